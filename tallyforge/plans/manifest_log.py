"""Versioned snapshots of a ledger store: I6 and the multi-table part of S10, S11 and I5.

A version says everything about a store at one time: the recorded keys, the source files they were built from, and the
data folders (``parts``) that make up each table.  Data folders are written once and never changed.  A version
becomes visible by the creation of its log entry, ``log/<number>.json``, which fails when that number exists:
of two refreshes that start from the same version one commits, the other raises ``ConcurrentRefresh`` and changes nothing.
Readers take the newest entry, so they see all tables of one version, also while a refresh runs or after it crashed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "object_name string, fingerprint string"
FILES = "account string, rel string, mtime timestamp, length long"
PARTS = "table string, part string, path string"
SCHEMAS = {"keys": KEYS, "files": FILES, "parts": PARTS}


class ConcurrentRefresh(RuntimeError):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


@dataclass
class Snapshot:
    """One version of a store; version 0 is the empty store."""
    spark: SparkSession
    version: int
    state: str | None

    def _read(self, what: str) -> DataFrame:
        if self.state is None:
            return self.spark.createDataFrame([], SCHEMAS[what])
        return self.spark.read.schema(SCHEMAS[what]).parquet(f"{self.state}/{what}")

    @property
    def keys(self) -> DataFrame:
        """The recorded keys; a name that is not recorded counts as ``0``."""
        return self._read("keys")

    @property
    def files(self) -> DataFrame:
        return self._read("files")

    @property
    def parts(self) -> DataFrame:
        return self._read("parts")

    def has(self, table: str) -> bool:
        return not self.parts.where(F.col("table") == table).isEmpty()

    def table(self, table: str, parts: DataFrame | None = None) -> DataFrame | None:
        """A table of this version, or the rows of some of its parts (column ``part``); None when it has none."""
        own = self.parts.where(F.col("table") == table)
        if parts is not None:
            own = own.join(parts.select("part").distinct(), "part", "left_semi")
        paths = [r["path"] for r in own.select("path").distinct().collect()]  # folders: at most buckets x refreshes
        return self.spark.read.parquet(*paths) if paths else None


class ManifestLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        fs, path = _fs(self.spark, self.root)
        log = path(f"{self.root}/log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or a given one."""
        known = self._versions()
        if not known:
            return Snapshot(self.spark, 0, None)
        n = known[-1] if version is None else version
        line = self.spark.read.text(f"{self.root}/log/{n}.json").first()[0]
        return Snapshot(self.spark, n, f"{self.root}/{json.loads(line)['state']}")

    def commit(self, base: Snapshot, keys: DataFrame, files: DataFrame, parts: DataFrame) -> int:
        """Publish a version after ``base``; raises ``ConcurrentRefresh`` when another one came first."""
        state = f"states/{uuid.uuid4().hex}"
        for name, df in (("keys", keys), ("files", files), ("parts", parts)):
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            df.select(*columns).write.mode("errorifexists").parquet(f"{self.root}/{state}/{name}")
        return self._publish(base, state)

    def _publish(self, base: Snapshot, state: str) -> int:
        fs, path = _fs(self.spark, self.root)
        number = base.version + 1
        if self._versions()[-1:] not in ([], [base.version]):
            raise ConcurrentRefresh(f"{self.root}: version {number} exists already")
        fs.mkdirs(path(f"{self.root}/log"))
        ready = path(f"{self.root}/log/.{uuid.uuid4().hex}.tmp")
        out = fs.create(ready, False)
        out.write(bytearray(json.dumps({"state": state}).encode()))
        out.close()
        # a rename onto an existing name fails on HDFS; elsewhere the check before it decides
        target = path(f"{self.root}/log/{number}.json")
        if fs.exists(target) or not fs.rename(ready, target):
            fs.delete(ready, False)
            raise ConcurrentRefresh(f"{self.root}: version {number} exists already")
        return number

    def clear(self, names: DataFrame) -> int:
        """Forget the keys of some objects (column ``object_name``): the next refresh builds them anew.  Tables
        stay as they are."""
        base = self.snapshot()
        left = base.keys.join(names.select("object_name").distinct(), "object_name", "left_anti")
        return self.commit(base, left, base.files, base.parts)
