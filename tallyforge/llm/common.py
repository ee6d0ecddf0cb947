"""Helpers shared by the text operators: tables, shared folders, shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  A local master (tests) may leave it unset and
    then gets a temporary folder; on a cluster an unset folder is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage and
    survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per application)."""
    sc = spark.sparkContext
    # rows of text are long: a worker holds so many at a time (a caller's own setting stays)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # not when the package itself runs from a zip that was shipped before
        path = os.path.join(tempfile.mkdtemp(prefix="llm-ship-"), f"tallyforge_llm_{os.getpid()}.zip")
        with zipfile.ZipFile(path, "w") as z:
            z.write(os.path.join(root, "__init__.py"), "tallyforge/__init__.py")
            here = os.path.dirname(os.path.abspath(__file__))
            for f in sorted(os.listdir(here)):
                if f.endswith(".py"):
                    z.write(os.path.join(here, f), f"tallyforge/llm/{f}")
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def open_fs(uri: str):
    """(pyarrow filesystem, path) for a URI of the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write ``chunks`` (bytes) to ``uri`` under a temporary name and rename: a retried task replaces
    the whole file, readers never see half of one.  Returns the bytes written."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(tmp, compression=None) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(tmp, path)
    return n


FILTER_BITS = 1 << 23


def likely(rows: DataFrame, ids: DataFrame, others: bool = False) -> DataFrame:
    """Rows whose ``doc_id`` may be among ``ids`` or, with ``others``, those whose id is not for certain.
    The filter has a fixed size; it spares most rows a shuffle, and a join decides about what it lets
    pass (with very many ids it lets all pass)."""
    from pyspark.sql import functions as F

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    slots = ids.select(slot.alias("slot"))
    bits = slots.groupBy(F.expr("slot div 62").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, slot % 62))").alias("_bits"))
    met = rows.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 62"))
    met = met.join(F.broadcast(bits), "_word", "left")  # at most FILTER_BITS / 62 rows
    hit = F.coalesce(F.expr("shiftright(_bits, _slot % 62) & 1 = 1"), F.lit(False))
    return met.where(~hit if others else hit).select(*rows.columns)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text expression (it has no such function): the
    bitwise definition with the reflected polynomial 0xEDB88320."""
    byte = "lambda z, k: xor(z >> 1, 3988292384 * (z & 1))"
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ord(x) AS bigint))"
    folded = (f"list_reduce(list_prepend(cast(4294967295 AS bigint), {codes}), "
              f"lambda s, x: list_reduce(list_prepend(xor(s, x), cast(range(8) AS bigint[])), {byte}))")
    return f"xor({folded}, 4294967295)"
