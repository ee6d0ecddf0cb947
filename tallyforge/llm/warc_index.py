"""WARC archives with a two-level capture index.

Writing: each task writes the records of its pages to one archive, every record a gzip member of its
own.  Of pages with equal payloads (SHA-1) the largest ``page_id`` is kept whole (``response``), the
others are ``revisit`` records that name it and keep the HTTP header only.

Index: one line per record, ``surt timestamp page_id archive offset length``, sorted by the SURT key
(host reversed, then path).  A range partition writes its lines as zlib blocks of ``LINES`` lines to one
index file whose tail is a sparse directory (first key, offset and length of each block).  The list of
index files with their first keys is the level above.

Reading one key binary-searches the file list, then that file's directory, range-reads one or more
blocks and range-reads the records.  ``read_archives`` goes through all blocks of the index instead.

Defined results: a null payload is the empty payload; a null ``url`` is the empty URL; a null
``page_id`` is the smallest; of repeated rows of the largest ``page_id`` one is the response and the
others revisit it; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import open_fs, put_file, read_table, scratch, ship, written

LINES = 1000  # lines of an index block
HOT_SHARE = 500  # payloads of more than one in so many rows are joined by broadcast: fewer than that
DATE = "2024-01-01T00:00:00Z"


# Blanks, controls and line or paragraph separators are percent-encoded: a key is one word of one index line.
_BREAKS = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def surt(url: str | None) -> str:
    """``http://www.a.com:80/b?c`` -> ``com,a,www:80)/b?c`` (host lower-case, no scheme or fragment)."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.partition("#")[0]
    host, slash, path = rest.partition("/")
    host, colon, port = host.lower().partition(":")
    key = ",".join(reversed(host.split("."))) + colon + port + ")" + slash + path
    return _BREAKS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), key)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=False)[1:-1]}",
             f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers of a record (lower-case names), its HTTP headers under ``http`` and its ``payload``."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(out["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    http, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return out


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``revisit`` and ``refers_to``.  A payload that very many pages share
    is not shuffled to one task: at most ``HOT_SHARE`` of them are joined by broadcast."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = pages.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    groups = written(groups.where("n > 1"), "payload-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") * HOT_SHARE > total).select("sha", F.col("last").alias("hot_last"), F.lit(True).alias("is_hot"))
    rest = groups.where(F.col("n") * HOT_SHARE <= total).select("sha", F.col("last").alias("rest_last"), F.lit(True).alias("is_rest"))
    tagged = pages.join(F.broadcast(hot), "sha", "left")  # fewer than HOT_SHARE rows
    # hot payloads get a key of their own, so the shuffled join spreads them
    key = F.when(F.col("is_hot"), F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.col("sha"))
    tagged = tagged.withColumn("key", key).join(rest.withColumnRenamed("sha", "key"), "key", "left")
    shared = F.coalesce("is_hot", "is_rest", F.lit(False))
    last = F.coalesce("hot_last", "rest_last")
    tagged = tagged.withColumn("shared", shared).withColumn("last", last)
    is_last = F.col("shared") & F.col("page_id").eqNullSafe(F.col("last"))
    # only rows of the largest id compete; repeated ones are told apart
    k = F.row_number().over(Window.partitionBy("key", "page_id").orderBy("url"))
    tagged = tagged.withColumn("revisit", F.col("shared") & (~is_last | (k > 1)))
    return tagged.select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives under ``folder/archive``; returns the index lines ``surt, page_id, archive, offset, length``."""
    ship(pages.sparkSession)

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        rows, at = [], 0

        def chunks():
            nonlocal at
            for b in batches:
                for page, url, html, revisit, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                    got = record(page, url, html.encode(), refers, revisit)
                    rows.append((surt(url), page, name, at, len(got)))
                    at += len(got)
                    yield got

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        put_file(f"{folder}/archive/{name}", (c for part in ((first,), stream) for c in part))
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["surt", "page_id", "archive", "offset", "length"])

    return pages.mapInArrow(run, "surt string, page_id long, archive string, offset long, length long")


def write_index(lines: DataFrame, folder: str, files: int) -> None:
    """Sorted, compressed index files with sparse directories, and ``files.json``, the level above."""
    ship(lines.sparkSession)

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():06d}.cdxz"
        directory, keys = [], []

        def chunks():
            at, block, first = 0, [], None

            def close():
                z = zlib.compress("".join(block).encode())
                directory.append((first, at, len(z)))
                return z

            for b in batches:
                for key, page, archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("surt", "page_id", "archive", "offset", "length"))):
                    first = key if not block else first
                    block.append(f"{key} {'-' if page is None else page} {archive} {offset} {length}\n")
                    if not keys:
                        keys.append(key)
                    if len(block) == LINES:
                        z = close()
                        at += len(z)
                        block = []
                        yield z
            if block:
                z = close()
                at += len(z)
                yield z
            tail = zlib.compress(json.dumps(directory).encode())
            yield tail + struct.pack("<Q", len(tail))

        stream = chunks()
        put_file(f"{folder}/index/{name}", stream)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([keys[0]])], ["file", "first"])

    ordered = lines.repartitionByRange(files, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    listed = ordered.mapInArrow(run, "file string, first string").collect()  # a row per index file
    put_file(f"{folder}/files.json", [json.dumps(sorted((r["first"], r["file"]) for r in listed)).encode()])


class Index:
    """Reader of the two levels; holds the file list and, per file asked for, its sparse directory."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        with self.fs.open_input_stream(f"{self.root}/files.json") as f:
            self.files = json.loads(f.read())
        self.open: dict = {}

    def directory(self, name: str):
        if name not in self.open:
            f = self.fs.open_input_file(f"{self.root}/index/{name}")
            (n,) = struct.unpack("<Q", f.read_at(8, f.size() - 8))
            self.open[name] = f, json.loads(zlib.decompress(f.read_at(n, f.size() - 8 - n)))
        return self.open[name]

    def lines(self, name: str, blocks=None):
        f, directory = self.directory(name)
        for _, at, n in directory if blocks is None else blocks:
            for line in zlib.decompress(f.read_at(n, at)).decode().split("\n"):
                if not line:
                    continue
                key, page, archive, offset, length = line.split(" ")
                yield key, (None if page == "-" else int(page)), archive, int(offset), int(length)

    def find(self, url: str) -> list:
        """Captures of one URL: two binary searches, then range reads of the blocks that can hold it."""
        key, out = surt(url), []
        firsts = [x[0] for x in self.files]
        for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            _, directory = self.directory(self.files[k][1])
            keys = [x[0] for x in directory]
            blocks = directory[max(0, bisect.bisect_left(keys, key) - 1) : bisect.bisect_right(keys, key)]
            out += [x for x in self.lines(self.files[k][1], blocks) if x[0] == key]
        return out

    def read(self, archive: str, offset: int, length: int) -> dict:
        if archive not in self.open:
            self.open[archive] = self.fs.open_input_file(f"{self.root}/archive/{archive}")
        return parse_record(self.open[archive].read_at(length, offset))


def read_archives(spark, folder: str) -> DataFrame:
    """Every record, found through the index and read by its range."""
    ship(spark)
    index = Index(folder)
    files = [(name,) for _, name in index.files]
    schema = "archive string, offset long, length long"

    def entries(batches):
        own = Index(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = [(a, o, n) for _, _, a, o, n in own.lines(name)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 10_000])], ["archive", "offset", "length"])

    listed = spark.createDataFrame(files, "file string").repartition(max(1, len(files)), "file").mapInArrow(entries, schema)

    def records(batches):
        own = Index(folder)
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                r = own.read(archive, offset, length)
                whole = r["warc-type"] == "response"
                if whole and "sha1:" + digest32(r["payload"]) != r["warc-payload-digest"]:
                    raise ValueError(f"{archive} at {offset}: the payload has another digest")
                number = lambda s: int(s) if s else None
                rows.append((number(r["x-page-id"]), len(r["payload"]) if whole else int(r["http"]["content-length"]),
                             r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number(r.get("x-refers-to-page-id"))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # neighbours in an archive are read by the same task, in order
    spread = listed.withColumn("stretch", F.floor(F.col("offset") / (8 << 20)))
    spread = spread.repartition("archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    return spread.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a record, indexed and read back."""
    folder = scratch(spark, "warc")
    lines = written(write_archives(decide(read_table(spark, sf_dir, "pages")), folder), "captures")
    write_index(lines, folder, max(1, lines.count() // 100_000 + 1))
    return read_archives(spark, folder)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, count(*) AS n, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('{_BASE32}', CAST(1 + ((CAST(('0x' || substr(p.h, CAST(1 + (i // 4) * 5 AS INT), 5)) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN g USING (h)
"""
