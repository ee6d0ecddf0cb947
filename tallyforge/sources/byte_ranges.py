"""Files by byte ranges: listings without contents, first records (S1), arrays of large JSON files.

Bytes are read in tasks, with the file systems pyarrow opens (local, hdfs, s3, gs).  The functions that run
in tasks are self-contained and shipped by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

PART_BYTES = 8 << 20  # bytes of a file that one task scans
CHUNK_ROWS = 1000  # array elements in one row of text
PROBE_BYTES = 1 << 12  # first read of a file's head


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``uri`` (as ``_metadata.file_path`` has it), ``path``, ``length`` of the files; contents are not read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_path").alias("uri"), "path", "length")


def _opener():
    """path -> an open random-access file."""
    def opened(path: str):
        from urllib.parse import quote

        from pyarrow import fs

        if path.startswith("file:"):
            return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
        if "://" not in path:
            return fs.LocalFileSystem().open_input_file(path)
        system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@?&=%+"))
        return system.open_input_file(inner)

    return opened


def first_records(files: DataFrame, quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """``uri, value``: the first record of each file that is not blank, without a byte-order mark.  A line
    feed inside quotes belongs to the record.  Only as many bytes as it takes are read; files of blank lines
    only give no row."""
    opened, first = _opener(), PROBE_BYTES

    def run(batches):
        import pyarrow as pa

        for b in batches:
            uris, values = [], []
            for uri, path, length in zip(*(b.column(c).to_pylist() for c in ("uri", "path", "length"))):
                size = first
                with opened(path) as f:
                    while True:
                        f.seek(0)
                        # a character cut at the end of the read is left out
                        text = f.read(size).decode(encoding, errors="ignore").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                        record, open_ = "", False
                        whole = size >= length
                        for line in text.split("\n") if whole else text.split("\n")[:-1]:
                            record = f"{record}\n{line}" if open_ else line
                            open_ = bool(quote) and record.count(quote) % 2 == 1
                            if not open_ and record.strip():
                                break
                        else:
                            if not whole:
                                size *= 4
                                continue
                        if record.strip():
                            uris.append(uri)
                            values.append(record)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(values, pa.string())], ["uri", "value"])

    return files.select("uri", "path", "length").mapInArrow(run, "uri string, value string")


def _parts(files: DataFrame, part_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(part_bytes).cast("long"))
    parts = files.select("path", "length", F.explode(starts).alias("start"))
    return parts.withColumn("stop", F.least(F.col("start") + part_bytes, F.col("length")))


def _survey():
    """Per part and for both states at its start (outside and inside a string): whether the state flips, the
    change of depth, and its square brackets (place, depth before and after, whether the field opens)."""
    opened = _opener()

    def run(batches, field: str):
        import re

        import numpy as np
        import pyarrow as pa

        before_array = re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*$')
        bracket = pa.struct([("at", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("named", pa.bool_())])
        for b in batches:
            for path, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop"))):
                with opened(path) as f:
                    back = min(start, 256)
                    while True:  # as far back as blanks or backslashes reach, and the field's name before
                        f.seek(start - back)
                        data = f.read(back + stop - start)
                        if back == start or len(data[:back].rstrip(b" \t\r\n\\:")) > len(field) + 8:
                            break
                        back = min(start, back * 4)
                a = np.frombuffer(data, np.uint8)
                # a quote counts if the run of backslashes before it is even
                place = np.arange(len(a))
                other = np.maximum.accumulate(np.where(a != 92, place, -1))
                run_before = np.concatenate([[0], (place - other)[:-1]])
                quotes = ((a == 34) & (run_before % 2 == 0))[back:]
                a = a[back:]
                inside = (np.cumsum(quotes) - quotes) % 2 == 1
                sides = []
                for state in (False, True):
                    free = inside == state
                    step = np.zeros(len(a), np.int64)
                    step[free & ((a == 123) | (a == 91))] = 1
                    step[free & ((a == 125) | (a == 93))] = -1
                    depth = np.cumsum(step)
                    at = np.flatnonzero(free & ((a == 91) | (a == 93)))
                    rows = [{"at": start + int(k), "before": int(depth[k] - step[k]), "after": int(depth[k]),
                             "named": bool(a[k] == 91 and before_array.search(data[max(0, back + k - 4096): back + k]))} for k in at]
                    sides.append((int(depth[-1]) if len(a) else 0, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([start]), pa.array([stop]), pa.array([int(quotes.sum() % 2)]),
                     pa.array([sides[0][0]]), pa.array([sides[1][0]]), pa.array([sides[0][1]], pa.list_(bracket)), pa.array([sides[1][1]], pa.list_(bracket))],
                    ["path", "start", "stop", "flips", "d0", "d1", "b0", "b1"])

    return run


def json_array_parts(files: DataFrame, field: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """The array ``field`` of files that hold one JSON object each, read by byte ranges, so that one long file
    is the work of many tasks.  Gives two frames:

    - ``path, start, held, first, chunk``: JSON arrays of up to 1,000 elements as text; ``first`` is the place
      of the chunk's first element among the ``held`` ones that begin in the part at ``start``;
    - ``path, head``: each file's object without the array's elements.

    Whether a part starts inside a string, and how deep, follows from sums over the parts before it.  The
    elements are objects; files without the array have only a head."""
    survey = _survey()
    bracket = "array<struct<at:long,before:long,after:long,named:boolean>>"
    parts = _parts(files, part_bytes).repartition("path", "start")
    seen = parts.select("path", "start", "stop").mapInArrow(
        lambda batches: survey(batches, field),
        f"path string, start long, stop long, flips long, d0 long, d1 long, b0 {bracket}, b1 {bracket}")
    seen = materialize(seen, "json-parts")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = seen.select("path", "start", "stop", "d0", "d1", (F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    own = F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))
    known = known.withColumn("depth", F.coalesce(F.sum(own).over(earlier), F.lit(0))).select("path", "start", "stop", "inside", "depth")
    marks = known.join(seen.select("path", "start", "b0", "b1"), ["path", "start"])
    marks = marks.select("path", "depth", F.explode(F.when(F.col("inside"), F.col("b1")).otherwise(F.col("b0"))).alias("m"))
    marks = marks.select("path", F.col("m.at").alias("at"), (F.col("depth") + F.col("m.before")).alias("before"),
                         (F.col("depth") + F.col("m.after")).alias("after"), F.col("m.named").alias("named"))
    opens = marks.where("named and before = 1 and after = 2").groupBy("path").agg(F.min("at").alias("from"))
    closes = marks.where("before = 2 and after = 1").join(opens, "path").where("at > from").groupBy("path", "from").agg(F.min("at").alias("to"))
    spans = materialize(closes, "json-arrays")
    opened, chunk_rows = _opener(), CHUNK_ROWS

    def elements(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, start, stop, inside, depth, lo, hi in zip(
                    *(b.column(c).to_pylist() for c in ("path", "start", "stop", "inside", "depth", "from", "to"))):
                if hi < start or lo >= stop:
                    continue
                with opened(path) as f:
                    back = min(start, 64)
                    while True:
                        f.seek(start - back)
                        lead = f.read(back)
                        if back == start or lead.rstrip(b"\\"):
                            break
                        back = min(start, back * 4)
                    escaped = (len(lead) - len(lead.rstrip(b"\\"))) % 2
                    f.seek(start)
                    data, end = f.read(stop - start), stop
                    while True:
                        a = np.frombuffer(data, np.uint8)
                        place = np.arange(len(a))
                        other = np.maximum.accumulate(np.where(a != 92, place, -1))
                        run_before = np.concatenate([[0], (place - other)[:-1]])
                        leading = np.concatenate([[True], (other < 0)[:-1]])  # only backslashes before, in this part
                        quotes = (a == 34) & ((run_before + np.where(leading, escaped, 0)) % 2 == 0)
                        free = (np.cumsum(quotes) - quotes + inside) % 2 == 0
                        step = np.zeros(len(a), np.int64)
                        step[free & ((a == 123) | (a == 91))] = 1
                        step[free & ((a == 125) | (a == 93))] = -1
                        deep = depth + np.cumsum(step)
                        begins = np.flatnonzero((a == 123) & (step == 1) & (deep == 3))
                        begins = begins[(begins < stop - start) & (begins + start > lo) & (begins + start < hi)]
                        ends = np.flatnonzero((a == 125) & (step == -1) & (deep == 2))
                        if not len(begins) or (len(ends) and ends[-1] > begins[-1]):
                            break
                        more = f.read(max(1 << 16, end - start))  # the last element goes on in the next part
                        if not more:
                            begins = begins[:-1]
                            break
                        data, end = data + more, end + len(more)
                if not len(begins):
                    continue
                ends = ends[np.searchsorted(ends, begins)]
                firsts, chunks = [], []
                for k in range(0, len(begins), chunk_rows):
                    last = min(k + chunk_rows, len(begins)) - 1
                    firsts.append(k)
                    chunks.append("[" + data[begins[k]: ends[last] + 1].decode("utf-8", errors="replace") + "]")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(firsts)), pa.array([start] * len(firsts)), pa.array([len(begins)] * len(firsts)), pa.array(firsts), pa.array(chunks)],
                    ["path", "start", "held", "first", "chunk"])

    def heads(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, length, lo, hi in zip(*(b.column(c).to_pylist() for c in ("path", "length", "from", "to"))):
                with opened(path) as f:
                    if lo is None:
                        text = f.read()
                    else:
                        text = f.read(lo + 1)
                        f.seek(hi)
                        text += f.read(length - hi)
                out.append(text.decode("utf-8-sig", errors="replace"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "head"])

    work = known.join(spans, "path").repartition("path", "start")
    rows = work.mapInArrow(elements, "path string, start long, held long, first long, chunk string")
    tops = files.select("path", "length").join(spans, "path", "left").mapInArrow(heads, "path string, head string")
    return rows, tops
