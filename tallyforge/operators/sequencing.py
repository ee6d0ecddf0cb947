"""Positions, running sums and last values in a given order, by one plan for data of every size.

Positions drive the ledger: transaction IDs hash the row index, transfers pair the k-th match on
each side, statements carry a running balance and the unaccounted list has a global index.  A
window ``partitionBy(account).orderBy(...)`` puts a whole account into one task, and one account
may hold a third of all rows.  ``ordered_scan`` computes the same numbers as a segmented scan:

1. the rows are range-partitioned by (keys, order) and sorted, the only shuffle of the data; the
   order is total, so a hot key is cut into as many ranges as its rows need;
2. each range is scanned once where it lies: positions and running values inside (range, key);
3. the scanned rows are written once, so every later read sees the same ranges, and the last
   row of each range carries the range's summary: its last key with that key's count, sums
   and last values;
4. a key goes on from one range into the next only where the one's last key is the other's first;
   the summaries are combined along those chains (two rows per range, on the driver, which also cuts
   the ranges) and what came before is added to the first key's rows of each range.  No row is
   joined on its key.

Nothing depends on the number of rows; what the driver sees and broadcasts has a row or two per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_RANGE, _OPEN, _EDGE = "__range", "__open", "__edge"
_HEAD, _TAIL = 1, 2


def _range_scanner(keys: Sequence[str], sums: Sequence[tuple[str, str]], lasts: Sequence[tuple[str, str]], index: str):
    """The scan of one sorted range as a function of its Arrow batches.  Self-contained: it is shipped to
    the executors by value."""
    keys, sums, lasts = list(keys), list(sums), list(lasts)
    head, tail = _HEAD, _TAIL
    flags = (_OPEN, _EDGE)

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def differs(col):
            """Whether each value but the first differs from the one before it; null equals null."""
            a, b = col.slice(1), col.slice(0, len(col) - 1)
            plain = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            return plain | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))

        held = None                      # the newest finished batch: it may hold the range's last row
        last_key, count, first_key = None, 0, True
        totals = [0] * len(sums)
        values = [None] * len(lasts)
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= differs(b.column(k))
            key = tuple(b.column(k)[0].as_py() for k in keys)
            begins = last_key is None    # the first row of the range
            new[0] = begins or key != last_key
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, 0))
            going_on = (start == 0) & (not new[0])
            position = at - start + np.where(going_on, count, 0)
            added = []
            for j, (name, _) in enumerate(sums):
                v = pc.fill_null(b.column(name), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                c = np.cumsum(v)
                run = c - (c[start] - v[start]) + np.where(going_on, totals[j], 0)
                totals[j] = int(run[-1])
                added.append(pa.array(run, pa.int64()))
            for j, (name, _) in enumerate(lasts):
                col = b.column(name)
                seen = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), at, -1))
                known = seen >= start
                filled = col.take(pa.array(np.where(known, seen, 0), pa.int64(), mask=~known))
                if values[j] is not None and going_on.any():
                    filled = pc.if_else(pa.array(going_on & ~known), pa.scalar(values[j], col.type), filled)
                values[j] = filled[-1].as_py()
                added.append(filled)
            if not begins and new[0]:
                first_key = False
            open_run = (np.cumsum(new) - (1 if new[0] else 0) == 0) if first_key else np.zeros(n, bool)
            if new[1:].any():
                first_key = False
            edge = np.zeros(n, np.int8)
            if begins:
                edge[0] = head
            last_key = tuple(b.column(k)[n - 1].as_py() for k in keys)
            count = int(position[-1]) + 1
            if held is not None:
                yield pa.RecordBatch.from_arrays(*held)
            held = ([*b.columns, pa.array(position, pa.int64()), *added, pa.array(open_run), pa.array(edge, pa.int8())],
                    [*b.schema.names, index, *[o for _, o in sums], *[o for _, o in lasts], *flags])
        if held is not None:
            cols, names = held
            edge = cols[-1].to_numpy().copy()
            edge[-1] |= tail
            cols[-1] = pa.array(edge, pa.int8())
            yield pa.RecordBatch.from_arrays(cols, names)

    return scan


def _carried(edges, keys, index: str, sums: Sequence[str], lasts: Sequence[str]) -> list[tuple]:
    """Per range whose first key began in an earlier range: (range, rows, sums and last values that the
    earlier ranges hold of that key)."""
    out = []
    key, count, totals, values = None, 0, [0] * len(sums), [None] * len(lasts)
    for e in sorted(edges, key=lambda e: (e[_RANGE], e[_EDGE] & _TAIL)):
        own = tuple(e[k] for k in keys)
        if e[_EDGE] & _HEAD:
            if key is not None and own == key:
                out.append((e[_RANGE], count, *totals, *values))
            else:
                key, count, totals, values = own, 0, [0] * len(sums), [None] * len(lasts)
        if e[_EDGE] & _TAIL:
            if own != key:  # another key began in this range
                key, count, totals, values = own, 0, [0] * len(sums), [None] * len(lasts)
            count += e[index] + 1
            totals = [t + e[s] for t, s in zip(totals, sums)]
            values = [v if e[c] is None else e[c] for v, c in zip(values, lasts)]
    return out


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Sequence[str] = (),
                 lasts: Sequence[str] = (), index: str = "_idx", run_prefix: str = "_run_",
                 last_prefix: str = "_last_") -> DataFrame:
    """Add ``index`` (0-based position inside ``keys`` by ``order``), per BIGINT column in ``sums`` the
    inclusive running sum ``run_prefix + name`` (null counts as 0) and per column in ``lasts`` the last
    non-null value up to and with the row, ``last_prefix + name``.

    No ``keys`` means one order over all rows.  ``order`` should be total inside ``keys``; rows
    that tie on all of it take neighbouring positions in an undefined order.  Null keys are one key.
    Ascending columns put nulls first; pass ``col.desc()`` and the like for other directions.
    The scanned rows are written once (see ``session.materialize``)."""
    keys = list(keys)
    by = [F.col(k).asc() for k in keys] + [F.col(o).asc() if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_RANGE, F.spark_partition_id())
    sum_cols = [(s, run_prefix + s) for s in sums]
    last_cols = [(c, last_prefix + c) for c in lasts]
    schema = T.StructType([
        *ranged.schema.fields, T.StructField(index, T.LongType()), *[T.StructField(o, T.LongType()) for _, o in sum_cols],
        *[T.StructField(o, ranged.schema[c].dataType) for c, o in last_cols],
        T.StructField(_OPEN, T.BooleanType()), T.StructField(_EDGE, T.ByteType())])
    rows = materialize(ranged.mapInArrow(_range_scanner(keys, sum_cols, last_cols, index), schema), "scan")

    # two rows per range reach the driver: its first and its last one
    outs = [index, *[o for _, o in sum_cols], *[o for _, o in last_cols]]
    edges = rows.where(F.col(_EDGE) > 0).select(*keys, _RANGE, _EDGE, *outs).collect()
    carry = _carried(edges, keys, index, [o for _, o in sum_cols], [o for _, o in last_cols])
    kept = T.StructType([T.StructField(_RANGE, T.IntegerType()), *[T.StructField("__c_" + f.name, f.dataType)
                                                                  for f in schema.fields if f.name in outs]])
    done = rows
    if carry:
        done = rows.join(F.broadcast(df.sparkSession.createDataFrame(carry, kept)), _RANGE, "left")  # one row per range
    else:
        done = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.fields[1:]])
    shown = [F.col(c) for c in df.columns]
    before = lambda o: F.when(F.col(_OPEN), F.col("__c_" + o))
    shown += [(F.col(o) + F.coalesce(before(o), F.lit(0))).alias(o) for o in (index, *[o for _, o in sum_cols])]
    shown += [F.coalesce(F.col(o), before(o)).alias(o) for _, o in last_cols]
    return done.select(*shown)


__all__ = ["ordered_scan"]
