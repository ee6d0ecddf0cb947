"""Benchmark: headline ledger queries on the driver tables.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints ONE
JSON line.  Each query is forced with the ``noop`` sink (full computation, nothing collected);
the reported time per query is the median of ``$BENCH_RUNS`` warm runs (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.plans import driver_queries as D  # noqa: E402
from tallyforge.session import local_session  # noqa: E402

HEADLINE = [
    "txn_ids", "statement", "derived_txn", "transfer_pairs", "ledger_entries", "unaccounted",
    "events_unaccounted", "geo_series_totals", "hot_statement", "hot_unaccounted",
]


def calibration(spark) -> float:
    """Plain Spark work of a fixed size: how fast the machine is in this run."""
    from pyspark.sql import functions as F
    df = spark.range(0, 4_000_000, 1, 8).select((F.col("id") % 1000).alias("k"), F.xxhash64("id").alias("v"))
    df = df.groupBy("k").agg(F.sum(F.col("v").cast("double")).alias("s")).orderBy("k")
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    scratch = tempfile.mkdtemp(prefix="tally-bench-")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, scratch=scratch,
                          app="tallyforge-bench")
    qs = D.queries()
    # Warm-up: JVM, codegen caches and file listing.
    qs["txn_ids"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    def timed(name: str) -> float:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        return round(statistics.median(samples), 3)

    loops = [calibration(spark) for _ in range(3)]
    times = {name: timed(name) for name in HEADLINE}
    loops += [calibration(spark) for _ in range(3)]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "calibration_sec": round(statistics.median(loops), 3),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "spark": spark.version,
        "cores": cpus,
        "runs": runs,
        "warm": True,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
