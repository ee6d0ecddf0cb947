"""The ordered scan equals the naive window: hot keys, null keys, many ranges, sums and last values."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators.identity import ORDER, identify, valid_raw
from tallyforge.operators.sequencing import ordered_scan


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _data(spark, n=6000):
    return spark.range(0, n).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 41 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 37).cast("string"))).alias("k"),
        (F.lit(1_600_000_000) + (F.col("id") * 7919 % 5000) * 3600).alias("epoch"),
        (F.col("id") * 31 % 1000003).alias("tb"),
        (F.col("id") % 17 - 8).alias("amt"), F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("mark"))


@pytest.fixture()
def many_ranges(spark):
    """Small ranges that are not coalesced: keys go on over several of them."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def test_positions_sums_and_last_values_match_windows(spark, many_ranges):
    df = _data(spark)
    got = ordered_scan(df, ["k"], ["epoch", "tb"], sums=["amt"], lasts=["mark"], index="idx")
    w = Window.partitionBy("k").orderBy("epoch", "tb")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("idx", F.row_number().over(w).cast("long") - 1).withColumn("_run_amt", F.sum("amt").over(upto)).withColumn(
        "_last_mark", F.last("mark", ignorenulls=True).over(upto))
    assert _same(got, exp)


def test_small_batches_change_nothing(spark, many_ranges):
    df = _data(spark, 900)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    saved = spark.conf.get(size)
    want = ordered_scan(df, ["k"], ["epoch", "tb"], sums=["amt"], lasts=["mark"])
    try:
        spark.conf.set(size, "1")
        got = ordered_scan(df, ["k"], ["epoch", "tb"], sums=["amt"], lasts=["mark"])
        assert _same(got, want)
    finally:
        spark.conf.set(size, saved)


def test_one_order_over_all_rows(spark, many_ranges):
    df = _data(spark, 3000)
    got = ordered_scan(df, [], ["k", "epoch", "tb"], sums=["amt"], index="i")
    w = Window.orderBy("k", "epoch", "tb")
    exp = df.withColumn("i", F.row_number().over(w).cast("long") - 1).withColumn(
        "_run_amt", F.sum("amt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert _same(got, exp)


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "k string, o long, v long")
    assert ordered_scan(df, ["k"], ["o"], sums=["v"]).collect() == []
    one = spark.createDataFrame([(None, 1, None)], "k string, o long, v long")
    assert [tuple(r) for r in ordered_scan(one, ["k"], ["o"], sums=["v"], lasts=["v"]).collect()] == [(None, 1, None, 0, 0, None)]


def test_descending_order(spark, many_ranges):
    df = _data(spark, 2000)
    got = ordered_scan(df, ["k"], [F.col("epoch").desc(), "tb"], index="i").select("k", "tb", "i")
    w = Window.partitionBy("k").orderBy(F.col("epoch").desc(), "tb")
    assert _same(got, df.select("k", "tb", (F.row_number().over(w).cast("long") - 1).alias("i")))


def _hot_raw(spark):
    return spark.range(0, 4000).select(
        F.when(F.col("id") % 3 != 0, F.lit("HOT")).otherwise(F.format_string("A%03d", F.col("id") % 11)).alias("account"),
        F.to_date(F.lit("2020-01-01")).alias("date"),
        (F.lit(1577836800) + (F.col("id") % 4) * 86400).alias("epoch"),  # many equal timestamps
        (F.col("id") - 2000).alias("amount"),
        F.lit("x").alias("description"), F.lit("f.csv").alias("src_file"),
        F.lit(0).cast("bigint").alias("src_block"), (F.col("id") * 13 % 4001).alias("src_row"))


def test_identify_hot_account_matches_naive(spark, many_ranges):
    raw = _hot_raw(spark)
    w = Window.partitionBy("account").orderBy(*ORDER)
    exp = valid_raw(raw).select("account", "src_row", (F.row_number().over(w).cast("long") - 1).alias("seq"))
    assert _same(identify(raw).select("account", "src_row", "seq"), exp)


def test_opening_balances_join_the_scan(spark, many_ranges):
    raw = _hot_raw(spark)
    accounts = spark.createDataFrame([("HOT", "source", 500), ("A003", "source", -7), ("idle", "source", 9)],
                                     "name string, kind string, start_value bigint")
    got = identify(raw, accounts)
    assert _same(got.drop("balance"), identify(raw))
    w = Window.partitionBy("account").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("account") == "HOT", 500).when(F.col("account") == "A003", -7).otherwise(0)
    exp = raw.select("account", "src_row", (start + F.sum("amount").over(w)).alias("balance"))
    assert _same(got.select("account", "src_row", "balance"), exp)


def test_derived_numbering_matches_the_window(spark, many_ranges):
    from tallyforge.operators import rules as R
    from tallyforge.plans.ledgers import orders_ledger
    lf = orders_ledger(spark, "/root/testdata/sf0.001")
    got = R.derived_transactions(lf.txn, lf.mapping.derived)
    w = Window.partitionBy("derived_account").orderBy("epoch", "matching_no", "source_account", "source_seq")
    exp = got.withColumn("seq", F.row_number().over(w).cast("long") - 1)
    assert got.count() > 0 and _same(got, exp)
