"""Balances at many times: probes before, at and after rows, null times, accounts without rows or opening."""

from tallyforge.operators.balances import balance_at
from tallyforge.operators.series import asof_many


def test_balance_at_edges(spark):
    txn = spark.createDataFrame([("a", 10, 5), ("a", 10, 7), ("a", 20, -1), ("b", 15, 3), ("x", 1, 9)], "account string, epoch long, amount long")
    accounts = spark.createDataFrame([("a", 100), ("idle", 4), ("b", -2)], "name string, start_value long")
    probes = [("a", 9, 1), ("a", 10, 2), ("a", 11, 3), ("a", 20, 4), ("a", 21, 5), ("a", None, 6), ("idle", 99, 7), ("x", 2, 8), ("x", 1, 9),
              ("new", 5, 10), ("b", 16, 11), ("b", 16, 11)]
    got = balance_at(txn, accounts, spark.createDataFrame(probes, "account string, at long, tag int"))
    assert got.columns == ["account", "at", "tag", "balance"]
    want = {1: 100, 2: 100, 3: 112, 4: 112, 5: 111, 6: 100, 7: 4, 8: 9, 9: 0, 10: 0, 11: 1}
    rows = got.collect()
    assert len(rows) == len(probes) and all(want[r["tag"]] == r["balance"] for r in rows)


def test_asof_many_edges(spark):
    series = spark.createDataFrame([("g", 0, 10), ("g", 5, 12), ("g", 9, 3), ("h", -4, 1)], "grp string, epoch long, balance long")
    starts = spark.createDataFrame([("g", 10), ("h", 6)], "grp string, start long")
    probes = spark.createDataFrame([("g", 0), ("g", 5), ("g", 6), ("g", 100), ("g", -1), ("h", -4), ("h", 0), ("none", 3)], "grp string, epoch long")
    got = {(r["grp"], r["epoch"]): r["balance"] for r in asof_many(series, probes, starts).collect()}
    assert got == {("g", 0): 10, ("g", 5): 10, ("g", 6): 12, ("g", 100): 3, ("g", -1): 10, ("h", -4): 6, ("h", 0): 1, ("none", 3): None}
