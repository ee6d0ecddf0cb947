"""The physical plans keep the properties the design relies on at scale."""

from pyspark.sql import functions as F

from tallyforge.operators import transfers as T
from tallyforge.operators.rules import match_rules
from tallyforge.plans.ledgers import orders_ledger

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_match_in_one_scan_with_pruned_columns(spark):
    lf = orders_ledger(spark, SF)
    plan = _plan(match_rules(lf.raw.withColumnRenamed("src_row", "seq").withColumn("id", lf.raw.account),
                             lf.mapping.derived))
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1
    assert "Generate explode" in plan and "Join" not in plan and "Exchange" not in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "o_comment" not in scan and "o_clerk" not in scan


def test_numbered_tables_join_nothing_on_an_account(spark):
    """Statements and the unaccounted list read their written scan: no shuffle, one join with a row per range."""
    lf = orders_ledger(spark, SF)
    for df in (lf.txn, lf.statement(), lf.unaccounted, lf.derived_statement()):
        plan = _plan(df)
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert any("/tables/scan-" in f for f in df.inputFiles())


def test_transfer_sides_are_zipped_not_joined(spark):
    lf = orders_ledger(spark, SF)
    plan = _plan(T.transfer_matches(lf.txn, lf.transfer_mappings))
    assert "FullOuter" not in plan and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning(mapping_no") == 1 and "_block" in plan


def test_transfer_blocks_change_nothing(spark, monkeypatch):
    lf = orders_ledger(spark, SF)
    hot = lf.transfer_mappings.where("mapping_no = 1").withColumn("from_regex", F.lit("")).withColumn("to_regex", F.lit("LOW"))
    want = sorted(map(str, T.transfer_matches(lf.txn, hot).collect()))
    monkeypatch.setattr(T, "RANK_BLOCK", 2)
    assert len(want) > 4 and sorted(map(str, T.transfer_matches(lf.txn, hot).collect())) == want
