"""SURVEY 5(c): ledger invariants on the driver tables (orders and events ledgers, sf0.001)."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ledger as L
from tallyforge.operators import transfers as T
from tallyforge.plans.ledgers import events_ledger, orders_ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["orders", "events"])
def lf(request, spark):
    return (orders_ledger if request.param == "orders" else events_ledger)(spark, SF)


def test_accounted_and_unaccounted_partition_source_ids(lf):
    txn = lf.txn.select("account", "id")
    acc = L.accounted_ids(lf.entries).select("account", "id").distinct().join(txn, ["account", "id"], "left_semi")
    n_un = lf.unaccounted.count()
    assert acc.count() + n_un == txn.count()
    idx = [r["index"] for r in lf.unaccounted.select("index").collect()]
    assert sorted(idx) == list(range(n_un))


def test_derived_total_is_minus_matched_source_total(lf):
    d = lf.derived_txn.agg(F.sum("amount")).first()[0] or 0
    src = (lf.derived_txn.select(F.col("source_account").alias("account"), F.col("source_id").alias("id"))
           .join(lf.txn, ["account", "id"]).agg(F.sum("amount")).first()[0] or 0)
    assert d == -src


def test_last_running_balance_is_end_balance(lf):
    st = lf.statement()
    last = st.groupBy("account").agg(F.max_by("balance", "seq").alias("last"))
    end = lf.source_balances().select(F.col("name").alias("account"), "end_value")
    assert last.join(end, "account").where("last <> end_value").count() == 0


def test_paired_plus_unpaired_is_matched(lf):
    m = lf.transfer_matches
    pairs = T.transfer_pairs(m).count()
    un = T.unpaired(m).groupBy("side").count().collect()
    un = {r["side"]: r["count"] for r in un}
    rep = T.transfer_report(lf.transfer_mappings, m).agg(F.sum("n_from"), F.sum("n_to")).first()
    assert pairs + un.get("from", 0) == (rep[0] or 0)
    assert pairs + un.get("to", 0) == (rep[1] or 0)
