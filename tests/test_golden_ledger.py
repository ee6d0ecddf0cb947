"""FIXTURES section 2: balances, matches, pairing, unaccounted rows and clipped series."""

from pyspark.sql import functions as F

from golden import write_golden
from tallyforge.functions.timefmt import bound_epoch
from tallyforge.operators import hierarchy as H
from tallyforge.operators import ledger as L
from tallyforge.operators import series as S
from tallyforge.operators import transfers as T
from tallyforge.plans.ledgers import ledger_from_folders


def _ledger(spark, workdir):
    return ledger_from_folders(spark, write_golden(workdir))


def test_source_and_derived_balances(spark, workdir):
    lf = _ledger(spark, workdir)
    src = {r["name"]: r["end_value"] for r in lf.source_balances().collect()}
    assert src == {"chequing": 79476, "visa": -8910}
    der = {r["name"]: r["end_value"] for r in lf.derived_balances().collect()}
    assert der == {"Coffee": 1725, "Groceries": 7010, "Salary": -99000}
    rows = sorted((r["derived_account"], r["amount"]) for r in lf.derived_txn.collect())
    assert rows == sorted([("Coffee", 525), ("Coffee", 1200), ("Groceries", 4000), ("Groceries", 3010),
                           ("Salary", -100000)])


def test_entries_transfers_unaccounted(spark, workdir):
    lf = _ledger(spark, workdir)
    entries = lf.entries.collect()
    assert len(entries) == 6
    assert sorted(e["delta"] for e in entries) == [525, 1200, 3010, 4000, 20000, 100000]
    rep = T.transfer_report(lf.transfer_mappings, lf.transfer_matches).collect()
    assert len(rep) == 1 and rep[0]["n_paired"] == 1 and rep[0]["in_sync"] and rep[0]["n_from"] == 2
    un = T.unpaired(lf.transfer_matches).collect()
    assert [(u["account"], u["amount"]) for u in un] == [("chequing", -5000)]
    unacc = sorted((r["index"], r["account"], r["delta"], r["description"]) for r in lf.unaccounted.collect())
    assert unacc == [(0, "chequing", -5000, "TRANSFER TO VISA"), (1, "chequing", -999, "UNKNOWN"),
                     (2, "visa", 300, "REFUND MISC")]
    assert L.duplicate_claims(lf.entries).count() == 0


def test_statement_running_balance(spark, workdir):
    lf = _ledger(spark, workdir)
    st = lf.statement().where("account = 'chequing'").orderBy("seq").collect()
    assert [r["balance"] for r in st] == [9475, 109475, 89475, 85475, 80475, 79476]
    assert st[-1]["date"] == "2020-01-06"


def test_clipped_series(spark, workdir):
    lf = _ledger(spark, workdir)
    edges = H.edges_from_dict(spark, lf.mapping.category_tree())
    gl = H.subtree_leaves(edges).where(F.col("grp").isin("Living", "Salary"))
    d = lf.derived_txn.withColumnRenamed("derived_account", "account")
    full = S.full_series(gl, d, lf.derived_accounts)
    starts = S.group_start(gl, lf.derived_accounts)
    s, e = bound_epoch("2020-Jan-02"), bound_epoch("2020-Jan-05")
    clipped = S.clip_series(full, starts, s, e)
    got = sorted((r["grp"], r["epoch"], r["balance"]) for r in clipped.collect())
    day = 86400
    assert got == sorted([
        ("Living", s, -1725), ("Living", s + day, -5725), ("Living", s + 2 * day, -8735), ("Living", e, -8735),
        ("Salary", s, 99000), ("Salary", e, 99000)])
    tot = {r["grp"]: r["balance_point_sum"] for r in S.series_totals(clipped).collect()}
    assert tot == {"Living": -24920, "Salary": 198000}


def test_tree_checks_on_golden_tree(spark, workdir):
    lf = _ledger(spark, workdir)
    edges = H.edges_from_dict(spark, lf.mapping.category_tree())
    assert H.coverage(edges, lf.accounts).count() == 0
    assert H.duplicate_children(edges).count() == 0
    assert H.isolated_nodes(edges, "All").count() == 0
    assert H.cycle_nodes(edges, "All").count() == 0
    h = {r["node"]: r["height"] for r in H.heights(edges).collect()}
    assert h["All"] == 2 and h["Living"] == 1 and h["Coffee"] == 0


def test_many_ranges_give_same_results(spark, workdir):
    """Ranges of a row or two: accounts go on from range to range."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lf = _ledger(spark, workdir)
        unacc = sorted((r["index"], r["account"], r["delta"]) for r in lf.unaccounted.collect())
        assert unacc == [(0, "chequing", -5000), (1, "chequing", -999), (2, "visa", 300)]
        st = lf.statement().where("account = 'chequing'").orderBy("seq").collect()
        assert [r["balance"] for r in st] == [9475, 109475, 89475, 85475, 80475, 79476]
        assert len(lf.entries.collect()) == 6
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_account_lookup_source_then_derived(spark, workdir):
    lf = _ledger(spark, workdir)
    assert [r["balance"] for r in lf.account_statement("visa").orderBy("seq").collect()] == [-26200, -6200, -9210, -8910]
    assert [r["balance"] for r in lf.account_statement("Salary").collect()] == [-99000]
    assert lf.account_statement("nobody").count() == 0
