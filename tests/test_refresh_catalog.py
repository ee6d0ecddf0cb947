"""Refresh (I1-I6) and catalog (S10-S15): what changed is extended or rebuilt, versions change as a whole."""

import os

import pytest

from golden import write_golden
from tallyforge.plans.manifest_log import ConcurrentRefresh, ManifestLog
from tallyforge.plans.refresh import TABLES, folder_fingerprints, refresh_ledger, stored_table
from tallyforge.sources import catalog
from tallyforge.sources.json_io import read_account_mapping


def _accounts(spark):
    return spark.createDataFrame([("chequing", "source", 10000), ("visa", "source", -25000)],
                                 "name string, kind string, start_value bigint")


def _rows(df, skip=("src_row",)):
    return sorted(str([(c, r[c]) for c in sorted(df.columns) if c not in skip]) for r in df.collect())


def _add(root, account, name, *lines):
    with open(os.path.join(root, "accounts", account, name), "w") as f:
        f.write("TransDate,Debit,Credit,Description\n" + "".join(line + "\n" for line in lines))


def _equals_fresh(spark, root, mapping, store, accounts, workdir, tag):
    fresh = os.path.join(workdir, f"fresh-{tag}")
    refresh_ledger(spark, f"{root}/accounts", accounts, mapping, fresh, prefix=f"f{tag}")
    for t in TABLES:
        assert _rows(stored_table(spark, store, t)) == _rows(stored_table(spark, fresh, t)), (tag, t)


def test_appended_files_extend_and_changes_rebuild(spark, workdir, monkeypatch):
    import tallyforge.plans.refresh as R
    root = write_golden(workdir)
    mapping = read_account_mapping(spark, f"{root}/home_rules.json")
    store = os.path.join(workdir, "store")
    read = []
    real = R.read_files
    monkeypatch.setattr(R, "read_files", lambda s, f, formats: read.extend(r["rel"] for r in f.collect()) or real(s, f, formats))

    def refresh(accounts=None):
        read.clear()
        return refresh_ledger(spark, f"{root}/accounts", accounts or _accounts(spark), mapping, store, prefix="rf", buckets=2)

    r1 = refresh()
    assert r1.accounts("rebuilt") == ["chequing", "visa"] and r1.ledger_rebuilt and r1.version == 1
    assert spark.table("rf_unaccounted").count() == 3
    r2 = refresh()
    assert r2.sources.count() == 0 and r2.rebuilt_derived == [] and not r2.ledger_rebuilt and read == []
    # a later file: only it is read
    _add(root, "visa", "more.csv", "2020-02-09,,7.00,COFFEE TRUCK", "2020-02-10,3.00,,REFUND")
    r3 = refresh()
    assert r3.accounts("extended") == ["visa"] and r3.accounts("rebuilt") == [] and read == ["visa/more.csv"]
    assert "Coffee" in r3.rebuilt_derived and "Salary" not in r3.rebuilt_derived and r3.ledger_rebuilt and r3.version == 3
    assert spark.table("rf_txn").where("account = 'visa'").count() == 6
    _equals_fresh(spark, root, mapping, store, _accounts(spark), workdir, "a")
    # an earlier row: the account is rebuilt, the other one's files are not read
    _add(root, "visa", "old.csv", "2019-12-09,,1.00,COFFEE OLD")
    r4 = refresh()
    assert r4.accounts("rebuilt") == ["visa"] and r4.accounts("extended") == [] and not any("chequing" in f for f in read)
    _equals_fresh(spark, root, mapping, store, _accounts(spark), workdir, "b")
    # a file that changed, next to an appended one
    _add(root, "visa", "more.csv", "2020-02-09,,8.00,COFFEE TRUCK")
    _add(root, "chequing", "later.csv", "2021-01-01,5.00,,LATE", "2021-01-01,,2.00,LATER")
    r5 = refresh()
    assert r5.accounts("rebuilt") == ["visa"] and r5.accounts("extended") == ["chequing"]
    _equals_fresh(spark, root, mapping, store, _accounts(spark), workdir, "c")
    # an account that leaves, and older versions that stay as they were
    only = spark.createDataFrame([("chequing", "source", 10000)], "name string, kind string, start_value bigint")
    r6 = refresh(only)
    assert r6.accounts("removed") == ["visa"] and r6.accounts("rebuilt") == [] and r6.ledger_rebuilt and read == []
    assert spark.table("rf_txn").where("account = 'visa'").count() == 0
    _equals_fresh(spark, root, mapping, store, only, workdir, "d")
    assert stored_table(spark, store, "txn", version=3).where("account = 'visa'").count() == 6


def test_cleared_keys_rebuild(spark, workdir):
    root = write_golden(workdir)
    mapping = read_account_mapping(spark, f"{root}/home_rules.json")
    store = os.path.join(workdir, "store")
    refresh_ledger(spark, f"{root}/accounts", _accounts(spark), mapping, store, prefix="rc")
    log = ManifestLog(spark, store)
    names = spark.createDataFrame([("source:visa",), ("derived:Salary",), ("nobody",)], "object_name string")
    assert log.clear(names) == 2
    before = {t: _rows(stored_table(spark, store, t)) for t in TABLES}
    r = refresh_ledger(spark, f"{root}/accounts", _accounts(spark), mapping, store, prefix="rc")
    assert r.accounts("rebuilt") == ["visa"] and r.rebuilt_derived == ["Salary"] and not r.ledger_rebuilt and r.version == 3
    assert {t: _rows(stored_table(spark, store, t)) for t in TABLES} == before


def test_of_two_refreshes_one_wins_and_a_crash_changes_nothing(spark, workdir, monkeypatch):
    import tallyforge.plans.refresh as R
    root = write_golden(workdir)
    mapping = read_account_mapping(spark, f"{root}/home_rules.json")
    store = os.path.join(workdir, "store")
    go = lambda: refresh_ledger(spark, f"{root}/accounts", _accounts(spark), mapping, store, prefix="rw")
    go()
    before = {t: _rows(stored_table(spark, store, t)) for t in TABLES}
    _add(root, "visa", "more.csv", "2020-02-09,,7.00,COFFEE TRUCK")
    # crash between the entries and the unaccounted list
    real = R.ledger_ops.unaccounted
    monkeypatch.setattr(R.ledger_ops, "unaccounted", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        go()
    assert {t: _rows(stored_table(spark, store, t)) for t in TABLES} == before
    assert ManifestLog(spark, store).snapshot().version == 1
    # another refresh commits while ours is about to
    def overtaken(*a):
        monkeypatch.setattr(R.ledger_ops, "unaccounted", real)
        assert go().version == 2
        return real(*a)
    monkeypatch.setattr(R.ledger_ops, "unaccounted", overtaken)
    with pytest.raises(ConcurrentRefresh):
        go()
    after = {t: _rows(stored_table(spark, store, t)) for t in TABLES}
    assert after != before and ManifestLog(spark, store).snapshot().version == 2
    assert go().sources.count() == 0


def test_catalog_store_update_drop(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert catalog.store(df, "cat_t1")
    assert not catalog.store(df, "cat_t1")
    assert catalog.is_stored(spark, "cat_t1")
    catalog.update(df.union(df), "cat_t2")
    assert catalog.retrieve(spark, "cat_t2").count() == 2
    assert "cat_t1" in catalog.stored_names(spark)
    assert catalog.drop(spark, "cat_t1") and not catalog.drop(spark, "cat_t1")
    assert catalog.query(spark, "SELECT count(*) AS n FROM cat_t2 WHERE x = :v", {"v": 1}).first()["n"] == 2


def test_fingerprint_order_free(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) s")
    a = catalog.frame_fingerprint(df).first()[0]
    b = catalog.frame_fingerprint(df.repartition(5).orderBy("s")).first()[0]
    c = catalog.frame_fingerprint(df.where("id > 0")).first()[0]
    assert a == b and a != c


def test_folder_fingerprints(spark, workdir):
    root = write_golden(workdir)
    fps = {r["account"]: r["n_files"] for r in folder_fingerprints(spark, f"{root}/accounts").collect()}
    assert fps == {"chequing": 2, "visa": 2}


def test_refresh_after_rule_edits_equals_a_fresh_build(spark, workdir):
    from tallyforge.plans.config import AccountMapping, DerivedRule, Matching
    root = write_golden(workdir)
    base = read_account_mapping(spark, f"{root}/home_rules.json")
    coffee, groceries, salary = base.derived
    nothing = DerivedRule(coffee.name, (Matching("", ("NO SUCH TEXT",)),))
    extra = DerivedRule("Misc", (Matching("visa", ("REFUND",)),))
    edits = [[groceries, salary], [nothing, groceries, salary], [salary, groceries, coffee], [coffee, groceries, salary, extra], []]
    store = os.path.join(workdir, "store")
    refresh_ledger(spark, f"{root}/accounts", _accounts(spark), base, store, prefix="re")
    for k, rules in enumerate(edits):
        mapping = AccountMapping(rules, base.transfers, base.tree)
        refresh_ledger(spark, f"{root}/accounts", _accounts(spark), mapping, store, prefix="re")
        refresh_ledger(spark, f"{root}/accounts", _accounts(spark), mapping, os.path.join(workdir, f"fresh{k}"), prefix=f"fr{k}")
        for t in ("txn", "derived", "entries", "unaccounted"):
            assert _rows(spark.table(f"re_{t}")) == _rows(spark.table(f"fr{k}_{t}")), (k, t)


def test_refresh_takes_bank_formats(spark, workdir):
    from pyspark.sql import functions as F
    from tallyforge.plans.config import AccountMapping
    from tallyforge.sources.csv_folders import BankFormat
    d = os.path.join(workdir, "acc", "card")
    os.makedirs(d)
    with open(os.path.join(d, "export.csv"), "w") as f:
        f.write("when;amount;text\n03/01/2020;-12.50;LUNCH\n")

    def card(df):
        amt = F.col("amount").cast("decimal(20,2)")
        return df.select(F.to_date("when", "dd/MM/yyyy").alias("TransDate"), F.when(amt < 0, -amt).alias("Credit"),
                         F.when(amt >= 0, amt).alias("Debit"), F.col("text").alias("Description"), "_account_dir", "_file", "_block", "_row")

    accounts = spark.createDataFrame([("card", "source", 0)], "name string, kind string, start_value bigint")
    refresh_ledger(spark, os.path.join(workdir, "acc"), accounts, AccountMapping(), os.path.join(workdir, "s"), prefix="fm",
                   formats={"card": BankFormat(name="card", options={"header": "true", "sep": ";"}, transform=card)},
                   account_formats={"card": "card"})
    assert [(r.account, r.amount, r.description) for r in spark.table("fm_txn").collect()] == [("card", -1250, "LUNCH")]
