"""Reference semantics and the survey's decisions."""

from pyspark.sql import functions as F

from tallyforge.functions.text import escape_pattern, patterns_regex
from tallyforge.operators import browse as B
from tallyforge.operators import ledger as L
from tallyforge.operators import rules as R
from tallyforge.operators.identity import identify, quarantine
from tallyforge.plans.config import DerivedRule, Matching
from tallyforge.sources.schemas import RAW_SCHEMA


def _raw(spark, rows):
    import datetime as dt
    out = []
    for i, (acct, day, amount, desc) in enumerate(rows):
        d = dt.date(2020, 1, day) if day else None
        out.append((acct, d, None if d is None else int((d - dt.date(1970, 1, 1)).days) * 86400, amount, desc, "f", 0, i))
    return spark.createDataFrame(out, RAW_SCHEMA)


def test_escape_only_four_metacharacters():
    assert escape_pattern("A*B+C(D)E.F?") == r"A\*B\+C\(D\)E.F?"
    assert patterns_regex(["X", "Y(1)"]) == r"X|Y\(1\)"
    assert patterns_regex([]) == ""


def test_match_semantics_null_empty_and_live_dot(spark):
    txn = identify(_raw(spark, [("a", 1, -100, "GROCER (NORTH)"), ("a", 2, -200, "GROCERXNORTH"),
                                ("a", 3, -300, None), ("b", 1, 50, "anything")]))
    rules = [DerivedRule("G", (Matching("", ("GROCER (NORTH)", "GROCER.NORTH")),)),
             DerivedRule("All", (Matching("", ()),)),
             DerivedRule("OnlyB", (Matching("b", ("",)),))]
    d = R.derived_transactions(txn, rules)
    got = sorted((r["derived_account"], r["source_account"], r["amount"]) for r in d.collect())
    assert got == sorted([("G", "a", 100), ("G", "a", 200), ("All", "a", 100), ("All", "a", 200),
                          ("All", "b", -50), ("OnlyB", "b", -50)])


def test_equal_rows_in_two_accounts_get_distinct_ids(spark):
    txn = identify(_raw(spark, [("a", 1, -100, "SAME"), ("b", 1, -100, "SAME")]))
    ids = [r["id"] for r in txn.collect()]
    assert len(set(ids)) == 2


def test_both_amounts_null_quarantined(spark):
    raw = _raw(spark, [("a", 1, None, "x"), ("a", None, 5, "y"), ("a", 2, 5, "z")])
    q = {r["description"]: r["reason"] for r in quarantine(raw).collect()}
    assert q == {"x": "no amount", "y": "no date"}
    assert identify(raw).count() == 1


def test_double_claim_reported_and_unaccounted_partition(spark):
    txn = identify(_raw(spark, [("a", 1, -100, "COFFEE"), ("a", 2, -200, "TEA")]))
    rules = [DerivedRule("X", (Matching("", ("COFFEE",)),)), DerivedRule("Y", (Matching("a", ("COF",)),))]
    entries = R.derived_entries(R.derived_transactions(txn, rules))
    assert L.duplicate_claims(entries).count() == 1
    un = L.unaccounted(txn, entries).collect()
    assert [(r["index"], r["description"]) for r in un] == [(0, "TEA")]


def test_empty_rules_give_typed_empty_results(spark):
    txn = identify(_raw(spark, [("a", 1, -100, "COFFEE")]))
    d = R.derived_transactions(txn, [])
    assert d.count() == 0 and "source_id" in d.columns
    assert L.unaccounted(txn, R.derived_entries(d)).count() == 1


def test_sort_toggle_nulls_first_and_sql_filter(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "seq int, delta int")
    st = B.SortState().click("delta")
    assert [r["seq"] for r in B.sort_frame(df, st, ["seq"]).collect()] == [2, 1, 3]
    st = st.click("delta")
    assert st.descending and [r["seq"] for r in B.sort_frame(df, st, ["seq"]).collect()] == [2, 3, 1]
    assert B.filter_sql(df, "delta > :v", {"v": 5}).count() == 1
    assert B.filter_description(df.withColumn("description", F.lit("ab")), "").count() == 3
