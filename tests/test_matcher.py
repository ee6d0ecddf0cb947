"""The automaton proposes, the regular expression decides: the same rows as one search per pattern."""

import re

import pytest

from tallyforge.functions.text import patterns_regex
from tallyforge.operators.matcher import factors, literal_factor, matching_entries, matching_patterns
from tallyforge.operators import rules as R
from tallyforge.plans.config import RULE_SCHEMA, DerivedRule, Matching

TEXTS = ["GROCER (NORTH)", "GROCERXNORTH", "a+b", "ab", "aab", "x|y", "", None, "tail.", "TAIL", "50% off [new]", "new\nline", "Ünïcode ☕", "zz9"]
PATTERNS = ["GROCER (NORTH)", "GROCER.NORTH", "a+b", "a?b", "b{2}", "^a", "off$", "[xy]", "[^a]b", r"\d", r"\.", "new", "", "☕", "x", "a|", "9|nope"]


@pytest.mark.parametrize("text,want", [
    ("plain", ("plain", True)), (r"a\*b\(c", ("a*b(c", True)), ("ab?cd", ("cd", False)), ("a.bc", ("bc", False)), ("(ab)c", ("", False)),
    ("ab{2}cde", ("cde", False)), ("[ab]cd", ("cd", False)), (r"\Qa.b\E", ("", False)), ("x", ("x", True)), ("x?", ("", False)), ("abc[", ("", False))])
def test_literal_factor(text, want):
    assert literal_factor(text) == want


def test_factors_of_an_alternation():
    assert factors("CAT|D.G") == (["CAT", "D"], False)
    assert factors(patterns_regex(["A (1)", "B+"])) == (["A (1)", "B+"], True)
    assert factors("abc|[a|b]") is None and factors("[a|b]cd") == (["cd"], False)


def test_same_rows_as_one_search_per_pattern(spark):
    df = spark.createDataFrame([(i, t, "acc" + str(i % 2)) for i, t in enumerate(TEXTS)], "i int, description string, account string")
    entries = [(a, patterns_regex([p])) for p in PATTERNS for a in (None, "acc0")] + [(None, patterns_regex(PATTERNS[:2]))]
    got = sorted((r["i"], r["entry"]) for r in matching_entries(df, entries).collect())
    want = sorted((i, n) for n, (a, p) in enumerate(entries) for i, t in enumerate(TEXTS)
                  if t is not None and (a is None or a == f"acc{i % 2}") and re.search(p, t))
    assert got == want
    assert matching_entries(df, []).collect() == []


def test_slices_of_patterns_change_nothing(spark, monkeypatch):
    from tallyforge.operators import matcher
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, description string")
    pats = spark.createDataFrame([(patterns_regex([p]),) for p in PATTERNS * 2] + [(None,)], "regex string")
    want = sorted(map(tuple, matching_patterns(df, pats).select("i", "regex").collect()))
    monkeypatch.setattr(matcher, "SLICE_CHARACTERS", 7)
    assert sorted(map(tuple, matching_patterns(df, pats).select("i", "regex").collect())) == want and len(want) > 20
    assert matching_patterns(df, pats.where("false")).collect() == []


def test_5000_matchings_in_one_pass(spark):
    """Rules with thousands of matchings: one scan, no join; the rule table gives the same rows."""
    txn = spark.range(0, 3000).selectExpr("concat('A', id % 50) account", "id seq", "concat('shop ', id % 700, ' town') description", "id")
    rules = [DerivedRule(f"D{k}", tuple(Matching(f"A{(k + j) % 50}", (f"shop {(k * 25 + j) % 900} ",)) for j in range(25))) for k in range(200)]
    rules.append(DerivedRule("Every", (Matching("", ("shop 1 ", "6.. t")),)))
    hits = R.match_rules(txn, rules)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = sorted((r["seq"], r["rule_no"], r["matching_no"], r["derived_account"]) for r in hits.collect())
    rows = [(r["account"], r["seq"], r["description"]) for r in txn.collect()]
    want = sorted((s, k, j, rule.name) for k, rule in enumerate(rules) for j, m in enumerate(rule.matchings)
                  for a, s, d in rows if (rule.is_universal or a == m.account_name) and re.search(m.regex, d))
    assert got == want and len(want) > 1000
    table = [(k, rule.name, 0, j, None if rule.is_universal else m.account_name, rule.is_universal, m.regex)
             for k, rule in enumerate(rules) for j, m in enumerate(rule.matchings)]
    again = R.match_rules_table(txn, spark.createDataFrame(table, RULE_SCHEMA))
    assert sorted((r["seq"], r["rule_no"], r["matching_no"], r["derived_account"]) for r in again.collect()) == want
