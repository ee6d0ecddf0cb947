"""Derived accounts: F1, J2, J3, P3, P7, O2, L3-L6, A1 for derived accounts.

All rules, however many, are matched in ONE scan of the transaction table (``operators.matcher``): an
automaton over the patterns' literal factors proposes (row, matching) pairs and the regular expression
decides.  A row hit by two matchings appears twice, once per matching.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import transaction_id
from ..plans.config import DerivedRule
from ..sources.schemas import DERIVED_COLUMNS, ENTRY_COLUMNS
from .matcher import matching_entries, matching_patterns
from .sequencing import ordered_scan


def usable_matchings(rules: Sequence[DerivedRule]) -> list[tuple[int, int, DerivedRule, str | None, str]]:
    """(rule_no, matching_no, rule, account or None for all, regex).

    A blank account inside a multi-matching rule is refused by the reference (V3); it is left
    out here and reported by ``checks.blank_matching_report``.
    """
    out = []
    for r_no, rule in enumerate(rules):
        for m_no, m in enumerate(rule.matchings):
            if rule.is_universal:
                out.append((r_no, m_no, rule, None, m.regex))
            elif not m.is_blank:
                out.append((r_no, m_no, rule, m.account_name, m.regex))
    return out


def match_rules(txn: DataFrame, rules: Sequence[DerivedRule], only: set[str] | None = None) -> DataFrame:
    """One row per (matching, matched source row): rule_no, matching_no, derived_account + txn.
    ``only`` keeps the rules of these accounts; rules are numbered in the full list all the same."""
    ms = [m for m in usable_matchings(rules) if only is None or m[2].name in only]
    place = {name: i for i, name in enumerate(dict.fromkeys(rule.name for _, _, rule, _, _ in ms), 1)}
    hits = matching_entries(txn, [(acct, regex) for _, _, _, acct, regex in ms], "_entry")

    def of_entry(values, kind):
        """The entry's value: one literal array, looked up by the entry's number."""
        return F.element_at(F.lit(list(values)).cast(f"array<{kind}>"), F.col("_entry") + 1)

    return hits.select(
        *txn.columns, of_entry((m[0] for m in ms), "int").alias("rule_no"), of_entry((m[1] for m in ms), "int").alias("matching_no"),
        F.element_at(F.lit(list(place)).cast("array<string>"), of_entry((place[m[2].name] for m in ms), "int")).alias("derived_account"))


def match_rules_table(txn: DataFrame, rules_df: DataFrame) -> DataFrame:
    """The same hits for a rule table (RULE_SCHEMA) that the driver need not hold: its distinct patterns are
    matched in one pass, then a row meets the matchings of (its account, a pattern it matches), never
    all matchings of its account."""
    hits = matching_patterns(txn, rules_df)
    shown = [*txn.columns, "rule_no", "matching_no", "derived_account"]
    cols = ["rule_no", "matching_no", "derived_account", "regex"]
    named = rules_df.where(~F.col("universal") & F.col("account_name").isNotNull()).select(*cols, F.col("account_name").alias("account"))
    every = rules_df.where(F.col("universal")).select(*cols)
    return hits.join(named, ["account", "regex"]).select(*shown).unionByName(hits.join(every, "regex").select(*shown))


def derived_transactions(txn: DataFrame, rules: Sequence[DerivedRule] | DataFrame, only: set[str] | None = None,
                         openings: DataFrame | None = None) -> DataFrame:
    """L3: matched rows with flipped sign, numbered per derived account and identified.

    Order inside a derived account (O2): timestamp, then matching order, then source account
    name (a universal rule walks accounts in name order), then source order.  ``openings`` (name,
    start_value) adds the running ``balance``, as in ``identity.identify``.
    """
    if isinstance(rules, DataFrame):
        hits = match_rules_table(txn, rules)
    else:
        hits = match_rules(txn, rules, only)
    d = hits.select(
        "derived_account", "rule_no", "matching_no",
        F.col("account").alias("source_account"), F.col("seq").alias("source_seq"),
        F.col("id").alias("source_id"), "date", "epoch", (-F.col("amount")).alias("amount"),
        "description")
    order = ["epoch", "matching_no", "source_account", "source_seq"]
    extra = []
    if openings is None:
        numbered = ordered_scan(d, ["derived_account"], order, index="seq")
    else:
        first = openings.select(F.col("name").alias("derived_account"), F.col("start_value").alias("amount"), F.lit(1).alias("_opening"))
        d = d.withColumn("_opening", F.lit(0)).unionByName(first, allowMissingColumns=True)
        numbered = ordered_scan(d, ["derived_account"], [F.col("_opening").desc(), *order], sums=["amount", "_opening"], index="_at")
        numbered = numbered.where("_opening = 0").withColumn("seq", F.col("_at") - F.col("_run__opening"))
        extra = [F.col("_run_amount").alias("balance")]
    return numbered.withColumn(
        "id", transaction_id(F.col("derived_account"), F.col("seq"), F.col("date"), F.col("epoch"),
                             F.col("amount"), F.col("description"))
    ).select(*DERIVED_COLUMNS, *extra)


def derived_entries(derived: DataFrame) -> DataFrame:
    """One ledger entry per derived row: source -> derived, delta = |amount|."""
    return derived.select(
        F.col("source_account").alias("from_account_name"),
        F.col("source_id").alias("from_transaction_id"),
        F.col("derived_account").alias("to_account_name"),
        F.col("id").alias("to_transaction_id"),
        F.abs("amount").alias("delta"),
    ).select(*ENTRY_COLUMNS)


def derived_accounts(spark: SparkSession, rules: Sequence[DerivedRule]) -> DataFrame:
    """Account rows (name, kind, start_value) for the configured derived accounts."""
    from ..sources.schemas import ACCOUNT_SCHEMA
    return spark.createDataFrame([(r.name, "derived", int(r.start_value)) for r in rules], ACCOUNT_SCHEMA)
