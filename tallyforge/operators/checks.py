"""Validation reports: the reference's asserts (stripped under ``-OO``, Q2) as row-level checks.

Each check returns the offending rows; ``require_empty`` turns a report into the reference's
hard failure for callers that want strict mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import DerivedRule


class LedgerCheckError(AssertionError):
    pass


def require_empty(report: DataFrame, message: str, show: int = 20) -> None:
    """Strict mode: raise with a few offending rows (bounded ``take``) when the report has any."""
    rows = report.take(show)
    if rows:
        raise LedgerCheckError(f"{message}: {[r.asDict() for r in rows]}")


def self_sourced(derived: DataFrame) -> DataFrame:
    """V1: derived rows taken from an account of the derived account's own name."""
    return derived.where(F.col("derived_account") == F.col("source_account"))


def blank_matchings(spark: SparkSession, rules: Sequence[DerivedRule]) -> DataFrame:
    """A blank-account matching that does not stand alone."""
    rows = [(r.name, i) for r in rules if not r.is_universal
            for i, m in enumerate(r.matchings) if m.is_blank]
    return spark.createDataFrame(rows, "derived_account string, matching_no int")


def name_clashes(kinds: DataFrame) -> DataFrame:
    """Names that are both a source and a derived account."""
    return kinds.where(~F.col("created")).select("name")


def unknown_rule_accounts(spark: SparkSession, rules: Sequence[DerivedRule], mappings: DataFrame,
                          registry: DataFrame) -> DataFrame:
    """Accounts named by a rule or a transfer mapping that are not source accounts."""
    named = [(r.name, m.account_name) for r in rules for m in r.matchings if not m.is_blank]
    ref = spark.createDataFrame(named, "used_by string, account string")
    ref = ref.unionByName(mappings.select(F.concat(F.lit("mapping "), F.col("mapping_no").cast("string")).alias("used_by"),
                                          F.col("from_account").alias("account")))
    ref = ref.unionByName(mappings.select(F.concat(F.lit("mapping "), F.col("mapping_no").cast("string")).alias("used_by"),
                                          F.col("to_account").alias("account")))
    src = registry.where(F.col("kind") == "source").select(F.col("name").alias("account"))
    return ref.join(src, "account", "left_anti")


def match_counts(derived: DataFrame) -> DataFrame:
    """Matched rows per (derived account, matching, source account)."""
    return derived.groupBy("derived_account", "matching_no", "source_account").agg(
        F.count(F.lit(1)).alias("n_rows"))
