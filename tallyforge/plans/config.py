"""Ledger configuration (D7-D11): derived-account rules, transfer mappings, category tree.

Rule files are human-written; they stay Python objects on the driver and are matched in one scan.  Transfer mappings may be data-derived and
large; they are a DataFrame, matched by their distinct patterns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.text import patterns_regex


@dataclass(frozen=True)
class Matching:
    account_name: str | None          # None or "" = every source account (universal rule)
    strings: tuple[str, ...]

    @property
    def regex(self) -> str:
        return patterns_regex(self.strings)

    @property
    def is_blank(self) -> bool:
        return self.account_name is None or self.account_name == ""


@dataclass(frozen=True)
class DerivedRule:
    name: str
    matchings: tuple[Matching, ...]
    start_value: int = 0              # cents ("starting value", default 0)

    @property
    def is_universal(self) -> bool:
        """exactly one matching and its account name is blank."""
        return len(self.matchings) == 1 and self.matchings[0].is_blank


@dataclass(frozen=True)
class TransferMapping:
    from_account: str
    from_strings: tuple[str, ...]
    to_account: str
    to_strings: tuple[str, ...]


@dataclass
class AccountMapping:
    """Derived accounts + internal transactions + category tree (rule file contents)."""
    derived: list[DerivedRule] = field(default_factory=list)
    transfers: list[TransferMapping] = field(default_factory=list)
    tree: dict[str, list[str]] | None = None   # None -> Q17: one root over all derived accounts

    def category_tree(self, root: str = "All") -> dict[str, list[str]]:
        if self.tree:
            return self.tree
        return {root: [r.name for r in self.derived]}


RULE_SCHEMA = T.StructType([
    T.StructField("rule_no", T.IntegerType(), False),
    T.StructField("derived_account", T.StringType(), False),
    T.StructField("start_value", T.LongType(), False),
    T.StructField("matching_no", T.IntegerType(), False),
    T.StructField("account_name", T.StringType(), True),
    T.StructField("universal", T.BooleanType(), False),
    T.StructField("regex", T.StringType(), False),
])

MAPPING_SCHEMA = T.StructType([
    T.StructField("mapping_no", T.LongType(), False),
    T.StructField("from_account", T.StringType(), False),
    T.StructField("from_regex", T.StringType(), False),
    T.StructField("to_account", T.StringType(), False),
    T.StructField("to_regex", T.StringType(), False),
])


def rules_frame(spark: SparkSession, rules: list[DerivedRule]) -> DataFrame:
    rows = []
    for r_no, rule in enumerate(rules):
        for m_no, m in enumerate(rule.matchings):
            rows.append((r_no, rule.name, int(rule.start_value), m_no,
                         None if m.is_blank else m.account_name, rule.is_universal, m.regex))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def mappings_frame(spark: SparkSession, transfers: list[TransferMapping], first_no: int = 0) -> DataFrame:
    rows = [(first_no + i, t.from_account, patterns_regex(t.from_strings), t.to_account,
             patterns_regex(t.to_strings)) for i, t in enumerate(transfers)]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)
