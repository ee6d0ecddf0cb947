"""Composite ledger build (L16): sources -> derived -> entries -> unaccounted, as one lazy graph.

``LedgerFrames`` is a bundle of DataFrames, each built when it is first asked for.  ``build_ledger`` is the one place that wires the operators together, for the driver
tables, CSV folders and JSON configurations alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import balances, ledger, rules, transfers
from ..operators.identity import identify, quarantine
from .config import AccountMapping, mappings_frame


@dataclass
class LedgerFrames:
    spark: SparkSession
    name: str
    raw: DataFrame                 # txn_raw
    source_accounts: DataFrame     # name, kind='source', start_value
    mapping: AccountMapping
    transfer_mappings: DataFrame   # mapping_no, from_account, from_regex, to_account, to_regex

    # Base tables are scans that are written once (``sequencing.ordered_scan``); what follows reads them.
    @cached_property
    def numbered(self) -> DataFrame:
        """Transactions with position, ID and running balance, from one scan."""
        return identify(self.raw, self.source_accounts)

    @cached_property
    def txn(self) -> DataFrame:
        return self.numbered.drop("balance")

    @cached_property
    def quarantine(self) -> DataFrame:
        return quarantine(self.raw)

    @cached_property
    def numbered_derived(self) -> DataFrame:
        return rules.derived_transactions(self.txn, self.mapping.derived, openings=self.derived_accounts)

    @cached_property
    def derived_txn(self) -> DataFrame:
        return self.numbered_derived.drop("balance")

    @cached_property
    def derived_accounts(self) -> DataFrame:
        return rules.derived_accounts(self.spark, self.mapping.derived)

    @cached_property
    def accounts(self) -> DataFrame:
        return balances.account_registry(self.source_accounts, self.derived_accounts)

    @cached_property
    def derived_entries(self) -> DataFrame:
        return rules.derived_entries(self.derived_txn)

    @cached_property
    def transfer_matches(self) -> DataFrame:
        return transfers.transfer_matches(self.txn, self.transfer_mappings)

    @cached_property
    def transfer_entries(self) -> DataFrame:
        return transfers.transfer_entries(self.transfer_matches)

    @cached_property
    def entries(self) -> DataFrame:
        return ledger.ledger_entries(self.derived_entries, self.transfer_entries)

    @cached_property
    def unaccounted(self) -> DataFrame:
        return ledger.unaccounted(self.txn, self.entries)

    def statement(self) -> DataFrame:
        return balances.shown_statement(self.numbered)

    def derived_statement(self) -> DataFrame:
        return balances.shown_statement(self.numbered_derived.withColumnRenamed("derived_account", "account"))

    def account_statement(self, name: str) -> DataFrame:
        """J8 + L10: the statement of one account, looked up among source accounts first, then
        derived ones.  The filter on the account reaches the written scan, which is sorted by it."""
        from pyspark.sql import functions as F
        src = self.statement().where(F.col("account") == F.lit(name))
        der = self.derived_statement().where(F.col("account") == F.lit(name))
        return src.unionByName(der.join(src.select("account").distinct(), "account", "left_anti"))

    def tree_problems(self) -> DataFrame:
        """(check, subject) for every mistake of the category tree (H1-H5)."""
        from pyspark.sql import functions as F

        from ..operators import hierarchy as H
        tree = self.mapping.category_tree()
        edges, root = H.edges_from_dict(self.spark, tree), next(iter(tree))
        parts = [(H.duplicate_children(edges), "duplicate child", "child"), (H.isolated_nodes(edges, root), "isolated", "node"),
                 (H.cycle_nodes(edges, root), "cycle", "node"),
                 (H.invalid_leaves(edges, balances.account_kinds(self.accounts), root), "not one account", "name"),
                 (H.coverage(edges, self.accounts), None, "name")]
        out = None
        for df, check, col in parts:
            part = df.select((F.col("problem") if check is None else F.lit(check)).alias("check"), F.col(col).alias("subject"))
            out = part if out is None else out.unionByName(part)
        return out

    def source_balances(self) -> DataFrame:
        return balances.end_balances(self.source_accounts, self.txn)

    def derived_balances(self) -> DataFrame:
        return balances.end_balances(self.derived_accounts, self.derived_txn, "derived_account")


def build_ledger(spark: SparkSession, name: str, raw: DataFrame, source_accounts: DataFrame,
                 mapping: AccountMapping, transfer_mappings: DataFrame | None = None,
                 strict: bool = False) -> LedgerFrames:
    """``strict`` runs the tree checks and refuses a ledger whose category tree has mistakes."""
    if transfer_mappings is None:
        transfer_mappings = mappings_frame(spark, mapping.transfers)
    lf = LedgerFrames(spark, name, raw, source_accounts, mapping, transfer_mappings)
    if strict:
        found = lf.tree_problems().limit(20).collect()
        if found:
            raise ValueError(f"ledger {name!r}: " + "; ".join(f"{r['check']}: {r['subject']}" for r in found))
    return lf


def with_ledger(ledgers: list[LedgerFrames], result: str) -> DataFrame:
    """One result (an attribute such as ``txn`` or ``unaccounted``) of several ledgers in one job,
    told apart by the column ``ledger``."""
    from pyspark.sql import functions as F
    out = None
    for lf in ledgers:
        part = getattr(lf, result).withColumn("ledger", F.lit(lf.name))
        out = part if out is None else out.unionByName(part)
    return out


def orders_ledger(spark: SparkSession, sf_dir: str) -> LedgerFrames:
    from ..sources import driver_tables as d
    return build_ledger(spark, "orders", d.orders_raw(spark, sf_dir), d.orders_accounts(spark, sf_dir),
                        d.ORDERS_MAPPING, d.orders_transfer_mappings(spark, sf_dir))


def status_ledger(spark: SparkSession, sf_dir: str) -> LedgerFrames:
    """Orders keyed by status: three accounts with a third of the rows each (hot keys)."""
    from ..sources import driver_tables as d
    return build_ledger(spark, "status", d.orders_by_status_raw(spark, sf_dir),
                        d.orders_by_status_accounts(spark, sf_dir), d.ORDERS_MAPPING)


def events_ledger(spark: SparkSession, sf_dir: str) -> LedgerFrames:
    from ..sources import driver_tables as d
    return build_ledger(spark, "events", d.events_raw(spark, sf_dir), d.events_accounts(spark, sf_dir),
                        d.EVENTS_MAPPING, d.events_transfer_mappings(spark, sf_dir))


def ledger_from_folders(spark: SparkSession, data_root: str, ledger_name: str | None = None,
                        formats=None, account_formats: dict[str, str] | None = None, strict: bool = False) -> LedgerFrames:
    """The reference's on-disk layout.  ``LedgerConfiguration.json`` in ``data_root``
    names the ledgers; the chosen one (or the default) gives the rule file
    ``<accounting file>.json`` and the account folders ``<source account directory>/<account>``."""
    from pyspark.sql import functions as F

    from ..sources.csv_folders import read_files
    from ..sources.json_io import read_account_mapping, read_ledger_configuration, select_ledger
    from .refresh import folder_files, with_formats
    root = data_root.rstrip("/")
    cfg = select_ledger(read_ledger_configuration(spark, f"{root}/LedgerConfiguration.json"), ledger_name)
    head = cfg.select("ledger_name", "accounting_file", "source_dir").first()
    if head is None:
        raise ValueError(f"ledger {ledger_name or '(default)'} not configured under {root}")
    name, acc_file, src_dir = head["ledger_name"], head["accounting_file"], head["source_dir"]
    src = cfg.where(F.col("account").isNotNull()).select(
        F.col("account").alias("name"), F.lit("source").alias("kind"), "start_value")
    # the configured accounts' files are chosen from a listing, so only they are read
    files = folder_files(spark, f"{root}/{src_dir}").where(F.col("rel").rlike(r"^[^/]+/[^/]+\.csv$"))
    files = files.join(src.select(F.col("name").alias("account")), "account", "left_semi")
    raw = read_files(spark, with_formats(files, account_formats), formats)
    mapping = read_account_mapping(spark, f"{root}/{acc_file}.json")
    return build_ledger(spark, name, raw, src, mapping, strict=strict)


def all_ledgers_from_folders(spark: SparkSession, data_root: str, **options) -> list[LedgerFrames]:
    """Every ledger of a configuration."""
    from ..sources.json_io import read_ledger_configuration
    cfg = read_ledger_configuration(spark, f"{data_root.rstrip('/')}/LedgerConfiguration.json")
    names = sorted(r[0] for r in cfg.select("ledger_name").distinct().collect())
    return [ledger_from_folders(spark, data_root, n, **options) for n in names]


# Names under which the reference serves ledger results.
UNACCOUNTED_NAME = "UnaccountedTransactions"
ENTRIES_NAME = "LedgerEntries"


def ledger_data(lf: LedgerFrames, name: str) -> DataFrame:
    """A ledger result by name; an unknown name gives an empty frame."""
    if name == UNACCOUNTED_NAME:
        return lf.unaccounted
    if name == ENTRIES_NAME:
        return lf.entries
    return lf.spark.createDataFrame([], "empty string")
