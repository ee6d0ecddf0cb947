"""Ledger entries and unaccounted transactions: L8, L9, U2, U3, U4, J1, W4, V2.

Entries are the union of derived-account entries and paired transfers (U2).  The reference only
asserts, under ``-O`` stripped, that transfer IDs are new; entries are concatenated either way.
Here the concatenation is kept and every ID claimed more than once is reported (V2, also
covering two rules claiming one row, Q8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import ENTRY_COLUMNS, UNACCOUNTED_COLUMNS
from .sequencing import ordered_scan


def ledger_entries(derived_entries: DataFrame, transfer_entries: DataFrame) -> DataFrame:
    """L8 / U1 / U2."""
    return derived_entries.select(*ENTRY_COLUMNS).unionByName(transfer_entries.select(*ENTRY_COLUMNS))


def accounted_ids(entries: DataFrame) -> DataFrame:
    """Both sides of every entry stacked into one (account, id) list."""
    return entries.select(F.inline(F.array(
        F.struct(F.col("from_account_name").alias("account"), F.col("from_transaction_id").alias("id"),
                 F.lit("from").alias("side")),
        F.struct(F.col("to_account_name").alias("account"), F.col("to_transaction_id").alias("id"),
                 F.lit("to").alias("side")),
    )))


def duplicate_claims(entries: DataFrame) -> DataFrame:
    """V2 / U4: (account, id) pairs claimed by more than one entry side."""
    return (accounted_ids(entries).groupBy("account", "id")
            .agg(F.count(F.lit(1)).alias("n_claims"))
            .where(F.col("n_claims") > 1))


def unaccounted_rows(txn: DataFrame, entries: DataFrame) -> DataFrame:
    """Source transactions no entry mentions, on either side."""
    ids = accounted_ids(entries).select("account", "id")
    return txn.join(ids, ["account", "id"], "left_anti")


def unaccounted(txn: DataFrame, entries: DataFrame) -> DataFrame:
    """``index, date, description, delta, account``; index runs 0..n-1 over accounts in name
    order, rows in account order (W4): positions in one order over all rows."""
    rows = unaccounted_rows(txn, entries).select("account", "seq", "date", "description", "amount")
    return ordered_scan(rows, [], ["account", "seq"], index="index").select(
        "index",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "description",
        F.col("amount").alias("delta"),
        "account",
    ).select(*UNACCOUNTED_COLUMNS)
