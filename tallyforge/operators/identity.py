"""Number each account's rows in time order and give them IDs.

The reference sorts an account by timestamp, numbers rows 0..n-1 and hashes the index with the
row's fields.  Here all accounts are numbered in one job; equal timestamps are ordered by source
file, split and row (decision Q11) so the numbering, and with it every ID, is reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import transaction_id
from ..sources.schemas import TXN_COLUMNS
from .sequencing import ordered_scan

ORDER = ["epoch", "src_file", "src_block", "src_row"]


def valid_raw(raw: DataFrame) -> DataFrame:
    """Rows that can be numbered and hashed (V8 sends the others to quarantine)."""
    return raw.where(F.col("account").isNotNull() & F.col("epoch").isNotNull()
                     & F.col("date").isNotNull() & F.col("amount").isNotNull())


def quarantine(raw: DataFrame) -> DataFrame:
    """V8: rows with no account, date or amount (e.g. both Credit and Debit empty), with reason."""
    reason = (F.when(F.col("account").isNull(), F.lit("no account"))
              .when(F.col("date").isNull() | F.col("epoch").isNull(), F.lit("no date"))
              .when(F.col("amount").isNull(), F.lit("no amount")))
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def identify(raw: DataFrame, openings: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """txn_raw -> txn with ``seq`` (0-based position in the account) and ``id``.

    With ``openings`` (an account table: name, start_value) the rows also carry ``balance``, the
    running balance after the row: an account's opening balance is the first element of its scan, so
    positions and balances take one pass and no join (W1, L10).

    ``bases`` (account, base) continues accounts that have ``base`` rows already: positions begin there."""
    rows = valid_raw(raw).fillna({"src_file": "", "src_block": 0, "src_row": 0})
    if openings is None:
        numbered = ordered_scan(rows, ["account"], ORDER, index="seq")
        extra = []
    else:
        first = openings.select(F.col("name").alias("account"), F.col("start_value").alias("amount"), F.lit(1).alias("_opening"))
        rows = rows.withColumn("_opening", F.lit(0)).unionByName(first, allowMissingColumns=True)
        numbered = ordered_scan(rows, ["account"], [F.col("_opening").desc(), *ORDER], sums=["amount", "_opening"], index="_at")
        numbered = numbered.where("_opening = 0").withColumn("seq", F.col("_at") - F.col("_run__opening"))
        extra = [F.col("_run_amount").alias("balance")]
    if bases is not None:
        numbered = numbered.join(bases.select("account", "base"), "account", "left").withColumn(
            "seq", F.col("seq") + F.coalesce("base", F.lit(0)))
    return numbered.withColumn(
        "id", transaction_id(F.col("account"), F.col("seq"), F.col("date"), F.col("epoch"),
                             F.col("amount"), F.col("description"))
    ).select(*TXN_COLUMNS, *extra)
