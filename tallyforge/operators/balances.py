"""Balances: A1 end balance, W1 running balance, L10 account statement, J8/J10 lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequencing import ordered_scan


def end_balances(accounts: DataFrame, txn: DataFrame, account_col: str = "account") -> DataFrame:
    """A1: start + sum(amount) per account; an account without rows keeps its start value.
    Sums are pre-aggregated per account before the (small) join with the account list."""
    sums = txn.groupBy(F.col(account_col).alias("name")).agg(
        F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("n_txn"))
    j = accounts.join(sums, "name", "left")
    return j.select(
        "name", "kind", "start_value",
        (F.col("start_value") + F.coalesce("_sum", F.lit(0))).alias("end_value"),
        F.coalesce("n_txn", F.lit(0)).alias("n_txn"),
    )


def statement(txn: DataFrame, accounts: DataFrame, account_col: str = "account") -> DataFrame:
    """Every row with the running balance ``start + cumulative amount`` in account order.

    Columns: account, seq, date (text), description, delta, balance.  The opening balance is the first
    element of an account's scan (``seq`` -1), so no row is joined with its account."""
    rows = txn.select(F.col(account_col).alias("account"), "seq", "date", "description", "amount")
    first = accounts.select(F.col("name").alias("account"), F.lit(-1).cast("bigint").alias("seq"), F.col("start_value").alias("amount"))
    run = ordered_scan(rows.unionByName(first, allowMissingColumns=True), ["account"], ["seq"], sums=["amount"], index="_pos")
    return shown_statement(run.where("seq >= 0").withColumn("balance", F.col("_run_amount")))


def shown_statement(rows: DataFrame) -> DataFrame:
    """The statement's columns of rows that carry their running ``balance``."""
    return rows.select("account", "seq", F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
                       F.col("amount").alias("delta"), "balance")


def account_registry(source_accounts: DataFrame, derived_accounts: DataFrame) -> DataFrame:
    """One account table (name, kind, start_value) for source and derived accounts."""
    return source_accounts.select("name", "kind", "start_value").unionByName(
        derived_accounts.select("name", "kind", "start_value"))


def account_kinds(registry: DataFrame) -> DataFrame:
    """A name must be source XOR derived; ``created`` is that test."""
    g = registry.groupBy("name").agg(
        F.max(F.when(F.col("kind") == "source", 1).otherwise(0)).alias("_src"),
        F.max(F.when(F.col("kind") == "derived", 1).otherwise(0)).alias("_der"))
    return g.select("name", ((F.col("_src") + F.col("_der")) == 1).alias("created"),
                    (F.col("_src") == 1).alias("is_source"), (F.col("_der") == 1).alias("is_derived"))


def balance_at(txn: DataFrame, accounts: DataFrame, probes: DataFrame, at: str = "at") -> DataFrame:
    """J7 for many probe times at once: every row of ``probes`` (``account``, the epoch ``at`` and any other
    columns) with ``balance``, its account's balance after all transactions strictly before that time.

    Probes and transactions are merged in one ordered scan: the opening balance is an account's first element, a
    probe stands before the transactions of its own second and takes the running sum where it stands.  A hot
    account is cut into ranges like any other; no probe is joined with a transaction.  An account without
    an opening balance starts at 0; a probe with a null time sees the opening balance only."""
    extra = [c for c in probes.columns if c not in ("account", at)]
    asked = probes.select("account", F.col(at).cast("bigint").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_amount"), *extra)
    moved = txn.select("account", F.col("epoch").alias("_t"), F.lit(2).alias("_kind"), F.col("amount").alias("_amount"))
    first = accounts.select(F.col("name").alias("account"), F.lit(None).cast("bigint").alias("_t"), F.lit(0).alias("_kind"),
                            F.col("start_value").alias("_amount"))
    rows = asked.unionByName(moved, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    run = ordered_scan(rows, ["account"], ["_t", "_kind", *extra], sums=["_amount"], index="_i")
    return run.where("_kind = 1").select(*[F.col("_t").alias(at) if c == at else F.col(c) for c in probes.columns],
                                         F.col("_run__amount").alias("balance"))
