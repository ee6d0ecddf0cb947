"""The driver's Parquet tables read as ledgers.

``orders``: one source account per customer (``C`` + zero-padded key), opening balance from
``c_acctbal``; status ``F`` is a debit, others a credit; the priority text is the description;
``o_orderkey`` breaks ties.  ``events``: one account per user; ``purchase`` is a debit; the event
type is the description; ``event_id`` breaks ties.  Category tree for roll-ups: All -> region ->
nation -> customer account.

Only the needed columns are selected so the Parquet scans read just them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents, signed_amount
from ..functions.timefmt import date_of, epoch_seconds
from ..plans.config import AccountMapping, DerivedRule, Matching, TransferMapping
from .schemas import RAW_COLUMNS

ROOT = "All"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_account(key_col) -> F.Column:
    return F.format_string("C%010d", key_col)


def user_account(key_col) -> F.Column:
    return F.format_string("U%010d", key_col)


def _raw(df: DataFrame, account, ts_col: str, debit_if, value_col: str, desc_col: str,
         tie_col: str, source: str) -> DataFrame:
    ts_type = df.schema[ts_col].dataType
    value = cents(F.col(value_col))
    debit = F.when(debit_if, value)
    credit = F.when(~debit_if, value)
    return df.select(
        account.alias("account"),
        date_of(F.col(ts_col), ts_type).alias("date"),
        epoch_seconds(F.col(ts_col), ts_type).alias("epoch"),
        signed_amount(credit, debit).alias("amount"),
        F.col(desc_col).cast("string").alias("description"),
        F.lit(source).alias("src_file"),
        F.lit(0).cast("bigint").alias("src_block"),
        F.col(tie_col).cast("bigint").alias("src_row"),
    ).select(*RAW_COLUMNS)


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return _raw(o, customer_account(F.col("o_custkey")), "o_orderdate",
                F.col("o_orderstatus") == F.lit("F"), "o_totalprice", "o_orderpriority",
                "o_orderkey", "orders")


def orders_by_status_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot-account ledger over the same orders: one account per order status, so each of the
    three accounts holds about a third of all rows (the skew case the numbering must split)."""
    o = table(spark, sf_dir, "orders")
    return _raw(o, F.concat(F.lit("S"), F.col("o_orderstatus")), "o_orderdate",
                F.col("o_orderstatus") == F.lit("F"), "o_totalprice", "o_orderpriority",
                "o_orderkey", "orders")


def orders_by_status_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.select(F.concat(F.lit("S"), F.col("o_orderstatus")).alias("name")).distinct()
            .select("name", F.lit("source").alias("kind"), F.lit(0).cast("bigint").alias("start_value")))


def orders_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(customer_account(F.col("c_custkey")).alias("name"),
                    F.lit("source").alias("kind"),
                    F.coalesce(cents(F.col("c_acctbal")), F.lit(0).cast("bigint")).alias("start_value"))


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _raw(e, user_account(F.col("user_id")), "ts", F.col("event_type") == F.lit("purchase"),
                "value", "event_type", "event_id", "events")


def events_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.select(user_account(F.col("user_id")).alias("name")).distinct()
            .select("name", F.lit("source").alias("kind"), F.lit(0).cast("bigint").alias("start_value")))


# Rule files for the two driver ledgers (configuration, applied to whole tables).
ORDERS_MAPPING = AccountMapping(
    derived=[
        DerivedRule("High", (Matching("", ("1-URGENT", "2-HIGH")),)),
        DerivedRule("Mid", (Matching("", ("MEDIUM",)),), start_value=1000),
        DerivedRule("Flagged", (Matching("C0000000003", ("LOW",)),
                                Matching("C0000000007", ("NOT SPEC",)),
                                Matching("C0000000003", ("5-LOW|URGENT",)))),
    ],
    transfers=[TransferMapping("C0000000005", ("HIGH",), "C0000000005", ("LOW",))],
    tree={"All": ["Priority", "Flagged"], "Priority": ["High", "Mid"]},
)

EVENTS_MAPPING = AccountMapping(
    derived=[
        DerivedRule("Money", (Matching("", ("purchase",)),)),
        DerivedRule("Noise", (Matching("", ("click", "view")),)),
    ],
    transfers=[],
    tree={"All": ["Money", "Noise"]},
)


def orders_transfer_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account a's URGENT rows against account a+1's LOW rows, for every customer a with a
    successor, plus the configured mappings (numbered below zero, in file order)."""
    from ..plans.config import mappings_frame  # local import: config -> sources cycle
    c = table(spark, sf_dir, "customer").select("c_custkey")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.lit(True).alias("has_next"))
    data = (c.join(nxt, "c_custkey", "inner")
            .select(F.col("c_custkey").cast("bigint").alias("mapping_no"),
                    customer_account(F.col("c_custkey")).alias("from_account"),
                    F.lit("URGENT").alias("from_regex"),
                    customer_account(F.col("c_custkey") + 1).alias("to_account"),
                    F.lit("LOW").alias("to_regex")))
    fixed = mappings_frame(spark, ORDERS_MAPPING.transfers, first_no=-len(ORDERS_MAPPING.transfers))
    return fixed.unionByName(data)


def events_transfer_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    nxt = u.select((F.col("user_id") - 1).alias("user_id"))
    return (u.join(nxt, "user_id", "inner")
            .select(F.col("user_id").cast("bigint").alias("mapping_no"),
                    user_account(F.col("user_id")).alias("from_account"),
                    F.lit("purchase").alias("from_regex"),
                    user_account(F.col("user_id") + 1).alias("to_account"),
                    F.lit("signup").alias("to_regex")))


def geo_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category edges (parent, child, ord): All -> region -> nation -> customer account."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    top = r.select(F.lit(ROOT).alias("parent"), F.col("r_name").alias("child"),
                   F.col("r_regionkey").cast("bigint").alias("ord"))
    mid = n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("child"),
        F.col("n_nationkey").cast("bigint").alias("ord"))
    low = c.join(n, c.c_nationkey == n.n_nationkey, "inner").select(
        F.col("n_name").alias("parent"), customer_account(F.col("c_custkey")).alias("child"),
        F.col("c_custkey").cast("bigint").alias("ord"))
    return top.unionByName(mid).unionByName(low)
