"""Queries that reach the edges of the ledger operators, over the driver tables: unreadable bank rows,
deep and broken trees, rule tables too long to compile.  Their SQL is written from the semantics alone
and imports nothing of the code it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import rules as R
from ..operators.cycles import nodes_on_cycles
from ..operators.identity import quarantine, valid_raw
from ..sources.csv_folders import homogenize
from ..sources.driver_tables import customer_account, table
from .config import RULE_SCHEMA
from .ledgers import events_ledger, orders_ledger, with_ledger


def _bank_rows(spark, sf) -> DataFrame:
    """Orders as the text cells of a bank export, some of them unreadable or empty."""
    o = table(spark, sf, "orders")
    k, amount = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice"))
    debit = F.when(k % 89 == 0, F.lit("1,234.50")).when(k % 79 == 0, F.lit("")).when(
        (F.col("o_orderstatus") == "F") | (k % 83 == 0), amount)
    credit = F.when(k % 79 == 0, F.lit(None).cast("string")).when((F.col("o_orderstatus") != "F") | (k % 83 == 0), amount)
    date = F.when(k % 97 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(date.alias("TransDate"), credit.alias("Credit"), debit.alias("Debit"), F.col("o_orderpriority").alias("Description"),
                    customer_account(F.col("o_custkey")).alias("account"), F.lit("orders").alias("_file"), F.lit(0).cast("long").alias("_block"),
                    k.alias("_row"))


def q_import_rows(spark, sf) -> DataFrame:
    return valid_raw(homogenize(_bank_rows(spark, sf))).select("account", "date", "epoch", "amount", "description", "src_row")


def q_import_quarantine(spark, sf) -> DataFrame:
    return quarantine(homogenize(_bank_rows(spark, sf))).select("account", "description", "src_row", "reason")


_BANK = """
WITH b AS (
  SELECT printf('C%010d', o_custkey) AS account, o_orderkey AS k, o_orderpriority AS description,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS date,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL
         WHEN o_orderkey % 79 = 0 THEN NULL
         WHEN o_orderstatus = 'F' OR o_orderkey % 83 = 0 THEN cast(round(o_totalprice * 100) AS bigint)
         ELSE -cast(round(o_totalprice * 100) AS bigint) END AS amount
  FROM orders)
"""


def _chains(spark, sf) -> DataFrame:
    """Order keys as chains of up to 200 nodes: each key below the one before it."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.where("k % 200 <> 0").select((F.col("k") - 1).cast("string").alias("parent"), F.col("k").cast("string").alias("child"),
                                          F.lit(0).cast("long").alias("ord"))


def q_deep_tree_closure(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderkey % 200 = 0").select(F.col("o_orderkey").cast("string").alias("node"))
    return H.closure(_chains(spark, sf), o)


def q_long_rule_table(spark, sf) -> DataFrame:
    """One rule per priority with one matching per third customer: more matchings than are compiled."""
    names = table(spark, sf, "customer").select("c_custkey")
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = [names.where((F.col("c_custkey") + i) % 3 != 0).select(
        F.lit(i).alias("rule_no"), F.lit("R" + p[0]).alias("derived_account"), F.lit(0).cast("long").alias("start_value"),
        F.col("c_custkey").cast("int").alias("matching_no"), customer_account(F.col("c_custkey")).alias("account_name"),
        F.lit(False).alias("universal"), F.lit(p[2:]).alias("regex")) for i, p in enumerate(priorities)]
    rules = rows[0]
    for r in rows[1:]:
        rules = rules.unionByName(r)
    hits = R.match_rules_table(orders_ledger(spark, sf).txn, rules.select(*RULE_SCHEMA.names))
    return hits.groupBy("derived_account", "rule_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"), F.count_distinct("matching_no").alias("n_matchings"))


def _broken_tree(spark, sf) -> DataFrame:
    """Regions, nations and suppliers as a tree with mistakes: suppliers listed twice, parents that are
    nobody's child, and rings of customers."""
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    tag = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    e = [n.select(F.lit("All"), tag("R", "n_regionkey")).distinct(), n.select(tag("R", "n_regionkey"), tag("N", "n_nationkey")),
         s.select(tag("N", "s_nationkey"), tag("S", "s_suppkey")),
         s.where("s_suppkey % 10 = 3").select(F.lit("All"), tag("S", "s_suppkey")),
         n.where("n_nationkey % 10 = 4").select(tag("X", "n_nationkey"), tag("Y", "n_nationkey"))]
    ring = c.where("c_custkey % 100 = 1")
    for a, b in (("A", "B"), ("B", "C"), ("C", "A")):
        e.append(ring.select(tag("ring" + a, "c_custkey"), tag("ring" + b, "c_custkey")))
    out = e[0].toDF("parent", "child")
    for x in e[1:]:
        out = out.union(x)
    return out.withColumn("ord", F.lit(0).cast("long"))


def q_broken_tree_checks(spark, sf) -> DataFrame:
    e = _broken_tree(spark, sf)
    kinds = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(True).alias("created"))
    parts = [H.duplicate_children(e).select(F.lit("H1").alias("check"), F.col("child").alias("subject")),
             H.isolated_nodes(e, "All").select(F.lit("H2").alias("check"), F.col("node").alias("subject")),
             H.cycle_nodes(e, "All").select(F.lit("H3").alias("check"), F.col("node").alias("subject")),
             H.invalid_leaves(e, kinds, "All").select(F.lit("H4").alias("check"), F.col("name").alias("subject"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_one_ring(spark, sf) -> DataFrame:
    """All customers as one ring, with every order hanging off its customer, and suppliers in tangled rings whose nodes
    have several parents."""
    c, o, s = (table(spark, sf, t) for t in ("customer", "orders", "supplier"))
    tag = lambda p, col: F.concat(F.lit(p), col.cast("string"))
    n = c.agg(F.max("c_custkey").alias("top"), F.min("c_custkey").alias("low"))
    key = F.col("c_custkey")
    ring = c.crossJoin(F.broadcast(n)).select(  # one row
        tag("C", F.when(key == F.col("low"), F.col("top")).otherwise(key - 1)), tag("C", key))
    k = F.col("s_suppkey")
    tangle = s.select(tag("S", k), tag("S", k - k % 4 + (k + 1) % 4)).union(s.select(tag("S", k), tag("S", k - k % 4 + (k * 3) % 4)))
    chain = s.select(tag("S", k), tag("T", k)).union(s.where("s_suppkey % 4 < 3").select(tag("T", k), tag("T", k + 1)))
    e = ring.union(o.select(tag("C", F.col("o_custkey")), tag("O", F.col("o_orderkey")))).union(tangle).union(chain)
    return nodes_on_cycles(e.toDF("parent", "child")).groupBy(F.substring("node", 1, 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(F.substring("node", 2, 20).cast("bigint")).alias("key_sum"))


def q_two_ledgers_txn(spark, sf) -> DataFrame:
    """Both ledgers in one job."""
    t = with_ledger([orders_ledger(spark, sf), events_ledger(spark, sf)], "txn")
    return t.groupBy("ledger", "account").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"), F.max("seq").alias("last_seq"))


def queries() -> dict:
    return {"two_ledgers_txn": q_two_ledgers_txn, "import_rows": q_import_rows, "import_quarantine": q_import_quarantine, "deep_tree_closure": q_deep_tree_closure,
            "long_rule_table": q_long_rule_table, "broken_tree_checks": q_broken_tree_checks, "one_ring": q_one_ring}


def oracle_sql() -> dict[str, str]:
    return {
        "one_ring": """
WITH RECURSIVE e AS (
  SELECT DISTINCT a, b FROM (
    SELECT s_suppkey AS a, s_suppkey - s_suppkey % 4 + (s_suppkey + 1) % 4 AS b FROM supplier
    UNION ALL SELECT s_suppkey, s_suppkey - s_suppkey % 4 + (s_suppkey * 3) % 4 FROM supplier)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT 'C' AS kind, count(*) AS n_nodes, cast(sum(c_custkey) AS bigint) AS key_sum FROM customer
UNION ALL SELECT 'S', count(*), cast(sum(a) AS bigint) FROM r WHERE a = b HAVING count(*) > 0""",
        "two_ledgers_txn": """
SELECT 'orders' AS ledger, printf('C%010d', o_custkey) AS account, count(*) AS n_rows,
  cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS total,
  count(*) - 1 AS last_seq FROM orders GROUP BY ALL
UNION ALL
SELECT 'events', printf('U%010d', user_id), count(*),
  cast(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * cast(round_even(value * 100, 0) AS bigint)) AS bigint), count(*) - 1
FROM events GROUP BY ALL""",
        "import_rows": _BANK + """SELECT account, date, cast(epoch(date) AS bigint) AS epoch, amount, description, k AS src_row
FROM b WHERE date IS NOT NULL AND amount IS NOT NULL""",
        "import_quarantine": _BANK + """SELECT account, description, k AS src_row,
  CASE WHEN date IS NULL THEN 'no date' ELSE 'no amount' END AS reason FROM b WHERE date IS NULL OR amount IS NULL""",
        "deep_tree_closure": """
WITH RECURSIVE c AS (
  SELECT o_orderkey AS a, o_orderkey AS k, 0 AS depth FROM orders WHERE o_orderkey % 200 = 0
  UNION ALL SELECT c.a, o.o_orderkey, c.depth + 1 FROM c JOIN orders o ON o.o_orderkey = c.k + 1 AND o.o_orderkey % 200 <> 0)
SELECT cast(a AS varchar) AS ancestor, cast(k AS varchar) AS node, depth FROM c""",
        "long_rule_table": """
SELECT 'R' || substr(o_orderpriority, 1, 1) AS derived_account, cast(substr(o_orderpriority, 1, 1) AS int) - 1 AS rule_no,
  count(*) AS n_rows,
  cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS total,
  count(DISTINCT o_custkey) AS n_matchings
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE (o_custkey + cast(substr(o_orderpriority, 1, 1) AS int) - 1) % 3 <> 0 GROUP BY ALL""",
        "broken_tree_checks": """
SELECT 'H1' AS "check", 'S' || cast(s_suppkey AS varchar) AS subject FROM supplier WHERE s_suppkey % 10 = 3
UNION ALL SELECT 'H2', 'X' || cast(n_nationkey AS varchar) FROM nation WHERE n_nationkey % 10 = 4
UNION ALL SELECT 'H3', 'ring' || l || cast(c_custkey AS varchar) FROM customer, (VALUES ('A'), ('B'), ('C')) v(l) WHERE c_custkey % 100 = 1
UNION ALL SELECT 'H4', 'S' || cast(s_suppkey AS varchar) FROM supplier WHERE NOT s_acctbal > 0
UNION ALL SELECT 'H4', 'N' || cast(n_nationkey AS varchar) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""",
    }
