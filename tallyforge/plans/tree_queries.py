"""Interval labels of the category tree and of deep chains, and sums over subtrees.  The SQL is written from the
semantics alone and imports nothing of the code it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import materialize
from ..sources import driver_tables as dt
from .ledgers import orders_ledger

_SHOWN = ["node", "depth", "size", "height", "enter", "leave"]


def q_geo_labels(spark, sf) -> DataFrame:
    return I.label(materialize(dt.geo_tree_edges(spark, sf))).select(*_SHOWN)


def q_deep_tree_labels(spark, sf) -> DataFrame:
    """Order keys as chains of up to 200 nodes, each key below the one before it."""
    o = dt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).where("k % 200 <> 0")
    e = o.select((F.col("k") - 1).cast("string").alias("parent"), F.col("k").cast("string").alias("child"), F.lit(0).cast("long").alias("ord"))
    return I.label(materialize(e)).select(*_SHOWN)


def q_geo_subtree_totals(spark, sf) -> DataFrame:
    """A10 for every node: transactions, their amounts and the accounts' start values below it."""
    lf = orders_ledger(spark, sf)
    labels = I.label(materialize(dt.geo_tree_edges(spark, sf)))
    moved = lf.txn.select(F.col("account").alias("node"), F.lit(1).cast("bigint").alias("n_txn"), "amount", F.lit(0).cast("bigint").alias("start_value"))
    begun = lf.source_accounts.select(F.col("name").alias("node"), F.lit(0).cast("bigint").alias("n_txn"), F.lit(0).cast("bigint").alias("amount"), "start_value")
    return I.subtree_sums(labels, moved.unionByName(begun), ["n_txn", "amount", "start_value"])


def queries() -> dict:
    return {"geo_labels": q_geo_labels, "deep_tree_labels": q_deep_tree_labels, "geo_subtree_totals": q_geo_subtree_totals}


_TREE = """tree AS (
  SELECT r_name AS node, 'All' AS parent, r_regionkey AS ord FROM region
  UNION ALL SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT printf('C%010d', c_custkey), n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT DISTINCT 'All', NULL, 0 FROM region),
above(node, anc, depth, place) AS (
  SELECT node, node, 0, [CAST(ord AS BIGINT)] FROM tree
  UNION ALL SELECT a.node, t.parent, a.depth + 1, list_prepend(coalesce(CAST(p.ord AS BIGINT), 0), a.place)
  FROM above a JOIN tree t ON t.node = a.anc JOIN tree p ON p.node = t.parent)"""


def oracle_sql() -> dict[str, str]:
    return {
        "geo_labels": f"""WITH RECURSIVE {_TREE},
lines AS (SELECT node, max(depth) AS depth, max_by(place, depth) AS place FROM above GROUP BY node),
below AS (SELECT anc AS node, count(*) AS size, max(depth) AS height FROM above GROUP BY anc),
ranked AS (SELECT node, depth, row_number() OVER (ORDER BY place) - 1 AS enter FROM lines)
SELECT node, CAST(depth AS BIGINT) AS depth, size, CAST(height AS BIGINT) AS height, enter, enter + size AS leave
FROM ranked JOIN below USING (node)""",
        "deep_tree_labels": """
WITH k AS (SELECT o_orderkey AS k FROM orders),
e AS (SELECT k - 1 AS p, k AS c FROM k WHERE k % 200 <> 0),
n AS (SELECT p AS k FROM e UNION SELECT c FROM e),
s AS (SELECT k, k - row_number() OVER (ORDER BY k) - 1000000000 * (k // 200) AS island FROM n),
m AS (SELECT island, min(k) AS low, max(k) AS high, count(*) AS size FROM s GROUP BY island),
f AS (SELECT *, sum(size) OVER (ORDER BY CAST(low AS VARCHAR)) - size AS before FROM m)
SELECT CAST(k AS VARCHAR) AS node, CAST(k - low AS BIGINT) AS depth, CAST(high - k + 1 AS BIGINT) AS size, CAST(high - k AS BIGINT) AS height,
  CAST(before + k - low AS BIGINT) AS enter, CAST(before + size AS BIGINT) AS leave
FROM s JOIN f USING (island)""",
        "geo_subtree_totals": f"""WITH RECURSIVE {_TREE},
own AS (
  SELECT printf('C%010d', o_custkey) AS node, 1 AS n_txn,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount, 0 AS start_value FROM orders
  UNION ALL SELECT printf('C%010d', c_custkey), 0, 0, CAST(round(c_acctbal * 100) AS BIGINT) FROM customer),
s AS (SELECT a.anc AS node, sum(n_txn) AS n, sum(amount) AS amount, sum(start_value) AS start_value FROM above a JOIN own USING (node) GROUP BY a.anc)
SELECT t.node, CAST(coalesce(n, 0) AS BIGINT) AS n_txn, CAST(coalesce(amount, 0) AS BIGINT) AS amount,
  CAST(coalesce(start_value, 0) AS BIGINT) AS start_value
FROM tree t LEFT JOIN s USING (node)""",
    }
