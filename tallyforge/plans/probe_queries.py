"""Balances at many given times, hot transfer mappings and long rule lists over the driver tables.  The
SQL is written from the semantics alone and imports nothing of the code it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balances as B
from ..operators import checks as C
from ..operators import rules as R
from ..operators import series as S
from ..operators import transfers as T
from ..sources import driver_tables as dt
from .config import MAPPING_SCHEMA, AccountMapping, DerivedRule, Matching, TransferMapping
from .ledgers import build_ledger, events_ledger, orders_ledger, status_ledger


def _shipments(spark, sf, account) -> DataFrame:
    """The account of every line's order, with the line's shipping day as an epoch."""
    line = dt.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at"))
    order = dt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), account.alias("account"))
    return line.join(order, "l_orderkey")


def q_balance_at_shipment(spark, sf) -> DataFrame:
    lf = orders_ledger(spark, sf)
    return B.balance_at(lf.txn, lf.source_accounts, _shipments(spark, sf, dt.customer_account(F.col("o_custkey"))))


def q_hot_balance_at_shipment(spark, sf) -> DataFrame:
    """Three accounts hold all rows: each is cut into ranges."""
    lf = status_ledger(spark, sf)
    return B.balance_at(lf.txn, lf.source_accounts, _shipments(spark, sf, F.concat(F.lit("S"), F.col("o_orderstatus"))))


def q_event_balances(spark, sf) -> DataFrame:
    """Every user's balance at each of the user's own events, before them."""
    lf = events_ledger(spark, sf)
    probes = lf.txn.select("account", F.col("epoch").alias("at")).distinct()
    return B.balance_at(lf.txn, lf.source_accounts, probes)


def q_derived_balance_by_day(spark, sf) -> DataFrame:
    """Every derived account's series at the start of every day on which an order was made."""
    lf = orders_ledger(spark, sf)
    d = lf.derived_txn.withColumnRenamed("derived_account", "account")
    groups = lf.derived_accounts.select(F.col("name").alias("grp"), F.col("name").alias("leaf"))
    days = lf.txn.select("epoch").distinct()
    probes = days.select("epoch", F.explode(F.array(*[F.lit(r.name) for r in lf.mapping.derived])).alias("grp"))
    return S.asof_many(S.full_series(groups, d, lf.derived_accounts), probes, S.group_start(groups, lf.derived_accounts))


def q_hot_transfers(spark, sf) -> DataFrame:
    """Two mappings between the three hot accounts: every rank block holds rows of both sides."""
    m = spark.createDataFrame([(1, "SF", "URGENT|HIGH", "SO", "LOW"), (2, "SO", "^[45]-", "SF", "M.DIUM"), (3, "SP", "SPECIFIED$", "SF", "LOW")], MAPPING_SCHEMA)
    found = T.transfer_matches(status_ledger(spark, sf).txn, m)
    return found.select("mapping_no", "k", "from_account", "from_seq", "from_amount", "to_account", "to_seq", "to_amount")


def check_rows(lf) -> DataFrame:
    """(check, subject) of every row-level check of a ledger."""
    rules = lf.mapping.derived
    parts = [
        C.self_sourced(lf.derived_txn).select(F.lit("V1").alias("check"), F.col("source_id").alias("subject")),
        C.blank_matchings(lf.spark, rules).select(F.lit("V3").alias("check"), F.col("derived_account").alias("subject")),
        C.name_clashes(B.account_kinds(lf.accounts)).select(F.lit("V6").alias("check"), F.col("name").alias("subject")),
        T.self_transfers(lf.transfer_mappings).select(
            F.lit("V7").alias("check"), F.concat(F.lit("mapping "), F.col("mapping_no").cast("string")).alias("subject")),
        lf.quarantine.select(F.lit("V8").alias("check"), F.col("reason").alias("subject")),
        C.unknown_rule_accounts(lf.spark, rules, lf.transfer_mappings, lf.accounts).select(
            F.lit("V10").alias("check"), F.col("account").alias("subject")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_clashing_checks(spark, sf) -> DataFrame:
    """Orders with a rule file full of mistakes: derived accounts named like source accounts (one takes rows from
    itself), a blank matching among others, unknown accounts, a mapping onto itself."""
    rules = [DerivedRule("C0000000003", (Matching("C0000000003", ("LOW",)), Matching("C0000000004", ("URGENT",)))),
             DerivedRule("Both", (Matching("", ("HIGH",)), Matching("C0000000007", ("LOW",)))),
             DerivedRule("C0000000010", (Matching("", ("MEDIUM",)),)), DerivedRule("Gone", (Matching("NOBODY", ("LOW",)),))]
    transfers = [TransferMapping("C0000000001", ("URGENT",), "NOWHERE", ("LOW",)), TransferMapping("C0000000002", ("LOW",), "C0000000002", ("LOW",))]
    lf = build_ledger(spark, "clashing", dt.orders_raw(spark, sf), dt.orders_accounts(spark, sf), AccountMapping(rules, transfers))
    # rows that an account takes from itself are counted by account
    own = lf.derived_txn.select(F.col("source_id").alias("subject"), "derived_account")
    named = check_rows(lf).join(own.where("derived_account like 'C%'"), "subject", "left")
    subject = F.when(F.col("check") == "V1", F.col("derived_account")).otherwise(F.col("subject"))
    return named.where("check <> 'V1' or derived_account in ('C0000000003', 'C0000000010')").groupBy("check", subject.alias("subject")).agg(
        F.count(F.lit(1)).alias("n"))


def q_mirrored_transfers(spark, sf) -> DataFrame:
    """Every customer's urgent orders against an account that mirrors them; for every third customer some mirrored
    amounts are a cent off, and for another third one mirrored row in seven is missing."""
    raw = dt.orders_raw(spark, sf)
    key, row = F.substring("account", 2, 10).cast("bigint"), F.col("src_row")
    off = F.when((key % 3 == 1) & (row % 5 == 0), 1).otherwise(0)
    mirror = raw.where((F.col("description") == "1-URGENT") & ((key % 3 != 2) | (row % 7 != 0))).withColumn("amount", off - F.col("amount"))
    mirror = mirror.withColumn("account", F.concat(F.lit("M"), F.substring("account", 2, 10)))
    c = dt.table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("mapping_no"), F.format_string("%010d", "c_custkey").alias("k"))
    m = c.select("mapping_no", F.concat(F.lit("C"), "k").alias("from_account"), F.lit("URGENT").alias("from_regex"),
                 F.concat(F.lit("M"), "k").alias("to_account"), F.lit("URGENT").alias("to_regex"))
    lf = build_ledger(spark, "mirrored", raw.unionByName(mirror), dt.orders_accounts(spark, sf), AccountMapping(), m)
    return T.transfer_report(m, lf.transfer_matches)


MANY = 5000


def q_many_rules(spark, sf) -> DataFrame:
    """A rule file of 5,000 matchings: rule i takes the orders of customers i, i + 500, ... by priority."""
    words = ("URGENT", "HIGH", "MEDIUM", "SPECIFIED", "LOW")
    rules = [DerivedRule(f"Rule{i}", tuple(Matching(f"C{i + 500 * j:010d}", (words[(i + j) % 5],)) for j in range(10))) for i in range(MANY // 10)]
    return R.match_rules(orders_ledger(spark, sf).txn, rules).select("account", "seq", "derived_account", "rule_no", "matching_no", "amount")


def queries() -> dict:
    return {"balance_at_shipment": q_balance_at_shipment, "hot_balance_at_shipment": q_hot_balance_at_shipment, "event_balances": q_event_balances,
            "derived_balance_by_day": q_derived_balance_by_day, "hot_transfers": q_hot_transfers, "many_rules": q_many_rules,
            "clashing_checks": q_clashing_checks, "mirrored_transfers": q_mirrored_transfers}


_ORDERS = """o AS (
  SELECT {account} AS account, o_orderkey AS k, cast(epoch(cast(o_orderdate AS date)) AS bigint) AS t, o_orderpriority AS description,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * cast(round(o_totalprice * 100) AS bigint) AS amount FROM orders),
o2 AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, k) - 1 AS seq FROM o)"""

_AT = """WITH {orders},
run AS (SELECT account, t, cast(sum(sum(amount)) OVER (PARTITION BY account ORDER BY t) AS bigint) AS total FROM o GROUP BY account, t),
p AS (SELECT l_orderkey, l_linenumber, cast(epoch(cast(l_shipdate AS date)) AS bigint) AS at, {account} AS account, {start} AS start
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey {more})
SELECT p.l_orderkey, p.l_linenumber, p.at, p.account, p.start + coalesce(run.total, 0) AS balance
FROM p ASOF LEFT JOIN run ON run.account = p.account AND run.t < p.at"""

_CUSTOMER = "printf('C%010d', o_custkey)"


def oracle_sql() -> dict[str, str]:
    by_customer, by_status = _ORDERS.format(account=_CUSTOMER), _ORDERS.format(account="'S' || o_orderstatus")
    return {
        "clashing_checks": """
SELECT 'V1' AS "check", 'C0000000003' AS subject, count(*) AS n FROM orders WHERE o_custkey = 3 AND o_orderpriority = '5-LOW' HAVING count(*) > 0
UNION ALL SELECT 'V1', 'C0000000010', count(*) FROM orders WHERE o_custkey = 10 AND o_orderpriority = '3-MEDIUM' HAVING count(*) > 0
UNION ALL SELECT 'V3', 'Both', 1
UNION ALL SELECT 'V6', printf('C%010d', c_custkey), 1 FROM customer WHERE c_custkey IN (3, 10)
UNION ALL SELECT 'V7', 'mapping 1', 1
UNION ALL SELECT 'V10', a, 1 FROM (VALUES ('NOBODY'), ('NOWHERE')) v(a)""",
        "mirrored_transfers": """
WITH u AS (SELECT c_custkey AS c, count(o_orderkey) AS n, count(o_orderkey) FILTER (c_custkey % 3 = 1 AND o_orderkey % 5 = 0) AS off,
    count(o_orderkey) FILTER (c_custkey % 3 = 2 AND o_orderkey % 7 = 0) AS lost
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey),
o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * cast(round(o_totalprice * 100) AS bigint) AS amount
  FROM orders WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) AS pos2 FROM o WHERE c % 3 <> 2 OR k % 7 <> 0),
bad AS (SELECT o.c, bool_or(o.amount <> m.amount) AS bad FROM o JOIN m ON m.c = o.c AND m.pos2 = o.pos WHERE o.c % 3 = 2 GROUP BY o.c)
SELECT cast(u.c AS bigint) AS mapping_no, printf('C%010d', u.c) AS from_account, printf('M%010d', u.c) AS to_account, n AS n_from, n - lost AS n_to,
  n - lost AS n_paired, n - lost AS pair_count, off = 0 AND NOT coalesce(bad, false) AS in_sync, -lost AS diff_to_from
FROM u LEFT JOIN bad ON bad.c = u.c""",
        "balance_at_shipment": _AT.format(orders=by_customer, account=_CUSTOMER, start="coalesce(cast(round(c_acctbal * 100) AS bigint), 0)",
                                          more="LEFT JOIN customer ON c_custkey = o_custkey"),
        "hot_balance_at_shipment": _AT.format(orders=by_status, account="'S' || o_orderstatus", start="cast(0 AS bigint)", more=""),
        "event_balances": """
WITH e AS (
  SELECT printf('U%010d', user_id) AS account, cast(floor(epoch(ts)) AS bigint) AS t,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * cast(round_even(value * 100, 0) AS bigint) AS amount FROM events
  WHERE value IS NOT NULL)
SELECT account, t AS at, cast(coalesce(sum(sum(amount)) OVER (PARTITION BY account ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS balance
FROM e GROUP BY account, t""",
        "derived_balance_by_day": "WITH " + by_customer + """,
d AS (
  SELECT 'High' AS grp, t, amount FROM o WHERE description IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 'Mid', t, amount FROM o WHERE description = '3-MEDIUM'
  UNION ALL SELECT 'Flagged', t, amount FROM o WHERE account = 'C0000000003' AND description = '5-LOW'
  UNION ALL SELECT 'Flagged', t, amount FROM o WHERE account = 'C0000000007' AND description = '4-NOT SPECIFIED'
  UNION ALL SELECT 'Flagged', t, amount FROM o WHERE account = 'C0000000003' AND description IN ('5-LOW', '1-URGENT')),
run AS (SELECT grp, t, cast(sum(sum(amount)) OVER (PARTITION BY grp ORDER BY t) AS bigint) AS total FROM d GROUP BY grp, t),
p AS (SELECT DISTINCT t AS epoch, grp, start FROM o, (VALUES ('High', 0), ('Mid', -1000), ('Flagged', 0)) v(grp, start))
SELECT p.grp, p.epoch, cast(p.start + coalesce(run.total, 0) AS bigint) AS balance
FROM p ASOF LEFT JOIN run ON run.grp = p.grp AND run.t < p.epoch""",
        "hot_transfers": "WITH " + by_status + """,
f AS (
  SELECT 1 AS m, *, row_number() OVER (ORDER BY seq) - 1 AS k2 FROM o2 WHERE account = 'SF' AND description IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 2, *, row_number() OVER (ORDER BY seq) - 1 FROM o2 WHERE account = 'SO' AND description[1] IN ('4', '5')
  UNION ALL SELECT 3, *, row_number() OVER (ORDER BY seq) - 1 FROM o2 WHERE account = 'SP' AND description = '4-NOT SPECIFIED'),
t2 AS (
  SELECT 1 AS m, *, row_number() OVER (ORDER BY seq) - 1 AS k2 FROM o2 WHERE account = 'SO' AND description = '5-LOW'
  UNION ALL SELECT 2, *, row_number() OVER (ORDER BY seq) - 1 FROM o2 WHERE account = 'SF' AND description = '3-MEDIUM'
  UNION ALL SELECT 3, *, row_number() OVER (ORDER BY seq) - 1 FROM o2 WHERE account = 'SF' AND description = '5-LOW')
SELECT cast(coalesce(f.m, t2.m) AS bigint) AS mapping_no, coalesce(f.k2, t2.k2) AS k, f.account AS from_account, f.seq AS from_seq, f.amount AS from_amount,
  t2.account AS to_account, t2.seq AS to_seq, t2.amount AS to_amount
FROM f FULL JOIN t2 ON f.m = t2.m AND f.k2 = t2.k2""",
        "many_rules": "WITH " + _ORDERS.format(account="o_custkey").replace("AS account, ", "AS c, ").replace("PARTITION BY account", "PARTITION BY c") + f""",
hit AS (SELECT *, c % 500 AS i, c // 500 AS j FROM o2 WHERE c >= 0 AND c < {MANY})
SELECT printf('C%010d', c) AS account, seq, 'Rule' || cast(i AS varchar) AS derived_account, cast(i AS int) AS rule_no, cast(j AS int) AS matching_no, amount
FROM hit WHERE contains(description, ['URGENT', 'HIGH', 'MEDIUM', 'SPECIFIED', 'LOW'][cast((i + j) % 5 + 1 AS int)])""",
    }
