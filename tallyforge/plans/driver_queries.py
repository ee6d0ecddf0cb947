"""Named queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables; results carry BIGINT cents and text dates so that Spark and
DuckDB types agree column for column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as ledger_ops
from ..operators import transfers as transfer_ops
from ..sources import driver_tables as dt
from ..functions.timefmt import bound_epoch
from ..operators import browse as B
from ..operators import checks as C
from ..operators import hierarchy as H
from ..operators import intervals as I
from ..operators import series as S
from ..operators.balances import account_kinds
from ..session import materialize
from . import edge_queries, probe_queries, tree_queries
from . import oracle as O
from .ledgers import events_ledger, orders_ledger, status_ledger

Query = Callable[[SparkSession, str], DataFrame]


def _txn_ids(lf) -> DataFrame:
    return lf.txn.select("account", "seq", "id", F.date_format("date", "yyyy-MM-dd").alias("date"),
                         "epoch", "amount", "description")


def q_txn_ids(spark, sf):
    return _txn_ids(orders_ledger(spark, sf))


def q_events_txn_ids(spark, sf):
    return _txn_ids(events_ledger(spark, sf))


def q_end_balances(spark, sf):
    return orders_ledger(spark, sf).source_balances()


def q_statement(spark, sf):
    return orders_ledger(spark, sf).statement()


def q_events_statement(spark, sf):
    return events_ledger(spark, sf).statement()


def _derived(lf) -> DataFrame:
    return lf.derived_txn.select("derived_account", "seq", "id",
                                 F.date_format("date", "yyyy-MM-dd").alias("date"), "epoch",
                                 "amount", "description", "source_id", "source_account")


def q_derived_txn(spark, sf):
    return _derived(orders_ledger(spark, sf))


def q_events_derived_txn(spark, sf):
    return _derived(events_ledger(spark, sf))


def q_derived_balances(spark, sf):
    return orders_ledger(spark, sf).derived_balances()


def q_derived_statement(spark, sf):
    return orders_ledger(spark, sf).derived_statement()


def q_derived_entries(spark, sf):
    return orders_ledger(spark, sf).derived_entries


def _pairs(lf) -> DataFrame:
    p = transfer_ops.transfer_pairs(lf.transfer_matches)
    return p.select("mapping_no", "k", "from_account", "from_id", "to_account", "to_id",
                    F.abs("from_amount").alias("delta"), "pair_in_sync")


def q_transfer_pairs(spark, sf):
    return _pairs(orders_ledger(spark, sf))


def q_events_transfer_pairs(spark, sf):
    return _pairs(events_ledger(spark, sf))


def q_transfer_unpaired(spark, sf):
    u = transfer_ops.unpaired(orders_ledger(spark, sf).transfer_matches)
    return u.select("mapping_no", "k", "side", "account", "id", "seq", "amount",
                    F.date_format("date", "yyyy-MM-dd").alias("date"), "description")


def q_transfer_report(spark, sf):
    lf = orders_ledger(spark, sf)
    return transfer_ops.transfer_report(lf.transfer_mappings, lf.transfer_matches)


def q_self_transfers(spark, sf):
    return transfer_ops.self_transfers(orders_ledger(spark, sf).transfer_mappings)


def q_ledger_entries(spark, sf):
    return orders_ledger(spark, sf).entries


def q_events_ledger_entries(spark, sf):
    return events_ledger(spark, sf).entries


def q_duplicate_claims(spark, sf):
    return ledger_ops.duplicate_claims(orders_ledger(spark, sf).entries)


def q_unaccounted(spark, sf):
    return orders_ledger(spark, sf).unaccounted


def q_events_unaccounted(spark, sf):
    return events_ledger(spark, sf).unaccounted


def q_hot_txn_ids(spark, sf):
    return _txn_ids(status_ledger(spark, sf))


def q_hot_statement(spark, sf):
    return status_ledger(spark, sf).statement()


def q_hot_unaccounted(spark, sf):
    return status_ledger(spark, sf).unaccounted


def q_events_end_balances(spark, sf):
    return events_ledger(spark, sf).source_balances()


def q_events_derived_balances(spark, sf):
    return events_ledger(spark, sf).derived_balances()


def q_events_transfer_report(spark, sf):
    lf = events_ledger(spark, sf)
    return transfer_ops.transfer_report(lf.transfer_mappings, lf.transfer_matches)


def q_events_duplicate_claims(spark, sf):
    return ledger_ops.duplicate_claims(events_ledger(spark, sf).entries)


def queries() -> dict[str, Query]:
    return {
        "txn_ids": q_txn_ids,
        "events_txn_ids": q_events_txn_ids,
        "end_balances": q_end_balances,
        "statement": q_statement,
        "events_statement": q_events_statement,
        "derived_txn": q_derived_txn,
        "events_derived_txn": q_events_derived_txn,
        "derived_balances": q_derived_balances,
        "derived_statement": q_derived_statement,
        "derived_entries": q_derived_entries,
        "transfer_pairs": q_transfer_pairs,
        "events_transfer_pairs": q_events_transfer_pairs,
        "transfer_unpaired": q_transfer_unpaired,
        "transfer_report": q_transfer_report,
        "self_transfers": q_self_transfers,
        "ledger_entries": q_ledger_entries,
        "events_ledger_entries": q_events_ledger_entries,
        "duplicate_claims": q_duplicate_claims,
        "unaccounted": q_unaccounted,
        "events_unaccounted": q_events_unaccounted,
        "events_end_balances": q_events_end_balances,
        "events_derived_balances": q_events_derived_balances,
        "events_transfer_report": q_events_transfer_report,
        "events_duplicate_claims": q_events_duplicate_claims,
        "hot_txn_ids": q_hot_txn_ids,
        "hot_statement": q_hot_statement,
        "hot_unaccounted": q_hot_unaccounted,
        **geo_queries(),
        **browse_queries(),
        **edge_queries.queries(),
        **probe_queries.queries(),
        **tree_queries.queries(),
    }


# ------------------------------------------------------------------------------------------
# Oracle SQL


def _orders(*extra: str) -> str:
    m = dt.ORDERS_MAPPING
    return O.with_ctes(O.raw_orders(), O.accounts_orders(), O.txn_ctes(), O.derived_ctes(m),
                       O.mappings_orders(m), O.transfer_ctes(), *extra)


def _events(*extra: str) -> str:
    m = dt.EVENTS_MAPPING
    return O.with_ctes(O.raw_events(), O.accounts_events(), O.txn_ctes(), O.derived_ctes(m),
                       O.mappings_events(), O.transfer_ctes(), *extra)


def _status(*extra: str) -> str:
    """Orders keyed by status (three hot accounts); no transfer mappings."""
    m = dt.ORDERS_MAPPING
    raw = O.raw_orders().replace("printf('C%010d', o_custkey)", "'S' || o_orderstatus")
    accounts = """src_accounts AS (
  SELECT DISTINCT 'S' || o_orderstatus AS name, 'source' AS kind, cast(0 AS bigint) AS start_value FROM orders)"""
    fixed = O.mappings_orders(m).split("\n  UNION ALL SELECT c.c_custkey")[0] + ")"
    return O.with_ctes(raw, accounts, O.txn_ctes(), O.derived_ctes(m), fixed, O.transfer_ctes(), *extra)


TXN_IDS = "SELECT account, seq, id, strftime(date, '%Y-%m-%d') AS date, epoch, amount, description FROM txn"

END_BAL = """SELECT a.name, a.kind, a.start_value,
       a.start_value + coalesce(s.total, 0) AS end_value, coalesce(s.n, 0) AS n_txn
FROM {accounts} a LEFT JOIN (SELECT {acct} AS name, cast(sum(amount) AS bigint) AS total,
                                     count(*) AS n FROM {table} GROUP BY {acct}) s ON a.name = s.name"""

STATEMENT = """SELECT t.{acct} AS account, t.seq, strftime(t.date, '%Y-%m-%d') AS date, t.description,
       t.amount AS delta,
       coalesce(a.start_value, 0) + cast(sum(t.amount) OVER (PARTITION BY t.{acct} ORDER BY t.seq
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS balance
FROM {table} t LEFT JOIN {accounts} a ON a.name = t.{acct}"""

DERIVED = """SELECT derived_account, seq, id, strftime(date, '%Y-%m-%d') AS date, epoch, amount, description,
       source_id, source_account FROM derived"""

PAIRS = """SELECT mapping_no, k, from_account, from_id, to_account, to_id, abs(from_amount) AS delta,
       from_amount = -to_amount AS pair_in_sync
FROM matches WHERE from_id IS NOT NULL AND to_id IS NOT NULL"""

UNPAIRED = """SELECT mapping_no, k, 'from' AS side, from_account AS account, from_id AS id, from_seq AS seq,
       from_amount AS amount, strftime(from_date, '%Y-%m-%d') AS date, from_description AS description
FROM matches WHERE to_id IS NULL
UNION ALL
SELECT mapping_no, k, 'to', to_account, to_id, to_seq, to_amount, strftime(to_date, '%Y-%m-%d'), to_description
FROM matches WHERE from_id IS NULL"""

REPORT = """SELECT u.mapping_no, u.from_account, u.to_account,
       coalesce(a.n_from, 0) AS n_from, coalesce(a.n_to, 0) AS n_to, coalesce(a.n_paired, 0) AS n_paired,
       least(coalesce(a.n_from, 0), coalesce(a.n_to, 0)) AS pair_count,
       coalesce(a.in_sync, true) AS in_sync,
       coalesce(a.n_to, 0) - coalesce(a.n_from, 0) AS diff_to_from
FROM usable u LEFT JOIN (
  SELECT mapping_no, count(from_id) AS n_from, count(to_id) AS n_to,
         count(CASE WHEN from_id IS NOT NULL AND to_id IS NOT NULL THEN 1 END) AS n_paired,
         coalesce(bool_and(CASE WHEN from_id IS NOT NULL AND to_id IS NOT NULL
                                THEN from_amount = -to_amount END), true) AS in_sync
  FROM matches GROUP BY mapping_no) a ON u.mapping_no = a.mapping_no"""

UNACCOUNTED = """SELECT row_number() OVER (ORDER BY t.account, t.seq) - 1 AS index,
       strftime(t.date, '%Y-%m-%d') AS date, t.description, t.amount AS delta, t.account
FROM txn t ANTI JOIN accounted a ON t.account = a.account AND t.id = a.id"""


def oracle_sql() -> dict[str, str]:
    return {
        "txn_ids": _orders() + TXN_IDS,
        "events_txn_ids": _events() + TXN_IDS,
        "end_balances": _orders() + END_BAL.format(accounts="src_accounts", table="txn", acct="account"),
        "statement": _orders() + STATEMENT.format(table="txn", acct="account", accounts="src_accounts"),
        "events_statement": _events() + STATEMENT.format(table="txn", acct="account", accounts="src_accounts"),
        "derived_txn": _orders() + DERIVED,
        "events_derived_txn": _events() + DERIVED,
        "derived_balances": _orders() + END_BAL.format(accounts="der_accounts", table="derived",
                                                       acct="derived_account"),
        "derived_statement": _orders() + STATEMENT.format(table="derived", acct="derived_account",
                                                          accounts="der_accounts"),
        "derived_entries": _orders() + "SELECT * FROM derived_entries",
        "transfer_pairs": _orders() + PAIRS,
        "events_transfer_pairs": _events() + PAIRS,
        "transfer_unpaired": _orders() + UNPAIRED,
        "transfer_report": _orders() + REPORT,
        "self_transfers": _orders() + "SELECT mapping_no, from_account AS account FROM mappings "
                                      "WHERE from_account = to_account",
        "ledger_entries": _orders() + "SELECT * FROM entries",
        "events_ledger_entries": _events() + "SELECT * FROM entries",
        "duplicate_claims": _orders() + "SELECT account, id, count(*) AS n_claims FROM accounted "
                                        "GROUP BY account, id HAVING count(*) > 1",
        "unaccounted": _orders() + UNACCOUNTED,
        "events_unaccounted": _events() + UNACCOUNTED,
        "events_end_balances": _events() + END_BAL.format(accounts="src_accounts", table="txn", acct="account"),
        "events_derived_balances": _events() + END_BAL.format(accounts="der_accounts", table="derived",
                                                              acct="derived_account"),
        "events_transfer_report": _events() + REPORT,
        "events_duplicate_claims": _events() + "SELECT account, id, count(*) AS n_claims FROM accounted "
                                               "GROUP BY account, id HAVING count(*) > 1",
        "hot_txn_ids": _status() + TXN_IDS,
        "hot_statement": _status() + STATEMENT.format(table="txn", acct="account", accounts="src_accounts"),
        "hot_unaccounted": _status() + UNACCOUNTED,
        **geo_oracle(),
        **browse_oracle(),
        **edge_queries.oracle_sql(),
        **probe_queries.oracle_sql(),
        **tree_queries.oracle_sql(),
    }


# ------------------------------------------------------------------------------------------
# Category tree over the driver tables: All -> region -> nation -> customer account


SERIES_FROM = "1995-Mar-15"
SERIES_TO = "1996-Feb-29"
OPEN_NODES = ["AMERICA", "ASIA", "NATION_7"]
SWITCHES = [(1, "ASIA", False), (2, "NATION_8", True), (3, "NATION_12", False)]


def _geo(spark, sf):
    return materialize(dt.geo_tree_edges(spark, sf))


def q_geo_closure(spark, sf):
    return H.closure(_geo(spark, sf)).select("ancestor", "node", F.col("depth").cast("bigint").alias("depth"))


def q_geo_subtree_leaves(spark, sf):
    return H.subtree_leaves(_geo(spark, sf))


def q_geo_heights(spark, sf):
    return H.heights(_geo(spark, sf)).select("node", F.col("height").cast("bigint").alias("height"))


def q_geo_tree_problems(spark, sf):
    """H1-H5 on the geo tree used as a category tree of the orders ledger."""
    e = _geo(spark, sf)
    lf = orders_ledger(spark, sf)
    dup = H.duplicate_children(e).select(F.col("child").alias("name"), F.lit("duplicate child").alias("problem"))
    iso = H.isolated_nodes(e, dt.ROOT).select(F.col("node").alias("name"), F.lit("isolated node").alias("problem"))
    cyc = H.cycle_nodes(e, dt.ROOT).select(F.col("node").alias("name"), F.lit("cycle").alias("problem"))
    bad = H.invalid_leaves(e, account_kinds(lf.accounts), dt.ROOT).select(
        "name", F.lit("invalid leaf").alias("problem"))
    cov = H.coverage(e, lf.accounts)
    return dup.unionByName(iso).unionByName(cyc).unionByName(bad).unionByName(cov)


def _series(spark, sf, e=None, labels=None, groups=None):
    """Series and start values of ``groups`` (all inner nodes, if none are given)."""
    lf = orders_ledger(spark, sf)
    e = e if e is not None else _geo(spark, sf)
    labels = labels if labels is not None else I.label(e)
    groups = groups if groups is not None else labels.where("height > 0").select(F.col("node").alias("grp"))
    height = labels.agg(F.max("height")).first()[0] or 0
    # the transactions are shuffled once, then rolled up level by level
    net = S.rolled_net_changes(e, lf.txn, groups, depth=height)
    starts = materialize(S.subtree_starts(labels, lf.source_accounts).join(groups, "grp", "left_semi"), "starts")
    return S.full_series(None, lf.txn, lf.source_accounts, net=net, starts=starts), starts


def q_geo_series(spark, sf):
    return _series(spark, sf)[0]


def q_geo_clipped_series(spark, sf):
    full, starts = _series(spark, sf)
    return S.clip_series(full, starts, bound_epoch(SERIES_FROM), bound_epoch(SERIES_TO))


def q_geo_series_totals(spark, sf):
    return S.series_totals(q_geo_clipped_series(spark, sf))


def q_geo_series_range(spark, sf):
    return S.series_range(q_geo_clipped_series(spark, sf))


def _open(spark):
    return spark.createDataFrame([(n,) for n in OPEN_NODES], "node string")


def _switches(spark):
    return spark.createDataFrame(SWITCHES, "switch_no bigint, node string, active boolean")


def q_geo_frontier(spark, sf):
    return H.frontier(_geo(spark, sf), dt.ROOT, _open(spark))


def q_geo_selection(spark, sf):
    return H.selection(_geo(spark, sf), _switches(spark))


def q_selected_series_totals(spark, sf):
    e = _geo(spark, sf)
    labels = I.label(e)
    groups = materialize(H.selected_groups(e, dt.ROOT, _open(spark), _switches(spark), labels), "groups")
    full, starts = _series(spark, sf, e, labels, groups)
    clipped = S.clip_series(full, starts, bound_epoch(SERIES_FROM), bound_epoch(SERIES_TO))
    return S.series_totals(clipped)


GEO_EDGES = """geo_edges AS (
  SELECT 'All' AS parent, r_name AS child FROM region
  UNION ALL SELECT r.r_name, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT n.n_name, printf('C%010d', c.c_custkey) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
geo_nodes AS (SELECT parent AS node FROM geo_edges UNION SELECT child FROM geo_edges),
geo_leaves AS (SELECT DISTINCT child AS node FROM geo_edges WHERE child NOT IN (SELECT parent FROM geo_edges)),
clo(ancestor, node, depth) AS (
  SELECT node, node, 0 FROM geo_nodes
  UNION ALL SELECT c.ancestor, e.child, c.depth + 1 FROM clo c JOIN geo_edges e ON e.parent = c.node),
sub_leaves AS (SELECT ancestor AS grp, node AS leaf FROM clo WHERE node IN (SELECT node FROM geo_leaves))"""


def _geo_sql(*extra: str) -> str:
    return "WITH RECURSIVE " + _orders()[len("WITH "):].rstrip() + ",\n" + ",\n".join((GEO_EDGES,) + extra) + "\n"


def _series_ctes(groups_sql: str, leaves: str = "sub_leaves", accounts: str = "src_accounts",
                 txn: str = "txn", acct: str = "account", bounds=None) -> str:
    lo, hi = bounds or (SERIES_FROM, SERIES_TO)
    s, e = bound_epoch(lo), bound_epoch(hi)
    return f"""gl AS (SELECT grp, leaf FROM {leaves} WHERE grp IN ({groups_sql})),
g_start AS (SELECT gl.grp, -cast(sum(a.start_value) AS bigint) AS start
            FROM gl JOIN {accounts} a ON a.name = gl.leaf GROUP BY gl.grp),
net AS (SELECT gl.grp, t.epoch, -cast(sum(t.amount) AS bigint) AS net
        FROM gl JOIN {txn} t ON t.{acct} = gl.leaf GROUP BY gl.grp, t.epoch),
series AS (
  SELECT n.grp, n.epoch, g.start + cast(sum(n.net) OVER (PARTITION BY n.grp ORDER BY n.epoch) AS bigint) AS balance
  FROM net n JOIN g_start g ON g.grp = n.grp
  UNION ALL SELECT grp, cast(0 AS bigint), start FROM g_start),
asof_s AS (SELECT grp, max_by(balance, epoch) AS b FROM series WHERE epoch < {s} GROUP BY grp),
asof_e AS (SELECT grp, max_by(balance, epoch) AS b FROM series WHERE epoch < {e} GROUP BY grp),
clipped AS (
  SELECT grp, epoch, balance FROM series WHERE epoch BETWEEN {s} AND {e}
  UNION ALL SELECT g.grp, cast({s} AS bigint), coalesce(a.b, g.start) FROM g_start g LEFT JOIN asof_s a ON a.grp = g.grp
    WHERE g.grp NOT IN (SELECT grp FROM series WHERE epoch = {s})
  UNION ALL SELECT g.grp, cast({e} AS bigint), coalesce(a.b, g.start) FROM g_start g LEFT JOIN asof_e a ON a.grp = g.grp
    WHERE g.grp NOT IN (SELECT grp FROM series WHERE epoch = {e})),
totals AS (
  SELECT grp, count(*) AS n_points, cast(sum(balance) AS bigint) AS balance_point_sum,
         min_by(balance, epoch) AS first_balance, max_by(balance, epoch) AS last_balance,
         max_by(balance, epoch) - min_by(balance, epoch) AS net_change,
         min(balance) AS min_balance, max(balance) AS max_balance
  FROM clipped GROUP BY grp)"""


INTERIOR = "SELECT DISTINCT parent FROM geo_edges"

FRONTIER = """opened AS (SELECT * FROM (VALUES {opened}) v(node)),
vis AS (
  SELECT c.node FROM clo c
  WHERE c.ancestor = 'All' AND c.depth > 0
    AND NOT EXISTS (SELECT 1 FROM clo a WHERE a.node = c.node AND a.depth > 0 AND a.ancestor <> 'All'
                    AND a.ancestor NOT IN (SELECT node FROM opened))),
frontier AS (SELECT node FROM vis WHERE node NOT IN (SELECT node FROM opened)
                                      OR node IN (SELECT node FROM geo_leaves)),
switches AS (SELECT * FROM (VALUES {switches}) v(switch_no, node, active)),
selection AS (
  SELECT n.node, coalesce((SELECT max_by(s.active, s.switch_no) FROM clo c JOIN switches s ON s.node = c.ancestor
                           WHERE c.node = n.node), true) AS active
  FROM geo_nodes n)"""


def _frontier_sql() -> str:
    opened = ", ".join(f"('{n}')" for n in OPEN_NODES)
    sw = ", ".join(f"({a}, '{b}', {str(c).lower()})" for a, b, c in SWITCHES)
    return FRONTIER.format(opened=opened, switches=sw)


def geo_oracle() -> dict[str, str]:
    return {
        "geo_closure": _geo_sql() + "SELECT ancestor, node, cast(depth AS bigint) AS depth FROM clo",
        "geo_subtree_leaves": _geo_sql() + "SELECT grp, leaf FROM sub_leaves",
        "geo_heights": _geo_sql() + "SELECT ancestor AS node, cast(max(depth) AS bigint) AS height FROM clo "
                                    "WHERE node IN (SELECT node FROM geo_leaves) GROUP BY ancestor",
        "geo_tree_problems": _geo_sql() + """
SELECT name, 'source account in tree' AS problem FROM src_accounts WHERE name IN (SELECT node FROM geo_nodes)
UNION ALL SELECT name, 'derived account not in tree' FROM der_accounts WHERE name NOT IN (SELECT node FROM geo_nodes)
UNION ALL SELECT child, 'duplicate child' FROM geo_edges GROUP BY child HAVING count(*) > 1""",
        "geo_series": _geo_sql(_series_ctes(INTERIOR)) + "SELECT grp, epoch, balance FROM series",
        "geo_clipped_series": _geo_sql(_series_ctes(INTERIOR)) + "SELECT grp, epoch, balance FROM clipped",
        "geo_series_totals": _geo_sql(_series_ctes(INTERIOR)) + "SELECT * FROM totals",
        "geo_series_range": _geo_sql(_series_ctes(INTERIOR)) + """
SELECT min(min_balance) AS min_balance, max(max_balance) AS max_balance, min(balance_point_sum) AS min_total,
       max(balance_point_sum) AS max_total, count(*) AS n_groups FROM totals""",
        "geo_frontier": _geo_sql(_frontier_sql()) + "SELECT node FROM frontier",
        "geo_selection": _geo_sql(_frontier_sql()) + "SELECT node, active FROM selection",
        "selected_series_totals": _geo_sql(
            _frontier_sql(),
            _series_ctes("SELECT f.node FROM frontier f JOIN selection s ON s.node = f.node WHERE s.active")
        ) + "SELECT * FROM totals",
        "category_clipped_series": _category_sql() + "SELECT grp, epoch, balance FROM clipped",
        "category_series_totals": _category_sql() + "SELECT * FROM totals",
        "events_category_series_totals": _category_sql(mapping=dt.EVENTS_MAPPING, base=_events,
                                                       bounds=(EVENTS_FROM, EVENTS_TO)) + "SELECT * FROM totals",
    }


# ---- the orders ledger's own category tree over its derived accounts (the reference's plot)

def _category_clipped(spark, sf, builder=orders_ledger, bounds=None):
    lf = builder(spark, sf)
    tree = lf.mapping.category_tree()
    e = H.edges_from_dict(spark, tree)
    gl = H.subtree_leaves(e)
    d = lf.derived_txn.withColumnRenamed("derived_account", "account")
    full = S.full_series(gl, d, lf.derived_accounts)
    starts = S.group_start(gl, lf.derived_accounts)
    lo, hi = bounds or (SERIES_FROM, SERIES_TO)
    return S.clip_series(full, starts, bound_epoch(lo), bound_epoch(hi))


# Plot bounds for the events ledger (its timestamps span one month, with sub-second parts).
EVENTS_FROM = "2024-Jan-10"
EVENTS_TO = "2024-Jan-20"


def q_events_category_series_totals(spark, sf):
    return S.series_totals(_category_clipped(spark, sf, events_ledger, (EVENTS_FROM, EVENTS_TO)))


def q_category_clipped_series(spark, sf):
    return _category_clipped(spark, sf)


def q_category_series_totals(spark, sf):
    return S.series_totals(_category_clipped(spark, sf))


def _category_sql(*extra: str, mapping=None, base=None, bounds=None) -> str:
    mapping = mapping or dt.ORDERS_MAPPING
    base = base or _orders
    tree = mapping.category_tree()
    values = ", ".join(f"('{p}', '{c}')" for p, cs in tree.items() for c in cs)
    cat = f"""cat_edges AS (SELECT * FROM (VALUES {values}) v(parent, child)),
cat_nodes AS (SELECT parent AS node FROM cat_edges UNION SELECT child FROM cat_edges),
cat_leaves AS (SELECT DISTINCT child AS node FROM cat_edges WHERE child NOT IN (SELECT parent FROM cat_edges)),
cclo(ancestor, node, depth) AS (
  SELECT node, node, 0 FROM cat_nodes
  UNION ALL SELECT c.ancestor, e.child, c.depth + 1 FROM cclo c JOIN cat_edges e ON e.parent = c.node),
cat_sub_leaves AS (SELECT ancestor AS grp, node AS leaf FROM cclo WHERE node IN (SELECT node FROM cat_leaves))"""
    series = _series_ctes("SELECT node FROM cat_nodes", leaves="cat_sub_leaves", accounts="der_accounts",
                          txn="derived", acct="derived_account", bounds=bounds)
    return "WITH RECURSIVE " + base()[len("WITH "):].rstrip() + ",\n" + ",\n".join((cat, series) + extra) + "\n"


def geo_queries() -> dict[str, Query]:
    return {
        "geo_closure": q_geo_closure,
        "geo_subtree_leaves": q_geo_subtree_leaves,
        "geo_heights": q_geo_heights,
        "geo_tree_problems": q_geo_tree_problems,
        "geo_series": q_geo_series,
        "geo_clipped_series": q_geo_clipped_series,
        "geo_series_totals": q_geo_series_totals,
        "geo_series_range": q_geo_series_range,
        "geo_frontier": q_geo_frontier,
        "geo_selection": q_geo_selection,
        "selected_series_totals": q_selected_series_totals,
        "category_clipped_series": q_category_clipped_series,
        "category_series_totals": q_category_series_totals,
        "events_category_series_totals": q_events_category_series_totals,
    }


# ------------------------------------------------------------------------------------------
# Browser, catalog SQL and checks


USER_SQL = ("SELECT account, count(*) AS n_txn, CAST(sum(amount) AS BIGINT) AS total "
            "FROM ledger_txn WHERE amount > {min} GROUP BY account")


def q_browse_statement(spark, sf):
    st = orders_ledger(spark, sf).statement()
    shown = B.browse(st, ["account", "seq", "date", "description", "delta", "balance"],
                     B.SortState().click("delta").click("delta"), text="URGENT", tie_break=["account", "seq"])
    return B.filter_sql(shown, "delta < :lim", {"lim": 0})


def q_browse_unaccounted(spark, sf):
    u = orders_ledger(spark, sf).unaccounted
    return B.browse(u, ["index", "date", "description", "delta", "account"], B.SortState().click("index"),
                    text="LOW")


def q_account_names(spark, sf):
    return B.account_names(orders_ledger(spark, sf).txn, "account")


def q_sql_query(spark, sf):
    lf = orders_ledger(spark, sf)
    return B.run_sql(spark, USER_SQL.format(min=":min"), {"ledger_txn": lf.txn}, {"min": 100000})


def q_match_counts(spark, sf):
    return C.match_counts(orders_ledger(spark, sf).derived_txn)


def q_ledger_checks(spark, sf):
    return probe_queries.check_rows(orders_ledger(spark, sf))


def browse_queries() -> dict[str, Query]:
    return {
        "browse_statement": q_browse_statement,
        "browse_unaccounted": q_browse_unaccounted,
        "account_names": q_account_names,
        "sql_query": q_sql_query,
        "match_counts": q_match_counts,
        "ledger_checks": q_ledger_checks,
    }


def browse_oracle() -> dict[str, str]:
    st = STATEMENT.format(table="txn", acct="account", accounts="src_accounts")
    return {
        "browse_statement": _orders() + f"SELECT * FROM ({st}) s WHERE contains(description, 'URGENT') AND delta < 0",
        "browse_unaccounted": _orders() + f"SELECT * FROM ({UNACCOUNTED}) u WHERE contains(description, 'LOW')",
        "account_names": _orders() + "SELECT DISTINCT account AS name FROM txn",
        "sql_query": _orders_with("ledger_txn AS (SELECT * FROM txn)") + USER_SQL.format(min=100000),
        "match_counts": _orders() + "SELECT derived_account, matching_no, source_account, count(*) AS n_rows "
                                    "FROM derived GROUP BY ALL",
        "ledger_checks": _orders() + """
SELECT 'V1' AS "check", source_id AS subject FROM derived WHERE derived_account = source_account
UNION ALL SELECT 'V6', name FROM src_accounts WHERE name IN (SELECT name FROM der_accounts)
UNION ALL SELECT 'V7', 'mapping ' || cast(mapping_no AS varchar) FROM mappings WHERE from_account = to_account
UNION ALL SELECT 'V8', CASE WHEN account IS NULL THEN 'no account' WHEN date IS NULL OR epoch IS NULL THEN 'no date'
                          ELSE 'no amount' END FROM raw
          WHERE account IS NULL OR date IS NULL OR epoch IS NULL OR amount IS NULL
UNION ALL SELECT 'V10', a FROM (
  SELECT from_account AS a FROM mappings UNION ALL SELECT to_account FROM mappings
  UNION ALL SELECT * FROM (VALUES {rule_accounts}) v(a)) x
  WHERE a NOT IN (SELECT name FROM src_accounts)""".format(rule_accounts=_rule_accounts_values()),
    }


def _rule_accounts_values() -> str:
    names = [m.account_name for r in dt.ORDERS_MAPPING.derived for m in r.matchings if not m.is_blank]
    return ", ".join(f"({O.q(n)})" for n in names) or "(NULL)"


def _orders_with(extra: str) -> str:
    return _orders().rstrip() + ",\n" + extra + "\n"
