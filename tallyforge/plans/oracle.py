"""DuckDB SQL for the driver's correctness check, written independently of the Spark code.

Each ledger is described by plain SQL CTEs over the pre-registered driver views; windows there
are the naive single-partition kind, which is exactly what makes them a good oracle for the
bucketed Spark numbering.
"""

from __future__ import annotations

from ..functions.ids import transaction_id_sql
from .config import AccountMapping


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def raw_orders() -> str:
    return """raw AS (
  SELECT printf('C%010d', o_custkey) AS account,
         cast(o_orderdate AS date) AS date,
         cast(floor(epoch(o_orderdate)) AS bigint) AS epoch,
         CASE WHEN o_orderstatus = 'F' THEN cast(round(o_totalprice * 100) AS bigint)
              WHEN o_orderstatus <> 'F' THEN -cast(round(o_totalprice * 100) AS bigint) END AS amount,
         o_orderpriority AS description,
         o_orderkey AS src_row
  FROM orders)"""


def accounts_orders() -> str:
    return """src_accounts AS (
  SELECT printf('C%010d', c_custkey) AS name, 'source' AS kind,
         coalesce(cast(round(c_acctbal * 100) AS bigint), 0) AS start_value
  FROM customer)"""


def raw_events() -> str:
    return """raw AS (
  SELECT printf('U%010d', user_id) AS account,
         cast(ts AS date) AS date,
         cast(floor(epoch(ts)) AS bigint) AS epoch,
         CASE WHEN event_type = 'purchase' THEN cast(round(value * 100) AS bigint)
              WHEN event_type <> 'purchase' THEN -cast(round(value * 100) AS bigint) END AS amount,
         event_type AS description,
         event_id AS src_row
  FROM events)"""


def accounts_events() -> str:
    return """src_accounts AS (
  SELECT DISTINCT printf('U%010d', user_id) AS name, 'source' AS kind, cast(0 AS bigint) AS start_value
  FROM events)"""


def mappings_orders(mapping: AccountMapping) -> str:
    fixed = []
    n = len(mapping.transfers)
    for i, t in enumerate(mapping.transfers):
        fixed.append(f"SELECT cast({i - n} AS bigint) AS mapping_no, {q(t.from_account)} AS from_account, "
                     f"{q(_regex(t.from_strings))} AS from_regex, {q(t.to_account)} AS to_account, "
                     f"{q(_regex(t.to_strings))} AS to_regex")
    data = """SELECT c.c_custkey AS mapping_no, printf('C%010d', c.c_custkey) AS from_account,
         'URGENT' AS from_regex, printf('C%010d', c.c_custkey + 1) AS to_account, 'LOW' AS to_regex
  FROM customer c JOIN customer n ON n.c_custkey = c.c_custkey + 1"""
    return "mappings AS (\n  " + "\n  UNION ALL ".join(fixed + [data]) + ")"


def mappings_events() -> str:
    return """mappings AS (
  SELECT u.user_id AS mapping_no, printf('U%010d', u.user_id) AS from_account, 'purchase' AS from_regex,
         printf('U%010d', u.user_id + 1) AS to_account, 'signup' AS to_regex
  FROM (SELECT DISTINCT user_id FROM events) u
  JOIN (SELECT DISTINCT user_id FROM events) n ON n.user_id = u.user_id + 1)"""


def _regex(strings) -> str:
    from ..functions.text import patterns_regex
    return patterns_regex(strings)


def txn_ctes() -> str:
    idsql = transaction_id_sql("account", "seq", "date", "epoch", "amount", "description")
    return f"""txn0 AS (
  SELECT account, row_number() OVER (PARTITION BY account ORDER BY epoch, src_row) - 1 AS seq,
         date, epoch, amount, description
  FROM raw WHERE account IS NOT NULL AND epoch IS NOT NULL AND amount IS NOT NULL AND date IS NOT NULL),
txn AS (SELECT *, {idsql} AS id FROM txn0)"""


def derived_ctes(mapping: AccountMapping) -> str:
    parts = []
    for r_no, rule in enumerate(mapping.derived):
        for m_no, m in enumerate(rule.matchings):
            if rule.is_universal:
                cond = f"regexp_matches(description, {q(m.regex)})"
            elif not m.is_blank:
                cond = f"account = {q(m.account_name)} AND regexp_matches(description, {q(m.regex)})"
            else:
                continue
            parts.append(f"SELECT {q(rule.name)} AS derived_account, {r_no} AS rule_no, {m_no} AS matching_no, "
                         f"account AS source_account, seq AS source_seq, id AS source_id, date, epoch, "
                         f"-amount AS amount, description FROM txn WHERE {cond}")
    hits = "\n  UNION ALL ".join(parts)
    idsql = transaction_id_sql("derived_account", "seq", "date", "epoch", "amount", "description")
    acc = " UNION ALL ".join(f"SELECT {q(r.name)} AS name, 'derived' AS kind, cast({int(r.start_value)} AS bigint) AS start_value"
                             for r in mapping.derived)
    return f"""hits AS (
  {hits}),
derived0 AS (
  SELECT *, row_number() OVER (PARTITION BY derived_account
                               ORDER BY epoch, matching_no, source_account, source_seq) - 1 AS seq
  FROM hits),
derived AS (SELECT *, {idsql} AS id FROM derived0),
der_accounts AS ({acc}),
derived_entries AS (
  SELECT source_account AS from_account_name, source_id AS from_transaction_id,
         derived_account AS to_account_name, id AS to_transaction_id, abs(amount) AS delta
  FROM derived)"""


def transfer_ctes() -> str:
    return """usable AS (SELECT * FROM mappings WHERE from_account <> to_account),
from_hits AS (
  SELECT m.mapping_no, t.account, t.seq, t.id, t.amount, t.date, t.description,
         row_number() OVER (PARTITION BY m.mapping_no ORDER BY t.seq) - 1 AS k
  FROM txn t JOIN usable m ON t.account = m.from_account
  WHERE regexp_matches(t.description, m.from_regex)),
to_hits AS (
  SELECT m.mapping_no, t.account, t.seq, t.id, t.amount, t.date, t.description,
         row_number() OVER (PARTITION BY m.mapping_no ORDER BY t.seq) - 1 AS k
  FROM txn t JOIN usable m ON t.account = m.to_account
  WHERE regexp_matches(t.description, m.to_regex)),
matches AS (
  SELECT coalesce(f.mapping_no, t.mapping_no) AS mapping_no, coalesce(f.k, t.k) AS k,
         f.account AS from_account, f.id AS from_id, f.amount AS from_amount, f.seq AS from_seq,
         f.date AS from_date, f.description AS from_description,
         t.account AS to_account, t.id AS to_id, t.amount AS to_amount, t.seq AS to_seq,
         t.date AS to_date, t.description AS to_description
  FROM from_hits f FULL OUTER JOIN to_hits t ON f.mapping_no = t.mapping_no AND f.k = t.k),
transfer_entries AS (
  SELECT from_account AS from_account_name, from_id AS from_transaction_id,
         to_account AS to_account_name, to_id AS to_transaction_id, abs(from_amount) AS delta
  FROM matches WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
entries AS (SELECT * FROM derived_entries UNION ALL SELECT * FROM transfer_entries),
accounted AS (
  SELECT from_account_name AS account, from_transaction_id AS id FROM entries
  UNION ALL SELECT to_account_name, to_transaction_id FROM entries)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
