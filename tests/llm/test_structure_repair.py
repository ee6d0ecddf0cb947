"""Audits against a plain shortest path; damaged and repaired tables against a plain walk and the SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow.parquet as pq

from tallyforge.llm import structure_repair as R

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_audit(rows):
    """rows: (initial, must_go, truncated); least (cost, letters) by trying everything, state by state."""
    def inserted(f):
        f = dict(f)
        for _ in range(4):
            for q, to in NEXT.items():
                if q in f:
                    f[to] = min(f.get(to, (9**9, "")), (f[q][0] + 3, f[q][1] + "I"))
        return f

    f = inserted({"": (0, "")})
    for initial, gone, cut in rows:
        g = {}
        for q, (c, a) in f.items():
            ways = [(q, c + 4, "D")]
            if not gone:
                if initial == NEXT[q] or (initial, q) == ("s", ""):
                    ways.append((initial, c + 3 * cut, "K"))
                ways.append((NEXT[q], c + 3 + 3 * cut, "R"))
            for to, cost, letter in ways:
                g[to] = min(g.get(to, (9**9, "")), (cost, a + letter))
        f = inserted(g)
    return min(f[q] for q in ("", "a") if q in f)


def _symbols(rows):
    return [R.MUST_GO if gone else R.symbol(initial, cut) for initial, gone, cut in rows]


KINDS = [(i, False, c) for i in ("s", "u", "a", "x", "") for c in (False, True)] + [("u", True, False)]


def test_every_short_conversation():
    for n in range(4):
        for rows in itertools.product(KINDS, repeat=n):
            assert R.audit(_symbols(rows)) == plain_audit(rows), rows


def test_long_random_conversations():
    rng = random.Random(3)
    for _ in range(400):
        rows = [rng.choice(KINDS) for _ in range(rng.randrange(4, 70))]
        assert R.audit(_symbols(rows)) == plain_audit(rows)
    rows = [rng.choice(KINDS) for _ in range(20_000)]
    cost, letters = R.audit(_symbols(rows))
    assert (cost, letters) == plain_audit(rows)


def plain(rows):
    """The whole contract on (conv_id, turn, role, text) rows."""
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[c] += [(t, role, text)] * (2 if h == 3 else 1)
    out = []
    for c, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, role, text in found:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, letters = plain_audit(kinds)
        lines, last, at = [], "", 0
        for e in letters:
            if e in "IR":
                role = {"u": "user", "a": "assistant"}[NEXT[last]]
                text = "" if e == "I" else found[at][2]
            else:
                _, role, text = found[at]
            at += e != "I"
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        out.append((c, gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _edge_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]
    texts = ["Hello.", "Hello", "", None, " \t\n", "Why?!", "a\n.b", "ends\x0b", "☕.", "long " * 3000 + "."]
    rows = [(c, t if rng.random() > .1 else None, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(0, 14))]
    rows += [(None, 1, "user", "x."), (None, None, None, None), (7, 2**62, "user", "far."), (7, -2**62, "assistant", "far.")]
    rows += [(90, t, "user", "same.") for t in (1, 1, 1, 2)] + [(91, None, "user", "b."), (91, None, "assistant", "a.")]
    return rows


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as position", "'x' as digest", "true as kept", "'a' as audit")  # clashing names


def test_edge_rows_against_the_plain_walk(spark):
    rows = _edge_rows()
    got = R.repair_digests(R.damaged(_frame(spark, rows).repartition(5)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_edge_rows_against_the_sql(spark):
    rows = _edge_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[1] is None or abs(r[1]) < 2**60])
    res = con.execute(R.ORACLE)
    at = [[d[0] for d in res.description].index(c) for c in COLUMNS]
    want = plain([r for r in rows if r[1] is None or abs(r[1]) < 2**60])
    assert sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str) == want


def test_repaired_turns_are_legal_and_empty_tables_pass(spark):
    rows = _edge_rows()
    turns = R.repaired_turns(_frame(spark, rows)).collect()
    by = {}
    for r in sorted(turns, key=lambda r: (str(r["conv_id"]), r["position"])):
        by.setdefault(r["conv_id"], []).append(r)
    for c, found in by.items():
        assert [r["position"] for r in found] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in found)), c
    empty = _frame(spark, [])
    assert R.repair_digests(R.damaged(empty)).collect() == [] and R.repaired_turns(empty).collect() == []


def test_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{path}/conversations.parquet").to_pylist()]
    assert sorted(map(tuple, R.op11_structure_repair(spark, path).collect()), key=str) == plain(rows)
