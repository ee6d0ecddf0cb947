"""The trie against plain dictionaries of prefixes and against the SQL."""

import hashlib
import random
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from tallyforge.llm import prefix_trie as T


def plain_trie(paths):
    """paths: {conv: [(role, text), ...]} -> rows of NODE."""
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
        leaves[node] = sum(leaves[k] for k in below) or 1
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
                    leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: [(r, x) for _, r, x in sorted(found, key=key)] for c, found in convs.items()}


def plain_rebuilt(rows):
    convs = ordered(rows)
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def _edge_rows():
    rng = random.Random(5)
    texts = ["a", "b", "", None, "☕ é", "long " * 2000]
    rows = [(c, t if rng.random() > .1 else None, rng.choice(["user", "assistant", None]), rng.choice(texts[:4]))
            for c in range(-20, 330) if c % 7 for t in range(rng.randrange(0, 11))]
    rows += [(300, t, "user", "same") for t in range(3)] + [(c, t, "user", texts[t % 6]) for c in range(400, 440) for t in range(9)]
    rows += [(None, 1, "user", "x"), (777, 1, "user", "twice"), (777, 1, "user", "twice"), (2**62, 1, "user", "far")]
    return rows


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as depth", "'k' as key", "2 as block", "array(1) as keys", "3 as digest")  # clashing names


@pytest.fixture(params=[1, 2, 4])
def block(request, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", request.param)


def test_rebuilt_trie_against_plain(spark, block):
    rows = _edge_rows()
    got = T.trie(*T.rebuilt(T.turn_digests(_frame(spark, rows)))).select(*T.NODE)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_of_conversations_as_they_are(spark):
    rows = [r for r in _edge_rows() if r[0] is None or r[0] < 60] + [(60, t, "user", str(t)) for t in range(200)]
    got = T.prefix_trie(_frame(spark, rows)).select(*T.NODE)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(ordered(rows))


def test_empty_table(spark):
    assert T.prefix_trie(_frame(spark, [])).collect() == []
    assert T.trie(*T.rebuilt(T.turn_digests(_frame(spark, [])))).collect() == []


def test_sql_agrees_on_edge_rows():
    rows = _edge_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    res = con.execute(T.ORACLE)
    at = [[d[0] for d in res.description].index(c) for c in T.NODE]
    assert sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str) == plain_trie(plain_rebuilt(rows))


def test_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{path}/conversations.parquet").to_pylist()]
    got = T.op13_prefix_trie(spark, path)
    assert got.columns == list(T.NODE)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(plain_rebuilt(rows))
