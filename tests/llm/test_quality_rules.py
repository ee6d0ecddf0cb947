"""Counts against plain loops; estimates against the same algorithm on numpy arrays; planted outliers."""

import collections
import random
import re

import numpy as np
import pyarrow.parquet as pq

from tallyforge.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    hit = [False] * n
    for i in range(n - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            hit[i:i + 5] = [True] * 5
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, sum(hit)


EDGES = [None, "", " \t\n\x0b", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\n\nx\nx \n x\n", "#*$%&|<> é☕ z", "  a\x1fb",
         "w " * 9000, " ".join(f"t{i % 97}" for i in range(500)), "r\r\nr\r\nr"]


def test_counts_of_edge_texts():
    rng = random.Random(2)
    mixed = ["".join(rng.choice("ab \n#\t") for _ in range(rng.randrange(120))) for _ in range(300)]
    for t in EDGES + mixed:
        assert Q.text_counts(t) == plain_counts(t), repr(t)[:80]


def _points(counts):
    n, chars, sy, dup, rep = (counts[:, i].astype(float) for i in range(5))
    rate = lambda c: np.log2(1 + 100 * c / (n + Q.SHORT))
    return np.floor(np.stack([np.log2(1 + n), np.log2(chars / n), rate(sy), rate(dup), rate(rep)], 1) * Q.STEP + .5) / Q.STEP


def _used(x, factor):
    n = len(x)
    cov = np.cov(x.T, bias=True)
    used = (n * factor * cov + Q.PRIOR_ROWS * np.diag(np.square(Q.PRIOR))) / (n + Q.PRIOR_ROWS) + np.diag(np.square(Q.FLOOR))
    return x.mean(0), np.linalg.inv(used), np.linalg.slogdet(used)[1]


def _d2(x, est):
    return np.einsum("ij,jk,ik->i", x - est[0], est[1], x - est[0])


def plain_distances(x):
    """Concentration steps on one group's points."""
    n, ends = len(x), []
    lower = lambda v: np.sort(v, axis=0)[(n + 1) // 2 - 1]
    mid = lower(x)
    spread = np.floor((lower(np.abs(x - mid)) * Q.STEP * 1.4826) ** 2) / Q.STEP**2
    prior, floor = np.diag(np.square(Q.PRIOR)), np.diag(np.square(Q.FLOOR))
    used = (n * np.diag(spread) + Q.PRIOR_ROWS * prior) / (n + Q.PRIOR_ROWS) + floor
    for est in (_used(x, 1.0), (mid, np.linalg.inv(used), 0.0)):
        size = None
        for _ in range(Q.MOST_STEPS):
            bins = np.minimum(np.floor(np.log2(1 + _d2(x, est)) * 256), Q.BINS - 1)
            edge = np.sort(bins)[int(np.ceil(n * Q.SUBSET)) - 1]
            sub = x[bins <= edge]
            new = _used(sub, Q.SUBSET_FACTOR)
            done = size == len(sub) and abs(new[2] - est[2]) <= 1e-9
            est, size = new, len(sub)
            if done:
                break
        ends.append(est)
    best = min(ends, key=lambda e: e[2])
    return _d2(x, _used(x[_d2(x, best) <= Q.REWEIGHT_QUANTILE], Q.REWEIGHT_FACTOR))


def _check(rows, got):
    """rows: (doc_id, lang, source, text); got: judged rows by doc_id."""
    groups = collections.defaultdict(list)
    for doc, lang, source, text in rows:
        c = plain_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        g = got[doc]
        assert tuple(g[k] for k in Q.COUNTS) == c and g["base_failed"] == failed
        if failed:
            assert g["kept"] is False and g["distance"] is None
        else:
            groups[lang, source].append((doc, c))
    for members in groups.values():
        want = plain_distances(_points(np.array([c for _, c in members])))
        have = np.array([got[doc]["distance"] for doc, _ in members])
        assert np.allclose(have, want, rtol=1e-6, atol=1e-6)
        assert [got[doc]["kept"] for doc, _ in members] == (want <= Q.CUTOFF).tolist()


def _documents():
    rng = random.Random(9)
    vocabulary = ["the", "of", "river", "stone", "walked", "because", "evening", "a", "question", "nobody"]
    rows = []
    for i in range(500):
        text = " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(int(2 ** rng.gauss(7, 1.2)) + 10))
        group = ("en", "hot") if i % 3 else rng.choice([("de", "a"), (None, "a"), ("de", None), ("es", "tiny")])
        rows.append((i, *group, text + rng.choice([".", "\nEnd & out.", ""])))
    junk = [(1000 + i, "en", "hot", " ".join(rng.choice(vocabulary) + rng.choice(["&&&", "%%%", "|", "###"]) for _ in range(120 + i))) for i in range(40)]
    return rows, junk, [(2000 + i, "en", "hot", t) for i, t in enumerate(EDGES)]


def _frame(spark, rows):
    df = spark.createDataFrame([(d, t, l, s) for d, l, s, t in rows], "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as n_words", "2 as x0", "3 as start", "4 as n", "5 as rows", "6 as kept", "7 as n_chars")  # clashing names


def test_estimates_and_verdicts_against_numpy(spark):
    clean, junk, edges = _documents()
    rows = clean + junk + edges
    got = {r["doc_id"]: r for r in Q.judged(_frame(spark, rows).repartition(7)).collect()}
    assert len(got) == len(rows)
    _check(rows, got)
    assert not any(got[d]["kept"] for d, *_ in junk)
    assert sum(got[d]["kept"] for d, *_ in clean) >= 0.99 * len(clean)


def test_empty_table_repeated_ids_and_null_ids(spark):
    assert Q.judged(_frame(spark, [])).collect() == []
    text = " ".join(f"word{i}" for i in range(30))
    got = Q.judged(_frame(spark, [(1, "en", "s", text), (1, "en", "s", text), (None, "en", "s", text), (2, None, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in got) == [("1", 30, True), ("1", 30, True), ("2", 0, False), ("None", 30, True)]


def test_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    full = {r["doc_id"]: r for r in Q.judged(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    _check(rows, full)
    out = Q.op12_quality_rules(spark, path)
    assert out.columns == ["doc_id", *Q.COUNTS, "base_failed", "kept"]
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == {d: r["kept"] for d, r in full.items()}
