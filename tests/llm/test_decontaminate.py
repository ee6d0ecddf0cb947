import hashlib
import random
import re

from fixtures import collect, tables, words

from tallyforge.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, x in items:
            x = split(x)
            n = min(10, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names.add(name)
        listed = sorted(str(x) for x in names if x is not None)
        out.append((str(i), len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def result(spark, docs, items):
    rows = D.op7_decontaminate(spark, tables(documents=docs, benchmark=items)).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


def corpus(seed=1):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 30))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 30, 80] * 2)]
    items += [(None, "null named item with more than ten words in it to find"), (90, None), (91, " .. "), (92, items[8][1]), (8, items[8][1]), (93, "É û 漢")]
    docs = []
    for i in range(120):
        w = words(rng, rng.randrange(80), 30)
        for _ in range(rng.randrange(4)):
            x = split(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[a : a + rng.randrange(25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    docs += [(500, None), (501, ""), (502, "!!"), (503, "null named item with more than ten words in it to find"), (3, "again w1 w2"), (None, items[8][1]),
             (504, ("w1 " * 30_000) + items[8][1]), (505, "É û 漢"), (506, "é û 漢")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    assert result(spark, docs, items) == brute(docs, items)


def test_several_slices_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_WORDS", 200)
    docs, items = corpus(2)
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_every_long_shared_span_shares_a_fingerprint():
    rng = random.Random(3)
    for _ in range(300):
        shared = words(rng, 10, 6)
        prints = []
        for _ in range(2):
            w = [x.encode() for x in words(rng, rng.randrange(20), 6) + shared + words(rng, rng.randrange(20), 6)]
            g = D.gram_hashes(D.hashes_of(w), D.K)
            prints.append({int(g[p]) for p in D.winnow(g, D.GUARANTEE - D.K + 1)})
        assert prints[0] & prints[1]
