import random

import numpy as np
import pytest
from fixtures import collect, tables, words

from tallyforge.llm import components as K
from tallyforge.llm import ngram_join as J
from tallyforge.llm.common import written
from tallyforge.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), len(s), str(least.get(root(k)) if s or i is None else i)) for k, (i, s) in enumerate(sets))


def result(spark, docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.op6_ngram_join(spark, tables(documents=docs)).collect())


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    license_ = words(rng, 60)
    docs = []
    for g in range(25):
        base = words(rng, rng.choice([3, 6, 30, 120, 400]), 5000)
        for _ in range(rng.randrange(1, 9)):
            docs.append(edited(rng, base, rng.choice([0, 0, 1, 2, 5])))
    for _ in range(60):  # unrelated texts around one passage
        docs.append(words(rng, rng.randrange(10, 80), 5000) + license_ + words(rng, rng.randrange(5, 40), 5000))
    chain = words(rng, 200, 10**6)  # neighbours link, ends do not
    for k in range(12):
        docs.append(chain[k * 4 : k * 4 + 140])
    docs += [[], ["one"], ["one"], ["ONE"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + [(5000, None), (5001, " \t\n\x0b\x0c\r"), (5002, "x\x0by  z\x1cq")]


def test_components_equal_brute_force(spark, corpus):
    assert result(spark, corpus) == brute(corpus)


def test_small_cells_and_common_shingles(spark, corpus, monkeypatch):
    monkeypatch.setattr(J, "CELL", 4)
    monkeypatch.setattr(J, "COMMON", 8)
    assert result(spark, corpus) == brute(corpus)


def test_a_pair_of_several_tiles_is_proposed_once(spark, monkeypatch):
    # one near group whose members share most of 12 shingles, each with other members
    rng = random.Random(14)
    sets = {sid: sorted(rng.sample(range(100, 112), 9)) for sid in range(30)}
    shared = spark.createDataFrame([(h, sid) for sid, s in sets.items() for h in s], "h long, sid long")
    bits = J.parity_bitmap(np.arange(40, dtype=np.uint64) << np.uint64(7))
    classes = spark.createDataFrame([(sid, 40, bits) for sid in sets], "sid long, n long, bitmap binary")
    none = spark.createDataFrame([], "node long, comp long")
    monkeypatch.setattr(type(shared), "distinct", lambda self: self)  # the rows as the cells propose them
    for cell in (1024, 7):
        monkeypatch.setattr(J, "CELL", cell)
        pairs = [tuple(r) for r in J._tiles(shared, classes, none, True).collect()]
        assert set(pairs) == {(a, b) for a in range(30) for b in range(a + 1, 30)}
        assert len(pairs) < 1.1 * len(set(pairs))  # each pair shares six tiles or more


def test_a_class_comes_once_to_the_tile_of_a_smallest_class(spark, monkeypatch):
    # near texts share most of their shingles: tiles by shingle would deal each text some forty times
    rng = random.Random(23)
    base = words(rng, 160, 10**6)
    docs = [(i, " ".join(edited(rng, base, 3))) for i in range(20)]
    dealt, tiles = [], J._tiles
    monkeypatch.setattr(J, "_tiles", lambda shared, *args: dealt.append(shared.select("h", "sid").collect()) or tiles(shared, *args))
    assert result(spark, docs) == brute(docs)
    assert len(dealt[0]) == len(set(dealt[0])) < 20 * 20


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(K, "written", lambda df, name: rounds.append(name) or written(df, name))
    stars = spark.createDataFrame([(1, k) for k in range(2, 30)] + [(k, 50) for k in range(51, 60)] + [(50, 51), (7, 7)], "a long, b long")
    assert dict(map(tuple, components(stars).collect())) == {k: 1 for k in range(1, 30)} | {k: 50 for k in range(50, 60)}
    assert rounds == []
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert dict(map(tuple, components(path).collect())) == {1: 1, 2: 1, 3: 1} and len(rounds) == 1


@pytest.mark.parametrize("rest", [8, 0])
def test_other_pairs_of_a_cell_are_settled_in_its_round(spark, monkeypatch, rest):
    # near in their bitmaps, linked or not: the forest's pairs alone do not tell all components
    rng = random.Random(21)
    docs = []
    for g in range(6):
        base = words(rng, 150, 10**6)
        docs += [edited(rng, base, n) for n in (0, 2, 3, 4, 5, 5, 6, 6, 7, 7)]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    deals, tiles = [], J._tiles
    monkeypatch.setattr(J, "REST", rest)
    monkeypatch.setattr(J, "_tiles", lambda *args: deals.append(args[-1]) or tiles(*args))
    assert result(spark, docs) == brute(docs)
    assert deals == [False] if rest else deals[-1] is True


def test_repeats_nulls_and_empty_table(spark):
    docs = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (9, "A B c d e f g"), (2, "z"), (None, "q r"), (3, "w " * 50_000)]
    assert result(spark, docs) == brute(docs)
    assert result(spark, []) == []


def test_documents_without_an_id_link_others(spark):
    rng = random.Random(6)
    w = words(rng, 140, 10**6)
    a, b, c = w[:104], w[6:114], w[14:122]  # a-b and b-c link, a-c do not
    docs = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c))]
    assert result(spark, docs) == brute(docs) and {r[2] for r in result(spark, docs)} == {"1"}
    assert {r[2] for r in brute([docs[0], docs[2]])} == {"1", "2"}
    more = docs + [(None, " ".join(b))] * 3 + [(None, " ".join(words(rng, 30, 10**6)))] * 2 + [(2, " ".join(a[:50])), (2, "x y z")]
    assert result(spark, more) == brute(more)


def test_threshold_is_exact(spark):
    # 100 and 75 shingles of which 75 are shared: exactly 0.75; one fewer shared: below it
    a = [f"t{i}" for i in range(104)]
    docs = [(1, " ".join(a)), (2, " ".join(a[:79])), (10, " ".join(f"u{i}" for i in range(104))), (11, " ".join([f"u{i}" for i in range(78)] + ["v"]))]
    assert result(spark, docs) == brute(docs)
    assert {r[2] for r in result(spark, docs)} == {"1", "10", "11"}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 700))) for _ in range(2))
        x, y = (np.frombuffer(J.parity_bitmap(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert int(np.bitwise_count(J.fold(x, w) ^ J.fold(y, w)).sum()) <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(written(spark.createDataFrame(edges, "a long, b long"), "test-edges"))
    assert sorted(map(tuple, got.collect())) == sorted(label.items())
