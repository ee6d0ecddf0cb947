import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from fixtures import collect, tables, words

from tallyforge.llm import hashing as H
from tallyforge.llm import substring_dedup as S


def brute(docs):
    low = -(2**63)
    data = [(low if i is None else i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, _), (n, b) in zip(docs, data):
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < n:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(spark, docs):
    rows = S.op9_substring_dedup(spark, tables(documents=docs)).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    passages = [" ".join(words(rng, rng.randrange(6, 40), 10**5)) for _ in range(8)]
    passages += ["x" * 49, "y" * 50, "z" * 51, "ab" * 60, "é" * 40, "漢字" * 20]
    docs = []
    for i in range(140):
        parts = [" ".join(words(rng, rng.randrange(30), 10**5)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 3))
            parts.insert(rng.randrange(len(parts) + 1), p[a : len(p) - rng.randrange(max(1, len(p) // 3))] if rng.random() < 0.5 else p)
        docs.append("|".join(parts))
    docs += [docs[3], docs[3], docs[7][10:], "short", "", docs[9] + docs[9]]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


def test_equals_brute_force(spark, corpus):
    assert result(spark, corpus) == brute(corpus)


def test_small_blocks_slices_and_buckets(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(S, "SLICE_WINDOWS", 50)
    monkeypatch.setattr(S, "BUCKET_ANCHORS", 100)
    monkeypatch.setattr(S, "BUCKET_CONTEXTS", 50)
    assert result(spark, corpus) == brute(corpus)


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rng = random.Random(4)
    long_ = " ".join(words(rng, 60_000, 10**6))
    docs = [(1, None), (None, "n" * 30 + "m" * 40), (2, "n" * 30 + "m" * 40), (7, "same words again and again, " * 4), (7, "same words again and again, " * 4),
            (8, "same words again and again, " * 4), (9, ""), (10, long_[:5000]), (11, "head " + long_[2000:2600])]
    assert result(spark, docs) == brute(docs)
    got = collect(S.op9_substring_dedup(spark, tables(documents=[(1, long_), (2, long_[100:-100])]))).set_index("doc_id").sort_index()
    assert got.n_removed.tolist() == [0, len(long_) - 200] and got.n_spans.tolist() == [0, 1]
    assert result(spark, []) == []


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(8)
    one, two, three = (" ".join(words(rng, 60, 10**6)) for _ in range(3))
    docs = [(1, one), (1, one + two), (7, one), (7, "short"), (7, three + one[40:200]), (7, two[:150] + three), (None, three[:90]), (8, three + three), (8, None)]
    assert result(spark, docs) == brute(docs)
    assert result(spark, docs[:4] + docs[:4]) == brute(docs[:4] + docs[:4])


def test_suffix_sort_orders_groups_by_their_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    text = S.Suffixes(data)
    starts = rng.permutation(3900)[:1500]
    group = np.sort(rng.integers(0, 12, 1500))
    order = S.suffix_sort(text, starts, group)
    want = sorted(range(1500), key=lambda k: (group[k], data[starts[k] : starts[k] + S.LENGTH].tobytes(), k))
    assert order.tolist() == want
    new = S.equal_classes(text, starts[order], group[order])
    key = [(group[k], data[starts[k] : starts[k] + S.LENGTH].tobytes()) for k in want]
    assert new.tolist() == [k == 0 or key[k] != key[k - 1] for k in range(1500)]


def test_common_extension():
    text = S.Suffixes(np.frombuffer(b"abcabcabcx-abcabcabcy", np.uint8))
    assert text.common(np.array([0, 0, 3]), np.array([3, 11, 14]), 7).tolist() == [6, 7, 6]


def contexts(n):
    """``n`` anchors of four contexts each, of three texts, and their bytes one after another."""
    rng = np.random.default_rng(4)
    rows = np.zeros(4 * n, S._CONTEXT)
    rows["key"] = np.tile(rng.permutation(n).astype(np.uint64) * np.uint64(7919), 4)
    rows["id"] = np.repeat([5, 2, 9, 2], n)
    rows["count"], rows["ahead"] = 13, 12
    own = rng.integers(97, 101, (n, 62)).astype(np.uint8)
    other = own.copy()
    other[::2, :8] = 48  # strings from place 8 on are still shared
    return np.concatenate([own, other, own, own]).ravel(), rows


@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_slices_of_a_bucket_cover_what_the_whole_covers(size, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", size)
    data, rows = contexts(300)
    count = rows["count"].astype(np.int64)
    first = np.cumsum(count + 49) - count - 49
    want = S.covered(data, first, count, rows["ahead"].astype(np.int64), rows["id"], rows["key"]).reshape(-1, 13)
    got = np.zeros_like(want)
    for part, hit in S.covered_by_slices(data, rows):
        got[part] |= hit.reshape(-1, 13)
    assert want.any() and not want.all() and (got == want).all()
    assert list(S.covered_by_slices(data[:62], rows[:1])) == []


def test_memory_of_a_bucket_is_bounded(monkeypatch):
    monkeypatch.setattr(H.PrefixHashes, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(H.PrefixHashes, "_inverses", np.ones(1, np.uint64))
    data, rows = contexts(30_000)  # 7 MB
    tracemalloc.start()
    n = sum(int(hit.sum()) for _, hit in S.covered_by_slices(data, rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 60 << 20  # 239 MB when the bucket was hashed as a whole, 25 MB in slices


def test_powers_of_long_data_are_not_kept(monkeypatch):
    monkeypatch.setattr(H.PrefixHashes, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(H.PrefixHashes, "_inverses", np.ones(1, np.uint64))
    data = np.tile(np.frombuffer(b"abcdefg", np.uint8), 200_000)
    text = H.PrefixHashes(data)
    assert text.piece(np.array([3]), 50) == text.piece(np.array([7 * 190_000 + 3]), 50)
    assert H.PrefixHashes(data[:100]).piece(np.array([3]), 50) == text.piece(np.array([3]), 50)
    assert len(H.PrefixHashes._powers) <= H.KEPT and len(H.PrefixHashes._inverses) <= H.KEPT


def test_packets_do_not_grow_with_blocks_times_buckets(spark, monkeypatch):
    """Finding F2: a row for each text and bucket of anchors, and a packet of contexts for each block and bucket."""
    data, rows = contexts(500)
    rows["key"] <<= np.uint64(20)
    step = 4 * 62
    packed = S._Contexts(8)
    sent = [b for k in range(0, 500) for b in packed.add(rows[4 * k : 4 * k + 4], data[step * k : step * k + step])]
    sent += packed.flush()
    assert sum(b.num_rows for b in sent) == 8 and list(packed.flush()) == []
    got = []
    for bucket, raw in ((x["bucket"], x["blob"]) for b in sent for x in b.to_pylist()):
        n, size = np.frombuffer(raw, np.int64, 2).tolist()
        raw = S.pa.decompress(raw[16:], decompressed_size=size, codec="zstd", asbytes=True)
        own = np.frombuffer(raw, S._CONTEXT, n)
        assert ((own["key"] >> np.uint64(20)) % np.uint64(8) == bucket).all()
        got += [(r.tobytes(), raw[n * S._CONTEXT.itemsize + 62 * k :][:62]) for k, r in enumerate(own)]
    assert sorted(got) == sorted((r.tobytes(), data[62 * k : 62 * k + 62].tobytes()) for k, r in enumerate(rows))

    rng = random.Random(3)
    shared = " ".join(words(rng, 200, 10**6))
    docs = spark.createDataFrame([(i, shared + " " + " ".join(words(rng, 50, 10**6)), i % 2) for i in range(60)], "doc_id long, text string, part int")
    S.ship(spark)
    anchors = S._shared_anchors(docs, 12).collect()
    assert 0 < len(anchors) <= 2 * 12  # 60 * 12 before
    assert sum(r.n for r in anchors) >= 60 * 40
    assert set(np.concatenate([np.frombuffer(r.ids, np.int64) for r in anchors]).tolist()) == set(range(60))
    monkeypatch.setattr(S, "IDS_TOLD", 10)
    assert all(r.ids is None for r in S._shared_anchors(docs, 12).collect())


def test_filter_is_left_out_when_too_many_ids_share(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "IDS_TOLD", 0)
    monkeypatch.setattr(S, "PART_BYTES", 3000)
    monkeypatch.setattr(S, "ANCHORS_HELD", 200)
    monkeypatch.setattr(S, "CONTEXTS_HELD", 4000)
    assert result(spark, corpus) == brute(corpus)


def hot_contexts(n):
    """``n`` contexts of one anchor: of few and of many texts, by few ids."""
    rng = np.random.default_rng(9)
    rows = np.zeros(n, S._CONTEXT)
    rows["key"], rows["id"], rows["count"], rows["ahead"] = 77, rng.integers(0, 40, n), 14, 13
    text = rng.integers(97, 99, (n, 63)).astype(np.uint8)
    text[:, 6:58] = 120  # strings 6 .. 8 of all are equal
    text[::3] = text[rng.integers(0, 5, len(text[::3]))]
    return text, rows


def test_one_hot_anchor_is_cut_by_strings(monkeypatch):
    text, rows = hot_contexts(2000)
    least = {}
    for c in range(2000):
        for k in range(14):
            s = (13 - k, text[c, k : k + 50].tobytes())
            least[s] = min(least.get(s, 99), int(rows["id"][c]))
    want = np.array([[rows["id"][c] > least[13 - k, text[c, k : k + 50].tobytes()] for k in range(14)] for c in range(2000)])
    for slices, strings in ((10**9, 10**9), (3000, 10**9), (3000, 900)):
        monkeypatch.setattr(S, "SLICE_BYTES", slices)
        monkeypatch.setattr(S, "HOT_STRINGS", strings)
        got = np.zeros_like(want)
        for part, hit in S.covered_by_slices(text.ravel(), rows):
            got[part] |= hit.reshape(-1, 14)
        assert (got == want).all() and want.any() and not want.all()


def test_memory_of_one_hot_anchor_is_bounded(monkeypatch):
    monkeypatch.setattr(H.PrefixHashes, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(H.PrefixHashes, "_inverses", np.ones(1, np.uint64))
    text, rows = hot_contexts(100_000)  # 6 MB
    tracemalloc.start()
    n = sum(int(hit.sum()) for _, hit in S.covered_by_slices(text.ravel(), rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 150 << 20  # 211 MB before, 99 MB by slices


def test_suffix_sort_compares_little_in_large_groups(monkeypatch):
    """Finding F2: in a group of many suffixes each was compared by its extensions with log(n) ^ 2 / 2 others."""
    asked = []
    before = S.Suffixes.before
    monkeypatch.setattr(S.Suffixes, "before", lambda self, a, b, length: asked.append(len(a)) or before(self, a, b, length))
    rng = np.random.default_rng(5)
    text = S.Suffixes(rng.integers(97, 123, 60_000).astype(np.uint8))
    starts = rng.permutation(59_900)[:20_000]
    order = S.suffix_sort(text, starts, np.zeros(20_000, np.int64))
    got = [text.data[s : s + 50].tobytes() for s in starts[order]]
    assert got == sorted(got) and sum(asked) < 20_000  # four million before
