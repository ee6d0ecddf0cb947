import math

import numpy as np
from fixtures import collect, tables
from pyspark.sql import functions as F

from tallyforge.llm import ann_forest as A


def brute(rows, k=5, every=50):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dims = max({len(v) for _, v in ok}, key=[len(v) for _, v in ok].count, default=0)
    ok = sorted(x for x in ok if len(x[1]) == dims)
    out = {}
    for q, v in ok:
        if q % every == 0:
            v = np.array(v, np.float32).astype(float)
            near = [(-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in ((i, np.array(w, np.float32).astype(float)) for i, w in ok) if i != q]
            out[q] = sorted(near)[:k]
    return out


def vectors(n, d=8, seed=1):
    return [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32))]


def test_small_tables_are_exact_with_bad_vectors_and_ties(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(50, rows[50][1])]  # one vector that many rows share
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] + [1.0] * 7), (2200, [float("inf")] + [1.0] * 7),
             (2250, [None] + [1.0] * 7), (2300, [1.0] * 3), (None, [1.0] * 8)]
    got = collect(A.op5_ann_forest(spark, tables(embeddings=rows)))
    want = brute(rows)
    assert set(got.query_id) == set(want)
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert part.vec_id.tolist() == [i for _, i in want[q]]
        assert np.allclose(part.score, [-s for s, _ in want[q]], atol=1e-12)


def test_fewer_candidates_than_asked_for(spark):
    got = collect(A.op5_ann_forest(spark, tables(embeddings=vectors(3))))
    assert len(got) == 2 and set(got.query_id) == {0}
    assert len(collect(A.op5_ann_forest(spark, tables(embeddings=[])))) == 0
    assert len(collect(A.op5_ann_forest(spark, tables(embeddings=[(0, [1.0, 2.0])])))) == 0


def test_recall_over_several_blocks(spark):
    """Vectors without near neighbours, the hard case, in several blocks."""
    rows = vectors(6000, 64, 3)
    path = tables(embeddings=rows)
    df = spark.read.parquet(path + "/embeddings.parquet")
    got = collect(A.nearest(df, "vec_id", "embedding", lambda c: F.pmod(F.col(c), F.lit(50)) == 0, least=200, block_rows=2000))
    want = brute(rows)
    hits = sum(len({i for _, i in want[q]} & set(part.vec_id)) for q, part in got.groupby("query_id"))
    assert hits / (5 * len(want)) >= 0.9
    for q, part in got.groupby("query_id"):
        v = {i: np.array(x) for i, x in rows}
        for r in part.itertuples():
            assert abs(r.score - v[q] @ v[r.vec_id] / np.linalg.norm(v[q]) / np.linalg.norm(v[r.vec_id])) < 1e-6


def test_the_forest_ascends_only_as_far_as_needed():
    x = np.random.default_rng(5).standard_normal((3000, 16))
    forest = A.Forest(x, trees=8, bits=16)
    for _, found in forest.candidates(x[:20], 100):
        assert 100 <= len(found) < 2500


def test_recall_on_the_given_table(spark):
    from conftest import SF

    folder = SF.replace("0.001", "0.1")
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(folder + "/embeddings.parquet").collect()]
    got = collect(A.op5_ann_forest(spark, folder))
    want = brute(rows)
    hits = sum(len({i for _, i in want[q]} & set(part.vec_id)) for q, part in got.groupby("query_id"))
    assert len(got) == 5 * len(want) and hits / (5 * len(want)) >= 0.9
