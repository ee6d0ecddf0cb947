import random

import corpus_pipeline as P
import pytest
from fixtures import collect, tables, words
from test_bpe import PATH
from test_decontaminate import brute as leaks
from test_language_id import VOCAB
from test_ngram_join import brute as groups
from test_substring_dedup import brute as repeats
from tokenizers import Tokenizer

from tallyforge.llm.common import written


@pytest.fixture(scope="module")
def folder():
    rng = random.Random(31)
    rows, bench = [], [(k, " ".join(words(rng, 25, 10**5))) for k in range(3)]
    for i in range(150):
        w = [rng.choice(VOCAB["aa"]) + str(rng.randrange(9)) * 2 for _ in range(rng.randrange(8, 60))]
        rows.append([i, " ".join(w), "aa", "s"])
    for k in range(0, 30, 3):
        rows[k + 100][1] = rows[k][1] + " ka"  # near copies
    for k in range(1, 30, 6):
        rows[k + 60][1] += " " + bench[k % 3][1]  # passages of the benchmark
    for k in range(2, 40, 5):
        rows[k + 100][1] = "ka lo mi nu ta " + rows[k][1][:70] + " ro si ka lo"  # repeated passages
    rows += [[900, None, "aa", "s"], [901, "1234 5678", "aa", "s"], [902, rows[4][1], "aa", "s"], [3, rows[3][1], "aa", "s"]]
    return tables(documents=[(*r, len(r[1] or "")) for r in rows], benchmark=bench)


def test_each_stage_equals_brute_force_and_run_applies_them(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").select(*P.COLUMNS)
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "test-" + name)
        assert docs.columns == P.COLUMNS and dict(docs.dtypes) == dict(seen[0].dtypes)
        seen.append(docs)
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in seen]
    by_id = [dict(r) for r in rows]

    assert set(by_id[0]) - set(by_id[1]) == {900, 901} and len(rows[1]) == len(rows[0]) - 2
    least = {int(i): int(c) for i, _, c in groups(rows[1])}
    assert sorted(i for i, _ in rows[2]) == sorted({i for i in least if least[i] == i})
    cut = {int(i): (n, gone) for i, n, gone, *_ in repeats(rows[2])}
    assert sum(gone > 0 for _, gone in cut.values()) > 3
    assert {i: len(t.encode()) for i, t in rows[3]} == {i: n - gone for i, (n, gone) in cut.items() if n - gone or not n}
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(folder + "/benchmark.parquet").collect()]
    dirty = {int(i) for i, *_, bad in leaks(rows[3], items) if bad}
    assert dirty and rows[4] and sorted(i for i, _ in rows[4]) == sorted(set(by_id[3]) - dirty)

    out = collect(P.run(spark, folder)).set_index("doc_id")
    library = Tokenizer.from_file(PATH)
    assert {i: int(n) for i, n in out.n_tokens.items()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows[4]}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rng = random.Random(9)
    w = words(rng, 80, 10**6)
    other = " ".join(words(rng, 40, 10**6))
    near = " ".join([*w[:-1], "end"])
    rows = [(5, " ".join(w)), (7, near), (7, other), (7, other), (None, near + " x"), (None, "no one else holds these words"), (9, None)]
    docs = spark.read.parquet(tables(documents=rows) + "/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)


def test_empty_tables(spark):
    path = tables(documents=[], benchmark=[])
    assert collect(P.run(spark, path)).empty
