import random
import zlib

import numpy as np
from fixtures import collect, tables

from tallyforge.llm import language_id as L

VOCAB = {"aa": "ka lo mi nu ta ro si".split(), "bb": "eth ung sch wer ich ein".split(), "cc": "ción ñar que los por".split()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCAB[lang]) for _ in range(rng.randrange(3, 60))), lang, "s", 0)
            for i in range(n) for lang in [rng.choice(sorted(VOCAB))]]


def test_held_out_accuracy_and_contract(spark):
    docs = corpus()
    docs += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 ½ _ !!", "bb"), (903, "KA LO MI NU " * 9000, None), (904, "ka lo ta ro", None)]
    got = collect(L.op2_language_id(spark, tables(documents=docs))).set_index("doc_id")
    lang = {d[0]: d[2] for d in docs}
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    held = got[got.held_out & (got.index < 900)]
    assert len(held) > 50 and np.mean([lang[i] == p for i, p in held.lang_pred.items()]) > 0.97
    assert got.loc[[900, 901, 902]].lang_pred.tolist() == ["und"] * 3
    assert got.loc[[900, 901, 902]].score.tolist() == [0.0] * 3 and got.loc[[900, 901, 902]].rejected.all()
    assert got.loc[903].lang_pred == "aa" and not got[got.index < 900].rejected.any()
    assert got.score.between(0, 1).all()


def test_prediction_is_nearest_centroid_by_brute_force(spark):
    path = tables(documents=corpus(120, 3))
    docs = spark.read.parquet(path + "/documents.parquet")
    model = L.learn_from(docs)
    got = collect(L.predict(docs, model, keep=("doc_id", "text"))).set_index("doc_id")
    assert len(model.languages) > 3  # several centroids a language
    for r in got.itertuples():
        v = np.zeros(L.DIMS)
        for k, n in enumerate(L.gram_counts(r.text)):
            v[k] = (1 + np.log(n)) * model.idf[k] if n else 0
        cos = [float(v @ c) / np.linalg.norm(v) for c in model.centroids]
        assert r.lang_pred == model.languages[int(np.argmax(cos))] and abs(r.score - max(cos)) < 1e-9


def test_far_texts_are_rejected_and_prediction_ignores_labels(spark):
    docs = corpus(200, 4)
    path = tables(documents=docs + [(999, "漢字仮名交じり文" * 30, None)])
    got = collect(L.op2_language_id(spark, path)).set_index("doc_id")
    assert got.loc[999].rejected and got.loc[999].lang_pred in VOCAB
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else l) for i, t, l, *_ in docs]
    other = collect(L.op2_language_id(spark, tables(documents=swapped))).set_index("doc_id")
    assert "zz" not in set(other.lang_pred) and (other.lang_pred == got.lang_pred.drop(999)).all()


def test_nothing_to_learn(spark):
    got = collect(L.op2_language_id(spark, tables(documents=[(1, "abc", None), (1, "abc", None)])))
    assert got.lang_pred.tolist() == ["und", "und"]
    assert len(collect(L.op2_language_id(spark, tables(documents=[])))) == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"ka lo {i}", "aa") for i in range(3000)], "doc_id long, text string, lang string")
    model = L.fit(docs, fit_rows=50)
    assert len(model.languages) <= L.CENTROIDS and np.exp(model.idf.max() - 1) <= 51.01


def test_more_than_a_thousand_languages(spark):
    docs = [(i, f"word{i} text of label", f"l{i % 1100}") for i in range(2200)]
    got = collect(L.op2_language_id(spark, tables(documents=docs)))
    assert len(got) == 2200 and set(got.lang_pred) <= {f"l{k}" for k in range(1100)} | {"und"}
