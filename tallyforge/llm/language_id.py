"""Language identification by nearest centroids.

A text is the L2-normalised TF-IDF vector of its byte n-grams (1 to 3 bytes of the lower-cased text,
everything that is no letter being a blank), hashed to ``DIMS`` dimensions.  Each language has several
centroids, found by spherical k-means over its labelled texts; a text gets the language of the centroid
of largest cosine.  Distance-based rejection: a text is rejected when that cosine lies under the
centroid's floor (``REJECT_SHARE`` of the smallest cosine among the texts it was made of), or when it
has no letter.

The model is fitted on a bounded sample: at most ``FIT_ROWS`` labelled texts, spread evenly over the
languages and chosen by a hash of their text and id; prediction reads every text whole.

Defined results: ``lang_pred`` is ``und``, score 0 and rejected when the text is null, empty or without
a letter; ties go to the language that sorts first; with no labelled text every text is ``und``;
repeated rows give repeated results; null languages are not learned; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.bpe import blocks
from tallyforge.llm.common import read_table, ship

DIMS = 4096
FIT_ROWS = 4000
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.25
UNKNOWN = "und"

# ASCII bytes that are no letters become blanks; bytes from 128 on belong to letters or stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    a = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] | a[1:] << np.uint32(8)
    three = two[:-1] | a[2:] << np.uint32(16)
    grams = np.concatenate([a[1:-1] | np.uint32(1 << 24), two | np.uint32(2 << 24), three | np.uint32(3 << 24)])
    return np.bincount((grams * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(dims), minlength=dims)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors (zero rows stay zero)."""
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        ks = [k for k, t in enumerate(texts) if has_letter(t)]
        if not ks or not self.languages:
            return out
        v = tfidf(np.stack([gram_counts(texts[k], len(self.idf)) for k in ks]), self.idf)
        cos = v @ self.centroids.T
        best = cos.argmax(axis=1)
        for k, c, s in zip(ks, best.tolist(), cos[np.arange(len(ks)), best].tolist()):
            out[k] = (self.languages[c], min(1.0, max(0.0, s)), bool(s < self.floors[c]))
        return out


def _cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids and each row's centroid."""
    mean = v.mean(axis=0)
    seeds = [int((v @ mean).argmax())]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).argmax(axis=1)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, dims: int = DIMS, k: int = CENTROIDS) -> Model:
    """Learn from ``doc_id, text, lang`` rows; only ``text`` and ``lang`` enter the model."""
    spark = labelled.sparkSession
    ship(spark)
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row per label
    if not sizes:
        return Model([], np.zeros((0, dims)), np.zeros(0), np.ones(dims))
    each = max(1, fit_rows // len(sizes))
    # about twice the wanted rows pass by their hash, so the window below sees a bounded group
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 2 * each / n) * 2**31))])
    sample = known.where(F.pmod("h", F.lit(2**31)) <= share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h")
    sample = sample.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("lang", "text")

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if has_letter(text):
                    n = gram_counts(text, dims)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([n[at].astype(np.int32).tobytes()], pa.binary())],
                        ["lang", "at", "n"])

    rows = sorted(sample.mapInArrow(run, "lang string, at binary, n binary").collect())  # at most fit_rows
    if not rows:
        return Model([], np.zeros((0, dims)), np.zeros(0), np.ones(dims))
    counts = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    languages, centroids, floors = [], [], []
    for lang in sorted({r["lang"] for r in rows}):
        v = tfidf(counts[[i for i, r in enumerate(rows) if r["lang"] == lang]], idf)
        c, own = _cluster(v, k)
        cos = (v * c[own]).sum(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                languages.append(lang)
                centroids.append(c[j])
                floors.append(REJECT_SHARE * cos[own == j].min())
    return Model(languages, np.stack(centroids), np.array(floors), idf)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred, score, rejected``; only ``text`` enters the prediction."""
    spark = docs.sparkSession
    ship(spark)
    cols = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS vectors a label
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name in keep)

    def run(batches):
        for b in batches:
            got = [r for _, texts in blocks([t or "" for t in b.column("text").to_pylist()]) for r in shared.value.predict(texts)]
            langs, scores, rejected = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"])

    return cols.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """The documents nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def learn_from(docs: DataFrame) -> Model:
    return fit(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the ids."""
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, learn_from(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
