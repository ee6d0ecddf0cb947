r"""Benchmark decontamination by winnowing.

Fingerprints: of every ``GUARANTEE - K + 1`` consecutive k-grams of words the one of least hash (all
of equals) is kept, so any shared run of ``GUARANTEE`` words shares a kept k-gram at the same place.
The documents' fingerprints are joined with the benchmark's, and every hit is extended word by word to
both sides; runs of ``GUARANTEE`` words or more are contamination.  An item of fewer words is a window of
its own: its whole-item gram is its fingerprint, looked up among all grams of that length.

The benchmark's fingerprints reach the tasks as broadcast arrays of at most ``SLICE_WORDS`` words a
slice; a larger benchmark takes several slices, one pass over the documents each, whose hits are united.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case.  Defined results: null
and empty texts have no words, no hits and the digest of the empty string; items without words have no
window; repeated items count once; items with a null id mark words but are not listed; repeated
documents give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import blocks
from tallyforge.llm.common import read_table, ship
from tallyforge.llm.hashing import gram_hashes, word_hashes

GUARANTEE, K = 10, 5
SLICE_WORDS = 2_000_000

_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def cleaned(text: str | None) -> bytes:
    """The words of a text between blanks."""
    return (text or "").encode().lower().translate(_WORD_BYTES)  # bytes.lower() changes A-Z only


def words_of(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return word_hashes([b" ".join(words)])[0]


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every ``window`` consecutive hashes (all of equals)."""
    n = len(grams)
    if n <= window:
        return np.flatnonzero(grams == grams.min()) if n else np.zeros(0, np.int64)
    least = grams[: n - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : n - window + 1 + j], out=least)
    # a hash is kept if it is the least of some window: the largest of its windows' least ones
    most = np.zeros(n, np.uint64)
    for j in range(window):
        np.maximum(most[j : n - window + 1 + j], least, out=most[j : n - window + 1 + j])
    return np.flatnonzero(most == grams)


class Benchmark:
    """Items of one slice, their fingerprints and their short windows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.names = [n for n, _ in items]
        self.words = [w for _, w in items]
        prints: list[tuple[int, int, int]] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            h = hashes_of(w)
            if len(w) >= GUARANTEE:
                g = gram_hashes(h, K)
                prints += [(int(g[p]), i, p) for p in winnow(g, GUARANTEE - K + 1).tolist()]
            elif w:
                self.short.setdefault(len(w), {}).setdefault(int(gram_hashes(h, len(w))[0]), []).append(i)
        self.at: dict[int, list[tuple[int, int]]] = {}
        for p, i, j in prints:
            self.at.setdefault(p, []).append((i, j))
        self.prints = np.array(sorted(self.at), np.uint64)
        self.short_prints = {n: np.array(sorted(d), np.uint64) for n, d in self.short.items()}

    def spans(self, text: str | None, h: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans [a, b) of a document, whose words have the hashes h, and the items in it."""
        spans, found, grams, words = [], set(), gram_hashes(h, K), None
        if len(self.prints) and len(grams):
            kept = winnow(grams, GUARANTEE - K + 1)
            hits = kept[_member(grams[kept], self.prints)]
            # a run is followed from its first hit only: (item, offset between document and item) -> end
            followed: dict[tuple[int, int], int] = {}
            words = words_of(text) if len(hits) else None
            for p in hits.tolist():
                for i, j in self.at[int(grams[p])]:
                    if followed.get((i, p - j), -1) > p:
                        continue
                    item = self.words[i]
                    a, b = p, p
                    while b < len(words) and j + b - p < len(item) and words[b] == item[j + b - p]:
                        b += 1
                    while a > 0 and j - (p - a) > 0 and words[a - 1] == item[j - (p - a) - 1]:
                        a -= 1
                    followed[i, p - j] = max(b, p + 1)
                    if b - a >= GUARANTEE:
                        spans.append((a, b))
                        found.add(i)
        for n, prints in self.short_prints.items():
            grams = gram_hashes(h, n)
            at = np.flatnonzero(_member(grams, prints)) if len(grams) else []
            words = words_of(text) if words is None and len(at) else words
            for p in at.tolist() if len(at) else []:
                for i in self.short[n][int(grams[p])]:
                    if words[p : p + n] == self.words[i]:
                        spans.append((p, p + n))
                        found.add(i)
        return spans, found


def text_hashes(texts: list[str]) -> list[np.ndarray]:
    h, counts = word_hashes([cleaned(t) for t in texts])
    return np.split(h, np.cumsum(counts)[:-1])


def _member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _slices(items: DataFrame) -> list[DataFrame]:
    """The benchmark in parts whose words have a bounded number."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / SLICE_WORDS))  # a word and its blank are two bytes at least
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def hit_spans(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``n_words, spans, items``: the merged hit spans and the items that occur.
    The rows stream through one step per benchmark slice; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    held = [*keep, *[c for c in ("text",) if c not in keep]]
    out = docs.select(*held).select(
        *[F.col(c) for c in held], F.lit(0).cast("long").alias("_words"),
        F.array().cast("array<struct<a:bigint,b:bigint>>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema = out.schema
    for part in _slices(items):
        rows = [tuple(r) for r in part.collect()]  # at most SLICE_WORDS words
        shared = spark.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] or "", r[1])))

        def run(batches, shared=shared):
            bench = Benchmark([(n, words_of(t)) for n, t in shared.value])
            for b in batches:
                n_words, spans, found = [], [], []
                texts, before, listed = (b.column(c).to_pylist() for c in ("text", "_spans", "_items"))
                hashes = (h for _, part in blocks([t or "" for t in texts]) for h in text_hashes(part))
                for text, s, i, h in zip(texts, before, listed, hashes):
                    more, names = bench.spans(text, h)
                    n_words.append(len(h))
                    merged = merge_spans(more + [(x["a"], x["b"]) for x in s])
                    spans.append([{"a": x, "b": y} for x, y in merged])
                    found.append(sorted({bench.names[k] for k in names if bench.names[k] is not None} | set(i)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in held), pa.array(n_words, pa.int64()), pa.array(spans, b.column("_spans").type),
                     pa.array(found, b.column("_items").type)], [*held, "_words", "_spans", "_items"])

        out = out.mapInArrow(run, schema)
    return out.select(*keep, F.col("_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def n_hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    out = hit_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", n_hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit_words() > 0).alias("contaminated"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) x WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i) x),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT d.*, ns.n, unnest(range(1, len(w) - ns.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) ns WHERE len(w) >= ns.n) x),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (n, s)),
marked AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) x GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
