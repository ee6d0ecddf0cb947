r"""Quality rules: counts per text, two base rules, and robust multivariate outliers.

Documents that pass the base rules become points of five transformed statistics (``STATISTICS``).  Per language and
source, location and scatter of the points are estimated by the minimum covariance determinant: of all subsets with
three quarters of a group's points, that whose covariance has the least determinant.  As in the fast algorithms,
it is approached by concentration steps, from two starts (medians with median deviations, and the group's
mean and covariance): keep the points nearest to the estimate, estimate again, until the subsets stay; the start
that ends with the smaller determinant counts.  One reweighting step follows, and points beyond the
``CUTOFF`` of the squared Mahalanobis distance are rejected.

Distribution.  A point is five integers (statistics in steps of 1/256).  A concentration step is one join of the points
with the estimates (a row per group and start) and one aggregation per (group, start, distance bin): count, sums and
products, all exact integers, so results do not depend on how rows are partitioned.  Bins are narrow and bounded in
number; the subset is the nearest bins that hold at least three quarters of the group.  A group may hold any share
of the rows, and there may be any number of groups: only the count of groups that still move reaches the driver.

The covariance is that of the subset times its consistency factor, averaged with ``PRIOR`` (weight
``PRIOR_ROWS`` points), plus ``FLOOR``: statistics that hardly vary in a group, and groups of a few documents, thus do
not make every other document an outlier.

Defined results: a null text has no words; null languages and sources are groups of their own; rows are judged one by
one, so repeated ids and rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import read_table, ship, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20

STATISTICS = ("words", "word_length", "symbols", "repeated_lines", "repeated_words")  # all as binary logarithms
P = len(STATISTICS)
STEP = 256                       # a statistic's integer steps
SHORT = 50                       # words added to rates, so a symbol or two in a short text weigh little
SUBSET = 0.75                    # the share of a group's points in a subset
# Fixed values of the chi-squared law with 5 degrees of freedom: its quantiles, and the consistency factors
# a / P(X7 <= q_a) of covariances of the nearest share a (X7: 7 degrees of freedom).
SUBSET_FACTOR = 1.4121
REWEIGHT_QUANTILE, REWEIGHT_FACTOR = 12.8325, 1.0555
CUTOFF = 35.8882                 # one clean point in a million lies beyond
PRIOR = (2.0, 0.3, 1.0, 1.0, 1.0)      # standard deviations assumed before a group's points are seen
PRIOR_ROWS = 20
FLOOR = (0.5, 0.15, 0.5, 0.75, 0.75)   # spread that every group has
MOST_STEPS = 25
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, repeated lines, words in repeated windows) of a whole text."""
    import re

    if not text:
        return 0, 0, 0, 0, 0
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(m[0], len(ids)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)), np.int64)
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    covered = 0
    if n > WINDOW:
        # windows by exact codes: pairs, pairs of pairs, and the fifth word
        def coded(a, b):
            return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

        two = coded(words[:-1], words[1:])
        four = coded(two[:-2], two[2:])
        code = coded(four[:-1], words[4:])
        hits = np.flatnonzero(np.bincount(code)[code] > 1)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + WINDOW, -1)
        covered = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return n, chars, symbols, again, covered


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts and ``base_failed`` of every document."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    groups = ("doc_id", "lang", "source")

    def run(batches):
        for b in batches:
            found = [text_counts(t.as_py()) for t in b.column("text")]
            cols = list(zip(*found)) if found else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*[b.column(g) for g in groups], *[pa.array(c, pa.int64()) for c in cols]], [*groups, *COUNTS])

    out = rows.mapInArrow(run, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


X = [f"x{i}" for i in range(P)]
GROUP = ["lang", "source"]


def points(counts: DataFrame) -> DataFrame:
    """The counts with the transformed statistics ``x0..x4`` in integer steps (null where the base rules fail)."""
    n = F.col("n_words")

    def per_hundred(c):
        return F.log2(1 + 100 * F.col(c) / (n + SHORT))

    stats = [F.log2(1 + n), F.log2(F.col("word_chars") / n), per_hundred("n_symbols"), per_hundred("n_dup_lines"), per_hundred("n_repeat_words")]
    return counts.select("*", *[F.when(~F.col("base_failed"), F.floor(s * STEP + 0.5).cast("long")).alias(x) for s, x in zip(stats, X)])


SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]


def _moments():
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]]


def _same_group(a: str, b: str):
    return F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


ESTIMATE = ", ".join(["lang string", "source string", "start int", "rows long", "n long", *[f"m{i} double" for i in range(P)],
                      *[f"p{i}{j} double" for i, j in PAIRS], "logdet double"])


def estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Centre ``m``, inverse covariance ``p`` and log determinant of every (group, start) from its moments."""
    ship(moments.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            n = col("n")
            mean = np.stack([col(f"s{i}") for i in range(P)], 1) / n[:, None]
            cov = np.empty((len(n), P, P))
            for i, j in PAIRS:
                # exact integers: n * q - s_i * s_j, formed as Python integers
                top = [int(k) * int(q) - int(a) * int(c) for k, q, a, c in
                       zip(b.column("n").to_pylist(), b.column(f"q{i}{j}").to_pylist(), b.column(f"s{i}").to_pylist(), b.column(f"s{j}").to_pylist())]
                cov[:, i, j] = cov[:, j, i] = np.array([float(t) for t in top]) / n**2
            yield estimate_batch(b, mean / STEP, cov / STEP**2, n, factor)

    return moments.select(*GROUP, "start", "rows", *SUMS).mapInArrow(run, ESTIMATE)


def regularised(cov: np.ndarray, n: np.ndarray, factor: float) -> np.ndarray:
    """The covariance used: the subset's and the prior's, weighted, plus the floor."""
    prior, floor = np.diag(np.square(PRIOR)), np.diag(np.square(FLOOR))
    w = n[:, None, None]
    return (w * factor * cov + PRIOR_ROWS * prior) / (w + PRIOR_ROWS) + floor


def estimate_batch(b, mean, cov, n, factor) -> pa.RecordBatch:
    used = regularised(cov, n, factor)
    inverse = np.linalg.inv(used)
    cols = [b.column("lang"), b.column("source"), b.column("start"), b.column("rows"), b.column("n"),
            *[pa.array(mean[:, i]) for i in range(P)], *[pa.array(inverse[:, i, j]) for i, j in PAIRS],
            pa.array(np.linalg.slogdet(used)[1])]
    names = [part.split()[0] for part in ESTIMATE.split(", ")]
    return pa.RecordBatch.from_arrays(cols, names)


def _squared_distance(est: str):
    diff = [F.col(x) / F.lit(float(STEP)) - F.col(f"{est}.m{i}") for i, x in enumerate(X)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"{est}.p{i}{j}") * diff[i] * diff[j]
    return F.greatest(total, F.lit(0.0))


BINS = 8192


def _bin(d2):
    """Narrow bins of the squared distance, the last one open."""
    return F.least(F.floor(F.log2(1 + d2) * 256), F.lit(BINS - 1)).cast("int")


def concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Moments of each (group, start)'s nearest bins that hold at least the subset's share of its points."""
    r, e = rows.alias("r"), est.alias("e")
    near = r.join(e, _same_group("r", "e")).select("r.lang", "r.source", "e.start", "e.rows", *X, _bin(_squared_distance("e")).alias("bin"))
    bins = near.groupBy(*GROUP, "start", "bin").agg(F.first("rows").alias("rows"), *_moments())
    before = Window.partitionBy(*GROUP, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    nearest = bins.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < F.ceil(F.col("rows") * SUBSET))
    return nearest.groupBy(*GROUP, "start").agg(F.first("rows").alias("rows"), *[F.sum(c).alias(c) for c in SUMS])


def _median_start(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Moments of a pretended sample: at each group's medians, spread by its median absolute deviations (to the
    normal law's scale).  Histograms of the integer statistics are bounded, so medians are exact."""
    flat = rows.select(*GROUP, F.posexplode(F.array(*X)).alias("k", "v")).groupBy(*GROUP, "k", "v").agg(F.count(F.lit(1)).alias("c"))

    def medians(hist, value, name):
        w = Window.partitionBy(*GROUP, "k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*GROUP, "k")
        at = hist.withColumn("_upto", F.sum("c").over(w)).withColumn("_all", F.sum("c").over(every)).where(2 * F.col("_upto") >= F.col("_all"))
        return at.groupBy(*GROUP, "k").agg(F.min(value).alias(name))

    flat = written(flat, "histograms")
    mid = medians(flat, "v", "mid")
    h, m = flat.alias("h"), mid.alias("m")
    off = h.join(m, _same_group("h", "m") & (F.col("h.k") == F.col("m.k"))).select("h.lang", "h.source", "h.k", "h.c", "m.mid", F.abs(F.col("h.v") - F.col("m.mid")).alias("d"))
    dev = medians(off, "d", "mad")
    d = dev.alias("d")
    both = m.join(d, _same_group("m", "d") & (F.col("m.k") == F.col("d.k"))).select("m.lang", "m.source", "m.k", "m.mid", "d.mad")
    wide = both.groupBy(*GROUP).agg(*[F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"mid{i}") for i in range(P)],
                                    *[F.max(F.when(F.col("k") == i, F.col("mad"))).alias(f"mad{i}") for i in range(P)])
    a, w = wide.alias("a"), whole.alias("w")
    n = F.col("w.n")
    sums = [(n * F.col(f"mid{i}")).alias(f"s{i}") for i in range(P)]
    squares = [(n * (F.col(f"mid{i}") * F.col(f"mid{j}") + (F.floor(F.pow(F.col(f"mad{i}") * 1.4826, 2)).cast("long") if i == j else F.lit(0)))).alias(f"q{i}{j}")
               for i, j in PAIRS]
    return a.join(w, _same_group("a", "w")).select("a.lang", "a.source", F.lit(1).alias("start"), n.alias("rows"), n.alias("n"), *sums, *squares)


def scatter(rows: DataFrame) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of every group of points."""
    whole = written(rows.groupBy(*GROUP).agg(*_moments()), "moments")
    first = whole.select(*GROUP, F.lit(0).alias("start"), F.col("n").alias("rows"), *SUMS)
    moments = first.unionByName(_median_start(rows, whole))
    est = written(estimates(moments, 1.0), "estimates")
    for step in range(MOST_STEPS):
        new = written(estimates(concentrate(rows, est), SUBSET_FACTOR), "estimates")
        if step:
            old, now = est.alias("o"), new.alias("w")
            same = _same_group("o", "w") & (F.col("o.start") == F.col("w.start"))
            moving = old.join(now, same).where((F.col("o.n") != F.col("w.n")) | (F.abs(F.col("o.logdet") - F.col("w.logdet")) > 1e-9))
            if moving.isEmpty():
                est = new
                break
        est = new
    best = est.groupBy(*GROUP).agg(F.min(F.struct("logdet", "start")).alias("b")).select("lang", "source", F.col("b.start").alias("start"))
    e, b, r = est.alias("e"), best.alias("b"), rows.alias("r")
    e = e.join(b, _same_group("e", "b") & (F.col("e.start") == F.col("b.start"))).select("e.*").alias("e")
    inside = r.join(e, _same_group("r", "e")).where(_squared_distance("e") <= REWEIGHT_QUANTILE)
    kept = inside.select("r.*", "e.rows").groupBy(*GROUP).agg(F.first("rows").alias("rows"), *_moments()).withColumn("start", F.lit(0))
    return written(estimates(kept, REWEIGHT_FACTOR), "scatter")


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, counts, ``base_failed``, ``distance`` (squared, null where the base rules fail) and ``kept``."""
    rows = written(points(counted(docs)), "points")
    est = scatter(rows.where("not base_failed"))
    r, e = rows.alias("r"), est.alias("e")
    met = r.join(e, _same_group("r", "e"), "left").select("r.*", F.when(~F.col("base_failed"), _squared_distance("e")).alias("distance"))
    return met.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).drop(*X)


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(read_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
