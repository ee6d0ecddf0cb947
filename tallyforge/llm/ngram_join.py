"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

Documents are sets of 64-bit hashes of word 5-grams.  Two link when ``100 * |A & B| >= 75 * |A | B|``.
Equal sets are one class from the start (64-bit signature of the sorted hashes), so copies cost one
narrow row each.  For the others:

1. Prefixes.  In any order of all shingles, linked sets share one within their first
   ``n - ceil(3n/4) + 1``.  The order puts common shingles (in more than ``1 / COMMON`` of the documents)
   last and is by hash otherwise, so passages that many documents share stay out of most prefixes.
2. Prefix shingles that two classes hold are found by one shuffle of (shingle, class).
3. Stars: each class meets the smaller class it shares most prefix shingles with; verified links make
   the first components.
4. Tiles: the classes that meet the same smallest class in their shared shingles, each once, and of one
   size band (sizes of linked sets differ by 4/3 at most, so a band meets itself and the next), in cells
   of bounded size, are compared by parity bitmaps,
   two bits a shingle: the number of differing bits is at most the size of the symmetric difference and
   so bounds the overlap from above.  Cells whose members are all one component already need no pair.
   A pair that several tiles hold is met in the first of them, told by the first tiles of each class.
   A cell proposes a forest over its components (so many pairs as they are, less one) and lists all its
   other pairs beside it, which are checked where the forest has left them in different components: most
   tiles are done after one round.  Tiles with a cell of more than ``REST`` such pairs a member come
   again: with forests while many of their pairs link, then with all remaining pairs, so that no link
   between components is missed.
5. Pairs that pass are verified by intersecting the sorted hash arrays.

Only connectivity is asked for, so pairs inside a component are not expanded.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.  Defined results: null and empty
texts, and texts of blanks, have empty sets and are linked with nothing; fewer than five words are one
shingle; repeated rows are linked, and rows of one ``doc_id`` with different texts are documents of their
own; a document whose ``doc_id`` is null links like any other, but never names a component that has
another id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.bpe import blocks
from tallyforge.llm.common import likely, read_table, ship, written
from tallyforge.llm.components import components
from tallyforge.llm.hashing import gram_hashes, word_hashes

WORDS = 5
COMMON = 2000  # a shingle in more than one of so many documents comes last in the order
LOCAL = 1_000_000  # shingles counted at a time in a task
PAIR, OTHER, AGAIN = 0, 1, 2  # kinds of the rows that cells make
ANY = -(1 << 30)  # the band of a cell that holds a whole tile
BLOCK_CHARS = 500_000  # text hashed at a time
SEND_BYTES = 4 << 20  # hash arrays sent on at a time
PART = 500  # classes compared with a hub in one place, about
CELL = 1024  # members of a tile that meet in one cell, about
FIRSTS = 8  # tiles that a class names, so that its pairs are met in the first one that they share
REST = 64  # pairs a member that a cell lists beside its forest
FOREST = 8  # rounds of forests go on while one in so many pairs links


# bytes.lower() changes A-Z only; \x09 to \x0D become blanks
_BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def shingle_sets(texts: list[str | None]):
    """Sorted distinct 64-bit shingle hashes of each whole text."""
    for _, part in blocks([t or "" for t in texts], BLOCK_CHARS):
        h, counts = word_hashes([t.encode().lower().translate(_BLANKS) for t in part])
        for words in np.split(h, np.cumsum(counts)[:-1]):
            s = gram_hashes(words, min(WORDS, len(words))) if len(words) else words
            s.sort()
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles whose hash falls on i; the width follows the size (two to four
    bits a shingle), and halves of a bitmap XORed give the bitmap of half the width."""
    width = max(64, 2 << int(len(s) - 1).bit_length()) if len(s) else 64
    at = (s >> np.uint64(7)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test by intersecting two sorted arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 75 * (len(a) + len(b) - same)


# ---------------------------------------------------------------- one pass: classes and common shingles


def _survey(docs: DataFrame) -> DataFrame:
    """A row per document (``doc_id, text_hash, n, sid, bitmap``) and, marked by ``times``, counts of
    shingles that are frequent among the documents of a task."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    names = ["doc_id", "text_hash", "n", "sid", "bitmap", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches):
        held, size, docs_held = [], 0, 0

        def frequent():
            s = np.concatenate(held)
            s.sort()
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            times = np.diff(np.append(starts, len(s)))
            often = np.flatnonzero(times >= max(2, docs_held // COMMON))
            k = len(often)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(s[starts[often]].view(np.int64)), pa.nulls(k, pa.binary()),
                 pa.array(times[often])], names)

        for b in batches:
            rows = []
            for doc, text, s in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), shingle_sets(b.column("text").to_pylist())):
                rows.append((doc, text, len(s), signature(s), parity_bitmap(s), None))
                held.append(s)
                size += len(s)
                docs_held += 1
                if size >= LOCAL:
                    yield frequent()
                    held, size, docs_held = [], 0, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if size:
            yield frequent()

    return cols.mapInArrow(run, "doc_id long, text_hash long, n long, sid long, bitmap binary, times long")


def _postings(docs: DataFrame, common) -> DataFrame:
    """``h, sid``: the prefix shingles of every document; copies that a task meets send them once."""
    def run(batches):
        last = common.value
        seen: set[int] = set()
        for b in batches:
            if len(seen) > LOCAL:  # forgotten, so that a task's memory is bounded; repeats are dropped later
                seen.clear()
            sids, lists, sizes = [], [], []
            for s in shingle_sets(b.column("text").to_pylist()):
                if len(s) == 0:
                    continue
                k = prefix_size(len(s))
                sid = signature(s)
                if sid in seen:
                    continue
                seen.add(sid)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    is_last = last[at] == s
                    s = np.concatenate([s[~is_last], s[is_last]])
                sids.append(sid)
                lists.append(s[:k])
                sizes.append(k)
            if sids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), sizes))], ["h", "sid"])

    return docs.select("text").mapInArrow(run, "h long, sid long")


def _shared(postings: DataFrame) -> DataFrame:
    """Rows of the shingles that at least two classes hold, with ``low``, the smallest of them."""
    def run(batches):
        # sorted by (h, sid), repeated pairs included; a run may go on in the next batch
        tail = None  # (h, first sid, last sid, whether the first was emitted)
        for b in batches:
            h, s = b.column("h").to_numpy(), b.column("sid").to_numpy()
            if tail is not None:
                h, s = np.concatenate([[tail[0]], h]), np.concatenate([[tail[2]], s])
            if not len(h):
                continue
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            if tail is not None:
                fresh[0] = True
            h, s = h[fresh], s[fresh]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(starts, len(h)))
            low = np.repeat(s[starts], sizes)
            out = np.repeat(sizes > 1, sizes)
            if tail is not None:
                k = int(sizes[0])
                low[:k] = tail[1]
                if tail[3]:  # the carried row is out already, and its run has two members for certain
                    out[:k] = True
                    out[0] = False
                elif k > 1:
                    out[:k] = True
            tail = (h[-1], low[-1], s[-1], bool(out[-1]) or (tail is not None and tail[3] and len(starts) == 1))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(s[out]), pa.array(low[out])], ["h", "sid", "low"])

    return postings.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(run, "h long, sid long, low long")


# ---------------------------------------------------------------- verification


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` of all rows; those without an id, which no id tells apart, once a text
    and under the text's hash as their id."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    nameless = written(cols.where("doc_id is null and text is not null").dropDuplicates(["text_hash"]), "nameless")
    nameless = nameless.withColumn("doc_id", F.col("text_hash"))
    return cols.where("doc_id is not null").unionByName(nameless)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a, b``) that link, by exact intersection.  The sorted hashes of each class travel
    once, from its text to the hubs ``a`` it meets; a hub of many is split in parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    place = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    sends = pairs.join(parts, "a").select(F.col("b").alias("sid"), F.struct("a", place.alias("part")).alias("to"))
    hubs = parts.select(F.col("a").alias("sid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sends = sends.unionByName(hubs.select("sid", F.struct("a", "part").alias("to")))
    wanted = sends.groupBy("sid").agg(F.collect_set("to").alias("to")).join(classes.select("sid", "doc_id", "text_hash"), "sid")
    wanted = written(wanted, "wanted")
    found = likely(texts, wanted.select("doc_id")).join(wanted, ["doc_id", "text_hash"]).select("sid", "to", "text")

    def spread(batches):
        names, types = ["a", "part", "other", "sid", "s"], (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            rows, size = [], 0
            for sid, to, s in zip(b.column("sid").to_pylist(), b.column("to").to_pylist(), shingle_sets(b.column("text").to_pylist())):
                if signature(s) != sid:  # two texts of one id and one hash
                    continue
                packed = s.tobytes()
                for t in to:
                    rows.append((t["a"], t["part"], sid != t["a"], sid, packed))
                    size += len(packed)
                    if size >= SEND_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
            if rows:
                yield pack(rows)

    def compare(batches):
        hub, own, last = None, None, None
        for b in batches:
            out = []
            for a, other, sid, s in zip(b.column("a").to_pylist(), b.column("other").to_pylist(), b.column("sid").to_pylist(), b.column("s")):
                s = np.frombuffer(s.as_py(), np.uint64)
                if not other:
                    hub, own = a, s
                elif hub == a and (a, sid) != last:  # rows that come twice are neighbours
                    last = (a, sid)
                    if linked(own, s):
                        out.append(last)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = found.mapInArrow(spread, "a long, part int, other boolean, sid long, s binary")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "other", "sid")
    return written(dealt.mapInArrow(compare, "a long, b long"), "links")


def _near_bits(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    def run(batches):
        for b in batches:
            ok = []
            for na, nb, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                ok.append(4 * min(na, nb) >= 3 * max(na, nb) and 7 * int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= na + nb)
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    left = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("xa"))
    right = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("xb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- tiles


def _tiles(shared: DataFrame, classes: DataFrame, comps: DataFrame, every: bool) -> DataFrame:
    """``a, b``: pairs of different components whose bitmaps allow a link, with ``every`` all of them.  Else, with
    ``kind``: as ``PAIR`` a forest over the components of each cell, made of similar pairs, as ``OTHER`` the
    cell's others; a cell with too many of these names its shingle instead (``a``, as ``AGAIN``).  A pair comes
    twice only if the tiles that it shares are not among the first ``FIRSTS`` of its classes."""
    named = shared.select("h", "sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left").join(classes.select("sid", "n"), "sid")
    named = named.withColumn("comp", F.coalesce("comp", "sid"))
    mixed = named.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"))
    open_ = written(named.join(mixed.where("x <> y").select("h", "m"), "h"), "open-tiles")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    open_ = open_.withColumn("size", size)
    # a tile that fits one cell is dealt whole and finds its bands there
    whole = open_.where(F.col("m") <= CELL).select("h", "sid", "comp", "n", "size", *(F.lit(x).alias(c) for c, x in (("band", ANY), ("part", 0), ("i", 0), ("j", 0))))
    # a band is its own members and those of the band below it
    members = open_.where(F.col("m") > CELL).withColumn("band", F.explode(F.array("size", F.col("size") + 1)))
    sizes = members.groupBy("h", "band").agg(F.count("*").alias("k"), F.max(F.col("size") == F.col("band")).alias("any_own")).where("k > 1 and any_own")
    parts = F.ceil(F.col("k") / CELL).cast("int")
    dealt = members.join(sizes.select("h", "band", parts.alias("parts")), ["h", "band"])
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, part).alias("i"), F.greatest(j, part).alias("j")))
    dealt = dealt.withColumn("part", part).withColumn("cell", F.explode(cells)).select(*whole.columns[:-2], "cell.i", "cell.j")
    # bitmaps join when the cells are dealt, so that they travel there only; with them the first tiles of the class
    firsts = open_.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("h")), 1, FIRSTS).alias("firsts"))  # bounded by a set's prefix
    known = firsts.join(classes.select("sid", "bitmap"), "sid")
    dealt = whole.unionByName(dealt).join(known, "sid").withColumn("firsts", F.filter("firsts", lambda x: x < F.col("h")))
    cols = ["h", "band", "i", "j", "part", "size", "sid", "comp", "n", "bitmap", "firsts"]
    dealt = dealt.select(*cols).repartition("h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j", "sid")

    def bands(rows: dict, out: list) -> None:
        if rows["band"] != ANY:
            return compare(rows | {"own": [x == rows["band"] for x in rows["size"]]}, out)
        each = np.array(rows["size"])
        for band in np.unique(each):
            at = np.flatnonzero((each == band) | (each == band - 1)).tolist()
            if len(at) > 1:
                compare(rows | {c: [rows[c][k] for k in at] for c in cols[4:]} | {"own": (each[at] == band).tolist()}, out)

    def compare(rows: dict, out: list) -> None:
        rest, again = [], every
        comp, n, own, part = (np.array(rows[c]) for c in ("comp", "n", "own", "part"))
        if len(comp) < 2 or not own.any() or (comp == comp[0]).all():
            return
        words = min(len(x) for x in rows["bitmap"]) // 8
        bits = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in rows["bitmap"]])
        split = rows["i"] != rows["j"]
        firsts = np.full((len(comp), FIRSTS), np.iinfo(np.int64).max)
        for k, f in enumerate(rows["firsts"]):
            firsts[k, : len(f)] = f
        tree = comp.copy()  # components joined by the pairs proposed so far
        for k in range(len(comp) - 1):
            ok = ((tree if again else comp)[k + 1 :] != (tree if again else comp)[k]) & (own[k] | own[k + 1 :])
            if split:
                ok &= part[k + 1 :] != part[k]
            ok &= (4 * np.minimum(n[k], n[k + 1 :]) >= 3 * np.maximum(n[k], n[k + 1 :]))
            at = np.flatnonzero(ok) + k + 1
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
            near = 7 * differ <= n[at] + n[k]
            at, differ = at[near], differ[near]
            # a pair that meets in an earlier tile is left to that
            earlier = firsts[k][firsts[k] < rows["h"]]
            if len(earlier):
                fresh = ~np.isin(firsts[at], earlier).any(axis=1)
                at, differ = at[fresh], differ[fresh]
            if not len(at):
                continue
            if not every:  # the most similar class of each tree is met once, all of them join
                others, apart = at, tree[at] != tree[k]
                at, differ = at[apart], differ[apart]
                order = np.argsort(differ, kind="stable")
                _, first = np.unique(tree[at[order]], return_index=True)
                at = at[order][first]
                tree[np.isin(tree, tree[at])] = tree[k]
                if not again:
                    rest += [(k, q) for q in np.setdiff1d(others, at).tolist()]
                    if len(rest) > REST * len(comp):
                        rest, again = [], True
            out += [pair(rows["sid"][k], rows["sid"][q], PAIR) for q in at.tolist()]
        out += [pair(rows["sid"][k], rows["sid"][q], OTHER) for k, q in rest]
        if again and not every:
            out.append((rows["h"], rows["h"], AGAIN))

    def pair(x: int, y: int, kind: int) -> tuple:
        return (x, y, kind) if x < y else (y, x, kind)

    def pack(out: list):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "kind"])

    def run(batches):
        key, rows = None, None
        for b in batches:
            out: list = []
            got = {c: b.column(c).to_pylist() for c in cols}
            for k in range(b.num_rows):
                at = tuple(got[c][k] for c in cols[:4])
                if at != key:
                    if rows:
                        bands(rows, out)
                    key, rows = at, dict(zip(cols, at)) | {c: [] for c in cols[4:]}
                for c in cols[4:]:
                    rows[c].append(got[c][k])
            if out:
                yield pack(out)
        out = []
        if rows:
            bands(rows, out)
        if out:
            yield pack(out)

    out = dealt.mapInArrow(run, "a long, b long, kind int")
    return out.select("a", "b") if every else out


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("comp").alias("_" + end)), end, "left")
    return pairs.where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")


# ---------------------------------------------------------------- the join


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, leader_hash`` of every row.  The row of a component
    whose id is ``component_id`` and whose ``text_hash`` is ``leader_hash`` leads it: the smallest id, of
    its texts the one of least hash."""
    spark = docs.sparkSession
    ship(spark)
    survey = written(_survey(docs), "survey")
    people = survey.where("times is null").select("doc_id", "text_hash", "n", "sid", "bitmap")
    total = people.count()
    often = survey.where("times is not null").groupBy("sid").agg(F.sum("times").alias("t"))
    often = often.where(F.col("t") > max(2, total // COMMON)).select("sid")
    # at most COMMON times the mean set size, since each holds more than 1 / COMMON of the documents
    common = np.sort(often.toPandas()["sid"].to_numpy(np.int64).view(np.uint64))
    shared = _shared(_postings(docs, spark.sparkContext.broadcast(common)))
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = people.where("n > 0").groupBy("sid").agg(
        F.min(named).alias("leader"), F.any_value("n").alias("n"), F.any_value("bitmap").alias("bitmap"))
    classes = classes.withColumn("text_hash", F.col("leader.text_hash"))
    classes = written(classes.withColumn("doc_id", F.coalesce("leader.doc_id", "text_hash")), "classes")
    texts = _texts(docs)
    # all shingles of one smallest class make one tile, so that a class comes there once
    tiles = written(shared.groupBy(F.col("low").alias("h"), "sid").count(), "tiles")
    hubs = tiles.where("sid <> h").select(F.col("h").alias("a"), F.col("sid").alias("b"), "count")
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    stars = hubs.withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b")
    tested = written(_near_bits(stars, classes), "pairs")
    every = False
    comps = written(components(_verified(tested, classes, texts)), "components")

    def joined(more: DataFrame) -> DataFrame:
        """The components with more links: the former ones stand for their links."""
        return written(components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "components")

    while True:
        rows = written(_tiles(tiles, classes, comps, every).distinct(), "proposed")
        pairs = rows if every else rows.where(F.col("kind") == PAIR).select("a", "b")
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = _verified(pairs, classes, texts)
        tested = tested.unionByName(pairs)
        found, tried = more.count(), pairs.count()
        comps = joined(more) if found else comps
        if every:
            break
        others = rows.where(F.col("kind") == OTHER).select("a", "b").join(tested, ["a", "b"], "left_anti")
        others = written(_apart(others, comps), "pairs")
        if not others.isEmpty():
            more = _verified(others, classes, texts)
            tested = tested.unionByName(others)
            comps = joined(more) if not more.isEmpty() else comps
        again = rows.where(F.col("kind") == AGAIN).select(F.col("a").alias("h")).distinct()
        if again.isEmpty():
            break
        tiles = tiles.join(again, "h", "left_semi")
        # the most similar pairs come first while many of them link; then all that are left
        every = found * FOREST < tried or found == 0

    ids = classes.select("sid", "leader").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = ids.groupBy("comp").agg(F.min("leader").alias("least"))
    ids = ids.join(least, "comp").select("sid", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("leader_hash"))
    out = people.select("doc_id", "n", "text_hash", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(ids, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      "text_hash", F.coalesce("leader_hash", "text_hash").alias("leader_hash"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT g.a, r.c FROM r JOIN g ON g.b = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
