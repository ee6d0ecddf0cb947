"""Removal of long substrings that an earlier document holds, by hash-compared suffix sorting.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id.  The suffixes that can matter are found first: every such string picks one of its ``K``-byte grams
as its anchor (least hash of its LENGTH - K + 1 grams, the first of equals), so equal strings have equal
anchors at equal places.

0. A text that a smaller id holds whole is covered whole (if it has LENGTH bytes) and takes no further part.
1. A task sends the hashes of its documents' anchors to buckets, packed by the million; anchors of one
   document only are dropped.  The others go to the parts of the texts that have them, once a part.
2. Documents that share anchors cut out, around each shared one, the bytes of the strings that picked
   it.  Strings already covered by an earlier document of the same block are marked there and not sent.
   The others leave a task packed by bucket, some megabytes a time, so that the number of packets does not
   grow with blocks times buckets.
3. Each bucket sorts the suffixes: prefix polynomial hashes over its bytes give the hash of any piece in
   constant time, a binary search over the length finds the common extension of two suffixes, and a
   mergesort compares by it.  Strings that agree by hash and by their bytes enter it once.  Neighbours
   that agree on LENGTH bytes by hash are verified by their bytes.
   In each class of equal strings all but those of the smallest id are marked.
4. Marks carry the id and a hash of the text they belong to, since rows may repeat an id.  They leave a
   task packed by the partition that unites them, a few blobs a task; then each text is cut.

All steps work on numpy arrays; texts longer than a block pass through it whole.

Defined results: null text is the empty text; a null ``doc_id`` counts as the smallest id; rows of equal
``doc_id`` never cut each other, whatever their texts, and each is cut by what smaller ids hold; overlaps
count, and strings are judged on the input; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import FILTER_BITS, likely, read_table, ship, written
from tallyforge.llm.hashing import PrefixHashes, mixed

LENGTH, K = 50, 25
BLOCK_BYTES = 1 << 19  # bytes of text that are worked on at a time
BUCKET_ANCHORS = 1_000_000
BUCKET_CONTEXTS = 100_000
PART_BYTES = 1 << 24  # bytes of text that meet their shared anchors at a time
ANCHORS_HELD = 1_000_000  # anchors that a task packs at a time
CONTEXTS_HELD = 12 << 20  # bytes of contexts that a task packs at a time
MARKS_HELD = 200_000  # marks that a task packs at a time
SLICE_WINDOWS = 300_000  # suffixes sorted at a time in a bucket, cut between anchors
SLICE_BYTES = 1 << 19  # bytes of a bucket that are hashed at a time, cut between anchors
HOT_STRINGS = 2_000_000  # strings of one anchor that are held at a time
IDS_TOLD = 4 * FILTER_BITS  # pairs of a bucket of anchors and an id, at most, that are told for a filter
NO_ID = -(2**63)
SMALL_GROUP = 4  # suffixes that are sorted by their extensions alone

class Suffixes(PrefixHashes):
    """Comparison of suffixes by the hashes of their pieces."""

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        a0, b0, a1, b1 = self.prefix[a], self.prefix[b], self._inverses[a], self._inverses[b]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - a0) * a1 == (self.prefix[b + mid] - b0) * b1
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffix at a sorts before the one at b on its first ``length`` bytes."""
        out = self.piece(a, length) != self.piece(b, length)
        at = np.flatnonzero(out)
        if len(at):
            k = self.common(a[at], b[at], length - 1)
            out[at] = self.data[a[at] + k] < self.data[b[at] + k]
        return out


def suffix_sort(text: Suffixes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A stable order of ``starts`` (already grouped) by suffix inside each group.  Groups of more than
    SMALL_GROUP are first cut by their next eight bytes, as long as there are such; then a bottom-up
    mergesort of all groups at once: an element's place in a merge is its rank in its run plus the number
    of elements of the neighbouring run before it, found by binary search."""
    n = len(starts)
    order = np.arange(n)
    begins = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    words = np.ndarray(max(0, len(text.data) - 7), ">u8", text.data, strides=(1,)) if len(text.data) > 7 else None
    for ahead in range(0, length - 7, 8):
        edges = np.flatnonzero(begins)
        sizes = np.diff(np.append(edges, n))
        at = np.flatnonzero(np.repeat(sizes > SMALL_GROUP, sizes))
        if not len(at):
            break
        own = np.cumsum(begins)[at]
        word = words[starts[order[at]] + ahead].astype(np.uint64)
        by_word = np.lexsort((word, own))
        order[at] = order[at[by_word]]
        word = word[by_word]
        begins[at[1:]] |= (word[1:] != word[:-1])
    edges = np.flatnonzero(begins)
    sizes = np.diff(np.append(edges, n))
    first = np.repeat(edges, sizes)
    last = first + np.repeat(sizes, sizes)
    width = 1
    biggest = int(sizes.max()) if n else 0
    while width < biggest:
        # only groups that are longer than a run still merge
        at = np.flatnonzero(last - first > width)
        place = at - first[at]
        run = place // width
        own = first[at] + run * width
        other = np.where(run % 2 == 0, own + width, own - width)
        stop = np.minimum(np.minimum(other + width, last[at]), n)
        low, high = np.minimum(other, stop), stop.copy()
        base = low.copy()
        left = run % 2 == 0
        mine = starts[order[at]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            theirs = starts[order[mid]]
            # equal elements of the left run stay first
            smaller = np.where(left[open_], text.before(theirs, mine[open_], length), ~text.before(mine[open_], theirs, length))
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        merged = np.where(left, own, other) + (at - own) + (low - base)
        fresh = order.copy()
        fresh[merged] = order[at]
        order = fresh
        width *= 2
    return order


def equal_classes(text: Suffixes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For sorted suffixes: whether each begins a class of equal strings, verified by the bytes."""
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        near = np.flatnonzero((group[1:] == group[:-1]) & (text.piece(starts[1:], length) == text.piece(starts[:-1], length))) + 1
        new[near[_same_bytes(text.data, starts[near], starts[near - 1], length)]] = False
    return new


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at a and b agree."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,)) if length >= 8 else data  # unaligned
    wide = 8 if length >= 8 else 1
    same = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y, out = a[k : k + (1 << 16)], b[k : k + (1 << 16)], same[k : k + (1 << 16)]
        for ahead in [*range(0, length - wide + 1, wide), length - wide]:
            out &= words[x + ahead] == words[y + ahead]
    return same


class Anchors:
    """Anchors of the strings of a block of documents."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.at, self.doc, self.key = empty, empty, empty, empty, np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        self.hashes = Suffixes(self.data)
        grams = self.hashes.prefix[K:] - self.hashes.prefix[:-K]
        grams *= self.hashes._inverses[: n - K + 1]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
        low = grams & np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(grams), dtype=np.uint64)
        size, window = 1, LENGTH - K + 1
        while size * 2 <= window:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < window:
            low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
        at = low.astype(np.uint32)  # the lower half
        # runs of strings of one anchor, cut at the first and after the last string of each text
        begins = self.stops - sizes
        ends = np.maximum(begins, self.stops - LENGTH + 1)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, begins[begins < len(at)], ends[ends < len(at)]]))
        doc = np.searchsorted(self.stops, cuts, side="right")
        valid = cuts + LENGTH <= self.stops[np.minimum(doc, len(self.stops) - 1)]
        self.first, self.last = cuts[valid], np.append(cuts[1:], len(at))[valid] - 1  # starts of the strings of each anchor
        self.at, self.doc = at[self.first].astype(np.int64), doc[valid]
        self.key = grams[self.at]


def covered(data, first: np.ndarray, count: np.ndarray, ahead: np.ndarray, ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each string of each context is also in a context of a smaller id.  Context c holds the
    strings at ``first[c] .. first[c] + count[c] - 1`` of ``data`` (bytes or their ``Suffixes``), whose
    anchor lies ``ahead[c]`` bytes after the first; the result is flat."""
    total = int(count.sum())
    out = np.zeros(total, bool)
    if total == 0:
        return out
    # only anchors that several ids hold can cover anything
    order = np.argsort(key)
    k, d = key[order], ids[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    edges = np.flatnonzero(new)
    several = np.minimum.reduceat(d, edges) != np.maximum.reduceat(d, edges)
    some = np.sort(order[several[np.cumsum(new) - 1]])
    if not len(some):
        return out
    where = (np.cumsum(count) - count)[some]
    first, count, ahead, ids, key = (x[some] for x in (first, count, ahead, ids, key))
    text = data if isinstance(data, Suffixes) else None
    data = text.data if text else data
    if text is None and len(data) <= 4 * SLICE_BYTES:
        text = Suffixes(data)
    keeper = _equal_contexts(data, text, first, count, ahead, ids, key)
    alone = np.flatnonzero(keeper == np.arange(len(keeper)))
    out_of = _covered_distinct(data, text, *(x[alone] for x in (first, count, ahead, ids, key)))
    # equal contexts: a larger id is covered whole, the smallest shares what its keeper has
    place = np.zeros(len(keeper), np.int64)
    place[alone] = np.cumsum(count[alone]) - count[alone]
    step = _steps(count)
    got = out_of[np.repeat(place[keeper], count) + step] | np.repeat(ids > ids[keeper], count)
    out[np.repeat(where, count) + step] = got
    return out


def _steps(count: np.ndarray) -> np.ndarray:
    """0 .. count[c] - 1 for each c, one after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _chunks(sizes: np.ndarray, most: int):
    """Ranges of neighbours whose sizes sum up to about ``most``."""
    filled = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        j = max(k + 1, int(np.searchsorted(filled, (filled[k - 1] if k else 0) + most, side="right")))
        yield k, j
        k = j


def _pieces(data: np.ndarray, text, first: np.ndarray, size: np.ndarray, most: int):
    """(range of contexts, a text that holds them, their places in it): the whole text, if it is hashed,
    else their bytes by the slice."""
    if text is not None:
        yield 0, len(first), text, first
        return
    for k, j in _chunks(size, most):
        own = np.cumsum(size[k:j]) - size[k:j]
        yield k, j, Suffixes(data[np.repeat(first[k:j], size[k:j]) + _steps(size[k:j])]), own


def _equal_contexts(data: np.ndarray, text, first, count, ahead, ids, key) -> np.ndarray:
    """For each context the one of least id among those with the same bytes and places (itself, if none)."""
    size = count + LENGTH - 1
    whole = np.zeros(len(first), np.uint64)
    for k, j, part, own in _pieces(data, text, first, size, SLICE_BYTES):
        whole[k:j] = part.piece(own, size[k:j])
    whole = mixed(whole + key * np.uint64(3) + (count * 64 + ahead).astype(np.uint64))
    order = np.lexsort((ids, whole))
    f, c, a, k, w = (x[order] for x in (first, count, ahead, key, whole))
    same = np.zeros(len(order), bool)
    same[1:] = (w[1:] == w[:-1]) & (k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    at = np.flatnonzero(same)
    for part in np.array_split(at, max(1, len(at) // 20_000)):  # verified by the bytes
        n = size[order[part]]
        step = _steps(n)
        differ = data[np.repeat(f[part], n) + step] != data[np.repeat(f[part - 1], n) + step]
        same[part[np.unique(np.repeat(np.arange(len(part)), n)[differ])]] = False
    heads = np.flatnonzero(~same)
    keeper = np.empty(len(order), np.int64)
    keeper[order] = order[heads[np.cumsum(~same) - 1]]
    return keeper


def _covered_distinct(data: np.ndarray, text, first, count, ahead, ids, key) -> np.ndarray:
    out = np.zeros(int(count.sum()), bool)
    where = np.cumsum(count) - count
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    ends = np.append(edges[1:], len(order))
    shared = ends - edges > 1
    edges, ends = edges[shared], ends[shared]
    windows = np.concatenate([[0], np.cumsum(count[order])])
    k = 0
    while k < len(edges):  # whole anchors, about SLICE_WINDOWS strings at a time
        j = max(k + 1, int(np.searchsorted(windows[ends], windows[edges[k]] + SLICE_WINDOWS, side="right")))
        part = np.concatenate([order[a:b] for a, b in zip(edges[k:j], ends[k:j])])
        k = j
        number = np.cumsum(np.concatenate([[True], key[part][1:] != key[part][:-1]]))
        total = int(count[part].sum())
        # one anchor with very many strings: by the hash of the string, so that equal ones stay together
        shares = -(-total // HOT_STRINGS) if text is None or total > 2 * SLICE_WINDOWS else 1
        for share in range(shares):
            held = []
            for a, b, piece, own in _pieces(data, text, first[part], count[part] + LENGTH - 1, SLICE_BYTES):
                sizes = count[part[a:b]]
                owner, step = np.repeat(np.arange(a, b), sizes), _steps(sizes)
                hash_ = piece.piece(np.repeat(own, sizes) + step, LENGTH)
                back = ahead[part[owner]] - step  # from the string's start to the anchor
                group = number[owner] * 64 + back
                string = mixed(hash_ + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                if shares > 1:
                    mine = np.flatnonzero((string >> np.uint64(8)) % np.uint64(shares) == share)
                    owner, step, group, string = owner[mine], step[mine], group[mine], string[mine]
                held.append((part[owner].astype(np.int32), step.astype(np.uint8), group, string))
            own, step, group, string = (np.concatenate(x) for x in zip(*held))
            held.clear()
            hit = ids[own] > _least_ids(data, text, first[own] + step, group, string, ids[own])
            out[where[own[hit]] + step[hit]] = True
    return out


def _least_ids(data: np.ndarray, text, starts: np.ndarray, group: np.ndarray, string: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that holds each string in its group; ``string``: a hash of both.  What agrees by it
    and by its bytes is met once; the suffixes that are left are sorted in their groups."""
    least = ids.copy()
    order = np.argsort(string)
    s, g, h = starts[order], group[order], string[order]
    new = np.ones(len(order), bool)
    near = np.flatnonzero((h[1:] == h[:-1]) & (g[1:] == g[:-1])) + 1
    new[near[_same_bytes(data, s[near], s[near - 1], LENGTH)]] = False
    heads = np.flatnonzero(new)
    if not len(heads):
        return least
    low = np.minimum.reduceat(ids[order], heads)
    of = np.cumsum(new) - 1
    # distinct strings of groups that have several
    s, g, h = s[heads], g[heads], h[heads]
    by_group = np.argsort(g, kind="stable") if text is not None else np.arange(len(g))
    for a, b in [(0, len(g))] if text is not None else _chunks(np.full(len(g), LENGTH), SLICE_BYTES):
        while text is None and b < len(g) and h[b] == h[b - 1]:
            b += 1
        part = by_group[a:b]
        if text is None:
            part = part[np.argsort(g[part], kind="stable")]
        x = g[part]
        fresh = np.concatenate([[True], x[1:] != x[:-1]])
        part = part[~(fresh & np.append(fresh[1:], True))]
        if not len(part):
            continue
        if text is None:
            places = np.arange(len(part)) * LENGTH
            own = Suffixes(data[(s[part][:, None] + np.arange(LENGTH)).ravel()])
        else:
            places, own = s[part], text
        by_suffix = suffix_sort(own, places, g[part])
        part, places = part[by_suffix], places[by_suffix]
        begin = equal_classes(own, places, g[part])
        if not begin.all():
            low[part] = np.minimum.reduceat(low[part], np.flatnonzero(begin))[np.cumsum(begin) - 1]
    least[order] = low[of]
    return least


def _spans(flags: np.ndarray) -> np.ndarray:
    """[start, stop) rows of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


# ---------------------------------------------------------------- the Spark steps


def _texts(batches):
    """Blocks of (parts, ids, texts as bytes) of about BLOCK_BYTES; a longer text is a block."""
    parts, ids, texts, size = [], [], [], 0
    for b in batches:
        for part, doc, text in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            parts.append(part)
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield parts, ids, texts
                parts, ids, texts, size = [], [], [], 0
    if ids:
        yield parts, ids, texts


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """``part, n, ids, keys``: the anchors (upper hash bits) that two ids hold, once for each part of the
    texts with a text that has them; ``n``: how many anchors of texts they are, ``ids``: whose (null, if
    the ids of all buckets would be more than a filter of ids can tell apart)."""
    def emit(batches):
        held, size = [], 0

        def flush():
            nonlocal size
            texts = np.concatenate([[0], np.cumsum([len(ids) for _, ids, _, _ in held])])
            parts = np.concatenate([p for p, _, _, _ in held])
            ids = np.concatenate([i for _, i, _, _ in held])
            doc = np.concatenate([d + n for (_, _, d, _), n in zip(held, texts)])
            key = np.concatenate([k for _, _, _, k in held])
            held.clear()
            size = 0
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, doc, key = bucket[order], doc[order], key[order].astype(np.uint32)
            edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            own = np.flatnonzero(edge | np.concatenate([[True], doc[1:] != doc[:-1]]))  # a text's first anchor in a bucket
            many = np.diff(np.append(own, len(key))).astype(np.uint32)
            ids, parts = ids[doc[own]], parts[doc[own]]
            cuts = np.append(np.flatnonzero(edge), len(key))
            docs_at = np.searchsorted(own, cuts)
            blobs = []
            for s, e, i, j in zip(cuts[:-1], cuts[1:], docs_at[:-1], docs_at[1:]):
                low = int(ids[i:j].min())
                slim = int(ids[i:j].max()) - low < 1 << 32
                few = int(many[i:j].max()) < 1 << 16 and int(parts[i:j].max()) < 1 << 16
                names = (ids[i:j] - low).astype(np.uint32) if slim else ids[i:j]
                kind = np.uint16 if few else np.uint32
                blobs.append(b"".join([np.array([j - i, e - s, low, slim, few], np.int64).tobytes(), names.tobytes(), key[s:e].tobytes(),
                                       many[i:j].astype(kind).tobytes(), parts[i:j].astype(kind).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for parts, ids, texts in _texts(batches):
            a = Anchors(texts)
            if len(a.key):
                held.append((np.array(parts, np.int32), np.array(ids, np.int64), a.doc, a.key))
                size += len(a.key)
            if size >= ANCHORS_HELD:
                yield from flush()
        if held:
            yield from flush()

    def unpack(raw):
        n, m, low, slim, few = np.frombuffer(raw, np.int64, 5).tolist()
        kind, at = np.dtype(np.uint16 if few else np.uint32), 40
        names = np.frombuffer(raw, np.uint32, n, at).astype(np.int64) + low if slim else np.frombuffer(raw, np.int64, n, at)
        at += n * (4 if slim else 8)
        keys = np.frombuffer(raw, np.uint32, m, at)
        many = np.frombuffer(raw, kind, n, at + 4 * m)
        parts = np.frombuffer(raw, kind, n, at + 4 * m + n * kind.itemsize).astype(np.int32)
        return np.repeat(names, many), np.repeat(parts, many), keys

    def meet(batches):
        at, held = None, []

        def close():
            ids, parts, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys)
            start = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
            edges = np.flatnonzero(start)
            low, high = np.minimum.reduceat(ids[order], edges), np.maximum.reduceat(ids[order], edges)
            keep = order[(low != high)[np.cumsum(start) - 1]]
            if not len(keep):
                return
            ids, parts, keys = ids[keep], parts[keep], keys[keep]
            order = np.lexsort((keys, parts))
            ids, parts, keys = ids[order], parts[order], keys[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])), len(parts))
            names = [np.unique(ids[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
            told = sum(map(len, names)) * buckets <= IDS_TOLD
            blobs = [np.int64(at).tobytes() + np.unique(keys[s:e]).tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array([x.tobytes() if told else None for x in names], pa.binary()), pa.array(blobs, pa.binary())],
                ["part", "n", "ids", "keys"])

        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                if bucket != at:
                    if held:
                        yield from close()
                    at = bucket
                held.append(unpack(blob.as_py()))
        if held:
            yield from close()

    sent = docs.select("part", "doc_id", "text").mapInArrow(emit, "bucket int, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return written(sent.mapInArrow(meet, "part int, n long, ids binary, keys binary"), "anchors", "none")


_CONTEXT = np.dtype([("id", "<i8"), ("tag", "<i8"), ("key", "<u8"), ("first", "<u4"), ("count", "u1"), ("ahead", "u1")])
_MARK = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def covered_by_slices(data: np.ndarray, rows: np.ndarray):
    """``covered`` for the contexts ``rows``, whose bytes follow one another in ``data``: pairs of some
    contexts and their flags, for those with a covered string.  Hashes and sorts take about SLICE_BYTES at
    a time, cut between anchors, so that they do not grow with a bucket."""
    sizes = rows["count"].astype(np.int64) + LENGTH - 1
    first = np.cumsum(sizes) - sizes
    order = np.argsort(rows["key"], kind="stable")
    key = rows["key"][order]
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    filled = np.cumsum(sizes[order])[ends - 1]
    k = 0
    while k < len(ends):
        begin, done = (int(ends[k - 1]), filled[k - 1]) if k else (0, 0)
        k = max(k + 1, int(np.searchsorted(filled, done + SLICE_BYTES, side="right")))
        part = order[begin : int(ends[k - 1])]
        own = np.cumsum(sizes[part]) - sizes[part]
        text = data[np.repeat(first[part] - own, sizes[part]) + np.arange(int(sizes[part].sum()))]
        hit = covered(text, own, rows["count"][part].astype(np.int64), rows["ahead"][part].astype(np.int64), rows["id"][part], rows["key"][part])
        if hit.any():
            yield part, hit


def _runs(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Marks of the runs [start, stop) of neighbouring positions of each text."""
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    other = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    fresh = np.concatenate([[True], other | (pos[1:] != pos[:-1])])
    ids, tags, pos = ids[fresh], tags[fresh], pos[fresh]
    s = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 1) | (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
    out = np.zeros(len(s), _MARK)
    out["id"], out["tag"], out["start"], out["stop"] = ids[s], tags[s], pos[s], pos[np.append(s[1:], len(pos)) - 1] + 1
    return out


class _Marks:
    """Marks of a task, packed by the partition that unites those of a text."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, marks: np.ndarray):
        self.held.append(marks)
        self.size += len(marks)
        if self.size >= MARKS_HELD:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        marks = np.concatenate(self.held)
        self.held, self.size = [], 0
        part = (mixed(marks["tag"].astype(np.int64).view(np.uint64)) % np.uint64(self.parts)).astype(np.int32)
        order = np.lexsort((marks["tag"], marks["id"], part))
        marks, part = marks[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = [_pack(marks[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[cuts]), pa.nulls(len(cuts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "bucket", "blob"])


def _pack(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)


class _Contexts:
    """Contexts of a task and their bytes, packed by the bucket that meets them."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, rows: np.ndarray, data: np.ndarray):
        self.held.append((rows, data))
        self.size += rows.nbytes + len(data)
        if self.size >= CONTEXTS_HELD:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        rows, data = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        size = rows["count"].astype(np.int64) + LENGTH - 1
        first = np.cumsum(size) - size
        bucket = ((rows["key"] >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(rows))
        blobs = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = order[s:e]
            raw = rows[s:e].tobytes() + data[np.repeat(first[part], size[part]) + _steps(size[part])].tobytes()
            blobs.append(np.array([e - s, len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
        where = pa.array(bucket[cuts[:-1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([where, where, pa.array(blobs, pa.binary())], ["part", "bucket", "blob"])


def _met_texts(batches):
    """Blocks of (shared anchors, ids, tags, texts) of about BLOCK_BYTES, each of one part; the rows of a
    part with anchors come before those with texts."""
    at, keys, names = None, [], None
    ids, tags, texts, size = [], [], [], 0
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("part", "doc_id", "tag"))
        for part, doc, tag, text, blob in zip(*columns, b.column("text").cast(pa.binary()), b.column("keys")):
            if part != at:
                if texts:
                    yield names, ids, tags, texts
                    ids, tags, texts, size = [], [], [], 0
                at, keys, names = part, [], None
            if blob.is_valid:
                raw = blob.as_py()
                keys.append(np.frombuffer(raw, np.uint32, -1, 8).astype(np.uint64) | np.frombuffer(raw, np.uint64, 1) << np.uint64(32))
                continue
            if names is None:
                names, keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64), []
            if not len(names):
                continue
            ids.append(doc)
            tags.append(tag)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield names, ids, tags, texts
                ids, tags, texts, size = [], [], [], 0
    if texts:
        yield names, ids, tags, texts


def _marks(docs: DataFrame, anchors: DataFrame, anchor_buckets: int, buckets: int, parts: int) -> DataFrame:
    """``doc_id, tag, blob``: runs [start, stop) of starts of covered strings of each text (``tag``: its
    hash), one row a text."""
    def told(batches):
        for b in batches:
            ids = [np.frombuffer(x.as_py(), np.int64) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64))], ["doc_id"])

    some = docs
    if anchors.where("ids is null").isEmpty():
        some = likely(docs, anchors.select("ids").mapInArrow(told, "doc_id long"))

    def cut(batches):
        marks, contexts = _Marks(parts), _Contexts(buckets)
        for shared, ids, tags, texts in _met_texts(batches):
            a = Anchors(texts)
            if not len(a.key):
                continue
            name = (a.key >> np.uint64(32)) % np.uint64(anchor_buckets) << np.uint64(32) | a.key & np.uint64(0xFFFFFFFF)
            keep = shared[np.minimum(np.searchsorted(shared, name), len(shared) - 1)] == name
            first, last, at, doc, key = (x[keep] for x in (a.first, a.last, a.at, a.doc, a.key))
            if not len(first):
                continue
            begin = np.concatenate([[0], a.stops])[doc]
            names = np.array(ids, np.int64)[doc]
            tags = np.array(tags, np.int64)[doc]
            count = last - first + 1
            # what an earlier document of this block covers is marked here and does not travel
            hit = covered(a.hashes, first, count, at - first, names, key)
            where = np.cumsum(count) - count
            if hit.any():
                own = np.repeat(np.arange(len(first)), count)
                pos = (np.repeat(first - begin, count) + np.arange(len(own)) - np.repeat(where, count))[hit]
                yield from marks.add(_runs(names[own[hit]], tags[own[hit]], pos))
            # the rest of each context: from its first to its last string that is open
            left = np.flatnonzero(~hit)
            if not len(left):
                continue
            owner = np.repeat(np.arange(len(first)), count)[left]
            step = left - where[owner]
            e = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
            c = owner[e]
            lo, hi = step[e], step[np.append(e[1:], len(owner)) - 1]
            rows = np.zeros(len(c), _CONTEXT)
            rows["id"], rows["tag"], rows["key"], rows["first"] = names[c], tags[c], key[c], first[c] - begin[c] + lo
            rows["count"], rows["ahead"] = hi - lo + 1, at[c] - first[c] - lo
            sizes = rows["count"].astype(np.int64) + LENGTH - 1
            yield from contexts.add(rows, a.data[np.repeat(first[c] + lo, sizes) + _steps(sizes)])
        yield from contexts.flush()
        yield from marks.flush()

    def resolve(batches):
        at, held = None, []
        marks = _Marks(parts)

        def close():
            rows = np.concatenate([r for r, _ in held])
            data = np.concatenate([d for _, d in held])
            held.clear()
            for part, hit in covered_by_slices(data, rows):
                count = rows["count"][part].astype(np.int64)
                own = np.repeat(part, count)
                pos = (np.repeat(rows["first"][part].astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(len(own)))[hit]
                yield from marks.add(_runs(rows["id"][own[hit]], rows["tag"][own[hit]], pos))

        for b in batches:
            marked = b.filter(pa.compute.is_null(b.column("bucket")))
            if marked.num_rows:
                yield marked
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                if bucket is None:
                    continue
                if bucket != at:
                    if held:
                        yield from close()
                    at, held = bucket, []
                raw = blob.as_py()
                n, size = np.frombuffer(raw, np.int64, 2).tolist()
                raw = pa.decompress(raw[16:], decompressed_size=size, codec="zstd", asbytes=True)
                held.append((np.frombuffer(raw, _CONTEXT, n), np.frombuffer(raw, np.uint8, -1, n * _CONTEXT.itemsize)))
        if held:
            yield from close()
        yield from marks.flush()

    def unite(batches):
        held = [np.frombuffer(_unpack(blob.as_py()), _MARK) for b in batches for blob in b.column("blob")]
        if not held:
            return
        marks = np.concatenate(held)
        marks = marks[np.lexsort((marks["tag"], marks["id"]))]
        ids, tags = marks["id"], marks["tag"]
        edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
        spans = np.stack([marks["start"], marks["stop"]], axis=1).astype("<i8")
        for k in range(0, len(edges), 10_000):
            at = edges[k : k + 10_000]
            stops = np.append(at[1:], edges[k + 10_000] if k + 10_000 < len(edges) else len(marks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at].astype(np.int64)), pa.array(tags[at].astype(np.int64)), pa.array([spans[i:j].tobytes() for i, j in zip(at, stops)], pa.binary())],
                ["doc_id", "tag", "blob"])

    # shared anchors and texts meet by parts; contexts go to their bucket, marks to the partition that unites them
    none = {"doc_id": F.lit(None).cast("long"), "tag": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}
    met = anchors.select("part", "keys").withColumns(none).unionByName(some.withColumn("keys", F.lit(None).cast("binary")))
    met = met.withColumn("kind", F.col("keys").isNull()).repartition(parts, "part").sortWithinPartitions("part", "kind")
    sent = met.select("part", "doc_id", "tag", "text", "keys").mapInArrow(cut, "part int, bucket int, blob binary")
    sent = sent.repartition(buckets, "part").sortWithinPartitions("bucket")
    found = written(sent.mapInArrow(resolve, "part int, bucket int, blob binary").select("part", "blob"), "marks", "none")
    return found.repartition(parts, "part").mapInArrow(unite, "doc_id long, tag long, blob binary")


def _copies(docs: DataFrame) -> DataFrame:
    """``doc_id, sha, tag`` of the texts of at least LENGTH bytes that a smaller id holds whole."""
    own = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("tag"))
    own = written(own, "digests")
    least = own.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return written(own.join(least.select("sha", "least"), "sha").where("doc_id > least").select("doc_id", "sha", "tag").distinct(), "copies")


def cut_repeats(docs: DataFrame, keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, with the columns ``keep`` and,
    if ``texts``, the remaining ``text`` (characters that were cut apart are dropped)."""
    spark = docs.sparkSession
    ship(spark)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    own = docs.select(F.col("doc_id").alias("_id"), id_.alias("doc_id"), "text", *keep)
    copies = _copies(own.select("doc_id", "text"))
    slim = own.select("doc_id", "text")
    maybe = likely(slim, copies).withColumn("sha", F.sha2("text", 256)).join(copies, ["doc_id", "sha"], "left_anti").drop("sha")
    slim = likely(slim, copies, others=True).unionByName(maybe)
    slim = slim.where(F.octet_length("text") >= LENGTH)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = total * 2 / (LENGTH - K + 2)  # anchors
    least = spark.sparkContext.defaultParallelism
    parts = max(least, math.ceil(total / PART_BYTES))
    slim = slim.withColumn("tag", F.xxhash64("text")).withColumn("part", F.pmod("tag", F.lit(parts)).cast("int"))
    buckets = max(least, math.ceil(expected / BUCKET_ANCHORS))
    anchors = _shared_anchors(slim, buckets)
    shared = anchors.agg(F.sum("n")).first()[0] or 0
    marks = _marks(slim, anchors, buckets, max(least, math.ceil(shared / BUCKET_CONTEXTS)), parts)
    marks = written(marks, "spans", "none")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string",
                        *(f"`{c}` {kinds[c]}" for c in keep), *(["text string"] if texts else [])])

    def finish(batches):
        for b in batches:
            n_bytes, n_removed, n_spans, sha, left = [], [], [], [], []
            for text, marked, whole in zip(b.column("text").to_pylist(), b.column("marks"), b.column("whole").to_pylist()):
                t = (text or "").encode()
                if whole:
                    n_spans.append(1)
                    n_removed.append(len(t))
                    rest = b""
                elif marked.is_valid:
                    gone = np.zeros(len(t) + 1, np.int32)
                    s = np.frombuffer(marked.as_py(), "<i8").reshape(-1, 2)
                    np.add.at(gone, s[:, 0], 1)
                    np.add.at(gone, s[:, 1] + LENGTH - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    n_spans.append(len(_spans(gone)))
                    n_removed.append(int(gone.sum()))
                    rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
                else:
                    n_spans.append(0)
                    n_removed.append(0)
                    rest = t
                n_bytes.append(len(t))
                sha.append(hashlib.sha256(rest).hexdigest())
                left.append(None if text is None else rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()),
                 *(b.column(c) for c in keep), *([pa.array(left, pa.string())] if texts else [])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *keep, *(["text"] if texts else [])])

    # only texts that may have marks are shuffled to them
    concerned = marks.select("doc_id").unionByName(copies.select("doc_id")).distinct()
    # marks and digests of whole copies are one table with a row a text, so texts are shuffled once
    known = marks.select("doc_id", "tag", F.col("blob").alias("marks"), F.lit(None).cast("string").alias("sha")).unionByName(
        copies.select("doc_id", "tag", F.lit(None).cast("binary").alias("marks"), "sha"))
    known = known.groupBy("doc_id", "tag").agg(F.max("marks").alias("marks"), F.max("sha").alias("sha"))
    marked = likely(own, concerned).withColumn("tag", F.xxhash64("text")).join(known, ["doc_id", "tag"], "left")
    marked = marked.withColumn("whole", F.coalesce(F.col("sha") == F.sha2("text", 256), F.lit(False))).drop("tag", "sha")
    clean = likely(own, concerned, others=True).withColumns({"marks": F.lit(None).cast("binary"), "whole": F.lit(False)})
    return marked.unionByName(clean).mapInArrow(finish, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated substrings of all documents."""
    return cut_repeats(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT doc_id, q, substr(h, CAST(2 * q + 1 AS BIGINT), 1098) AS h
      FROM (SELECT *, unnest(range(0, len(h) // 2 - 49, 500)) AS q FROM b WHERE len(h) >= 100) x),
w AS (SELECT doc_id, q + o AS p, substr(h, CAST(2 * o + 1 AS BIGINT), 100) AS s
      FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS o FROM z) x),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.least),
r AS (SELECT doc_id, p, p + 50 AS e, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT doc_id, p, e, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
spans AS (SELECT doc_id, k, min(p) AS a, max(e) AS z FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM spans),
kept AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS n, max(z) AS last FROM gaps GROUP BY doc_id),
parts AS (SELECT doc_id, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head
          FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id) LEFT JOIN parts USING (doc_id)
"""
