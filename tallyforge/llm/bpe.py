r"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left ends: leaf ``i`` holds ``rank * P + i`` of the pair that starts
at symbol ``i`` (infinite when no merge exists).  The root is the minimum, hence the leftmost pair of
the lowest rank.  Merging it changes three leaves, each a point update of log P nodes, until the root
is infinite.  The trees of many words are the columns of one numpy array, so that every step works on
all words that still merge.

Text handling follows the tokenizer file: special tokens are cut out of the raw text first; the rest
is put into NFC, white space separates, letters are lower-cased one by one, and words are split by the
file's pattern.  None of these steps looks across white space, so results are kept per white-space
delimited chunk: most chunks of a corpus have been seen before.  The cache is bounded.

Defined results: null text is the empty text (0 tokens, digests of the empty string); repeated rows
give repeated results; an empty table gives no rows; other columns are not read.  Texts of any length
are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyforge.llm.common import read_table, ship

TOKENIZER = "word_bpe_49k.json"
CACHED_CHUNKS = 250_000  # per Python worker; beyond it the cache starts anew
LONG_CHUNK = 200  # longer chunks are not kept

# The white space of Unicode, and the printable stand-ins of bytes in byte-level BPE.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

INF = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    out, spare = {}, 0x100
    for b in PRINTABLE:
        out[b] = chr(b)
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class PairRanks:
    """(left id, right id) -> (rank, merged id) for whole arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.base = max(vocab.values(), default=0) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)  # of a repeated pair the first rank counts
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # open addressing: a power of two of slots, at most an eighth full
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, INF, dtype=np.int64)
        self.slot_made = np.zeros(1 << bits, dtype=np.int64)
        self.probes = 1
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] < 0
            slots, winners = np.unique(at[left[free]], return_index=True)
            placed = left[free][winners]
            self.slot_key[slots] = keys[placed]
            self.slot_rank[slots] = first[placed]
            self.slot_made[slots] = made[first[placed]]
            left = np.setdiff1d(left, placed, assume_unique=True)
            if len(left):
                at[left] = (at[left] + 1) & self.mask
                self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (INF where no merge exists) and merged ids."""
        keys = np.where((left < 0) | (right < 0), -2, left * self.base + right)
        at = self._slot(keys)
        found = self.slot_key[at]
        rank = np.where(found == keys, self.slot_rank[at], INF)
        made = self.slot_made[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            made[open_[hit]] = self.slot_made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return rank, made


def merge_words(symbols: np.ndarray, sizes: np.ndarray, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` of all words, one after another, and their ``sizes``: the merged ids likewise."""
    starts = np.cumsum(sizes) - sizes
    counts = sizes.copy()
    out = symbols.copy()
    widths = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64), 0)
    for width in np.unique(widths[widths > 0]).tolist():
        ks = np.flatnonzero(widths == width)
        for at in range(0, len(ks), step := max(1, (1 << 20) // width)):
            part = ks[at : at + step]
            ids, counts[part] = _merge_block(symbols, starts[part], sizes[part], width, ranks)
            first = np.cumsum(counts[part]) - counts[part]
            out[np.repeat(starts[part] - first, counts[part]) + np.arange(len(ids))] = ids
    new = np.cumsum(counts) - counts
    return out[np.repeat(starts - new, counts) + np.arange(int(counts.sum()))], counts


def _merge_block(symbols, starts, sizes, width: int, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Words of 2 to width + 1 symbols; column c of every array belongs to word c."""
    n = len(sizes)
    sym = np.full((width + 2, n), -1, dtype=np.int64)
    cols = np.repeat(np.arange(n), sizes)
    rows = np.arange(len(cols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sym[rows, cols] = symbols[np.repeat(starts, sizes) + rows]
    end = width + 1  # row of a symbol that is never there
    pos = np.arange(width + 2)[:, None]
    nxt = np.where(pos + 1 < sizes, pos + 1, end)
    prv = np.broadcast_to(np.where(pos > 0, pos - 1, end), sym.shape).copy()
    alive = sym >= 0
    rank, _ = ranks.look_up(sym[:width].ravel(), np.where(nxt[:width] == end, -1, np.take_along_axis(sym, nxt[:width], 0)).ravel())
    rank = rank.reshape(width, n)
    tree = np.full((2 * width, n), INF, dtype=np.int64)
    tree[width:] = np.where(rank < INF, rank * width + np.arange(width)[:, None], INF)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    live = np.flatnonzero(tree[1] < INF)
    while len(live):
        at = tree[1, live] % width
        right = nxt[at, live]
        after = nxt[right, live]
        before = prv[at, live]
        left_id, right_id = sym[at, live], sym[right, live]
        _, made = ranks.look_up(left_id, right_id)
        sym[at, live] = made
        alive[right, live] = False
        nxt[at, live] = after
        inner = after != end
        prv[after[inner], live[inner]] = at[inner]
        here, _ = ranks.look_up(made, np.where(inner, sym[after, live], -1))
        _update(tree, width, at, live, here)
        gone = right < width
        _update(tree, width, right[gone], live[gone], np.full(int(gone.sum()), INF))
        has = before != end
        there, _ = ranks.look_up(sym[before[has], live[has]], made[has])
        _update(tree, width, before[has], live[has], there)
        live = live[tree[1, live] < INF]
    return sym.T[alive.T], alive.sum(axis=0)


def _update(tree: np.ndarray, width: int, at: np.ndarray, live: np.ndarray, rank: np.ndarray) -> None:
    """Point update of leaf ``at`` in the trees ``live``."""
    tree[width + at, live] = np.where(rank < INF, rank * width + at, INF)
    node = (width + at) >> 1
    while width > 1 and node[:1].size and node[0] >= 1:
        tree[node, live] = np.minimum(tree[2 * node, live], tree[2 * node + 1, live])
        node = node >> 1


class Bpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE with word ends, lower-casing)."""

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        signs = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in signs], dtype=np.int64)
        self.final = np.array([self.vocab[s + suffix] for s in signs], dtype=np.int64)
        self.ranks = PairRanks(self.vocab, model["merges"])
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = np.full(size, "", dtype=object)
        for t, i in (self.vocab | self.special).items():
            self.token[i] = t
        self.dtype = np.dtype(np.uint16 if size < 0xFF00 else np.uint32)
        self.id_names = np.array([str(i) for i in range(size)], dtype=object)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE.replace("\\", ""))
        self.words = regex.compile(pattern + r"|\n").findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.white = re.compile(f"[^{WHITE}]+").findall
        self.cached, self.ids_of = cached, {}

    def chunks(self, text: str) -> list[str]:
        # str.split() also takes four control characters for white space
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.white(text)
        return text.split()

    def _lower(self, s: str) -> str:
        return "".join(map(str.lower, s)) if "Σ" in s else s.lower()  # a final sigma has no form of its own here

    def _merge(self, words: list[str]) -> None:
        """Keep the ids of words."""
        b = np.frombuffer("\n".join(words).encode() + b"\n", dtype=np.uint8)
        ends = np.flatnonzero(b == 10)  # no word holds a line feed
        sizes = np.diff(ends, prepend=-1) - 1
        symbols = self.inner[b]
        symbols[ends - 1] = self.final[b[ends - 1]]
        ids, counts = merge_words(np.delete(symbols, ends), sizes, self.ranks)
        packed, stops = ids.astype(self.dtype).tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
        at = 0
        for w, stop in zip(words, stops):
            self.ids_of[w] = packed[at:stop]
            at = stop

    def learn(self, chunks: list[str]) -> None:
        """Keep the ids of new chunks."""
        plain = [c for c in chunks if "<|" not in c]
        if plain:
            joined = "\n".join(plain)
            words = self.words(self._lower(joined if joined.isascii() else unicodedata.normalize("NFC", joined)))
            if new := [w for w in set(words).difference(self.ids_of) if w != "\n"]:
                self._merge(new)
            self.ids_of["\n"] = mark = b"\xff" * self.dtype.itemsize  # no id has such a high byte
            made = b"".join(map(self.ids_of.__getitem__, words)).split(mark)
            del self.ids_of["\n"]
            self.ids_of.update(zip(plain, made, strict=True))
        for c in chunks:
            if "<|" in c:  # may hold special tokens: the text between them stands alone
                out = []
                for p in filter(None, self.cut.split(c)):
                    if p in self.special:
                        out.append(np.array([self.special[p]], self.dtype).tobytes())
                        continue
                    words = self.words(self._lower(unicodedata.normalize("NFC", p)))
                    if new := list(set(words).difference(self.ids_of)):
                        self._merge(new)
                    out += map(self.ids_of.__getitem__, words)
                self.ids_of[c] = b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.chunks(t) for t in texts]
        if len(self.ids_of) > self.cached:
            self.ids_of = {}
        new = set().union(*split).difference(self.ids_of) if split else set()
        if new:
            self.learn(list(new))
        out = [np.frombuffer(b"".join(map(self.ids_of.__getitem__, s)), self.dtype) for s in split]
        for c in new:
            if len(c) > LONG_CHUNK:
                del self.ids_of[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids joined by blanks (the file names no decoder); special tokens stay."""
        return " ".join(self.token[ids].tolist())

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(self.id_names[ids].tolist())


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


BLOCK_CHARS = 2_000_000  # texts are taken in blocks of about so many characters


def blocks(texts: list[str], chars: int = BLOCK_CHARS):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text; no shuffle."""
    ship(docs.sparkSession)
    cols = docs.select("doc_id", "text")
    kind = cols.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from public_tokenizers import path as tokenizer_path

        bpe = loaded(path or tokenizer_path(TOKENIZER))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in blocks([t or "" for t in b.column("text").to_pylist()]):
                for ids in bpe.encode(texts):
                    n.append(len(ids))
                    ids_sha.append(sha(bpe.decimal(ids)))
                    text_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return cols.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    return bpe_digests(read_table(spark, sf_dir, "documents"))
