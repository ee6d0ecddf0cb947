r"""Token ids in binary files: frequency-ranked ids, byte-aligned variable length, control bytes apart.

A job encodes the texts once, counts every id of the corpus, ranks ids by frequency (ties by id), and
writes ranks in ascending ``doc_id`` order: frequent ids take one byte.  Each file is a row of blocks

    block := u32 docs | u64 ids | u64 data bytes | control bytes | data bytes | doc table
    doc table := (flags u8, doc_id i64, ids u32) per document; bit 0 of flags: doc_id is null

A control byte holds the lengths (1 to 4) of four ranks, two bits each.  Decoding looks the four lengths
up in a 256-row table, cumulates them to positions and gathers all values at once.  ``ranks.npy`` maps a
rank to its id, ``manifest`` (Parquet) names the files with their first position in the corpus.

The tokenizer's work is kept per blank-delimited piece: the library encodes new pieces only, since its
word pattern never joins text across single blanks or single line feeds.  A text with other runs of
white space goes to the library whole.

Defined results: null text holds the end id alone; null ``doc_id`` sorts first; equal ``doc_id``s follow
each other in order of their ids' digest; an empty table gives no rows and no files; other columns are
not read.
"""

from __future__ import annotations

import io
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import blocks
from tallyforge.llm.common import open_fs, put_file, read_table, scratch, ship, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
IDS_PER_FILE = 8_000_000
BLOCK_IDS = 1 << 20
CACHED_PIECES = 1_500_000
LONG_PIECE = 200
TAIL = ".,!?;:"

# The white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


# ---------------------------------------------------------------- tokenizing


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.ids_of: dict[str, bytes] = {}
        self.first_of: dict[str, bytes] = {}
        self.white = frozenset(WHITE)
        self.tails = {c: self._whole(c) for c in TAIL}

    def _whole(self, text: str) -> bytes:
        done = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # it counts no offsets
        return np.array(done[0].ids, self.dtype).tobytes()

    def _learn(self, names: list[str], pieces: list[str]) -> None:
        """One call for all new pieces: each starts with one blank or line feed, so that none reaches
        into its neighbour; the offsets part the result."""
        text = "".join(pieces)
        done = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(done.ids, self.dtype)
        begin = np.array([a for a, _ in done.offsets], np.int64)
        ends = np.cumsum(np.array(list(map(len, pieces)), np.int64))
        # the tokens of a character cut in parts share its offsets, so "begin < end" keeps them together
        stops = (np.searchsorted(begin, ends, side="left") * self.dtype.itemsize).tolist()
        packed, at = ids.tobytes(), 0
        for p, stop in zip(names, stops):
            self.ids_of[p] = packed[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        # a piece is " word" or "\nword"; a text's first word has no blank before it
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        if len(self.ids_of) > CACHED_PIECES:
            self.ids_of = {}
        known = self.ids_of
        # not difference_update(), which would walk all that are known instead of the block's words
        words = {w for w in set().union(*(s[1:] for s in split)) if w not in known}
        odd, new, tailed = set(), [], []
        for w in words:
            if w.isalpha():
                new.append(w)
                continue
            body = w[1:] if w[:1] == "\n" else w
            if w[-1:] in self.tails and w[-2:-1].isalpha() and (w[:-1].isalpha() or self.white.isdisjoint(body)):
                tailed.append(w)  # a letter, then one mark: the mark is a word of its own
            elif not body or not self.white.isdisjoint(body):
                odd.add(w)  # white space at an end of a piece, or an empty one: a longer run of white space
            else:
                new.append(w)
        new += {b for w in tailed if (b := w[:-1]) not in known}.difference(new)
        plain = [w for w in new if "<|" not in w]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            self._learn(part, [w if w[0] == "\n" else " " + w for w in part])
        for w in new:
            if "<|" in w:
                known[w] = self._whole(w if w[0] == "\n" else " " + w)
        for w in tailed:
            known[w] = known[w[:-1]] + self.tails[w[-1]]
        out = []
        for t, s in zip(texts, split):
            first = s[0]
            if (odd and not odd.isdisjoint(s[1:])) or not first or not self.white.isdisjoint(first):
                out.append(self._whole(t))
                continue
            if first not in self.first_of:
                self.first_of[first] = self._whole(first)
            out.append(self.first_of[first] + b"".join(map(known.__getitem__, s[1:])))
        if len(self.first_of) > CACHED_PIECES // 10:
            self.first_of = {}
        new += tailed
        for w in new:
            if len(w) > LONG_PIECE:
                del known[w]
        return out


_LOADED: dict[str, PieceEncoder] = {}


def loaded(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def _pack(ids: bytes, width: int) -> bytes:
    """Byte planes, compressed: for the intermediate table only."""
    b = np.frombuffer(ids, np.uint8).reshape(-1, width)
    return pa.compress(np.ascontiguousarray(b.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def encode_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n, width, packed``: the ids of every whole text with the end id appended."""
    ship(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        from public_tokenizers import path as tokenizer_path

        encoder = loaded(path or tokenizer_path(TOKENIZER))
        width = encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in batches:
            n, packed = [], []
            for _, texts in blocks([t or "" for t in b.column("text").to_pylist()]):
                for ids in encoder.encode(texts):
                    n.append(len(ids) // width + 1)
                    packed.append(_pack(ids + end, width))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(packed, pa.binary())],
                ["doc_id", "n", "width", "packed"])

    return cols.mapInArrow(run, "doc_id long, n long, width int, packed binary")


def _each(batch):
    for doc, n, width, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "packed"))):
        yield doc, _unpack(packed, n, width)


def frequency_ranks(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole corpus, ties by id (at most one row per vocabulary entry
    reaches the driver)."""
    def run(batches):
        counts = np.zeros(0, np.int64)
        for b in batches:
            for _, ids in _each(b):
                got = np.bincount(ids)
                if len(got) > len(counts):
                    counts = np.pad(counts, (0, len(got) - len(counts)))
                counts[: len(got)] += got
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], ["id", "n"])

    rows = encoded.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64).astype(np.uint32)


# ---------------------------------------------------------------- the variable-length code

_LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), shape=(len(data) + 1,), strides=(1,))
    return words[at] & _KEEP[size]


def _block(docs: list, ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    flat = rank_of[np.concatenate(ids)]
    control, data = vbyte_encode(flat)
    table = b"".join(struct.pack("<BqI", d is None, 0 if d is None else d, len(i)) for d, i in zip(docs, ids))
    return struct.pack("<IQQ", len(docs), len(flat), len(data)) + control + data + table


def read_blocks(stream, id_of: np.ndarray):
    """(doc_id, ids) of every document of a file."""
    while head := stream.read(20):
        docs, n, size = struct.unpack("<IQQ", head)
        control, data = stream.read(-(-n // 4)), stream.read(size)
        ids = id_of[vbyte_decode(control, data, n)]
        at = 0
        for null, doc, k in struct.iter_unpack("<BqI", stream.read(13 * docs)):
            yield (None if null else doc), ids[at : at + k]
            at += k


# ---------------------------------------------------------------- files


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the corpus under ``folder`` and return its manifest ``file, base, docs, ids`` in order."""
    spark = docs.sparkSession
    encoded = written(encode_ids(docs, path), "token-ids", "none")
    ranks = frequency_ranks(encoded)
    total = encoded.agg(F.sum("n")).first()[0] or 0
    files = max(1, math.ceil(total / ids_per_file))
    buffer = io.BytesIO()
    np.save(buffer, ranks)
    put_file(f"{folder}/ranks.npy", [buffer.getvalue()])
    size = int(ranks.max()) + 1 if len(ranks) else 1

    def run(batches):
        part = TaskContext.get().partitionId()
        rank_of = np.zeros(size, np.uint32)
        rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
        seen = {"docs": 0, "ids": 0}

        def chunks():
            pending, ids, n = [], [], 0
            for b in batches:
                for doc, got in _each(b):
                    pending.append(doc)
                    ids.append(got)
                    n += len(got)
                    if n >= BLOCK_IDS:
                        yield _block(pending, ids, rank_of)
                        seen["docs"] += len(pending)
                        seen["ids"] += n
                        pending, ids, n = [], [], 0
            if pending:
                yield _block(pending, ids, rank_of)
                seen["docs"] += len(pending)
                seen["ids"] += n

        name = f"part-{part:06d}.tok"
        put_file(f"{folder}/{name}", chunks())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([seen["docs"]], pa.int64()), pa.array([seen["ids"]], pa.int64())],
            ["part", "file", "docs", "ids"])

    ordered = encoded.withColumn("digest", F.xxhash64("packed")).repartitionByRange(files, "doc_id", "digest")
    ordered = ordered.sortWithinPartitions("doc_id", "digest").drop("digest")
    rows = sorted(ordered.mapInArrow(run, "part int, file string, docs long, ids long").collect())  # a row per file
    base, listed = 0, []
    for _, name, n_docs, n_ids in rows:
        if n_docs:
            listed.append((name, base, n_docs, n_ids))
        base += n_ids
    manifest = spark.createDataFrame(listed, "file string, base long, docs long, ids long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches):
        fs, root = open_fs(folder)
        with fs.open_input_stream(f"{root}/ranks.npy") as f:
            id_of = np.load(io.BytesIO(f.read()))
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                rows, at = [], base
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for doc, ids in read_blocks(f, id_of):
                        rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    # one file a task: files are the unit of reading
    files = max(1, manifest.count())
    return manifest.select("file", "base").repartition(files, "file").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded, written in ascending doc_id order and read back."""
    folder = scratch(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
