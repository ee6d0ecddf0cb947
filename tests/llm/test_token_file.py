import io
import random
import zlib

import numpy as np
import public_tokenizers
from fixtures import collect, tables
from test_bpe import hostile
from tokenizers import Tokenizer

from tallyforge.llm import token_file as T
from tallyforge.llm.common import open_fs, scratch

PATH = public_tokenizers.path(T.TOKENIZER)


def test_pieces_equal_the_library():
    library, own = Tokenizer.from_file(PATH), T.PieceEncoder(PATH)
    texts = hostile(3000, 7) + ["a  <|endoftext|>", "a\n<|endoftext|>b", "\n", "a\n\nb", " a", "a ", "a\n b", "x, y; z!! w.", "🙂 漢字🙂 🙂\n🙂"]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_variable_length_code_round_trip():
    rng = np.random.default_rng(1)
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = np.concatenate([edges, (rng.random(n) ** 8 * 2**32).astype(np.uint32)])[: n or None] if n else edges[:0]
        control, data = T.vbyte_encode(v)
        assert len(control) == -(-len(v) // 4)
        assert (T.vbyte_decode(control, data, len(v)) == v).all()


def check(spark, docs, **options):
    library = Tokenizer.from_file(PATH)
    folder = scratch(spark, "test-files")
    path = tables(documents=docs)
    T.write_token_files(spark.read.parquet(path + "/documents.parquet"), folder, **options)
    got = sorted((r.start, -(2**63) if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_token_files(spark, folder).collect())
    at, want = 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [T.END_ID]
        want.append((at, -(2**63) if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return got, want, folder


def test_files_hold_the_corpus_in_order(spark):
    rng = random.Random(4)
    docs = list(enumerate(hostile(200, 9))) + [(5000, "tail " * 9000), (5001, None)]
    rng.shuffle(docs)
    got, want, folder = check(spark, docs, ids_per_file=3000)
    assert got == want
    assert spark.read.parquet(folder + "/manifest").count() > 3
    fs, root = open_fs(folder)
    ranks = np.load(io.BytesIO(fs.open_input_stream(root + "/ranks.npy").read()))
    assert len(set(ranks.tolist())) == len(ranks)


def test_null_ids_repeats_and_empty_table(spark):
    got, want, _ = check(spark, [(7, "same"), (7, "same"), (None, "first"), (3, "")])
    assert got == want
    assert check(spark, [])[:2] == ([], [])


def test_frequent_ids_take_the_lowest_ranks(spark):
    docs = spark.createDataFrame([(1, "the the the the cat"), (2, None)], "doc_id long, text string")
    ranks = T.frequency_ranks(T.encode_ids(docs))
    library = Tokenizer.from_file(PATH)
    assert ranks[0] == library.encode(" the").ids[0] and ranks[1] == T.END_ID


def test_the_work_of_a_block_does_not_grow_with_the_cache():
    class Cache(dict):
        def __iter__(self):
            raise AssertionError("all known pieces are walked")

    own, library = T.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", "word", "a new word", "a\nnew  blank", " lead", "new word, new mark!", "tail "] + hostile(200, 3)
    own.ids_of = Cache({"old": own._whole(" old")})
    for part in ([], texts, texts[3:] + ["an old word"]):
        for t, ids in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
