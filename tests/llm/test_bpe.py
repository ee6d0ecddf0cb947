import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from fixtures import collect, tables
from tokenizers import Tokenizer

from tallyforge.llm import bpe as B

PATH = public_tokenizers.path(B.TOKENIZER)
ALPHABET = "abtheinion  \n\t'srveé́İΣσςß½٣Ⅷ<|endoftext|>ÇñÜ漢字か\x1c\x85\xa0 !.,_-—🙂️́"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hostile(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + [
        "", " ", "<|startoftext|>hi<|endoftext|> it's THE end", "x<|startoftext|>y", "a" * 500, "ab" * 900, "hello " * 5000]


def test_encoding_and_decoding_equal_the_library(library):
    own = B.Bpe(PATH, cached=2000)  # small, so that the cache starts anew now and then
    texts = hostile(3000, 1)
    for at in range(0, len(texts), 400):
        for t, ids in zip(texts[at : at + 400], own.encode(texts[at : at + 400])):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want, repr(t)
            assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_segment_tree_equals_repeated_scans():
    rng = random.Random(3)
    vocab = {c: i for i, c in enumerate("abc")}
    merges = []
    while len(merges) < 40:
        x, y = rng.choice(list(vocab)), rng.choice(list(vocab))
        if len(x + y) < 9 and [x, y] not in merges:
            merges.append([x, y])
            vocab.setdefault(x + y, len(vocab))
    rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}

    def plain(ids):
        ids = list(ids)
        while found := [(rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            k = min(found)[1]
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]
        return ids

    words = [[rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 64, 200]))] for _ in range(500)]
    flat, sizes = np.array([i for w in words for i in w]), np.array([len(w) for w in words])
    got, counts = B.merge_words(flat, sizes, B.PairRanks(vocab, merges))
    assert [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == [plain(w) for w in words]


def test_query_equals_the_library(spark, library):
    docs = list(enumerate(hostile(150, 5))) + [(1000, None), (None, "null id"), (3, "again"), (3, "again")]
    got = collect(B.op3_bpe(spark, tables(documents=docs)))
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(float("nan") if i is None else float(i)), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert found == sorted(want)
    assert len(collect(B.op3_bpe(spark, tables(documents=[])))) == 0


def test_kept_chunks_are_bounded():
    bpe = B.Bpe(PATH)
    for k in range(5):
        bpe.encode([" ".join(f"q{k}z{i}" for i in range(80_000))])
    assert len(bpe.ids_of) < 350_000  # a worker that kept up to a million held 356 MB
