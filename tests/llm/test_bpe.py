import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import ODD, documents, empty, frame, odd
from twinsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(1)
    out = [r[1] for r in documents(40)] + [r[1] or "" for r in ODD]
    out += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "\x1c \x85 x", "it's we'll I'D", "½ ² ٣ İ", "the" * 400 + "\n\n  z"]
    out += ["".join(rng.choice("ab c\n\t'sté日😀<|end>0½  \x0b!") for _ in range(rng.randrange(60))) for _ in range(500)]
    return out


def test_same_as_the_library(vocabulary, library):
    codec = bpe.Codec(vocabulary)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_parts_of_characters_decode_as_in_the_library(vocabulary, library):
    codec, rng = bpe.Codec(vocabulary), random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_both_trees_agree(vocabulary):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdefgh e\xc3\xa9") for _ in range(rng.randrange(1, 129))) for _ in range(300)]
    got = bpe.encode_pieces(pieces, vocabulary)
    assert all(got[p] == bpe.encode_long(p, vocabulary) for p in pieces)


def test_tree_yields_leftmost_lowest():
    tree = bpe.PairTree([7, 3, bpe.NONE, 3, 9])
    assert tree.root == (3, 1)
    tree.set(1, bpe.NONE)
    assert tree.root == (3, 3)
    tree.set(3, 8)
    assert tree.root == (7, 0)
    assert bpe.PairTree([bpe.NONE]).root is None and bpe.PairTree([4]).root == (4, 0)


def test_little_memory_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "CHUNK", 40)
    some = texts()[:120]
    for t, (n, ids, decoded) in zip(some, bpe.Codec(vocabulary).digests(some), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(t.encode()).hexdigest()


def test_over_tables(spark, library):
    rows = bpe.encode_documents(odd(spark), PATH).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r for r in rows}
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
    r = bpe.token_ids(frame(spark, [(1, "hello <|endoftext|>", "en", "s", 1)]), PATH).first()
    assert r["ids"] == library.encode("hello <|endoftext|>", add_special_tokens=False).ids and r["decoded"] == "hello <|endoftext|>"
