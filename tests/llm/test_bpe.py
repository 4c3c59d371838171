import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from quarryline.llm import bpe

RANKS = bpe.load_ranks(bpe.VOCABULARY)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "\n", "a", "Hello world", "it's we're I'll you've I'm he'd 'sam 's't x'y ''s '", "  two  spaces\n\n next \t tab ", "123 45six7 ½ ²",
    "naïve café 日本語 😀😀 é", "a b  c　　d", "\x1c\x1d x", "!!! ??'s!'s", "<|endoftext|> text", " 's 'll\n're", "x" * 5000, "ab" * 3000 + " " * 700 + "é" * 900,
]


def test_matches_peer():
    c = bpe.Codec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = "ab'sretlvdm \n\t12é日😀.,!_-  "
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(3000)]
    for text in texts:
        assert bpe.split_public(text) == regex.findall(public_tokenizers.PATTERN, text) or "\x1c" in text
        ids = c.encode(text).tolist()
        assert ids == PEER.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text.encode()


def test_long_texts_are_split_alike(monkeypatch):
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 20)
    text = "some words it's and more\n\n words  here 12 34 " * 30
    assert bpe.split_public(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_very_long_piece_is_not_quadratic():
    c = bpe.Codec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    ids = c.encode("thonerat" * 40_000).tolist()
    assert c.decode(ids) == b"thonerat" * 40_000


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "it's a tie", "x"), (3, "it's a tie", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect())
    want = []
    for i, text, _ in rows:
        ids = PEER.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
    assert bpe.encode_digests(docs.limit(0)).count() == 0
    whole = bpe.encode(docs.filter("doc_id = 3")).collect()
    assert [bytes(r.decoded) for r in whole] == [b"it's a tie"] * 2 and whole[0].ids == PEER.encode_ordinary("it's a tie")


@pytest.mark.parametrize("pattern", [r"\S+|\s+"])
def test_other_pattern(pattern):
    c = bpe.Codec(bpe.VOCABULARY, pattern)
    assert c.decode(c.encode("one two\nthree")) == b"one two\nthree"


@pytest.mark.parametrize("seed", range(4))
def test_joint_queue_with_any_order_of_ranks(seed):
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    tokens += sorted({bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(300)})
    rng.shuffle(tokens)  # a merge may well make a pair of lower rank
    ranks = {t: i for i, t in enumerate(tokens)}
    peer = tiktoken.Encoding("any", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks)
    pieces = ["".join(rng.choices("abcd", k=rng.randrange(1, 40))) for _ in range(2000)] + ["abcabc" * 400, "a" * 3000]
    alone = []
    single = encoder.encode
    encoder.encode = lambda piece: alone.append(piece) or single(piece)
    found = encoder.encode_all([p.encode() for p in pieces])
    assert [np.frombuffer(x, np.uint32).tolist() for x in found] == [peer.encode_ordinary(p) for p in pieces]
    assert len(alone) > 10


def test_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    monkeypatch.setattr(bpe, "LOOK_UP", 200)
    monkeypatch.setattr(bpe, "JOINT", 64)
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "gammadelta", "éé", "12345", "x" * 90], k=rng.randrange(0, 60))) for _ in range(50)]
    c = bpe.Codec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert [x.tolist() for x in c.encode_all(texts)] == [PEER.encode_ordinary(t) for t in texts]
