"""Byte-level BPE against the public library, on fixtures and random texts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from causeway.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    return bpe.Codec(ranks, P.PATTERN, memo=500), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  ", "   x", "a  b", "a   b", "x \n y", "x\n y", "x \n\n  y ", "tab\t end\n ", "it's we'll 'S don't", "Ünïcödé été 你好 ½ ² Ⅷ 一",
         "\x1c \x1d\x85  a b  ", "<|endoftext|> x", "a" * 5000, "ab" * 3000 + " " + "z" * 999, "$$$ ### !!", "\U0001f600\U0001f600 ok",
         "the the the the", "supercalifragilisticexpialidocious " * 50]


def same(codec, text):
    own, lib = codec
    [ids] = own.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), repr(text[:80])
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", TEXTS)
def test_fixture_texts(codec, text):
    same(codec, text)


def test_many_pieces_equal_one_by_one(codec):
    rnd = random.Random(8)
    pieces = list({bytes(rnd.choice(b"abcdeinorst \xc3\xa9\x00") for _ in range(rnd.randint(1, 70))) for _ in range(3000)})
    merger = codec[0].merger
    assert {p: np.frombuffer(b, "<u4").tolist() for p, b in merger.many(pieces).items()} == {p: merger.ids(p) for p in pieces}


def test_random_texts(codec):
    rnd = random.Random(3)
    alphabet = "aaabcdeéñß   \n\n\t'slt.,!#12½你 \x1f 　🙂"
    for _ in range(3000):
        same(codec, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))))
    for _ in range(300):
        same(codec, "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 200))))


MIXED = [a + (gap * n) + b for gap in ("\u00a0 ", " \u00a0", "\t ", " \t", "\u3000 ", " \u3000", "\n ", " \x1c", " \u2003\u00a0")
         for n in (1, 2, 5) for a, b in (("x", "y"), ("", "y"), ("x", ""), ("x ", " y z"), ("w x", "\u00a0y"))]


@pytest.mark.parametrize("text", ["x \u00a0 \u00a0 \u00a0y", *MIXED])
def test_blanks_beside_other_white_space(codec, text):
    same(codec, text)


def test_random_mixed_white_space(codec):
    rnd = random.Random(12)
    for _ in range(3000):
        same(codec, "".join(rnd.choice("ab1.  \u00a0\t\u3000\n\x1c\x85") for _ in range(rnd.randint(0, 40))))
    for _ in range(1000):      # no two blanks together: always cut into chunks
        same(codec, "".join(rnd.choice(["a", "b1", ".", " \u00a0", "\u00a0 ", " \t", " x", "\u3000", " y z"]) for _ in range(20)).replace("  ", " "))


def test_query_rows(spark):
    texts = [None, *TEXTS, TEXTS[-1]]
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(open(PATH, "rb").read()), special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, PATH, P.PATTERN).collect())
    want = sorted((i is None, i or 0, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, _, _ in rows for x in [lib.encode_ordinary(t or "")])
    assert got == want
    assert bpe.encode_texts(df.limit(0), PATH, P.PATTERN).count() == 0
    assert all(r.decoded.decode() == (texts[r.doc_id] or "") for r in bpe.encode_texts(df.where("doc_id is not null"), PATH, P.PATTERN).collect())
