"""Token alignment against whole-text tokenization, sets of ends and all overlapping pairs."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from tokenizers import Tokenizer

from causeway.llm import alignment as al

RANKS, PIECES = files.path("byte_bpe_50k.tiktoken"), files.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Tokens of both sides as the libraries give them for a whole text."""
    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in open(RANKS, "rb") if line.strip())}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def tokens(text):
        if not text:
            return [], []
        x = [(i, ranks[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        same = b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode()
        return (x, y) if same else ([], [])
    return tokens


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(docs, tokens):
    per, holds = [], Counter()
    for d, text in docs:
        a, b = map(spans, tokens(text))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in a if start <= s and e <= c) + "|" + ",".join(str(i) for i, s, e in b if start <= s and e <= c))
            start = c
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        holds.update(set(links))
        per.append((d, len(a), len(b), groups, links))
    most = {}
    for (a, _), n in holds.items():
        most[a] = max(n, most.get(a, 0))
    return Counter((d, na, nb, len(g), len(k), sum(holds[x] == most[x[0]] for x in k), sum(holds[x] for x in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, k in per)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b\tc", "x    y", "▁", "a▁b c", "<s>hi</s> <unk> <0x41>", "<|endoftext|> end",
       "a\x00b", "﻿x", "ﬁ ① é é", "日本語のテキスト と 漢字", "😀😀 👩‍👩‍👧 ok", "It's we'll I'D 1234567 3.14", "a" * 300, " " * 50 + "end", "z" + "　" * 9 + "z",
       "Ünïcödé straße Привет мир", "a   b\u0085c", "\r\n\r\n x"]


def docs(seed):
    rnd = random.Random(seed)
    words = ["the", "of", "Haus", "übermäßig", "éclair", "mañana", "running", "x86", "naïve", "Ω", "привет", "日本", "don't", "-", "--", "\n", "\t", "", "  ", "😀"]
    out = [(k, t) for k, t in enumerate(ODD)]
    out += [(100 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(60)]
    return [*out, (None, "the end of the line"), (5, "the end of the line"), (5, "the end of the line")]


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, plain, seed):
    rows = docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, plain)
    assert got(al.align_corpus(df, RANKS, files.PATTERN, PIECES)) == want
    # counts brought in many rounds
    assert got(al.align_corpus(df, RANKS, files.PATTERN, PIECES, pairs_per_round=40)) == want


def test_long_text_and_small_memory(plain):
    a = al.Aligner(open(RANKS, "rb").read(), files.PATTERN, open(PIECES, "rb").read(), 50)
    text = " ".join(t for _, t in docs(7) if t and "▁" not in t) * 30
    for _ in range(2):
        out = a.align([text, None, "short one"])
        x, y = plain(text)
        assert out["n_a"].tolist()[:2] == [len(x), 0] and out["n_b"][0] == len(y)
        pairs, times = al.unpack_links(out["links"][0])
        links, (p, q) = Counter(), map(spans, (x, y))
        j = 0
        for i, s, e in p:
            while q[j][2] <= s:
                j += 1
            k = j
            while k < len(q) and q[k][1] < e:
                links[i << 20 | q[k][0]] += 1
                k += 1
        assert dict(zip(pairs.tolist(), times.tolist())) == links and out["n_links"][0] == sum(links.values())


def test_shared_ends_by_division():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 200):
        for share in (0.02, 0.3, 1.0):
            a_all, b_all, af, at, bf, bt = [], [], [], [], [], []
            base = 0
            for _ in range(6):
                size = int(rng.integers(n, 4 * n + 1))
                common = rng.choice(size, max(1, int(share * size)), replace=False)
                a = np.unique(np.concatenate([common, rng.choice(size, n), [size]])) + base
                b = np.unique(np.concatenate([common, rng.choice(size, n), [size]])) + base
                af.append(len(a_all)), bf.append(len(b_all))
                a_all += a.tolist()
                b_all += b.tolist()
                at.append(len(a_all)), bt.append(len(b_all))
                base += size + 1
            a, b = np.array(a_all), np.array(b_all)
            got = al.shared_ends(a, b, *map(np.array, (af, at, bf, bt)))
            assert a[got].tolist() == sorted(set(a_all) & set(b_all))


def test_links_pack_and_unpack():
    pairs = np.array([3 << 20 | 7, 3 << 20 | 9, 70_000 << 20 | 31_999])
    p, t = al.unpack_links(al.pack_links(pairs, np.array([1, 500, 70_000])))
    assert p.tolist() == pairs.tolist() and t.tolist() == [1, 500, 70_000] and al.unpack_links(b"")[0].size == 0


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert al.align_corpus(empty, RANKS, files.PATTERN, PIECES).count() == 0
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id int, text string").select("*", F.lit(3).alias("row"), F.lit("x").alias("links"), F.lit(0).alias("n_a"))
    assert [tuple(r)[:2] for r in al.align_corpus(df, RANKS, files.PATTERN, PIECES).orderBy("doc_id").collect()] == [(1, 2), (2, 0)]


def test_table(spark, sf_dir, plain):
    from causeway.llm.common import read
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect() if r.text is None or len(r.text) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(al.align_corpus(df, RANKS, files.PATTERN, PIECES)) == brute(rows, plain)
    assert al.op12_token_alignment(spark, sf_dir).count() == read(spark, sf_dir, "documents").count()
