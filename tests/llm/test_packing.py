"""Packing: plans against exhaustive search, pieces against the tokenizer's own ids."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from causeway.llm import packing as pk

PATH = P.path("byte_bpe_50k.json")


def test_best_fill_is_the_closest_multiset():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 60)
        got = pk.best_fill(dict(counts), room)
        assert all(0 < n <= counts[x] for x, n in got.items())
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values()))
                   if (s := sum(x * k for x, k in zip(counts, c))) <= room)
        assert sum(x * n for x, n in got.items()) == best


def fill(counts):
    """Follows a plan: (windows, ids in them), each window within the capacity, all remainders and tails used."""
    plan, stock, ids = pk.plan_windows(dict(counts)), dict(counts), 0
    for step in plan:
        size = sum(x * n for x, n in step.window.items()) + step.piece
        assert step.times > 0 and size <= 1024 and (step.piece == 0 or size == 1024)
        for x, n in [*step.window.items(), *([(step.cut, 1)] if step.cut else [])]:
            stock[x] -= n * step.times
            assert stock[x] >= 0
        if step.cut:
            assert 0 < step.piece < step.cut
            stock[step.cut - step.piece] = stock.get(step.cut - step.piece, 0) + step.times
        ids += size * step.times
    assert not any(stock.values()) and ids == sum(x * c for x, c in counts.items())
    return sum(s.times for s in plan), ids


def test_plan_uses_every_remainder():
    rnd = random.Random(3)
    fill({x: rnd.randint(0, 40) for x in range(1, 1024)} | {700: 5000})
    assert pk.plan_windows({}) == [] and fill({5: 1}) == (1, 5)
    for _ in range(200):
        fill({rnd.randint(1, 1023): rnd.randint(1, 50) for _ in range(rnd.randint(1, 8))})


def test_padding_is_small_whatever_the_lengths():
    for counts in ({x: 100 for x in range(1, 1024)}, {600: 10_000}, {513: 10_000}, {514: 10_000}, {x: 5 for x in range(520, 1024)}):
        windows, ids = fill(counts)
        assert windows * 1024 - ids < 0.01 * ids


def test_places_follow_the_plan():
    rnd = random.Random(8)
    for _ in range(30):
        counts = {rnd.randint(1, 1023): rnd.randint(1, 60) for _ in range(rnd.randint(1, 6))}
        places = pk.Places(pk.plan_windows(dict(counts)), counts)
        length = np.array([x for x, c in counts.items() for _ in range(c)])
        rank = np.array([r for c in counts.values() for r in range(c)])
        by, got = {}, {}
        for which, start, size, sequence, offset in places.of(length, rank):
            for w, a, n, q, o in zip(*(x.tolist() for x in (which, start, size, sequence, offset))):
                by.setdefault(q, []).append((o, n))
                assert got.get(w, 0) == a
                got[w] = a + n
        assert [got[w] for w in range(len(length))] == length.tolist() and sorted(by) == list(range(places.sequences))
        for parts in by.values():
            parts.sort()
            assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]


def encoded(ids, texts):
    flat, n = ids.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_ids_equal_the_tokenizer():
    tk = Tokenizer.from_file(PATH)
    ids = pk.TokenIds(open(PATH, "rb").read(), memo=300)
    rnd = random.Random(1)
    texts = ["", " ", "a  b", "x \n y\n", "été 你好 ½", "<|endoftext|> a<|endoftext|>", "x <|endoftext|>  y", "it's", " lead", "a　 b 🙂🙂 c", "\x00a \x00b", "\x00a"]
    texts += ["".join(rnd.choice("aabcdeé \n\t's.,!#1½🙂") for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        assert encoded(ids, part) == [e.ids for e in tk.encode_batch(part, add_special_tokens=False)]


def test_blanks_beside_other_white_space_equal_the_tokenizer():
    tk = Tokenizer.from_file(PATH)
    ids = pk.TokenIds(open(PATH, "rb").read(), memo=300)
    rnd = random.Random(13)
    texts = ["x \u00a0 \u00a0 \u00a0y", "x \t \ty z", "x\u3000 \u3000 y", " \u00a0 x", "x \u00a0", "x  \u00a0  y  z  "]
    texts += ["".join(rnd.choice(["a", "b1", ".", " \u00a0", "\u00a0 ", " \t", " x", "\u3000", " y z", "\x1c", "  "]) for _ in range(rnd.randint(1, 30)))
              for _ in range(3000)]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        assert encoded(ids, part) == [e.ids for e in tk.encode_batch(part, add_special_tokens=False)]


def check_pieces(rows, docs):
    """Every id of every document in one piece, every sequence gapless and within 1024."""
    tk = Tokenizer.from_file(PATH)
    of, by = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for d, t in docs:
        ids, at = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        left = of[d, len(ids)]
        while at < len(ids):
            # repeated rows may be cut in different places: take a piece that goes on from here
            piece = next(p for p in left if p[0] == at and p[2] == zlib.crc32(ids[at:at + p[1]].tobytes()))
            left.remove(piece)
            at += piece[1]
        assert at == len(ids)
    assert not any(of.values())
    pad = total = 0
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
        total += end
        pad += 0 if end & (end - 1) == 0 else 1024 - end
    return pad / max(1, total)


def test_pack(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "ürn", "x1"]) for _ in range(rnd.randint(0, 1500)))) for i in range(400)]
    docs += [(None, None), (None, ""), (5, docs[5][1]), (401, "same text here")] + [(500 + i, docs[7][1]) for i in range(150)]
    docs += [(900, "a b " * 3000), (901, "end <|endoftext|> of <|endoftext|>")]
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, rest string, start int").repartition(5)
    rows = pk.pack(df, PATH).collect()
    assert check_pieces(rows, docs) < 0.01
    assert pk.pack(df.limit(0), PATH).count() == 0


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_pieces(pk.op6_packing(spark, sf_dir).collect(), docs) < 0.01
