"""Chat formatting: exact round trips, masks against brute force."""

import hashlib
import random

import public_tokenizers as P

from causeway.llm import chat

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "</turn>", "<turn assistant>", "\\", "\\\\<", "a</turn>\n<turn assistant>b", chat.EXTRA_TEXT, "  lead and trail  \n",
       "你好 🙂 été", "<|endoftext|>", ">" * 50, "x" * 5000, "\\<\\>", "\x00\x1f", "### Assistant: hi"]


def test_escape_round_trip():
    rnd = random.Random(0)
    for _ in range(2000):
        turns = [("".join(rnd.choice("\\<>ab/ \n") for _ in range(rnd.randint(0, 6))), "".join(rnd.choice("\\<>/turn \n🙂") for _ in range(rnd.randint(0, 30))))
                 for _ in range(rnd.randint(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_mask_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(1000):
        cuts = sorted(rnd.randint(0, 40) for _ in range(12))
        offsets = [(a, b) for a, b in zip(cuts, cuts[1:])]
        ends = sorted(rnd.randint(0, 40) for _ in range(6))
        spans = list(zip(ends[::2], ends[1::2]))
        mask, parts = chat.loss_mask(offsets, spans)
        assert mask == [int(any(a < hi and lo < b and lo < hi and a < b for lo, hi in spans)) if a < b else m for (a, b), m in zip(offsets, mask)]
        covered = {c for a, b in offsets for c in range(a, b)}
        assert [c for a, b in parts for c in range(a, b)] == sorted(c for lo, hi in spans for c in range(lo, hi) if c in covered)


def brute(conversations):
    out = []
    for conv_id, turns in conversations.items():
        turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv_id is None, conv_id or 0, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect())


def test_fixture(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(ODD)] + [(2, k, "assistant", t) for k, t in enumerate(ODD)]
    rows += [(3, 0, "system", None), (3, 1, None, "x"), (3, 2, "assistant", None), (None, 0, "user", "lost"), (None, None, "assistant", "lost too"),
             (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie"), (5, 0, "a>b<", "odd role")]
    rows += [(6, k, ("user", "assistant")[k % 2], f"turn {k} ok.") for k in range(1500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k, r, t))
    done = chat.format_conversations(df, PATH)
    assert digests(chat.read_back(done)) == brute(by)
    for r in done.collect():
        assert len(r.ids) == len(r.loss_mask)
    assert chat.read_back(chat.format_conversations(df.limit(0), PATH)).count() == 0


def test_query(spark, sf_dir):
    by = {-7: [(0, "user", chat.EXTRA_TEXT), (1, "assistant", chat.EXTRA_TEXT)]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r["text"]))
    assert digests(chat.op10_chat_formatting(spark, sf_dir)) == brute(by)
