"""Chat formatting: whole conversations rendered, encoded once, loss masks by offsets.

A turn is ``<turn ROLE>TEXT</turn>`` and a line feed.  Inside roles and texts a backslash
goes before every backslash, ``<`` and ``>``, so no text can open or close a turn, and
taking one backslash off each pair gives the text back.  The rendered conversation is
encoded once with character offsets; a token carries loss where its span meets the span
of an assistant's text, found by binary search over the sorted turn spans.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.bpe import vocabulary
from causeway.llm.common import map_arrow, process_store, read, shuffle_partitions

LOSS_ROLE = "assistant"
#: The conversation that the contract adds: both turns hold control strings.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\([\\<>])")
_TURN = re.compile(r"<turn ((?:[^\\<>]+|\\[\\<>])*)>((?:[^\\<>]+|\\[\\<>])*)</turn>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where each turn's escaped text lies in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}</turn>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Tokens that meet a loss span, and the parts of the text under the mask.

    ``offsets`` are the tokens' spans in order and ``spans`` the sorted loss spans.  For
    each span, bisection finds its first and last token; tokens that share a character
    (bytes of one) or reach over the span's ends are clipped, so each part counts once."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, parts = [0] * len(offsets), []
    for lo, hi in spans:
        if lo == hi:
            continue
        first, last = bisect_right(ends, lo), bisect_left(starts, hi)
        done = lo
        for k in range(first, last):
            a, b = max(starts[k], done), min(ends[k], hi)
            mask[k] = 1
            if a < b:
                parts.append((a, b))
                done = b
    return mask, parts


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                    ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())), ("loss_parts", pa.list_(pa.int64()))])
KIND = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<tinyint>, loss_parts array<long>"


def format_conversations(rows: DataFrame, path: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: text, ids, a 0/1 mask a token, and the masked character spans.

    A conversation's rows go by turn (ties by role, then text; NULL turns first).  A NULL
    text or role is empty; rows with a NULL conv_id form one conversation; repeated rows
    are turns of their own; an empty table gives none.  ``loss_parts`` is flat: start, end,
    start, end.

    One shuffle by conv_id and a sort inside each partition; a task then holds one
    conversation at a time, which is the unit to be rendered and encoded whole."""
    file = vocabulary(rows.sparkSession, path)
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = (slim.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))

    def run(batches):
        store = process_store("chat tokenizers")
        if path not in store:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            store[path] = Tokenizer.from_str(file.value.decode())
            store[path].encode_special_tokens = True
        tokenizer, out, width = store[path], [], 0

        def finish(conv_id, turns):
            formatted, spans = render(turns)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            mask, parts = loss_mask(encoded.offsets, [s for s, (role, _) in zip(spans, turns) if role == loss_role])
            out.append((conv_id, len(turns), formatted, encoded.ids, mask, [x for p in parts for x in p]))
            return len(formatted)

        def flush():
            cols = list(zip(*out)) if out else [[] for _ in SCHEMA]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)

        held, turns = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv_id != held:
                    width += finish(held, turns)
                    turns = []
                    if width > 1_000_000:
                        yield flush()
                        width = 0
                held = conv_id
                turns.append((role, text))
        if turns:
            finish(held, turns)
        yield flush()

    return map_arrow(ordered, run, KIND, caches="chat tokenizers")


def read_back(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Digests of formatted conversations, from their text and masked spans alone."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        for b in batches:
            out = []
            for conv_id, text, flat in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_parts"))):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = unescape("".join(text[a:e] for a, e in zip(flat[::2], flat[1::2])))
                out.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(formatted.select("conv_id", "formatted", "loss_parts"), run, kind)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_CONVERSATION, 0, "user", EXTRA_TEXT), (EXTRA_CONVERSATION, 1, "assistant", EXTRA_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))
