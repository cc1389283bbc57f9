"""Dialog and generated-sequence tables (M1-M8).

A dialog is a table of turns ``(conv_id, turn, role, text)``; turn numbers are the
message positions (0-based, consecutive).  A dialog is gathered once, in turn order, and
screened, checked, folded and rendered as expressions over its array of messages; the
rendered prompt, which holds all of them, is its output value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.arrays import let
from causeway.functions.text import strip as text_strip

# Instruction-format tags, the system wrapper, the control tags that
# make a dialog unsafe and the error text that replaces its output; header-format
# special tokens.
B_INST, E_INST = "[INST]", "[/INST]"
B_SYS, E_SYS = "<<SYS>>\n", "\n<</SYS>>\n\n"
SPECIAL_TAGS = (B_INST, E_INST, "<<SYS>>", "<</SYS>>")
UNSAFE_ERROR = "Error: special tags are not allowed as part of the prompt."
BEGIN_OF_TEXT = "<|begin_of_text|>"
START_HEADER, END_HEADER, END_OF_TURN = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
# Fixed value: published pre-token split pattern of the header-format tokenizer (Java regex accepts it).
PIECE_PATTERN = (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*"
                 r"|\s*[\r\n]+|\s+(?!\S)|\s+")

def strip(c):
    """Python ``str.strip()`` (whitespace character-set trim)."""
    return text_strip(c)


# ------------------------------------------------------------------ one dialog as an array of its turns

def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages): a dialog's messages (turn, role, text) in turn order.  One shuffle;
    everything about a dialog is then an expression over this array."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.groupBy(conv).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def unsafe_messages(m: Column) -> Column:
    """M1: a message contains a control tag."""
    return F.exists(m, lambda x: F.coalesce(reduce(lambda a, b: a | b, [x["text"].contains(t) for t in SPECIAL_TAGS]), F.lit(False)))


def led_by_system(m: Column) -> Column:
    return F.coalesce(F.element_at(m, 1)["role"] == "system", F.lit(False))


def folded_messages(m: Column) -> Column:
    """M3: a leading system message is folded into the next one's text with the system wrapper."""
    system = F.concat(F.lit(B_SYS), F.element_at(m, 1)["text"], F.lit(E_SYS))
    rest = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))
    fold = let(system, lambda s: F.transform(rest, lambda x, i: F.struct(
        x["turn"].alias("turn"), x["role"].alias("role"), F.when(i == 0, F.concat(s, x["text"])).otherwise(x["text"]).alias("text"))))
    return F.when(led_by_system(m), fold).otherwise(m)


def valid_messages(m: Column, folded: Column) -> Column:
    """M2: after an optional leading system message user and assistant alternate, user first
    and last, and turn numbers are consecutive."""
    roles = F.transform(folded, lambda x, i: F.coalesce(x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)))
    whole = F.element_at(m, -1)["turn"] - F.element_at(m, 1)["turn"] + 1 == F.size(m)
    return F.coalesce(F.forall(roles, lambda ok: ok) & (F.size(folded) % 2 == 1) & whole, F.lit(False))


def inst_text(folded: Column) -> Column:
    """M4: ``[INST] u [/INST] a `` per pair, then the open last user turn; contents stripped."""
    def piece(x):
        c = strip(x["text"])
        return F.when(x["role"] == "user", F.concat(F.lit(B_INST + " "), c, F.lit(" " + E_INST))).otherwise(F.concat(F.lit(" "), c, F.lit(" ")))
    return F.array_join(F.transform(folded, piece), "")


def dialog_state(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """M1-M4 in one grouped pass: (conv, valid, unsafe, prompt), the prompt of valid dialogs."""
    g = gather(turns, conv, turn, role, text)

    def judge(b):
        valid = valid_messages(b["m"], b["f"])
        return F.struct(valid.alias("valid"), unsafe_messages(b["m"]).alias("unsafe"), F.when(valid, inst_text(b["f"])).alias("prompt"))
    state = let(F.struct(F.col("messages").alias("m"), folded_messages(F.col("messages")).alias("f")), judge)
    return g.select(conv, F.inline(F.array(state)))


def screen_tags(turns: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """M1: a conversation is unsafe if any message contains a control tag (a map-side
    combined flag; no dialog is gathered)."""
    hit = reduce(lambda a, b: a | b, [F.col(text).contains(t) for t in SPECIAL_TAGS])
    return turns.groupBy(conv).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("unsafe"))


def validate_roles(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """M2: (conv, valid)."""
    g = gather(turns.withColumn("_none", F.lit("")), conv, turn, role, "_none")
    return g.select(conv, valid_messages(F.col("messages"), folded_messages(F.col("messages"))).alias("valid"))


def fold_system(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """M3: the messages after the fold, renumbered from 0."""
    g = gather(turns, conv, turn, role, text)
    m = g.select(conv, F.posexplode(folded_messages(F.col("messages"))).alias("_at", "_m"))
    return m.select(conv, F.col("_at").alias(turn), F.col("_m.role").alias(role), F.col("_m.text").alias(text))


def _ordered_concat(df: DataFrame, conv: str, turn: str, piece: str, out: str) -> DataFrame:
    return df.groupBy(conv).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(piece).alias("p")))),
                                 lambda s: s["p"]), "").alias(out))


def render_inst(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """M4 (on valid dialogs, after M3): (conv, prompt)."""
    g = gather(turns, conv, turn, role, text)
    return g.select(conv, inst_text(folded_messages(F.col("messages"))).alias("prompt"))


def render_header(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """M5: begin tag, then per message header + stripped content + end-of-turn, then an
    open assistant header."""
    piece = F.concat(F.lit(START_HEADER), F.col(role), F.lit(END_HEADER + "\n\n"), strip(F.col(text)),
                     F.lit(END_OF_TURN))
    body = _ordered_concat(turns.withColumn("_piece", piece), conv, turn, "_piece", "_body")
    return body.select(conv, F.concat(F.lit(BEGIN_OF_TEXT), F.col("_body"),
                                      F.lit(START_HEADER + "assistant" + END_HEADER + "\n\n")).alias("prompt"))


def system_user_pair(df: DataFrame, system_prompt: str, text: str, out: str = "dialog") -> DataFrame:
    """M6: wrap a post into a [system, user] message array."""
    return df.withColumn(out, F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(text).alias("content"))))


def piece_counts(docs: DataFrame, text: str = "text", by=()) -> DataFrame:
    """M8: pre-token pieces (published split pattern) counted per group / corpus."""
    return (docs.select(*by, F.explode(F.regexp_extract_all(F.col(text), F.lit(PIECE_PATTERN), 0)).alias("piece"))
            .groupBy(*by, "piece").agg(F.count("*").alias("n")))
