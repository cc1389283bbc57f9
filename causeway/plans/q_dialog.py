"""Queries over dialog turns (``conversations``) and token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions.text import PY_WHITESPACE
from causeway.operators import dialog as D
from causeway.plans import tables as TB
from causeway.plans.registry import r6, register

_TRIM_SET = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def _strip_sql(e):
    return f"trim({e}, {_TRIM_SET})"


_TAGS_SQL = " OR ".join(f"contains(text, '{t}')" for t in D.SPECIAL_TAGS)

DIALOG_RENDER_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
f AS (SELECT conv_id, min(turn) AS t0, max(turn) AS t1, count(*) AS n, arg_max(role, turn) AS last_role,
             arg_min(role, turn) AS first_role FROM c GROUP BY conv_id),
j AS (SELECT c.*, f.t0, f.t1, f.n, f.last_role, f.first_role = 'system' AS has_sys FROM c JOIN f USING (conv_id)),
v AS (SELECT conv_id,
             bool_and(CASE WHEN has_sys AND turn = t0 THEN true
                           ELSE coalesce(role = CASE WHEN (turn - t0 - CASE WHEN has_sys THEN 1 ELSE 0 END) % 2 = 0
                                                     THEN 'user' ELSE 'assistant' END, false) END) AS rows_ok,
             any_value(last_role) AS last_role, any_value(n) AS n, any_value(t0) AS t0, any_value(t1) AS t1,
             any_value(has_sys) AS has_sys
      FROM j GROUP BY conv_id),
vv AS (SELECT conv_id, coalesce(rows_ok AND last_role = 'user' AND t1 - t0 + 1 = n
                                AND n - CAST(has_sys AS INTEGER) >= 1, false) AS valid FROM v),
u AS (SELECT conv_id, bool_or(coalesce({_TAGS_SQL}, false)) AS unsafe FROM c GROUP BY conv_id),
st AS (SELECT conv_id, arg_min(text, turn) AS sys_text FROM c WHERE role = 'system' GROUP BY conv_id),
fo AS (SELECT j.conv_id, j.turn - t0 - CASE WHEN has_sys THEN 1 ELSE 0 END AS turn, role,
              CASE WHEN has_sys AND j.turn = t0 + 1
                   THEN '<<SYS>>' || chr(10) || st.sys_text || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text
                   ELSE text END AS text
       FROM j LEFT JOIN st USING (conv_id) WHERE NOT (has_sys AND j.turn = t0)),
pc AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[INST] ' || {_strip_sql('text')} || ' [/INST]'
                                  ELSE ' ' || {_strip_sql('text')} || ' ' END AS piece FROM fo),
pr AS (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS prompt FROM pc GROUP BY conv_id)
SELECT vv.conv_id, vv.valid, u.unsafe, CASE WHEN vv.valid THEN pr.prompt END AS prompt,
       CASE WHEN u.unsafe THEN '{D.UNSAFE_ERROR}' END AS output_text
FROM vv JOIN u USING (conv_id) LEFT JOIN pr USING (conv_id)
"""


@register("dialog_render_conversations", DIALOG_RENDER_SQL)
def dialog_render_conversations(spark, sf):
    """M1 + M2 + M3 + M4: tag screen, role validation, system fold, instruction format."""
    c = TB.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return D.dialog_state(c).withColumn("output_text", F.when(F.col("unsafe"), F.lit(D.UNSAFE_ERROR)))


HEADER_SQL = f"""
SELECT conv_id, '{D.BEGIN_OF_TEXT}' || string_agg('{D.START_HEADER}' || role || '{D.END_HEADER}' || chr(10) || chr(10)
                                                   || {_strip_sql('text')} || '{D.END_OF_TURN}', '' ORDER BY turn)
       || '{D.START_HEADER}assistant{D.END_HEADER}' || chr(10) || chr(10) AS prompt
FROM conversations GROUP BY conv_id
"""


@register("dialog_header_conversations", HEADER_SQL)
def dialog_header_conversations(spark, sf):
    """M5: header-format rendering of every conversation."""
    c = TB.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return D.render_header(c)


N_PROMPT, MAX_GEN = 2, 40
STOP_TOKENS = ("the", "der", "la", "el")


def _stop_sql():
    pos = ", ".join(f"list_position(w, '{s}')" for s in STOP_TOKENS)
    return f"list_min(list_filter([{pos}], lambda p: p IS NOT NULL AND p > 0))"


TRIM_SQL = f"""
WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS tokens FROM conversations),
w AS (SELECT conv_id, turn, list_slice(tokens, {N_PROMPT} + 1, least({N_PROMPT} + {MAX_GEN}, len(tokens))) AS w FROM t),
s AS (SELECT conv_id, turn, w, {_stop_sql()} AS fp FROM w),
k AS (SELECT conv_id, turn, CASE WHEN fp IS NULL THEN w ELSE list_slice(w, 1, fp - 1) END AS kept FROM s)
SELECT conv_id, turn, CAST(len(kept) AS INTEGER) AS n_kept, array_to_string(kept, ' ') AS kept_text,
       round(CAST(coalesce(list_sum(list_transform(kept, lambda x: -length(x))), 0) AS DOUBLE), 6) AS logprob
FROM k
"""


@register("completion_trim_conversations", TRIM_SQL)
def completion_trim_conversations(spark, sf):
    """M7 + C25: drop prompt tokens, cap at prompt + max_gen, cut at the first stop
    token (tokens and log-probs together); sum the kept log-probs."""
    c = TB.table(spark, sf, "conversations")
    t = c.select("conv_id", "turn", F.split("text", " ").alias("tokens"))
    t = t.withColumn("logprobs", F.transform("tokens", lambda w: -F.length(w).cast("double")))
    t = t.withColumn("_r", A.trim_completion("tokens", N_PROMPT, MAX_GEN, STOP_TOKENS))
    kept = F.slice("tokens", F.col("_r.start") + 1, F.col("_r.length"))
    return t.select("conv_id", "turn", F.size(kept).cast("int").alias("n_kept"),
                    F.array_join(kept, " ").alias("kept_text"),
                    r6(A.slice_sum("logprobs", F.col("_r.start"), F.col("_r.length"))).alias("logprob"))


@register("piece_counts_documents")
def piece_counts_documents(spark, sf):
    """M8: pre-token piece counts over the whole corpus (no SQL oracle: the pattern
    needs look-ahead, which DuckDB's regex engine lacks)."""
    d = TB.table(spark, sf, "documents").select("text")
    return D.piece_counts(d)
