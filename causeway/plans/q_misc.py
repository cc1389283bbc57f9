"""Queries for the remaining scalar, code, attribute, grid and evaluation operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import codes as C
from causeway.functions import text as T
from causeway.functions.draws import sql_uniform, uniform
from causeway.operators import clean, discretize, estimators, evaluate, grid, sampling
from causeway.plans import tables as TB
from causeway.plans.registry import cte, r6, register
from causeway.sources import io
from causeway.spec import EMAIL, StudySpec

# ------------------------------------------------------------------ C2 thread keys

KEYS_SQL = """
SELECT page_id, string_split(url, '/')[-2] AS submission_key, string_split(url, '/')[-3] AS comment_key FROM pages
"""


@register("thread_keys_pages", KEYS_SQL)
def thread_keys_pages(spark, sf):
    """Thread key segments of a permalink-like path (segment -2 / -3)."""
    p = TB.table(spark, sf, "pages")
    return p.select("page_id", T.thread_key("url", is_comment=False).alias("submission_key"),
                    T.thread_key("url", is_comment=True).alias("comment_key"))


# ------------------------------------------------------------------ A8 resume

TODO_SQL = """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""


@register("todo_documents", TODO_SQL)
def todo_documents(spark, sf):
    """Documents not yet labelled (left anti-join on the key)."""
    return io.todo(TB.table(spark, sf, "documents").select("doc_id"), TB.table(spark, sf, "labels"), "doc_id")


# ------------------------------------------------------------------ A10 array text

ARRAY_TEXT_SQL = """
WITH t AS (SELECT vec_id,
                  '[' || array_to_string(list_transform(embedding[1:32], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ' ')
                  || chr(10) || ' ' ||
                  array_to_string(list_transform(embedding[33:64], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ' ')
                  || ']' AS txt FROM embeddings),
p AS (SELECT vec_id, list_transform(list_filter(string_split_regex(regexp_replace(txt, '^[\\[\\s]+|[\\]\\s]+$', '', 'g'),
                                                                  '\\s+'), lambda s: s <> ''),
                                    lambda s: TRY_CAST(s AS DOUBLE)) AS arr FROM t)
SELECT vec_id, CAST(len(arr) AS INTEGER) AS n, round(list_sum(arr), 6) AS total FROM p
"""


@register("array_text_embeddings", ARRAY_TEXT_SQL)
def array_text_embeddings(spark, sf):
    """A10: printed-array text (with a line break) parsed back to ARRAY<DOUBLE>."""
    e = TB.table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    fmt = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x)), " ")
    txt = F.concat(F.lit("["), fmt(F.slice(v, 1, 32)), F.lit("\n "), fmt(F.slice(v, 33, 32)), F.lit("]"))
    arr = A.parse_array_text(txt)
    return e.select("vec_id", F.size(arr).cast("int").alias("n"), r6(A.array_sum(arr)).alias("total"))


# ------------------------------------------------------------------ E9 / E10 distinct classes

CLASSES_SQL = """
SELECT 'lang' AS field, CAST(count(DISTINCT lang) AS BIGINT) AS n_classes,
       array_to_string(list_sort(list_distinct(list(lang))), ',') AS classes FROM documents
UNION ALL
SELECT 'source', CAST(count(DISTINCT source) AS BIGINT), array_to_string(list_sort(list_distinct(list(source))), ',')
FROM documents
"""


@register("classes_documents", CLASSES_SQL)
def classes_documents(spark, sf):
    """E9 + E10: distinct values and their count per field."""
    fields = ("lang", "source")
    d = TB.table(spark, sf, "documents").select(F.stack(F.lit(len(fields)), *[x for f in fields for x in (F.lit(f), F.col(f))]).alias("field", "value"))
    # one scan; distinct (field, value) rows first, so only those meet
    distinct = d.groupBy("field", "value").count().where("value is not null")
    return distinct.groupBy("field").agg(F.count("*").cast("bigint").alias("n_classes"),
                                         F.array_join(F.array_sort(F.collect_list("value")), ",").alias("classes"))


# ------------------------------------------------------------------ C27 known-value coalesce

COALESCE_SQL = """
WITH k AS (SELECT event_id, CASE WHEN value > 50 THEN NULL
                                 ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events),
i AS (SELECT event_id, round(value) AS k FROM events)
SELECT k.event_id, coalesce(k.k, i.k) AS k FROM k LEFT JOIN i USING (event_id)
"""


@register("coalesce_known_events", COALESCE_SQL)
def coalesce_known_events(spark, sf):
    """Extracted value wins, inferred value fills NULLs (aligned by key)."""
    e = TB.table(spark, sf, "events")
    known = discretize.parse_answers(e.select("event_id", "props", "value"), "props", ["k"])
    known = known.select("event_id", F.when(F.col("value") > 50, F.lit(None))
                         .otherwise(C.to_number("k")).alias("k"))
    inferred = e.select("event_id", F.round("value").alias("k"))
    return discretize.coalesce_known(known, inferred, "event_id", ["k"])


# ------------------------------------------------------------------ C8 trial recodes

TRIAL_RAW_SQL = """
SELECT o.o_orderkey AS unit_id,
       CASE CAST(floor(o.o_totalprice / 50000) AS INTEGER) WHEN 0 THEN '1) $0 - $100' WHEN 1 THEN '2) $100 - $200'
            WHEN 2 THEN '3) $200 - $350' WHEN 3 THEN '4) $350 - $500' WHEN 4 THEN '5) $500 - $750'
            WHEN 5 THEN '6) $750 - $1000' ELSE '7) $1000 +' END AS history_segment,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'Suburban' WHEN 1 THEN 'Rural' ELSE 'Urban' END AS zip_code,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Phone' WHEN '2-HIGH' THEN 'Web' ELSE 'Multichannel' END AS channel,
       CASE o.o_orderstatus WHEN 'F' THEN 'Womens E-Mail' WHEN 'O' THEN 'Mens E-Mail' ELSE 'No E-Mail' END AS treatment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

RECODE_SQL = f"""
WITH {cte('r', TRIAL_RAW_SQL)}
SELECT unit_id,
       CAST(CASE history_segment WHEN '1) $0 - $100' THEN 0 WHEN '2) $100 - $200' THEN 1 WHEN '3) $200 - $350' THEN 2
            WHEN '4) $350 - $500' THEN 3 WHEN '5) $500 - $750' THEN 4 WHEN '6) $750 - $1000' THEN 5 ELSE 6 END AS INTEGER)
           AS history_segment,
       CAST(CASE zip_code WHEN 'Suburban' THEN 0 WHEN 'Rural' THEN 1 ELSE 2 END AS INTEGER) AS zip_code,
       CAST(CASE channel WHEN 'Phone' THEN 0 WHEN 'Web' THEN 1 ELSE 2 END AS INTEGER) AS channel,
       CAST(CASE treatment WHEN 'Womens E-Mail' THEN 1 WHEN 'No E-Mail' THEN 0 WHEN 'Mens E-Mail' THEN 1 END AS INTEGER)
           AS treatment_binary,
       CAST(CASE treatment WHEN 'Womens E-Mail' THEN 0 WHEN 'Mens E-Mail' THEN 1 WHEN 'No E-Mail' THEN 2 END AS INTEGER)
           AS treatment
FROM r
"""


@register("recode_trial_orders", RECODE_SQL)
def recode_trial_orders(spark, sf):
    """Trial-table recodes with catch-all codes."""
    r = TB.derived(spark, sf, TRIAL_RAW_SQL, ("orders", "customer"))
    return discretize.recode_email_trial(r).select("unit_id", "history_segment", "zip_code", "channel",
                                                   "treatment_binary", "treatment")


# ------------------------------------------------------------------ C6 / C7 / I10 on coded samples

def _email_codes(spark, sf):
    a = TB.derived(spark, sf, TB.EMAIL_ANSWERS_SQL, TB.EMAIL_NEEDS)
    return discretize.discretize_email(a, seed=10, id_col="unit_id")


def _case_decode(field):
    opts = EMAIL.options[field]
    return "CASE " + field + " " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(opts)) + " END"


_CODE_FIELDS = ("recency", "history", "zip_code", "channel", "visit")


def _codes_sql():
    from causeway.plans.queries import _email_sql
    return _email_sql()


DECODE_SQL = f"""
WITH c AS ({_codes_sql()}),
d AS (SELECT unit_id, {', '.join(f'{_case_decode(f)} AS {f}_label' for f in _CODE_FIELDS)} FROM c)
SELECT unit_id, {', '.join(f'{f}_label' for f in _CODE_FIELDS)},
       {', '.join("CAST(CASE " + f + "_label " + " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(EMAIL.options[f])) + f" END AS INTEGER) AS {f}_code" for f in _CODE_FIELDS)}
FROM d
"""


@register("decode_encode_email_orders", DECODE_SQL)
def decode_encode_email_orders(spark, sf):
    """C7 then C6: codes -> option labels -> codes (round trip over the option lists)."""
    c = _email_codes(spark, sf)
    d = c.select("unit_id", *[C.decode_options(EMAIL.options[f], f).alias(f + "_label") for f in _CODE_FIELDS])
    return d.select("unit_id", *[f + "_label" for f in _CODE_FIELDS],
                    *[C.encode_options(EMAIL.options[f], f + "_label").cast("int").alias(f + "_code")
                      for f in _CODE_FIELDS])


def _uniform_sql():
    def one(f):
        return (f"{f}_d AS (SELECT {f} AS v, row_number() OVER (ORDER BY CAST(floor({sql_uniform(3, 'domain', 'v')} * 256) AS INTEGER), v) - 1 AS k, "
                f"count(*) OVER () AS n FROM (SELECT DISTINCT {f}, {f} AS v FROM c WHERE {f} IS NOT NULL))")
    joins = " ".join(f"JOIN {f}_d ON {f}_d.k = CAST(floor({sql_uniform(3, 'baseline:' + f, 'c.unit_id')} * {f}_d.n) AS BIGINT)" for f in _CODE_FIELDS)
    return f"""
WITH {cte('c', _codes_sql())}, {', '.join(one(f) for f in _CODE_FIELDS)}
SELECT c.unit_id, {', '.join(f'CAST({f}_d.v AS INTEGER) AS {f}' for f in _CODE_FIELDS)} FROM c {joins}
"""


@register("uniform_baseline_orders", _uniform_sql())
def uniform_baseline_orders(spark, sf):
    """Every field replaced by a keyed uniform draw from the codes observed in it."""
    c = _email_codes(spark, sf).select("unit_id", *[F.col(f).cast("int").alias(f) for f in _CODE_FIELDS])
    return sampling.uniform_baseline(c, _CODE_FIELDS, 3, "unit_id")


# ------------------------------------------------------------------ D3 / F2 / D4 lookups by digest and key

POST_SAMPLE_SQL = """
WITH s AS (SELECT d.text, l.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL),
f AS (SELECT text, arg_min(doc_id, doc_id) AS doc_id, arg_min(quality, doc_id) AS quality FROM s GROUP BY text)
SELECT d.doc_id, f.doc_id AS first_sample_id, CAST(f.quality AS INTEGER) AS first_quality FROM documents d LEFT JOIN f USING (text)
"""


@register("post_sample_documents", POST_SAMPLE_SQL)
def post_sample_documents(spark, sf):
    """D3 + F2: each post with the first labelled sample of the same text, met by digest."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    lab = TB.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("quality"))
    samples = d.withColumnRenamed("doc_id", "sample_id").join(lab, "sample_id")
    r = clean.lookup_first(d, samples, "text", "sample_id", ["sample_id", "quality"])
    return r.select("doc_id", "first_sample_id", "first_quality")


ALIGN_SQL = """
SELECT coalesce(vec_id, doc_id) AS unit_id, CASE WHEN doc_id IS NULL THEN 'left' WHEN vec_id IS NULL THEN 'right' ELSE 'both' END AS side,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(quality AS INTEGER) AS quality
FROM embeddings FULL OUTER JOIN labels ON vec_id = doc_id
"""


@register("align_embeddings", ALIGN_SQL)
def align_embeddings(spark, sf):
    """Probability arrays and covariates aligned by unit_id, units of one side audited."""
    e = TB.table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), r6(F.element_at("embedding", 1).cast("double")).alias("first"))
    lab = TB.table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"), F.col("quality").cast("int").alias("quality"))
    return clean.align(e, lab).select("unit_id", "side", "first", "quality")


# ------------------------------------------------------------------ C5 / I7 / I8 / I9 / I11 / B22

X_FIELDS = ("recency", "history", "mens", "womens", "zip_code", "newbie", "channel")
ATTR_SEED, DROP_Q, TRAIT_P = 4, 0.3, 0.5


def _u_key_sql(tag, key_expr, id_expr):
    return (f"(CAST(('0x' || substr(md5('{ATTR_SEED}:{tag}:' || {key_expr} || ':' || CAST({id_expr} AS VARCHAR)), 1, 8))"
            " AS BIGINT) / 4294967296.0)")


def _attr_sql():
    desc = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in EMAIL.descriptions.items())
    unk = ", ".join(f"CASE WHEN {f} IN ('Unknown', 'unknown') THEN NULL ELSE {f} END AS {f}"
                    for f in X_FIELDS + ("email_type", "visit"))
    traits = ", ".join(f"CASE WHEN {sql_uniform(ATTR_SEED, 'trait:' + t, 'unit_id')} < {TRAIT_P} THEN 'High' ELSE 'Low' END AS {t}"
                       for t in sampling.TRAITS)
    return f"""
WITH {cte('a0', TB.EMAIL_ANSWERS_SQL)},
a AS (SELECT unit_id, {unk} FROM a0),
kv AS (UNPIVOT a ON {', '.join(X_FIELDS + ('email_type', 'visit'))} INTO NAME k VALUE v),
keep AS (SELECT * FROM kv
         WHERE (k IN ({', '.join(repr(f) for f in X_FIELDS)}) AND {_u_key_sql('drop', 'k', 'unit_id')} >= {DROP_Q})
            OR (k = 'email_type' AND v = 'Yes') OR k = 'visit'),
txt AS (SELECT unit_id, string_agg(CASE k {desc} ELSE '' END || v || '. ' || chr(10), ''
                                   ORDER BY {_u_key_sql('order', 'k', 'unit_id')}, k, v) AS features_text
        FROM keep GROUP BY unit_id)
SELECT a.unit_id, txt.features_text, {traits} FROM a LEFT JOIN txt USING (unit_id)
"""


@register("attribute_text_orders", _attr_sql())
def attribute_text_orders(spark, sf):
    """B22 + I7 + I8 + I9 + I11 + C5: per unit, non-null covariates each kept with
    probability 0.7, treatment shown only if affirmative, outcome always, order
    shuffled by keyed draws, rendered as description lines; five persona traits."""
    a = clean.unknown_to_null(TB.derived(spark, sf, TB.EMAIL_ANSWERS_SQL, TB.EMAIL_NEEDS))
    xs = F.map_filter(F.create_map(*[x for f in X_FIELDS for x in (F.lit(f), F.col(f))]),
                      lambda k, v: v.isNotNull())                                                   # B22
    kept = sampling.drop_attributes(xs, DROP_Q, X_FIELDS, ATTR_SEED, "unit_id")                      # I7
    z = F.when(F.col("email_type") == "Yes", F.create_map(F.lit("email_type"), F.col("email_type"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    y = F.when(F.col("visit").isNotNull(), F.create_map(F.lit("visit"), F.col("visit"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_concat(kept, z, y)
    entries = sampling.shuffle_attributes(m, ATTR_SEED, "unit_id")                                  # I8
    text = F.when(F.size(entries) > 0, sampling.attribute_text(entries, EMAIL.descriptions, ". \n"))  # C5
    out = a.select("unit_id", text.alias("features_text"))
    return sampling.assign_traits(out, TRAIT_P, ATTR_SEED, "unit_id")                                # I9


# ------------------------------------------------------------------ C19-C22, C24, C30: option scoring inputs

OPT_FIELDS = ("email_type", "visit")


def _option_text_sql():
    parts = ["' ' || chr(10) || chr(10) || '## Questions'"]
    for f in OPT_FIELDS:
        opts = "".join(grid.ANSWER_LETTERS[i] + o + " " for i, o in enumerate(EMAIL.options[f]))
        q = EMAIL.questions[f].replace("'", "''")
        lab = "CASE " + f + " " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(EMAIL.options[f])) + " END"
        parts.append(f"' ' || chr(10) || chr(10) || 'Q: {q} ' || chr(10) || 'Options: {opts} ' || chr(10) || 'A: ' || {lab}")
    return " || ".join(parts)


def _known_sql():
    q = EMAIL.questions["mens"].replace("'", "''")
    return ("' ' || chr(10) || chr(10) || '## Questions and their correct answers' || chr(10) || "
            f"'Q: {q} A: ' || CASE sample_mens WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE '' END || '.'")


OPTIONS_SQL = f"""
WITH s AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS sample_mens
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT CAST(range AS INTEGER) AS cell, CAST(range // 2 AS INTEGER) AS email_type, CAST(range % 2 AS INTEGER) AS visit
      FROM range(4)),
x AS (SELECT s.doc_id, g.cell, g.email_type, g.visit, s.text || {_known_sql()} || {_option_text_sql()} AS prompt
      FROM s CROSS JOIN g),
sc AS (SELECT doc_id, cell, email_type, visit, -CAST(length(prompt) % 7 AS DOUBLE) AS loglik FROM x),
mx AS (SELECT doc_id, max(loglik) AS m FROM sc GROUP BY doc_id),
p AS (SELECT sc.*, exp(loglik - m) / sum(exp(loglik - m)) OVER (PARTITION BY sc.doc_id) AS p
      FROM sc JOIN mx USING (doc_id)),
best AS (SELECT doc_id, max(p) AS posterior FROM p GROUP BY doc_id),
mxc AS (SELECT p.doc_id, min(p.cell) AS max_cell,
               arg_min(CASE p.email_type WHEN 0 THEN 'No' ELSE 'Yes' END, p.cell) AS max_sample_email_type,
               arg_min(CASE p.visit WHEN 0 THEN 'No' ELSE 'Yes' END, p.cell) AS max_sample_visit,
               round(any_value(best.posterior), 6) AS posterior
        FROM p JOIN best USING (doc_id) WHERE p.p = best.posterior GROUP BY p.doc_id),
cum AS (SELECT doc_id, cell, sum(p) OVER (PARTITION BY doc_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS c FROM p),
smp AS (SELECT doc_id, coalesce(min(cell) FILTER (WHERE c > {{SAMPLE_U}}), 3) AS sample_cell FROM cum GROUP BY doc_id)
SELECT mxc.*, CAST(sample_cell AS INTEGER) AS sample_cell,
       CASE sample_cell // 2 WHEN 0 THEN 'No' ELSE 'Yes' END AS sample_email_type,
       CASE sample_cell % 2 WHEN 0 THEN 'No' ELSE 'Yes' END AS sample_visit
FROM mxc JOIN smp USING (doc_id)
""".replace("{SAMPLE_U}", sql_uniform(8, "sample", "doc_id"))


@register("option_scoring_documents", OPTIONS_SQL)
def option_scoring_documents(spark, sf):
    """C19 + C20 + C21 + C22 + D7 + C23 + C24 + C7 + C30: labelled documents with a known
    answer, expanded over the (email_type, visit) option grid into prompts, scored by a
    deterministic stand-in scorer, reshaped to per-document arrays, softmaxed, arg-max
    decoded to labels with its posterior."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    lab = TB.table(spark, sf, "labels").select("doc_id", "quality")
    s = d.join(lab, "doc_id").select("doc_id", "text", (F.col("quality") == 1).cast("int").alias("sample_mens"))
    s = grid.known_answers_text(s, EMAIL, ["mens"])                                                 # C21
    opts = grid.option_prompts(spark, EMAIL, list(OPT_FIELDS)).select("cell", *OPT_FIELDS, "option_text")  # C19/C20
    x = grid.expand_options(s, opts)                                                              # C22
    x = x.withColumn("prompt", F.concat("text", "known_answers", "option_text"))
    scored = x.select("doc_id", "cell", (-(F.length("prompt") % 7)).cast("double").alias("loglik"))
    arr = grid.collect_scores(scored, "doc_id", "cell", "loglik")
    p = arr.withColumn("p", A.softmax("loglik"))
    best = (p.withColumn("max_cell", A.argmax("p")).withColumn("posterior", F.array_max("p"))
            .withColumn("sample_cell", A.draw_index("p", uniform(8, "sample", "doc_id"))))          # I4
    labels = {f: EMAIL.options[f] for f in OPT_FIELDS}
    return best.select("doc_id", F.col("max_cell").cast("int").alias("max_cell"),                  # C30
                       C.decode_options(labels["email_type"], F.floor(F.col("max_cell") / 2)).alias("max_sample_email_type"),
                       C.decode_options(labels["visit"], F.col("max_cell") % 2).alias("max_sample_visit"),
                       r6("posterior").alias("posterior"), F.col("sample_cell").cast("int").alias("sample_cell"),
                       C.decode_options(labels["email_type"], F.floor(F.col("sample_cell") / 2)).alias("sample_email_type"),
                       C.decode_options(labels["visit"], F.col("sample_cell") % 2).alias("sample_visit"))


# ------------------------------------------------------------------ K1 / K2 / K4 / K6 on the embedding arrays

DIST_SQL = """
WITH ex AS (SELECT vec_id AS unit_id, r.pos - 1 AS pos, CAST(embedding[r.pos] AS DOUBLE) AS l
            FROM embeddings CROSS JOIN range(1, 65) AS r(pos)),
mx AS (SELECT unit_id, max(l) AS m FROM ex GROUP BY unit_id),
ee AS (SELECT ex.unit_id, pos, exp(l - m) AS e FROM ex JOIN mx USING (unit_id)),
pf AS (SELECT unit_id, pos, e / sum(e) OVER (PARTITION BY unit_id) AS p FROM ee),
pred AS (SELECT pos, avg(p) AS b FROM pf GROUP BY pos),
am AS (SELECT unit_id, min(pos) AS cell FROM (SELECT unit_id, pos, p, max(p) OVER (PARTITION BY unit_id) AS mp FROM pf)
       WHERE p = mp GROUP BY unit_id),
obs AS (SELECT CAST(r.range AS BIGINT) AS pos, coalesce(count(am.cell), 0) / (SELECT count(*) FROM am) AS a
        FROM range(64) r LEFT JOIN am ON am.cell = r.range GROUP BY r.range),
j AS (SELECT obs.pos, obs.a, coalesce(pred.b, 0) AS b FROM obs LEFT JOIN pred USING (pos))
SELECT round(sum(CASE WHEN a <> 0 THEN a * ln(a / (b + 1e-6)) ELSE 0 END), 6) AS kl,
       round(avg((a - b) * (a - b)), 6) AS mse FROM j
"""


EMB_STUDY = StudySpec(
    name="embeddings", x=("x",), y="y", z="z", strata=("x",), enum=("x",),
    options={"x": [str(i) for i in range(16)], "z": ["0", "1"], "y": ["0", "1"]})


@register("joint_distance_embeddings", DIST_SQL)
def joint_distance_embeddings(spark, sf):
    """K1 + K2 + K4: distance between the empirical joint of arg-max options
    (observed) and the mean predicted joint."""
    from causeway.plans.q_effects import emb_units
    u = emb_units(spark, sf)
    fields = ["x", "z", "y"]
    cells = u.select(A.argmax("p_full").alias("cell"))
    cells = cells.withColumns({"x": F.floor(F.col("cell") / 4), "z": F.floor(F.col("cell") / 2) % 2, "y": F.col("cell") % 2})
    obs = grid.empirical_joint(cells, EMB_STUDY, fields) \
        .select(F.lit(0).alias("trial"), F.col("cell").alias("pos"), F.col("freq").alias("a"))
    pred = estimators.joint_observed(u, "p_full").select(F.lit(0).alias("trial"), "pos", F.col("joint").alias("b"))
    r = evaluate.distribution_distance(obs, pred, "pos", "a", "b")
    return r.select(r6("kl").alias("kl"), r6("mse").alias("mse"))


ACC_TRIALS, ACC_SIZE, ACC_SEED = 3, 200, 321


def _acc_sql():
    from causeway.functions.draws import sql_uniform_seed
    u = sql_uniform_seed(f"{ACC_SEED} + tr.trial", "trial", "e.vec_id")
    return f"""
WITH ex AS (SELECT vec_id AS unit_id, r.pos - 1 AS pos, CAST(embedding[r.pos] AS DOUBLE) AS l
            FROM embeddings CROSS JOIN range(1, 65) AS r(pos)),
am AS (SELECT unit_id, min(pos) AS cell FROM (SELECT unit_id, pos, l, max(l) OVER (PARTITION BY unit_id) AS ml FROM ex)
       WHERE l = ml GROUP BY unit_id),
t AS (SELECT vec_id AS unit_id, CAST(embedding[9] > 0 AS INTEGER) AS z, label AS x,
             CAST(embedding[11] > 0 AS INTEGER) AS y FROM embeddings),
tr AS (SELECT unit_id, trial FROM (
         SELECT e.vec_id AS unit_id, CAST(tr.trial AS INTEGER) AS trial,
                row_number() OVER (PARTITION BY tr.trial ORDER BY {u}, e.vec_id) AS rn
         FROM embeddings e CROSS JOIN range({ACC_TRIALS}) AS tr(trial)) WHERE rn <= {ACC_SIZE}),
j AS (SELECT tr.trial, t.*, am.cell // 4 AS mx, (am.cell // 2) % 2 AS mz, am.cell % 2 AS my
      FROM tr JOIN t USING (unit_id) JOIN am USING (unit_id)),
per AS (SELECT trial, 'x_acc_max' AS metric, avg(CAST(x = mx AS DOUBLE)) AS acc FROM j GROUP BY trial
        UNION ALL SELECT trial, 'z_acc_max', avg(CAST(z = mz AS DOUBLE)) FROM j GROUP BY trial
        UNION ALL SELECT trial, 'y_acc_max', avg(CAST(y = my AS DOUBLE)) FROM j GROUP BY trial)
SELECT metric, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM per GROUP BY metric
"""


@register("accuracy_embeddings", _acc_sql())
def accuracy_embeddings(spark, sf):
    """K6 (+ I3): per-field agreement between 'true' codes (the label and signs of embedding values)
    and the arg-max decoded option, per keyed trial subsample, then mean and population std
    over the trials."""
    e = TB.table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    truth = e.select(F.col("vec_id").alias("unit_id"), F.col("label").alias("x"),
                     (F.element_at(v, 9) > 0).cast("int").alias("z"), (F.element_at(v, 11) > 0).cast("int").alias("y"))
    truth = sampling.trials(truth, ACC_TRIALS, ACC_SIZE, ACC_SEED)
    cell = A.argmax(v)
    pred = e.select(F.col("vec_id").alias("unit_id"), (F.floor(cell / 4)).cast("int").alias("max_sample_x"),
                    (F.floor(cell / 2) % 2).cast("int").alias("max_sample_z"), (cell % 2).cast("int").alias("max_sample_y"))
    r = evaluate.accuracy(truth, pred, "unit_id", ["x", "z", "y"], prefixes=("max_sample_",), by=["trial"])
    return r.select("metric", r6("mean").alias("mean"), r6("std").alias("std"))


# ------------------------------------------------------------------ K8 + D11: wide results over two sizes

def _eval_long(spark, sf, size):
    from causeway.plans.queries import units
    tr = sampling.trials(units(spark, sf), 3, size, 123)
    ates = estimators.ipw_strata(tr, ["segment", "region"], "t", "y", by=["trial"])
    truth = estimators.ipw_strata(units(spark, sf), ["segment", "region"], "t", "y").select("ate_ipw").scalar()
    long = evaluate.trial_metrics(ates, truth, "ate_naive", "ate_ipw", "ate_ipw")
    return long.withColumn("eval_size", F.lit(size)).withColumn("value", r6("value"))


def _wide_sql():
    from causeway.plans.q_effects import EVAL_SQL, TRIAL_SIZE
    a = EVAL_SQL.replace(f"rn <= {TRIAL_SIZE}", "rn <= 500")
    return f"""
WITH a AS ({a}), b AS ({EVAL_SQL})
SELECT coalesce(a.metric, b.metric) AS metric, a.value AS ate_ipw_eval500, b.value AS ate_ipw_eval1000
FROM a FULL OUTER JOIN b ON a.metric = b.metric
"""


@register("results_wide_orders", _wide_sql())
def results_wide_orders(spark, sf):
    """K8 + D11: metric rows x <estimator>_eval<size> columns, two sizes merged on metric."""
    tables = [evaluate.results_wide(_eval_long(spark, sf, s), columns=[("ate_ipw", s)]) for s in (500, 1000)]
    return evaluate.merge_sizes(tables).select("metric", "ate_ipw_eval500", "ate_ipw_eval1000")


# ------------------------------------------------------------------ N1 / A9 batch scorer

def word_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in user scorer: whitespace word count per text (vectorised pandas)."""
    n = pdf["text"].fillna("").str.count(r"\S+")
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n.astype("int64")})


SCORE_SQL = f"""
SELECT doc_id, CAST({T.sql_word_count("coalesce(text, '')")} AS BIGINT) AS n_words
FROM documents
"""


@register("score_documents", SCORE_SQL)
def score_documents(spark, sf):
    """N1 + A9: a user batch scorer applied over Arrow batches to every document."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    return io.score(d, word_scorer, "doc_id long, n_words long")


# ------------------------------------------------------------------ C28 + I7 + I8 + C5 with the retail spec

RETAIL_X = ("avg_purchase", "avg_product_quantity", "num_transactions", "age", "avg_regular_points_received")
RETAIL_ATTR_SEED, RETAIL_DROP_Q = 6, 0.3


def _retail_attr_sql():
    from causeway.plans.queries import RETAIL_CLIENTS_CTE
    from causeway.spec import RETAIL

    def ukey(tag):
        return (f"(CAST(('0x' || substr(md5('{RETAIL_ATTR_SEED}:{tag}:' || k || ':' || CAST(client_id AS VARCHAR)), 1, 8))"
                " AS BIGINT) / 4294967296.0)")
    desc = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in RETAIL.descriptions.items())
    rounded = ", ".join(f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR) AS {c}" for c in RETAIL_X)
    return RETAIL_CLIENTS_CTE.rstrip() + f""",
a AS (SELECT client_id, {rounded},
             CASE treatment_flg WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS sms_communication,
             CASE target WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS purchase FROM j),
kv AS (UNPIVOT a ON {', '.join(RETAIL_X + ('sms_communication', 'purchase'))} INTO NAME k VALUE v),
keep AS (SELECT * FROM kv
         WHERE (k IN ({', '.join(repr(f) for f in RETAIL_X)}) AND {ukey('drop')} >= {RETAIL_DROP_Q})
            OR (k = 'sms_communication' AND v = 'Yes') OR k = 'purchase')
SELECT client_id, string_agg(CASE k {desc} ELSE '' END || v || '. ' || chr(10) || ' ', ''
                             ORDER BY {ukey('order')}, k, v) AS features_text
FROM keep GROUP BY client_id
"""


@register("attribute_text_retail_clients", _retail_attr_sql())
def attribute_text_retail_clients(spark, sf):
    """C28 + I7 + I8 + C5 with the retail spec: client features rounded (half to even) and
    labelled, each covariate kept with probability 0.7, the SMS treatment shown only if
    received, the purchase outcome always, shuffled by keyed draws and rendered."""
    from causeway.plans.queries import retail_clients
    from causeway.spec import RETAIL
    f = retail_clients(spark, sf).withColumnsRenamed({"treatment_flg": "sms_communication", "target": "purchase"})
    yes_no = {0: "No", 1: "Yes"}
    r = sampling.round_and_label(f, RETAIL_X, {"sms_communication": yes_no, "purchase": yes_no})
    xs = F.create_map(*[x for c in RETAIL_X for x in (F.lit(c), F.col(c))])
    kept = sampling.drop_attributes(xs, RETAIL_DROP_Q, RETAIL_X, RETAIL_ATTR_SEED, "client_id")
    z = F.when(F.col("sms_communication") == "Yes", F.create_map(F.lit("sms_communication"), F.col("sms_communication"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_concat(kept, z, F.create_map(F.lit("purchase"), F.col("purchase")))
    entries = sampling.shuffle_attributes(m, RETAIL_ATTR_SEED, "client_id")
    return r.select("client_id", sampling.attribute_text(entries, RETAIL.descriptions, RETAIL.description_sep)
                    .alias("features_text"))
