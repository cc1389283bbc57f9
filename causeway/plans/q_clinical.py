"""Migraine-study discretisation (C16 with the botox spec), complete cases (B17) and
stratum propensities over its grid; the composed curation query (3.1 lifecycle);
the propensity distance (K5); trial / observational benchmarks (J18, J19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import clean, discretize, estimators, evaluate, grid, thread
from causeway.plans import tables as TB
from causeway.plans.registry import cte, r6, register
from causeway.spec import BOTOX, ERENUMAB

MIGRAINE_ANSWERS_SQL = """
SELECT o.o_orderkey AS unit_id,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'Botox' WHEN 1 THEN 'Topamax' WHEN 2 THEN 'Topiramate'
            WHEN 3 THEN 'Trokenidi' WHEN 4 THEN 'Unknown' ELSE 'Qudexy' END AS drug_type,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'Unknown' ELSE CAST(16 + c.c_custkey % 60 AS STRING) END AS age,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'unknown' END AS sex,
       CASE c.c_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'Ohio' WHEN 2 THEN 'UK' WHEN 3 THEN 'EU'
            WHEN 4 THEN 'Brazil' ELSE 'Unknown' END AS country,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'Unknown' ELSE CAST(5 + o.o_orderkey % 30 AS STRING) END AS baseline_MMD,
       CAST(o.o_orderkey % 20 AS STRING) AS final_MMD,
       CAST(10 + o.o_orderkey % 60 AS STRING) AS duration_days,
       CASE o.o_orderkey % 4 WHEN 0 THEN '50' WHEN 1 THEN '100' WHEN 2 THEN 'Unknown' ELSE '200' END AS dosage,
       CASE WHEN o.o_orderstatus = 'F' THEN 'nausea' ELSE 'Unknown' END AS adverse_effect,
       CASE o.o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Unknown' END AS discontinued
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""
_RAW = ("drug_type", "age", "sex", "country", "baseline_MMD", "final_MMD", "duration_days", "dosage",
        "adverse_effect", "discontinued")
_NUM = ("age", "baseline_MMD", "final_MMD", "duration_days", "dosage")
OUT = ("unit_id", "drug_type", "discontinued", "age", "sex", "country", "baseline_MMD", "duration_days")


def _unk(c):
    return f"CASE WHEN {c} IN ('Unknown', 'unknown') THEN NULL ELSE {c} END"


def _botox_sql(mode, raw_sql=None):
    folds = {n: code for code, names in BOTOX.treatment_folds.items() for n in names}
    fold = "CASE " + " ".join(f"WHEN drug_type = '{k}' THEN {v}" for k, v in folds.items()) + " END"
    allowed = ", ".join(f"'{a}'" for a in BOTOX.allowed_treatments)
    cmap = "CASE country " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BOTOX.aliases["country"].items()) + " END"
    num = ", ".join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in _NUM)
    sql = f"""
WITH {cte('raw', raw_sql or MIGRAINE_ANSWERS_SQL)},
a AS (SELECT unit_id, {', '.join(f'{_unk(c)} AS {c}' for c in _RAW)} FROM raw),
h AS (SELECT * FROM a {f"WHERE drug_type IN ({allowed}) AND discontinued IS NOT NULL" if mode == "hard" else ""}),
n AS (SELECT unit_id, drug_type,
             coalesce(CAST(CASE sex WHEN 'Male' THEN 0 WHEN 'Female' THEN 1 END AS DOUBLE), TRY_CAST(trim(sex) AS DOUBLE)) AS sex,
             coalesce(CAST({cmap} AS DOUBLE), TRY_CAST(trim(country) AS DOUBLE)) AS country, {num},
             CAST(coalesce(CAST(CASE discontinued WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS DOUBLE),
                           TRY_CAST(trim(discontinued) AS DOUBLE)) AS INTEGER) AS discontinued
      FROM h),
g AS (SELECT * EXCLUDE (drug_type), CAST({fold} AS INTEGER) AS drug_type FROM n WHERE ({fold}) IS NOT NULL)"""
    if mode == "hard":
        crit = ["((baseline_MMD >= 15 AND baseline_MMD <= 30) OR baseline_MMD IS NULL)",
                "(drug_type = 0 OR (drug_type = 1 AND dosage <= 100) OR dosage IS NULL)",
                "(age >= 18 OR age <= 65 OR age IS NULL)"]
        body = "SELECT * FROM g WHERE " + " AND ".join(f"coalesce({c}, false)" for c in crit)
    else:
        body = "SELECT * REPLACE (" + ", ".join(
            f"CAST(CASE WHEN {c} <= {t} THEN 0 WHEN {c} > {t} THEN 1 END AS DOUBLE) AS {c}"
            for c, t in BOTOX.thresholds.items()) + ") FROM g"
    return sql + f",\nout AS ({body})"


def _out_sql():
    return ", ".join(c if c == "unit_id" else f"CAST({c} AS INTEGER) AS {c}" if c in ("drug_type", "discontinued")
                     else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in OUT)


def _out(df):
    return df.select(*[F.col(c) if c == "unit_id" else F.col(c).cast("int").alias(c)
                       if c in ("drug_type", "discontinued") else r6(F.col(c).cast("double")).alias(c) for c in OUT])


def _answers(spark, sf):
    return TB.derived(spark, sf, MIGRAINE_ANSWERS_SQL, ("orders", "customer"))


@register("discretize_botox_hard", _botox_sql("hard") + f"\nSELECT {_out_sql()} FROM out")
def discretize_botox_hard(spark, sf):
    """C16 hard mode with the migraine spec: B15 allow-list + outcome known, C9 folds
    (countries, sexes, drug names), C10, B18, B16 (MMD range, topiramate dose, age rule)."""
    return _out(discretize.discretize_clinical(_answers(spark, sf), BOTOX, mode="hard"))


# ------------------------------------------------------------------ C16 with the second migraine study

ERENUMAB_ANSWERS_SQL = f"""
SELECT * REPLACE (CASE unit_id % 7 WHEN 0 THEN 'Erenumab' WHEN 1 THEN 'Aimovig' WHEN 2 THEN 'CGRP (Erenumab)' WHEN 3 THEN 'Topamax'
                       WHEN 4 THEN 'Trokenidi' WHEN 5 THEN 'Unknown' ELSE 'Topiramat' END AS drug_type,
                  CASE unit_id % 5 WHEN 0 THEN '70' WHEN 1 THEN '140' WHEN 2 THEN 'Unknown' WHEN 3 THEN '100' ELSE '200' END AS dosage),
       CASE unit_id % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Unknown' ELSE 'No' END AS pregnant
FROM ({MIGRAINE_ANSWERS_SQL})
"""


def _erenumab_answers(spark, sf):
    m = _answers(spark, sf)
    k, u = F.col("unit_id"), F.lit("Unknown")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    return m.withColumns({
        "drug_type": pick(7, "Erenumab", "Aimovig", "CGRP (Erenumab)", "Topamax", "Trokenidi", "Unknown", "Topiramat"),
        "dosage": pick(5, "70", "140", "Unknown", "100", "200"),
        "pregnant": F.when(k % 9 == 0, "Yes").when(k % 9 == 1, u).otherwise("No")})


def _erenumab_sql(mode):
    folds = " ".join(f"WHEN drug_type = '{n}' THEN {code}" for code, names in ERENUMAB.treatment_folds.items() for n in sorted(set(names)))
    allowed = ", ".join(f"'{x}'" for x in sorted(set(ERENUMAB.allowed_treatments)))
    countries = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ERENUMAB.aliases["country"].items())

    def number(c, labels=""):
        coded = f"CAST(CASE {c} {labels} END AS DOUBLE)" if labels else "NULL"
        return f"coalesce({coded}, TRY_CAST(trim({c}) AS DOUBLE)) AS {c}"
    yes_no = "WHEN 'No' THEN 0 WHEN 'Yes' THEN 1"
    keep = f"WHERE drug_type IN ({allowed}) AND discontinued IS NOT NULL" if mode == "hard" else ""
    criteria = """WHERE coalesce(age >= 18 OR age <= 65 OR age IS NULL, false) AND coalesce(pregnant = 0 OR pregnant IS NULL, false)
  AND coalesce((baseline_MMD >= 4 AND baseline_MMD <= 30) OR baseline_MMD IS NULL, false)
  AND coalesce((drug_type = 0 AND (dosage = 70 OR dosage = 140)) OR (drug_type = 1 AND dosage <= 100) OR dosage IS NULL, false)""" if mode == "hard" else ""
    return f"""
WITH {cte('raw', ERENUMAB_ANSWERS_SQL)},
a AS (SELECT unit_id, {', '.join(f'{_unk(c)} AS {c}' for c in (*_RAW, 'pregnant'))} FROM raw),
h AS (SELECT * FROM a {keep}),
n AS (SELECT unit_id, CAST(CASE {folds} END AS INTEGER) AS drug_type, {number('sex', "WHEN 'Male' THEN 0 WHEN 'Female' THEN 1")}, {number('country', countries)},
             {', '.join(number(c) for c in _NUM)}, {number('pregnant', yes_no)}, {number('discontinued', yes_no)} FROM h),
out AS (SELECT * FROM n WHERE drug_type IS NOT NULL)
SELECT {_out_sql()} FROM out {criteria}
"""


@register("discretize_erenumab_hard", _erenumab_sql("hard"))
def discretize_erenumab_hard(spark, sf):
    """C16 + B15 + B16 hard mode with the second migraine study (pregnancy, MMD and dose rules)."""
    return _out(discretize.discretize_clinical(_erenumab_answers(spark, sf), ERENUMAB, mode="hard"))


@register("discretize_erenumab_soft", _erenumab_sql("soft"))
def discretize_erenumab_soft(spark, sf):
    """C16 plain soft mode: codes and numbers, no filter but unrecognised treatments."""
    return _out(discretize.discretize_clinical(_erenumab_answers(spark, sf), ERENUMAB, mode="soft"))


_STRATA = list(BOTOX.strata)
STRATA_SQL = _botox_sql("soft_inf") + f""",
cc AS (SELECT * FROM out WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _STRATA)}),
cnt AS (SELECT {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _STRATA)},
               count(*) FILTER (WHERE drug_type = 0) AS n0, count(*) FILTER (WHERE drug_type = 1) AS n1
        FROM cc GROUP BY ALL),
gr AS (SELECT {', '.join(f'CAST((r.range // {s}) % {k} AS INTEGER) AS {c}' for c, s, k in zip(_STRATA, grid.strides(BOTOX.shape(_STRATA)), BOTOX.shape(_STRATA)))}
       FROM range({int(__import__('math').prod(BOTOX.shape(_STRATA)))}) r)
SELECT {', '.join('gr.' + c for c in _STRATA)}, CAST(coalesce(n0, 0) AS BIGINT) AS n0, CAST(coalesce(n1, 0) AS BIGINT) AS n1,
       round(CASE WHEN coalesce(n0, 0) + coalesce(n1, 0) > 0 THEN n0 / (n0 + n1) ELSE 0 END, 6) AS e0,
       round(CASE WHEN coalesce(n0, 0) + coalesce(n1, 0) > 0 THEN n1 / (n0 + n1) ELSE 0 END, 6) AS e1
FROM gr LEFT JOIN cnt USING ({', '.join(_STRATA)})
"""


@register("strata_propensity_botox", STRATA_SQL)
def strata_propensity_botox(spark, sf):
    """C16 soft mode + C13 binarisation -> B17 complete cases on the strata -> E6 + D8
    propensity by counts over the full 144-cell strata grid."""
    d = discretize.discretize_clinical(_answers(spark, sf), BOTOX, mode="soft_inf")
    d = clean.complete_cases(d, _STRATA).withColumns({c: F.col(c).cast("int") for c in _STRATA})
    p = grid.stratum_propensity(d, BOTOX, _STRATA, "drug_type")
    return p.select(*[F.col(c).cast("int").alias(c) for c in _STRATA], F.col("n0").cast("bigint").alias("n0"),
                    F.col("n1").cast("bigint").alias("n1"), r6("e0").alias("e0"), r6("e1").alias("e1"))


# ------------------------------------------------------------------ 3.1: curation, composed

CURATE_TERMS = ("th", "the", "ein", "tion", "eau", "que")


def _curate_sql():
    from causeway.plans.queries import _NORM_SQL, _WORDS_SQL, _prompt_sql_variant
    lst = ", ".join(f"'{t}'" for t in sorted(CURATE_TERMS))
    hay = "lower(concat_ws(chr(1), coalesce(subreddit, ''), coalesce(title, ''), coalesce(text, '')))"
    post_c = _prompt_sql_variant("extraction")[1]
    return f"""
WITH d0 AS ({TB.DOC_POSTS_SQL}),
d AS (SELECT *, 1700000000 + doc_id * 60 AS created_utc FROM d0),
n AS (SELECT *, {_NORM_SQL} AS norm FROM d),
r AS (SELECT * FROM n
      WHERE text IS NOT NULL AND permalink IS NOT NULL AND score IS NOT NULL AND text NOT IN ('[deleted]', '[removed]')
        AND coalesce(NOT contains(lower(author), 'bot'), false) AND instr(substr(norm, 1, 2048), ' ') > 0
        AND length(norm) > 0 AND length(regexp_replace(norm, '[^\\p{{L}}]+', '', 'g')) >= 0.5 * length(norm)
        AND {_WORDS_SQL} >= 10),
m AS (SELECT *, list_sort(list_filter([{lst}], lambda t: instr({hay}, t) > 0)) AS tr FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM m WHERE len(tr) > 0),
f AS (SELECT doc_id, subreddit, title, text AS post,
             strftime(make_timestamp(CAST(created_utc AS BIGINT) * 1000000), '%B %d, %Y') AS date_created,
             array_to_string(tr, ',') AS treatments FROM k WHERE rn = 1)
SELECT doc_id, treatments, {post_c} AS prompt FROM f
"""


@register("curate_documents", _curate_sql())
def curate_documents(spark, sf):
    """Post curation as one plan: rule filter (B1-B8) -> treatment mention (B10) ->
    keep-first de-duplication by text (F1) -> extraction prompt rendering (C4, C3)."""
    d = TB.derived(spark, sf, TB.DOC_POSTS_SQL, TB.DOC_NEEDS).withColumn(
        "created_utc", F.lit(1700000000) + F.col("doc_id") * 60)
    d = clean.rule_filter(d, "text", is_comment=True)
    d = clean.mention_filter(d, ["subreddit", "title", "text"], CURATE_TERMS, "treatments")
    d = clean.keep_first(d.select("doc_id", "subreddit", "title", "text", "created_utc", "treatments"), "text", "doc_id")
    d = d.select("doc_id", "subreddit", "title", F.col("text").alias("post"), "created_utc", "treatments",
                 F.lit(True).alias("is_comment"))
    out = thread.render_posts(d, variant="extraction")
    return out.select("doc_id", F.array_join("treatments", ",").alias("treatments"), "prompt")


# ------------------------------------------------------------------ K5 propensity distance

PROP_DIST_SQL = """
WITH ex AS (SELECT vec_id AS unit_id, r.pos - 1 AS pos, CAST(embedding[r.pos] AS DOUBLE) AS l
            FROM embeddings CROSS JOIN range(1, 65) AS r(pos)),
mx AS (SELECT unit_id, max(l) AS m FROM ex GROUP BY unit_id),
ee AS (SELECT ex.unit_id, pos, exp(l - m) AS e FROM ex JOIN mx USING (unit_id)),
pz AS (SELECT unit_id, pos, e / sum(e) OVER (PARTITION BY unit_id) AS p FROM ee),
pw AS (SELECT unit_id, sum(p) FILTER (WHERE (pos // 2) % 2 = 0) AS p0, sum(p) FILTER (WHERE (pos // 2) % 2 = 1) AS p1 FROM pz GROUP BY unit_id),
s AS (SELECT vec_id AS unit_id, CAST(embedding[9] > 0 AS INTEGER) AS z, CAST(embedding[10] > 0 AS INTEGER) AS a,
             CAST(embedding[11] > 0 AS INTEGER) AS b FROM embeddings),
j AS (SELECT * FROM pw JOIN s USING (unit_id)),
st AS (SELECT a, b, avg(p0) AS e0, avg(p1) AS e1, count(*) FILTER (WHERE z = 0) / count(*) AS o0,
              count(*) FILTER (WHERE z = 1) / count(*) AS o1 FROM j GROUP BY a, b),
cells AS (SELECT o0 AS o, e0 AS e FROM st UNION ALL SELECT o1, e1 FROM st)
SELECT round(sum(CASE WHEN o <> 0 THEN o * ln(o / (e + 1e-6)) ELSE 0 END), 6) AS kl, round(avg((o - e) * (o - e)), 6) AS mse
FROM cells
"""


@register("propensity_distance_embeddings", PROP_DIST_SQL)
def propensity_distance_embeddings(spark, sf):
    """K5 (+ K1, K2): distance between observed stratum treatment shares (E6 on the
    sampled treatment) and the predicted hybrid propensities (J4)."""
    from causeway.plans.q_effects import emb_units
    u = emb_units(spark, sf)
    pred = estimators.hybrid_propensity(u, "p_zy", ["sample_a", "sample_b"])
    obs = u.groupBy("sample_a", "sample_b").agg((F.count_if(F.col("sample_z") == 0) / F.count("*")).alias("o0"),
                                                (F.count_if(F.col("sample_z") == 1) / F.count("*")).alias("o1"))
    key = F.concat_ws(":", "sample_a", "sample_b", "z")
    o = obs.select("sample_a", "sample_b", F.explode(F.array(F.struct(F.lit(0).alias("z"), F.col("o0").alias("v")),
                                                            F.struct(F.lit(1).alias("z"), F.col("o1").alias("v")))).alias("c")) \
        .select("sample_a", "sample_b", "c.z", "c.v").select(F.lit(0).alias("trial"), key.alias("cell"), F.col("v").alias("a"))
    p = pred.select("sample_a", "sample_b", F.explode(F.array(F.struct(F.lit(0).alias("z"), F.col("e0").alias("v")),
                                                             F.struct(F.lit(1).alias("z"), F.col("e1").alias("v")))).alias("c")) \
        .select("sample_a", "sample_b", "c.z", "c.v").select(F.lit(0).alias("trial"), key.alias("cell"), F.col("v").alias("b"))
    r = evaluate.distribution_distance(o, p, "cell", "a", "b")
    return r.select(r6("kl").alias("kl"), r6("mse").alias("mse"))


# ------------------------------------------------------------------ B10 / B11 with the study lexicons

def _lexicon_sql(terms, hay):
    lst = ", ".join("'" + t.replace("'", "''") + "'" for t in sorted({t.lower() for t in terms}))
    return f"array_to_string(list_sort(list_filter([{lst}], lambda t: instr({hay}, t) > 0)), ',')"


_DOC_HAY = "lower(concat_ws(chr(1), coalesce(source, ''), coalesce(text, '')))"
LEXICON_SQL = f"""
SELECT doc_id, {_lexicon_sql(BOTOX.lexicon, _DOC_HAY)} AS treatments,
       {_lexicon_sql(BOTOX.outcome_words, _DOC_HAY)} AS outcome_words
FROM documents
"""


@register("lexicon_terms_documents", LEXICON_SQL)
def lexicon_terms_documents(spark, sf):
    """B10 + B11 with the published migraine lexicons (130+ treatment terms, each
    tested on its own) annotating every document."""
    from causeway.functions import text as T
    d = TB.table(spark, sf, "documents").select("doc_id", "source", "text")
    return d.select("doc_id",
                    F.array_join(T.mention_terms(["source", "text"], BOTOX.lexicon, "one_pass"), ",").alias("treatments"),
                    F.array_join(T.mention_terms(["source", "text"], BOTOX.outcome_words), ",").alias("outcome_words"))


# ------------------------------------------------------------------ C17 retail discretiser (I6 from distinct ages)

RETAIL_ANSWERS_SQL = """
SELECT c_custkey AS unit_id,
       CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE CAST(18 + c_custkey % 70 AS STRING) END AS age,
       CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) AS avg_purchase,
       CAST(c_custkey % 15 AS STRING) AS avg_product_quantity,
       CASE WHEN c_nationkey % 5 = 0 THEN 'Unknown' ELSE CAST(c_custkey % 40 AS STRING) END AS num_transactions,
       CAST(c_nationkey AS STRING) AS avg_regular_points_received,
       CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS purchase,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Yes' WHEN 'MACHINERY' THEN 'Unknown' ELSE 'No' END AS sms_communication
FROM customer
"""
RETAIL_SEED = 10
RETAIL_OUT = ("unit_id", "age", "age_binary", "avg_purchase", "avg_product_quantity", "num_transactions",
              "avg_regular_points_received", "purchase", "sms_communication")


def _retail_sql():
    from causeway.functions.draws import sql_uniform
    from causeway.spec import RETAIL_BINS
    u = lambda tag: sql_uniform(RETAIL_SEED, tag, "unit_id")

    def bin_sql(f, edges):
        x = f"TRY_CAST(trim({f}) AS DOUBLE)"
        cases = " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN {i}" for i in range(len(edges) - 1))
        return f"CAST(coalesce(CASE {cases} END, CAST(floor({u(f)} * {len(edges) - 1}) AS INTEGER)) AS INTEGER) AS {f}"

    def yn(f):
        return (f"CAST(coalesce(CASE {f} WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END, CAST(TRY_CAST(trim({f}) AS DOUBLE) AS INTEGER),"
                f" CAST(floor({u(f)} * 2) AS INTEGER)) AS INTEGER) AS {f}")
    cols = ("age", "avg_purchase", "avg_product_quantity", "num_transactions", "avg_regular_points_received",
            "purchase", "sms_communication")
    return f"""
WITH {cte('raw', RETAIL_ANSWERS_SQL)},
a AS (SELECT unit_id, {', '.join(f"{_unk(c)} AS {c}" for c in cols)} FROM raw),
a1 AS (SELECT * REPLACE (TRY_CAST(trim(age) AS DOUBLE) AS age) FROM a),
d AS (SELECT DISTINCT age FROM a1 WHERE age IS NOT NULL),
r AS (SELECT age AS age_draw, row_number() OVER (ORDER BY CAST(floor({sql_uniform(RETAIL_SEED, 'domain', 'age')} * 256) AS INTEGER), age) - 1 AS k FROM d),
a2 AS (SELECT a1.*, CAST(coalesce(CASE WHEN age <= 45 THEN 0 WHEN age > 45 THEN 1 END,
                                  CAST(floor({u('age_binary')} * 2) AS INTEGER)) AS INTEGER) AS age_binary,
              CASE WHEN age IS NULL THEN CAST(floor({u('age')} * (SELECT count(*) FROM d)) AS INTEGER) END AS k FROM a1),
a3 AS (SELECT a2.* REPLACE (coalesce(a2.age, r.age_draw) AS age) FROM a2 LEFT JOIN r ON a2.k = r.k)
SELECT unit_id, round(age, 6) AS age, age_binary,
       {', '.join(bin_sql(f, e) for f, e in RETAIL_BINS.items())}, {yn('purchase')}, {yn('sms_communication')}
FROM a3
"""


@register("discretize_retail_customers", _retail_sql())
def discretize_retail_customers(spark, sf):
    """C17 for the retail study: age -> age_binary, right-closed bins (C14), Yes/No codes,
    every missing value imputed by a keyed draw (I6) -- ages from the observed distinct ages."""
    a = TB.derived(spark, sf, RETAIL_ANSWERS_SQL, ("customer",))
    d = discretize.discretize_retail(a, seed=RETAIL_SEED, id_col="unit_id")
    return d.select("unit_id", r6(F.col("age")).alias("age"), *[F.col(c).cast("int").alias(c) for c in RETAIL_OUT[2:]])


# ------------------------------------------------------------------ 3.2: extraction, composed

DRUGS = ("Botox", "Topamax", "Topiramate", "Unknown", "Qudexy", "Trokendi")
SEXES = ("Male", "Female", "unknown")
COUNTRY_BY_LANG = {"en": "US", "fr": "Europe", "de": "Germany", "es": "Argentina"}
VERDICTS = ("Yes", "No", "Unknown")


def answer_scorer(pdf):
    """Stand-in for a user's extraction model: one JSON answer per post (pandas batch)."""
    import json

    import pandas as pd
    rows = []
    for doc_id, n_chars, lang in zip(pdf["doc_id"], pdf["n_chars"], pdf["lang"]):
        rows.append(json.dumps({
            "drug_type": DRUGS[doc_id % 6], "age": "Unknown" if doc_id % 5 == 0 else str(18 + n_chars % 60),
            "sex": SEXES[n_chars % 3], "country": COUNTRY_BY_LANG.get(lang, "Unknown"),
            "baseline_MMD": str(4 + n_chars % 25), "final_MMD": "Unknown", "duration_days": str(7 + doc_id % 60),
            "dosage": "Unknown", "adverse_effect": "Unknown", "discontinued": VERDICTS[(n_chars // 3) % 3]}))
    return pd.DataFrame({"doc_id": pdf["doc_id"], "answer": rows})


_SCORED_SQL = f"""
SELECT doc_id AS unit_id,
       CASE doc_id % 6 {' '.join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DRUGS))} END AS drug_type,
       CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE CAST(18 + n_chars % 60 AS VARCHAR) END AS age,
       CASE n_chars % 3 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SEXES))} END AS sex,
       CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_BY_LANG.items())} ELSE 'Unknown' END AS country,
       CAST(4 + n_chars % 25 AS VARCHAR) AS baseline_MMD, 'Unknown' AS final_MMD,
       CAST(7 + doc_id % 60 AS VARCHAR) AS duration_days, 'Unknown' AS dosage, 'Unknown' AS adverse_effect,
       CASE (n_chars // 3) % 3 {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERDICTS))} END AS discontinued
FROM documents
"""

EXTRACTION_SQL = _botox_sql("soft_inf", _SCORED_SQL) + f""",
cc AS (SELECT * FROM out WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _STRATA)} AND discontinued IS NOT NULL),
s AS (SELECT {', '.join(_STRATA)}, count(*) FILTER (WHERE drug_type = 0) AS n0, count(*) FILTER (WHERE drug_type = 1) AS n1,
             sum(CASE WHEN drug_type = 1 THEN discontinued ELSE 0 END) AS y1,
             sum(CASE WHEN drug_type = 0 THEN discontinued ELSE 0 END) AS y0
      FROM cc GROUP BY ALL)
SELECT CAST(sum(n0 + n1) AS BIGINT) AS n,
       round(sum(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / (n1 / (n0 + n1)) - y0 / (n0 / (n0 + n1)) ELSE 0 END)
             / sum(n0 + n1), 6) AS ate_ipw,
       round(sum(y1) / sum(n1) - sum(y0) / sum(n0), 6) AS ate_naive
FROM s
"""


@register("extraction_documents", EXTRACTION_SQL)
def extraction_documents(spark, sf):
    """Extraction as one plan: user batch scorer over Arrow batches (N1/A9) -> JSON answers
    parsed (C18) -> migraine discretiser, soft mode with binarisation (C16, C13) ->
    complete cases on the strata (B17) -> stratum-propensity IPW and naive effect (E6, J10)."""
    from causeway.sources import io
    fields = list(_RAW)
    posts = TB.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    scored = io.score(posts, answer_scorer, "doc_id long, answer string")
    parsed = discretize.parse_answers(scored, "answer", fields).withColumnRenamed("doc_id", "unit_id")
    d = discretize.discretize_clinical(parsed, BOTOX, mode="soft_inf")
    d = clean.complete_cases(d, _STRATA + ["discontinued"])
    r = estimators.ipw_strata(d, _STRATA, "drug_type", "discontinued")
    return r.select(F.col("n").cast("bigint").alias("n"), r6("ate_ipw").alias("ate_ipw"),
                    r6("ate_naive").alias("ate_naive"))
