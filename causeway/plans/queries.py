"""Registered queries: each binds operators to the driver tables and has, where the
semantics are SQL-expressible, an equivalent DuckDB oracle (``ORACLES``).

Every query reads whole tables (no id subsets, row caps or prefixes); limits
appear only where they are the feature (sample sizes of a subsampling operator).
Floating outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.functions.arrays import let
from causeway.functions.draws import sql_uniform
from causeway.operators import clean, discretize, estimators, thread
from causeway.plans import tables as TB
from causeway.plans.tables import derived
from causeway.spec import LIRAGLUTIDE, RETAIL_BINS, TIRZEPATIDE

from causeway.plans.registry import ORACLES, QUERIES, r6, register  # noqa: F401
from causeway.plans.registry import cte as _cte


# ---------------------------------------------------------------------------------- 7.1 slice

def units(spark, sf):
    return derived(spark, sf, TB.UNITS_SQL, TB.UNITS_NEEDS)


ATE_ORDERS_SQL = f"""
WITH {_cte('u', TB.UNITS_SQL)},
s AS (SELECT segment, region,
             count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1,
             sum(CASE WHEN t = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN t = 0 THEN y ELSE 0 END) AS y0
      FROM u GROUP BY segment, region)
SELECT CAST(sum(n0 + n1) AS BIGINT) AS n,
       round(sum(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / (n1 / (n0 + n1)) - y0 / (n0 / (n0 + n1)) ELSE 0 END)
             / sum(n0 + n1), 6) AS ate_ipw,
       round(sum(y1) / sum(n1) - sum(y0) / sum(n0), 6) AS ate_naive
FROM s
"""


@register("ate_orders", ATE_ORDERS_SQL)
def ate_orders(spark: SparkSession, sf: str) -> DataFrame:
    """E6 stratum propensity + J5-form IPW on observed outcomes + J10, orders x customer x nation."""
    r = estimators.ipw_strata(units(spark, sf), ["segment", "region"], "t", "y")
    return r.select(F.col("n").cast("bigint").alias("n"), r6("ate_ipw").alias("ate_ipw"),
                    r6("ate_naive").alias("ate_naive"))


# ---------------------------------------------------------------------------------- curation

_TRIM_SET = " || ".join(f"chr({ord(c)})" for c in T.PY_WHITESPACE)
_NORM_SQL = ("trim(replace(replace(replace(replace(replace(text, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'),"
             f" chr(10), ' '), chr(9), ' '), {_TRIM_SET})")
_WORDS_SQL = T.sql_word_count("text")

RULE_FILTER_SQL = f"""
WITH {_cte('d', TB.DOC_POSTS_SQL)},
n AS (SELECT *, {_NORM_SQL} AS norm FROM d)
SELECT doc_id, CAST({_WORDS_SQL} AS BIGINT) AS n_words,
       CAST(length(regexp_replace(norm, '[^\\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
       CAST(length(norm) AS BIGINT) AS n_norm
FROM n
WHERE text IS NOT NULL AND permalink IS NOT NULL AND score IS NOT NULL
  AND text NOT IN ('[deleted]', '[removed]')
  AND coalesce(NOT contains(lower(author), 'bot'), false)
  AND instr(substr(norm, 1, 2048), ' ') > 0
  AND length(norm) > 0 AND length(regexp_replace(norm, '[^\\p{{L}}]+', '', 'g')) >= 0.5 * length(norm)
  AND {_WORDS_SQL} >= 10
"""


@register("rule_filter_documents", RULE_FILTER_SQL)
def rule_filter_documents(spark, sf):
    """B1-B8 + C1 on documents read as comments."""
    d = derived(spark, sf, TB.DOC_POSTS_SQL, TB.DOC_NEEDS)
    kept = clean.rule_filter(d, "text", is_comment=True)
    counts = let(T.normalise("text"), lambda norm: F.struct(T.letter_count(norm).cast("bigint").alias("n_letters"),
                                                            F.length(norm).cast("bigint").alias("n_norm")))
    return kept.select("doc_id", T.word_count("text").cast("bigint").alias("n_words"), F.inline(F.array(counts)))


DATE_CUTOFF = 1705276800  # 2024-01-15 00:00:00 UTC

DATE_CUTOFF_SQL = f"""
WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc FROM events)
SELECT event_id, created_utc, strftime(make_timestamp(created_utc * 1000000), '%B %d, %Y') AS date_created
FROM e WHERE created_utc <= {DATE_CUTOFF}
"""


@register("date_cutoff_events", DATE_CUTOFF_SQL)
def date_cutoff_events(spark, sf):
    """B9 + C3 on events (epoch seconds of ts)."""
    e = TB.table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("created_utc"))
    return clean.date_cutoff(e, "created_utc", DATE_CUTOFF).withColumn("date_created", T.utc_date("created_utc"))


# binding lexicons: overlapping terms that occur in the generated prose
DOC_TREATMENT_TERMS = ("th", "the", "then", "ein", "einen", "tion", "ation", "eau", "eaux", "que")
DOC_OUTCOME_WORDS = ("sch", "ing", "ment", "lich", "ier", "src1")


def _terms_sql(terms, hay):
    lst = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"list_sort(list_filter([{lst}], lambda t: instr({hay}, t) > 0))"


_HAY = "lower(concat_ws(chr(1), coalesce(subreddit, ''), coalesce(title, ''), coalesce(text, '')))"
MENTION_SQL = f"""
WITH {_cte('d', TB.DOC_POSTS_SQL)},
m AS (SELECT doc_id, {_terms_sql(DOC_TREATMENT_TERMS, _HAY)} AS tr, {_terms_sql(DOC_OUTCOME_WORDS, _HAY)} AS ow FROM d)
SELECT doc_id, array_to_string(tr, ',') AS treatments, array_to_string(ow, ',') AS outcome_words,
       CAST(len(tr) AS BIGINT) AS n_treatments
FROM m WHERE len(tr) > 0 AND len(ow) > 0
"""


@register("mention_filter_documents", MENTION_SQL)
def mention_filter_documents(spark, sf):
    """B10 + B11 + H2: treatment mention, then outcome-word mention."""
    d = derived(spark, sf, TB.DOC_POSTS_SQL, TB.DOC_NEEDS)
    cols = ["subreddit", "title", "text"]
    m = clean.mention_filter(d, cols, DOC_TREATMENT_TERMS, "treatments")
    m = clean.mention_filter(m, cols, DOC_OUTCOME_WORDS, "outcome_words")
    return m.select("doc_id", F.array_join("treatments", ",").alias("treatments"),
                    F.array_join("outcome_words", ",").alias("outcome_words"),
                    F.size("treatments").cast("bigint").alias("n_treatments"))


KEEP_FIRST_SQL = "SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text"


@register("keep_first_documents", KEEP_FIRST_SQL)
def keep_first_documents(spark, sf):
    """keep-first de-duplication by text (source order = doc_id)."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    return clean.keep_first_text(d, "text", "doc_id", extra={"copies": F.count("*").cast("bigint")})


VERDICT_SQL = """
SELECT doc_id, lower(text) = 'yes' AS strict_yes,
       contains(lower(text), 'yes') AND NOT contains(lower(text), 'no') AS lenient_yes
FROM documents
"""


@register("verdict_documents", VERDICT_SQL)
def verdict_documents(spark, sf):
    """B12 / B13 as flags over every document."""
    d = TB.table(spark, sf, "documents")
    return d.select("doc_id", T.strict_yes("text").alias("strict_yes"), T.lenient_yes("text").alias("lenient_yes"))


ANSWERS_SQL = """
WITH a AS (SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k FROM events)
SELECT event_id, CASE WHEN k IN ('Unknown', 'unknown') THEN NULL ELSE TRY_CAST(trim(k) AS DOUBLE) END AS k
FROM a
"""


@register("answers_events", ANSWERS_SQL)
def answers_events(spark, sf):
    """C18 (JSON answer -> struct) + B14 (Unknown -> NULL) + C10 (lenient number)."""
    e = TB.table(spark, sf, "events").select("event_id", "props")
    p = discretize.parse_answers(e, "props", ["k"])
    p = clean.unknown_to_null(p, ["k"])
    from causeway.functions import codes as C
    return p.select("event_id", C.to_number("k").alias("k"))


# ---------------------------------------------------------------------------------- threads

def _threads(spark, sf):
    subs = derived(spark, sf, TB.THREAD_SUBS_SQL, TB.CONV_NEEDS)
    coms = derived(spark, sf, TB.THREAD_COMMENTS_SQL, TB.CONV_NEEDS)
    return thread.stitch(subs, coms)


STITCH_SQL = f"""
WITH {_cte('s', TB.THREAD_SUBS_SQL)}, {_cte('c', TB.THREAD_COMMENTS_SQL)},
r AS (SELECT s.sub_id, string_agg(chr(10) || '> ' || c.body, '' ORDER BY c.seq) AS replies,
             count(*) AS n_rep
      FROM s JOIN c ON c.thread_key = s.thread_key AND c.author = s.author GROUP BY s.sub_id),
p AS (SELECT s.sub_id, s.thread_key, s.author,
             CASE WHEN r.n_rep > 0 THEN s.selftext || chr(10) || chr(10)
                  || 'The author also replied with the following in the thread:' || r.replies
                  ELSE s.selftext END AS post,
             CAST(coalesce(r.n_rep, 0) AS BIGINT) AS n_replies
      FROM s LEFT JOIN r ON s.sub_id = r.sub_id)
SELECT sub_id, CAST(NULL AS BIGINT) AS seq, false AS is_comment, post, '' AS initial_post, n_replies FROM p
UNION ALL
SELECT p.sub_id, c.seq, true AS is_comment, c.body AS post, p.post AS initial_post, CAST(0 AS BIGINT) AS n_replies
FROM p JOIN c ON c.thread_key = p.thread_key
WHERE NOT coalesce(c.author = p.author, false)
"""


@register("thread_stitch_conversations", STITCH_SQL)
def thread_stitch_conversations(spark, sf):
    """D1 + D2 + E2: submission (turn 0) joined with its replies; author replies folded in."""
    t = _threads(spark, sf)
    return t.select("sub_id", "seq", "is_comment", "post", "initial_post",
                    F.size("author_replies").cast("bigint").alias("n_replies"))


def _prompt_sql_variant(variant="verdict"):
    post_t, com_t = ((thread.POST_TEMPLATE, thread.COMMENT_TEMPLATE) if variant == "verdict"
                     else (thread.EXTRACT_POST_TEMPLATE, thread.EXTRACT_COMMENT_TEMPLATE))

    def fill(tpl):
        out = []
        rest = tpl
        for name, expr in (("subreddit", "subreddit"), ("title", "title"), ("date_created", "date_created"),
                           ("post", "post")):
            a, rest = rest.split("{" + name + "}", 1)
            out.append(_sql_str(a))
            out.append(f"coalesce(CAST({expr} AS VARCHAR), '')")
        out.append(_sql_str(rest))
        return " || ".join(out)
    return fill(post_t), fill(com_t)


def _prompt_sql():
    return _prompt_sql_variant("verdict")


def _sql_str(s):
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


_P, _C = _prompt_sql()
RENDER_SQL = f"""
WITH {_cte('s', TB.THREAD_SUBS_SQL)}, {_cte('c', TB.THREAD_COMMENTS_SQL)},
r AS (SELECT s.sub_id, string_agg(chr(10) || '> ' || c.body, '' ORDER BY c.seq) AS replies, count(*) AS n_rep
      FROM s JOIN c ON c.thread_key = s.thread_key AND c.author = s.author GROUP BY s.sub_id),
p AS (SELECT s.*, CASE WHEN r.n_rep > 0 THEN s.selftext || chr(10) || chr(10)
                  || 'The author also replied with the following in the thread:' || r.replies
                  ELSE s.selftext END AS post
      FROM s LEFT JOIN r ON s.sub_id = r.sub_id),
rows AS (SELECT sub_id, CAST(NULL AS BIGINT) AS seq, false AS is_comment, subreddit, title, post, created_utc FROM p
         UNION ALL
         SELECT p.sub_id, c.seq, true, p.subreddit, p.title, c.body, c.created_utc
         FROM p JOIN c ON c.thread_key = p.thread_key WHERE NOT coalesce(c.author = p.author, false)),
d AS (SELECT *, strftime(make_timestamp(CAST(created_utc AS BIGINT) * 1000000), '%B %d, %Y') AS date_created FROM rows)
SELECT sub_id, seq, date_created, CASE WHEN is_comment THEN {_C} ELSE {_P} END AS prompt FROM d
"""


@register("render_prompts_conversations", RENDER_SQL)
def render_prompts_conversations(spark, sf):
    """C4 + C3: verdict prompts for every context post of the stitched threads."""
    t = thread.render_posts(_threads(spark, sf))
    return t.select("sub_id", "seq", "date_created", "prompt")


# ---------------------------------------------------------------------------------- retail features

RETAIL_SQL = f"""
WITH li AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                   CAST(round(l_tax * 100) AS BIGINT) AS pts, CAST(ceil(l_quantity / 10) AS BIGINT) AS qty FROM lineitem),
l AS (SELECT l_orderkey,
             arg_max(cents, CAST(l_linenumber AS BIGINT) * 1099511627776 + cents) FILTER (WHERE cents IS NOT NULL)
                 AS purchase_sum,
             arg_max(pts, CAST(l_linenumber AS BIGINT) * 1099511627776 + pts) FILTER (WHERE pts IS NOT NULL)
                 AS points,
             sum(qty) AS quantity
      FROM li GROUP BY l_orderkey),
t AS (SELECT o.o_custkey AS client_id, l.* FROM l JOIN orders o ON l.l_orderkey = o.o_orderkey),
f AS (SELECT client_id, CAST(sum(purchase_sum) AS DOUBLE) / count(purchase_sum) / 10000 AS avg_purchase,
             CAST(sum(points) AS DOUBLE) / count(points) AS avg_regular_points_received,
             CAST(sum(quantity) AS DOUBLE) / count(quantity) AS avg_product_quantity,
             CAST(count(*) AS BIGINT) AS num_transactions
      FROM t GROUP BY client_id),
j AS (SELECT f.*, 18 + c.c_custkey % 70 AS age,
             CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS treatment_flg,
             CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END AS target
      FROM f JOIN customer c ON f.client_id = c.c_custkey)
SELECT client_id, num_transactions, avg_purchase, avg_product_quantity, avg_regular_points_received,
       {{bins}},
       CAST(CASE WHEN age <= 45 THEN 0 WHEN age > 45 THEN 1 END AS INTEGER) AS age_binary,
       CAST(treatment_flg AS INTEGER) AS treatment_flg, CAST(target AS INTEGER) AS target
FROM j
"""


def _bin_sql(col, edges, alias):
    cases = " ".join(f"WHEN {col} > {edges[i]} AND {col} <= {edges[i + 1]} THEN {i}" for i in range(len(edges) - 1))
    return f"CAST(CASE {cases} END AS INTEGER) AS {alias}"


RETAIL_SQL = RETAIL_SQL.replace("{bins}", ", ".join(_bin_sql(c, e, c + "_bin") for c, e in RETAIL_BINS.items()))


@register("retail_features", RETAIL_SQL)
def retail_features_q(spark, sf):
    """E1 + E3 + E4 + D5 + C14 + C15: client features from line items."""
    from causeway.functions import codes as C
    f = retail_clients(spark, sf)
    return f.select("client_id", "num_transactions", "avg_purchase", "avg_product_quantity",
                    "avg_regular_points_received",
                    *[C.right_closed_bin(c, e).alias(c + "_bin") for c, e in RETAIL_BINS.items()],
                    C.binarise("age", 45).alias("age_binary"), "treatment_flg", "target")


# the client-feature CTE chain of the oracle (everything before the final projection)
RETAIL_CLIENTS_CTE = RETAIL_SQL.split("SELECT client_id, num_transactions, avg_purchase")[0]


def retail_clients(spark, sf):
    """Client features (money in hundreds of dollars) joined to the client attributes."""
    from causeway.operators.features import client_features
    # money in integer cents and points/quantities as integers: sums are exact, so the
    # means do not depend on summation order
    li = TB.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("purchase_sum"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("regular_points_received"),
        F.ceil(F.col("l_quantity") / 10).cast("bigint").alias("product_quantity"))
    orders = TB.table(spark, sf, "orders").select(F.col("o_orderkey").alias("transaction_id"),
                                                  F.col("o_custkey").alias("client_id"))
    cust = TB.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("client_id"), (18 + F.col("c_custkey") % 70).alias("age"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("treatment_flg"),
        (F.col("c_acctbal") > 0).cast("int").alias("target"))
    # line numbers repeat inside an order: ties are broken by the value itself, packed
    # into one BIGINT (line * 2^40 + value) so the aggregate stays hash-based
    li = li.withColumns({"_k_price": F.col("l_linenumber").cast("bigint") * (1 << 40) + F.col("purchase_sum"),
                         "_k_pts": F.col("l_linenumber").cast("bigint") * (1 << 40) + F.col("regular_points_received")})
    f = client_features(li, orders, cust, order_col={"purchase_sum": "_k_price", "regular_points_received": "_k_pts"})
    return f.withColumn("avg_purchase", F.col("avg_purchase") / 10000)      # cents -> hundreds of dollars


# ---------------------------------------------------------------------------------- discretisation

def _ladder_sql(x, edges):
    parts = [f"WHEN {x} <= {edges[0]} THEN 0"]
    for i in range(1, len(edges)):
        parts.append(f"WHEN {x} <= {edges[i]} THEN {i}")
    parts.append(f"WHEN {x} > {edges[-1]} THEN {len(edges)}")
    return "CASE " + " ".join(parts) + " END"


def _imp(code_sql, n, seed, tag):
    return f"CAST(coalesce({code_sql}, CAST(floor({sql_uniform(seed, tag, 'unit_id')} * {n}) AS INTEGER)) AS INTEGER)"


def _unk(c):
    return f"CASE WHEN {c} IN ('Unknown', 'unknown') THEN NULL ELSE {c} END"


def _num(c):
    return f"TRY_CAST(trim({_unk(c)}) AS DOUBLE)"


def _yesno(c):
    return (f"coalesce(CASE {_unk(c)} WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END, "
            f"CAST(TRY_CAST(trim({_unk(c)}) AS DOUBLE) AS INTEGER))")


def _email_sql(seed=10):
    from causeway.spec import EMAIL_HISTORY_EDGES, EMAIL_RECENCY_EDGES
    cols = [
        f"{_imp(_ladder_sql(_num('history'), EMAIL_HISTORY_EDGES), 7, seed, 'history')} AS history",
        f"{_imp(_ladder_sql(_num('recency'), EMAIL_RECENCY_EDGES), 3, seed, 'recency')} AS recency",
    ]
    for f in ("mens", "womens", "newbie", "email_type", "visit"):
        cols.append(f"{_imp(_yesno(f), 2, seed, f)} AS {f}")
    zip_sql = "CASE zip_code WHEN 'Suburban' THEN 0 WHEN 'Rural' THEN 1 WHEN 'Urban' THEN 2 END"
    channel_sql = "CASE channel WHEN 'Phone' THEN 0 WHEN 'Web' THEN 1 WHEN 'Multichannel' THEN 2 END"
    cols.append(f"{_imp(zip_sql, 3, seed, 'zip_code')} AS zip_code")
    cols.append(f"{_imp(channel_sql, 3, seed, 'channel')} AS channel")
    return f"WITH {_cte('a', TB.EMAIL_ANSWERS_SQL)} SELECT unit_id, " + ", ".join(cols) + " FROM a"


EMAIL_COLS = ("unit_id", "history", "recency", "mens", "womens", "newbie", "email_type", "visit", "zip_code", "channel")


@register("discretize_email_orders", _email_sql())
def discretize_email_orders(spark, sf):
    """C17 (+ B14, C10, C15, I6): email-marketing answers -> codes with keyed imputation."""
    a = derived(spark, sf, TB.EMAIL_ANSWERS_SQL, TB.EMAIL_NEEDS)
    d = discretize.discretize_email(a, seed=10, id_col="unit_id")
    return d.select(*[F.col(c).cast("int").alias(c) if c != "unit_id" else F.col(c) for c in EMAIL_COLS])


def _clinical_sql(spec, mode):
    """DuckDB re-expression of C16 for the oracle."""
    sel = ["unit_id"]
    folds = {}
    for code, names in spec.treatment_folds.items():
        for n in names:
            folds.setdefault(n, code)
    fold = "CASE " + " ".join(f"WHEN drug_type = '{k}' THEN {v}" for k, v in folds.items()) + " END"
    allowed = ", ".join("'" + a + "'" for a in spec.allowed_treatments)
    sexmap = "CASE sex WHEN 'Male' THEN 0 WHEN 'Female' THEN 1 END"
    cmap = "CASE country " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in spec.aliases["country"].items()) + " END"
    kg = "coalesce(weight_unit = 'kg', false)"
    base = f"""
WITH {_cte('raw', TB.CLINICAL_ANSWERS_SQL)},
a AS (SELECT unit_id, {', '.join(f"{_unk(c)} AS {c}" for c in (
        'drug_type', 'age', 'sex', 'country', 't2dm', 'metformin', 'bmi', 'start_HbA1c', 'end_HbA1c', 'start_weight',
        'end_weight', 'weight_unit', 'weight_change', 'percentage_weight_change', 'duration_days', 'dosage'))} FROM raw),
h AS (SELECT * FROM a {"WHERE drug_type IN (" + allowed + ") AND (" + _known_sql(spec) + ")" if mode == "hard" else ""}),
n AS (SELECT unit_id, drug_type, weight_unit,
             coalesce(CAST({sexmap} AS DOUBLE), TRY_CAST(trim(sex) AS DOUBLE)) AS sex,
             coalesce(CAST({cmap} AS DOUBLE), TRY_CAST(trim(country) AS DOUBLE)) AS country,
             {', '.join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in (
                 'age', 'bmi', 'start_HbA1c', 'end_HbA1c', 'start_weight', 'end_weight', 'weight_change',
                 'percentage_weight_change', 'duration_days', 'dosage'))},
             coalesce(CAST(CASE t2dm WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS DOUBLE), TRY_CAST(trim(t2dm) AS DOUBLE)) AS t2dm,
             coalesce(CAST(CASE metformin WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS DOUBLE),
                      TRY_CAST(trim(metformin) AS DOUBLE)) AS metformin
      FROM h),
k AS (SELECT * REPLACE (CASE WHEN {kg} THEN start_weight * 2.20462 ELSE start_weight END AS start_weight,
                        CASE WHEN {kg} THEN end_weight * 2.20462 ELSE end_weight END AS end_weight,
                        CASE WHEN {kg} THEN weight_change * 2.20462 ELSE weight_change END AS weight_change) FROM n),
c AS (SELECT * REPLACE (CASE WHEN percentage_weight_change IS NULL AND weight_change IS NULL
                             THEN end_weight - start_weight ELSE weight_change END AS weight_change) FROM k),
p AS (SELECT * REPLACE (coalesce(percentage_weight_change,
                                 100.0 * CASE WHEN start_weight <> 0 THEN weight_change / start_weight END)
                        AS percentage_weight_change) FROM c),
f AS (SELECT *, CAST(coalesce(percentage_weight_change <= {spec.outcome_threshold}, false) AS INTEGER) AS target_achieved,
             CAST({fold} AS INTEGER) AS drug_code FROM p),
g AS (SELECT * EXCLUDE (drug_type, drug_code, weight_unit), drug_code AS drug_type FROM f WHERE drug_code IS NOT NULL)
"""
    if mode == "hard":
        crit = _criteria_sql(spec)
        body = f"SELECT * EXCLUDE (t2dm, metformin, dosage) FROM g WHERE {crit}"
    else:
        th = spec.thresholds
        body = "SELECT * REPLACE (" + ", ".join(
            f"CAST(CASE WHEN {c} <= {t} THEN 0 WHEN {c} > {t} THEN 1 END AS DOUBLE) AS {c}" for c, t in th.items()) \
            + ") FROM g"
    return base + f", out AS ({body}) SELECT " + ", ".join(_clin_out_sql()) + " FROM out"


def _known_sql(spec):
    if spec.name == "liraglutide":
        return ("start_weight IS NOT NULL AND (end_weight IS NOT NULL OR weight_change IS NOT NULL "
                "OR percentage_weight_change IS NOT NULL)")
    return "end_weight IS NOT NULL OR weight_change IS NOT NULL OR percentage_weight_change IS NOT NULL"


def _criteria_sql(spec):
    hb = "((start_HbA1c >= 7 AND start_HbA1c <= 10.5) OR start_HbA1c IS NULL)"
    t2 = f"((t2dm = 1 OR t2dm IS NULL) AND {hb})"
    met = "(metformin = 1 OR metformin IS NULL)"
    if spec.name == "liraglutide":
        dose = "((drug_type = 0 AND dosage = 1) OR (drug_type = 1 AND dosage = 1.2) OR dosage IS NULL)"
        return " AND ".join(f"coalesce({c}, false)" for c in (t2, met, dose))
    bmi = "(bmi >= 25 OR bmi IS NULL)"
    dose = "((drug_type = 0 AND dosage = 1) OR (drug_type = 1 AND dosage = 5) OR dosage IS NULL)"
    return " AND ".join(f"coalesce({c}, false)" for c in (t2, met, bmi, dose))


CLIN_OUT = ("unit_id", "drug_type", "target_achieved", "age", "sex", "country", "bmi", "start_HbA1c", "start_weight",
            "end_weight", "weight_change", "percentage_weight_change", "duration_days")


def _clin_out_sql():
    out = []
    for c in CLIN_OUT:
        if c in ("unit_id",):
            out.append(c)
        elif c in ("drug_type", "target_achieved"):
            out.append(f"CAST({c} AS INTEGER) AS {c}")
        else:
            out.append(f"round(CAST({c} AS DOUBLE), 6) AS {c}")
    return out


def _clin_out(df):
    cols = []
    for c in CLIN_OUT:
        if c == "unit_id":
            cols.append(F.col(c))
        elif c in ("drug_type", "target_achieved"):
            cols.append(F.col(c).cast("int").alias(c))
        else:
            cols.append(r6(F.col(c).cast("double")).alias(c))
    return df.select(*cols)


@register("discretize_liraglutide_hard", _clinical_sql(LIRAGLUTIDE, "hard"))
def discretize_liraglutide_hard(spark, sf):
    """C16 hard mode: B14 -> B15 -> C9/C10 -> C11 -> C12 -> C9/B18 -> B16."""
    a = derived(spark, sf, TB.CLINICAL_ANSWERS_SQL, TB.CLINICAL_NEEDS).drop("target_achieved_raw")
    return _clin_out(discretize.discretize_clinical(a, LIRAGLUTIDE, mode="hard"))


@register("discretize_tirzepatide_soft", _clinical_sql(TIRZEPATIDE, "soft_inf"))
def discretize_tirzepatide_soft(spark, sf):
    """C16 soft mode with binarisation (C13) for inference."""
    a = derived(spark, sf, TB.CLINICAL_ANSWERS_SQL, TB.CLINICAL_NEEDS).drop("target_achieved_raw")
    return _clin_out(discretize.discretize_clinical(a, TIRZEPATIDE, mode="soft_inf"))


# further plan modules register themselves on import
from causeway.plans import q_baseline, q_clinical, q_dialog, q_effects, q_misc, q_models  # noqa: E402,F401
