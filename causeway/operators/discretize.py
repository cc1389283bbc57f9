"""Turning extracted answers into coded covariates.

One engine, driven by a ``StudySpec``: the six studies differ only in data.
Random imputation (I6) uses the keyed draw ``u(seed, field, unit_id)`` so the
result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from causeway.functions import codes as C
from causeway.functions.draws import uniform
from causeway.operators.clean import unknown_to_null
from causeway.spec import (EMAIL_CHANNEL_RECODE, EMAIL_HISTORY_EDGES, EMAIL_HISTORY_SEGMENTS, EMAIL_RECENCY_EDGES,
                           EMAIL_TREATMENT_BINARY, EMAIL_TREATMENT_RECODE, EMAIL_ZIP_RECODE, KG_TO_LB, RETAIL_AGE_THRESHOLD,
                           RETAIL_BINS, StudySpec)

YES_NO = {"No": 0, "Yes": 1}


# ----------------------------------------------------------------------------- answers

def parse_answers(df: DataFrame, col: str, fields, post_col: str = "post") -> DataFrame:
    """Model JSON answer -> one STRING column per field (bad JSON -> NULLs),
    original text kept under ``post``."""
    schema = StructType([StructField(f, StringType(), True) for f in fields])
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    out = df.withColumn("_ans", parsed)
    return out.select(*[c for c in df.columns if c != col], *[F.col("_ans")[f].alias(f) for f in fields]) \
        if post_col in df.columns else out.select(*df.columns, *[F.col("_ans")[f].alias(f) for f in fields])


def coalesce_known(known: DataFrame, inferred: DataFrame, key: str, fields) -> DataFrame:
    """Extracted value wins, inferred value only fills NULLs (aligned by key)."""
    inf = inferred.select(key, *[F.col(f).alias("_inf_" + f) for f in fields])
    j = known.join(inf, key, "left")
    return j.withColumns({f: F.coalesce(F.col(f), F.col("_inf_" + f).cast(known.schema[f].dataType))
                          for f in fields}).drop(*["_inf_" + f for f in fields])


def encode(df: DataFrame, spec: StudySpec, fields=None, prefix: str = "") -> DataFrame:
    """Labels and their aliases -> option positions for ``prefix + field`` columns."""
    fields = fields or [f for f in spec.options if prefix + f in df.columns]
    return df.withColumns({prefix + f: C.encode_options(spec.options[f], prefix + f, spec.aliases.get(f)) for f in fields})


def decode(df: DataFrame, spec: StudySpec, fields=None, prefix: str = "") -> DataFrame:
    """Option positions -> labels (``spec.decode_labels`` where they differ from the options)."""
    fields = fields or [f for f in spec.options if prefix + f in df.columns]
    return df.withColumns({prefix + f: C.decode_options(spec.decode_labels.get(f, spec.options[f]), prefix + f) for f in fields})


# ----------------------------------------------------------------------------- clinical

def allow_list_filter(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Treatment answer on the allow-list and the outcome known."""
    return df.where(F.col(spec.z).isin(*spec.allowed_treatments) & spec.outcome_known())


def inclusion_filter(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Every criterion satisfied or unknown; criterion columns dropped."""
    crit = spec.criteria()
    score = sum(F.coalesce(c, F.lit(False)).cast("int") for c in crit)
    drop = [c for c in spec.criteria_drop if c in df.columns]
    return df.where(score == len(crit)).drop(*drop)


def fold_treatment(spec: StudySpec, c: str):
    """Raw treatment answer -> 0/1 code (NULL if not folded)."""
    m = {}
    for code, names in spec.treatment_folds.items():
        for n in names:
            m.setdefault(n, code)
    return C.lookup(m, c).cast("int")


def discretize_clinical(df: DataFrame, spec: StudySpec, mode: str = "hard") -> DataFrame:
    """C16.  mode: 'hard' (B15 + B16 filters), 'soft_inf' (C13 binarisation) or 'soft'."""
    out = unknown_to_null(df)                                                            # B14
    if mode == "hard":
        out = allow_list_filter(out, spec)                                               # B15
    cols = set(out.columns)
    upd = {}
    for f, m in spec.aliases.items():                                                    # C9 (sex, country)
        if f in cols:
            upd[f] = C.fold_or_number(m, f)
    for f in spec.numeric_fields:                                                        # C10
        if f in cols and f not in upd:
            upd[f] = C.to_number(f)
    for f in spec.yes_no_fields:
        if f in cols and f != spec.y:
            upd[f] = C.fold_or_number(YES_NO, f)
    out = out.withColumns(upd)
    if "weight_unit" in cols:                                                            # C11
        kg = F.coalesce(F.col("weight_unit") == "kg", F.lit(False))
        out = out.withColumns({f: F.when(kg, F.col(f) * KG_TO_LB).otherwise(F.col(f))
                               for f in ("start_weight", "end_weight", "weight_change") if f in cols})
        out = out.drop("weight_unit")
    if spec.outcome_threshold is not None:                                               # C12
        change = F.when(F.col("percentage_weight_change").isNull() & F.col("weight_change").isNull(),
                        F.col("end_weight") - F.col("start_weight")).otherwise(F.col("weight_change"))
        out = out.withColumn("weight_change", change)
        pct = F.coalesce(F.col("percentage_weight_change"),
                         F.lit(100.0) * F.try_divide(F.col("weight_change"), F.col("start_weight")))
        out = out.withColumn("percentage_weight_change", pct)
        out = out.withColumn(spec.y, F.coalesce(F.col("percentage_weight_change") <= spec.outcome_threshold,
                                                F.lit(False)).cast("int"))
    elif spec.y in cols:
        out = out.withColumn(spec.y, C.fold_or_number(YES_NO, spec.y).cast("int"))
    out = out.withColumn(spec.z, fold_treatment(spec, spec.z)).where(F.col(spec.z).isNotNull())   # C9 + B18
    if mode == "hard":
        out = inclusion_filter(out, spec)                                                # B16
    elif mode == "soft_inf":
        out = out.withColumns({f: C.binarise(f, t) for f, t in spec.thresholds.items() if f in out.columns})
    return out


# ----------------------------------------------------------------------------- marketing

def discretize_email(df: DataFrame, seed: int = 10, id_col: str = "unit_id") -> DataFrame:
    """C17 for the email-marketing study.  Only a NULL or Unknown answer is imputed; a
    label outside the study's stays without a code (NULL)."""
    out = unknown_to_null(df)
    cols = set(out.columns)
    upd = {}
    if "history" in cols:
        upd["history"] = impute_expr(C.ladder(C.to_number("history"), EMAIL_HISTORY_EDGES), 7, seed, "history", id_col)
    if "recency" in cols:
        upd["recency"] = impute_expr(C.ladder(C.to_number("recency"), EMAIL_RECENCY_EDGES), 3, seed, "recency", id_col)
    for f in ("mens", "womens", "newbie", "email_type", "visit"):
        if f in cols:
            upd[f] = impute_answer(C.fold_or_number(YES_NO, f), f, 2, seed, id_col)
    if "zip_code" in cols:
        upd["zip_code"] = impute_answer(C.lookup({"Suburban": 0, "Rural": 1, "Urban": 2}, "zip_code"), "zip_code", 3,
                                        seed, id_col)
    if "channel" in cols:
        upd["channel"] = impute_answer(C.lookup({"Phone": 0, "Web": 1, "Multichannel": 2}, "channel"), "channel", 3,
                                       seed, id_col)
    return out.withColumns(upd)


def impute_expr(code, n_options: int, seed: int, tag: str, id_col: str):
    return F.coalesce(code.cast("int"), F.floor(uniform(seed, tag, id_col) * n_options).cast("int"))


def impute_answer(code, answer: str, n_options: int, seed: int, id_col: str):
    """I6 for labels: a draw where the answer itself is NULL, else its code (NULL if it has none)."""
    return F.when(F.col(answer).isNull(), F.floor(uniform(seed, answer, id_col) * n_options).cast("int")) \
        .otherwise(code.cast("int"))


def discretize_retail(df: DataFrame, seed: int = 10, id_col: str = "unit_id") -> DataFrame:
    """C17 for the retail-SMS study.  Missing ages are drawn uniformly from the
    observed distinct ages (a numbered domain table that only they are joined with)."""
    from causeway.operators.sampling import domain, draw_from_domain
    out = unknown_to_null(df)
    cols = set(out.columns)
    if "age" in cols:
        out = out.withColumn("age", C.to_number("age"))
        out = out.withColumn("age_binary", impute_expr(C.binarise("age", RETAIL_AGE_THRESHOLD), 2, seed,
                                                       "age_binary", id_col))
        out = draw_from_domain(out, "age", domain(out, "age", seed), uniform(seed, "age", id_col), F.col("age").isNull(), id_col)
    upd = {}
    for f, edges in RETAIL_BINS.items():
        if f in cols:
            upd[f] = impute_expr(C.right_closed_bin(C.to_number(f), edges), len(edges) - 1, seed, f, id_col)
    for f in ("purchase", "sms_communication"):
        if f in cols:
            upd[f] = impute_answer(C.fold_or_number(YES_NO, f), f, 2, seed, id_col)
    return out.withColumns(upd)


def recode_email_trial(df: DataFrame) -> DataFrame:
    """Trial-table recodes (history segment, zip code, channel, treatment, binary treatment)."""
    seg = {s: i for i, s in enumerate(EMAIL_HISTORY_SEGMENTS)}
    return df.withColumns({
        "history_segment": C.recode_with_default(seg, 6, "history_segment"),
        "zip_code": C.recode_with_default(EMAIL_ZIP_RECODE, 2, "zip_code"),
        "channel": C.recode_with_default(EMAIL_CHANNEL_RECODE, 2, "channel"),
        "treatment_binary": C.lookup(EMAIL_TREATMENT_BINARY, "treatment").cast("int"),
        "treatment": C.lookup(EMAIL_TREATMENT_RECODE, "treatment").cast("int"),
    })
