"""Post curation filters.

Each filter is one ``where`` over native expressions, so Catalyst pushes what it
can into the scan and fuses the rest into one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import codes as C
from causeway.functions import text as T
from causeway.functions.arrays import let


def rule_predicate(text: str, is_comment: bool, author: str = "author", score: str = "score",
                   permalink: str = "permalink"):
    """B8 = B1 ∧ B2 ∧ B3 ∧ (B4 for comments) ∧ B5 ∧ B6 ∧ B7.  The normalised text is
    used only for the test; rows keep their original text."""
    p = (F.col(text).isNotNull() & F.col(permalink).isNotNull()       # B1
         & F.col(score).isNotNull()                                     # B2
         & T.not_tombstone(text)                                        # B3
         & T.human_author(author))                                      # B5
    if is_comment:
        p = p & T.long_enough(text)                                     # B4
    # the normalised text is made once a row, for both rules that read it
    return p & let(T.normalise(text), lambda norm: T.has_word_break(norm) & T.alpha_ratio_ok(norm))     # B6, B7


def rule_filter(df: DataFrame, text: str, is_comment: bool, author: str = "author", score: str = "score",
                permalink: str = "permalink") -> DataFrame:
    return df.where(rule_predicate(text, is_comment, author, score, permalink))


def date_cutoff(df: DataFrame, epoch_col: str, cutoff: int) -> DataFrame:
    """Keep rows created at or before ``cutoff`` (epoch seconds)."""
    return df.where(F.col(epoch_col) <= F.lit(cutoff))


def mention_filter(df: DataFrame, text_cols, terms, out: str, method: str = "scan") -> DataFrame:
    """Attach the sorted distinct matched terms, keep rows with at least one.
    ``method``: 'scan' (one substring scan per term) or 'one_pass' (all terms together)."""
    return df.withColumn(out, T.mention_terms(text_cols, terms, method)).where(F.size(out) > 0)


def verdict_filter(df: DataFrame, answer: str, mode: str = "strict") -> DataFrame:
    """B12 (strict: exactly 'yes') or B13 (lenient: 'yes' and no 'no')."""
    pred = T.strict_yes(answer) if mode == "strict" else T.lenient_yes(answer)
    return df.where(pred)


def unknown_to_null(df: DataFrame, cols=None) -> DataFrame:
    """B14 over every string column (or ``cols``)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: C.unknown_to_null(c) for c in cols})


def keep_first(df: DataFrame, keys, order: str, extra: dict | None = None) -> DataFrame:
    """one row per key, the one with the smallest ``order``.

    Written as a grouped ``min_by`` rather than a ``row_number`` window: the
    aggregate is combined map-side, so a key repeated across a third of the
    table is reduced before the shuffle instead of landing in one task.  ``extra``
    adds aggregates over each key group (e.g. the number of copies) to the same pass."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in df.columns if c not in keys]
    extra = extra or {}
    more = [v.alias(k) for k, v in extra.items()]
    if others == [order]:
        # only the order column rides along: a plain min is a hash aggregate
        return df.groupBy(*keys).agg(F.min(order).alias(order), *more).select(*df.columns, *extra)
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_first"), *more)
    return agg.select(*keys, *[F.col("_first." + c).alias(c) for c in others], *extra).select(*df.columns, *extra)


def digest(c) -> Column:
    """256 bits that stand for a text as a key (NULL for NULL)."""
    return F.unhex(F.sha2(F.col(c) if isinstance(c, str) else c, 256))


def keep_first_text(df: DataFrame, text: str, order: str, extra: dict | None = None, columns=()) -> DataFrame:
    """F1 by digest: (order, ``columns``, ``extra``) of the first row of each text.  The text is
    neither a key nor carried along: 32 bytes a row are shuffled, combined map-side.  A NULL
    text is a text of its own."""
    rows = df.select(digest(text).alias("_digest"), order, *columns)
    more = [v.alias(k) for k, v in (extra or {}).items()]
    if not columns:
        return rows.groupBy("_digest").agg(F.min(order).alias(order), *more).drop("_digest")
    first = F.min_by(F.struct(*columns), F.col(order)).alias("_first")
    agg = rows.groupBy("_digest").agg(F.min(order).alias(order), first, *more)
    return agg.select(order, *[F.col(f"_first.{c}").alias(c) for c in columns], *(extra or {}))


def lookup_first(posts: DataFrame, samples: DataFrame, text: str, order: str, columns, verify: bool = True) -> DataFrame:
    """D3 + F2: every post with ``columns`` of the first sample (by ``order``) of the same text;
    posts without one, or without a text, get NULLs.

    Rows meet by a digest of the text, so a key is 32 bytes.  With ``verify`` the first
    sample's text rides along and must equal the post's, which makes the match exact even if
    two texts shared a digest.  Samples of one text are combined map-side."""
    columns = list(columns)
    keep = [*columns, *([text] if verify else [])]
    first = (samples.where(F.col(text).isNotNull()).groupBy(digest(text).alias("_digest"))
             .agg(F.min_by(F.struct(*keep), F.col(order)).alias("_first")))
    joined = posts.withColumn("_key", digest(text)).join(first, F.col("_key") == F.col("_digest"), "left")
    same = F.col(text) == F.col(f"_first.{text}") if verify else F.col("_digest").isNotNull()
    return joined.select(*posts.columns, *[F.when(same, F.col(f"_first.{c}")).alias(f"first_{c}") for c in columns])


def align(left: DataFrame, right: DataFrame, key: str = "unit_id") -> DataFrame:
    """Both tables by key, every key that either has, with ``side`` ('both', 'left', 'right').

    A NULL key aligns with nothing.  Columns of the same name are an error, as is a key that
    a table repeats: alignment is one to one, so a repeated key is never multiplied out."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")

    def once(df, mark):
        others = [c for c in df.columns if c != key]
        g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(1).alias(mark), *others)).alias("_r"))
        single = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))))
        return g.select(key, single.alias("_r")).select(key, "_r.*")

    j = once(left, "_in_left").join(once(right, "_in_right"), key, "full_outer")
    side = F.when(F.col("_in_right").isNull(), "left").when(F.col("_in_left").isNull(), "right").otherwise("both")
    return j.withColumn("side", side).drop("_in_left", "_in_right")


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def subset(df: DataFrame, ids: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows whose key is in an id table (e.g. one evaluation trial) -- a semi-join,
    never a positional index."""
    return df.join(ids.select(key), key, "left_semi")


def first_n(df: DataFrame, n: int, order: str = "unit_id") -> DataFrame:
    """G1: the first ``n`` rows in source order, with the order made explicit.  Used
    where the size cap is the feature (a configured dataset size)."""
    return df.orderBy(order).limit(n)
