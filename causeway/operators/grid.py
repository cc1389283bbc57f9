"""Option grids and empirical distributions.

The grid is built from ``spark.range`` with index arithmetic (row-major, last
field fastest), so no cross join is needed; its size is the product of the
option-list lengths, fixed by the spec.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.spec import StudySpec

ANSWER_LETTERS = ("a) ", "b) ", "c) ", "d) ")   # fixed values: at most four lettered options


def strides(shape):
    out = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        out[i] = out[i + 1] * shape[i + 1]
    return out


def cell_index(fields, shape):
    """Row-major flat index of the code columns ``fields``."""
    st = strides(shape)
    return reduce(lambda a, b: a + b, [F.col(f).cast("int") * s for f, s in zip(fields, st)]).cast("int")


def option_grid(spark: SparkSession, spec: StudySpec, fields, prefix: str = "") -> DataFrame:
    """One row per grid cell: ``cell`` plus one code column per field."""
    shape = spec.shape(fields)
    n = 1
    for s in shape:
        n *= s
    st = strides(shape)
    g = spark.range(n).withColumnRenamed("id", "cell").withColumn("cell", F.col("cell").cast("int"))
    return g.select("cell", *[(F.floor(F.col("cell") / s) % k).cast("int").alias(prefix + f)
                              for f, s, k in zip(fields, st, shape)])


def option_labels(spark: SparkSession, spec: StudySpec, fields) -> DataFrame:
    """Grid with the label of each field (struct columns, no string round trip)."""
    g = option_grid(spark, spec, fields)
    for f in fields:
        arr = F.array(*[F.lit(x) for x in spec.options[f]])
        g = g.withColumn(f + "_label", F.element_at(arr, F.col(f) + 1))
    return g


def question(spec: StudySpec, f: str) -> str:
    if f not in spec.questions:
        raise KeyError(f"study {spec.name!r} has no question for {f!r}")
    return spec.questions[f]


def option_prompts(spark: SparkSession, spec: StudySpec, fields) -> DataFrame:
    """C20: multiple-choice text per grid option (question, lettered options, answer)."""
    g = option_labels(spark, spec, fields)
    parts = [F.lit(" \n\n## Questions")]
    for f in fields:
        opts = "".join(ANSWER_LETTERS[i] + o + " " for i, o in enumerate(spec.options[f]))
        parts += [F.lit(" \n\nQ: " + question(spec, f) + " \nOptions: " + opts + " \nA: "),
                  F.col(f + "_label")]
    return g.withColumn("option_text", F.concat(*parts))


def known_answers_text(df: DataFrame, spec: StudySpec, fields, prefix: str = "sample_") -> DataFrame:
    """C21: " ## Questions and their correct answers" + "Q: … A: <label>." per field."""
    parts = [F.lit(" \n\n## Questions and their correct answers")]
    for f in fields:
        arr = F.array(*[F.lit(x) for x in spec.options[f]])
        parts += [F.lit("\nQ: " + question(spec, f) + " A: "),
                  F.coalesce(F.element_at(arr, F.col(prefix + f).cast("int") + 1), F.lit("")), F.lit(".")]
    return df.withColumn("known_answers", F.concat(*parts))


def expand_options(units: DataFrame, options: DataFrame) -> DataFrame:
    """One scoring input per (unit, grid option), for every option of ``options`` (whose
    ``cell`` numbers them from 0).  Each unit explodes the option indices and picks the
    attributes by an equi-join on the cell index (the grid is the spec's fixed, small table)."""
    last = options.agg(F.max("cell")).scalar()
    ex = units.withColumn("cell", F.explode(F.sequence(F.lit(0), last)))
    return ex.join(F.broadcast(options), "cell")


def collect_scores(scored: DataFrame, unit: str, idx: str = "cell", score: str = "loglik") -> DataFrame:
    """C22 back: per-unit ordered score array (one value per grid option)."""
    return (scored.groupBy(unit)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(score).alias("v")))).alias("_s"))
            .select(unit, F.transform("_s", lambda s: s["v"]).alias(score)))


def empirical_joint(df: DataFrame, spec: StudySpec, fields, by=()) -> DataFrame:
    """E5 + D8: relative frequency of every grid cell (zeros included), per ``by`` group."""
    by = list(by)
    shape = spec.shape(fields)
    counts = (df.withColumn("cell", cell_index(fields, shape))
              .groupBy(*by, "cell").agg(F.count("*").alias("n")))
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    n_cells = 1
    for k in shape:
        n_cells *= k
    # every group gets every cell (explode of the fixed cell range, not a join)
    if by:
        frame = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    else:
        frame = (df.sparkSession.range(n_cells).select(F.col("id").cast("int").alias("cell"))
                 .withColumn("total", df.select(F.count("*")).scalar()))
    j = frame.join(counts, [*by, "cell"], "left")
    return j.select(*by, "cell", (F.coalesce(F.col("n"), F.lit(0)) / F.col("total")).alias("freq"))


def _grid_size(spec, fields):
    n = 1
    for k in spec.shape(fields):
        n *= k
    return n


def stratum_propensity(df: DataFrame, spec: StudySpec, strata, z: str, by=(), grid: bool = True) -> DataFrame:
    """Per stratum (n0, n1) and (e0, e1) = (n0, n1)/(n0+n1); empty cells (0, 0)."""
    by = list(by)
    agg = (df.groupBy(*by, *strata)
           .agg(F.count_if(F.col(z) == 0).alias("n0"), F.count_if(F.col(z) == 1).alias("n1")))
    if grid:
        cells = option_grid(df.sparkSession, spec, strata)
        if by:
            n_cells = _grid_size(spec, strata)
            keys = df.select(*by).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
            cells = keys.join(F.broadcast(cells), "cell")
        agg = cells.join(agg, [*by, *strata], "left").na.fill(0, ["n0", "n1"])
    tot = F.col("n0") + F.col("n1")
    return agg.withColumns({"e0": F.when(tot > 0, F.col("n0") / tot).otherwise(0.0),
                            "e1": F.when(tot > 0, F.col("n1") / tot).otherwise(0.0)})


def array_totals(df: DataFrame, probs: str, by=(), size: int | None = None) -> DataFrame:
    """E7 building block: element-wise sum and count of probability arrays per group,
    one output row per cell.  A unit whose array is NULL is in no sum and no count.  With
    the array size given (a spec grid) the positions are summed column-wise in one hash
    aggregate and an array of any other length is an error; without it the positions are
    exploded and summed per group.  Both give the same totals."""
    by = list(by)
    df = df.where(F.col(probs).isNotNull())
    if size is not None:
        whole = F.when(F.size(probs) == size, F.col(probs)).otherwise(
            F.raise_error(F.concat(F.lit(f"array of length {size} expected, got "), F.size(probs).cast("string"))))
        df = df.withColumn(probs, whole)
        sums = [F.sum(F.element_at(F.col(probs), F.lit(i + 1))).alias(f"_s{i}") for i in range(size)]
        agg = df.groupBy(*by).agg(*sums, F.count("*").alias("n"))
        cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"_s{i}").alias("s")) for i in range(size)])
        return agg.select(*by, "n", F.explode(cells).alias("_c")).select(*by, "_c.pos", "_c.s", "n")
    return (df.select(*by, F.posexplode(probs).alias("pos", "p"))
            .groupBy(*by, "pos").agg(F.sum("p").alias("s"), F.count("*").alias("n")))


def array_mean(df: DataFrame, probs: str, by=()) -> DataFrame:
    """Element-wise mean of probability arrays, as (pos, mean) rows per group."""
    return array_totals(df, probs, by).select(*by, "pos", (F.col("s") / F.col("n")).alias("mean"))


def marginalise(df: DataFrame, probs: str, shape, keep_axes, unit: str) -> DataFrame:
    """C26 in table form: (unit, kept-cell, p) rows summed over the dropped axes."""
    st = strides(shape)
    kept = [a for a in range(len(shape)) if a in keep_axes]
    kst = strides([shape[a] for a in kept])
    ex = df.select(unit, F.posexplode(probs).alias("pos", "p"))
    idx = reduce(lambda a, b: a + b, [(F.floor(F.col("pos") / st[a]) % shape[a]) * kst[k] for k, a in enumerate(kept)])
    return ex.withColumn("cell", idx.cast("int")).groupBy(unit, "cell").agg(F.sum("p").alias("p"))
