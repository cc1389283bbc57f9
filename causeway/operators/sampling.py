"""Reproducible sampling (I1-I3, I6-I11) on keyed uniform draws.

Every draw is ``u(seed, tag, id)`` (see ``functions.draws``): independent of
partitioning, re-computable after an executor loss, and reproducible in SQL.

Exact-size selection without replacement (I2, I3) is "the k smallest u per
group".  A ``row_number`` window over a whole group would put a hot group (a
third of the table) in one task, so instead:

1. histogram the draws per group into ``bins`` buckets (a grouped count,
   combined map-side),
2. find per group the bucket holding the k-th draw (window over the small
   histogram only),
3. take every row below that bucket, and rank only the rows *inside* the
   boundary bucket (about n / bins rows per group, bins = 2^14: a map task sends at
   most that many counts a group, and a group of 10^10 rows ranks about 610,000).

Weighted resampling with replacement (I1) picks a (treatment, confounder) cell
from a four-row table and then a unit by its rank inside the cell (equi-join on
rank), never a nested-loop range join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.draws import uniform, uniform_seed_col
from causeway.session import cut_lineage

BINS = 1 << 14


# ------------------------------------------------------------------ exact k smallest per group

def rank_select(df: DataFrame, by, ks: dict, u: str, tie: str, bins: int = BINS) -> DataFrame:
    """Keep the rows whose rank by ``(u, tie)`` inside their ``by`` group is within the
    largest of ``ks`` (name -> int or per-group column), and flag for every name whether
    the row is within that k (boolean column ``in_<name>``).

    Plan: one grouped histogram of ``floor(u * bins)`` (map-side combined), a
    window over the histogram only (prefix counts per group), a per-group
    threshold table (one row per group), and a window over the rows of the
    boundary bins only -- about n / bins rows per group, however hot the group."""
    by = list(by)
    # the input is read twice (histogram, then selection); materialising it was measured
    # slower than re-reading it here, so the plan re-reads (callers may persist)
    x = df.withColumn("_bin", F.least(F.floor(F.col(u) * bins).cast("int"), F.lit(bins - 1)))
    kcols = {}
    for name, k in ks.items():
        kcols[name] = f"_k_{name}"
        x = x.withColumn(kcols[name], F.lit(k).cast("bigint") if not isinstance(k, str) else F.col(k).cast("bigint"))
    hist = x.groupBy(*by, "_bin").agg(F.count("*").alias("_cnt"), *[F.first(c).alias(c) for c in kcols.values()])
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w))
    aggs = []
    for name, kc in kcols.items():
        # primitive aggregates only, so the threshold stays a hash aggregate
        reached = F.when(F.col("_cum") >= F.col(kc), F.col("_bin"))
        aggs += [F.min(reached).alias(f"_b_{name}"),
                 F.min_by(F.col(kc) - (F.col("_cum") - F.col("_cnt")), reached).alias(f"_need_{name}")]
    th = hist.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*aggs)
    # null-safe: rows whose group is NULL are a group like any other
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
    j = x.drop(*kcols.values()).join(th, same, "left").drop(*[f"_g_{c}" for c in by])
    bcols = [F.col(f"_b_{n}") for n in ks]
    any_open = reduce(lambda a, b: a | b, [c.isNull() for c in bcols])
    top = F.greatest(*bcols) if len(bcols) > 1 else bcols[0]
    sel = j.where(any_open | (F.col("_bin") <= top))
    is_boundary = reduce(lambda a, b: a | b, [F.coalesce(F.col("_bin") == c, F.lit(False)) for c in bcols])
    rw = Window.partitionBy(*by, "_bin").orderBy(F.col(u), F.col(tie))
    boundary = sel.where(is_boundary).withColumn("_r", F.row_number().over(rw))
    rest = sel.where(~is_boundary).withColumn("_r", F.lit(None).cast("int"))
    allr = boundary.unionByName(rest)
    for name in ks:
        b, need = F.col(f"_b_{name}"), F.col(f"_need_{name}")
        allr = allr.withColumn(f"in_{name}", b.isNull() | (F.col("_bin") < b) | ((F.col("_bin") == b) & (F.col("_r") <= need)))
    keep = reduce(lambda a, b: a | b, [F.col(f"in_{n}") for n in ks])
    drop = ["_bin", "_r"] + [f"_b_{n}" for n in ks] + [f"_need_{n}" for n in ks]
    return allr.where(keep).drop(*drop)


def take_smallest(df: DataFrame, by, k, u: str, tie: str, bins: int = BINS) -> DataFrame:
    """Rows with the ``k`` smallest ``(u, tie)`` in each ``by`` group (all rows if fewer)."""
    return rank_select(df, by, {"k": k}, u, tie, bins).drop("in_k")


# ------------------------------------------------------------------ I3 trials

def trials(df: DataFrame, k: int, size: int, seed: int, id_col: str = "unit_id") -> DataFrame:
    """``k`` subsamples of ``size`` rows without replacement; trial i uses seed+i.
    Output carries a ``trial`` column; every trial runs in the same job."""
    ex = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ex = ex.withColumn("_u", uniform_seed_col(F.lit(seed) + F.col("trial"), "trial", id_col))
    return take_smallest(ex, ["trial"], size, "_u", id_col).drop("_u")


# ------------------------------------------------------------------ I2 stratified split

def allocate(counts: DataFrame, strata, total, n_col: str = "n", out: str = "k") -> DataFrame:
    """Largest-remainder allocation of ``total`` (a number or a Column over ``counts``) over
    strata proportional to ``n`` (ties by stratum key).  ``counts`` has one row per stratum."""
    strata = list(strata)
    g = Window.partitionBy()
    c = counts.withColumn("_N", F.sum(n_col).over(g)).withColumn("_total", F.lit(total) if isinstance(total, int) else total)
    c = c.withColumn("_num", F.col(n_col) * F.col("_total"))
    c = c.withColumn("_base", F.floor(F.col("_num") / F.col("_N")).cast("bigint"))
    c = c.withColumn("_rem", F.col("_num") - F.col("_base") * F.col("_N"))
    c = c.withColumn("_deficit", F.col("_total") - F.sum("_base").over(g))
    r = Window.orderBy(F.col("_rem").desc(), *[F.col(s) for s in strata])
    c = c.withColumn("_rank", F.row_number().over(r))
    return c.withColumn(out, (F.col("_base") + (F.col("_rank") <= F.col("_deficit")).cast("bigint"))) \
        .drop("_N", "_total", "_num", "_base", "_rem", "_deficit", "_rank")


def _part(size, rows: Column) -> Column:
    """A part's rows: a whole number of them, or a share (below 1) of the table's."""
    return F.floor(rows * F.lit(size)).cast("bigint") if isinstance(size, float) else F.lit(int(size)).cast("bigint")


def stratified_split(df: DataFrame, strata, train_size, test_size, seed: int, id_col: str = "unit_id") -> DataFrame:
    """Exact-size train / val split stratified by ``strata`` (e.g. treatment and
    outcome), without replacement.  A size is a number of rows or, as a float, a share of the
    table.  Adds ``split`` in {"train", "val"}; rows in neither are dropped.  A table with
    fewer rows than both parts need is an error, not a short split.  The allocation runs on
    the per-stratum count table (one row per stratum)."""
    strata = list(strata)
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    rows = F.sum("n").over(Window.partitionBy())
    need = _part(train_size, rows) + _part(test_size, rows)
    enough = F.when(need > rows, F.raise_error(F.concat(F.lit("a split of "), need.cast("string"), F.lit(" rows from "), rows.cast("string")))
                    .cast("bigint")).otherwise(_part(train_size, rows))
    counts = counts.withColumn("_train", enough).withColumn("_val", _part(test_size, rows))
    alloc = allocate(counts, strata, F.col("_train"), out="k_train")
    alloc = allocate(alloc.withColumn("n_rest", F.col("n") - F.col("k_train")), strata, F.col("_val"), n_col="n_rest", out="k_val")
    alloc = alloc.select(*strata, "k_train", (F.col("k_train") + F.col("k_val")).alias("k_all"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata])
    alloc = alloc.withColumnsRenamed({c: f"_s_{c}" for c in strata})
    x = df.join(F.broadcast(alloc), same).drop(*[f"_s_{c}" for c in strata]).withColumn("_u", uniform(seed, "split", id_col))
    chosen = rank_select(x, strata, {"train": "k_train", "all": "k_all"}, "_u", id_col)
    return chosen.withColumn("split", F.when(F.col("in_train"), "train").otherwise("val")) \
        .drop("in_train", "in_all", "_u", "k_train", "k_all")


# ------------------------------------------------------------------ I1 confounded resample

TWO_32 = 4294967296
TWO_64 = 18446744073709551616


def _h(seed, tag, col) -> Column:
    """Raw 32-bit keyed hash (the integer behind ``uniform``)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(col).cast("string"))),
                              1, 8), 16, 10).cast("decimal(38,0)")


#: Keyed buckets in which a cell's units are numbered.  Fixed, so a draw never depends on the
#: number of rows; a bucket of a table of 10^11 rows numbers about 1.5 million.
BUCKETS = 1 << 16


def confounded_resample(df: DataFrame, x: str, t: str, propensity: float, seed: int, n_draws=None,
                        id_col: str = "unit_id", scale: int = 10_000, buckets: int = BUCKETS) -> DataFrame:
    """Draw n units with replacement, weight ``t ex / n1 + (1 - t)(1 - ex) / n0``,
    ``ex = p (1 - x) + (1 - p) x`` (x, t binary).

    The weight depends only on the cell (t, x), so a draw is: pick a cell with
    probability n_c w_c / sum (four-row table, exact integer weights with the
    propensity in 1/scale units), then pick a unit uniformly inside the cell by
    its rank.  Ranks come from keyed buckets: per-(cell, bucket) counts and their
    prefix offsets form a table of at most 4 x buckets rows, and a unit's rank is
    offset + its position inside the bucket -- no window ever spans a whole cell.
    All position arithmetic is exact (DECIMAL(38,0) and integral division), so the
    draws are reproducible in SQL.  The offsets join the units on the key by which the
    numbering has already dealt them; nothing is counted, cached or broadcast but the cells."""
    spark = df.sparkSession
    p = int(round(propensity * scale))
    u = (df.select(id_col, F.col(t).cast("int").alias("_t"), F.col(x).cast("int").alias("_x"))
         .withColumn("_bucket", F.floor(uniform(seed, "bucket", id_col) * buckets).cast("int")))
    # per (cell, bucket) counts -> small table; cell totals and weights from it
    cb = u.groupBy("_t", "_x", "_bucket").agg(F.count("*").alias("_cnt"))
    cw = Window.partitionBy("_t", "_x").orderBy("_bucket")
    cb = cb.withColumn("_off", F.sum("_cnt").over(cw.rowsBetween(Window.unboundedPreceding, -1)))
    cb = cb.withColumn("_off", F.coalesce(F.col("_off"), F.lit(0)))
    cells = cb.groupBy("_t", "_x").agg(F.sum("_cnt").alias("_nc"))
    arms = Window.partitionBy()
    cells = cells.withColumn("_n1", F.sum(F.when(F.col("_t") == 1, F.col("_nc")).otherwise(0)).over(arms))
    cells = cells.withColumn("_n0", F.sum(F.when(F.col("_t") == 0, F.col("_nc")).otherwise(0)).over(arms))
    ex = F.lit(p) * (1 - F.col("_x")) + F.lit(scale - p) * F.col("_x")
    dec = "decimal(38,0)"
    wc = F.when(F.col("_t") == 1, ex.cast(dec) * F.col("_n0").cast(dec)) \
        .otherwise((F.lit(scale) - ex).cast(dec) * F.col("_n1").cast(dec))
    cells = cells.withColumn("_W", (wc * F.col("_nc").cast(dec)).cast(dec))
    order = Window.orderBy("_t", "_x")
    cells = (cells.withColumn("_hi", F.sum("_W").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(dec))
             .withColumn("_lo", (F.col("_hi") - F.col("_W")).cast(dec))
             .withColumn("_tot", F.sum("_W").over(arms).cast(dec))
             .where(F.col("_W") > 0))
    # unit rank inside its cell
    bw = Window.partitionBy("_t", "_x", "_bucket").orderBy(id_col)
    ranked = (u.withColumn("_r", F.row_number().over(bw) - 1)
              .join(cb.select("_t", "_x", "_bucket", "_off"), ["_t", "_x", "_bucket"])
              .withColumn("_rank", (F.col("_off") + F.col("_r")).cast("bigint"))
              .select(id_col, "_t", "_x", "_rank"))
    # draws: cell by h1, rank by the 64-bit (h2, h3).  With n draws for n units the
    # draw ids are the unit ids themselves (no count job, distributed like the units);
    # an explicit n_draws uses a parallel range.
    if n_draws is None:
        d = df.select(F.col(id_col).alias("draw_id"))
    else:
        d = spark.range(0, n_draws).withColumnRenamed("id", "draw_id")
    d = d.withColumn("_h1", _h(seed, "draw", "draw_id")) \
        .withColumn("_h64", (_h(seed, "pick_hi", "draw_id") * F.lit(TWO_32).cast(dec)
                             + _h(seed, "pick_lo", "draw_id")).cast(dec))
    cond = ((F.col("_h1") * F.col("_tot") >= F.col("_lo") * F.lit(TWO_32).cast(dec))
            & (F.col("_h1") * F.col("_tot") < F.col("_hi") * F.lit(TWO_32).cast(dec)))
    d = d.join(F.broadcast(cells.select("_t", "_x", "_nc", "_lo", "_hi", "_tot")), cond)   # <= 4 cells
    d = d.withColumn("_rank", F.expr(f"(_h64 * CAST(_nc AS DECIMAL(38,0))) div CAST({TWO_64} AS DECIMAL(38,0))"))
    out = d.select("draw_id", "_t", "_x", "_rank").join(ranked, ["_t", "_x", "_rank"])
    return out.select("draw_id", id_col).join(df, id_col)


# ------------------------------------------------------------------ I6-I11 row-local draws

def impute_uniform(col: str, options: Column, seed: int, id_col: str) -> Column:
    """NULL -> uniform draw from an array of options."""
    idx = (F.floor(uniform(seed, col, id_col) * F.size(options)) + 1).cast("int")
    return F.coalesce(F.col(col), F.element_at(options, idx))


DOMAIN_BUCKETS = 256


def domain(df: DataFrame, col: str, seed: int = 0) -> DataFrame:
    """E10 as a table: (value, k, size) -- the distinct non-NULL values of a column, numbered
    from 0 by (keyed bucket, value).  Buckets are numbered on their own and shifted by a prefix
    sum over the (at most ``DOMAIN_BUCKETS``) bucket counts, so no window spans the values."""
    values = df.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    values = values.withColumn("_bucket", F.floor(uniform(seed, "domain", "value") * DOMAIN_BUCKETS).cast("int"))
    counts = values.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("value")) - 1
    return values.withColumn("_r", at).join(F.broadcast(counts), "_bucket").select("value", (F.col("_r") + F.col("_off")).cast("bigint").alias("k"), "size")


def draw_from_domain(df: DataFrame, col: str, values: DataFrame, draw: Column, where: Column, id_col: str) -> DataFrame:
    """``col`` replaced, where ``where`` holds, by the value of a ``domain`` that the uniform
    ``draw`` picks (each equally likely; an empty domain leaves it as it is).

    Only those rows take part in the join: the others get keys of their own below zero, which
    match nothing and spread over the partitions."""
    size = values.agg(F.max("size")).scalar()
    pick = F.coalesce(F.floor(draw * size).cast("bigint"), F.lit(-1))
    spread = -1 - F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    j = df.withColumn("_k", F.when(where, pick).otherwise(spread)).withColumn("_where", where)
    j = j.join(values.select(F.col("k").alias("_vk"), F.col("value").alias("_drawn")), F.col("_k") == F.col("_vk"), "left")
    return j.withColumn(col, F.when(F.col("_where"), F.coalesce("_drawn", col)).otherwise(F.col(col))).drop("_k", "_vk", "_drawn", "_where")


def uniform_baseline(df: DataFrame, cols, seed: int, id_col: str, observed: DataFrame | None = None) -> DataFrame:
    """Replace every column by a uniform draw from the values observed in it (in
    ``observed``, the table itself by default)."""
    out = df
    for c in cols:
        # checkpointed: its size and its values are read apart
        values = cut_lineage(domain(df if observed is None else observed, c, seed))
        out = draw_from_domain(out, c, values, uniform(seed, "baseline:" + c, id_col), F.lit(True), id_col)
    return out


def drop_attributes(m: Column, q: float, keep_keys, seed: int, id_col: str) -> Column:
    """Drop each X attribute with probability q; attributes outside X are removed."""
    keys = F.array(*[F.lit(k) for k in keep_keys])
    return F.map_filter(m, lambda k, v: F.array_contains(keys, k) &
                        (_u_key(seed, "drop", k, id_col) >= F.lit(q)))


def _u_key(seed, tag, key: Column, id_col: str) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), key, F.col(id_col).cast("string"))),
                           1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(4294967296.0)


def shuffle_attributes(m: Column, seed: int, id_col: str) -> Column:
    """I8: attribute order shuffled by keyed draws; returns ARRAY<STRUCT<key, value>>."""
    entries = F.map_entries(m)
    tagged = F.transform(entries, lambda e: F.struct(_u_key(seed, "order", e["key"], id_col).alias("u"),
                                                     e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(tagged), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


TRAITS = ("Extraversion", "Agreeableness", "Conscientiousness", "Neuroticism", "Openness")  # fixed values


def assign_traits(df: DataFrame, p: float, seed: int, id_col: str) -> DataFrame:
    """Five persona traits, each 'High' with probability p."""
    return df.withColumns({t: F.when(uniform(seed, "trait:" + t, id_col) < p, "High").otherwise("Low")
                           for t in TRAITS})


def round_and_label(df: DataFrame, round_cols, label_maps: dict) -> DataFrame:
    """Numbers rounded to integers and coded fields rendered as labels before the
    attribute text is written (label_maps: field -> {code: label})."""
    from causeway.functions.codes import lookup
    # Python's round(): half to even
    upd = {c: F.bround(F.col(c)).cast("bigint").cast("string") for c in round_cols if c in df.columns}
    upd.update({c: lookup(m, F.col(c).cast("int")) for c, m in label_maps.items() if c in df.columns})
    return df.withColumns(upd)


def attribute_text(entries: Column, descriptions: dict, sep: str) -> Column:
    """Ordered (key, value) entries -> "description: value<sep>" lines."""
    desc = F.create_map(*[x for k, v in descriptions.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(entries, lambda e: F.concat(F.coalesce(F.element_at(desc, e["key"]), F.lit("")),
                                                                e["value"], F.lit(sep))), "")
