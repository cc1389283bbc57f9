"""Evaluation metrics (K1-K8, E8) in long form ``(metric, estimator, value)``.

All trials are rows of one table (a ``trial`` column), so every metric is one
grouped aggregate over trials -- the whole evaluation is a single job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trial_metrics(ates: DataFrame, truth, obs_col: str, pred_col: str, estimator: str) -> DataFrame:
    """E8 + K3 in one aggregate over the trial table: mean and population std of the
    predictions, and the error decomposition against ``truth``."""
    g = truth if not isinstance(truth, (int, float)) else F.lit(float(truth))
    a = ates.withColumn("_g", g)
    g, o, p = F.col("_g"), F.col(obs_col), F.col(pred_col)
    r = a.agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s"), F.avg((g - o) * (g - o)).alias("co"),
              F.avg((o - p) * (o - p)).alias("op"), (2 * F.avg((g - o) * (o - p))).alias("ec"),
              F.avg((g - p) * (g - p)).alias("cp"))
    names = ["ATE_mean", "ATE_std_dev", "CRE-Obs MSE", "Obs-Pred MSE", "Error Corr", "CRE-Pred MSE"]
    args = [x for n, c in zip(names, ["m", "s", "co", "op", "ec", "cp"]) for x in (F.lit(n), F.col(c))]
    return r.select(F.lit(estimator).alias("estimator"), F.stack(F.lit(len(names)), *args).alias("metric", "value"))


def distribution_distance(obs: DataFrame, pred: DataFrame, key: str, obs_col: str, pred_col: str,
                          by=("trial",), eps: float = 1e-6) -> DataFrame:
    """K1/K2 per trial between an observed and a predicted distribution given as
    (trial, key, value) rows, then K4/K5: the mean over trials."""
    by = list(by)
    j = obs.select(*by, key, F.col(obs_col).alias("a")).join(pred.select(*by, key, F.col(pred_col).alias("b")),
                                                             [*by, key], "full_outer").na.fill(0.0, ["a", "b"])
    per = j.groupBy(*by).agg(
        F.sum(F.when(F.col("a") != 0, F.col("a") * F.log(F.col("a") / (F.col("b") + eps))).otherwise(0.0)).alias("kl"),
        F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    return per.agg(F.avg("kl").alias("kl"), F.avg("mse").alias("mse"))


def accuracy(truth: DataFrame, pred: DataFrame, key: str, fields, prefixes=("sample_",), by=()) -> DataFrame:
    """K6: per field share of units whose predicted label equals the truth, for each
    prediction prefix (drawn ``sample_`` and arg-max ``max_sample_``); per trial,
    then mean and population std over trials."""
    by = list(by)
    j = truth.join(pred, key)
    parts = []
    for f in fields:
        for pre in prefixes:
            parts += [F.lit(f + "_acc_" + ("max" if pre.startswith("max") else "sample")),
                      (F.col(f) == F.col(pre + f)).cast("double")]
    stacked = j.select(*by, F.stack(F.lit(len(parts) // 2), *parts).alias("metric", "hit"))
    per = stacked.groupBy(*by, "metric").agg(F.avg("hit").alias("acc"))
    return per.groupBy("metric").agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"))


def trial_table(trials: DataFrame, probs: str, cell: str, cells: int, fields, prefixes=("sample_", "max_sample_"),
                by: str = "trial") -> DataFrame:
    """K7: everything the metrics need of a table of (trial, unit) rows, in one grouped pass.

    ``probs`` is a unit's predicted joint (``cells`` values), ``cell`` its true cell.  One row
    a trial: n, the mean predicted and the observed joint as arrays, and per field the share
    of drawn and of arg-max labels that equal the true one (``hit_sample_f``, ``hit_max_f``)."""
    hits = [F.avg((F.col(f) == F.col(p + f)).cast("double")).alias(f"hit_{'max' if p.startswith('max') else 'sample'}_{f}")
            for f in fields for p in prefixes]
    row = trials.groupBy(by).agg(
        F.count("*").alias("n"), *[F.avg(F.element_at(probs, i + 1)).alias(f"_p{i}") for i in range(cells)],
        *[(F.count_if(F.col(cell) == i) / F.count("*")).alias(f"_o{i}") for i in range(cells)], *hits)
    return row.select(by, "n", F.array(*[f"_p{i}" for i in range(cells)]).alias("predicted"),
                      F.array(*[f"_o{i}" for i in range(cells)]).alias("observed"), *[c for c in row.columns if c.startswith("hit_")])


def trial_report(table: DataFrame, shape, truth, by: str = "trial") -> DataFrame:
    """K3-K7: (metric, value) over the rows of ``trial_table`` (a handful, one a trial).

    ``shape`` is (X cells, treatments, outcomes), ``truth`` the effect that errors refer to (a
    number or a scalar column).  A trial's effect is the full-joint IPW of its mean predicted
    joint, the observed one that of its observed joint; both joints and both propensities are
    compared by KL and MSE in each trial, and averaged.  An empty stratum has propensity 0."""
    from causeway.functions import arrays as A
    from causeway.operators.estimators import ipw_full
    from causeway.session import cut_lineage
    nx, nz, ny = shape
    table = cut_lineage(table)          # a row a trial, read by every metric

    def propensity(joint):
        def share(x):
            return F.transform(A.marginal(joint, shape, (0, 1)), lambda v, i: F.coalesce(
                F.try_divide(v, F.element_at(x, F.floor(i / nz).cast("int") + 1)), F.lit(0.0)))
        return A.let(A.marginal(joint, shape, (0,)), share)

    t = table.withColumns({"e_pred": propensity("predicted"), "e_obs": propensity("observed")})
    pred = ipw_full(t, "predicted", nz, ny, [by], nx * nz * ny).select(by, F.col("ate").alias("p"), F.col("uncorrected").alias("u"))
    obs = ipw_full(t, "observed", nz, ny, [by], nx * nz * ny).select(by, F.col("ate").alias("o"))
    hits = [c for c in table.columns if c.startswith("hit_")]
    each = t.join(pred, by).join(obs, by).withColumn("g", F.lit(float(truth)) if isinstance(truth, (int, float)) else truth).select(
        "p", "u", "o", "g", A.kl("observed", "predicted").alias("klj"), A.mse("observed", "predicted").alias("msej"),
        A.kl("e_obs", "e_pred").alias("klp"), A.mse("e_obs", "e_pred").alias("msep"), *hits)
    p, o, g = F.col("p"), F.col("o"), F.col("g")
    metrics = {"ATE_mean": F.avg(p), "ATE_std_dev": F.stddev_pop(p), "Uncorrected_mean": F.avg("u"),
               "CRE-Obs MSE": F.avg((g - o) * (g - o)), "Obs-Pred MSE": F.avg((o - p) * (o - p)),
               "Error Corr": 2 * F.avg((g - o) * (o - p)), "CRE-Pred MSE": F.avg((g - p) * (g - p)),
               "KL to Obs Joint": F.avg("klj"), "MSE to Obs Joint": F.avg("msej"),
               "KL to Obs Propensity": F.avg("klp"), "MSE to Obs Propensity": F.avg("msep")}
    for h in hits:
        kind, field = h[4:].split("_", 1)
        metrics |= {f"{field}_acc_{kind}_mean": F.avg(h), f"{field}_acc_{kind}_std": F.stddev_pop(h)}
    names = list(metrics)
    row = each.agg(*[m.alias(f"_m{i}") for i, m in enumerate(metrics.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_m{i}").alias("value")) for i, n in enumerate(names)])))


def results_wide(long: DataFrame, column_cols=("estimator", "eval_size"), columns=None) -> DataFrame:
    """K8: metric rows x ``<estimator>_eval<size>`` columns.  With ``columns`` (pairs of
    estimator and size) given, the plan runs once; without, once more to find them."""
    name = F.concat(F.col(column_cols[0]), F.lit("_eval"), F.col(column_cols[1]).cast("string"))
    values = None if columns is None else [f"{e}_eval{n}" for e, n in columns]
    return long.withColumn("_col", name).groupBy("metric").pivot("_col", values).agg(F.first("value"))


def merge_sizes(tables) -> DataFrame:
    """Results of several evaluation sizes merged on metric (full outer)."""
    return reduce(lambda a, b: a.join(b, "metric", "full_outer"), tables)
