"""Hard negatives against all inner products, in Python integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from causeway.llm import negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor):
    ok = [(v, l, [math.floor(256 * x) for x in e]) for v, l, e in rows
          if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (v, l, e) in enumerate(ok):
        if not is_anchor(v):
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), w is None, w or 0, w, m) for j, (w, m, f) in enumerate(ok) if j != k]
        scored.sort(key=lambda s: s[:3])
        for s, _, _, p, _ in [s for s in scored if s[4] == l][:5]:
            fit = [t for t in scored if t[4] != l and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(v, p, r, t[3], -s, -t[0]) for r, t in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, is_anchor, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hn.mine_negatives(df, df.where(is_anchor), **kw).collect())


def vectors(seed, n, dim=12, labels=4):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    base = rng.normal(size=(n, dim)) / 3
    base[: n // 6] = base[0]                         # many equal vectors: ties
    rows = [(i, rnd.randrange(labels), base[i].tolist()) for i in range(n)]
    rows += [rows[0], rows[0], rows[7], (None, 1, base[3].tolist()), (None, 0, base[0].tolist())]
    rows += [(1000, None, base[1].tolist()), (1001, 1, None), (1002, 1, [None] * dim), (1003, 2, [math.inf] + [0.1] * (dim - 1)),
             (1004, 2, [math.nan] * dim), (1005, 3, []), (1006, 3, base[2][:5].tolist()), (1007, 2, [0.0] * dim), (-5, 1, base[4].tolist())]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = vectors(seed, 150)
    want = brute(rows, lambda v: v is not None and v % 5 == 0)
    assert want and mined(spark, rows, "vec_id % 5 = 0") == want
    # packs of few anchors, small blocks: the same rows
    assert mined(spark, rows, "vec_id % 5 = 0", per_pack=7, block=16) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.integers(-2 ** 21, 2 ** 21, 4) / 1.0).tolist()) for i in range(40)]
    assert mined(spark, rows, "vec_id % 3 = 0") == brute(rows, lambda v: v % 3 == 0)
    with pytest.raises(Exception, match="53 bits"):
        mined(spark, [(1, 1, [1e300]), (2, 1, [1.0])], "vec_id = 1")


def test_empty_tables(spark):
    assert not mined(spark, [], "true")
    assert not mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])], "vec_id = 50")
    assert not mined(spark, [(50, 1, [1.0])], "vec_id = 50")


def test_scan_keeps_only_what_bounds_admit():
    rng = np.random.default_rng(2)
    columns = rng.integers(-100, 100, (32, 500))
    block = hn.Block(np.arange(500), np.ones(500, bool), np.zeros(500, np.int64), columns)
    scan, anchor = hn.Columns(block, 100), rng.integers(-100, 100, 32)
    exact = anchor @ columns
    seen = []

    def admit(least, most):
        seen.append(len(least))
        return (most >= 60_000) & (least <= 80_000)
    at, score = scan.scan(anchor, 0, 500, admit)
    keep = np.flatnonzero((exact >= 60_000) & (exact <= 80_000))
    assert at.tolist() == keep.tolist() and score.tolist() == exact[keep].tolist()
    assert seen[-1] < 500        # the bitmap shrank before the last step


def test_table(spark, sf_dir):
    from causeway.llm.common import read
    rows = [(r.vec_id, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10, r.embedding)
            for r in read(spark, sf_dir, "embeddings").collect()]
    assert Counter(tuple(r) for r in hn.op11_hard_negatives(spark, sf_dir).collect()) == brute(rows, lambda v: v % 50 == 0)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F
    rows = vectors(9, 60)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("id"), F.lit(2).alias("vector"), F.lit(3).alias("rank"))
    got = Counter(tuple(r) for r in hn.mine_negatives(df, df.where("vec_id % 5 = 0")).collect())
    assert got == brute(rows, lambda v: v is not None and v % 5 == 0)
