"""Per-unit distribution operators that need an ordering: nucleus cut (F4, G2) and the draw
after it (I5).  Both are folds over a unit's sorted array (``functions.arrays``): one scan,
no rows for the options and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions.draws import uniform


def nucleus(df: DataFrame, probs: str, top_p: float, out: str = "nucleus") -> DataFrame:
    """``df`` with an array column of the kept (idx, p), most likely first, renormalised."""
    return df.withColumn(out, A.nucleus(probs, top_p))


def nucleus_draw(df: DataFrame, unit: str, seed: int, tag: str = "nucleus", kept: str = "nucleus") -> DataFrame:
    """(unit, n_kept, drawn): a draw from the renormalised nucleus in its order."""
    return df.select(unit, F.size(kept).alias("n_kept"), A.nucleus_draw(kept, uniform(seed, tag, unit)).cast("int").alias("drawn"))
