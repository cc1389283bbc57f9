"""Model-based effect estimators (J10-J21): one grouped scan, fits kept as a small table.

Every estimator here sees a unit table only through its *design cells*: for each distinct
covariate pattern, how many units either arm has and the sum of their outcomes.  Cells come
from one hash aggregate; the logistic propensity (Fisher scoring), all linear outcome models
(summed normal equations) and the effects themselves are sums over cells, so the data are
scanned once however many steps a fit takes, and four estimators share one propensity.

A fit is a value (``Fitted``): coefficients in a stated covariate order, with a table form
that can be stored and read back.  It is applied to any table's cells, so models are fitted on
one table (train) and effects evaluated on another (val, J18-J20).

* ``naive``           difference in means of the evaluated table
* ``ipw``             logistic propensity, weighted arm means
* ``standardization`` one linear outcome model with the treatment as a feature
* ``strat_std``       one linear outcome model per arm
* ``dr_vanilla``      AIPW with the standardisation model and the logistic propensity
* ``dr_ipfeature``    standardisation with the inverse-propensity weight as a feature
* ``dr_importance``   standardisation fitted with inverse-propensity sample weights
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import cut_lineage, ship_package

ESTIMATORS = ("naive", "ipw", "standardization", "strat_std", "dr_vanilla", "dr_ipfeature", "dr_importance")
#: Up to so many cells are summed on the driver; more are summed where they lie.  The sums are the same.
LOCAL_CELLS = 1 << 16
#: Penalty of the logistic fit: half the sum of squared weights, added to the summed loss.
PENALTY = 1.0
MAX_STEPS = 100


# ------------------------------------------------------------------ design cells

class Cells:
    """Design cells of one table: covariate pattern, units and outcome sums of either arm."""

    def __init__(self, frame: DataFrame, x_cols, local: int = LOCAL_CELLS):
        self.frame, self.x_cols = frame, tuple(x_cols)
        self.columns = [f"_x{i}" for i in range(len(self.x_cols))] + ["n1", "n0", "s1", "s0"]
        head = frame.select(*self.columns).limit(local + 1).toArrow()
        self.local = self._arrays(head) if head.num_rows <= local else None

    def _arrays(self, table) -> tuple[np.ndarray, ...]:
        m = np.array([table.column(c).to_numpy() for c in self.columns], dtype=np.float64).reshape(len(self.columns), -1)
        return m[:-4].T, *m[-4:]

    def total(self, fn: Callable[..., np.ndarray]) -> np.ndarray:
        """``fn(x, n1, n0, s1, s0)``, a vector of sums over some cells, summed over all."""
        if self.local is not None:
            return fn(*self.local)
        ship_package()

        def run(batches):
            parts = [fn(*self._arrays(pa.Table.from_batches([b]))) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([sum(parts)], pa.list_(pa.float64()))], names=["sums"])

        rows = self._frame_only().mapInArrow(run, "sums array<double>").collect()
        return np.sum([r["sums"] for r in rows], axis=0)

    def _frame_only(self) -> DataFrame:
        """The cells' frame, detached so that the function sent to tasks does not hold it."""
        frame, self.frame = self.frame, None
        try:
            return frame.select(*self.columns)
        finally:
            self.frame = frame

    def __getstate__(self):
        return {"x_cols": self.x_cols, "columns": self.columns, "frame": None, "local": None}


def _grouped(df: DataFrame, x_cols, t: str, y: str, by=()) -> DataFrame:
    """One aggregate, checkpointed: rows with a NULL covariate, treatment or outcome take no part.

    Cells with a NULL covariate are dropped behind the aggregate: a filter before it would put
    a constraint on every covariate's expression, which the optimiser combines without end."""
    cols = [F.col(c).alias(f"_by_{c}") for c in by] + [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x_cols)]
    units = df.select(*cols, F.col(t).cast("int").alias("_t"), F.col(y).cast("double").alias("_y"))
    xs = [f"_x{i}" for i in range(len(x_cols))]
    out, cells = F.col("_y"), units.groupBy(*[f"_by_{c}" for c in by], *xs)

    def arm(a):
        return (F.col("_t") == a) & out.isNotNull()

    cells = cut_lineage(cells.agg(
        F.count_if(arm(1)).cast("double").alias("n1"), F.count_if(arm(0)).cast("double").alias("n0"),
        F.sum(F.when(arm(1), out).otherwise(0.0)).alias("s1"), F.sum(F.when(arm(0), out).otherwise(0.0)).alias("s0")))
    return cells.dropna(subset=xs).where("n1 + n0 > 0")


def design_cells(df: DataFrame, x_cols, t: str, y: str, local: int = LOCAL_CELLS) -> Cells:
    """Cells of a unit table.  Treatment is 0/1; rows with a NULL take no part."""
    return Cells(_grouped(df, x_cols, t, y), x_cols, local)


def design_cells_by(df: DataFrame, by: str, x_cols, t: str, y: str) -> dict:
    """Cells of each value of ``by`` (a split, a table's name), from one scan."""
    grouped = _grouped(df, x_cols, t, y, [by])
    values = sorted((r[0] for r in grouped.select(f"_by_{by}").distinct().collect()), key=lambda v: (v is None, str(v)))
    return {v: Cells(grouped.where(F.col(f"_by_{by}").eqNullSafe(F.lit(v))), x_cols) for v in values}


# ------------------------------------------------------------------ fits

@dataclass(frozen=True)
class Fitted:
    """Coefficients, intercept first, in the order of ``x_cols``.

    ``outcome`` has the linear models: ``standardization`` and ``dr_importance`` over
    (X, treatment), ``dr_ipfeature`` over (X, treatment, weight), ``arm1`` and ``arm0`` over X."""

    x_cols: tuple[str, ...]
    penalty: float
    propensity: np.ndarray
    outcome: dict[str, np.ndarray]

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, position, term, coefficient, penalty): one row a coefficient."""
        rows = []
        for name, coef in {"propensity": self.propensity, **self.outcome}.items():
            terms = ["(intercept)", *self.x_cols, "(treatment)", "(weight)"]
            rows += [(name, k, terms[k], float(v), float(self.penalty)) for k, v in enumerate(coef)]
        return spark.createDataFrame(rows, "model string, position int, term string, coefficient double, penalty double")

    @classmethod
    def from_table(cls, table: DataFrame) -> Fitted:
        models: dict = {}
        rows = sorted(table.collect(), key=lambda r: r["position"])
        for r in rows:
            models.setdefault(r["model"], []).append(r["coefficient"])
        names = tuple(r["term"] for r in rows if r["model"] == "propensity" and r["position"])
        return cls(names, rows[0]["penalty"], np.array(models.pop("propensity")), {k: np.array(v) for k, v in models.items()})

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(treatment = 1 | X)."""
        return 1 / (1 + np.exp(-(self.propensity[0] + x @ self.propensity[1:])))


def fit_propensity(cells: Cells, penalty: float = PENALTY, penalise_intercept: bool = False) -> np.ndarray:
    """Logistic P(t = 1 | X) by Fisher scoring with step halving, intercept first.

    The loss is the summed log-loss plus ``penalty`` times half the sum of squared weights
    (1.0 is the usual C = 1); the intercept is penalised only where asked for, as solvers do
    that treat it as one more weight.  Without a penalty, arms that a covariate separates
    have no finite fit: an error."""
    k = len(cells.x_cols) + 1
    ridge = np.full(k, float(penalty))
    ridge[0] *= penalise_intercept

    def sums(beta):
        def fn(x, n1, n0, s1, s0):
            z = np.hstack([np.ones((len(x), 1)), x])
            v = z @ beta
            e, n = 1 / (1 + np.exp(-v)), n1 + n0
            loss = (n1 * np.logaddexp(0, -v) + n0 * np.logaddexp(0, v)).sum()
            return np.concatenate([[loss], z.T @ (n1 - n * e), ((z * (n * e * (1 - e))[:, None]).T @ z).ravel()])
        out = cells.total(fn)
        return out[0] + (ridge * beta ** 2).sum() / 2, out[1:k + 1] - ridge * beta, out[k + 1:].reshape(k, k) + np.diag(ridge)

    beta = np.zeros(k)
    loss, slope, curve = sums(beta)
    for _ in range(MAX_STEPS):
        step = np.linalg.pinv(curve, rcond=1e-12, hermitian=True) @ slope
        size = 1.0
        while size > 1e-9:
            after = sums(beta + size * step)
            if after[0] <= loss + 1e-12 * abs(loss):
                break
            size /= 2
        beta = beta + size * step
        done = np.abs(size * step).max() <= 1e-11 * max(1.0, np.abs(beta).max())
        loss, slope, curve = after
        if done:
            return beta
        if not penalty and np.abs(beta).max() > 1e3:
            break
    raise ValueError("the propensity fit does not converge (a covariate separates the arms)")


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares from summed equations whose first regressor is the constant: centred,
    of least norm where regressors depend on one another."""
    n = gram[0, 0]
    if n <= 0:
        raise ValueError("no units to fit an outcome model on")
    mean, centre = gram[0, 1:] / n, rhs[0] / n
    inner = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(inner), 0))
    scale[scale < 1e-9 * np.sqrt(np.maximum(np.diag(gram)[1:], 1e-300))] = np.inf      # constants get 0
    coef = np.linalg.pinv(inner / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ ((rhs[1:] - mean * rhs[0]) / scale) / scale
    return np.concatenate([[centre - mean @ coef], coef])


def fit(cells: Cells, penalty: float = PENALTY, penalise_intercept: bool = False) -> Fitted:
    """The propensity and, by one pass of summed normal equations, all outcome models."""
    d = len(cells.x_cols)
    fitted = Fitted(cells.x_cols, float(penalty), fit_propensity(cells, penalty, penalise_intercept), {})

    def equations(x, n1, n0, s1, s0):
        e, out = fitted.score(x), []
        for n, s, w in ((n1, s1, 1 / e), (n0, s0, 1 / (1 - e))):
            z = np.hstack([np.ones((len(x), 1)), x, w[:, None]])
            out += [((z * n[:, None]).T @ z).ravel(), z.T @ s]
            z = z[:, :-1]
            out += [((z * (w * n)[:, None]).T @ z).ravel(), z.T @ (w * s)]
        return np.concatenate(out)

    sums, at, arms = cells.total(equations), 0, []
    for _ in (1, 0):
        arm = []
        for k in (d + 2, d + 1):
            arm += [sums[at:at + k * k].reshape(k, k), sums[at + k * k:at + k * k + k]]
            at += k * k + k
        arms.append(arm)
    (g1, b1, h1, c1), (g0, b0, h0, c0) = arms

    def with_treatment(g1, b1, g0, b0):
        """Both arms' equations together, the treatment (0/1) after (1, X)."""
        k = len(b1)
        place = [*range(d + 1), *range(d + 2, k + 1)]
        gram, rhs = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        gram[np.ix_(place, place)], rhs[place] = g1 + g0, b1 + b0
        gram[d + 1, place] = gram[place, d + 1] = g1[0]
        gram[d + 1, d + 1], rhs[d + 1] = g1[0, 0], b1[0]
        return gram, rhs

    x = slice(0, d + 1)
    fitted.outcome.update({
        "standardization": _solve(*with_treatment(g1[x, x], b1[x], g0[x, x], b0[x])),
        "dr_ipfeature": _solve(*with_treatment(g1, b1, g0, b0)),
        "dr_importance": _solve(*with_treatment(h1, c1, h0, c0)),
        "arm1": _solve(g1[x, x], b1[x]), "arm0": _solve(g0[x, x], b0[x])})
    return fitted


# ------------------------------------------------------------------ effects

def effects(fitted: Fitted, cells: Cells) -> dict[str, float]:
    """Every estimator's effect on the table of ``cells``, by the models of ``fitted``.

    One pass of sums.  An arm without units makes the effects that average it NaN."""
    d, o = len(fitted.x_cols), fitted.outcome
    if fitted.x_cols != cells.x_cols:
        raise ValueError(f"fitted on {fitted.x_cols}, applied to {cells.x_cols}")

    def sums(x, n1, n0, s1, s0):
        e, n = fitted.score(x), n1 + n0
        std, feature = o["standardization"], o["dr_ipfeature"]
        m0 = std[0] + x @ std[1:d + 1]
        m1 = m0 + std[d + 1]
        gap = o["arm1"] - o["arm0"]
        return np.array([
            n.sum(), n1.sum(), n0.sum(), s1.sum(), s0.sum(),
            (s1 / e).sum(), (n1 / e).sum(), (s0 / (1 - e)).sum(), (n0 / (1 - e)).sum(),
            (n * (gap[0] + x @ gap[1:])).sum(),
            (n * (m1 - m0) + (s1 - n1 * m1) / e - (s0 - n0 * m0) / (1 - e)).sum(),
            (n * (feature[d + 1] + feature[d + 2] * (1 / e - 1 / (1 - e)))).sum()])

    with np.errstate(divide="ignore", invalid="ignore"):
        n, n1, n0, s1, s0, w1, k1, w0, k0, strat, aipw, feature = cells.total(sums)
        return {"naive": s1 / n1 - s0 / n0, "ipw": w1 / k1 - w0 / k0, "standardization": o["standardization"][d + 1],
                "strat_std": strat / n, "dr_vanilla": aipw / n, "dr_ipfeature": feature / n, "dr_importance": o["dr_importance"][d + 1]}


def _rows(spark: SparkSession, rows: Iterable[tuple], keys: str) -> DataFrame:
    """Rows whose last value is an effect; NaN (an empty arm) as NULL."""
    clean = [(*r[:-1], None if np.isnan(r[-1]) else float(r[-1])) for r in rows]
    return spark.createDataFrame(clean, f"{keys}, estimator string, ate double".lstrip(", "))


def estimate(df: DataFrame, x_cols, t: str, y: str, name: str, penalty: float = PENALTY) -> DataFrame:
    """One estimator fitted and evaluated on the same table: a row (estimator, ate)."""
    cells = design_cells(df, x_cols, t, y)
    return _rows(df.sparkSession, [(name, effects(fit(cells, penalty), cells)[name])], "")


def compare(df: DataFrame, x_cols, t: str, y: str, names=None, penalty: float = PENALTY) -> DataFrame:
    """One ``(estimator, ate)`` row per estimator over the same unit table."""
    cells = design_cells(df, x_cols, t, y)
    found = effects(fit(cells, penalty), cells)
    return _rows(df.sparkSession, [(n, found[n]) for n in names or ESTIMATORS], "")


def benchmark(df: DataFrame, table: str, fit_on: dict, x_cols, t: str, y: str, names=None, penalty: float = PENALTY) -> DataFrame:
    """(table, estimator, ate).  ``table`` names the column that tells the tables of
    ``df`` apart; ``fit_on`` maps each table to the one its models are fitted on (itself, or
    train for val).  One scan for all tables; each needed fit is made once."""
    cells = design_cells_by(df, table, x_cols, t, y)
    missing = {v for pair in fit_on.items() for v in pair} - set(cells)
    if missing:
        raise ValueError(f"no units of {sorted(map(str, missing))}")
    fits = {v: fit(cells[v], penalty) for v in set(fit_on.values())}
    rows = [(name, n, found[n]) for name, source in fit_on.items() for found in [effects(fits[source], cells[name])] for n in names or ESTIMATORS]
    return _rows(df.sparkSession, rows, f"{table} string")
