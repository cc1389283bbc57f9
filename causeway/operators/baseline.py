"""Learned text baselines (L1-L5): sparse bag of words, and a perceptron's grid search as tasks.

Encodings: a bag of words (L1) kept as long sparse counts over a vocabulary table (E12), or a
dense encoding column supplied by the user (L2).  Targets are a field's labels in ascending
order (L3).  Per field, every setting of the published search space is cross-validated by
accuracy, one (field, setting, fold) a task, on a bounded sample that goes out with the tasks
(L4); the best setting is refitted on the sample and labels any table (L5).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.draws import uniform
from causeway.operators.sampling import domain
from causeway.session import cut_lineage, ship_package

# Word tokens of two or more word characters, and the published search space.
TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"
GRID = {"hidden": (128, 256, 512), "depth": (2, 3), "activation": ("tanh", "relu"), "step": (1e-4, 5e-3, 1e-3),
        "batch": (32, 64), "solver": ("sgd", "adam")}
MAX_ITER, TOLERANCE, PATIENCE, HELD_BACK = 20, 1e-4, 10, 0.1

#: Rows that the search and the refit use at most, chosen by a hash of their key.
SAMPLE = 256


# ------------------------------------------------------------------ E12 / L1 bag of words

def words(text: str):
    """L1: the lower-cased word tokens of a text, as an array column."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def vocabulary(train: DataFrame, text: str) -> DataFrame:
    """(term, index): every term of the training texts, numbered from 0.

    A table: nothing is capped, and no map of terms passes through the driver."""
    terms = train.select(F.explode(words(text)).alias("term"))
    return domain(terms, "term").select(F.col("value").alias("term"), F.col("k").alias("index"))


def bag_of_words(docs: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """L1: (key, index, n): how often each term of the vocabulary occurs, absent ones left out.

    A document's terms are counted before they meet the vocabulary, so a frequent term moves
    one row a document."""
    counts = docs.select(key, F.explode(words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return counts.join(vocab, "term").select(key, "index", "n")


# ------------------------------------------------------------------ L4 the perceptron

@dataclass
class Perceptron:
    """Labels, and the layers (weights, biases) of a fitted network."""

    labels: list[str]
    activation: str
    layers: list[tuple[np.ndarray, np.ndarray]]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if k == len(self.layers) - 1 else np.tanh(z) if self.activation == "tanh" else np.maximum(z, 0))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1].argmax(axis=1)

    def gradients(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the mean cross-entropy plus ``decay`` / 2 times the mean squared weights."""
        a = self.forward(x)
        p = np.exp(a[-1] - a[-1].max(axis=1, keepdims=True))
        d = p / p.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out = []
        for k in range(len(self.layers) - 1, -1, -1):
            out.append((a[k].T @ d + decay / len(y) * self.layers[k][0], d.sum(axis=0)))
            if k:
                d = (d @ self.layers[k][0].T) * ((1 - a[k] ** 2) if self.activation == "tanh" else (a[k] > 0))
        return out[::-1]


def fit_perceptron(x: np.ndarray, y: np.ndarray, labels: list[str], setting: dict, seed: int, max_iter: int = MAX_ITER) -> Perceptron:
    """A network by mini-batches, stopped when a held-back tenth of the rows no longer gains."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *[setting["hidden"]] * setting["depth"], max(2, len(labels))]
    gain = 6 if setting["activation"] == "tanh" else 2
    net = Perceptron(labels, setting["activation"], [])
    for i, o in zip(sizes, sizes[1:]):
        bound = np.sqrt(gain / (i + o))
        net.layers.append((rng.uniform(-bound, bound, (i, o)).astype(np.float32), rng.uniform(-bound, bound, o).astype(np.float32)))
    order = rng.permutation(len(x))
    held = order[:int(len(x) * HELD_BACK)]
    rows = order[len(held):]
    state = [[np.zeros_like(p) for p in layer] for layer in net.layers]
    second = [[np.zeros_like(p) for p in layer] for layer in net.layers]
    best, best_layers, waited, t = -np.inf, net.layers, 0, 0
    for _ in range(max_iter):
        rng.shuffle(rows)
        for at in range(0, len(rows), setting["batch"]):
            part, t = rows[at:at + setting["batch"]], t + 1
            layers = []
            for k, (layer, grad) in enumerate(zip(net.layers, net.gradients(x[part], y[part]))):
                new = []
                for j, (p, g) in enumerate(zip(layer, grad)):
                    if setting["solver"] == "sgd":          # Nesterov momentum
                        state[k][j] = 0.9 * state[k][j] - setting["step"] * g
                        new.append(p + 0.9 * state[k][j] - setting["step"] * g)
                    else:
                        state[k][j] = 0.9 * state[k][j] + 0.1 * g
                        second[k][j] = 0.999 * second[k][j] + 0.001 * g * g
                        size = setting["step"] * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
                        new.append(p - size * state[k][j] / (np.sqrt(second[k][j]) + 1e-8))
                layers.append(tuple(q.astype(np.float32) for q in new))
            net.layers = layers
        score = (net.predict(x[held]) == y[held]).mean() if len(held) else 0.0
        waited = 0 if score > best + TOLERANCE else waited + 1
        if score > best:
            best, best_layers = score, net.layers
        if waited > PATIENCE:
            break
    net.layers = best_layers
    return net


# ------------------------------------------------------------------ L4 / L5 search and labels

def settings(grid: dict | None = None) -> list[dict]:
    """Every combination of the search space, in a fixed order."""
    grid = grid or GRID
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _sampled(train: DataFrame, key: str, features: str, fields, sample: int, seed: int):
    """The sample as arrays: features and, for each field, labels and classes."""
    rows = (train.where(F.col(features).isNotNull()).withColumn("_u", uniform(seed, "baseline sample", key))
            .orderBy("_u", key).limit(sample).select(features, *[F.col(f).cast("string").alias(f) for f in fields]).toArrow())
    x = np.array(rows.column(features).to_pylist(), dtype=np.float32)
    out = {}
    for f in fields:
        names = rows.column(f).to_pylist()
        labels = sorted({n for n in names if n is not None})
        known = np.array([k for k, n in enumerate(names) if n is not None], dtype=np.int64)
        out[f] = (known, np.array([labels.index(names[k]) for k in known], dtype=np.int64), labels)
    return x, out


def grid_search(train: DataFrame, key: str, features: str, fields, folds: int = 5, grid: dict | None = None,
                sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """L4: (field, setting, fold, accuracy, ...one column a parameter): every setting of the
    search space, cross-validated; one (field, setting, fold) a row and, in turn, a task's work.

    Rows without features or without a label of the field take no part.  The draws depend on
    the field, the setting and the fold alone, so neither the partitions nor a lost executor
    change the table."""
    spark, choices = train.sparkSession, settings(grid)
    ship_package()
    shared = spark.sparkContext.broadcast(_sampled(train, key, features, fields, sample, seed))
    work = [(f, s, k) for s in range(len(choices)) for f in fields for k in range(folds)]
    tasks = spark.createDataFrame(work, "field string, setting int, fold int").repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism), "setting", "field", "fold")

    def run(batches):
        x, targets = shared.value
        for b in batches:
            score = []
            for f, s, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                known, y, labels = targets[f]
                of = np.arange(len(known)) % folds
                fit = fit_perceptron(x[known[of != k]], y[of != k], labels, choices[s], seed * 7919 + s * 97 + k) if (of != k).any() and (of == k).any() else None
                score.append(float((fit.predict(x[known[of == k]]) == y[of == k]).mean()) if fit else None)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(score, pa.float64())], names=["field", "setting", "fold", "accuracy"])

    scores = cut_lineage(tasks.mapInArrow(run, "field string, setting int, fold int, accuracy double"))
    named = spark.createDataFrame([(s, *c.values()) for s, c in enumerate(choices)], ["setting", *(grid or GRID)]).withColumn("setting", F.col("setting").cast("int"))
    return scores.join(F.broadcast(named), "setting")


def best_settings(search: DataFrame) -> DataFrame:
    """(field, setting, accuracy): the setting of highest mean accuracy, the first of equals."""
    mean = search.groupBy("field", "setting").agg(F.avg("accuracy").alias("accuracy"))
    return mean.groupBy("field").agg(F.max_by("setting", F.struct(F.coalesce("accuracy", F.lit(-1.0)), -F.col("setting"))).alias("setting"), F.max("accuracy").alias("accuracy"))


def fit_fields(train: DataFrame, key: str, features: str, best: DataFrame, grid: dict | None = None, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(field, setting, model): the best settings refitted on the sample, one field a task.
    ``model`` is the network as JSON text, so the table can be stored and read back (A12)."""
    spark, choices = train.sparkSession, settings(grid)
    ship_package()
    fields = sorted(r["field"] for r in best.select("field").collect())
    shared = spark.sparkContext.broadcast(_sampled(train, key, features, fields, sample, seed))

    def run(batches):
        x, targets = shared.value
        for b in batches:
            out = []
            for f, s in zip(b.column("field").to_pylist(), b.column("setting").to_pylist()):
                known, y, labels = targets[f]
                out.append(to_json(fit_perceptron(x[known], y, labels, choices[s], seed * 7919 + s * 97 + 96)))
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("setting"), pa.array(out, pa.string())], names=["field", "setting", "model"])

    return cut_lineage(best.select("field", "setting").repartition(max(1, len(fields)), "field").mapInArrow(run, "field string, setting int, model string"))


def to_json(net: Perceptron) -> str:
    layers = [[w.shape, w.ravel().tolist(), b.tolist()] for w, b in net.layers]
    return json.dumps({"labels": net.labels, "activation": net.activation, "layers": layers})


def from_json(text: str) -> Perceptron:
    m = json.loads(text)
    layers = [(np.array(w, np.float32).reshape(shape), np.array(b, np.float32)) for shape, w, b in m["layers"]]
    return Perceptron(m["labels"], m["activation"], layers)


def predict_fields(models: DataFrame, df: DataFrame, features: str) -> DataFrame:
    """``df`` with ``pred_<field>`` for every field of ``models``; NULL without features."""
    ship_package()
    nets = {r["field"]: from_json(r["model"]) for r in models.collect()}
    shared, names = df.sparkSession.sparkContext.broadcast(nets), sorted(nets)
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`pred_{n}` string" for n in names)])

    def run(batches):
        for b in batches:
            rows = b.column(features).to_pylist()
            known = [k for k, r in enumerate(rows) if r is not None]
            x = np.array([rows[k] for k in known], dtype=np.float32)
            extra = []
            for n in names:
                out = [None] * len(rows)
                if known and shared.value[n].labels:
                    for k, label in zip(known, shared.value[n].predict(x)):
                        out[k] = shared.value[n].labels[min(label, len(shared.value[n].labels) - 1)]
                extra.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *(f"pred_{n}" for n in names)])

    return df.mapInArrow(run, kind)


def field_accuracy(pred: DataFrame, fields, split: str) -> DataFrame:
    """L5 accuracy rows ``(field, split, acc)``."""
    parts = []
    for f in fields:
        parts += [F.lit(f), (F.col(f).cast("string") == F.col("pred_" + f)).cast("double")]
    return (pred.select(F.stack(F.lit(len(fields)), *parts).alias("field", "hit"))
            .groupBy("field").agg(F.avg("hit").alias("acc")).withColumn("split", F.lit(split)))


def save_models(models: DataFrame, path: str) -> None:
    """A12 sink: the table of fitted networks in a shared folder."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """A12 source."""
    return spark.read.parquet(path)
