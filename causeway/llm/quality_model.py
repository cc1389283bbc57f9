"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic.

A document becomes statistics of its whole text.  Their standardised values go through
random Fourier features, whose inner products approximate a Gaussian kernel; every
partition sums its normal equations, the sums meet row by row, and the driver solves one
system of fixed size.  Isotonic regression over a histogram of the training scores turns
ridge scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import cut, map_arrow, map_rows, read, text_of

FOURIER = 256
RIDGE = 1e-3
#: Length scale of the kernel, in standard deviations of a statistic times sqrt(statistics).
WIDTH = 1.0
BINS = 1024
KEEP_SCORE = 0.3
FOLDS = 5

_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "stop": b".!?",
         "comma": b",;:", "symbol": b"#*$%&|<>=+~^_@\\", "quote": b"\"'()[]{}-/`", "shout": b"!", "table": b"|"}
_MASK = np.stack([np.isin(np.arange(256), list(s)) for s in _SETS.values()] + [np.arange(256) > 127]).astype(np.float64)
STATISTICS = (*_SETS, "high", "log_chars", "log_words", "word_length", "word_spread", "distinct", "top", "pairs",
              "repeats", "lines_again", "line_words", "shouted", "ends")


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a UTF-8 text; the empty text has zeros."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    out[:len(_MASK)] = np.sqrt(_MASK @ counts / len(text))
    words = text.split()
    n = len(words)
    if not n:
        return out
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    kinds = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[len(_MASK):] = (
        np.log1p(len(text)), np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(kinds) / n,
        sum(c for _, c in kinds.most_common(3)) / n, len(set(zip(words, words[1:]))) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(map(bytes.isupper, words)) / n, sum(w[-1:] in b".!?" for w in words) / n)
    return out


@dataclass
class Model:
    """Scores of statistics between 0 and 1; higher means label 1 is likelier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # a small part of the ridge score keeps the order inside a level of the calibration
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * (raw + 0.5) / 2


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in the order of ``x``: (mean x, share of ones) a level."""
    levels: list[list[float]] = []
    for at, n, k in zip(x, total, ones):
        levels.append([at * n, n, k])
        while len(levels) > 1 and levels[-2][2] * levels[-1][1] >= levels[-1][2] * levels[-2][1]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last)]
    return np.array([a / n for a, n, _ in levels]), np.array([k / n for _, n, k in levels])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row's whole text."""
    def start():
        return lambda cols: {"doc_id": cols["doc_id"], "stats": [statistics(t) for t in cols["text"]]}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return map_rows(slim, start, "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def fit(train: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE, width: float = WIDTH, seed: int = 7) -> Model:
    """Fit on every row of ``train`` (stats, label 0/1); without rows, a model that says 0.5.

    What reaches the driver has a fixed size: means and deviations, (fourier + 1) summed
    rows of the normal equations, and at most BINS counts."""
    train = cut(train)
    k = len(STATISTICS)
    moments = train.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(k), np.ones(k)
    for r in moments:
        mean[r["at"]], scale[r["at"]] = r["m"], max(r["s"], 1e-6)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(k, fourier)) / (width * np.sqrt(k)), rng.uniform(0, 2 * np.pi, fourier),
                  np.zeros(fourier + 1), np.zeros(0), np.zeros(0))
    if not moments:
        return model
    size = fourier + 1

    def equations(batches):
        total = np.zeros((size, size + 2))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                z, y = model.features(_matrix(part, "stats")), part.column("label").to_numpy().astype(np.float64)
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ y
                total[0, size + 1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], names=["row", "sums"])

    def add(table):
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"row": table.column("row")[:1], "sums": pa.array([sums], type=pa.list_(pa.float64()))})

    rows = map_arrow(train, equations, "row int, sums array<double>").groupBy("row").applyInArrow(add, "row int, sums array<double>").collect()
    total = np.array([r["sums"] for r in sorted(rows, key=lambda r: r["row"])])
    n = total[0, size + 1]
    model.beta = np.linalg.solve(total[:, :size] + ridge * n / fourier * np.eye(size), total[:, size])

    def binned(batches):
        for b in batches:
            raw = model.raw(_matrix(b, "stats"))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw + 0.5) / 2 * BINS, BINS - 1).astype(np.int32)), b.column("label").cast(pa.int32())],
                                             names=["bin", "label"])

    bins = sorted(map_arrow(train, binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect(),
                  key=lambda r: r["bin"])
    at = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in bins])
    model.knots, model.values = isotonic(at, np.array([r["n"] for r in bins], float), np.array([r["ones"] for r in bins], float))
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_on(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, quality) from the statistics of rows not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    return fit(stats.where(~held_out()).join(known, "doc_id").select("stats", "label"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) of rows that are not held out; rows of either
    table with a NULL key or label teach nothing, repeated rows count each.  A NULL text is
    empty; a NULL doc_id is not held out.  Without a label every score is 0.5.

    The texts are read once; the statistics lie in the shared checkpoint folder between the
    fit and the scoring."""
    stats = cut(document_statistics(docs))
    model = fit_on(stats, labels)

    def score(batches):
        for b in batches:
            s = model.score(_matrix(b, "stats"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= KEEP_SCORE).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(stats.withColumn("held_out", held_out()), score, "doc_id long, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier accepts.

    Texts are read twice, for the fit and for the decision; no text is shuffled."""
    model = fit_on(document_statistics(docs), labels)

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                x = np.array([statistics((t or "").encode()) for t in b.column("text").to_pylist()])
                yield b.filter(pa.array(model.score(x) >= KEEP_SCORE))

    return map_arrow(docs, keep, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
