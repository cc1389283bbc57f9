"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression.

The kernel is a blended spectrum of presence: for each n from 1 to 4, the byte n-grams that
two texts share, over the root of the product of how many each has, averaged over n.  The
n-grams that count are those most often present in some language of the training sample.
A few training documents are landmarks; a text's kernel values against them, through the
inverse root of the landmarks' own kernel matrix, are its features, on which one ridge
regression a language is fitted against the rest.  Texts are scored in batches: presence
by landmarks, kernel values by weights, two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.chunk_ids import slices
from causeway.llm.common import cut, map_arrow, read

ORDERS = (1, 2, 3, 4)
#: Most n-grams of each order that count.
GRAMS = 4096
#: The fit uses at most so many documents of each language, chosen by a hash.
SAMPLE = 500
#: Landmarks, dealt out over the languages (one of each at least).
LANDMARKS = 256
RIDGE = 1e-3
#: How far apart ridge scores must be for a score near 1.
SHARPNESS = 6.0
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

#: Letters and bytes beyond ASCII count; everything else is a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SLOTS, _SLOT_SHIFT, _GOLD = 1 << 18, np.uint32(14), np.uint32(2654435769)


def codes(text: str) -> list[np.ndarray]:
    """For each order, the n-grams (n bytes as a number) of the lower-cased text, whose runs of
    other characters are one blank, with a blank at either end."""
    raw = b" ".join([b"", *text.lower().encode().translate(_LETTERS).split(), b""])
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out, gram = [], x
    for n in ORDERS:
        if n > 1:
            gram = gram[:-1] | x[n - 1:] << np.uint32(8 * (n - 1)) if len(x) >= n else x[:0]
        out.append(gram)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Grams:
    """The n-grams of one order that count, found by one look into a table.

    Of those that fall on one slot, the first stays: a dictionary is fixed before the fit."""

    def __init__(self, wanted: np.ndarray):
        slot = (wanted * _GOLD) >> _SLOT_SHIFT
        _, first = np.unique(slot, return_index=True)
        self.grams = wanted[np.sort(first)]
        self.code, self.at = np.zeros(_SLOTS, np.uint32), np.full(_SLOTS, -1, np.int32)
        slot = (self.grams * _GOLD) >> _SLOT_SHIFT
        self.code[slot], self.at[slot] = self.grams, np.arange(len(self.grams))

    def present(self, found: np.ndarray, row: np.ndarray) -> None:
        """Sets the places of ``row`` whose n-grams are in ``found``."""
        slot = (found * _GOLD) >> _SLOT_SHIFT
        at = self.at[slot[self.code[slot] == found]]
        row[at[at >= 0]] = 1


def presence(grams: list[Grams], texts: list[str]) -> list[np.ndarray]:
    """For each order a matrix: 1 where the text has the n-gram."""
    out = [np.zeros((len(texts), len(g.grams)), np.float32) for g in grams]
    for k, t in enumerate(texts):
        for g, found, m in zip(grams, codes(t), out):
            g.present(found, m[k])
    return out


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Blended presence kernel of two lists of texts, given by their presence matrices."""
    total = np.zeros((len(a[0]), len(b[0])))
    for x, y in zip(a, b):
        size = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(y.sum(axis=1), 1))
        total += (x @ y.T) / size
    return total / len(a)


@dataclass
class Model:
    """Ridge scores of texts for each language; without a language, nothing is learned."""

    languages: list[str]
    grams: list[Grams]
    landmarks: list[np.ndarray]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return kernel(presence(self.grams, texts), self.landmarks) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and a score from 0 to 1; ``und`` and 0 for a
        NULL text and one without a letter."""
        known = [k for k, t in enumerate(texts) if t is not None and has_letter(t)] if self.languages else []
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            s = self.scores([texts[k] for k in known])
            p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            best = s.argmax(axis=1)
            score[known] = p.max(axis=1) / p.sum(axis=1)
            for k, l in zip(known, best):
                names[k] = self.languages[l]
        return names, score


def fit_ridge(k_landmarks: np.ndarray, k_sample: np.ndarray, labels: np.ndarray, languages: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the landmarks' kernel values: (landmarks, languages).

    Features are kernel values through the inverse root of the landmarks' matrix; every
    language has the same weight in the least squares, however many documents it has."""
    values, vectors = np.linalg.eigh(k_landmarks)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k_sample @ root
    of = np.bincount(labels, minlength=languages)
    w = 1.0 / (languages * of[labels])
    target = 2.0 * (labels[:, None] == np.arange(languages)) - 1
    return root @ np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(z.shape[1]), (z * w[:, None]).T @ target)


# ----- the corpus ------------------------------------------------------------------------

def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text, place): at most ``per_language`` documents of each language, by a hash.

    Rows are thinned by the hash to four times that before they are ranked, so neither the
    shuffle nor a language's task grows with the documents.  A NULL doc_id, lang or text
    teaches nothing."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.xxhash64(F.lit("language sample"), F.col("doc_id"))
    thin = (known.join(F.broadcast(counts), "lang")             # one row a language
            .where(F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < 4.0 * per_language))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    return (thin.select("lang", "text", "doc_id", draw.alias("draw")).withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= per_language).select("lang", "text", "place"))


def choose_grams(sample: DataFrame, most: int = GRAMS) -> list[Grams]:
    """The n-grams with the largest share of documents in some language, for each order."""
    def count(batches):
        found: dict = {}

        def flush():
            for lang, parts in found.items():
                for n, arrays in enumerate(parts):
                    gram, docs = np.unique(np.concatenate(arrays), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram.astype(np.int64)), pa.array(docs)],
                        names=["lang", "order", "gram", "docs"])
            found.clear()

        held = 0
        for batch in batches:
            for b in slices(batch, "text"):
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    parts = found.setdefault(lang, [[] for _ in ORDERS])
                    for part, c in zip(parts, codes(text)):
                        part.append(np.unique(c))
                        held += len(part[-1])
                if held > 1 << 21:
                    yield from flush()
                    held = 0
        yield from flush()

    held = map_arrow(sample.select("lang", "text"), count, "lang string, order int, gram long, docs long")
    held = held.groupBy("lang", "order", "gram").agg(F.sum("docs").alias("docs"))
    sizes = sample.groupBy("lang").agg(F.count("*").alias("n"))
    share = held.join(F.broadcast(sizes), "lang").groupBy("order", "gram").agg(F.max(F.col("docs") / F.col("n")).alias("share"))
    share = cut(share)
    return [Grams(np.array([r["gram"] for r in share.where(F.col("order") == n).orderBy(F.desc("share"), "gram").limit(most).collect()], np.uint32))
            for n in range(len(ORDERS))]


def fit(docs: DataFrame, per_language: int = SAMPLE, landmarks: int = LANDMARKS, grams: int = GRAMS) -> Model:
    """A model of ``docs`` (doc_id, text, lang), from rows that are not held out.

    The driver gets the chosen n-grams and one bit for each of them and sampled document."""
    sample = cut(training_sample(docs, per_language))
    chosen = choose_grams(sample, grams)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def bits(batches):
        for batch in batches:
            for b in slices(batch, "text", rows=128):
                packed = [np.packbits(p > 0, axis=1) for p in presence(shared.value, b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array([r.tobytes() for r in np.hstack(packed)], pa.binary())],
                                                 names=["lang", "place", "bits"])

    rows = map_arrow(sample, bits, "lang string, place int, bits binary").orderBy("lang", "place").collect()
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return Model([], chosen, [np.zeros((0, len(g.grams)), np.float32) for g in chosen], np.zeros((0, 0)))
    labels = np.array([languages.index(r["lang"]) for r in rows])
    each = max(1, landmarks // len(languages))
    mark = np.flatnonzero([r["place"] <= each for r in rows])
    widths = np.cumsum([0, *(-(-len(g.grams) // 8) for g in chosen)])

    def matrices(which):
        raw = [np.frombuffer(rows[k]["bits"], np.uint8) for k in which]
        return [np.unpackbits(np.stack([r[lo:hi] for r in raw]), axis=1)[:, :len(g.grams)].astype(np.float32)
                for g, lo, hi in zip(chosen, widths, widths[1:])]

    marks = matrices(mark)
    k_sample = np.vstack([kernel(matrices(range(at, min(at + 512, len(rows)))), marks) for at in range(0, len(rows), 512)])
    return Model(languages, chosen, marks, fit_ridge(kernel(marks, marks), k_sample, labels, len(languages)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row's whole text.  Row-local: no shuffle.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every text when
    nothing was learned.  A NULL doc_id stays and is not held out; repeated rows come out
    each; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text", rows=256):
                names, score = shared.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
