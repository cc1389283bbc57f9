"""Hard-negative mining by a vertical scan of columnar blocks (branch and bound on dimensions).

Vectors lie in blocks, one array a dimension.  An anchor reads the dimensions in the order
of its own descending magnitudes.  After each step the least and the most that the
dimensions still unread can add, from their extremes in the block, bound every row's score
from both sides; rows that no bound admits leave the candidate bitmap, and what is left at
the end has exact scores.

Two scans: the first finds an anchor's best rows of its own label (positives), the second,
for the window of scores that each positive allows, the best rows of other labels.  Anchors
go out in packs of bounded size, and every pack meets every block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import cut, map_arrow, read

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block, dimensions read at a step, anchors that go out at a time (64 dimensions: 16 MB).
BLOCK = 8192
STEP = 8
ANCHORS = 32_768

_BLOCK = pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("known", pa.binary()),
                    ("labels", pa.binary()), ("columns", pa.binary())])
_BLOCK_DDL = "n long, dim long, kind string, ids binary, known binary, labels binary, columns binary"
_LEAST = np.iinfo(np.int64).min


class Block:
    """Rows in columns, ordered by label; ``known`` tells which have an id."""

    def __init__(self, ids, known, labels, columns):
        self.ids, self.known, self.labels, self.columns = ids, known, labels, columns

    @classmethod
    def of_rows(cls, ids: pa.Array, labels: pa.Array, vectors: pa.ListArray, scale: int) -> Block:
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if len(flat) and np.abs(flat).max() >= 2.0 ** 53:
            raise ValueError("a scaled component has more than 53 bits")
        columns = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        columns[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        known = np.asarray(ids.is_valid())
        ids, labels = ids.fill_null(0).to_numpy(), labels.to_numpy()
        order = np.lexsort((ids, ~known, labels))
        return cls(ids[order], known[order], labels[order], columns[:, order])

    def packed(self) -> pa.RecordBatch:
        top = int(np.abs(self.columns).max(initial=0))
        kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
        values = (len(self.ids), len(self.columns), kind, self.ids.tobytes(), self.known.tobytes(), self.labels.tobytes(),
                  self.columns.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)

    @classmethod
    def unpacked(cls, row: dict) -> Block:
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["labels"], np.int64),
                   np.frombuffer(row["columns"], row["kind"]).reshape(row["dim"], row["n"]))

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        dim = max(len(b.columns) for b in blocks)
        columns = [np.pad(b.columns.astype(np.int64), ((0, dim - len(b.columns)), (0, 0))) for b in blocks]
        return cls(*(np.concatenate([getattr(b, k) for b in blocks]) for k in ("ids", "known", "labels")), np.hstack(columns))


def pack_rows(rows: DataFrame, size: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """``rows`` (id, label, vector) as blocks of at most ``size``, made where the rows lie."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(pieces):
        t = pa.Table.from_batches(pieces).combine_chunks()
        return Block.of_rows(*(t.column(c).combine_chunks() for c in ("id", "label", "vector")), scale).packed()

    return map_arrow(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")), run, _BLOCK_DDL)


def usable(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part: a label and only finite components."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vector")).where(F.col("label").isNotNull() & finite)


# ----- the vertical scan -----------------------------------------------------------------

class Columns:
    """A block's columns as numbers in which scores are exact, with each column's extremes."""

    def __init__(self, block: Block, most: int):
        """``most``: the largest magnitude of an anchor's component."""
        columns = block.columns
        self.low = columns.min(axis=1, initial=0).astype(np.int64)
        self.high = columns.max(axis=1, initial=0).astype(np.int64)
        bound = most * int(np.maximum(-self.low, self.high).sum())      # Python integers: no overflow
        if bound >= 1 << 62:
            raise ValueError("scores need more than 62 bits")
        self.values = columns.astype(np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64)

    def scan(self, anchor: np.ndarray, start: int, stop: int, admit: Callable[[np.ndarray, np.ndarray], np.ndarray],
             step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the rows in start..stop that ``admit(least, most)`` keeps
        while the columns are read in the order of the anchor's descending magnitudes."""
        dim = min(len(anchor), len(self.values))
        order = np.argsort(-np.abs(anchor[:dim]), kind="stable")
        a = anchor[order]
        one, two = a * self.low[order], a * self.high[order]
        least = np.append(np.cumsum(np.minimum(one, two)[::-1])[::-1], 0)       # of the columns not yet read
        most = np.append(np.cumsum(np.maximum(one, two)[::-1])[::-1], 0)
        a = a.astype(self.values.dtype)
        live, score = None, np.zeros(stop - start, self.values.dtype)
        for at in range(0, dim, step):
            columns = order[at:at + step]
            part = self.values[columns, start:stop] if live is None else self.values[columns[:, None], live]
            score += a[at:at + step] @ part
            end = min(at + step, dim)
            keep = admit(score + least[end], score + most[end])
            n = np.count_nonzero(keep)
            if n == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            # the bitmap is applied when it pays: gathering rows costs more than reading on
            if n < (len(score) // 4 if live is None else len(score)) or end == dim:
                live, score = (np.flatnonzero(keep) + start if live is None else live[keep]), score[keep]
        if live is None:
            live = np.arange(start, stop)
        return live, score.astype(np.int64)


class Best:
    """The best ``k`` rows so far of each of many anchors: score, then known id, then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LEAST)
        self.ids, self.known = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.full = np.zeros(n, np.int64)

    def worst(self, i: int) -> int:
        """The score below which no further row can be among the best of ``i``."""
        return self.score[i, self.k - 1]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        n = self.full[i]
        score, ids, known = (np.concatenate([x[i, :n], y]) for x, y in ((self.score, score), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[:self.k]
        n = self.full[i] = len(order)
        self.score[i, :n], self.ids[i, :n], self.known[i, :n] = score[order], ids[order], known[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(which anchor, which place) of all rows held."""
        return np.nonzero(np.arange(self.k) < self.full[:, None])


def best_of_label(block: Block, columns: Columns, anchors: Block, best: Best) -> None:
    """Adds to each anchor's best those of the block's rows that share its label."""
    first = np.searchsorted(block.labels, anchors.labels)
    last = np.searchsorted(block.labels, anchors.labels, side="right")
    for i in range(len(anchors.ids)):
        if first[i] == last[i]:
            continue

        def admit(least, most, floor=best.worst(i), k=best.k):
            if len(least) > k:
                floor = max(floor, np.partition(least, len(least) - k)[-k])
            return most >= floor

        at, score = columns.scan(anchors.columns[:, i], first[i], last[i], admit)
        best.add(i, score, block.ids[at], block.known[at])


def best_in_windows(block: Block, columns: Columns, anchors: Block, low: np.ndarray, high: np.ndarray, best: Best) -> None:
    """Adds to the best of each anchor's windows the block's rows of other labels.

    Window j of anchor i admits scores from low[i, j] to high[i, j] (none if low > high) and
    its best are number i * windows + j."""
    windows = low.shape[1]
    first = np.searchsorted(block.labels, anchors.labels)
    last = np.searchsorted(block.labels, anchors.labels, side="right")
    for i in range(len(anchors.ids)):
        floor = [max(low[i, j], best.worst(i * windows + j)) for j in range(windows)]
        open_ = [j for j in range(windows) if floor[j] <= high[i, j]]
        if not open_:
            continue

        def admit(least, most):
            keep = np.zeros(len(least), bool)
            for j in open_:
                keep |= (most >= floor[j]) & (least <= high[i, j])
            return keep

        for start, stop in ((0, first[i]), (last[i], len(block.ids))):
            if start == stop:
                continue
            at, score = columns.scan(anchors.columns[:, i], start, stop, admit)
            for j in open_:
                inside = (score >= floor[j]) & (score <= high[i, j])
                if inside.any():
                    best.add(i * windows + j, score[inside], block.ids[at[inside]], block.known[at[inside]])


# ----- the corpus ------------------------------------------------------------------------

def _scan_blocks(blocks: DataFrame, shared, visit: Callable, size: int, k: int) -> DataFrame:
    """(number, score, id): the best ``k`` of each of ``size`` numbers, over all blocks.

    A task keeps one best list for all its blocks, so later blocks meet sharper bounds and
    a task passes on k rows a number at most; these are ranked once more."""
    def run(batches):
        best, anchors, most = Best(size, k), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if anchors is None:
                    anchors = shared.value
                    most = int(np.abs(anchors[0].columns).max(initial=0))
                block = Block.unpacked(row)
                visit(block, Columns(block, most), *anchors, best)
        number, place = best.rows()
        ids = pa.array(best.ids[number, place], mask=~best.known[number, place])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(best.score[number, place]), ids], names=["number", "score", "id"])

    found = map_arrow(blocks, run, "number long, score long, id long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, anchors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, per_pack: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` are rows of ``rows``.  A component x counts as floor(scale * x); a score is
    the inner product of such integers, exact (more than 62 bits raise an error; a shorter
    vector has zeros at its end).  Rows with a NULL label, a NULL vector, or a NULL or
    non-finite component take no part.  Higher scores come first, ties by smaller vec_id, a
    NULL vec_id last.  A repeated row is another row; an anchor leaves itself out once.
    Without positives or without rows in a window there is no row; other columns are not read.

    Blocks lie in the shared checkpoint folder; the anchors go out ``per_pack`` at a time,
    so what the driver holds and sends is bounded however many there are."""
    blocks = cut(pack_rows(usable(rows, vec_id, label, vector), block, scale))
    packs = cut(pack_rows(usable(anchors, vec_id, label, vector), min(1024, per_pack), scale)).withColumn("pack", F.monotonically_increasing_id())
    parts, group, n = [], [], 0
    sizes = sorted((r["pack"], r["n"]) for r in packs.select("pack", "n").collect())
    for pack, size in [*sizes, (None, per_pack)]:
        if group and n + size > per_pack:
            held = packs.where(F.col("pack").between(group[0], group[-1])).drop("pack").collect()
            parts.append(_mine(blocks, Block.joined([Block.unpacked(r.asDict()) for r in held]), positives, negatives, low, high))
            group, n = [], 0
        group.append(pack)
        n += size
    if not parts:
        parts = [_mine(blocks, Block.of_rows(pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64())), scale),
                       positives, negatives, low, high)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mine(blocks: DataFrame, anchors: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    sc, n = blocks.sparkSession.sparkContext, len(anchors.ids)
    # one more than the positives: the anchor itself is among them, or lower than all
    found = _scan_blocks(blocks, sc.broadcast((anchors,)), best_of_label, n, positives + 1).toArrow().to_pydict()
    score, ids = np.zeros((n, positives), np.int64), np.zeros((n, positives), object)
    have, seen = np.zeros(n, np.int64), np.zeros(n, bool)
    own = (anchors.columns.astype(object) ** 2).sum(axis=0) if n else []
    for k in np.lexsort((found["rank"], found["number"])):
        i, s, v = found["number"][k], found["score"][k], found["id"][k]
        if not seen[i] and s == own[i] and v == anchors.ids[i]:
            seen[i] = True
        elif have[i] < positives:
            score[i, have[i]], ids[i, have[i]] = s, v
            have[i] += 1
    # 100 * negative between low * positive and high * positive, in integers
    whole = score.astype(object)
    floor, ceiling = (-(-low * whole // 100)).astype(np.int64), (high * whole // 100).astype(np.int64)
    missing = np.arange(positives) >= have[:, None]
    floor[missing], ceiling[missing] = 0, -1
    windows = _scan_blocks(blocks, sc.broadcast((anchors, floor, ceiling)), best_in_windows, n * positives, negatives)
    names, bound = sc.broadcast((anchors.ids, ids.ravel(), score.ravel())), positives

    def name(batches):
        anchor, positive, scores = names.value
        for b in batches:
            at = b.column("number").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[at // bound]), pa.array(list(positive[at]), pa.int64()), b.column("rank"), b.column("id"),
                 pa.array(scores[at]), b.column("score")],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return map_arrow(windows.select("number", "rank", "id", "score"), name,
                     "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vec_id has its label moved on by one; anchors are every fiftieth."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine_negatives(rows, rows.where("vec_id % 50 = 0"))
