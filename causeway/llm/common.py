"""Helpers shared by the text operators: scans, lineage cuts, Arrow batch mapping."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import checkpoint_dir, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's reader only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later passes read it, executors may go.

    What led to it is garbage then, but Spark drops shuffle files only when the driver
    collects its garbage, which a driver with little to do puts off: so it is asked to."""
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return done


def text_of(column: str = "text"):
    """The whole text, a NULL one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema, caches: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package shipped by value (workers need no install).

    ``caches`` names the operator's ``process_store``; a task drops those of other
    operators first, so a worker that serves many operators holds one's caches at a time."""
    ship_package()

    def task(batches):
        drop_stores(caches)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, start: Callable[[], Callable[[list], dict]], schema: str,
             size: int = 512, caches: str | None = None) -> DataFrame:
    """Map slices of at most ``size`` rows, so memory follows a slice and not a partition.

    ``start()`` runs once per task and returns a function from the slice's columns (a dict
    of Python lists) to the output columns (a dict in the order of ``schema``)."""
    arrow = pa.schema([pa.field(n, t) for n, t in _arrow_fields(schema)])

    def run(batches):
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                cols = {n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)}
                out = work(cols)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema, caches)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
          "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}


def _arrow_fields(schema: str):
    for part in schema.split(","):
        name, kind = part.split()
        yield name, _ARROW[kind]


def process_store(name: str) -> dict:
    """A dictionary kept for the life of a Python worker process, across its tasks.

    Only caches go here: an operator's results never depend on what it holds."""
    store = sys.modules.setdefault("_causeway_llm_store", types.ModuleType("_causeway_llm_store"))
    return store.__dict__.setdefault(name, {})


def drop_stores(keep: str | None) -> None:
    """Forget the stores of this worker process other than ``keep``."""
    store = sys.modules.get("_causeway_llm_store")
    for name in [n for n in vars(store) if not n.startswith("__") and n != keep] if store else []:
        vars(store)[name].clear()
        delattr(store, name)
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: allocators keep it for a worker's next task, and
    beside the JVM every idle worker's share counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


class ChunkMemo:
    """What ``make`` gives for chunks of texts (words, mostly), kept in bounded space.

    ``make`` gets the unknown chunks of a slice of texts at once.  Two generations of about
    ``limit`` chunks each are kept: when the young one is full it becomes the old one, so
    frequent chunks survive and memory is bounded whatever the number of distinct ones.
    A text that is one chunk is made anew each time, since it may be as long as any text."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = 250_000):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The made bytes of each text's chunks, joined."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        unknown = []
        for c in set().union(*(t for t in texts if len(t) > 1)).difference(self.young):
            known = self.old.get(c)
            if known is None:
                unknown.append(c)
            else:
                self.young[c] = known
        self.young.update(zip(unknown, self.make(unknown)))
        find = self.young.__getitem__
        whole = iter(self.make([t[0] for t in texts if len(t) == 1]))
        return [next(whole) if len(t) == 1 else b"".join(map(find, t)) for t in texts]
