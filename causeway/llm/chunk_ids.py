"""Ids of texts by public tokenizers, chunk by chunk, in arrays.

Texts repeat their words.  A text is cut where every tokenizer used here begins a new
piece; each distinct chunk is encoded once while it is remembered, and the ids of a slice
of texts are gathered from one growing array, without a Python object for a token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A blank between two characters that are no white space.  Nothing of the split pattern
#: holds a blank after a non-blank, so a piece begins there, whatever stands around.
CUT = re.compile(r" (?<=\S )(?=\S)")

#: Chunks remembered by a worker, and the most ids they may have together.
LIMIT = 300_000
IDS_PER_CHUNK = 16


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``size`` bytes of ``column`` (one row at least)."""
    ends = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


class Growing:
    """An array of ids with the start and the length of each chunk's part."""

    def __init__(self, kind):
        self.ids, self.used = np.zeros(1 << 16, kind), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(need, 2 * len(self.ids)) - self.used, self.ids.dtype)])
        self.ids[self.used:need] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used = need

    def gather(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        n = self.length[chunks]
        shift = np.repeat(self.start[chunks] - (np.cumsum(n) - n), n)
        return self.ids[shift + np.arange(len(shift))], n


class ChunkIds:
    """Remembers what an encoder makes of chunks, in bounded space.

    ``encode`` turns a list of chunks into one or more streams of ids: for each, the ids of
    the chunks one after another and the number that each chunk has.  When more than
    ``limit`` chunks, or ids in proportion, are held, all are forgotten: what is held is at
    most that and one slice.  Results never depend on it."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], kinds: tuple, limit: int = LIMIT):
        self.encode, self.kinds, self.limit = encode, kinds, limit
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held = [Growing(k) for k in self.kinds]

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The place of each chunk; unknown ones are encoded together."""
        kinds = set(chunks)
        unknown = list(kinds.difference(self.at))
        if len(self.at) + len(unknown) > self.limit or max(h.used for h in self.held) > IDS_PER_CHUNK * self.limit:
            self.forget()
            unknown = list(kinds)
        if unknown:
            streams = self.encode(unknown)
            first = len(self.at)
            self.at.update(zip(unknown, range(first, first + len(unknown))))
            for held, made in zip(self.held, streams):
                held.add(*made)
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))


def byte_encoding(ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
    """The library's byte-level encoding of a rank file; ``special`` texts have an id of their own."""
    import tiktoken
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})


def id_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each id."""
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[np.fromiter(ranks.values(), np.int64, len(ranks))] = np.fromiter(map(len, ranks), np.int64, len(ranks))
    return out


def split_flat(ids: np.ndarray, lengths: np.ndarray, chunk_bytes: np.ndarray) -> np.ndarray:
    """How many ids each chunk has, when ``ids`` encode the chunks one after another and a
    new piece begins with each."""
    ends = np.cumsum(lengths[ids])
    return np.diff(np.searchsorted(ends, np.cumsum(chunk_bytes), side="right"), prepend=0)
