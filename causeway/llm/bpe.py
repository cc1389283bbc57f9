"""Byte-level BPE: whole texts to token ids and back, from a rank file.

A text is split by the vocabulary's pattern; inside a piece, the leftmost adjacent pair of
lowest rank is merged until no pair has a rank.  The pairs' ranks stand in a segment tree
over byte positions whose root is always that pair; a merge is three point updates on the
live neighbours, so a piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import ChunkMemo, map_rows, process_store, read, text_of

_NONE = 1 << 62


def pattern_of(pattern: str):
    """The split pattern; ``\\s`` is Unicode white space, as in the vocabulary's own engine."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                         .replace(r"\S", r"\P{White_Space}"))


#: A blank between two characters that are no white space (by Python's ``\\s``, which holds
#: all of Unicode's White_Space); written so that the search is for the blank itself.
_CUT = re.compile(r" (?<=\S )(?=\S)")


def chunks(text: str) -> list[str]:
    """Pieces of a text that split the same way alone as inside it, mostly words.

    A blank between two characters that are no white space always begins a new piece of the
    pattern, so a text is cut before each.  Beside other white space (a tab, a no-break
    space) a blank may stand inside a piece, and the run stays whole.  Where blanks follow
    one another, or end the text, the text is a single chunk."""
    if "  " in text or text.endswith(" "):
        return [text]
    first, *rest = _CUT.split(text)
    return ([first] if first else []) + [" " + x for x in rest]


class Merger:
    """Merges the bytes of one piece by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))

    def rank(self, piece: bytes, a: int, b: int) -> int:
        return self.ranks.get(piece[a:b], _NONE) if b - a <= self.longest else _NONE

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length() - 1
        # leaf i: the rank of the pair of parts that starts at byte i, above its position,
        # so the least key is the leftmost pair of least rank
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = self.rank(piece, i, i + 2)
            if r != _NONE:
                tree[size + i] = (r << shift) | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))    # starts of the neighbouring parts

        def put(i, r):
            tree[size + i] = (r << shift) | i if r != _NONE else _NONE
            i = (size + i) >> 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                if b < a:
                    a = b
                if tree[i] == a:
                    return
                tree[i] = a
                i >>= 1

        while tree[1] != _NONE:
            i = tree[1] & (size - 1)
            j = after[i]            # the right part, which joins the one at i
            k = after[j]
            after[i] = k
            before[k] = i
            put(j, _NONE)
            put(i, self.rank(piece, i, after[k]) if k < n else _NONE)
            if before[i] >= 0:
                put(before[i], self.rank(piece, before[i], k))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return out


class PieceMerger(Merger):
    """The same merges for many pieces at once: one segment tree a row of a matrix.

    Pieces are grouped by the power of two that holds their length; each step merges the
    root pair of every row that still has one."""

    LONGEST_ROW = 64

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        table = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct piece, as little-endian unsigned 32-bit integers."""
        out, groups = {}, {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > self.LONGEST_ROW:
                out[p] = array("I", self.ids(p)).tobytes()
            else:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        for size, group in groups.items():
            for at in range(0, len(group), 1 << 15):
                self._rows(group[at:at + (1 << 15)], size, out)
        return out

    def _rows(self, group: list[bytes], size: int, out: dict[bytes, bytes]) -> None:
        rows, shift = len(group), size.bit_length() - 1
        n = np.array([len(p) for p in group])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in group), dtype=np.uint8).reshape(rows, size)
        alive = np.arange(size) < n[:, None]
        ids = np.zeros((rows, size + 1), dtype=np.int64)
        ids[:, :size] = self.byte_ids[raw]
        after = np.tile(np.arange(1, size + 2), (rows, 1))
        before = np.tile(np.arange(-1, size), (rows, 1))
        tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
        rank = self.pair_rank(ids[:, :size - 1].ravel(), ids[:, 1:size].ravel()).reshape(rows, size - 1)
        rank[~alive[:, 1:]] = _NONE
        tree[:, size:2 * size - 1] = np.where(rank < _NONE, (rank << shift) | np.arange(size - 1), _NONE)
        for level in range(shift - 1, -1, -1):
            lo = 1 << level
            tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])

        def put(row, i, r):
            tree[row, size + i] = np.where(r < _NONE, (r << shift) | i, _NONE)
            node = (size + i) >> 1
            for _ in range(shift):
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1

        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            i, token = root & (size - 1), root >> shift
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = token
            after[row, i] = k
            before[row, k] = i
            alive[row, j] = False
            put(row, j, np.full(len(row), _NONE))
            put(row, i, np.where(k < n[row], self.pair_rank(token, ids[row, k]), _NONE))
            left = before[row, i]
            has = left >= 0
            put(row[has], left[has], self.pair_rank(ids[row[has], left[has]], token[has]))
            row = row[tree[row, 1] < _NONE]
        flat = ids[:, :size][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        for p, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
            out[p] = flat[a:b]


class Codec:
    """Encoder and decoder of one vocabulary; chunks are memoised in bounded space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 250_000):
        self.merger, self.pattern = PieceMerger(ranks), pattern_of(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo = ChunkMemo(self.chunk_ids, memo)

    def chunk_ids(self, many: list[str]) -> list[bytes]:
        pieces = [[p.encode() for p in self.pattern.findall(c)] for c in many]
        ids = self.merger.many(list({p for ps in pieces for p in ps}))
        return [b"".join([ids[p] for p in ps]) for ps in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.memo.join([chunks(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def vocabulary(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast value: its size is fixed, and workers need no copy."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids (array) of every row's whole text and the bytes they decode to.

    A NULL or empty text has no ids and no bytes; a NULL doc_id stays; rows come out as
    they come in; other columns are not read.  Row-local: no shuffle."""
    def outputs(ids, back):
        return {"ids": [np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids], "decoded": back}
    return _mapped(docs, path, pattern, "ids array<int>, decoded binary", outputs)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode_texts``, with the count and digests in place of ids and bytes."""
    def outputs(ids, back):
        return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back]}
    return _mapped(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", outputs)


def _mapped(docs, path, pattern, kind, outputs):
    file = vocabulary(docs.sparkSession, path)

    def start():
        store = process_store("bpe")
        if path not in store:
            store[path] = Codec(load_ranks(file.value), pattern)
        codec = store[path]

        def work(cols):
            ids = codec.encode(cols["text"])
            return {"doc_id": cols["doc_id"]} | outputs(ids, [codec.decode(i) for i in ids])
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(slim, start, "doc_id long, " + kind, caches="bpe")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
