"""Packing by minimum bin slack: documents' ids into sequences of a fixed capacity.

A document is cut at multiples of the capacity; those pieces fill a sequence each.  What
is left, a remainder shorter than the capacity, is packed by length alone: a window takes
the longest remainder there is and the multiset of other lengths whose sum comes closest
to the capacity, found by a bitset subset-sum over the lengths and backtracked into counts.
Where even the best multiset leaves room, one more remainder is cut to fill it, and its
tail is a remainder of its own.  The plan for a multiset is used as often as the counts
allow, so planning takes the histogram of lengths (at most capacity - 1 numbers) whatever
the number of documents.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.bpe import vocabulary
from causeway.llm.chunk_ids import CUT, ChunkIds, byte_encoding, id_lengths, slices, split_flat
from causeway.llm.common import cut, map_arrow, process_store, read, text_of

CAPACITY = 1024
SEPARATOR = 0
#: Remainders of one length are numbered in so many buckets of a key hash, each on its own.
BUCKETS = 256
#: Chunks whose ids a worker remembers (about 0.25 KB a chunk).
MEMO = 300_000
# Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenIds:
    """Ids of texts by a ``tokenizers`` file of byte-level BPE.

    The file's vocabulary is read as ranks, and chunks are encoded by them, as the library
    would.  A text that holds the literal of an added token is encoded whole by the library,
    which gives that literal one id."""

    def __init__(self, file: bytes, memo: int = MEMO):
        spec = json.loads(file)
        added = {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(_byte_characters())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.file, self.added, self.library = file, sorted(added), None
        self.encoding, self.lengths = byte_encoding(ranks, PATTERN), id_lengths(ranks)
        self.memo = ChunkIds(self.chunk_ids, (np.int32,), memo)

    def chunk_ids(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of chunks.  Each stands after a blank, but for those that begin a text, which
        are marked by a blank of their own."""
        n, parts = np.zeros(len(chunks), np.int64), []
        inner = [k for k, c in enumerate(chunks) if c[:1] != " "]
        texts = [" " + chunks[k] for k in inner]
        ids = self.encoding.encode_to_numpy("".join(texts), disallowed_special=()).astype(np.int32)
        n[inner] = split_flat(ids, self.lengths, np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        # back in the order of the chunks
        starts = [k for k, c in enumerate(chunks) if c[:1] == " "]
        own = [self.encoding.encode_to_numpy(chunks[k][1:], disallowed_special=()).astype(np.int32) for k in starts]
        n[starts] = [len(x) for x in own]
        out, place = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        shift = np.repeat(place[inner] - (np.cumsum(n[inner]) - n[inner]), n[inner])
        out[np.arange(len(ids)) + shift] = ids
        for k, x in zip(starts, own):
            out[place[k]:place[k] + len(x)] = x
        return [(out, n)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        split = []
        for t in texts:
            chunks = [] if not t or any(a in t for a in self.added) else CUT.split(t)
            if chunks:
                chunks[0] = " " + chunks[0]
            split.append(chunks)
        n = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.memo.rows(list(chain.from_iterable(split)))
        ids, per_chunk = self.memo.held[0].gather(rows)
        count = np.bincount(np.repeat(np.arange(len(texts)), n), per_chunk, len(texts)).astype(np.int64)
        whole = [k for k, t in enumerate(texts) if t and not n[k]]
        if not whole:
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for k in whole:
            parts[k] = np.array(self.by_library(texts[k]), np.int32)
            count[k] = len(parts[k])
        return np.concatenate(parts), count

    def by_library(self, text: str) -> list[int]:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark deals out the cores
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.file.decode())
        return self.library.encode(text, add_special_tokens=False).ids


def _byte_characters() -> list[str]:
    """The character that spells each byte in a byte-level vocabulary: printable ones stand
    for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within ``counts``) whose sum comes closest to ``room``.

    Bit s of ``bits`` says that the lengths so far can sum to s; the states before each
    length let the best sum be walked back into how often each length is taken."""
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        before = bits
        for _ in range(min(counts[length], room // length)):
            more = (bits | bits << length) & mask
            if more == bits:
                break
            bits = more
        steps.append((length, before))
        if bits >> room & 1:
            break
    left, taken = bits.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            taken[length] = n
    return taken


@dataclass
class Step:
    """``times`` windows of one kind: a multiset of lengths and, where it leaves room, the
    first ``piece`` ids of one more remainder of length ``cut``, whose tail is packed later."""

    window: dict[int, int]
    times: int
    cut: int = 0
    piece: int = 0


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps until every remainder is in a window.

    A window holds the longest remainder there is and the multiset that fills it best.  Only
    where no multiset fills it is a remainder cut: of the length that most are left of."""
    counts, plan = {x: c for x, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        window = best_fill(counts, capacity - longest)
        counts[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        step = Step(window, min(counts[x] // n for x, n in window.items()))
        room = capacity - sum(x * n for x, n in window.items())
        left = {x: c - window.get(x, 0) for x, c in counts.items() if c > window.get(x, 0)}
        if room and left:
            # what is left is longer than the room, or it would have been taken
            step.cut, step.piece = max(left, key=lambda x: (left[x], x)), room
            step.times = min([step.times, *(counts[x] // (n + (x == step.cut)) for x, n in window.items()), counts[step.cut]])
        plan.append(step)
        for x, n in [*window.items(), *([(step.cut, 1)] if step.cut else [])]:
            counts[x] -= n * step.times
        if step.cut:
            tail = step.cut - step.piece
            counts[tail] = counts.get(tail, 0) + step.times
        counts = {x: c for x, c in counts.items() if c}
    return plan


class Places:
    """Where the r-th remainder of a length lies, by the plan.

    Tails are numbered behind the remainders of their length, in the order of the cuts.
    A row of a length's table: first number, how many a window, first sequence, offset, ids
    placed there (all of them, unless cut), number of the first tail."""

    def __init__(self, plan: list[Step], counts: dict[int, int]):
        rows, used, total, self.sequences = defaultdict(list), defaultdict(int), defaultdict(int, counts), 0
        for step in plan:
            offset = 0
            for length in sorted(step.window, reverse=True):
                n = step.window[length]
                rows[length].append((used[length], n, self.sequences, offset, length, 0))
                used[length] += n * step.times
                offset += length * n
            if step.cut:
                tail = step.cut - step.piece
                rows[step.cut].append((used[step.cut], 1, self.sequences, offset, step.piece, total[tail]))
                used[step.cut] += step.times
                total[tail] += step.times
            self.sequences += step.times
        self.rows = {x: np.array(s, dtype=np.int64) for x, s in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(which, start in the remainder, ids, sequence, offset) of the pieces, cut by cut."""
        which, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        while len(which):
            sequence, offset, size, tail = (np.zeros(len(which), np.int64) for _ in range(4))
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                s = self.rows[int(x)]
                row = s[np.searchsorted(s[:, 0], rank[at], side="right") - 1]
                copy, place = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + copy, row[:, 3] + place * row[:, 4]
                size[at], tail[at] = row[:, 4], row[:, 5] + copy
            yield which, start, size, sequence, offset
            more = size < length
            which, start, rank, length = which[more], (start + size)[more], tail[more], (length - size)[more]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR,
                 memo: int = MEMO) -> DataFrame:
    """(doc_id, doc_tokens, crcs, tail): ids counted with the separator, a CRC for each run of
    ``capacity`` ids, and the ids that are left."""
    file = vocabulary(docs.sparkSession, path)
    end, kind = np.array([separator], dtype="<u4").tobytes(), [("doc_id", pa.int64()), ("doc_tokens", pa.int64()),
                                                               ("crcs", pa.list_(pa.int64())), ("tail", pa.binary())]

    def run(batches):
        store = process_store("tokenizers")
        if (path, memo) not in store:
            store[path, memo] = TokenIds(file.value, memo)
        for batch in batches:
            for b in slices(batch, "text"):
                ids, n = store[path, memo].encode(b.column("text").to_pylist())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                crcs, tails = [], []
                for stop, count in zip(ends.tolist(), n.tolist()):
                    text = raw[4 * (stop - count):4 * stop] + end
                    full = (count + 1) // capacity * capacity * 4
                    crcs.append([zlib.crc32(text[a:a + 4 * capacity]) for a in range(0, full, 4 * capacity)])
                    tails.append(text[full:])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n + 1), pa.array(crcs, kind[2][1]), pa.array(tails, pa.binary())],
                                                 schema=pa.schema(kind))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(slim, run, "doc_id long, doc_tokens long, crcs array<long>, tail binary", caches="tokenizers")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR,
         buckets: int = BUCKETS, memo: int = MEMO) -> DataFrame:
    """One row per piece: which ids of its document it holds, and where it lies.

    A NULL or empty text is the separator alone; a NULL doc_id stays; repeated rows are
    packed each; an empty table gives no piece.  The texts are read and encoded once (into
    the shared checkpoint folder: a few numbers a document and the ids that fill no sequence);
    only these are shuffled, once: the numbers before each (length, bucket) are joined on the
    key by which the rows already lie.  The plan, bounded by the capacity, goes out with the
    tasks.  ``memo`` bounds a worker's cache: fewer chunks take less memory and more time,
    and give the same rows."""
    rows = cut(token_pieces(docs, path, capacity, separator, memo))
    rows = rows.select("*", (F.col("doc_tokens") % capacity).alias("rest"),
                       F.floor(F.col("doc_tokens") / capacity).cast("long").alias("whole"),
                       F.pmod(F.xxhash64("doc_id", "crcs", "tail"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = cut(rows.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}
    places = Places(plan_windows(histogram, capacity), histogram)
    # whole pieces before each bucket, and inside a bucket before each length
    per_bucket = counts.groupBy("bucket").agg(F.sum("whole").alias("w")).withColumn("one", F.lit(1))
    per_bucket = per_bucket.select("bucket", F.coalesce(F.sum("w").over(
        Window.partitionBy("one").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    zero = F.lit(0).cast("long")
    starts = counts.join(F.broadcast(per_bucket), "bucket").select(
        "rest", "bucket",
        F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("rank0"),
        (F.col("base") + F.coalesce(F.sum("whole").over(Window.partitionBy("bucket").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)), zero)).alias("whole0"))
    order = Window.partitionBy("rest", "bucket").orderBy("doc_id", "doc_tokens", "crcs", "tail")
    numbered = (rows.withColumn("rank", F.row_number().over(order) - 1)
                .withColumn("earlier", F.coalesce(F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero))
                .join(starts, ["rest", "bucket"])
                .select("doc_id", "doc_tokens", "crcs", "tail", "rest", (F.col("rank") + F.col("rank0")).cast("long").alias("rank"),
                        (F.col("earlier") + F.col("whole0")).cast("long").alias("first_whole")))

    def lay(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                cols = b.slice(at, 4096)
                doc, crcs, tails = cols.column("doc_id"), cols.column("crcs"), cols.column("tail").to_pylist()
                tokens, rest, rank, first = (cols.column(c).to_numpy() for c in ("doc_tokens", "rest", "rank", "first_whole"))
                n = np.diff(crcs.offsets.to_numpy())
                of = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)         # which whole piece of its document
                yield piece_rows(doc, tokens, of, k * capacity, np.full(len(of), capacity), crcs.flatten(),
                                 places.sequences + first[of] + k, np.zeros(len(of), np.int64))
                left = np.flatnonzero(rest)
                for which, start, size, sequence, offset in places.of(rest[left], rank[left]):
                    of = left[which]
                    crc = [zlib.crc32(tails[i][4 * a:4 * (a + m)]) for i, a, m in zip(of.tolist(), start.tolist(), size.tolist())]
                    yield piece_rows(doc, tokens, of, n[of] * capacity + start, size, pa.array(crc, pa.int64()), sequence, offset)

    def piece_rows(doc, tokens, of, start, length, crc, sequence, offset):
        return pa.RecordBatch.from_arrays([doc.take(pa.array(of)), pa.array(start), pa.array(length), crc, pa.array(tokens[of]),
                                           pa.array(sequence), pa.array(offset)], schema=PIECES)

    return map_arrow(numbered, lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
