"""Alignment of two tokenizers: the cuts they share, the tokens that overlap, and how often.

A byte-level BPE (A) and a piece BPE with byte fallback (B) encode the same bytes, a blank
and the text.  Where a token of both ends, the text can be cut; between neighbouring cuts
the tokens of A and B form a group.  Cuts are found by divide and conquer: of an interval,
the end of A nearest to its middle that bisection also finds among B's ends splits it, and
both halves go on; an interval without a common end is a leaf, a group.  All intervals of
a slice of documents are split together, level by level.

A link is a pair of tokens whose bytes overlap.  How many documents hold an id pair linked
is counted over the whole corpus; a document then looks up the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.bpe import load_ranks, vocabulary
from causeway.llm.chunk_ids import CUT, ChunkIds, byte_encoding, id_lengths, slices, split_flat
from causeway.llm.common import cut, map_arrow, process_store, read

#: Id pairs whose counts go out to the tasks at a time (24 MB); more pairs take more rounds.
PAIRS_PER_ROUND = 1 << 20
#: Entries whose documents are counted together in a task before they are passed on.
COUNT_BUFFER = 1 << 21
#: Chunks that a worker remembers (about 0.4 KB each).
MEMO = 250_000
_SPACE = "▁"


# ----- cuts ------------------------------------------------------------------------------

def shared_ends(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray,
                b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``a`` and ``b`` (ascending) share.

    Interval k holds a[a_from[k]:a_to[k]] and b[b_from[k]:b_to[k]] over the same bytes, so
    its last ends are equal and belong to the result; inside, it is divided as told above."""
    cuts = [a_to - 1]
    lo, hi, blo, bhi = a_from, a_to - 1, b_from, b_to - 1          # inner ends: lo..hi-1 and blo..bhi-1
    while len(lo):
        inner = (hi > lo) & (bhi > blo)
        lo, hi, blo, bhi = lo[inner], hi[inner], blo[inner], bhi[inner]
        at = _nearest_shared(a, b, lo, hi, blo, bhi)
        split = at >= 0
        at, lo, hi, blo, bhi = at[split], lo[split], hi[split], blo[split], bhi[split]
        cuts.append(at)
        pos = np.searchsorted(b, a[at])
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
        blo, bhi = np.concatenate([blo, pos + 1]), np.concatenate([pos, bhi])
    return np.sort(np.concatenate(cuts))


def _nearest_shared(a, b, lo, hi, blo, bhi) -> np.ndarray:
    """Of each interval, the place of the shared inner end nearest to its middle, or -1.

    Ends are tried outwards from the middle, in rings of doubling width."""
    middle, out = (lo + hi) // 2, np.full(len(lo), -1)
    open_, inside, reach = np.arange(len(lo)), 0, 1
    while len(open_):
        m, left, right = middle[open_], lo[open_], hi[open_]
        # places at a distance of ``inside`` to ``reach - 1`` from the middle, on either side
        starts = np.concatenate([np.maximum(left, m - reach + 1), np.maximum(m + max(inside, 1), left)])
        stops = np.concatenate([np.minimum(right, m - inside + 1), np.minimum(right, m + reach)])
        n = np.maximum(stops - starts, 0)
        of = np.repeat(np.concatenate([open_, open_]), n)
        places = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        ends = a[places]
        found = np.searchsorted(b, ends)
        shared = b[np.minimum(found, len(b) - 1)] == ends
        of, places = of[shared], places[shared]
        distance = np.abs(places - middle[of])
        order = np.lexsort((places, distance, of))
        of, places = of[order], places[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first]] = places[first]
        more = (out[open_] < 0) & ((m - reach >= left) | (m + reach < right))
        open_, inside, reach = open_[more], reach, 2 * reach
    return out


# ----- tokens ----------------------------------------------------------------------------

class Aligner:
    """Encodes texts with both vocabularies and aligns their tokens.

    Where a text is cut into chunks both have an end, so groups and links lie inside the
    chunks; a chunk that was seen before need not be divided again."""

    def __init__(self, ranks: bytes, pattern: str, pieces: bytes, limit: int):
        import sentencepiece
        table = load_ranks(ranks)
        self.encoding, self.a_bytes = byte_encoding(table, pattern), id_lengths(table)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        size = self.model.get_piece_size()
        spelled = [self.model.id_to_piece(i) for i in range(size)]
        self.b_spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode()
                          for i, p in enumerate(spelled)]
        self.b_bytes = np.array([len(x) for x in self.b_spelled], np.int64)
        # streams of a chunk: A and B as 2 * id + (whether it ends a group), and its links
        self.memo = ChunkIds(self.encode, (np.int32, np.int32, np.int64), limit)
        a_text = [b"%d%b" % (k, m) for k in range(len(self.a_bytes)) for m in (b",", b"|")]
        self.b_words = len(a_text)
        self.spelled = a_text + [b"%d%b" % (k, m) for k in range(size) for m in (b",", b";")]

    def encode(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The streams of distinct chunks; none where B does not give the chunk's bytes back."""
        texts = [" " + c for c in chunks]
        raw = [t.encode() for t in texts]
        ids_a = self.encoding.encode_to_numpy("".join(texts), disallowed_special=()).astype(np.int64)
        n_a = split_flat(ids_a, self.a_bytes, np.fromiter(map(len, raw), np.int64, len(raw)))
        many = self.model.encode(chunks, num_threads=1)                     # the model puts the blank before
        n_b = np.fromiter(map(len, many), np.int64, len(many))
        flat = list(chain.from_iterable(many))
        spell = self.b_spelled.__getitem__
        if b"".join(map(spell, flat)) != b"".join(raw):
            good = np.array([b"".join(map(spell, ids)) == r for ids, r in zip(many, raw)])
            ids_a, n_a = ids_a[np.repeat(good, n_a)], n_a * good
            flat, n_b = list(chain.from_iterable(ids for ids, g in zip(many, good) if g)), n_b * good
        ids_b = np.array(flat, np.int64)
        ends_a, ends_b = np.cumsum(self.a_bytes[ids_a]), np.cumsum(self.b_bytes[ids_b])
        full = np.flatnonzero(n_a)
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        at = shared_ends(ends_a, ends_b, (a_to - n_a)[full], a_to[full], (b_to - n_b)[full], b_to[full])
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[at] = 1
        last_b[np.searchsorted(ends_b, ends_a[at])] = 1
        ends = np.concatenate([ends_a, ends_b])
        ends.sort(kind="stable")
        ends = ends[np.flatnonzero(np.diff(ends, prepend=-1))]
        # between two neighbouring ends of either side lies one token of each: a link
        left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = np.bincount(np.searchsorted(a_to, left, side="right"), minlength=len(chunks))
        return [(2 * ids_a + last_a, n_a), (2 * ids_b + last_b, n_b), (ids_a[left] << 20 | ids_b[right], links)]

    def align(self, texts: list[str]) -> dict:
        """For a slice of texts: the counts, the digests and each document's linked id pairs."""
        split = [CUT.split(t) if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.memo.rows(list(chain.from_iterable(split)))
        of = np.repeat(np.arange(len(texts)), n)
        held_a, held_b, held_links = self.memo.held
        bad = n == 0
        bad[of[held_a.length[rows] == 0]] = True
        rows, of = rows[~bad[of]], of[~bad[of]]
        a, n_a = held_a.gather(rows)
        b, n_b = held_b.gather(rows)
        links, n_links = held_links.gather(rows)

        def each(count):
            return np.bincount(of, count, len(texts)).astype(np.int64)

        out = {"n_a": each(n_a), "n_b": each(n_b), "n_links": each(n_links)}
        out["n_groups"] = np.bincount(np.repeat(of, n_a), a & 1, len(texts)).astype(np.int64)
        out["groups_sha256"], out["links"] = [""] * len(texts), [b""] * len(texts)
        # tokens of a group stand together, its A before its B
        last_a, last_b = np.flatnonzero(a & 1), np.flatnonzero(b & 1)
        before_b = np.concatenate([[0], last_b + 1])[np.cumsum(a & 1) - (a & 1)]
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + before_b] = a
        words[np.arange(len(b)) + (last_a + 1)[np.cumsum(b & 1) - (b & 1)]] = b.astype(np.int64) + self.b_words
        key, times = np.unique(np.repeat(of, n_links) << 40 | links, return_counts=True)
        bounds = np.searchsorted(key >> 40, np.arange(len(texts) + 1))
        pairs, ends = key & ((1 << 40) - 1), np.cumsum(out["n_a"] + out["n_b"])
        words, spell = words.tolist(), self.spelled.__getitem__
        for k in np.flatnonzero(~bad).tolist():
            start = ends[k] - out["n_a"][k] - out["n_b"][k]
            out["groups_sha256"][k] = hashlib.sha256(b"".join(map(spell, words[start:ends[k]]))[:-1]).hexdigest()
            out["links"][k] = pack_links(pairs[bounds[k]:bounds[k + 1]], times[bounds[k]:bounds[k + 1]])
        return out


def pack_links(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """A document's linked id pairs (a << 20 | b, ascending) and how often each is linked."""
    a = pairs >> 20
    parts = np.concatenate([np.diff(a, prepend=0), pairs & ((1 << 20) - 1), times]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(parts.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    parts = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(3, -1).astype(np.int64)
    return np.cumsum(parts[0]) << 20 | parts[1], parts[2]


# ----- the corpus ------------------------------------------------------------------------

_ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])


def align_tokens(docs: DataFrame, ranks: str, pattern: str, pieces: str, limit: int = MEMO) -> DataFrame:
    """One row per document: tokens, groups, links, the digest of its groups, its packed pairs."""
    spark = docs.sparkSession
    a_file, b_file = vocabulary(spark, ranks), vocabulary(spark, pieces)

    def run(batches):
        store = process_store("alignment")
        if (ranks, pieces, limit) not in store:
            store[ranks, pieces, limit] = Aligner(a_file.value, pattern, b_file.value, limit)
        for batch in batches:
            for b in slices(batch, "text"):
                got = store[ranks, pieces, limit].align([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[f.name], type=f.type) for f in _ALIGNED if f.name != "doc_id")],
                                                 schema=_ALIGNED)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary",
                     caches="alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether no pair of its A id is in more.

    Tasks count what they hold before anything is shuffled; an A id has at most as many
    pairs as B has ids, so the window is bounded by a vocabulary."""
    def count(batches):
        buffer, held = [], 0

        def flush():
            pairs, n = np.unique(np.concatenate(buffer), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for links in b.column("links").to_pylist():
                pairs, _ = unpack_links(links)
                buffer.append(pairs)
                held += len(pairs)
                if held >= COUNT_BUFFER:
                    yield flush()
                    buffer, held = [], 0
        if held:
            yield flush()

    counts = map_arrow(aligned.select("links"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 20))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _looked_up(rows: DataFrame, counts: pa.Table) -> DataFrame:
    """(row, n_best, count_sum): what the given counts add to each document."""
    pair, n, best = (counts.column(k).to_numpy() for k in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = rows.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))

    def run(batches):
        known, n, best = shared.value
        for b in batches:
            size = b.num_rows
            links = [unpack_links(x) for x in b.column("links").to_pylist()]
            of = np.repeat(np.arange(size), [len(p) for p, _ in links])
            pairs = np.concatenate([p for p, _ in links]) if links else np.zeros(0, np.int64)
            times = np.concatenate([t for _, t in links]) if links else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            hit = np.flatnonzero(known[at] == pairs) if len(known) else np.zeros(0, np.int64)
            at, of, times = at[hit], of[hit], times[hit]
            total, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(total, of, times * n[at])
            np.add.at(most, of, times * best[at])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(most), pa.array(total)], names=["row", "n_best", "count_sum"])

    return map_arrow(rows.select("row", "links"), run, "row long, n_best long, count_sum long")


def align_corpus(docs: DataFrame, ranks: str, pattern: str, pieces: str,
                 pairs_per_round: int = PAIRS_PER_ROUND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A text that is NULL, empty or not given back by a vocabulary byte for byte (U+2581,
    which stands for a blank in B) has no tokens: zeros and an empty digest.  A NULL doc_id
    stays; repeated rows count as documents of their own; an empty table gives no row;
    other columns are not read.

    Texts are read and encoded once; the aligned rows lie in the shared checkpoint folder.
    The counts of all pairs are brought to them in rounds of at most ``pairs_per_round``
    pairs (by a hash of the pair), so no round's broadcast grows with the corpus, and the
    rounds' sums are added by row."""
    aligned = cut(align_tokens(docs, ranks, pattern, pieces)).withColumn("row", F.monotonically_increasing_id())
    counts = cut(pair_counts(aligned))
    rounds = -(-counts.count() // pairs_per_round) or 1
    # hashed into twice the rounds, so that none is over-full by chance
    rounds = rounds if rounds == 1 else 2 * rounds
    parts = [_looked_up(aligned, counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == k).toArrow()) for k in range(rounds)]
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("links").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files
    return align_corpus(read(spark, sf_dir, "documents"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, files.path("piece_bpe_32k.model"))
