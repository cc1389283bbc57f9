"""Document fingerprints: a Merkle tree over sections, paragraphs and spans of a text.

Paragraphs are the lines of a text; a section ends at a blank line or after a paragraph
whose digest falls in one class of eight, so section borders move with the content and
not with its position.  Inside a paragraph the leaves are spans that end at punctuation.
Every node's digest is taken over the digests of its children, so equal roots mean equal
texts and a comparison descends only into branches whose digests differ.

A fingerprint is the tree in one string: the root (32 hexadecimal digits), then ``/`` and
a section each; a section is its digest and ``;`` with a paragraph each; a paragraph is
its digest and ``,`` with a span each (12, 12 and 8 digits).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import map_arrow, read, shuffle_partitions, text_of

SECTION_CLASSES = 8
_SPAN = re.compile(rb"[^.,;:!?|]+[.,;:!?|]*|[.,;:!?|]+")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: bytes) -> str:
    """The fingerprint of a UTF-8 text; the empty text has a root and no branch."""
    sections, paragraphs, digests = [], [], []

    def close():
        if paragraphs:
            d = _digest(b"".join(digests))
            sections.append((d, ";".join([d.hex()[:12], *paragraphs])))
            paragraphs.clear()
            digests.clear()

    for line in text.split(b"\n") if text else []:
        spans = [_digest(s) for s in _SPAN.findall(line)]
        d = _digest(b"p" + b"".join(spans))
        digests.append(d)
        paragraphs.append(",".join([d.hex()[:12], *(s.hex()[:8] for s in spans)]))
        if not line.strip() or d[0] % SECTION_CLASSES == 0:
            close()
    close()
    return "/".join([_digest(b"r" + b"".join(d for d, _ in sections)).hex(), *(s for _, s in sections)])


def _tree(fp: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    out = []
    for section in fp.split("/")[1:]:
        head, *paragraphs = section.split(";")
        out.append((head, [(p[0], p[1:]) for p in (x.split(",") for x in paragraphs)]))
    return out


def _left_over(a: list, b: list) -> tuple[list, list, list]:
    """What two lists of (digest, children) share, as multisets, and what each has besides."""
    have, common, mine = Counter(x[0] for x in b), [], []
    for x in a:
        if have[x[0]] > 0:
            have[x[0]] -= 1
            common.append(x)
        else:
            mine.append(x)
    seen, theirs = Counter(x[0] for x in common), []
    for x in b:
        if seen[x[0]] > 0:
            seen[x[0]] -= 1
        else:
            theirs.append(x)
    return common, mine, theirs


def likeness(a: str, b: str) -> float:
    """Share of spans (0 to 1) that two fingerprints have in common, from the tree.

    Equal roots give 1 at once; else equal sections and paragraphs count whole and only the
    spans of differing paragraphs are compared.  A blank paragraph counts as one span."""
    if a[:32] == b[:32]:
        return 1.0
    ta, tb = _tree(a), _tree(b)
    size = lambda paragraphs: sum(max(1, len(s)) for _, s in paragraphs)
    total = sum(size(p) for _, p in ta) + sum(size(p) for _, p in tb)
    same, mine, theirs = _left_over(ta, tb)
    shared = sum(size(p) for _, p in same)
    same, mine, theirs = _left_over([p for _, ps in mine for p in ps], [p for _, ps in theirs for p in ps])
    shared += size(same)
    ca, cb = (Counter(s for _, spans in x for s in spans) for x in (mine, theirs))
    shared += sum((ca & cb).values())
    return 2.0 * shared / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) positions of ``a`` whose content ``b`` lacks: where edits lie."""
    tb = _tree(b)
    sections = {h for h, _ in tb}
    paragraphs = {p for _, ps in tb for p, _ in ps}
    return [(i, j) for i, (h, ps) in enumerate(_tree(a)) if h not in sections
            for j, (p, _) in enumerate(ps) if p not in paragraphs]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
    half = len(text) // 2
    edited = (text[:len(text) - half] + following[:half]).encode()
    edited_fp = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), fp, edited_fp,
            likeness(fp, edited_fp), likeness(fp, next_fp))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text (last half of the code points
    replaced by the start of the next document, by falling doc_id; after the last, the first).

    Rows with equal doc_id follow one another by text; rows with a NULL doc_id come last.
    A NULL text is empty; a table of one row follows itself; an empty table gives none.

    "Next" needs a global order but no global sort: doc_id quantiles cut the table into as
    many ranges as there are shuffle partitions (a bounded list), each range gets a copy of
    the first document of the range after it, and one shuffle of the texts brings a range
    together; a task then reads its rows in order and holds two documents at a time."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), text_of().alias("text"))
    ids = slim.select("k")
    cuts = np.array(sorted(set(map(int, ids.approxQuantile("k", [i / n for i in range(1, n)], 0.5 / n)))), dtype=np.int64)

    def ranges(batches):
        for b in batches:
            part = np.searchsorted(cuts, b.column("k").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(part.astype(np.int32))], names=["k", "part"])

    heads = sorted(map_arrow(ids, ranges, "k long, part int").groupBy("part").agg(F.max("k").alias("k")).collect(),
                   key=lambda r: -r["part"])       # at most one row for each range
    before = {r["k"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    firsts = np.array(sorted(before), dtype=np.int64)

    def place(batches):
        for b in batches:
            k = b.column("k").to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, k).astype(np.int32)
            own = pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(np.zeros(len(k), np.int32))], schema=placed)
            yield own
            # the first document of each range also goes, as a ghost, to the range before it
            if len(at := np.flatnonzero(np.isin(k, firsts))):
                some = b.take(pa.array(at))
                to = np.array([before[int(x)] for x in k[at]], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to), pa.array(np.ones(len(at), np.int32))], schema=placed)

    placed = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("part", pa.int32()), ("ghost", pa.int32())])
    ordered = (map_arrow(slim, place, "doc_id long, k long, text string, part int, ghost int")
               .repartitionById(n, F.col("part"))
               .sortWithinPartitions(F.col("part"), F.col("ghost"), F.col("k").desc(), F.col("text"))
               .select("doc_id", "part", "ghost", "text"))

    def run(batches):
        held, out, width = None, [], 0

        def flush():
            nonlocal out, width
            cols = list(zip(*out)) if out else [[] for _ in SCHEMA]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)
            out, width = [], 0
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, part, ghost, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if ghost and (held is None or held[0] != part):
                        continue            # a second ghost, or a range of which nothing is left
                    fp = fingerprint(text.encode())
                    if held is not None:    # the next document of the one held is here
                        row = _row(held[1], held[2], held[3], text, fp)
                        out.append(row)
                        width += len(row[3]) + len(row[4])
                        if width > 8_000_000:
                            yield flush()
                    held = None if ghost else (part, doc_id, text, fp)
        yield flush()

    return map_arrow(ordered, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(read(spark, sf_dir, "documents"))
