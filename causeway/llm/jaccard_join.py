"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of all shingles (their 64-bit hash order) is cut into fragments; each
set is a row of fragment parts.  Two sets within the threshold differ in few shingles, so
most of their fragments are equal: equal fragments find the candidate pairs, and for each
pair the overlaps are counted fragment by fragment and summed.

Let a link need 100 * intersection >= T * union (T = 90).  Two linked sets of s <= t
shingles differ in at most (s + t)(100 - T) / (100 + T) of them.  Sizes fall into classes;
a class has one bound D on that difference and one number of fragments.

1. Sets that are equal are one node.  With D + 1 fragments, linked nodes share a fragment,
   so a node none of whose fragments occurs in another node has no link (``suspects``).
2. Suspects are cut finer, into 4 D fragments.  Linked nodes share all but D of them, so
   among the D + 1 rarest fragments of each there is a common one (prefix filter).  An
   edited copy has its own fragments wherever it was edited: they occur once, fill the
   prefix, and show which pairs differ in too many places without looking at either set.
3. In each prefix group the node with the fewest fragments of its own is the pivot; pairs
   with the pivot are counted.  What that leaves in different components is paired
   besides, so no link is lost while a group of copies never becomes all its pairs.  Those
   pairs are looked for block by block of a group, whatever its size, and only those that
   the planes do not rule out leave the join.

What travels is kept narrow: keys of one node alone are held back by a bit filter before
they are shuffled a second time, prefix rows carry no planes, and members are shipped for
nodes that are in a pair.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import cut, map_arrow, map_rows, process_store, read, text_of
from causeway.llm.components import connected_components

SHINGLE = 3
THRESHOLD = 90
#: Fragments of the global order in which partial overlaps are counted.
PARTS = 8
#: Bits kept of each fine key in a node's planes, by which two nodes' fragments are compared.
PLANES = 6
#: Bits of the filters that keep most rows without a partner out of a second shuffle: 16 for
#: each key, within these bounds (128 KB to 16 MB).  Beyond 8 million keys a filter lets more
#: rows through, which the exact join behind it drops.
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 27
#: Members of a prefix group that are compared in one block.
BLOCK = 512

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: bytes, hashes: dict, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (one of all words if they are fewer)."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < width:
        total = np.array([len(h)], dtype=np.uint64)
        for x in h:
            total = mix(total * _GOLD + x)
        return total
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * _GOLD + h[k:len(h) - width + 1 + k])
    return np.unique(total)


def difference(s: int, t: int, threshold: int) -> int:
    """Most shingles in which linked sets of ``s`` and ``t`` shingles differ."""
    return (s + t) * (100 - threshold) // (100 + threshold)


class Classes:
    """Size classes: class c holds sizes from ``bounds[c]`` up to the next bound.

    A class is at least 100 / threshold wide, so a set links within its own and the next."""

    def __init__(self, threshold: int, ratio: float = 1.5):
        self.threshold, self.ratio, self.bounds = threshold, ratio, [1]

    def _upto(self, size: int) -> None:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio), 100 * self.bounds[-1] // self.threshold))

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(class, D of the class, D of this size) for each class in which the size can link:
        its own, and the next where a linked set can be that large."""
        most = 100 * size // self.threshold
        self._upto(2 * most + 2)
        own = int(np.searchsorted(self.bounds, size, side="right")) - 1
        out = []
        for c in range(own, int(np.searchsorted(self.bounds, most, side="right"))):
            d = difference(self.bounds[c + 1] - 1, self.bounds[c + 1] - 1, self.threshold)
            out.append((c, d, min(d, difference(size, most, self.threshold))))
        return [x for x in out if x[2] > 0]


def fragment_keys(h: np.ndarray, fragments: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for the content of each fragment of a sorted set, and which fragments are empty."""
    of = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    bounds = np.searchsorted(of, np.arange(fragments + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _GOLD), dtype=np.uint64)])
    place = np.arange(fragments, dtype=np.uint64) + np.uint64(salt << 32)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + mix(place * _GOLD)), bounds[1:] == bounds[:-1]


def planes(keys: np.ndarray) -> np.ndarray:
    """PLANES bits of each key, as bit planes: for 64 keys, PLANES longs one after another."""
    padded = np.zeros(-(-len(keys) // 64) * 64, np.uint64)
    padded[:len(keys)] = keys >> np.uint64(64 - PLANES)
    bits = (padded[:, None] >> np.arange(PLANES, dtype=np.uint64)) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8).reshape(-1, 64, PLANES).transpose(0, 2, 1), axis=2, bitorder="little")
    return packed.reshape(-1).view(np.int64)


def _signature(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _hashes() -> WordHashes:
    store = process_store("word hashes")
    return store.setdefault("words", WordHashes())


def coarse_keys(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """(doc_id, n, sig, keys): a key list of which linked nodes share at least one."""
    def start():
        hashes, classes = _hashes(), Classes(threshold)

        def work(cols):
            sets = [shingles(t, hashes, width) for t in cols["text"]]
            keys = []
            for h in sets:
                own = []
                for c, d, d_own in classes.of(len(h)):
                    k, empty = fragment_keys(h, d + 1, c)
                    own.append(k[np.lexsort((k, empty))[:d_own + 1]])
                keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
            return {"doc_id": cols["doc_id"], "n": [len(h) for h in sets], "sig": [_signature(h) for h in sets], "keys": keys}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return map_rows(slim, start, "doc_id long, n long, sig long, keys array<long>", caches="word hashes")


def fine_sets(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """(sig, n, members, and for up to two classes: class, own D, fine keys, their planes)."""
    def start():
        hashes, classes = _hashes(), Classes(threshold)

        def work(cols):
            sets = [shingles(t, hashes, width) for t in cols["text"]]
            out = {"sig": [_signature(h) for h in sets], "n": [len(h) for h in sets], "members": [h.view(np.int64) for h in sets]}
            for k in (0, 1):
                at = [(*classes.of(len(h)), (-1, 0, 0), (-1, 0, 0))[k] for h in sets]
                out[f"c{k}"] = [c for c, _, _ in at]
                out[f"d{k}"] = [d for _, _, d in at]
                keys = [fragment_keys(h, 4 * d, c + (1 << 16))[0] for h, (c, d, _) in zip(sets, at)]
                out[f"k{k}"] = [x.view(np.int64) for x in keys]
                out[f"p{k}"] = [planes(x) for x in keys]
            return out
        return work

    slim = docs.select(text_of().cast("binary").alias("text"))
    return map_rows(slim, start, "sig long, n long, members array<long>, c0 int, d0 int, k0 array<long>, p0 array<long>, "
                                 "c1 int, d1 int, k1 array<long>, p1 array<long>", caches="word hashes")


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit table over the low bits of ``keys`` (key, uniform longs), as bytes.

    Only the words with a bit set come to the driver, at most FILTER_MOST / 64."""
    keys = cut(keys)
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint8)


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _keep_maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose doc_id is in ``ids`` (doc_id), and a few others
    that the join behind drops.  It saves shuffling most texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(ids.select(F.xxhash64("doc_id").alias("key"))))

    def run(batches):
        for b in batches:
            hit = _held(shared.value, b.column("hash").to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(hit)).select(["doc_id", "text"])

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_of().alias("text"))
    return map_arrow(slim.withColumn("hash", F.xxhash64("doc_id")), run, "doc_id long, text string")


def _exploded_maybe(rows: DataFrame, names: str, keys: str, table: np.ndarray) -> DataFrame:
    """``names`` (longs) of ``rows`` with each element of the array ``keys`` that the filter holds."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    columns = names.split()

    def run(batches):
        for b in batches:
            lists = b.column(len(columns))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(_held(shared.value, flat)) if len(flat) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))[hit]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(of)) for i in range(len(columns))), pa.array(flat[hit])],
                                             names=[*columns, "key"])

    return map_arrow(rows.select(*[F.col(c).cast("long").alias(c) for c in columns], keys), run,
                     ", ".join(f"{c} long" for c in columns) + ", key long")


def count_links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: partial overlaps by fragment, summed per pair."""
    def parts(side):
        needed = sets.join(pairs.select(F.col(side).alias("sig")).distinct(), "sig", "left_semi")
        part = needed.select("sig", "n", "members", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        shift = 64 - PARTS.bit_length() + 1
        return part.select(F.col("sig").alias(side), F.col("n").alias(f"n{side}"), "part",
                           F.filter("members", lambda x: F.shiftrightunsigned(x, shift) == F.col("part")).alias(f"m{side}"))

    both = pairs.join(parts("b"), "b").join(parts("a"), ["a", "part"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return total.where(100 * F.col("overlap") >= threshold * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(node, class, n, own, planes, prefix): the rarest D + 1 fine keys that others share.

    ``own`` counts the fragments that no other node has; they are rarer than any other."""
    sides = [sets.select("sig", "n", F.col(f"c{k}").alias("class"), F.col(f"d{k}").alias("d"), F.col(f"k{k}").alias("keys"),
                         F.col(f"p{k}").alias("planes")) for k in (0, 1)]
    sides = sides[0].unionByName(sides[1]).where("class >= 0")
    df = cut(sides.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    held = _exploded_maybe(sides, "sig class", "keys", _filter(df.select("key"))).join(df, "key")
    # the list holds one node's fragments: their number follows its own size
    held = held.groupBy("sig", "class").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))
    node = held.join(sides.withColumn("size", F.size("keys")).drop("keys"), ["sig", "class"]).withColumn("own", F.col("size") - F.size("held"))
    room = F.greatest(F.col("d") + 1 - F.col("own"), F.lit(0))
    return node.select(F.col("sig").alias("node"), "class", "n", "own", "planes",
                       F.transform(F.slice("held", F.lit(1), room), lambda x: x["key"]).alias("prefix"))


def _possible(threshold: int):
    """Whether a pair (x, y) can link, by its sizes and by the fragments seen to differ.

    Each differing fragment holds a differing shingle; planes show all but 1 in 2^PLANES."""
    bound = F.floor((F.col("x.n") + F.col("y.n")) * (100 - threshold) / (100 + threshold))
    unlike = F.zip_with("x.planes", "y.planes", lambda p, q: p.bitwiseXOR(q))

    def any_of(d, at):
        out = F.element_at(d, at * PLANES + 1)
        for k in range(1, PLANES):
            out = out.bitwiseOR(F.element_at(d, at * PLANES + k + 1))
        return F.bit_count(out)

    apart = F.element_at(F.transform(F.array(unlike), lambda d: F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(d) / PLANES).cast("int") - 1), F.lit(0), lambda s, at: s + any_of(d, at))), 1)
    return (100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")) & (apart <= bound)


def link_components(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    A NULL text, an empty one and one without words have no shingle and link with nothing
    (their component is themselves).  Rows with equal sets link, so repeated rows and
    copies share a component; its id is the least doc_id in it (NULL only if all are).
    An empty table gives an empty one.  Other columns are not read.

    The texts are read twice: once for the coarse keys, once for the sets of suspects."""
    rows = cut(coarse_keys(docs, threshold, width))
    spread = rows.select("sig", F.explode("keys").alias("key")).groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    shared = cut(spread.where("lo < hi").select("key"))
    suspects = cut(_exploded_maybe(rows, "sig", "keys", _filter(shared)).distinct().join(shared, "key", "left_semi").select("sig").distinct())
    # one document of each suspect node stands for it
    speakers = rows.groupBy("sig").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id")).join(suspects, "sig", "left_semi")
    sets = cut(fine_sets(_keep_maybe(docs, speakers), threshold, width).join(suspects, "sig", "left_semi").dropDuplicates(["sig"]))
    prefixes = cut(_prefixes(sets))
    facts = prefixes.select("node", "class", "n", "planes")
    narrow = prefixes.select(F.explode("prefix").alias("key"), "node", "class", "own")
    many = narrow.groupBy("key").agg(F.min(F.struct("own", "node")).alias("p"), F.count("*").alias("many")).where("many > 1")
    many = cut(many.select("key", F.col("p.node").alias("pivot"), "many"))
    star = cut(narrow.join(many, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "class").distinct())
    star = star.join(facts.withColumnsRenamed({"node": "a", "n": "na", "planes": "pa"}), ["a", "class"])
    star = star.join(facts.withColumnsRenamed({"node": "b", "n": "nb", "planes": "pb"}), ["b", "class"])
    x, y = F.struct(F.col("na").alias("n"), F.col("pa").alias("planes")), F.struct(F.col("nb").alias("n"), F.col("pb").alias("planes"))
    star = cut(star.select("a", "b", x.alias("x"), y.alias("y")).where(_possible(threshold)).select("a", "b").distinct())
    links = cut(count_links(star, sets, threshold))
    found = cut(connected_components(links))

    # members outside the component of their group's pivot, against the group's other members;
    # in a group of two that pair has been counted
    def placed(frame, name, to):
        named = found.select(F.col("node").alias(name), F.col("component").alias(to))
        return frame.join(named, name, "left").withColumn(to, F.coalesce(to, name))
    larger = placed(many.where("many > 2"), "pivot", "centre")
    members = placed(narrow.drop("own").join(larger, "key"), "node", "component").where("node <> pivot")
    members = cut(members.select("key", "many", "node", "class", "component", (F.col("component") != F.col("centre")).alias("out")))
    mixed = members.where("out").select("key").distinct()
    wide = members.join(mixed, "key", "left_semi").join(facts, ["node", "class"])
    # a group is cut into blocks, and every block of outsiders meets every block of the group
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    wide = wide.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = ("key", "block", "other", "node", "component", "n", "planes")
    outsiders = wide.where("out").select(*side).alias("x")
    everyone = wide.select("key", F.col("block").alias("other"), F.col("other").alias("block"), *side[3:]).alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "block", "other")])
    rest = (outsiders.join(everyone, same).where((F.col("x.component") != F.col("y.component")) & _possible(threshold))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    more = cut(count_links(cut(rest), sets, threshold))
    nodes = connected_components(links.unionByName(more)).select(F.col("node").alias("sig"), F.col("component"))

    least = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = least.join(nodes, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_sig = named.join(ids, "component").select("sig", "component_id")
    some = rows.where("n > 0").join(by_sig, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents"))
