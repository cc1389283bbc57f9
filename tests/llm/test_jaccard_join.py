"""The Jaccard join's components against all pairs, on fixtures and on the table."""

import random

import numpy as np
import pytest

from causeway.llm import jaccard_join as jj
from causeway.llm.components import connected_components


def brute(docs, threshold=90):
    """(doc_id, n_shingles, component_id) by comparing whole sets through an inverted index."""
    sets = []
    for _, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen, index = {}, {}
    for i, s in enumerate(sets):
        if not s:
            continue
        if s in seen:
            root[find(i)] = find(seen[s])
            continue
        seen[s] = i
        overlap = {}
        for g in s:
            for j in index.get(g, ()):
                overlap[j] = overlap.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, o in overlap.items():
            if 100 * o >= threshold * (len(s) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d is None, d or 0, len(sets[i]), (d if not sets[i] else least.get(find(i)))) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rnd, words, share):
    return [f"e{rnd.randint(0, 10**9)}" if rnd.random() < share else w for w in words]


def corpus(seed):
    rnd = random.Random(seed)
    docs, n = [], 0
    vocabulary = [f"w{i}" for i in range(400)]
    for family in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 11, 12, 13, 20, 40, 100, 250, 700]))]
        for _ in range(rnd.randint(1, 12)):
            words = edited(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            words = words[:len(words) - rnd.choice([0, 0, 1, 2, len(words) // 12])]
            docs.append((n, rnd.choice([" ", "\n", "  "]).join(words)))
            n += 1
    # one large family whose copies are on both sides of the threshold
    base = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(160):
        docs.append((n, " ".join(edited(rnd, base, rnd.random() * 0.04))))
        n += 1
    # a chain: each text drops the first words of the last and adds some
    long = [rnd.choice(vocabulary) for _ in range(400)]
    for k in range(25):
        docs.append((n, " ".join(long[k * 5:k * 5 + 150])))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "One"), (n + 5, "one two"), (n + 6, "a b c"), (n + 7, "A b\tc"),
             (None, "a b c"), (None, None), (3, docs[3][1]), (n + 8, docs[100][1].upper()), (n + 9, "x " * 4000), (n + 10, "x " * 3000)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("threshold", [34, 50, 60, 66, 90])
def test_a_set_links_within_two_classes(threshold):
    classes = jj.Classes(threshold)
    assert all(len(classes.of(n)) <= 2 for n in range(1, 3000))


@pytest.mark.parametrize("threshold", [50, 60])
def test_low_thresholds(spark, threshold):
    rnd = random.Random(threshold)
    docs = []
    for _ in range(40):      # a set and a larger one that holds it, on both sides of the threshold
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
        n = rnd.randint(4, 24)
        docs += [(len(docs), " ".join(words[:n + 2])), (len(docs) + 1, " ".join(words[:100 * n // threshold + 2 + rnd.choice([0, 0, 1])]))]
    docs += [(900, " ".join("abcdefghij")), (901, " ".join("abcdefghijklmno"))]      # 8 and 13 shingles
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(jj.link_components(df, threshold=threshold)) == brute(docs, threshold)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, sig string, n int").repartition(5)
    assert got(jj.link_components(df)) == brute(docs)
    assert got(jj.link_components(df, threshold=70)) == brute(docs, 70)


def test_empty(spark):
    assert jj.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(jj.op8_ngram_jaccard(spark, sf_dir)) == brute(docs)


def test_linked_sets_share_keys():
    rnd = np.random.default_rng(0)
    classes = jj.Classes(90)
    for _ in range(3000):
        s = int(rnd.integers(1, 400))
        base = np.unique(rnd.integers(0, 1 << 63, s + 60, dtype=np.uint64))
        a = base[:s]
        cut_off, added = int(rnd.integers(0, s // 9 + 2)), int(rnd.integers(0, s // 9 + 2))
        b = np.unique(np.concatenate([a[cut_off:], base[s:s + added]]))
        o = len(np.intersect1d(a, b))
        if not len(b) or 100 * o < 90 * (len(a) + len(b) - o) or o == len(a) == len(b):
            continue
        keys = []
        for h in (a, b):
            own = set()
            for c, d, d_own in classes.of(len(h)):
                k, empty = jj.fragment_keys(h, d + 1, c)
                own |= set(k[np.lexsort((k, empty))[:d_own + 1]].tolist())
            keys.append(own)
        assert keys[0] & keys[1]


def test_planes_show_differing_keys():
    rnd = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 200):
        a = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = a.copy()
        b[::3] = rnd.integers(0, 1 << 63, len(b[::3]), dtype=np.uint64) * np.uint64(2)
        top = np.uint64(64 - jj.PLANES)
        d = (jj.planes(a) ^ jj.planes(b)).view(np.uint64).reshape(-1, jj.PLANES)
        assert sum(int(np.bitwise_or.reduce(row)).bit_count() for row in d) == int(((a >> top) != (b >> top)).sum())


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in connected_components(df).collect()} == {(x, find(x)) for x in touched}
