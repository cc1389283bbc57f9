"""Licence scan, fingerprints and sharding against brute force on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from causeway.llm import fingerprints as fp
from causeway.llm import licenses as lic
from causeway.llm import sharding as sh

KIND = "doc_id long, text string, source string, labels string, part int, shard int"
LONG = "Released under the MIT License. " * 3000


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "clash", 7, 3) for i, t in zip(ids, texts)], KIND).repartition(3)


TEXTS = [None, "", "Under the MIT license", "under, THE mit-License! and CC BY-NC 4.0; cc by nc", "Apache License, Version 2.0",
         "apache license version 20", "lapache license version 2", "GNU General Public License, version 3", LONG,
         "cc by nc\x00cc by nc", "é under the mit licensé", "same", "same"]


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in lic.BASE_PHRASES.items() for q in [p.split()]
          for i in range(len(words) - len(q) + 1) if words[i:i + len(q)] == q]
    return (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


def test_license_scan_matches_brute_force(spark):
    rows = lic.scan_licenses(frame(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(TEXTS[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def alternatives(parsed):
    """Shortest texts of every branch, option and character of a parsed expression."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            part = [chr(arg)]
        elif op == "ANY":
            part = ["x"]
        elif op == "IN":
            part = [chr(a) if str(k) == "LITERAL" else "7" for k, a in arg]
            assert all(str(k) == "LITERAL" or str(a) == "CATEGORY_DIGIT" for k, a in arg)
        elif op == "BRANCH":
            part = [x for branch in arg[1] for x in alternatives(branch)]
        elif op == "SUBPATTERN":
            part = alternatives(arg[3])
        else:
            assert op == "MAX_REPEAT"
            low, high, inner = arg
            part = [x * n for x in alternatives(inner) for n in ({0, 1} if (low, high) == (0, 1) else {low})]
        out = [a + b for a in out for b in part]
    return out


def test_every_license_rule_fires_alone():
    s = lic.Scanner()
    for k, (label, _, keyword, expression) in enumerate(lic.rules()):
        for text in alternatives(re._parser.parse(expression)):
            words = text.split()
            text = " ".join(words)
            assert re.fullmatch(expression, text) and keyword in text, (label, keyword, text)
            assert (k, 0, len(words)) in s.detections(lic.word_list(text.encode())), (label, keyword, text)


@pytest.mark.parametrize("text, label", [
    ("This product includes software developed by the Apache Software Foundation", "apache-1.1"),
    ("This product includes cryptographic software written by Eric Young", "ssleay"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights", "cc0-1"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"),
    ("Redistributions and use in source and binary forms, with or without modification, are permitted", "bsd-2-clause"),
    ("PSF license", "python-2")])
def test_license_alternatives_without_the_name(text, label):
    assert lic.Scanner().scan(text.encode())["labels"] == label


def test_license_rules_priority_and_suppression():
    s = lic.Scanner()
    assert len(s.rules) >= 200
    assert s.scan(b"GNU General Public License, version 3")["labels"] == "gpl-3"       # the plain gpl lies inside
    assert s.scan(b"gnu general public license")["labels"] == "gpl"
    assert s.scan(b"Licensed under the Apache License, Version 2.0")["labels"] == "apache-2"
    assert s.scan(b"cc by-nc-sa 4.0")["labels"] == "cc-by-nc,cc-by-nc-sa"                # the base label stays
    assert s.scan(b"SPDX-License-Identifier: GPL-2.0-only")["labels"] == "gpl-2"
    assert s.scan("Tous droits réservés".encode())["labels"] == "all-rights-reserved"
    assert s.scan(b"the permit license of a smith")["labels"] == ""
    # containment against a brute-force pass
    rng = np.random.default_rng(5)
    for _ in range(200):
        found = [(int(k) + 3, int(a), int(n)) for k, a, n in zip(rng.integers(0, 9, 12), rng.integers(0, 20, 12), rng.integers(1, 8, 12))]
        kept = []
        for d in sorted(found, key=lambda d: (d[0], d[1])):
            if not any(k[1] <= d[1] and d[1] + d[2] <= k[1] + k[2] for k in kept):
                kept.append(d)
        assert s.keep(found) == kept


def test_license_scan_empty(spark):
    assert lic.scan_licenses(frame(spark, ["x"]).limit(0)).count() == 0


def brute_edit(texts, ids):
    order = sorted(range(len(ids)), key=lambda i: (-(ids[i] if ids[i] is not None else -(1 << 63)), texts[i] or ""))
    out = []
    for at, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        h = len(a) // 2
        out.append((ids[i], a, a[:len(a) - h] + b[:h], b))
    return out


@pytest.mark.parametrize("ids", [None, [7] * 13, [5, None, None, 3, -4, 9, 9, 12, 100, 10**15, -10**15, 0, 1]])
def test_fingerprints_match_brute_force(spark, ids):
    ids = ids if ids is not None else list(range(len(TEXTS)))
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                   r.near_edited, r.near_next) for r in fp.fingerprint_with_edits(frame(spark, TEXTS, ids)).collect())
    want = sorted((i is None, i or 0, len(a), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(a.encode()),
                   fp.fingerprint(e.encode()), fp.likeness(fp.fingerprint(a.encode()), fp.fingerprint(e.encode())),
                   fp.likeness(fp.fingerprint(a.encode()), fp.fingerprint(b.encode())))
                  for i, a, e, b in brute_edit(TEXTS, ids))
    assert rows == want


def test_fingerprint_tree():
    a = "\n".join(f"line {i}, with more; words here. And {i * 7} ends" for i in range(60))
    b = a.replace("line 31,", "line thirty-one,")
    fa, fb = fp.fingerprint(a.encode()), fp.fingerprint(b.encode())
    assert fa[:32] != fb[:32] and 0.97 < fp.likeness(fa, fb) < 1 and fp.likeness(fa, fa) == 1
    assert fp.likeness(fa, fb) == fp.likeness(fb, fa)
    changed = fp.edits(fa, fb)
    paragraphs = [(i, j) for i, (_, ps) in enumerate(fp._tree(fa)) for j in range(len(ps))]
    assert len(changed) == 1 and paragraphs.index(changed[0]) == 31
    assert fp.fingerprint(b"") == fp.fingerprint(b"") and fp.likeness(fp.fingerprint(b""), fa) == 0
    assert fp.fingerprint(b"a\n\nb")[:32] != fp.fingerprint(b"a\nb")[:32]
    assert fp.fingerprint(b"a b")[:32] != fp.fingerprint(b"a  b")[:32]


def test_fingerprints_empty(spark):
    assert fp.fingerprint_with_edits(frame(spark, ["x"]).limit(0)).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_its_definition():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 2, 40, 41):
        assert sh.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_sharding(spark):
    texts = TEXTS + [f"t{i}" for i in range(3000)]
    ids = [None, None] + list(range(2, 12)) + [11] + list(range(12, 3012))
    rows = sh.shard_by_key(frame(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 0.4 * len(rows) / 41 < moved < 1.8 * len(rows) / 41
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert len({(r.shard, r.grown_shard) for r in rows if r.doc_id is None}) == 1
    assert sh.shard_by_key(frame(spark, ["x"]).limit(0)).count() == 0
