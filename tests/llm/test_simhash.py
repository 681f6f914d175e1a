from __future__ import annotations

import random

import numpy as np
import xxhash

from palimpsest.llm import simhash
from palimpsest.llm.components import connected_components


def slow_fingerprint(text: str) -> int:
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fuzzy_keys_meet_within_two_bits():
    r = random.Random(0)
    w = np.array([r.getrandbits(23) for _ in range(400)])
    for flips in ((), (3,), (3, 17), (0, 22)):
        other = w.copy()
        for b in flips:
            other ^= 1 << b
        a, b = simhash.fuzzy_keys(w), simhash.fuzzy_keys(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))
    assert {int((x >= 0).sum()) for x in simhash.fuzzy_keys(w)} <= {1, 6}


def test_fingerprints(docs):
    for r in simhash.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.fp % (1 << 64) == slow_fingerprint(r.text)


def test_links_are_exact(spark):
    """Chains of near fingerprints, and a crowd that shares its keys."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(4):
            b ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(b)
    crowd = r.getrandbits(64)
    for _ in range(150):
        fps.add(crowd ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = slow_components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {x.node: x.root for x in connected_components(simhash.links(df)).collect()}
    got = {n: found.get(n, n) for n in signed}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[4].component_id == 2
    assert by[6].component_id == 5
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(docs, none):
    kept = simhash.keep_one(docs, shingle=5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1 and {2, 1, 9, 20, 31} <= set(ids) and 3 not in ids
    assert simhash.keep_one(none).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame([*chain, *star, (5, 5), (7, None)], "a long, b long")).collect()}
    assert len({found[i] for i in range(201)}) == 1 and len({found[1000 + i] for i in range(300)}) == 1 and found[0] != found[1000]
