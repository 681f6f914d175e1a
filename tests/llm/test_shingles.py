"""The pipeline's near-duplicate stage against brute force, with a crowd of near-copies and a common passage."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline

from palimpsest.llm import prefixes, shingles, simhash


def grams(text, k=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def slow_keep(rows, similar=0.8):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= similar * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def made():
    r = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    passage, base, rows = prose(60), prose(150), []
    for _ in range(15):  # pairs about the threshold, far beyond two bits of a SimHash
        x = prose(120)
        rows.append(x)
        for edits in (1, 2, 3, 4):
            y = list(x)
            for at in r.sample(range(120), edits):
                y[at] = "edit" + str(r.random())
            rows.append(y)
    for _ in range(80):  # a crowd whose members are not all similar to any one of them
        y = list(base)
        for at in r.sample(range(150), r.choice((1, 2, 3, 4))):
            y[at] = "edit" + str(r.random())
        rows.append(y)
    rows += [passage + prose(12) for _ in range(30)] + [prose(40) + passage + prose(40) for _ in range(30)] + [[], ["one"], ["ONE"]]
    r.shuffle(rows)
    return [(k, " ".join(x)) for k, x in enumerate(rows)]


def test_stage_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "ROUNDS", 1)  # the rest goes through small salted blocks
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(x.doc_id for x in got.collect()) == slow_keep(rows)


def test_stage_edges(docs, none):
    rows = shingles.keep_one(docs).collect()
    assert [r.doc_id for r in rows].count(6) == 0 and len(rows) < docs.count()
    assert shingles.keep_one(none).count() == 0 and shingles.keep_one(docs).schema == docs.schema


def test_wide_simhash_by_plain_code():
    """Each bit is the majority of that bit in the hashes, which are mixed anew for each word but the first; similar sets stay within the bound."""
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 200, 301):
        hashes = r.integers(0, 1 << 64, n, dtype=np.uint64)
        words = []
        for k, factor in enumerate(simhash.FACTORS.tolist()):
            mixed = [int(h) if k == 0 else (lambda x: (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64)(int(h) * factor % 2**64) for h in hashes]
            mixed = mixed if k == 0 else [x ^ x >> 32 for x in mixed]
            words.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > n))
        assert [w % 2**64 for w in simhash.wide(hashes).tolist()] == words == [w % 2**64 for w in simhash.wide(hashes, step=50).tolist()]
    differ = lambda a, b: int(np.bitwise_count((simhash.wide(a) ^ simhash.wide(b)).view(np.uint64)).sum())
    for common, own in ((8, 1), (4, 0), (40, 5), (160, 20), (800, 100)):
        for _ in range(30):
            x = r.integers(0, 1 << 64, common + 2 * own + 1, dtype=np.uint64)
            a, b = (x[: common + own], x[own : common + 2 * own]) if own else (x[:4], x[:5])
            assert differ(a, b) <= shingles.most_different(0.8, few=len(a) < shingles.FEW)
    assert differ(x[:200], x[150:350]) > shingles.most_different(0.8)


def test_stage_is_by_simhash(spark, monkeypatch):
    """Near-copies within two bits of a SimHash are linked by it alone; no pair is compared whose SimHashes are far apart."""
    r = random.Random(9)
    prose = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    base, long = [prose(40) for _ in range(6)], prose(3000)
    rows = [(k, t) for k, t in enumerate([*base, long, long + " end", base[0].upper()])]
    given = {}

    def none(prefix, verified, similar, sketches, known):
        given.update(words=len(sketches.columns) - 2, first={x.id: x.s0 for x in sketches.collect()})
        return known

    monkeypatch.setattr(prefixes, "links", none)
    kept = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similar=0.8, seed=42)
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert given["words"] == simhash.WIDE
    fps = {simhash.fingerprint(t.encode(), 5, 42) for t in [*base, long, long + " end"]}
    assert {x % 2**64 for x in given["first"].values()} == fps


def test_blocks_are_for_loners(spark, monkeypatch):
    """Members of a key's largest component are not paired among themselves: a key with few others has one block, whatever its size; all pairs are met once."""
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    rows = [(7, k, 1, 1, 0) for k in range(400)] + [(7, 1000 + k, 1, 1, 1000 + k) for k in range(20)] + [(8, k, 1, 1, 0) for k in range(300)] + [(8, 2000, 1, 1, 2000)]
    members = spark.createDataFrame(rows, "key long, id long, at int, n int, root long")
    mains = {r.key: (r.main, r.members, r.loners) for r in prefixes._mains(members).collect()}
    assert mains == {7: (0, 420, 20), 8: (0, 301, 1)}
    found = sorted((r.a, r.b) for r in prefixes._rest(members, 0.8).collect())
    root = {(k, i): r for k, i, _, _, r in rows}
    ids = {k: [i for x, i in root if x == k] for k in (7, 8)}
    assert found == sorted({(a, b) for k in ids for a in ids[k] for b in ids[k] if a < b and root[k, a] != root[k, b]})


def test_order_follows_the_input(spark, monkeypatch):
    """A passage that a fixed share of more texts than the sample holds is still known as frequent."""
    monkeypatch.setattr(shingles, "SAMPLE", 10)
    texts = spark.createDataFrame([(f"a b c d e f{k}" if k % 10 == 0 else f"{k} {k + 1} {k + 2} {k + 3} {k + 4}",) for k in range(600)], "text string")
    known, counts = shingles._common(texts, 5, 42)
    assert shingles.shingle_set(b"a b c d e", 5, 42)[0] in known and (counts >= shingles.OFTEN).all()
