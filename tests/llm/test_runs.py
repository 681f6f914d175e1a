from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries, runs


def every_run(words, least=24, times=3):
    """All runs by comparing all words at all lags."""
    found = {}
    for q in range(1, len(words) // times + 1):
        k = 0
        while k + q < len(words):
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            length = k - start + q
            if k > start and length >= max(least, times * q):
                found.setdefault((start, length), q)
            k += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def looping(r, n):
    """Words of a small vocabulary with repeats of many periods in them, overlapping and nested."""
    w = [r.choice("abcdefgh") for _ in range(n)]
    for _ in range(r.randrange(5)):
        p, at = r.randrange(1, 12), r.randrange(n)
        for k in range(at + p, min(n, at + p * r.randrange(2, 30))):
            w[k] = w[k - p]
    return w


@pytest.mark.parametrize("seed", range(40))
def test_equals_comparing_all_words(seed):
    r = random.Random(seed)
    w = looping(r, r.randrange(20, 600))
    codes = np.unique(w, return_inverse=True)[1]
    assert runs.periodic_runs(codes) == every_run(w)
    assert runs.periodic_runs(codes, least=6, times=4) == every_run(w, 6, 4)


def test_frequent_and_rare_words_are_counted_alike(monkeypatch):
    codes = np.random.default_rng(1).zipf(1.3, 5000) % 300
    want = [0, *(int((codes[:-q] == codes[q:]).sum()) for q in range(1, 1700))]
    assert runs.lag_matches(codes, 1699).tolist() == want
    monkeypatch.setattr(runs, "PAIRS", 100)
    assert runs.lag_matches(codes, 1699).tolist() == want
    assert runs.lag_matches(np.zeros(900, int), 300).tolist() == [0, *range(899, 599, -1)]


def test_long_texts_take_seconds():
    """A million equal words, a million words that repeat after a third, a million without repeats."""
    rng, began = np.random.default_rng(2), time.process_time()
    assert runs.periodic_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    part = rng.integers(0, 50_000, 333_333)
    assert runs.periodic_runs(np.concatenate([part, part, part, [60_000]])) == [(0, 999_999, 333_333)]
    assert runs.periodic_runs(rng.zipf(1.2, 1_000_000) % 50_000) == []
    assert time.process_time() - began < 120


def expected(doc_id, text):
    """The columns of op13 by plain code."""
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = every_run(w)
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_on_its_tables(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, " ".join(looping(r, r.randrange(1, 200)))) for k in range(300)]
    rows += [(None, "a " * 30), (None, None), (7, None), (10, ""), (34, " \t\n"), (300, "x"), (12, "ß é " * 40), (12, "ß é " * 40), (301, "y z\u000b\u000c" * 4000)]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("w", F.lit("x"))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(*x) for x in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(x[1] > 0 for x in want) > 50
    out = runs.collapse(made.limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "w", "runs", "strongest"]
