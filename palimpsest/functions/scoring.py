"""Scores and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of lexical signals, of the rank fusion and of BM25's fields.
SUBJECT, COVERAGE, REPOSITORY, ANCHOR, WHOLE_CJK = 1.5, 2.0, 1.0, 3.0, 3.0
FUSION = 60
FIELD_WEIGHTS = {"subject": 10.0, "body": 3.0, "paths": 2.0}
K1, B = 1.2, 0.75


def lexical_score(subject: Column, coverage: Column, terms: Column, repository: Column, anchored: Column, cjk: Column) -> Column:
    return cjk * WHOLE_CJK + subject * SUBJECT + coverage / terms * COVERAGE + repository * REPOSITORY + F.when(anchored, ANCHOR).otherwise(0.0)


def relation_score(support: Column, proportion: Column, coverage: Column, seeds: Column, ubiquity: Column) -> Column:
    """Support and proportion, raised by how many seeds took part and lowered by how common the file is."""
    return support * proportion * (1 + 0.5 * coverage / seeds) / (1 + ubiquity)


def relation_confidence(support: Column, proportion: Column) -> Column:
    return F.when((support >= 4) & (proportion >= 0.3), "high").when((support >= 2) | (proportion >= 0.1), "medium").otherwise("low")


def reciprocal_rank(rank: Column) -> Column:
    return 1 / (FUSION + rank)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed in doubles and kept within -1 and 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def bm25_term(tf: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def regression_score(lexical: Column, hunk: Column, symbol: Column, tests: Column, temporal: Column) -> Column:
    return 14 * lexical + 8 * hunk.cast("int") + 12 * symbol.cast("int") + 4 * tests + 3 * temporal
