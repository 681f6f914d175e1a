"""Quality scores by Bradley-Terry ranking of documents.

The model is a weight for each surface feature of a text. It is learnt from
preference pairs (a document labelled good against one labelled bad) by Newton
steps on the logistic loss of the feature differences, so that only the order of
scores matters to it. A cutoff is then chosen among the score quantiles of the
labelled sample, and scores are mapped to 0..1 so that the cutoff falls on the
threshold. Learning reads a bounded sample of labelled rows; scoring reads all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import short_batches

#: Labelled rows that learning reads at most (taken by hash), and preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 100_000
SYMBOLS = np.array([c in b"#*$%&|<>" for c in range(256)])
NAMES = ("symbols", "pipes", "bangs", "capitals", "digits", "marks", "same word", "same three words", "same line", "one-letter words", "word length", "length", "blank")


def features(text: bytes) -> list[float]:
    """Surface features of a whole UTF-8 text, each of the order of one."""
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum() + count[192:].sum())
    digits = int(count[48:58].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    soft = math.sqrt
    return [
        soft(int(count[SYMBOLS].sum()) / n), soft(int(count[124]) / n), soft(int(count[33]) / n), soft(upper / max(1, upper + lower)),
        soft(digits / len(text)), soft(marks / n), soft(sum(map(eq, found, found[1:])) / n),
        soft(1 - len(set(zip(found, found[1:], found[2:]))) / triples) if n > 2 else 0.0,  # noqa: B905
        soft(1 - len(set(lines)) / len(lines)), soft(sum(len(w) == 1 for w in found) / n),
        math.log(len(text) / n), math.log(n) / 4, 0.0,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoff: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cutoff + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, *, threshold: float, pairs: int = PAIRS, ridge: float = 1e-2, seed: int = 7) -> Model:
    """Bradley-Terry weights from rows ``x`` and their labels; without rows of both kinds all scores are equal and pass."""
    d = len(NAMES)
    if not good.any() or good.all():
        return Model(np.zeros(d), np.ones(d), np.zeros(d), -1.0, threshold)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    diff = z[draw.choice(np.flatnonzero(good), pairs)] - z[draw.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # the probability that the model prefers the bad one
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d), diff.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # Quantiles of the sample's scores: the cutoff with the least labels on the wrong side, the middle one among equals.
    order = np.sort(raw)
    cuts = np.unique(np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2]))
    bad_kept = (~good).sum() - np.searchsorted(np.sort(raw[~good]), cuts)
    good_lost = np.searchsorted(np.sort(raw[good]), cuts)
    wrong = bad_kept + good_lost
    best = np.flatnonzero(wrong == wrong.min())
    return Model(mean, scale, w, float(cuts[best[len(best) // 2]]), threshold)


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0, ``sample`` of them at most.

    Rows without doc_id or quality are left out; every label row counts, repeated
    ones as often as they occur. A labelled document without a text counts as blank.
    """
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    train = train.where(~_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "quality", "h"])

    short_batches(docs.sparkSession)
    # ``train`` has ``sample`` rows at most, and so has the result unless doc_ids repeat. Texts become features where they lie.
    joined = texts.join(F.broadcast(train), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))
    rows = joined.mapInArrow(scan, "x array<double>, quality int, h long").orderBy("h", "quality").limit(sample).collect()
    x = np.array([r.x for r in rows]).reshape(-1, len(NAMES))
    return fit(x, np.array([r.quality == 1 for r in rows], dtype=bool), threshold=threshold)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``score`` of each row of ``docs(text, ...)`` before its columns, as a struct ``row``; null and empty texts are scored as blank ones."""
    short_batches(docs.sparkSession)
    # The text crosses to Python once, within the row.
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.binary())
            x = np.array([features(t.as_py() or b"") for t in texts]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.score(x)), batch.column(0)], names=["score", "row"])

    return rows.mapInArrow(scan, T.StructType([T.StructField("score", T.DoubleType()), *rows.schema.fields]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a null doc_id is not held out."""
    model = learn(docs, labels, threshold=threshold)
    scored = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    held = F.coalesce(_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    kept = score(docs, learn(docs, labels, threshold=threshold)).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"row.`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema.fields])
