"""Stupid-backoff language-model scores, computed relationally.

With c the count of a word n-gram over all documents and N the number of words, a word
w after the context u scores

    S(w | u) = c(u w) / c(u)            if c(u w) reaches the cutoff,
               0.4 S(w | u shortened)   else,        and S(w) = c(w) / N.

N-grams are 64-bit hashes: of words, and of the pair of the hashes of context and suffix.
Relations hold them by blocks of documents, packed, since a row each would cost far more
to move than the n-gram itself:

- blocks (block, doc_ids, sizes, words): about ``PIECE`` bytes of text in hashed words;
- grams (bucket, block, keys, counts): the different n-grams of a block, exploded
  and cut by ranges of their hashes into buckets of some ``BUCKET`` n-grams of the corpus;
- found (block, bucket, totals): the counts of each bucket's n-grams over all blocks, as
  a table of the bucket, joined to the n-grams that were asked for.

Blocks joined with what was found for them give the scores, summed by document. An n-gram
that is frequent everywhere travels once for each block, so no bucket is larger for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_table, materialize, pieces, short_batches

ALPHA, CUTOFF = 0.4, 2
#: Bytes of text in a block, about; words of the corpus for each bucket of an order.
PIECE, BUCKET = 4 << 20, 1 << 21

# Primes of the XXH64 hash (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of eight bytes each."""
    h = _turn((seed + P5 + np.uint64(8)) ^ _turn(x * P2, 31) * P1, 27) * P1 + P4
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def joined(u: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The keys of n-grams by the hashes of context and suffix: Spark's ``xxhash64(u, s)``."""
    return _hash_long(s, _hash_long(u, np.full(len(u), 42, np.uint64)))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the words of all texts, one after the other, and the number of words of each text."""
    from xxhash import xxh64_intdigest

    runs = pc.ascii_split_whitespace(texts)
    coded = runs.flatten().dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxh64_intdigest(w, 42) for w in different), np.uint64, len(different))
    at = coded.indices.to_numpy(zero_copy_only=False)
    sizes = runs.value_lengths().to_numpy(zero_copy_only=False)
    # White space at an end of a text leaves an empty word.
    full = at != different.index(b"") if b"" in different else np.ones(len(at), dtype=bool)
    return hashes[at[full]], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))


def blocked(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """``(doc_ids, hashes of their words, sizes)`` of runs of rows ``(doc_id, text)`` with about ``most`` bytes of text, or one longer text."""
    ids, words, sizes, held = [], [], [], 0
    for batch in batches:
        texts = batch.column(1)
        bytes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = (held + np.cumsum(bytes_)) // most
        for rows in np.split(np.arange(len(bytes_)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            if len(rows) == 1 and bytes_[rows[0]] > most:
                h = np.concatenate([hashed(pa.array([p], pa.binary()).cast(pa.string()))[0] for p in pieces(texts[rows[0]].cast(pa.binary()).as_py(), most)])
                n = np.array([len(h)])
            else:
                h, n = hashed(texts.slice(rows[0], len(rows)))
            ids += batch.column(0).slice(rows[0], len(rows)).to_pylist()
            words.append(h)
            sizes.append(n)
            held += int(bytes_[rows].sum())
            if held >= most:
                yield ids, np.concatenate(words), np.concatenate(sizes)
                ids, words, sizes, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(words), np.concatenate(sizes)


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(keys, places)`` of the n-grams of each order that lie within texts: their hashes, and the place of their first word."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    keys, place = words, np.arange(len(words))
    yield keys, place
    for _ in range(1, order):
        # N-grams of one text follow each other; the last one of a text has no successor in it.
        inside = np.flatnonzero(text[place[1:]] == text[place[:-1]]) if len(place) else place
        keys, place = joined(keys[inside], keys[inside + 1]), place[inside]
        yield keys, place


def _pack(raw: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def blocks(docs: DataFrame, most: int = PIECE) -> DataFrame:
    """The relation ``block, doc_ids, sizes, vocabulary, codes``, written: words are codes into a sorted vocabulary of hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, (ids, words, sizes) in enumerate(blocked(batches, most)):
            vocabulary, codes = np.unique(words, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([_pack(vocabulary)], pa.binary()), pa.array([_pack(codes.astype(np.uint32))], pa.binary()),
                ],
                names=["block", "doc_ids", "sizes", "vocabulary", "codes"],
            )

    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    packed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(pack, "block long, doc_ids array<long>, sizes array<long>, vocabulary binary, codes binary")
    return materialize(packed, "blocks")


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words and sizes of a block."""
    return _unpack(row["vocabulary"], "<u8")[_unpack(row["codes"], "<u4")], np.array(row["sizes"], dtype=np.int64)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets are equal ranges of the upper half of the hash."""
    return np.concatenate([np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets, dtype=np.uint64)), [len(keys)]])


def counted(held: DataFrame, order: int, buckets: int) -> DataFrame:
    """The relation ``block, bucket, totals``: for the different n-grams of a block in a bucket, in order of their keys, the counts over all blocks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, (keys, _) in enumerate(grams(*_loaded(row), order)):
                    different, counts = np.unique(keys, return_counts=True)
                    ends = _bounds(different, buckets)
                    used = np.flatnonzero(np.diff(ends)).tolist()
                    parts = [(different[ends[b] : ends[b + 1]].tobytes(), counts[ends[b] : ends[b + 1]].astype("<u4").tobytes()) for b in used]
                    arrays = [pa.array([n * buckets + b for b in used], pa.int64()), pa.array([row["block"]] * len(used), pa.int64()), *[pa.array(x, pa.binary()) for x in zip(*parts, strict=True)]]
                    if used:
                        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "keys", "counts"])

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["counts"]])
        _, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, counts).astype("<i8")[at]
        sizes = pc.binary_length(table["keys"]).to_numpy() // 8
        ends = np.cumsum(sizes)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": pa.array([_pack(totals[b - n : b]) for n, b in zip(sizes, ends, strict=True)], pa.binary())})

    asked = held.select("block", "sizes", "vocabulary", "codes").mapInArrow(explode, "bucket long, block long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(count, "block long, bucket long, totals binary")


def scores(words: np.ndarray, sizes: np.ndarray, totals: list[np.ndarray], corpus: int, cutoff: int) -> np.ndarray:
    """ln S summed over the words of each text; ``totals``: by order, the counts of the different n-grams in order of their keys."""
    score, before = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
    for n, ((keys, place), total) in enumerate(zip(grams(words, sizes, len(totals)), totals, strict=True), 1):
        c = total[np.unique(keys, return_inverse=True)[1]]
        last = place + n - 1
        # ``before`` holds the counts of the next lower order by the place of the first word: those of the contexts.
        score[last] = np.log(c / corpus) if n == 1 else np.where(c >= cutoff, np.log(c / before[place]), math.log(ALPHA) + score[last])
        before[place] = c
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), score, minlength=len(sizes))


def score(docs: DataFrame, *, order: int = 2, cutoff: int = CUTOFF, block: int = PIECE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_words, log_score`` for every row of ``docs(doc_id, text, ...)``.

    Words are lower-cased and lie between ASCII white space. ``log_score`` is the mean
    of ln S over the words of a text, null if it has none; null texts have none. Counts
    are over all rows, repeated ones included; equal texts score alike. ``cutoff`` is for
    orders above one. Other columns play no part; no rows give no rows.
    """
    short_batches(docs.sparkSession)
    held = blocks(docs, block)
    corpus = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-corpus // bucket))
    found = materialize(counted(held, order, buckets), "found")
    lists = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("found"))
    whole = held.join(lists, "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, sizes = _loaded(row)
                parts: list[list[np.ndarray]] = [[np.empty(0, "<i8")] for _ in range(order)]
                for x in sorted(row["found"] or (), key=lambda x: x["bucket"]):
                    parts[x["bucket"] // buckets].append(_unpack(x["totals"], "<i8"))
                sums = scores(words, sizes, [np.concatenate(x) for x in parts], corpus, cutoff)
                mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), mean], names=["doc_id", "n_words", "log_score"])

    out = materialize(whole.mapInArrow(finish, "doc_id long, n_words long, log_score double"), "scores")
    drop_table(held)
    drop_table(found)
    return out
