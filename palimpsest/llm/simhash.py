"""SimHash near-duplicates found through Golay-code fuzzy keys.

Fingerprints are 64-bit SimHashes over the XXH64 hashes of word shingles. Two
fingerprints that differ in at most two bits are linked. To find them without
comparing all, a fingerprint is cut into three segments of 22, 21 and 21 bits. By
pigeonhole one segment is equal in both, and the next one (cyclically) differs in
two bits at most. The perfect binary Golay code [23, 12] gives that segment fuzzy
keys: every word within one bit of it is decoded, which yields one or six
codeword indices, and two words at distance two or less always share one, that of
a word midway between them. The join key is (equal segment, codeword index); a
candidate is verified by counting the differing bits.

Keys that very many different fingerprints share are not paired. Their members are
linked through the points at one bit or less from them, 65 a fingerprint: two
fingerprints have such a point in common if and only if they differ in two bits
or fewer, so each point joined to its least member gives the same components at
linear cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_table, materialize, short_batches
from palimpsest.llm.components import connected_components

#: Widths of the segments; each fits into a Golay word of 23 bits.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
#: Different fingerprints under one key that are still paired with each other.
PAIRED = 24


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words, and the error of up to three bits for each syndrome."""
    unit = np.array([_remainder(1 << b) for b in range(23)], dtype=np.int64)
    error = np.zeros(2048, dtype=np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return unit, error


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices of all words at one bit or less from each 23-bit word; -1 fills repeated ones."""
    unit, error = _tables()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for b in range(23):
        syndrome ^= np.where(words >> b & 1, unit[b], 0)
    found = np.empty((len(words), 24), dtype=np.int64)
    found[:, 23] = (words ^ error[syndrome]) >> 11
    for b in range(23):
        found[:, b] = (words ^ 1 << b ^ error[syndrome ^ unit[b]]) >> 11
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, low = [], 0
    for width in SEGMENTS:
        out.append((fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = _segments(fp.view(np.uint64))
        for i in range(len(SEGMENTS)):
            fuzzy = fuzzy_keys(parts[(i + 1) % len(SEGMENTS)])
            row, col = np.nonzero(fuzzy >= 0)
            key = np.int64(i) << 40 | parts[i][row] << 12 | fuzzy[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of a UTF-8 text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    count, n = np.zeros(64, dtype=np.int64), len(starts)
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little")


#: 64-bit words of a wide fingerprint, and the odd factors that make further bits of a shingle's hash.
WIDE = 32
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """SimHash of ``64 * WIDE`` bits over unsigned 64-bit hashes, as signed integers: a bit is set if it is in over half of them.

    The first word is the SimHash of the hashes as they are; the others are those of the hashes mixed
    anew. Two sets whose vectors have the angle t between them differ in a bit with probability t / pi.
    """
    count = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * FACTORS
        part = (part ^ (part >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        part[:, 0] = hashes[at : at + step]
        # Full adders on whole words: three of one weight leave one of it and one of twice that.
        weight = 1
        while len(part):
            carried = []
            while len(part) > 1:
                k = max(len(part) // 3, 1)
                a, b, c = part[:k], part[k : 2 * k], part[2 * k : 3 * k]
                if len(part) == 2:
                    carried.append(a & b)
                    part = a ^ b
                    break
                both = a ^ b
                carried.append(a & b | c & both)
                part = np.concatenate([both ^ c, part[3 * k :]])
            count += np.unpackbits(part[0].astype("<u8").view(np.uint8), bitorder="little") * np.int64(weight)
            part = np.concatenate(carried) if carried else part[:0]
            weight *= 2
    return np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, text_hash)`` for every row of ``docs``: the SimHash of the whole text as a signed long.

    A-Z is lower-cased; words lie between ASCII white space; a text of fewer words
    than a shingle is one shingle; null, empty and blank texts have fingerprint 0. A
    bit is set if it is set in more than half the shingle hashes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    short_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("h")).mapInArrow(scan, "doc_id long, fp long, text_hash long")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct values ``fps(fp)`` at two differing bits or fewer."""
    keys = materialize(fps.select("fp").mapInArrow(_keyed, "key long, fp long"), "golay")
    crowd = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    few = crowd.where(F.col("members") <= PAIRED).select("key")
    many = crowd.where(F.col("members") > PAIRED).select("key")
    kept = keys.join(few, "key", "left_semi")
    pairs = (
        kept.select("key", F.col("fp").alias("a"))
        .join(kept.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )
    dense = keys.join(many, "key", "left_semi").select("fp").distinct()
    near = dense.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("point"))
    hubs = near.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("point", "b")
    stars = near.join(hubs, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    edges = materialize(pairs.unionByName(stars).distinct(), "near")
    drop_table(keys)
    return edges


def grouped(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, text_hash, root, component_id)`` for every row; see ``near_duplicates``. ``root``: one fingerprint of the component."""
    marked = materialize(fingerprints(docs, shingle, seed), "simhash")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    edges = links(groups)
    roots = connected_components(edges)
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "members")
    drop_table(groups)
    drop_table(edges)
    return marked.join(member, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the least doc_id among all rows reachable through links,
    the row itself included. Equal rows and rows of one doc_id are kept as they
    are; a null doc_id is ignored as a minimum, so that ``component_id`` is null
    only where all rows reached have none. Blank texts share fingerprint 0 and are
    linked like any others. Other columns play no part. No rows give no rows.
    """
    return grouped(docs, shingle, seed).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` less their near-copies, with all their columns.

    Of each component one row stays: that of the least doc_id (nulls only if there
    is no other), among those the least hash of the text, and one of equal rows.
    """
    from pyspark.sql import Window

    first = grouped(docs, shingle, seed).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = first.groupBy("root", "doc_id").agg(F.min("text_hash").alias("__hash")).select(F.col("doc_id").alias("__id"), "__hash").distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__text"))
    kept = rows.join(keep, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    one = kept.withColumn("__k", F.row_number().over(Window.partitionBy("__doc", "__text").orderBy("__doc")))
    return one.where("__k = 1").select("__row.*")
