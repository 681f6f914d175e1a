"""Benchmark decontamination by a broadcast set of normalised n-grams.

The windows of all benchmark items are hashed into one sorted array. Every task
turns its texts into word numbers, slides a polynomial hash over them, looks the
hashes up, and verifies each hit word by word before it counts. The set is
broadcast only while its windows stay under a checked bound; beyond it the same
result comes from a join on the window's hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ascii_lower, materialize, short_batches

#: Lower-cases A-Z; anything that is not in a word becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows, and bytes of benchmark text, that may be broadcast.
WINDOWS, ITEM_BYTES = 2_000_000, 64_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of a text as it stands, in UTF-8.
CASED_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCHEMA = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("hits", T.ArrayType(T.IntegerType()))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowSet:
    """Benchmark windows by length: sorted hashes for the scan, and word numbers to verify with."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, list[str]] = {}
        found: dict[int, set[int]] = {}
        for item, text in sorted(items):
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)], dtype=np.int32)
            n = min(size, len(numbers))
            if not n:
                continue
            hashes = self.hashes(numbers, n)
            for at in range(len(numbers) - n + 1):
                owners = self.windows.setdefault(numbers[at : at + n].tobytes(), [])
                if item not in owners:
                    owners.append(item)
                found.setdefault(n, set()).add(int(hashes[at]))
        self.hashed = {n: np.array(sorted(x), dtype=np.uint64) for n, x in found.items()}

    @staticmethod
    def hashes(numbers: np.ndarray, n: int) -> np.ndarray:
        count, wide = len(numbers) - n + 1, numbers.astype(np.uint64)
        out = np.zeros(max(count, 0), dtype=np.uint64)
        for k in range(n if count > 0 else 0):
            out = out * STEP + wide[k : k + count]
        return out ^ out >> np.uint64(29)

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, a mask of the hit ones, and the items found."""
        words = split_words(text)
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        hit, items = np.zeros(len(words), dtype=bool), set()
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        for n, hashed in self.hashed.items():
            if len(words) < n:
                continue
            whole = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(whole):
                continue
            h = self.hashes(numbers, n)[whole]
            at = np.minimum(np.searchsorted(hashed, h), len(hashed) - 1)
            for p in whole[hashed[at] == h]:
                if owners := self.windows.get(numbers[p : p + n].tobytes()):
                    hit[p : p + n] = True
                    items.update(owners)
        return len(words), hit, items


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], size: int, spans: bool) -> DataFrame:
    short_batches(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(items)
    made: dict[int, WindowSet] = {}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = made.get(0) or made.setdefault(0, WindowSet(held.value, size))
        for batch in batches:
            n_words, n_hit, found, hits = [], [], [], []
            for t in batch.column(0).cast(pa.binary()):
                n, mask, owners = windows.scan(t.as_py() or b"")
                n_words.append(n)
                n_hit.append(int(mask.sum()))
                found.append(sorted(owners))
                hits.append(np.flatnonzero(mask).tolist() if spans else [])
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=["n_words", "n_hit", "items", "hits", *batch.schema.names[1:]])

    return rows.mapInArrow(scan, T.StructType([*SCHEMA.fields, *rows.schema.fields[1:]]))


def _windows(words, n):
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def _joined(rows: DataFrame, benchmark: DataFrame, size: int, spans: bool) -> DataFrame:
    """The scan as a join on windows, for benchmarks that are too large to broadcast."""
    split = lambda c: F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    texts = materialize(rows.select(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).distinct().select("h", split(F.col("text")).alias("w")), "words")
    sized = benchmark.select("item", split(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    owned = sized.select("item", "n", F.explode(_windows(F.col("w"), F.col("n"))).alias("window")).groupBy("n", "window").agg(F.collect_set("item").alias("owners"))
    lengths = F.broadcast(sized.select("n").distinct())  # at most ``size`` rows
    there = texts.join(lengths, F.size("w") >= F.col("n")).select("h", "n", F.posexplode(_windows(F.col("w"), F.col("n"))).alias("at", "window"))
    hits = there.join(owned, ["n", "window"]).select("h", "owners", F.sequence(F.col("at"), F.col("at") + F.col("n") - 1).alias("span"))
    found = hits.groupBy("h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("span")))).alias("hits"))
    done = texts.join(found, "h", "left").select(
        F.col("h").alias("__h"), F.size("w").cast("long").alias("n_words"), F.size(F.coalesce("hits", F.array().cast("array<int>"))).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
    )
    out = rows.withColumn("__h", F.xxhash64("text")).join(done, "__h").drop("__h")
    out = out if spans else out.withColumn("hits", F.array().cast("array<int>"))
    return out.select("n_words", "n_hit", "items", "hits", *rows.columns[1:])


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = 8, *, keep: list[str] | None = None, spans: bool = False, most_windows: int = WINDOWS) -> DataFrame:
    """``n_words, n_hit, items, hits`` and the columns ``keep`` for each row of ``docs(text, ...)``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but
    not none, is one window. A document's word inside any occurrence of a window
    is hit; ``hits`` lists their positions if ``spans``. ``items`` lists, sorted as
    strings, the item_ids with occurring windows; rows of one item_id count as one
    item. Null and wordless texts have no words and no hits; benchmark rows without
    an item_id or words are ignored; an empty benchmark hits nothing. Repeated rows
    and doc_ids are scanned row by row. ``docs`` may have any further columns.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in (keep or [])])
    wanted = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A text of b bytes has at most b/2 + 1 words, and no more windows than words.
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if total.b <= min(ITEM_BYTES, most_windows * 2) and total.n <= most_windows:
        return _scan(rows, [(r.item, bytes(r.text, "utf-8")) for r in wanted.collect()], size, spans)
    return _joined(rows, wanted, size, spans)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, size: int = 8, items: int = 2) -> DataFrame:
    """A row for each document: counts, the digest of its items, and whether ``items`` or more occur."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark, size, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= items).alias("contaminated"),
    )


def without(text: bytes, hits: list[int]) -> bytes:
    """A text less its words at the places ``hits``, each with what stands between it and the next word."""
    starts = [m.start() for m in CASED_BYTES.finditer(text)]
    gone, ends = set(hits), [*starts[1:], len(text)]
    return text[: starts[0]] + b"".join(text[a:b] for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k not in gone)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 8, items: int = 2) -> DataFrame:
    """``docs`` without what the benchmark's windows hit, with all its columns.

    Documents in which windows of ``items`` items or more occur are removed. In the
    others the hit words go, each with whatever stands between it and the next
    word, and a column n_chars is set to the new length. Rows without a hit stay
    as they are, null and empty texts included.
    """
    # One struct and reserved names: columns of ``docs`` may have any name.
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("__row"))
    found = scan_documents(packed, benchmark, size, keep=["__row"], spans=True).where(F.size("items") < items).select("hits", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).field("text").cast(pa.binary())
            new = [without(t.as_py(), h).decode() if h else None for t, h in zip(texts, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(1)], names=["__cut", "__row"])

    row = found.schema["__row"]
    out = found.mapInArrow(cut, T.StructType([T.StructField("__cut", T.StringType()), row]))
    hit = F.col("__cut").isNotNull()
    new = {"text": F.col("__cut"), "n_chars": F.char_length("__cut")}
    old = lambda f: F.col(f"__row.`{f.name}`")
    return out.select(*[(F.when(hit, new[f.name].cast(f.dataType)).otherwise(old(f)) if f.name in new else old(f)).alias(f.name) for f in docs.schema.fields])
