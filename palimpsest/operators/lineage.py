"""Lines through the versions of a file: blame, backward and forward lineage, tracked regions.

Versions are dealt by ranges of (file, position), so that a long history lies in several blocks,
each of which begins with the last version of the one before. What a block does to lines is a map of
pieces (``functions.linemaps``); maps of blocks are composed by a scan of log2(blocks) joins,
after which each block knows the state it begins with and is folded by itself. No
group holds more than one block, whatever the length of a history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import linemaps
from palimpsest.functions.lines import back, diff, not_unchanged, removed, track
from palimpsest.plans.durable import checkpointed, forget

#: Bytes of versions in a block, about.
BLOCK = 16 << 20
PIECES = "array<struct<first: bigint, size: bigint, target: bigint, kind: bigint>>"


def versions(rows: DataFrame, key: str, position: str, text: str, separator: str = "\n") -> DataFrame:
    """``file, position, lines`` from any table of texts in order."""
    return rows.select(F.col(key).cast("string").alias("file"), F.col(position).cast("long").alias("position"), F.split(text, separator, -1).alias("lines"))


def blocks(rows: DataFrame) -> DataFrame:
    """``file, block, position, lines, before``: versions in blocks numbered from 0 in each file; ``before`` marks the last version of the block before."""
    spark = rows.sparkSession
    held = checkpointed(rows.select("file", "position", "lines"))
    size = held.agg(F.sum(F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK)
    dealt = checkpointed(held.repartitionByRange(parts, "file", "position").withColumn("part", F.spark_partition_id()))
    forget(held)
    ends = dealt.groupBy("file", "part").agg(F.max("position").alias("last")).withColumn("block", F.row_number().over(Window.partitionBy("file").orderBy("part")) - 1)
    own = dealt.join(ends.select("file", "part", "block"), ["file", "part"]).select("file", "block", "position", "lines", F.lit(False).alias("before"))
    final = dealt.join(ends, ["file", "part"]).where("position = last").select("file", (F.col("block") + 1).alias("block"), "position", "lines", F.lit(True).alias("before"))
    return checkpointed(own.unionByName(final.join(ends.select("file", "block"), ["file", "block"], "left_semi")))


def _history(pdf: pd.DataFrame) -> list[tuple[int, list[str]]]:
    ordered = pdf.sort_values("position")
    return [(int(p), list(x)) for p, x in zip(ordered["position"], ordered["lines"], strict=True)]


def _short_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold fewer rows and bytes, as versions may be long; settings below these stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def _maps(dealt: DataFrame, one: Callable[[list[tuple[int, list[str]]], bool], list[linemaps.Piece]]) -> DataFrame:
    """``file, block, map``: what each block does to lines."""

    names = ("first", "size", "target", "kind")

    maps = pa.list_(pa.struct([(n, pa.int64()) for n in names]))

    def told(key: tuple, past: list[tuple[int, list[str]]], before: bool) -> tuple:
        return *key, [dict(zip(names, p, strict=True)) for p in one(past, before)]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), maps), strict=True)], ["file", "block", "map"])

    # Blocks follow each other in a stream that holds one at a time: very many are small, and each as a group of its own takes longer than its fold.
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, past, before = None, [], False
        for batch in batches:
            out = []
            for file, block, position, lines, mark in zip(*(batch[c].to_pylist() for c in ("file", "block", "position", "lines", "before")), strict=True):
                if (file, block) != key:
                    if past:
                        out.append(told(key, past, before))
                    key, past, before = (file, block), [], False
                past.append((position, lines))
                before = before or mark
            yield table(out)
        if past:
            yield table([told(key, past, before)])

    _short_batches(dealt.sparkSession)
    placed = dealt.select("file", "block", "position", "lines", "before").repartition("file", "block").sortWithinPartitions("file", "block", "position")
    return placed.mapInArrow(fold, f"file string, block int, map {PIECES}")


def _composed(one: pa.Array, two: pa.Array) -> pa.Array:
    """Each map of ``one``, then that of ``two``; null in ``two`` leaves it."""
    names = ("first", "size", "target", "kind")
    rows = lambda v: [tuple(p[n] for n in names) for p in v]
    made = [a if b is None else [dict(zip(names, p, strict=True)) for p in linemaps.compose(rows(a), rows(b))] for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)]
    return pa.array(made, one.type)


def _scanned(maps: DataFrame, back: bool) -> DataFrame:
    """``file, block, map`` with the map of a block and all after it, the latest first (``back``), or of all blocks up to it, the earliest first."""
    held, step = checkpointed(maps), 1
    most = held.agg(F.max("block")).first()[0] or 0
    while step <= most:
        shifted = held.select("file", (F.col("block") + F.lit(-step if back else step)).alias("block"), F.col("map").alias("far"))
        met = held.join(shifted, ["file", "block"], "left")
        both = F.arrow_udf(_composed, PIECES)(F.coalesce("far", "map"), F.when(F.col("far").isNotNull(), F.col("map")))
        before, held = held, checkpointed(met.select("file", "block", both.alias("map")))
        forget(before)
        step *= 2
    return held


def _folded(dealt: DataFrame, scanned: DataFrame, line: int, back: bool, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each block folded from the line that it begins with."""
    hit = F.get(F.filter("map", lambda p: (p["first"] <= line) & (line < p["first"] + p["size"])), F.lit(0))
    reached = F.when(hit["kind"] == linemaps.SHIFT, hit["target"] + line - hit["first"]).when(hit["kind"] == linemaps.CONST, hit["target"])
    starts = scanned.select("file", (F.col("block") + F.lit(-1 if back else 1)).alias("block"), reached.alias("line")).where("line IS NOT NULL")
    ends = scanned.groupBy("file").agg(F.max("block").alias("block")) if back else scanned.select("file", F.lit(0).alias("block")).distinct()
    starts = starts.unionByName(ends.select("file", "block", F.lit(line).cast("long").alias("line")))
    return dealt.join(starts, ["file", "block"]).groupBy("file", "block").applyInPandas(fold, schema)


def backward(rows: DataFrame, line: int) -> DataFrame:
    """``file, position, line, relation`` from the last version back: where a line came from, until it was introduced."""

    def one(past: list[tuple[int, list[str]]], _: bool) -> list[linemaps.Piece]:
        found = None
        for (_, old), (_, new) in zip(past[-2::-1], past[:0:-1], strict=True):
            step = linemaps.origin_map(old, new)
            found = step if found is None else linemaps.compose(found, step)
        return [(1, len(past[-1][1]), 1, linemaps.SHIFT)] if found is None else found

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        past, at, out = _history(pdf), int(pdf["line"].iloc[0]), []
        if at <= len(past[-1][1]):
            for (_, old), (position, new) in zip(past[-2::-1], past[:0:-1], strict=True):
                relation, before = back(diff(old, new), at, old == new)
                out.append((pdf["file"].iloc[0], position, at, relation))
                if before is None:
                    break
                at = before
            else:
                if not pdf["before"].any():
                    out.append((pdf["file"].iloc[0], past[0][0], at, "introduced"))
        return pd.DataFrame(out, columns=["file", "position", "line", "relation"])

    dealt = blocks(rows)
    return _folded(dealt, _scanned(_maps(dealt, one), back=True), line, True, fold, "file string, position long, line long, relation string")


def fate(rows: DataFrame, line: int) -> DataFrame:
    """``file, position, line, event`` from the first version on: what became of a line, until it is gone or unknown."""

    def one(past: list[tuple[int, list[str]]], _: bool) -> list[linemaps.Piece]:
        found = [(1, len(past[0][1]), 1, linemaps.SHIFT)]
        for (_, old), (_, new) in pairwise(past):
            found = linemaps.compose(found, linemaps.fate_map(old, new))
        return found

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        past, at, out = _history(pdf), int(pdf["line"].iloc[0]), []
        if at <= len(past[0][1]):
            for (_, old), (position, new) in pairwise(past):
                event, after = linemaps.step_forward(old, new, diff(old, new), at)
                if event == "kept" and after == at:
                    continue
                out.append((pdf["file"].iloc[0], position, after or at, {"kept": "shifted"}.get(event, event)))
                if event not in ("kept", "moved"):
                    break
                at = after
        return pd.DataFrame(out, columns=["file", "position", "line", "event"])

    dealt = blocks(rows)
    return _folded(dealt, _scanned(_maps(dealt, one), back=False), line, False, fold, "file string, position long, line long, event string")


def blame(rows: DataFrame) -> DataFrame:
    """``file, line, position``: the version that introduced or last changed each line of the last one."""

    def one(past: list[tuple[int, list[str]]], before: bool) -> list[linemaps.Piece]:
        found = [(1, len(past[-1][1]), 1, linemaps.SHIFT)]
        for (_, old), (position, new) in zip(past[-2::-1], past[:0:-1], strict=True):
            found = linemaps.compose(found, linemaps.blame_map(old, new, position))
            if all(kind == linemaps.OWNED for _, _, _, kind in found):  # older versions have no line more
                return found
        return found if before else linemaps.compose(found, [(1, len(past[0][1]), past[0][0], linemaps.OWNED)])

    whole = _scanned(_maps(blocks(rows), one), back=True).where("block = 0")
    piece = whole.select("file", F.explode("map").alias("p")).select("file", "p.*")
    return piece.select("file", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("line"), F.col("target").alias("position"))


def followups(rows: DataFrame) -> DataFrame:
    """``file, seed, position, old_first, old_last, new_first, new_last``: later versions that touch what the second one added.

    The seed's added lines are regions, carried through every later version; budgets of
    the caller cut the versions before. Whether a region has ended can't be told from maps of
    blocks, so that its state goes from block to block, all files at a time.
    """
    state = "pairs long, seed long, regions array<long>"
    event = ["file", "seed", "position", "old_first", "old_last", "new_first", "new_last"]
    schema = f"file string, seed long, position long, old_first long, old_last long, new_first long, new_last long, block int, {state.replace('seed', 'from_seed')}"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        past, out, file = _history(pdf), [], pdf["file"].iloc[0]
        n, seed, flat = int(pdf["pairs"].iloc[0]), int(pdf["seed"].iloc[0]), list(pdf["regions"].iloc[0])
        regions = list(zip(flat[::2], flat[1::2], strict=True))
        for (_, old), (position, new) in pairwise(past):
            if n == 0:
                added = not_unchanged(diff(old, new, 0), len(new), old == new)
                seed = position
                for k in added:
                    regions = [*regions[:-1], (regions[-1][0], k)] if regions and regions[-1][1] == k - 1 else [*regions, (k, k)]
            else:
                found = track(regions, diff(old, new, 0))
                if found is None or not regions:
                    regions = []
                    break
                regions, met = found
                out += [(file, seed, position, *m, None, None, None, None) for m in met]
            n += 1
        if regions or n == 0:
            out.append((file, None, None, None, None, None, None, int(pdf["block"].iloc[0]) + 1, n, seed, [x for r in regions for x in r]))
        made = pd.DataFrame(out, columns=[*event, "block", "pairs", "from_seed", "regions"])
        return made.astype({c: "Int64" for c in made.columns if c not in ("file", "regions")})

    dealt = blocks(rows)
    states = dealt.select("file").distinct().select("file", F.lit(0).alias("block"), F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("seed"), F.array().cast("array<long>").alias("regions"))
    out = None
    while True:
        told = checkpointed(dealt.join(states, ["file", "block"]).groupBy("file", "block").applyInPandas(fold, schema))
        found = told.where("block IS NULL").select(*event)
        out = found if out is None else out.unionByName(found)
        states = told.where("block IS NOT NULL").select("file", "block", "pairs", F.col("from_seed").alias("seed"), "regions")
        if dealt.join(states, ["file", "block"], "left_semi").isEmpty():
            return out


def introducing(rows: DataFrame) -> DataFrame:
    """Trace a fix: the versions that introduced the lines which the last version removed, by number of lines."""
    rows = checkpointed(rows.select("file", "position", "lines"))  # read five times
    newest = lambda df: df.groupBy("file").agg(F.max("position").alias("position"), F.max_by("lines", "position").alias("lines"))
    last = newest(rows).select("file", F.col("position").alias("fixed"), F.col("lines").alias("new"))
    earlier = rows.join(last.select("file", "fixed"), "file").where(F.col("position") < F.col("fixed")).drop("fixed")
    two = newest(earlier).join(last, "file").select("file", "fixed", F.col("lines").alias("old"), "new")

    def gone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, fixed, old, new in zip(pdf["file"], pdf["fixed"], map(list, pdf["old"]), map(list, pdf["new"]), strict=True):
                out += [(file, k, fixed) for k in removed(diff(old, new, 0))]
            yield pd.DataFrame(out, columns=["file", "line", "fixed"])

    lost = two.mapInPandas(gone, "file string, line long, fixed long")
    return lost.join(blame(earlier), ["file", "line"]).groupBy("file", "fixed", "position").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))
