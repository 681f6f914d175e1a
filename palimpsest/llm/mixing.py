"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from water filling over the sources. Their words are cut into equal
blocks, and the blocks are apportioned by highest quotients, first to sources and
then, within each source, to shards of its documents. A shard's documents lie on
a tape in seeded order; it gives as many blocks as its quota says, running from a
seeded block round the tape, so that no word is taken twice more often than another
one is. Everything is DataFrame operations: rows travel as ids and sizes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, small, words

#: Words in a block, words in a shard (about), and shards at most.
BLOCK, SHARD, SHARDS = 8, 20_000, 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``: water filling under ``most`` times the size.

    Sources in order of code points, null last, get ``weights`` in turn. The one
    row a source goes through a single task, as an order of all sources needs.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") - 1) % len(weights))
    cap = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    by, every = Window.orderBy("ratio", "k"), Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * float(epochs) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # The level at which the sources before this one are full is right from the first source on that it does not fill.
    levels = cap.withColumn("level", level).withColumn("i", F.row_number().over(by))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("i", "level"))).over(every)["level"]
    full = levels.withColumn("at", F.coalesce(fits, F.lit(float("inf"))))
    return full.select("source", "source_size", F.least("cap", F.col("at") * F.col("w")).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """Sainte-Lague seats: ``parties`` (group, party, votes, seats of the group) with ``quota`` seats each.

    All parties first get what a divisor just too large would give them; the seats
    then missing, no more than parties, go to the highest quotients votes / (2s - 1),
    ties by party. The result is that of handing out all seats one by one.
    """
    g = Window.partitionBy(*group)
    known = parties.withColumn("n", F.count("*").over(g)).withColumn("v", F.sum("votes").over(g))
    share = F.when(F.col("v") > 0, F.col("votes") / F.col("v")).otherwise(0.0)
    base = F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("n") / 2) + 0.5 - 1e-9)).cast("long")
    based = known.withColumn("base", base).withColumn("extra", F.when(F.col("votes") > 0, F.ceil(share * F.col("n")) + 2).otherwise(0).cast("int"))
    open_ = based.withColumn("left", F.col("seats") - F.sum("base").over(g))
    bids = open_.where("extra > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("extra"))))
    bids = bids.withColumn("q", F.col("votes") / (2 * (F.col("base") + F.col("j")) - 1))
    won = bids.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("q"), *party, "j")))
    return won.groupBy(*group, *party).agg((F.first("base") + F.sum((F.col("rank") <= F.col("left")).cast("long"))).alias("quota"))


def plan(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), epochs: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``doc_id, text_hash, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source, ...)``.

    ``size``: words between ASCII white space, 0 for null, empty and blank texts,
    of which nothing is taken. A source may be null, which is a source of its own.
    ``taken`` counts repeats, and is ``most`` times the size at most; equal rows are
    rows of their own. The choice depends on ``seed`` and the rows alone, not on
    their order or partitions. No rows give no rows.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
            F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = materialize(source_targets(sized, weights, epochs, most), "targets")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("wanted")).first()
    shards = max(1, min(SHARDS, total.words // shard))
    placed = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(shards)))
    named = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    seats = apportion(named.select(F.lit(0).alias("all"), "key", F.col("target").alias("votes"), F.lit(round(total.wanted / block)).alias("seats")), ["all"], ["key"])
    cells = placed.groupBy("key", "cell").agg(F.sum("size").alias("tape"))
    voting = cells.join(small(seats.select("key", F.col("quota").alias("seats"))), "key").select("key", "cell", F.col("tape").alias("votes"), "seats")
    quotas = apportion(voting, ["key"], ["cell"]).join(cells, ["key", "cell"]).select("key", "cell", "quota", "tape")
    quotas = materialize(quotas, "quotas")

    # On a tape of ``tape`` words: ``rounds`` whole passes, and a run of ``rest`` words from a seeded block on.
    blocks = F.ceil(F.col("tape") / block)
    given = quotas.withColumn("wanted", F.least(F.col("quota") * block, F.floor(F.col("tape") * F.lit(float(most)))).cast("long"))
    given = given.withColumn("rounds", F.floor(F.col("wanted") / F.col("tape"))).withColumn("rest", F.col("wanted") % F.col("tape"))
    given = given.withColumn("from", F.pmod(F.xxhash64(F.lit(seed + 1), "key", "cell"), blocks) * block)
    tape = Window.partitionBy("key", "cell").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "text_hash"), "doc_id", "text_hash", "size")
    laid = placed.join(given.drop("quota"), ["key", "cell"], "left").withColumn("end", F.sum("size").over(tape.rowsBetween(Window.unboundedPreceding, 0)))
    start, end, first, last = F.col("end") - F.col("size"), F.col("end"), F.col("from"), F.col("from") + F.col("rest")
    meet = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(start, a))
    run = meet(first, F.least(last, F.col("tape"))) + meet(F.lit(0), last - F.col("tape"))
    taken = F.coalesce(F.col("rounds") * F.col("size") + run, F.lit(0)).cast("long")
    mixed = laid.select("doc_id", "text_hash", "key", "size", taken.alias("taken"))
    about = small(named.select("key", "source_size", "target"))
    return mixed.join(about, "key").select("doc_id", "text_hash", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents as mixed: each row of ``docs`` as often as ``plan`` takes it, to the nearest whole copy.

    Runs on a tape are contiguous, so only the two documents at the ends of a run
    are taken in part; they are rounded, half a document up. Blank documents have no
    words to take and go. All columns stay; rows alike in doc_id and text take turns.
    """
    copies = plan(docs, **options).where("size > 0 AND taken > 0").withColumn("n", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("n > 0")
    turn = lambda d, *k: d.withColumn("__k", F.row_number().over(Window.partitionBy("__id", "__h").orderBy(*k)))
    chosen = copies.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("__id"), F.col("text_hash").alias("__h")).agg(F.array_sort(F.collect_list("n"), lambda a, b: b - a).alias("__n"))
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__h"))
    met = turn(rows.join(chosen, ["__id", "__h"]), "__id")
    return met.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.coalesce(F.get("__n", F.col("__k") - 1), F.lit(0))))).select("__row.*")
