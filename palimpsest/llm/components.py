"""Connected components by randomized contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_table, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Distributed union-find over ``edges(a, b)``; returns ``(node, root)``.

    Each round every node hooks onto the neighbour (or itself) of least priority,
    the priority being a hash that changes by round, and the edges are rewritten
    between the hooks. Chains, stars and cliques all shrink by a constant factor a
    round, so the number of rounds is logarithmic. The minimum is pre-aggregated
    before its shuffle, and the joins are plain equi-joins of two exchanges, which
    adaptive execution splits where one node has very many edges. ``root`` is any
    node of the component, the same for all its nodes. Self-loops and nulls are
    ignored; nodes without an edge are not returned. Empty edges give no rows.
    Raises if the edges are not exhausted after ``rounds``.
    """
    todo = materialize(
        edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    roots = None
    kind = edges.schema["a"].dataType
    for k in range(rounds):
        if todo.isEmpty():
            break
        both = todo.select("a", "b").unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.lit(k), c)
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("r"), F.min_by("b", rank("b")).alias("n"))
        hook = materialize(
            least.select("node", F.when(F.col("r") < rank("node"), F.col("n")).otherwise(F.col("node")).cast(kind).alias("hook")),
            "hooks",
        )
        left = hook.select(F.col("node").alias("a"), F.col("hook").alias("ha"))
        right = hook.select(F.col("node").alias("b"), F.col("hook").alias("hb"))
        nxt = materialize(
            todo.join(left, "a").join(right, "b").where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(),
            "edges",
        )
        if roots is None:
            merged = hook.select("node", F.col("hook").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "hook")
            merged = materialize(roots.join(step, "root", "left").select("node", F.coalesce("hook", "root").alias("root")), "roots")
            drop_table(roots)
            drop_table(hook)
        roots = merged
        drop_table(todo)
        todo = nxt
    else:
        if not todo.isEmpty():
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots
