"""Similar sets by prefix filter: exact, also where very many of them share a key.

Of two sets with Jaccard similarity s or more, whose elements are put in any one order,
some element is among the first n - ceil(s n) + 1 of both. ``prefix`` tables hold those:
``key, id, at, n`` with the place ``at`` (from 1 on) in the order and the size ``n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_table, materialize
from palimpsest.llm.components import connected_components

#: Rounds of hubs; members of a salted block; first keys of a member, by which a pair that shares several is met once.
ROUNDS, BLOCK, SHARED = 2, 256, 16


def _may(similar: float, at_a: str, n_a: str, at_b: str, n_b: str) -> Column:
    """Whether sets whose first common element is at these places can be similar: their rests bound what they share."""
    most = 1 + F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b))
    return most >= (F.col(n_a) + F.col(n_b)) * (similar / (1 + similar)) - 1e-6


def _words(sketches: DataFrame | None) -> list[str]:
    return [c for c in sketches.columns if c != "id"] if sketches is not None else []


def _near(words: list[str]) -> Column:
    """Whether the sketches of two sides, ``s_a, ...`` and ``s_b, ...``, differ in as many bits as the looser side's ``most`` or fewer."""
    if not words:
        return F.lit(True)
    bits = (F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words if w != "most")
    return sum(bits, F.lit(0)) <= F.greatest("most_a", "most_b")


def _close(pairs: DataFrame, sketches: DataFrame | None, near: Column | None = None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches are near each other."""
    if sketches is None:
        return pairs
    words = _words(sketches)
    side = lambda s: sketches.select(F.col("id").alias(s), *[F.col(w).alias(f"{w}_{s}") for w in words])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near(words) if near is None else near).select("a", "b")


def _mains(members: DataFrame) -> DataFrame:
    """By ``key`` the root ``main`` that most members have, the number of ``members`` and of ``loners``, which have others."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("members"))
    return most.select("key", F.col("m.root").alias("main"), "members", (F.col("members") - F.col("m.c")).alias("loners"))


def _rest(members: DataFrame, similar: float, sketches: DataFrame | None = None, near: Column | None = None) -> DataFrame:
    """Pairs ``a, b`` of different roots under one key whose sketches are near each other, met in salted blocks."""
    words = _words(sketches)
    mains = _mains(members)
    if words:
        members = members.join(sketches, "id")
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "key"))), 1, SHARED), lambda x: x["key"])
    members = members.join(members.groupBy("id").agg(first.alias("ks")), "id")
    words = [*words, "ks"]
    blocks = mains.select("key", "main", F.ceil(F.col("loners") / BLOCK).cast("int").alias("blocks"))
    own = members.join(blocks, "key").withColumn("loner", F.col("root") != F.col("main"))
    # Members of the main root need no look at each other: loners are dealt to blocks, and all members go to each of those.
    side = lambda s, *more: ["key", "block", *more, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "at", "n", "root", *words)]]
    every = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*side("a", "loner"))
    alone = own.where("loner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(*side("b"))
    # Two loners are met in the blocks of both.
    met = every.join(alone, ["key", "block"]).where("root_a <> root_b").where("NOT loner OR id_a < id_b")
    # A pair is met under each key it shares: it goes on from the first of those, as far as that is among the first ones of both.
    once = F.coalesce(F.get(F.array_intersect("ks_a", "ks_b"), F.lit(0)), F.col("key")) == F.col("key")
    near = _near(words[:-1]) if near is None else near
    return met.where(_may(similar, "at_a", "n_a", "at_b", "n_b") & near & once).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` with the ``root`` of the component that ``edges`` put each id in."""
    roots = connected_components(edges).select(F.col("node").alias("id"), "root")
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _open(members: DataFrame) -> DataFrame:
    """Those of ``members`` whose key has several components."""
    several = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return members.join(several, "key", "left_semi")


def links(prefix: DataFrame, verified: Callable[[DataFrame], DataFrame], similar: float, sketches: DataFrame | None = None, known: DataFrame | None = None, near: Column | None = None) -> DataFrame:
    """Edges ``a, b`` that connect exactly the ids that pairs of similarity ``similar`` or more connect.

    Pairs within one component need no look. So the members of each key are compared
    with one hub a round, which joins near-copies at linear cost. The hub, which has then
    been compared with all, leaves the key, and keys whose members are in one component
    are done. After ``ROUNDS`` rounds all pairs of different components under a key are compared.
    ``verified`` takes pairs ``a, b`` and returns those that are similar. ``sketches``: by
    ``id`` words of bits of which similar sets differ in ``most`` (a column) at most, that of either; other pairs are not verified.
    ``near``: in that rule's place a condition on any columns of ``sketches``, ``x_a`` and ``x_b`` for each column ``x``.
    ``known``: edges ``a, b`` between similar ids that are there already; they are among those returned.
    ``prefix`` may have a ``weight``, the same in all rows of an id: the heaviest members are hubs first.
    """
    own = ["id", "at", "n", *[c for c in prefix.columns if c == "weight"]]
    todo = materialize(_open(prefix.select("key", *own, F.col("id").alias("root"))), "prefix")
    edges = todo.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0) if known is None else known
    if known is not None and not known.isEmpty():
        every, rooted = todo, materialize(_rooted(todo.drop("root"), known), "rooted")
        todo = materialize(_open(rooted), "prefix")
        drop_table(every)
        drop_table(rooted)
    for k in range(ROUNDS + 1):
        if todo.isEmpty():
            break
        if k == ROUNDS:
            pairs = _rest(todo, similar, sketches, near)
            edges = materialize(edges.unionByName(verified(materialize(pairs, "candidates"))), "similar")
            break
        rank = F.struct(*[-F.col(c) for c in own if c == "weight"], F.xxhash64(F.lit(k), "id").alias("turn"))
        hub = todo.groupBy("key").agg(F.min_by(F.struct("id", "at", "n", "root"), rank).alias("h")).select("key", *[F.col(f"h.{c}").alias(f"{c}_h") for c in ("id", "at", "n", "root")])
        met = materialize(todo.join(hub, "key").where("id <> id_h"), "met")
        open_ = met.where("root <> root_h").where(_may(similar, "at", "n", "at_h", "n_h"))
        pairs = _close(open_.select(F.least("id", "id_h").alias("a"), F.greatest("id", "id_h").alias("b")).distinct(), sketches, near)
        edges = materialize(edges.unionByName(verified(materialize(pairs, "candidates"))), "similar")
        rooted = _rooted(met.select("key", *own), edges)
        rooted = materialize(rooted, "rooted")
        drop_table(todo)
        drop_table(met)
        todo = materialize(_open(rooted), "prefix")
        drop_table(rooted)
    drop_table(todo)
    return edges
