"""Quality rules whose cutoffs are controlled for risk on labelled documents.

Each rule measures a document and rejects it above a cutoff. For each stratum and
rule the cutoffs of a fixed grid are tested from the most lenient on: a cutoff holds if
the exact binomial bound shows, at the corrected level, that it rejects no more than
the tolerated share of good documents. The first cutoff that fails ends the sequence,
so that the grid needs no correction of its own; rules and strata share the error
probability (Bonferroni), and rules share the tolerated rate (union bound). Where
the labels do not suffice to show anything, a rule stays out of force.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, small, words

#: Words of a window that counts as repeated; fixed limits of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Cutoffs by rule, the most lenient first; a document above one is rejected.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02),
    "repeated_words": (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "long_words": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0),
    "short_words": (-1.2, -1.5, -1.8, -2.0, -2.2, -2.4, -2.6, -2.8, -3.0, -3.2, -3.4, -3.6),
}
#: Share of good documents that all rules may reject in a stratum, and the probability that any bound is wrong.
RATE, DELTA = 0.02, 0.05
#: Terms of the binomial tail that are summed; the rest is bounded from above.
TERMS = 4000


def features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of ``text``.

    Null texts have no words or lines. Windows are compared by 64-bit hashes of their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("__t")).withColumn("__w", words(F.col("__t")))
    at = lambda a, i: F.get(F.col(a), i)
    starts = F.when(F.size("__w") >= WINDOW, F.sequence(F.lit(0), F.size("__w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = base.withColumn("__h", F.transform(starts, lambda i: F.xxhash64(*[at("__w", i + k) for k in range(WINDOW)]))).withColumn("__l", lines)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    two = one.withColumn("__s", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    three = two.withColumn("__p", F.sort_array(F.transform(F.filter("__s", lambda x, i: same(x, at("__s", i - 1)) | same(x, at("__s", i + 1))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), at("__p", k + 1) - p), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)
    names = [c for c in docs.select(*keep).columns]
    return three.select(
        *[F.col(f"`{c}`") for c in names],
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("__t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.size(F.split("__t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def measures() -> Column:
    """The rules' values for a row of ``features``, as an array in the order of ``GRIDS``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        F.col("word_chars") / n, -(F.col("word_chars") / n),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, stepped down; good to 1e-12."""
    x, down = n + F.lit(9.0), F.lit(0.0)
    for k in range(1, 9):
        down = down + F.log(n + F.lit(float(k)))
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) at probability ``p``, rounded up at worst; 1 where ``k`` is at or over the mean."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    down = F.sequence(F.lit(0), F.least(k, F.lit(float(TERMS))).cast("int"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    ratio = lambda j: j * (1 - p) / ((n - j + 1) * p)
    summed = F.aggregate(down, zero, lambda a, i: F.struct((a["t"] * ratio(k - i)).alias("t"), (a["s"] + a["t"]).alias("s")))
    rest = F.when(k > TERMS, summed["t"] / (1 - ratio(k - TERMS))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * (summed["s"] + rest))


def cutoffs(measured: DataFrame, rate: float = RATE, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff`` in force, from ``measured(stratum, values)``: one row for each good document that passed the base rules."""
    grids = F.array(*[F.array(*[F.lit(c) for c in g]) for g in GRIDS.values()])
    grid = F.get(grids, F.col("rule"))
    # The first step at which a document is rejected, one beyond the last if it never is.
    each = measured.select("stratum", F.posexplode("values").alias("rule", "v")).withColumn("step", F.size(F.filter(grid, lambda c: F.col("v") <= c)) + 1)
    counted = each.groupBy("stratum", "rule", "step").agg(F.count("*").alias("docs"))
    steps = counted.select("stratum", "rule").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.size(grid))))
    there = counted.unionByName(steps.withColumn("docs", F.lit(0).cast("long"))).groupBy("stratum", "rule", "step").agg(F.sum("docs").alias("docs"))
    w = Window.partitionBy("stratum", "rule")
    tested = there.withColumn("n", F.sum("docs").over(w)).withColumn("k", F.sum("docs").over(w.orderBy("step"))).where(F.col("step") <= F.size(grid))
    strata = measured.select("stratum").distinct().agg(F.count("*").alias("strata"))
    level = F.lit(delta) / (F.greatest(F.col("strata"), F.lit(1)) * len(GRIDS))
    tail = binomial_tail(F.col("n").cast("double"), F.col("k").cast("double"), rate / len(GRIDS))
    held = tested.crossJoin(F.broadcast(strata)).withColumn("ok", tail <= level)  # one row with the number of strata
    run = held.withColumn("all_ok", F.min(F.col("ok").cast("int")).over(w.orderBy("step"))).where("all_ok = 1")
    last = run.groupBy("stratum", "rule").agg(F.max("step").alias("step"))
    return last.select("stratum", "rule", F.get(F.get(grids, F.col("rule")), F.col("step") - 1).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, rate: float = RATE, delta: float = DELTA) -> DataFrame:
    """A row for each document: its measures, ``base_failed`` and ``kept``.

    Strata are languages; a null one is a stratum of its own. Good documents are
    those with a label row of quality 1, counted once a row; labels without doc_id
    or document do not count. Documents that fail the base rules are out; the others
    stay unless they lie above a cutoff in force for their stratum. Texts may be
    null or empty, rows may repeat; no rows give no rows.
    """
    doc = F.col("doc_id").cast("long").alias("doc_id")
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("stratum")
    found = features(docs, [doc, stratum]).withColumn("base_failed", base_failed()).withColumn("values", measures())
    rows = materialize(found, "features")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    limits = cutoffs(rows.where("NOT base_failed").join(good, "doc_id").select("stratum", "values"), rate, delta)
    by_stratum = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    met = rows.join(small(materialize(by_stratum, "cutoffs")), "stratum", "left")
    above = F.exists(F.map_entries("cuts"), lambda e: F.get("values", e["key"]) > e["value"])
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(above, F.lit(False))).alias("kept"))
