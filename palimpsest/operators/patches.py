"""Patch equivalence, inverse patches, and what groups of them say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modes of regular files and of absence; anything else leaves a patch indeterminate.
REGULAR = ("000000", "100644", "100755")


def parse_header(header: Column) -> Column:
    """The four numbers of a hunk header; a missing length is 1."""
    part = lambda i: F.regexp_extract(header, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    length = lambda i: F.when(part(i) == "", F.lit("1")).otherwise(part(i)).cast("long")
    number = lambda i: F.nullif(part(i), F.lit("")).cast("long")
    return F.struct(number(1).alias("old_start"), length(2).alias("old_lines"), number(3).alias("new_start"), length(4).alias("new_lines"))


def edits(text: Column) -> Column:
    """The changed lines of a hunk with their signs, without header and context."""
    return F.filter(F.split(text, "\n", -1), lambda x, i: (i > 0) & (x.startswith("+") | x.startswith("-")))


def edit_blocks(text: Column) -> Column:
    """The changed lines of a hunk in runs that unchanged lines part: an array for each run."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("run"))
    closed = lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        changed = x.startswith("+") | x.startswith("-")
        # A line like "\\ No newline at end of file" belongs to the line before it.
        note = x.startswith("\\")
        done = F.when(changed | note, s["done"]).otherwise(closed(s))
        run = F.when(changed, F.concat(s["run"], F.array(x))).when(note, s["run"]).otherwise(F.array().cast("array<string>"))
        return F.struct(done.alias("done"), run.alias("run"))

    lines = F.split(text, "\n", -1)
    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, step, closed)


def inverse_edits(blocks: Column) -> Column:
    """Edit blocks as they would be undone: signs swapped, and in each block removals before additions."""

    def undone(changed: Column) -> Column:
        swap = F.transform(changed, lambda x: F.concat(F.when(x.startswith("+"), "-").otherwise("+"), F.substr(x, F.lit(2))))
        return F.concat(F.filter(swap, lambda x: x.startswith("-")), F.filter(swap, lambda x: x.startswith("+")))

    return F.transform(blocks, undone)


def file_patches(changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """``oid, forward, inverse, complete``: digests of a commit's whole patch and of its inverse.

    ``changes(oid, ordinal, status, old_path, new_path, old_mode, new_mode)``,
    ``hunks(oid, ordinal, hunk, text)``. Files are sorted by paths; line numbers and
    context do not matter, the division into hunks and edit blocks does. Special modes, unreadable text
    and counts that contradict the header make a patch incomplete.
    """
    head = parse_header(F.substring_index("text", "\n", 1))
    minus, plus = lambda e: F.size(F.filter(e, lambda x: x.startswith("-"))), lambda e: F.size(F.filter(e, lambda x: x.startswith("+")))
    context = F.size(F.filter(F.split("text", "\n", -1), lambda x, i: (i > 0) & x.startswith(" ")))
    read = hunks.withColumn("e", edits(F.col("text"))).withColumn("blocks", edit_blocks(F.col("text"))).withColumn("h", head)
    sound = F.col("text").isNotNull() & (minus(F.col("e")) + context == F.col("h.old_lines")) & (plus(F.col("e")) + context == F.col("h.new_lines"))
    by_file = read.groupBy("oid", "ordinal").agg(F.array_sort(F.collect_list(F.struct("hunk", "blocks"))).alias("hs"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"))
    files = changes.join(by_file, ["oid", "ordinal"], "left")
    regular = F.col("old_mode").isin(*REGULAR) & F.col("new_mode").isin(*REGULAR)
    hs = F.coalesce("hs", F.array().cast(by_file.schema["hs"].dataType))
    kind = F.substring("status", 1, 1)
    undone = F.when(kind == "A", "D").when(kind == "D", "A").otherwise(kind)
    forward = F.struct("old_path", "new_path", kind.alias("kind"), "old_mode", "new_mode", F.transform(hs, lambda h: h["blocks"]).alias("edits"))
    inverse = F.struct(F.col("new_path").alias("old_path"), F.col("old_path").alias("new_path"), undone.alias("kind"), F.col("new_mode").alias("old_mode"), F.col("old_mode").alias("new_mode"), F.transform(hs, lambda h: inverse_edits(h["blocks"])).alias("edits"))
    each = files.select("oid", forward.alias("f"), inverse.alias("i"), (regular & F.coalesce("sound", F.lit(True))).alias("ok"))
    # A file's patch goes on as its digest; those of a commit are put in order in 256 parts, so that no row grows with its files.
    part = lambda c, kind: F.struct(F.lit(kind).alias("kind"), F.sha2(F.to_json(F.col(c)), 256).alias("digest"))
    told = each.select("oid", "ok", F.explode(F.array(part("f", "forward"), part("i", "inverse"))).alias("p")).select("oid", "ok", "p.*")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    parts = told.groupBy("oid", "kind", F.substring("digest", 1, 2).alias("part")).agg(joined("digest").alias("digest"), F.bool_and("ok").alias("ok"))
    whole = parts.groupBy("oid", "kind").agg(joined(F.concat("part", "digest")).alias("digest"), F.bool_and("ok").alias("ok"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("digest"))).alias(kind)
    return whole.groupBy("oid").agg(of("forward"), of("inverse"), F.bool_and("ok").alias("complete"))


def equivalents(patches: DataFrame, oid: str, relation: str = "equivalent") -> DataFrame:
    """Complete patches equal to that of ``oid``, or to its inverse."""
    column = {"equivalent": "forward", "inverse": "inverse"}[relation]
    query = patches.where((F.col("oid") == oid) & F.col("complete")).select(F.col(column).alias("wanted"))
    return patches.where(F.col("complete") & (F.col("oid") != oid)).join(F.broadcast(query), F.col("forward") == F.col("wanted")).select("oid").orderBy("oid")


def groups(ranked: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Groups of equal patches: the best-ranked member stands for each, sizes do not score; unknown ones stay alone."""
    best = F.struct(-F.col("score"), -F.col("commit_time"), "oid")
    key = F.coalesce(F.col(fingerprint), F.concat(F.lit("?"), F.col("doc_id").cast("string")))
    return ranked.groupBy(key.alias("g")).agg(F.min_by(F.struct("doc_id", "score", "commit_time", "oid"), best).alias("b"), F.count("*").alias("members")).select(
        F.col("b.doc_id").alias("representative"), "b.score", "members", "b.commit_time", "b.oid"
    )


def inverse_pairs(patches: DataFrame) -> DataFrame:
    """Pairs of different commits where one undoes the other, each pair once."""
    a = patches.where("complete").select(F.col("oid").alias("a"), F.col("inverse").alias("k"))
    b = patches.where("complete").select(F.col("oid").alias("b"), F.col("forward").alias("k"))
    return a.join(b, "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def excerpt(hunks: DataFrame, key: str, *, most: int = 16, files: int = 8, hunk_bytes: int = 8192, total: int = 32_768) -> DataFrame:
    """The first hunks of each result within its limits of hunks, files and bytes; longer hunks are left out."""
    short = hunks.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= hunk_bytes)
    w = Window.partitionBy(key).orderBy("ordinal", "hunk")
    ranked = short.withColumn("k", F.row_number().over(w)).withColumn("f", F.dense_rank().over(Window.partitionBy(key).orderBy("ordinal"))).withColumn("spent", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("k") <= most) & (F.col("f") <= files) & (F.col("spent") <= total)).drop("k", "f", "spent", "bytes")
