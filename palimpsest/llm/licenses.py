"""Licence scans by the digest of a canonical text.

Texts and known licences go through the same steps: lower case, copyright lines
dropped, punctuation and white space to single spaces, equivalent spellings to one.
The SHA-256 of the result is joined to the digests of the known licences, once for the
whole text and once for each of its lines, so that a one-line statement within a
document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, small
from palimpsest.llm.license_texts import SPELLINGS, TEXTS

#: A line that only names holders and years: "copyright" alone may begin any line of a sentence, so a sign or year has to follow.
COPYRIGHT = r"(?m)^[^\p{L}\n©]*(?:©|(?:\(c\)|copyright\b)[^\n]*(?:©|\b(?:19|20)[0-9]{2}\b|[\[<{](?:yyyy|year))|copyright\b[ \t:,]*\(c\)|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """``text`` in canonical words, with a space on either side of each word and line feeds kept."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", " \n "), F.lit(" "))
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``digest, license_id`` for the known licences; those alike in digest keep the least name."""
    rows = list((TEXTS if texts is None else texts).items())
    made = spark.createDataFrame(rows, "license_id string, text string")
    return made.select(F.sha2(squeeze(canonical_lines(F.col("text"))), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """``doc_id, digest, license_id, statements, licensed`` for every row of ``docs(doc_id, text, ...)``.

    ``digest`` is that of the whole canonical text, ``license_id`` the licence with
    that digest or null, ``statements`` the sorted licences equal to the whole text
    or one of its lines. Null, empty and wordless texts have the digest of the empty
    text and no licence. Equal rows get a row each; a null doc_id stays null.
    ``licenses(digest, license_id)`` is broadcast only if its row count allows it.
    """
    text = F.col("text").cast("string")
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), canonical_lines(text).alias("c"))
    whole = F.sha2(squeeze(F.col("c")), 256)
    lines = F.transform(F.split("c", "\n", -1), lambda x: F.sha2(F.trim(x), 256))
    # Written once: the canonical text is far dearer than its digests.
    digests = materialize(shaped.select("doc_id", "text_hash", whole.alias("digest"), F.when(F.trim("c") != "", F.array_distinct(F.array_append(lines, whole))).alias("all")), "digests")
    wanted = small(licenses.where(F.col("digest") != F.sha2(F.lit(""), 256)).select(F.col("digest").alias("one"), "license_id"))
    hits = digests.select("doc_id", "text_hash", F.explode("all").alias("one")).join(wanted, "one")
    by_text = hits.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "text_hash").agg(F.array_sort(F.collect_set("license_id")).alias("statements"))
    named = digests.join(wanted.withColumnRenamed("one", "digest"), "digest", "left").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "doc_id", "text_hash", "digest", "license_id")
    out = named.join(by_text, ["k", "text_hash"], "left")
    found = F.coalesce("statements", F.array().cast("array<string>"))
    return out.select("doc_id", "digest", "license_id", found.alias("statements"), (F.size(found) > 0).alias("licensed"))
