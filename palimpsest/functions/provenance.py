"""What commit messages state: reverts, reasons, retries and references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a subject or mark a sentence.
REVERTS = ("revert", "rollback", "roll back", "back out")
CORRECTIONS = (*REVERTS, "fix", "correct", "restore", "follow-up", "followup", "re-land", "reland", "re-landed", "un-revert")
CAUSES = ("because", "since ", "due to", "reason:", "why:", "root cause", "caused by", "so that", "therefore", "thus ", "could not", "cannot ", "can't ")
HARMS = (
    "fails", "failed", "breaks", "broke", "bricking", "bricked", "regression", "no longer", "silently", "slowed", "slows", "clobber", "corrupt", "leak",
    "race", "overhead", "stall", "hangs", "flaky", "unstable",
)
RETRIES = (
    "re-land criteria:", "reland criteria:", "re-land:", "retry condition:", "safe retry:", "retry:", "workaround:", "should be re-addressed", "to retry",
)
DECLARATIONS = ("this reverts commit", "this is a revert of commit", "this is a revert of the code changes in commit", "reverts the changes from commit")
LEAST, MOST = 24, 240


def _opens(subject: Column, marks: tuple[str, ...]) -> Column:
    return F.lower(subject).rlike(r"^\s*(" + "|".join(m.replace("-", r"\-") for m in marks) + ")")


def is_revert_subject(subject: Column) -> Column:
    return _opens(subject, REVERTS)


def is_corrective_subject(subject: Column) -> Column:
    return _opens(subject, CORRECTIONS)


def sentences(text: Column) -> Column:
    """Sentences of a message: wrapped lines joined, split after an ender and white space or at blank lines."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r", ""), r"(?<=\S)[ \t]*\n(?=[ \t]*\S)", " ")
    return F.filter(F.transform(F.split(joined, r"(?<=[.!?])\s+|\n\s*\n?", -1), lambda s: F.trim(s)), lambda s: s != "")


def revert_targets(message: Column) -> Column:
    """Object ids (7 or more hex digits) that sentences declare as reverted, in order."""
    named = F.concat(F.lit(""), F.lower(message))
    plain = r"^(?:" + "|".join(DECLARATIONS) + r") ([0-9a-f]{7,})"
    because = r"^reverted ([0-9a-f]{7,})\s+because [^\s.!?]"
    pick = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, plain, 1), F.lit("")), F.nullif(F.regexp_extract(s, because, 1), F.lit("")))
    return F.filter(F.transform(sentences(named), pick), lambda x: x.isNotNull())


def _marked(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(F.lower(text), F.lit(m))
    return found


def bounded(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def stated_reason(message: Column) -> Column:
    """The first sentence of 24 characters or more that states a cause or a harm, at most 240 characters of it; else null."""
    return bounded(F.get(F.filter(sentences(message), lambda s: (F.length(s) >= LEAST) & _marked(s, CAUSES + HARMS)), F.lit(0)), MOST)


def stated_retry(message: Column) -> Column:
    """The first sentence that says how to try again, without the marker that opens it; else null."""
    found = F.get(F.filter(sentences(message), lambda s: _marked(s, RETRIES)), F.lit(0))
    return bounded(F.regexp_replace(found, "^(?i)(" + "|".join(m for m in RETRIES if m.endswith(":")) + r")\s*", ""), MOST)


def references(message: Column) -> Column:
    """Issue references such as #12, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"(?<!\S)[(\[]?(#\d+)(?=[)\].,;:!?]*(?:\s|$))"), F.lit(1))))


def explanation_strength(message: Column) -> Column:
    """One point for 24 characters or more, and up to two for causes and harms named."""
    named = sum((F.contains(F.lower(message), F.lit(m)).cast("int") for m in CAUSES + HARMS), F.lit(0))
    return (F.length(F.trim(message)) >= LEAST).cast("int") + F.least(named, F.lit(2))
