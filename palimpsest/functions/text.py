"""Tokens, identifiers and paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point ranges of scripts written without spaces.
CJK = (
    r"\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    r"\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff66}-\x{ff9d}\x{20000}-\x{323af}"
)
ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Places between letters where a word ends within an identifier.
BOUNDARY = "|".join(
    [
        r"(?<=\p{IsLowercase})(?=\p{IsUppercase})",
        r"(?<=\p{IsAlphabetic})(?=\p{N})",
        r"(?<=\p{N})(?=\p{IsAlphabetic})",
        r"(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})(?<=\p{IsUppercase}{2})",
        rf"(?<=[{CJK}])(?=[^{CJK}\s])",
        rf"(?<=[^{CJK}\s])(?=[{CJK}])",
    ]
)
#: Identifiers and literals that say nothing about a change.
COMMON_NAMES = ("to_string", "to_owned", "is_empty", "Some", "unwrap_or_default", "assert_eq", "assert_ne")
COMMON_LITERALS = ("string", "default", "true", "false", "success", "message", "result", "status", "error")


#: Words that end nowhere within: lower-case letters after at most one capital.
PLAIN = r"^\p{Lu}?\p{Ll}+$"


def logical_terms(text: Column) -> Column:
    """Lower-case words in order, each once: split at anything but letters and digits, at case
    changes within identifiers, between letters and digits, and where a spaceless script begins or ends."""
    words = F.array_distinct(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[^{ALNUM}]+", -1), ""))
    # Only words that may have such places are searched for them.
    apart = F.flatten(F.transform(words, lambda w: F.when(w.rlike(PLAIN), F.array(w)).otherwise(F.split(w, BOUNDARY, -1))))
    return F.array_distinct(F.transform(F.array_remove(apart, ""), F.lower))


def is_cjk(term: Column) -> Column:
    return term.rlike(f"^[{CJK}]+$")


def only_cjk(term: str) -> bool:
    """``is_cjk`` of a term of a query."""
    chars = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), CJK)
    return re.fullmatch(f"[{chars}]+", term) is not None


def _fragments(term: Column, single: bool) -> Column:
    chars = F.split(term, "")
    pairs = F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(chars, pairs) if single else pairs


def tokens(text: Column) -> Column:
    """Logical terms, and for spaceless scripts their characters and pairs of characters too."""
    return F.array_distinct(F.flatten(F.transform(logical_terms(text), lambda t: F.when(is_cjk(t), F.concat(F.array(t), _fragments(t, True))).otherwise(F.array(t)))))


def query_alternatives(text: Column) -> Column:
    """What a full-text match of a query looks for: terms, and pairs of characters of long spaceless ones."""
    return F.array_distinct(F.flatten(F.transform(logical_terms(text), lambda t: F.when(is_cjk(t) & (F.length(t) > 1), F.concat(F.array(t), _fragments(t, False))).otherwise(F.array(t)))))


def searchable(text: Column) -> Column:
    """The text, and on a further line its tokens if it has any."""
    found = tokens(text)
    return F.when(F.size(found) > 0, F.concat(text, F.lit("\n"), F.array_join(found, " "))).otherwise(text)


def term_hits(query: Column, haystack: Column, texts: Column) -> Column:
    """``exact`` and ``partial`` counts of the terms ``query`` found in tokens or, if spaceless, in the texts or by pairs."""
    exact = lambda t: F.when(is_cjk(t), F.exists(texts, lambda x: F.contains(x, t))).otherwise(F.array_contains(haystack, t))
    partial = lambda t: ~exact(t) & is_cjk(t) & (F.array_contains(haystack, t) | F.arrays_overlap(_fragments(t, False), haystack))
    return F.struct(F.size(F.filter(query, exact)).alias("exact"), F.size(F.filter(query, partial)).alias("partial"))


def distinctive_signals(text: Column) -> Column:
    """Sorted identifiers of several words and quoted literals that are telling enough to associate changes by."""
    names = F.split(text, f"[^{ALNUM}_]+", -1)
    name = lambda x: (F.octet_length(x).between(8, 96)) & ((F.size(tokens(x)) >= 2) | F.contains(x, F.lit("_"))) & ~x.isin(*COMMON_NAMES)

    def quoted(mark: str) -> Column:
        pieces = F.filter(F.split(text, mark, -1), lambda x, i: i % 2 == 1)
        good = lambda x: F.octet_length(x).between(6, 96) & x.rlike(r"\p{IsAlphabetic}") & ~x.rlike(r"\p{IsWhite_Space}") & ~x.isin(*COMMON_LITERALS)
        return F.transform(F.filter(pieces, good), lambda x: F.concat(F.lit(mark), x, F.lit(mark)))

    return F.array_sort(F.array_distinct(F.concat(F.filter(names, name), quoted('"'), quoted("'"))))


def normalize_path(path: Column) -> Column:
    """Forward slashes, ASCII lower case, no leading ``./`` and no slashes at the ends."""
    low = F.translate(F.replace(path, F.lit("\\"), F.lit("/")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, r"^(\./)+", ""), "^/+|/+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def path_matches(query: str, path: Column) -> Column:
    """A query path names a changed path: all of it, or its last part if the query has no slash."""
    p = normalize_path(path)
    return (p == query) | (basename(p) == query) if "/" not in query else p == query


def is_test_path(path: Column) -> Column:
    """Paths shaped like tests: a test directory, or a file name with a test's prefix, suffix or infix."""
    return normalize_path(path).rlike(r"(^|/)(test|tests|__tests__|spec)/|(^|/)test[_-][^/]*$|(^|/)[^/]*(_test|_spec)(\.[^./]*)?$|(^|/)[^/]*\.(test|spec)\.[^/]*$")


def message_parts(message: Column) -> Column:
    """``subject`` (the first line, without a carriage return) and ``body`` (the rest)."""
    subject = F.regexp_replace(F.substring_index(message, "\n", 1), "\r$", "")
    body = F.when(F.contains(message, F.lit("\n")), F.substr(message, F.instr(message, "\n") + 1)).otherwise("")
    return F.struct(subject.alias("subject"), body.alias("body"))
