"""Patterns of a dialect without look-around and backreferences, as Java's regular expressions understand them."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

MOST_BYTES = 16_384
#: ASCII classes by name, as members of a class (fixed values).
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
GROUP = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_][A-Za-z0-9_]*)>|(?P<flags>[imsx]*(?:-[imsx]+)?)(?P<end>[:)]))")
PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)([^{}]+)\}|([A-Z]))")
QUANTIFIER = re.compile(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??")


def _compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # the gateway's own kinds, or PySpark's where it converts them
        if isinstance(e, PySparkException) or type(e).__name__ == "Py4JJavaError":
            return False
        raise
    return True


def _property(spark: SparkSession, found: re.Match) -> str:
    kind, negated, name, letter = found.groups()
    kind = {"p": "P", "P": "p"}[kind] if negated else kind
    key, _, value = (name or letter).rpartition("=")
    # A category, a script or a binary property by its bare name.
    tried = [f"{key.lower()}={value}"] if key else [f"{n}" for n in (value, f"Is{value}", f"gc={value}", f"sc={value}")]
    fits = next((n for n in tried if _compiles(spark, rf"\p{{{n}}}")), None)
    if fits is None:
        raise ValueError(f"no such property of characters: {value}")
    return rf"\{kind}{{{fits}}}"


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for ``rlike``: Unicode classes, only line feeds end lines.

    Named groups may be written ``(?P<n>...)``, scripts ``\\p{Greek}``, ASCII classes ``[[:alpha:]]``, code points
    ``\\u{e9}``. Refused are look-around, backreferences, atomic groups, repeated quantifiers (possessive in Java), flags beyond
    i, m, s and x, differences of classes, line feeds, the empty pattern and more than 16,384 bytes.
    """
    if not pattern or "\n" in pattern:
        raise ValueError("a pattern is not empty and has no line breaks")
    if len(pattern.encode()) > MOST_BYTES:
        raise ValueError("the pattern is too long")
    out, k, depth, quantified = [], 0, 0, False
    while k < len(pattern):
        c, rest, again = pattern[k], pattern[k:], False
        if c == "\\":
            if depth == 0 and re.match(r"\\(?:[1-9]|k[<{'])", rest):
                raise ValueError("backreferences are not supported")
            if found := PROPERTY.match(pattern, k):
                out.append(_property(spark, found))
                k = found.end()
            elif found := re.compile(r"\\u\{([0-9A-Fa-f]+)\}").match(pattern, k):
                out.append(rf"\x{{{found[1]}}}")
                k = found.end()
            elif len(rest) > 1 and rest[1] in "QEGZXRhHvVNc":  # mean other things in Java, or nothing here
                raise ValueError(f"no such escape: {rest[:2]}")
            else:
                out.append(rest[:2])
                k += 2
        elif depth and (found := re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, k)):
            if found[2] not in POSIX:
                raise ValueError(f"no such class: {found[2]}")
            out.append(f"[{found[1]}{POSIX[found[2]]}]")
            k = found.end()
        elif depth and rest[:2] in ("--", "~~"):
            raise ValueError("differences of classes are not supported")
        elif c == "[":
            # A bracket that closes nothing, right at the beginning, is a member.
            head = re.compile(r"\[\^?\]?").match(pattern, k)[0]
            out.append(head[:-1] + r"\]" if head.endswith("]") else head)
            depth, k = depth + 1, k + len(head)
        elif c == "]" and depth:
            out.append(c)
            depth, k = depth - 1, k + 1
        elif c == "(" and not depth and rest.startswith("(?"):
            found = GROUP.match(pattern, k)
            if not found:
                raise ValueError("look-around, atomic groups and such flags are not supported")
            out.append(f"(?<{found['name'].replace('_', 'U')}>" if found["name"] else found[0])
            k = found.end()
        elif not depth and (found := QUANTIFIER.match(pattern, k)) and k:
            if quantified:
                raise ValueError("a quantifier follows another")
            out.append(found[0])
            k, again = found.end(), True
        else:
            out.append(c)
            k += 1
        quantified = again
    made = f"(?dU){''.join(out)}"
    if not _compiles(spark, made):
        raise ValueError(f"not a pattern: {pattern}")
    return made
