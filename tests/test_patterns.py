from __future__ import annotations

import pytest

from palimpsest.functions.patterns import java_pattern
from palimpsest.operators.search import by_regex

LINES = ["CaseWord", "café Élan", "greek αβ", "crlf\r", "", "a]b", "tab\tx", "b\u0085", "it is\u2028so", "x1_y", "back\\1", "(?=odd)"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(LINES)], "doc_id long, line_no int, content string")


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        (r"^CaseWord$", [0]), (r"^caseword$", []), (r"(?i)^caseword$", [0]), (r"(?i)^café élan$", [1]), (r"\p{Greek}+", [2]), (r"^(CaseWord|crlf)$", [0, 3]), (r"^$", [4]), (r"^", list(range(12))),
        (r"\p{Lu}[a-z]+", [0, 1]), (r"\pL{5}\b", [0, 2]), (r"\x{41}|\u{E9}", [1]), (r"(?P<one_n>Case)(?P<two>Word)", [0]), (r"[[:alpha:]]é", [1]), (r"^[[:alpha:]]+$", [0, 3]), (r"^[[:^alpha:]]*$", [4]), (r"[]x]b", [5]), (r"[^]a-z]", [0, 1, 2, 6, 7, 8, 9, 10, 11]),
        (r"\\1$", [10]), (r"\(\?=", [11]), (r"[(?=]", [11]), (r"b.$", [7]), (r"s.so", [8]), (r"\w\W\w+ ?", [1, 2, 5, 6, 8, 10]), (r"\P{^Greek}", [2]), (r"\p{script=Greek}", [2]), (r"\p{gc=Nd}", [9, 10]), (r"\d_\w", [9]), (r"a{1,2}?f", [1]), (r"x*1", [9, 10]),
    ],
)
def test_patterns_match(lines, pattern, found):
    assert sorted(r.line_no for r in by_regex(lines, pattern, None).collect()) == found


@pytest.mark.parametrize("pattern", ["", "a\nb", r"(?=a)", r"(?<!a)b", r"(?>a)", r"(a)\1", r"(?<n>a)\k<n>", r"(?-u:\xff)", r"(?U)a", "a++", "(", "[a", r"\p{Nowhere}", r"[[:nothing:]]", r"[a--b]", r"\Qa\E", "x" * 20_000])
def test_patterns_are_refused(spark, pattern):
    with pytest.raises(ValueError):
        java_pattern(spark, pattern)
