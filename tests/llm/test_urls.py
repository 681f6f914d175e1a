from __future__ import annotations

import random
import re

import numpy as np
import pytest

from palimpsest.llm import urls
from palimpsest.llm.queries import GLOBS, RULES


def plain(glob: str) -> re.Pattern:
    """The glob as a regular expression over characters."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + "(?s:.*)", k + 1
        elif glob[k] == "*":
            out += "[^/]*"
        elif glob[k] == "?":
            out += "[^/]"
        else:
            k += glob[k] == "\\" and k + 1 < len(glob)
            out += re.escape(glob[k])
        k += 1
    return re.compile(out)


def matched(globs, texts):
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    return urls.Automaton(globs).match(np.frombuffer(b"".join(raw) or b"\0", np.uint8), starts, sizes).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_first_match_by_regular_expressions(seed):
    r = random.Random(seed)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    globs = [word(9, "ab/*?é\\.") for _ in range(60)] + ["x" * 70 + "*", "**" + "y" * 130]
    texts = [word(12, "ab/é.*") for _ in range(400)] + ["", "x" * 75, "x" * 69, "z/" + "y" * 130, "é" * 40]
    want = [next((k for k, g in enumerate(globs) if plain(g).fullmatch(t)), -1) for t in texts]
    assert matched(globs, texts) == want


def test_no_patterns_and_too_many():
    assert matched([], ["a", ""]) == [-1, -1]
    with pytest.raises(ValueError, match="more than"):
        urls.Automaton(["x" * urls.MOST_BITS])


def judged(url):
    """Host, path, rule and verdict by plain code."""
    rest = url.partition("://")[2] if url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
    if fit:
        best = max(fit, key=lambda x: len(str(x)))
        return host, path, str(best), best.verdict
    return host, path, None, next((v for g, v in GLOBS if plain(g).fullmatch(host + path)), "allow")


URLS = [
    None, "", "no scheme/at all", "http://", "https://example.com", "https://example.com/", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/", "https://www.example.com/en/1?a=/es/",
    "https://notexample.com/en/", "https://a.b.net/es/1", "https://net/es/", "https://net/ES/", "https://xnet/es/", "https://a.net/fr/#x", "https://a.net/fr", "https://evil.org/x.example.com/en/", "ftp://a.org?x://b.net/es/",
    "https://évil.net/es/é", "https://a.net\n/es/", "https://big-casino.org/x", "https://x.org/casino", "https://" + "a." * 4000 + "net/es/" + "y" * 9000, "https://İ.COM/",
]


def test_rules_by_plain_code(spark):
    """Nulls, malformed and very long URLs, ties, repeated rows, clashing names and no rows."""
    rows = [(k, u, "mine", "old") for k, u in enumerate(URLS + URLS[4:6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, extra string")
    got = urls.judge(pages, RULES, GLOBS)
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    assert [tuple(r)[3:] for r in got.orderBy("page_id").collect()] == [judged(u) for _, u, _, _ in rows]
    assert urls.judge(pages.limit(0), RULES, GLOBS).count() == 0
    none = urls.judge(pages, [], otherwise="block").select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "block")]


def test_ties_go_to_longer_hosts_then_to_blocks(spark):
    pages = spark.createDataFrame([("x://b.a/c/",), ("x://b.a/d",)], "url string")
    rules = [urls.Rule("a", "/c/b.", "allow"), urls.Rule("a", "/c/", "allow"), urls.Rule("a", "/c/", "block"), urls.Rule("b.a", "/", "allow"), urls.Rule("a", "/d", "block")]
    assert sorted(tuple(r) for r in urls.judge(pages, rules).select("url", "rule", "verdict").collect()) == [("x://b.a/c/", "b.a/", "allow"), ("x://b.a/d", "b.a/", "allow")]
