from __future__ import annotations

import re

from palimpsest.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        words = split(t)
        n = min(8, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == words[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def make(spark):
    items = [(1, "One two three four five six seven eight nine ten"), (2, "tiny item"), (10, "Eight, nine TEN eleven twelve thirteen fourteen fifteen"), (3, ""), (4, None), (None, "lost words")]
    texts = [
        "so one two three four five six seven eight nine, ten! eleven twelve thirteen fourteen fifteen end", "a tiny-item and Tiny ITEM.", "tiny", None, "", "ÉÉ one two three four five six seven eight",
        "one two three four five six seven", "lost words " * 5000,
    ]
    return (
        items,
        texts,
        spark.createDataFrame([(k, t, 5, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_hit int, items string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_scan_join_and_brute_force_agree(spark):
    items, texts, docs, bench = make(spark)
    known = [(i, t) for i, t in items if i is not None]
    for most in (d.WINDOWS, 0):
        rows = d.scan_documents(docs, bench, keep=["doc_id"], spans=True, most_windows=most).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"]) == slow(texts[r.doc_id], known), (most, r)
            assert len(r.hits) == r.n_hit


def test_report_and_clean(spark, docs, none):
    items, texts, own, bench = make(spark)
    flagged = {r.doc_id: r.contaminated for r in d.report(own, bench).collect()}
    assert [k for k, v in flagged.items() if v] == [0]
    cleaned = {r.doc_id: r.text for r in d.clean(own, bench).collect()}
    assert 0 not in cleaned and cleaned[1] == "a and " and cleaned[2] == "tiny" and cleaned[3] is None and cleaned[5] == "ÉÉ "
    same = d.clean(docs, bench.limit(0))
    assert same.schema == docs.schema and sorted(map(repr, same.collect())) == sorted(map(repr, docs.collect()))
    assert d.report(none, bench).count() == 0
