"""Texts of a megabyte without a break, shorter where they hold many matches, through the operators that look for patterns in them."""

from __future__ import annotations

import random
import re
import string
import time

import pytest

from palimpsest.llm import private

MB = 1 << 20
r = random.Random(1)
LONG = {
    "digits": "7" * MB,
    "spaced digits": "1 2 3 4-" * (MB // 64),
    "letters": "a" * MB,
    "dots": "." * MB,
    "base64": "".join(r.choices(string.ascii_letters + string.digits + "+/", k=MB)),
    "labels": "a@" + "b." * (MB // 2),
    "signs": "a@b." * (MB // 4),
    "secrets": "token = " * (MB // 8),
    "octets": "1.2.3." * (MB // 48),
    "dates": "1977-03-24-" * (MB // 88),
    "phones": "+1 (212) " * (MB // 9),
}


@pytest.mark.parametrize("kind", LONG)
def test_no_text_ends_a_task(spark, kind):
    text = LONG[kind]
    mail, card = "jane.doe@example.com", "4111 1111 1111 1111"
    began = time.monotonic()
    rows = {x.doc_id: x for x in private.pseudonymize(spark.createDataFrame([(1, text), (2, f"{mail} {text} x {card}")], "doc_id long, text string"), "k").collect()}
    assert time.monotonic() - began < 60
    out = rows[2].text
    assert mail not in out and "@example.invalid" in out and card not in out and rows[2].n_replaced >= 2
    if kind in ("digits", "letters", "dots"):
        assert rows[1].n_replaced == 0 and rows[1].text == text
    assert re.search("[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}$", out)


def test_many_cards_in_one_run(spark):
    cards = "4111111111111111 " * 2000
    (row,) = private.pseudonymize(spark.createDataFrame([(1, cards.strip())], "doc_id long, text string"), "k").collect()
    assert row.n_replaced == 2000 and len(set(row.text.split())) == 1 and len(row.text) == len(cards) - 1
