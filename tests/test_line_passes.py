"""One pass over a diff against asking for each of its lines."""

from __future__ import annotations

import difflib
import random

import pytest

from palimpsest.functions import linemaps
from palimpsest.functions.lines import Hunk, back, deleted, diff, forward, not_unchanged, removed


class Counting(list):
    counted = 0

    def count(self, x):
        self.counted += 1
        return super().count(x)


@pytest.mark.parametrize("context", [0, 3])
def test_passes_equal_single_lines(context):
    r = random.Random(3)
    for _ in range(200):
        old, new = ([r.choice("abcde") * 3 for _ in range(r.randrange(12))] for _ in range(2))
        new = old[: r.randrange(12)] + new if r.random() < 0.5 else new
        hunks = diff(old, new, context)
        assert not_unchanged(hunks, len(new), old == new) == [k for k in range(1, len(new) + 1) if back(hunks, k, old == new)[0] != "unchanged"]
        assert deleted(hunks) == [k for k in range(1, len(old) + 1) if forward(hunks, k, old == new)[0] == "deleted"]
    assert not_unchanged([], 3) == [1, 2, 3] and not_unchanged([Hunk(1, 1, 1, 2, ("+a",))], 2) == [1, 2]


def test_a_long_version_is_compared_once(monkeypatch):
    old, new = ([f"{k} {v}" for k in range(400)] for v in "ab")
    calls, real = [], difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a, **b: calls.append(1) or real(*a, **b))
    asked = Counting()
    assert linemaps.fate_map(old[:200], asked) == [] and asked.counted == 0
    assert len(not_unchanged(diff(old, new, 0), 400)) == 400 and len(calls) == 3


@pytest.mark.parametrize("context", [0, 3])
def test_removed_lines_in_one_pass(context):
    """as asking for each line of the old version."""
    r = random.Random(4)
    for _ in range(200):
        old, new = ([r.choice("abcde") * 3 for _ in range(r.randrange(12))] for _ in range(2))
        hunks = diff(old, new, context)
        assert removed(hunks) == [k for k in range(1, len(old) + 1) if forward(hunks, k, old == new)[0] in ("deleted", "rewritten")]
    assert removed([]) == [] and removed([Hunk(1, 1, 1, 2, ("-a",))]) == []
