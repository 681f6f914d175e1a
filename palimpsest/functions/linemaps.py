"""Maps of lines between versions that compose: sorted pieces of (first line, number of lines, target, kind).

A piece of kind ``SHIFT`` maps its lines to target, target + 1, ...; ``CONST`` maps them all to
target; ``OWNED`` ends them, with a position as target. Lines in no piece end without one. Composition is
associative, so that a long history's maps can be put together in any grouping.
"""

from __future__ import annotations

import difflib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

from palimpsest.functions.lines import deleted, diff, forward

SHIFT, CONST, OWNED = 0, 1, 2
Piece = tuple[int, int, int, int]


def merged(pieces: Iterable[Piece]) -> list[Piece]:
    """Neighbours that go on in the same way as one piece."""
    out: list[Piece] = []
    for first, size, target, kind in pieces:
        if out:
            a, n, t, k = out[-1]
            if k == kind and a + n == first and target == (t + n if kind == SHIFT else t):
                out[-1] = (a, n + size, t, k)
                continue
        out.append((first, size, target, kind))
    return out


def blame_map(old: list[str], new: list[str], position: int) -> list[Piece]:
    """Lines of ``new`` to those of ``old`` that they are; the others are owned by ``position``."""
    ops = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    return merged((k + 1, m - k, i + 1, SHIFT) if tag == "equal" else (k + 1, m - k, position, OWNED) for tag, i, _, k, m in ops if m > k)


def origin_map(old: list[str], new: list[str]) -> list[Piece]:
    """Lines of ``new`` to where they were in ``old``: changed ones to the first line that their edit removed, introduced ones end."""
    ops = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    return merged((k + 1, m - k, i + 1, SHIFT if tag == "equal" else CONST) for tag, i, _, k, m in ops if m > k and tag != "insert")


def step_forward(old: list[str], new: list[str], hunks: list, line: int) -> tuple[str, int | None]:
    """What became of a line of ``old``: as ``lines.forward``, and ``moved`` for a deleted line that stands once in both."""
    event, after = forward(hunks, line, old == new)
    if event == "deleted" and len(old[line - 1].strip()) > 2 and new.count(old[line - 1]) == 1 and old.count(old[line - 1]) == 1:
        return "moved", new.index(old[line - 1]) + 1
    return event, after


def fate_map(old: list[str], new: list[str]) -> list[Piece]:
    """Lines of ``old`` to where they are in ``new``, kept or moved; the others end."""
    gone, was, there = set(deleted(diff(old, new))), Counter(old), {}
    for k, x in enumerate(new, 1):
        there[x] = 0 if x in there else k
    out = []
    for tag, i, j, k, _ in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            out.append((i + 1, j - i, k + 1, SHIFT))
            continue
        # As ``step_forward`` tells for each line, which would look through the whole versions.
        for line in range(i + 1, j + 1):
            x = old[line - 1]
            if line in gone and len(x.strip()) > 2 and was[x] == 1 and there.get(x):
                out.append((line, 1, there[x], CONST))
    return merged(out)


def at(pieces: list[Piece], line: int) -> tuple[int, int] | None:
    """Target and kind of a line."""
    k = bisect_right(pieces, line, key=lambda p: p[0]) - 1
    if k < 0 or line >= pieces[k][0] + pieces[k][1]:
        return None
    first, _, target, kind = pieces[k]
    return (target + line - first if kind == SHIFT else target), kind


def compose(one: list[Piece], two: list[Piece]) -> list[Piece]:
    """The map that does ``one``, then ``two``."""
    starts, out = [p[0] for p in two], []
    for first, size, target, kind in one:
        if kind == OWNED:
            out.append((first, size, target, kind))
        elif kind == CONST:
            found = at(two, target)
            if found:
                out.append((first, size, found[0], CONST if found[1] == SHIFT else found[1]))
        else:
            k = max(bisect_right(starts, target) - 1, 0)
            while k < len(two) and two[k][0] < target + size:
                a, n, t, to = two[k]
                low, high = max(a, target), min(a + n, target + size)
                if low < high:
                    out.append((first + low - target, high - low, t + low - a if to == SHIFT else t, to))
                k += 1
    return merged(out)
