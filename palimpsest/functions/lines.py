"""How lines map across hunks: pure functions for the grouped folds."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Hunk:
    old_start: int
    old_lines: int
    new_start: int
    new_lines: int
    rows: tuple[str, ...]

    @property
    def sound(self) -> bool:
        """Rows agree with the counts of the header."""
        signs = [r[:1] for r in self.rows if r[:1] != "\\"]
        context = signs.count(" ")
        return signs.count("-") + context == self.old_lines and signs.count("+") + context == self.new_lines


HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_hunk(text: str) -> Hunk | None:
    """A hunk from its text, header first; a missing length is 1."""
    head, _, rest = text.partition("\n")
    found = HEADER.match(head)
    if not found:
        return None
    a, b, c, d = found.groups()
    rows = rest.split("\n")
    return Hunk(int(a), int(b or 1), int(c), int(d or 1), tuple(rows[:-1] if rows[-1] == "" else rows))


def diff(old: list[str], new: list[str], context: int = 3) -> list[Hunk]:
    """Hunks between two versions."""
    out = []
    for group in difflib.SequenceMatcher(None, old, new, autojunk=False).get_grouped_opcodes(context):
        rows: list[str] = []
        for tag, i, j, k, m in group:
            if tag == "equal":
                rows += [f" {x}" for x in old[i:j]]
            else:
                rows += [f"-{x}" for x in old[i:j]] + [f"+{x}" for x in new[k:m]]
        i, j, k, m = group[0][1], group[-1][2], group[0][3], group[-1][4]
        out.append(Hunk(i + (j > i), j - i, k + (m > k), m - k, tuple(rows)))
    return out


def back(hunks: list[Hunk], line: int, same: bool = False) -> tuple[str, int | None]:
    """Where a line of the new version was in the old one: ``unchanged``, ``changed``, ``introduced`` or ``unmappable``.

    A changed line maps to the first line removed in its edit block; one in a block
    without removals is introduced there. ``same``: without hunks the contents are equal.
    """
    if not hunks:
        return ("unchanged", line) if same else ("unmappable", None)
    shift = 0
    for h in sorted(hunks, key=lambda x: x.new_start):
        first = h.new_start + (h.new_lines == 0)
        if line < first:
            break
        if line < first + h.new_lines:
            if not h.sound:
                return "unmappable", None
            old, new, removed = h.old_start + (h.old_lines == 0), first, None
            for r in h.rows:
                if r[:1] == " ":
                    if new == line:
                        return "unchanged", old
                    old, new, removed = old + 1, new + 1, None
                elif r[:1] == "-":
                    removed = old if removed is None else removed
                    old += 1
                elif r[:1] == "+":
                    if new == line:
                        return ("introduced", None) if removed is None else ("changed", removed)
                    new += 1
            return "unmappable", None
        shift += h.old_lines - h.new_lines
    return "unchanged", line + shift


def not_unchanged(hunks: list[Hunk], n: int, same: bool = False) -> list[int]:
    """Those of the ``n`` lines of the new version for which ``back`` tells anything but ``unchanged``, in one pass."""
    if not hunks:
        return [] if same else list(range(1, n + 1))
    out = []
    for h in hunks:
        at = h.new_start + (h.new_lines == 0)
        if not h.sound:
            out += range(at, at + h.new_lines)
            continue
        for r in h.rows:
            if r[:1] == "+":
                out.append(at)
            at += r[:1] in ("+", " ")
    return sorted(out)


def removed(hunks: list[Hunk]) -> list[int]:
    """The lines of the old version for which ``forward`` tells ``deleted`` or ``rewritten``, in one pass."""
    out = []
    for h in hunks:
        if h.sound:
            at = h.old_start + (h.old_lines == 0)
            for r in h.rows:
                if r[:1] == "-":
                    out.append(at)
                at += r[:1] in ("-", " ")
    return sorted(out)


def deleted(hunks: list[Hunk]) -> list[int]:
    """The lines of the old version for which ``forward`` tells ``deleted``, in one pass."""
    return removed([h for h in hunks if not any(r[:1] == "+" for r in h.rows)])


def forward(hunks: list[Hunk], line: int, same: bool = False) -> tuple[str, int | None]:
    """Where a line of the old version is in the new one: ``kept``, ``deleted``, ``rewritten`` or ``unmappable``.

    A removed line counts as deleted if its hunk adds nothing, as rewritten otherwise;
    the new line is known only where one line replaces one.
    """
    if not hunks:
        return ("kept", line) if same else ("unmappable", None)
    shift = 0
    for h in sorted(hunks, key=lambda x: x.old_start):
        first = h.old_start + (h.old_lines == 0)
        if line < first:
            break
        if line < first + h.old_lines:
            if not h.sound:
                return "unmappable", None
            old, new = first, h.new_start + (h.new_lines == 0)
            minus, plus = sum(r[:1] == "-" for r in h.rows), [i for i, r in enumerate(h.rows) if r[:1] == "+"]
            for r in h.rows:
                if r[:1] == " ":
                    if old == line:
                        return "kept", new
                    old, new = old + 1, new + 1
                elif r[:1] == "-":
                    if old == line:
                        if not plus:
                            return "deleted", None
                        return "rewritten", (new if minus == 1 and len(plus) == 1 else None)
                    old += 1
                elif r[:1] == "+":
                    new += 1
            return "unmappable", None
        shift += h.new_lines - h.old_lines
    return "kept", line + shift


def track(regions: list[tuple[int, int]], hunks: list[Hunk]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]] | None:
    """Regions (first, last) of the old version as they are in the new one, and what overlapped: (old first, old last, new first, new last).

    An edit block overlaps a region if it removes one of its lines or inserts strictly
    within it; the region then takes in the block's added lines. Regions of which nothing
    is left end. None if a hunk's counts do not hold.
    """
    if not all(h.sound for h in hunks):
        return None
    blocks: list[tuple[int, int, int, int]] = []  # old first, removed, new first, added
    for h in sorted(hunks, key=lambda x: x.old_start):
        old, new, block = h.old_start + (h.old_lines == 0), h.new_start + (h.new_lines == 0), None
        for r in (*h.rows, " "):
            sign = r[:1]
            if sign == " ":
                if block:
                    blocks.append(tuple(block))
                block, old, new = None, old + 1, new + 1
            elif sign in "+-" and sign:
                block = block or [old, 0, new, 0]
                if sign == "-":
                    block[1], old = block[1] + 1, old + 1
                else:
                    block[3], new = block[3] + 1, new + 1
    kept, met = [], []
    for low, high in regions:
        lines, mine = set(), []
        at, shift = low, 0
        for first, removed, new_first, added in blocks:
            touches = (removed and first <= high and first + removed > low) or (not removed and low < first <= high)
            for x in range(at, min(high + 1, first)):
                lines.add(x + shift)
            at = max(at, first + removed)
            shift += added - removed
            if touches:
                lines.update(range(new_first, new_first + added))
                mine.append((low, high, new_first, new_first + added - 1))
        lines.update(x + shift for x in range(at, high + 1))
        if lines:
            kept.append((min(lines), max(lines)))
        met += mine
    return kept, met
