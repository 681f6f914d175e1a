"""URL rules and glob patterns judged by a bit-parallel automaton.

All patterns stand side by side in the bits of a row of 64-bit words, a bit for each
place in a pattern (multiword Shift-And with loops). A step over one byte shifts every
pattern at once, and all URLs of a batch take the step together, so that the cost is
that of (bytes of URLs) x (words of masks), however many patterns match.

Globs match a whole canonical URL, which is host and path: ``*`` any characters but a
slash, ``**`` any characters, ``?`` one character but a slash, a backslash takes the
next character as it is. Since a host has no slash, a leading ``*`` stays within it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower

#: Bits of all patterns together; the masks take 4 kB for each 64 of them and go to every task.
MOST_BITS = 1 << 17
#: Words of state that are held at a time, 8 MB.
STATE_WORDS = 1 << 20

SLASH, HIGH, CONTINUED = ord("/"), 0x80, range(0x80, 0xC0)


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains, if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        whole = "".join(f"\\{c}" if c in "*?\\" else c for c in str(self)) + "**"
        return whole, f"*.{whole}"


def _symbols(glob: str) -> Iterable[tuple[str, bytes]]:
    """``("byte", b"x")`` for each byte to match, ``("one", b"")``, ``("run", b"")`` or ``("all", b"")``."""
    k = 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            yield "all", b""
            k += 1
        elif c == "*":
            yield "run", b""
        elif c == "?":
            yield "one", b""
        else:
            if c == "\\" and k + 1 < len(glob):
                k += 1
                c = glob[k]
            yield from (("byte", bytes([b])) for b in c.encode())
        k += 1


class Automaton:
    """Finds, for each byte string, the first of ``globs`` that matches all of it."""

    def __init__(self, globs: Iterable[str]) -> None:
        parsed = [list(_symbols(g)) for g in globs]
        places = [1 + sum(kind in ("byte", "one") for kind, _ in p) for p in parsed]
        bits = sum(places)
        if bits > MOST_BITS:
            raise ValueError(f"patterns of {bits} bits, more than {MOST_BITS}")
        self.words = max(1, -(-bits // 64))
        steps, loops = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        first, last = np.zeros(bits, bool), np.zeros(bits, bool)
        at = 0
        for p, size in zip(parsed, places, strict=True):
            first[at] = last[at + size - 1] = True
            for kind, byte in p:
                if kind == "all":
                    loops[:, at] = True
                elif kind == "run":
                    loops[np.arange(256) != SLASH, at] = True
                elif kind == "byte":
                    at += 1
                    steps[byte[0], at] = True
                else:  # a character begins with any byte that continues none, and goes on with those that do
                    at += 1
                    steps[[b for b in range(256) if b not in CONTINUED and b != SLASH], at] = True
                    loops[CONTINUED, at] = True
            at += 1
        self.steps, self.loops = self._packed(steps), self._packed(loops)
        self.first, self.last = self._packed(first[None])[0], self._packed(last[None])[0]
        #: The pattern that each bit belongs to.
        self.owner = np.repeat(np.arange(len(places)), places)

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64 * self.words), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def match(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of the first pattern for each string ``data[start : start + size]``, -1 for none."""
        out = np.full(len(sizes), -1, np.int32)
        most = max(1, STATE_WORDS // self.words)
        order = np.argsort(-sizes, kind="stable")  # those still going on come first
        for k in range(0, len(order), most):
            rows = order[k : k + most]
            out[rows] = self._together(data, starts[rows], sizes[rows])
        return out

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        state = np.repeat(self.first[None], len(sizes), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        going = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        for place, n in enumerate(going.tolist()):
            now, byte = state[:n], data[starts[:n] + place]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.steps[byte]
            now &= self.loops[byte]
            now |= moved
        state &= self.last
        found = state != 0
        word = found.argmax(axis=1)
        held = state[np.arange(len(state)), word]
        lowest = np.frexp((held & (~held + one)).astype(np.float64))[1] - 1
        return np.where(found.any(axis=1), self.owner[np.minimum(64 * word + np.maximum(lowest, 0), len(self.owner) - 1)] if len(self.owner) else -1, -1)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty for null or where there is no ``://``.

    The host goes from behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path from there up to ``?``, ``#`` or the end.
    """
    text = url.cast("string")
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[Rule], globs: Iterable[tuple[str, str]] = (), otherwise: str = "allow") -> DataFrame:
    """``pages`` with columns ``host``, ``path``, ``rule`` and ``verdict`` put last, in the place of columns of those names.

    Of the rules that fit, the one of most characters wins, of equally long ones that of the
    longer host, then one that blocks. ``rule`` names it, else is null; then the first glob
    that matches gives its verdict, else ``otherwise``. Null and malformed URLs have an empty
    host and path, which no rule fits. Rows are independent of each other, so that
    ties and repeated rows are no matter; rules and globs have a bound of ``MOST_BITS``.
    """
    ranked = sorted(rules, key=lambda r: (-len(str(r)), -len(r.host), r.verdict != "block", str(r)))
    listed = [(g, str(r), r.verdict) for r in ranked for g in r.globs()] + [(g, None, v) for g, v in globs]
    Automaton(g for g, _, _ in listed)  # refuses too many before any job
    patterns, held = tuple(g for g, _, _ in listed), []

    @F.arrow_udf("int")
    def first_match(url: pa.Array) -> pa.Array:
        if not held:
            held.append(Automaton(patterns))
        raw = url.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], "<i8", len(raw) + 1, 8 * raw.offset)
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] and raw.buffers()[2].size else np.zeros(1, np.uint8)
        return pa.array(held[0].match(data, ends[:-1], np.diff(ends)), pa.int32())

    host, path = parts(F.col("url"))
    named = lambda k: F.array(*[F.lit(x[k]).cast("string") for x in listed]) if listed else F.array().cast("array<string>")
    told = pages.select(F.struct("*").alias("__row"), host.alias("__host"), path.alias("__path"))
    found = told.withColumn("__k", first_match(F.concat("__host", "__path")))
    mine = ("host", "path", "rule", "verdict")
    kept = [F.col(f"__row.`{f}`").alias(f) for f in pages.columns if f not in mine]
    verdict = F.when(F.col("__k") >= 0, F.get(named(2), F.col("__k"))).otherwise(otherwise)
    return found.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.when(F.col("__k") >= 0, F.get(named(1), F.col("__k"))).alias("rule"), verdict.alias("verdict"))
