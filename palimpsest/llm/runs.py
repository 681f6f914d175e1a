"""Runs: stretches of words that repeat with a period, found and collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``least`` words and ``times`` periods long, that no neighbouring word
extends keeping period q. Two words q apart that are identical are a match at lag q; a
run of L words is an island of L - q matches in a row. So

1. the matches at every lag are counted: an exact autocorrelation by fast Fourier
   transforms for words so frequent that their pairs would be dearer, the differences of
   all pairs of places for the others;
2. matches that lie in runs of a period already found, of which the lag is a multiple,
   are taken off (they belong to no other run, as two periods can't share so long a
   stretch);
3. only lags that still have enough matches for a run get a scan for islands, by a
   sparse sample of places first, which no island can slip through.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import short_batches

#: Pairs of places whose differences are taken at a time.
PAIRS = 1 << 21
#: Samples of an island that have to match in a row before a lag is scanned in full.
SAMPLES = 8

Run = tuple[int, int, int]


def lag_matches(codes: np.ndarray, most: int) -> np.ndarray:
    """The number of i with ``codes[i] == codes[i + q]``, for q from 0 to ``most`` (0 at 0)."""
    n = len(codes)
    found = np.zeros(most + 1, np.int64)
    if most < 1 or n < 2:
        return found
    size = 1 << int(n + most).bit_length()
    count = np.bincount(codes)
    # A transform costs about 3 n log n steps of the kind of which a pair costs five.
    heavy = np.flatnonzero(count.astype(np.float64) ** 2 / 2 * 5 > 3 * size * np.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(codes == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        found[1:] = np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype(np.int64)
    rare = np.ones(len(count), bool)
    rare[heavy] = False
    places = np.argsort(codes, kind="stable")
    places = places[rare[codes[places]]]
    groups = count[rare & (count > 0)]
    # Each place of a word goes with all later ones of that word.
    later = np.repeat(np.cumsum(groups), groups) - np.arange(len(places)) - 1
    ends = np.cumsum(later)
    at = 0
    while at < len(places):
        done = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        number = later[at:until]
        left = np.repeat(np.arange(at, until), number)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(number) - number, number)
        lag = places[right] - places[left]
        found += np.bincount(lag[lag <= most], minlength=most + 1)
        at = until
    found[0] = 0
    return found


def _islands(codes: np.ndarray, lag: int, need: int) -> list[Run]:
    """Stretches with ``need`` matches in a row or more at ``lag``, as (start, length, lag)."""
    step = need // SAMPLES
    if step > 1:
        # An island holds need // step sampled places one after the other.
        apart = np.flatnonzero(codes[:-lag:step] != codes[lag::step])
        bounds = np.concatenate([[-1], apart, [-(-(len(codes) - lag) // step)]])
        if np.diff(bounds).max() - 1 < need // step:
            return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-lag] == codes[lag:]).view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    return [(s, e - s + lag, lag) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= need]


def periodic_runs(codes: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """All runs as (start, length, period), by start, then period. ``codes``: a number for each word; ``times`` is 3 or more."""
    n = len(codes)
    if n < least:
        return []
    most = n // times
    lags = np.arange(most + 1)
    need = np.maximum(np.maximum(least - lags, (times - 1) * lags), 1)
    matches = lag_matches(codes, most)
    runs: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(matches >= need).tolist():
        if q == 0 or matches[q] < need[q]:
            continue
        for start, length, _ in _islands(codes, q, int(need[q])):
            if (start, length) not in runs:  # else it has a smaller period, which divides q
                runs[start, length] = q
                multiples = np.arange(2 * q, min(length, most + 1), q)
                matches[multiples] -= length - multiples
    return sorted((s, n_words, q) for (s, n_words), q in runs.items())


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period, compared exactly; of equal ones the first, then the one of the smaller period."""
    order = lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]
    return min(runs, key=cmp_to_key(order), default=None)


def collapsed(text: bytes, least: int = 24, times: int = 3) -> tuple[bytes, list[Run]]:
    """The words of a text joined by one space, each run cut to its first period, and the runs.

    A word goes if any run holds it after that run's first period.
    """
    words = text.split()
    if len(words) < least:
        return b" ".join(words), []
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
    runs = periodic_runs(codes, least, times)
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
    return b" ".join(words), runs


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def collapse(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with the column text collapsed, and columns ``runs`` (array of start, length, period) and ``strongest`` (one of them or null) put last, in the place of columns of those names.

    Words are what stands between ASCII white space, numbered from 0. Null and blank texts
    become empty, without runs. Rows are independent of each other; a task holds one text, its
    words and their numbers at a time, beside a batch of rows.
    """
    short_batches(docs.sparkSession)
    run = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])

    def structs(rows: list) -> pa.Array:
        columns = [pa.array([r[k] if r else None for r in rows], pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, fields=list(run), mask=pa.array([r is None for r in rows], pa.bool_()))

    @F.arrow_udf(f"struct<text: string, runs: array<{RUN}>, strongest: {RUN}>")
    def told(texts: pa.Array) -> pa.Array:
        made = [collapsed(t.as_py() or b"", least, times) for t in texts.cast(pa.large_binary())]
        ends = np.cumsum([0, *(len(r) for _, r in made)]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs([x for _, r in made for x in r]))
        text = pa.array([t for t, _ in made], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([text, runs, structs([strongest(r) for _, r in made])], names=["text", "runs", "strongest"])

    found = docs.select(F.struct("*").alias("__row"), F.col("text").cast("string").alias("__text")).withColumn("__told", told("__text"))
    kept = [F.col("__told.text").alias("text") if f == "text" else F.col(f"__row.`{f}`").alias(f) for f in docs.columns if f not in ("runs", "strongest")]
    return found.select(*kept, F.col("__told.runs").alias("runs"), F.col("__told.strongest").alias("strongest"))
