"""Moved lines: what a commit removes in one place and adds, with its surroundings, in another.

A removed line is looked for by its window, the line with up to three lines on either side, of
which three or more are not blank. Windows are joined by their digests among all files of the commit, and
the added side is counted first, so that repeated passages make no pairs. Found once is a
``unique`` move, found more often an ``ambiguous`` one; where only the lines around it are found,
whatever their indentation and with another line in the middle, it is ``unverified``.

Only at the ends of its file is a removed line's window cut off. An added line has one whole window, therefore, and of
the cut off ones that it may fill only those that a bitmap of the removed ones' digests leaves; the join tells what is in it by chance.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import _short_batches, blocks
from palimpsest.plans.durable import checkpointed

#: Lines on either side, and lines that are not blank in a window at least.
AROUND, LEAST = 3, 3
#: Bits of the bitmap as a power of two, at most; with fewer there is one in 64 set at most.
MOST_BITS = 28
FULL = (AROUND, AROUND)
SHAPES = [s for s in product(range(AROUND + 1), repeat=2) if sum(s) + 1 >= LEAST]


def _digest(text: str) -> tuple[int, int]:
    raw = blake2b(text.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


def _factor(*of: object) -> np.ndarray:
    """Two odd numbers."""
    return np.array(_digest(repr(of)), dtype="u8") | np.uint64(1)


#: A window's digest is a sum, modulo 2^64 in two lanes, of its lines' digests times the factors of their places, and of its shape and its commit.
PLACES = {o: _factor("place", o) for o in range(-AROUND, AROUND + 1)}
SHAPED = {(s, kind): _factor(kind, *s) for s in SHAPES for kind in ("whole", "around", "few")}
SPREAD = _factor("bits")[0]


class _Versions:
    """Versions in order as flat arrays of their lines: digests in two lanes, whole and less indentation, and how many before each are not blank."""

    def __init__(self, table: pa.Table) -> None:
        one = table.combine_chunks()
        column = one["lines"].chunk(0)
        words = column.flatten().dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        lanes = lambda texts: np.array([_digest(x) for x in texts], dtype="u8").reshape(-1, 2).T[:, self.ids]
        known = words.dictionary.to_pylist()
        self.whole, self.bare = lanes(known), lanes(x.lstrip(" \t") for x in known)
        self.filled = np.array([bool(x.strip()) for x in known], dtype=bool)[self.ids]
        self.before = np.concatenate([[0], np.cumsum(self.filled)])
        sizes = np.diff(self.ends)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(self.ids)) - self.ends[self.of]
        self.left = sizes[self.of] - 1 - self.at
        self.position = one["position"].to_numpy()
        self.commit = np.array([one[c].to_numpy().view("u8") for c in ("high", "low")])
        self.file, block = one["file"].to_pylist(), one["block"].to_pylist()
        #: Whether a version follows the one before it.
        self.follows = np.array([k > 0 and self.file[k] == self.file[k - 1] and block[k] == block[k - 1] for k in range(len(block))], dtype=bool)

    def differing(self) -> tuple[np.ndarray, np.ndarray]:
        """Which lines the next version has removed, and which a version has added."""
        gone, come = np.zeros(len(self.ids), dtype=bool), np.zeros(len(self.ids), dtype=bool)
        for k in np.flatnonzero(self.follows):
            first, middle, last = self.ends[k - 1 : k + 2]
            old, new = self.ids[first:middle].tolist(), self.ids[middle:last].tolist()
            for tag, i, j, m, n in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if old != new else ():
                if tag != "equal":
                    gone[first + i : first + j], come[middle + m : middle + n] = True, True
        return gone, come

    def cut(self, shape: tuple[int, int]) -> np.ndarray:
        """Whether a line's window has the shape when it is cut off at the ends of the file."""
        return (np.minimum(self.at, AROUND) == shape[0]) & (np.minimum(self.left, AROUND) == shape[1])

    def within(self, shape: tuple[int, int]) -> np.ndarray:
        """Whether a window of the shape lies within the file."""
        return (self.at >= shape[0]) & (self.left >= shape[1])

    def windows(self, at: np.ndarray, shape: tuple[int, int], commit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``whole, wanted, around, enough`` of windows around lines: digests, whether a removed line may be found by the one, and whether there is enough around it for the other; without, it is a digest that no added line has."""
        places = range(-shape[0], shape[1] + 1)
        in_all = self.before[at + shape[1] + 1] - self.before[at - shape[0]]
        enough = in_all - self.filled[at] >= LEAST
        made = lambda lanes, kind, among: sum((lanes[:, at + o] * PLACES[o][:, None] for o in among), commit + SHAPED[shape, kind][:, None])
        around = made(self.bare, "around", [o for o in places if o]) + np.where(enough, np.uint64(0), SHAPED[shape, "few"][:, None])
        return made(self.whole, "whole", places), self.filled[at] & (in_all >= LEAST), around, enough

    def removed(self, lines: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, ...]:
        """``at, whole, around, enough`` of those of the lines that have a window, of this shape, by the commit of the next version."""
        at = np.flatnonzero(lines & self.filled & self.cut(shape))
        whole, wanted, around, enough = self.windows(at, shape, self.commit[:, self.of[at] + 1])
        return at[wanted], whole[:, wanted], around[:, wanted], enough[wanted]


def _places(digests: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and bits of a bitmap."""
    bit = (digests[0] * SPREAD) >> np.uint64(64 - power)
    return bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))


def _in_order(batches: Iterator[pa.RecordBatch], made: Callable[[_Versions, bool], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What is made of each batch with the last version of the batch before it, and whether there is one."""
    last = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            yield from made(_Versions(table), last is not None)
            last = batch.slice(batch.num_rows - 1)


FOUND = {"file": pa.string(), "position": pa.int64(), "line": pa.int64(), "number": pa.int64(), "whole0": pa.int64(), "whole1": pa.int64(), "around0": pa.int64(), "around1": pa.int64()}


def _rows(n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in FOUND.items()], list(FOUND))


def _lanes(name: str, digests: np.ndarray, there: np.ndarray | None = None) -> dict[str, pa.Array]:
    return {f"{name}{k}": pa.array(digests[k].view("i8"), mask=None if there is None else ~there) for k in range(2)}


def _bitmap(placed: DataFrame, power: int) -> np.ndarray:
    """Bits of the digests of all windows that are cut off, of versions that another follows: of the removed lines' and some more."""

    def made(v: _Versions, _: bool) -> Iterator[pa.RecordBatch]:
        old = np.append(v.follows[1:], False)[v.of]
        for shape in SHAPES:
            if shape != FULL:
                _, whole, around, enough = v.removed(old, shape)
                words, bits = _places(np.concatenate([whole, around[:, enough]], axis=1), power)
                yield pa.RecordBatch.from_arrays([pa.array(words.view("i8")), pa.array(bits.view("i8"))], ["word", "bits"])

    found = placed.mapInArrow(lambda batches: _in_order(batches, made), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << power >> 6), dtype="u8")
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view("u8")
    return out


def moved_lines(rows: DataFrame, commit: Column) -> DataFrame:
    """``file, position, line, status, to_file, to_line`` of each removed line with a window, of ``rows(file, position, lines)``.

    ``commit``: of ``file`` and ``position``, what the versions that one commit made share. ``line`` counts
    in the version before, ``to_line`` in the one made; the destination is given for unique moves.
    """
    dealt, spark = blocks(rows), rows.sparkSession
    _short_batches(spark)
    lane = lambda n: F.xxhash64(F.lit(n), commit)
    placed = dealt.select("file", "block", "position", "lines", lane(0).alias("high"), lane(1).alias("low")).repartition("file", "block").sortWithinPartitions("file", "block", "position")
    power = min(max((dealt.count() * 4 * AROUND * 64).bit_length(), 6), MOST_BITS)
    held = spark.sparkContext.broadcast(_bitmap(placed, power))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks are told apart by numbers, which Spark can keep in its hash tables.
        number, bitmap = TaskContext.get().partitionId() << 40, held.value

        def hit(digests: np.ndarray) -> np.ndarray:
            words, bits = _places(digests, power)
            return bitmap[words] & bits != 0

        def made(v: _Versions, again: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            numbers = number + np.cumsum(~v.follows) - again
            number = int(numbers[-1])
            fresh = ~v.follows
            fresh[0] = not again
            yield _rows(int(fresh.sum()), file=pa.array(v.file).filter(pa.array(fresh)), number=numbers[fresh])
            gone, come = v.differing()
            file = pa.array(v.file)
            for shape in SHAPES:
                at, whole, around, _ = v.removed(gone, shape)
                yield _rows(len(at), file=file.take(pa.array(v.of[at])), position=v.position[v.of[at] + 1], line=v.at[at] + 1, **_lanes("whole", whole), **_lanes("around", around))
                at = np.flatnonzero(come & v.within(shape))
                whole, wanted, around, enough = v.windows(at, shape, v.commit[:, v.of[at]])
                if shape != FULL:
                    wanted, enough = wanted & hit(whole), enough & hit(around)
                some = wanted | enough
                yield _rows(int(some.sum()), number=numbers[v.of[at[some]]], line=v.at[at[some]] + 1, **_lanes("whole", whole[:, some], wanted[some]), **_lanes("around", around[:, some], enough[some]))

        yield from _in_order(batches, made)

    schema = ", ".join(f"{c} {'string' if kind == pa.string() else 'long'}" for c, kind in FOUND.items())
    # Made once, for all that reads it. Sides of the joins grow with the texts and are never sent to the driver to be broadcast.
    found = checkpointed(placed.mapInArrow(numbered, schema))
    added, whole, around = found.where("number IS NOT NULL"), ["whole0", "whole1"], ["around0", "around1"]
    same = added.where("whole0 IS NOT NULL").groupBy(*whole).agg(F.count("*").alias("n"), F.max("number").alias("to"), F.max("line").alias("to_line"))
    near = added.where("around0 IS NOT NULL").groupBy(*around).agg(F.count("*").alias("near"))
    files = added.where("file IS NOT NULL").select(F.col("number").alias("to"), F.col("file").alias("to_file"))
    removed = found.where("number IS NULL").drop("number")
    met = removed.join(near.hint("merge"), around, "left").join(same.hint("merge"), whole, "left")
    status = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").when(F.col("near") > 0, "unverified").otherwise("none")
    # Those that moved to no one place are dealt out as well.
    one = F.when(F.col("n") == 1, F.col("to")).otherwise(-1 - F.abs(F.col("whole0") % (1 << 40)))
    told = met.select("file", "position", "line", status.alias("status"), one.alias("to"), F.when(F.col("n") == 1, F.col("to_line")).alias("to_line"))
    return told.join(files.hint("merge"), "to", "left").select("file", "position", "line", "status", "to_file", "to_line")
