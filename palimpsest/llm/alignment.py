"""Tokens of two tokenizers aligned by bytes, and how many documents hold each pair of aligned ids.

A reads a space and the text, B the text, before which it puts a space itself; so both
stand for the same bytes. Where a token of each ends at the same byte, a group ends. All
pairs of an A token and a B token of one group are links.

1. A pass over the texts aligns a block of documents at a time. Both tokenizers cut before
   a space that follows no white space, so that different stretches between such cuts
   are tokenized and aligned once for a block. It gives a row for each document, and
   postings: for each id pair of the block the documents that hold it and how often.
2. Postings are shuffled by their ids, at most one row for each pair and block. The
   number of documents of a pair is added up before the shuffle and after it, the highest
   of an A id among its pairs, and both are joined to the postings as sorted streams, which
   spill; of a pair that is in every document Spark splits the stream.
3. Postings with their counts go back to their blocks, in which what they add to each
   document is summed up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, short_batches

#: Documents of a block, which two bytes count; bytes that a process remembers of stretches, and what one takes beside its own.
BLOCK, MEMORY, ENTRY = 1000, 56 << 20, 300
#: Bytes of stretches that are tokenized by one call; pairs of tokens of one group that are listed.
TOGETHER, LARGE = 1 << 16, 4096
SPACE_PIECE = "▁"
#: Ends before which neither needs to cut: ASCII controls and space, and the last two bytes of white space beyond ASCII (other characters have them too).
WHITE = {bytes([b]) for b in (*range(0x21), 0x7F)} | {bytes([x, y]) for x in (0xC2, 0x9A, 0x80, 0x81) for y in (*range(0x80, 0x8B), 0xA0, 0xA8, 0xA9, 0xAF, 0x9F)}
IS_WHITE = np.isin(np.arange(1 << 16), [int.from_bytes(w) for w in WHITE])

TABLE = "block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, id_a int, id_b int, docs binary, times binary"


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Arena:
    """Aligned stretches by number, in flat arrays: their sizes (tokens of A, of B, groups, links), groups as text, and different id pairs with how often each is linked."""

    def __init__(self) -> None:
        self.groups: list[str | None] = []
        self.sizes, self.firsts = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, groups: list[str | None], sizes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.groups += groups
        self.new.append((sizes, counts, pairs, times))

    def settle(self) -> None:
        """Put what was added into the arrays."""
        if self.new:
            sizes, counts, pairs, times = zip(*self.new, strict=True)
            self.sizes = np.concatenate([self.sizes, *sizes])
            self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(np.concatenate(counts))])
            self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
            self.new = []


    def only(self, kept: np.ndarray) -> Arena:
        """Another one with these stretches, numbered from 0."""
        out, counts = Arena(), self.firsts[kept + 1] - self.firsts[kept]
        places = _expand(self.firsts[kept], counts)
        out.add([self.groups[k] for k in kept.tolist()], self.sizes[kept], counts, self.pairs[places], self.times[places])
        out.settle()
        return out


class Aligner:
    """Both tokenizers, and a memory of stretches: beyond ``memory`` bytes those stay that the last block had twice."""

    def __init__(self, file_a: str, file_b: str, memory: int = MEMORY) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.memory = Tokenizer.from_file(file_a), SentencePieceProcessor(model_file=file_b), memory
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        of = byte_level()
        self.bytes_a = [bytes(of[c] for c in t) if t and all(c in of for c in t) else b"" for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = list(map(self.b.id_to_piece, range(self.b.vocab_size())))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_PIECE, " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE_PIECE)
        steps = json.loads(self.a.pre_tokenizer.__getstate__()) if self.a.pre_tokenizer else {}
        #: Whether both cut before a space that follows no white space.
        self.apart = steps.get("type") == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"] and not self.a.normalizer and not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.known: dict[bytes, int] = {}
        #: Aligned stretches, about how many bytes they take, and how often the last block had each.
        self.arena, self.held, self.used = Arena(), 0, np.zeros(0, np.int64)

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where stretches begin in the UTF-8 texts one after the other that begin at ``starts``."""
        cut = np.zeros(len(data), bool)
        if self.apart and len(data) > 2:
            before, second = data[1:-1], data[:-2]
            white = IS_WHITE[np.where(before >= 0x80, second, 0).astype(np.int32) * 256 + before]
            cut[2:] = (data[2:] == 0x20) & ~white
        cut[starts] = True
        return np.flatnonzero(cut)

    def stretches(self, texts: list[bytes]) -> np.ndarray:
        """The numbers in ``arena`` of different stretches that begin with a space, until the next call; their groups are None where the bytes of tokens are not those of the stretch."""
        if self.held > self.memory:
            self._trim()
        known = self.known
        new = [t for t in dict.fromkeys(texts) if t not in known]
        joined: list[bytes] = []
        size = 0
        for t in new:
            known[t] = len(known)
            # Stretches one after the other are cut where they were, if no white space ends one.
            if not self.apart or len(t) > TOGETHER or (t[-2:] if t[-1] >= 0x80 else t[-1:]) in WHITE:
                self._together(joined)
                self._together([t])
                joined, size = [], 0
                continue
            joined.append(t)
            size += len(t)
            if size > TOGETHER:
                self._together(joined)
                joined, size = [], 0
        self._together(joined)
        self.arena.settle()
        self.held += sum(map(len, new)) + ENTRY * len(new)
        return np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))

    def _trim(self) -> None:
        kept = np.flatnonzero(self.used > 1)
        if len(kept) * ENTRY > self.memory // 2:
            kept = kept[:0]
        listed = list(self.known)
        self.known = {listed[k]: n for n, k in enumerate(kept.tolist())}
        self.arena, self.held, self.used = self.arena.only(kept), sum(map(len, self.known)) + ENTRY * len(kept), kept[:0]

    def _together(self, texts: list[bytes]) -> None:
        """Align stretches by one call of each tokenizer, and put them into the arena."""
        if not texts:
            return
        text = b"".join(texts)
        a = np.array(self.a.encode(text.decode(), add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:].decode()) if len(text) > 1 else [self.space], np.int64)
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == text == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = _common(ends_a, ends_b) if same else bounds[:0]
        if not same or len(_common(bounds, cuts)) < len(bounds):
            if len(texts) == 1:
                self.arena.add([None], np.zeros((1, 4), np.int64), np.zeros(1, np.int64), a[:0], a[:0])
            for t in texts if len(texts) > 1 else ():
                self._together([t])
            return
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        many_a, many_b = to_a - from_a, to_b - from_b
        of = np.searchsorted(bounds, cuts)  # the stretch of each group
        name_a, name_b = (list(map(self.names.__getitem__, x.tolist())) for x in (a, b))
        listed = [
            f"{name_a[i]}|{name_b[k]}" if j - i == 1 == m - k else ",".join(name_a[i:j]) + "|" + ",".join(name_b[k:m])
            for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)
        ]
        last = np.searchsorted(of, np.arange(len(texts)), side="right")
        groups = [listed[x] if y - x == 1 else ";".join(listed[x:y]) for x, y in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]
        total = lambda v: np.bincount(of, weights=v, minlength=len(texts)).astype(np.int64)
        sizes = np.stack([total(many_a), total(many_b), total(None), total(many_a * many_b)], axis=1)
        # All pairs of a group; of large groups the different ids are counted first.
        small = np.flatnonzero(many_a * many_b <= LARGE)
        each = _expand(from_a[small], many_a[small])
        width, start = np.repeat(many_b[small], many_a[small]), np.repeat(from_b[small], many_a[small])
        stretch = np.repeat(np.repeat(of[small], many_a[small]), width)
        pair, often = (np.repeat(a[each], width) << 32) | b[_expand(start, width)], np.ones(len(stretch), np.int64)
        for g in np.flatnonzero(many_a * many_b > LARGE).tolist():
            (x, m), (y, n) = np.unique(a[from_a[g] : to_a[g]], return_counts=True), np.unique(b[from_b[g] : to_b[g]], return_counts=True)
            pair = np.concatenate([pair, ((x[:, None] << 32) | y[None]).ravel()])
            often = np.concatenate([often, (m[:, None] * n[None]).ravel()])
            stretch = np.concatenate([stretch, np.full(len(x) * len(y), of[g])])
        order = np.argsort((stretch << 48) | pair) if len(self.bytes_a) <= 1 << 16 else np.lexsort((pair, stretch))
        pair, stretch = pair[order], stretch[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(stretch, prepend=-1) != 0))
        self.arena.add(groups, sizes, np.bincount(stretch[first], minlength=len(texts)), pair[first], np.add.reduceat(often[order], first))


@lru_cache(maxsize=1)
def aligner(file_a: str, file_b: str) -> Aligner:
    """The tokenizers of this process: tasks that share a worker share them."""
    return Aligner(file_a, file_b)


def _common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What two sorted arrays of different numbers share."""
    if not len(two):
        return two
    return one[two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one]


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _packed_times(times: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each number, or four in rows with a number over 255; and the ends of rows in it."""
    wide = np.maximum.reduceat(times, firsts) > 255 if len(firsts) else np.zeros(0, bool)
    width = np.where(wide, 4, 1)
    ends = np.concatenate([[0], np.cumsum(counts * width)])
    out = np.zeros(ends[-1], np.uint8)
    each = np.repeat(wide, counts)
    places = np.repeat(ends[:-1], counts) + (np.arange(len(times)) - np.repeat(firsts, counts)) * np.where(each, 4, 1)
    out[places] = times & 255
    for k in (1, 2, 3):
        out[places[each] + k] = (times[each] >> (8 * k)) & 255
    return out, ends


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def _block(known: Aligner, number: int, doc_ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents, then its postings."""
    n = len(texts)
    sizes, groups = np.zeros((n, 4), np.int64), [""] * n
    there = [k for k, t in enumerate(texts) if t]
    docs, pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if there:
        raw = b"".join(b" " + texts[k] for k in there)
        data = np.frombuffer(raw, np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) + 1 for k in there])[:-1]])
        cuts = known.cuts(data, starts)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(raw)).astype("<i8").tobytes()), pa.py_buffer(raw)])
        coded = stretches.dictionary_encode()
        found = known.stretches(coded.dictionary.to_pylist())
        codes, arena = found[coded.indices.to_numpy(zero_copy_only=False)], known.arena
        known.used = np.bincount(codes)
        firsts = np.searchsorted(cuts, starts)
        lost = np.logical_or.reduceat(np.equal(np.array(arena.groups, object), None).astype(bool)[codes], firsts)
        summed = np.add.reduceat(arena.sizes[codes], firsts, axis=0)
        listed = list(map(arena.groups.__getitem__, codes.tolist()))
        for k, (doc, a, b) in enumerate(zip(there, firsts.tolist(), [*firsts[1:].tolist(), len(codes)], strict=True)):
            if not lost[k]:
                sizes[doc], groups[doc] = summed[k], ";".join(listed[a:b])
        # How often a document holds each different stretch, then each pair.
        of = np.repeat(np.arange(len(there)), np.diff(np.append(firsts, len(codes))))
        kept = ~lost[of]
        held, often = np.unique(of[kept] * len(arena.groups) + codes[kept], return_counts=True)
        doc, code = held // len(arena.groups), held % len(arena.groups)
        many = arena.firsts[code + 1] - arena.firsts[code]
        places = _expand(arena.firsts[code], many)
        different, pair = np.unique(arena.pairs[places], return_inverse=True)
        key = pair * len(there) + np.repeat(doc, many)
        order = np.argsort(key)
        once = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(once):
            times = np.add.reduceat((arena.times[places] * np.repeat(often, many))[order], once)
            docs, pairs = np.array(there)[key[order][once] % len(there)], different[key[order][once] // len(there)]
    row = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.diff(np.append(row, len(pairs)))
    fields = ["block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "id_a", "id_b", "docs", "times"]
    none = lambda kind, size: pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), doc_ids.cast(pa.int64()), *(pa.array(c) for c in sizes.T.copy()), pa.array(groups, pa.string()), none(pa.int32(), n), none(pa.int32(), n), none(pa.binary(), n), none(pa.binary(), n)],
        names=fields,
    )
    if len(row):
        packed, ends = _packed_times(times, counts, row)
        ids = pairs[row]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), number)), none(pa.int32(), len(row)), *(none(pa.int64(), len(row)) for _ in range(5)), none(pa.string(), len(row)),
                pa.array((ids >> 32).astype(np.int32)), pa.array((ids & 0xFFFFFFFF).astype(np.int32)), _binary(docs.astype("<u2"), np.append(row, len(pairs)) * 2), _binary(packed, ends),
            ],
            names=fields,
        )


def _summed(known: pa.Table, met: pa.Table) -> pa.Table:
    """The documents of a block with what its postings add to each."""
    docs = np.frombuffer(b"".join(met["docs"].to_pylist()), "<u2")
    counts = np.array([len(d) // 2 for d in met["docs"].to_pylist()], np.int64)
    raw = met["times"].to_pylist()
    times = np.concatenate([np.frombuffer(t, "u1" if len(t) == c else "<u4").astype(np.int64) for t, c in zip(raw, counts.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    best, held = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    np.add.at(best, docs, times * np.repeat(met["best"].to_numpy(), counts))
    np.add.at(held, docs, times * np.repeat(met["n_docs"].to_numpy(), counts))
    at = known["at"].to_numpy()
    return known.drop_columns(["block", "at"]).append_column("n_best", pa.array(best[at], pa.int64())).append_column("count_sum", pa.array(held[at], pa.int64()))


def align(docs: DataFrame, file_a: str, file_b: str, describe: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and of B of each group in order; ``describe`` is applied
    to it before anything is written, as the text is longer than the document. ``n_best``:
    links whose pair is held by as many documents as any of its A id; ``count_sum``: the
    documents of its pair, over all links. Rows of one doc_id count as documents of their own. Texts that are
    null, empty or whose tokens do not give back their bytes have no tokens: zeros and no groups. Other columns
    are left out. ``file_a``: a byte-level vocabulary of the tokenizers library, ``file_b``: a
    sentencepiece model, which every executor has at these places.
    """
    spark = docs.sparkSession
    short_batches(spark, BLOCK)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(file_a, file_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                yield from _block(known, number, part.column(0), part.column(1).cast(pa.large_binary()).to_pylist())
                number += 1

    described = rows.mapInArrow(told, TABLE).withColumn("groups", F.when(F.col("at").isNotNull(), describe(F.col("groups"))))
    table = materialize(described, "aligned")
    postings = table.where("id_a IS NOT NULL").select("block", "id_a", "id_b", "docs", "times")
    counts = pair_counts(postings)
    met = postings.join(counts, ["id_a", "id_b"]).select(F.col("block").alias("of"), "docs", "times", "n_docs", "best")
    known = table.where("at IS NOT NULL").select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    kept = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return known.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_summed, kept)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``id_a, id_b, n_docs, best``: the documents that hold each pair linked, and whether no pair of its A id is in more."""
    counts = postings.groupBy("id_a", "id_b").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("n_docs"))
    # An A id has no more pairs than B has ids.
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("id_a")))
