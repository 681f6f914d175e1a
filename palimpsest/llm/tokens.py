"""Token ids in seekable binary shards.

A shard file is a run of zstandard frames in the public seekable format:

    frame, gap, frame, gap, ..., index, seek table

- frame: an independent zstandard frame over little-endian unsigned 32-bit ids of
  whole documents.
- gap: a skippable frame of four bytes (``GAP``). Spark's own text writer writes the
  files, through Hadoop's commit protocol, so that they reach any file system that
  Spark can write and lost tasks leave nothing behind; it ends every record with a
  separator. The separator is the magic number that ends a seek table: it is the
  contents of a gap within a file, and the end of the seek table at its end.
- index: a skippable frame holding a zstandard frame with, for each document in
  order, doc_id (signed 64 bits), number of ids (unsigned 64) and frame (unsigned
  32, gaps not counted), and one byte telling whether doc_id is null, column by column.
- seek table: a skippable frame with, for each frame before it (gaps and the index
  too, as frames of no data), its stored size, its size once decompressed and
  the low 32 bits of the XXH64 of that; last in it the number of frames, a descriptor
  and the magic number. It ends the file.

A reader takes the seek table from the end of the file, then the index, then only
the frames that hold the documents asked for, checking each one's checksum.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_path, materialize, pieces, shared_dir, short_batches, small

#: Magic numbers of the seekable zstandard format: skippable frames, the seek table's kind, its end.
SKIP, TABLE, END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: What ends each record, and the skippable frame that it completes within a file.
SEPARATOR = struct.pack("<I", END)
GAP = struct.pack("<II", SKIP, len(SEPARATOR)) + SEPARATOR
#: Ids in a frame, at least (a longer document makes a longer one); bytes of text in a shard, about.
FRAME_IDS, SHARD_BYTES = 1 << 16, 32 << 20


def _checksum(raw: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Builds a shard record by record; ``SEPARATOR`` is to follow each record, the last one too."""

    def __init__(self, level: int = 3, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.frame_ids, self.held, self.held_ids = frame_ids, [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_id or 0, len(ids), len(self.entries) // 2, doc_id is None))
        self.held.append(ids.astype("<u4"))
        self.held_ids += len(ids)
        if self.held_ids >= self.frame_ids:
            yield self._frame()

    def _frame(self) -> bytes:
        raw = np.concatenate(self.held).tobytes()
        frame = self.pack(raw)
        self.entries += [(len(frame), len(raw), _checksum(raw)), (len(GAP), 0, _checksum(b""))]
        self.held, self.held_ids = [], 0
        return frame + GAP[: -len(SEPARATOR)]

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        ids, counts, frames, nulls = zip(*self.docs, strict=True) if self.docs else ((), (), (), ())
        index = self.pack(b"".join([np.array(ids, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), np.array(frames, "<u4").tobytes(), np.array(nulls, "u1").tobytes()]))
        index = struct.pack("<III", SKIP + 1, len(index) + 4, len(self.docs)) + index
        entries = [*self.entries, (len(index), 0, _checksum(b""))]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, END)
        yield index + (struct.pack("<II", TABLE, len(table)) + table)[: -len(SEPARATOR)]


class ShardReader:
    """Reads a shard from a seekable binary file; decompresses only what is asked for."""

    def __init__(self, file: io.BufferedIOBase) -> None:
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        end = file.seek(0, io.SEEK_END)
        count, kind, magic = struct.unpack("<IBI", self._at(max(end - 9, 0), 9))
        if magic != END or kind != 0x80:
            raise ValueError("not a seekable shard")
        entries = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        at = int(starts[-2])
        head, size, n = struct.unpack("<III", self._at(at, 12))
        if head != SKIP + 1:
            raise ValueError("no index before the seek table")
        raw = self.unpack(self._at(at + 12, size - 4))
        #: Places and entries of the frames that hold ids; a gap follows each.
        self.starts, self.entries = starts[:-2:2], entries[:-1:2]
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.counts = np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)
        self.frames = np.frombuffer(raw, "<u4", n, 16 * n).astype(np.int64)
        self.nulls = np.frombuffer(raw, "u1", n, 20 * n).astype(bool)
        #: Ids before each document in its shard, and before each frame.
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame_offsets = np.concatenate([[0], np.cumsum(self.entries[:, 1] // 4)])

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        size, whole, checksum = self.entries[k].tolist()
        raw = self.unpack(self._at(int(self.starts[k]), size), max_output_size=whole)
        if _checksum(raw) != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, ids before it in the shard, ids)`` in order; of the doc_ids ``wanted`` only."""
        rows = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)) & ~self.nulls)
        last, ids = -1, np.empty(0, "<u4")
        for k in rows:
            if self.frames[k] != last:
                last = int(self.frames[k])
                ids = self.frame(last)
            at = int(self.offsets[k] - self.frame_offsets[last])
            yield None if self.nulls[k] else int(self.doc_ids[k]), int(self.offsets[k]), ids[at : at + int(self.counts[k])]


#: A pre-tokenizer pattern whose matches never span white space and which drops all of it (a fixed value).
WORDWISE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are encoded together, about, and of words and their ids that a process remembers.
PIECE, MEMORY = 2 << 20, 80 << 20
#: What a word takes beside its bytes and ids, about.
ENTRY = 200


class Codec:
    """Ids of whole texts, by the tokenizers library.

    If the tokenizer treats each run of non-space characters by itself, the
    different runs of about ``PIECE`` bytes of text are found first, most of them are
    taken apart into a word and its punctuation, and each is encoded once; what is
    remembered of words is bounded in bytes. Else texts are encoded whole.
    """

    def __init__(self, file: str, memory: int = MEMORY) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memory = Tokenizer.from_file(file), memory
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        steps = state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        kinds = [n["type"] for n in state(self.tokenizer.normalizer).get("normalizers", [])]
        split = steps[0] if len(steps) == 2 and steps[0]["type"] == "Split" and steps[1]["type"] == "ByteLevel" else {}
        self.wordwise = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORDWISE} and split["invert"] and split["behavior"] == "Removed"
        #: The same model, which the two share, without the steps before it.
        self.bare = Tokenizer(self.tokenizer.model)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin letters that normalisation leaves alone once lower-cased, by their byte-level form.
        self.letters = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c} if self.wordwise else {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: Iterable[bytes], most: int = PIECE) -> Iterator[np.ndarray]:
        """The ids of each UTF-8 text, in order."""
        group, size = [], 0
        for text in texts:
            if not self.wordwise:
                yield np.frombuffer(self._whole(text.decode()), "<u4")
                continue
            if len(text) > most:
                yield from self._together(group)
                yield np.concatenate([ids for part in pieces(text, most) for ids in self._together([part])])
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size >= most:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if texts:
            counts, ids = self._runs(pa.array(texts, pa.binary()).cast(pa.string()))
            ends = np.cumsum(counts).tolist()
            yield from (ids[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def _runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after the other."""
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.flatten().dictionary_encode()
        different, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        cores = pc.ascii_rtrim(different, characters=PUNCTUATION)
        lower = pc.utf8_lower(cores)
        words = lower.dictionary_encode()
        plain = self._words(words.dictionary)
        # A run is a plain word and the punctuation after it; or all of it stands in the second place.
        first = words.indices.to_numpy(zero_copy_only=False)
        odd = ~plain[first] | pc.match_substring(different, "\u0130").to_numpy(zero_copy_only=False)  # lower-cases to two characters
        cut = np.where(odd, 0, pc.binary_length(cores).to_numpy(zero_copy_only=False))
        rest = np.flatnonzero(cut < pc.binary_length(different).to_numpy(zero_copy_only=False))
        tails: dict[bytes, int] = {}
        second = np.full(len(different), -1)
        second[rest] = [tails.setdefault(r[c:], len(tails)) for r, c in zip(_listed(different.take(rest).cast(pa.binary())), cut[rest].tolist(), strict=True)]
        pieces = [self.words.get(w, b"") for w in _listed(words.dictionary)] + [b""] + [self._whole(t.decode()) for t in tails]
        empty = len(words.dictionary)
        pair = np.stack([np.where(odd, empty, first), empty + 1 + second], axis=1).astype(np.int32)
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(pieces), "<u4"))
        out = lists.take(pa.array(pair[at].reshape(-1))).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[pair].sum(axis=1)[at])])
        bounds = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
        return np.diff(ends[bounds]), out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: pa.Array) -> np.ndarray:
        """Which of the different words are plain; the ids of those are in memory afterwards."""
        listed, known, letter = _listed(words), self.words, self.letters.__contains__
        if self.held > self.memory:
            known.clear()
            self.held = 0
        new = [w for w in listed if w not in known and 0 < len(w) < 200 and all(map(letter, w))]
        form = self.letters.__getitem__
        for k in range(0, len(new), 1000):
            part = new[k : k + 1000]
            e = self.bare.encode(["".join(map(form, w)) for w in part], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(part)))).tolist()
            known.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            self.held += len(raw) + sum(map(len, part)) + ENTRY * len(part)
        return np.fromiter(map(known.__contains__, listed), dtype=bool, count=len(listed))


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def codec(file: str) -> Codec:
    """The codec of this process: tasks that share a worker share it."""
    return Codec(file)


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, level: int = 3, shard_bytes: int = SHARD_BYTES, frame_ids: int = FRAME_IDS) -> None:
    """Encode ``docs(doc_id, text)`` whole and write them to ``path`` in ascending doc_id.

    Files in name order hold ascending doc_ids, nulls first; rows of one doc_id go
    by the hash of their text, equal rows stay equal. ``end_id`` ends every document,
    so that null and empty texts hold one id. Other columns are left out; without
    rows, the shards are empty. ``tokenizer``: a file of the tokenizers library that
    every executor has at this place. Rows are dealt by ranges of (doc_id, text hash), about
    ``shard_bytes`` of text each; a task holds the ids of one frame, and of one long text, at a time.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (1 << 20)))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, coder = ShardWriter(level, frame_ids), codec(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                for record in writer.add(doc, np.concatenate([ids, end])):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])
        for record in writer.close():
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])

    binary = ranged.mapInArrow(shard, "value binary").select(F.col("value").cast("string"))
    binary.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """``doc_id, ids`` (array of long) of the given documents; only the frames that hold them are decompressed.

    ``doc_ids`` travel with the plan, so they are to be few; those that are not there give
    no row, and a doc_id of several rows gives them all.
    """
    short_batches(spark)
    wanted = sorted({int(d) for d in doc_ids})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                for d, _, ids in ShardReader(io.BytesIO(content.as_py())).documents(wanted):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _files(spark, path).mapInArrow(rows, "doc_id long, ids array<long>")


#: Shards whose numbers of ids are added up together in one task.
BLOCK = 4096


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the shards at ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all shards in order of
    their names: the sums of blocks of shards first, then those within a block.
    """
    short_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(io.BytesIO(content.as_py()))
                crc = [zlib.crc32(ids.tobytes()) for _, _, ids in reader.documents()]
                arrays = [pa.array(np.full(len(crc), k)), pa.array(reader.doc_ids, mask=reader.nulls), pa.array(reader.offsets[:-1]), pa.array(reader.counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([a.cast(pa.int64()) for a in arrays], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = materialize(_files(spark, path).mapInArrow(rows, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "read-back")
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).withColumn("block", F.floor(F.col("shard") / BLOCK))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", before(Window.orderBy("block")).alias("base"))
    starts = totals.join(small(blocks), "block").select("shard", (F.col("base") + before(Window.partitionBy("block").orderBy("shard"))).alias("base"))
    return found.join(small(starts), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str, *, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as shards to ``path`` and report the documents as read back from them.

    Without ``path`` the shards go into the shared folder, and away once they are read.
    """
    import uuid

    spark = docs.sparkSession
    place = path or f"{shared_dir(spark)}/palimpsest/shards-{uuid.uuid4().hex}"
    write_shards(docs, place, tokenizer, **options)
    found = read_shards(spark, place)
    if not path:
        drop_path(spark, place)
    return found
