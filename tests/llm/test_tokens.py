from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import common, tokens
from palimpsest.llm.queries import tokenizer_file


def shard(records) -> bytes:
    return b"".join(r + tokens.SEPARATOR for r in records)


def test_shard_round_trip_and_damage():
    w = tokens.ShardWriter(frame_ids=10)
    docs = [(k if k != 4 else None, np.arange(k % 7, dtype=np.uint32) * 100003) for k in range(30)]
    records = [r for d, ids in docs for r in w.add(d, ids)] + list(w.close())
    data = shard(records)
    reader = tokens.ShardReader(io.BytesIO(data))
    back = list(reader.documents())
    assert [(d, i.tolist()) for d, _, i in back] == [(d, i.tolist()) for d, i in docs]
    assert [s for _, s, _ in back] == np.cumsum([0, *(len(i) for _, i in docs)])[:-1].tolist()

    opened = []
    reader.frame = lambda k, f=reader.frame: opened.append(k) or f(k)
    (one,) = reader.documents([13])
    assert one[2].tolist() == docs[13][1].tolist() and len(opened) == 1

    bad = bytearray(data)
    bad[6] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(tokens.ShardReader(io.BytesIO(bytes(bad))).documents())
    empty = tokens.ShardReader(io.BytesIO(shard(tokens.ShardWriter().close())))
    assert list(empty.documents()) == []


def test_stock_readers_open_a_shard():
    """The library's own stream reader skips gaps, index and table; a reader by the format's text finds each frame from the end."""
    import struct

    import xxhash
    import zstandard

    w = tokens.ShardWriter(frame_ids=50)
    data = shard([r for k in range(40) for r in w.add(k, np.arange(k, dtype=np.uint32) + k)] + list(w.close()))
    want = b"".join((np.arange(k, dtype="<u4") + k).astype("<u4").tobytes() for k in range(40))
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == want
    assert data[-4:] == struct.pack("<I", 0x8F92EAB1)
    frames, flags = struct.unpack("<IB", data[-9:-4])
    table = len(data) - 9 - 12 * frames
    assert flags == 0x80 and struct.unpack("<II", data[table - 8 : table]) == (0x184D2A5E, 12 * frames + 9)
    at, out = 0, b""
    for k in range(frames):
        stored, size, checksum = struct.unpack_from("<III", data, table + 12 * k)
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + stored], max_output_size=size) if size else b""
        assert len(raw) == size and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF == checksum
        at, out = at + stored, out + raw
    assert out == want and at == table - 8


def test_codec_equals_the_library():
    texts = ["Don't it's WE'LL İstanbul ﬁne x y 漢字 ½ a1b2 ée <|endoftext|>x ß ſ K word's ''", "", "  ", "a" * 500, "x.'s", "word,word;", "Ünïcödé!!", "The the THE.", " \n".join(["e\u0301 it's", "\u0301x  <|endoftext|> y"] * 40)]
    plain = Tokenizer.from_file(tokenizer_file())
    coded = [t.encode() for t in texts]
    for coder in (tokens.Codec(tokenizer_file()), tokens.Codec(tokenizer_file(), memory=100)):
        assert coder.wordwise
        for most in (tokens.PIECE, 40, 3):
            for t, ids in zip(texts, coder.encode(coded, most), strict=True):
                assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t
        assert coder.held <= coder.memory + 300 * sum(len(t.split()) for t in texts)
    assert b"".join(common.pieces(coded[-1], 20)) == coded[-1]
    coder.wordwise = False
    assert [x.tolist() for x in coder.encode(coded)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts(spark):
    """A text of over a megabyte, one without any space, and one of a single line."""
    texts = ["lorem ipsum, dolor! " * 60_000, "x" * 300_000, "é\n" * 200_000]
    plain = Tokenizer.from_file(tokenizer_file())
    got = tokens.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_file()).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_documents_by_id(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    tokens.write_shards(docs, path, tokenizer_file())
    plain = Tokenizer.from_file(tokenizer_file())
    got = tokens.read_documents(spark, path, [1, 6, 9, 999]).collect()
    assert sorted(r.doc_id for r in got) == [1, 6, 6, 9]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == [*plain.encode(text[r.doc_id], add_special_tokens=False).ids, 1] for r in got)


def test_encode(spark, docs, none):
    plain = Tokenizer.from_file(tokenizer_file())
    got = sorted(tokens.encode(docs, tokenizer_file()).collect(), key=lambda r: r.start)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == docs.count()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
    assert tokens.encode(none, tokenizer_file()).count() == 0
