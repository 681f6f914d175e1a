from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import alignment, queries
from palimpsest.llm.queries import tokenizer_file

ENOUGH = 1 << 24
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def known():
    return alignment.Aligner(tokenizer_file(A), tokenizer_file(B))


def whole(known, text):
    """Groups of one text by encoding all of it and comparing all ends; None without tokens."""
    if not text:
        return None
    a = known.a.encode(" " + text, add_special_tokens=False).ids
    b = known.b.encode(text)
    table = alignment.byte_level()
    raw_a = [bytes(table[c] for c in known.a.id_to_token(i)) for i in a]
    piece = known.b.id_to_piece
    raw_b = [bytes([int(piece(i)[3:5], 16)]) if known.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
    at_a, at_b = ends(raw_a), ends(raw_b)
    groups, i, j = [], 0, 0
    for cut in sorted(set(at_a) & set(at_b)):
        x, y = at_a.index(cut) + 1, at_b.index(cut) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def expected(known, rows):
    """The rows of op11 by plain code over all documents."""
    every = [(d, whole(known, t)) for d, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in every]
    docs = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for (d, g), c in zip(every, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        n_best = sum(m for p, m in c.items() if docs[p] == best[p[0]])
        out.append((d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()), n_best, sum(m * docs[p] for p, m in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n  b\t c", "\r\n x;\r\n y", "x\u00a0 y", "x\u3000 y", "x\u2003 y", "x\u0085 y", "x\u2028 y", "x\u202f  y", "x\u205f y", "x\u1680 y", "x\u001c y", "x\u007f y", "x\u0001 y",
    "<|endoftext|> and </s> <s> <0x41> <unk>", "\u2581 lower \u2581block", "漢字 かな 漢字", "\U0001f600 \U0001f600\U0001f600 \U0001f469\u200d\U0001f469\u200d\U0001f467", "\u00e9 e\u0301 \ufb01", "don't  they'll",
    "a" * 5000, "ab" * 3000 + " " + "=" * 4000, "日本語" * 1500, "1234567 89 " * 300, "\x00 \x00", "x\ufeffy \u200b z",
]


def test_cuts_change_no_token(known):
    r = random.Random(4)
    alphabet = [" ", " ", " ", "\n", "\t", "\r", "a", "the", "É", " ", " ", "　", "'s", "1", ".", "\u0085", "​", "漢", "\x1d", "\U0001f600", " "]
    texts = [t for t in ODD if t] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(2000)]
    cut = 0
    for t in texts:
        raw = b" " + t.encode()
        at = known.cuts(np.frombuffer(raw, np.uint8), np.array([0])).tolist()
        cut += len(at) > 1
        parts = [known.arena.groups[k] for k in known.stretches([raw[x:y] for x, y in zip(at, [*at[1:], len(raw)], strict=True)]).tolist()]
        got = None if None in parts else ";".join(parts)
        want = whole(known, t)
        assert got == (want and ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)), t
    assert cut > 500


def test_query_on_its_tables(spark, docs, known, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [tuple(x) for x in docs.select("doc_id", "text").collect()]
    rows += [(None, "the river"), (None, None), (500, "the the the , " * 400), (500, "the the the , " * 400), *[(600 + k, "the river, the light") for k in range(20)]]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "at", "id_a", "groups", "n_docs")})
    made.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = expected(known, rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    empty = alignment.align(made.limit(0), tokenizer_file(A), tokenizer_file(B))
    assert empty.count() == 0 and empty.columns[-3:] == ["groups", "n_best", "count_sum"]


def test_blocks_and_memory_change_nothing(spark, known, monkeypatch):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["the", "river", "ünder", "x.y", "42", "green;\r"]) for _ in range(r.randrange(60)))) for k in range(150)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.align(made, tokenizer_file(A), tokenizer_file(B))
    got = [(*x[:5], x.n_best, x.count_sum, hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else "") for x in found.collect()]
    assert sorted(got) == sorted(expected(known, rows))
    one = alignment.Aligner(tokenizer_file(A), tokenizer_file(B), memory=1)
    texts = [b" " + t.encode() for _, t in rows if t]
    named = lambda ids: [one.arena.groups[k] for k in ids.tolist()]
    first = named(one.stretches(texts))
    one.used = np.arange(len(one.known)) % 3
    assert named(one.stretches(texts)) == first and len(one.known) == len(set(texts)) == len(one.arena.groups)
    one.memory, one.used = ENOUGH, np.arange(len(one.known)) % 3
    one.held = ENOUGH + 1
    assert named(one.stretches(texts)) == first and list(one.known) != list(dict.fromkeys(texts)) and len(one.known) == len(one.arena.groups) == len(one.arena.sizes)


def test_large_groups_count_different_ids(known, monkeypatch):
    raw = [b" " + t.encode() for t in ODD if t and not whole(known, t) is None]
    pairs = lambda x: sorted((x.arena.groups[k], x.arena.sizes[k].tolist(), x.arena.pairs[x.arena.firsts[k] : x.arena.firsts[k + 1]].tolist(), x.arena.times[x.arena.firsts[k] : x.arena.firsts[k + 1]].tolist()) for k in x.stretches(raw).tolist())
    first = pairs(known)
    monkeypatch.setattr(alignment, "LARGE", 1)
    assert pairs(alignment.Aligner(tokenizer_file(A), tokenizer_file(B))) == first


def test_numbers_beyond_a_byte():
    times, counts = np.array([1, 255, 3, 70_000, 256, 9]), np.array([2, 3, 1])
    packed, ends = alignment._packed_times(times, counts, np.array([0, 2, 5]))
    raw = [packed[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    assert [np.frombuffer(x, "u1" if len(x) == c else "<u4").tolist() for x, c in zip(raw, counts, strict=True)] == [[1, 255], [3, 70_000, 256], [9]]
