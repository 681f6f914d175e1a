"""Mixing, rules, licences, pseudonyms, backoff scores and fuzzy lines against brute force on small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import pairwise

import pytest

from palimpsest.llm import backoff, licenses, lines, mixing, private, rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


# Mixing


def seats_one_by_one(votes, n):
    got = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize("votes, n", [([50.0, 30.0, 20.0], 7), ([1.0, 1.0, 1.0, 97.0], 11), ([5.0], 4), ([0.0, 10.0, 3.0], 9), ([33.0, 33.0, 34.0, 1.0, 2.0], 500)])
def test_apportionment_equals_seat_by_seat(spark, votes, n):
    rows = [("g", f"p{i}", v, n) for i, v in enumerate(votes)]
    got = {r.p: r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g string, p string, votes double, seats long"), ["g"], ["p"]).collect()}
    want = seats_one_by_one(votes, n)
    assert [got.get(f"p{i}", 0) for i in range(len(votes))] == want


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / left for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(docs, none):
    rows = mixing.plan(docs, block=2).collect()
    assert len(rows) == docs.count() and mixing.plan(none).count() == 0
    sizes = defaultdict(int)
    for r in docs.select("text", "source").collect():
        sizes[r.source] += len(split(r.text))
    target = slow_targets(sizes)
    by_size = {v: target[k] for k, v in sizes.items()}
    taken = Counter()
    for r in rows:
        assert r.taken <= 2 * r.size
        assert r.target == pytest.approx(by_size[r.source_size])
        taken[r.source_size] += r.taken
    for size, words in taken.items():
        assert abs(words - by_size[size]) <= 16
    again = mixing.plan(docs.repartition(5), block=2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()}.isdisjoint({2, 3, 4})


# Rules


def slow_features(text):
    text = text or ""
    w = split(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    there = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(there) - len(set(there)), len(hit)


def test_features(spark, docs, none):
    texts = ["a b c d e a b c d e f", "x " * 40, "one\none\n \n\ntwo\none", "# $% &|<>", "a b c d e f g a b c d e q a b c d e", None, ""]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.features(made, ["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_features(texts[r.doc_id]), texts[r.doc_id]
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    judged = rules.judge(docs, labels).collect()
    assert len(judged) == docs.count() and rules.judge(none, labels).count() == 0
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(n, k, p) for n in (5, 60, 900, 4000) for k in (0, 1, 3, 20) for p in (0.004, 0.05) if k <= n]
    for n, k, p in cases:
        got = spark.range(1).select(rules.binomial_tail(F.lit(float(n)), F.lit(float(k)), p)).first()[0]
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(1.0 if k >= n * p else exact, rel=1e-7)


def test_cutoffs_hold_the_rate(spark):
    """Good documents with rising symbols: the cutoff in force rejects few enough of them; a small stratum gets none."""
    rows = [("=en", [i / 20000, 0.0, 0.0, 5.0, -5.0]) for i in range(8000)] + [("=fr", [0.0] * 5)] * 20
    made = spark.createDataFrame(rows, "stratum string, values array<double>")
    cut = {(r.stratum, r.rule): r.cutoff for r in rules.cutoffs(made).collect()}
    assert not [k for k in cut if k[0] == "=fr"]
    best = cut["=en", 0]
    n = len([1 for s, v in rows if s == "=en" and v[0] > best])
    assert best in rules.GRIDS["symbols"] and n / 8000 <= rules.RATE / len(rules.GRIDS)


# Licences


def test_licenses(spark, docs, none):
    from palimpsest.llm.license_texts import TEXTS

    known = licenses.known(spark)
    mit = "Copyright (c) 2020 Some One\n" + TEXTS["MIT"].replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, "prose here\nLICENCED under CC BY-NC 4.0\nmore"), (3, TEXTS["ISC"] + " more"), (4, None), (5, ""), (None, TEXTS["Zlib"]), (None, TEXTS["Zlib"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].license_id == "MIT" and by[1].statements == ["MIT"]
    assert by[2].license_id is None and by[2].statements == ["statement:CC-BY-NC-4.0"]
    assert not by[3].licensed and not by[4].licensed and by[4].digest == by[5].digest and by[None].license_id == "Zlib"
    assert licenses.scan(docs, known).count() == docs.count() and licenses.scan(none, known).count() == 0
    assert licenses.scan(docs, known.limit(0)).where("licensed").count() == 0


def test_wrapping_does_not_matter(spark):
    """MIT as it is published, on one line a paragraph, and wrapped so that lines begin with "copyright"."""
    from palimpsest.llm.license_texts import TEXTS

    flat = [" ".join(p.split()) for p in TEXTS["MIT"].split("\n\n")]
    published = "\n\n".join(flat).replace("SHALL THE AUTHORS", "SHALL THE\nAUTHORS").replace("Permission is", "Copyright (c) 2019 Some One\nCopyright 2020, 2021 Another\n\nPermission is")
    broken = "\n\n".join(flat).replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("copyright notice", "\ncopyright notice")
    rows = [(1, published), (2, "\n\n".join(flat)), (3, broken), (4, published.replace("BE LIABLE FOR ANY CLAIM", "PAY FOR ANY CLAIM"))]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None}


# Pseudonyms


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark, docs, none):
    from datetime import date

    text = (
        "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112; call +1 (415) 555-2671 or 415.555.2671. ssn 123-45-6789, 000-45-6789. "
        "born 1984-02-29, not 1983-02-29, nor 31/02/1999; 28/02/1999. ip 10.0.0.1 and 300.1.1.1 mail Jo.Doe@example.com jo.doe@EXAMPLE.com token = \"abcdef0123456789\""
    )
    rows = private.pseudonymize(spark.createDataFrame([(1, text), (2, text + " again"), (3, None), (4, ""), (5, "no data")], "doc_id long, text string"), "k").collect()
    by = {r.doc_id: r for r in rows}
    out = by[1].text
    assert by[2].text == out + " again" and by[3].text is None and by[4].text == "" and by[5].text == "no data" and by[5].n_found == 0
    for gone in ("4111 1111 1111 1111", "415) 555-2671", "123-45-6789", "1984-02-29", "28/02/1999", "10.0.0.1", "Doe", "abcdef0123456789"):
        assert gone not in out, gone
    for kept in ("4111 1111 1111 1112", "000-45-6789", "1983-02-29", "31/02/1999", "300.1.1.1"):
        assert kept in out, kept
    cards = re.findall(r"card ([\d ]{19}) and ([\d-]{19})", out)[0]
    assert all(map(luhn, cards)) and cards[0].replace(" ", "") == cards[1].replace("-", "")
    a, b = re.search(r"\+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4}) or", out), re.search(r"or ([2-9]\d\d)\.([2-9]\d\d)\.(\d{4})\.", out)
    assert a.groups() == b.groups()
    assert date.fromisoformat(re.search(r"born (\d{4}-\d\d-\d\d)", out)[1])
    assert len(set(re.findall(r"user-[0-9a-f]{16}@example\.invalid", out))) == 1
    same = private.pseudonymize(docs, "k")
    assert same.columns == [*docs.columns, "n_found", "n_replaced"] and same.count() == docs.count() and private.pseudonymize(none, "k").count() == 0


def test_cards_beside_digits_and_all_area_codes(spark):
    one, two, amex = "4111111111111111", "7536784127813050", "3782 822463 10005"
    assert luhn(one) and luhn(two) and luhn(amex)
    texts = [f"{one} 12/27", f"{two} 4242424242424242", "2027 4111 1111 1111 1111", f"no {amex} 9 or", "call (124) 555-4766 or (017) 555-4766", "4111 1111 1111 1112 12", one, "41 1111 1111 111111"]
    got = {r.doc_id: r for r in private.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    new = got[6].text
    assert new != one and luhn(new) and len(new) == 16
    assert got[0].text == f"{new} 12/27"
    a, b = got[1].text.split()
    assert a != two and b != "4242424242424242" and luhn(a) and luhn(b) and (got[1].n_found, got[1].n_replaced) == (2, 2)
    assert got[2].text.replace(" ", "") == "2027" + new
    assert amex not in got[3].text and got[3].text.endswith(" 9 or")
    phones = re.findall(r"\((\d{3})\) ([2-9]\d\d)-(\d{4})", got[4].text)
    assert len(phones) == 2 and got[4].n_replaced == 2 and all(p[0] < "200" for p in phones) and "4766" not in got[4].text
    assert got[5].text == texts[5] and got[7].text.replace(" ", "") == new


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(17 * 40).select((F.col("id") / 40).cast("long").alias("a"), (F.col("id") % 40).alias("b"))
    out = pairs.select(private.feistel("k", "t", F.col("a"), F.lit(17), F.col("b"), F.lit(40)).alias("p")).select("p.*").collect()
    assert len({tuple(r) for r in out}) == 17 * 40 and all(0 <= r.a < 17 and 0 <= r.b < 40 for r in out)


def test_dates_stay_apart(spark):
    """All days in all three ways of writing: as many pseudonyms as dates, each of the same way, equal days linked."""
    from pyspark.sql import functions as F

    days = spark.range(73_049).select(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")).alias("d"))
    styles = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"]
    written = days.select(F.explode(F.array(*[F.date_format("d", x) for x in styles])).alias("m")).distinct()
    out = written.select("m", private.pseudonym("k", F.col("m")).alias("p"))
    first = lambda c: F.try_to_date(F.col(c), "dd/MM/yyyy").isNotNull()
    month = lambda c: F.try_to_date(F.col(c), "MM/dd/yyyy").isNotNull()
    way = lambda c: F.when(F.col(c).rlike("^[0-9]{4}-"), 0).when(first(c), 1).when(month(c), 2).otherwise(3)
    found = out.agg(F.count("*").alias("n"), F.count_distinct("p").alias("p"), F.sum((way("m") != way("p")).cast("int")).alias("other"), F.sum((F.col("m") == F.col("p")).cast("int")).alias("same")).first()
    assert found.n == found.p == 2 * 73_049 + 44_249 and found.other == 0 and found.same < 60
    assert spark.createDataFrame([("1977-03-24", "24/03/1977")], "a string, b string").where(F.date_format(F.to_date(private.pseudonym("k", F.col("a"))), "dd/MM/yyyy") == private.pseudonym("k", F.col("b"))).count() == 1


def slow_pseudonyms(text, key):
    """The same by plain code, a match at a time."""
    import hashlib
    from datetime import date, timedelta

    def feistel(kind, a, m1, b, m2):
        for r in range(8):
            h = int(hashlib.sha256(f"{key}|{kind}|{r}|{b if r % 2 == 0 else a}|{key}".encode()).hexdigest()[:12], 16)
            a, b = ((a + h) % m1, b) if r % 2 == 0 else (a, (b + h) % m2)
        return a, b

    def fill(m, digits):
        it = iter(digits)
        return "".join(next(it) if c in "0123456789" else c for c in m)

    def card(m):
        d = re.sub("[^0-9]", "", m)
        if not (13 <= len(d) <= 19 and luhn(d)):
            return m
        half = (len(d) - 1) // 2
        rest = len(d) - 1 - half
        a, b = feistel("card", int(d[:half]), 10**half, int(d[half:-1]), 10**rest)
        body = f"{a:0{half}d}{b:0{rest}d}"
        return fill(m, body + next(c for c in "0123456789" if luhn(body + c)))

    def phone(m):
        d = re.sub("[^0-9]", "", m)
        lead, d = d[:-10], d[-10:]
        low, size = (0, 20_000) if int(d[:3]) < 200 else (200, 80_000)
        a, b = feistel("phone", (int(d[:3]) - low) * 100 + int(d[6:8]), size, (int(d[3]) - 2) * 10_000 + int(d[4:6]) * 100 + int(d[8:]), 80_000)
        return fill(m, f"{lead}{a // 100 + low:03d}{b // 100 + 200:03d}{a % 100:02d}{b % 100:02d}")

    def ssn(m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        areas = [x for x in range(1, 900) if x != 666]
        a, b = feistel("ssn", areas.index(area) * 99 + group - 1, 898 * 99, serial - 1, 9999)
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"

    def valid(y, mo, d):
        try:
            return date(y, mo, d)
        except ValueError:
            return None

    def dated(m):
        iso = m[4] == "-"
        y, mo, d = map(int, m.split("-")) if iso else (int(m[6:]), int(m[3:5]), int(m[:2]))
        x = valid(y, mo, d)
        if x:
            n = (x - date(1900, 1, 1)).days
            a, b = feistel("date", n // 4297, 17, n % 4297, 4297)
            return (date(1900, 1, 1) + timedelta(a * 4297 + b)).strftime("%Y-%m-%d" if iso else "%d/%m/%Y")
        if iso or not valid(y, d, mo):
            return m
        mo, d = d, mo
        if (mo, d) == (2, 29):
            years = [y for y in range(1900, 2100) if valid(y, 2, 29)]
            at = years.index(y)
            a, b = feistel("leap day", at // 7, 7, at % 7, 7)
            return f"02/29/{years[a * 7 + b]}"
        late = [(i, k) for i in range(1, 13) for k in range(13, 32) if valid(1901, i, k)]
        a, b = feistel("month first", y - 1900, 200, late.index((mo, d)), 221)
        return f"{late[b][0]:02d}/{late[b][1]:02d}/{a + 1900}"

    def ip(m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = feistel("ip", o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    email = lambda m: f"user-{hashlib.sha256(f'{key}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid"
    made = {"email": email, "secret": lambda m: "[secret]", "ip": ip, "ssn": ssn, "phone": phone, "date": dated, "card": card}
    one = lambda m: next(made[k](m) for k, p in private.PATTERNS.items() if re.fullmatch(p, m))
    return re.sub(private.ANY, lambda m: one(m[0]), text, flags=re.ASCII)


def test_pseudonyms_by_plain_code(spark):
    import random

    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(150):
        body = digits(r.choice([12, 14, 15, 18]))
        number = body + next(c for c in "0123456789" if luhn(body + c))
        parts = [
            number, " ".join(number[i : i + 4] for i in range(0, 16, 4)) if len(number) == 16 else digits(9), f"({digits(3)}) {r.randrange(2, 10)}{digits(2)}-{digits(4)}", f"+1 {digits(3)}.{digits(3)}.{digits(4)}",
            f"{digits(3)}-{digits(2)}-{digits(4)}", f"{r.choice([19, 20])}{digits(2)}-{r.randrange(1, 14):02d}-{r.randrange(1, 33):02d}", f"{r.randrange(1, 33):02d}/{r.randrange(1, 33):02d}/{r.choice([19, 20])}{digits(2)}",
            f"{r.randrange(300)}.{r.randrange(300)}.{r.randrange(20)}.1", f"A{digits(2)}b@mail{digits(1)}.example.org", f"api_key: {digits(14)}", "AKIA" + digits(16), "02/29/2004", "plain words",
        ]
        r.shuffle(parts)
        texts.append("; ".join(parts))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in private.pseudonymize(made, "k").collect():
        assert x.text == slow_pseudonyms(texts[x.doc_id], "k")
    clash = private.pseudonymize(made.selectExpr("doc_id", "7 AS n_found", "text"), "k")
    assert clash.columns == ["doc_id", "text", "n_found", "n_replaced"] and clash.where("n_found > 5").count() > 100


# Backoff


def slow_backoff(texts, cutoff=2):
    split_ = [split((t or "").lower()) for t in texts]
    one = Counter(w for t in split_ for w in t)
    two = Counter(p for t in split_ for p in pairwise(t))
    n = sum(one.values())

    def s(t, i):
        if i and two[t[i - 1], t[i]] >= cutoff:
            return math.log(two[t[i - 1], t[i]] / one[t[i - 1]])
        return math.log(one[t[i]] / n) + (math.log(0.4) if i else 0)

    return [(len(t), sum(s(t, i) for i in range(len(t))) / len(t) if t else None) for t in split_]


@pytest.mark.parametrize("sizes", [{}, {"block": 300, "bucket": 40}])
def test_backoff(docs, none, sizes):
    texts = [r.text for r in docs.select("text").collect()]
    want = sorted((n, x if x is None else round(x, 6)) for n, x in slow_backoff(texts) if n)
    rows = backoff.score(docs, **sizes).collect()
    got = sorted((r.n_words, round(r.log_score, 6)) for r in rows if r.n_words)
    assert len(rows) == docs.count()
    assert [n for n, _ in got] == [n for n, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-6)
    assert all(r.log_score is None and r.n_words == 0 for r in rows if not r.n_words)
    assert backoff.score(none, **sizes).count() == 0


def slow_trigrams(texts, cutoff=2):
    split_ = [split((t or "").lower()) for t in texts]
    count = Counter(tuple(t[i : i + n]) for t in split_ for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = sum(len(t) for t in split_)

    def s(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        return math.log(count[gram] / count[gram[:-1]]) if count[gram] >= cutoff else math.log(0.4) + s(gram[1:])

    return [sum(s(tuple(t[max(0, i - 2) : i + 1])) for i in range(len(t))) / len(t) for t in split_ if t]


def test_trigrams_and_long_texts(spark):
    """Order three against brute force; texts cut into pieces and put into blocks give the same."""
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice("a b c d e f".split()) for _ in range(n)) + r.choice(["", " ", "\n"]) for n in (1, 2, 3, 40, 400, 4000)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_trigrams(texts)
    for sizes in ({}, {"block": 100, "bucket": 50}):
        got = [x.log_score for x in backoff.score(made, order=3, **sizes).orderBy("doc_id").collect()]
        assert got == pytest.approx(want, abs=1e-9)
    batch = made.toArrow().combine_chunks().to_batches()[0]
    whole = [h.tolist() for _, h, _ in backoff.blocked(iter([batch, batch]))]
    cut = [h.tolist() for _, h, _ in backoff.blocked(iter([batch, batch]), most=50)]
    assert sum(whole, []) == sum(cut, []) and len(cut) > len(whole) == 1


def test_keys_are_those_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    u, s = np.array([0, 1, -5, 2**62]), np.array([7, -1, 2**63 - 1, 0])
    made = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, s, strict=True)], "u long, s long")
    assert [x.k for x in made.select(F.xxhash64("u", "s").alias("k")).collect()] == backoff.joined(u.view(np.uint64), s.view(np.uint64)).view(np.int64).tolist()


# Lines


def slow_similar(a, b, k=9):
    grams = lambda s: {s[i : i + k] for i in range(max(1, len(s) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_fuzzy_lines(spark, docs, none):
    import random

    r = random.Random(3)
    base = [" ".join("".join(r.choice("abcdefgéñ") for _ in range(6)) for _ in range(30)) for _ in range(12)]
    texts = []
    for k, x in enumerate(base):
        near = x[:100] + "#" + x[101:]
        texts += [(3 * k, f"{x}\nshort"), (3 * k + 1, f"\n  {near}\nshort\nown {k}"), (3 * k + 2, f"{x}  \n{x}")]
    crowd = base[0]
    texts += [(100 + k, crowd[:k] + "~" + crowd[k + 1 :]) for k in range(5, 95)]
    got = {x.doc_id: x for x in lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    everything = sorted({x.strip() for _, t in texts for x in t.split("\n") if x.strip()})
    root = {x: x for x in everything}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(everything):
        for b in everything[:i]:
            if slow_similar(a, b) >= 0.8:
                root[find(a)] = find(b)
    seen, want = set(), {}
    for d, t in sorted(texts):
        gone = []
        for at, x in enumerate(t.split("\n")):
            if x.strip():
                if find(x.strip()) in seen:
                    gone.append(at)
                seen.add(find(x.strip()))
        want[d] = gone
    agree = sum(got[d].dropped == want[d] for d in want)
    assert agree >= 0.97 * len(want)
    assert lines.duplicates(docs).count() == docs.count() and lines.duplicates(none).count() == 0
    cleaned = {x.doc_id: x.text for x in lines.clean(spark.createDataFrame(texts[:3], "doc_id long, text string")).collect()}
    assert cleaned[0] == texts[0][1] and cleaned[2] == ""


def test_repeated_rows_and_ids(spark):
    """Rows alike keep a line once; of rows of one doc_id each loses its own places."""
    rows = [(1, "A LINE OF ITS OWN\nseen in both"), (1, "seen in both\nKEEP ONE\nmore"), (2, "twice the same\n\nrow"), (2, "twice the same\n\nrow"), (None, "row"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_lines", "'x' AS dropped")
    out = lines.clean(docs)
    assert out.columns == docs.columns
    kept = [x for r in out.collect() if r.text for x in r.text.split("\n") if x]
    assert sorted(kept) == sorted({x for _, t in rows if t for x in t.split("\n") if x})
    assert sum(r.n_dropped for r in lines.duplicates(docs).collect()) == 1 + 2 + 1


def test_recall_of_bands(spark):
    """Pairs of lines at similarity 0.8 and 0.9, short and long: nine in ten are found, and nothing below 0.8."""
    import random

    r = random.Random(9)
    texts, pairs = {}, []
    for k in range(400):
        n = r.choice([60, 120, 300])
        x = "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
        y = x
        while slow_similar(x, y) > r.choice([0.82, 0.92]) and slow_similar(x, y) > 0.805:
            at = r.randrange(n)
            z = y[:at] + r.choice("QRSTUV") + y[at + 1 :]
            if slow_similar(x, z) < 0.8:
                break
            y = z
        texts[2 * k], texts[2 * k + 1] = x, y
        pairs.append((2 * k, 2 * k + 1))
    found = {tuple(sorted(e)) for e in lines.similar_lines(spark.createDataFrame(list(texts.items()), "id long, line string")).collect()}
    assert all(slow_similar(texts[a], texts[b]) >= 0.8 for a, b in found)
    assert sum(p in found for p in pairs) >= 0.95 * len(pairs)


def test_crowds_of_different_lines_link_exactly(spark):
    """Boilerplate of few phrases with a letter changed: many share every rare shingle, and few are similar to any one hub."""
    import random

    r, texts = random.Random(8), set()
    for k in range(4):
        base = "".join(r.choice("abcdefgh ") for _ in range(60)) + "the same words at the end of all of them " + "xyzw"[k] * 9
        for _ in range(70):
            at = r.randrange(len(base))
            texts.add(base[:at] + r.choice("ABCDEFGH") + base[at + 1 :])
    texts = sorted(texts)
    edges = lines.similar_lines(spark.createDataFrame(list(enumerate(texts)), "id long, line string"), bands=24, rows=1).collect()

    def groups(pairs):
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return [find(x) == find(y) for x in range(len(texts)) for y in range(x)]

    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if slow_similar(a, b) >= 0.8]
    assert all(slow_similar(texts[e.a], texts[e.b]) >= 0.8 for e in edges)
    assert groups([(e.a, e.b) for e in edges]) == groups(want)


def of_letters(r, n):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_lines_by_dataframes_only(spark, monkeypatch):
    """No Python runs on the executors."""

    def no_python(*_, **__):
        raise AssertionError("Python on the executors")

    docs = spark.createDataFrame([(1, "a line that is seen twice, but for one end\nits own"), (2, "a line that is seen twice, but for one end.")], "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, no_python)
    assert {r.doc_id: r.dropped for r in lines.duplicates(docs).collect()} == {1: [], 2: [0]}


def test_crowd_that_shares_a_passage(spark, monkeypatch):
    """Of lines that are alike by a long passage, but not enough, hardly any pairs are compared; all near copies among them are found."""
    import random

    r = random.Random(12)
    passage = of_letters(r, 300)
    own = [of_letters(r, 28) + passage + of_letters(r, 29) for _ in range(150)]
    near = [x[:3] + "#" + x[4:] for x in own[:20]]
    seen, compared = [], lines._compared

    def counted(texts, wanted, *more):
        seen.append(wanted.count())
        return compared(texts, wanted, *more)

    monkeypatch.setattr(lines, "_compared", counted)
    edges = lines.similar_lines(spark.createDataFrame(list(enumerate(own + near)), "id long, line string")).collect()
    assert {tuple(sorted(e)) for e in edges} == {(k, 150 + k) for k in range(20)}
    assert 20 <= sum(seen) < 500


def test_sketches_of_similar_lines_are_near(spark):
    """Pairs of just 0.8 are near by either sketch, those well below are not."""
    import random

    r, rows, want = random.Random(13), [], {}
    for k in range(300):
        share, part = (400, 2000, 6000)[k % 3], (0.8, 0.6)[k // 3 % 2]
        x = of_letters(r, share + 8)
        tail = round(share * (1 - part) / (2 * part))
        rows += [(2 * k, x + of_letters(r, tail - 1)), (2 * k + 1, x + of_letters(r, tail - 1))]
        want[2 * k] = part == 0.8
    made = lines._sketched(spark.createDataFrame(rows, "id long, line string"), 9)
    side = lambda s, odd: made.where(f"id % 2 = {odd}").select((made.id - odd).alias("id"), *[made[c].alias(f"{c}_{s}") for c in made.columns if c != "id"])
    got = {x.id: x.near for x in side("a", 0).join(side("b", 1), "id").select("id", lines._near(0.8).alias("near")).collect()}
    assert got == want


def test_short_and_repetitive_lines(spark):
    """Lines of four or more shingles and one more, and runs of one character of any length."""
    import random

    r, rows = random.Random(14), [(0, "-" * 50), (1, "-" * 700)]
    for k in range(1, 201):
        n = r.randrange(4, 24)
        x = of_letters(r, n + 8).replace(" ", "x")
        rows += [(2 * k, x), (2 * k + 1, x + of_letters(r, max(1, n // 4)).replace(" ", "y"))]
    found = {tuple(sorted(e)) for e in lines.similar_lines(spark.createDataFrame(rows, "id long, line string")).collect()}
    assert all(slow_similar(rows[a][1], rows[b][1]) >= 0.8 for a, b in found)
    assert (0, 1) in found and sum((2 * k, 2 * k + 1) in found for k in range(1, 201)) >= 196


def test_trimmed_and_sifted_lines(spark):
    """White space goes from both ends alone; all wanted ids pass the bitmap, and hardly any others."""
    from pyspark.sql import functions as F

    texts = [a + x + b for x in ("a b\tc", "é 漢", "x") for a in ("", " ", "\t\x0b ", " ") for b in ("", "\r", " \f")] + ["", " \r"]
    got = spark.createDataFrame([(x,) for x in texts], "line string").select("line", lines._trimmed(F.col("line")).alias("x")).collect()
    assert all(r.x == r.line.strip(lines.BLANK) for r in got)
    rows = spark.range(4000).select(F.xxhash64("id").alias("id"), F.col("id").alias("k"))
    found = {r.k for r in lines._sifted(rows, rows.where("k % 40 = 0").select("id")).collect()}
    assert found >= set(range(0, 4000, 40)) and len(found) < 120


def test_lines_of_a_megabyte(spark):
    """A pair of long near copies and one that shares half; time grows with the length."""
    import random
    import time

    r = random.Random(21)
    draw = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz \u6f22", k=n))
    long = draw(1 << 20)
    texts = [(1, f"short\n{long}"), (2, f"{long[: 1 << 19]}{draw(1 << 19)}\nown"), (3, f"own line\n{long[:500_000]}#{long[500_001:]}"), (4, "x" * (1 << 20)), (5, "x" * (1 << 19))]
    began = time.monotonic()
    got = {x.doc_id: x.dropped for x in lines.duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [1], 4: [], 5: [0]}
    assert time.monotonic() - began < 120
