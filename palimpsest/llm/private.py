"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel
network over two numbers, ``a`` below M1 and ``b`` below M2: rounds add a keyed hash of
one to the other, modulo its bound. Any such network is a permutation of all pairs, so
that equal values stay linked across documents and different ones stay apart, and its
result is again a valid value of the format:

- card numbers (13 to 19 digits that pass the Luhn check): all digits but the last are
  permuted, the last is set to pass the check again; spaces and hyphens stay.
- phone numbers of the North American plan: area and exchange codes stay valid; area codes
  below 200, which are not in use, become others below 200.
- social security numbers with valid area, group and serial.
- dates from 1900 to 2099, year first or last, that exist: permuted as day numbers. What
  can only be read month first (the day is over 12) becomes another such date, by year and
  by month and day, the 29th of February by leap year; so each way of writing is permuted
  within itself, and equal dates are linked if written day first or year first.
- IPv4 addresses: permuted as 32 bits.

E-mail addresses get a keyed name at a reserved domain, which also links equal ones;
secrets (cloud keys, tokens, passwords) are masked. What does not validate stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 = 17 x 4297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297
#: Days over 12 in the months of a common year before each month, and in all; years; leap years from 1904 to 2096 = 7 x 7.
LATE, LATE_DAYS, YEARS, LEAP = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202), 221, 200, 7

#: What to look for, by kind; the first kind that fits a match decides. No group is repeated without a bound but possessively,
#: since Java recurses for each repeat of others, and nothing that may be long is begun anew at each of its characters.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:token|password|passwd|secret|api_?key) ?[=:] ?\"?[A-Za-z0-9_\-+/]{12,}\"?)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9]|[/-][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+(?![0-9])",
}
#: A match of "card" is a whole run of digits, which may hold cards beside other numbers: in these groupings anywhere, in others at its end.
GROUPED = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these have nothing to look for.
HINT = r"[0-9@]|(?i:password|passwd|secret|token|key)"


def _round(key: str, kind: str, r: Column, number: Column) -> Column:
    """A keyed 48-bit hash as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), number.cast("string"), F.lit(key)), 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, m1: Column, b: Column, m2: Column) -> Column:
    """The keyed permutation of pairs (a < m1, b < m2), as a struct (a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _round(key, kind, r, s["b"]), m1)).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _round(key, kind, r, s["a"]), m2)).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part(d: Column, start: int, size: int) -> Column:
    return F.substring(d, start, size).cast("long")


def _zeros(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0") if isinstance(width, int) else F.lpad(number.cast("string"), width, F.lit("0"))


def _fill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    chars = F.split(m, "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        number = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(number, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + number.cast("int")).alias("at"))

    return F.aggregate(chars, state, step, lambda s: s["out"])


def _luhn(digits: Column, skip: int) -> Column:
    """Luhn sum; the digit ``skip`` places from the right counts single, the next double."""
    reverse = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when((i + skip) % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda a, x: a + x)


def _parts(m: Column) -> Column:
    """Digits and separators of a run in turn."""
    return F.regexp_extract_all(m, F.lit("[0-9]+|[ -]"), F.lit(0))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once; lambdas would compute an expression anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cards(parts: Column) -> Column:
    """Valid cards within the parts of a run, as structs (i, j, text) of the first and last part, by place; they may overlap."""
    last = F.size(parts) - 1
    # 19 digits have 18 separators at most.
    runs = lambda i: F.transform(F.sequence(i, F.least(i + 36, last), F.lit(2)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(parts, i + 1, j - i + 1), "").alias("text")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(2)), runs))
    right = F.filter(every, lambda c: F.char_length(_digits(c["text"])).between(13, 19) & (c["text"].rlike(GROUPED) | (c["j"] == last)) & (_luhn(_digits(c["text"]), 0) % 10 == 0))
    return _let(right, lambda found: _let(F.filter(found, lambda c: c["text"].rlike(GROUPED)), lambda grouped: F.when(F.size(grouped) > 0, grouped).otherwise(F.slice(found, 1, 1))))


def _card(key: str, m: Column) -> Column:
    """The run with each card in it replaced, from the left, the rest as it is; struct (out, n) with their number."""
    return _let(_parts(m), lambda parts: _cards_replaced(key, parts))


def _cards_replaced(key: str, parts: Column) -> Column:
    # Pieces are put together at the end: text that grows by each card would be copied for each.
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    until = lambda s, i: F.array_join(F.slice(parts, s["at"] + 1, F.greatest(i - s["at"], F.lit(0))), "")

    def step(s: Column, c: Column) -> Column:
        free = c["i"] >= s["at"]
        out = F.when(free, F.concat(s["out"], F.array(until(s, c["i"]), _new_card(key, c["text"])))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(free, c["j"] + 1).otherwise(s["at"]).alias("at"), (s["n"] + free.cast("int")).alias("n"))

    return F.aggregate(_cards(parts), state, step, lambda s: F.struct(F.concat(F.array_join(s["out"], ""), until(s, F.size(parts))).alias("out"), s["n"].alias("n")))


def _new_card(key: str, m: Column) -> Column:
    d = _digits(m)
    n = F.char_length(d)
    half = F.floor((n - 1) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    a, b = F.substr(d, F.lit(1), half), F.substr(d, half + 1, n - 1 - half)
    p = feistel(key, "card", a.cast("long"), power(half), b.cast("long"), power(n - 1 - half))
    body = lambda s: F.concat(_zeros(s["a"], half), _zeros(s["b"], n - 1 - half))
    whole = lambda s: F.concat(body(s), ((10 - _luhn(body(s), 1) % 10) % 10).cast("string"))
    return _fill(m, whole(p))


def _phone(key: str, m: Column) -> Column:
    d = F.right(_digits(m), F.lit(10))
    # Area codes below 200 are not in use, but written: they are permuted among themselves.
    unused = _part(d, 1, 3) < 200
    least = F.when(unused, 0).otherwise(200)
    a = (_part(d, 1, 3) - least) * 100 + _part(d, 7, 2)
    b = ((_part(d, 4, 1) - 2) * 100 + _part(d, 5, 2)) * 100 + _part(d, 9, 2)
    m1 = F.lit(80_000).cast("long")
    p = feistel(key, "phone", a, F.when(unused, F.lit(20_000).cast("long")).otherwise(m1), b, m1)
    code = lambda x, low=200: _zeros(F.floor(x / 100) + low, 3)
    tail = lambda x: _zeros(x % 100, 2)
    digits = F.concat(code(p["a"], least), code(p["b"]), tail(p["a"]), tail(p["b"]))
    return _fill(m, F.concat(F.substr(_digits(m), F.lit(1), F.char_length(_digits(m)) - 10), digits))


def _ssn(key: str, m: Column) -> Column:
    d = _digits(m)
    area, group, serial = _part(d, 1, 3), _part(d, 4, 2), _part(d, 6, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - (area > 666).cast("int")  # 898 areas
    p = feistel(key, "ssn", index * 99 + group - 1, F.lit(898 * 99).cast("long"), serial - 1, F.lit(9999).cast("long"))
    back = F.floor(p["a"] / 99) + 1
    digits = F.concat(_zeros(back + (back >= 666).cast("int"), 3), _zeros(p["a"] % 99 + 1, 2), _zeros(p["b"] + 1, 4))
    return F.when(valid, _fill(m, digits)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    d = _digits(m)
    ymd = m.rlike("^[0-9]{4}")
    iso = lambda y, mo, da: F.try_to_date(F.concat_ws("-", F.substring(d, y, 4), F.substring(d, mo, 2), F.substring(d, da, 2)), "yyyy-MM-dd")
    day_first = iso(5, 3, 1)
    date = F.when(ymd, iso(1, 5, 7)).otherwise(day_first)
    month_first = iso(5, 1, 3)
    number = F.datediff(date, F.to_date(F.lit(FIRST_DAY))).cast("long")
    p = feistel(key, "date", F.floor(number / DAYS_B), F.lit(DAYS_A).cast("long"), number % DAYS_B, F.lit(DAYS_B).cast("long"))
    new = F.date_add(F.to_date(F.lit(FIRST_DAY)), (p["a"] * DAYS_B + p["b"]).cast("int"))
    style = F.when(ymd, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return F.when(number.isNotNull(), style).when(~ymd & month_first.isNotNull(), _month_first(key, _part(d, 1, 2), _part(d, 3, 2), _part(d, 5, 4))).otherwise(m)


def _month_first(key: str, month: Column, day: Column, year: Column) -> Column:
    """A date whose day is over 12, month first, as another such."""
    before = F.array(*map(F.lit, LATE))
    leap_day = (month == 2) & (day == 29)
    p = feistel(key, "month first", year - 1900, F.lit(YEARS).cast("long"), F.get(before, month.cast("int") - 1) + day - 13, F.lit(LATE_DAYS).cast("long"))
    new = F.size(F.filter(before, lambda x: x <= p["b"]))
    common = F.concat_ws("/", _zeros(new, 2), _zeros(p["b"] - F.get(before, new - 1) + 13, 2), (p["a"] + 1900).cast("string"))
    # Of the years from 1900 to 2099 that are multiples of four all but the first have a leap day.
    at = F.floor((year - 1904) / 4)
    q = feistel(key, "leap day", F.floor(at / LEAP), F.lit(LEAP).cast("long"), at % LEAP, F.lit(LEAP).cast("long"))
    return F.when(leap_day, F.concat(F.lit("02/29/"), (1904 + 4 * (q["a"] * LEAP + q["b"])).cast("string"))).otherwise(common)


def _ip(key: str, m: Column) -> Column:
    octet = F.transform(F.split(m, "[.]"), lambda x: x.cast("long"))
    at = lambda i: F.get(octet, F.lit(i))
    m1 = F.lit(65_536).cast("long")
    p = feistel(key, "ip", at(0) * 256 + at(1), m1, at(2) * 256 + at(3), m1)
    text = F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
    return F.when(F.forall(octet, lambda x: x < 256), text).otherwise(m)


def _email(key: str, m: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match of ``ANY``."""
    made = {"email": _email(key, m), "secret": F.lit("[secret]"), "ip": _ip(key, m), "ssn": _ssn(key, m), "phone": _phone(key, m), "date": _date(key, m), "card": _card(key, m)["out"]}
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    return reduce(lambda e, k: e.when(m.rlike(whole[k]), made[k]), list(PATTERNS)[1:], F.when(m.rlike(whole["email"]), made["email"])).otherwise(m)


def _more(m: Column, key: str) -> Column:
    """Cards in a match beyond the first."""
    long = F.char_length(m) > 26  # two cards of 13 digits and what parts them
    return F.when(long & m.rlike(f"^(?:{PATTERNS['card']})$"), F.greatest(_card(key, m)["n"] - 1, F.lit(0))).otherwise(0)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the column text replaced, and columns ``n_found`` and ``n_replaced`` (long) put last, in the place of columns of those names.

    Null texts stay null with nothing found; texts without personal data stay as they
    are. ``n_found`` counts the places that look like personal data, ``n_replaced`` those
    that validated and were changed. Rows are independent of each other.
    """
    text = F.col("text").cast("string")
    hint = text.rlike(HINT)
    none = F.array().cast("array<string>")
    found = docs.select(F.struct("*").alias("__row"), text.alias("__text"), F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none).alias("__old"))
    new = found.withColumn("__new", F.transform("__old", lambda m: pseudonym(key, m)))
    gaps = F.when(F.size("__old") > 0, F.split("__text", ANY, -1)).otherwise(none)
    joined = F.concat(F.get("__gap", F.lit(0)), F.array_join(F.transform("__new", lambda x, i: F.concat(x, F.get("__gap", i + 1))), ""))
    out = new.withColumn("__gap", gaps).withColumn("__out", F.when(F.size("__old") > 0, joined).otherwise(F.col("__text")))
    more = F.aggregate("__old", F.lit(0), lambda n, m: n + _more(m, key))
    changed = F.size(F.filter(F.zip_with("__old", "__new", lambda a, b: a != b), lambda x: x))
    columns = [F.col("__out").alias(f.name) if f.name == "text" else F.col(f"__row.`{f.name}`") for f in docs.schema.fields if f.name not in ("n_found", "n_replaced")]
    return out.select(*columns, (F.greatest(F.size("__old"), F.lit(0)) + F.coalesce(more, F.lit(0))).cast("long").alias("n_found"), (F.greatest(changed, F.lit(0)) + F.coalesce(more, F.lit(0))).cast("long").alias("n_replaced"))
