"""Fuzzy line deduplication by MinHash over character shingles, in DataFrame operations only.

Lines are laid out in fixed-width code points, so that a shingle is a slice, and exploded.
Each shingle is hashed once: the range of hashes is cut into as many bins as there are
orders, and one aggregate keeps the least hash of each bin, an empty bin that of the next
one (one-permutation MinHash with rotation). Bands of these are the line's keys; components
of the similar pairs, by exact Jaccard similarity, keep their first line.

Lines of one band are not all paired: they are compared with hubs, which joins near-copies
at linear cost, and only those left in different components in blocks (``prefixes``). Pairs
whose sizes or sketches lie too far apart are not compared. A sketch has the parities of the
shingles under each of its bits, so that those of two lines differ in a bit for about every
shingle that only one of them has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import prefixes
from palimpsest.llm.common import SIEVE, drop_table, materialize, text_partitions
from palimpsest.llm.components import connected_components

#: Code points of a shingle, bands and hashes in a band, similarity, standard deviations that sketches may lie apart beyond the mean.
SHINGLE, BANDS, ROWS, SIMILAR, DEVIATIONS = 9, 8, 3, 0.8, 3.5
#: Bits of a sketch; a second one is of one shingle in ``THINNED``, for pairs that have more shingles than ``FULL``.
BITS, THINNED, FULL = 512, 8, 2400
#: Bins with a shingle of their own up to which a line, as it has few shingles, has each ``EVERY``-th bin alone as a key too.
SPARSE, EVERY = 16, 3
#: White space around a line.
BLANK = " \t\n\x0b\f\r"


def _trimmed(line: Column) -> Column:
    """Less the white space around it; only lines that have some are gone through from end to end."""
    some = [f(line, F.lit(x)) for x in BLANK for f in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, some), F.btrim(line, F.lit(BLANK))).otherwise(line)


def _sifted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows(id, ...)`` whose ids are among ``ids(id)``, and some others: by a bitmap of ``SIEVE`` bits in words of 64, 16 MB whatever the input."""
    bit = F.col("id").bitwiseAND(F.lit(SIEVE - 1))
    place = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    words = ids.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(place).alias("bits"))
    met = rows.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(words), "word")
    return met.where(F.col("bits").bitwiseAND(place) != 0).select(*rows.columns)


def _wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def _starts(wide: str, shingle: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 4 * shingle + 1, F.lit(1)), F.lit(4))


def _shingle(wide: str, at: Column, shingle: int) -> Column:
    """The hash of the shingle at a place of a column of ``_wide`` lines; a line shorter than one is one shingle."""
    return F.xxhash64(F.substr(F.col(wide), at, F.lit(4 * shingle)))


def _shingles(wide: str, shingle: int) -> Column:
    """The hashes of the different shingles; the line is the variable of an outer lambda, since an inner one would copy a column anew for each place."""
    each = lambda w: F.array_distinct(F.transform(_starts(wide, shingle), lambda i: F.xxhash64(F.substr(w, i, F.lit(4 * shingle)))))
    return F.get(F.transform(F.array(F.col(wide)), each), F.lit(0))


def _hashed(lines: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``lines(..., line)`` but the line, and ``x``, the hash of each of its shingles, a row for each place.

    Places are exploded, which Spark compiles; a lambda over them would fetch the whole line for each one.
    """
    rest = [c for c in lines.columns if c != "line"]
    wide = lines.select(*rest, _wide(F.col("line")).alias("wide"))
    # Outer, though there is always one: else a filter on the array's size is put below, which makes it twice.
    each = wide.select(*rest, "wide", F.explode_outer(_starts("wide", shingle)).alias("at"))
    return each.select(*rest, _shingle("wide", F.col("at"), shingle).alias("x"))


def signatures(lines: DataFrame, shingle: int, orders: int) -> DataFrame:
    """``id, m0, m1, ...`` from ``lines(id, line)``, where rows of one id are alike: the least hash in each of ``orders`` bins, null in empty ones."""
    hashed = _hashed(lines.select("id", "line"), shingle)
    binned = hashed.select("id", "x", F.expr(f"cast(shiftright(shiftrightunsigned(x, 32) * {orders}L, 32) AS int)").alias("bin"))
    return binned.groupBy("id").agg(*[F.min(F.when(F.col("bin") == k, F.col("x"))).alias(f"m{k}") for k in range(orders)])


def _keyed(lines: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, keys``: a key for each band; lines of few shingles, whose bins repeat each other's, have keys of single bins too."""
    orders = bands * rows
    full = signatures(lines, shingle, orders).select(
        "id",
        sum((F.col(f"m{k}").isNotNull().cast("int") for k in range(orders)), F.lit(0)).alias("bins"),
        *[F.coalesce(*[f"m{(k + j) % orders}" for j in range(orders)]).alias(f"m{k}") for k in range(orders)],
    )
    # The bins of a band lie far apart, so that one shingle doesn't stand for several of them.
    banded = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b + r * bands}") for r in range(rows)]) for b in range(bands)])
    single = F.array(*[F.xxhash64(F.lit(-1 - k), F.col(f"m{k}")) for k in range(0, orders, EVERY)])
    return full.select("id", F.when(F.col("bins") <= SPARSE, F.concat(banded, single)).otherwise(banded).alias("keys"))


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, size, s0, s1, ...`` of ``texts(id, line)``: the number of different shingles, a sketch of all and one of those thinned."""
    # Dealt by id as lines, and by number, so that tasks are not put together by bytes: what follows is many times larger, and needs no other exchange.
    dealt = texts.select("id", "line").repartition(text_partitions(texts.sparkSession), "id")
    each = _hashed(dealt, shingle).distinct()
    bits = each.select(
        "id",
        F.expr(f"cast(shiftright(x, 6) & {BITS // 64 - 1} AS int)").alias("word"),
        F.expr("shiftleft(1L, cast(x & 63 AS int))").alias("bit"),
        (F.shiftright("x", 20).bitwiseAND(F.lit(THINNED - 1)) == 0).alias("thin"),
    )
    own = lambda k: F.col("word") == k
    full = [F.bit_xor(F.when(own(k), F.col("bit")).otherwise(0)) for k in range(BITS // 64)]
    thinned = [F.bit_xor(F.when(own(k) & F.col("thin"), F.col("bit")).otherwise(0)) for k in range(BITS // 64)]
    return bits.groupBy("id").agg(F.count("*").alias("size"), *[x.alias(f"s{k}") for k, x in enumerate(full + thinned)])


def _near(similar: float) -> Column:
    """Whether the sketches of two sides differ in so few bits that they can be ``similar``: by the normal law one pair in 4,000 of just that similarity does not.

    Shingles that only one of two lines has are, at that similarity, a fixed part of the sum of both lines' shingles.
    """
    both = F.col("size_a") + F.col("size_b")
    words = BITS // 64

    def within(first: int, part: float) -> Column:
        apart = both * ((1 - similar) / (1 + similar) * part)
        left = F.exp(apart * (-2 / BITS))
        mean = (1 - left) * (BITS / 2)
        # Of parities, and of the number of shingles that the thinned have.
        spread = (1 - left * left) * (BITS / 4) - apart * left * left + apart * (1 - part) * left * left
        bits = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(first, first + words)), F.lit(0))
        return bits <= mean + F.sqrt(F.greatest(spread, F.lit(0.0))) * DEVIATIONS + 1

    return F.when(both <= FULL, within(0, 1.0)).otherwise(within(words, 1 / THINNED))


def _compared(texts: DataFrame, wanted: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Those of the pairs ``wanted(a, b)`` of ``texts(id, line)`` that have similarity ``similar`` or more."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("line").alias(f"l{s}"))
    # Pairs travel with their lines, which are far smaller than the lines' shingles.
    both = wanted.join(side("a"), "a").join(side("b"), "b")
    wide = both.select("a", "b", _wide(F.col("la")).alias("wa"), _wide(F.col("lb")).alias("wb"))
    sets = wide.select("a", "b", _shingles("wa", shingle).alias("sa"), _shingles("wb", shingle).alias("sb"))
    # Written before it is filtered: a filter would move below, and make the shingles anew within itself.
    common = materialize(sets.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n")), "compared")
    return common.where(F.col("n") >= similar * (F.col("na") + F.col("nb") - F.col("n")) - 1e-9).select("a", "b")


def _linked(lines: DataFrame, shingle: int, bands: int, rows: int, similar: float, often: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` between ids of ``lines(id, line)``, where rows of one id are alike.

    Lines that ``often(id, n)`` has most often are compared first: others are mostly copies of them.
    """
    signed = materialize(_keyed(lines, shingle, bands, rows), "signed")
    # Dealt once, for both sides of the join.
    keyed = signed.select("id", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    todo = materialize(keyed.join(shared.hint("shuffle_hash"), "key", "left_semi"), "keyed")
    ids = materialize(todo.select("id").distinct(), "wanted")
    # Not a semi join, which would be moved below the bitmap's: ids are different.
    texts = materialize(_sifted(lines, ids).join(ids.hint("shuffle_hash"), "id").groupBy("id").agg(F.any_value("line").alias("line")), "texts")
    words = materialize(_sketched(texts, shingle), "sketches")
    # A band stands in the place of a prefix of one element; the sizes bound what two sets share.
    prefix = todo.join(words.select("id", "size"), "id").select("key", "id", F.lit(1).alias("at"), F.col("size").alias("n"))
    if often is not None:
        prefix = prefix.join(often.select("id", F.col("n").alias("times")), "id", "left").select("key", "id", "at", "n", F.coalesce("times", F.lit(1)).alias("weight"))
    edges = prefixes.links(prefix, lambda wanted: _compared(texts, wanted, shingle, similar), similar, words, near=_near(similar))
    for t in (signed, todo, ids, texts, words):
        drop_table(t)
    return edges


def similar_lines(lines: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """Edges ``(a, b)`` that connect those ids of ``lines(id, line)`` which pairs of similarity ``similar`` or more with a common key connect."""
    there = lines.where("line IS NOT NULL").select(F.col("id").cast("long").alias("id"), "line")
    return _linked(there, shingle, bands, rows, similar)


def _judged(docs: DataFrame, keep: list[Column], *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """The columns ``keep`` of every row of docs, ``n_lines``, and the places ``dropped``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.lit(2**63 - 1)
    named = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), last).alias("__d"), F.xxhash64(text).alias("__t"), text.alias("__s"))
    each = named.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.posexplode_outer(F.split("__s", "\n", -1)).alias("at", "line"))
    each = each.select("d", "t", "at", _trimmed(F.col("line")).alias("line")).where("line <> ''").select("d", "t", "at", F.xxhash64("line").alias("id"), "line")
    placed = materialize(each.select("d", "t", "at", "id"), "placed")
    often = materialize(placed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "often")
    edges = _linked(each.select("id", "line"), shingle, bands, rows, similar, often)
    roots = connected_components(edges)
    repeated = often.select("id").join(roots.select(F.col("node").alias("id"), "root"), "id", "full").select("id", F.coalesce("root", "id").alias("root"))
    repeated = materialize(repeated, "repeated")
    there = materialize(placed.select("d", "t", "at", "id").join(repeated, "id").select("d", "t", "at", "root"), "places")
    order = F.struct("d", "t", "at")
    first = materialize(there.groupBy("root").agg(F.min(order).alias("first")), "first")
    lost = there.join(first, "root").where(order != F.col("first")).select("d", "t", "at").distinct()
    gone = materialize(lost.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.array_sort(F.collect_list("at")).alias("__dropped")), "dropped")
    for t in (placed, often, edges, repeated, there, first):
        drop_table(t)
    filled = F.filter(F.transform(F.split("__s", "\n", -1), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    counted = named.select(*[c for c in named.columns if c != "__s"], filled.alias("__filled"))
    # Of rows alike in doc_id and text one has its turn first; the lines of the others all repeat its own.
    turn = F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.lit(0)))
    met = counted.join(gone, ["__d", "__t"], "left").withColumn("__turn", turn)
    dropped = F.when(F.col("__turn") > 1, F.col("__filled")).otherwise(F.coalesce("__dropped", F.array().cast("array<int>")))
    return met.select(*[c for c in named.columns if not c.startswith("__") or c == "__row"], F.size("__filled").cast("long").alias("n_lines"), dropped.alias("dropped"))


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` for every row of ``docs(doc_id, text, ...)``.

    A line is what lies between line feeds, less the white space around it; blank lines
    are neither counted nor dropped. Of each component of similar lines, equal ones
    included, the first stays in order of doc_id (nulls last), hash of the text and
    place. ``dropped`` lists the others' places among the lines, from 0 on. Null texts have
    no lines. Of rows alike in doc_id and text one counts as the first, the others drop
    all their lines. Other columns play no part.
    """
    found = _judged(docs, [F.col("doc_id").cast("long").alias("doc_id")], **options)
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; null texts stay null."""
    found = _judged(docs, [F.struct("*").alias("__row")], **options)
    text = F.col("__row.text").cast("string")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i))
    new = F.when(F.size("dropped") == 0, text).otherwise(F.array_join(kept, "\n"))
    return found.select(*[new.alias(f.name) if f.name == "text" else F.col(f"__row.`{f.name}`") for f in docs.schema.fields])
