"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs: its lines, and within a line at those ends of
sentences that a letter of CUT_BEFORE follows.  Such cuts depend on the text around
them alone, so an inserted sentence moves none but its own.  The set of the
paragraphs' 64-bit digests is the document.

The sketch deals the digests by a hash to 2**k segments, the least k with SEGMENT
of them in a segment on average at most.  A segment is a table of 3 * third cells: a
digest falls into one cell of each third, and a cell holds a count, the XOR of its
digests and the XOR of their checks.  Peeling recovers the digests of a table: a
cell with a count of one whose check fits holds one digest, which then leaves its
other cells, and so on.  A segment that doesn't peel is built anew with twice the
cells, up to THIRDS[-1]; past that, each digest has a cell of its own.  So every
sketch can be peeled whole, and its digests are known from it alone.

Two sketches are compared segment by segment: the cells subtract (counts subtract,
the rest is XORed), what the versions share cancels out, and peeling recovers what
differs, with its sign.  Where that fails - more differences than the table holds,
or sizes that don't fit each other - both are peeled whole and the digests
recovered are compared.  Either way the result is a function of the two sketches.

The printed fingerprint is the sketch, all of it: the number of digests, then for
each segment its third and its cells.  Likeness is 1 - d / (a + b) for d recovered
digests of a and b in the versions; it can be computed from two printed
fingerprints.  Everything is an expression of a single row, without any UDF; work
grows in proportion to the text.

Defined results: null is the empty text; two texts without paragraphs are alike
(1.0), one without is unlike any with (0.0); documents come by descending doc_id,
rows that tie by their text, rows without doc_id last, by their text; the last
one's next is the first; a single document is its own next; columns of other names
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEGMENT = 8
#: Cells in a third of a segment's table, at the first try and the next ones.
THIRDS = (6, 12, 24, 48, 96)
BUCKET_DOCS = 256
QUANTILES = 256
#: Ranges for each of which one row goes through a window in one task.
CHAIN = 1024
CUT_BEFORE = "A-D"
PIECE = rf"[^\n]+?[.!?](?=[ \t\x0b\f\r]+[{CUT_BEFORE}])|[^\n]+"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def digests(text: Column) -> Column:
    """Sorted distinct digests of the paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _entry(d: Column, third: int) -> Column:
    """A digest with its check and its cells."""
    spot = [(F.pmod(F.shiftright(d, 21 * i), F.lit(third)) + third * i).cast("int").alias(f"p{i}") for i in range(3)]
    return F.struct(d.alias("d"), F.hash(d).alias("h"), *spot)


def _in(e: Column, j: Column) -> Column:
    return (e["p0"] == j) | (e["p1"] == j) | (e["p2"] == j)


def _cell(j: Column, c: Column, k: Column, x: Column) -> Column:
    return F.struct(j.alias("j"), c.alias("c"), k.alias("k"), x.alias("x"))


def cells(ds: Column, third: int) -> Column:
    """The table of a set of digests: array of (j, c, k, x)."""
    return _let(
        F.transform(ds, lambda d: _entry(d, third)),
        lambda es: F.transform(
            F.sequence(F.lit(0), F.lit(3 * third - 1)),
            lambda j: F.aggregate(F.filter(es, lambda e: _in(e, j)), _cell(j, F.lit(0), F.lit(0).cast("bigint"), F.lit(0)), lambda a, e: _cell(a["j"], a["c"] + 1, a["k"].bitwiseXOR(e["d"]), a["x"].bitwiseXOR(e["h"]))),
        ),
    )


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["j"], x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["x"].bitwiseXOR(y["x"])))


def _some(z: Column) -> Column:
    return (z["c"] != 0) | (z["k"] != 0) | (z["x"] != 0)


def peeled(table: Column, third: int, rounds: int = 24) -> Column:
    """Digests that a table or a difference of tables holds, as array of (c, d), c 1 or -1; null if it can't be peeled."""

    def peel(st: Column, _: Column) -> Column:
        pure = F.filter(st["cells"], lambda z: (F.abs(z["c"]) == 1) & (F.hash(z["k"]) == z["x"]))
        found = F.array_distinct(F.transform(pure, lambda z: F.struct(z["c"].alias("c"), _entry(z["k"], third).alias("e"))))

        def less(z: Column, f: Column) -> Column:
            return F.aggregate(F.filter(f, lambda e: _in(e["e"], z["j"])), z, lambda a, e: _cell(a["j"], a["c"] - e["c"], a["k"].bitwiseXOR(e["e"]["d"]), a["x"].bitwiseXOR(e["e"]["h"])))

        after = _let(found, lambda f: F.struct(F.filter(F.transform(st["cells"], lambda z: less(z, f)), _some).alias("cells"), F.concat(st["found"], F.transform(f, lambda x: F.struct(x["c"].alias("c"), x["e"]["d"].alias("d")))).alias("found"), (F.size(f) > 0).alias("on")))
        return F.when(~st["on"] | (F.size(st["cells"]) == 0), st).otherwise(after)

    begin = F.struct(F.filter(table, _some).alias("cells"), F.expr("CAST(array() AS array<struct<c:int,d:bigint>>)").alias("found"), F.lit(True).alias("on"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, peel)
    return _let(end, lambda st: F.when(F.size(st["cells"]) == 0, st["found"]))


def _dealt(ds: Column, outer: Column, inner: Column) -> Column:
    """Digests dealt to outer * inner segments: array of arrays, in two steps."""

    def deal(xs: Column, n: Column, salt: int) -> Column:
        return _let(F.transform(xs, lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.lit(salt)), n).alias("s"))), lambda ps: F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.filter(ps, lambda p: p["s"] == s), lambda p: p["d"])))

    return F.flatten(F.transform(deal(ds, outer, 1), lambda xs: deal(xs, inner, 2)))


def _segment(ds: Column) -> Column:
    """(third, cells, found): the table of a segment at the first size at which it peels, and what peeling it recovers."""

    def kept(third: Column, table: Column, found: Column) -> Column:
        return F.struct(third.alias("third"), table.alias("cells"), found.alias("found"))

    def tried(third: int) -> Column:
        both = _let(cells(ds, third), lambda t: F.struct(t.alias("t"), peeled(t, third).alias("f")))
        # Two digests may look like one whose check fits: only the whole set counts.
        return _let(both, lambda x: _let(F.array_sort(F.transform(x["f"], lambda y: y["d"])), lambda f: F.when(f == ds, kept(F.lit(third), x["t"], ds))))

    plain = kept(F.lit(0), F.transform(ds, lambda d, i: _cell(i, F.lit(1), d, F.hash(d))), ds)
    return F.when(F.size(ds) == 0, plain).otherwise(F.coalesce(*[tried(t) for t in THIRDS], plain))


def sketch(ds: Column) -> Column:
    """(n, segments) of a sorted set of digests."""

    def power(x: Column) -> Column:
        return F.pow(F.lit(2.0), x).cast("int")

    def of(ds: Column) -> Column:
        k = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.lit(1), F.size(ds)).cast("double") / SEGMENT)).cast("double"))
        dealt = _let(k, lambda k: _dealt(ds, power(F.ceil(k / 2)), power(F.floor(k / 2))))
        return F.struct(F.size(ds).alias("n"), F.transform(dealt, _segment).alias("segments"))

    return _let(ds, of)


def printed(s: Column) -> Column:
    """The sketch in hexadecimal digits: n (8), then of each segment: third (2), number of cells (4), of each cell its count (4), check (8), digests (16)."""

    def number(x: Column, digits: int) -> Column:
        return F.lpad(F.hex(x.cast("bigint")), digits, "0")

    def cell(z: Column) -> Column:
        return F.concat(number(F.shiftleft(z["c"].cast("bigint"), 32) + z["x"].cast("bigint").bitwiseAND(0xFFFFFFFF), 12), number(z["k"], 16))

    def segment(x: Column) -> Column:
        return F.concat(number(F.shiftleft(x["third"], 16) + F.size(x["cells"]), 6), F.array_join(F.transform(x["cells"], cell), ""))

    return F.concat(number(s["n"], 8), F.array_join(F.transform(s["segments"], segment), ""))


def differences(a: Column, b: Column) -> Column:
    """(a, b): the digests in the first sketch alone and in the second alone, recovered by peeling."""

    def both(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    def signed(f: Column, sign: int) -> Column:
        return F.transform(F.filter(f, lambda x: x["c"] == sign), lambda x: x["d"])

    def whole(x: Column, y: Column) -> Column:
        return both(F.array_except(x, y), F.array_except(y, x))

    def segment(x: Column, y: Column) -> Column:
        fits = (x["third"] == y["third"]) & (x["third"] > 0)
        found = F.when(fits & (x["third"] == THIRDS[0]), peeled(subtracted(x["cells"], y["cells"]), THIRDS[0]))
        found = found.when(fits & (x["third"] == THIRDS[1]), peeled(subtracted(x["cells"], y["cells"]), THIRDS[1]))
        return _let(found, lambda f: F.when(f.isNotNull(), both(signed(f, 1), signed(f, -1))).otherwise(whole(x["found"], y["found"])))

    def all_of(s: Column) -> Column:
        return F.flatten(F.transform(s["segments"], lambda x: x["found"]))

    parts = F.zip_with(a["segments"], b["segments"], segment)
    by_segment = _let(parts, lambda ps: both(F.flatten(F.transform(ps, lambda p: p["a"])), F.flatten(F.transform(ps, lambda p: p["b"]))))
    return F.when(F.size(a["segments"]) == F.size(b["segments"]), by_segment).otherwise(whole(all_of(a), all_of(b)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two sketches."""
    held = a["n"] + b["n"]
    differing = _let(differences(a, b), lambda d: F.size(d["a"]) + F.size(d["b"]))
    return F.when(held == 0, 1.0).when((a["n"] == 0) | (b["n"] == 0), 0.0).otherwise(1.0 - differing / held)


def _ranged(value: Column, quantiles: list[int] | None, rows: int) -> Column:
    """Number of the range, from 0, that holds a value, rising with it: about BUCKET_DOCS rows each."""
    bounds = sorted(set(quantiles or [0]))
    parts = max(1, -(-rows // (QUANTILES * BUCKET_DOCS)))
    # The quantiles are a constant; a range between two of them is cut evenly.
    table = F.split(F.lit(",".join(map(str, [*bounds, bounds[-1] + 1]))), ",").cast("array<bigint>")
    at = F.greatest(F.lit(1), F.size(F.filter(table, lambda b: b <= value)))
    low, high = F.get(table, at - 1).cast("double"), F.coalesce(F.get(table, at), F.get(table, at - 1) + 1).cast("double")
    part = F.floor((value.cast("double") - low) / F.greatest(F.lit(1.0), high - low) * parts)
    return ((at - 1) * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), part))).cast("bigint")


def _prefix(text: Column) -> Column:
    """A number of the first seven bytes, that never falls as the text rises."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def bucketed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket): buckets fall in the order of the documents, about BUCKET_DOCS rows each."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    of_none = F.when(F.col("doc_id").isNull(), _prefix(F.col("text")))
    known = rows.agg(F.count("doc_id"), F.percentile_approx("doc_id", points, 10_000), F.count(of_none), F.percentile_approx(of_none, points, 10_000)).collect()[0]
    by_id, by_text = _ranged(F.col("doc_id"), known[1], known[0]), _ranged(_prefix(F.col("text")), known[3], known[2])
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - by_text).otherwise(by_id))


def successors(heads: DataFrame) -> DataFrame:
    """heads' columns with ``bucket`` replaced by the bucket before it in the documents' order; the first one's is the last.

    One row for each bucket.  Buckets are dealt to groups of CHAIN numbers; one row
    for each group goes through a window in one task.
    """
    group = F.floor(F.col("bucket") / CHAIN)
    keys = heads.select("bucket", group.alias("g"))
    groups = keys.groupBy("g").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    over = Window.orderBy(F.col("g").desc())
    ends = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("g", F.coalesce(F.lag("low").over(over), F.last("low").over(ends)).alias("above"))
    inside = Window.partitionBy("g").orderBy(F.col("bucket").desc())
    before = keys.withColumn("near", F.lag("bucket").over(inside)).join(groups, "g").select("bucket", F.coalesce("near", "above").alias("before"))
    return heads.join(before, "bucket").drop("bucket").withColumnRenamed("before", "bucket")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, a, next_text, m): each row with its sketch and the text and the sketch of the next.

    The texts are shuffled once; only the last row of a bucket needs a row from
    another one, the head of the next bucket.
    """
    dealt = bucketed(docs)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    heads = dealt.withColumn("k", F.row_number().over(order)).filter("k = 1").select("bucket", F.col("text").alias("head"))
    heads = written(heads, "fingerprint-heads")
    heads = successors(heads).withColumn("head_sketch", sketch(digests(F.col("head"))))
    rows = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("a", sketch(digests(F.col("text")))).withColumn("m", F.lead("a").over(order))
    rows = rows.join(heads, "bucket")
    last = F.col("next_text").isNull()
    return rows.select("doc_id", "text", "a", F.when(last, F.col("head")).otherwise(F.col("next_text")).alias("next_text"), F.when(last, F.col("head_sketch")).otherwise(F.col("m")).alias("m"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.expr("length(text) DIV 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "a", "m")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "m", sketch(digests(F.col("edited"))).alias("e"))
    a, e, m = F.col("a"), F.col("e"), F.col("m")
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(a).alias("fingerprint"), printed(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"), likeness(a, m).alias("near_next"))
