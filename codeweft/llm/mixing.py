"""Mixing sources to target weights: temperature, entropy or repetition limit.

Each source's share of the tokens is raised to an exponent and the results are
normalised: 1 keeps the natural mixture, 0 makes all sources equal.  The exponent
is bisected to the smallest one in [0, HIGHEST] that meets the target: an
entropy of the weights in nats at most, or at most so many repetitions of a
source (both fall as the exponent grows).  The weights times the token budget
are the sources' quotas.  Without a budget it is the least with which every
document is taken at least once.

A quota is realised by permutations of blocks: a source's documents fall into
blocks of about BLOCK_DOCS by a seeded hash, in seeded order within a block.
They are taken in that order, again and again, until the quota ends; the last
copy of a document is taken only if it fits the quota whole.  Running sums are
taken within blocks, within groups of GROUP_BLOCKS blocks and over the groups,
so that no task holds a source or all its blocks.  Positions along the quota
give the output block, so that each output block holds the sources in their
weights.

The plan is DataFrame operations throughout.  The table of sources has one row
each; up to MAX_SOURCES it is broadcast, beyond them it is joined by a shuffle.  Its
token sums make one array for the bisection: 8 bytes a source.

Defined results: block and order come from a hash of the whole row, so that the
result does not depend on how the table is partitioned; null is a source of its own; documents without tokens are taken
once and use no quota; equal rows are taken each for itself; an empty table
gives an empty result; columns named mix_* in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_SOURCES = 10_000
BLOCK_DOCS = 1024
GROUP_BLOCKS = 1024
HIGHEST = 16.0
STEPS = 60
ADDED = ("mix_copy", "mix_block", "mix_order")


def words(text: Column) -> Column:
    """Tokens of a text for mixing: runs of what isn't white space."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("bigint")


def _powers(ps: Column, a: Column) -> Column:
    return F.transform(ps, lambda p: F.pow(p, a))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _entropy(ps: Column, a: Column) -> Column:
    q = _powers(ps, a)
    # With Z = sum q: the entropy of q / Z is ln Z - (sum q ln q) / Z.
    return F.ln(_total(q)) - _total(F.transform(q, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) / _total(q)


def _repeats(ps: Column, a: Column, budget: Column | None) -> Column:
    ratios = F.transform(ps, lambda p: F.pow(p, a - 1.0))
    if budget is None:
        return F.array_max(ratios) / F.array_min(ratios)
    return F.array_max(ratios) / _total(_powers(ps, a)) * budget


def source_weights(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, exponent, met, weight, quota) for (source, tokens, docs), one row for each source.

    met: whether the target is met; an entropy below what HIGHEST gives is not, and HIGHEST is taken.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("one target: an entropy or a repetition limit")
    row = totals.agg(F.collect_list(F.struct("source", "tokens", "docs")).alias("all"), F.sum("tokens").alias("sum")).withColumn(
        "ps", F.transform(F.filter("all", lambda x: x["tokens"] > 0), lambda x: x["tokens"].cast("double") / F.col("sum"))
    )
    given = None if budget is None else F.lit(float(budget)) / F.col("sum")

    def too_high(a: Column) -> Column:
        return _entropy(F.col("ps"), a) > entropy if entropy is not None else _repeats(F.col("ps"), a, given) > max_repeats

    def halve(st: Column, _: Column) -> Column:
        mid = (st["lo"] + st["hi"]) / 2.0
        high = too_high(mid)
        return F.struct(F.when(high, mid).otherwise(st["lo"]).alias("lo"), F.when(high, st["hi"]).otherwise(mid).alias("hi"))

    # A repetition limit is met best by 1 at the latest; a target met by 0 needs no search.
    top = HIGHEST if entropy is not None else 1.0
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi")), halve)["hi"]
    row = row.withColumn("exponent", F.when(F.size("ps") == 0, 1.0).when(too_high(F.lit(0.0)), found).otherwise(0.0))
    row = row.withColumn("z", _total(_powers(F.col("ps"), F.col("exponent"))))
    row = row.withColumn("met", (F.size("ps") == 0) | ~too_high(F.col("exponent")))
    each = row.select("exponent", "met", "sum", "z", "ps", F.explode("all").alias("s")).select("s.source", "s.tokens", "s.docs", "exponent", "met", "sum", "z", "ps")
    share = F.col("tokens").cast("double") / F.col("sum")
    each = each.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(share, F.col("exponent")) / F.col("z")).otherwise(0.0))
    if budget is None:
        scale = F.array_max(F.transform("ps", lambda p: p / (F.pow(p, F.col("exponent")) / F.col("z")))) * F.col("sum")
    else:
        scale = F.lit(float(budget))
    quota = F.round(F.col("weight") * scale).cast("bigint")
    if max_repeats is not None:
        quota = F.least(quota, F.round(F.col("tokens") * F.lit(float(max_repeats))).cast("bigint"))
    return each.select("source", "tokens", "docs", "exponent", "met", "weight", quota.alias("quota"))


def mix(docs: DataFrame, tokens: Column, entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' columns and mix_copy (from 1), mix_block (output block), mix_order (order within it): a row for each copy."""
    names = [c for c in docs.columns if c not in ADDED]
    # Of the whole row, nulls told apart from what follows them: rows that tie on it are equal.
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in names and "map<" not in f.dataType.simpleString()]
    row_key = F.xxhash64(F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in plain]), *plain)
    who = F.xxhash64(F.lit(seed), F.col("w.id"), F.col("w.n"), F.col("w.row"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), tokens.alias("n"), row_key.alias("row"))
    slim = written(rows.select("id", "src", "n", "row"), "mix")
    totals = written(slim.groupBy("src").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).withColumnRenamed("src", "source"), "mix-totals")
    weights = written(source_weights(totals, entropy, max_repeats, budget), "mix-weights")
    near = F.broadcast(weights) if weights.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else weights
    blocks = F.greatest(F.lit(1), F.ceil(F.col("q.docs") / BLOCK_DOCS))

    def placed(x: DataFrame) -> DataFrame:
        """With the source's figures, the block and the order within it."""
        both = x.alias("w").join(near.alias("q"), F.col("w.src").eqNullSafe(F.col("q.source")))
        return both.select("w.*", "q.tokens", "q.quota", F.col("q.source").isNull().alias("nul"), F.coalesce("q.source", F.lit("")).alias("key"), F.pmod(who, blocks).alias("block"), F.xxhash64(F.lit(seed + 1), who).alias("rank"))

    sums = placed(slim).groupBy("nul", "key", "block").agg(F.sum("n").alias("held")).withColumn("group", F.expr(f"block DIV {GROUP_BLOCKS}"))
    sums = written(sums, "mix-blocks")
    # Sums before a block: of the groups of blocks before its own, and of the blocks before it in its group.
    groups = sums.groupBy("nul", "key", "group").agg(F.sum("held").alias("all"))
    before = Window.partitionBy("nul", "key").orderBy(F.xxhash64(F.lit(seed + 4), "group"), "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("nul", "key", "group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("nul", "key", "group").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("more", F.coalesce(F.sum("held").over(within), F.lit(0))).join(groups, ["nul", "key", "group"])
    offsets = offsets.select("nul", "key", "block", (F.col("first") + F.col("more")).alias("offset"))
    inside = Window.partitionBy("nul", "key", "block").orderBy("rank", "id", "n", "row").rowsBetween(Window.unboundedPreceding, 0)
    at = placed(rows).withColumn("upto", F.sum("n").over(inside)).join(offsets, ["nul", "key", "block"])
    at = at.withColumn("upto", F.col("upto") + F.col("offset"))
    full = F.expr("CASE WHEN tokens > 0 THEN quota DIV tokens ELSE 0 END")
    left = F.col("quota") - full * F.col("tokens")
    copies = F.when(F.col("n") == 0, 1).otherwise(full + F.when(F.col("upto") <= left, 1).otherwise(0))
    drawn = at.withColumn("copies", copies.cast("int")).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = (F.col("copy") - 1) * F.col("tokens") + F.col("upto") - F.col("n")
    total = weights.agg(F.sum("quota")).collect()[0][0] or 0
    out_blocks = max(1, -(-total // block_tokens))
    block = F.when(F.col("quota") > 0, F.least(F.lit(out_blocks - 1), F.floor(place / F.col("quota") * out_blocks))).otherwise(0).cast("bigint")
    order = F.xxhash64(F.lit(seed + 3), F.col("copy"), F.col("rank"))
    return drawn.select("doc.*", F.col("copy").alias("mix_copy"), block.alias("mix_block"), order.alias("mix_order"))
