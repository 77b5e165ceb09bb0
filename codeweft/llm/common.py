"""What the training-data operators share: tables, shared storage, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*keys: Column) -> Column:
    """A number of [0, 1) by the hash of some columns: below ``share`` for that share of the rows, however small."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


#: Rows of one key that are joined in one task, and most keys that have more.
KEY_ROWS, HOT_KEYS = 64, 100_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join where a key of ``left`` may hold a large share of its rows.

    right: rows with the number ``n`` of left's rows that hold their key; total: left's rows.
    A key with more rows than a limit is dealt to as many parts as it needs, its rows of ``right`` repeated for each.
    The limit rises with the table, so that at most HOT_KEYS keys are over it: only those are broadcast.
    """
    limit = max(KEY_ROWS, -(-total // HOT_KEYS))
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(right.filter(F.col("n") > limit).select(*keys, parts.alias("__parts")).distinct())
    dealt = left.join(hot, keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts"))).cast("int")).drop("__parts")
    repeated = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(repeated, [*keys, "__part"]).drop("__part")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null: the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
