"""Joins and running totals that stay even when a key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.shared import Staging

#: A key is hot when it has more than one part in HOT_PARTS of all rows, so there are fewer hot keys than HOT_PARTS.
HOT_PARTS = 1000
#: Over how many salts a hot key's rows are spread.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """Keys of counts(key, n) with n over total/parts. Fewer than ``parts`` rows by construction, so it may be broadcast."""
    return F.broadcast(counts.filter((F.col("n") * parts > total) & F.col(key).isNotNull()).select(key).withColumn("hot", F.lit(True)))


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """many join one on key, rows of hot keys spread over ``salts`` partitions by the hash ``spread``.

    ``one`` has a row a key; hot keys' rows of it are repeated once a salt (fewer than HOT_PARTS x salts rows).
    """
    left = many.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("hot")
    right = one.join(hot, key, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return left.join(right, [key, "salt"], how).drop("salt")


def running_total(df: DataFrame, order: list[str], value: str, out: str, staging: Staging, within: str | None = None, parts: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order`` (of the same ``within``, if given).

    Range-partitions once; each part sums its own rows, and only a row of totals a part and ``within`` value goes
    through the driver's side. ``order`` must tell all rows apart. No task holds more than its range.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ([within] if within else []) + order
    ranged = staging.put(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    by = ["__part"] + ([within] if within else [])
    totals = ranged.groupBy(*by).agg(F.sum(value).alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    if within:
        before = W.partitionBy(within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = ranged.join(starts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__start"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]))
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__start", *[f"__k{i}" for i in range(len(by))])
