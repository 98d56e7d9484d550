"""Paired reads: interleaving, relations of mates, insert-size window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two tables under one pair_id; order by (pair_id, mate)."""
    return first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2)))


def deinterleave(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reads.filter("mate = 1"), reads.filter("mate = 2")


def paired(first: DataFrame, second: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair; columns of the mates get _1 and _2. Both sides must hold each key."""
    rename = lambda df, n: df.select(key, *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c != key])
    return rename(first, 1).join(rename(second, 2), key)


def pair_relation(p1: Column, p2: Column, window: int) -> Column:
    """0, 1: within the window, second not after / after the first; 2, 3: the same outside it; 4, 5: only the first / second has a place; 6: none."""
    near = F.abs(p1 - p2) < window
    return (
        F.when(p1.isNull() & p2.isNull(), 6).when(p2.isNull(), 4).when(p1.isNull(), 5)
        .when(near & (p2 <= p1), 0).when(near, 1).when(p2 <= p1, 2).otherwise(3)
    )


def insert_window(distances: DataFrame, col: str = "d", limit: int = 20_000, share: float = 0.9) -> DataFrame:
    """One row: n, median (of an even number the integer mean of the middle two), half (least power of two from 4 whose open window holds floor(share * n)), bits. 256 and 256 without data.

    The median comes from two percentiles, windows from one aggregate with conditional counts.
    """
    x = distances.filter(F.col(col).isNotNull() & (F.abs(col) < limit)).select(F.col(col).cast("long").alias("x"))
    mid = x.agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by x)").alias("low"), F.expr("percentile_disc(0.5) within group (order by x desc)").alias("high"))
    mid = mid.withColumn("median", F.coalesce(F.floor((F.col("low") + F.col("high")) / 2).cast("long"), F.lit(256)))
    # one row, so broadcast
    powers = range(2, 32)
    away = x.crossJoin(F.broadcast(mid.select("median"))).select(F.abs(F.col("x") - F.col("median")).alias("a"))
    inside = away.agg(F.array(*[F.coalesce(F.sum((F.col("a") < (1 << p)).cast("long")), F.lit(0)) for p in powers]).alias("inside"))
    both = mid.crossJoin(F.broadcast(inside))
    fits = F.array_position(F.transform("inside", lambda c: c >= F.floor(F.col("n") * share)), True)
    power = F.when(F.col("n") == 0, 8).otherwise(F.when(fits > 0, fits + 1).otherwise(31)).cast("int")
    return both.select("n", "median", F.expr("1L").alias("one"), power.alias("p")).select("n", "median", F.expr("shiftleft(one, p)").alias("half"), (F.col("p") + 1).alias("bits"))
