"""Quality strings: minima, means, histogram cuts, labels, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.packed import quality_stats


def codes(qual: Column) -> Column:
    return F.when(F.length(qual) > 0, F.transform(F.split(qual, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def quality_sum(qual: Column) -> Column:
    return quality_stats(qual)["total"]


def quality_mean(qual: Column) -> Column:
    """Null for the empty string."""
    return F.when(F.length(qual) > 0, quality_sum(qual) / F.length(qual))


def block_minimum(reads: DataFrame, *block: str) -> DataFrame:
    return _stats(reads, *block).groupBy(*block).agg(F.min("low").alias("min_qual"))


def _stats(reads: DataFrame, *keep: str) -> DataFrame:
    """Kept columns with total, low, high and len of the qualities: one pass over them."""
    return reads.select(*keep, quality_stats(F.col("qual")).alias("_q"), F.length("qual").alias("len")).select(*keep, "_q.total", "_q.low", "_q.high", "len")


def mean_bins(reads: DataFrame, key: str, *block: str) -> DataFrame:
    """key, block, mean above the block's minimum, and its half-step bin (0..200)."""
    one = cut(_stats(reads, key, *block))
    low = one.groupBy(*block).agg(F.min("low").alias("min_qual"))
    mean = one.filter("len > 0").select(key, *block, (F.col("total") / F.col("len")).alias("mean"))
    # without blocks one row
    joined = mean.join(low, list(block)) if block else mean.crossJoin(F.broadcast(low))
    above = F.col("mean") - F.col("min_qual")
    return joined.select(key, *block, above.alias("above"), F.least(F.floor(above * 2), F.lit(200)).cast("int").alias("bin"))


def cuts(bins: DataFrame, *block: str) -> DataFrame:
    """Up to three cuts per block, bin / 2 each: bins are walked upwards with a running count; where it exceeds a quarter of all, a cut is set and a quarter taken off (once a bin).

    The walk is an aggregate over the sorted histogram: 201 bins at most per block.
    """
    hist = bins.groupBy(*block, "bin").agg(F.count(F.lit(1)).alias("c"))
    walk = hist.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("h"), F.sum("c").alias("n"))
    quarter = F.floor(F.col("n") / 4)

    def step(s: Column, b: Column) -> Column:
        run = s["run"] + b["c"]
        hit = (run > quarter) & (F.size(s["cuts"]) < 3)
        return F.struct(F.when(hit, run - quarter).otherwise(run).alias("run"), F.when(hit, F.concat(s["cuts"], F.array((b["bin"] / 2).cast("double")))).otherwise(s["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).cast("long").alias("run"), F.array().cast("array<double>").alias("cuts"))
    return walk.select(*block, "n", F.aggregate("h", start, step, lambda s: s["cuts"]).alias("cuts"))


def label(above: Column, cuts_: Column) -> Column:
    """How many cuts the truncated mean exceeds."""
    return F.size(F.filter(cuts_, lambda c: F.floor(above) > c))


def quality_contexts(reads: DataFrame) -> DataFrame:
    """One row per base: position, base, its quality, the one before, the greater of the two before that, whether those are equal, and the pair of bases."""
    flat = reads.select("ordinal", F.posexplode(F.arrays_zip(F.split("seq", "").alias("b"), codes(F.col("qual")).alias("q"))).alias("pos", "x"))
    flat = flat.select("ordinal", "pos", F.col("x.b").alias("base"), F.col("x.q").alias("q"))
    w = Window.partitionBy("ordinal").orderBy("pos")
    q2, q3 = F.lag("q", 2, 0).over(w), F.lag("q", 3, 0).over(w)
    return flat.withColumn("q1", F.lag("q", 1, 0).over(w)).withColumn("q23", F.greatest(q2, q3)).withColumn("equal", (q2 == q3).cast("int")).withColumn("pair", F.concat(F.lag("base", 1, "").over(w), "base"))
