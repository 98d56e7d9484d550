"""Sketches of blocks that are merged at query time: distinct sequences, quantiles of lengths and of mean qualities.

A sketch has a fixed size whatever it has seen: 2**PRECISION registers for distinct values, some multiples of
RANKS values for quantiles. Those of blocks merge to those of files and of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import quality_stats

#: Distinct values: the standard error is 1.04 / 2**(PRECISION / 2), 1.6 %.
PRECISION = 12
#: Quantiles: the rank of an answer is off by no more than RANK_ERROR with a probability of 0.99.
RANKS, RANK_ERROR = 400, 0.0085


def sketch_columns(quality: Column) -> list[Column]:
    """Aggregates distinct_seq, lengths and mean_quals of reads; ``quality``: quality_stats() of the read. The empty sequence is a value like any other, hence hashes."""
    mean = quality["total"] / F.nullif(F.length("qual"), F.lit(0))
    return [
        F.hll_sketch_agg(F.when(F.col("seq").isNotNull(), F.xxhash64("seq")), F.lit(PRECISION)).alias("distinct_seq"),
        F.kll_sketch_agg_bigint(F.length("seq").cast("long"), F.lit(RANKS)).alias("lengths"), F.kll_sketch_agg_double(mean, F.lit(RANKS)).alias("mean_quals"),
    ]


def block_sketches(reads: DataFrame, *block: str) -> DataFrame:
    """One row per block: reads, distinct_seq, lengths and mean_quals, sketches of the sequences, their lengths and the mean quality signs of reads that have any.

    Null sequences and qualities are left out of their sketches and counted as reads; an empty table has no row.
    """
    rows = reads.select(*block, "seq", "qual", quality_stats(F.col("qual")).alias("_q"))
    return rows.groupBy(*block).agg(F.count(F.lit(1)).alias("reads"), *sketch_columns(F.col("_q")))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """block_sketches() of larger groups; without ``by`` of everything."""
    return sketches.groupBy(*by).agg(
        F.sum("reads").alias("reads"), F.hll_union_agg("distinct_seq").alias("distinct_seq"),
        F.kll_merge_agg_bigint("lengths", F.lit(RANKS)).alias("lengths"), F.kll_merge_agg_double("mean_quals", F.lit(RANKS)).alias("mean_quals"),
    )


def distinct_about(sketch: Column) -> Column:
    """Distinct values, within 5 % (three standard errors)."""
    return F.hll_sketch_estimate(sketch)


def length_quantile(sketch: Column, share: float) -> Column:
    """Least length whose rank is ``share`` of the reads, within RANK_ERROR; null where none has a length."""
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(share))))


def quality_quantile(sketch: Column, share: float) -> Column:
    """The same of mean quality signs."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def summary(sketches: DataFrame, *by: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """reads, about_distinct, and arrays of the quantiles of lengths and mean qualities, of each group, or of everything."""
    m = merged(sketches, *by)
    return m.select(
        *by, "reads", distinct_about(F.col("distinct_seq")).alias("about_distinct"),
        F.array(*(length_quantile(F.col("lengths"), s) for s in shares)).alias("length_quantiles"),
        F.array(*(quality_quantile(F.col("mean_quals"), s) for s in shares)).alias("quality_quantiles"),
    )
