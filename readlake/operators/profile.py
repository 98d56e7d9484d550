"""Per-block and per-stream statistics and digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LONG_READ


def block_stats(reads: DataFrame, *block: str) -> DataFrame:
    return reads.groupBy(*block).agg(
        F.count(F.lit(1)).alias("read_count"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("max_len"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("bases"),
        F.coalesce(F.bool_or(F.length("seq") > LONG_READ), F.lit(False)).alias("longseq"),
    )


def streams(reads: DataFrame) -> DataFrame:
    """One row per stream and file: reads, bytes with one line end each (two for the name: its mark too)."""
    sizes = F.array(*[F.struct(F.lit(n).alias("stream"), (F.octet_length(c) + extra).cast("long").alias("bytes")) for n, c, extra in (("name", "name", 2), ("seq", "seq", 1), ("qual", "qual", 1))])
    return reads.select("file_idx", F.inline(sizes)).groupBy("file_idx", "stream").agg(F.count(F.lit(1)).alias("reads"), F.sum("bytes").alias("bytes"))


def totals(streams_: DataFrame) -> DataFrame:
    """Bytes by stream, with a row Total."""
    return streams_.rollup("stream").agg(F.sum("bytes").alias("bytes")).withColumn("stream", F.coalesce("stream", F.lit("Total")))


def ratios(original: DataFrame, compressed: DataFrame) -> DataFrame:
    """Original and compressed bytes by stream and their ratio, with Total."""
    both = totals(original).join(totals(compressed).withColumnRenamed("bytes", "compressed"), "stream", "left")
    return both.withColumn("ratio", F.col("bytes") / F.nullif(F.col("compressed"), F.lit(0)))


def mismatch_histogram(alignments: DataFrame) -> DataFrame:
    """Reads by number of mismatches; unmapped ones under null."""
    return alignments.groupBy("mis").agg(F.count(F.lit(1)).alias("reads"))


def distinct_profile(reads: DataFrame) -> DataFrame:
    """Distinct values per stream, exact and estimated, by file and over all (grouping sets)."""
    return reads.rollup("file_idx").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("seq").alias("distinct_seq"), F.approx_count_distinct("seq").alias("about_seq"))


def stream_cube(reads: DataFrame) -> DataFrame:
    """Bytes by every combination of file and stream: each, either and all (null where not grouped by)."""
    return streams(reads).cube("file_idx", "stream").agg(F.sum("bytes").alias("bytes"), F.sum("reads").alias("reads"))


def observed(reads: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``reads`` and what an action on them counts on its way: reads, bases and blocks done."""
    seen = Observation(name)
    return reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("bases"), F.approx_count_distinct(F.struct("file_idx", "block_idx")).alias("blocks")), seen


def common_sequences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct sequences that both hold."""
    return first.select("seq").intersect(second.select("seq"))


def missing_sequences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sequences of the first, as often as it holds them more than the second."""
    return first.select("seq").exceptAll(second.select("seq"))


def ordered_digest(reads: DataFrame, col: str, *block: str, order: str = "ordinal") -> DataFrame:
    """MD5 of a column's values of each block, joined in order without separators. A block is one value: keep blocks small."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.coalesce(col, F.lit("")).alias("v")))), lambda x: x["v"]), "")
    return reads.groupBy(*block).agg(F.md5(joined).alias("digest"))


def unordered_digest(reads: DataFrame, *cols: str) -> DataFrame:
    """A digest of a whole table, whatever its order and size: sum of 64-bit row hashes, as a decimal, and the count."""
    return reads.agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("digest"), F.count(F.lit(1)).alias("rows"))


@F.pandas_udf(T.StringType())
def xxh3_128(values: pd.Series) -> pd.Series:
    """128-bit XXH3 of each string, hexadecimal."""
    import xxhash

    return values.map(lambda v: None if v is None else xxhash.xxh3_128_hexdigest(v.encode()))


def block_digest(reads: DataFrame, col: str, check: str = "md5", *block: str) -> DataFrame:
    """Digest per block by "md5" or "xxhash"; "none" gives nulls."""
    if check == "md5":
        return ordered_digest(reads, col, *block)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce(col, F.lit("")).alias("v")))), lambda x: x["v"]), "")
    grouped = reads.groupBy(*block).agg(joined.alias("_v"))
    return grouped.withColumn("digest", xxh3_128(F.col("_v")) if check == "xxhash" else F.lit(None).cast("string")).drop("_v")
