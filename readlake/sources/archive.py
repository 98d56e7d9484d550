"""The archive: reads as Parquet by file, with tables of blocks, files and parameters beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import quality_stats
from ..operators.profile import block_digest, streams
from ..operators.sketches import sketch_columns
from ..schema import LONG_READ

MAGIC, VERSION = "readlake-archive", (1, 1, 0)
#: Sketches in the table of blocks.
SKETCHES = ("distinct_seq", "lengths", "mean_quals")


class ArchiveError(ValueError):
    """Not an archive of this kind, or one that does not hold what it says."""


def write_archive(reads: DataFrame, path: str, *, files: list[str] | None = None, check: str = "md5", mode: str = "error", compression: str = "zstd", **params: object) -> None:
    """``reads`` (READS columns) to a folder: reads/ by file_idx, sorted by block; blocks/, files/, digests/, meta/."""
    spark = reads.sparkSession
    order = [c for c in ("block_idx", "pair_id", "ordinal", "mate") if c in reads.columns]
    # ranges of (file, block) keep a large file in many tasks and its rows together
    laid = reads.repartitionByRange("file_idx", *order).sortWithinPartitions("file_idx", *order)
    laid.write.partitionBy("file_idx").option("compression", compression).mode(mode).parquet(f"{path}/reads")
    stored = spark.read.schema(reads.schema).parquet(f"{path}/reads")
    comment = F.length(F.coalesce("comment", F.lit(""))) == 0 if "comment" in reads.columns else F.lit(True)
    blocks = stored.withColumn("_q", quality_stats(F.col("qual"))).groupBy("file_idx", "block_idx").agg(
        F.count(F.lit(1)).alias("read_count"), F.sum(F.length("seq").cast("long")).alias("bases"), F.bool_and(comment).alias("onech"), F.bool_or(F.length("seq") > LONG_READ).alias("longseq"),
        *sketch_columns(F.col("_q")),
    )
    blocks.write.mode(mode).parquet(f"{path}/blocks")
    if check != "none":
        names = ("name", "seq", "qual")
        keyed = stored.withColumn("ordinal", F.struct(*[c for c in ("pair_id", "ordinal", "mate") if c in stored.columns])) if "pair_id" in stored.columns else stored
        parts = [block_digest(keyed, c, check, "file_idx", "block_idx").withColumn("stream", F.lit(c)) for c in names]
        parts[0].unionByName(parts[1]).unionByName(parts[2]).write.mode(mode).parquet(f"{path}/digests")
    streams(stored).write.mode(mode).parquet(f"{path}/streams")
    rows = [(i, f) for i, f in enumerate(files or [])]
    spark.createDataFrame(rows, "file_idx int, path string").coalesce(1).write.mode(mode).parquet(f"{path}/files")
    meta = {"magic": MAGIC, "version": list(VERSION), "check": check, "columns": reads.columns, **params}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    except Exception as x:
        raise ArchiveError(f"{path} is no archive") from x
    if meta.get("magic") != MAGIC or meta["version"][0] != VERSION[0]:
        raise ArchiveError(f"{path} is {meta.get('magic')} {meta.get('version')}")
    return meta


def read_archive(spark: SparkSession, path: str, *, files: list[int] | None = None, blocks: list[int] | None = None) -> DataFrame:
    """Reads of an archive; ``files`` prunes partitions, ``blocks`` row groups."""
    meta = read_meta(spark, path)
    df = spark.read.parquet(f"{path}/reads").select(*meta["columns"])
    if files is not None:
        df = df.filter(F.col("file_idx").isin(files))
    return df.filter(F.col("block_idx").isin(blocks)) if blocks is not None else df


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """Counts of blocks without reading a read."""
    read_meta(spark, path)
    return spark.read.parquet(f"{path}/blocks").drop(*SKETCHES)


def sketch_table(spark: SparkSession, path: str) -> DataFrame:
    """file_idx, block_idx, reads and the sketches of each block, for operators.sketches; no read is read."""
    read_meta(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    if not set(SKETCHES) <= set(blocks.columns):
        raise ArchiveError(f"{path} was written without sketches")
    return blocks.select("file_idx", "block_idx", F.col("read_count").alias("reads"), *SKETCHES)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    read_meta(spark, path)
    return spark.read.parquet(f"{path}/files")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Blocks and streams whose digest or count is not what was written; empty when all is well."""
    meta = read_meta(spark, path)
    reads = read_archive(spark, path)
    counts = reads.groupBy("file_idx", "block_idx").agg(F.count(F.lit(1)).alias("now"))
    off = block_table(spark, path).join(counts, ["file_idx", "block_idx"], "full").filter("not (read_count <=> now)").select("file_idx", "block_idx", F.lit("count").alias("stream"))
    if meta["check"] == "none":
        return off
    keyed = reads.withColumn("ordinal", F.struct(*[c for c in ("pair_id", "ordinal", "mate") if c in reads.columns])) if "pair_id" in reads.columns else reads
    stored = spark.read.parquet(f"{path}/digests")
    for c in ("name", "seq", "qual"):
        now = block_digest(keyed, c, meta["check"], "file_idx", "block_idx").withColumnRenamed("digest", "now")
        bad = stored.filter(F.col("stream") == c).join(now, ["file_idx", "block_idx"], "full").filter("not (digest <=> now)")
        off = off.unionByName(bad.select("file_idx", "block_idx", F.lit(c).alias("stream")))
    return off
