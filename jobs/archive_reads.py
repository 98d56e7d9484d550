"""Add new reads to an archive that grows: a stream over a folder, ended when it has taken all that is there.

The stream's checkpoint is the mark: files that an earlier run has taken are not read again. A batch
leaves out reads that an earlier batch has brought (a file delivered twice), writes the rest by source file
and batch, and then works out anew the blocks (counts and digests) of the source files that it touched, and
of no others. A batch that is repeated after a failure replaces its own output and looks only at earlier
batches, so a repetition leaves the same archive.

    python -m jobs.archive_reads --source PATH --archive PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readlake.checkpoints import cut
from readlake.operators.profile import block_digest, block_stats
from readlake.plans.views import reads_of

from .common import command_line

log = logging.getLogger("archive_reads")

KEY, BLOCK, STREAMS = ("file_idx", "ordinal"), ("file_idx", "block_idx"), ("name", "seq", "qual")
READS = "block_idx int, ordinal long, name string, seq string, qual string, file_idx int, batch long"
BLOCKS = "block_idx int, read_count long, max_len long, bases long, name_digest string, seq_digest string, qual_digest string, file_idx int"


@dataclass(frozen=True)
class Settings:
    """max_files_per_batch: files of the source that a batch takes; check: "md5", "xxhash" or "none", the digests of blocks."""

    max_files_per_batch: int = 1000
    check: str = "md5"


def stored_reads(spark: SparkSession, archive: str) -> DataFrame:
    return spark.read.schema(READS).parquet(f"{archive}/reads")


def fresh(reads: DataFrame, archived: DataFrame) -> DataFrame:
    """Reads whose (file_idx, ordinal) the archive does not hold; of a key that comes twice the least by name, bases and qualities. ``reads`` are read once."""
    some = cut(reads.groupBy(*KEY).agg(F.min(F.struct("name", "seq", "qual", "block_idx")).alias("r")).select(*KEY, "r.*"))
    # of the archive only the partitions of files that the batch has are read, and of those the keys
    here = archived.join(F.broadcast(some.select("file_idx").distinct()), "file_idx", "left_semi").select(*KEY)
    return some.join(here, list(KEY), "left_anti")


def blocks_of(reads: DataFrame, check: str) -> DataFrame:
    """One row a block: counts, and a digest of each stream in order."""
    out = block_stats(reads, *BLOCK).select(*BLOCK, "read_count", F.col("max_len").cast("long").alias("max_len"), "bases")
    for c in STREAMS:
        out = out.join(block_digest(reads, c, check, *BLOCK).withColumnRenamed("digest", f"{c}_digest"), list(BLOCK))
    return out


def _replace(df: DataFrame, path: str, *by: str) -> None:
    laid = df.hint("rebalance", "file_idx").sortWithinPartitions(*by, "block_idx")
    laid.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def add(batch: DataFrame, number: int, archive: str, settings: Settings) -> tuple[int, int]:
    """One batch of documents into the archive: how many it has, and how many reads were added."""
    spark, seen = batch.sparkSession, Observation()
    reads = reads_of(batch.observe(seen, F.count(F.lit(1)).alias("documents"))).filter("file_idx is not null and ordinal is not null")
    # the folder is there, also before the first read
    _replace(spark.createDataFrame([], READS), f"{archive}/reads", "file_idx", "batch")
    new = fresh(reads, stored_reads(spark, archive).filter(F.col("batch") < number))
    _replace(new.withColumn("batch", F.lit(number).cast("long")), f"{archive}/reads", "file_idx", "batch")
    now = stored_reads(spark, archive).filter(F.col("batch") <= number)
    # names of files touched: partition columns alone, at most as many as the batch has sources
    touched = now.filter(F.col("batch") == number).select("file_idx").distinct()
    whole = now.join(F.broadcast(touched), "file_idx", "left_semi")
    _replace(blocks_of(whole, settings.check), f"{archive}/blocks", "file_idx")
    documents, added = seen.get["documents"], now.filter(F.col("batch") == number).count()
    log.info("batch %s: %s documents read, %s reads added to %s", number, documents, added, archive)
    return documents, added


def run(spark: SparkSession, source: str, archive: str, checkpoint: str, settings: Settings = Settings()) -> dict:  # noqa: B008
    """Takes what is new at ``source`` (a folder of Parquet files that may grow, or a pattern of paths) into ``archive``; returns when all of it is in. What was read and added."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.max_files_per_batch).parquet(source)
    done: list[tuple[int, int]] = []
    began = stream.writeStream.foreachBatch(lambda batch, number: done.append(add(batch, number, archive, settings))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    began.awaitTermination()
    told = {"source": source, "archive": archive, "batches": len(done), "documents": sum(d for d, _ in done), "added": sum(a for _, a in done)}
    log.info("%s batches of new files of %s, %s documents read, %s reads added to %s", told["batches"], source, told["documents"], told["added"], archive)
    return told


def read_back(spark: SparkSession, archive: str) -> DataFrame:
    """All reads of the archive, each with what the archive says of its block."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{archive}/blocks")
    return stored_reads(spark, archive).drop("batch").join(blocks, list(BLOCK))


if __name__ == "__main__":
    command_line(__doc__ or "", "archive_reads.json", Settings(), run, "source", "archive", "checkpoint")
