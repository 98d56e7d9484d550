"""Screen reads against a panel of unwanted sequences (contaminants, vectors, controls) before they are archived.

A read is screened when it shares enough different k-mers with one sequence of the panel, on either strand.
Every read is written, with its verdict and the sequence it fits best, by source file; a file that is given
again replaces what it has written, so reruns leave the same output.

    python -m jobs.screen_reads --documents PATH --panel PATH --out PATH [--config FILE]
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readlake.checkpoints import cut
from readlake.functions.packed import distinct_kmers, packed_kmers
from readlake.functions.sequence import reverse_complement
from readlake.plans.views import bases, reads_of

from .common import command_line

log = logging.getLogger("screen_reads")

#: K-mers of a panel up to which it is sent to all tasks.
FEW_SEEDS = 1 << 20

COLUMNS = "file_idx int, ordinal long, name string, seq string, qual string, kmers long, contig long, hits long, share double, verdict string"


@dataclass(frozen=True)
class Settings:
    """k: bases of a k-mer; min_hits: different k-mers that a read shares with a sequence to be screened; max_contigs: k-mers that more sequences of the panel hold say nothing."""

    k: int = 21
    min_hits: int = 8
    max_contigs: int = 50


def _seeds(sequences: DataFrame, k: int, *keys: str) -> DataFrame:
    """Different k-mers of each sequence; an unknown base counts as A, as in the overlap step."""
    return packed_kmers(sequences.select(*keys, F.translate("seq", "N", "A").alias("seq")), k).select(*keys, "kmer").distinct()


def panel_seeds(panel: DataFrame, settings: Settings) -> DataFrame:
    """(contig, kmer, of) of both strands of ``panel`` (contig, seq): of is how many k-mers the contig has; those of many contigs are left out, but count."""
    turned: Column = reverse_complement(F.translate("seq", "N", "A"))
    found = _seeds(panel.select("contig", "seq").unionByName(panel.select("contig", turned.alias("seq"))), settings.k, "contig")
    sizes = found.groupBy("contig").agg(F.count(F.lit(1)).alias("of"))
    common = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > settings.max_contigs).select("kmer")
    return found.join(common, "kmer", "left_anti").join(sizes, "contig")


def screened(reads: DataFrame, panel: DataFrame, settings: Settings) -> DataFrame:
    """``reads`` (file_idx, ordinal, name, seq, qual) with kmers, contig, hits, share and verdict ("clean" or "screened").

    contig is the sequence of the panel with the most shared k-mers, then the smallest; null where there
    is none. Only k-mers that the panel has leave the tasks that read them where it has at most FEW_SEEDS;
    a larger one is joined as Spark sees fit. An empty sequence is clean.
    """
    key = ["file_idx", "ordinal"]
    plain = F.translate("seq", "N", "A").alias("seq")
    known_seeds = cut(panel_seeds(panel, settings))
    if known_seeds.limit(FEW_SEEDS + 1).count() <= FEW_SEEDS:
        known_seeds = F.broadcast(known_seeds)
    # a read's k-mers stay in its task but for those that the panel has
    own = packed_kmers(reads.select(*key, plain), settings.k).select(*key, "kmer")
    shared = own.join(known_seeds, "kmer").groupBy(*key, "contig", "of").agg(F.countDistinct("kmer").alias("hits"))
    # reads that share a name are counted together, others each by itself
    twice = reads.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
    together = _seeds(reads.join(twice, key, "left_semi"), settings.k, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("together"))
    best = shared.groupBy(*key).agg(F.min(F.struct((-F.col("hits")).alias("less"), "contig", "of")).alias("b"))
    hits = -F.col("b.less")
    best = best.select(*key, F.col("b.contig").alias("contig"), hits.alias("hits"), (hits / F.col("b.of")).alias("share"))
    alone = F.when(F.col("file_idx").isNotNull() & F.col("ordinal").isNotNull(), distinct_kmers(F.translate("seq", "N", "A"), settings.k))
    known = reads.select(*key, "name", "seq", "qual", alone.alias("alone")).join(together, key, "left").join(best, key, "left").withColumn("kmers", F.coalesce("together", "alone"))
    return known.select(
        *key, "name", "seq", "qual", F.coalesce("kmers", F.lit(0)).cast("long").alias("kmers"), F.col("contig").cast("long").alias("contig"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("share", F.lit(0.0)).alias("share"), F.when(F.coalesce("hits", F.lit(0)) >= settings.min_hits, "screened").otherwise("clean").alias("verdict"),
    )


def run(spark: SparkSession, documents: str, panel: str, out: str, settings: Settings = Settings()) -> dict:  # noqa: B008
    """Reads of the table at ``documents`` against the sequences of the table at ``panel`` (item_id, text), to ``out``; what was read and written."""
    reads = reads_of(spark.read.parquet(documents))
    sequences = spark.read.parquet(panel).select(F.col("item_id").alias("contig"), bases("text", "ACGTN").alias("seq"))
    seen = Observation()
    n = F.count(F.lit(1))
    found = screened(reads, sequences, settings).observe(seen, n.alias("reads"), F.count_if(F.col("verdict") == "screened").alias("screened"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("bases"))
    # a file's rows together, a large file's in several tasks; no sampling pass as ranges would need
    laid = found.hint("rebalance", "file_idx").sortWithinPartitions("file_idx", "ordinal")
    laid.write.partitionBy("file_idx").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
    told = {"documents": documents, "panel": panel, "out": out, **seen.get}
    log.info("read %s reads (%s bases) of %s and the panel %s, wrote all to %s, %s of them screened", told["reads"], told["bases"], documents, panel, out, told["screened"])
    return told


def read_back(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(out)


if __name__ == "__main__":
    command_line(__doc__ or "", "screen_reads.json", Settings(), run, "documents", "panel", "out")
