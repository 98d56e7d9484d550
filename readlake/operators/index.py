"""Seed index of a reference: k-mers at even offsets, counts, offsets, and the join with reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import packed_kmers
from ..functions.sequence import unpack_kmer

K = 14
#: Bases of a reference chunk.
CHUNK = 4096
#: A k-mer that occurs this often in the reference is no seed.
TOO_MANY = 65_536


def kmer_counts(seqs: DataFrame, k: int = K, canonical: bool = False) -> DataFrame:
    """kmer, n over all positions; canonical: the smaller of a k-mer and its reverse complement. K-mers with letters other than ACGT are left out."""
    counts = packed_kmers(seqs.select("seq"), k, canonical=canonical).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(unpack_kmer(F.col("kmer"), k).alias("kmer"), "n")


def seeds(ref: DataFrame, k: int = K) -> DataFrame:
    """contig, pos (0-based, even), kmer, packed; k-mers with letters other than ACGT are left out. ``ref``: contig, seq, or chunks of contigs that carry along the bases that follow."""
    if "piece" in ref.columns:
        begin = (F.col("chunk").cast("long") * CHUNK).alias("begin")
        # the k-mers that begin in a chunk: those across its end need k - 1 bases more
        text = F.concat("piece", F.substring("ahead", 1, k - 1)).alias("seq")
        found = packed_kmers(ref.select("contig", begin, text), k)
        return found.select("contig", (F.col("begin") + F.col("pos")).cast("int").alias("pos"), "kmer").filter("pos % 2 = 0")
    return packed_kmers(ref.select("contig", "seq"), k, 2)


def seed_counts(seeds_: DataFrame, too_many: int | None = TOO_MANY) -> DataFrame:
    """kmer, n of those that occur less often than ``too_many``; None: of all."""
    counts = seeds_.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts if too_many is None else counts.filter(F.col("n") < too_many)


def csr(counts: DataFrame, k: int = K) -> DataFrame:
    """kmer, n, start: the exclusive running sum in k-mer order, in two levels: ranges of the first bases, then within each, so no task holds all k-mers."""
    heads = counts.withColumn("head", F.shiftright("kmer", max(0, 2 * k - 8)))
    base = heads.groupBy("head").agg(F.sum("n").alias("sum"))
    # at most 4**4 heads
    before = base.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("head").orderBy("kmer").rowsBetween(Window.unboundedPreceding, -1)
    return heads.join(F.broadcast(before.select("head", "base")), "head").select("kmer", "n", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("start"))


def named(kmers: DataFrame, k: int = K) -> DataFrame:
    """With the letters of the packed k-mers."""
    return kmers.withColumn("kmer", unpack_kmer(F.col("kmer"), k))


def query_seeds(reads: DataFrame, k: int = K) -> DataFrame:
    """read_id, off, phase (parity of the offset), kmer, packed, of every read."""
    return packed_kmers(reads.select("read_id", "seq"), k).select("read_id", F.col("pos").alias("off"), (F.col("pos") % 2).alias("phase"), "kmer")


def seed_hits(reads: DataFrame, seeds_: DataFrame, k: int = K) -> DataFrame:
    """read_id, contig, hits: shared seeds."""
    return query_seeds(reads, k).select("read_id", "kmer").join(seeds_, "kmer").groupBy("read_id", "contig").agg(F.count(F.lit(1)).alias("hits"))


def rarest_seeds(queries: DataFrame, counts: DataFrame, cap: int, *by: str) -> DataFrame:
    """Of each read and phase (or other group) the seed that the reference holds least often, ties to the earliest. Counts are joined before any position is touched."""
    by = by or ("read_id", "phase")
    best = Window.partitionBy(*by).orderBy("n", "off")
    return queries.join(counts.filter(F.col("n") < cap), "kmer").withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
