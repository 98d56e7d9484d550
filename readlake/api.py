"""What a command line of a read archiver offers, as functions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import extract as X
from .operators.align import align
from .operators.graph import layout, spanning_forest
from .operators.index import K, csr, seed_counts, seeds
from .operators.overlap import overlap_top2
from .operators.profile import ratios, streams
from .operators.sketches import summary
from .sources import archive as A
from .sources import fastq as Q

CHECKS = {0: "none", 1: "md5", 2: "xxhash"}


def load_reads(spark: SparkSession, paths: str | list[str], *, layout: str = "SE", block_bytes: int = 64 << 20) -> DataFrame:
    """``layout``: SE one file, PE two files, MULTI a list, a comma list or "@" and a file of paths."""
    files = [paths] if isinstance(paths, str) else list(paths)
    if layout == "PE":
        if len(files) != 2:
            raise ValueError("PE takes two files")
        return Q.read_pairs(spark, *files, range_bytes=block_bytes)
    if layout == "SE" and len(files) != 1 or layout not in ("SE", "MULTI"):
        raise ValueError(f"{layout} does not take {len(files)} files")
    return Q.read_fastq(spark, files[0] if len(files) == 1 else files, range_bytes=block_bytes)


#: Seeds of one bucket of a stored index.
SEEDS_PER_BUCKET = 4_000_000


def build_ref_index(spark: SparkSession, fasta: str, out: str, *, k: int = K, mode: str = "error", seeds_per_bucket: int = SEEDS_PER_BUCKET) -> None:
    """Seeds, counts and sequences of a reference as tables, the first two bucketed and sorted by k-mer. An index that is there already is used again if its digest fits."""
    ref = Q.read_fasta_chunks(spark, fasta)
    seen = ref.agg(F.sum(F.xxhash64("contig", "chunk", "piece").cast("decimal(38,0)")).cast("string").alias("digest"), F.sum(F.length("piece").cast("long")).alias("bases")).first()
    digest, buckets = seen["digest"] or "", max(1, min(MAX_BUCKETS, -(-(seen["bases"] or 0) // (2 * seeds_per_bucket))))
    try:
        if spark.read.parquet(f"{out}/meta").first()["digest"] == f"{k}:{digest}:{buckets}":
            return
    except Exception:  # noqa: BLE001 no index yet
        pass
    ref.write.mode(mode).parquet(f"{out}/ref")
    _write_bucketed(seeds(spark.read.parquet(f"{out}/ref"), k), f"{out}/seeds", buckets, ["kmer", "contig", "pos"], mode)
    _write_bucketed(csr(seed_counts(spark.read.parquet(f"{out}/seeds")), k), f"{out}/counts", buckets, ["kmer"], mode)
    spark.createDataFrame([(f"{k}:{digest}:{buckets}",)], "digest string").coalesce(1).write.mode(mode).parquet(f"{out}/meta")


#: What Spark allows by default (spark.sql.sources.bucketing.maxBuckets).
MAX_BUCKETS = 100_000


def _write_bucketed(rows: DataFrame, path: str, buckets: int, order: list[str], mode: str) -> None:
    """``rows`` in ``buckets`` files by the hash of k-mers. The table's name serves this write alone: what is bucketed is said again where it is read."""
    name = f"readlake_{uuid.uuid4().hex}"
    laid = rows.repartition(buckets, "kmer")
    try:
        laid.write.bucketBy(buckets, "kmer").sortBy(*order).option("path", path).mode(mode).saveAsTable(name)
    finally:
        rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # files at a path of one's own stay


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table of _write_bucketed() as one whose joins by k-mer need no exchange, in any session: no catalogue has to know it."""
    columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
    where = path.replace("'", "\\'")
    # one name for each folder and layout: loading again finds the same table
    name = "readlake_" + hashlib.md5(f"{path}:{buckets}:{columns}".encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (kmer) INTO {buckets} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


@dataclass(frozen=True)
class RefIndex:
    """A stored reference: k, its sequences, seeds and counts."""

    k: int
    ref: DataFrame
    seeds: DataFrame
    counts: DataFrame


def load_ref_index(spark: SparkSession, path: str) -> RefIndex:
    """What build_ref_index() has written. Seeds and counts come bucketed by k-mer, so looking reads up shuffles reads only."""
    k, _, buckets = spark.read.parquet(f"{path}/meta").first()["digest"].split(":")
    return RefIndex(int(k), spark.read.parquet(f"{path}/ref"), *(_bucketed(spark, f"{path}/{t}", int(buckets)) for t in ("seeds", "counts")))


def read_key(reads: DataFrame) -> Column:
    """One long for each read of several files and mates, in their order: the byte offset has 42 bits, the file 20."""
    mate = F.when(F.col("mate") == 2, 1).otherwise(0) if "mate" in reads.columns else F.lit(0)
    return F.shiftleft(F.col("file_idx").cast("long"), 43).bitwiseOR(F.shiftleft("ordinal", 1)).bitwiseOR(mate.cast("long"))


def encode(spark: SparkSession, reads: DataFrame, out: str, *, check: int | str = 1, reorder: bool = False, k: int = 13, files: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Write an archive; the result is its profile: bytes by stream before and after. ``reorder`` lays similar reads side by side (pairs keep their pair_id)."""
    if reorder:
        reads = reordered(reads, k)
    A.write_archive(reads, out, files=files, check=CHECKS.get(check, check), mode="overwrite" if overwrite else "error", reorder=reorder)
    return profile(spark, out)


def reordered(reads: DataFrame, k: int = 13) -> DataFrame:
    """``reads`` with new_ordinal, the place in its file and block: components side by side, breadth first; reads without an overlap at the end; mates one after the other."""
    own = reads.withColumn("_key", read_key(reads))
    keyed = own.select(F.col("_key").alias("read_id"), F.regexp_replace("seq", "[^ACGT]", "A").alias("seq"))
    tree = layout(*spanning_forest(overlap_top2(keyed, k))).select(F.col("node").alias("_key"), "component", "depth")
    placed = own.join(tree, "_key", "left")
    if "pair_id" in reads.columns:  # mates stay together, where the first of them lies
        pair = Window.partitionBy("file_idx", "pair_id")
        first = F.min(F.struct(F.col("component").isNull().alias("none"), "component", "depth", "_key")).over(pair)
        placed = placed.withColumn("_first", first).withColumn("component", F.col("_first.component")).withColumn("depth", F.col("_first.depth")).withColumn("_at", F.col("_first._key"))
        # mates lie at other bytes of their files, so a pair belongs to the block of its first mate
        placed = placed.withColumn("_block", F.min(F.when(F.col("mate") == 1, F.col("block_idx"))).over(pair))
    else:
        placed = placed.withColumn("_at", F.col("_key")).withColumn("_block", F.col("block_idx"))
    order = Window.partitionBy("file_idx", "_block").orderBy(F.col("component").asc_nulls_last(), "depth", "_at", "_key")
    return placed.withColumn("new_ordinal", F.row_number().over(order).cast("long") - 1).select(*reads.columns, "new_ordinal")


def decode(spark: SparkSession, archive: str, out: str | list[str], *, overwrite: bool = False, verify: bool = True) -> None:
    """Back to FASTQ in the original order; two outputs for pairs."""
    if verify and not A.verify(spark, archive).isEmpty():
        raise A.ArchiveError(f"{archive}: digests differ")
    reads, mode = A.read_archive(spark, archive), "overwrite" if overwrite else "error"
    if isinstance(out, list):
        Q.write_mates(reads, out[0], out[1], mode)
    else:
        Q.write_fastq(reads, out, by_file="pair_id" not in reads.columns, mode=mode)


def extract(spark: SparkSession, archive: str, spec: str, *, seed: int = 0, pair_mode: str = "each") -> DataFrame:
    """Reads of an archive by ``M:regex``, ``H:n``, ``S:n``, ``L`` or ``G:i,j``; files and blocks that cannot matter are not read."""
    s = X.parse_spec(spec)
    if s.kind == "list":
        return A.file_table(spark, archive)
    if s.kind == "get":
        return A.read_archive(spark, archive, files=list(s.value))
    reads = A.read_archive(spark, archive)
    if s.kind == "head":
        return X.head_by_blocks(reads, A.block_table(spark, archive), int(s.value))
    return X.extract(reads, s, seed=seed, pair_mode=pair_mode)


def extract_files(spark: SparkSession, paths: str | list[str], spec: str, *, seed: int = 0, pair_mode: str = "each") -> DataFrame:
    """extract() of read files as they are: files that a ``G`` leaves out are not opened, and ``L`` opens none."""
    s = X.parse_spec(spec)
    if s.kind == "list":
        return spark.createDataFrame(list(enumerate(Q.files_of(paths))), "file_idx int, path string")
    if s.kind == "get":
        return Q.read_fastq(spark, paths, files=list(s.value))
    return X.extract(Q.read_fastq(spark, paths), s, seed=seed, pair_mode=pair_mode)


def align_reads(reads: DataFrame, ref: DataFrame | RefIndex, *, k: int = K) -> DataFrame:
    """Place of each read of one or many files, single or paired: file_idx, ordinal (and mate, pair_id) and what align() says. A stored index is used as it is."""
    keys = [c for c in ("file_idx", "ordinal", "mate", "pair_id") if c in reads.columns]
    keyed = reads.select(read_key(reads).alias("read_id"), "seq", *keys)
    if isinstance(ref, RefIndex):
        found = align(keyed.select("read_id", "seq"), ref.ref, ref.k, index=(ref.seeds, ref.counts.select("kmer", "n")))
    else:
        found = align(keyed.select("read_id", "seq"), ref, k)
    return keyed.drop("seq").join(found, "read_id").drop("read_id")


def profile(spark: SparkSession, archive: str) -> DataFrame:
    """Bytes of each stream, its compressed bytes by the Parquet footers, ratio, and Total."""
    reads = A.read_archive(spark, archive)
    return ratios(streams(reads), compressed_bytes(spark, archive))


def about(spark: SparkSession, archive: str, *, by_file: bool = True, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Reads, distinct sequences and quantiles of lengths and mean qualities, by file or of all, from the sketches of the archive's blocks: approximate, whatever its size without a read."""
    return summary(A.sketch_table(spark, archive), *(["file_idx"] if by_file else []), shares=shares)


def compressed_bytes(spark: SparkSession, archive: str) -> DataFrame:
    """stream, bytes: column chunks by the footers of the archive's files, which tasks read, wherever they lie."""
    files = spark.read.parquet(f"{archive}/reads").inputFiles()
    schema = "stream string, bytes long"
    if not files:
        return spark.createDataFrame([], schema)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            names, sizes = [], []
            for path in batch.column(0).to_pylist():
                store, name = Q.located(path)
                with store.open_input_file(name) as f:
                    meta = pq.read_metadata(f)
                columns = [meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
                names += [c.path_in_schema for c in columns]
                sizes += [c.total_compressed_size for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["stream", "bytes"])

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 1000))
    return listed.mapInArrow(footers, schema).filter("stream in ('name', 'seq', 'qual')").groupBy("stream").agg(F.sum("bytes").alias("bytes"))
