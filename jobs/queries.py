"""The jobs as queries: each runs twice over whole tables into a new folder, and returns what stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readlake.checkpoints import shared_dir
from readlake.plans.views import READS_SQL

from . import archive_reads, screen_reads


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_screen_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{_folder(spark, 'screen_reads')}/reads"
    for _ in range(2):
        screen_reads.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return screen_reads.read_back(spark, out)


def job2_archive_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "archive_reads")
    for _ in range(2):
        # a pattern, as a stream takes folders and patterns but not the path of a single file
        archive_reads.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/archive", f"{folder}/checkpoint")
    return archive_reads.read_back(spark, f"{folder}/archive")


_S = screen_reads.Settings()
JOB1_SQL = f"""WITH {READS_SQL}, panel AS (
  SELECT item_id AS contig, translate(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g'), 'N', 'A') AS seq FROM benchmark
), strands AS (
  SELECT contig, seq FROM panel UNION ALL SELECT contig, translate(reverse(seq), 'ACGT', 'TGCA') FROM panel
), p AS (
  SELECT DISTINCT contig, substr(seq, i, {_S.k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {_S.k - 2})) AS i FROM strands)
), sizes AS (
  SELECT contig, count(*) AS n FROM p GROUP BY contig
), usable AS (
  SELECT * FROM p WHERE kmer IN (SELECT kmer FROM p GROUP BY kmer HAVING count(*) <= {_S.max_contigs})
), own AS (
  SELECT DISTINCT file_idx, ordinal, substr(s, i, {_S.k}) AS kmer FROM (SELECT file_idx, ordinal, translate(seq, 'N', 'A') AS s, unnest(range(1, length(seq) - {_S.k - 2})) AS i FROM reads)
), had AS (
  SELECT file_idx, ordinal, count(*) AS kmers FROM own GROUP BY file_idx, ordinal
), shared AS (
  SELECT file_idx, ordinal, contig, count(*) AS hits FROM own JOIN usable USING (kmer) GROUP BY file_idx, ordinal, contig
), best AS (
  SELECT *, row_number() OVER (PARTITION BY file_idx, ordinal ORDER BY hits DESC, contig) AS rn FROM shared
)
SELECT r.file_idx, r.ordinal, name, seq, qual, coalesce(kmers, 0) AS kmers, b.contig, coalesce(hits, 0) AS hits, coalesce(hits / n, 0) AS share,
       CASE WHEN coalesce(hits, 0) >= {_S.min_hits} THEN 'screened' ELSE 'clean' END AS verdict
FROM reads r LEFT JOIN had h ON h.file_idx = r.file_idx AND h.ordinal = r.ordinal
LEFT JOIN best b ON b.file_idx = r.file_idx AND b.ordinal = r.ordinal AND rn = 1 LEFT JOIN sizes z ON z.contig = b.contig"""

JOB2_SQL = f"""WITH {READS_SQL}, blocks AS (
  SELECT file_idx, block_idx, count(*) AS read_count, max(length(seq)) AS max_len, CAST(sum(length(seq)) AS BIGINT) AS bases,
         md5(string_agg(name, '' ORDER BY ordinal)) AS name_digest, md5(string_agg(seq, '' ORDER BY ordinal)) AS seq_digest, md5(string_agg(qual, '' ORDER BY ordinal)) AS qual_digest
  FROM reads GROUP BY file_idx, block_idx
)
SELECT * FROM reads JOIN blocks USING (file_idx, block_idx)"""

QUERIES = {"job1_screen_reads": job1_screen_reads, "job2_archive_reads": job2_archive_reads}
SQL = {"job1_screen_reads": JOB1_SQL, "job2_archive_reads": JOB2_SQL}
