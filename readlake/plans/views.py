"""Read tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import letters_of
from ..functions.sequence import reverse_complement

#: Letters a..z to quality signs (fixed values: "@" and A to Y).
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "@ABCDEFGHIJKLMNOPQRSTUVWXY"
BLOCK_DOCS, MATE_LEN = 100, 75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: str, alphabet: str = "ACGT") -> Column:
    """The letters of a text that are in the alphabet, in upper case."""
    return F.regexp_replace(F.translate(text, alphabet.lower(), alphabet), f"[^{alphabet}]", "")


def reads_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(table(spark, sf_dir, "documents"))


def reads_of(documents: DataFrame) -> DataFrame:
    """Documents as reads: file by source, block by hundreds of ids."""
    letters = F.translate(F.regexp_replace("text", "[^a-z]", ""), LETTERS, SIGNS)
    docs = documents.select("doc_id", "source", bases("text", "ACGTN").alias("seq"), letters.alias("q"))
    return docs.select(
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("file_idx"), F.floor(F.col("doc_id") / BLOCK_DOCS).cast("int").alias("block_idx"), F.col("doc_id").alias("ordinal"),
        F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(" length="), F.length("seq").cast("string")).alias("name"), "seq",
        F.rpad(F.expr("substr(q, 1, length(seq))"), F.length("seq"), F.lit("I")).alias("qual"),
    )


READS_SQL = f"""d0 AS (
  SELECT doc_id, source, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS seq,
         translate(regexp_replace(text, '[^a-z]', '', 'g'), '{LETTERS}', '{SIGNS}') AS q
  FROM documents
), reads AS (
  SELECT CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS file_idx, CAST(doc_id // {BLOCK_DOCS} AS INTEGER) AS block_idx, doc_id AS ordinal,
         source || '.' || doc_id || ' length=' || length(seq) AS name, seq,
         rpad(substr(q, 1, length(seq)), CAST(length(seq) AS INTEGER), 'I') AS qual
  FROM d0
)"""


def reads_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates of 75 bases from reads of 150 or more, interleaved."""
    r = reads_se(spark, sf_dir).filter(F.length("seq") >= 2 * MATE_LEN)
    m1 = F.struct(F.lit(1).alias("mate"), F.substring("seq", 1, MATE_LEN).alias("seq"), F.substring("qual", 1, MATE_LEN).alias("qual"))
    m2 = F.struct(F.lit(2).alias("mate"), reverse_complement(F.substring("seq", MATE_LEN + 1, MATE_LEN)).alias("seq"), F.reverse(F.substring("qual", MATE_LEN + 1, MATE_LEN)).alias("qual"))
    return r.select("file_idx", "block_idx", F.col("ordinal").alias("pair_id"), "name", F.inline(F.array(m1, m2))).withColumn("name", F.concat(F.element_at(F.split("name", " "), 1), F.lit("/"), F.col("mate").cast("string")))


READS_PE_SQL = (
    READS_SQL
    + f""", mates AS (
  SELECT file_idx, block_idx, ordinal AS pair_id, split_part(name, ' ', 1) || '/1' AS name, CAST(1 AS INTEGER) AS mate, substr(seq, 1, {MATE_LEN}) AS seq, substr(qual, 1, {MATE_LEN}) AS qual
  FROM reads WHERE length(seq) >= {2 * MATE_LEN}
  UNION ALL
  SELECT file_idx, block_idx, ordinal, split_part(name, ' ', 1) || '/2', CAST(2 AS INTEGER), translate(reverse(substr(seq, {MATE_LEN + 1}, {MATE_LEN})), 'ACGT', 'TGCA'), reverse(substr(qual, {MATE_LEN + 1}, {MATE_LEN}))
  FROM reads WHERE length(seq) >= {2 * MATE_LEN}
)"""
)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, seq: documents as reference sequences."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), letters_of(F.col("text")).alias("seq"))


def reference_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq: benchmark items as reads."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq")).filter(F.length("seq") >= 14)


REF_SQL = """ref AS (SELECT doc_id AS contig, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents),
queries AS (SELECT read_id, seq FROM (SELECT item_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM benchmark) WHERE length(seq) >= 14)"""


def plain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq: documents as reads, N replaced by A."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.translate(letters_of(F.col("text"), "ACGTN"), "N", "A").alias("seq"))


PLAIN_SQL = READS_SQL + ", short AS (SELECT ordinal AS read_id, translate(seq, 'N', 'A') AS seq FROM reads)"
