"""From raw documents to packed token sequences, stage by stage; each stage is written and read again.

All stages take null ids and texts, empty and very long texts, repeated rows, empty tables and columns of
any further names, which they pass on as they are; what becomes of each case is said with the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readlake.llm.common import discard, documents, written
from readlake.llm.exact_dedup import drop_exact_copies
from readlake.llm.near_dedup import drop_near_copies
from readlake.llm.packing import packed
from readlake.llm.queries import piece_digests, public_encoder
from readlake.llm.substring_dedup import MIN_UNIT, cut, repeated_spans
from readlake.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go. Null and empty texts are judged by the overall rate of the labels."""
    model, vectors = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    discard(vectors)  # the model has its counts from them; rows are judged by their texts
    return drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the most code points stays, then the smallest doc_id; null counts as empty, rows with a null id stay only where no other has their text."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; null and empty texts and rows with a null id have no copies."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages and lines that an earlier document holds are cut out; rows with a null id neither lose nor claim any, null texts stay null."""
    return cut(docs, repeated_spans(docs, line_words=MIN_UNIT))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences; a null or empty text is its end mark alone."""
    return piece_digests(packed(docs, public_encoder))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Nearest neighbours, SimHash and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
