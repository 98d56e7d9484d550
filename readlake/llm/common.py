"""Helpers shared by the operators of this package: shared folder, written tables, input selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that written() made in this process; discard() deletes no others.
_MADE: set[str] = set()

#: The deleted class of the exact-copy rule: ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="readlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    folder = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{folder}"
    _MADE.add(folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of ended queries: it does so when the driver's JVM collects what refers to them."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose readers have all been written themselves, and sweeps."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1] in _MADE:
                path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty; other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def integral(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
