"""Exact dedup over an extendible-hash index on shared files, DataFrame operations only.

A text's key is the xxhash64 of its normalised form (ASCII white space deleted). Three passes:

1. every row leaves a narrow record (id, code points, key, SHA-256) in the shared folder;
2. owner tasks group ``(key, normalised bytes)``: equal keys with different bytes stay separate
   entries of one chain. Map-side grouping comes first, so a text that a third of all rows repeat
   reaches its owner once per map task;
3. the directory: entries are counted per key prefix; a bucket that holds more than ``bucket_rows``
   entries is split by one more bit, doubling the directory, until it fits or the prefix ends.
   Buckets (key ranges) with slot and chain position are written as the index table.

The index table is ordered by key range, bucket by bucket, so whoever looks up a key reads its bucket.
Rows look up their entry by a join; AQE splits a hot key on the row side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, without_space, written

#: Entries that a bucket holds, and prefix bits beyond those that an even spread of keys would need.
BUCKET_ROWS, SLACK_BITS = 512, 4


def _records(docs: DataFrame, id_col: str, text_col: str, key_bits: int, *more: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    norm = docs.select(docs[id_col].alias("doc_id"), F.char_length(text).cast("long").alias("cp"), without_space(text).alias("norm"), *more)
    key = F.xxhash64("norm")
    return norm.withColumn("key", key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits))


def global_depth(n_entries: int, bucket_rows: int) -> int:
    """Bits of the directory; it grows with the entries, so no bucket is left overfull but by equal keys."""
    return min(62, max(1, math.ceil(math.log2(max(2.0, n_entries / bucket_rows))) + SLACK_BITS))


def directory(entries: DataFrame, n_entries: int, bucket_rows: int) -> DataFrame:
    """(prefix, depth, bucket): the directory at its global depth, one row per prefix that occurs.

    ``depth`` is the bucket's local depth, the least from the first directory's on (where the mean bucket
    would be overfull) at which it holds ``bucket_rows`` entries or fewer (the global depth where not even that is enough: equal keys cannot be told apart by bits).
    The table has at most 2**SLACK_BITS * n_entries / bucket_rows rows, so it is joined, not collected.
    """
    top = global_depth(n_entries, bucket_rows)
    cells = entries.groupBy(F.shiftrightunsigned("key", 64 - top).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
    levels = cells.select("prefix", "rows", F.explode(F.sequence(F.lit(max(0, top - SLACK_BITS - 2)), F.lit(top))).alias("depth"))
    levels = levels.withColumn("head", F.expr(f"shiftright(prefix, {top} - depth)"))
    fill = levels.groupBy("depth", "head").agg(F.sum("rows").alias("fill"))
    fit = levels.join(fill, ["depth", "head"]).filter((F.col("fill") <= bucket_rows) | (F.col("depth") == top))
    fit = fit.groupBy("prefix").agg(F.min("depth").alias("depth"))
    # a bucket is named by its first prefix: contiguous in key order
    return fit.withColumn("bucket", F.expr(f"shiftleft(shiftright(prefix, {top} - depth), {top} - depth)"))


def build_index(docs: DataFrame, records: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index table, written: bucket, depth, slot, chain, key, sha, n, keep_id, keep_row; one row per distinct normalised text."""
    texts = _records(docs, id_col, text_col, key_bits).groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"))
    entries = texts.select("key", F.sha2("norm", 256).alias("sha"), "n")
    # bytes were compared by the grouping; two byte strings under one digest would be an error, not a merge
    entries = entries.groupBy("key", "sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    entries = entries.withColumn("n", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("SHA-256 collision")).cast("long"))).drop("texts")
    first = F.min(F.struct((-F.col("cp")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    best = records.groupBy("key", "sha").agg(first).select("key", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    entries = written(entries.join(best, ["key", "sha"]), "exact-entries")
    n_entries = entries.count()
    top = global_depth(n_entries, bucket_rows)
    placed = entries.withColumn("prefix", F.shiftrightunsigned("key", 64 - top)).join(directory(entries, n_entries, bucket_rows), "prefix")
    # owner tasks: each has a range of keys, whole buckets in order
    placed = placed.repartitionByRange("bucket").sortWithinPartitions("bucket", "depth", "key", "sha")
    by_bucket = Window.partitionBy("bucket", "depth")
    placed = placed.select(
        "bucket", "depth", F.row_number().over(by_bucket.orderBy("key", "sha")).cast("long").alias("slot"),
        F.row_number().over(Window.partitionBy("bucket", "depth", "key").orderBy("sha")).cast("long").alias("chain"), "key", "sha", "n", "keep_id", "keep_row",
    )
    index = written(placed, "exact-index")
    discard(entries)
    return index


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their bytes are, after deleting every ASCII white-space character. Of equal
    texts the row with the most code points in its original text stays, then the smallest doc_id.

    Defined cases: a null text counts as empty, empty and all-white texts are equal to each other;
    a null doc_id ranks after all others and may be kept only where its group has nothing else;
    of repeated rows (same id, same text) exactly one is kept; an empty table gives an empty result;
    other columns are ignored. ``key_bits`` below 64 forces collisions (tests).
    """
    return _judged(docs, id_col, text_col, key_bits, bucket_rows).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), "bucket", "chain")


def _judged(docs: DataFrame, id_col: str, text_col: str, key_bits: int, bucket_rows: int, own: Column | None = None) -> DataFrame:
    """The records with their entry of the index, whether they are kept, and ``own``, a digest of the row."""
    source = docs if own is None else docs.withColumn("_own", own)
    norm = _records(source, id_col, text_col, key_bits, *(["_own"] if own is not None else []))
    records = norm.select("doc_id", "cp", "key", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"), *([] if own is None else ["_own"]))
    records = written(records, "exact-records")
    index = build_index(docs, records, id_col=id_col, text_col=text_col, key_bits=key_bits, bucket_rows=bucket_rows)
    return records.join(index.drop("slot", "depth"), ["key", "sha"]).withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` without the rows that exact_dedup() drops; its columns stay. Of each class of equal texts exactly one row is left.

    Defined cases: as in exact_dedup(); rows alike in id and text leave one of them, whichever other
    columns it has; an empty table stays empty; columns named like those used inside stay as they are.
    """
    # a row is known by its id and whole text; the id's length comes first, so no two rows look alike joined
    name_ = docs[id_col].cast("string")
    head = F.when(docs[id_col].isNull(), "-").otherwise(F.concat(F.length(name_).cast("string"), F.lit(":"), name_))
    own = F.sha2(F.concat(head, F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256)
    keep = _judged(docs.select(id_col, text_col), id_col, text_col, key_bits, bucket_rows, own).filter("kept").select(F.col("_own").alias("_own_kept"))
    name = "_own"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, own)
    # the join has dealt and ordered the rows by their digest, so equal ones meet without another shuffle
    return marked.join(keep, marked[name] == keep["_own_kept"], "left_semi").dropDuplicates([name]).drop(name)
