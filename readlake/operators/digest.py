"""Tree digests: a column's bytes in fixed chunks, digested, and digests combined level by level.

The bytes of a group (a file) are those of its values in order, without separators. They are cut every
``size`` bytes wherever values begin or end, so no value, task or row ever holds more than a chunk of them.
A node of the tree is the MD5 of its children's hexadecimal digests in order; the chunks are the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Bytes of a chunk, children of a node.
CHUNK_BYTES, FAN = 1 << 20, 16


def _joined(parts: Column) -> Column:
    """Binary values of an array of (place, part), in order."""
    return F.unhex(F.array_join(F.transform(F.sort_array(parts), lambda x: F.hex(x["part"])), ""))


def chunk_digests(rows: DataFrame, col: str, *group: str, block: str = "block_idx", order: str = "ordinal", size: int = CHUNK_BYTES) -> DataFrame:
    """group, chunk, bytes, digest (MD5) of each chunk of ``col``; groups without bytes have none, nulls count as empty.

    A value's place is the sum of the bytes before it: of earlier blocks first, then within its block.
    """
    own = rows.select(*group, block, order, F.coalesce(F.col(col).cast("binary"), F.lit(b"")).alias("_v")).withColumn("_n", F.octet_length("_v").cast("long"))
    sums = own.groupBy(*group, block).agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).filter("_n > 0").join(base, [*group, block]).withColumn("_at", F.col("_at") + F.col("_base"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("_n") - 1) / size)
    spread = placed.select(*group, "_at", "_v", F.explode(F.sequence(first, last)).alias("chunk"))
    # what of the value lies in the chunk
    begin = F.greatest(F.col("chunk") * size - F.col("_at"), F.lit(0))
    stop = (F.col("chunk") + 1) * size - F.col("_at")
    parts = spread.select(*group, "chunk", F.struct((F.col("_at") + begin).alias("place"), F.substring(F.col("_v"), (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part")).alias("p"))
    return parts.groupBy(*group, "chunk").agg(F.sum(F.octet_length("p.part").cast("long")).alias("bytes"), F.md5(_joined(F.collect_list("p"))).alias("digest"))


def tree_digest(chunks: DataFrame, *group: str, fan: int = FAN) -> DataFrame:
    """group, digest (of the root), chunks, bytes from chunk_digests(); as many rounds as the largest group has levels."""
    sizes = chunks.groupBy(*group).agg(F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"))
    level = cut(chunks.join(sizes, [*group]).select(*group, F.col("chunk").alias("i"), "digest", F.col("chunks").alias("left")))
    while not level.filter("left > 1").isEmpty():
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "")
        # a root stays what it is while larger trees go on
        up = level.groupBy(*group, F.floor(F.col("i") / fan).alias("i"), "left").agg(F.md5(children).alias("node"), F.first("digest").alias("same"))
        level = cut(up.select(*group, "i", F.when(F.col("left") > 1, F.col("node")).otherwise(F.col("same")).alias("digest"), F.ceil(F.col("left") / fan).alias("left")))
    return level.select(*group, "digest").join(sizes, [*group])


def differing_chunks(a: DataFrame, b: DataFrame, *group: str, size: int = CHUNK_BYTES) -> DataFrame:
    """group, chunk, first_byte of the chunks in which two sides differ, or that only one has."""
    both = a.select(*group, "chunk", F.col("digest").alias("_a")).join(b.select(*group, "chunk", F.col("digest").alias("_b")), [*group, "chunk"], "full")
    return both.filter("not (_a <=> _b)").select(*group, "chunk", (F.col("chunk") * size).alias("first_byte"))
