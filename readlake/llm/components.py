"""Connected components and blocked all-pairs work, for links that may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a table that may be broadcast; a larger one is joined by a shuffle.
SMALL_TABLE = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links``: component is the smallest node reachable.

    Rounds of: each node points to its smallest neighbour if that is smaller, pointers are followed to
    the end, links are redrawn between the ends. Every end is the smallest of what it stands for, and
    of the nodes that still have links at least half lose their place in a round, so rounds grow with
    the logarithm of the nodes. Grouping by a hot node is map-side first; each round is written to the
    shared folder. Nothing but a count reaches the driver. Null nodes are ignored.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    nodes = links.select(F.explode(F.array(a, b)).alias("node")).filter("node is not null").distinct()
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = nodes.select("node", F.col("node").alias("component"))
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), "pointers")
        while True:  # pointer jumping
            on = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = written(up.join(on, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            up = jumped.select("a", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        ends = written(ends.join(up.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "ends")
        left, right = up.select("a", F.col("to").alias("a_end")), up.select(F.col("a").alias("b"), F.col("to").alias("b_end"))
        redrawn = edges.join(left, "a").join(right, "b").filter("a_end <> b_end")
        edges = written(redrawn.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "links")
    return ends


def block_cells(rows: DataFrame, bucket: list[str], row_id: str, block: int) -> DataFrame:
    """``rows`` dealt to cells (bucket, i, j) such that every two rows of a bucket meet in at least one cell.

    A bucket of up to ``block`` rows is one cell (0, 0). A larger one is cut into blocks by a hash of
    ``row_id``; each pair of blocks i <= j is a cell, and each row goes to the cells of its block, with
    its own block in ``own``. No task ever needs a whole large bucket. Buckets with a single row go nowhere.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    dealt = rows.join(sizes, bucket).withColumn("_k", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return dealt.withColumn("_cell", F.explode(cells)).withColumn("i", F.col("_cell.i")).withColumn("j", F.col("_cell.j")).drop("_cell", "_n", "_k")


def in_cells(rows: DataFrame, crowded: DataFrame, bucket: list[str], cells: int, block: int, useful: str = "true", row_id: str = "node") -> DataFrame:
    """``rows`` with cell, i, j, own: small buckets share ``cells`` cells, those listed in ``crowded`` are cut by block_cells(), or left out if not ``useful``.

    Only the list of crowded buckets is joined, and not at all where there is none.
    """
    zero = F.lit(0)
    shared = lambda df: df.withColumns({"cell": F.pmod(F.xxhash64(*bucket), F.lit(cells)), "own": zero, "i": zero, "j": zero})
    crowded = written(crowded, "crowded")
    n = crowded.count()
    if not n:
        return shared(rows)
    listed = F.broadcast(crowded) if n <= SMALL_TABLE else crowded
    small = shared(rows.join(listed.select(*bucket), bucket, "left_anti"))
    large = block_cells(rows.join(listed.filter(useful).select(*bucket), bucket, "left_semi"), bucket, row_id, block)
    return small.unionByName(large.withColumn("cell", F.xxhash64(*bucket)))
