"""Sharding by sampled splitters, DataFrame operations only.

Records are ordered by ``(xxhash64(text), doc_id, row)``: copies of one text are neighbours, and a text
that a third of all rows repeat is still divisible, with one id or none in all of them too. Size-weighted samples of that composite key give
quantile boundaries; records fall into ranges, ranges that turn out overfull are subdivided by
denser samples of their own. Each range is ordered by one task; running sizes then give the
exact record at every shard boundary. What the driver sees is bounded: samples (SAMPLES_PER_RANGE a
range), one total per range, and one record per shard boundary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, integral, written

#: Bounds of what is sent to the driver.
MAX_RANGES, SAMPLES_PER_RANGE = 4096, 16
#: A range is overfull beyond this multiple of its fair share; how often overfull ones are subdivided.
OVERFULL, ROUNDS = 2.0, 3
#: A group of equal texts up to this share of a shard stays together at a boundary.
WHOLE_GROUP = 0.01


def _position(splitters: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted splitters are at or below the record: two levels of comparisons."""
    if not splitters:
        return F.lit(0)
    lit = lambda s: F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(s, ("h", "o", "row"), strict=True)))
    step = max(1, math.isqrt(len(splitters)))
    heads, own = splitters[::step], F.struct(F.col("h"), F.col("o"), F.col("row"))
    head = F.size(F.filter(F.array(*map(lit, heads)), lambda s: s <= own))
    blocks = F.array(*[F.array(*map(lit, splitters[i : i + step])) for i in range(0, len(splitters), step)])
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(head, F.lit(1))), lambda s: s <= own))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + inside)


def _quantiles(rows: DataFrame, total: int, ranges: int, seed: int) -> list[tuple[int, int, int]]:
    """Boundaries for ``ranges`` ranges of equal weight, from a sample in which a record's chance grows with its weight."""
    want = ranges * SAMPLES_PER_RANGE
    draw = F.pmod(F.xxhash64("h", "o", "row", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    sample = rows.filter(draw < F.col("w") * (want / max(1, total))).select("h", "o", "row").collect()
    keys = sorted((r["h"], r["o"], r["row"]) for r in sample)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if len(keys) > ranges else keys


def splitters_of(weighed: DataFrame, total: int, ranges: int) -> tuple[list[tuple[int, int, int]], dict[int, tuple[int, int]]]:
    """Sorted splitters of records (h, o, row, w) and (records, weight) of each range that has any; ranges that are overfull are subdivided, at most ROUNDS times.

    Rows that agree in text and id differ in ``row``, so only a range of one record stays overfull for good.
    """
    splitters: list[tuple[int, int, int]] = []
    inside, part, wanted = weighed, total, ranges
    for seed in range(ROUNDS + 1):
        splitters = sorted({*splitters, *_quantiles(inside, part, wanted, seed)})
        filled = weighed.groupBy(_position(splitters).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()
        sums = {r["range"]: (r["n"], r["w"]) for r in filled}
        over = [i for i, (n, w) in sums.items() if n > 1 and w > OVERFULL * total / ranges]
        if not over:
            break
        inside = weighed.filter(_position(splitters).isin(over))
        part = sum(sums[i][1] for i in over)
        wanted = min(MAX_RANGES, 2 * math.ceil(part * ranges / total))
    return splitters, sums


def sharded(docs: DataFrame, shards: int = 16, *, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: neither law keeps shards when one is added).

    law "bytes": shards' sizes (UTF-8 bytes + 1) differ from the mean by less than one record plus
    WHOLE_GROUP of a shard (a group of equal texts up to that size is not cut by a boundary, a larger
    one is); law "rows": counts differ by at most one. Within a shard, slots run in
    key order from 0 without gaps.

    Defined cases: null text has size 1 and the checksum of the empty text; rows with a null doc_id
    come first among equal texts; repeated rows are separate records, in some
    fixed order, and may be divided like others; an empty table gives an empty
    result; fewer records than shards leave shards empty; other columns are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    text = id_text(docs, id_col, text_col)
    # ids of other types than integers order equal texts by their hash
    order = F.col("doc_id").cast("long") if integral(docs, id_col) else F.xxhash64("doc_id")
    # the rank among rows that agree in everything else does not matter, but must be fixed: so it is written
    rows = text.select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("h"),
        F.when(F.col("doc_id").isNull(), F.lit(-(1 << 63))).otherwise(order).alias("o"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "shard-records")
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    weighed = rows.withColumn("w", weight)
    got = weighed.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    n, total = got["n"], got["w"] or 0
    splitters, sums = splitters_of(weighed, total, min(MAX_RANGES, max(64, n // rows_per_range)))
    placed = weighed.withColumn("range", _position(splitters))
    before, n_run, w_run = [], 0, 0
    for i in range(len(splitters) + 1):
        before.append((n_run, w_run))
        n_run, w_run = n_run + sums.get(i, (0, 0))[0], w_run + sums.get(i, (0, 0))[1]
    offsets = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(before)], "range int, n0 long, w0 long")
    order = Window.partitionBy("range").orderBy("h", "o", "row")
    ranked = placed.withColumn("i", F.row_number().over(order).cast("long") - 1).withColumn("wr", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    # at most MAX_RANGES * (ROUNDS + 1) + 1 rows
    ranked = ranked.join(F.broadcast(offsets), "range").withColumn("i", F.col("i") + F.col("n0")).withColumn("at", F.col("wr") + F.col("w0"))
    ranked = written(ranked.select("doc_id", "size", "text_crc32", "h", "i", "at"), "shard-ranked")
    # the shard of a record by the place of its first unit
    ranked = ranked.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.lit(max(1, total)))).cast("int"))
    first = {r["shard"]: r["i"] for r in ranked.groupBy("shard").agg(F.min("i").alias("i")).collect()}
    starts = _aligned(ranked, first, shards, n, total) if law == "bytes" else [first.get(s, n) for s in range(shards)]
    for s in range(shards - 2, -1, -1):
        starts[s] = min(starts[s], starts[s + 1])
    starts[0] = 0
    shard = sum((F.when(F.col("i") >= x, 1).otherwise(0) for x in starts[1:]), F.lit(0)).cast("int")
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("i") - base).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _aligned(ranked: DataFrame, first: dict[int, int], shards: int, n: int, total: int) -> list[int]:
    """Starts of the shards; one inside a small group of equal texts moves to that group's start. Looks at no more groups than shards."""
    starts = [first.get(s, n) for s in range(shards)]
    cut = ranked.filter(F.col("i").isin(starts)).select("h").distinct()
    groups = ranked.join(F.broadcast(cut), "h").groupBy("h").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.sum("size").alias("size")).collect()
    for s, at in enumerate(starts):
        for g in groups:
            if g["i0"] < at <= g["i1"] and g["size"] <= WHOLE_GROUP * total / shards:
                starts[s] = g["i0"]
    return starts
