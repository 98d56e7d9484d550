"""Row-to-row encodings as window functions; every one is partitioned by its block, so blocks stay independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_block(order: str = "ordinal", *block: str) -> WindowSpec:
    return Window.partitionBy(*block).orderBy(order)


def same_flag(x: Column, w: WindowSpec) -> tuple[Column, Column]:
    """(1 where x equals its predecessor, which starts as 0; else 0 and the value)."""
    same = x == F.lag(x, 1, 0).over(w)
    return same.cast("int"), F.when(~same, x)


def run_lengths(df: DataFrame, col: str, order: str, *block: str) -> DataFrame:
    """Runs of equal values: start, value, length."""
    w = in_block(order, *block)
    new = df.withColumn("_new", F.when(F.col(col).eqNullSafe(F.lag(col).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*block, "run").agg(F.min(order).alias("start"), F.first(col).alias("value"), F.count(F.lit(1)).alias("length"))


def changed_position(pos: Column, w: WindowSpec) -> tuple[Column, Column]:
    """(0 where the position is the last one given, else 1; the position where it is new). Rows without a position keep the last one."""
    before = F.last(pos, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    same = pos.eqNullSafe(before)
    return F.when(pos.isNotNull(), F.when(same, 0).otherwise(1)), F.when(pos.isNotNull() & ~same, pos)


def median3_residual(x: Column, w: WindowSpec) -> Column:
    """x minus the median of its three predecessors; the first three as they are."""
    last = [F.lag(x, i).over(w) for i in (1, 2, 3)]
    return F.when(last[2].isNull(), x).otherwise(x - F.sort_array(F.array(*last))[1])


def sign_magnitude(x: Column) -> tuple[Column, Column, Column]:
    """(1 if negative, 32 minus the bits of the size, the size)."""
    size = F.abs(x)
    return (x < 0).cast("int"), (32 - F.when(size == 0, 0).otherwise(F.length(F.bin(size)))).cast("int"), size


def rolling_flags(flag: Column, w: WindowSpec, n: int = 10) -> Column:
    """Sum of the n flags before; 0 at the start."""
    return F.coalesce(F.sum(flag).over(w.rowsBetween(-n, -1)), F.lit(0))


def history3(flag: Column, w: WindowSpec) -> Column:
    """The last three flags as 0..7, the latest lowest."""
    return sum((F.lag(flag, i, 0).over(w) * (1 << (i - 1)) for i in (2, 3)), F.lag(flag, 1, 0).over(w))


def running_offset(size: Column, w: WindowSpec) -> Column:
    """Sum of the sizes before."""
    return F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def base_context(seq: Column, i: Column, n: int = 10) -> Column:
    """The n bases before the 1-based position i."""
    return F.substring(seq, F.greatest(i - n, F.lit(1)), F.least(i - 1, F.lit(n)))


def format_runs(names: DataFrame, fmt: Column, order: str, *block: str) -> DataFrame:
    """``names`` with its format and the number of its run of equal formats, from 0."""
    w = in_block(order, *block)
    with_fmt = names.withColumn("format", fmt)
    new = F.when(F.lag("format").over(w).isNull() | (F.lag("format").over(w) != F.col("format")), 1).otherwise(0)
    return with_fmt.withColumn("_new", new).withColumn("format_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def restore_order(df: DataFrame, permutation: DataFrame, old: str = "ordinal", new: str = "new_ordinal") -> DataFrame:
    """Rows of ``df`` with their place in a new order (permutation: old, new)."""
    return df.join(permutation.select(old, new), old)


def ranked(df: DataFrame, head: Column, *order: str) -> DataFrame:
    """With ``rank``, the place of each row in the order from 0, in two levels: ``head`` grows with the order and has few values; sizes of those first, then ranks within each."""
    headed = df.withColumn("_head", head)
    sizes = headed.groupBy("_head").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_head", F.coalesce(F.sum("_size").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_head").orderBy(*order))
    return headed.join(before, "_head").withColumn("rank", F.col("_before") + inside - 1).drop("_head", "_before")
