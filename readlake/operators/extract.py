"""The extract surface: regex, head, sample, list, get, mates; specs like ``M:regex`` are parsed here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import posix_pattern

ORDER, PAIR_ORDER = ("file_idx", "block_idx", "ordinal"), ("file_idx", "pair_id", "mate")


def match_names(reads: DataFrame, pattern: str, pair_mode: str = "each") -> DataFrame:
    """Reads whose name holds the POSIX extended pattern anywhere. Pairs: "each" mate by itself, or both when "any" or "all" mates match."""
    hit = F.col("name").rlike(posix_pattern(pattern))
    if pair_mode == "each":
        return reads.filter(hit)
    by_pair = Window.partitionBy("pair_id")
    test = (F.bool_or if pair_mode == "any" else F.bool_and)(hit).over(by_pair)
    return reads.withColumn("_hit", test).filter("_hit").drop("_hit")


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads in block order, pairs in order of their number; mates count each."""
    order = [c for c in (PAIR_ORDER if "pair_id" in reads.columns else ORDER) if c in reads.columns]
    return reads.orderBy(*order).limit(max(0, n))


def head_by_blocks(reads: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """head(), reading only the blocks that hold the first n reads: their running counts decide before the scan (one row a block, so a filter by join)."""
    upto = Window.orderBy("file_idx", "block_idx").rowsBetween(Window.unboundedPreceding, -1)
    need = blocks.withColumn("_before", F.coalesce(F.sum("read_count").over(upto), F.lit(0))).filter(F.col("_before") < n).select("file_idx", "block_idx")
    return head(reads.join(need, ["file_idx", "block_idx"], "left_semi"), n)


def sample(reads: DataFrame, n: int, seed: int = 0, block: tuple[str, ...] = ("file_idx", "block_idx"), key: str = "ordinal") -> DataFrame:
    """n reads, spread over blocks of files: min(n, blocks) blocks, the first n mod blocks of them give one more; within a block by a seeded digest, without replacement. Quotas beyond a block's size give the whole block."""
    if n <= 0:
        return reads.limit(0)
    block = tuple(c for c in block if c in reads.columns)
    order = [F.col(c) for c in dict.fromkeys((key, "mate")) if c in reads.columns]
    sizes = reads.groupBy(*block).agg(F.count(F.lit(1)).alias("_size"))
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(*block)) - 1).withColumn("_blocks", F.least(F.lit(n), F.count(F.lit(1)).over(Window.partitionBy())))
    quota = F.when(F.col("_i") < F.col("_blocks"), F.floor(F.lit(n) / F.col("_blocks")) + F.when(F.col("_i") < F.lit(n) % F.col("_blocks"), 1).otherwise(0)).otherwise(0)
    quotas = ranked.select(*block, quota.alias("_quota")).filter("_quota > 0")
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    placed = reads.join(quotas, list(block)).withColumn("_rank", F.row_number().over(Window.partitionBy(*block).orderBy(digest, *order)))
    return placed.filter(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def list_files(reads: DataFrame) -> DataFrame:
    return reads.groupBy("file_idx").agg(F.count(F.lit(1)).alias("reads"))


def get_files(reads: DataFrame, indexes: list[int]) -> DataFrame:
    """Reads of some files; on an archive partitioned by file_idx this prunes partitions."""
    return reads.filter(F.col("file_idx").isin(sorted(set(indexes))))


def mate(reads: DataFrame, which: int) -> DataFrame:
    return reads.filter(F.col("mate") == which)


@dataclass(frozen=True)
class Spec:
    kind: str
    value: str | int | tuple[int, ...] | None = None


def parse_spec(text: str) -> Spec:
    """``M:regex``, ``H:n``, ``S:n``, ``L`` or ``G:i,j,...``."""
    kind, sign, rest = text.partition(":")
    if kind == "L" and not rest:
        return Spec("list")
    if kind == "M" and sign and rest:
        return Spec("match", rest)
    if kind in ("H", "S") and rest.isdigit():
        return Spec({"H": "head", "S": "sample"}[kind], int(rest))
    if kind == "G" and rest and all(x.strip().isdigit() for x in rest.split(",")):
        return Spec("get", tuple(sorted({int(x) for x in rest.split(",")})))
    raise ValueError(f"not an extract spec: {text!r}")


def extract(reads: DataFrame, spec: str | Spec, *, seed: int = 0, pair_mode: str = "each") -> DataFrame:
    s = parse_spec(spec) if isinstance(spec, str) else spec
    if s.kind == "match":
        return match_names(reads, str(s.value), pair_mode)
    if s.kind == "head":
        return head(reads, int(s.value))  # type: ignore[arg-type]
    if s.kind == "sample":
        return sample(reads, int(s.value), seed)  # type: ignore[arg-type]
    if s.kind == "get":
        return get_files(reads, list(s.value))  # type: ignore[arg-type]
    return list_files(reads)


def align_guard(reads: DataFrame, low: int = 64, high: int = 500) -> DataFrame:
    """Reads that may be split for alignment."""
    return reads.filter((F.length("seq") > low) & (F.length("seq") < high))


def record(comment: Column | None = None) -> Column:
    """A read as four lines; the third is bare, or "+" and the comment where there is one."""
    third = F.lit("+") if comment is None else F.concat(F.lit("+"), F.coalesce(comment, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), F.col("seq"), third, F.col("qual"))
