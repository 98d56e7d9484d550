"""Nearest neighbours by a permutation index: ordered nearest pivots, inverted files, footrule rank, rerank.

A vector is represented by its nearest pivots in order (by angle). Each pivot has an inverted file of the
vectors that list it, with the place that they give it. A query walks the files of its own nearest pivots;
with lists of length L the footrule distance of two lists is a constant less twice the sum of
L - max(place, place) over the pivots that both hold, so one addition a posting ranks exactly. The best
of that ranking are reranked by the inner product in double precision.

Equal vectors are one entry of the index that knows its smallest ids. The index is cut into segments of
bounded bytes, by length, band of norms (inner products favour long vectors, so each band is searched for
itself) and a hash; queries meet segments in blocks. A task holds one segment and one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Pivots of a length, places of a list, and the bounded sample that pivots are chosen from (the vectors of smallest hash): rows and bytes at most.
PIVOTS, LISTED, SAMPLE, SAMPLE_BYTES = 256, 64, 4096, 16 << 20
#: Cosine that two pivots stay below at first, so that a crowd of like vectors does not fill them.
APART = 0.5
#: Share of a segment that is reranked, and how many at least.
SHARE, LEAST = 0.2, 256
#: Bytes and rows of a segment, distinct queries of a block, different lengths of vectors that one index takes.
SEGMENT_BYTES, SEGMENT_ROWS, BLOCK, LENGTHS = 16 << 20, 16_384, 2048, 64


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lists(x: np.ndarray, pivots: np.ndarray, listed: int = LISTED) -> np.ndarray:
    """Rows of the ``listed`` nearest pivots (unit vectors) of each vector, nearest first, ties to the lower pivot."""
    return np.argsort(-(_unit(x) @ pivots.T), 1, kind="stable")[:, :listed].astype(np.int32)


def posted(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of lists (rows x places): (start of each pivot's file, rows, room), room being the list's length less the place."""
    n, listed = order.shape
    pivot, row = order.ravel(), np.repeat(np.arange(n, dtype=np.int32), listed)
    room = np.tile(np.arange(listed, 0, -1, dtype=np.uint16), n)
    by = np.argsort(pivot, kind="stable")
    return np.searchsorted(pivot[by], np.arange(n_pivots + 1)).astype(np.int64), row[by], room[by]


def shared(starts: np.ndarray, rows: np.ndarray, room: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of L - max(place, place) over the pivots of ``order``: the less the footrule distance, the higher."""
    score = np.zeros(n, np.uint32)
    for place, pivot in enumerate(order.tolist()):
        at = slice(starts[pivot], starts[pivot + 1])
        score[rows[at]] += np.minimum(room[at], np.uint16(len(order) - place))
    return score


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).distinct()


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, dim, norm), written: distinct vectors with their k + 1 smallest ids. A window with a limit keeps few rows of a vector that many share before the shuffle."""
    few = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_rank") <= k + 1)
    top = F.array_max(F.transform("v", F.abs))
    norm = F.log2(top) + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))) / 2
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return written(grouped.select("v", "ids", F.size("v").alias("dim"), norm.alias("norm")), "permutation-entries")


def spread(x: np.ndarray, n: int, apart: float = APART) -> np.ndarray:
    """``n`` of the unit vectors, in their order, no two with a cosine of ``apart`` or more; where these are too few, the bound is raised by a tenth, and so on."""
    chosen, rest = np.empty((0, x.shape[1])), np.arange(len(x))
    while len(chosen) < n and len(rest):
        left = []
        for i in rest.tolist():
            if len(chosen) < n and (apart >= 1 or not len(chosen) or (chosen @ x[i]).max() < apart):
                chosen = np.concatenate([chosen, x[i : i + 1]])
            else:
                left.append(i)
        rest, apart = np.array(left, np.int64), apart + 0.1
    return chosen


def _pivots(entries: DataFrame, n_pivots: int) -> dict[int, np.ndarray]:
    """Unit pivots of each length."""
    first = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v")
    bound = F.greatest(F.lit(n_pivots), F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (F.col("dim") * 8))))
    some = entries.select("dim", "v").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= SAMPLE).filter(F.col("_rank") <= bound)
    found: dict[int, list] = {}
    for r in some.orderBy("dim", "_rank").select("dim", "v").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: spread(_unit(np.array(v, np.float64)), n_pivots) for dim, v in found.items()}


def _segments(entries: DataFrame, listed: int) -> DataFrame:
    """(dim, band, segments): at most LENGTHS x 64 rows."""
    top = entries.agg(F.max("norm").alias("top"), F.countDistinct("dim").alias("lengths")).first()
    if (top["lengths"] or 0) > LENGTHS:
        raise ValueError(f"{top['lengths']} different lengths of vectors; an index takes {LENGTHS}")
    # a band is a factor of the root of two; what is very short shares the last one
    band = F.least(F.lit(63), F.floor((F.lit(top["top"] or 0.0) - F.col("norm")) * 2)).cast("int")
    per = F.greatest(F.lit(LEAST), F.least(F.lit(SEGMENT_ROWS), F.floor(F.lit(SEGMENT_BYTES) / (F.col("dim") * 8 + listed * 6))))
    placed = entries.withColumn("band", band)
    sizes = placed.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("segments", F.ceil(F.col("n") / per).cast("int"))
    return placed.join(F.broadcast(sizes.drop("n")), ["dim", "band"]).withColumn("segment", F.pmod(F.xxhash64("v"), F.col("segments")).cast("int"))


def build_index(vectors: DataFrame, *, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, listed: int = LISTED) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(the index, written, one row a segment: dim, band, segment, segments, n, starts, rows, room, x, ids, id_ends; unit pivots by length)."""
    entries = _entries(_usable(vectors, id_col, vec_col), k)
    chosen = _pivots(entries, pivots)
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind_of = np.float32 if single else np.float64

    def post(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        order = lists(x, chosen[dim], listed)
        starts, rows, room = posted(order, len(chosen[dim]))
        size = np.diff(ids.offsets.to_numpy())
        one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "band": table.column("band").slice(0, 1), "segment": table.column("segment").slice(0, 1), "segments": table.column("segments").slice(0, 1), "n": pa.array([len(x)], pa.int32()),
            "starts": one(starts), "rows": one(rows), "room": one(room), "x": one(x.astype(kind_of)), "ids": one(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), "id_ends": one(np.cumsum(size).astype(np.int64)),
        })

    schema = "dim int, band int, segment int, segments int, n int, starts binary, rows binary, room binary, x binary, ids binary, id_ends binary"
    placed = _segments(entries, listed).select("dim", "band", "segment", "segments", "v", F.col("ids").cast("array<long>").alias("ids"))
    return written(placed.groupBy("dim", "band", "segment").applyInArrow(post, schema), "permutation-index"), chosen


def neighbours(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int = PIVOTS, listed: int = LISTED, share: float = SHARE, least: int = LEAST, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that the index finds for each row that ``is_query`` holds of (a column over ``vec_id``).

    Nearness is the inner product of the vectors as they are, in double precision; ties go to the smaller
    vec_id. Ids are integers.

    Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows
    with a null id, take no part; vectors of different length are not compared; rows of the query's own id
    are no candidates; repeated rows count once, an id with several vectors is one candidate (and one
    query) for each; with fewer candidates than ``k`` all are returned; products that overflow to NaN come
    last; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    index, chosen = build_index(vectors, k=k, id_col=id_col, vec_col=vec_col, pivots=pivots, listed=listed)
    asked = _usable(vectors, id_col, vec_col).filter(is_query)
    distinct = written(asked.select("v", F.size("v").alias("dim")).distinct().withColumn("q", F.monotonically_increasing_id()), "permutation-queries")
    # both tables have at most LENGTHS x 64 rows
    sizes = distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    bands = spark.createDataFrame([tuple(r) for r in index.select("dim", "band", "segments").distinct().collect()], "dim int, band int, segments int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "q": pa.array([table.column("q").to_numpy().astype(np.int64).tobytes()], pa.binary()), "qx": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    blocks = distinct.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("v", F.lit(3)), F.col("blocks")).cast("int"))
    blocks = written(blocks.select("dim", "block", "q", "v").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, q binary, qx binary"), "permutation-blocks")
    cells = ["dim", "band", "segment", "block"]
    left = index.join(F.broadcast(sizes), "dim").select("*", upto("blocks").alias("block")).drop("blocks", "segments")
    right = blocks.join(F.broadcast(bands), "dim").select("*", upto("segments").alias("segment")).drop("segments")
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind_of = np.float32 if single else np.float64

    def search(key: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asking.num_rows:
            return none
        raw = lambda t, c, kind: np.frombuffer(t.column(c)[0].as_py(), kind)
        dim, n = key[0].as_py(), held.column("n")[0].as_py()
        starts, rows, room, ids = raw(held, "starts", np.int64), raw(held, "rows", np.int32), raw(held, "room", np.uint16), raw(held, "ids", np.int64)
        id_ends, x = raw(held, "id_ends", np.int64), raw(held, "x", kind_of).reshape(n, dim)
        id_starts = np.concatenate([[0], id_ends[:-1]])
        q, qx = raw(asking, "q", np.int64), raw(asking, "qx", np.float64).reshape(-1, dim)
        budget, out = max(least, math.ceil(share * n)), []
        for one, mine, order in zip(q.tolist(), qx, lists(qx, chosen[dim], listed), strict=True):
            near = np.arange(n)
            if budget < n:
                score = shared(starts, rows, room, order, n)
                near = np.flatnonzero(score >= np.partition(score, n - budget)[n - budget])  # ties at the cut all stay
            some = x[near].astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                rough = np.nan_to_num(some @ mine, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                if len(near) > k + 1:
                    cut = np.partition(rough, len(near) - k - 1)[len(near) - k - 1]
                    ahead = rough >= cut - 1e-9 * abs(cut)
                    near, some = near[ahead], some[ahead]
                exact = (some * mine).sum(1)  # alike for equal vectors, wherever they lie
            sizes_ = id_ends[near] - id_starts[near]
            value = np.repeat(exact, sizes_)
            name = ids[np.repeat(id_starts[near] - np.cumsum(sizes_) + sizes_, sizes_) + np.arange(len(value))]
            best = np.lexsort((name, -np.nan_to_num(value, nan=-np.inf, posinf=np.inf, neginf=-np.inf)))[: k + 1]
            out.append((np.full(len(best), one), name[best], value[best]))
        q_out, name, value = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": q_out, "vec_id": name, "score": value})

    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(search, "q long, vec_id long, score double")
    nearness = F.nanvl(F.col("score"), F.lit(float("-inf")))
    # a query gets k + 1 of each segment at most, and k + 1 in all
    best = found.withColumn("_rank", F.row_number().over(Window.partitionBy("q").orderBy(nearness.desc(), "vec_id"))).filter(F.col("_rank") <= k + 1)
    hits = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("hits"))
    kept = asked.join(distinct.select("v", "q"), "v").select("vec_id", "q").join(hits, "q")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k)
    ranked = kept.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_at", "_hit"))
    kind = dict(vectors.dtypes)[id_col]
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.vec_id").cast(kind).alias("vec_id"), F.col("_hit.score").alias("score"))
