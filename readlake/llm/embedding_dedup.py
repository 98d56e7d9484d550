"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one node with a weight, so a vector that a third of all rows repeat is compared
once. Bits per table follow the number of vectors, tables follow from the wanted recall at the
threshold itself. A pair that shares buckets in several tables counts in the first of them only, so
link counts need no distinct over pairs; large buckets are cut into pairs of blocks, and a task emits
per vector its count and one link of a spanning star: output is linear.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, in_cells
from .simhash import star

#: Vectors that an unrelated bucket would hold on average; chance that a pair at the threshold shares a bucket.
BUCKET_SIZE, RECALL = 32, 0.998
BLOCK, CELL_ROWS = 2048, 20_000


def shape(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n / BUCKET_SIZE)))))
    hit = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


@functools.lru_cache(8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def cosine_classes(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components links
    with nothing, nor does a row with a null id (its component is its own id); vectors of different
    length never link; repeated rows link with each other; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    good = rows.filter("good")
    nodes = written(good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "vectors")
    n = nodes.count()
    bits, tables = shape(n, threshold, recall)

    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind_of = np.float32 if single else np.float64

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def signs(x: np.ndarray) -> np.ndarray:
        """Keys of unit vectors, one column a table."""
        return (((x @ _planes(x.shape[1], bits, tables, seed)) > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(2)

    def probes(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = batch.column(0)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)])
                for dim in np.unique(lengths):
                    rows_of = np.flatnonzero(lengths == dim)
                    raw = flat[starts[rows_of][:, None] + np.arange(dim)]
                    keys = signs(unit(raw))
                    index = pa.array(rows_of)
                    same = [batch.column(1).take(index), batch.column(2).take(index), pa.array([r.tobytes() for r in raw.astype(kind_of)], pa.binary())]
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array(keys[:, t].astype(np.int64) << 32 | int(dim)), *same], ["part", "bucket", "node", "weight", "x"])

    kind = dict(nodes.dtypes)["node"]
    probed = nodes.select("v", "node", "weight").mapInArrow(probes, f"part int, bucket long, node {kind}, weight long, x binary")
    hot = probed.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {block}")
    columns = ["part", "cell", "i", "j", "own", "bucket", "node", "weight", "x"]
    dealt = in_cells(probed, hot, ["part", "bucket"], max(8, math.ceil(n * tables / CELL_ROWS)), block).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        bucket, own, node, weight = (table.column(c).to_numpy() for c in ("bucket", "own", "node", "weight"))
        cross, part = table.column("i")[0].as_py() != table.column("j")[0].as_py(), table.column("part")[0].as_py()
        order = np.argsort(bucket, kind="stable")
        x = table.column("x").combine_chunks()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        nodes_out, links_out, to_out = [], [], []
        for at, stop in zip(bounds[:-1], bounds[1:], strict=True):
            if stop - at < 2:
                continue
            rows_of = order[at:stop]
            m = unit(np.stack([np.frombuffer(b, kind_of) for b in x.take(pa.array(rows_of)).to_pylist()]))
            left, right = np.nonzero(np.triu(m @ m.T >= threshold, 1))
            if cross:
                ok = own[rows_of[left]] != own[rows_of[right]]
                left, right = left[ok], right[ok]
            if part and len(left):
                # a pair counts in the first of the tables that it shares a bucket in
                met, place = np.unique(np.concatenate([left, right]), return_inverse=True)
                k = signs(m[met])[:, :part]
                left_k, right_k = place[: len(left)], place[len(left) :]
                fresh = np.ones(len(left), bool)
                for t in range(part):
                    fresh &= k[left_k, t] != k[right_k, t]
                left, right = left[fresh], right[fresh]
            if len(left):
                w, ids = weight[rows_of], node[rows_of]
                links = np.bincount(left, w[right], len(rows_of)) + np.bincount(right, w[left], len(rows_of))
                root = star(left, right, len(rows_of))
                has = np.flatnonzero(links)
                nodes_out.append(ids[has])
                links_out.append(links[has].astype(np.int64))
                to_out.append(ids[root[has]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"node": pa.array(cat(nodes_out), table.schema.field("node").type), "links": pa.array(cat(links_out), pa.int64()), "to": pa.array(cat(to_out), table.schema.field("node").type)})

    found = dealt.groupBy("part", "cell", "i", "j").applyInArrow(compare, f"node {kind}, links long, to {kind}")
    found = written(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found, "node", "to")
    of_node = nodes.join(links, "node", "left").join(classes, "node", "left").select("v", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "v").join(of_node, "v").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
