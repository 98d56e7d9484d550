"""SimHash fingerprints and their links by the generalised pigeonhole.

64 bits are dealt to m partitions, correlated bits together; partition i gets a threshold t_i >= -1
(-1: not probed) with sum(t_i) = tau - m + 1. Two fingerprints within tau bits of each other then
agree up to t_i bits in at least one partition i. m and the thresholds come from dynamic programming
over estimated costs: rows that probing with radius t emits, and candidates it meets, estimated from a
bounded sample and the number of fingerprints.

Probing is a keyed join in disguise: a fingerprint is at home in the bucket of its own key and a guest
in the buckets of smaller keys within t_i bits. Buckets are dealt to tasks by hash; a bucket beyond
``block`` rows is cut into pairs of blocks. A task compares homes with guests in numpy and emits only a
spanning star of each local component, so output stays linear however dense a group of near copies is.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written
from .components import components, in_cells

BITS, SEED = 64, 42
#: Fingerprints that the plan is estimated from.
PLAN_SAMPLE = 4096
#: Seconds that one probe row and one candidate pair cost, and probe rows a fingerprint may have.
ROW_S, PAIR_S, MAX_ROWS = 1e-5, 3e-9, 160
#: Bucket rows beyond which a bucket is cut into blocks; rows of small buckets that share a task's table.
BLOCK, CELL_ROWS = 16_384, 50_000
#: Pairs compared, and shingles hashed, at once.
CHUNK = 1 << 17


def hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of the lower-cased (A-Z) words, in chunks."""
    parts = text.lower().split()
    if not parts:
        return
    words = min(words, len(parts))
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)


_BIT_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


def majority(chunks: Iterator[np.ndarray]) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; 0 for none."""
    n, counts = 0, np.zeros(BITS, np.int64)
    for h in chunks:
        lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def mapped(docs: DataFrame, of: Callable[[bytes], tuple], fields: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and what ``of`` makes of the UTF-8 text of each row."""
    kind = dict(docs.dtypes)[id_col]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(text.as_py()) for text in batch.column(1).cast(pa.binary())]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", *names])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {fields}")


def fingerprints(docs: DataFrame, words: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): SimHash of the word shingles, repeats included."""
    return mapped(docs, lambda text: (majority(hashes(text, words)),), "fp long", id_col, text_col)


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each grown around the bit with most correlation left."""
    x = bits - bits.mean(0)
    scale = np.sqrt((x * x).sum(0))
    scale[scale == 0] = 1
    strength = np.abs((x / scale).T @ (x / scale))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, groups))) // (m - i)
        group = [max(left, key=lambda b: strength[b, list(left)].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: strength[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _keys(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for to, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def plan(sample: np.ndarray, n: int, tau: int, max_rows: int = MAX_ROWS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the probed partitions with the least estimated cost for n fingerprints; where none keeps to ``max_rows`` probe rows, twice as many are allowed."""
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    half = sample[: PLAN_SAMPLE // 2], sample[len(sample) // 2 :][: PLAN_SAMPLE // 2]
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, min(tau + 1, 16) + 1):
        groups, budget = _group_bits(bits, m), tau - m + 1
        options = []
        for group in groups:
            apart = np.bitwise_count(_keys(half[0], group)[:, None] ^ _keys(half[1], group)[None, :])
            seen = np.bincount(apart.ravel(), minlength=BITS + 1).cumsum() / max(1, apart.size)
            cost, ball = {-1: (0.0, 0.0)}, 0
            for t in range(min(budget + m - 1, len(group), 6) + 1):
                ball += math.comb(len(group), t)
                chance = max(seen[t], ball / 2.0 ** len(group))
                cost[t] = (ROW_S * (ball + 1) / 2 + PAIR_S * n * chance, (ball + 1) / 2)
            options.append(cost)
        # states: sum of thresholds -> (cost, rows, thresholds)
        states: dict[int, tuple[float, float, tuple]] = {0: (0.0, 0.0, ())}
        for cost in options:
            new: dict[int, tuple[float, float, tuple]] = {}
            for total, (c, rows, chosen) in states.items():
                for t, (more, some) in cost.items():
                    state = (c + more, rows + some, (*chosen, t))
                    if state[1] <= max_rows and (total + t not in new or state < new[total + t]):
                        new[total + t] = state
            states = new
        if budget in states and states[budget][0] < best[0]:
            best = states[budget][0], [(g, t) for g, t in zip(groups, states[budget][2], strict=True) if t >= 0]
    return best[1] or plan(sample, n, tau, 2 * max_rows)


def star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their component, by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def segment_pairs(first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (first[k], r) with first[k] < r < stop[k], chunk by chunk."""
    count = stop - first - 1
    first, count = first[count > 0], count[count > 0]
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        c = count[at:upto]
        left = np.repeat(first[at:upto], c)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        yield left, right
        at = upto


def linked(rows: DataFrame, tau: int, *, near: Callable[[dict, np.ndarray, np.ndarray], np.ndarray] | None = None, extra: str = "", block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of rows (node long, fp long, extra...) within tau bits.

    ``near(columns, left, right)`` may reject pairs by the extra columns (all long).
    """
    names = ["node", "fp", *(x.split()[0] for x in extra.split(", ") if x)]
    rows = rows.select(*names)
    n = rows.count()
    head = rows.filter(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(max(1, n // PLAN_SAMPLE))) == 0).select("fp").limit(PLAN_SAMPLE).collect()
    parts = plan(np.array([r[0] for r in head], np.int64).astype(np.uint64), n, tau)
    # masks of each probed partition, the empty one first
    masks = [np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(len(g)), k)], np.uint64) for g, t in parts]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fps = batch.column(1).to_numpy().astype(np.uint64)
                for part, ((group, _), flips) in enumerate(zip(parts, masks, strict=True)):
                    keys = _keys(fps, group)
                    bucket = keys[:, None] ^ flips[None, :]
                    row, col = np.nonzero(bucket <= keys[:, None])
                    out = [pa.array(np.full(len(row), part, np.int32)), pa.array(bucket[row, col].astype(np.int64)), pa.array((col == 0).astype(np.int32))]
                    index = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*out, *(batch.column(i).take(index) for i in range(len(names)))], ["part", "bucket", "home", *names])

    probed = rows.mapInArrow(probes, "part int, bucket long, home int, " + ", ".join(f"{x} long" for x in names))
    hot = probed.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("_crowd"), F.max("home").alias("_any")).filter(f"_crowd > {block}")
    cells = max(8, math.ceil(n * sum((len(f) + 1) / 2 for f in masks) / CELL_ROWS))
    both = in_cells(probed, hot, ["part", "bucket"], cells, block, "_any = 1")
    columns = ["part", "cell", "i", "j", "own", "bucket", "home", *names]
    both = both.select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        c = {x: table.column(x).to_numpy() for x in ("bucket", "home", "own", *names)}
        order = np.lexsort((-c["home"], c["bucket"]))
        c = {k: v[order] for k, v in c.items()}
        change = np.flatnonzero(np.diff(c["bucket"])) + 1
        bounds = np.concatenate([[0], change, [len(order)]])
        stop = np.repeat(bounds[1:], np.diff(bounds))
        cross = len(order) and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        fps, label = c["fp"].astype(np.uint64), np.arange(len(order))
        homes = np.flatnonzero(c["home"] == 1)
        for left, right in segment_pairs(homes, stop[homes]):
            ok = np.bitwise_count(fps[left] ^ fps[right]) <= tau
            if cross:
                ok &= c["own"][left] != c["own"][right]
            left, right = left[ok], right[ok]
            if near and len(left):
                ok = near(c, left, right)
                left, right = left[ok], right[ok]
            label = star(np.concatenate([left, np.arange(len(label))]), np.concatenate([right, label]), len(label)) if len(left) else label
        moved = np.flatnonzero(c["node"] != c["node"][label])
        return pa.table({"a": c["node"][label[moved]], "b": c["node"][moved]})

    return both.groupBy("part", "cell", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_classes(docs: DataFrame, *, words: int = 3, tau: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over fingerprints within tau bits).

    Equal fingerprints are one node, so copies are never compared with each other.

    Defined cases: null, empty and all-white texts have fingerprint zero, linked like any other;
    fewer words than a shingle are one shingle; rows with a null doc_id get a class but never name
    one (null, if their fingerprint occurs in such rows alone); repeated rows share a class; an empty
    table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    known = nodes.filter("node is not null")
    found = components(linked(known, tau, block=block))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
