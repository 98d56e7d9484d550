"""Near-duplicate documents: candidates by SimHash and by shared rare shingles, exact Jaccard of five-word shingles.

SimHash candidates are documents whose SimHashes of distinct words lie within TAU bits, whose SimHashes of
shingles lie within FAR bits, and whose shingle counts allow the similarity. They miss copies that lose or
gain many words at once, so every pair that shares a shingle of its prefixes is a candidate too: in one
order of all shingles, two sets of the similarity meet within their first ones, whatever the edits. A pair
is rejected only where counts of shingles by class of hash prove it less similar.

Rows of equal shingle sets are one node. Candidates form components with linear output; only documents of
components with two or more are looked at again. Each member is compared with the component's centre
first: those that are similar to it are one class and never meet each other. The few that are not meet all
other members in cells (blocks of large components), where bit sets give exact Jaccard. Verified links give
the final classes. A row is known by its id and text, so rows of one id and different texts are judged apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written
from .components import block_cells, components
from .simhash import hashes, linked, majority, mapped, segment_pairs, star

WORDS, SIMILARITY = 5, 0.8
#: Bits within which copies of this similarity lie: of distinct words (about 99 in 100 of pairs just at 0.8), and of shingles.
TAU, FAR = 9, 22
BLOCK = 512
CELLS = 4096
#: Documents that common shingles are looked for in (for the order of shingles only; results do not depend on it), and how many are kept.
ORDER_SAMPLE, COMMON = 2048, 1 << 16
#: Prefix rows of a bucket beyond which it is cut into blocks, rows of small buckets that share a task's table, and bytes of counts compared at once.
PREFIX_BLOCK, CELL_ROWS, COMPARED = 16_384, 20_000, 1 << 23


def _set(text: bytes) -> np.ndarray:
    found = list(hashes(text, WORDS))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def signature(text: bytes) -> tuple[int, int, int]:
    """(SimHash of distinct words, SimHash of distinct shingles, number of distinct shingles)."""
    return _signature(text, _set(text))


def _signature(text: bytes, shingles: np.ndarray) -> tuple[int, int, int]:
    words = b" ".join(sorted(set(text.lower().split())))
    return majority(hashes(words, 1)), majority(iter([shingles])), len(shingles)


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """How many first shingles of a set of n meet those of any set of the similarity: of one not smaller than itself (home), of any one."""
    reach = lambda share: n - math.ceil(share * n - 1e-9) + 1
    return reach(2 * similarity / (1 + similarity)), reach(similarity)


def class_counts(shingles: np.ndarray) -> bytes:
    """Counts, at most 255, of the hashes by their low bits; about eight shingles or fewer a class, 32 classes or more."""
    classes = 32 << max(0, math.ceil(math.log2(max(1, len(shingles)) / 256)))
    counts = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _common(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of three or more documents of a bounded sample, sorted."""
    base = id_text(docs, id_col, text_col)
    some = base.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(max(1, docs.count() // ORDER_SAMPLE))) == 0).limit(ORDER_SAMPLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(_set(text.as_py()).astype(np.int64))], ["shingle"])

    often = some.mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    return np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()], np.int64).astype(np.uint64))


def prefix_links(signs: DataFrame, similarity: float, block: int = PREFIX_BLOCK) -> DataFrame:
    """(a, b): links of (node, n, prefix, counts) whose components hold all pairs of the similarity."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                firsts = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(2)]
                homes = [prefix_sizes(n, similarity)[0] for n in batch.column(1).to_pylist()]
                home = np.concatenate([np.arange(len(f)) < h for f, h in zip(firsts, homes, strict=True)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(f) for f in firsts])), pa.array(home)], ["bucket", "node", "home"])

    rows = signs.select("node", "n", "prefix").mapInArrow(explode, "bucket long, node long, home int")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_crowd"), F.max("home").alias("_any")).filter("_crowd > 1 and _any = 1").select("bucket", "_crowd")
    met = written(rows.join(shared, "bucket").join(signs.select("node", "n", "counts"), "node"), "near-prefixes")
    cells = max(8, math.ceil(met.count() / CELL_ROWS))
    zero = F.lit(0)
    columns = ["cell", "i", "j", "own", "bucket", "home", "node", "n", "counts"]
    small = met.filter(F.col("_crowd") <= block).withColumns({"cell": F.pmod(F.xxhash64("bucket"), F.lit(cells)), "own": zero, "i": zero, "j": zero})
    large = block_cells(met.filter(F.col("_crowd") > block), ["bucket"], "node", block).withColumn("cell", F.xxhash64("bucket"))

    def compare(table: pa.Table) -> pa.Table:
        c = {x: table.column(x).to_numpy() for x in ("bucket", "home", "own", "node", "n")}
        order = np.lexsort((-c["home"], c["bucket"]))
        c = {k: v[order] for k, v in c.items()}
        counts = table.column("counts").combine_chunks().take(pa.array(order)).to_pylist()
        tier = np.array([len(x) // 32 for x in counts], np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(c["bucket"])) + 1, [len(order)]])
        stop = np.repeat(bounds[1:], np.diff(bounds))
        cross = len(order) and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        # counts of a node are held once a tier: its own, and folded to the next smaller one
        node, first, place = np.unique(c["node"], return_index=True, return_inverse=True)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at_tier(t: int) -> tuple[np.ndarray, np.ndarray]:
            if t not in held:
                fits = np.flatnonzero((tier[first] == t) | (tier[first] == 2 * t))
                table_ = np.zeros((len(fits), 32 * t), np.uint8)
                for k, r in enumerate(first[fits]):
                    x = np.frombuffer(counts[r], np.uint8)
                    table_[k] = x if tier[r] == t else np.minimum(x.reshape(2, -1).sum(0), 255)
                index = np.full(len(node), -1)
                index[fits] = np.arange(len(fits))
                held[t] = index, table_
            return held[t]

        def may(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            allowed = (c["n"][left] + c["n"][right]) * (1 - similarity) / (1 + similarity) + 1e-6
            low, ok = np.minimum(tier[left], tier[right]), np.ones(len(left), bool)
            for t in np.unique(low).tolist():
                index, table_ = at_tier(t)
                which, step = np.flatnonzero(low == t), max(1, COMPARED // (32 * t))
                for at in range(0, len(which), step):
                    w = which[at : at + step]
                    x, y = table_[index[place[left[w]]]], table_[index[place[right[w]]]]
                    ok[w] = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64) <= allowed[w]
            return ok

        label = np.arange(len(node))
        homes = np.flatnonzero(c["home"] == 1)
        for left, right in segment_pairs(homes, stop[homes]):
            size_l, size_r = c["n"][left], c["n"][right]
            ok = (np.minimum(size_l, size_r) >= similarity * np.maximum(size_l, size_r) - 1e-9) & (label[place[left]] != label[place[right]])
            if cross:
                ok &= c["own"][left] != c["own"][right]
            left, right = left[ok], right[ok]
            if len(left):
                ok = may(left, right)
                ends = place[left[ok]], place[right[ok]]
                every = np.arange(len(label))
                label = star(np.concatenate([ends[0], every]), np.concatenate([ends[1], label]), len(label))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[label[moved]], "b": node[moved]})

    both = small.select(*columns).unionByName(large.select(*columns))
    return both.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def _signatures(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """One row per row with an id and words, written: node, doc_id, text_sha256, same (digest of the shingle set), fp, far, n, prefix, counts."""
    common = _common(docs, id_col, text_col)

    def sign(text: bytes) -> tuple:
        shingles = _set(text)
        often = np.isin(shingles, common, assume_unique=True)
        ranked = np.concatenate([shingles[~often], shingles[often]])
        prefix = ranked[: prefix_sizes(len(ranked), similarity)[1]].tobytes()
        return hashlib.sha256(text).hexdigest(), hashlib.sha256(shingles.tobytes()).digest()[:16], *_signature(text, shingles), prefix, class_counts(shingles)

    signs = mapped(docs, sign, "text_sha256 string, same binary, fp long, far long, n long, prefix binary, counts binary", id_col, text_col)
    return written(signs.filter("doc_id is not null and n > 0").withColumn("node", F.monotonically_increasing_id()), "near-signatures")


def _candidates(signs: DataFrame, similarity: float, tau: int) -> DataFrame:
    """(node, component) of the nodes that may be similar to another, written; component is its smallest node."""

    def may(c: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        low, high = np.minimum(c["n"][left], c["n"][right]), np.maximum(c["n"][left], c["n"][right])
        return (low >= similarity * high) & (np.bitwise_count(c["far"][left].astype(np.uint64) ^ c["far"][right].astype(np.uint64)) <= FAR)

    links = linked(signs.select("node", "fp", "far", "n"), tau, near=may, extra="far long, n long").unionByName(prefix_links(signs, similarity))
    return written(components(links), "near-candidates")


def _member_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component, shingles) of ``wanted`` (node, component, doc_id, text_sha256), written."""
    # digests are taken of the texts that the ids meet, not of all
    members = id_text(docs, id_col, text_col).join(wanted, "doc_id").filter(F.sha2("text", 256) == F.col("text_sha256"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [_set(t.as_py()).tobytes() for t in batch.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["node", "component", "shingles"])

    sets = members.select("node", "component", "text").mapInArrow(shingled, "node long, component long, shingles binary")
    return written(sets.dropDuplicates(["node"]), "near-shingles")  # rows alike in id and text have met each other


def _near_centre(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component, near), written: whether a member is similar to the smallest node of its component, which is near itself."""
    centres = sets.filter("node = component").select("component", F.col("shingles").alias("centre"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, centre in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(centre.as_py(), np.uint64)
                both = 0
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9:
                    at = np.searchsorted(b, a)
                    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                near.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["node", "component", "near"])

    joined = sets.join(centres, "component").select("node", "component", "shingles", "centre")
    return written(joined.mapInArrow(compare, "node long, component long, near boolean"), "near-centres")


def _others(sets: DataFrame, judged: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links of the members that are not near their centre, with each other and with those that are."""
    sizes = judged.groupBy("component").agg(F.count_if(~F.col("near")).alias("_u"), F.count_if("near").alias("_l")).filter("_u > 0")
    blocks = sizes.select("component", (F.col("_u") + F.col("_l") <= block).alias("_small"), F.ceil(F.col("_u") / block).cast("int").alias("_ku"), F.ceil(F.col("_l") / block).cast("int").alias("_kl"))
    rows = sets.join(judged.join(blocks, "component").drop("component"), "node")
    place = lambda k: F.pmod(F.xxhash64("node", F.lit(7)), F.col(k)).cast("int")
    rows = rows.withColumn("own", F.when(F.col("_small"), F.lit(0)).when(F.col("near"), F.col("_ku") + place("_kl")).otherwise(place("_ku")))
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, apart = F.col("own"), F.sequence(F.lit(0), F.col("_ku") - 1)
    with_apart = F.transform(apart, lambda x: cell(F.least(x, own), F.greatest(x, own)))  # for those near, own is beyond all x
    with_near = F.transform(F.sequence(F.col("_ku"), F.col("_ku") + F.col("_kl") - 1), lambda y: cell(own, y))
    cells = F.when(F.col("_small"), F.array(cell(F.lit(0), F.lit(0)))).when(F.col("near"), with_apart).otherwise(F.concat(with_apart, with_near))
    dealt = rows.select("node", "component", "near", "shingles", "own", "_small", F.inline(cells))
    # small components share a task's table
    dealt = dealt.withColumn("cell", F.when(F.col("_small"), F.pmod(F.xxhash64("component"), F.lit(CELLS))).otherwise(F.xxhash64("component", "i", "j"))).drop("_small")

    def verify(table: pa.Table) -> pa.Table:
        ids, of, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
        near = table.column("near").to_numpy(zero_copy_only=False)
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets_ = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        order = np.lexsort((ids, near, of))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1, [len(order)]])
        a, b = [], []
        for at, stop in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[at:stop]
            sizes_ = np.array([len(sets_[r]) for r in rows])
            # bit k of a row: it holds the k-th shingle that at least two rows hold
            values, place_, times = np.unique(np.concatenate([sets_[r] for r in rows]), return_inverse=True, return_counts=True)
            shared = np.cumsum(times > 1) - 1
            bits = np.zeros((len(rows), max(1, (int(shared[-1]) + 64) // 64)), np.uint64)
            row = np.repeat(np.arange(len(rows)), sizes_)
            keep = times[place_] > 1
            k = shared[place_[keep]].astype(np.uint64)
            np.bitwise_or.at(bits, (row[keep], k >> np.uint64(6)), np.uint64(1) << (k & np.uint64(63)))
            lefts, rights = [], []
            for x in range(min(len(rows) - 1, int((~near[rows]).sum()))):  # those not near come first
                common = np.bitwise_count(bits[x] & bits[x + 1 :]).sum(1, dtype=np.int64)
                hit = np.flatnonzero(common >= similarity * (sizes_[x] + sizes_[x + 1 :] - common) - 1e-9)
                if cross:
                    hit = hit[own[rows[x]] != own[rows[x + 1 + hit]]]
                lefts.append(np.full(len(hit), x))
                rights.append(x + 1 + hit)
            if lefts:
                root = star(np.concatenate(lefts), np.concatenate(rights), len(rows))
                moved = np.flatnonzero(root != np.arange(len(rows)))
                a.append(ids[rows[root[moved]]])
                b.append(ids[rows[moved]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"a": cat(a), "b": cat(b)})

    return dealt.groupBy("cell", "i", "j").applyInArrow(verify, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, tau: int, block: int) -> DataFrame:
    """(doc_id, text_sha256, keep_id, keep_text) of the rows in a class of two or more, kept ones too."""
    signs = _signatures(docs, id_col, text_col, similarity)
    heads = signs.groupBy("same").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("same", "a")
    doubles = written(signs.select("same", F.col("node").alias("b")).join(heads, "same").filter("a <> b").select("a", "b"), "near-doubles")
    single = signs.join(doubles.select(F.col("b").alias("node")), "node", "left_anti")
    groups = _candidates(single, similarity, tau)
    sets = _member_sets(docs, groups.join(signs.select("node", "doc_id", "text_sha256"), "node"), id_col, text_col)
    judged = _near_centre(sets, similarity)
    links = judged.filter("near and node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(doubles)
    links = links.unionByName(_others(sets, judged, similarity, block))
    named = components(links).join(signs.select("node", "doc_id", "text_sha256"), "node")
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", "text_sha256")).alias("least"))
    return named.join(least, "component").select("doc_id", "text_sha256", F.col("least.doc_id").alias("keep_id"), F.col("least.text_sha256").alias("keep_text"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of every document in a class of two or more; component_id is the smallest doc_id of the class.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles
    (lower-cased A-Z; fewer words: the whole sequence) is ``similarity`` or more.

    Defined cases: null and empty texts have no shingles and link with nothing, nor do rows with a
    null doc_id; rows of one doc_id and different texts are judged each by its text, and the id is listed
    with each class that one of them is in; rows alike in id and text are one document; an empty table
    gives an empty result; other columns are ignored.
    """
    return _classes(docs, id_col, text_col, similarity, tau, block).select("doc_id", F.col("keep_id").alias("component_id")).distinct()


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id, of one id the least digest of its text. All other rows stay as they are.

    Defined cases: as in near_classes(); a row goes only if its own text has a copy, whatever other rows
    of its id hold; rows alike in id and text stay or go together.
    """
    classes = _classes(docs, id_col, text_col, similarity, tau, block)
    gone = classes.filter("not (doc_id = keep_id and text_sha256 = keep_text)").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_text")).distinct()
    text = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (text == gone["_gone_text"]), "left_anti")
