"""Toxicity by the nearest labelled examples: exact cosine of TF-IDF vectors over a block-max inverted index.

Fitting looks at a bounded sample of labelled rows (``max_examples``, by hash order). Every word of an
example is a term of the index, none is selected or left out; document frequencies come from all
documents. A term's weight is its TF-IDF, times how many standard deviations its share of label 1 is off
the overall share where that is more than one: with TF-IDF alone neighbours agree in topic, not in
toxicity (figures in the README).

The index has postings of the examples; those of words that many examples hold are kept as columns in
blocks of consecutive examples with the greatest weight per word and block. A query sums its rare words
exactly, bounds each block by that and its maxima, and visits blocks in the order of their bounds until
none can enter the k best, so results are exact. Votes weighted by distance pass through a logistic
calibration fitted on leave-one-out votes of the examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, written

WORD = re.compile(r"\w+")
#: Bounds of the model: labelled examples, nearest examples that vote, leave-one-out votes that the calibration is fitted on.
MAX_EXAMPLES, K, CALIBRATION = 6144, 7, 4096
#: Examples in a block, queries searched at once; a word that one in so many examples holds is kept in blocks.
BLOCK, QUERIES, COMMON = 64, 64, 24
MEMO_WORDS = 100_000

INTS = pa.list_(pa.int32())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts at once are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hashed(words: list[str]) -> np.ndarray:
    """Words stand for themselves as 64-bit hashes."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def word_counts(texts: list[str]) -> list[Counter]:
    """Words of the lower-cased texts with their counts."""
    return [Counter(WORD.findall(t.lower())) for t in texts]


class Vocabulary:
    """Hashes of the known words, sorted; a word's number is its place."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.memo = hashes, {}

    def __len__(self) -> int:
        return len(self.hashes)

    def __reduce__(self):
        return Vocabulary, (self.hashes,)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, terms, counts): of each text the known words in order, and how often it has them."""
        found = word_counts(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = list({w for c in found for w in c if w not in self.memo})
        if fresh and len(self):
            h = hashed(fresh)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
            self.memo.update(zip(fresh, np.where(self.hashes[at] == h, at, -1).tolist(), strict=True))
        else:
            self.memo.update(dict.fromkeys(fresh, -1))
        sizes = [len(c) for c in found]
        terms = np.fromiter((self.memo[w] for c in found for w in c), np.int32, sum(sizes))
        counts = np.fromiter((n for c in found for n in c.values()), np.int32, sum(sizes))
        rows = np.repeat(np.arange(len(texts)), sizes)
        keep = np.flatnonzero(terms >= 0)
        keep = keep[np.lexsort((terms[keep], rows[keep]))]
        return np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(texts)))]).astype(np.int32), terms[keep], counts[keep]


class BlockMaxIndex:
    """Unit vectors given as (offsets, terms, weights); searched for the greatest cosines."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK, common: int = COMMON):
        self.n, self.block = len(offsets) - 1, block
        self.blocks = max(1, -(-self.n // block))
        owner = np.repeat(np.arange(self.n), np.diff(offsets))
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) > max(1, self.n // common))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        many = self.column[terms] >= 0
        dense = np.zeros((self.n, len(often)))
        dense[owner[many], self.column[terms[many]]] = weights[many]
        # vectors alike side by side, those with as much weight on common words too: tighter bounds
        self.order = np.lexsort((np.arange(self.n), (dense * dense).sum(1), _alike(dense)))
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        self.dense = np.concatenate([dense[self.order], np.zeros((self.blocks * block - self.n, len(often)))]).reshape(self.blocks, block, -1)
        self.bound = self.dense.max(1)
        docs = place[owner[~many]]
        by_term = np.lexsort((docs, terms[~many]))
        self.start = np.searchsorted(terms[~many][by_term], np.arange(n_terms + 1)).astype(np.int32)
        self.doc, self.weight = docs[by_term].astype(np.int32), weights[~many][by_term]

    def search(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), each of k columns: of each query the k best with a positive cosine, then -1 and 0; ties go to the earlier in index order. ``skip``: an example that each query leaves out."""
        n = len(offsets) - 1
        found, best = np.full((n, k), -1, np.int64), np.zeros((n, k))
        for at in range(0, n, QUERIES):
            stop = min(n, at + QUERIES)
            own = slice(offsets[at], offsets[stop])
            found[at:stop], best[at:stop] = self._search(offsets[at : stop + 1] - offsets[at], terms[own], weights[own], k, None if skip is None else skip[at:stop])
        return found, best

    def _search(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(offsets) - 1, self.blocks * self.block
        query, column = np.repeat(np.arange(n), np.diff(offsets)), self.column[terms]
        many = column >= 0
        q = np.zeros((n, self.bound.shape[1]))
        q[query[many], column[many]] = weights[many]
        # words that few examples hold: exact sums from their postings
        rare = terms[~many]
        start, size = self.start[rare], self.start[rare + 1] - self.start[rare]
        ends = np.cumsum(size)
        rows = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.bincount(np.repeat(query[~many] * width, size) + self.doc[rows], self.weight[rows] * np.repeat(weights[~many], size), n * width).astype(float, copy=False)
        if skip is not None:
            sums[np.arange(n) * width + skip] = -np.inf
        sums = sums.reshape(n, self.blocks, self.block)
        bounds = sums.max(2) + q @ self.bound.T
        best = np.zeros((n, k))  # the k greatest cosines so far, least first
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(block: int, which: np.ndarray) -> None:
            got = np.round(sums[which, block] + q[which] @ self.dense[block].T, 12)
            row, at = np.nonzero((got > 0) & (got >= best[which, :1]))
            if len(row):
                met.append((which[row], block * self.block + at, got[row, at]))
                better = np.unique(row)
                best[which[better]] = np.partition(np.concatenate([best[which[better]], got[better]], 1), -k)[:, -k:]
                best[which[better]] = np.sort(best[which[better]])

        top = bounds.argmax(1)
        for block in np.unique(top):
            visit(block, np.flatnonzero(top == block))
        bounds[np.arange(n), top] = -1
        for block in np.argsort(-bounds.max(0), kind="stable"):
            # no block whose bound is below the k-th best so far can change the result
            which = np.flatnonzero((bounds[:, block] > 0) & (bounds[:, block] >= best[:, 0] - 1e-11))
            if len(which):
                visit(block, which)
        found, cosines = np.full((n, k), -1, np.int64), np.zeros((n, k))
        if met:
            query, doc, cosine = (np.concatenate(x) for x in zip(*met, strict=True))
            keep = np.flatnonzero(cosine >= best[query, 0])
            keep = keep[np.lexsort((doc[keep], -cosine[keep], query[keep]))]
            query = query[keep]
            rank = np.arange(len(keep)) - np.searchsorted(query, query)
            first = rank < k
            found[query[first], rank[first]], cosines[query[first], rank[first]] = doc[keep[first]], cosine[keep[first]]
        return found, cosines


def _alike(x: np.ndarray, groups: int = 8, rounds: int = 6) -> np.ndarray:
    """Rows in groups by direction (spherical k-means from evenly spaced rows)."""
    length = np.sqrt((x * x).sum(1, keepdims=True))
    x = x / np.maximum(length, 1e-12)
    centres = x[:: max(1, len(x) // groups)][:groups]
    group = np.zeros(len(x), np.int64)
    for _ in range(rounds if len(centres) and x.shape[1] else 0):
        group = (x @ centres.T).argmax(1)
        sums = np.stack([x[group == g].sum(0) for g in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return group


class Model:
    """Vocabulary, weights of its words, index of the examples, their ids and labels, calibration.

    ``examples`` is (offsets, terms, counts); ``df`` and ``n`` are the documents that hold each word and all documents.
    """

    def __init__(self, vocabulary: Vocabulary, df: np.ndarray, n: int, ids: list, labels: np.ndarray, examples: tuple[np.ndarray, np.ndarray, np.ndarray], k: int = K):
        self.vocabulary, self.k = vocabulary, k
        offsets, terms, counts = examples
        y = np.asarray(labels, float)
        self.weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(offsets, terms, y, len(vocabulary))
        weights = self.weights(offsets, terms, counts)
        self.index = BlockMaxIndex(offsets, terms, weights, len(vocabulary))
        self.ids, self.labels = [ids[i] for i in self.index.order], y[self.index.order]
        self.rate = float((y.sum() + 0.5) / (len(y) + 1))
        self.coef = np.array([0.0, 1.0])
        chosen = np.arange(len(y))[:: max(1, math.ceil(len(y) / CALIBRATION))]
        if len(chosen):
            sizes = np.diff(offsets)[self.index.order[chosen]]
            ends = np.cumsum(sizes)
            rows = np.repeat(offsets[self.index.order[chosen]] - ends + sizes, sizes) + np.arange(ends[-1])
            found, cosines = self.index.search(np.concatenate([[0], ends]), terms[rows], weights[rows], k, chosen)
            self._calibrate(self.votes(found, cosines), self.labels[chosen])

    def weights(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of vectors, each of length one."""
        w = (1 + np.log(counts)) * self.weight[terms]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return w / np.sqrt(np.bincount(owner, w * w, len(offsets) - 1))[owner]

    def votes(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Log-odds of the votes of each row, each weighted by its nearness; the overall rate votes with a little weight."""
        near = np.where(found >= 0, 1 / (1.05 - np.minimum(cosines, 1)), 0)
        labels = self.labels[found] if len(self.labels) else np.zeros(found.shape)
        p = ((near * labels).sum(1) + 0.5 * self.rate) / (near.sum(1) + 0.5)
        return np.log(p / (1 - p))

    def _calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the label on the vote, with a small ridge; Newton steps."""
        x = np.stack([np.ones_like(votes), votes], 1)
        y = labels * (1 - 1e-3) + 5e-4
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * (self.coef - [0, 1]))
            self.coef = self.coef + step
            if np.abs(step).max() < 1e-9:
                break
        self.coef[1] = max(self.coef[1], 1e-3)

    def score(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the probability of label 1, and the voting examples (then -1) with their cosines."""
        found, cosines = self.index.search(offsets, terms, self.weights(offsets, terms, counts), self.k)
        z = self.coef[0] + self.coef[1] * self.votes(found, cosines)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), found, cosines


def relevance(offsets: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each term by how many standard deviations its examples' labels are off the overall share, 1 at least."""
    n, hits = len(labels), labels.sum()
    if not 0 < hits < n:
        return np.ones(n_terms)
    share = hits / n
    held = np.bincount(terms, minlength=n_terms)
    off = np.bincount(terms, np.repeat(labels, np.diff(offsets)), n_terms) - held * share
    spread = held * share * (1 - share) * np.maximum(1, n - held) / n
    return np.sqrt(np.maximum(1, off * off / np.maximum(spread, 1e-12)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_examples: int = MAX_EXAMPLES, k: int = K) -> tuple[Model, DataFrame]:
    """A model from the labelled rows that are not held out, at most ``max_examples`` of them, and the term vectors of all documents in its space.

    Labels that are null, and ids without a text or with a null id, teach nothing; of several labels
    of one id the mean decides, and each row of that id is an example. Without any example every text
    gets the same score.
    """
    base = id_text(docs, id_col, text_col)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # at most max_examples small rows, so broadcast; the texts stay where they are
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    kind = dict(docs.dtypes)[id_col]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = word_counts(batch.column(2).to_pylist())
            hashes = [hashed(list(c)).view(np.int64).tobytes() for c in found]
            counts = [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "y", "hashes", "counts"])

    # words of at most max_examples texts
    rows = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(words, f"doc_id {kind}, y int, hashes binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["hashes"], r["counts"]))
    hashes = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["hashes"], np.uint64) for r in rows)])
    counts = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r["counts"], np.int32) for r in rows)])
    offsets = np.concatenate([[0], np.cumsum([len(r["counts"]) // 4 for r in rows])]).astype(np.int64)
    ids, y = [r["doc_id"] for r in rows], np.array([r["y"] for r in rows], float)
    del rows
    known, terms = np.unique(hashes, return_inverse=True)
    vocabulary = Vocabulary(known)

    vectors = written(term_vectors(base, vocabulary), "toxic-vectors")
    df = document_frequencies(vectors, len(vocabulary))
    return Model(vocabulary, df, vectors.count(), ids, y, (offsets, terms.astype(np.int32), counts), k), vectors


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many vectors hold each term: summed in each task first, so a task sends a row a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], ["term", "n"])

    df = np.zeros(n_terms)
    if n_terms:  # one row a term
        got = vectors.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df


def term_vectors(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms, counts) of each row: the words that the vocabulary has."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            offsets, terms, counts = vocabulary.vectors(batch.column(1).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "terms", "counts"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, terms array<int>, counts array<int>")


def scored(vectors: DataFrame, model: Model) -> DataFrame:
    """One row per term vector: doc_id, score, predicted, evidence (examples that voted: id, label, cosine; nearest first).

    Defined cases: a null or empty text, and one without any word of an example, gets the score of
    having no neighbour; null and repeated ids pass through; an empty table gives an empty result;
    other columns of the documents are ignored.
    """
    kind = dict(vectors.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = [batch.column(i).flatten().to_numpy() for i in (1, 2)]
            sizes = batch.column(1).value_lengths().to_numpy()
            scores, found, cosines = model.score(np.concatenate([[0], np.cumsum(sizes)]), *flat)
            evidence = [[{"doc_id": model.ids[i], "label": int(model.labels[i]), "cosine": c} for i, c in zip(f, cs, strict=True) if i >= 0] for f, cs in zip(found.tolist(), cosines.tolist(), strict=True)]
            shape = pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, shape)], ["doc_id", "score", "evidence"])

    # vectors have about the size of their texts, so files need not be dealt anew
    rows = vectors.select("doc_id", "terms", "counts").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, label: int, cosine: double>>")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; a map, no shuffle, columns as they are. Null and empty texts have no neighbour and get the score of that."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        kept: list[bool] = []
        for at in range(0, len(texts), 200):  # few texts at once are Python objects
            some = [t or "" for t in texts.slice(at, 200).to_pylist()]
            kept.extend((model.score(*model.vocabulary.vectors(some))[0] < 0.5).tolist())
        return pa.array(kept, pa.bool_())

    return docs.filter(clean(F.col(text_col).cast("string")))
