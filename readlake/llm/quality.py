"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(w.x - t_j): one weight vector over hashed text features is shared by all grades,
thresholds t_0 < t_1 < ... tell them apart. Fitted on the driver from a bounded sample of labelled rows
(``max_examples``, by hash order); scoring is a map over the scan. Expected grade and the probability
of reaching a grade follow from the same model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

BITS, MAX_EXAMPLES, STEPS, RIDGE = 16, 12_000, 300, 1e-5
#: Words remembered, and letters of a word that is one feature; longer ones are cut into pieces.
MEMO_WORDS, PIECE = 300_000, 64
_SQUEEZE = re.compile(r"(.)\1+", re.S)


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode()) & ((1 << BITS) - 1)


class Slots(dict):
    """word to the slots of its lower-case form and of its shape (letters by case, digits, other signs; runs once)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[word] = _slot("w" + word.lower()), _slot("s" + _SQUEEZE.sub(r"\1", shape))
        return out


_slots = Slots()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): square roots of the shares of words and of shapes; one-hot tenths of repeats and distinct words; length."""
    words = text.split()
    if len(text) > PIECE and any(len(w) > PIECE for w in words):  # long ones count piece by piece
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    n = max(1, len(words))
    counts = Counter(words)
    shapes: Counter = Counter()
    forms: Counter = Counter()
    for word, times in counts.items():
        form, shape = _slots[word]
        forms[form] += times
        shapes[shape] += times
    again = sum(map(str.__eq__, words[1:], words[:-1]))
    hot = [_slot(f"r{10 * again // n}"), _slot(f"d{10 * len(counts) // n}"), _slot(f"n{n.bit_length()}"), _slot("1")]
    slots = np.array([*forms, *shapes, *hot], np.int64)
    values = np.concatenate([np.sqrt(np.array([*forms.values(), *shapes.values()], float) / n), np.ones(len(hot))])
    return slots, values


class Model:
    """Weights and increasing thresholds; grades are 0..len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        slots, values = features(text)
        return 1 / (1 + np.exp(-np.clip(self.weights[slots] @ values - self.thresholds, -500, 500)))


def fit_cumulative(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Greatest penalised likelihood by Adam steps over all rows; thresholds stay ordered as a start plus positive gaps."""
    slots = np.concatenate([s for s, _ in rows]) if rows else np.empty(0, np.int64)
    values = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    share = np.array([(np.sum(grades >= j) + 0.5) / (len(grades) + 1) for j in range(1, top + 1)])
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(1 << BITS), start[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(len(rows))
    for step in range(1, steps + 1 if len(rows) else 1):
        w, t = theta[: 1 << BITS], np.concatenate([theta[1 << BITS :][:1], theta[1 << BITS :][:1] + np.cumsum(np.exp(theta[(1 << BITS) + 1 :]))])
        z = np.bincount(owner, w[slots] * values, len(rows))
        # above[j] = P(grade >= j), with 1 before and 0 after
        above = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))), np.zeros((len(rows), 1))], 1)
        slope = above * (1 - above)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        dz = (slope[at, grades] - slope[at, grades + 1]) / p
        dt = np.zeros((len(rows), top + 2))
        np.add.at(dt, (at, grades), -slope[at, grades] / p)
        np.add.at(dt, (at, grades + 1), slope[at, grades + 1] / p)
        dt = dt[:, 1:-1].mean(0)
        later = dt[::-1].cumsum()[::-1]
        grad = np.concatenate([np.bincount(slots, dz[owner] * values, 1 << BITS) / len(rows) - ridge * w, later[:1], later[1:] * np.exp(theta[(1 << BITS) + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = np.concatenate([theta[1 << BITS :][:1], theta[1 << BITS :][:1] + np.cumsum(np.exp(theta[(1 << BITS) + 1 :]))])
    return Model(theta[: 1 << BITS], t)


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of a labelled row: 0 poor, 1 sound but toxic, 2 sound. Null where a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, *, grade_col: str = "grade", top: int = 2, id_col: str = "doc_id", text_col: str = "text", max_examples: int = MAX_EXAMPLES) -> Model:
    """A model from at most ``max_examples`` rated rows. Null grades, ids and grades outside 0..top teach nothing; of several ratings of one id the mean, rounded, counts."""
    rated = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("double").alias("y")).filter(f"doc_id is not null and y between 0 and {top}")
    rated = rated.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    chosen = rated.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(max_examples)
    kind = dict(docs.dtypes)[id_col]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype(np.int32).tobytes() for s, _ in got]), pa.array([v.astype(np.float32).tobytes() for _, v in got])], ["doc_id", "y", "slots", "values"])

    # at most max_examples small rows, so broadcast and collected
    sample = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    rows = sorted(sample.mapInArrow(vectors, f"doc_id {kind}, y int, slots binary, values binary").collect(), key=lambda r: (r["doc_id"], r["slots"]))
    pairs = [(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float)) for r in rows]
    return fit_cumulative(pairs, np.array([r["y"] for r in rows], np.int64), top)


def graded(docs: DataFrame, model: Model, *, tail: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability (of ``tail`` or better), kept (that is 0.5 or more).

    Defined cases: null text counts as empty and gets the score of a text without words; a text without
    white space counts piece by piece; null and repeated ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = np.array([model.tails(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, tail - 1])], ["doc_id", "expected_grade", "tail_probability"])

    rows = id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return rows.withColumn("kept", F.col("tail_probability") >= 0.5)
