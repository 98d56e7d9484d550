"""Repeated passages by hashing of lines, their sentences, and windows of words.

A unit is a line, cut after sentence ends. Digests (128 bits of the lower-cased words, one space
between) are grouped over all documents; the earliest occurrence, by (doc_id, offset), stays. Later
ones are marked, and runs of adjacent marked units with ``min_words`` words or more are removed with
their original offsets; an unmarked unit ends a run, as does one of fewer than ``MIN_UNIT`` words,
which is not hashed. A lone common line of a few words is no passage and
stays, unless ``line_words`` asks for lines. Each document sends a digest once, and grouping is
map-side first, so a line in a third of all documents is no hot task.

Passages of ``PASSAGE`` words or more are found wherever they begin and end: of every WINDOW
consecutive windows of WINDOW words the one with the least hash is an anchor. Equal passages have
equal anchors, at most WINDOW words apart, so windows at anchors that occur twice cover a passage but
for its ends; there, and wherever an anchor that ends such a run of anchors in any document occurs,
all windows are compared.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_text, sweep, written

BREAK = re.compile(r"[.!?]\s+|\n\s*")
MIN_UNIT, MIN_WORDS = 4, 25
#: Words of a passage that is found wherever it begins, and words of a window: a passage holds WINDOW windows and more.
PASSAGE, WINDOW = 50, 25
WORD = re.compile(r"\S+")
#: What goes through shuffles, packed: start and stop in span; first word, number of words and the mark of whole lines in place.
#: ``mark`` is the row's text (62 bits of a hash, so rows that share a doc_id are told apart) and how often its document had the digest before.
FIELDS = ["unit", "span", "place", "high", "low", "mark"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, own) of the rows with an id; ``own`` tells texts apart."""
    base = id_text(docs, id_col, text_col).filter("doc_id is not null")
    return base.withColumn("own", text_key(F.col("text")))


def text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 2)


def _packed(unit: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, words: np.ndarray, high: np.ndarray, low: np.ndarray, line: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
    return [unit, start << 32 | stop, at << 32 | words << 1 | line, high, low, again]


def _unpacked(rows: DataFrame) -> DataFrame:
    low = F.lit((1 << 32) - 1)
    place = F.col("place").bitwiseAND(low)
    return rows.select(
        "doc_id", "unit", F.shiftright("span", 32).alias("start"), F.col("span").bitwiseAND(low).alias("stop"), F.shiftright("place", 32).alias("at"),
        F.shiftright(place, 1).alias("words"), place.bitwiseAND(F.lit(1)).alias("line"), F.shiftrightunsigned("mark", 2).alias("own"), "first_id",
    )


def units(text: str, lines: bool = False) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
    """(unit, start, stop, first word, words, high, low, line) of each unit with MIN_UNIT words or more; offsets count code points, ``stop`` is past the white space after it.

    ``line`` is 1 for a unit that is a whole line. With ``lines``, a line of several units comes too, as unit -1.
    """

    def one(unit: int, start: int, stop: int, at: int, words: list[str], line: int) -> tuple:
        d = xxhash.xxh3_128_digest(" ".join(words).encode())
        return unit, start, stop, at, len(words), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), line

    start = unit = at = 0
    held: list[tuple] = []
    for stop in [*(m.end() for m in BREAK.finditer(text)), len(text)]:
        words = text[start:stop].lower().split()
        if words:
            held.append((unit, start, stop, at, words))
            unit, at = unit + 1, at + len(words)
        if held and (stop == len(text) or "\n" in text[held[-1][1] : stop].lstrip()):
            for u in (u for u in held if len(u[4]) >= MIN_UNIT):
                yield one(*u, int(len(held) == 1))
            if lines and len(held) > 1 and sum(len(u[4]) for u in held) >= MIN_UNIT:
                yield one(-1, held[0][1], held[-1][2], held[0][3], [w for u in held for w in u[4]], 1)
            held = []
        start = stop


def _unit_rows(docs: DataFrame, id_col: str, text_col: str, lines: bool) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found, counts = [], []
                for text in batch.column(1).to_pylist():
                    before = len(found)
                    found.extend(units(text, lines))
                    counts.append(len(found) - before)
                if not found:
                    continue
                table = np.array(found, np.int64)
                rows = np.repeat(np.arange(len(counts)), counts)
                # an occurrence after the first in its own document needs no lookup
                _, first = np.unique(np.column_stack([rows, table[:, 5:7]]), axis=0, return_index=True)
                again = np.ones(len(found), np.int64)
                again[first] = 0
                mark = batch.column(2).to_numpy()[rows] << 2 | again
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, _packed(*table.T, mark))], ["doc_id", *FIELDS])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in FIELDS))


BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@functools.lru_cache(2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0..n-1 of each base and of its inverse modulo 2^64."""
    def of(x: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)

    return [(of(int(b)), of(pow(int(b), -1, 1 << 64))) for b in BASES]


def window_hashes(words: list[str], digests: int = 1) -> np.ndarray:
    """``digests`` 64-bit hashes of each WINDOW consecutive words."""
    n = len(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, n)
    out = []
    for power, inverse in _powers(1 << max(10, n.bit_length()))[:digests]:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
        x = (sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n - WINDOW + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(x ^ (x >> np.uint64(29)))
    return np.array(out)


def anchors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) of the anchors; neighbours with equal keys are one."""
    if len(words) < PASSAGE - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = window_hashes(words)[0]
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(1) + np.arange(len(h) - WINDOW + 1)
    at = least[np.flatnonzero(np.diff(least, prepend=-1))]
    new = np.flatnonzero(np.diff(h[at]) != 0) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    return h[at[first]].astype(np.int64), at[first], at[last]


def _anchor_rows(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [anchors(t.lower().split()) for t in batch.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                ids = [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], ["doc_id", "own", "key", "first", "last"])

    return docs.mapInArrow(run, f"doc_id {kind}, own long, key long, first long, last long")


def _windows(text: str, places: list[dict]) -> np.ndarray:
    """Rows of FIELDS: the windows at shared anchors, and those before and after where such a run of anchors ends."""
    words = text.lower().split()
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty((0, len(FIELDS)), np.int64)
    wanted = np.zeros(n, bool)
    for p in places:
        wanted[max(0, p["first"] - (WINDOW - 1) * p["left"]) : p["last"] + (WINDOW - 1) * p["right"] + 1] = True
    at = np.flatnonzero(wanted)
    high, low = window_hashes(words, 2)[:, at].astype(np.int64)
    low &= (1 << 32) - 1  # 96 bits tell windows apart, and less goes to disk
    starts = np.array([*(m.start() for m in WORD.finditer(text)), len(text)], np.int64)
    _, first, of = np.unique(np.column_stack([high, low]), axis=0, return_index=True, return_inverse=True)
    before = at - at[first][of.ravel()]
    # 1: an occurrence after the first in its own document; 2: one that overlaps the first
    again = np.where(before == 0, 0, np.where(before >= WINDOW, 1, 2))
    return np.column_stack(_packed(np.zeros(len(at), np.int64), starts[at], starts[at + WINDOW], at, np.full(len(at), WINDOW), high, low, np.zeros(len(at), np.int64), again))


def _window_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The window rows, not yet written, and the table that they are read from."""
    kind = dict(docs.dtypes)[id_col]
    base = _texts(docs, id_col, text_col)
    rows = written(_anchor_rows(base, kind), "anchors")
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("last") - F.col("first")).alias("far")).filter(f"n > 1 or far >= {WINDOW}").select("key")
    order = Window.partitionBy("doc_id", "own").orderBy("first")
    far = lambda x: F.coalesce(x > WINDOW, F.lit(True)).cast("int")
    shared = written(rows.join(twice, "key").withColumns({"left": far(F.col("first") - F.lag("last").over(order)), "right": far(F.lead("first").over(order) - F.col("last"))}), "shared-anchors")
    discard(rows)
    ends = shared.groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    places = shared.drop("left", "right").join(ends, "key").groupBy("doc_id", "own").agg(F.collect_set(F.struct("first", "last", "left", "right")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [_windows(t, p) for t, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                table = np.concatenate(found)
                table[:, -1] |= batch.column(1).to_numpy()[rows] << 2
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(table[:, i]) for i in range(len(FIELDS)))], ["doc_id", *FIELDS])

    found = base.join(places, ["doc_id", "own"]).select("doc_id", "own", "text", "places").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in FIELDS))
    return found, shared


def _marked(rows: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """The rows that are not the earliest of their digest, with first_id, the document of that; written. ``spent``: tables that only ``rows`` reads, deleted once those are written."""
    rows = written(rows, name)
    discard(*spent)
    again = F.col("mark").bitwiseAND(F.lit(3))
    once = rows.filter(again == 0)
    # written, so that the joins with it are dealt by themselves and a digest of many rows can be split
    first = written(once.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id <> last_id").select("high", "low", "first_id"), "first-" + name)
    sweep(rows.sparkSession)
    columns = ["doc_id", "unit", "span", "place", "mark"]
    across = once.join(first, ["high", "low"]).filter("doc_id <> first_id").select(*columns, "first_id")
    within = rows.filter(again > 0).join(first, ["high", "low"], "left").filter((again == 1) | (F.col("doc_id") != F.col("first_id"))).select(*columns, F.coalesce("first_id", "doc_id").alias("first_id"))
    marked = written(across.unionByName(within), "marked-" + name)
    discard(rows, first)
    return _unpacked(marked)


def _merged(pieces: DataFrame) -> DataFrame:
    """doc_id, start, stop, at, upto, units, first_id of the unions of pieces that touch or overlap."""
    order = Window.partitionBy("doc_id", "own").orderBy("at", "upto", "start")
    reach = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut_ = pieces.withColumn("_new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return cut_.groupBy("doc_id", "own", "_island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("at").alias("at"), F.max("upto").alias("upto"), F.sum("units").alias("units"), F.min("first_id").alias("first_id"),
    ).drop("_island")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """One row per removed span: doc_id, text_key (tells rows of one doc_id apart), start, stop (code points of the original text), words, units (whole units in it), kept_in (smallest doc_id that keeps a part of it).

    Spans are runs of repeated units with ``min_words`` or more, runs of repeated windows with as many
    (every one of a passage of PASSAGE words or more, of a shorter one those near an anchor in it), and, with ``line_words``, repeated lines of so many words or more.

    Defined cases: null and empty texts have no units; rows with a null doc_id have no rank, so they
    neither lose nor claim a unit; rows that share a doc_id rank alike, so they lose nothing to each
    other, and have spans of their own; rows alike in id and text have the same spans, once; an empty
    table gives an empty result; other columns are ignored.
    """
    marked = _marked(_unit_rows(docs, id_col, text_col, line_words is not None), "units")
    island = F.col("unit") - F.dense_rank().over(Window.partitionBy("doc_id", "own").orderBy("unit"))
    upto = F.col("at") + F.col("words")
    runs = marked.filter("unit >= 0").withColumn("island", island).groupBy("doc_id", "own", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("at").alias("at"), F.max(upto).alias("upto"),
        (F.max("unit") - F.min("unit") + 1).alias("units"), F.min("first_id").alias("first_id"),
    ).drop("island").filter(f"upto - at >= {min_words}")
    columns = ["doc_id", "own", "start", "stop", "at", "upto", "units", "first_id"]
    found, anchored = _window_rows(docs, id_col, text_col)
    windows = _marked(found, "windows", anchored).withColumn("upto", upto).withColumn("units", F.lit(0))
    pieces = runs.select(*columns).unionByName(_merged(windows.select(*columns)).filter(f"upto - at >= {min_words}").select(*columns))
    if line_words is not None:
        lines = marked.filter(f"line = 1 and words >= {line_words}")
        pieces = pieces.unionByName(lines.withColumn("upto", upto).withColumn("units", F.lit(1)).select(*columns))
    return _merged(pieces).select("doc_id", F.col("own").alias("text_key"), "start", "stop", (F.col("upto") - F.col("at")).alias("words"), "units", F.col("first_id").alias("kept_in"))


def cut(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the spans taken out of their texts, each by doc_id and text; ``count_col``, if there is one, counts what is left.

    Defined cases: null texts stay null, rows with a null id and rows without spans stay as they are;
    columns named like those used inside stay as they are.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_cuts"))

    @F.pandas_udf("string")
    def without(texts, cuts):
        def one(text, spans):
            if text is None or spans is None:
                return text
            at, left = 0, []
            for span in spans:
                left.append(text[at : span["start"]])
                at = max(at, span["stop"])
            return "".join([*left, text[at:]])

        return texts.combine(cuts, one)

    # columns by position, so names may be whatever they are
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    own = text_key(F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")))
    joined = plain.join(cuts, (F.col(at[id_col]) == F.col("_cut_id")) & (own == F.col("_cut_key")), "left")
    has = F.col("_cuts").isNotNull()
    text = F.when(has, without(F.col(at[text_col]), F.col("_cuts"))).otherwise(F.col(at[text_col]))
    new = joined.withColumn(at[text_col], text)
    if count_col in at:
        new = new.withColumn(at[count_col], F.when(has, F.char_length(at[text_col]).cast(docs.schema[count_col].dataType)).otherwise(F.col(at[count_col])))
    return new.select(*(F.col(c).alias(n) for n, c in at.items()))
