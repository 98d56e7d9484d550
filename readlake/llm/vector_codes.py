"""Product codes of vectors: integer codebooks by rounds of assignment and averaging, exact partial-distance search.

A vector's components become integers, its dimensions are cut into equal consecutive parts, and each part
is named by the nearest entry of its position's codebook. The nearest entry is found by partial distances:
dimensions are taken in descending variance of the codebook, an entry is dropped from a row's mask once
what it has accumulated strictly exceeds the best complete distance known for the row, and what is left at
the end is complete. All arithmetic is on integers, so results do not depend on how rows are dealt.

The rows are a map over one written table, once a round. Codebooks (entries x dimensions) are all that
the driver holds and all that tasks are sent; a task sends back one sum per entry and dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to a codebook are held at once; dimensions accumulated between two prunings of the masks.
ROWS, STEP = 1024, 2


def limit(dims: int) -> int:
    """Size of a component up to which the squared distance of two vectors fits a long."""
    return min((1 << 31) - 1, math.isqrt(((1 << 63) - 1) // max(1, dims)) // 2)


def dimension_order(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook by descending variance of its entries, ties in order."""
    return np.argsort(-book.astype(np.float64).var(0), kind="stable")


def nearest(rows: np.ndarray, book: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row: the nearest entry of ``book``, ties to the lower one."""
    order = dimension_order(book) if order is None else order
    x, c = np.ascontiguousarray(rows[:, order].T), np.ascontiguousarray(book[:, order].T)
    entry, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), ROWS):
        stop = min(len(rows), at + ROWS)
        entry[at:stop], error[at:stop] = _nearest(x[:, at:stop], c)
    return entry, error


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns of x (dimensions x rows) among columns of c (dimensions x entries), both in search order."""
    dims, first = len(x), min(STEP, len(x))
    done = np.zeros((x.shape[1], c.shape[1]), np.int64)
    for d in range(first):
        gap = x[d][:, None] - c[d][None, :]
        done += gap * gap
    # the entry that leads after the first dimensions gives each row its first complete distance
    lead = done.argmin(1)
    best = ((x - c[:, lead]) ** 2).sum(0)
    row, entry = np.nonzero(done <= best[:, None])
    so_far = done[row, entry]
    for at in range(first, dims, STEP):
        for d in range(at, min(dims, at + STEP)):
            gap = x[d][row] - c[d][entry]
            so_far += gap * gap
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    # rows come in order, and entries in order within a row; a row's lead is never dropped
    starts = np.searchsorted(row, np.arange(x.shape[1]))
    least = np.minimum.reduceat(so_far, starts)
    hit = np.flatnonzero(so_far == least[row])
    where = hit[np.searchsorted(row[hit], np.arange(x.shape[1]))]
    return entry[where], least


def _integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the rows that can be coded, written: x holds 32-bit integers; and their dimensions."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("v"))
    rows = rows.filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))
    first = rows.select(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v")).alias("d")).first()["d"]
    if not first or first % parts:
        first = 0
    top = float(limit(first))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, first)
            x = np.clip(np.floor(flat * scale), -top, top).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "x"])

    kind = dict(rows.dtypes)
    kept = rows.filter(F.size("v") == first) if first else rows.limit(0)
    return written(kept.mapInArrow(whole, f"vec_id {kind['vec_id']}, label {kind['label']}, x binary"), "vector-integers"), first


def _rows_of(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _first_books(table: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, dims / parts): parts of the vectors with the smallest ids; of an id with several vectors the least in bytes."""
    ids = [r[0] for r in table.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        ids = [None]
    some = table.filter(F.col("vec_id") <= ids[-1]) if ids[-1] is not None else table.filter("vec_id is null")
    rows = some.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    flat = np.frombuffer(b"".join(r["x"] for r in rows), "<i4").reshape(len(rows), parts, dims // parts)
    return np.ascontiguousarray(flat.transpose(1, 0, 2)).astype(np.int64)


def _averaged(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the componentwise floor of the mean of its parts; unused ones stay."""
    parts, entries, width = books.shape
    orders = [dimension_order(b) for b in books]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _rows_of(batch, 0, parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                code, _ = nearest(part, books[p], orders[p])
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(part[order], starts, axis=0)
                    count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = table.select("x").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    # one row an entry and component at most; what tasks have summed is added without overflow
    summed = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out = books.copy()
    for r in summed.collect():
        out[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["n"]
    return out


def codebooks(table: DataFrame, dims: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, dims / parts) after ``rounds`` of assignment and averaging."""
    books = _first_books(table, dims, parts, entries)
    for _ in range(rounds):
        books = _averaged(table, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows of integer vectors."""
    parts, _, width = books.shape
    orders = [dimension_order(b) for b in books]
    digits = 2 * max(1, math.ceil(math.log(max(2, books.shape[1]), 256)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch, 2, parts * width)
            error, codes = np.zeros(len(x), np.int64), []
            for p in range(parts):
                code, far = nearest(x[:, p * width : (p + 1) * width], books[p], orders[p])
                codes.append(code.tolist())
                error += far
            text = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*codes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = dict(table.dtypes)
    return table.select("vec_id", "label", "x").mapInArrow(assign, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def vector_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per row that can be coded: vec_id, label, code, error, label_error, codebooks_sha256.

    A component x becomes floor(scale * x). Codebooks start as the parts of the vectors with the
    ``entries`` smallest ids. ``error`` is the squared distance to what the code stands for,
    ``label_error`` its sum over rows of the same label, null labels together.

    Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are
    dropped, and so are those whose length is not that of the smallest id's vector or not a multiple of
    ``parts``; components beyond limit() are clamped to it; rows with a null id are coded but start no
    entry unless all ids are null; repeated rows are coded each, an id with several vectors starts one
    entry; with fewer ids than ``entries`` the codebooks are smaller; an empty table gives an empty
    result; other columns are ignored.
    """
    table, dims = _integers(vectors, id_col, vec_col, label_col, parts, scale)
    kind = dict(table.dtypes)
    if not dims:
        schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    books = codebooks(table, dims, parts=parts, entries=entries, rounds=rounds)
    found = written(coded(table, books), "vector-codes")
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
