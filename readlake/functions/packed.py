"""Bases and qualities as numbers, a batch at a time: k-mers, mixes, mismatches, quality sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code of each byte: A, C, G, T as 0..3, all else 4.
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGT")] = range(4)
#: Bases that are turned into k-mers at once.
PIECE = 1 << 20


def window_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed k-mer at each position, first base highest; -1 where a code is not one of the four."""
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(k):
        out = out << 2 | (codes[i : i + n] & 3)
    odd = np.concatenate([[0], np.cumsum(codes > 3)])
    out[odd[k:] != odd[:-k]] = -1
    return out


def turned_codes(packed: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements; -1 stays."""
    out, rest = np.zeros_like(packed), ~packed
    for _ in range(k):
        out, rest = out << 2 | rest & 3, rest >> 2
    return np.where(packed < 0, -1, out)


def mixed(packed: np.ndarray, k: int) -> np.ndarray:
    """functions.sequence.mix_kmer of packed k-mers."""
    mask, x = np.uint64((1 << 2 * k) - 1), packed.astype(np.uint64)
    shifted = lambda *ns: sum((x << np.uint64(n) for n in ns), np.zeros_like(x)) & mask
    folded = lambda n: x ^ x >> np.uint64(n)
    x = (~x + (x << np.uint64(21))) & mask
    x = folded(24)
    x = shifted(0, 3, 8)
    x = folded(14)
    x = shifted(0, 2, 4)
    x = folded(28)
    return shifted(0, 31).astype(np.int64)


def letters_of(text: Column, alphabet: str = "ACGT") -> Column:
    """The letters of a text that are in ``alphabet`` in either case, in upper case."""
    sign = np.zeros(256, np.uint8)
    for x in alphabet.encode():
        sign[x] = sign[x | 32] = x

    @F.arrow_udf(T.StringType())
    def kept(texts: pa.Array) -> pa.Array:
        held = texts.cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data = sign[np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if len(held) else np.empty(0, np.uint8)
        # bytes of other signs of UTF-8 are above 127, and so are no letters
        before = np.concatenate([[0], np.cumsum(data > 0, dtype=np.int64)])[offsets - offsets[0]] if len(held) else np.zeros(1, np.int64)
        out = pa.Array.from_buffers(pa.large_string(), len(held), [None, pa.py_buffer(before), pa.py_buffer(data[data > 0])])
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())).cast(pa.string())

    return kept(text)


def codes_of(text: str) -> np.ndarray:
    return CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def packed_bases(codes: np.ndarray) -> bytes:
    """Codes 0..3 at two bits a base, the first highest."""
    four = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()


#: The four codes of a byte.
_FOUR = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.uint8)


def unpacked_bases(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` codes of packed_bases()."""
    return _FOUR[np.frombuffer(packed, np.uint8)].ravel()[:n]


def packed_kmers(seqs: DataFrame, k: int, step: int = 1, *, canonical: bool = False, seq_col: str = "seq") -> DataFrame:
    """The other columns with pos (0-based, every ``step``-th) and kmer, packed, of each sequence. K-mers with letters other than ACGT are left out; ``canonical``: the lesser of a k-mer and its reverse complement."""
    if not 0 < k < 32:
        raise ValueError(f"k-mers of {k} bases do not fit a long")
    keep = [c for c in seqs.columns if c != seq_col]
    kinds = dict(seqs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, found, size = [], [], [], 0

            def flushed() -> pa.RecordBatch:
                index = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(len(keep))), pa.array(np.concatenate(at)), pa.array(np.concatenate(found))], [*keep, "pos", "kmer"])  # noqa: B023

            for row, text in enumerate(batch.column(len(keep))):
                codes = codes_of(text.as_py() or "")
                for start in range(0, max(0, len(codes) - k + 1), PIECE):
                    kmer = window_codes(codes[start : start + PIECE + k - 1], k)
                    pos = np.arange(start, start + len(kmer))
                    good = np.flatnonzero((kmer >= 0) & (pos % step == 0))
                    kmer = kmer[good]
                    rows.append(np.full(len(good), row))
                    at.append(pos[good].astype(np.int32))
                    found.append(np.minimum(kmer, turned_codes(kmer, k)) if canonical else kmer)
                    size += len(good)
                    if size >= PIECE:
                        yield flushed()
                        rows, at, found, size = [], [], [], 0
            if size:
                yield flushed()

    return seqs.select(*keep, seq_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int", "kmer long"]))


def distinct_kmers(seq: Column, k: int) -> Column:
    """How many different k-mers of ACGT a sequence has."""

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        found = (window_codes(codes_of(x.as_py() or ""), k) for x in texts)
        return pa.array([len(np.unique(x[x >= 0])) for x in found], pa.int64())

    return counted(seq)


@F.arrow_udf(T.IntegerType())
def mismatch_count(a: pa.Array, b: pa.Array) -> pa.Array:
    """Positions that differ between strings, over the longer one."""

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        u, v = (np.frombuffer(s[:n].encode("latin-1", "replace"), np.uint8) for s in (x, y))
        return int(np.count_nonzero(u != v)) + max(len(x), len(y)) - n

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(T.StructType([T.StructField("total", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))
def _quality(qual: pa.Array) -> pa.Array:
    text = qual.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    size = np.diff(offsets)
    has = np.flatnonzero((size > 0) & ~np.asarray(text.is_null()))
    total, low, high = (np.zeros(len(text), kind) for kind in (np.int64, np.int32, np.int32))
    if len(has):
        signs = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]]
        # values of rows without signs lie between no others, so each segment ends where the next one starts
        total[has] = np.add.reduceat(signs, offsets[has], dtype=np.int64)
        low[has], high[has] = np.minimum.reduceat(signs, offsets[has]), np.maximum.reduceat(signs, offsets[has])
    none = np.ones(len(text), bool)
    none[has] = False
    return pa.StructArray.from_arrays([pa.array(total), pa.array(low, mask=none), pa.array(high, mask=none)], ["total", "low", "high"])


def quality_stats(qual: Column) -> Column:
    """(total, low, high) of the quality bytes, in one pass; 0 and nulls for the empty string."""
    return _quality(F.coalesce(qual, F.lit("")))


#: Which bytes are one of ACGT in any case.
PLAIN = np.zeros(256, bool)
PLAIN[list(b"ACGTacgt")] = True


@F.arrow_udf(T.StructType([T.StructField("best", T.IntegerType()), T.StructField("gaps", T.ArrayType(T.IntegerType()))]))
def degenerate_stats(seq: pa.Array, qual: pa.Array) -> pa.Array:
    """(best, gaps) of functions.sequence.degenerate_max_quality and degenerate_gaps; nulls without a degenerate base. Places beyond the shorter of both do not count."""

    def one(s: str | None, q: str | None) -> tuple[int, list[int]] | None:
        if s is None or q is None:
            return None
        bases, signs = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8)[: min(len(s), len(q))] for x in (s, q))
        odd = ~PLAIN[bases]
        if not odd.any():
            return None
        best = int(signs[odd].max())
        at = np.flatnonzero(odd[signs <= best])
        return best, np.diff(np.concatenate([[-1], at, [np.count_nonzero(signs <= best)]])) - 1

    found = [one(s.as_py(), q.as_py()) for s, q in zip(seq, qual, strict=True)]
    best, gaps = pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([best, gaps], ["best", "gaps"])


def context_counts(reads: DataFrame, n: int = 10) -> DataFrame:
    """context, n: how many bases stand behind each run of up to ``n`` bases (fewer at a read's begin) of column seq; letters other than ACGT are the same as N. Counted a piece at a time in the tasks, then summed."""
    if not 0 < n <= 20:
        raise ValueError(f"a context of {n} bases does not fit a long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held), return_counts=True)], ["code", "n"])

        for batch in batches:
            for text in batch.column(0):
                codes = codes_of(text.as_py() or "").astype(np.int64) + 1
                for start in range(0, len(codes), PIECE):
                    # a base a digit, from 1; places before the read are 0
                    piece = np.concatenate([np.zeros(max(0, n - start), np.int64), codes[max(0, start - n) : start + PIECE]])
                    found = np.zeros(len(piece) - n, np.int64)
                    for i in range(n):
                        found = found << 3 | piece[i : i + len(found)]
                    held.append(found)
                    size += len(found)
                    if size >= PIECE:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    counts = reads.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(F.translate(F.conv(F.col("code").cast("string"), 10, 8), "123450", "ACGTN").alias("context"), "n")


#: Sign of a place whose base is not known yet.
HOLE = "\x01"


@F.arrow_udf(T.StringType())
def over_holes(size: pa.Array, found: pa.Array) -> pa.Array:
    """``size`` holes with the bases of mismatches (pos, code, base) in their places."""
    out = []
    for n, marks in zip(size.to_pylist(), found.to_pylist(), strict=True):
        text = [HOLE] * (n or 0)
        for m in marks or ():
            text[m["pos"]] = m["base"]
        out.append("".join(text))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def fill_holes(text: pa.Array, above: pa.Array, begins: pa.Array) -> pa.Array:
    """Holes of ``text`` filled from ``above``, on which it begins at ``begins``; holes of that stay holes."""
    out = []
    for own, other, start in zip(text.to_pylist(), above.to_pylist(), begins.to_pylist(), strict=True):
        a, b = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (own, other))
        a, holes = a.copy(), np.flatnonzero(a == ord(HOLE))
        a[holes] = b[holes + start]
        out.append(a.tobytes().decode("latin-1"))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def patched(text: pa.Array, found: pa.Array) -> pa.Array:
    """``text`` with the bases of mismatches (pos, code, base) in their places; one without a base drops the place."""
    out = []
    for own, marks in zip(text.to_pylist(), found.to_pylist(), strict=True):
        if own is None or marks is None:
            out.append(None)
            continue
        signs = list(own)
        for m in marks:
            signs.extend([None] * (m["pos"] + 1 - len(signs)))
            signs[m["pos"]] = m["base"]
        out.append("".join(x for x in signs if x is not None))
    return pa.array(out, pa.string())
