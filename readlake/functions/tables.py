"""Table functions for SQL: k-mers and minimizers of a table of reads (read_id, seq).

    SELECT * FROM read_kmers(TABLE(reads), 14)
    SELECT * FROM read_minimizers(TABLE(SELECT read_id, seq FROM reads) PARTITION BY (read_id), 13)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .packed import PIECE, codes_of, window_codes


def _k(k: pa.Array, default: int) -> int:
    return k[0].as_py() if len(k) and k[0].as_py() else default


def _rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """``found`` of each read under its id."""
    index = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    columns = [pa.array(np.concatenate(c) if len(c) else np.empty(0, np.int64)).cast(t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
    return pa.table([batch.column("read_id").cast(pa.int64()).take(pa.array(index)), *columns], ["read_id", *names])


@F.arrow_udtf(returnType="read_id bigint, pos int, kmer bigint")
class ReadKmers:
    """read_id, pos, kmer (packed) at every place of each read; those with letters other than ACGT are left out, as are null sequences."""

    def eval(self, batch: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        size, ids = _k(k, 14), batch.column("read_id").cast(pa.int64())
        rows, places, found, held = [], [], [], 0

        def flushed() -> pa.Table:
            index, at, kmers = (np.concatenate(c) for c in (rows, places, found))
            return pa.table([ids.take(pa.array(index)), pa.array(at.astype(np.int32)), pa.array(kmers)], ["read_id", "pos", "kmer"])

        for row, seq in enumerate(batch.column("seq")):
            codes = codes_of(seq.as_py() or "")
            for start in range(0, max(0, len(codes) - size + 1), PIECE):
                kmers = window_codes(codes[start : start + PIECE + size - 1], size)
                at = np.flatnonzero(kmers >= 0)
                rows.append(np.full(len(at), row))
                places.append(at + start)
                found.append(kmers[at])
                held += len(at)
                # reads have many times their bytes in k-mers, so a batch is handed on in pieces
                if held >= PIECE:
                    yield flushed()
                    rows, places, found, held = [], [], [], 0
        if held:
            yield flushed()


@F.arrow_udtf(returnType="read_id bigint, key bigint, pos int, strand int")
class ReadMinimizers:
    """read_id, key, pos, strand as operators.overlap.minimizers() gives them."""

    def eval(self, batch: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        from readlake.operators.overlap import read_minimizers

        found = [read_minimizers(seq or "", _k(k, 13)) for seq in batch.column("seq").to_pylist()]
        if found:
            yield _rows(batch, found, ["key", "pos", "strand"], [pa.int64(), pa.int32(), pa.int32()])


def register(spark: SparkSession) -> None:
    """read_kmers and read_minimizers for SQL of this session."""
    spark.udtf.register("read_kmers", ReadKmers)
    spark.udtf.register("read_minimizers", ReadMinimizers)
