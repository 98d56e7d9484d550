"""Structured Streaming over read files: source, ordered batches out, names with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names as N
from ..operators.encode import format_runs
from ..sources.fastq import RANGE_BYTES, lines, register


def stream_fastq(spark: SparkSession, path: str, *, bytes_per_batch: int = 1 << 30, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of reads from files that may grow; a micro-batch is read as byte ranges by executors, its bytes are the backpressure."""
    register(spark)
    return spark.readStream.format("fastq").option("paths", path).option("bytesPerBatch", str(bytes_per_batch)).option("rangeBytes", str(range_bytes)).load()


def pipe_out(reads: DataFrame, emit: Callable[[str], None], checkpoint: str, *, mate: int | None = None) -> StreamingQuery:
    """Batches in order, records in order within each, as four lines to ``emit``. ``mate`` 1 or 2 gives that side only."""
    def batch(df: DataFrame, _: int) -> None:
        for record in lines(df if mate is None else df.filter(F.col("mate") == mate)):
            emit(record)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def name_deltas(reads: DataFrame) -> DataFrame:
    """file_idx, ordinal, value, delta: first number of each name against the read before it in its file, over batches. One counter is the state of a file."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ordinal")
        before = state.get[0] if state.exists else 0
        value = rows["name"].str.extract(r"(\d+)")[0].fillna("0").astype("int64")
        delta = value.diff()
        delta.iloc[0] = value.iloc[0] - before
        state.update((int(value.iloc[-1]),))
        yield pd.DataFrame({"file_idx": rows["file_idx"], "ordinal": rows["ordinal"], "value": value, "delta": delta.astype("int64")})

    return reads.groupBy("file_idx").applyInPandasWithState(step, "file_idx int, ordinal long, value long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


#: What spark.sql.streaming.stateStore.providerClass has to be for streams of name_states().
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _name_parts(reads: DataFrame) -> DataFrame:
    """file_idx, ordinal, format, parts (tokens) and value, the first number of the name; null where there is none or one that no long can hold."""
    name = F.coalesce("name", F.lit(""))
    return reads.select("file_idx", "ordinal", N.name_format(name).alias("format"), N.tokens(name).alias("parts"), F.regexp_extract(name, "[0-9]+", 0).try_cast("long").alias("value"))


def name_columns(reads: DataFrame) -> DataFrame:
    """How each name follows from those before it in its file: file_idx, ordinal, format, format_run, same, value, delta.

    format_run: number of the run of equal formats, from 0; same: for each token 1 where it is that of the
    first name of the format, else 0; delta: value less that of the last name of the format, or less 0.
    Null names count as empty.
    """
    own = Window.partitionBy("file_idx", "format").orderBy("ordinal")
    rows = format_runs(_name_parts(reads), F.col("format"), "ordinal", "file_idx")
    delta = F.col("value") - F.coalesce(F.lag("value").over(own), F.lit(0))
    return rows.select("file_idx", "ordinal", "format", "format_run", N.same_as_leader(F.col("parts"), own).alias("same"), "value", delta.alias("delta"))


class _NameState(StatefulProcessor):
    """Of a file: first name and last number of each format, and the run it is in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._formats = handle.getMapState("formats", "format string", "leader array<string>, last long")
        self._run = handle.getValueState("run", "format string, run long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken = pd.concat(list(rows)).sort_values("ordinal")
        before, run = self._run.get() if self._run.exists() else (None, -1)
        seen: dict[str, tuple[list[str], int | None]] = {}
        out = []
        for ordinal, fmt, parts, value in zip(taken["ordinal"], taken["format"], taken["parts"], taken["value"].astype("Int64"), strict=True):
            parts, value = list(parts), None if pd.isna(value) else int(value)
            if fmt not in seen:
                stored = self._formats.getValue((fmt,)) if self._formats.containsKey((fmt,)) else (parts, None)
                seen[fmt] = (list(stored[0]), stored[1])
            leader, last = seen[fmt]
            before, run = fmt, run + (fmt != before)
            out.append((key[0], ordinal, fmt, run, [int(a == b) for a, b in zip(parts, leader, strict=True)], value, None if value is None else value - (last or 0)))
            seen[fmt] = (leader, value)
        for fmt, (leader, last) in seen.items():
            self._formats.updateValue((fmt,), (leader, last))
        self._run.update((before, run))
        frame = pd.DataFrame(out, columns=["file_idx", "ordinal", "format", "format_run", "same", "value", "delta"])
        yield frame.astype({"value": "Int64", "delta": "Int64"})

    def close(self) -> None:
        pass


def name_states(reads: DataFrame) -> DataFrame:
    """name_columns() of a stream: what must be known of the reads before is kept as state by file.

    Batches come in the order of a file's records, as stream_fastq() gives them; one batch of a file is sorted by
    one task, so ``bytes_per_batch`` bounds it. STATE_STORE has to be the session's state store.
    """
    out = "file_idx int, ordinal long, format string, format_run long, same array<int>, value long, delta long"
    return _name_parts(reads).groupBy("file_idx").transformWithStateInPandas(_NameState(), out, outputMode="Append", timeMode="None")
