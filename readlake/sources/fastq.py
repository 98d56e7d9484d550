"""FASTQ and FASTA: a DataSource for batch and stream reads and for paired writes, and plain writers.

A plain file is cut into byte ranges. A range finds its first record by structure (a line that starts with
"@", two lines on one that starts with "+", sequence and quality of equal length), since a quality line may
start with "@" as well. A gzip file is one range, or one for each stretch of its members where they have
been looked up (``split_gzip``). ordinal is the byte offset of the record in its (unpacked) file: unique and
ordered within a file without any coordination. Records are found a block at a time and leave as Arrow
batches. Paths may be local, or URIs of a store that pyarrow reads.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = {"file_idx": "int", "ordinal": "long", "name": "string", "seq": "string", "comment": "string", "qual": "string"}
SCHEMA = ", ".join(f"{c} {t}" for c, t in FIELDS.items())
SUFFIXES, FASTA_SUFFIXES = (".fq", ".fastq", ".fq.gz", ".fastq.gz", ".gz"), (".fa", ".fasta")
#: Bytes of a range, bytes that are read and turned into a batch at once, bytes before a place where a record that spans it is looked for first.
RANGE_BYTES, BLOCK_BYTES, LOOK_BACK = 64 << 20, 4 << 20, 64 << 10
#: Tests of names that the source makes itself.
NAME_TESTS = {"equals": pc.equal, "starts": pc.starts_with, "ends": pc.ends_with, "contains": pc.match_substring}
#: How a gzip member begins (fixed values of the format).
MEMBER = b"\x1f\x8b\x08"


class FormatError(ValueError):
    """A file that is not the FASTQ it should be."""


class Range(InputPartition):
    """Bytes ``start`` to ``stop`` of an unpacked file. ``at``, ``base``: where in a gzip file its first member lies, and how far into the unpacked file that is. ``ends``: records count by their last byte, not their first."""

    def __init__(self, file_idx: int, path: str, start: int, stop: int | None, at: int = 0, base: int = 0, ends: bool = False):
        self.file_idx, self.path, self.start, self.stop, self.at, self.base, self.ends = file_idx, path, start, stop, at, base, ends


# --- files -------------------------------------------------------------------------------------
def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def size_of(path: str) -> int:
    store, name = located(path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _paths(options: dict) -> list[str]:
    """``path`` or ``paths``: files by comma, a folder of read files, or "@list", a file of paths."""
    spec = options.get("paths") or options.get("path") or ""
    if spec.startswith("@"):
        store, name = located(spec[1:])
        with store.open_input_stream(name) as f:
            return [x.strip() for x in f.read().decode().splitlines() if x.strip()]
    found: list[str] = []
    for p in filter(None, (x.strip() for x in spec.split(","))):
        store, name = located(p)
        if store.get_file_info(name).type == fs.FileType.Directory:
            found += sorted(p.rstrip("/") + "/" + x.base_name for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name.endswith(SUFFIXES))
        else:
            found.append(p)
    return found


def files_of(paths: str | list[str]) -> list[str]:
    """The files of a path, list or folder, in the order of their numbers."""
    return _paths({"paths": paths if isinstance(paths, str) else ",".join(paths)})


# --- records -----------------------------------------------------------------------------------
def _is_record(lines: list[bytes]) -> bool:
    return len(lines) == 4 and lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip(b"\r\n")) == len(lines[3].rstrip(b"\r\n"))


def _first_record(stream, data: bytes, skip: bool) -> tuple[int, bytes]:
    """(bytes before the first record, what has been read): of a stream whose first bytes are ``data``. ``skip``: the first line is what is left of one."""
    at = 0
    if skip:
        while (end := data.find(b"\n")) < 0 and (more := stream.read(BLOCK_BYTES)):
            data += more
        at = end + 1 if end >= 0 else len(data)
    while True:
        ends, place = [at], at
        while len(ends) < 5 and (place := data.find(b"\n", place)) >= 0:
            place += 1
            ends.append(place)
        if len(ends) < 5:
            if more := stream.read(BLOCK_BYTES):
                data += more
                continue
            last = [data[a:b] for a, b in zip(ends, [*ends[1:], len(data)], strict=True)]
            return (at if _is_record(last) else len(data)), data
        if _is_record([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]):
            return at, data
        at = ends[1]


def _text(lines: pa.Array, which: np.ndarray, skip: int, plain: bool) -> pa.Array:
    """The lines of those numbers without their ends and first ``skip`` bytes; bytes are Latin-1."""
    some = lines.take(pa.array(which))
    if not plain:
        return pa.array([x.as_py().rstrip(b"\r\n")[skip:].decode("latin-1") for x in some], pa.string())
    some = pc.ascii_rtrim(some.cast(pa.string()), "\r\n")
    return pc.utf8_slice_codeunits(some, skip) if skip else some


def parsed(stream, base: int, path: str, data: bytes = b"", *, tail: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches (ordinal, name, seq, comment, qual) with the end of each record, from a stream that is at a record; ``base`` is where in the file ``data`` begins. ``tail``: the last record may lack its line end; else it is left out."""
    done = False
    while not done:
        more = stream.read(BLOCK_BYTES)
        done, data = not more, data + more
        if done and tail and data and not data.endswith(b"\n"):
            data += b"\n"
        codes = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(codes == 10) + 1
        if done and tail and len(ends) % 4:
            if data.strip():
                blank = not data[: ends[0]].strip()
                ends_all = len(ends) // 4 * 4
                left = data[ends[ends_all - 1] if ends_all else 0 :]
                if left.strip():
                    raise FormatError(f"{path}: {'empty line' if blank else 'no record'} at byte {base + len(data) - len(left)}")
        n = len(ends) // 4
        if not n:
            continue
        ends = ends[: 4 * n].astype(np.int32)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        cut = int(ends[-1])
        lines = pa.Array.from_buffers(pa.binary(), 4 * n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
        turn = ends >= 2
        size = ends - starts - 1 - (turn & (codes[np.maximum(ends - 2, 0)] == 13) & (ends - starts > 1))
        name, seq, third, qual = (np.arange(k, 4 * n, 4) for k in range(4))
        bad = np.flatnonzero((codes[starts[name]] != 64) | (codes[starts[third]] != 43) | (size[seq] != size[qual]))
        if len(bad):
            at = int(bad[0])
            where = base + int(starts[4 * at])
            if not size[4 * at]:  # an empty line: nothing but those may follow
                rest = data[starts[4 * at] :]
                while not rest.strip() and (more := stream.read(BLOCK_BYTES)):
                    rest = more
                if rest.strip():
                    raise FormatError(f"{path}: empty line at byte {where}")
                n, done, name, seq, third, qual = at, True, name[:at], seq[:at], third[:at], qual[:at]
                if not n:
                    return
            elif codes[starts[4 * at]] != 64 or codes[starts[4 * at + 2]] != 43:
                raise FormatError(f"{path}: no record at byte {where}")
            else:
                raise FormatError(f"{path}: {size[4 * at + 1]} bases and {size[4 * at + 3]} qualities at byte {where}")
        plain = bool((codes[:cut] < 128).all())
        columns = [pa.array(base + starts[name].astype(np.int64)), _text(lines, name, 1, plain), _text(lines, seq, 0, plain), _text(lines, third, 1, plain), _text(lines, qual, 0, plain)]
        yield pa.RecordBatch.from_arrays(columns, ["ordinal", "name", "seq", "comment", "qual"]), base + ends[qual].astype(np.int64)
        base, data = base + cut, data[cut:]


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    """The records that begin after ``start`` and no later than ``stop`` (or at byte 0 of a file); with ``ends``, that end there."""
    store, name = located(part.path)
    with store.open_input_file(name) as raw:
        if part.path.endswith(".gz"):
            raw.seek(part.at)
            stream, base = gzip.GzipFile(fileobj=raw, mode="rb"), part.base
            base, data = _at_record(stream, base) if base else (0, b"")
        else:
            stream, back = raw, LOOK_BACK
            while True:
                base = max(0, part.start - back) if part.ends else part.start
                raw.seek(base)
                base, data = _at_record(stream, base) if base else (0, b"")
                # the record that spans the start must begin before it, or at 0
                if not part.ends or base <= part.start or part.start <= back:
                    break
                back *= 8
        for batch, ends in parsed(stream, base, part.path, data, tail=not part.ends):
            place = ends if part.ends else batch.column(0).to_numpy()
            keep = (place > part.start) | ((place == 0) & (part.start == 0))
            if part.stop is not None:
                keep &= place <= part.stop
            if keep.any():
                yield batch if keep.all() else batch.filter(pa.array(keep))
            if part.stop is not None and len(place) and place[-1] > part.stop:
                return


def _at_record(stream, base: int) -> tuple[int, bytes]:
    """(place of the first record after ``base``, the bytes from there on that have been read)."""
    skipped, data = _first_record(stream, stream.read(1 << 16), True)
    return base + skipped, data[skipped:]


# --- reading -----------------------------------------------------------------------------------
class FastqReader(DataSourceReader):
    """Option ``files``: numbers of the files that are opened at all; ``name``: [kind, value] of a test of names that rows pass before they leave the task.

    Filters come as options and not by pushFilters(): a loaded DataFrame of Spark 4.1.2 keeps what one query
    has pushed for all later ones (measured: a count after a filtered count gave the filtered number).
    """

    def __init__(self, options: dict, columns: list[str]):
        self.files, self.columns = _paths(options), columns
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.members = json.loads(options.get("members") or "{}")
        self.wanted = set(json.loads(options["files"])) if options.get("files") else None
        kind, value = json.loads(options.get("name") or "[null, null]")
        if kind not in (None, *NAME_TESTS):
            raise ValueError(f"no test of names: {kind}")
        self.test, self.value = NAME_TESTS.get(kind), value

    def partitions(self) -> list[Range]:
        out = []
        for i, path in enumerate(self.files):
            if self.wanted is not None and i not in self.wanted:
                continue
            if path.endswith(".gz"):
                out += [Range(i, path, base, stop, at, base) for at, base, stop in self.members.get(path) or [(0, 0, None)]]
            else:
                total = size_of(path)
                out += [Range(i, path, at, min(total, at + self.size)) for at in range(0, total, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in _batches(partition):
            if self.test:
                batch = batch.filter(self.test(batch.column(1), self.value))
            if batch.num_rows:
                yield selected(batch, partition.file_idx, self.columns)


def selected(batch: pa.RecordBatch, file_idx: int, columns: list[str]) -> pa.RecordBatch:
    files = pa.array(np.full(batch.num_rows, file_idx, np.int32))
    return pa.RecordBatch.from_arrays([files if c == "file_idx" else batch.column(c) for c in columns], columns)


class FastqStreamReader(DataSourceStreamReader):
    """Files that grow, and new ones of a folder. The offset is the size of each file; a batch is what lies between two, as byte ranges that executors read.

    A record counts once its last line end is written, in the batch whose range holds that byte, so none
    is lost or comes twice wherever an offset falls. A gzip file counts as a whole when it appears.
    ``bytesPerBatch`` admits so many bytes to a batch, files in order of their names. Files keep the number
    (file_idx) by which they were first seen; numbers are part of the offset. A restarted stream says
    where it stands by planning the empty range at its last offset.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options.items()), columns
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.limit = int(options.get("bytesperbatch", options.get("bytesPerBatch", 1 << 40)))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802 name of the interface
        self.at = {}
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802 name of the interface
        now = {p: size_of(p) for p in _paths(self.options)}
        to, left = dict(self.at or {}), self.limit
        for path in sorted(now):
            number, have = to.get(path, (len(to), 0))
            new = now[path] - have
            if new > 0 and left > 0:
                # a whole gzip file, or as much of a plain one as is admitted
                take = new if path.endswith(".gz") else min(new, left)
                to[path], left = (number, have + take), left - take
        self.at = to
        return {"files": json.dumps(to)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, self.at = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (number, size) in self.at.items():
            have = before.get(path, (number, 0))[1]
            if path.endswith(".gz"):
                out += [Range(number, path, 0, None)] if size > 0 and not have else []
            else:
                out += [Range(number, path, a, min(size, a + self.size), ends=True) for a in range(have, size, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in _batches(partition):
            yield selected(batch, partition.file_idx, self.columns)


# --- writing -----------------------------------------------------------------------------------
class Written(WriterCommitMessage):
    def __init__(self, files: dict[int, str], reads: dict[int, int], sizes: dict[int, int]):
        self.files, self.reads, self.sizes = files, reads, sizes


class MateWriter(DataSourceArrowWriter):
    """Rows (mate, value) to the folders ``first`` and ``second``: tasks write aside, and what they wrote is moved into place once all have ended and both mates have equally many records and the bytes that were counted."""

    def __init__(self, options: dict, overwrite: bool):
        self.folders, self.overwrite, self.run = {1: options["first"], 2: options["second"]}, overwrite, uuid.uuid4().hex

    def _aside(self, mate: int) -> str:
        return posixpath.join(self.folders[mate], "_temporary", self.run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.fastq"
        open_, reads, sizes, files = {}, {1: 0, 2: 0}, {1: 0, 2: 0}, {}
        try:
            for batch in iterator:
                for mate in (1, 2):
                    some = batch.filter(pc.equal(batch.column("mate"), mate)).column("value")
                    if not len(some):
                        continue
                    if mate not in open_:
                        store, folder = located(self._aside(mate))
                        store.create_dir(folder)
                        files[mate] = posixpath.join(self._aside(mate), name)
                        open_[mate] = store.open_output_stream(posixpath.join(folder, name))
                    data = "".join(x + "\n" for x in some.to_pylist()).encode("latin-1")
                    open_[mate].write(data)
                    reads[mate] += len(some)
                    sizes[mate] += len(data)
        finally:
            for f in open_.values():
                f.close()
        return Written(files, reads, sizes)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        reads = {mate: sum(m.reads[mate] for m in done) for mate in (1, 2)}
        if reads[1] != reads[2]:
            raise FormatError(f"{reads[1]} reads of the first mate and {reads[2]} of the second")
        for m in done:
            for mate, path in m.files.items():
                if size_of(path) != m.sizes[mate]:
                    raise FormatError(f"{path} has {size_of(path)} bytes, {m.sizes[mate]} were written")
        for mate, folder in self.folders.items():
            store, name = located(folder)
            store.create_dir(name)
            if self.overwrite:
                for x in store.get_file_info(fs.FileSelector(name)):
                    if x.type == fs.FileType.File:
                        store.delete_file(x.path)
            for m in done:
                if mate in m.files:
                    _, path = located(m.files[mate])
                    # task attempts differ, partitions do not
                    store.move(path, posixpath.join(name, posixpath.basename(path).rpartition("-")[0] + ".fastq"))
            self._clear(mate)

    def abort(self, messages: list[Written | None]) -> None:
        for mate in self.folders:
            self._clear(mate)

    def _clear(self, mate: int) -> None:
        store, folder = located(posixpath.join(self.folders[mate], "_temporary"))
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def _columns(self) -> list[str]:
        return [c for c in (self.options.get("columns") or "").split(",") if c] or list(FIELDS)

    def schema(self) -> str:
        return ", ".join(f"{c} {FIELDS[c]}" for c in self._columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options, schema.fieldNames())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 name of the interface
        return FastqStreamReader(self.options, schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> MateWriter:
        return MateWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def gzip_members(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> dict[str, list[tuple[int, int, int | None]]]:
    """{path: [(first member, unpacked bytes before it, unpacked bytes after its stretch)]}: stretches of members, one for each range of packed bytes that has a member's start.

    Executors look for starts in their ranges; a start is one where a member unpacks. What comes back is
    one row a range, as many as the plan of the scan has anyway. Each member ends with its unpacked
    length (modulo 2**32), so nothing but heads is unpacked.
    """
    cells = [(p, a, min(size, a + range_bytes)) for p in paths for size in [size_of(p)] for a in range(0, size, range_bytes)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *found) for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for found in _member_starts(p, a, b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "first", "before", "inside"])

    if not cells:
        return {}
    ranges = spark.createDataFrame(cells, "path string, a long, b long").repartition(min(len(cells), 10_000))
    found: dict[str, list] = {}
    for r in ranges.mapInArrow(look, "path string, first long, before long, inside long").orderBy("path", "first").collect():
        found.setdefault(r["path"], []).append(r)
    out: dict[str, list[tuple[int, int, int | None]]] = {}
    for path, rows in found.items():
        # unpacked bytes of a stretch: its members' but the last, and the last one's, which lies before the next start
        bases = [0]
        for this, after in zip(rows[:-1], rows[1:], strict=True):
            bases.append(bases[-1] + this["inside"] + after["before"])
        out[path] = [(r["first"], base, stop) for r, base, stop in zip(rows, bases, [*bases[1:], None], strict=True)]
    return out


def _member_starts(path: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """At most one (first member's start in [a, b), unpacked length of the member before it, of the members between it and the last start)."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        head = max(0, a - 4)
        f.seek(head)
        data, starts = f.read(b - head + 64), []
        at = data.find(MEMBER, a - head)
        while 0 <= at < b - head:
            # flags that are defined, and a body that unpacks
            if at + 10 <= len(data) and data[at + 3] < 32 and _unpacks(f, head + at):
                starts.append(at)
            at = data.find(MEMBER, at + 1)
    if starts:
        length = lambda at: int.from_bytes(data[at - 4 : at], "little") if at >= 4 else 0
        yield head + starts[0], length(starts[0]), sum(map(length, starts[1:]))


def _unpacks(f, at: int) -> bool:
    f.seek(at)
    try:
        zlib.decompressobj(31).decompress(f.read(1 << 14))
    except zlib.error:
        return False
    return True


def read_fastq(spark: SparkSession, paths: str | list[str], *, range_bytes: int = RANGE_BYTES, split_gzip: bool = False, columns: list[str] | None = None, files: list[int] | None = None, name: tuple[str, str] | None = None) -> DataFrame:
    """READS of one or many files. ``columns``: only these are built (and block_idx, where ordinal is among them); ``split_gzip``: gzip files of many members are read by stretches of them; ``files``: numbers of the files that are opened; ``name``: (one of NAME_TESTS, text) that names pass in the source."""
    register(spark)
    spec = paths if isinstance(paths, str) else ",".join(paths)
    reader = spark.read.format("fastq").option("paths", spec).option("rangeBytes", str(range_bytes))
    if split_gzip:
        reader = reader.option("members", json.dumps(gzip_members(spark, [p for i, p in enumerate(_paths({"paths": spec})) if p.endswith(".gz") and (files is None or i in files)], range_bytes)))
    if files is not None:
        reader = reader.option("files", json.dumps(sorted(files)))
    if name:
        reader = reader.option("name", json.dumps(list(name)))
    if columns:
        reader = reader.option("columns", ",".join(columns))
    reads = reader.load()
    return reads.withColumn("block_idx", F.floor(F.col("ordinal") / range_bytes).cast("int")) if "ordinal" in reads.columns else reads


def numbered(reads: DataFrame) -> DataFrame:
    """With ``n``, the number of the record in its file: counts of blocks first, then ranks within each block, so no task holds a file."""
    sizes = reads.groupBy("file_idx", "block_idx").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("file_idx").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("file_idx", "block_idx").orderBy("ordinal"))
    return reads.withColumn("_r", rank).join(before, ["file_idx", "block_idx"]).withColumn("n", F.col("before") + F.col("_r") - 1).drop("_r", "before")


def read_pairs(spark: SparkSession, first: str, second: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Mates of two files, joined by record number: pair_id, mate, and the columns of a read. Files of unequal count are an error when read."""
    sides = [numbered(read_fastq(spark, p, range_bytes=range_bytes)).withColumn("mate", F.lit(m)) for m, p in ((1, first), (2, second))]
    both = sides[0].unionByName(sides[1]).withColumnRenamed("n", "pair_id")
    counts = both.groupBy("pair_id").agg(F.count(F.lit(1)).alias("c")).filter("c <> 2")
    if not counts.isEmpty():
        raise FormatError(f"{first} and {second} do not hold the same number of reads")
    return both


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, contig_start (over all contigs, in order), seq; lines of a contig are joined. One file is read as text with its line numbers by offset."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at")).filter("trim(value) <> ''")
    w = Window.partitionBy("file_path").orderBy("at")
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S*)", 1))
    marked = lines.withColumn("contig", F.last(name, ignorenulls=True).over(w)).filter(~F.col("value").startswith(">") & F.col("contig").isNotNull())
    joined = marked.groupBy("file_path", "contig").agg(F.min("at").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("seq"))
    upto = Window.partitionBy("file_path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("contig_start", F.coalesce(F.sum(F.length("seq")).over(upto), F.lit(0)).cast("long")).select("contig", "contig_start", "seq")


def _record(reads: DataFrame, commented: bool = False) -> Column:
    third = F.concat(F.lit("+"), F.coalesce(F.col("comment"), F.lit(""))) if "comment" in reads.columns else F.concat(F.lit("+"), F.col("name")) if commented else F.lit("+")
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), F.col("seq"), third, F.col("qual"))


#: Bases of a reference chunk, and bases that follow it that it carries along, for k-mers across its end; bytes that a header line has at most.
CHUNK, AHEAD, HEADER = 4096, 31, 64 << 10


def _fasta_parts(path: str, a: int, b: int | None) -> Iterator[tuple[bool, bytes]]:
    """(is a header, name or bases) of bytes ``a`` to ``b`` (None: the end) of a FASTA file; a header belongs to the range where its line begins, bases to the one where they lie."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        back = max(0, a - HEADER)
        f.seek(back)
        before = f.read(a - back)
        line = before.rfind(b"\n") + 1
        # in the middle of a header line: its rest is another range's
        inside = a > 0 and before[line : line + 1] == b">"
        at_start, at, waiting = a == 0 or before.endswith(b"\n"), a, b""
        while b is None or at < b or waiting:
            data = f.read(BLOCK_BYTES if b is None or waiting else min(BLOCK_BYTES, b - at))
            if not data:
                break
            at += len(data)
            data, waiting, done = waiting + data, b"", 0
            # a header that runs beyond the range is read to its end, and nothing after it
            while done < len(data) and (b is None or at - len(data) + done < b):
                end = data.find(b"\n", done)
                if inside:
                    done, inside, at_start = (len(data), True, False) if end < 0 else (end + 1, False, True)
                elif at_start and data[done : done + 1] == b">":
                    if end < 0:
                        waiting = data[done:]
                        break
                    yield True, data[done + 1 : end]
                    done = end + 1
                else:
                    # bases up to the next line that is a header; line ends and blanks are no bases
                    head = data.find(b"\n>", done)
                    stop = len(data) if head < 0 else head + 1
                    if bases := data[done:stop].translate(None, b"\r\n\t "):
                        yield False, bases
                    at_start, done = data[stop - 1 : stop] == b"\n", stop
        if waiting:
            yield True, waiting[1:]


def read_fasta_chunks(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, chunk: int = CHUNK, ahead: int = AHEAD) -> DataFrame:
    """contig, contig_start (over all contigs of the file), chunk (its number), piece (``chunk`` bases, fewer at the end of a contig), ahead (bases of the contig that follow, at most ``ahead``).

    Byte ranges are read twice. The first pass leaves one row a range: bases before its first header, its
    last header, bases after that. A scan over these, which are as many as the plan has tasks anyway,
    carries the last header and the bases since then into every range. The second pass writes the
    chunks that begin in a range, reading on to their ends. No contig is ever in one task.
    """
    files = _fasta_files(path)
    cells = [(i, p, a, min(size, a + range_bytes)) for i, p in enumerate(files) for size in [size_of(p)] for a in range(0, size, range_bytes)]
    schema = "contig string, contig_start long, chunk int, piece string, ahead string"
    if not cells:
        return spark.createDataFrame([], schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last, total, since = None, None, 0, 0
                for header, data in _fasta_parts(p, a, b):
                    if header:
                        first, last, since = total if last is None else first, _contig(data), 0
                    else:
                        total, since = total + len(data), since + len(data)
                rows.append((i, a, last, total, since))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "a", "last", "total", "since"])

    ranges = spark.createDataFrame(cells, "file int, path string, a long, b long").repartition(min(len(cells), 10_000))
    carried, now = [], None
    places = {(i, a): (p, b) for i, p, a, b in cells}
    for r in sorted(ranges.mapInArrow(summed, "file int, a long, last string, total long, since long").collect()):
        if now is None or now[0] != r["file"]:
            now = (r["file"], None, 0, 0)  # file, contig, bases of it so far, bases of the file so far
        carried.append((*places[r["file"], r["a"]], r["a"], now[1], now[2], now[3]))
        now = (r["file"], now[1] if r["last"] is None else r["last"], r["total"] + now[2] if r["last"] is None else r["since"], now[3] + r["total"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b, a, contig, have, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _fasta_chunks(p, a, b, contig, have, bases, chunk, ahead)

    again = spark.createDataFrame(carried, "path string, b long, a long, contig string, have long, bases long").repartition(min(len(carried), 10_000))
    return again.mapInArrow(cut, schema)


def _contig(header: bytes) -> str:
    return (header.decode("latin-1").split() or [""])[0]


def _fasta_files(path: str) -> list[str]:
    store, name = located(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    return sorted(path.rstrip("/") + "/" + x.base_name for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name.endswith(FASTA_SUFFIXES))


def _fasta_chunks(path: str, a: int, b: int, contig: str | None, have: int, bases: int, chunk: int, ahead: int) -> Iterator[pa.RecordBatch]:
    """Chunks that begin in the range; ``contig``, ``have``, ``bases``: what the scan has carried into it."""
    rows: list[tuple] = []
    # ``text`` holds bases of the contig from ``at`` on, ``at`` being where the next chunk begins
    at, text, origin = -(-have // chunk) * chunk, b"", bases - have
    skip = at - have

    def flushed(last: bool) -> None:
        nonlocal text, at
        done = 0
        while len(text) - done >= chunk + ahead or last and len(text) > done:
            piece = text[done : done + chunk]
            rows.append((contig, origin, at // chunk, piece.decode("latin-1"), text[done + chunk : done + chunk + ahead].decode("latin-1")))
            done, at = done + len(piece), at + len(piece)
        text = text[done:]

    def table() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["contig", "contig_start", "chunk", "piece", "ahead"])

    for header, data in _fasta_parts(path, a, b):
        if header:
            flushed(True)
            contig, origin, at, text, skip = _contig(data), bases, 0, b"", 0
        else:
            bases += len(data)
            if contig is not None:
                gone = min(skip, len(data))
                skip, text = skip - gone, text + data[gone:]
                flushed(False)
        if len(rows) >= 1000:
            yield table()
            rows = []
    # chunks that began here end beyond the range: their bases, and those that they carry along
    begun = -(-len(text) // chunk) * chunk
    if text:
        for header, data in _fasta_parts(path, b, None):
            if header or len(text) >= begun + ahead:
                break
            text += data
        more, text = text[begun : begun + ahead], text[:begun]
        while text:
            piece, rest = text[:chunk], text[chunk:] + more
            rows.append((contig, origin, at // chunk, piece.decode("latin-1"), rest[:ahead].decode("latin-1")))
            text, at = text[chunk:], at + len(piece)
    if rows:
        yield table()


def write_fastq(reads: DataFrame, path: str, *, by_file: bool = False, commented: bool = False, mode: str = "error") -> None:
    """Text files of four-line records in order; ``by_file`` gives one folder per file_idx."""
    order = [c for c in ("file_idx", "block_idx", "pair_id", "ordinal", "mate") if c in reads.columns]
    text = _record(reads, commented).alias("value")
    if by_file:
        reads.repartitionByRange("file_idx", *order[1:]).sortWithinPartitions(*order).select(text, "file_idx").write.partitionBy("file_idx").mode(mode).text(path)
    else:
        reads.orderBy(*order).select(text).write.mode(mode).text(path)


def write_mates(reads: DataFrame, first: str, second: str, mode: str = "error") -> None:
    """Mates to a folder each, in order. Both are there once all is written and checked: as many records of each, and the bytes that were counted; else neither is."""
    register(reads.sparkSession)
    if mode == "error":
        for path in (first, second):
            store, name = located(path)
            if store.get_file_info(name).type != fs.FileType.NotFound:
                raise FileExistsError(path)
    order = [c for c in ("file_idx", "block_idx", "pair_id", "ordinal", "mate") if c in reads.columns and c not in ("file_idx", "block_idx") or c in reads.columns and "pair_id" not in reads.columns]
    text = reads.orderBy(*order).select("mate", _record(reads).alias("value"))
    text.write.format("fastq").option("first", first).option("second", second).mode("overwrite" if mode == "overwrite" else "append").save()


def lines(reads: DataFrame) -> Iterator[str]:
    """Records in order, one partition at a time on the driver (the pipe)."""
    order = [c for c in ("file_idx", "block_idx", "pair_id", "ordinal", "mate") if c in reads.columns]
    text = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), F.col("seq"), F.concat(F.lit("+"), F.coalesce(F.col("comment"), F.lit(""))) if "comment" in reads.columns else F.lit("+"), F.col("qual"))
    for row in reads.orderBy(*order).select(text.alias("t")).toLocalIterator():
        yield row["t"]
