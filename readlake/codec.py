"""The optional codec tier: columns of a block as compressed streams, one Arrow task per block.

Names are cut into tokens and stored as columns of differences, lengths as runs, both under zstd. Bases
and qualities go together as joint symbols where all bases are one of ACGTN: a base with one of the
eight most frequent neighbouring qualities is one symbol, any other an escape for the base and its
quality in a stream beside it. Else bases are two bits each with exceptions, and qualities a stream of
their own, in the context of the three before. Symbol streams are entropy coded (entropy.py). Tables
are those of the block, so blocks stand for themselves.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import entropy

TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]+")
_TOP, _BOTTOM = 1 << 24, 1 << 16


class FrequencyModel:
    """Adaptive counts of n symbols; halved when their sum would pass the coder's resolution."""

    def __init__(self, n: int, step: int = 24, limit: int = _BOTTOM - 32):
        self.counts, self.total, self.step, self.limit = [1] * n, n, step, limit

    def span(self, symbol: int) -> tuple[int, int]:
        return sum(self.counts[:symbol]), self.counts[symbol]

    def find(self, at: int) -> tuple[int, int, int]:
        low = 0
        for symbol, count in enumerate(self.counts):
            if at < low + count:
                return symbol, low, count
            low += count
        raise ValueError("corrupt stream")

    def update(self, symbol: int) -> None:
        self.counts[symbol] += self.step
        self.total += self.step
        if self.total > self.limit:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)


class RangeEncoder:
    """Carry-less range coder of 32 bits."""

    def __init__(self):
        self.low, self.range, self.out = 0, 0xFFFFFFFF, bytearray()

    def encode(self, low: int, count: int, total: int) -> None:
        self.range //= total
        self.low = (self.low + low * self.range) & 0xFFFFFFFF
        self.range *= count
        self._shift()

    def _shift(self) -> None:
        while True:
            if (self.low ^ (self.low + self.range)) < _TOP:
                pass
            elif self.range < _BOTTOM:
                self.range = -self.low & (_BOTTOM - 1)
            else:
                break
            self.out.append(self.low >> 24 & 0xFF)
            self.low = self.low << 8 & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24 & 0xFF)
            self.low = self.low << 8 & 0xFFFFFFFF
        return bytes(self.out)


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.range, self.code = data, 4, 0, 0xFFFFFFFF, int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def place(self, total: int) -> int:
        self.range //= total
        return min(total - 1, ((self.code - self.low) & 0xFFFFFFFF) // self.range)

    def consume(self, low: int, count: int) -> None:
        self.low = (self.low + low * self.range) & 0xFFFFFFFF
        self.range *= count
        while True:
            if (self.low ^ (self.low + self.range)) < _TOP:
                pass
            elif self.range < _BOTTOM:
                self.range = -self.low & (_BOTTOM - 1)
            else:
                break
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.code = (self.code << 8 | byte) & 0xFFFFFFFF
            self.low = self.low << 8 & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF


def encode_symbols(symbols: list[int], alphabet: int, order: int = 1) -> bytes:
    """Adaptive coding of symbols 0..alphabet-1, each in the context of the ``order`` before it."""
    models: dict[tuple, FrequencyModel] = {}
    coder, context = RangeEncoder(), (0,) * order
    for s in symbols:
        model = models.get(context) or models.setdefault(context, FrequencyModel(alphabet))
        coder.encode(*model.span(s), model.total)
        model.update(s)
        context = (*context[1:], s) if order else ()
    return coder.finish()


def decode_symbols(data: bytes, n: int, alphabet: int, order: int = 1) -> list[int]:
    models: dict[tuple, FrequencyModel] = {}
    coder, context, out = RangeDecoder(data), (0,) * order, []
    for _ in range(n):
        model = models.get(context) or models.setdefault(context, FrequencyModel(alphabet))
        s, low, count = model.find(coder.place(model.total))
        coder.consume(low, count)
        model.update(s)
        out.append(s)
        context = (*context[1:], s) if order else ()
    return out


def encode_integers(values: list[int]) -> bytes:
    """Zigzag and seven bits a byte."""
    out = bytearray()
    for v in values:
        v = v << 1 if v >= 0 else (-v << 1) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def decode_integers(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value >> 1 if not value & 1 else -(value + 1 >> 1))
            value = shift = 0
    return out


def encode_names(names: list[str]) -> bytes:
    """Token columns per run of equal layout: digits as differences, other tokens as text where they differ from the one before."""
    runs, columns, layout = [], [], None
    for name in names:
        parts = TOKEN.findall(name)
        now = [("d" if p.isascii() and p.isdigit() and (p == "0" or p[0] != "0") and len(p) < 19 else "p" + str(len(p)) if p.isascii() and p.isdigit() and len(p) < 19 else "t") for p in parts]
        if now != layout:
            layout = now
            columns = [[] for _ in parts]
            runs.append([now, 0, columns])
        runs[-1][1] += 1
        for column, part, kind in zip(columns, parts, now, strict=True):
            column.append(part if kind == "t" else int(part))
    out = []
    for now, n, cols in runs:
        packed = []
        for kind, column in zip(now, cols, strict=True):
            packed.append([x if i == 0 or x != column[i - 1] else 0 for i, x in enumerate(column)] if kind == "t" else [x - (column[i - 1] if i else 0) for i, x in enumerate(column)])
        out.append([now, n, packed])
    return json.dumps(out, separators=(",", ":")).encode()


def decode_names(data: bytes) -> list[str]:
    names: list[str] = []
    for kinds, n, packed in json.loads(data):
        rows: list[list[str]] = [[] for _ in range(n)]
        for kind, column in zip(kinds, packed, strict=True):
            before: object = 0 if kind != "t" else ""
            for row, x in zip(rows, column, strict=True):
                before = (before if x == 0 else x) if kind == "t" else before + x  # type: ignore[operator]
                row.append(str(before) if kind in ("t", "d") else str(before).zfill(int(kind[1:])))
        names += ["".join(r) for r in rows]
    return names


def encode_lengths(lengths: list[int]) -> bytes:
    """(run, value) pairs of equal neighbours."""
    runs: list[int] = []
    for n in lengths:
        if runs and runs[-1] == n:
            runs[-2] += 1
        else:
            runs += [1, n]
    return encode_integers(runs)


def decode_lengths(data: bytes) -> list[int]:
    runs = decode_integers(data)
    return [n for times, n in zip(runs[::2], runs[1::2], strict=True) for _ in range(times)]


def encode_bases(text: str) -> bytes:
    """Four bases a byte; runs of other signs as (gap, sign, length) beside them."""
    plain = text.translate({ord(b): str(i) for i, b in enumerate("ACGT")})
    odd, at = [], 0
    for m in re.finditer(r"([^0-3])\1*|([0-3])", plain) if re.search(r"[^0-3]", plain) or set(text) - set("ACGT") else ():
        if m[1] or text[m.start()] not in "ACGT":
            odd += [m.start() - at, ord(text[m.start()]), m.end() - m.start()]
            at = m.end()
    codes = "".join(c if t in "ACGT" else "0" for c, t in zip(plain, text, strict=True)) if odd else plain
    packed = int("1" + codes, 4).to_bytes((2 * len(codes) + 8) // 8, "big") if codes else b""
    side = encode_integers(odd)
    return struct.pack("<QI", len(codes), len(side)) + side + packed


def decode_bases(data: bytes) -> str:
    n, size = struct.unpack_from("<QI", data)
    odd, packed = decode_integers(data[12 : 12 + size]), data[12 + size :]
    digits = []
    value = int.from_bytes(packed, "big")
    bits = bin(value)[3:].zfill(2 * n) if n else ""
    digits = ["ACGT"[int(bits[i : i + 2], 2)] for i in range(0, 2 * n, 2)]
    at = 0
    for gap, sign, length in zip(odd[::3], odd[1::3], odd[2::3], strict=True):
        at += gap
        digits[at : at + length] = chr(sign) * length
        at += length
    return "".join(digits)


#: Bytes to base codes of joint symbols; 5 is a letter that they do not have.
_BASES = np.full(256, 5, np.uint8)
_BASES[list(b"ACGTN")] = range(5)
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)
#: Qualities in the window of joint symbols, first escape, symbols in all.
WINDOW, ESCAPE, JOINT = 8, 40, 45
#: Symbols from which on contexts of two symbols pay for their tables.
MANY = 1 << 17


def encode_joint(bases: np.ndarray, quals: np.ndarray) -> bytes:
    """Joint symbols of base codes 0..4 and quality bytes."""
    if not len(bases):
        return b""
    low = int(quals.min())
    counts = np.bincount(quals - low, minlength=WINDOW)
    first = int(np.convolve(counts, np.ones(WINDOW, np.int64), "valid").argmax()) + low
    inside = (quals >= first) & (quals < first + WINDOW)
    symbols = np.where(inside, bases.astype(np.int64) * WINDOW + (quals.astype(np.int64) - first), ESCAPE + bases)
    rest = quals[~inside].astype(np.int64) - low
    order = "joint" if len(bases) >= MANY else "last"
    main = entropy.encode(symbols, JOINT, order)
    side = entropy.encode(rest, int(rest.max()) + 1 if len(rest) else 1, "last")
    return struct.pack("<BBBI", order == "joint", low, first, len(main)) + main + side


def decode_joint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    two, low, first, size = struct.unpack_from("<BBBI", data)
    symbols = entropy.decode(data[7 : 7 + size], "joint" if two else "last")
    escaped = symbols >= ESCAPE
    bases = np.where(escaped, symbols - ESCAPE, symbols // WINDOW).astype(np.uint8)
    quals = (symbols % WINDOW + first).astype(np.uint8)
    quals[escaped] = entropy.decode(data[7 + size :], "last") + low
    return bases, quals


def encode_quals(quals: np.ndarray) -> bytes:
    """Quality bytes by rank among those that occur, in the context of the three before."""
    seen = np.unique(quals)
    context = "quality" if len(quals) >= MANY and len(seen) <= 64 else "last"
    ranks = np.searchsorted(seen, quals)
    return struct.pack("<BH", context == "quality", len(seen)) + seen.tobytes() + (entropy.encode(ranks, len(seen), context) if len(seen) else b"")


def decode_quals(data: bytes) -> np.ndarray:
    three, n = struct.unpack_from("<BH", data)
    seen = np.frombuffer(data, np.uint8, n, 3)
    return seen[entropy.decode(data[3 + n :], "quality" if three else "last")] if n else seen


def encode_block(names: list[str], seqs: list[str], quals: list[str], level: int = 9) -> dict[str, bytes]:
    press = zstandard.ZstdCompressor(level=level).compress
    out = {"name": press(encode_names(names)), "length": press(encode_lengths(list(map(len, seqs))))}
    text, marks = "".join(seqs), np.frombuffer("".join(quals).encode("latin-1"), np.uint8)
    bases = _BASES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    if len(bases) == len(marks) and not (bases == 5).any():
        return {**out, "seq": b"", "qual": b"J" + encode_joint(bases, marks)}
    return {**out, "seq": press(encode_bases(text)), "qual": b"Q" + encode_quals(marks)}


def decode_block(streams: dict[str, bytes]) -> tuple[list[str], list[str], list[str]]:
    open_ = zstandard.ZstdDecompressor().decompress
    names, lengths = decode_names(open_(streams["name"])), decode_lengths(open_(streams["length"]))
    kind, data = bytes(streams["qual"][:1]), bytes(streams["qual"][1:])
    if kind == b"J":
        codes, marks = decode_joint(data)
        text = _LETTERS[codes].tobytes().decode("latin-1")
    else:
        text, marks = decode_bases(open_(streams["seq"])), decode_quals(data)
    quals = marks.tobytes().decode("latin-1")
    ends = np.cumsum(lengths).tolist()
    starts = [0, *ends][:-1]
    return names, [text[a:b] for a, b in zip(starts, ends, strict=True)], [quals[a:b] for a, b in zip(starts, ends, strict=True)]


def encode_reads(reads: DataFrame, block_reads: int = 20_000) -> DataFrame:
    """file_idx, block_idx, part, n, ordinals and one binary per stream. A task cuts what it reads of a block into parts of at most ``block_reads``; no shuffle when the reads come sorted."""
    cols = ["file_idx", "block_idx", "ordinal", "name", "seq", "qual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                stop = at
                while stop < len(rows) and stop - at < block_reads and (rows[stop]["file_idx"], rows[stop]["block_idx"]) == (rows[at]["file_idx"], rows[at]["block_idx"]):
                    stop += 1
                part = rows[at:stop]
                s = encode_block([r["name"] for r in part], [r["seq"] for r in part], [r["qual"] for r in part])
                ordinals = encode_integers([r["ordinal"] - (part[i - 1]["ordinal"] if i else 0) for i, r in enumerate(part)])
                yield pa.RecordBatch.from_pylist([{"file_idx": part[0]["file_idx"], "block_idx": part[0]["block_idx"], "part": part[0]["ordinal"], "n": len(part), "ordinals": ordinals, **s}], schema=_ENCODED)
                at = stop

    return reads.select(*cols).mapInArrow(run, "file_idx int, block_idx int, part long, n long, ordinals binary, name binary, length binary, seq binary, qual binary")


_ENCODED = pa.schema([("file_idx", pa.int32()), ("block_idx", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("ordinals", "name", "length", "seq", "qual"))])


def decode_reads(encoded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names, seqs, quals = decode_block(r)
                ordinals, last = [], 0
                for d in decode_integers(r["ordinals"]):
                    last += d
                    ordinals.append(last)
                n = len(names)
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = [[r["file_idx"]] * n, [r["block_idx"]] * n, ordinals, names, seqs, quals]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_idx", "block_idx", "ordinal", "name", "seq", "qual"])

    return encoded.mapInArrow(run, "file_idx int, block_idx int, ordinal long, name string, seq string, qual string")


#: What extends the engine: a function from reads and reference to alignments, and one from reads to coded blocks and back.
Aligner = Callable[[DataFrame, DataFrame], DataFrame]
Codec = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]
CODECS: dict[str, Codec] = {"joint": (encode_reads, decode_reads)}


def register_codec(name: str, encode: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame]) -> None:
    """A codec of one's own, for write_blocks() and read_blocks() by its name."""
    CODECS[name] = encode, decode


def write_blocks(reads: DataFrame, path: str, *, codec: str = "joint", mode: str = "error") -> None:
    """Coded blocks as Parquet, the codec's name beside them."""
    CODECS[codec][0](reads).write.mode(mode).option("compression", "none").parquet(f"{path}/blocks")
    reads.sparkSession.createDataFrame([(codec,)], "codec string").coalesce(1).write.mode(mode).parquet(f"{path}/codec")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    codec = spark.read.parquet(f"{path}/codec").first()["codec"]
    if codec not in CODECS:
        raise ValueError(f"{path}: codec {codec!r} is not registered")
    return CODECS[codec][1](spark.read.parquet(f"{path}/blocks"))
