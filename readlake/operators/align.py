"""Gapless alignment of reads by their rarest seeds, stage by stage in one pass."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut
from ..functions.packed import CODE, mismatch_count, packed_bases, unpacked_bases, window_codes
from ..functions.sequence import degenerate_letters, mismatches, reverse_complement
from .index import CHUNK, K, TOO_MANY, query_seeds, seed_counts, seeds

#: Caps of the seed search (fixed values): occurrences of a seed, of a seed of a short part.
SEED_CAP, PART_CAP = 100_000, 620
#: Bases of reference and of reads that meet in a cell, of a stretch of a contig that stays together, and the least that are worth a task.
BUCKET, SLICE, STRETCH, LEAST = 1 << 25, 1 << 26, 1 << 20, 1 << 20
#: k-mers of reads up to which the reference is scanned for them alone, bases that are turned into k-mers at once, words of 32 bases that are compared at once, at most, and places.
LOOKED, PIECE, STEP, PLACES = 1 << 20, 1 << 22, 64, 1 << 16
TURN = bytes.maketrans(b"ACGT", b"TGCA")
#: Lists of best places that are kept before they are put together, and k-mers up to which each has a bit.
HELD, KNOWN = 256, 1 << 28
#: Mismatches allowed in a hundred bases.
LIMIT_PERCENT = 8


def chunks(ref: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig, chunk, piece: a candidate meets the pieces that it lies on, and not a whole contig. A reference that comes in chunks stays as it is."""
    if "piece" in ref.columns:
        return ref.select("contig", "chunk", "piece")
    n = F.length("seq")
    at = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("int"))
    return ref.select("contig", F.posexplode(F.transform(at, lambda i: F.substring(F.col("seq"), i * size + 1, F.lit(size)))).alias("chunk", "piece"))


def lengths(ref: DataFrame) -> DataFrame:
    """contig, ref_len."""
    if "piece" in ref.columns:
        return ref.groupBy("contig").agg(F.max(F.col("chunk").cast("long") * CHUNK + F.length("piece")).alias("ref_len"))
    return ref.select("contig", F.length("seq").alias("ref_len"))


def _on_chunks(places: DataFrame, ref: DataFrame, size: int = CHUNK) -> DataFrame:
    """``places`` (contig, pos, len) once for each piece that they lie on, with chunk, at (first base of the place on it) and window, the reference there."""
    spread = places.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("pos") / size).cast("int"), F.floor((F.col("pos") + F.greatest(F.col("len"), F.lit(1)) - 1) / size).cast("int"))))
    met = spread.join(chunks(ref, size), ["contig", "chunk"])
    first = F.col("chunk").cast("long") * size
    met = met.withColumn("at", F.greatest(F.lit(0), first - F.col("pos")).cast("int"))
    return met.withColumn("window", F.expr(f"substr(piece, cast(greatest(0, pos - chunk * {size}L) as int) + 1, len - at)")).drop("piece")


def _parts(read_len: Column) -> Column:
    return F.when(read_len < 45, 2).when(read_len <= 75, 3).otherwise(4)


def _slots(k: int) -> Column:
    """(stage, slot, rank) of a seed of columns rev, len, off, phase and n: in each slot of a stage the least rank is looked up, ties to the earliest."""
    n, off, parts = F.col("len"), F.col("off"), _parts(F.col("len"))
    div = lambda a, b: F.floor(a / b)
    slot = lambda stage, at, rank: F.struct(stage.cast("int").alias("stage"), at.cast("int").alias("slot"), rank.cast("long").alias("rank"))
    part = F.least(div(off * parts, n), parts - 1)
    # the sweep: seeds that lie across the end of a part, of either parity the first that is rare enough
    begun = F.least(div(off * parts + parts - 1, n), parts - 1)
    low = F.greatest(F.lit(0), div(n, parts) - k) + div(begun * n, parts)
    high = F.least(n - k, div((begun + 1) * n, parts) - 8)
    few = F.col("n") < PART_CAP
    every = F.array(
        slot(F.col("rev") * 2 + F.col("phase"), F.col("phase"), F.col("n")),
        F.when(few, slot(F.col("rev") * 2 + 4, part, F.col("n"))),
        F.when(few & off.between(low, high), slot(F.col("rev") * 2 + 5, begun * 2 + (off - low) % 2, F.lit(0))),
    )
    return F.filter(every, lambda x: x.isNotNull())


def candidates(reads: DataFrame, ref: DataFrame, k: int = K, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """read_id, stage, rev, contig, pos (0-based): where the rarest seeds put each read.

    Stages, first to win: 0, 1 seeds at even, odd offsets; 2, 3 the same of the reverse complement;
    4 the rarest seed of each part of the read, 5 the sweep: the first seeds that are rare enough across
    the parts' ends; 6, 7 the same of the reverse complement. Reads with more degenerate bases than their
    limit have none. ``index``: seeds and counts of the reference, if there are stored ones.
    """
    n = F.length("seq")
    fit = reads.filter(F.length(degenerate_letters(F.col("seq"))) <= F.floor(n * LIMIT_PERCENT / 100))
    turned = F.array(F.struct(F.lit(0).alias("rev"), F.col("seq")), F.struct(F.lit(1).alias("rev"), reverse_complement(F.col("seq")).alias("seq")))
    both = fit.select("read_id", F.inline(turned))
    seeds_, counts = index or (seeds(ref, k), None)
    counts = seed_counts(seeds_) if counts is None else counts
    keyed = both.select(F.struct("read_id", "rev", F.length("seq").alias("len")).alias("read_id"), "seq")
    queries = query_seeds(keyed, k).select("read_id.read_id", "read_id.rev", "read_id.len", "off", "phase", "kmer")
    met = queries.join(counts.filter(F.col("n") < SEED_CAP), "kmer").select("read_id", "rev", "len", "off", "kmer", F.inline(_slots(k)))
    # one aggregation for all stages, map-side first: no window over a read's seeds
    chosen = met.groupBy("read_id", "rev", "len", "stage", "slot").agg(F.min(F.struct("rank", "off", "kmer")).alias("b"))
    chosen = chosen.select("read_id", "rev", "len", "stage", F.col("b.off").alias("off"), F.col("b.kmer").alias("kmer"))
    placed = chosen.join(seeds_, "kmer").withColumn("pos", F.col("pos") - F.col("off")).filter("pos >= 0").join(lengths(ref), "contig").filter("pos + len <= ref_len")
    return placed.select("read_id", "stage", "rev", "len", "contig", "pos").distinct()


def _by_index(reads: DataFrame, ref: DataFrame, k: int, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What _by_cells() gives, from stored seeds: every candidate is met with the pieces that it lies on."""
    turned = F.when(F.col("rev") == 1, reverse_complement(F.col("read"))).otherwise(F.col("read"))
    near = _on_chunks(candidates(reads, ref, k, index), ref).join(reads.select("read_id", F.col("seq").alias("read")), "read_id")
    near = near.withColumn("part", F.substring(turned, F.col("at") + 1, F.length("window")))
    place = ["read_id", "stage", "rev", "contig", "pos", "len"]
    scored = near.select(*place, mismatch_count("window", "part").alias("mis")).groupBy(*place).agg(F.sum("mis").cast("int").alias("mis"))
    return scored.filter(F.col("mis") <= F.floor(F.col("len") * LIMIT_PERCENT / 100))


def _raw(packed: bytes, n: int, plain: bool) -> np.ndarray:
    """The letters of _squeezed()."""
    return np.frombuffer(b"ACGT", np.uint8)[unpacked_bases(packed, n)] if plain else np.frombuffer(packed, np.uint8)


def _squeezed(raw: bytes) -> tuple[bytes, int, bool]:
    """(bytes, letters, plain): two bits a base if all are ACGT, else as they are."""
    codes = CODE[np.frombuffer(raw, np.uint8)]
    plain = not (codes > 3).any()
    return packed_bases(codes) if plain else raw, len(raw), plain


def _latin(text: str | None) -> bytes:
    return (text or "").encode("latin-1", "replace")


def _pieces(ref: DataFrame, k: int) -> DataFrame:
    """contig, chunk, seq, n, plain, ahead: chunks of the reference, squeezed, and the k - 1 letters that follow each."""
    if "piece" in ref.columns:
        cuts = ref.select("contig", "chunk", "piece", F.substring("ahead", 1, k - 1).alias("ahead"))
    else:
        last = F.greatest(F.floor((F.length("seq") - 1) / CHUNK), F.lit(0)).cast("int")
        both = lambda i: F.struct(F.substring(F.col("seq"), i * CHUNK + 1, F.lit(CHUNK)).alias("piece"), F.substring(F.col("seq"), (i + 1) * CHUNK + 1, F.lit(k - 1)).alias("ahead"))
        cuts = ref.select("contig", F.posexplode(F.transform(F.sequence(F.lit(0), last), both)).alias("chunk", "x")).select("contig", "chunk", "x.piece", "x.ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, n, plain = zip(*(_squeezed(_latin(x.as_py())) for x in batch.column(2)), strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seq, pa.binary()), pa.array(n, pa.int32()), pa.array(plain, pa.bool_()), batch.column(3)], ["contig", "chunk", "seq", "n", "plain", "ahead"])

    return cuts.mapInArrow(run, f"contig {dict(ref.dtypes)['contig']}, chunk int, seq binary, n int, plain boolean, ahead string")


class _Ranks:
    """Sorted k-mers, found by a bit for each that there is and the number of those before its word; by a search if k is too large for that."""

    def __init__(self, wanted: np.ndarray, k: int) -> None:
        self.wanted, self.bits = wanted, None
        if 4**k <= KNOWN:
            self.bits = np.zeros(-(-(4**k) // 64), np.uint64)
            if len(wanted):
                first = np.flatnonzero(np.diff(wanted >> 6, prepend=-1))
                self.bits[wanted[first] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (wanted & 63).astype(np.uint64), first)
            n = np.bitwise_count(self.bits)
            self.before = np.cumsum(n, dtype=np.int32) - n

    def among(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which): the ``kmers`` that are among the sorted ones."""
        at = np.flatnonzero(kmers >= 0)
        kmers = kmers[at]
        if self.bits is None:
            which = np.searchsorted(self.wanted, kmers)
            good = self.wanted[np.minimum(which, len(self.wanted) - 1)] == kmers if len(self.wanted) else np.zeros(len(at), bool)
            return at[good], which[good]
        word, bit = kmers >> 6, (kmers & 63).astype(np.uint64)
        held = self.bits[word]
        good = np.flatnonzero(held >> bit & np.uint64(1))
        below = held[good] & (np.uint64(1) << bit[good]) - np.uint64(1)
        return at[good], self.before[word[good]] + np.bitwise_count(below).astype(np.int64)


def _counted(pieces: DataFrame, k: int, wanted: np.ndarray | None) -> DataFrame:
    """kmer, n: how often the reference holds each k-mer at even places, of ``wanted`` alone if there are any; counted a piece at a time in the tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            kmers = _even_kmers(np.concatenate(held), k)
            kmers = kmers[kmers >= 0] if ranks is None else kmers[ranks.among(kmers)[0]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(kmers, return_counts=True)], ["kmer", "n"])

        ranks = None if wanted is None else _Ranks(wanted, k)
        held, size = [], 0
        for batch in batches:
            for seq, n, plain, ahead in zip(*(batch.column(i) for i in range(4)), strict=True):
                codes = unpacked_bases(seq.as_py(), n.as_py()) if plain.as_py() else CODE[np.frombuffer(seq.as_py(), np.uint8)]
                more = CODE[np.frombuffer(_latin(ahead.as_py()), np.uint8)]
                # apart by other letters, each from an even place on
                held += [codes, more, np.full(2 - (len(codes) + len(more)) % 2, 4, np.uint8)]
                size += len(codes) + len(more)
                if size >= PIECE:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return pieces.select("seq", "n", "plain", "ahead").mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def _both(raw: bytes) -> tuple[bytes, bytes]:
    return raw, raw.translate(TURN)[::-1]


def _kmers_of(k: int, known: Broadcast | None):
    def run(table: pa.Table) -> pa.Table:
        """The different k-mers of a slice of reads, of either strand, that are among the ``known``."""
        found, held, size = [], [], 0

        def kept() -> np.ndarray:
            kmers = window_codes(np.concatenate(held), k)
            kmers = kmers[kmers >= 0]
            if known is not None:
                kmers = kmers[known.value[kmers >> 6] >> (kmers & 63).astype(np.uint64) & np.uint64(1) > 0]
            return _different(kmers)

        for text in table.column("seq"):
            for x in _both(_latin(text.as_py())):
                held += [CODE[np.frombuffer(x, np.uint8)], np.full(1, 4, np.uint8)]
                size += len(x)
            if size >= PIECE:
                found.append(kept())
                held, size = [], 0
        if held:
            found.append(kept())
        kmers = _different(np.concatenate(found))
        return pa.table({"slice": pa.array(np.full(len(kmers), table.column("slice")[0].as_py(), np.int32)), "kmer": pa.array(kmers)})

    return run


def _different(kmers: np.ndarray) -> np.ndarray:
    """np.unique(), by a sort."""
    kmers = np.sort(kmers)
    return kmers[np.flatnonzero(np.diff(kmers, prepend=-1))]


def _looked_up(n: int, k: int, sides: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """(rev, off) -> stage: the seeds of a read of ``n`` bases that _slots() chooses, with the first stage of each; ``sides``: counts of the k-mers of either strand."""
    out: dict[tuple[int, int], int] = {}
    parts = 2 if n < 45 else 3 if n <= 75 else 4
    for rev, counts in enumerate(sides):
        if not counts.any():
            continue
        rare = np.where(counts > 0, counts, TOO_MANY)
        few = rare < PART_CAP
        slots = []
        for phase in (0, 1):
            some = rare[phase::2]
            if len(some) and some[at := int(some.argmin())] < TOO_MANY:
                slots.append((2 * rev + phase, 2 * at + phase))
        for p in range(parts):
            first, last = -(-p * n // parts), len(rare) if p == parts - 1 else -(-(p + 1) * n // parts)
            some = rare[first:last]
            if len(some) and some[at := int(some.argmin())] < PART_CAP:
                slots.append((2 * rev + 4, first + at))
            # the sweep: offsets across the end of a part
            begin, end = (max(0, -(-(q * n - parts + 1) // parts)) if q else 0 for q in (p, p + 1))
            low = max(0, n // parts - k) + p * n // parts
            begin, end = max(begin, low), min(len(rare) if p == parts - 1 else end, n - k + 1, (p + 1) * n // parts - 7)
            for start in (begin, begin + 1):
                some = few[start : max(start, end) : 2]
                if len(some) and some[at := int(some.argmax())]:
                    slots.append((2 * rev + 5, start + 2 * at))
        for stage, o in slots:
            out[rev, o] = min(out.get((rev, o), 9), stage)
    return out


#: A seed of a read that is looked up; reads carry theirs as bytes. Its stage says the strand, and the read the k-mer.
_SPOT = np.dtype([("off", "<i4"), ("stage", "u1")])


def _chosen(k: int):
    def run(reads: pa.Table, met: pa.Table) -> pa.Table:
        """The reads of a slice, squeezed, with the seeds that are looked up."""
        kmers, counts = met.column("kmer").to_numpy(), met.column("n").to_numpy()
        order = np.argsort(kmers)
        ranks, counts = _Ranks(kmers[order], k), counts[order]
        rows, texts, spots = [], [], []

        def choose(block: list[tuple[int, bytes]]) -> None:
            # the k-mers of many reads are counted together
            codes = [np.concatenate([CODE[np.frombuffer(x, np.uint8)], np.full(k, 4, np.uint8)]) for _, raw in block for x in _both(raw)]
            every = window_codes(np.concatenate(codes), k)
            held = np.zeros(len(every), np.int64)
            at, which = ranks.among(every)
            held[at] = counts[which]
            begin = 0
            for row, raw in block:
                n, sides = len(raw), []
                for _ in range(2):
                    end = begin + max(0, n - k + 1)
                    sides.append(held[begin:end])
                    begin += n + k
                found = _looked_up(n, k, sides)
                if found:
                    rows.append(row)
                    texts.append(_squeezed(raw))
                    spots.append(np.array([(o, s) for (_, o), s in found.items()], _SPOT).tobytes())

        block, size = [], 0
        for row, text in enumerate(reads.column("seq")):
            block.append((row, _latin(text.as_py())))
            size += 2 * len(block[-1][1])
            if size >= PIECE:
                choose(block)
                block, size = [], 0
        if block:
            choose(block)
        seq, n, plain = zip(*texts, strict=True) if texts else ((), (), ())
        some = reads.take(pa.array(rows, pa.int64()))
        return pa.table({"slice": some.column("slice"), "read_id": some.column("read_id"), "seq": pa.array(seq, pa.binary()), "n": pa.array(n, pa.int32()), "plain": pa.array(plain, pa.bool_()), "spots": pa.array(spots, pa.binary())})

    return run


#: The low bit of each of the first 0 to 32 bases of a word.
_FIRST = np.array([sum(1 << 62 - 2 * i for i in range(n)) for n in range(33)], np.uint64)


class _Words:
    """A text as words of 32 bases at two bits, and where it has letters other than ACGT, if it has any, as a word of low bits."""

    def __init__(self, codes: np.ndarray) -> None:
        words = lambda x: np.frombuffer(packed_bases(np.concatenate([x, np.zeros(-len(x) % 32 + 64, np.uint8)])), ">u8").astype(np.uint64)
        odd = codes > 3
        self.words = words(codes & 3)
        self.plain = words((~odd).view(np.uint8)) if odd.any() else None

    def at(self, p: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """The 32 bases from each place on, beyond the end any."""
        words = self.words if words is None else words
        i, s = np.minimum(p >> 5, len(words) - 2), ((p & 31) << 1).astype(np.uint64)
        return words[i] << s | words[i + 1] >> np.uint64(1) >> np.uint64(63) - s

    def differ(self, p: np.ndarray, other: _Words, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of the next n bases, 32 at most, differ from those of ``other``; those that are no ACGT on either side are not counted."""
        x = self.at(p) ^ other.at(q)
        x = (x | x >> np.uint64(1)) & _FIRST[np.clip(n, 0, 32)]
        for text, at in ((self, p), (other, q)):
            if text.plain is not None:
                x &= text.at(at, text.plain)
        return np.bitwise_count(x)


def _even_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """window_codes() at even places."""
    if k % 2:
        return window_codes(codes, k)[::2]
    n = (len(codes) - k) // 2 + 1
    if n < 1:
        return np.empty(0, np.int64)
    two = codes[: len(codes) // 2 * 2].reshape(-1, 2)
    pair = two[:, 0] << 2 & 12 | two[:, 1] & 3
    out = np.zeros(n, np.int64)
    for i in range(k // 2):
        out = out << 4 | pair[i : i + n]
    odd = np.concatenate([[0], np.cumsum((two > 3).any(axis=1))])
    out[odd[k // 2 : k // 2 + n] != odd[:n]] = -1
    return out


class _Reference:
    """The stretches of a cell one behind the other, and where the wanted k-mers begin at even places of them."""

    def __init__(self, table: pa.Table, k: int, wanted: np.ndarray) -> None:
        self.contigs = table.column("contig").unique()
        self.contigs = self.contigs.take(pc.sort_indices(self.contigs))
        contig = pc.index_in(table.column("contig"), value_set=self.contigs).to_numpy()
        chunk, stretch, size = (table.column(c).to_numpy().astype(np.int64) for c in ("chunk", "stretch", "n"))
        order = np.lexsort((chunk, stretch, contig))
        seq, plain = table.column("seq").combine_chunks(), table.column("plain").to_pylist()
        contig, chunk, stretch, size = contig[order], chunk[order], stretch[order], size[order]
        new = np.concatenate([[True], (np.diff(contig) != 0) | (np.diff(stretch) != 0)])
        first = np.flatnonzero(new)
        self.contig, self.offset, stretch = contig[first], chunk[first] * CHUNK, stretch[first]
        length = np.add.reduceat(size, first)
        # each stretch from an even place on, behind a sign that is no base
        room = length + 2 - length % 2
        self.begin = np.cumsum(room) - room
        self.end = self.begin + length
        self.size = int(room.sum())
        text = self.text = np.full(self.size, ord("-"), np.uint8)
        at = np.cumsum(size) - size + np.repeat(self.begin - (np.cumsum(length) - length), np.diff([*first, len(order)]))
        for i, begin, n in zip(order.tolist(), at.tolist(), size.tolist(), strict=True):
            text[begin : begin + n] = _raw(seq[i].as_py(), n, plain[i])
        codes = CODE[text]
        self.words = _Words(codes if not all(plain) else codes & 3)
        long = bool(len(self.offset) and (self.offset.any() or length.max() > STRETCH))
        places, ids, ranks = [np.empty(0, np.int32)], [np.empty(0, np.int32)], _Ranks(wanted, k)
        for start in range(0, self.size, PIECE):
            at, which = ranks.among(_even_kmers(codes[start : start + PIECE + k - 1], k)[: PIECE // 2])
            at = at * 2 + start
            if long:
                # those of a stretch's neighbours, which lie on it for its places alone, are found there
                of = np.searchsorted(self.begin, at, side="right") - 1
                good = (at - self.begin[of] + self.offset[of]) // STRETCH == stretch[of]
                at, which = at[good], which[good]
            places.append(at.astype(np.int32))
            ids.append(which.astype(np.int32))
        place, which = np.concatenate(places), np.concatenate(ids)
        self.place = place[np.argsort(which, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(wanted)))])


class _Reads:
    """The reads of a cell one behind the other, then the reverse complements from the last to the first."""

    def __init__(self, reads: pa.Table) -> None:
        self.n = reads.column("n").to_numpy().astype(np.int64)
        self.limit = self.n * LIMIT_PERCENT // 100
        raws = [_raw(*x) for x in zip(*(reads.column(c).to_pylist() for c in ("seq", "n", "plain")), strict=True)]
        text = np.concatenate(raws)
        codes = CODE[text]
        begin = np.cumsum(self.n) - self.n
        self.text = text
        self.words = _Words(np.concatenate([codes, np.where(codes > 3, 4, 3 - codes)[::-1]]))
        self.begin = np.stack([begin, 2 * len(text) - begin - self.n])

    def kmers(self, side: np.ndarray, row: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
        return (self.words.at(self.begin[side, row] + off) >> np.uint64(64 - 2 * k)).astype(np.int64)

    def letters(self, row: int, side: int) -> np.ndarray:
        x = self.text[self.begin[0, row] : self.begin[0, row] + self.n[row]]
        return np.frombuffer(x.tobytes().translate(TURN)[::-1], np.uint8) if side else x


def _fitting(ref: _Reference, reads: _Reads, row: np.ndarray, side: np.ndarray, off: np.ndarray, stage: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, stage, mis, contig, pos, side): of the places where seeds put reads the least of each read with no more mismatches than its limit, of many places at a time; contigs as ranks."""
    # reads of like lengths are done together
    order = np.argsort(reads.n[row], kind="stable")
    row, side, off, stage, which = (c[order] for c in (row, side, off, stage, which))
    begin, count = ref.start[which], ref.start[which + 1] - ref.start[which]
    ends = np.cumsum(count)
    first = 0
    while first < len(row):
        done = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + PLACES, side="right")))
        of = np.repeat(np.arange(first, stop), count[first:stop])
        at = ref.place[np.arange(len(of)) + done - (ends - count)[of] + begin[of]].astype(np.int64) - off[of]
        first = stop
        n = reads.n[row[of]]
        good = np.flatnonzero((at >= 0) & (at + n <= ref.size))
        of, at, n = of[good], at[good], n[good]
        x, limit, mis = reads.begin[side[of], row[of]], reads.limit[row[of]], np.zeros(len(of), np.int32)
        kept, o, wide = [], 0, 1
        while len(of):
            if wide == 1:
                mis += ref.words.differ(at + o, reads.words, x + o, n - o)
            else:
                more = np.arange(o, o + 32 * wide, 32)
                mis += ref.words.differ(at[:, None] + more, reads.words, x[:, None] + more, n[:, None] - more).sum(axis=1, dtype=np.int32)
            o += 32 * wide
            close = mis <= limit
            over = np.flatnonzero(close & (n <= o))
            if len(over):
                kept.append((of[over], at[over], mis[over]))
            live = np.flatnonzero(close & (n > o))
            of, at, n, x, limit, mis = (c[live] for c in (of, at, n, x, limit, mis))
            wide = 1 if o < 128 else max(1, min(2 * wide, STEP, PLACES // max(1, len(of))))
        if not kept:
            continue
        of, at, mis = (np.concatenate(c) for c in zip(*kept, strict=True))
        # a seed ends within its stretch: a place that begins in another one crosses that one's end
        within = np.searchsorted(ref.begin, at, side="right") - 1
        good = np.flatnonzero(at + reads.n[row[of]] <= ref.end[within])
        of, at, within, mis = of[good], at[good], within[good], mis[good]
        if ref.words.plain is not None or reads.words.plain is not None:
            # other letters are compared one by one
            for i, (s, a) in enumerate(zip(of.tolist(), at.tolist(), strict=True)):
                x = reads.letters(int(row[s]), int(side[s]))
                mis[i] = np.count_nonzero(ref.text[a : a + len(x)] != x)
            good = np.flatnonzero(mis <= reads.limit[row[of]])
            of, at, within, mis = of[good], at[good], within[good], mis[good]
        yield _least_of([(row[of], stage[of], mis, ref.contig[within], at - ref.begin[within] + ref.offset[within], side[of])])


def _least_of(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The least of each row."""
    found = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort(found[::-1])
    row = found[0][order]
    return tuple(c[order[np.flatnonzero(np.diff(row, prepend=-1))]] for c in found)


def _met_in_cell(k: int, names: list[str]):
    def run(reads: pa.Table, pieces: pa.Table) -> pa.Table:
        """The best place of each read of a cell."""
        best = tuple(np.empty(0, np.int64) for _ in range(6))
        contigs = pieces.column("contig").combine_chunks()
        if len(reads) and len(pieces):
            packed = reads.column("spots").to_pylist()
            spots = np.frombuffer(b"".join(packed), _SPOT)
            row = np.repeat(np.arange(len(packed)), [len(x) // _SPOT.itemsize for x in packed])
            off, stage = (spots[c].astype(np.int64) for c in ("off", "stage"))
            side, texts = stage >> 1 & 1, _Reads(reads)
            wanted, which = np.unique(texts.kmers(side, row, off, k), return_inverse=True)
            ref = _Reference(pieces, k, wanted)
            contigs = ref.contigs
            there, mapped = np.diff(ref.start)[which] > 0, np.zeros(len(reads), bool)
            # the first four stages win over the others
            for late in (False, True):
                some = np.flatnonzero(there & ((stage > 3) == late) & ~mapped[row])
                held = [best]
                for found in _fitting(ref, texts, row[some], side[some], off[some], stage[some], which[some]):
                    held.append(found)
                    if len(held) > HELD:
                        held = [_least_of(held)]
                best = _least_of(held)
                mapped[best[0]] = True
        row, *stage_mis, contig, pos, side = best
        some = reads.take(pa.array(row))
        columns = [some.column("read_id"), *(pa.array(c.astype(np.int32)) for c in stage_mis), contigs.take(pa.array(contig)), *(pa.array(c.astype(np.int32)) for c in (pos, side)), some.column("n")]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


class _Scanned:
    """A reference in pieces, with what is counted of it."""

    def __init__(self, ref: DataFrame, k: int) -> None:
        self.pieces, self.k = cut(_pieces(ref, k)), k
        self.total = self.pieces.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0

    def counts(self, wanted: np.ndarray | None) -> DataFrame:
        """kmer, n of those that may be seeds, of ``wanted`` alone if there are any."""
        return _counted(self.pieces, self.k, wanted).filter(F.col("n") < min(TOO_MANY, SEED_CAP))

    @functools.cached_property
    def every(self) -> DataFrame:
        return cut(self.counts(None))

    @functools.cached_property
    def known(self) -> Broadcast | None:
        """A bit for each of the 4**k k-mers there are, whatever the reference's length: those of ``every``. None if k is too large."""
        if 4**self.k > KNOWN:
            return None
        words = self.every.groupBy(F.shiftright("kmer", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(kmer & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(-(-(4**self.k) // 64), np.uint64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        return self.pieces.sparkSession.sparkContext.broadcast(bits)


def _by_cells(reads: DataFrame, ref: _Scanned, k: int) -> DataFrame:
    """read_id, stage, mis, contig, pos, rev, len: the best places of reads, one a cell at most.

    Slices of the reads meet buckets of the reference's stretches in cells; within one the places of the chosen
    seeds are compared as arrays, and only the best one leaves it. Each stretch carries along as many bases on
    either side as the longest read has. Neither candidates nor the k-mers of the reference are rows. Slices and
    cells are tasks by their numbers, as hashes would put several into one.
    """
    schema = lambda text, *fields: T.StructType([*fields, *T.StructType.fromDDL(text)])
    pieces, total = ref.pieces, ref.total
    fit = reads.filter(F.length(degenerate_letters(F.col("seq"))) <= F.floor(F.length("seq") * LIMIT_PERCENT / 100))
    bases, longest = fit.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)), F.coalesce(F.max(F.length("seq")), F.lit(0))).first()
    cores = reads.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-bases // SLICE), min(cores, -(-bases // LEAST)))
    buckets = max(1, -(-total // BUCKET), min(-(-cores // slices), -(-total // LEAST)))
    sliced = fit.select(F.pmod(F.xxhash64("read_id"), F.lit(slices)).cast("int").alias("slice"), "read_id", "seq").repartitionById(slices, F.col("slice"))
    kmers = lambda known: sliced.select("slice", "seq").groupBy("slice").applyInArrow(_kmers_of(k, known), "slice int, kmer long")
    if bases <= 4 * LOOKED and (asked := cut(kmers(None))).count() <= LOOKED:
        counts = ref.counts(np.sort(asked.select("kmer").distinct().toArrow().column(0).to_numpy()))
    else:
        asked, counts = kmers(ref.known), ref.every
    met = asked.join(counts, "kmer").select("slice", "kmer", "n").repartitionById(slices, F.col("slice"))
    chosen = sliced.groupBy("slice").cogroup(met.groupBy("slice"))
    chosen = chosen.applyInArrow(_chosen(k), schema("slice int, seq binary, n int, plain boolean, spots binary", reads.schema["read_id"]))
    near = lambda by: F.floor((F.col("chunk").cast("long") * CHUNK + by) / STRETCH)
    spread = pieces.drop("ahead").withColumn("stretch", F.explode(F.sequence(F.greatest(F.lit(0), near(-longest)), near(CHUNK - 1 + longest))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("contig", "stretch"), F.lit(buckets)).cast("int")).withColumn("slice", each(slices))
    names = ["read_id", "stage", "mis", "contig", "pos", "rev", "len"]
    celled = lambda df: df.withColumn("cell", (F.col("bucket") * slices + F.col("slice")).cast("int")).drop("bucket", "slice").repartitionById(buckets * slices, F.col("cell")).groupBy("cell")
    met = celled(chosen.withColumn("bucket", each(buckets))).cogroup(celled(spread))
    return met.applyInArrow(_met_in_cell(k, names), schema("stage int, mis int, pos int, rev int, len int", reads.schema["read_id"], pieces.schema["contig"]))


def align(reads: DataFrame, ref: DataFrame, k: int = K, *, index: tuple[DataFrame, DataFrame] | None = None, found: bool = True, scanned: _Scanned | None = None) -> DataFrame:
    """read_id, rev, contig, pos, mis, found (mismatches, on demand): one row per read, null columns where nothing fits.

    Within the first stage that has a place with at most LIMIT_PERCENT mismatches, the fewest
    mismatches win, then the first contig and position. ``reads``: read_id, seq of any length; ``ref``:
    contig, seq; ``index``: its stored seeds and counts; ``scanned``: what an earlier call has made of it.
    """
    good = _by_index(reads, ref, k, index) if index else _by_cells(reads, scanned or _Scanned(ref, k), k)
    # one comparison of structs: map-side first, no window over a read's candidates
    best = good.groupBy("read_id").agg(F.min(F.struct("stage", "mis", "contig", "pos", "rev", "len")).alias("b"))
    best = best.select("read_id", *(F.col(f"b.{c}").alias(c) for c in ("rev", "contig", "pos", "mis", "len")))
    if found:
        turned = F.when(F.col("rev") == 1, reverse_complement(F.col("read"))).otherwise(F.col("read"))
        best = fetch(best, ref).join(reads.select("read_id", F.col("seq").alias("read")), "read_id").withColumn("found", mismatches(F.col("bases"), turned))
    best = best.select("read_id", "rev", "contig", "pos", "mis", *(["found"] if found else []))
    return reads.select("read_id").join(best, "read_id", "left")


def split_align(reads: DataFrame, ref: DataFrame, k: int = K, *, low: int = 64, high: int = 500) -> DataFrame:
    """Segments of reads: seg_start, seg_len and what align() says of each; an unmapped read between the bounds is halved, and its halves again while longer than ``low`` (three rounds at most)."""
    todo, scanned = cut(reads.select("read_id", F.lit(0).alias("seg_start"), "seq")), _Scanned(ref, k)
    done: DataFrame | None = None
    while True:
        keyed = todo.select(F.struct("read_id", "seg_start").alias("read_id"), "seq")
        got = align(keyed, ref, k, found=False, scanned=scanned).select("read_id.read_id", "read_id.seg_start", "rev", "contig", "pos", "mis").join(todo, ["read_id", "seg_start"])
        got = cut(got)
        again = (F.length("seq") > low) & (F.length("seq") < high) & F.col("mis").isNull()
        ready = got.filter(~again).select("read_id", "seg_start", F.length("seq").alias("seg_len"), "rev", "contig", "pos", "mis")
        done = ready if done is None else done.unionByName(ready)
        high = high // 2 + 1
        if high <= low:
            rest = got.filter(again).select("read_id", "seg_start", F.length("seq").alias("seg_len"), "rev", "contig", "pos", "mis")
            return done.unionByName(rest)
        half = F.floor(F.length("seq") / 2).cast("int")
        left = F.struct(F.col("seg_start").alias("seg_start"), F.substring("seq", F.lit(1), half).alias("seq"))
        right = F.struct((F.col("seg_start") + half).alias("seg_start"), F.expr("substr(seq, cast(floor(length(seq) / 2) as int) + 1)").alias("seq"))
        todo = cut(got.filter(again).select("read_id", F.inline(F.array(left, right))))


def fetch(places: DataFrame, ref: DataFrame, size: int = CHUNK) -> DataFrame:
    """``places`` (contig, pos, len) with the reference bases there, by chunks."""
    keyed = places.withColumn("_row", F.monotonically_increasing_id())
    pieces = _on_chunks(keyed, ref, size).groupBy("_row", *places.columns).agg(F.sort_array(F.collect_list(F.struct("chunk", "window"))).alias("_p"))
    return pieces.select(*places.columns, F.array_join(F.transform("_p", lambda x: x["window"]), "").alias("bases"))
