"""Column functions on base and quality strings; they stay in the JVM, but for patching and for the qualities of degenerate bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<string>"


def _chars(s: Column) -> Column:
    """The characters of a string; none for the empty one."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast(_EMPTY))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, though f uses it many times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def reverse_complement(s: Column) -> Column:
    """A<->T, C<->G from the end; other letters stay."""
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def complement(s: Column, unknown_to_n: bool = False) -> Column:
    """Base by base, order kept; letters other than ACGT stay, or become N."""
    out = F.translate(s, "ACGT", "TGCA")
    return F.regexp_replace(out, "[^ACGT]", "N") if unknown_to_n else out


def base_code(base: Column) -> Column:
    """A, C, G, T to 0..3 in any case, all else 4."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def code_base(code: Column) -> Column:
    return F.when((code >= 0) & (code < 4), F.substring(F.lit("ACGT"), code + 1, F.lit(1))).otherwise("N")


def complement_code(code: Column) -> Column:
    """3 - code for the four bases, by exclusive or; other codes stay."""
    return F.when(code <= 3, code.bitwiseXOR(F.lit(3))).otherwise(code)


def pack_kmer(s: Column) -> Column:
    """Two bits a base, first base highest, as a long; null unless 1 to 31 letters of ACGT."""
    good = s.rlike("^[ACGT]{1,31}$")
    return F.when(good, F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def unpack_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed_reverse_complement(code: Column, k: int) -> Column:
    return pack_kmer(reverse_complement(unpack_kmer(code, k)))


def kmers(s: Column, k: int, step: int = 1, start: int = 0) -> Column:
    """Array of (pos, kmer), 0-based, every ``step``-th from ``start``; empty where the sequence is too short."""
    last = F.length(s) - k
    at = F.when(last >= start, F.sequence(F.lit(start), F.greatest(last, F.lit(start)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


def _add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64; halves are added apart, so ANSI mode sees no overflow."""
    low = F.lit(0xFFFFFFFF)
    lo = a.bitwiseAND(low) + b.bitwiseAND(low)
    hi = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(hi.bitwiseAND(low), 32).bitwiseOR(lo.bitwiseAND(low))


def _sum(first: Column, *more: Column) -> Column:
    for x in more:
        first = _add(first, x)
    return first


def mix_kmer(code: Column, k: int) -> Column:
    """Invertible mix of a packed k-mer modulo 4**k (shift-add hash of 64-bit integers); orders k-mers evenly."""
    mask = F.lit((1 << (2 * k)) - 1)
    fold = lambda n: lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    add = lambda *ns: lambda x: _sum(*[F.shiftleft(x, n) for n in ns]).bitwiseAND(mask)
    x = let(code, lambda c: _add(F.bitwise_not(c), F.shiftleft(c, 21)).bitwiseAND(mask))
    for step in (fold(24), add(0, 3, 8), fold(14), add(0, 2, 4), fold(28), add(0, 31)):
        x = let(x, step)
    return x


def is_degenerate(s: Column) -> Column:
    """Whether any letter is not one of ACGT, in any case."""
    return s.rlike("[^ACGTacgt]")


def degenerate_letters(s: Column) -> Column:
    return F.regexp_replace(s, "[ACGTacgt]", "")


def trim_degenerate(s: Column) -> Column:
    """Without leading and trailing letters other than ACGT."""
    return F.regexp_replace(s, "^[^ACGT]+|[^ACGT]+$", "")


def degenerate_max_quality(s: Column, q: Column) -> Column:
    """Greatest quality byte at a degenerate base; null where there is none."""
    from .packed import degenerate_stats

    return degenerate_stats(s, q)["best"]


def degenerate_gaps(s: Column, q: Column) -> Column:
    """Among positions of a quality no better than the best degenerate one: how many normal bases stand before each degenerate base and after the last. Null without any."""
    from .packed import degenerate_stats

    return degenerate_stats(s, q)["gaps"]


def most_frequent_base(s: Column) -> Column:
    """The base of ACGT that occurs most; of equals the first by letter."""
    n = {b: F.length(s) - F.length(F.regexp_replace(s, b, "")) for b in "ACGT"}
    top = F.greatest(*n.values())
    out = F.when(n["A"] == top, "A")
    for b in "CGT":
        out = out.when(n[b] == top, b)
    return out


def mask_n(s: Column) -> Column:
    """(seq with N replaced by its most frequent base, positions of N)."""
    at = F.filter(F.transform(_chars(s), lambda b, i: F.when(b == "N", i)), lambda i: i.isNotNull())
    return F.struct(F.replace(s, F.lit("N"), most_frequent_base(s)).alias("seq"), at.alias("n_at"))


def unmask_n(s: Column, n_at: Column) -> Column:
    return F.array_join(F.transform(_chars(s), lambda b, i: F.when(F.array_contains(n_at, i), "N").otherwise(b)), "")


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, over the longer length."""
    return F.aggregate(F.zip_with(_chars(a), _chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda n, x: n + x)


def mismatches(ref: Column, read: Column) -> Column:
    """Array of (pos, code): where the read differs; code 0..2 is which of the three other bases, by letter; 3 any other sign."""
    def one(pair: Column, i: Column) -> Column:
        others = F.replace(F.lit("ACGT"), pair["r"], F.lit(""))
        at = F.instr(others, pair["b"])
        return F.when(~pair["r"].eqNullSafe(pair["b"]), F.struct(i.alias("pos"), F.when((at > 0) & (F.length(others) == 3), at - 1).otherwise(3).alias("code"), pair["b"].alias("base")))

    pairs = F.zip_with(_chars(ref), _chars(read), lambda r, b: F.struct(r.alias("r"), b.alias("b")))
    return F.filter(F.transform(pairs, one), lambda x: x.isNotNull())


def apply_mismatches(ref: Column, found: Column) -> Column:
    """The read that mismatches() compared with ``ref``, in one pass over it."""
    from .packed import patched

    return patched(ref, found)


def bit_length(x: Column) -> Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def to_bits(x: Column, n: int) -> Column:
    """The n lowest bits, lowest first."""
    return F.array(*[F.shiftright(x, i).bitwiseAND(F.lit(1)).cast("int") for i in range(n)])


def from_bits(bits: Column) -> Column:
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda n, b: F.shiftleft(n, 1) + b)


def packed_hamming(a: Column, b: Column) -> Column:
    """Bases that differ between two packed k-mers: pairs of bits folded, then counted."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def little_endian(x: Column, n: int) -> Column:
    """The n lowest bytes as hexadecimal digits, lowest byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])


def reversed_units(x: Column, unit: int, width: int = 64) -> Column:
    """``width`` bits of a long with its units of ``unit`` bits in the opposite order."""
    if width % unit or unit > 32:
        raise ValueError(f"{width} bits are not made of units of {unit}")
    mask, out = F.lit((1 << unit) - 1).cast("long"), F.lit(0).cast("long")
    for i in range(width // unit):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, i * unit).bitwiseAND(mask), width - (i + 1) * unit))
    return out


def packed_words(s: Column, bases: int = 16) -> Column:
    """Two bits a base, ``bases`` of them a word, first base highest; the last word is filled with zeros at its low end. Other letters count as A."""
    plain = F.regexp_replace(s, "[^ACGT]", "A")
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(bases))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: pack_kmer(F.rpad(F.substring(plain, i, F.lit(bases)), bases, "A")))


def absolute_position(block_start: Column, offset: Column, mate_position: Column, relation: Column) -> Column:
    """Place on the whole reference: the block's start and the offset in it; a second mate's by its distance from the first, before it for even relations and after it for odd ones (operators.pairs.pair_relation); null for reads without a place."""
    distance = F.when(relation % 2 == 0, mate_position - offset).otherwise(mate_position + offset)
    return F.when(relation.isNull() | relation.isin(2, 3), block_start + offset).when(relation.isin(0, 1), distance)
