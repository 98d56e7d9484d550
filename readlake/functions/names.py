"""Column functions on read names."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .sequence import let

#: Token types (fixed values).
SYMBOL, LETTERS, DIGITS, MIXED, LENGTH_WORD, LENGTH_VALUE, MATE_TAIL, SINGLE_TAIL, PADDED = 0, 1, 2, 3, 7, 4, 5, 6, 8
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def tokens(name: Column) -> Column:
    """Runs of letters and digits, and runs of other signs, in turn."""
    return F.regexp_extract_all(name, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))


def token_types(name: Column, seq_length: Column, paired: bool = False) -> Column:
    """Type of each token. A value two tokens after the word "length" is LENGTH_VALUE only if it equals the read's length; a last token 1 or 2 after a sign is a tail."""
    def one(t: Column, i: Column, all_: Column) -> Column:
        before = lambda k: F.get(all_, i - k)
        is_value = t.rlike("^[0-9]+$") & (before(2) == "length") & (t == seq_length.cast("string"))
        is_tail = (i == F.size(all_) - 1) & (i > 0) & t.isin("1", "2") & (before(1) == "/")
        return (
            F.when(t.rlike("^[^A-Za-z0-9]"), SYMBOL).when(t == "length", LENGTH_WORD).when(F.coalesce(is_value, F.lit(False)), LENGTH_VALUE)
            .when(F.coalesce(is_tail, F.lit(False)), MATE_TAIL if paired else SINGLE_TAIL).when(t.rlike("^0[0-9]+$"), PADDED)
            .when(t.rlike("^[0-9]+$"), DIGITS).when(t.rlike("^[A-Za-z]+$"), LETTERS).otherwise(MIXED)
        )

    return let(tokens(name), lambda parts: F.transform(parts, lambda t, i: one(t, i, parts)))


def name_format(name: Column) -> Column:
    """What two names share if they are laid out alike: signs as they are, letters L, digits D, padded digits with their width, mixtures M."""
    def one(t: Column) -> Column:
        padded = F.concat(F.lit("P"), F.length(t).cast("string"))
        return F.when(t.rlike("^[^A-Za-z0-9]"), t).when(t.rlike("^0[0-9]+$"), padded).when(t.rlike("^[0-9]+$"), "D").when(t.rlike("^[A-Za-z]+$"), "L").otherwise("M")

    return F.array_join(F.transform(tokens(name), one), "|")


def delta_class(now: Column, before: Column) -> Column:
    """0 same, 1 one more, 2 more, 3 less or no predecessor."""
    d = now - before
    return F.when(d == 0, 0).when(d == 1, 1).when(d > 1, 2).otherwise(3)


def nibbles(x: Column) -> Column:
    """Hexadecimal digits of a non-negative integer as numbers, highest first."""
    return F.transform(F.split(F.hex(x), ""), lambda c: F.instr(F.lit("0123456789ABCDEF"), c) - 1)


def base62_codes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(BASE62), c) - 1)


def split_list(s: Column, sign: str = ",") -> Column:
    """Parts between the sign, empty ones dropped."""
    return F.filter(F.split(s, f"[{sign}]"), lambda x: x != "")


def file_stem(path: Column) -> Column:
    """Last part of a path, up to its second dot."""
    return F.regexp_extract(path, r"([^/.]*(?:\.[^/.]*)?)[^/]*$", 1)


def posix_pattern(pattern: str) -> str:
    """A POSIX extended pattern for Java's matcher: named classes are translated."""
    names = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
    for posix, java in names.items():
        pattern = pattern.replace(f"[:{posix}:]", rf"\p{{{java}}}")
    if "[:" in pattern or "[." in pattern or "[=" in pattern:
        raise ValueError(f"unsupported class in pattern: {pattern}")
    return pattern


def same_as_leader(parts: Column, w: WindowSpec) -> Column:
    """For each token 1 where it is that of the first name of its format in the block, else 0; ``w`` is ordered and partitioned by block and format."""
    leader = F.first(parts).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.zip_with(parts, leader, lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0))
