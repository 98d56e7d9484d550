from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import names as N
from readlake.functions import sequence as S


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else row


def test_reverse_complement_is_its_own_inverse(spark):
    s = F.lit("ACGTNacgt")
    assert one(spark, x=S.reverse_complement(S.reverse_complement(s))) == "ACGTNacgt"
    assert one(spark, x=S.complement(F.lit("ACGTX"), unknown_to_n=True)) == "TGCAN"


def test_pack_and_mix(spark):
    def mix(x, k):
        mask = (1 << 2 * k) - 1
        x = (~x + (x << 21)) & mask
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & mask
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & mask
        x ^= x >> 28
        return (x + (x << 31)) & mask

    for kmer in ("A" * 14, "ACGTACGTACGTAC", "T" * 31, "GATTACA"):
        code = int("".join(str("ACGT".index(c)) for c in kmer), 4)
        k = len(kmer)
        r = one(spark, c=S.pack_kmer(F.lit(kmer)), u=S.unpack_kmer(S.pack_kmer(F.lit(kmer)), k), m=S.mix_kmer(S.pack_kmer(F.lit(kmer)), k), r=S.packed_reverse_complement(S.pack_kmer(F.lit(kmer)), k))
        assert (r["c"], r["u"], r["m"]) == (code, kmer, mix(code, k))
    assert one(spark, x=S.pack_kmer(F.lit("ACN"))) is None


def test_codes_and_bits(spark):
    assert [one(spark, x=S.base_code(F.lit(b))) for b in "AcGtN"] == [0, 1, 2, 3, 4]
    assert [one(spark, x=S.code_base(F.lit(i))) for i in range(5)] == list("ACGTN")
    assert one(spark, x=S.complement_code(F.lit(1))) == 2
    assert one(spark, x=S.from_bits(S.to_bits(F.lit(77).cast("long"), 10))) == 77
    assert [one(spark, x=S.bit_length(F.lit(i).cast("long"))) for i in (0, 1, 255, 256)] == [0, 1, 8, 9]
    assert one(spark, x=S.packed_hamming(S.pack_kmer(F.lit("ACGT")), S.pack_kmer(F.lit("ACTA")))) == 2
    assert one(spark, x=S.little_endian(F.lit(258).cast("long"), 4)) == "02010000"


def test_degenerate(spark):
    s, q = F.lit("NACGNNTN"), F.lit("!IIIB#I!")
    assert one(spark, x=S.degenerate_max_quality(s, q)) == ord("B")
    assert one(spark, x=S.degenerate_gaps(s, q)) == [0, 0, 0, 0, 0]
    assert one(spark, x=S.trim_degenerate(s)) == "ACGNNT"
    assert one(spark, x=S.degenerate_gaps(F.lit("ACGT"), F.lit("IIII"))) is None
    assert one(spark, x=S.degenerate_max_quality(F.lit(""), F.lit(""))) is None
    assert one(spark, x=S.most_frequent_base(F.lit("TTCC"))) == "C"


def test_masks_and_mismatches_round_trip(spark):
    m = S.mask_n(F.lit("NACCNN"))
    assert one(spark, x=S.unmask_n(m["seq"], m["n_at"])) == "NACCNN"
    ref, read = F.lit("ACGTACGT"), F.lit("ACTTNCGA")
    found = S.mismatches(ref, read)
    assert [(x["pos"], x["code"]) for x in one(spark, x=found)] == [(2, 2), (4, 3), (7, 0)]
    assert one(spark, x=S.apply_mismatches(ref, found)) == "ACTTNCGA"
    assert one(spark, x=S.hamming(ref, read)) == 3


def test_names(spark):
    name = F.lit("SRR1.1 1 length=100")
    assert one(spark, x=N.tokens(name)) == ["SRR1", ".", "1", " ", "1", " ", "length", "=", "100"]
    assert one(spark, x=N.token_types(name, F.lit(100))) == [3, 0, 2, 0, 2, 0, 7, 0, 4]
    assert one(spark, x=N.token_types(name, F.lit(99)))[-1] == 2
    assert one(spark, x=N.token_types(F.lit("@X:007/2"), F.lit(9), paired=True)) == [0, 1, 0, 8, 0, 5]
    assert one(spark, x=N.file_stem(F.lit("/a/b/run.fastq.gz"))) == "run.fastq"
    assert [one(spark, x=N.file_stem(F.lit(p))) for p in ("run", "/a.b/run.fq", "a.b.c.d", "x/")] == ["run", "run.fq", "a.b", ""]
    assert one(spark, x=N.split_list(F.lit("a,,b,"))) == ["a", "b"]
    assert one(spark, x=N.nibbles(F.lit(0x1F).cast("long"))) == [1, 15]
    assert N.posix_pattern("x[[:digit:]]") == r"x[\p{Digit}]"


def test_units_words_and_positions(spark):
    x = 0x0123456789ABCDEF
    assert one(spark, x=S.reversed_units(F.lit(x).cast("long"), 8)) == int.from_bytes(x.to_bytes(8, "big"), "little", signed=True)
    assert one(spark, x=S.reversed_units(F.lit(0b1101).cast("long"), 1, 4)) == 0b1011
    assert one(spark, x=S.packed_words(F.lit("ACGT" * 4 + "TN"))) == [int("0123" * 4, 4), int("3" + "0" * 15, 4)]
    assert one(spark, x=S.packed_words(F.lit(""))) == []
    at = lambda mate, relation: one(spark, x=S.absolute_position(F.lit(1000), F.lit(7), F.lit(mate), F.lit(relation)))
    assert [at(500, r) for r in (None, 0, 1, 2, 3, 6)] == [1007, 493, 507, 1007, 1007, None]
