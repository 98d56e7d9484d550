"""What shows only on larger tables, on small ones that are made for it."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readlake.functions import packed
from readlake.functions import sequence as S
from readlake.functions import tables as table_functions
from readlake.operators import align as A
from readlake.operators import graph as G
from readlake.operators import overlap as O
from readlake.operators.align import align
from readlake.operators.index import seed_counts, seeds
from readlake.plans import catalogue


def tables(spark, tmp_path, documents, benchmark=()):
    """A folder with documents (doc_id, text) and benchmark (item_id, text)."""
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_counts_of_seeds_have_no_cap(spark, tmp_path):
    many = 70_000
    d = tables(spark, tmp_path, [(0, "a" * (2 * many + 12)), (1, "c" * 16)], [(0, "a" * 14)])
    assert [tuple(r) for r in catalogue.QUERIES["seed_index_csr"](spark, d).select("kmer", "n", "start").sort("start").collect()] == [("A" * 14, many, 0), ("C" * 14, 2, many)]
    assert [tuple(r) for r in catalogue.QUERIES["rarest_seed"](spark, d).collect()] == [(0, 0, 0, "A" * 14, many)]


def test_common_keys_meet_in_few_copies(spark):
    # one key for all reads, of which none are alike: rows dealt to cells grew with n * n / 1000, and each pair was a call
    rng = np.random.default_rng(3)
    half = lambda: "".join(rng.choice(list("CGT"), 60))
    reads = spark.createDataFrame([(i, half() + "A" * 13 + half()) for i in range(3000)], "read_id long, seq string").cache()
    assert O._met(reads, 13, O.KEY_BLOCK).count() <= 3000 * O.PER_READ
    assert O.near_pairs(reads).isEmpty()


def test_words_count_what_bases_do(spark):
    # overlaps that end within a word, on it, and beyond all words on either side
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ACGT"), 9000))
    rows = []
    for i, (a, b) in enumerate([(0, 9000), (10, 9000), (0, 5000), (3000, 9000), (0, 700), (64, 704), (1, 129), (0, 64)] * 2):
        text = np.array(list(base[a:b]))
        at = rng.choice(len(text), len(text) * (i % 5) // 50, replace=False)
        text[at] = "A"
        rows.append((i, "".join(text)))
    seqs = dict(rows)
    got = O.compared(spark.createDataFrame(rows, "read_id long, seq string"), percent=12).collect()
    turned = lambda x, s: x.translate(str.maketrans("ACGT", "TGCA"))[::-1] if s else x
    assert len(got) > 20
    for r in got:
        x, y = turned(seqs[r["src"]], r["s_strand"]), turned(seqs[r["dst"]], r["e_strand"])
        i, j, n = max(r["off"], 0), max(-r["off"], 0), r["span"]
        assert n == min(len(x) - i, len(y) - j) and r["mis"] == sum(a != b for a, b in zip(x[i : i + n], y[j : j + n], strict=True)) <= n * 12 // 100


def test_rest_and_small_trees_equal_the_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(a, b, rng.randint(-9, 9), rng.randint(0, 4), rng.randint(0, 1), rng.randint(0, 1)) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)}]
    edges = spark.createDataFrame(rows, "src long, dst long, off int, mis int, s_strand int, e_strand int").cache()
    cuts, real = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df: cuts.append(1) or real(df))

    def all_of() -> list:
        forest, comp = G.spanning_forest(edges)
        return [sorted(map(tuple, df.collect()), key=repr) for df in (forest, comp, G.layout(forest, comp).select("node", "component", "parent", "depth", "strand", "off", "as_is"))]

    got = all_of()
    # rounds were gone through for a handful of edges too
    assert len(cuts) <= 6
    monkeypatch.setattr(G, "FEW", 0)
    assert all_of() == got


def test_contexts_and_kmers_come_in_pieces(spark, monkeypatch):
    texts = ["", None, "A", "ACGTN" * 9, "".join(random.Random(6).choice("ACGTN") for _ in range(200))]
    reads = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "read_id long, seq string")
    want = Counter(x[max(0, i - 10) : i] for x in texts if x for i in range(len(x)))
    monkeypatch.setattr(packed, "PIECE", 16)
    assert {r["context"]: r["n"] for r in packed.context_counts(reads).collect()} == want
    monkeypatch.setattr(table_functions, "PIECE", 16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["read_id", "seq"])
    pieces = list(table_functions.ReadKmers.func().eval(batch, pa.array([14])))
    assert all(p.num_rows <= 32 for p in pieces)
    got = [(r["read_id"], r["pos"], r["kmer"]) for p in pieces for r in p.to_pylist()]
    codes = {c: n for n, c in enumerate("ACGT")}
    value = lambda x: sum(codes[c] << 2 * n for n, c in enumerate(reversed(x)))
    assert got == [(i, p, value(x[p : p + 14])) for i, x in enumerate(texts) if x for p in range(len(x) - 13) if "N" not in x[p : p + 14]]


def test_gaps_are_found_out_in_arrow(spark):
    rows = [("ACNGTN", "IIBIBA"), ("ACGT", "IIII"), ("", ""), ("NNA", "BAA"), (None, "I")]
    got = spark.createDataFrame(rows, "s string, q string").select(S.degenerate_gaps(F.col("s"), F.col("q")).alias("g"), S.degenerate_max_quality(F.col("s"), F.col("q")).alias("m"))
    assert [tuple(r) for r in got.collect()] == [([0, 1, 0], 66), (None, None), (None, None), ([0, 0, 1], 66), (None, None)]
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_reads_lie_packed_and_once_in_cells(spark):
    """A key of 12,000 reads is met in one cell, at two bits a base."""
    bases = "".join(random.Random(2).choices("ACGT", k=200))
    r = spark.range(12_000).select(F.col("id").alias("read_id"), F.lit(bases).alias("seq"))
    met = O._met(r, 13, O.KEY_BLOCK).agg(F.count(F.lit(1)), F.sum(F.length("seq"))).first()
    spots = O.minimizers(r.limit(1)).count()
    assert tuple(met) == (12_000 * spots, 12_000 * spots * 50)


def test_places_of_a_seed_have_no_cap(spark):
    """The only place that fits is the last of 3101 that share the read's only seed."""
    rng = random.Random(7)
    seed, rest = "".join(rng.choices("ACGT", k=14)), "".join(rng.choices("ACGT", k=16))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    spoilt = "".join(other[c] if i in (0, 14) else c for i, c in enumerate(rest))
    ref = [(i, seed + other[rest[0]] + "".join(rng.choices("ACGT", k=15))) for i in range(3100)] + [(9999, seed + spoilt)]
    got = align(spark.createDataFrame([(1, seed + rest)], "read_id long, seq string"), spark.createDataFrame(ref, "contig long, seq string"), found=False)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 9999, 0, 2)]


def test_places_of_many_reads_are_compared_together(monkeypatch):
    """Reads of a cell share few calls, whatever their number; each was several before."""
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=40_000))
    texts = [text[i * 13 : i * 13 + 60 + i % 40] for i in range(3000)]
    reads = pa.table({"slice": pa.array([0] * len(texts), pa.int32()), "read_id": list(range(len(texts))), "seq": texts})
    kmers = A._kmers_of(14, None)(reads).column("kmer")
    chosen = A._chosen(14)(reads, pa.table({"kmer": kmers, "n": pa.array([1] * len(kmers))}))
    seq, n, plain = zip(*(A._squeezed(text[i : i + 4096].encode()) for i in range(0, len(text), 4096)), strict=True)
    pieces = pa.table({"contig": [7] * len(seq), "chunk": list(range(len(seq))), "seq": seq, "n": pa.array(n, pa.int32()), "plain": plain, "stretch": [0] * len(seq)})
    calls, real = [], A._Words.differ
    monkeypatch.setattr(A._Words, "differ", lambda *x: calls.append(1) or real(*x))
    got = A._met_in_cell(14, ["read_id", "stage", "mis", "contig", "pos", "rev", "len"])(chosen, pieces)
    assert sorted((r["read_id"], r["contig"], r["pos"], r["mis"], r["rev"]) for r in got.to_pylist()) == [(i, 7, i * 13, 0, 0) for i in range(len(texts))]
    assert len(calls) < 30


def test_words_place_reads_as_stored_seeds_do(spark, monkeypatch):
    """Other letters, either strand, long contigs, ends of contigs: the same as by stored seeds, in cells of any number."""
    rng = random.Random(9)
    ref = [(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((9000, 700, 64, 5000, A.STRETCH + 6000))]
    ref[1] = (1, ref[1][1][:300] + "N" * 5 + ref[1][1][305:])
    ref.append((9, ref[0][1][100:400]))
    reads = []
    for i in range(300):
        text = ref[i % 6][1]
        n = min(len(text), rng.choice((14, 30, 64, 65, 200, 2500)))
        at = A.STRETCH - rng.randrange(n) if len(text) > A.STRETCH else rng.randrange(len(text) - n + 1)
        signs = list(text[at : at + n])
        for j in rng.sample(range(n), n * (i % 6) // 60):
            signs[j] = rng.choice("ACGTN")
        read = "".join(signs)
        reads.append((i, read[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 2 else read))
    r, c = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(ref, "contig long, seq string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    seeds_ = seeds(c)
    want = rows(A.align(r, c, found=False, index=(seeds_, seed_counts(seeds_))))
    assert sum(x[4] is not None for x in want) > 200
    assert rows(A.align(r, c, found=False)) == want
    # in more cells, and with the whole reference's k-mers counted
    for name, value in (("LEAST", 5000), ("LOOKED", 0)):
        monkeypatch.setattr(A, name, value)
    assert rows(A.align(r, c, found=False)) == want


def test_long_overlaps_are_looked_up(monkeypatch):
    """Long sequences of a key that agree in little else are not compared with each other; those that do are found, as by comparing all."""
    rng = np.random.default_rng(10)
    base = [rng.integers(0, 4, 3000, np.uint8) for _ in range(40)]
    rows = []
    for rank in range(1500):
        size, pos = int(rng.integers(300, 2500)), int(rng.integers(0, 280))
        codes = rng.integers(0, 4, size, np.uint8)
        if rank % 3 == 0:
            # cut from the same text around the key, with up to 14 % of other bases
            codes = base[rank // 6 % 20][300 - pos : 300 - pos + size].copy()
            at = rng.random(len(codes)) < rng.random() * 0.14
            codes[at] = rng.integers(0, 4, int(at.sum()), np.uint8)
        rows.append((O.packed_bases(codes), len(codes), pos, 0, rank // 3 % 2, rank))
    rows += [(*rows[i][:5], 2000 + i) for i in range(0, 90, 3)]
    monkeypatch.setattr(O, "WORTH", 100)
    compared, real = [], O._Key._exact
    monkeypatch.setattr(O._Key, "_exact", lambda key, x, *more: compared.append(len(x)) or real(key, x, *more))

    def found(cross: bool) -> list:
        key = O._Key((*r[:4], r[4] if cross else 0, r[5]) for r in rows)
        return [sorted(tuple(map(int, r)) for f in pick(key, cross, 8, looser, 0.5) for r in zip(*f, strict=True)) for pick, looser in ((O._all_near, 0), (O._two_nearest, 4))]

    got = [found(cross) for cross in (False, True)]
    assert all(len(x) > 100 for both in got for x in both)
    # four runs of 1500 sequences
    assert sum(compared) < 4 * 1500**2 / 2 / 8
    monkeypatch.setattr(O, "BUNDLES", ())
    assert [found(cross) for cross in (False, True)] == got
