from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import encode as E
from readlake.operators import extract as X
from readlake.operators import graph as G
from readlake.operators import overlap as O
from readlake.operators import pairs as P
from readlake.operators import profile as R
from readlake.operators import quality as Q
from readlake.operators.align import align, split_align


def reads(spark, n=20, blocks=4):
    return spark.createDataFrame([(0, i % blocks, i, f"r{i}", "ACGT" * (i % 3), "IIII" * (i % 3)) for i in range(n)], "file_idx int, block_idx int, ordinal long, name string, seq string, qual string")


def test_specs():
    assert X.parse_spec("G:3,1,3").value == (1, 3)
    for bad in ("", "X:1", "H:", "H:x", "M:", "G:a", "L:1"):
        with pytest.raises(ValueError):
            X.parse_spec(bad)


def test_head_and_sample(spark):
    r = reads(spark)
    assert X.extract(r, "H:7").count() == 7
    assert X.extract(r, "H:999").count() == 20
    assert X.extract(r, "S:0").count() == 0
    assert X.extract(r, "S:999").count() == 20
    per = {x["block_idx"]: x["count"] for x in X.sample(r, 6).groupBy("block_idx").count().collect()}
    assert per == {0: 2, 1: 2, 2: 1, 3: 1}
    assert X.sample(r, 3).groupBy("block_idx").count().count() == 3
    blocks = R.block_stats(r, "file_idx", "block_idx")
    assert X.head_by_blocks(r, blocks, 7).exceptAll(X.head(r, 7)).count() == 0


def test_pair_modes(spark):
    r = spark.createDataFrame([(0, 1, "a1"), (0, 2, "b1"), (1, 1, "a2"), (1, 2, "a3")], "pair_id long, mate int, name string")
    assert X.match_names(r, "^a").count() == 3
    assert X.match_names(r, "^a", "any").count() == 4
    assert X.match_names(r, "^a", "all").count() == 2


def test_insert_window(spark):
    rng = random.Random(1)
    xs = [rng.randint(-900, 900) for _ in range(301)] + [50_000]
    row = P.insert_window(spark.createDataFrame([(x,) for x in xs], "d long")).first()
    kept = sorted(x for x in xs if abs(x) < 20_000)
    med = kept[len(kept) // 2]
    half = next(1 << p for p in range(2, 32) if sum(abs(x - med) < 1 << p for x in kept) >= int(0.9 * len(kept)))
    assert (row["n"], row["median"], row["half"]) == (301, med, half)
    empty = P.insert_window(spark.createDataFrame([], "d long")).first()
    assert (empty["n"], empty["median"], empty["half"]) == (0, 256, 256)


def test_quality_cuts(spark):
    r = spark.createDataFrame([(i, 0, chr(33 + q) * 5) for i, q in enumerate([1, 2, 3, 10, 11, 12, 30, 31])], "ordinal long, file_idx int, qual string")
    bins = Q.mean_bins(r, "ordinal", "file_idx")
    counts = sorted(x["bin"] for x in bins.collect())
    run, want = 0, []
    for b, g in itertools.groupby(counts):
        run += len(list(g))
        if run > 2 and len(want) < 3:
            want.append(b / 2)
            run -= 2
    assert Q.cuts(bins, "file_idx").first()["cuts"] == want


def test_run_lengths_and_positions(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 5, 7, 7, 7, 5])], "b int, i long, v long")
    got = sorted((r["start"], r["value"], r["length"]) for r in E.run_lengths(df, "v", "i", "b").collect())
    assert got == [(0, 5, 2), (2, 7, 3), (5, 5, 1)]


def test_alignment(spark):
    rng = random.Random(3)
    contig = "".join(rng.choice("ACGT") for _ in range(9000))
    other = "".join(rng.choice("ACGT") for _ in range(500))
    ref = spark.createDataFrame([("a", contig), ("b", other)], "contig string, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    swap = lambda s, at: "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in at else c for i, c in enumerate(s))
    cases = {
        1: contig[4090:4150], 2: rc(contig[0:60]), 3: swap(contig[8940:9000], {3, 30, 58}), 4: swap(contig[100:160], {1, 9, 17, 25, 33, 41, 49, 57}), 5: "N" * 20 + contig[300:340],
        6: other[440:] + contig[:20], 7: other[100:150],
    }
    got = {r["read_id"]: r for r in align(spark.createDataFrame(list(cases.items()), "read_id long, seq string"), ref).collect()}
    assert (got[1]["contig"], got[1]["pos"], got[1]["mis"], got[1]["rev"]) == ("a", 4090, 0, 0)
    assert (got[2]["contig"], got[2]["pos"], got[2]["rev"]) == ("a", 0, 1)
    assert (got[3]["pos"], got[3]["mis"], [m["pos"] for m in got[3]["found"]]) == (8940, 3, [3, 30, 58])
    assert got[4]["mis"] is None and got[5]["mis"] is None and got[6]["mis"] is None
    assert (got[7]["contig"], got[7]["pos"]) == ("b", 100)
    long = spark.createDataFrame([(1, contig[1000:1100] + other[200:300])], "read_id long, seq string")
    parts = {r["seg_start"]: r for r in split_align(long, ref).collect()}
    assert (parts[0]["contig"], parts[0]["pos"], parts[100]["contig"], parts[100]["pos"]) == ("a", 1000, "b", 200)


def brute_align(reads, ref, k=14):
    """read_id -> (stage, mis, contig, pos, rev) by the rules of the stages, seed by seed."""
    places = {}
    for c, s in ref:
        for i in range(0, len(s) - k + 1, 2):
            places.setdefault(s[i : i + k], []).append((c, i))
    text, out = dict(ref), {}
    for r, seq in reads:
        found = []
        for rev, s in enumerate((seq, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            n = len(s)
            count = lambda o: len(places.get(s[o : o + k], ()))  # noqa: B023, E731
            parts = 2 if n < 45 else 3 if n <= 75 else 4
            offs = [o for o in range(n - k + 1) if count(o)]
            rarest = lambda some: min(((count(o), o) for o in some), default=(0, None))[1]  # noqa: B023, E731
            looked = [(2 * rev + p, rarest([o for o in offs if o % 2 == p])) for p in (0, 1)]
            few = [o for o in offs if count(o) < 620]
            looked += [(4 + 2 * rev, rarest([o for o in few if min(o * parts // n, parts - 1) == i])) for i in range(parts)]
            for i, p in itertools.product(range(parts), (0, 1)):
                begin, end = max(0, n // parts - k) + i * n // parts + p, min(n - k, (i + 1) * n // parts - 8)
                looked.append((5 + 2 * rev, next((o for o in range(begin, end + 1, 2) if o in few), None)))
            for stage, o in looked:
                for c, at in places.get(s[o : o + k], ()) if o is not None else ():
                    if 0 <= at - o <= len(text[c]) - n:
                        found.append((stage, sum(a != b for a, b in zip(s, text[c][at - o :])), c, at - o, rev))
        out[r] = min((f for f in found if f[1] <= len(seq) * 8 // 100), default=None)
    return out


def test_stages_of_alignment_and_the_sweep(spark):
    """Repeats and misleading rare seeds: every stage against the rules seed by seed; some reads are found by the sweep alone."""
    rng = random.Random(44)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads, lures = [], []
    home = letters(12_000)
    for i in range(150):
        n = rng.choice([40, 60, 75, 76, 100, 120, 151])
        at = rng.randrange(len(home) - n)
        read = list(home[at : at + n])
        parts = 2 if n < 45 else 3 if n <= 75 else 4
        # mismatches in the middle of parts leave seeds across their ends alone
        for j in rng.sample(range(parts), min(parts, n * 8 // 100)):
            x = (2 * j + 1) * n // (2 * parts)
            read[x] = {"A": "C", "C": "G", "G": "T", "T": "A"}[read[x]]
        read = "".join(read)
        # each spoilt seed exists elsewhere, once, and so is the rarest of its part; true ones are made common
        lures += [letters(1 + rng.randrange(2)) + read[o : o + 14] for o in range(n - 13) if read[o : o + 14] != home[at + o : at + o + 14]]
        reads.append((i, rc(read) if i % 3 == 0 else read))
    reads += [(900, letters(80)), (901, "ACGT" * 20), (902, "A" * 14)]
    ref = [("home", home), ("lures", "".join(lures)), ("again", "".join(letters(1) + home[o : o + 14] for o in range(0, len(home) - 14, 5)))]
    want = brute_align(reads, ref)
    got = align(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(ref, "contig string, seq string")).collect()
    assert {r["read_id"]: (r["mis"], r["contig"], r["pos"], r["rev"]) if r["contig"] else None for r in got} == {r: w and w[1:] for r, w in want.items()}
    stages = [w[0] for w in want.values() if w]
    assert 5 in stages and 7 in stages, sorted(set(stages))


def test_forest_is_the_least_one(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.randint(-9, 9), rng.randint(0, 3), 0, rng.randint(0, 1)) for a, b in itertools.combinations(range(24), 2) if rng.random() < 0.12 and (a < 14) == (b < 14)]
    df = spark.createDataFrame(edges, "src long, dst long, off int, mis int, s_strand int, e_strand int")
    forest, comp = G.spanning_forest(df)
    parent = list(range(24))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for e in sorted(edges, key=lambda e: (abs(e[2]), e[3], e[0], e[1])):
        a, b = find(e[0]), find(e[1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            want.add(e[:2])
    assert {(r["src"], r["dst"]) for r in forest.collect()} == want
    nodes = {x for e in edges for x in e[:2]}
    assert {r["node"]: r["component"] for r in comp.collect()} == {x: find(x) for x in nodes}
    tree = G.layout(forest, comp)
    assert tree.count() == len(nodes) and tree.filter("parent is null").count() == len({find(x) for x in nodes})
    seqs = spark.createDataFrame([(x, "".join(rng.choice("ACGTN") for _ in range(12))) for x in nodes], "read_id long, seq string")
    assert G.rebuild(G.parent_differences(tree, seqs)).exceptAll(seqs).count() == 0


def test_overlaps(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(i, genome[10 * i : 10 * i + 100]) for i in range(5)] + [(5, "".join(rng.choice("ACGT") for _ in range(100))), (6, genome[:100])]
    r = spark.createDataFrame(rows, "read_id long, seq string")
    edges = O.overlap_top2(r)
    got = {(x["src"], x["dst"]): x["off"] for x in edges.collect()}
    assert got[(0, 6)] == 0 and all(abs(v) <= 50 for v in got.values())
    assert [x["read_id"] for x in O.isolated(r, edges).select("read_id").collect()] == [5]


def brute_top2(spark, rows):
    """The two best by all pairs that share a minimizer."""
    df = spark.createDataFrame(rows, "read_id long, seq string")
    scored = O.compared(df, percent=12).cache()
    strict = O.top_neighbours(O.edges(scored, 8))
    full = strict.groupBy("src").count().filter("count >= 2").select("src")
    return {tuple(r) for r in strict.join(full, "src", "left_semi").unionByName(O.top_neighbours(O.edges(scored, 12).join(full, "src", "left_anti"))).collect()}


def test_two_nearest_of_crowded_keys(spark):
    """Equal, nearly equal and shifted reads, repeats inside a read, in one cell and in blocks: as by all pairs."""
    rng = random.Random(31)
    genome = "".join(rng.choice("ACGT") for _ in range(260))
    spoil = lambda s, n: "".join(rng.choice("ACGT") if rng.random() < n / 100 else c for c in s)
    seqs = [genome[:100]] * 30 + [spoil(genome[:100], rng.choice([2, 9, 12])) for _ in range(40)] + [spoil(genome[o : o + rng.choice([80, 100])], 4) for o in range(0, 150, 5)] + ["ACGTTGCA" * 12, "ACGTTGCA" * 11 + "ACG", "A" * 60, "A" * 70]
    seqs += [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs[25:60:4]]
    rng.shuffle(seqs)
    rows = list(enumerate(seqs))
    want = brute_top2(spark, rows)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    for block in (1000, 9):
        assert {tuple(r) for r in O.overlap_top2(df, block=block).collect()} == want
    assert len({w[0] for w in want}) > 90


def test_equal_reads_cost_linear_rows(spark):
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(120))
    few, many = (O.nearest(spark.range(n).select(F.col("id").alias("read_id"), F.lit(seq).alias("seq"))).count() for n in (900, 9000))
    assert many <= 100 * few  # two a read, key and pair of blocks; all pairs would be 40,500 a key


def test_shifted_children_cost_their_overhang(spark):
    """A child that begins later on its parent is stored by what the parent lacks, on either strand."""
    rng = random.Random(10)
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(i, genome[30 * i : 30 * i + 200]) if i % 3 else (i, rc(genome[30 * i : 30 * i + 200])) for i in range(15)]
    r = spark.createDataFrame(rows, "read_id long, seq string")
    diff = G.parent_differences(G.layout(*G.spanning_forest(O.overlap_top2(r))), r)
    sizes = [len(x["diff"]) for x in diff.filter("parent is not null").select("diff").collect()]
    assert len(sizes) > 8 and max(sizes) <= 100
    assert G.rebuild(diff).join(r, ["read_id", "seq"], "left_anti").isEmpty() and G.rebuild(diff).count() == diff.count()


def test_alignment_of_long_reads(spark):
    """Reads longer than any fixed bound, at every place relative to a chunk's border."""
    rng = random.Random(15)
    contig = "".join(rng.choice("ACGT") for _ in range(14_000))
    ref = spark.createDataFrame([("a", contig)], "contig string, seq string")
    cases = {i: contig[at : at + n] for i, (at, n) in enumerate([(0, 600), (100, 600), (3500, 600), (4050, 600), (4096, 600), (8000, 5000), (1, 13_000)])}
    spoiled = list(cases[3])
    spoiled[5], spoiled[300] = ("C" if spoiled[5] != "C" else "G"), ("A" if spoiled[300] != "A" else "T")
    got = {r["read_id"]: (r["pos"], r["mis"], [m["pos"] for m in r["found"]]) for r in align(spark.createDataFrame([*cases.items(), (99, "".join(spoiled))], "read_id long, seq string"), ref).collect()}
    assert got == {0: (0, 0, []), 1: (100, 0, []), 2: (3500, 0, []), 3: (4050, 0, []), 4: (4096, 0, []), 5: (8000, 0, []), 6: (1, 0, []), 99: (4050, 2, [5, 300])}


def test_head_and_sample_of_several_files_and_pairs(spark):
    r = spark.createDataFrame([(f, b, i, f"r{f}{b}{i}") for f in range(3) for b in range(2) for i in range(4)], "file_idx int, block_idx int, ordinal long, name string")
    per = X.sample(r, 7).groupBy("file_idx", "block_idx").count().collect()
    assert len(per) == 6 and sorted(x["count"] for x in per) == [1, 1, 1, 1, 1, 2]
    pairs = spark.createDataFrame([(0, i + m, 10 * i + m, i, m) for i in range(4) for m in (2, 1)], "file_idx int, block_idx int, ordinal long, pair_id long, mate int")
    assert [(x["pair_id"], x["mate"]) for x in X.head(pairs, 5).collect()] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]


def brute_minimizers(seq, k=13, per_read=4):
    def mix(x):
        mask = (1 << 2 * k) - 1
        x = (~x + (x << 21)) & mask
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & mask
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & mask
        x ^= x >> 28
        return (x + (x << 31)) & mask

    code = lambda s: mix(int("".join(str("ACGT".index(c)) for c in s), 4))
    turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    every = [min((code(s[i : i + k]), i, t) for t, s in enumerate((seq, turned))) for i in range(len(seq) - k + 1)]
    w = len(seq) // 2 - k
    if w <= 0:
        return set(every[max(0, (len(every) - per_read) // 2) :][:per_read])
    least = [min(every[i : i + w]) for i in range(len(every) - w + 1)]
    return set([x for i, x in enumerate(least) if not i or x != least[i - 1]][:per_read])


def test_minimizers_are_those_of_every_window(spark):
    rng = random.Random(11)
    seqs = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 5, 12, 13, 14, 20, 26, 27, 28, 29, 40, 63, 100, 333) for letters in ("ACGT", "AC", "A")]
    rows = [*enumerate(seqs), (900, "ACGTN" * 9), (901, None)]
    got = {}
    for r in O.minimizers(spark.createDataFrame(rows, "read_id long, seq string")).collect():
        got.setdefault(r["read_id"], set()).add((r["key"], r["pos"], r["strand"]))
    assert got == {i: brute_minimizers(s) for i, s in enumerate(seqs) if len(s) >= 13}


def test_overlaps_of_common_keys(spark):
    """More equal reads than a key's block still find each other."""
    r = spark.createDataFrame([(i, "ACGGTCATTGCAA") for i in range(1003)], "read_id long, seq string")
    assert O.overlaps(r).filter("off = 0 and mis = 0").count() == 1003 * 1002 // 2
    few = r.filter("read_id < 30")
    assert O.overlaps(few, block=4).exceptAll(O.overlaps(few)).isEmpty() and O.overlaps(few, block=4).count() == 30 * 29 // 2


def test_digests(spark):
    r = reads(spark)
    assert R.block_digest(r, "seq", "xxhash", "block_idx").filter("length(digest) = 32").count() == 4
    assert R.unordered_digest(r, "name", "seq").first() == R.unordered_digest(r.orderBy(F.rand()), "name", "seq").first()


def test_split_align_query_takes_all_reads(spark, tmp_path):
    from readlake.plans.graph_queries import QUERIES

    rng = random.Random(14)
    texts = {i: "".join(rng.choice("ACGT") for _ in range(rng.randint(60, 140))) for i in range(12)}
    rows = [(i, t, "src1", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(1_000_000 + i, 0, len(t), i, 0, 0) for i, t in texts.items()}
    got = QUERIES["split_align"](spark, str(tmp_path)).select("read_id", "seg_start", "seg_len", "contig", "pos", "mis")
    assert {tuple(r) for r in got.collect()} == want


def test_digest_query_equals_xxhash(spark):
    import xxhash

    rows = [(f, b, i, f"s{f}{b}{i}" * i) for f in range(2) for b in range(2) for i in (2, 0, 1)]
    got = R.block_digest(spark.createDataFrame(rows, "file_idx int, block_idx int, ordinal long, seq string"), "seq", "xxhash", "file_idx", "block_idx").collect()
    assert {(r["file_idx"], r["block_idx"]): r["digest"] for r in got} == {(f, b): xxhash.xxh3_128_hexdigest("".join(f"s{f}{b}{i}" * i for i in range(3))) for f in range(2) for b in range(2)}


def test_observed_counts(spark):
    r, seen = R.observed(reads(spark))
    assert r.count() == 20 and seen.get == {"reads": 20, "bases": r.selectExpr("sum(length(seq))").first()[0], "blocks": 4}


def walked(edges, root):
    """node -> (parent, depth, strand, off, as_is) from ``root``, level by level."""
    arcs = {}
    for a, b, off, _, s, e in edges:
        arcs.setdefault(a, []).append((b, off, s, s ^ e))
        arcs.setdefault(b, []).append((a, -off, e, s ^ e))
    out, level = {root: (None, 0, 0, None, None)}, [root]
    while level:
        following = []
        for u in level:
            for v, off, own, flip in arcs[u]:
                if v not in out:
                    out[v] = (u, out[u][1] + 1, out[u][2] ^ flip, off, own == out[u][2])
                    following.append(v)
        level = following
    return out


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_layout_in_few_rounds(spark, monkeypatch, shape):
    """A chain of 4,096 nodes, a hub, a random tree: the walk level by level, in at most 30 rounds."""
    rng = random.Random(14)
    n = {"chain": 4096, "hub": 600, "random": 300}[shape]
    names = rng.sample(range(10 * n), n)
    above = {"chain": lambda i: i - 1, "hub": lambda i: 0, "random": lambda i: rng.randrange(i)}[shape]
    pairs = [(names[i], names[above(i)]) for i in range(1, n)]
    edges = [(*(p if rng.random() < 0.5 else p[::-1]), rng.randint(-9, 9), 0, rng.randint(0, 1), rng.randint(0, 1)) for p in pairs]
    forest = spark.createDataFrame(edges, "src long, dst long, off int, mis int, s_strand int, e_strand int")
    comp = spark.createDataFrame([(x, min(names)) for x in names], "node long, component long")
    cuts, real = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df: cuts.append(1) or real(df))
    got = {r["node"]: (r["parent"], r["depth"], r["strand"], r["off"], r["as_is"]) for r in G.layout(forest, comp).collect()}
    assert got == walked(edges, min(names))
    # a table a round, and four before and after
    assert len(cuts) <= 14 + 5
    if shape == "random":
        cuts.clear()
        tree = spark.createDataFrame([(k, min(names), *v) for k, v in got.items()], "node long, component long, parent long, depth int, strand int, off int, as_is boolean")
        seqs = spark.createDataFrame([(x, "".join(rng.choice("ACGTN.") for _ in range(rng.randint(0, 30)))) for x in names], "read_id long, seq string")
        back = G.rebuild(G.parent_differences(tree, seqs))
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in seqs.collect()}
        assert len(cuts) <= 6


def test_tree_digest(spark):
    """Chunks cut anywhere, values longer than many chunks, empty values and groups, bytes beyond ASCII; the chunk of a changed byte is named."""
    import hashlib

    from readlake.operators import digest as D

    rng = random.Random(5)
    rows = [(f, b, 10 * b + i, "".join(rng.choice("ACGT\u00e9") for _ in range(rng.choice([0, 1, 5, 40, 700])))) for f in range(3) for b in range(3) for i in range(6)] + [(7, 0, 0, ""), (7, 0, 1, None), (8, 0, 0, "AC")]
    df = spark.createDataFrame(rows, "file_idx int, block_idx int, ordinal long, seq string")
    chunks = D.chunk_digests(df, "seq", "file_idx", size=16)
    got = {(r["file_idx"], r["chunk"]): (r["bytes"], r["digest"]) for r in chunks.collect()}
    want, roots = {}, {}
    for f in {r[0] for r in rows}:
        data = b"".join((v or "").encode() for x, _, _, v in sorted(rows, key=lambda r: r[:3]) if x == f)
        level = [hashlib.md5(data[i : i + 16]).hexdigest() for i in range(0, len(data), 16)]
        want |= {(f, i): (len(data[16 * i : 16 * i + 16]), h) for i, h in enumerate(level)}
        n = len(level)
        while len(level) > 1:
            level = [hashlib.md5("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        if level:
            roots[f] = (level[0], n, len(data))
    assert got == want
    assert {r["file_idx"]: (r["digest"], r["chunks"], r["bytes"]) for r in D.tree_digest(chunks, "file_idx", fan=4).collect()} == roots
    spoiled = df.withColumn("seq", F.when((F.col("file_idx") == 1) & (F.col("ordinal") == 11), F.concat(F.lit("N"), F.expr("substr(seq, 2)"))).otherwise(F.col("seq")))
    bad = D.differing_chunks(chunks, D.chunk_digests(spoiled, "seq", "file_idx", size=16), "file_idx", size=16).collect()
    before = sum(len((v or "").encode()) for f, _, o, v in rows if f == 1 and o < 11)
    assert {r["file_idx"] for r in bad} <= {1} and (not bad or min(r["first_byte"] for r in bad) == before // 16 * 16)


def test_table_functions_in_sql(spark):
    """K-mers and minimizers from SQL, partitioned and not, as the DataFrame forms give them."""
    from readlake.functions import tables
    from readlake.functions.packed import packed_kmers

    tables.register(spark)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(rng.choice([0, 5, 30, 200])))) for i in range(40)] + [(50, None)]
    reads = spark.createDataFrame(rows, "read_id long, seq string").repartition(3)
    reads.createOrReplaceTempView("some_reads")
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not b.isEmpty()
    assert same(spark.sql("SELECT * FROM read_kmers(TABLE(some_reads), 12)"), packed_kmers(reads, 12))
    for part in ("", " PARTITION BY (read_id)"):
        assert same(spark.sql(f"SELECT * FROM read_minimizers(TABLE(some_reads){part}, 11)"), O.minimizers(reads, 11))
