from __future__ import annotations

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake import api, codec, entropy
from readlake.sources import archive as A
from readlake.sources import fastq as Q
from readlake.streaming.pipes import STATE_STORE, name_columns, name_deltas, name_states, pipe_out, stream_fastq


def fastq(n=50, seed=1, sign="@"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 30, 100])
        q = (rng.choice("@+") + "".join(rng.choice("@+I#") for _ in range(k)))[:k]
        out.append((f"X.{i} {i:03d} length={k}", "".join(rng.choice("ACGTNacgtR") for _ in range(k)), q))
    return out, "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in out)


def got(df):
    return [(r["name"], r["seq"], r["qual"]) for r in df.orderBy("file_idx", "ordinal").collect()]


@pytest.mark.parametrize("size", [64, 100, 1 << 20])
def test_ranges_find_their_records(spark, tmp_path, size):
    rows, text = fastq()
    (tmp_path / "a.fastq").write_text(text)
    assert got(Q.read_fastq(spark, str(tmp_path / "a.fastq"), range_bytes=size)) == rows
    (tmp_path / "b.fastq").write_text(text[:-1])
    assert got(Q.read_fastq(spark, str(tmp_path / "b.fastq"), range_bytes=size)) == rows


def test_gzip_members_lists_and_edges(spark, tmp_path):
    rows, text = fastq(10)
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(text.encode()) + gzip.compress(text.encode()))
    (tmp_path / "b.fq").write_text("")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fastq.gz\n{tmp_path}/b.fq\n\n")
    assert got(Q.read_fastq(spark, f"@{tmp_path}/list")) == rows + rows
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="qualities"):
        Q.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\n")
    with pytest.raises(Exception, match="record"):
        Q.read_fastq(spark, str(tmp_path / "cut.fq")).collect()


def test_pairs(spark, tmp_path):
    (tmp_path / "1.fq").write_text("@a/1\nA\n+\nI\n@b/1\nCC\n+\nII\n")
    (tmp_path / "2.fq").write_text("@a/2\nGGG\n+\nIII\n@b/2\nT\n+\nI\n")
    (tmp_path / "3.fq").write_text("@a/2\nGGG\n+\nIII\n")
    both = api.load_reads(spark, [str(tmp_path / "1.fq"), str(tmp_path / "2.fq")], layout="PE", block_bytes=8)
    assert [(r["pair_id"], r["mate"], r["name"]) for r in both.orderBy("pair_id", "mate").collect()] == [(0, 1, "a/1"), (0, 2, "a/2"), (1, 1, "b/1"), (1, 2, "b/2")]
    with pytest.raises(Q.FormatError):
        Q.read_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "3.fq"))
    Q.write_mates(both, str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "o2").glob("part*"))) == (tmp_path / "2.fq").read_text()


@pytest.mark.parametrize("check", ["none", "md5", "xxhash"])
def test_archive_round_trip(spark, tmp_path, check):
    rows, text = fastq(30)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@c\nACGT\n+c\nIIII\n")
    reads = api.load_reads(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")], layout="MULTI", block_bytes=500)
    arc = str(tmp_path / "arc")
    report = api.encode(spark, reads, arc, check=check, files=["a.fq", "b.fq"])
    assert {r["stream"] for r in report.collect()} == {"name", "seq", "qual", "Total"}
    assert A.verify(spark, arc).isEmpty()
    api.decode(spark, arc, str(tmp_path / "out"))
    back = lambda i: "".join(p.read_text() for p in sorted((tmp_path / "out" / f"file_idx={i}").glob("part*")))
    assert back(0) == text and back(1) == "@c\nACGT\n+c\nIIII\n"
    assert api.extract(spark, arc, "L").count() == 2
    assert api.extract(spark, arc, "G:1").count() == 1
    assert got(api.extract(spark, arc, "H:5")) == rows[:5]
    assert api.extract(spark, arc, "M:^c$").count() == 1
    with pytest.raises(A.ArchiveError):
        A.read_meta(spark, str(tmp_path))


def test_fasta_and_index(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one x\nACGTACGTACGTACGTACGT\nACG\n\n>two\nNNNACGTACGTACGTACGTA\n")
    ref = {r["contig"]: r for r in Q.read_fasta(spark, str(tmp_path / "r.fa")).collect()}
    assert (ref["one"]["seq"], ref["two"]["contig_start"]) == ("ACGTACGTACGTACGTACGTACG", 23)
    for _ in range(2):
        api.build_ref_index(spark, str(tmp_path / "r.fa"), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix/seeds")).filter("kmer like '%N%' or pos % 2 = 1").count() == 0


def test_stream(spark, tmp_path):
    rows, text = fastq(25)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text(text)
    seen: list[str] = []
    q = pipe_out(stream_fastq(spark, str(tmp_path / "in"), bytes_per_batch=700, range_bytes=300), seen.append, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(x.split("\n")[0] for x in seen) == sorted(f"@{a}" for a, _, _ in rows)
    q = name_deltas(stream_fastq(spark, str(tmp_path / "in"), bytes_per_batch=700, range_bytes=300)).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["delta"] for r in spark.table("deltas").orderBy("ordinal").collect()] == [0] + [1] * 24


def test_sketches_of_an_archive(spark, tmp_path):
    """Distinct sequences and quantiles by file and of all, within their bounds, from an archive whose reads are gone; empty and null values."""
    import shutil

    from readlake.operators import sketches as K

    rng = random.Random(12)
    rows = []
    for f, n in ((0, 9000), (1, 1500), (2, 1)):
        pool = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) for _ in range(max(1, n // 2))]
        for i in range(n):
            seq = rng.choice(pool)
            rows.append((f, i // 700, i, f"r{i}", seq, "".join(chr(33 + min(40, int(rng.expovariate(0.1)))) for _ in seq)))
    reads = spark.createDataFrame(rows, "file_idx int, block_idx int, ordinal long, name string, seq string, qual string").repartition(5)
    arc = str(tmp_path / "arc")
    A.write_archive(reads, arc, check="none")
    assert A.block_table(spark, arc).columns == ["file_idx", "block_idx", "read_count", "bases", "onech", "longseq"]
    shutil.rmtree(f"{arc}/reads")
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    by_file = {r["file_idx"]: r for r in api.about(spark, arc, shares=shares).collect()}
    for f, r in [*by_file.items(), (None, api.about(spark, arc, by_file=False, shares=shares).first())]:
        own = [x for x in rows if f is None or x[0] == f]
        distinct = len({x[4] for x in own})
        assert r["reads"] == len(own) and abs(r["about_distinct"] - distinct) <= max(0.05 * distinct, 0)
        means = [sum(map(ord, x[5])) / len(x[5]) for x in own if x[5]]
        for values, found in (([len(x[4]) for x in own], r["length_quantiles"]), (means, r["quality_quantiles"])):
            for q, v in zip(shares, found, strict=True):
                if values:
                    assert sum(x < v for x in values) <= (q + 0.02) * len(values) and sum(x <= v for x in values) >= (q - 0.02) * len(values)
                else:
                    assert v is None
    odd = spark.createDataFrame([(0, None, None), (0, "", ""), (0, "", "")], "b int, seq string, qual string")
    assert K.summary(K.block_sketches(odd, "b"), "b", shares=(0.5,)).first() == (0, 3, 1, [0], [None])
    assert K.summary(K.block_sketches(odd.limit(0), "b"), "b").isEmpty()
    spark.createDataFrame([(0, 0, 1)], "file_idx int, block_idx int, read_count long").write.mode("overwrite").parquet(f"{arc}/blocks")
    with pytest.raises(A.ArchiveError, match="without sketches"):
        api.about(spark, arc)


def test_name_state_over_batches_and_restarts(spark, tmp_path):
    """Formats that alternate, appear late and come back after a restart; numbers of any size, padded ones, names without a token: as the windows over all reads give them."""
    rng = random.Random(19)
    make = lambda f, i: rng.choice([f"SRR{f}.{i} length=90", f"SRR{f}.{i * 3} length=9{i % 7}", f"x:{i % 5}:0{i % 10}/1", "", "word", f"{10**20 + i}", f"M{i}:a{i % 3}"])
    texts = ["".join(f"@{make(f, i)}\nACGT\n+\nIIII\n" for i in range(80)) for f in range(3)]
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seen = []
    try:
        for share in (0.3, 0.7, 1):
            for i, text in enumerate(texts):
                (tmp_path / f"in/{i}.fq").write_text(text[: int(len(text) * share)] if share < 1 else text)
            stream = name_states(stream_fastq(spark, str(tmp_path / "in"), bytes_per_batch=700, range_bytes=300))
            q = stream.writeStream.foreachBatch(lambda df, n: seen.append((n, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
            q.processAllAvailable()
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    order = lambda rows: sorted(rows, key=lambda r: (r["file_idx"], r["ordinal"]))
    batch = Q.read_fastq(spark, str(tmp_path / "in"))
    want = order(name_columns(batch).collect())
    got = order(r for _, b in seen for r in b)
    assert len(seen) > 4 and len(want) == 240 and [tuple(r) for r in got] == [tuple(r) for r in want]


def test_codec(spark):
    rng = random.Random(2)
    for order in (0, 1, 2):
        s = [min(7, int(rng.expovariate(0.7))) for _ in range(3000)]
        data = codec.encode_symbols(s, 8, order)
        assert codec.decode_symbols(data, len(s), 8, order) == s and len(data) < 3000 * 3 / 8
    v = [rng.randint(-(1 << 40), 1 << 40) for _ in range(100)] + [0, -1]
    assert codec.decode_integers(codec.encode_integers(v)) == v
    names = ["SRR1.1 001 length=10", "SRR1.2 002 length=10", "SRR1.10 999 length=7", "odd", "", "SRR1.3 0 x", "é1"]
    assert codec.decode_names(codec.encode_names(names)) == names
    for t in ("", "A", "ACGTN", "NNNacgtRYACGT0123", "T" * 100):
        assert codec.decode_bases(codec.encode_bases(t)) == t
    rows = [(0, 0, i, a, b, c) for i, (a, b, c) in enumerate(fastq(60)[0])] + [(1, 0, i, f"n{i}", "ACGT", "IIHH") for i in range(9)]
    df = spark.createDataFrame(rows, "file_idx int, block_idx int, ordinal long, name string, seq string, qual string").coalesce(1)
    assert codec.decode_reads(codec.encode_reads(df, 16)).exceptAll(df).count() == 0 and codec.decode_reads(codec.encode_reads(df)).count() == len(rows)


@pytest.mark.parametrize("context", ["none", "last", "quality", "joint"])
def test_entropy_coder(context):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 5000, 300_000):
        s = np.minimum(44, rng.geometric(0.25, n) - 1)
        data = entropy.encode(s, 45, context)
        assert (entropy.decode(data, context) == s).all()
        if n == 300_000 and context in ("none", "last"):
            p = np.bincount(s) / n
            p = p[p > 0]
            assert 8 * len(data) < 1.1 * n * -(p * np.log2(p)).sum()
    skewed = np.zeros(10_000, np.int64)
    skewed[::997] = np.arange(len(skewed[::997])) % 900
    assert (entropy.decode(entropy.encode(skewed, 1000, "last"), "last") == skewed).all()


def test_blocks_of_equal_and_ragged_reads(spark, tmp_path):
    """Joint symbols, escapes, letters outside ACGTN, empty reads; a codec of one's own by name."""
    rng = random.Random(8)
    make = lambda n, letters, signs, size: [(f"r.{i}", "".join(rng.choice(letters) for _ in range(k)), "".join(rng.choice(signs) for _ in range(k))) for i in range(n) for k in [size(i)]]
    sets = [make(900, "ACGT", "FFFFF:,#", lambda i: 150), make(200, "ACGTN", "".join(map(chr, range(33, 127))), lambda i: i), make(50, "ACGTNRYacgt", "I5", lambda i: 40), [("e", "", "")], []]
    for rows in sets:
        streams = codec.encode_block(*map(list, zip(*rows, strict=True))) if rows else codec.encode_block([], [], [])
        assert list(zip(*codec.decode_block(streams), strict=True)) == rows
    df = spark.createDataFrame([(0, 0, i, *r) for i, r in enumerate(sets[1])], "file_idx int, block_idx int, ordinal long, name string, seq string, qual string").coalesce(1)
    codec.write_blocks(df, str(tmp_path / "b"))
    assert codec.read_blocks(spark, str(tmp_path / "b")).exceptAll(df).isEmpty()
    codec.register_codec("plain", lambda r: r, lambda r: r)
    codec.write_blocks(df, str(tmp_path / "p"), codec="plain")
    assert codec.read_blocks(spark, str(tmp_path / "p")).count() == df.count()


def test_align_and_reorder_several_files_and_mates(spark, tmp_path):
    rng = random.Random(17)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "r.fa").write_text(f">g\n{genome}\n")
    places = [[10, 700, 1500], [2000, 350]]
    for f, starts in enumerate(places):
        (tmp_path / f"{f}.fq").write_text("".join(f"@x{f}.{i}\n{genome[p : p + 80]}\n+\n{'I' * 80}\n" for i, p in enumerate(starts)))
    reads = api.load_reads(spark, [str(tmp_path / "0.fq"), str(tmp_path / "1.fq")], layout="MULTI")
    api.build_ref_index(spark, str(tmp_path / "r.fa"), str(tmp_path / "ix"))
    stored = api.load_ref_index(spark, str(tmp_path / "ix"))
    for ref in (stored, Q.read_fasta(spark, str(tmp_path / "r.fa"))):
        got = api.align_reads(reads, ref).orderBy("file_idx", "ordinal").collect()
        assert [(r["file_idx"], r["pos"], r["mis"]) for r in got] == [(f, p, 0) for f, s in enumerate(places) for p in s]
    order = api.reordered(reads).groupBy("file_idx").agg({"new_ordinal": "max"}).collect()
    assert {tuple(r) for r in order} == {(0, 2), (1, 1)}
    for m in (1, 2):
        (tmp_path / f"m{m}.fq").write_text("".join(f"@p{i}/{m}\n{genome[p + 100 * m : p + 100 * m + 60 + m]}\n+\n{'I' * (60 + m)}\n" for i, p in enumerate([5, 1200, 25, 1190])))
    pairs = api.load_reads(spark, [str(tmp_path / "m1.fq"), str(tmp_path / "m2.fq")], layout="PE")
    placed = api.align_reads(pairs, stored).collect()
    assert len(placed) == 8 and all(r["pos"] == [5, 1200, 25, 1190][r["pair_id"]] + 100 * r["mate"] for r in placed)
    laid = api.reordered(pairs).orderBy("new_ordinal").collect()
    assert [r["mate"] for r in laid] == [1, 2] * 4 and all(laid[i]["pair_id"] == laid[i + 1]["pair_id"] for i in range(0, 8, 2))


def test_lookups_in_a_stored_index_shuffle_reads_only(spark, tmp_path):
    """Seeds and counts in buckets by k-mer: no exchange over them, also in a session that did not write them; results of the index built on the spot."""
    from readlake.operators.align import align, candidates

    rng = random.Random(23)
    contigs = [(c, "".join(rng.choice("ACGT") for _ in range(5000))) for c in "abc"]
    (tmp_path / "r.fa").write_text("".join(f">{c}\n{s}\n" for c, s in contigs))
    path = str(tmp_path / "it's an index")
    api.build_ref_index(spark, str(tmp_path / "r.fa"), path, seeds_per_bucket=1000)
    files = sorted((p.name, p.stat().st_mtime_ns) for p in tmp_path.rglob("*.parquet"))
    assert len([p for p in (tmp_path / "it's an index/seeds").glob("*.parquet")]) == 8
    api.build_ref_index(spark, str(tmp_path / "r.fa"), path, seeds_per_bucket=1000)  # is there already
    assert files == sorted((p.name, p.stat().st_mtime_ns) for p in tmp_path.rglob("*.parquet"))
    reads = [(i, s[at : at + 90]) for i, (_, s) in enumerate(contigs * 10) for at in [rng.randrange(4900)]] + [(99, "ACGT" * 20)]
    fresh = spark.newSession()
    other = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.enabled": "false"}
    for key, value in other.items():
        fresh.conf.set(key, value)
    index = api.load_ref_index(fresh, path)
    df = fresh.createDataFrame(reads, "read_id long, seq string")
    found = candidates(df, index.ref, index.k, (index.seeds, index.counts.select("kmer", "n")))
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, x in enumerate(plan) if "FileScan" in x and "kmer" in x]
    assert len(scans) == 2
    depth_of = lambda x: len(re.match("[ :+-]*", x)[0])
    for i in scans:  # up from the scan to its join there are filters, sorts and projections
        depth, way = depth_of(plan[i]), []
        for x in reversed(plan[:i]):
            if depth_of(x) < depth:
                way.append(x)
                depth = depth_of(x)
                if "Join" in x:
                    break
        assert "SortMergeJoin" in way[-1] and not any("Exchange" in x for x in way), way
    got = align(df, index.ref, index.k, index=(index.seeds, index.counts.select("kmer", "n"))).collect()
    assert {r["read_id"]: r for r in got} == {r["read_id"]: r for r in align(df, fresh.createDataFrame(contigs, "contig string, seq string")).collect()}
    assert sum(r["mis"] == 0 for r in got) == 30
    (tmp_path / "r.fa").write_text(f">d\n{contigs[1][1][:100]}\n")
    api.build_ref_index(spark, str(tmp_path / "r.fa"), path, mode="overwrite")  # another reference, one bucket
    assert api.load_ref_index(fresh, path).seeds.count() == 44


def test_stream_of_gzip_files(spark, tmp_path):
    rows, text = fastq(25)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "in/b.fq").write_text("@last\nACG\n+\nIII\n")
    q = stream_fastq(spark, str(tmp_path / "in"), bytes_per_batch=700, range_bytes=300).writeStream.format("memory").queryName("zipped").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("zipped")) == [*rows, ("last", "ACG", "III")]


def slow_records(text):
    """(ordinal, name, seq, comment, qual) line by line."""
    out, at, lines = [], 0, text.split("\n")
    for i in range(0, len(lines) // 4 * 4, 4):
        a, b, c, d = lines[i : i + 4]
        out.append((at, a[1:], b, c[1:], d))
        at += sum(map(len, (a, b, c, d))) + 4
    return out


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("file_idx", "ordinal", "name", "seq", "comment", "qual"))).collect())


def test_stream_over_growing_files(spark, tmp_path):
    """Ten files that grow in the middle of records, over restarts: the rows of the batch source, each once; the driver opens no record."""
    rng = random.Random(21)
    texts = [fastq(30, seed)[1] for seed in range(10)]
    (tmp_path / "in").mkdir()
    seen, opened = [], []
    real = Q._batches

    def run():
        q = stream_fastq(spark, str(tmp_path / "in"), bytes_per_batch=4000, range_bytes=700).writeStream.foreachBatch(lambda df, n: seen.append((n, rows_of(df)))).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()

    Q._batches = lambda part: opened.append(part) or real(part)  # in this process, the driver's
    try:
        have = [0] * 10
        for step in range(4):
            for i, text in enumerate(texts):
                if step == 0 and i % 2:  # appear later, some names between those already seen
                    continue
                have[i] = len(text) if step == 3 else rng.randint(have[i], len(text))
                (tmp_path / f"in/{i}.fq").write_text(text[: have[i]])
            run()
    finally:
        Q._batches = real
    batches = [r for _, r in seen]
    number = {name: i for r in batches for i, _, name, *_ in r}
    got = sorted(x[1:] for r in batches for x in r)
    assert got == sorted(x for t in texts for x in slow_records(t)) and not opened
    assert len({n for n, _ in seen}) == len(seen) > 6 and set(number.values()) == set(range(10))
    first = [texts[i] for i in (0, 2, 4, 6, 8)]
    for i, text in enumerate(first):  # files keep the numbers they were first seen by
        assert {x[0] for r in batches for x in r if x[1:] in set(slow_records(text))} >= {i}


def test_filters_and_columns_in_the_source(spark, tmp_path):
    """Files that are not asked for are not opened; names are tested in the source; a query leaves nothing behind for the next."""
    for i in range(4):
        (tmp_path / f"{i}.fq").write_text(fastq(10, i)[1] if i in (1, 3) else "this is no read file at all\n")
    with pytest.raises(Exception, match="record"):
        Q.read_fastq(spark, str(tmp_path)).count()
    good = Q.read_fastq(spark, str(tmp_path), files=[3, 1])
    rows = rows_of(good)
    assert good.rdd.getNumPartitions() == 2 and [r[0] for r in rows] == [1] * 10 + [3] * 10
    assert good.filter("file_idx = 3").count() == 10 and good.count() == 20
    assert rows_of(api.extract_files(spark, str(tmp_path), "G:3,1")) == rows
    for test, keep in ((("equals", "X.3 003 length=30"), lambda n: n == "X.3 003 length=30"), (("starts", "X.1"), lambda n: n.startswith("X.1")), (("ends", "=1"), lambda n: n.endswith("=1")), (("contains", "00"), lambda n: "00" in n)):
        assert rows_of(Q.read_fastq(spark, str(tmp_path), files=[1, 3], name=test)) == [r for r in rows if keep(r[2])]
    some = Q.read_fastq(spark, str(tmp_path / "1.fq"), columns=["seq", "file_idx"])
    assert some.columns == ["seq", "file_idx"] and rows_of(some, "seq") == sorted((r[3],) for r in rows if r[0] == 1)


@pytest.mark.parametrize("size", [1, 37, 500, 1 << 20])
def test_blocks_of_the_parser(tmp_path, size, monkeypatch):
    """Whatever is read at once: carriage returns, bytes beyond ASCII, no last line end, blank lines at the end, errors by place."""
    import io

    monkeypatch.setattr(Q, "BLOCK_BYTES", size)
    text = fastq(20)[1] + "@\xe9\nAC\n+\xe9\n@@\n"
    raw = text.encode("latin-1")
    take = lambda data: [tuple(r.values()) for b, _ in Q.parsed(io.BytesIO(data), 0, "x") for r in b.to_pylist()]
    want = slow_records(text)
    assert take(raw) == take(raw[:-1]) == take(raw + b"\n\n \n") == want
    assert [r[1:] for r in take(raw.replace(b"\n", b"\r\n"))] == [r[1:] for r in want]
    assert take(b"") == [] and take(b"\n") == []
    for data, words in ((raw + b"@a\nAC\n+\nI\n", "1 qualities at byte"), (raw + b"@a\nAC\n", "no record at byte"), (raw + b"\n" + raw, "empty line at byte"), (raw + b"x\nAC\n+\nII\n", "no record at byte")):
        with pytest.raises(Q.FormatError, match=f"{words} {len(raw)}" if "qual" not in words else words):
            take(data)


def test_gzip_of_many_members(spark, tmp_path):
    """64 members that cut records anywhere: 64 tasks, the rows and ordinals of one."""
    text = "".join(f"@r{i} @x\n{'ACGT' * (i % 60)}\n+\n{'@I+F' * (i % 60)}\n" for i in range(3000))
    raw = text.encode()
    rng = random.Random(9)
    cuts = sorted(rng.sample(range(1, len(raw)), 63))
    members = [gzip.compress(raw[a:b], 1) for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    (tmp_path / "m.fq.gz").write_bytes(b"".join(members))
    whole = Q.read_fastq(spark, str(tmp_path / "m.fq.gz"))
    assert whole.rdd.getNumPartitions() == 1 and [r[1:] for r in rows_of(whole)] == slow_records(text)
    least = min(map(len, members))
    split = Q.read_fastq(spark, str(tmp_path / "m.fq.gz"), range_bytes=max(1, least // 2), split_gzip=True)
    assert split.rdd.getNumPartitions() == 64 and rows_of(split) == rows_of(whole)
    some = Q.read_fastq(spark, str(tmp_path / "m.fq.gz"), range_bytes=5 * least, split_gzip=True)
    assert 1 < some.rdd.getNumPartitions() < 64 and rows_of(some) == rows_of(whole)
    assert Q.gzip_members(spark, []) == {}


def test_mates_are_written_together_or_not_at_all(spark, tmp_path):
    rows = [(i, m, f"p{i}/{m}", "ACGT"[: 1 + i % 4], "IIII"[: 1 + i % 4]) for i in range(200) for m in (1, 2)]
    frame = lambda r: spark.createDataFrame(r, "pair_id long, mate int, name string, seq string, qual string").repartition(4)
    one, two = tmp_path / "one", tmp_path / "two"
    files = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and "part" in p.name)
    with pytest.raises(Exception, match="200 reads of the first mate and 199"):
        Q.write_mates(frame(rows[:-1]), str(one), str(two))
    assert files() == []
    broken = frame(rows).withColumn("seq", F.when(F.col("pair_id") == 150, F.raise_error(F.lit("task fails")).cast("string")).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="task fails"):
        Q.write_mates(broken, str(one), str(two), mode="overwrite")
    assert files() == []
    Q.write_mates(frame(rows), str(one), str(two), mode="overwrite")
    for m, folder in ((1, one), (2, two)):
        text = "".join(p.read_text() for p in sorted(folder.glob("part*")))
        assert text == "".join(f"@{n}\n{s}\n+\n{q}\n" for _, mate, n, s, q in rows if mate == m)
    with pytest.raises(FileExistsError):
        Q.write_mates(frame(rows), str(one), str(two))
    before = files()
    with pytest.raises(Exception, match="first mate"):
        Q.write_mates(frame(rows[1:]), str(one), str(two), mode="overwrite")
    assert files() == before and not list(tmp_path.rglob("_temporary"))


@pytest.mark.parametrize("size", [1, 61, 700, 1 << 20])
def test_fasta_in_chunks(spark, tmp_path, size):
    """Contigs of one line and of many, blank lines, carriage returns, contigs without bases, ranges that cut headers: chunks and seeds of the whole sequences."""
    from readlake.operators.align import align, fetch, lengths
    from readlake.operators.index import seeds

    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(n))
    if size == 1:  # every byte a range
        contigs, chunk = [("a", "ACGTACGTAC"), ("b", ""), ("c", "TTGCA")], 4
    else:
        contigs, chunk = [("one", letters(9000)), ("two", letters(30)), ("none", ""), ("line", letters(5000)), ("last", letters(4096 * 2))], 4096
    text = ""
    for name, seq in contigs:
        wide = 60 if name != "line" else 10**6
        end = "\r\n" if name == "two" else "\n"
        text += f">{name} about > it{end}" + "".join(seq[i : i + wide] + end for i in range(0, len(seq), wide)) + ("\n" if name == "one" else "")
    (tmp_path / "r.fa").write_bytes(text.rstrip("\n").encode())
    found = Q.read_fasta_chunks(spark, str(tmp_path / "r.fa"), range_bytes=size, chunk=chunk)
    start, want = 0, []
    for name, seq in contigs:
        want += [(name, start, i // chunk, seq[i : i + chunk], seq[i + chunk : i + chunk + Q.AHEAD]) for i in range(0, len(seq), chunk)]
        start += len(seq)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    if chunk == 4096:
        whole = spark.createDataFrame(contigs, "contig string, seq string")
        for k in (14, 20):
            assert rows_of(seeds(found, k), "contig", "pos", "kmer") == rows_of(seeds(whole, k), "contig", "pos", "kmer")
        assert {tuple(r) for r in lengths(found).collect()} == {(c, len(q)) for c, q in contigs if q}
    if size == 700:
        reads = spark.createDataFrame([(1, contigs[0][1][4060:4160].replace("N", "A")), (2, contigs[3][1][100:180].replace("N", "A"))], "read_id long, seq string")
        assert align(reads, found).exceptAll(align(reads, whole)).isEmpty() and align(reads, found).filter("mis is null").isEmpty()
        assert fetch(spark.createDataFrame([("one", 4090, 50)], "contig string, pos int, len int"), found).first()["bases"] == contigs[0][1][4090:4140]
