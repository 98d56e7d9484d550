"""The jobs: against SQL, over input that grows, files delivered twice, batches repeated, settings."""

from __future__ import annotations

import json
import logging
import os
import random
from dataclasses import asdict
from pathlib import Path

import pytest

from jobs import archive_reads, common, queries, screen_reads

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(queries.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert before == {k: spark.conf.get(k) for k in before}


def documents(n, seed, sources=4):
    rng = random.Random(seed)
    return [(seed * 1000 + i, "".join(rng.choice("acgtn xyz") for _ in range(rng.choice([0, 3, 40, 200]))), "en", f"src{rng.randrange(sources)}", None) for i in range(n)]


def save(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def archive_of(spark, path):
    return sorted(repr(tuple(r)) for r in archive_reads.read_back(spark, str(path)).collect())


@pytest.mark.parametrize("files", [1, 1000])
def test_archive_takes_only_what_is_new(spark, tmp_path, caplog, files):
    """Two runs over growing input give the archive of one run over all of it; untouched files are not written again."""
    caplog.set_level(logging.INFO)
    settings = archive_reads.Settings(max_files_per_batch=files)
    run = lambda to: archive_reads.run(spark, str(tmp_path / "in"), str(tmp_path / to), str(tmp_path / f"{to}-mark"), settings)
    first, second = documents(60, 1), documents(40, 2, sources=2)
    save(spark, first, tmp_path / "in")
    assert run("a")["documents"] == 60
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    assert run("a") == {"source": str(tmp_path / "in"), "archive": str(tmp_path / "a"), "batches": 0, "documents": 0, "added": 0}
    assert stamp == {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    save(spark, second, tmp_path / "in")
    save(spark, first[:20], tmp_path / "in")  # delivered again under another name
    last = run("a")
    assert (last["documents"], last["added"], last["batches"]) == (60, 40, 2 if files == 1 else 1)
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    touched = {f"file_idx={r[3][3:]}" for r in [*second, *first[:20]]}
    assert all(left.get(p) == t for p, t in stamp.items() if p.parts[-3] == "reads" or p.parts[-2] not in touched)
    whole = tmp_path / "all"
    save(spark, [*first, *second], whole)
    archive_reads.run(spark, str(whole), str(tmp_path / "b"), str(tmp_path / "b-mark"))
    assert archive_of(spark, tmp_path / "a") == archive_of(spark, tmp_path / "b") and len(archive_of(spark, tmp_path / "b")) == 100
    assert "documents read" in caplog.text and "reads added" in caplog.text


def test_archive_batch_that_is_repeated(spark, tmp_path):
    """A batch whose commit was lost comes again under its number and leaves the same archive; so does a key that comes twice, and rows without a key."""
    one, two = documents(30, 1), documents(30, 2)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    odd = [(None, "acgt", "en", "src1", 4), (5, "acgt", "en", None, 4), one[0], (one[0][0], "ttt", "en", one[0][3], 3)]
    for name, steps in (("a", [(one + odd, 0), (two, 1)]), ("b", [(one + odd, 0), (one + odd, 0), (two, 1), (two, 1)])):
        for rows, number in steps:
            archive_reads.add(frame(rows), number, str(tmp_path / name), archive_reads.Settings())
    assert archive_of(spark, tmp_path / "a") == archive_of(spark, tmp_path / "b")
    assert len(archive_of(spark, tmp_path / "a")) == 60
    archive_reads.add(frame([]), 0, str(tmp_path / "c"), archive_reads.Settings())
    assert archive_of(spark, tmp_path / "c") == []


def test_screening_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    panel = [(i, letters(60)) for i in range(6)] + [(9, None), (10, ""), (11, "AC")]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(0, i, f"r{i}", letters(100), "I" * 100) for i in range(20)]
    reads += [(1, 100, "part", letters(30) + panel[2][1][10:50] + letters(9), ""), (1, 101, "turned", turn(panel[4][1]), ""), (1, 102, "none", "", ""), (1, 103, "short", panel[0][1][:16], ""), (2, 104, "masked", panel[1][1].replace("A", "N"), "")]
    settings = screen_reads.Settings(k=13, min_hits=10, max_contigs=2)
    kmers = lambda s: {s.replace("N", "A")[i : i + 13] for i in range(len(s) - 12)}
    seeds = {c: kmers(s) | kmers(turn(s)) for c, s in panel if s}
    want = []
    for f, o, name, seq, qual in reads:
        hits = sorted((-len(kmers(seq) & v), c, len(v)) for c, v in seeds.items() if kmers(seq) & v)
        best = hits[0] if hits else (0, None, 1)
        want.append((f, o, name, seq, qual, len(kmers(seq)), best[1], -best[0], -best[0] / best[2], "screened" if -best[0] >= 10 else "clean"))
    got = screen_reads.screened(spark.createDataFrame(reads, "file_idx int, ordinal long, name string, seq string, qual string"), spark.createDataFrame(panel, "contig long, seq string"), settings)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want if w[9] == "screened"} == {"part", "turned", "masked"}


def test_screening_replaces_a_file_that_comes_again(spark, tmp_path):
    docs, more = documents(50, 4), documents(50, 5, sources=2)
    spark.createDataFrame([(1, docs[0][1])], "item_id long, text string").write.parquet(str(tmp_path / "panel"))
    run = lambda where: screen_reads.run(spark, str(tmp_path / where), str(tmp_path / "panel"), str(tmp_path / "out"))
    save(spark, docs, tmp_path / "one")
    first = run("one")
    rows = sorted(map(repr, screen_reads.read_back(spark, str(tmp_path / "out")).collect()))
    assert run("one") == first and rows == sorted(map(repr, screen_reads.read_back(spark, str(tmp_path / "out")).collect())) and first["reads"] == 50
    save(spark, more, tmp_path / "two")
    run("two")
    left = screen_reads.read_back(spark, str(tmp_path / "out"))
    again = {int(r[3][3:]) for r in more}
    assert {r["ordinal"] for r in left.collect()} == {r[0] for r in more} | {r[0] for r in docs if int(r[3][3:]) not in again}


def test_settings(tmp_path):
    for job, name in ((screen_reads, "screen_reads"), (archive_reads, "archive_reads")):
        assert json.loads((ROOT / f"jobs/{name}.json").read_text()) == asdict(job.Settings())
    (tmp_path / "s.json").write_text('{"k": 15}')
    assert common.settings_from(str(tmp_path / "s.json"), screen_reads.Settings()).k == 15
    (tmp_path / "s.json").write_text('{"kk": 15}')
    with pytest.raises(ValueError, match="kk"):
        common.settings_from(str(tmp_path / "s.json"), screen_reads.Settings())
