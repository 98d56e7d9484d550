from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readlake.llm import embedding_dedup, near_dedup, simhash, substring_dedup
from readlake.llm.components import block_cells, components
from readlake.llm.exact_dedup import drop_exact_copies, exact_dedup
from readlake.llm.sharding import OVERFULL, sharded, splitters_of

#: Columns that clash with names used inside.
EXTRA = "doc_id long, text string, n long, key string, kept string, part string, node string, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", "x", "p", None, "b") for i, t in rows], EXTRA)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "   "), (7, "é" * 5), (8, "x " * 200_000), (8, "x " * 200_000), (None, "ab"), (None, "only"), (None, "only"), (9, "\x0b\x1cq")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i if i is not None else 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("bits,rows_per_bucket", [(64, 1_000_000), (2, 1), (64, 2)])
def test_exact(spark, bits, rows_per_bucket):
    got = exact_dedup(docs(spark, ROWS), key_bits=bits, bucket_rows=rows_per_bucket).collect()
    want = brute_exact(ROWS)
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(want)
    seen = {(r["keep_id"], r["group_size"]) for r in got}
    assert seen == set(want.values())
    for r in got:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    if bits == 2:
        assert max(r["chain"] for r in got) > 1


def test_exact_directory_splits(spark):
    d = docs(spark, [(i, f"text {i}") for i in range(200)])
    recs = exact_dedup(d, bucket_rows=4)
    fill = recs.groupBy("bucket").count().collect()
    assert len(fill) > 20 and max(r["count"] for r in fill) <= 4 and recs.count() == 200


def test_exact_empty_and_drop(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    left = drop_exact_copies(docs(spark, ROWS))
    assert left.columns == docs(spark, []).columns
    got = left.collect()
    assert len(got) == len(brute_exact(ROWS)) and sum(r["doc_id"] == 8 for r in got) == 1


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, law):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 300)) for i in range(900)] + [(1000 + i, "copy " * 20) for i in range(500)] + [(None, None), (7, None), (7, None)]
    got = sharded(docs(spark, rows), 16, law=law).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    sizes = [sum(r["size"] for r in v) if law == "bytes" else len(v) for v in by.values()]
    mean = sum(sizes) / 16
    assert max(sizes) - min(sizes) <= (2 * (301 + 0.02 * mean) if law == "bytes" else 1)
    assert sharded(docs(spark, []), 16).count() == 0
    assert sharded(docs(spark, [(1, "a"), (2, None)]), 16).count() == 2


def fp(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_texts(rng, n, edits):
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(1, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            out.append("  ".join(copy))
    return out


def test_simhash(spark):
    rng = random.Random(4)
    rows = list(enumerate(near_texts(rng, 60, 2))) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "Two words"), (905, "one"), (905, "one"), (None, "one"), (None, "lonely text here now")]
    got = simhash.simhash_classes(docs(spark, rows), block=8).collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(fp(t, 3), []).append(i)
    keys = list(prints)
    own = {k: min((i for i in v if i is not None), default=None) for k, v in prints.items()}
    links = [(own[a], own[b]) for x, a in enumerate(keys) for b in keys[:x] if bin(a ^ b).count("1") <= 3 and own[a] is not None and own[b] is not None]
    root = roots([v for v in own.values() if v is not None], links)
    want = sorted(((i, k if k < 1 << 63 else k - (1 << 64), root.get(own[k])) for k, v in prints.items() for i in v), key=repr)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=repr) == want
    assert simhash.simhash_classes(docs(spark, [])).count() == 0


def test_plan_covers_every_pair():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for tau, n in ((3, 1000), (3, 10**9), (9, 10**5), (9, 10**8)):
        parts = simhash.plan(sample, n, tau)
        assert sorted(b for g, _ in parts for b in g) == sorted({b for g, _ in parts for b in g})
        m_sum = sum(t + 1 for _, t in parts)
        assert m_sum == tau + 1


def test_near_dedup(spark):
    rng, block = random.Random(8), 3
    rows = list(enumerate(near_texts(rng, 40, 4))) + [(800, None), (801, ""), (802, "short"), (803, "Short"), (None, "short")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None and w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    want = {i: r for i, r in root.items() if sum(x == r for x in root.values()) > 1}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(docs(spark, rows), block=block).collect()}
    assert got == want and len(want) > 20
    left = near_dedup.drop_near_copies(docs(spark, rows), block=block)
    assert left.count() == len(rows) - sum(i != r for i, r in want.items()) and left.columns == docs(spark, []).columns
    assert near_dedup.near_classes(docs(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    named = docs(spark, [(1, text), (2, text), (3, "other words")]).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {tuple(r) for r in near_dedup.near_classes(named).collect()} == {("id1", "id1"), ("id2", "id1")}
    assert sharded(named, 2).count() == 3


def test_no_text_is_lost_with_another_of_its_id(spark):
    """Rows of one id and different texts are judged apart; repeated rows, null ids and clashing columns stay as they are."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (5, text + " more"), (5, "a text unlike any other"), (6, None), (6, ""), (None, text), (7, "twice the same row here"), (7, "twice the same row here")]
    left = near_dedup.drop_near_copies(docs(spark, rows).withColumn("node", F.lit(1)).withColumn("_gone", F.lit("x")).withColumn("component", F.lit(2)))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([r for r in rows if r != (5, text + " more")], key=repr)
    # the same rows as a hot id: nothing multiplies
    many = docs(spark, [(1, text), (2, text + " end")] + [(9, text + " tail")] * 300)
    assert {r["doc_id"] for r in near_dedup.drop_near_copies(many).collect()} == {1}
    nul = [("a\x00b", "c"), ("a", "b\x00c"), ("1", "1:x"), ("1:1", "x")]
    named = spark.createDataFrame(nul, "doc_id string, text string")
    assert drop_exact_copies(named).count() == 4


def test_near_dedup_members_far_from_the_centre(spark):
    """A chain: each text is near the next, the last ones far from the first; copies of the first are many."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[8 * i : 8 * i + 100]) for i in range(12)]
    rows = list(enumerate(chain)) + [(100 + i, chain[0] + f" x{i}") for i in range(40)]
    for block in (4, 512):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(docs(spark, rows), block=block).collect()}
        assert got == {i: 0 for i, _ in rows}


def test_near_dedup_finds_cut_and_extended_copies(spark):
    """Copies that lose or gain all their words at one end, just above the similarity."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    own = [[word() for _ in range(n)] for n in [rng.randint(60, 300) for _ in range(60)] + [1200, 2040, 2400]]
    rows = []
    for i, words in enumerate(own):
        keep = len(words) - 4 - int((len(words) - 4) * 0.19)
        more = [word() for _ in range(int((len(words) - 4) * 0.24))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[: keep + 4])), (1000 + i, " ".join(words + more))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert got == {d: 3 * i for i in range(len(own)) for d in (3 * i, 3 * i + 1, 1000 + i)}


def test_prefix_links_by_blocks(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 3, 60 + i % 3))) for i in range(40)] + [(90 + i, f"other {i}") for i in range(5)]
    sets = [(i, near_dedup._set(t.encode())) for i, t in rows]
    signs = spark.createDataFrame([(i, len(s), s[: near_dedup.prefix_sizes(len(s), 0.8)[1]].tobytes(), near_dedup.class_counts(s)) for i, s in sets], "node long, n long, prefix binary, counts binary")
    for block in (6, 10_000):
        found = components(near_dedup.prefix_links(signs, 0.8, block=block)).collect()
        assert {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(40)}


def test_components_and_cells(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    nodes = {x for e in links for x in e} | {1}
    assert {r["node"]: r["component"] for r in components(df).collect()} == roots(nodes, links)
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(1, 99)], "g long, id long")
    cells = defaultdict(set)
    for r in block_cells(rows, ["g"], "id", 8).collect():
        cells[r["g"], r["i"], r["j"]].add(r["id"])
    assert all(any({a, b} <= c for c in cells.values()) for a in range(50) for b in range(a)) and max(map(len, cells.values())) < 40


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.08 * rng.standard_normal(16)]) for i in range(300)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None, 1.0]), (506, []), (None, rows[1][1]), (507, [1e300] * 16), (508, [1e-300] * 16), (509, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, node string, weight string")
    got = {r["vec_id"]: r for r in embedding_dedup.cosine_classes(df, block=16).collect()}
    good = {i: np.array(v) / np.abs(np.array(v)).max() for i, v in rows if i is not None and v and len(v) in (2, 16) and None not in v and np.isfinite(v).all() and any(v)}
    good = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    found = sum(r["n_links"] for r in got.values()) / 2
    assert found <= len(links) and found >= 0.97 * len(links) > 100
    root = roots(good, links)
    assert np.mean([got[i]["component_id"] == root[i] for i in good]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (502, 503, 504, 505, 506)) and got[500]["n_links"] >= 2 and got[None]["n_links"] == 0
    assert embedding_dedup.cosine_classes(df.limit(0)).count() == 0


def test_substrings(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    passage = " ".join(sentence(9) for _ in range(7))
    line = sentence(12)
    rows = [(i, f"{sentence(10)} {sentence(11)}\n{line}\n{sentence(15)}") for i in range(30)]
    rows[3] = (3, f"{sentence(8)} {passage} {sentence(9)}")
    rows[7] = (7, f"{sentence(8)}\n{passage.upper()}\n{sentence(9)}")
    rows[9] = (9, f"{passage}\n{sentence(9)}\n{passage}")
    rows += [(100, None), (101, ""), (None, passage), (102, "x")]
    d = docs(spark, rows)
    spans = substring_dedup.repeated_spans(d)
    got = sorted((r["doc_id"], r["start"], r["stop"], r["kept_in"]) for r in spans.collect())
    text = dict(rows)
    assert [(i, k) for i, _, _, k in got] == [(7, 3), (9, 3), (9, 3)]
    assert text[7][got[0][1] : got[0][2]].strip().lower() == passage
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut(d, spans).collect()}
    assert passage not in left[9] and passage in left[3] and left[100] is None and left[5] == text[5] and left[None] == passage
    assert substring_dedup.repeated_spans(docs(spark, [])).count() == 0


def test_passages_across_unit_borders(spark):
    """Repeated passages with no sentence end of their own, glued to other text, are removed word for word; so are repeated lines where they are asked for."""
    rng = random.Random(16)
    fresh = iter(f"w{i}x" for i in range(100_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        passage, head = own(rng.randint(50, 140)), own(rng.randint(1, 60))
        rows += [(i, f"{own(rng.randint(1, 60))} {passage} {own(rng.randint(1, 60))}"), (100 + i, f"{head} {passage.upper()} {own(7)}")]
        want.add((100 + i, len(head) + 1, len(head) + len(passage) + 2, len(passage.split()), i))
    line, a, b = own(5), own(12), own(12)
    rows += [(300, f"{own(9)}\n{line}\n{own(9)}"), (301, f"{line}\n{own(9)}"), (400, f"{a}. Yes it. {b}."), (401, f"{a}. No way. {b}."), (500, " ".join(["again"] * 300)), (501, own(60))]
    d = docs(spark, rows)
    plain = {tuple(r) for r in substring_dedup.repeated_spans(d).select("doc_id", "start", "stop", "words", "kept_in").collect()}
    text = dict(rows)
    assert plain == want | {(500, 25 * 6, len(text[500]), 275, 500)}
    lines = {tuple(r) for r in substring_dedup.repeated_spans(d, line_words=4).select("doc_id", "start", "stop", "words", "kept_in").collect()}
    assert lines - plain == {(301, 0, len(line) + 1, 5, 300)} and plain <= lines


def test_rows_that_share_an_id_keep_their_own_text(spark):
    """Each row loses its own spans only, whatever other rows of its doc_id hold."""
    rng = random.Random(21)
    fresh = iter(f"v{i}q" for i in range(100_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    passage = own(70)
    rows = [(1, f"{own(9)} {passage}"), (2, f"{passage} {own(9)}"), (2, own(60)), (2, own(5)), (3, passage), (3, passage), (None, passage), (4, None), (4, "")]
    d = docs(spark, rows).withColumnRenamed("part", "_cuts").withColumnRenamed("node", "_cut_id").withColumnRenamed("bucket", "c0")
    left = sorted((repr(r["doc_id"]), repr(r["text"])) for r in substring_dedup.cut(d, substring_dedup.repeated_spans(d)).collect())
    want = [(1, rows[0][1]), (2, rows[1][1][len(passage) + 1 :]), (2, rows[2][1]), (2, rows[3][1]), (3, ""), (3, ""), (None, passage), (4, None), (4, "")]
    assert left == sorted((repr(i), repr(t)) for i, t in want)


def test_exact_drop_keeps_one_row_of_each_class(spark):
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (3, "c"), (3, "c"), (None, "c"), (None, "d"), (None, "d"), (4, None), (5, " ")]
    d = docs(spark, rows).withColumnRenamed("part", "_own").withColumnRenamed("node", "sha").withColumnRenamed("bucket", "row")
    left = drop_exact_copies(d)
    assert left.columns == d.columns
    assert sorted((repr(r["doc_id"]), r["text"]) for r in left.collect()) == sorted((repr(i), t) for i, t in [(1, "a b"), (3, "c"), (None, "d"), (5, " ")])


def test_exact_index_has_buckets_at_its_own_parameters(spark):
    """More entries than a bucket holds: buckets in key order, each within its bound, chains compare bytes."""
    d = docs(spark, [(i, f"text {i % 1500}") for i in range(1700)])
    got = exact_dedup(d).groupBy("bucket").agg({"text_sha256": "count"}).count()
    assert got > 2


def test_sharding_equals_brute_force(spark):
    """Records in order of (hash of the text, id), cut where a shard's share of the bytes begins; a small group of equal texts goes whole to the later shard."""
    rng = random.Random(31)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 400)))) for i in range(700)] + [(2000 + i, "same text again") for i in range(40)] + [(3000, None), (3001, "z" * 90_000)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), i, len((t or "").encode()) + 1) for i, t in rows)
    total, at, starts = sum(s for *_, s in order), 0, {}
    for k, (_, _, size) in enumerate(order):
        starts.setdefault(min(15, at * 16 // total), k)
        at += size
    bounds = [starts.get(s, len(order)) for s in range(16)]
    for s, k in enumerate(bounds):
        group = [j for j, o in enumerate(order) if k < len(order) and o[0] == order[k][0]]
        if group and sum(order[j][2] for j in group) <= 0.01 * total / 16:
            bounds[s] = group[0]
    for s in range(14, -1, -1):
        bounds[s] = min(bounds[s], bounds[s + 1])
    bounds[0] = 0
    want = {}
    for k, (_, i, _) in enumerate(order):
        shard = max(s for s in range(16) if bounds[s] <= k)
        want[i] = (shard, k - bounds[shard])
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharded(docs(spark, rows), 16).collect()} == want


def test_repeated_lines_equal_brute_force(spark):
    """With ``line_words``, a line of so many words is marked wherever an earlier document holds it, or the same one before."""
    rng = random.Random(33)
    pool = [" ".join(rng.choice(["red", "blue", "green", "tall", "small", "river"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for i in range(80)}
    seen, want = {}, {i: set() for i in texts}
    for i in sorted(texts):
        at = 0
        for line in texts[i].split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) >= 4 and key in seen:
                want[i] |= set(range(at, at + len(line)))
            seen.setdefault(key, i)
            at += len(line) + 1
    got = {i: set() for i in texts}
    for r in substring_dedup.repeated_spans(docs(spark, list(texts.items())), line_words=4).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    letters = lambda i, at: {x for x in at if x < len(texts[i]) and texts[i][x] != "\n"}
    for i in texts:
        # windows and runs of 25 words may take more, never less; nothing that occurs for the first time
        assert want[i] <= letters(i, got[i])
        extra = letters(i, got[i]) - want[i]
        assert all(len(line.split()) < 4 or not extra & set(range(at, at + len(line))) for at, line in _lines(texts[i]))


def _lines(text):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def test_sharding_divides_rows_alike_in_text_and_id(spark):
    """A third of all rows without an id and with one text: no range holds them all, no shard either."""
    same = spark.range(50_000).selectExpr("cast(null as bigint) as doc_id", "'one text' as text")
    df = same.unionByName(spark.range(100_000).selectExpr("id as doc_id", "concat('text ', id) as text")).repartition(6)
    weighed = df.selectExpr("xxhash64(text) as h", "coalesce(doc_id, -1) as o", "monotonically_increasing_id() as row", "cast(length(text) + 1 as bigint) as w").cache()
    total = weighed.agg({"w": "sum"}).first()[0]
    splitters, sums = splitters_of(weighed, total, 64)
    assert sum(n for n, _ in sums.values()) == 150_000 and sum(w for _, w in sums.values()) == total
    assert max(w for _, w in sums.values()) <= OVERFULL * total / 64 and splitters == sorted(set(splitters))
    got = sharded(df, 16).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count", "*": "count"}).collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(got) == 16 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16 and all(r["max(slot)"] == r["count(1)"] - 1 for r in got)
    assert sum(r["count(1)"] for r in got) == 150_000 and sum(r["count(doc_id)"] for r in got) == 100_000
