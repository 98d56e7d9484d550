"""Vector operators against brute force: permutation index and integer codes."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import permutation_index, vector_codes
from readlake.llm.queries import op11_permutation_index

ODD = [(None, [1.0, 0.0, 0.0, 0.0]), (900, None), (901, [float("nan"), 1.0, 1.0, 1.0]), (902, [None, 1.0, 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0, 1.0]), (904, []), (905, [0.0] * 4)]


def table(spark, rows, kind="double", label="int"):
    """With columns that clash with names used inside."""
    full = [(i, v, (None if i is None or i % 5 == 0 else i % 3), "b", None, 7) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, label {label}, band string, q string, n int")


def brute_neighbours(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)})
    out = {}
    for i, v in (r for r in rows if r[0] % every == 0):
        scored = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def by_query(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_neighbours_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(60)] + [(3, rows[3][1]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [5.0])] + ODD
    got = by_query(permutation_index.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    want = brute_neighbours(rows, 20, 20)
    assert 320 not in got  # nothing of its length
    assert {q: [(j, s) for _, j, s in v] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert all([r for r, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    assert permutation_index.neighbours(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation_index.neighbours(table(spark, ODD), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall_norms_and_hot_vector(spark):
    """Segments, norms over five decades, a third of all rows alike: recall of 0.9, exact scores, ties by id."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2400, 24)) * 10 ** rng.uniform(-2, 0.5, (2400, 1))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    got = by_query(permutation_index.neighbours(table(spark, rows, "float"), F.col("vec_id") % 50 == 0, k=20, least=64))
    exact = np.array([v for _, v in rows])
    hits = 0
    assert set(got) == set(range(0, 2400, 50))
    for q, found in got.items():
        s = exact @ exact[q]
        s[q] = -np.inf
        assert len(found) == 20 and all(abs(v - s[j]) <= 1e-9 * max(1, abs(s[j])) for _, j, v in found)
        assert found == sorted(found, key=lambda r: (-r[2], r[1])) and len({j for _, j, _ in found}) == 20
        best = np.sort(s)[-20]
        hits += sum(v >= best - 1e-9 for _, _, v in found)
    assert hits >= 0.9 * 20 * len(got)


def test_pivots_are_spread():
    rng = np.random.default_rng(8)
    x = permutation_index._unit(np.concatenate([np.ones(24) + 0.1 * rng.standard_normal((300, 24)), rng.standard_normal((100, 24))]))
    got = permutation_index.spread(x, 40)
    crowd = (got @ permutation_index._unit(np.ones((1, 24))).T > 0.9).sum()
    assert len(got) == 40 and crowd == 1
    assert len(permutation_index.spread(x, 500)) == 400 and len(permutation_index.spread(x[:0], 5)) == 0


def test_footrule_of_postings():
    rng = np.random.default_rng(5)
    pivots = permutation_index._unit(rng.standard_normal((30, 6)))
    order = permutation_index.lists(rng.standard_normal((50, 6)), pivots, 12)
    starts, rows, room = permutation_index.posted(order, 30)
    for mine in order[:5]:
        score = permutation_index.shared(starts, rows, room, mine, 50)
        for r, other in enumerate(order):
            place = lambda o, p: list(o).index(p) if p in o else 12
            footrule = sum(abs(place(mine, p) - place(other, p)) for p in {*mine, *other})
            assert footrule == 2 * sum(range(1, 13)) - 2 * int(score[r])


@pytest.mark.parametrize("where", ["sf0.1", "check_h"])
def test_recall_of_the_query(spark, where):
    """On even vectors, and where a third of all crowd around one."""
    if not os.path.isdir(f"/root/testdata/{where}"):
        pytest.skip("no driver tables")
    got = by_query(op11_permutation_index(spark, f"/root/testdata/{where}"))
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"/root/testdata/{where}/embeddings.parquet").collect()}
    ids, x = np.array(list(e)), np.array(list(e.values()), float)
    hits = 0
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, x @ np.array(e[q], float))
        hits += len({j for _, j, _ in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(got) == sum(i % 20 == 0 for i in e) and hits >= 0.9 * 20 * len(got)


def brute_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label) with equal lengths and distinct ids."""
    rows = [(i, [int(np.floor(1024 * e)) for e in v], lab) for i, v, lab in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    named = [r for r in rows if r[0] is not None][:entries]
    books = [[cut(v, p) for _, v, _ in named] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)) for c in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = [assign(v) for _, v, _ in rows]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[1], p) for r, f in zip(rows, found, strict=True) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    done = [(i, lab, assign(v)) for i, v, lab in rows]
    error = [sum(f for _, f in a) for _, _, a in done]
    total = {lab: sum(e for e, d in zip(error, done, strict=True) if d[1] == lab) for lab in {d[1] for d in done}}
    return sorted(repr((i, "".join(f"{c:02x}" for c, _ in a), e, total[lab], digest)) for (i, lab, a), e in zip(done, error, strict=True))


def test_codes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1 + 5 * (i % 4), 8).tolist()) for i in range(300)] + [(400 + i, [0.5, -0.25] * 4) for i in range(100)]
    odd = [(None, [0.1] * 8), (900, None), (901, [float("nan")] + [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("-inf")] + [1.0] * 7), (904, []), (905, [1.0] * 4), (906, [1e300] + [0.0] * 7)]
    df = table(spark, rows + odd[:-1])
    labelled = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect() if r["embedding"] and len(r["embedding"]) == 8]
    got = vector_codes.vector_codes(df, entries=40, rounds=3).drop("label")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(labelled, 4, 40, 3)
    assert vector_codes.vector_codes(table(spark, rows + odd)).count() == 402  # clamped, not lost
    assert vector_codes.vector_codes(table(spark, [])).count() == 0
    assert vector_codes.vector_codes(table(spark, [(1, [1.0] * 6)])).count() == 0
    one = vector_codes.vector_codes(table(spark, [(None, [1.0] * 4), (None, [1.0] * 4)])).collect()
    assert [(r["code"], r["error"]) for r in one] == [("00000000", 0)] * 2
    twice = vector_codes.vector_codes(table(spark, [*rows, rows[0], (0, [9.0] * 8)])).collect()
    assert len(twice) == 402


@pytest.mark.parametrize("dims", [1, 2, 5, 16])
def test_partial_distances_are_exact(dims):
    rng = np.random.default_rng(7)
    book, x = rng.integers(-9, 10, (50, dims)), rng.integers(-12, 13, (2500, dims))
    book[10:20] = book[:10]  # ties go to the lower entry
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    entry, error = vector_codes.nearest(x, book)
    assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()
    assert vector_codes.nearest(x[:0], book)[0].size == 0
