from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from readlake.llm import packing, preferences, quality, toxicity
from readlake.llm.bpe import PrefixBPE, load_ranks, roundtrip

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello world", "don't  stop\n\n", "日本語 ½ ² Ⅷ 🙂", "a" * 5000, " " * 300 + "x", "\x1c\x85\xa0 _x_ <|endoftext|>", "naïve Straße " * 4000, "the" * 40]


def frame(spark, rows, extra="offset string, tier string, ids string"):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], f"doc_id long, text string, {extra}")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_bpe(spark):
    ref = reference()
    rows = [*enumerate(TEXTS), (None, "x"), (1, "again")]
    got = roundtrip(frame(spark, rows), RANKS, P.PATTERN).collect()
    assert sorted((repr(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == sorted((repr(i), ref.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert roundtrip(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_bpe_appends_and_edits():
    bpe, ref, rng = PrefixBPE(load_ranks(RANKS)), reference(), random.Random(1)
    for _ in range(60):
        s = bytes(rng.choice(b"aeinrst the") for _ in range(rng.randint(1, 120)))
        table = bpe.last_tokens(s)
        assert bpe.walk(table) == ref._encode_single_piece(s)
        i = rng.randint(0, len(s))
        j, new = rng.randint(i, len(s)), bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(0, 9)))
        whole, edited = bpe.edit(table, s, i, j, new)
        assert edited == bpe.last_tokens(whole) and bpe.append(table, s, new) == bpe.last_tokens(s + new)
        assert bpe.decode(bpe.walk(edited)) == whole


def test_packing(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    rows = [*enumerate([*TEXTS, *[" ".join(rng.choice(["the", "zebra", "qux12", "été"]) for _ in range(rng.randint(0, 1500))) for _ in range(150)]]), (None, "null id")]
    make = lambda: packing.fast_encoder(P.path("byte_bpe_50k.json"), RANKS, P.PATTERN)
    got = packing.packed(frame(spark, rows).repartition(2), make).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids.tobytes() and all(r["doc_tokens"] == len(ids) for r in pieces)
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
    total = pad = 0
    groups = {}
    for v in seqs.values():
        v.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in v] == np.cumsum([0, *[r["length"] for r in v[:-1]]]).tolist() and len({r["step_group"] for r in v}) == 1
        n = sum(r["length"] for r in v)
        assert n <= v[0]["tier"] <= 2048
        total, pad = total + n, pad + (2048 - n if n & (n - 1) else 0)
        groups.setdefault(v[0]["step_group"], []).append(v[0]["tier"])
    assert pad < 0.01 * total and all(sum(g) <= 1 << 16 for g in groups.values())
    # of each task's groups one may be far from full, and only the last ones mix lengths
    for task in {g >> 32 for g in groups}:
        own = [groups[g] for g in sorted(groups) if g >> 32 == task]
        assert sum(sum(g) < (1 << 16) - 2048 for g in own) <= 1 and sum(len(set(g)) > 1 for g in own) <= 3
    assert packing.packed(frame(spark, []), make).count() == 0


def labelled(n=1500, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        y = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(3 if y else 0):
            text.insert(rng.randrange(60), rng.choice(["vilest", "rottener", "scummy"]) + rng.choice(["", "ly", "ness"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(y)))
    return docs, labels


def test_toxicity(spark):
    rows, marks = labelled()
    extra = [(5000, None), (5001, ""), (None, "vilest rottener"), (1, rows[1][1])]
    d = frame(spark, rows + extra)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model, vectors = toxicity.fit(d, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(vectors, model).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    y = dict(marks)
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5000]["score"] == got[5001]["score"] < 0.5 < got[None]["score"]
    assert not any(zlib.crc32(str(e["doc_id"]).encode()) % 5 == 0 for r in got.values() for e in r["evidence"])
    assert toxicity.drop_toxic(d, model).count() == sum(1 - r["predicted"] for r in toxicity.scored(vectors, model).collect())
    none, v = toxicity.fit(d, labels.limit(0))
    assert len({r["score"] for r in toxicity.scored(v, none).collect()}) == 1
    assert toxicity.scored(v.limit(0), none).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(0, 7), replace=False))
        w = rng.random(len(t)) + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    flat = [np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]), np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])]
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for block, common in ((16, 12), (64, 3), (5, 1000)):
        index = toxicity.BlockMaxIndex(*flat, 60, block, common)
        found, cosines = index.search(flat[0][:301], flat[1][: flat[0][300]], flat[2][: flat[0][300]], 9, np.arange(300))
        for i in range(300):
            full = dense[index.order] @ dense[i]
            full[i] = 0  # left out
            want = np.sort(full[full > 1e-12])[::-1][:9]
            assert np.allclose(cosines[i][: len(want)], want) and (found[i] >= 0).sum() == len(want)
            assert np.allclose(full[found[i][found[i] >= 0]], want)


def brute_toxicity(rows, marks, k=7):
    """doc_id to (score, evidence) by dense vectors, written anew: all words, all pairs."""
    y = {i: v for i, v in marks if v is not None and i is not None and zlib.crc32(str(i).encode()) % 5}
    words = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    examples = [r for r, (i, _) in enumerate(rows) if i in y]
    terms = sorted({w for r in examples for w in words[r]})
    at, labels = {w: j for j, w in enumerate(terms)}, np.array([y[rows[r][0]] for r in examples], float)
    count = np.zeros((len(rows), len(terms)))
    for r, c in enumerate(words):
        for w, n in c.items():
            if w in at:
                count[r, at[w]] = n
    share, held = labels.mean(), (count[examples] > 0).sum(0)
    hits = (count[examples][labels == 1] > 0).sum(0)
    z = np.abs(hits - held * share) / np.sqrt(np.maximum(held * share * (1 - share) * np.maximum(1, len(labels) - held) / len(labels), 1e-12))
    weight = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * (np.log((1 + len(rows)) / (1 + (count > 0).sum(0))) + 1) * np.maximum(1, z)
    unit = weight / np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-300)
    cosine = unit @ unit[examples].T
    rate = (labels.sum() + 0.5) / (len(labels) + 1)

    def nearest(row):
        best = sorted((j for j in range(len(examples)) if row[j] > 1e-12), key=lambda j: -row[j])[:k]
        near = [1 / (1.05 - min(1, row[j])) for j in best]
        p = (sum(n * labels[j] for n, j in zip(near, best)) + 0.5 * rate) / (sum(near) + 0.5)
        return math.log(p / (1 - p)), [(rows[examples[j]][0], row[j]) for j in best]

    votes = []
    for j, r in enumerate(examples):
        row = cosine[r].copy()
        row[j] = 0
        votes.append(nearest(row)[0])
    x, target, coef = np.stack([np.ones(len(votes)), votes], 1), labels * 0.999 + 5e-4, np.array([0.0, 1.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ coef))
        coef = coef + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (target - p) - 1e-2 * (coef - [0, 1]))
    return [(i, 1 / (1 + math.exp(-coef[0] - max(coef[1], 1e-3) * (v := nearest(cosine[r]))[0])), v[1]) for r, (i, _) in enumerate(rows)]


def test_toxicity_equals_brute_force(spark):
    rows, marks = labelled(420, 5)
    rows += [(900, None), (901, ""), (902, "words nobody has"), (903, (rows[4][1] + " ") * 400), (None, rows[5][1])]
    model, vectors = toxicity.fit(frame(spark, rows), spark.createDataFrame([*marks, (None, 1), (9999, 1)], "doc_id long, toxic int"))
    got = {repr(r["doc_id"]): r for r in toxicity.scored(vectors, model).collect()}
    want = brute_toxicity(rows, marks)
    assert len(got) == len(want) == len(rows)
    for i, score, evidence in want:
        r = got[repr(i)]
        assert abs(r["score"] - score) < 1e-6
        assert np.allclose([e["cosine"] for e in r["evidence"]], [c for _, c in evidence], atol=1e-9)
    assert all(bool(got[repr(i)]["evidence"]) == bool(e) for i, _, e in want) and not got["902"]["evidence"]
    assert sum(bool(e) for _, _, e in want) == len(rows) - 3


def test_quality(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        g = rng.randrange(3)
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
        if g == 0:
            w = [x + "###" for x in w]
        elif g == 1:
            w = [x.upper() if rng.random() < 0.5 else x for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, g))
    ratings = spark.createDataFrame([m for m in marks if m[0] % 3] + [(None, 1), (5, None), (6, 99)], "doc_id long, grade int")
    d = frame(spark, [*rows, (7000, None), (7001, "")])
    model = quality.fit(d, ratings)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.graded(d, model).collect()}
    y = dict(marks)
    test = [i for i in y if i % 3 == 0]
    assert np.mean([got[i]["kept"] == (y[i] >= 1) for i in test]) > 0.97
    assert np.mean([abs(got[i]["expected_grade"] - y[i]) for i in test]) < 0.3
    assert got[7000]["expected_grade"] == got[7001]["expected_grade"]
    assert quality.graded(d.limit(0), model).count() == 0
    head = "a" * 64
    long = {r["doc_id"]: r["expected_grade"] for r in quality.graded(frame(spark, [(1, head + "#" * 9000), (2, head + "bB" * 4500), (2, head)]), model).collect()}
    assert long[1] != long[2]


def test_preferences(spark):
    rows = [
        (1, True, 0, "system", "s"), (1, True, 1, "user", "hi"), (1, True, 2, "assistant", "good"), (1, False, 0, "system", "s"), (1, False, 1, "user", "hi"), (1, False, 2, "assistant", "bad"), (1, False, 3, "user", "no"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, None, None), (4, True, 0, "assistant", "x<|im_end|>y"), (4, False, 0, "assistant", "z"), (None, True, 0, "user", "q"), (5, None, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preferences.preference_pairs(df).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    a = got[1]
    assert (a["prompt"], a["prompt_turns"]) == (turn("system", "s") + turn("user", "hi"), 2)
    assert (a["chosen"], a["rejected"], a["usable"]) == (turn("assistant", "good"), turn("assistant", "bad") + turn("user", "no"), True)
    assert [a["rejected"][m["start"] : m["stop"]] for m in a["rejected_mask"]] == ["bad<|im_end|>"]
    assert set(got) == {1, 2, 3, 4} and not got[2]["usable"] and got[2]["chosen"] == "" and not got[3]["usable"]
    assert [got[4]["chosen"][m["start"] : m["stop"]] for m in got[4]["chosen_mask"]] == ["x<\\|im_end|>y<|im_end|>"]
    assert preferences.preference_pairs(df.limit(0)).count() == 0
