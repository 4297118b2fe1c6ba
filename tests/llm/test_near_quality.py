"""Near duplicates against all pairs; the classifier against plain sums and on held-out rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shardlight.llm import minhash, quality
from shardlight.llm.textkit import FOLDED, split_words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        out.append((i * 3, " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = [x if rng.random() > rng.choice([0.02, 0.1, 0.25]) else f"x{rng.randint(0, 99)}" for x in words]
            out.append((10_000 + len(out), " ".join(copy)))
    return [(d, t) for t, d in {t: d for d, t in reversed(out)}.items()]


def distances(docs, plan):
    sig, index = minhash.signatures(pa.array([t for _, t in docs]), plan.slots)
    assert list(index) == [i for i, (_, t) in enumerate(docs) if t and any(c.isalnum() for c in t)]
    return {(docs[index[a]][0], docs[index[b]][0]): int((sig[a] != sig[b]).sum()) for a in range(len(sig)) for b in range(a)}


def components(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("plan", [minhash.Plan(), minhash.Plan(32, 7, 4), minhash.Plan(16, 0, 1)])
def test_all_pairs_within_the_radius_are_found(spark, plan):
    docs = corpus(plan.radius)
    near = {p for p, d in distances(docs, plan).items() if d <= plan.radius}
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r["a"], r["b"]) for r in minhash.near_pairs(df, plan).collect()}
    sig, _ = minhash.signatures(pa.array([t for _, t in docs]), plan.slots)
    if len({s.tobytes() for s in sig}) == len(sig):
        assert got == {(max(p), min(p)) for p in near}
    roots = components([d for d, _ in docs], near)
    want = {(d, r) for d, r in roots.items() if sum(x == r for x in roots.values()) > 1}
    rows = minhash.near_groups(df, plan).collect()
    assert {(r["doc_id"], r["group_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["keep"] == (r["doc_id"] == r["group_id"]) for r in rows)


def test_minhash_follows_word_sets():
    a, b = [f"w{i}" for i in range(400)], [f"w{i}" for i in range(60, 460)]
    sig, _ = minhash.signatures(pa.array([" ".join(a), " ".join(b), "W0, " + " ".join(reversed(a))]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 340 / 460) < 0.05 and (sig[0] == sig[2]).all()


def test_near_edge_cases(spark):
    text = " ".join(f"a{i}" for i in range(50))
    docs = [(None, text, 1), (5, text, 1), (5, text, 1), (2, text, 2), (9, None, 1), (8, "", 1), (7, " .,! ", 1), (6, text + " more", 3), (4, "long " * 300_000, 1), (1, "clean and alone", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, group_id int")
    rows = {(r["doc_id"], r["group_id"], r["keep"]) for r in minhash.near_groups(df).collect()}
    assert rows == {(2, 2, True), (5, 2, False), (6, 2, False)}
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 2, 9, 8, 7, 4, 1])
    assert minhash.near_groups(df.where("false")).collect() == [] and minhash.keep_one(df.where("false")).collect() == []
    other = " ".join(f"b{i}" for i in range(50))
    bridge = spark.createDataFrame([(1, text), (3, text), (3, other), (4, other)], SCHEMA)
    assert {(r["doc_id"], r["group_id"]) for r in minhash.near_groups(bridge).collect()} == {(1, 1), (3, 1), (4, 1)}
    again = spark.createDataFrame([(3, "b c d"), (3, "x y z"), (3, None)], SCHEMA)
    assert [(r["doc_id"], r["text"]) for r in minhash.keep_one(again).collect()] == [(3, "b c d")]


def test_large_group_of_copies(spark):
    text = " ".join(f"c{i}" for i in range(80))
    docs = [(i, text + (f" v{i}" if i % 2 else "")) for i in range(1500)]
    rows = minhash.near_groups(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 1500 and {r["group_id"] for r in rows} == {0}


@pytest.mark.parametrize("together", [1, 3, 10])
def test_blocks_of_a_crowded_key_join_the_same_groups(spark, together):
    plan = minhash.Plan(16, 3, 4)
    docs = [(i, " ".join(f"c{k}" for k in range(60)) + f" v{i % 50}") for i in range(60)] + [(100 + i, f"other words {i}") for i in range(20)]
    df = spark.createDataFrame(docs, SCHEMA)
    s = minhash.prepared(df, plan)
    reps = {r["rep"]: r["sig"] for r in s.reps.collect()}
    edges = {(r["a"], r["b"]) for r in minhash._compared(s.reps, plan, False, together).collect()}
    near = {(a, b) for a in reps for b in reps if b < a and (np.frombuffer(reps[a], np.uint16) != np.frombuffer(reps[b], np.uint16)).sum() <= plan.radius}
    assert edges <= near and components(reps, edges) == components(reps, near) and len(near) > 30


def test_words_are_folded():
    raw = "Ab, äb\tC-d  ".encode()
    w = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), FOLDED)
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == ["Ab", "äb", "C", "d"]


# quality


def test_score_is_the_sparse_dot_product():
    texts = pa.array(["Some words, twice words", "x", "", None, "ä ö 123 Aa! " * 400])
    rng = np.random.default_rng(0)
    model = quality.Model(np.arange(1 << 12), rng.normal(size=1 << 12), 0.3, 12, 30.0)
    w = model.dense()
    got = quality.score_texts(texts, model, w)
    for (slots, values), p in zip(quality.examples(texts, 12, 30.0), got, strict=True):
        if len(slots):
            assert p == pytest.approx(1 / (1 + np.exp(-(0.3 + w[slots] @ values))), rel=1e-9)
        else:
            assert np.isnan(p)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, rest = labels.where("doc_id % 4 <> 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 4 = 0").collect()}
    rows = [r for r in quality.classify(docs, train).collect() if r["doc_id"] in rest and r["score"] is not None]
    right = sum(r["keep"] == (rest[r["doc_id"]] > 0) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.9


def test_ftrl_learns_and_is_sparse():
    rng = random.Random(0)
    texts, good = [], []
    for i in range(400):
        good.append(i % 2)
        texts.append(" ".join(rng.choice(["alpha", "beta", "gamma"] if i % 2 else ["Buy", "NOW!!", "$$$"]) if rng.random() < 0.4 else f"n{rng.randint(0, 500)}" for _ in range(30)))
    model = quality.fit(pa.array(texts[:300]), np.array(good[:300]) > 0)
    p = quality.score_texts(pa.array(texts[300:]), model, model.dense())
    assert ((p > 0.5) == np.array(good[300:], bool)).mean() > 0.97 and len(model.slots) < 5000


def test_ftrl_update_against_the_textbook():
    """One weight at a time, by the published update: z and n by coordinate, weights from them in closed form."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e f g Big 7 !".split()) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    good = [rng.random() < 0.5 for _ in texts]
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.3, 1.0, 3
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, plain=False):
        if plain:
            return -z[i] / ((beta + n[i] ** 0.5) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    rows = [(s.tolist(), v.tolist(), y) for (s, v), y in zip(quality.examples(pa.array(texts), 10, 30.0), good, strict=True) if len(s)]
    for _ in range(epochs):
        for slots, values, y in rows:
            w = {i: weight(i) for i in slots} | {"bias": weight("bias", True)}
            p = 1 / (1 + np.exp(-(sum(w[i] * x for i, x in zip(slots, values, strict=True)) + w["bias"])))
            for i, x in [*zip(slots, values, strict=True), ("bias", 1.0)]:
                g = (p - y) * x
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    model = quality.fit(pa.array(texts), np.array(good), bits=10)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert model.slots.tolist() == sorted(want) and model.weights == pytest.approx([want[i] for i in sorted(want)])
    assert model.intercept == pytest.approx(weight("bias", True))


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", 0.1), (1, "good text here", 0.2), (None, "good text", 0.3), (2, None, 0.4), (3, "", 0.5), (4, "bad " * 400_000, 0.6)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, 1, 0), (None, 0, 0), (77, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all((r["score"] is None) == (r["doc_id"] in (2, 3)) for r in rows) and not any(r["keep"] for r in rows if r["score"] is None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and defaultdict(int, Counter(r["doc_id"] for r in kept.collect()))[2] == 0
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in none if r["score"] is not None} == {0.5}
    assert quality.classify(docs.where("false"), labels).collect() == []
