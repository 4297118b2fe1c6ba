"""Nearest neighbours against all distances; the id store against round trips and tampering."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardlight.llm import idstore, knn

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every=1):
    clean = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and x == x for x in v):
            clean[(i, tuple(np.float32(v)))] = None
    out = Counter()
    for i, v in clean:
        if i % every:
            continue
        others = sorted((float(((np.array(v, float) - np.array(w, float)) ** 2).sum()), j) for j, w in clean if j != i and len(w) == len(v))
        for rank, (d, j) in enumerate(others[:k], 1):
            out[(i, rank, j, round(d**0.5, 6))] += 1
    return out


@pytest.mark.parametrize("shard", [40, 10_000])
def test_nearest_against_all_distances(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(250)]
    rows += [(1000 + i, [float(x) for x in rng.integers(0, 2, 3)], 0) for i in range(40)]  # many ties, another length
    rows += [rows[0], (1, rows[2][1], 0), (None, rows[0][1], 0), (5000, None, 0), (5001, [], 0), (5002, [1.0, None], 0), (5003, [float("nan")] * 8, 0), (5004, [1.0] * 5, 0)]
    got = knn.nearest(spark.createDataFrame(rows, VECTORS), k=5, every=1, shard=shard).collect()
    assert Counter((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in got) == brute(rows, 5)


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 3))
    tree = knn.Tree(points, np.arange(3000))
    best, who = tree.search(points[:200], np.arange(200), 7, np.full(200, np.inf))
    d = ((points[:200, None] - points[None]) ** 2).sum(2)
    d[np.arange(200), np.arange(200)] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert (who == want).all() and best == pytest.approx(np.take_along_axis(d, want, 1))
    leaves = tree.left < 0
    assert (tree.lo <= tree.hi).all() and (tree.last - tree.first)[leaves].sum() == 3000 and (tree.last - tree.first)[leaves].max() <= knn.LEAF
    for node in np.flatnonzero(~leaves):
        a, b = tree.left[node], tree.right[node]
        assert (tree.first[node], tree.last[a], tree.last[b]) == (tree.first[a], tree.first[b], tree.last[node])
        assert (tree.lo[node] == np.minimum(tree.lo[a], tree.lo[b])).all() and (tree.hi[node] == np.maximum(tree.hi[a], tree.hi[b])).all()
    # whole sub-trees are passed over
    assert len(tree.leaves_within(points[:200], best[:, -1])[0]) < 0.5 * 200 * leaves.sum()
    # a bound that another shard gave leaves only what is nearer
    kth = best[:, 3]
    some, _ = tree.search(points[:200], np.arange(200), 7, kth)
    assert (np.sort(some, axis=1)[:, :4] == best[:, :4]).all() and np.isinf(some[:, 6]).mean() > 0.5


def test_nearest_small_tables(spark):
    assert knn.nearest(spark.createDataFrame([], VECTORS)).collect() == []
    assert knn.nearest(spark.createDataFrame([(1, [1.0], 0)], VECTORS)).collect() == []
    two = knn.nearest(spark.createDataFrame([(1, [1.0], 0), (2, [4.0], 0)], VECTORS)).collect()
    assert {(r["id"], r["neighbour"], r["distance"]) for r in two} == set()
    two = knn.nearest(spark.createDataFrame([(20, [1.0], 0), (40, [4.0], 0), (7, [5.0], 0)], VECTORS)).collect()
    assert {(r["id"], r["rank"], r["neighbour"], r["distance"]) for r in two} == {(20, 1, 40, 3.0), (20, 2, 7, 4.0), (40, 1, 7, 1.0), (40, 2, 20, 3.0)}


def test_copies_crowd_no_shard(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, 0.25], 0) for i in range(300)] + [(300 + i, [float(x) for x in rng.normal(size=2)], 0) for i in range(500)]
    sizes = []
    monkeypatch.setattr(knn, "_boxes", lambda p, f=knn._boxes: sizes.extend(r["count"] for r in p.groupBy("shard").count().collect()) or f(p))
    got = knn.nearest(spark.createDataFrame(rows, VECTORS), k=5, shard=50).collect()
    assert Counter((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in got) == brute(rows, 5, 20)
    assert sum(sizes) == 506 and max(sizes) < 110


# store


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kind string, n int")


def test_store_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = idstore.store(docs).persist()
    enc = idstore.encoding(idstore.RANKS)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    back = {r["doc_id"]: enc.decode(np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in idstore.reconstructed(rows).collect()}
    assert back == {d: t for d, t in text.items() if t is not None}
    assert {r["what"]: r["count"] for r in idstore.faults(rows).collect()} == {"chunk": 0, "recipe": 0, "manifest": 0}
    keys = [bytes(r["key"]) for r in rows.where("kind = 'chunk'").collect()]
    assert len(keys) == len(set(keys))


def test_shared_passages_are_stored_once(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(4000))
    rows = [(i, " ".join(word() for _ in range(20 * i)) + " " + passage) for i in range(8)]
    stored = sum(len(r["ids"]) for r in idstore.store(docs_of(spark, rows)).where("kind = 'chunk'").collect())
    assert stored < 2.2 * len(idstore.encoding(idstore.RANKS).encode_ordinary(passage)) * 2


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    a, b = idstore.cuts(ids), [x - 300 for x in idstore.cuts(np.concatenate([rng.integers(0, 50_000, 300).astype(np.uint16), ids]))]
    sizes = np.diff([0, *a])
    assert sizes[:-1].min() >= idstore.LEAST and sizes.max() <= idstore.MOST and a[-1] == 20_000
    assert len(set(a) & set(b)) > 0.9 * len(a)
    assert idstore.cuts(ids[:0]) == [] and idstore.cuts(ids[:5]) == [5] and idstore.cuts(np.zeros(3000, np.uint16))[-1] == 3000


def naive_cuts(ids):
    """Cuts by the definition: the window's hash at every place, one after the other."""
    base, mask = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    out, start = [], 0
    for at in range(1, len(ids) + 1):
        if at == len(ids) or at - start == idstore.MOST:
            out.append(at)
            start = at
        elif at - start >= idstore.LEAST:
            h = sum(mix(int(x) + 1) * pow(base, j, 1 << 64) for j, x in enumerate(ids[at - idstore.WINDOW : at])) + idstore.WINDOW
            if mix(h & mask) % idstore.AVERAGE == 0:
                out.append(at)
                start = at
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 3000])
def test_cuts_against_a_naive_rolling_hash(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint16)
    assert idstore.cuts(ids) == naive_cuts(ids)
    assert idstore.cuts(np.zeros(n, np.uint16)) == naive_cuts(np.zeros(n, np.uint16))


def test_long_white_space_has_the_ids_of_the_whole_text():
    enc = idstore.encoding(idstore.RANKS)
    for space in (" " * 5000, "\n" * 3000, " \t\u3000" * 1500, "\n" * 2000 + " "):
        for text in (space, "a" + space, space + "b", "one" + space + "two " + space + "!", space + "\x1c" + space):
            assert idstore.encoded(enc, text).tolist() == enc.encode_ordinary(text)
    huge = "x" + " " * 2_000_000 + "y"
    assert enc.decode(idstore.encoded(enc, huge).tolist()) == huge


def test_merkle_root():
    h = lambda *x: hashlib.sha256(b"\1" + b"".join(x)).digest()
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    assert idstore.merkle_root([a]) == a and idstore.merkle_root([a, b]) == h(a, b) and idstore.merkle_root([a, b, c]) == h(h(a, b), c)


def test_store_edge_cases_and_tampering(spark):
    rows = [(None, "nobody"), (1, None), (2, ""), (3, "twice the same"), (3, "twice the same"), (3, "other"), (-5, "below zero"), (4, "long words " * 100_000 + " " * 1_200_000), *[(None, f"text {i % 7000}") for i in range(9000)]]
    stored = idstore.store(docs_of(spark, rows)).persist()
    recipes = defaultdict(list)
    for r in stored.where("kind = 'recipe'").collect():
        recipes[r["doc_id"]].append(r)
    assert {d: len(v) for d, v in recipes.items()} == {None: 9001, 1: 1, 2: 1, 3: 3, -5: 1, 4: 1}
    assert recipes[1][0]["key"] is None and recipes[1][0]["n"] is None and recipes[2][0]["n"] == 0 and recipes[2][0]["chunks"] == []
    assert len(idstore.reconstructed(stored).collect()) == 9007
    nodes = {r["bucket"]: r["n"] for r in stored.where("kind = 'manifest' AND level = 1").collect()}
    assert nodes == {None: 9001, 0: 5, -1: 1}
    assert {r["what"]: r["count"] for r in idstore.faults(stored).collect()} == {"chunk": 0, "recipe": 0, "manifest": 0}
    bad = stored.selectExpr("kind", "key", "doc_id", "n", "if(kind = 'chunk', concat(ids, X'00'), ids) ids", "if(doc_id = 3, reverse(array_append(chunks, X'00')), chunks) chunks", "level", "bucket")
    faults = {r["what"]: r["count"] for r in idstore.faults(bad).collect()}
    assert faults["chunk"] > 0 and faults["recipe"] == 3
    lost = {r["what"]: r["count"] for r in idstore.faults(stored.where("NOT (kind = 'recipe' AND doc_id <=> -5)")).collect()}
    assert lost["manifest"] > 0
    assert idstore.store(docs_of(spark, rows).where("false")).collect() == []
