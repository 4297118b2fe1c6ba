"""Chat formatting, mixing and packing against plain versions, SQL, and their defined cases."""

import itertools
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardlight.llm import chat, mixing, packing, queries

SF = "/root/testdata/sf0.001"


def by_sql(sql):
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    want, got = by_sql(queries.ORACLE_SQL[name]), [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    key = lambda r: repr(sorted((k, v) for k, v in r.items()))
    assert sorted(got, key=key) == sorted(want, key=key) and got


# chat


def plain_chat(turns):
    """(error, position) of one conversation by a loop."""
    turns = sorted(turns, key=lambda t: tuple((x is not None, x) for x in t))
    state, before = "start", object()
    for n, (turn, role, text) in enumerate(turns):
        if turn is None:
            return "null_turn", n
        if turn == before:
            return "repeated_turn", n
        if role not in chat.CHATML.pieces:
            return "unknown_role", n
        if text is None:
            return "null_text", n
        to = chat.CHATML.transitions.get((state, role))
        if to is None:
            return "bad_order", n
        state, before = to, turn
    return (None, -1) if state in chat.CHATML.accepting else ("unfinished", len(turns))


def test_chat_against_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(300):
        good = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(1, 3)
        for turn, role in enumerate(good):
            x = rng.random()
            rows.append((conv, None if x < 0.02 else turn - (x > 0.97), None if 0.02 < x < 0.04 else "tool" if 0.04 < x < 0.06 else "user" if 0.06 < x < 0.1 else role, None if 0.1 < x < 0.12 else f"t{turn}" * rng.randint(0, 2)))
    rows.append((None, 0, "user", "nobody's"))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {}
    for r in chat.format_chats(df).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(range(300))
    kinds = Counter()
    for conv, segments in got.items():
        own = [r[1:4] for r in rows if r[0] == conv]
        error, at = plain_chat(own)
        kinds[error] += 1
        assert {(s["valid"], s["error"], s["error_at"]) for s in segments} == {(error is None, error, at)}
        if error:
            assert len(segments) == 1 and segments[0]["text"] is None
            continue
        segments.sort(key=lambda s: s["segment"])
        assert [s["segment"] for s in segments] == list(range(len(segments)))
        assert "".join(s["text"] for s in segments) == "".join(p.replace("{text}", t) for _, role, t in sorted(own) for p, _ in chat.CHATML.pieces[role])
        assert "".join(s["text"] for s in segments if s["loss"]) == "".join(t + "<|im_end|>" for _, role, t in sorted(own) if role == "assistant")
    assert len(kinds) > 5


def test_chat_empty_table_and_long_text(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a" * 2_000_000), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert {(r["segment"], len(r["text"])) for r in chat.format_chats(df).collect() if r["role"] == "user" and r["segment"] == 1} == {(1, 2_000_000)}


# mixing


def plain_mix(docs, weights, fractions):
    """{doc: tier} by sorting each source."""
    import hashlib

    rows = [(s, int(hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:15], 16), len((t or "").split()), i) for i, (d, s, t) in enumerate(docs)]
    total, sources = sum(r[2] for r in rows), {r[0] for r in rows}
    have = {s: sum(r[2] for r in rows if r[0] == s) for s in sources}
    weights = {s: weights.get(s, 1.0) * (have[s] > 0) for s in sources}
    whole = sum(weights.values())
    scarcest = min((have[s] / weights[s] for s in sources if weights[s]), default=0)
    out = {}
    for s in sources:
        own = sorted(r for r in rows if r[0] == s) if s else sorted((r for r in rows if r[0] == s), key=lambda r: r[1:])
        for tier, f in reversed(list(enumerate(sorted(fractions)))):
            budget = int(weights[s] * min(f * total / whole, scarcest)) if weights[s] else 0
            for r in own:
                if sum(x[2] for x in own if x[1] <= r[1]) <= budget:
                    out[r[3]] = tier
    return out


def test_mix_against_sorting(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["src0", "a", "b", None, ""]), rng.choice([None, "", "w " * rng.randint(1, 30)])) for i in range(300)] + [(None, "a", "x y"), (7, "a", "again"), (7, "a", "again")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, tokens int")
    want = plain_mix(docs, mixing.WEIGHTS, mixing.FRACTIONS)
    got = Counter((r["doc_id"], r["source"], r["tokens"], r["tier"]) for r in mixing.mix(df).collect())
    assert got == Counter((docs[i][0], docs[i][1], len((docs[i][2] or "").split()), t) for i, t in want.items())
    kept = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.keep_mix(df).collect())
    only = plain_mix(docs, mixing.WEIGHTS, (0.8,))
    assert kept == Counter(docs[i] for i in only) and mixing.keep_mix(df).columns == df.columns


@pytest.mark.parametrize("weights", [{}, {"src0": 3.0, "src1": 0.5}])
def test_mix_is_nested_and_meets_targets(spark, weights):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    sources = {r["source"] for r in docs.select("source").collect()}
    of = {s: [r["doc_id"] for r in docs.where(docs.source == s).collect()] for s in sources}
    share = {s: weights.get(s, 1.0) / sum(weights.get(x, 1.0) for x in sources) for s in sources}
    rows = mixing.mix(docs, weights).collect()
    most = min(sum(size[d] for d in of[s]) / share[s] for s in sources)
    for tier, f in enumerate(mixing.FRACTIONS):
        for s in sources:
            got = sum(r["tokens"] for r in rows if r["source"] == s and r["tier"] <= tier)
            target = share[s] * min(f * sum(size.values()), most)
            # each source meets its share, short of one document
            assert target - max(size[d] for d in of[s]) <= got <= target + 1e-6
    kept = mixing.keep_mix(docs, weights).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows}
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.keep_mix(docs.where("false")).collect() == []


def test_mix_of_sources_without_tokens(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, "b", "one two"), (4, "b", "three")], "doc_id long, source string, text string")
    rows = {(r["doc_id"], r["tokens"]) for r in mixing.mix(df, fractions=(1.0,)).collect()}
    assert rows == {(1, 0), (2, 0), (3, 2), (4, 1)}
    assert {r["doc_id"] for r in mixing.keep_mix(df.where("source = 'a'")).collect()} == {1, 2}


# packing


def optimum(items, capacity):
    """Fewest bins, by search."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def histogram(items, capacity):
    return np.bincount(items, minlength=capacity + 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_never_costs_a_bin(items):
    fixed, rest = packing.reduce_instance(histogram(items, 20))
    left = [n for n in range(20, 0, -1) for _ in range(rest[n])]
    assert sum(n for _, n in fixed) + (optimum(left, 20) if left else 0) == optimum(sorted(items, reverse=True), 20)
    assert all(sum(size * k for size, k in p) <= 20 for p, _ in fixed)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_is_that_of_single_items(items):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 30) - x)
    got = packing.best_fit(histogram(items, 30)) if items else []
    assert sorted(30 - sum(s * k for s, k in p) for p, n in got for _ in range(n)) == sorted(rooms)


def test_pack_places_every_piece_once(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.choice([0, 1, 5, 5, 40, 99, 100, 101, 250, rng.randint(1, 100)])) for i in range(400)] + [(None, "a b c"), (1, "again x"), (1, "again x"), (900, None), (901, "  "), (902, "w " * 50_000)]
    df = spark.createDataFrame([(d, t, "z", 5) for d, t in docs], "doc_id long, text string, part string, length int")
    rows = packing.pack(df, 100).collect()
    placed = Counter((r["doc_id"], r["part"], r["length"]) for r in rows)
    want = Counter((d, p, min(100, n - 100 * p)) for d, t in docs if t for n in [len(t.split())] for p in range(-(-n // 100)))
    assert placed == want
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append((r["position"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= 100
    pieces = sum(n for _, _, n in placed.elements())
    assert len(bins) <= pieces / 100 * 1.2 + 2 and set(bins) == set(range(len(bins)))
    assert packing.pack(df.where("false")).collect() == []
