"""Maximal repeats against a brute-force search over all pairs of places."""

import random

import pytest

from shardlight.llm import repeats

LEAST, GRAM = 6, 3
SCHEMA = "doc_id long, text string"


def brute(docs, least):
    """{(words, occurrences)} of all maximal repeats of distinct texts, by extending every pair of places."""
    texts = {}
    for d, t in docs:
        if d is not None and t is not None:
            texts.setdefault(t, d)
            texts[t] = min(texts[t], d)
    words = {d: t.split() for t, d in texts.items()}
    found = set()
    places = [(d, i) for d, w in words.items() for i in range(len(w) - least + 1)]
    at = {}
    for d, i in places:
        at.setdefault(tuple(words[d][i : i + least]), []).append((d, i))
    for group in at.values():
        for k, (d, i) in enumerate(group):
            for e, j in group[k + 1 :]:
                a, b = words[d], words[e]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                found.add(tuple(a[i : i + n]))
    out = set()
    for run in found:
        n = len(run)
        where = frozenset((d, i) for d, w in words.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == run)
        out.add((n, where))
    return out


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r["group_id"], r["words"]), set()).add((r["doc_id"], r["start"]))
    return {(n, frozenset(v)) for (g, n), v in out.items() if not g.startswith("text:")}


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = iter(range(10**9))
    passages = [[f"p{next(word)}" for _ in range(rng.randint(4, 30))] for _ in range(6)]
    docs = []
    for d in range(40):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [f"u{next(word)}" for _ in range(rng.randint(0, 6))]
            p = list(rng.choice(passages))
            a, z = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            p = p[a:z] if rng.random() < 0.4 else p
            if p and rng.random() < 0.3:
                p[rng.randrange(len(p))] = f"x{rng.randint(0, 3)}"
            w += p
        docs.append((d, " ".join(w)))
    docs += [(100, docs[3][1]), (101, docs[3][1])]
    got = groups_of(repeats.occurrences(spark.createDataFrame(docs, SCHEMA), LEAST, GRAM).collect())
    same = {d: [e for e, u in docs if u == t] for d, t in docs}
    assert got == {(n, frozenset((e, i) for d, i in where for e in same[d])) for n, where in brute(docs, LEAST)}


def test_planted_passage_copies_and_clean(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"a b {passage} c d"), (2, f"e {passage}\nf"), (3, passage), (4, passage), (5, " ".join(f"z{i}" for i in range(200)))]
    rows = repeats.occurrences(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4}
    assert groups_of(rows) == {(60, frozenset({(1, 2), (2, 1), (3, 0), (4, 0)}))}
    assert {(r["doc_id"], r["start"]) for r in rows if r["group_id"].startswith("text:")} == {(3, 0), (4, 0)}


def test_tree_is_linear_and_holds_every_occurrence(spark):
    line = [f"l{i}" for i in range(60)]
    docs = [(1, "the " * 3000), (2, "x " + "the " * 200 + "y"), (3, " ".join(line * 10))]
    rows = repeats.repeat_tree(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {tuple(r) for r in map(list, rows)} and len(rows) < 2 * (3000 + 200 + 10)
    places = [r for r in rows if r["kind"] == "place"]
    groups = [r for r in rows if r["kind"] == "repeat"]
    assert {(r["doc_id"], r["start"]) for r in places} == {(1, i) for i in range(2951)} | {(2, 1 + i) for i in range(151)} | {(3, 60 * i) for i in range(10)}
    # "the" said 50 to 2999 times, at each place where so many follow
    by_words = {r["words"]: r for r in groups if r["doc_id"] == 1}
    assert sorted(by_words) == list(range(50, 3000))
    assert all(r["n"] == (3001 - n) + max(0, 201 - n) for n, r in by_words.items())
    for n in (50, 200, 201, 2999):
        g = by_words[n]
        assert sum(g["tree"] == r["tree"] and g["lo"] <= r["lo"] <= g["hi"] for r in places) == g["n"]
    assert sorted(r["words"] for r in groups if r["doc_id"] == 3) == [60 * k for k in range(1, 10)]


def test_near_copies_give_linear_rows(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(40):
        w = list(base)
        w[rng.randrange(300)] = f"changed{d}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, SCHEMA)
    rows = repeats.repeat_tree(df).collect()
    places = sum(r["kind"] == "place" for r in rows)
    assert places <= 40 * 42 and sum(r["kind"] == "repeat" for r in rows) < places
    assert {r["doc_id"]: r["text"] for r in repeats.keep_first(df).collect()} == plain(docs, 50)

def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    docs = [(None, long, 1), (1, None, 1), (2, "", 1), (3, "one two", 1), (4, long, 1), (4, long, 1), (5, "t " + long, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int")
    assert groups_of(repeats.occurrences(df).collect()) == {(30_000, frozenset({(4, 0), (5, 1)}))}
    assert repeats.occurrences(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = repeats.keep_first(df)
    assert kept.columns == df.columns
    rows = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert rows == {(None, long), (1, None), (2, ""), (3, "one two"), (4, long), (5, "t")}


def test_keep_first_cuts_all_but_the_first(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = [(7, f"seven {passage} end"), (2, f"two, {passage}  more\nlines"), (9, passage), (1, "clean text")]
    df = spark.createDataFrame([(d, t, len(t), "s") for d, t in docs], "doc_id long, text string, n_chars long, source string")
    rows = {r["doc_id"]: r for r in repeats.keep_first(df).collect()}
    assert {d: r["text"] for d, r in rows.items()} == {7: "seven end", 2: docs[1][1], 1: "clean text"}
    assert rows[7]["n_chars"] == 9 and rows[7]["source"] == "s"


def test_anchor_guarantee():
    import numpy as np

    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2**63, 400, dtype=np.uint64)
    _, at = repeats.anchors(ids, np.array([0, 150, 160, 400]), 50, 16)
    for lo, hi in ((0, 150), (160, 400)):
        for p in range(lo, hi - 49):
            assert ((at >= p) & (at + 16 <= p + 50)).any()


def plain(docs, least):
    """The rows that ``keep_first`` has to leave: words not in a later occurrence of a maximal repeat, by brute force."""
    texts = {}
    for d, t in sorted(docs):
        texts.setdefault(t, d)
    gone = {d: set() for d, _ in docs}
    for n, where in brute(docs, least):
        for d, i in sorted(where)[1:]:
            gone[d].update(range(i, i + n))
    out = {}
    for d, t in docs:
        w = t.split()
        left = [x for i, x in enumerate(w) if i not in gone[d]] if texts[t] == d or len(w) < least else []
        if left or not w:
            out[d] = " ".join(left)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_occurrences_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [[f"a{i}" for i in range(n)] for n in (1, 2, 4, 5, 7)] + ["b c b b c".split()]
    docs = []
    for d in range(24):
        w = []
        for _ in range(rng.randint(1, 3)):
            w += [f"u{d}"] * rng.randint(0, 1) + rng.choice(lines) * rng.randint(2, 8) + [rng.choice("xyz")] * rng.randint(0, 2)
        docs.append((d, " ".join(w[rng.randint(0, 3) :])))
    docs.append((30, "n " * 40))
    df = spark.createDataFrame(docs, SCHEMA)
    rows = repeats.occurrences(df, LEAST, GRAM).collect()
    keys = [tuple(r) for r in rows]
    assert len(set(keys)) == len(keys)
    same = {d: [e for e, u in docs if u == t] for d, t in docs}
    assert groups_of(rows) == {(n, frozenset((e, i) for d, i in where for e in same[d])) for n, where in brute(docs, LEAST)}
    assert {r["doc_id"]: r["text"] for r in repeats.keep_first(df, LEAST, GRAM).collect()} == plain(docs, LEAST)


def test_repeated_line_keeps_every_occurrence(spark):
    line = " ".join(f"w{i}" for i in range(32))
    df = spark.createDataFrame([(1, " ".join([line] * 3)), (2, " ".join([line] * 8))], SCHEMA)
    groups = {n: where for n, where in groups_of(repeats.occurrences(df).collect())}
    assert groups[96] == {(1, 0)} | {(2, 32 * k) for k in range(6)}
    assert groups[224] == {(2, 0), (2, 32)}
    assert [(r["doc_id"], r["text"]) for r in repeats.keep_first(df).collect()] == [(1, line)]


def test_occurrences_name_every_copy(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"a {passage} b"), (2, f"c d {passage}"), (3, f"c d {passage}"), (3, "another text"), (4, f"c d {passage}"), (4, f"c d {passage}")]
    rows = repeats.occurrences(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 7
    assert groups_of(rows) == {(60, frozenset({(1, 1), (2, 2), (3, 2), (4, 2)}))}
    assert {(r["words"], r["doc_id"]) for r in rows if r["group_id"].startswith("text:")} == {(62, 2), (62, 3), (62, 4)}


def without_repeats(docs, least):
    """{id: words left}. A word goes if a run of ``least`` words over it occurs before, by id and place: just these runs make up
    the occurrences of maximal repeats that aren't the first."""
    seen, out = set(), {}
    for d in sorted(docs):
        words = docs[d].split()
        gone = [False] * len(words)
        for i in range(len(words) - least + 1):
            run = tuple(words[i : i + least])
            if run in seen:
                gone[i : i + least] = [True] * least
            seen.add(run)
        out[d] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def test_whole_table_against_plain_versions(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    words = {d: t.split() for d, t in docs.items()}
    rows = repeats.repeat_tree(table).collect()
    # every place of a run of 50 words that has two different words before it somewhere; equal texts count once for that
    first = {}
    for d in sorted(docs):
        first.setdefault(docs[d], d)
    before, where = {}, {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            where.setdefault(run, []).append((d, i))
            if first[docs[d]] == d:
                before.setdefault(run, set()).add(w[i - 1] if i else (d,))
    want = {p for run, at in where.items() if len(before[run]) > 1 for p in at}
    places = [r for r in rows if r["kind"] == "place"]
    assert {(r["doc_id"], r["start"]) for r in places} == want and len(places) == len(want) > 1000
    by_tree = {}
    for r in places:
        if first[docs[r["doc_id"]]] == r["doc_id"]:
            by_tree.setdefault(r["tree"], {}).setdefault(r["lo"], []).append((r["doc_id"], r["start"]))
    groups = [r for r in rows if r["kind"] == "repeat"]
    rng = random.Random(0)
    for g in rng.sample(groups, 300):
        n, own = g["words"], [p for rank in range(g["lo"], g["hi"] + 1) for p in by_tree[g["tree"]].get(rank, ())]
        texts = {tuple(words[d][i : i + n]) for d, i in own}
        assert len(texts) == 1 and len(own) == g["n"] and min(own) == (g["doc_id"], g["start"])
        assert len({words[d][i - 1] if i else (d,) for d, i in own}) > 1 and len({words[d][i + n] if i + n < len(words[d]) else (d,) for d, i in own}) > 1
        run = next(iter(texts))[:50]
        assert len(own) == sum(tuple(words[d][i : i + n]) in texts for d, i in where[run] if first[docs[d]] == d)
    longest = {}
    for g in groups:
        for rank in range(g["lo"], g["hi"] + 1):
            longest[g["tree"], rank] = max(g["words"], longest.get((g["tree"], rank), 0))
    assert all(r["words"] == longest[r["tree"], r["lo"]] for r in places)
    left = {r["doc_id"]: r["text"].split() for r in repeats.keep_first(table).collect()}
    assert all(left.get(d, []) == w for d, w in without_repeats(docs, 50).items())
