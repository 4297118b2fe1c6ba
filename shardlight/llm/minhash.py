"""MinHash near-duplicate groups by a multi-index Hamming join.

A text's signature has ``slots`` b-bit values: for each slot the smallest hash over the set of its words (ASCII
letters lowered, ASCII punctuation dropped), reduced to 16 bits. The distance of two texts is the number of slots
that differ. The slots are cut into ``chunks``; two signatures within ``radius`` differ, by pigeonhole, in at most
``radius // chunks`` slots of some chunk. The build allows one error a chunk and enumerates it: every chunk gives
one key for each slot left out, so every pair within the radius meets under at least one key. Nothing is capped.

Under a key, signatures are compared by breadth-first search from each member in turn: any member within the
radius of a reached one is reached, so the groups are exactly the connected components of the "within radius"
graph, without listing the quadratically many pairs of a large group. A key with more than ``TOGETHER`` of them is
cut into blocks, of which every two are compared in a place of their own. ``near_pairs`` lists all pairs.

Defined cases: rows with a null ``doc_id`` are left out, and the pipeline keeps them; null texts and texts
without words have no signature and are nobody's duplicates; rows that share a ``doc_id`` are one document, near
whatever any of its rows is near; equal texts, being at distance 0, are in one group; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, lean, only, sieved, written
from .textkit import FOLDED, U64, mix64, slices, split_words


@dataclass(frozen=True)
class Plan:
    """``radius`` < 2 * ``chunks``, so that some chunk has at most one error."""

    slots: int = 64
    radius: int = 23
    chunks: int = 12

    def __post_init__(self) -> None:
        if not 0 <= self.radius < 2 * self.chunks <= 2 * self.slots:
            raise ValueError("one error a chunk covers a radius below twice the number of chunks")


_KEYS = np.random.default_rng(20).integers(1, 1 << 63, (2, 4096), dtype=np.uint64)


def signatures(texts: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, one row of uint16 for each text with words, and those texts' indices."""
    rows, index = [], []
    for at, data, begin in slices(texts):
        words = split_words(data, begin, FOLDED)
        has = np.flatnonzero(np.diff(words.first))
        if not len(has):
            continue
        h, start = words.hashes(FOLDED), words.first[has]
        out = np.empty((len(has), slots), np.uint16)
        work = np.empty_like(h)
        for k in range(slots):
            np.bitwise_xor(h, _KEYS[0, k], out=work)
            work *= _KEYS[1, k] | U64(1)
            out[:, k] = mix64(np.minimum.reduceat(work, start)) & U64(0xFFFF)
        rows.append(out)
        index.append(at + has)
    return (np.concatenate(rows), np.concatenate(index)) if rows else (np.zeros((0, slots), np.uint16), np.zeros(0, np.int64))


def signed(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, sig) of each row that has an id and words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, index = signatures(b.column("text"), plan.slots)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * plan.slots), len(sig), [None, pa.py_buffer(sig.tobytes())]) if len(sig) else pa.array([], pa.binary(2 * plan.slots))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(index)), flat.cast(pa.binary())], ["doc_id", "sig"])

    rows = only(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, sig binary")


def _matrix(column: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, slots)


def keys_of(sig: np.ndarray, chunks: int) -> np.ndarray:
    """Keys of each signature: for each chunk, one for each of its slots left out."""
    n, slots = sig.shape
    each = mix64((sig.astype(U64) + U64(1)) * _KEYS[0, :slots] + _KEYS[1, :slots])
    out = np.empty((n, slots), U64)
    for part in np.array_split(np.arange(slots), chunks):
        out[:, part] = mix64(each[:, part].sum(1, dtype=U64)[:, None] - each[:, part] + _KEYS[0, 2048 + part])
    return out


def search(groups: list[np.ndarray], ids: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each group's rows into the components of its within-radius graph."""
    left, right = [], []
    pairs = np.array([g for g in groups if len(g) == 2], np.int64).reshape(-1, 2)
    ok = (sig[pairs[:, 0]] != sig[pairs[:, 1]]).sum(1) <= radius
    left.append(ids[pairs[ok, 0]])
    right.append(ids[pairs[ok, 1]])
    for g in groups:
        if len(g) == 2:
            continue
        rest, queue = g, []
        while len(rest):
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            here = queue.pop()
            near = (sig[rest] != sig[here]).sum(1) <= radius
            queue += list(rest[near])
            left.append(ids[rest[near]])
            right.append(np.full(int(near.sum()), ids[here]))
            rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroups batches sorted by ``key`` so that no run of equal keys is cut: (rows, bounds of the runs)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cut = int(np.searchsorted(-(k != k[-1]).astype(np.int8), 0))  # where the batch's last run begins
        if last is not None and k[0] != last and held:
            yield _bounds(pa.Table.from_batches(held), key)
            held = []
        if cut:
            yield _bounds(pa.Table.from_batches([*held, b.slice(0, cut)]), key)
            held = []
        held.append(b.slice(cut))
        last = k[-1]
    if held:
        yield _bounds(pa.Table.from_batches(held), key)


def _bounds(t: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    k = np.asarray(t[key])
    return t, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def _keyed(reps: DataFrame, plan: Plan) -> DataFrame:
    """(key, rep): all keys of every signature."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = keys_of(_matrix(b.column("sig"), plan.slots), plan.chunks).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(b.column("rep")), plan.slots))], ["key", "rep"])

    return only(reps, "rep", "sig").mapInArrow(run, "key long, rep long")


def met(reps: DataFrame, plan: Plan) -> DataFrame:
    """(key, rep, n) of the keys under which ``n`` > 1 signatures meet; of keys with the same members one stays.

    Counted with partial aggregates, so a key that many share isn't one task's; only signatures with such a key are then looked up.
    """
    members = {"n": F.count("*"), "members": F.bit_xor(F.xxhash64("rep")), "least": F.min("rep")}
    by_key = _keyed(reps, plan).groupBy("key").agg(*[c.alias(k) for k, c in members.items()]).where("n > 1")
    chosen = written(by_key.groupBy("n", "members", "least").agg(F.min("key").alias("chosen")).select("chosen", "n"), "keys")
    maybe, _ = sieved(_keyed(reps, plan), F.col("key"), chosen.select("chosen"))
    return maybe.join(chosen, maybe.key == chosen.chosen).select("key", "rep", "n")


#: Signatures under one key that are compared in one place; more are cut into blocks, and each pair of blocks is one.
TOGETHER = 4096


def _compared(reps: DataFrame, plan: Plan, all_pairs: bool, together: int = TOGETHER) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, "place"):
            ids, sig = np.asarray(t["rep"]), _matrix(t["sig"], plan.slots)
            groups = [np.arange(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if all_pairs:
                groups = [np.stack(np.triu_indices(len(g), 1), 1)[:, :] + g[0] for g in groups]
                groups = list(np.concatenate(groups)) if groups else []
            a, b = search(groups, ids, sig, plan.radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    rows = met(reps, plan).withColumn("blocks", F.ceil(F.col("n") / together)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    rows = rows.select(place.alias("place"), "rep").join(reps, "rep").repartition("place").sortWithinPartitions("place")
    return rows.select("place", "rep", "sig").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node that isn't its component's smallest: alternating large and small stars."""
    edges = written(edges, "edges")
    print_of = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        stars = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, written(stars, "stars")
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == print_of:
            return edges.select("a", F.col("b").alias("root"))
        print_of = now


@dataclass(frozen=True)
class Signed:
    sig: DataFrame
    of_rep: DataFrame
    reps: DataFrame


def prepared(docs: DataFrame, plan: Plan) -> Signed:
    """Signatures; the smallest id of each distinct signature stands for all of them."""
    sig = written(signed(docs, plan), "signatures")
    reps = written(sig.groupBy("sig").agg(F.min("doc_id").alias("rep")), "representatives")
    return Signed(sig, written(sig.join(reps, "sig").select("doc_id", "rep"), "members"), reps)


def near_groups(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near duplicate; ``group_id`` is the smallest id, the one kept."""
    s = prepared(docs, plan)
    several = s.of_rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").drop("top")
    same_id = s.of_rep.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    roots = components(_compared(s.reps, plan, False).unionByName(same_id).distinct())
    member = s.of_rep.join(roots, s.of_rep.rep == roots.a, "left").select("doc_id", F.coalesce("root", "rep").alias("group_id")).where("doc_id <> group_id").distinct()
    dropped = written(member, "duplicates")
    return dropped.withColumn("keep", F.lit(False)).unionByName(dropped.select(F.col("group_id").alias("doc_id"), "group_id").distinct().withColumn("keep", F.lit(True)))


def near_pairs(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """All pairs (a, b), a > b, of distinct signatures' first documents within the radius."""
    return _compared(prepared(docs, plan).reps, plan, True)


def keep_one(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents without those that ``near_groups`` doesn't keep; of rows that share an id, the one with the smallest text."""
    gone = near_groups(docs, plan).where("NOT keep").select(F.col("doc_id").alias("__gone"))
    maybe, clear = sieved(docs, docs["`doc_id`"].cast("long"), gone)
    left = clear.unionByName(maybe.join(gone, maybe["`doc_id`"].cast("long") == gone["__gone"], "left_anti"))
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    again = written(ids, "repeated-ids")
    if again.isEmpty():
        return left
    once = left.join(again, left["`doc_id`"] == again["__again"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return once.unionByName(left.join(again, left["`doc_id`"] == again["__again"], "left_semi").withColumn("__rank", rank).where("__rank = 1").drop("__rank"))
