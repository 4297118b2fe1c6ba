"""Best-fit packing of documents into bins of ``capacity`` tokens, after a Martello-Toth dominance reduction.

Documents of one length are interchangeable, so the plan is made from the histogram of lengths, which has at most
``capacity`` rows whatever the corpus: first ``reduce_instance`` permanently fixes sets of up to three documents that
provably dominate every other set with the same largest document, then ``best_fit`` packs what is left in
decreasing order, each item into the fullest bin that takes it. Both work on whole multiplicities, and the result
is the one that packing item by item would give. Documents then find their place by their rank within their length.

A text longer than a bin is cut into full bins and a remainder. Tokens are words, as in ``mixing``.

Defined cases: null texts and texts without words take no place and aren't in the result; rows that share an id,
or have none, are packed one by one; equal lengths are ranked by a hash of the id, then the id; other columns
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import tokens
from .shared import lean, only, written

CAPACITY = 2048
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _dominant(count: np.ndarray, top: int) -> tuple[int, ...] | None:
    """The companions of the item ``top`` in a set that dominates all others, or None where none is proved."""
    room = len(count) - 1 - top
    count = count.copy()
    count[top] -= 1
    fit = np.flatnonzero(count[: room + 1])
    if not len(fit):
        return ()
    smallest = np.repeat(fit[:3], np.minimum(count[fit[:3]], 3))[:3]
    large = int(fit[-1])
    if large == room or len(smallest) < 2 or smallest[:2].sum() > room:
        return (large,)  # it fills the bin, or nothing else fits beside any companion
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    # at most two companions: the best pair below the room
    partner = fit[np.searchsorted(fit, room - fit, "right") - 1]
    ok = (fit + partner <= room) & ((fit != partner) | (count[fit] > 1))
    lower = np.where(partner == fit, np.concatenate([[0], fit[:-1]])[np.searchsorted(fit, partner)], partner)
    sums = np.where(ok, fit + partner, np.where((lower > 0) & (fit + lower <= room), fit + lower, 0))
    if large >= sums.max():
        return (large,)
    count[large] -= 1
    below = np.flatnonzero(count[: room - large + 1])
    if not len(below):
        return None
    small = int(below[-1])
    between = np.flatnonzero(count[small + 1 : large]) + small + 1
    two = np.repeat(between[:2], np.minimum(count[between[:2]], 2))[:2]
    return (large, small) if len(two) < 2 or two.sum() > room else None


def reduce_instance(count: np.ndarray) -> tuple[list[Pattern], np.ndarray]:
    """Fixed patterns, and the histogram of what remains; ``count[n]`` is the number of items of length n."""
    count, fixed = count.copy(), []
    again = True
    while again:
        again = False
        for top in range(len(count) - 1, 0, -1):
            while count[top]:
                companions = _dominant(count, top)
                if companions is None:
                    break
                need: dict[int, int] = {}
                for x in (top, *companions):
                    need[x] = need.get(x, 0) + 1
                # the proof stays good while the same items last
                times = min(int(count[x]) // k for x, k in need.items())
                for x, k in need.items():
                    count[x] -= k * times
                fixed.append((tuple(need.items()), times))
                again = True
    return fixed, count


def best_fit(count: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing over multiplicities: groups of equal bins by the room that they have left."""
    capacity = len(count) - 1
    open_: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, bins: int) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((items, bins))

    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                room, items, bins = capacity, (), -(-left // (capacity // size))
            else:
                room = rooms[i]
                items, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            each = room // size
            full = min(bins, left // each)
            put(room - each * size, (*items, (size, each)), full)
            left -= full * each
            bins -= full
            if left and bins:
                put(room - left * size, (*items, (size, left)), 1)
                bins, left = bins - 1, 0
            if items:
                put(room, items, bins)
    return [g for groups in open_.values() for g in groups]


def plan(count: np.ndarray) -> list[Pattern]:
    fixed, rest = reduce_instance(count)
    return fixed + best_fit(rest)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with the first bin, items a bin and offset that they get; sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for items, bins in patterns:
        offset = 0
        for size, each in items:
            lo = used.get(size, 0)
            used[size] = lo + each * bins
            rows.append((size, lo, base, each, offset))
            offset += size * each
        base += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "lo", "base", "each", "offset"), table.T, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (bin_id, doc_id, part, position, length): where each piece of each document lies."""
    lengths = only(docs, "doc_id", "text").select("doc_id", tokens(F.col("text")).alias("n")).where("n > 0")
    last = F.ceil(F.col("n") / capacity).cast("int") - 1
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    length = F.least(F.lit(capacity), F.col("n") - F.col("part").cast("long") * capacity).cast("int")
    # ranks are counted within (length, sub); full pieces, the commonest, have more subs
    h = F.xxhash64("doc_id", "part")
    pieces = pieces.select("doc_id", "part", length.alias("length")).withColumn("sub", F.when(F.col("length") == capacity, F.pmod(h, F.lit(4096))).otherwise(F.pmod(h, F.lit(64))).cast("int"))
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("length", "sub").agg(F.count("*").alias("n")), "counts")  # at most 64 * capacity + 4096 rows
    hist = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        hist[row["length"]] = row["n"]
    places = _places(plan(hist))
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places["size"] << 48 | places["lo"]
        for b in batches:
            size, rank = np.asarray(b.column("length")).astype(np.int64), np.asarray(b.column("rank"))
            at = np.searchsorted(key, size << 48 | rank, "right") - 1
            nth = rank - places["lo"][at]
            each = places["each"][at]
            bins, position = places["base"][at] + nth // each, places["offset"][at] + nth % each * size
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("doc_id"), b.column("part"), pa.array(position.astype(np.int32)), b.column("length")], ["bin_id", "doc_id", "part", "position", "length"])

    order = Window.partitionBy("length", "sub").orderBy("doc_id", "part")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(offsets, ["length", "sub"])
    ranked = ranked.select(F.col("doc_id").cast("long").alias("doc_id"), "part", "length", (F.col("start") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(run, "bin_id long, doc_id long, part int, position int, length int")
