"""Exact top-k search with KD-trees by shard: the queries are the rows whose id is divisible by ``every``, against all rows.

Vectors are spread over shards by median splits that a bounded sample gives (the sample decides only where a row
goes, never what is found); a crowded part is cut again by a hash, so a shard has about ``shard`` rows whatever the data. In each shard
a KD-tree is built by median splits on the widest side, with a tight box at every node. A search first goes down to the nearest
leaf, which gives a k-th distance, then down all sub-trees whose boxes aren't farther, and visits the leaves left over best-first, by the
distance from query to box, tightening the k-th distance as it goes. A block of queries goes in lockstep, so a
step is a few matrix products; candidates near the bound get their exact distance.

Shards are visited best-first too: every query goes to the shard with the nearest box, then, with the k-th distance that gave, to the next
few whose boxes aren't farther, then to the rest of those, with what these gave. The shards' boxes are given to all tasks; a shard grows
where their number would take more than ``BOXES`` bytes, which bounds them.

Neighbours are ordered by distance, then id; a vector's neighbours never have its own id. Distances are Euclidean. Of equal vectors
no query can need more than the ``k + 1`` smallest ids, so only these go into the trees, and copies crowd no shard.

Defined cases: rows with a null id or vector, or a vector with nulls or NaN, or empty, are left out; repeated rows
count once; rows that share an id but not the vector are queries each, told apart by nothing but their results;
vectors of different lengths never meet; with fewer than k others, all are given; equal distances go by id; other
columns aren't read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, only, written

K, EVERY, SHARD, LEAF, SAMPLE, BLOCK, BOXES, AHEAD = 10, 20, 8192, 128, 4096, 1024, 32 << 20, 4


def gaps(lo: np.ndarray, hi: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances from queries to boxes, row by row."""
    gap = np.maximum(np.maximum(lo - queries, queries - hi), 0)
    return np.einsum("...j,...j->...", gap, gap)


class Tree:
    """Points in leaf order. Node i has the points ``first[i]`` to ``last[i]``, a tight box, and children ``left[i]`` and ``right[i]`` or -1."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        first, last, left, right = [0], [len(points)], [-1], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            a, z = first[node], last[node]
            if z - a <= leaf:
                continue
            own = points[order[a:z]]
            side = int((own.max(0) - own.min(0)).argmax())
            order[a:z] = order[a:z][np.argpartition(own[:, side], (z - a) // 2)]
            middle = a + (z - a) // 2
            for child, (s, e) in ((left, (a, middle)), (right, (middle, z))):
                child[node] = len(first)
                todo.append(len(first))
                first.append(s)
                last.append(e)
                left.append(-1)
                right.append(-1)
        self.points, self.ids = points[order], ids[order]
        self.first, self.last, self.left, self.right = (np.array(x) for x in (first, last, left, right))
        self.lo = np.stack([self.points[a:z].min(0) for a, z in zip(first, last, strict=True)])
        self.hi = np.stack([self.points[a:z].max(0) for a, z in zip(first, last, strict=True)])
        self.norms = (self.points**2).sum(1)

    def nearest_leaf(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query comes to when it takes the nearer child at every node."""
        at = np.zeros(len(queries), np.int64)
        while len(inner := np.flatnonzero(self.left[at] >= 0)):
            a, b = self.left[at[inner]], self.right[at[inner]]
            nearer = gaps(self.lo[a], self.hi[a], queries[inner]) <= gaps(self.lo[b], self.hi[b], queries[inner])
            at[inner] = np.where(nearer, a, b)
        return at

    def leaves_within(self, queries: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, squared distance) of the leaves whose boxes, and those of all nodes above, aren't farther than ``kth``."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found: list[tuple] = []
        while len(q):
            d = gaps(self.lo[node], self.hi[node], queries[q])
            ok = d <= kth[q] * (1 + 1e-12)
            q, node, d = q[ok], node[ok], d[ok]
            leaf = self.left[node] < 0
            found.append((q[leaf], node[leaf], d[leaf]))
            q, node = q[~leaf], node[~leaf]
            q, node = np.concatenate([q, q]), np.concatenate([self.left[node], self.right[node]])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and ids of the k nearest within ``kth`` (squared); inf and -1 fill up."""
        best, who = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
        kth, norms = kth.copy(), (queries**2).sum(1)
        home = self.nearest_leaf(queries)
        self._visit(np.arange(len(queries)), home, queries, norms, own, k, kth, best, who)
        q, leaf, d = self.leaves_within(queries, kth)
        away = leaf != home[q]
        q, leaf, d = q[away], leaf[away], d[away]
        order = np.lexsort((d, q))
        q, leaf, d = q[order], leaf[order], d[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for r in range(int(turn.max(initial=-1)) + 1):  # every query's nearest leaf, then its next
            now = np.flatnonzero(turn == r)
            now = now[d[now] <= kth[q[now]] * (1 + 1e-12)]
            if not len(now):
                break
            self._visit(q[now], leaf[now], queries, norms, own, k, kth, best, who)
        return best, who

    def _visit(self, rows: np.ndarray, leaf: np.ndarray, queries: np.ndarray, norms: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        rows, leaf = rows[order], leaf[order]
        edges = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(rows))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            q, s = rows[a:z], slice(self.first[leaf[a]], self.last[leaf[a]])
            rough = norms[q, None] + self.norms[s] - 2 * (queries[q] @ self.points[s].T)
            rough[own[q, None] == self.ids[s]] = np.inf
            limit = kth[q]
            slack = 1e-9 * (1 + norms[q] + self.norms[s].max(initial=0))
            if rough.shape[1] > k:
                limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
            i, j = np.nonzero(np.isfinite(rough) & (rough <= (limit + slack)[:, None]))
            if not len(i):
                continue
            exact = ((queries[q[i]] - self.points[s][j]) ** 2).sum(1)
            # put the candidates beside the best so far, one row a query
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            wide = nth.max() + 1
            d, n = np.full((len(q), k + wide), np.inf), np.full((len(q), k + wide), np.iinfo(np.int64).max)
            d[:, :k], n[:, :k] = best[q], np.where(who[q] < 0, np.iinfo(np.int64).max, who[q])
            d[i, k + nth], n[i, k + nth] = exact, self.ids[s][j]
            order = np.lexsort((n, d), axis=1)[:, :k]
            best[q] = np.take_along_axis(d, order, 1)
            who[q] = np.where(np.isinf(best[q]), -1, np.take_along_axis(n, order, 1))
            kth[q] = np.minimum(kth[q], best[q, k - 1])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _splits(sample: np.ndarray, depth: int) -> list:
    """A tree of (side, cut, left, right); None is a shard."""
    if depth == 0 or len(sample) < 2:
        return None
    side = int((sample.max(0) - sample.min(0)).argmax())
    cut = float(np.median(sample[:, side]))
    below = sample[:, side] <= cut
    return (side, cut, _splits(sample[below], depth - 1), _splits(sample[~below], depth - 1))


def _route(splits: object, x: np.ndarray, rows: np.ndarray, out: np.ndarray, path: int = 1) -> None:
    if splits is None:
        out[rows] = path
        return
    side, cut, left, right = splits
    below = x[rows, side] <= cut
    _route(left, x, rows[below], out, 2 * path)
    _route(right, x, rows[~below], out, 2 * path + 1)


def _sharded(points: DataFrame, size: int) -> DataFrame:
    """(shard, id, v) of (id, v, dim); vectors of one shard have one length."""
    counts = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    splits: dict[int, object] = dict.fromkeys(counts)
    # as many shards as the bytes of their boxes allow, shared by the lengths
    size = max([size, *(-(-n * 16 * dim * len(counts) // BOXES) for dim, n in counts.items())])
    for dim, n in counts.items():
        if n > size:
            sample = points.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
            splits[dim] = _splits(_vectors(sample["v"]), int(np.ceil(np.log2(n / size))))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, part = np.asarray(b.column("dim")), np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = np.zeros(len(rows), np.int64)
                _route(splits[int(dim)], _vectors(b.column("v").take(pa.array(rows))), np.arange(len(rows)), own)
                part[rows] = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    routed = written(points.mapInArrow(run, "id long, v array<double>, dim int, part long"), "routed")
    crowded = routed.groupBy("dim", "part").agg(F.ceil(F.count("*") / size).alias("pieces"))
    cut = F.pmod(F.xxhash64("id"), F.col("pieces"))
    return routed.join(crowded, ["dim", "part"]).select(F.xxhash64("dim", "part", cut).alias("shard"), "id", "v")


def _boxes(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shards, lo, hi) of the shards' boxes by length of the vectors, within ``BOXES`` bytes in all, about."""

    def box(key: tuple, t: pa.Table) -> pa.Table:
        x = _vectors(t["v"])
        return pa.table({"shard": [key[0].as_py()], "lo": [x.min(0)], "hi": [x.max(0)]})

    rows = points.groupBy("shard").applyInArrow(box, "shard long, lo array<double>, hi array<double>").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["lo"]), []).append(r)
    return {dim: (np.array([r["shard"] for r in own]), np.array([r["lo"] for r in own]), np.array([r["hi"] for r in own])) for dim, own in by.items()}


ASKED = "shard long, id long, query long, v array<double>, kth double"
FOUND = "query long, id long, neighbour long, d2 double"


def _asked(queries: DataFrame, boxes: dict, begin: int, end: int | None) -> DataFrame:
    """Each query once for each shard whose box isn't farther than its k-th distance, those from the ``begin``-th nearest to before the ``end``-th."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("v").value_lengths())
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                shards, lo, hi = boxes[int(dim)]
                block = max(1, (1 << 22) // lo.size)
                for i in range(0, len(of), block):
                    rows = of[i : i + block]
                    x, kth = _vectors(b.column("v").take(pa.array(rows))), np.asarray(b.column("kth"))[rows]
                    d = gaps(lo, hi, x[:, None])
                    rank = np.argsort(d, axis=1, kind="stable")[:, begin:end]
                    q, r = np.nonzero(np.take_along_axis(d, rank, 1) <= kth[:, None] * (1 + 1e-9))
                    for c in range(0, len(q), 1 << 14):
                        own, s = pa.array(rows[q[c : c + (1 << 14)]]), shards[rank[q[c : c + (1 << 14)], r[c : c + (1 << 14)]]]
                        yield pa.RecordBatch.from_arrays([pa.array(s), *(b.column(n).take(own) for n in ("id", "query", "v", "kth"))], ["shard", "id", "query", "v", "kth"])

    return queries.mapInArrow(run, ASKED)


def _answered(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What the shards have for the queries that come to them. A task has one shard's tree at a time; its queries stream past in batches."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            keys, is_query = np.asarray(b.column("shard")), b.column("query").is_valid().to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (is_query[1:] != is_query[:-1]))), len(keys))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                c = b.slice(a, z - a)
                if keys[a] != shard:
                    shard, tree, own = keys[a], None, []
                if not is_query[a]:
                    own.append((_vectors(c.column("v")), np.asarray(c.column("id"))))
                    continue
                if tree is None and own:
                    tree, own = Tree(*(np.concatenate(x) for x in zip(*own, strict=True))), []
                for i in range(0, z - a if tree else 0, BLOCK):
                    q = c.slice(i, BLOCK)
                    ids = np.asarray(q.column("id"))
                    best, who = tree.search(_vectors(q.column("v")), ids, k, np.asarray(q.column("kth")))
                    n = (who >= 0).sum(1)
                    made = (np.repeat(np.asarray(q.column("query")), n), np.repeat(ids, n), who[who >= 0], best[who >= 0])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["query", "id", "neighbour", "d2"])

    none = points.select("shard", "id", F.lit(None).cast("long").alias("query"), "v", F.lit(None).cast("double").alias("kth"))
    # a shard's points come first
    rows = none.join(asked.select("shard").distinct(), "shard", "left_semi").unionByName(asked)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first()).mapInArrow(run, FOUND)


def nearest(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, every: int = EVERY, shard: int = SHARD) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest others of every row whose id is divisible by ``every``, rank from 1."""
    own = only(rows, id_column, vector_column).toDF("id", "v").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    clean = own.where("id IS NOT NULL AND size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).distinct()
    clean = written(clean, "vectors")
    same = Window.partitionBy("v").orderBy("id")
    needed = clean.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).select("id", "v", F.size("v").alias("dim"))
    points = written(_sharded(written(needed, "needed"), shard), "shards")
    boxes = _boxes(points)
    queries = clean.where(F.col("id") % every == 0).select("id", F.xxhash64("id", "v").alias("query"), "v", F.lit(float("inf")).alias("kth"))
    order = Window.partitionBy("query").orderBy("d2", "neighbour")
    best = None
    for begin, end in ((0, 1), (1, 1 + AHEAD), (1 + AHEAD, None)):
        if begin and max((len(s) for s, _, _ in boxes.values()), default=0) <= begin:
            break
        if best is not None:
            kth = best.groupBy("query").agg(F.count("*").alias("n"), F.max("d2").alias("far"))
            queries = queries.drop("kth").join(kth, "query", "left").select("id", "query", "v", F.when(F.col("n") == k, F.col("far")).otherwise(F.lit(float("inf"))).alias("kth"))
        found = _answered(points, written(_asked(queries, boxes, begin, end), "asked"), k)
        found = found if best is None else best.unionByName(found)
        best = written(found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "nearest")
    return best.select("id", F.row_number().over(order).alias("rank"), "neighbour", F.round(F.sqrt("d2"), 6).alias("distance"))


#: ``nearest`` over ``embeddings`` by comparing every query with all rows.
SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), p AS (
  SELECT a.id, b.id AS neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
  FROM v a JOIN v b ON a.id % {EVERY} = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
)
SELECT id, CAST(r AS INTEGER) AS rank, neighbour, round(sqrt(d2), 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS r FROM p) WHERE r <= {K}
"""
