"""Suffix-array deduplication: maximal repeats of at least ``least`` words, with all their occurrences.

A word is a run of bytes other than white space, and a repeat is a run of words that occurs at two places at least
and can't be extended: its occurrences have different next words (right-maximal, a node of the suffix tree) and
different words before (left-maximal). All suffixes that share their first ``least`` words form one sub-tree, so
the enhanced suffix array is built sub-tree by sub-tree, in parallel: the suffixes are sorted, the common prefixes
of neighbours are scanned with a stack, which closes each interval of the common-prefix interval tree, and the set
of left words is united upwards; an interval with two left words is a group.

Finding the suffixes that need this takes four passes, none of which drops a case:

1. Anchors. In every window of ``least - GRAM + 1`` runs of ``GRAM`` words the smallest hash is an anchor. Equal
   windows have equal anchors, so a repeat holds, in every ``least`` words, an anchor that occurs elsewhere.
2. Zones. Only windows whose anchor occurs elsewhere go on, as hashes of words.
3. Ends. A run of ``least`` words that has two different words before it somewhere is where a repeat can start, one with two
   different words after is where one can end. Both come from one aggregate by run. Between two ends all occurrences go on alike.
4. Paths. So a suffix is written as the hashes of its stretches from end to end, up to the first after which it goes
   on alone: a few numbers, however long the repeat. Equal stretches in a row are one, with a count, so a line said over and
   over costs little. Suffixes with equal paths are aggregated before they are sorted.

The scan streams: it holds one suffix and the stack. Its output is linear in its input. ``repeat_tree`` gives it as it is: each place
once, with its rank in the suffix array of its sub-tree, and each group as an interval ``lo`` to ``hi`` of ranks; the group's occurrences are
all places of that tree with a rank in it. ``occurrences`` writes these out, a row for each: (group_id, words, doc_id, start). That is
as long as the repeats are nested: a text that says a short line over and over has one for each length.

Equal texts are one text while repeats are sought, as they share them all; then each place is listed under every id that has
the text. The equal texts themselves are a group too, of all their ids.

Defined cases: null ids and null texts are left out (the pipeline keeps these rows as they are);
texts shorter than ``least`` words have no repeats; rows that share id and text are one; rows that share an id
but not the text both count, with the same id; repeats inside one document count; ``start`` is in words; other columns aren't read;
an empty table gives none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, only, sieved, written
from .textkit import U64, _pow_tables, buffers, mix64, prefix_sums, run_hashes, slices, split_words

LEAST, GRAM = 50, 16


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minima(words: np.ndarray, first: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``gram`` words, where they begin, and for each the smallest of the window of ``least`` words that begins there.

    A window that would span two texts has 0.
    """
    width = least - gram + 1
    h, at = run_hashes(words, first, gram)
    size = np.diff(np.searchsorted(at, first))
    if not len(h) or size.max() < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    least_of = window_minima(h, width)
    text = np.repeat(np.arange(len(size)), size)
    return h, at, np.where(text[: len(least_of)] == text[width - 1 :], least_of, U64(0))


def anchors(words: np.ndarray, first: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of anchors and the words at which they begin; windows never span two texts."""
    h, at, least_of = minima(words, first, least, gram)
    if not len(h):
        return h, at
    # a run is an anchor if it is the minimum of a window that holds it: the largest minimum of its windows equals it
    pad = np.zeros(least - gram, U64)
    chosen = ~window_minima(~np.concatenate([pad, least_of, pad]), least - gram + 1) == h
    return h[chosen], at[chosen]


def _anchored(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(anchor, h1, twice): the anchors of each row's text, each once; ``twice`` where the text has it twice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.asarray(b.column("h1"))
            for i, data, begin in slices(b.column("text")):
                words = split_words(data, begin)
                h, at = anchors(words.hashes(), words.first, least, gram)
                text = np.searchsorted(words.first, at, "right") - 1
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                twice = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(keys[i + text[new]]), pa.array(twice)], ["anchor", "h1", "twice"])

    return rows.mapInArrow(run, "anchor long, h1 long, twice boolean")


ZONE = "doc long, h1 long, zone int, left long, right long, words binary"
_INT64, _INT32 = pa.int64(), pa.int32()


def _zones(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Stretches of windows of ``least`` words whose smallest hash is an anchor that occurs elsewhere: the hashes of their words.

    ``left`` and ``right`` are the words around, null at the text's ends.
    """
    kinds = (_INT64, _INT64, _INT32, _INT64, _INT64, pa.binary())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys, hits = np.asarray(b.column("doc")), np.asarray(b.column("h1")), b.column("hits")
            for i, data, begin in slices(b.column("text")):
                words = split_words(data, begin)
                ids = words.hashes()
                _, at, least_of = minima(ids, words.first, least, gram)
                bounds = np.searchsorted(at[: len(least_of)], words.first)
                out: list[tuple] = []
                for k in range(len(begin) - 1):
                    own = slice(bounds[k], bounds[k + 1])
                    pos = at[own][np.isin(least_of[own].view(np.int64), np.asarray(hits[i + k].values))]
                    lo, hi = words.first[k], words.first[k + 1]
                    if not len(pos):
                        continue
                    breaks = np.flatnonzero(np.diff(pos) > 1)
                    for a, z in zip(pos[np.append(0, breaks + 1)].tolist(), (pos[np.append(breaks, len(pos) - 1)] + least).tolist(), strict=True):
                        left = int(ids[a - 1].view(np.int64)) if a > lo else None
                        right = int(ids[z].view(np.int64)) if z < hi else None
                        out.append((int(docs[i + k]), int(keys[i + k]), a - int(lo), left, right, ids[a:z].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "h1", "zone", "left", "right", "words"])

    return rows.mapInArrow(run, ZONE)


_CHAIN = ("run", "left", "inner_left", "right", "inner_right", "doc", "h1", "end", "step", "zone", "at", "every", "links")


def _starts(zones: DataFrame, least: int) -> DataFrame:
    """The chains of runs of ``least`` words in a zone, with the words before and after.

    The run is also found at ``at + every``, ``at + 2 * every`` and so on, ``links`` times, each less than ``least`` words after
    the last. ``left`` is the word before the first, ``inner_left`` that before the others; ``right`` is the word after the last, ``inner_right``
    that after the others. At a text's ends they are values of their own. ``end`` is the sum of the hashes of the zone's words up to
    the end of the first run and ``step`` that of the ``every`` words after it, so that all words between two runs can be hashed.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("words")
            sizes = np.diff(buffers(column)[1]) // 8
            keys = {c: np.asarray(b.column(c)) for c in ("doc", "h1", "zone")}
            edges = {c: (b.column(c).fill_null(0).to_numpy(zero_copy_only=False), b.column(c).is_null().to_numpy(zero_copy_only=False)) for c in ("left", "right")}
            upto, a = np.cumsum(sizes), 0
            while a < b.num_rows:  # some zones at a time
                z = max(a + 1, int(np.searchsorted(upto, upto[a] - sizes[a] + (1 << 17), "right")))
                words = buffers(column.slice(a, z - a))[0].view(U64)
                yield _chains(words, np.concatenate([[0], np.cumsum(sizes[a:z])]), {c: v[a:z] for c, v in keys.items()}, {c: (v[a:z], n[a:z]) for c, (v, n) in edges.items()}, least)
                a = z

    return zones.mapInArrow(run, ", ".join(f"{c} {'long' if k < 9 else 'int'}" for k, c in enumerate(_CHAIN)))


def _chains(words: np.ndarray, first: np.ndarray, keys: dict, edges: dict, least: int) -> pa.RecordBatch:
    h, at = run_hashes(words, first, least)
    of = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, h, of))
    h, at, of = h[order], at[order], of[order]
    step = np.zeros(len(h), np.int64)
    step[1:] = np.where((h[1:] == h[:-1]) & (of[1:] == of[:-1]) & (at[1:] - at[:-1] < least), at[1:] - at[:-1], 0)
    link = step > 0
    # a run may follow itself at two distances: a new chain begins where the step changes
    link[1:] &= (step[1:] == step[:-1]) | (step[:-1] == 0)
    begin = np.flatnonzero(~link)
    links = np.diff(np.append(begin, len(h))) - 1
    every = np.where(links > 0, step[np.minimum(begin + 1, len(h) - 1)], 0) if len(h) else links
    at, of, h = at[begin], of[begin], h[begin]
    last = at + links * every
    own = mix64(keys["doc"][of].view(U64) ^ mix64(keys["h1"][of].view(U64)) ^ mix64((keys["zone"][of] + at - first[of]).astype(U64)))
    inside = at > first[of]
    left = np.where(inside, words[np.maximum(at - 1, 0)].view(np.int64), np.where(edges["left"][1][of], own.view(np.int64), edges["left"][0][of]))
    inside = last + least < first[of + 1]
    right = np.where(inside, words[np.minimum(last + least, len(words) - 1)].view(np.int64), np.where(edges["right"][1][of], mix64(own).view(np.int64), edges["right"][0][of]))
    inner_left = np.where(links > 0, words[np.maximum(at + every - 1, 0)].view(np.int64), left)
    inner_right = np.where(links > 0, words[np.minimum(at + least, len(words) - 1)].view(np.int64), right)
    # sums from the zone's first word
    sums = prefix_sums(words)
    _, down = _pow_tables(len(words) + 1)
    end = (sums[at + least] - sums[first[of]]) * down[first[of]]
    ahead = (sums[np.minimum(at + least + every, len(words))] - sums[at + least]) * down[first[of]]
    rel = (at - first[of]).astype(np.int32)
    columns = (h.view(np.int64), left, inner_left, right, inner_right, keys["doc"][of], keys["h1"][of], end.view(np.int64), ahead.view(np.int64), keys["zone"][of], rel, every.astype(np.int32), links.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_CHAIN))


#: A stretch of a path: its hash, which way the path goes on, how often it follows itself, its words. Big-endian, so that bytes sort as numbers.
TOKEN = np.dtype([("hash", ">u8"), ("up", "u1"), ("times", ">u4"), ("words", ">u4")])


def _spans(sums: np.ndarray, at: np.ndarray, till_sums: np.ndarray, till: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``at`` to ``till``, of which the sums from the zone's start are given."""
    _, down = _pow_tables(int(till.max(initial=0)) + 1)
    return mix64((till_sums - sums) * down[at] + (till - at).astype(U64))


def _tokens(edge: np.ndarray, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run-length code of a zone's stretches, and the last stretch of the code that each is in.

    A path's order must be that of its stretches one by one. A count is followed by a smaller hash, or the path's end, or by a
    larger one (``up``). In the first case a smaller count sorts first, in the other a larger one, and all of the first before the other.
    """
    n = len(edge)
    new = np.ones(n, bool)
    new[1:] = (edge[1:] != edge[:-1]) | (words[1:] != words[:-1]) | stop[1:n]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], n) - 1
    code = np.zeros(len(begin), TOKEN)
    code["hash"], code["words"] = edge[begin], words[begin]
    ends = np.ones(len(begin), bool)  # a path ends after this one
    ends[:-1] = stop[begin[1:]]
    code["up"][:-1] = ~ends[:-1] & (edge[begin[1:]] > edge[begin[:-1]])
    times = (last - begin + 1).astype(np.uint32)
    code["times"] = np.where(code["up"] == 1, ~times, times)
    return code, np.repeat(np.arange(len(begin)), times)


def zone_paths(chains: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Of the chains of one zone: (run, word at which it starts in the zone, path, word before) of every place where a repeat can start."""
    links = chains["links"].astype(np.int64)
    of = np.repeat(np.arange(len(links)), links + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(links + 1) - links - 1, links + 1)
    at = chains["at"][of] + k * chains["every"][of]
    # the stretch between two links is the same each time, so its sum is the step times a power of the base
    up, _ = _pow_tables(int((k * chains["every"][of]).max(initial=0)) + 1)
    part = np.where(k > 0, chains["step"].view(U64)[of] * up[np.maximum(k - 1, 0) * chains["every"][of]], U64(0))
    total = np.cumsum(part)
    head = np.cumsum(links + 1) - links - 1
    sums = chains["end"].view(U64)[of] + total - total[head][of]
    order = np.argsort(at, kind="stable")
    of, k, at, sums = of[order], k[order], at[order], sums[order]
    till = at + least
    ends = np.flatnonzero(chains["rd"][of])
    alone = ~np.where(k < links[of], chains["goes_inner"][of], chains["goes"][of])[ends]
    starts = np.flatnonzero(chains["ld"][of])
    left = np.where(k > 0, chains["inner_left"][of], chains["left"][of])[starts]
    if not len(ends):
        return chains["run"][of[starts]], at[starts], [b""] * len(starts), left
    # stretch i goes from end i to end i + 1; a path stops at the first end after which it goes on alone
    edge = _spans(sums[ends[:-1]], till[ends[:-1]], sums[ends[1:]], till[ends[1:]])
    code, code_of = _tokens(edge, np.diff(till[ends]), alone[:-1]) if len(edge) else (np.zeros(0, TOKEN), np.zeros(0, np.int64))
    stops = np.flatnonzero(alone)
    raw, size = code.tobytes(), TOKEN.itemsize
    after = np.append(np.flatnonzero(np.diff(code_of)) + 1, len(edge))  # by code: the stretch after its last
    first = np.searchsorted(till[ends], till[starts])
    some = np.minimum(first, len(ends) - 1)
    lead = _spans(sums[starts], till[starts], np.where(first < len(ends), sums[ends[some]], sums[starts]), np.maximum(till[ends[some]], till[starts]))
    lead_words = till[ends[some]] - till[starts]
    stop = np.append(stops, len(ends) - 1)[np.searchsorted(stops, some)]
    paths = []
    opening = np.zeros(1, TOKEN)
    for i, (e, z, n) in enumerate(zip(some.tolist(), stop.tolist(), lead_words.tolist(), strict=True)):
        path = b""
        if n > 0:
            opening["hash"], opening["up"], opening["times"], opening["words"] = lead[i], 0, 1, n
            path = opening.tobytes()
        if n >= 0 and e < z:
            c = code_of[e]
            opening[0] = code[c]
            times = after[c] - e
            opening["times"] = ~np.uint32(times) if opening["up"][0] else times
            path += opening.tobytes() + raw[size * (c + 1) : size * (code_of[z - 1] + 1)]
        paths.append(path)
    return chains["run"][of[starts]], at[starts], paths, left


_MET = ("run", "left", "inner_left", "inner_right", "end", "step", "at", "every", "links", "ld", "rd", "goes", "goes_inner")


def _paths(zones: DataFrame, least: int) -> DataFrame:
    """(run, path, left, doc, h1, start) of every place where a repeat can start."""
    names = ["run", "path", "left", "doc", "h1", "start"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, h1, zone, met in zip(b.column("doc").to_pylist(), b.column("h1").to_pylist(), b.column("zone").to_pylist(), b.column("met"), strict=True):
                fields = met.values
                chains = {c: fields.field(c).to_numpy(zero_copy_only=False) for c in _MET}
                runs_, at, paths, left = zone_paths(chains, least)
                for column, new in zip(out, (runs_.tolist(), paths, left.tolist(), [doc] * len(at), [h1] * len(at), (at + zone).tolist()), strict=True):
                    column += new
                size += sum(map(len, paths)) + 40 * len(at)
                if size > 1 << 22:
                    yield _batch(out, names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield _batch(out, names)

    return zones.mapInArrow(run, "run long, path binary, left long, doc long, h1 long, start int")


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"path": pa.binary(), "start": _INT32, "lo": _INT32, "hi": _INT32, "words": _INT32, "again": _INT32}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, _INT64)) for c, n in zip(columns, names, strict=True)], names)


_UNPACK = struct.Struct(">QBII")
_SHORT = 16 * TOKEN.itemsize


def _total(path: bytes) -> int:
    """Words of a path."""
    if len(path) <= _SHORT:
        return sum((times ^ 0xFFFFFFFF if up else times) * words for _, up, times, words in _UNPACK.iter_unpack(path))
    code = np.frombuffer(path, TOKEN)
    times = code["times"].astype(np.int64)
    return int((np.where(code["up"] == 1, times ^ 0xFFFFFFFF, times) * code["words"]).sum())


def common(a: bytes, b: bytes) -> int:
    """Words that two paths share."""
    n = min(len(a), len(b))
    at, block = 0, _SHORT
    while at < n and a[at : at + block] == b[at : at + block]:  # equal blocks, ever longer
        at += block
        block *= 2
    if at < n:
        x, y = a[at : min(n, at + block)], b[at : min(n, at + block)]
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        at = at + len(x) - (differ.bit_length() + 7) // 8 if differ else n
    whole = min(at, n) // TOKEN.itemsize * TOKEN.itemsize
    shared = _total(a[:whole]) if whole else 0
    if whole < n:
        x, y = a[whole : whole + TOKEN.itemsize], b[whole : whole + TOKEN.itemsize]
        if x[:8] == y[:8] and x[13:] == y[13:]:
            shared += min(_total(x), _total(y))
    return shared


_MANY = object()


class _Open:
    """An open interval: words, first and last rank, the word before or ``_MANY``, places, the first of them, and the suffixes that may still need a group."""

    __slots__ = ("first", "hi", "left", "lo", "n", "pending", "words")

    def __init__(self, words: int, rank: int, left: object, n: int, first: tuple[int, int], pending: list):
        self.words, self.lo, self.hi, self.left, self.n, self.first, self.pending = words, rank, rank, left, n, first, pending

    def take(self, other: _Open) -> None:
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        self.left = self.left if self.left == other.left else _MANY
        self.n += other.n
        self.first = min(self.first, other.first)
        if len(self.pending) < len(other.pending):
            self.pending, other.pending = other.pending, self.pending
        self.pending += other.pending


_SCANNED = ("tree", "lo", "hi", "words", "path_id", "doc", "start", "n", "again")


class _Scan:
    """The stack scan of one partition's sorted suffixes. Rows: groups have no ``path_id``; suffixes have their rank in ``lo`` and ``hi``."""

    def __init__(self, least: int):
        self.least, self.tree, self.rank, self.last = least, None, 0, b""
        self.stack: list[_Open] = []
        self.rows: list[list] = [[] for _ in _SCANNED]

    def emit(self, *row: object) -> None:
        for column, x in zip(self.rows, row, strict=True):
            column.append(x)

    def close(self, e: _Open) -> None:
        if e.n < 2 or e.left is not _MANY:
            return
        self.emit(self.tree, e.lo, e.hi, e.words, None, *e.first, e.n, None)
        stays = []
        for item in e.pending:
            place, rank, path_id, n, words = item
            if place == e.first:
                stays.append((place, rank, path_id, n, words or e.words))
            else:
                self.emit(self.tree, rank, rank, words or e.words, path_id, *place, n, e.words)
        e.pending = stays

    def down_to(self, shared: int) -> None:
        child = None
        while self.stack and self.stack[-1].words > shared:
            e = self.stack.pop()
            if child:
                e.take(child)
            self.close(e)
            child = e
        if child is None:
            return
        if self.stack and self.stack[-1].words == shared:
            self.stack[-1].take(child)
        elif shared >= self.least:
            child.words = shared
            self.stack.append(child)
        else:
            for place, rank, path_id, n, words in child.pending:
                self.emit(self.tree, rank, rank, words, path_id, *place, n, 0)

    def suffix(self, tree: int, path: bytes, path_id: int, left: tuple[int, int], n: int, first: tuple[int, int]) -> None:
        """``left``: the smallest and the largest word before."""
        if tree == self.tree:
            self.down_to(self.least + common(self.last, path))
            self.rank += 1
        else:
            self.down_to(0)
            self.tree, self.rank = tree, 0
        self.last = path
        self.stack.append(_Open(self.least + _total(path), self.rank, left[0] if left[0] == left[1] else _MANY, n, first, [(first, self.rank, path_id, n, 0)]))

    def flushed(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, [[] for _ in _SCANNED]
        return _batch(rows, list(_SCANNED))


def _scanned(suffixes: DataFrame, least: int) -> DataFrame:
    """Groups and ranked suffixes. ``words``: of the group, or of the longest that the suffix is in; ``n``: places; (doc, start): the first.

    ``again``, for suffixes: words of the longest group in which its first place isn't the first, or 0; for its other places that is ``words``.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(least)
        for b in batches:
            lo, hi = b.column("lo").to_pylist(), b.column("hi").to_pylist()
            for tree, path, path_id, a, z, n, doc, start in zip(*(b.column(c).to_pylist() for c in ("run", "path", "path_id")), lo, hi, *(b.column(c).to_pylist() for c in ("n", "doc", "start")), strict=True):
                scan.suffix(tree, path, path_id, (a, z), n, (doc, start))
            if len(scan.rows[0]) > 2000:
                yield scan.flushed()
        scan.down_to(0)
        yield scan.flushed()

    own = suffixes.groupBy("run", "path_id").agg(F.first("path").alias("path"), F.min("left").alias("lo"), F.max("left").alias("hi"), F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first"))
    own = own.select("run", "path", "path_id", "lo", "hi", "n", "first.doc", "first.start")
    # a number of its own keeps small rows, which take Python time, in as many tasks as there are shuffle partitions
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "run").sortWithinPartitions("run", "path").mapInArrow(run, "tree long, lo int, hi int, words int, path_id long, doc long, start int, n long, again int")


class _Found:
    """``meta``: the texts' ids. ``places``: (run, path_id, doc, h1, start), of equal texts in that with the smallest id. ``scanned``: groups and suffixes."""

    def __init__(self, docs: DataFrame, least: int, gram: int):
        rows = only(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h1", F.xxhash64("text"))
        count = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))
        self.least = least
        self.meta = written(rows.groupBy("doc_id", "h1", F.xxhash64("text", F.lit(1)).alias("h2")).agg(F.count("*").alias("rows"), F.max(count).alias("words")), "texts")
        self.copies = self.meta.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.max("words").alias("words"))

        met = _anchored(rows, least, gram).groupBy("anchor").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("twice").alias("again"))
        shared = written(met.where("lo <> hi OR again").select(F.col("anchor").alias("key")), "anchors")
        maybe, _ = sieved(_anchored(rows, least, gram), F.col("anchor"), shared)
        hits = maybe.join(shared, maybe.anchor == shared.key).groupBy("h1").agg(F.collect_set("anchor").alias("hits"))
        wanted = written(hits.join(self.copies.select("h1", "doc"), "h1"), "hits")
        maybe, _ = sieved(rows, F.col("h1"), wanted.select("h1"))
        texts = maybe.join(wanted.withColumnRenamed("h1", "h"), (F.col("doc_id") == F.col("doc")) & (F.col("h1") == F.col("h"))).select("doc", "h1", "text", "hits")
        if not self.meta.where("rows > 1").isEmpty():  # rows that share id and text would otherwise count twice
            texts = texts.dropDuplicates(["doc", "h1"])
        zones = written(_zones(texts, least, gram), "zones")

        starts = _starts(zones, least)
        sides = [F.min(F.least("left", "inner_left")) != F.max(F.greatest("left", "inner_left")), F.min(F.least("right", "inner_right")) != F.max(F.greatest("right", "inner_right"))]
        ends = starts.groupBy("run").agg(sides[0].alias("ld"), sides[1].alias("rd")).where("ld OR rd")
        ends = written(ends.withColumnRenamed("run", "key"), "ends")
        maybe, _ = sieved(starts, F.col("run"), ends.select("key"))
        met = written(maybe.join(ends, maybe.run == ends.key).drop("key"), "chains")
        nexts = met.where("rd").select("run", F.explode(F.expr("array(struct(right, 1 AS times), struct(inner_right AS right, links AS times))")).alias("next"))
        goes = nexts.groupBy("run", "next.right").agg((F.sum("next.times") > 1).alias("goes")).where("goes")
        inner = goes.toDF("run", "inner_right", "goes_inner")
        met = met.join(goes, ["run", "right"], "left").join(inner, ["run", "inner_right"], "left").fillna(False, ["goes", "goes_inner"])
        by_zone = met.groupBy("doc", "h1", "zone").agg(F.collect_list(F.struct(*_MET)).alias("met"), F.max("ld").alias("any")).where("any")
        found = written(_paths(by_zone.select("doc", "h1", "zone", "met"), least).withColumn("path_id", F.xxhash64("path")), "suffixes")
        self.places = found.drop("path", "left")
        self.scanned = written(_scanned(found, least), "scan")


COLUMNS = ("kind", "tree", "lo", "hi", "words", "doc_id", "start", "n")


def repeat_tree(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(kind, tree, lo, hi, words, doc_id, start, n): places, repeats and copies.

    ``place``: ``doc_id`` has a repeat at word ``start``; ``lo`` and ``hi`` are its rank among the suffixes of ``tree``, ``words`` is the length of
    the longest repeat there. ``repeat``: a maximal repeat of ``words`` words, whose occurrences are all places of ``tree`` with a rank from ``lo``
    to ``hi``, ``n`` in distinct texts, the first at (doc_id, start). ``copy``: a text of ``words`` words that several ids have, a row for each id;
    ``tree`` is its hash.
    """
    found = _Found(docs, least, gram)
    rank = found.scanned.where("path_id IS NOT NULL").select(F.col("tree").alias("run"), "path_id", F.col("lo").alias("rank"), "words")
    places = found.places.join(rank, ["run", "path_id"])
    others = found.meta.join(found.copies.where("n > 1").select("h1", "h2", "doc"), ["h1", "h2"]).where("doc_id <> doc").select("doc", "h1", F.col("doc_id").alias("other"))
    one = F.lit(1).cast("long")
    columns = lambda doc: ["run", "rank", "rank", "words", doc, "start", one]
    named = lambda kind, df, cols: df.select(F.lit(kind), *cols).toDF(*COLUMNS)
    out = named("place", places, columns("doc")).unionByName(named("place", places.join(others, ["doc", "h1"]), columns("other")))
    groups = found.scanned.where("path_id IS NULL")
    out = out.unionByName(named("repeat", groups, ["tree", "lo", "hi", "words", "doc", "start", "n"]))
    equal = found.meta.join(found.copies.where("n > 1").where(F.col("words") >= least).select("h1", "h2", "n"), ["h1", "h2"])
    return out.unionByName(named("copy", equal, ["h1", F.lit(0), F.lit(0), "words", "doc_id", F.lit(0), "n"]))


def occurrences(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(group_id, words, doc_id, start): every occurrence, in every document, of every maximal repeat of ``least`` words or more."""
    rows = written(repeat_tree(docs, least, gram), "tree")
    at = rows.where("kind = 'place'").select("tree", F.col("lo").alias("rank"), "doc_id", "start")
    groups = rows.where("kind = 'repeat'").select("tree", "lo", "hi", "words", F.concat_ws(":", "tree", "lo", "hi").alias("group_id"))
    each = groups.join(at, "tree").where("rank BETWEEN lo AND hi").select("group_id", "words", "doc_id", "start")
    return each.unionByName(rows.where("kind = 'copy'").select(F.concat(F.lit("text:"), F.hex("tree")).alias("group_id"), "words", "doc_id", "start"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these (first word, words) spans; white space before a kept word goes with the word before it."""
    raw = text.encode()
    words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    keep = np.ones(len(words.start), bool)
    for start, n in spans:
        keep[start : start + n] = False
    if keep.all():
        return text
    ends = np.append(words.start[1:], len(raw))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return b"".join(raw[words.start[a] : ends[z - 1]] for a, z in edges.reshape(-1, 2)).strip().decode()


def keep_first(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """The documents without repeated passages: of each group the occurrence with the smallest (doc_id, start) stays.

    A text that is left without words goes; ``n_chars`` follows the new text. All columns stay.
    """
    found = _Found(docs, least, gram)
    known = found.scanned.where("path_id IS NOT NULL").select(F.col("tree").alias("run"), "path_id", F.col("doc").alias("of"), F.col("start").alias("at"), "words", "again")
    cut = F.when((F.col("doc") == F.col("of")) & (F.col("start") == F.col("at")), F.col("again")).otherwise(F.col("words"))
    places = found.places.join(known, ["run", "path_id"]).select(F.col("doc").alias("__doc"), F.col("h1").alias("__h1"), "start", cut.alias("words"))
    equal = found.meta.join(found.copies.where("n > 1").where(F.col("words") >= least).select("h1", "h2", "doc"), ["h1", "h2"]).where("doc_id <> doc")
    places = places.unionByName(equal.select(F.col("doc_id").alias("__doc"), F.col("h1").alias("__h1"), F.lit(0).alias("start"), "words"))
    spans = places.where("words > 0").groupBy("__doc", "__h1").agg(F.collect_list(F.struct("start", "words")).alias("__spans"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_words(t, [(x["start"], x["words"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    spans = written(spans, "spans")
    maybe, clear = sieved(docs, F.xxhash64(docs["`text`"]), spans.select("__h1"))
    both = maybe.join(spans, (maybe["`doc_id`"].cast("long") == F.col("__doc")) & (F.xxhash64(maybe["`text`"]) == F.col("__h1")), "left")
    has = F.col("__spans").isNotNull()
    both = both.withColumn("__new", without(F.when(has, F.col("text")), F.col("__spans"))).where(~has | (F.col("__new") != ""))
    out = {"text": F.when(has, F.col("__new")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(has, F.char_length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.withColumns(out).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(clear)
