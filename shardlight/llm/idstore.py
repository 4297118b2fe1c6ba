"""Content-addressed store of token ids.

Texts become ids with a byte-level BPE vocabulary read from ``ranks``. A rolling hash over ``WINDOW`` ids cuts each
stream where its low bits are 0, so equal passages are cut alike wherever they stand. A chunk is stored once, under
the SHA-256 of its bytes (little-endian uint16); a document's recipe lists its chunks, with a Merkle root over them;
manifests are Merkle nodes over the roots of ranges of ``doc_id``, up to one root for the store.

One table holds all, by ``kind``: ``chunk`` (key, n, ids), ``recipe`` (doc_id, key = Merkle root, n, chunks) and
``manifest`` (level, bucket, key, n = children).

Defined cases: a null text has a recipe with null ``n``, ``chunks`` and ``key``; an empty one has no chunks and the root of
nothing; rows that share an id each have a recipe; null ids are kept, and form a bucket of their own; texts of any length, and
any run of one character in them, are encoded as a whole; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, only, written
from .textkit import U64, mix64, prefix_sums, range_hashes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, AVERAGE, LEAST, MOST = 16, 256, 64, 1024
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: str) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks, read once a process."""
    if ranks not in _encodings:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks] = tiktoken.Encoding("store", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks]


#: White space as the pattern has it, in runs that its look-ahead can't take whole.
_SPACES = re.compile("[ \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def encoded(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text of any length.

    The pattern's ``\\s+(?!\\S)`` needs stack for each character of a run of white space. Of long runs the piece that it would
    match, all but the last character before another one, is encoded by itself; the ids are the same.
    """
    if not any(text[i : i + 500].isspace() for i in range(0, len(text), 500)):  # a run of 1000 has such a stretch
        return np.array(enc.encode_ordinary(text), np.uint16)
    ids: list[int] = []
    at = 0
    for m in _SPACES.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._encode_single_piece(text[m.start() : end])
        at = end
    return np.array(ids + enc.encode_ordinary(text[at:]), np.uint16)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream; each has ``LEAST`` to ``MOST`` ids, the last may be shorter."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    at = np.arange(LEAST, n)
    marks = at[(range_hashes(prefix_sums(mix64(ids.astype(U64) + U64(1))), at - WINDOW, at) & U64(AVERAGE - 1)) == 0]
    out, start, i = [], 0, 0
    while n - start > LEAST:
        i = int(np.searchsorted(marks, start + LEAST))
        end = min(int(marks[i]) if i < len(marks) else n, start + MOST, n)
        out.append(end)
        start = end
    return [*out, n] if start < n else out


def merkle_root(keys: list[bytes]) -> bytes:
    """Pairs are hashed upwards; an odd one goes up as it is."""
    if not keys:
        return hashlib.sha256(b"").digest()
    level = keys
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


SCHEMA = "kind string, key binary, doc_id long, n int, ids binary, chunks array<binary>, level int, bucket long"
_ARROW = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("chunks", pa.list_(pa.binary()))])


def _staged(docs: DataFrame, ranks: str) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        seen: set[bytes] = set()  # of this task; it only saves sending, later steps don't rely on it
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text is None:
                    rows.append(("recipe", None, doc_id, None, None, None))
                else:
                    ids = encoded(enc, text)
                    keys, start = [], 0
                    for end in cuts(ids):
                        raw = ids[start:end].astype("<u2").tobytes()
                        key = hashlib.sha256(raw).digest()
                        keys.append(key)
                        if key not in seen:
                            seen.add(key)
                            rows.append(("chunk", key, None, end - start, raw, None))
                            size += len(raw)
                        start = end
                    rows.append(("recipe", merkle_root(keys), doc_id, len(ids), None, keys))
                if size > 1 << 22 or len(rows) > 20_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, SCHEMA.split(", level")[0])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


#: Children of a manifest's node. A range of ids with more is cut again by key, so no row grows with the table.
FAN = 4096


def manifests(recipes: DataFrame) -> DataFrame:
    """(level, bucket, key, n): nodes over ranges of 4096 ids, then of 2**24, 2**40, 2**52, and all; children are sorted by bucket or id, then key.

    A node's hash covers its children's keys. Ids that are null, or shared by many rows, can crowd one range: its children are first
    hashed in parts of about ``FAN``, by a hash, and the node covers the parts' hashes; equal children are one with a number. ``n`` counts all children.
    """
    below, out = recipes.where("key IS NOT NULL").select(F.col("doc_id").alias("at"), "key"), None
    hashed = lambda column: F.unhex(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(column)), lambda x: F.concat(F.hex(x["key"]), F.when(x["times"] > 1, F.concat(F.lit("x"), x["times"].cast("string"))).otherwise("")))).cast("binary"), 256)).alias("key")
    for level, shift in enumerate((12, 12, 16, 12, None), 1):
        bucket = F.lit(0).cast("long") if shift is None else F.shiftright("at", shift)
        own = below.groupBy(bucket.alias("bucket"), "at", "key").agg(F.count("*").alias("times"))
        crowded = own.groupBy("bucket").count().withColumn("parts", F.ceil(F.col("count") / FAN)).select(F.col("bucket").alias("b"), "parts")
        own = own.join(crowded, own.bucket.eqNullSafe(F.col("b"))).withColumn("part", F.pmod(F.xxhash64("at", "key"), F.col("parts")))
        parts = own.groupBy("bucket", "part").agg(hashed(F.struct("at", "key", "times")), F.sum("times").alias("n"))
        nodes = parts.groupBy("bucket").agg(F.count("*").alias("several"), F.first("key").alias("only"), hashed(F.struct("part", "key", F.lit(1).alias("times"))), F.sum("n").cast("int").alias("n"))
        nodes = written(nodes.select("bucket", F.when(F.col("several") == 1, F.col("only")).otherwise(F.col("key")).alias("key"), "n"), f"level{level}")
        one = nodes.select(F.lit(level).alias("level"), "bucket", "key", "n")
        out = one if out is None else out.unionByName(one)
        below = nodes.select(F.col("bucket").alias("at"), "key")
    return out


def store(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """All rows of the store; texts are tokenised once, chunks cross one shuffle to be stored once."""
    staged = written(_staged(docs, ranks), "ids")
    chunks = staged.where("kind = 'chunk'").groupBy("kind", "key").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    recipes = staged.where("kind = 'recipe'").select("kind", "key", "doc_id", "n", "chunks")
    tree = manifests(recipes).withColumn("kind", F.lit("manifest"))
    rows = chunks.unionByName(recipes, True).unionByName(tree, True)
    return rows.select("kind", "key", "doc_id", "n", "ids", "chunks", "level", "bucket")


def reconstructed(rows: DataFrame) -> DataFrame:
    """(doc_id, key, ids) of every recipe with a text, from recipes and chunks alone."""
    recipes = rows.where("kind = 'recipe' AND key IS NOT NULL").select("doc_id", "key", "chunks").withColumn("row", F.monotonically_increasing_id())
    parts = recipes.select("row", F.posexplode("chunks").alias("at", "chunk")).join(rows.where("kind = 'chunk'").select(F.col("key").alias("chunk"), "ids"), "chunk")
    joined = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return recipes.drop("chunks").join(joined.select("row", whole.alias("ids")), "row", "left").select("doc_id", "key", F.coalesce("ids", F.unhex(F.lit(""))).alias("ids"))


def faults(rows: DataFrame) -> DataFrame:
    """(what, count): chunks whose bytes don't hash to their key, recipes whose root or length differs, manifests that differ."""

    @F.arrow_udf("binary")
    def root(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else merkle_root(k) for k in keys.to_pylist()], pa.binary())

    chunk = rows.where("kind = 'chunk'").where(F.unhex(F.sha2("ids", 256)) != F.col("key")).agg(F.lit("chunk").alias("what"), F.count("*").alias("count"))
    recipes = rows.where("kind = 'recipe' AND key IS NOT NULL")
    recipe = recipes.where(root("chunks") != F.col("key")).agg(F.lit("recipe").alias("what"), F.count("*").alias("count"))
    have = rows.where("kind = 'manifest'").select("level", "bucket", "key", "n")
    want = manifests(recipes)
    tree = have.exceptAll(want).unionByName(want.exceptAll(have)).agg(F.lit("manifest").alias("what"), F.count("*").alias("count"))
    return chunk.unionByName(recipe).unionByName(tree)
