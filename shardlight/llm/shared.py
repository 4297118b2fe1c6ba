"""The shared folder for intermediate tables, and a few helpers that all operators use."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only on one machine, as in tests, may it be unset; then it is a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shardlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later plans start here and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shardlight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once nothing reads it any more."""
    files = set(table.inputFiles())
    for spark, path in list(_made):
        if any(f"/{path.rpartition('/')[2]}/" in f for f in files):
            _delete(spark, path)
            _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder belongs to it
            return


def release() -> None:
    """Gives freed memory back to the system; a Python worker lives on beside the executor's heap after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lean(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """A map over batches that leaves no memory behind when it ends."""

    @functools.wraps(run)
    def inner(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


#: Rows of an Arrow batch: of texts, a batch is a few MB on either side.
BATCH_ROWS = 2000


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by exact name; whatever else the table has, clashing names included, stays out.

    The session's Arrow batches get ``BATCH_ROWS`` at most, for good: the setting counts when the lazy result runs, after the call.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(*[df[f"`{c}`"] for c in columns])


#: Bits of the bitmap for each key, and bounds of its size as a power of 2: 8 KB to 32 MB.
SIEVE_SPARE, SIEVE_LEAST, SIEVE_MOST = 16, 16, 28


def sieved(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose key may be among the values of ``keys``, a table of one column, and those whose key isn't.

    Rows that a join would only carry along needn't be shuffled. The keys' hashes are set in a bitmap, sized by their number up to
    ``2**SIEVE_MOST`` bits, which is broadcast. With more keys than that more rows pass, at worst all: then the join that
    follows sorts it out as it would have anyway. ``keys`` is counted, so it should be a written table. Null keys may be in either part.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    bits = min(SIEVE_MOST, max(SIEVE_LEAST, (SIEVE_SPARE * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    marked = keys.toDF("key").select(place(F.col("key")).alias("bit"))
    maps = marked.groupBy(F.expr("shiftright(bit, 15)").alias("__part")).agg(F.bitmap_construct_agg(F.expr("bit & 32767")).alias("__map"))
    # as an array of 32-bit words, which a join can look into without copying it
    maps = maps.withColumn("__map", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.conv(F.hex(F.substring(F.col("__map"), 4 * i + 1, F.lit(4))), 16, 10).cast("long")))
    met = rows.withColumn("__bit", place(key)).join(F.broadcast(maps), F.expr("shiftright(__bit, 15)") == F.col("__part"), "left")
    word, shift = "get(__map, cast((__bit & 32767) div 32 as int))", "cast((3 - (__bit & 31) div 8) * 8 + (__bit & 7) as int)"
    met = met.withColumn("__may", F.coalesce(F.expr(f"(shiftright({word}, {shift}) & 1) = 1"), F.lit(False)))
    return met.where("__may").select(*kept), met.where("NOT __may").select(*kept)
