"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.image import located


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, as in tests, may it be unset: then a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="carve-")
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/carve-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def image_of(parts: DataFrame, size: int, name: str = "image") -> str:
    """The path of an image file of ``size`` bytes in the shared folder, with ``parts`` (start_offset, bytes) in it and zeros elsewhere."""
    where, path = located(f"{shared_folder(parts.sparkSession)}/{name}-{uuid4().hex}.dd")
    if not isinstance(where, fs.LocalFileSystem):
        raise ValueError("an image is written in place, which needs a mounted folder")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(size)
    atexit.register(Path(path).unlink, True)
    write_in_place(parts.select(F.lit(path).alias("path"), "start_offset", "bytes"))
    return path


def write_in_place(parts: DataFrame) -> None:
    """Writes ``parts`` (path, start_offset, bytes) into files that are there already.

    Tasks write their parts in place, so a task that runs again writes the same. The folder has to be a mounted one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, path, f = 0, None, None
        try:
            for b in batches:
                for to, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if to != path:
                        if f:
                            f.close()
                        path, f = to, open(to, "r+b")
                    f.seek(at)
                    f.write(raw.as_py())
                    n += 1
        finally:
            if f:
                f.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    parts.select("path", F.col("start_offset").cast("long"), F.col("bytes").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()
