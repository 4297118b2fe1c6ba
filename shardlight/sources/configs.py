"""Definitions of custom formats, and reports of earlier runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import report
from ..plans.tables import kept
from .image import located

FRAGMENT = "struct<start_offset:bigint,end_offset:bigint,size:bigint>"
FILE = f"struct<file_id:int,filename:string,format:string,status:string,fragments:array<{FRAGMENT}>,total_size:bigint>"
REPORT = f"files array<{FILE}>, error string"
#: How our own reports are laid out: a line for each file and one for the error, so that tasks can write and read parts of them.
HEAD, ROW, ERROR = '{\n    "files": [', "        ", '    "error": '
_HEAD = re.compile(re.escape(HEAD.encode()) + rb"(\]|\n" + ROW.encode() + rb'\{")')


def custom_formats(spark: SparkSession, path: str) -> tuple[tuple[str, bytes, bytes], ...]:
    """Rows (extension, header, footer) of a JSON array; a row without an extension or header, or with odd hex, is an error."""
    rows = spark.read.schema("extension string, header_hex string, footer_hex string").json(path, multiLine=True)
    made = rows.select(F.lower(F.ltrim("extension", F.lit("."))).alias("e"), F.expr("try_to_binary(header_hex, 'hex') AS h"), F.expr("try_to_binary(coalesce(footer_hex, ''), 'hex') AS f")).collect()
    if any(not r.e or not r.h or r.f is None for r in made):
        raise ValueError(f"{path}: each format needs an extension and a header in hex")
    return tuple((r.e, bytes(r.h), bytes(r.f)) for r in made)


def reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each report that matches; what can't be parsed is left out, missing fields are null."""
    return spark.read.schema(REPORT).option("mode", "PERMISSIVE").json(path, multiLine=True).where("files IS NOT NULL OR error IS NOT NULL")


def _by_line(path: str) -> bool:
    where, name = located(path)
    with where.open_input_file(name) as f:
        size = f.size()
        return bool(_HEAD.match(f.read_at(64, 0))) and f.read_at(2, max(0, size - 2)) == b"\n}"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_block_start").alias("block"))


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _lines(spark, paths).where(F.startswith("value", F.lit(ROW + "{"))).select("block", F.from_json(F.rtrim("value", F.lit(",")), FILE).alias("f"))


def report_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files and the errors of reports. Those in our own layout are read by line; of any other, all files are one row until they are read."""
    own = [p for p in paths if _by_line(p)]
    other = [p for p in paths if p not in own]
    files, errors = [], []
    if own:
        files.append(_rows(spark, own).select("f.*"))
        errors.append(_lines(spark, own).where(F.startswith("value", F.lit(ERROR))).select(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "error string")["error"].alias("error")))
    if other:
        read = reports(spark, other)
        files.append(read.select(F.explode("files").alias("f")).select("f.*"))
        errors.append(report.errors(read))
    return (files[0].unionByName(files[1]), errors[0].unionByName(errors[1])) if own and other else (files[0], errors[0])


def ranked_files(spark: SparkSession, path: str) -> DataFrame:
    """(rank, f): the files of one report, with their places in it."""
    if not _by_line(path):
        return reports(spark, path).select(F.posexplode("files").alias("rank", "f"))
    # a block's rows are numbered as they are read; only counts of blocks share a window
    rows = kept(_rows(spark, [path]).withColumn("seq", F.monotonically_increasing_id()))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(blocks.withColumn("before", before)), "block").select((F.col("before") + F.col("seq") - F.col("first")).cast("int").alias("rank"), "f")
