"""Reports: fragments and totals, merging, and what the dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("complete", "partial", "incomplete_eof")


def coalesced(extents: DataFrame, *keys: str) -> DataFrame:
    """Extents (start_offset, end_offset) that touch become one fragment: (keys, fragment_id, start_offset, end_offset, size)."""
    order = Window.partitionBy(*keys).orderBy("start_offset", "end_offset")
    marked = extents.withColumn("new", F.when(F.lag("end_offset").over(order) == F.col("start_offset"), 0).otherwise(1))
    grouped = marked.withColumn("fragment_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = grouped.groupBy(*keys, "fragment_id").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"))
    return out.withColumn("size", F.col("end_offset") - F.col("start_offset"))


def total_size(fragments: Column) -> Column:
    return F.aggregate(fragments, F.lit(0).cast("long"), lambda a, f: a + f["size"])


def first_start(fragments: Column) -> Column:
    return F.coalesce(F.try_element_at(fragments, F.lit(1))["start_offset"], F.lit(0).cast("long"))


def merged(reports: DataFrame) -> DataFrame:
    """All files of several reports, by the start of their first fragment (0 without one), then name. Nothing is dropped."""
    return in_order(reports.select(F.explode("files").alias("f")).select("f.*"))


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(first_start(F.col("fragments")), "filename", "file_id")


def errors(reports: DataFrame) -> DataFrame:
    return reports.where("error IS NOT NULL").select("error")


def status_counts(files: DataFrame, *keys: str) -> DataFrame:
    """Files in all, and by status, with their bytes."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.sum("total_size").alias("total_size"))


def layout(fragments: Column) -> Column:
    """For each fragment the left edge and width of its bar in percent of the file's span, and whether it is the last."""
    begin = first_start(fragments)
    span = F.try_element_at(fragments, F.lit(-1))["end_offset"] - begin

    def bar(f: Column, i: Column) -> Column:
        left = F.when(span > 0, (f["start_offset"] - begin) * 100.0 / span).otherwise(0.0)
        width = F.when(span > 0, F.greatest(F.lit(2.0), f["size"] * 100.0 / span)).otherwise(100.0)
        return F.struct(left.alias("left_pct"), width.alias("width_pct"), (i == F.size(fragments) - 1).alias("is_last"))

    return F.transform(fragments, bar)
