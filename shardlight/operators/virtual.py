"""A table of texts as one image: each text padded with NUL to whole clusters, in order of its id. No sort of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLUSTER, BUCKET = 4096, 4096


def offsets(rows: DataFrame, id_column: str, size_column: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``start_offset``, the running sum of sizes before each row, in two levels.

    Sums of ranges of ids are few, and only they share a window; within a range rows are summed in parallel.
    """
    own = rows.withColumn("__bucket", F.floor(F.col(id_column) / bucket))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("__bucket").agg(F.sum(size_column).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    inside = Window.partitionBy("__bucket").orderBy(id_column).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("__in", F.coalesce(F.sum(size_column).over(inside), F.lit(0)))
    joined = placed.join(sums.select("__bucket", "__base"), "__bucket")
    return joined.withColumn("start_offset", (F.col("__base") + F.col("__in")).cast("long")).drop("__bucket", "__in", "__base")


def clusters(rows: DataFrame, id_column: str, text_column: str, cluster: int = CLUSTER) -> DataFrame:
    """(id, cluster_id, start_offset, n_bytes, bytes) of the clusters of every text; an empty or null text has none."""
    raw = rows.select(id_column, F.col(text_column).cast("binary").alias("raw")).withColumn("n", F.coalesce(F.octet_length("raw"), F.lit(0)))
    padded = raw.withColumn("padded", (F.ceil(F.col("n") / cluster) * cluster).cast("long"))
    placed = offsets(padded, id_column, "padded")
    parts = placed.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("padded") / cluster).cast("int") - 1)))
    start = F.col("start_offset") + F.col("k") * cluster
    body = F.substring("raw", F.col("k") * cluster + 1, F.lit(cluster))
    return parts.select(id_column, (start / cluster).cast("long").alias("cluster_id"), start.alias("start_offset"), F.octet_length(body).alias("n_bytes"), body.alias("bytes"))


def next_match(rows: DataFrame, id_column: str, probe: str, candidate: str, most: int) -> DataFrame:
    """For each row where ``probe`` holds, the nearest later row within ``most`` where ``candidate`` holds: a forward as-of join.

    Ids fall into ranges of ``most``, so the match lies in the row's own range or is the first of the next one.
    """
    own = rows.select(F.col(id_column).alias("id"), F.expr(probe).alias("p"), F.expr(candidate).alias("c")).withColumn("b", F.floor(F.col("id") / most))
    later = Window.partitionBy("b").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    here = own.withColumn("here", F.min(F.when(F.col("c"), F.col("id"))).over(later)).where("p")
    first = own.where("c").groupBy((F.col("b") - 1).alias("b")).agg(F.min("id").alias("there"))
    both = here.join(first, "b", "left").withColumn("m", F.coalesce("here", "there"))
    return both.select("id", F.when(F.col("m") <= F.col("id") + most, F.col("m")).alias("match"))
