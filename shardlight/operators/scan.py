"""Where files may start: signatures in clusters, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import ascii_lower, latin, looks_like_text
from ..functions.catalogue import Format


def signature_table(spark: SparkSession, formats: list[Format]) -> DataFrame:
    """(format, priority, sig, sig_len, text, lead, ahead); a few dozen rows, whatever the image. ``ahead`` matches the empty string before ``sig``."""
    rows = [(f.name, i, s.lower().decode("latin-1") if f.text else s.decode("latin-1"), len(s), f.text, f.lead) for i, f in enumerate(formats) for s in dict.fromkeys(f.signatures)]
    rows = [(*r, "(?=" + "".join(f"\\x{ord(c):02x}" for c in r[2]) + ")") for r in rows]
    return spark.createDataFrame(rows, "format string, priority int, sig string, sig_len int, text boolean, lead int, ahead string")


def halo_of(formats: list[Format]) -> int:
    """Bytes before a cluster that a signature may begin in."""
    return max((len(s) for f in formats for s in f.signatures), default=1) - 1


def hits(clusters: DataFrame, formats: list[Format]) -> DataFrame:
    """(image, start_offset, format, priority, sig_len) of every place where a file may start.

    ``halo`` holds the bytes before each cluster, so a signature across a boundary is found, once: in the cluster where it ends.
    Text signatures ignore the case of ASCII letters, and count only in clusters that look like text.
    """
    spark = clusters.sparkSession
    whole = clusters.select("image", "start_offset", F.length("halo").alias("h"), latin(F.concat("halo", "bytes")).alias("raw"), looks_like_text(latin(F.col("bytes"))).alias("readable"))
    whole = whole.withColumn("low", F.when(F.col("readable"), ascii_lower(F.col("raw"))))
    hay = F.when(F.col("text"), F.col("low")).otherwise(F.col("raw"))
    met = whole.join(F.broadcast(signature_table(spark, formats)), F.contains(hay, F.col("sig")))
    # cut before every occurrence, those that overlap included: each part but the first begins with one, and the first may
    parts = F.split(hay, F.col("ahead"), -1)
    start = F.when(F.startswith(hay, F.col("sig")), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(start.alias("at"), F.lit(0).alias("n"))
    walk = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, lambda a, p: F.struct(F.array_append(a["at"], a["n"] + F.length(p)).alias("at"), (a["n"] + F.length(p)).alias("n")))
    found = met.select("image", "format", "priority", "sig_len", "lead", "h", "start_offset", F.explode(walk["at"]).alias("at")).where(F.col("at") + F.col("sig_len") > F.col("h"))
    placed = found.withColumn("start_offset", F.col("start_offset") - F.col("h") + F.col("at") - F.col("lead")).where("start_offset >= 0")
    return placed.groupBy("image", "start_offset", "format", "priority").agg(F.max("sig_len").alias("sig_len"))


def first_hits(found: DataFrame) -> DataFrame:
    """One format for each place: the longest signature, then the first in the list."""
    best = F.min_by(F.struct("format", "priority", "sig_len"), F.struct(-F.col("sig_len"), "priority")).alias("x")
    return found.groupBy("image", "start_offset").agg(best).select("image", "start_offset", "x.*")
