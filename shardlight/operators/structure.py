"""Balance of whole documents without Python: tokens by regular expression, the stack by windows.

A running sum of +1 for an opening and -1 for a closing event gives each event its level: the sum itself for an opening, one
more for a closing. A closing event takes exactly one entry whatever its name, so the event before it at the
same level of the document is the opening one that a stack would give back. The first event where the sum is
below 0 or those names differ is the first violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERNS = {
    "html": r"(?s)<!--.*?(?:-->|\z)|<[^>]*>",
    "xml": r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<[^>]*>",
    "json": r'(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|[{}\[\]]',
    "rtf": r"(?s)\\.|[{}]",
}
TAG = r"(?s)^<(/)?([A-Za-z0-9_]+)([^>]*)>"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def tokens(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def events(rows: DataFrame, id_column: str, text_column: str, kind: str) -> DataFrame:
    """(id, pos, name, is_closing) of every tag or bracket; ``pos`` is its number among the document's tokens, from 0."""
    t = rows.select(id_column, F.posexplode(tokens(F.col(text_column), kind)).alias("pos", "t"))
    if kind in ("json", "rtf"):
        closes = F.col("t").isin("}", "]")
        name = F.when(F.col("t") == "}", "{").when(F.col("t") == "]", "[").otherwise(F.col("t"))
        return t.where(F.col("t").isin("{", "}", "[", "]")).select(id_column, "pos", name.alias("name"), closes.alias("is_closing"))
    part = lambda k: F.regexp_extract("t", TAG, k)
    t = t.where(~F.startswith("t", F.lit("<!")) & F.rlike("t", F.lit(TAG))).select(id_column, "pos", F.lower(part(2)).alias("name"), (part(1) == "/").alias("is_closing"), F.rtrim(part(3)).alias("rest"))
    t = t.where(~F.endswith("rest", F.lit("/")))
    t = t.where(~F.endswith("rest", F.lit("?"))) if kind == "xml" else t.where(~F.col("name").isin(*VOID))
    return t.drop("rest")


def balance(found: DataFrame, id_column: str) -> DataFrame:
    """(id, n_tags, depth, first_bad_pos, depth_at_bad, balanced) of each document with events; one shuffle, on the id."""
    by_doc = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = found.withColumn("d", F.sum(F.when(F.col("is_closing"), -1).otherwise(1)).over(by_doc))
    level = Window.partitionBy(id_column, "level").orderBy("pos")
    d = d.withColumn("level", F.col("d") + F.col("is_closing").cast("int"))
    bad = F.col("is_closing") & ((F.col("d") < 0) | ~F.lag("name").over(level).eqNullSafe(F.col("name")))
    d = d.withColumn("bad", bad)
    out = d.groupBy(id_column).agg(
        F.count("*").alias("n_tags"),
        F.sum(F.when(F.col("is_closing"), -1).otherwise(1)).alias("depth"),
        F.min(F.when(F.col("bad"), F.col("pos"))).alias("first_bad_pos"),
        F.min_by("d", F.when(F.col("bad"), F.col("pos"))).alias("depth_at_bad"),
    )
    return out.withColumn("balanced", F.col("first_bad_pos").isNull() & (F.col("depth") == 0))


def continues(stack: Column, closes: Column) -> Column:
    """Whether a cluster's unmatched closing names fit what is open: they are the top of the stack, read downwards."""
    n = F.size(closes)
    return (n <= F.size(stack)) & ((n == 0) | (F.slice(stack, -F.greatest(n, F.lit(1)), n) == F.reverse(closes)))
