"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source's budget is its share of the weights times a fraction of all
tokens, or of as many as the scarcest source allows: where a source has less than its share, all budgets shrink alike, so the shares
are met at every fraction, to within a document a source. A document is taken when the tokens of its source's documents up to and including its hash fit the
budget. The threshold is found without sorting: tokens are summed by source and the top 12 bits of the hash, the
bucket in which the running sum crosses the budget is located, and only its documents are summed again by the
next 12 bits, five levels in all. Several fractions give nested thresholds, so a smaller mix is part of a larger.

Tokens are words: runs of characters other than space, tab, newline and return. Their total decides the budgets, so
counts and thresholds cover all documents. Weights are 1 but for the sources that are named.

Defined cases: a null source is a source of its own, with the default weight; a null or empty text counts 0
tokens, and a source without tokens has no share and gives all its documents; rows that share an id share a hash and are taken or left together; rows with a null ``doc_id`` hash like
the id "" ; weights of sources that aren't there are ignored; an empty table gives none; other columns pass
through ``keep_mix`` and aren't read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import only, written

BITS, LEVELS = 12, 5
FRACTIONS = (0.25, 0.5, 0.8)
WEIGHTS: dict[str, float] = {}


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """60 bits that depend on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, tier, threshold): documents with a smaller hash fit the budget. Refines the boundary bucket level by level."""
    edge = budgets.select("source", "tier", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    inside = rows
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            # only the documents of some boundary bucket go on
            inside = rows.withColumn("prefix", F.shiftright("h", shift + BITS)).join(edge.select("source", "prefix").distinct(), ["source", "prefix"], "left_semi").drop("prefix")
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        parent = sums.withColumn("prefix", F.shiftright("bucket", BITS))
        run = Window.partitionBy("source", "tier").orderBy("bucket")
        met = parent.join(edge, ["source", "prefix"]).withColumn("upto", F.sum("tokens").over(run))
        over = met.where("upto > left").groupBy("source", "tier").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("tokens")).alias("left")), "bucket").alias("x"))
        edge = written(over.select("source", "tier", F.col("x.left").alias("left"), F.col("x.bucket").alias("prefix")), f"edge{level}")
    return edge.select("source", "tier", F.col("prefix").alias("threshold"))


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, h, tokens), written once: the levels read this, not the texts."""
    rows = only(docs, "doc_id", "source", "text")
    return written(rows.select("doc_id", F.to_json(F.array("source")).alias("source"), uniform(F.col("doc_id"), seed).alias("h"), tokens(F.col("text")).alias("tokens")), "measured")


def _name(source: Column) -> Column:
    """The source's own name out of the JSON array that stands for it, where null is a value like any other."""
    return F.from_json(source, "array<string>")[0]


def _cuts(rows: DataFrame, weights: dict[str, float], fractions: tuple[float, ...], default: float) -> DataFrame:
    """One row a source: an ascending array of (threshold, tier), null where the source fits whole."""
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("have"))
    weight = F.lit(default)
    for name, w in weights.items():
        weight = F.when(_name(F.col("source")) == name, F.lit(float(w))).otherwise(weight)
    totals = written(totals.withColumn("weight", F.when(F.col("have") > 0, weight.cast("double")).otherwise(0.0)), "totals")
    # sources of weight 0 are left out
    all_ = totals.agg(F.sum("weight").alias("weights"), F.sum("have").alias("total")).crossJoin(totals.where("weight > 0").agg(F.min(F.col("have") / F.col("weight")).alias("scarcest")))
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(sorted(fractions))]))
    budgets = totals.crossJoin(F.broadcast(all_)).select("source", "have", tiers.alias("t"), "weight", "weights", "total", "scarcest")
    budgets = budgets.select("source", "have", "t.tier", F.coalesce(F.floor(F.col("weight") * F.least(F.try_divide(F.col("t.fraction") * F.col("total"), F.col("weights")), F.col("scarcest"))), F.lit(0)).cast("long").alias("budget"))
    found = thresholds(rows, budgets.where("have > budget").select("source", "tier", "budget"))
    whole = budgets.where("have <= budget").select("source", "tier", F.lit(1 << 60).cast("long").alias("threshold"))
    return written(found.unionByName(whole).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("tier", "threshold"))).alias("cuts")), "cuts")


def _tiered(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    fits = F.filter("cuts", lambda c: F.col("h") < c["threshold"])
    return rows.join(cuts, "source").withColumn("tier", F.array_min(F.transform(fits, lambda c: c["tier"]))).where("tier IS NOT NULL").drop("cuts")


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, fractions: tuple[float, ...] = FRACTIONS, default: float = 1.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, tier) of the documents taken; ``tier`` is the smallest mix that has the document."""
    rows = measured(docs, seed)
    return _tiered(rows, _cuts(rows, weights, fractions, default)).select("doc_id", _name(F.col("source")).alias("source"), "tokens", "tier")


def keep_mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, fraction: float = FRACTIONS[-1], default: float = 1.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix with all their columns: one filter by source and hash."""
    cuts = _cuts(measured(docs, seed), weights, (fraction,), default).select(F.col("source").alias("__source"), F.col("cuts")[0]["threshold"].alias("__threshold"))
    named = F.to_json(F.array(docs["`source`"])) == F.col("__source")
    return docs.join(cuts, named & (uniform(docs["`doc_id`"], seed) < F.col("__threshold")), "left_semi")


#: ``mix`` with its defaults over ``documents``.
SQL = """
WITH m AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens
  FROM documents
), s AS (
  SELECT source, sum(tokens) AS have, CASE WHEN sum(tokens) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM m GROUP BY source
), b AS (
  SELECT source, tier, coalesce(floor(weight * least(fraction * (SELECT sum(have) FROM s) / (SELECT sum(weight) FROM s), (SELECT min(have / weight) FROM s WHERE weight > 0))), 0) AS budget
  FROM s, (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE)) AS f(tier, fraction)
), r AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM m
)
SELECT r.doc_id, r.source, r.tokens, CAST(min(b.tier) AS INTEGER) AS tier
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.upto <= b.budget
GROUP BY r.doc_id, r.source, r.tokens, r.h, r.upto
"""
