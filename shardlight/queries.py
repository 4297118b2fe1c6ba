"""Queries over the driver's tables for the engine's operators, and the SQL that gives the same rows."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary
from .functions.catalogue import FORMATS
from .operators import carve, report, scan, structure, virtual
from .options import CarveOptions
from .plans.carver import Carver, contents, members
from .plans.tables import image_of, kept, shared_folder
from .sources.configs import ranked_files
from .sources.image import located, register, splits
from .sources.output import merge_reports, write_worker_reports

STRUCTURAL = ("html", "body", "head", "nav", "ul", "li", "article", "div")
_IN = ", ".join(f"'{t}'" for t in STRUCTURAL)
_VOID = ", ".join(f"'{t}'" for t in structure.VOID)
WORKERS, LOOKAHEAD = 8, 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.clusters(_table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "cluster_id", "start_offset", (F.col("start_offset") + F.col("n_bytes")).alias("end_offset"))


_PADDED = "p AS (SELECT page_id, html, octet_length(encode(html)) AS n, CAST(ceil(octet_length(encode(html)) / 4096.0) AS BIGINT) AS k FROM pages WHERE html <> ''), o AS (SELECT *, CAST(coalesce(sum(k) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM p), c AS (SELECT page_id, html, base + i AS cluster_id, i, least(4096, n - i * 4096) AS n_bytes FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM o))"
_SCAN = f"WITH {_PADDED} SELECT page_id, cluster_id, cluster_id * 4096 AS start_offset, cluster_id * 4096 + n_bytes AS end_offset FROM c"


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.ceil(F.octet_length("html") / virtual.CLUSTER) * virtual.CLUSTER).cast("long")
    total = _table(spark, sf_dir, "pages").agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return spark.createDataFrame([(w, a, z) for w, (a, z) in enumerate(splits(total, WORKERS, virtual.CLUSTER))], "worker_id int, start_offset long, end_offset long")


_SPLIT = f"WITH t AS (SELECT CAST(sum(ceil(octet_length(encode(html)) / 4096.0)) * 4096 AS BIGINT) AS total FROM pages), s AS (SELECT total, greatest(4096, total // {WORKERS} // 4096 * 4096) AS step FROM t) SELECT CAST(w AS INTEGER) AS worker_id, w * step AS start_offset, CASE WHEN w = {WORKERS - 1} THEN total ELSE least((w + 1) * step, total) END AS end_offset FROM s, generate_series(0, {WORKERS - 1}) g(w) WHERE w * step < total"


def signature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").where("html IS NOT NULL")
    cl = pages.select(F.col("page_id").alias("image"), F.lit(0).cast("long").alias("start_offset"), F.col("html").cast("binary").alias("bytes"), F.unhex(F.lit("")).alias("halo"))
    return scan.first_hits(scan.hits(cl, CarveOptions().active())).select(F.col("image").alias("page_id"), "start_offset", "format", "sig_len")


def _signature_sql() -> str:
    values, lower = [], "translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for i, f in enumerate(CarveOptions().active()):
        for s in f.signatures:
            if all(32 <= b < 127 for b in s):  # other bytes don't occur in these texts
                sig = (s.lower() if f.text else s).decode().replace("'", "''")
                values.append(f"('{f.name}', {i}, '{sig}', {len(s)}, {str(f.text).lower()}, {f.lead})")
    gate = "octet_length(encode(html)) > 0 AND 1 - len(regexp_extract_all(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) / octet_length(encode(html)) >= 0.95"
    return (
        f"WITH s(format, priority, sig, sig_len, is_text, lead) AS (VALUES {', '.join(values)}), "
        f"m AS (SELECT page_id, s.*, string_split(CASE WHEN is_text THEN {lower} ELSE html END, sig) AS parts FROM pages, s WHERE contains(CASE WHEN is_text THEN {lower} ELSE html END, sig) AND (NOT is_text OR ({gate}))), "
        "i AS (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM m), "
        "h AS (SELECT page_id, format, priority, sig_len, CAST(list_sum(list_transform(parts[1:k], lambda x: octet_length(encode(x)))) + (k - 1) * sig_len - lead AS BIGINT) AS start_offset FROM i) "
        "SELECT page_id, start_offset, format, sig_len FROM (SELECT *, row_number() OVER (PARTITION BY page_id, start_offset ORDER BY sig_len DESC, priority) AS r FROM h WHERE start_offset >= 0) WHERE r = 1"
    )


def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", binary.latin(F.col("text").cast("binary")).alias("s"))
    return d.select("doc_id", F.length("s").alias("n_bytes"), binary.control_count(F.col("s")).alias("n_control"), binary.count_of(F.col("s"), "<").alias("n_open"), binary.looks_like_text(F.col("s")).alias("readable"))


_CONTROL = "len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]'))"
_GATE = f"SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, CAST({_CONTROL} AS INTEGER) AS n_control, CAST(length(text) - length(replace(text, '<', '')) AS INTEGER) AS n_open, octet_length(encode(text)) > 0 AND 1 - {_CONTROL} / octet_length(encode(text)) >= 0.95 AS readable FROM documents WHERE text IS NOT NULL"


def tag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.events(_table(spark, sf_dir, "pages"), "page_id", "html", "html")


_TOKENS = f"t AS (SELECT page_id, unnest(x) AS t, unnest(generate_series(0, len(x) - 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{structure.PATTERNS['html']}') AS x FROM pages) WHERE len(x) > 0), e AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(t, '{structure.TAG}', 2)) AS name, regexp_extract(t, '{structure.TAG}', 1) = '/' AS is_closing, rtrim(regexp_extract(t, '{structure.TAG}', 3)) AS rest FROM t WHERE NOT starts_with(t, '<!') AND regexp_matches(t, '{structure.TAG}')), v AS (SELECT page_id, pos, name, is_closing FROM e WHERE NOT ends_with(rest, '/') AND name NOT IN ({_VOID}))"


def stack_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.balance(tag_events(spark, sf_dir), "page_id")


def _structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.balance(tag_events(spark, sf_dir).where(F.col("name").isin(*STRUCTURAL)), "page_id")


def stack_balance_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structural(spark, sf_dir).select("page_id", "n_tags", "depth", "balanced")


def _balance_sql(source: str, key: str, more: str = "") -> str:
    return (
        f"WITH {source}, x AS (SELECT * FROM v {more}), d AS (SELECT *, sum(CASE WHEN is_closing THEN -1 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY pos) AS d FROM x), "
        f"l AS (SELECT *, d + CAST(is_closing AS INTEGER) AS level FROM d), b AS (SELECT *, is_closing AND (d < 0 OR lag(name) OVER (PARTITION BY {key}, level ORDER BY pos) IS DISTINCT FROM name) AS bad FROM l), "
        f"g AS (SELECT {key}, count(*) AS n_tags, CAST(sum(CASE WHEN is_closing THEN -1 ELSE 1 END) AS BIGINT) AS depth, min(pos) FILTER (bad) AS first_bad_pos, CAST(arg_min(d, pos) FILTER (bad) AS BIGINT) AS depth_at_bad FROM b GROUP BY {key}) "
    )


_ALL_OUT = "SELECT *, first_bad_pos IS NULL AND depth = 0 AS balanced FROM g"


def carve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its structural tags: whole, broken by a wrong tag, or still open at its end."""
    b = _structural(spark, sf_dir)
    status = F.when(F.col("first_bad_pos").isNotNull(), "partial").when(F.col("depth") == 0, "complete").otherwise("incomplete_eof")
    return b.withColumn("status", status).groupBy("status").agg(F.count("*").alias("files"), F.sum("n_tags").alias("tags"))


_STATUS = _balance_sql(_TOKENS, "page_id", f"WHERE name IN ({_IN})") + "SELECT CASE WHEN first_bad_pos IS NOT NULL THEN 'partial' WHEN depth = 0 THEN 'complete' ELSE 'incomplete_eof' END AS status, count(*) AS files, CAST(sum(n_tags) AS BIGINT) AS tags FROM g GROUP BY 1"


def json_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.when(F.expr("substr(props, -2, 1) < '5'"), F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = _table(spark, sf_dir, "events").select("event_id", props.alias("props"))
    return structure.balance(structure.events(rows, "event_id", "props", "json"), "event_id").select("event_id", "n_tags", "depth", "balanced")


_JSON = (
    _balance_sql(
        f"t AS (SELECT event_id, unnest(x) AS t, unnest(generate_series(0, len(x) - 1)) AS pos FROM (SELECT event_id, regexp_extract_all(CASE WHEN substr(props, -2, 1) < '5' THEN substr(props, 1, length(props) - 1) ELSE props END, '{structure.PATTERNS['json']}') AS x FROM events) WHERE len(x) > 0), v AS (SELECT event_id, pos, replace(replace(t, '}}', '{{'), ']', '[') AS name, t IN ('}}', ']') AS is_closing FROM t WHERE t IN ('{{', '}}', '[', ']'))",
        "event_id",
    )
    + "SELECT event_id, n_tags, depth, first_bad_pos IS NULL AND depth = 0 AS balanced FROM g"
)


def fragment_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of each page when clusters that begin with a space or an e are taken for damaged."""
    c = virtual.clusters(_table(spark, sf_dir, "pages"), "page_id", "html").where(~F.hex(F.substring("bytes", 1, 1)).isin("20", "65"))
    c = c.withColumn("end_offset", F.col("start_offset") + virtual.CLUSTER)
    return report.coalesced(c, "page_id").select("page_id", F.col("fragment_id").cast("int").alias("fragment_id"), "start_offset", "end_offset", "size")


_COALESCE = f"WITH {_PADDED}, r AS (SELECT page_id, cluster_id, cluster_id - row_number() OVER (PARTITION BY page_id ORDER BY cluster_id) AS island FROM c WHERE hex(array_slice(encode(html), i * 4096 + 1, i * 4096 + 1)) NOT IN ('20', '65')), g AS (SELECT page_id, min(cluster_id) * 4096 AS start_offset, (max(cluster_id) + 1) * 4096 AS end_offset FROM r GROUP BY page_id, island) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY start_offset) - 1 AS INTEGER) AS fragment_id, start_offset, end_offset, end_offset - start_offset AS size FROM g"


def gap_jump_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = virtual.clusters(_table(spark, sf_dir, "pages"), "page_id", "html").select("cluster_id", "n_bytes")
    return virtual.next_match(c, "cluster_id", "true", "n_bytes >= 0.8 * 4096", LOOKAHEAD).na.fill(-1, ["match"])


_JUMP = f"WITH {_PADDED} SELECT a.cluster_id AS id, coalesce((SELECT min(b.cluster_id) FROM c b WHERE b.cluster_id > a.cluster_id AND b.cluster_id <= a.cluster_id + {LOOKAHEAD} AND b.n_bytes >= 0.8 * 4096), -1) AS match FROM c a"


def _pages_image(spark: SparkSession, sf_dir: str) -> str:
    """All pages as one image, each padded to whole clusters."""
    c = kept(virtual.clusters(_table(spark, sf_dir, "pages"), "page_id", "html").select("start_offset", "bytes"))
    size = c.agg(F.coalesce(F.max("start_offset") + virtual.CLUSTER, F.lit(0).cast("long"))).first()[0]
    return image_of(c, size, "pages")


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of an image through the source, from the 11th on by a filter that the source takes."""
    register(spark)
    df = spark.read.format("raw_image").option("splits", WORKERS).load(_pages_image(spark, sf_dir))
    return df.where(F.col("start_offset") >= 10 * virtual.CLUSTER).select("cluster_id", "start_offset", "end_offset", F.md5("bytes").alias("digest"))


_WHOLE = "w AS (SELECT cluster_id, array_slice(encode(html), i * 4096 + 1, i * 4096 + 4096) || from_hex(repeat('00', CAST(4096 - n_bytes AS BIGINT))) AS b FROM c)"
_IMAGE = f"WITH {_PADDED}, {_WHOLE} SELECT cluster_id, cluster_id * 4096 AS start_offset, (cluster_id + 1) * 4096 AS end_offset, md5(b) AS digest FROM w WHERE cluster_id >= 10"


def overlap_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes before each cluster of an image, which the source gives along with it."""
    register(spark)
    df = spark.read.format("raw_image").option("halo", 15).option("splits", WORKERS).load(_pages_image(spark, sf_dir))
    return df.select("cluster_id", F.hex("halo").alias("tail"))


_TAIL = f"WITH {_PADDED}, {_WHOLE} SELECT cluster_id, coalesce(hex(array_slice(lag(b) OVER (ORDER BY cluster_id), 4082, 4096)), '') AS tail FROM w"


def linear_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format of one's own, given by its first and last bytes, carved out of the image of all pages, in ranges of 1 MiB."""
    opt = CarveOptions(formats=(), custom=(("nav", b"<nav>", b"</nav>"),))
    files = Carver(spark, opt, 1 << 20).files(_pages_image(spark, sf_dir))
    return files.select("file_id", "filename", "status", report.first_start(F.col("fragments")).alias("start_offset"), "total_size")


def _places_sql(what: str) -> str:
    return f"SELECT base * 4096 + CAST(coalesce(list_sum(list_transform(parts[1:j], lambda x: octet_length(encode(x)))), 0) AS BIGINT) + (j - 1) * {len(what)} AS pos FROM (SELECT base, parts, unnest(generate_series(1, len(parts) - 1)) AS j FROM (SELECT base, string_split(html, '{what}') AS parts FROM o))"


_LINEAR = (
    f"WITH {_PADDED}, h AS ({_places_sql('<nav>')}), f AS ({_places_sql('</nav>')}), "
    "m AS (SELECT h.pos, f.pos + 6 AS z FROM h ASOF LEFT JOIN f ON h.pos + 5 <= f.pos), g AS (SELECT min(pos) AS start_offset, z FROM m GROUP BY z), n AS (SELECT *, row_number() OVER (ORDER BY start_offset) - 1 AS r FROM g) "
    "SELECT CAST(r AS INTEGER) AS file_id, 'carved_w0_' || r || CASE WHEN z IS NULL THEN '_partial' ELSE '' END || '.nav' AS filename, CASE WHEN z IS NULL THEN 'incomplete_eof' ELSE 'complete' END AS status, start_offset, coalesce(z, (SELECT CAST(sum(k) AS BIGINT) * 4096 FROM p)) - start_offset AS total_size FROM n"
)

SMALL = 512


def _broken_image(spark: SparkSession, sf_dir: str) -> str:
    """A JSON file for each document, about as long as its text is; a cluster of noise stands between each file's first cluster and the rest."""
    body = F.expr("concat('{\"doc\":', doc_id, ',\"key\":[\"', repeat(concat(md5(cast(doc_id AS string)), '\",\"'), cast(1 + coalesce(n_chars, 0) div 50 AS int)), 'end\"]}')")
    rows = _table(spark, sf_dir, "documents").select("doc_id", body.cast("binary").alias("body"))
    rows = rows.withColumn("k", F.ceil(F.octet_length("body") / SMALL)).withColumn("space", ((F.col("k") + 1) * SMALL).cast("long"))
    placed = kept(virtual.offsets(rows, "doc_id", "space"))
    size = placed.agg(F.coalesce(F.max(F.col("start_offset") + F.col("space")), F.lit(0).cast("long"))).first()[0]
    first = placed.select("start_offset", F.substring("body", 1, SMALL).alias("bytes"))
    noise = placed.select((F.col("start_offset") + SMALL).alias("start_offset"), F.unhex(F.lit("01" * SMALL)).alias("bytes"))
    rest = placed.where("k > 1").select((F.col("start_offset") + 2 * SMALL).alias("start_offset"), F.expr(f"substring(body, {SMALL + 1})").alias("bytes"))
    return image_of(first.unionByName(noise).unionByName(rest), size, "broken")


def _broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(Carver(spark, CarveOptions(SMALL, 4, ("json",)), 1 << 20).files(_broken_image(spark, sf_dir)))


def carve_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that foreign clusters break: put together by the state that was saved before the gap, numbered by worker, and read back.

    The cluster that broke a file counts in its fragments and size, but isn't in what is read back.
    """
    files = _broken_files(spark, sf_dir)
    parts = contents(files).groupBy("worker_id", "file_id").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("parts"))
    whole = F.md5(F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["content"]))).alias("digest")
    own = files.select("worker_id", "file_id", "filename", "status", report.first_start(F.col("fragments")).alias("start_offset"), F.size("fragments").alias("n_fragments"), "total_size")
    return own.join(parts.select("worker_id", "file_id", whole), ["worker_id", "file_id"])


_BROKEN = (
    f"d AS (SELECT doc_id, '{{\"doc\":' || doc_id || ',\"key\":[\"' || repeat(md5(CAST(doc_id AS VARCHAR)) || '\",\"', 1 + coalesce(n_chars, 0) // 50) || 'end\"]}}' AS body FROM documents), "
    f"k AS (SELECT doc_id, body, length(body) AS n, CAST(ceil(length(body) / {SMALL}.0) AS BIGINT) AS k FROM d), "
    f"a AS (SELECT *, CAST(coalesce(sum(k + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {SMALL} AS BIGINT) AS start_offset, CAST(sum(k + 1) OVER () * {SMALL} AS BIGINT) AS size FROM k), "
    f"v AS (SELECT *, CAST(least(3, start_offset // greatest({SMALL}, size // 4 // {SMALL} * {SMALL})) AS INTEGER) AS worker_id FROM a), "
    "u AS (SELECT *, CAST(row_number() OVER (PARTITION BY worker_id ORDER BY start_offset) - 1 AS INTEGER) AS file_id FROM v)"
)
_GAPS = f"WITH {_BROKEN} SELECT worker_id, file_id, 'carved_w' || worker_id || '_' || file_id || '.json' AS filename, 'complete' AS status, start_offset, CASE WHEN k > 1 THEN 2 ELSE 1 END AS n_fragments, n + CASE WHEN k > 1 THEN {SMALL} ELSE 0 END AS total_size, md5(body) AS digest FROM u"


def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workers' reports of such a run, written, merged and read again: the order of the merged file as a column."""
    base, path = located(shared_folder(spark))
    folder = Path(path) / f"reports-{uuid4().hex}"
    folder.mkdir(parents=True)
    write_worker_reports(_broken_files(spark, sf_dir), folder, 4)
    merged = ranked_files(spark, str(merge_reports(spark, folder)))
    return merged.select("rank", "f.filename", "f.status", F.size("f.fragments").alias("n_fragments"), "f.total_size")


_MERGED = f"WITH {_BROKEN} SELECT CAST(row_number() OVER (ORDER BY start_offset) - 1 AS INTEGER) AS rank, 'carved_w' || worker_id || '_' || file_id || '.json' AS filename, 'complete' AS status, CASE WHEN k > 1 THEN 2 ELSE 1 END AS n_fragments, n + CASE WHEN k > 1 THEN {SMALL} ELSE 0 END AS total_size FROM u"

TASK_KEYS = 20_000
_TEXTS = (("xml", '<?xml version="1.0"?><row><id>#</id><!-- <p> --><name>name #</name></row>'), ("html", "<!DOCTYPE html><html><body><p>line<br># <i>x</i></p></body></html>"), ("json", '{"id":#,"name":"a \\" #","list":[1,{"b":2}]}'), ("rtf", "{\\rtf1 {\\b bold #} \\{ # }"))


def text_walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each text format for each customer: whole, whole with text after it, or cut short."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, t in _TEXTS])).alias("x")
    # few tasks read so narrow a table: keys are spread before they become texts, TASK_KEYS to a task at most
    keys = _table(spark, sf_dir, "customer").select("c_custkey")
    keys = keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_KEYS)), "c_custkey")
    rows = keys.select("c_custkey", kinds).select(F.concat_ws(":", "x.kind", "c_custkey").alias("name"), F.col("c_custkey") % 3, F.replace("x.t", F.lit("#"), F.col("c_custkey").cast("string"))).toDF("name", "how", "t")
    value = F.when(F.col("how") == 0, F.expr("substring(t, 1, length(t) - 3)")).when(F.col("how") == 1, F.concat("t", F.when(F.startswith("name", F.lit("json")), F.lit(" \n ")).otherwise(F.lit(" and more")))).otherwise(F.col("t"))
    files = carve.carve_values(rows.withColumn("value", value), "name", "value", CarveOptions(formats=("xml", "html", "json", "rtf")))
    return files.select(F.col("image").alias("name"), "file_id", "format", "status", "total_size")


_TEXT_SQL = "WITH k(kind, t) AS (VALUES {}), r AS (SELECT kind, kind || ':' || c_custkey AS name, c_custkey % 3 AS how, length(replace(t, '#', CAST(c_custkey AS VARCHAR))) AS n FROM customer, k) SELECT name, CAST(0 AS INTEGER) AS file_id, kind AS format, CASE WHEN how = 0 THEN 'incomplete_eof' ELSE 'complete' END AS status, CASE WHEN how = 0 THEN n - 3 ELSE n END AS total_size FROM r".format(
    ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in _TEXTS)
)


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a page, with the fragments that ``fragment_coalesce`` leaves it; pages without one have an empty list."""
    f = fragment_coalesce(spark, sf_dir).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("start_offset", "end_offset", "size"))).alias("fragments"))
    files = _table(spark, sf_dir, "pages").select("page_id").join(f, "page_id", "left")
    files = files.withColumn("fragments", F.coalesce("fragments", F.array().cast(f.schema["fragments"].dataType)))
    status = F.when(F.size("fragments") == 1, "complete").when(F.size("fragments") > 1, "partial").otherwise("incomplete_eof")
    return files.withColumn("status", status).withColumn("total_size", report.total_size(F.col("fragments")))


_FILES = f"f AS ({_COALESCE}), g AS (SELECT page_id, count(start_offset) AS n, coalesce(CAST(sum(size) AS BIGINT), 0) AS total_size, coalesce(min(start_offset), 0) AS first_start, max(end_offset) AS last_end FROM (SELECT page_id FROM pages) LEFT JOIN f USING (page_id) GROUP BY page_id), s AS (SELECT *, CASE WHEN n = 1 THEN 'complete' WHEN n > 1 THEN 'partial' ELSE 'incomplete_eof' END AS status FROM g)"


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(_reported(spark, sf_dir))


def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of eight workers, merged by first start; ``n_fragments`` 0 sorts as start 0."""
    f = _reported(spark, sf_dir).select((F.col("page_id") % WORKERS).alias("worker_id"), F.struct(F.col("page_id").cast("int").alias("file_id"), F.format_string("carved_%d", "page_id").alias("filename"), "status", "fragments", "total_size").alias("f"))
    merged = report.merged(f.groupBy("worker_id").agg(F.collect_list("f").alias("files")))
    return merged.select("file_id", "filename", "status", F.size("fragments").cast("long").alias("n_fragments"), report.first_start(F.col("fragments")).alias("first_start"), "total_size")


def dashboard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _reported(spark, sf_dir).select("page_id", F.posexplode(report.layout(F.col("fragments"))).alias("fragment_id", "b"))
    return f.select("page_id", "fragment_id", F.round("b.left_pct", 6).alias("left_pct"), F.round("b.width_pct", 6).alias("width_pct"), "b.is_last")


_LAYOUT = f"WITH f AS ({_COALESCE}), s AS (SELECT *, min(start_offset) OVER w AS a, max(end_offset) OVER w AS z, max(fragment_id) OVER w AS top FROM f WINDOW w AS (PARTITION BY page_id)) SELECT page_id, fragment_id, round((start_offset - a) * 100.0::DOUBLE / (z - a), 6) AS left_pct, round(greatest(2.0::DOUBLE, size * 100.0::DOUBLE / (z - a)), 6) AS width_pct, fragment_id = top AS is_last FROM s"

_MEMBERS = (("word/document.xml", "[Content_Types].xml"), ("xl/workbook.xml",), ("ppt/presentation.xml", "a.txt"), ("readme.txt", "b/c.txt"), ("xl/workbook.xml", "word/document.xml"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, value): a ZIP archive for each nation, whose members hold its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for member in _MEMBERS[key % len(_MEMBERS)]:
                        z.writestr(zipfile.ZipInfo(member, (2020, 1, 1, 0, 0, 0)), name)
                values.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], ["n_nationkey", "value"])

    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name").mapInArrow(run, "n_nationkey long, value binary")


def office_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole archives carved and named by their main member."""
    files = carve.carve_values(_archives(spark, sf_dir), "n_nationkey", "value", CarveOptions(formats=("zip",)))
    return files.select(F.col("image").cast("long").alias("n_nationkey"), "file_id", "format", "status")


_OFFICE = "SELECT n_nationkey, CAST(0 AS INTEGER) AS file_id, CASE n_nationkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' WHEN 3 THEN 'zip' ELSE 'docx' END AS format, 'complete' AS status FROM nation"


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the plain archives in an image, which holds one archive every 8192 bytes."""
    rows = kept(_archives(spark, sf_dir).select((F.col("n_nationkey") * 8192).alias("start_offset"), F.col("value").alias("bytes")))
    size = rows.agg(F.coalesce(F.max("start_offset") + 8192, F.lit(0).cast("long"))).first()[0]
    files = Carver(spark, CarveOptions(formats=("zip",)), 1 << 16).files(image_of(rows, size, "archives"))
    at = files.select("filename", (report.first_start(F.col("fragments")) / 8192).cast("long").alias("n_nationkey"))
    return members(files).join(at, "filename").select("n_nationkey", "member", F.md5("content").alias("digest"), "error")


_ARCHIVED = "SELECT n_nationkey, unnest(['readme.txt', 'b/c.txt']) AS member, md5(n_name) AS digest, CAST(NULL AS VARCHAR) AS error FROM nation WHERE n_nationkey % 5 = 3"


def _headers() -> list[tuple[int, str, bytes, int | None]]:
    """(case, format, first bytes, size that they mean)."""
    sq = b"SQLite format 3\0" + struct.pack(">H", 4096) + bytes(10) + struct.pack(">I", 2) + bytes(68)
    return [
        (1, "sqlite", sq, 8192), (2, "sqlite", sq[:16] + b"\0\1" + sq[18:], 131072), (3, "sqlite", sq[:16] + b"\0\0" + sq[18:], None),
        (4, "bmp", b"BM" + struct.pack("<III", 1078, 0, 54), 1078), (5, "bmp", b"BM" + struct.pack("<III", 1078, 7, 54), None),
        (6, "wav", b"RIFF" + struct.pack("<I", 24) + b"WAVE", 32), (7, "avi", b"RIFF" + struct.pack("<I", 20) + b"AVI ", 28), (8, "wav", b"RIFF" + struct.pack("<I", 20) + b"AVI ", None),
        (9, "au", b".snd" + struct.pack(">II", 24, 10), 34), (10, "au", b".snd" + struct.pack(">II", 8, 10), None),
        (11, "7z", b"7z\xbc\xaf\x27\x1c" + bytes(6) + struct.pack("<QQI", 10, 5, 0), 47),
        (12, "wim", b"MSWIM\0\0\0" + struct.pack("<I", 120) + bytes(36) + struct.pack("<QQQ", 100, 1000, 100) + struct.pack("<QQQ", 200, 1100, 200) + bytes(24), 1300),
    ]


def header_only_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, f, bytearray(b)) for n, f, b, _ in _headers()], "case_id int, format string, head binary")
    size = F.lit(None).cast("long")
    for f in ("sqlite", "bmp", "wav", "avi", "au", "7z", "wim"):
        size = F.when(F.col("format") == f, binary.header_size(f, F.col("head"))).otherwise(size)
    return rows.select("case_id", "format", F.coalesce(size, F.lit(-1).cast("long")).alias("size"))


_SIZES = "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{f}', CAST({-1 if s is None else s} AS BIGINT))" for n, f, _, s in _headers()) + ") t(case_id, format, size)"


@cache
def samples() -> tuple[tuple[str, bytes], ...]:
    """A small whole file of each binary format, made here."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    noise = bytes((i * 37 + 11) % 251 for i in range(6000))
    zipped, tarred = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.txt", "b.txt"):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), noise)
    with tarfile.open(fileobj=tarred, mode="w", format=tarfile.USTAR_FORMAT) as t:
        info = tarfile.TarInfo("a.bin")
        info.size = len(noise)
        t.addfile(info, io.BytesIO(noise))
    asf = lambda guid: FORMATS["wma"].signatures[0] + struct.pack("<Q", 200) + bytes(6) + bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365") + bytes(24) + struct.pack("<Q", 1000) + bytes.fromhex(guid) + bytes(106) + noise[:800]
    entry = struct.pack("<HHI", 273, 4, 1) + struct.pack("<I", 100) + struct.pack("<HHI", 279, 3, 1) + struct.pack("<HH", 700, 0)
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    wal = bytes.fromhex("377f0682") + bytes(4) + struct.pack(">I", 512) + bytes(4) + b"saltsalt" + bytes(8)
    data = {
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", noise) + chunk(b"IEND", b""),
        "jpg": b"\xff\xd8\xff\xe0\0\x10" + bytes(14) + b"\xff\xe1\0\x08\xff\xd9\xff\xd9\0\0" + b"\xff\xda\0\x04\0\0" + b"\x12\xff\0\x34" * 1500 + b"\xff\xd9",
        "gif": b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + bytes(9) + b"\x02" + (b"\xc8" + bytes(200)) * 9 + b"\0\x3b",
        "tiff": b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entry + bytes(4) + bytes(62) + noise[:700],
        "pcx": b"\x0a\x05\x01\x08" + struct.pack("<HHHH", 0, 0, 9, 9) + bytes(53) + b"\x01" + struct.pack("<H", 10) + bytes(60) + bytes(100) + b"\x0c" + bytes(768),
        "mp3": b"ID3\3\0\0\0\0\0\x0a" + bytes(10) + frame * 12 + b"TAG" + bytes(125),
        "wma": asf("00" * 16), "wmv": asf("c0ef19bc4d5bcf11a8fd00805f5c442b"),
        "mp4": box(b"ftyp", b"isomabcd") + box(b"mdat", noise), "mov": box(b"wide", b"") + box(b"mdat", noise),
        "flv": b"FLV\1\5" + struct.pack(">I", 9) + bytes(4) + b"\x08\0\x03\xe8" + bytes(7) + noise[:1000] + struct.pack(">I", 1011),
        "mpg": b"\0\0\1\xba" + noise[:5000] + b"\0\0\1\xb9",
        "rar": b"Rar!\x1a\7\0" + b"\0\0\x73\0\0\x0d\0" + bytes(6) + b"\0\0\x7b\0\0\7\0",
        "gz": gzip.compress(noise * 3, mtime=0), "bz2": bz2.compress(noise),
        "zip": zipped.getvalue(), "tar": tarred.getvalue()[: 512 + 6144 + 1024],
        "pdf": b"%PDF-1.4\n1 0 obj << /Length 5000 >>\nstream\n" + noise[:5000] + b"\nendstream endobj\n2 0 obj <<>>\nstream\nxx\nendstream\n%%EOF",
        "sqlitewal": wal + (struct.pack(">II", 1, 1) + b"saltsalt" + bytes(8) + bytes(512)) * 3,
        "sqlite": _headers()[0][2] + bytes(8092), "bmp": _headers()[3][2] + bytes(1064), "wav": _headers()[5][2] + bytes(20),
        "avi": _headers()[6][2] + bytes(16), "au": _headers()[8][2] + bytes(22), "7z": _headers()[10][2] + bytes(15), "wim": _headers()[11][2] + bytes(1180),
    }
    return tuple(data.items())


def walkers_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample, padded with zeros to the next cluster and one more, carved out of an image of its own."""
    rows = spark.createDataFrame([(k, bytearray(v + bytes(2 * 512 - len(v) % 512))) for k, v in samples()], "name string, value binary")
    files = carve.carve_values(rows, "name", "value", CarveOptions(512))
    return files.select(F.col("image").alias("name"), "file_id", "format", "status", "total_size")


_WALKERS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 0, '{k}', 'complete', CAST({len(v)} AS BIGINT))" for k, v in samples()) + ") t(name, file_id, format, status, total_size)"


def carve_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an image: the files of all formats in it, by the walk that images get."""
    return carve.carve_values(_table(spark, sf_dir, "pages"), "page_id", "html")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (carve_status, scan_clusters, split_plan, signature_hits, text_gate, tag_events, stack_balance, stack_balance_structural, json_brackets, fragment_coalesce, gap_jump_nearest, overlap_tail, linear_carve, status_summary, merge_sorted, dashboard_layout, office_detect, header_only_sizes, walkers_binary, carve_pages, image_scan, carve_gaps, merged_report, text_walkers, archive_members)
}
ORACLE_SQL: dict[str, str] = {
    "carve_status": _STATUS, "scan_clusters": _SCAN, "split_plan": _SPLIT, "signature_hits": _signature_sql(), "text_gate": _GATE,
    "tag_events": f"WITH {_TOKENS} SELECT * FROM v",
    "stack_balance": _balance_sql(_TOKENS, "page_id") + _ALL_OUT, "stack_balance_structural": _balance_sql(_TOKENS, "page_id", f"WHERE name IN ({_IN})") + "SELECT page_id, n_tags, depth, first_bad_pos IS NULL AND depth = 0 AS balanced FROM g",
    "json_brackets": _JSON, "fragment_coalesce": _COALESCE, "gap_jump_nearest": _JUMP, "overlap_tail": _TAIL, "linear_carve": _LINEAR,
    "status_summary": f"WITH {_FILES} SELECT count(*) AS files, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'incomplete_eof') AS incomplete_eof, CAST(sum(total_size) AS BIGINT) AS total_size FROM s",
    "merge_sorted": f"WITH {_FILES} SELECT CAST(page_id AS INTEGER) AS file_id, 'carved_' || page_id AS filename, status, n AS n_fragments, first_start, total_size FROM s",
    "dashboard_layout": _LAYOUT, "office_detect": _OFFICE, "header_only_sizes": _SIZES, "walkers_binary": _WALKERS,
    "image_scan": _IMAGE, "carve_gaps": _GAPS, "merged_report": _MERGED, "text_walkers": _TEXT_SQL, "archive_members": _ARCHIVED,
}
