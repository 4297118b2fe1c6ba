"""Whole runs over image files: source, scan, walk in ranges, contents, reports, dashboard, command line."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from shardlight import cli
from shardlight.functions import binary
from shardlight.operators import report, scan, structure
from shardlight.operators.carve import carve_hits, search
from shardlight.operators.follow import Image
from shardlight.options import CarveOptions
from shardlight.plans.carver import Carver, contents, members, write_files, write_members
from shardlight.queries import samples
from shardlight.sources import output
from shardlight.sources.configs import custom_formats, ranked_files, reports
from shardlight.sources.image import Buffered, register, splits
from shardlight.sources.output import dashboard, merge_reports, numbered_folder, write_worker_reports


def mixed_image(seed, n=60):
    """Samples, markup, broken starts and noise on cluster boundaries."""
    rng, data = random.Random(seed), dict(samples())
    out = b""
    for _ in range(n):
        kind = rng.choice([*data, "noise", "html", "cut", "json"])
        if kind == "noise":
            body = rng.randbytes(rng.randint(1, 3000))
        elif kind == "html":
            body = b"<html><body><p>" + b"text " * rng.randint(1, 300) + b"</p></body></html>"
        elif kind == "json":
            body = b'{"a": [1, {"b": "c"}]}'
        elif kind == "cut":
            body = data[rng.choice(["png", "zip", "jpg"])][: rng.randint(10, 4000)]
        else:
            body = data[kind]
        out += body + bytes(-len(body) % 512)
    return out


def rows_of(files):
    return sorted((r["fragments"][0]["start_offset"], r["format"], r["status"], r["total_size"]) for r in files.collect())


@pytest.fixture
def write(tmp_path):
    def make(data, name="disk.dd"):
        path = tmp_path / name
        path.write_bytes(data)
        return str(path)

    return make


@pytest.mark.parametrize("compat", [False, True])
def test_result_is_that_of_one_cursor_whatever_the_ranges(spark, write, compat):
    data = mixed_image(1)
    opt = CarveOptions(512, compat=compat, max_search_clusters=20)
    formats = opt.active()
    found = search(data, formats)
    if compat:  # one format a place
        found = [(a, k) for i, (a, k) in enumerate(found) if not i or found[i - 1][0] != a]
    plain = sorted((f.start, f.format, f.status, f.total) for f in carve_hits(Image(len(data), lambda p, n: data[p : p + n]), found, formats, opt))
    path = write(data)
    for split in (10**9, 20_000):
        got = rows_of(Carver(spark, opt, split).files(path))
        # text signatures in clusters that don't look like text aren't hits of an image
        assert [r for r in got if r[1] not in ("html", "xml", "json", "rtf")] == [r for r in plain if r[1] not in ("html", "xml", "json", "rtf")]
    assert len({r[1] for r in got}) > 8


def test_source_clusters_halo_and_pushdown(spark, write):
    data = random.Random(0).randbytes(10_000)
    path = write(data)
    register(spark)
    df = spark.read.format("raw_image").option("clusterSize", 512).option("halo", 7).option("splits", 3).load(path)
    rows = sorted(df.collect(), key=lambda r: r["cluster_id"])
    assert b"".join(bytes(r["bytes"]) for r in rows) == data and rows[-1]["end_offset"] == 10_000
    assert all(bytes(r["halo"]) == data[max(0, r["start_offset"] - 7) : r["start_offset"]] for r in rows)
    some = df.where("start_offset >= 2048 AND start_offset < 3072").collect()
    assert sorted(r["start_offset"] for r in some) == [2048, 2560]
    part = spark.read.format("raw_image").option("clusterSize", 512).option("startOffset", 1024).option("endOffset", 2048).load(path)
    assert part.count() == 2
    assert spark.read.format("raw_image").load(write(b"", "empty.dd")).count() == 0


def test_splits():
    assert splits(1000, 3, 100) == [(0, 300), (300, 600), (600, 1000)]
    assert splits(50, 4, 64) == [(0, 50)] and splits(0, 2, 64) == []


def test_buffered_reads(write):
    b = Buffered(write(bytes(range(62))), 10, 4)
    assert b.read(0, 5) == bytes(range(5)) and b.read(8, 6) == bytes(range(8, 14)) and b.read(5, 3) == bytes(range(5, 8))
    assert b.read(60, 10) == bytes([60, 61]) and b.read(70, 3) == b""


def test_signature_across_clusters_counts_once(spark, write):
    data = bytes(508) + b"\x89PNG\r\n\x1a\n" + bytes(508) + b"SQLite format 3\0" + bytes(3000)
    carver = Carver(spark, CarveOptions(512, formats=("png", "sqlite", "html")))
    hits = carver.hits(write(data))
    assert sorted((r["start_offset"], r["format"]) for r in hits.collect()) == [(508, "png"), (1024, "sqlite")]
    page = write(b"x" * 500 + b"<HTML><Html><html>" + b"y" * 600, "page.dd")
    assert sorted(r["start_offset"] for r in carver.hits(page).collect()) == [500, 506, 512]


def test_files_contents_and_office(spark, write, tmp_path):
    docx, plain = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<document/>")
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", "0" * 500_000)
        z.writestr("ok.txt", "fine")
    data = b"".join(x.getvalue() + bytes(-len(x.getvalue()) % 512) for x in (docx, plain))
    files = Carver(spark, CarveOptions(512, formats=("docx",), workers=2)).files(write(data)).persist()
    rows = sorted(files.collect(), key=lambda r: r["fragments"][0]["start_offset"])
    assert [(r["format"], r["filename"], r["worker_id"]) for r in rows] == [("docx", "carved_w0_0.docx", 0), ("zip", "carved_w1_0.zip", 1)] or rows[1]["worker_id"] in (0, 1)
    body = {}
    for r in contents(files, 100).orderBy("worker_id", "file_id", "seq").collect():
        body[r["filename"]] = body.get(r["filename"], b"") + bytes(r["content"])
    assert body[rows[0]["filename"]] == docx.getvalue() and body[rows[1]["filename"]] == plain.getvalue()
    out = tmp_path / "out"
    assert {r["filename"]: r["size"] for r in write_files(files, str(out)).collect()} == {k: len(v) for k, v in body.items()}
    assert sorted(p.name for p in out.iterdir()) == sorted(body)
    got = {r["member"]: (r["content"], r["error"]) for r in members(files).collect()}
    assert bytes(got["ok.txt"][0]) == b"fine" and got["big.txt"] == (None, "too large")
    wrote = {r["member"]: (r["size"], r["error"]) for r in write_members(files, str(out)).collect()}
    assert wrote == {"ok.txt": (4, None), "big.txt": (None, "too large")}
    assert (out / f"{rows[1]['filename']}_extracted" / "ok.txt").read_bytes() == b"fine"


def test_members_stay_in_their_folder(spark, write, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.txt", "x")
        z.writestr("/abs/./in.txt", "y")
    files = Carver(spark, CarveOptions(512, formats=("zip",))).files(write(out.getvalue() + bytes(600)))
    wrote = {r["member"]: r["error"] for r in write_members(files, str(tmp_path / "m")).collect()}
    assert wrote == {"../evil.txt": "outside", "/abs/./in.txt": None}
    assert [p.name for p in tmp_path.rglob("*.txt")] == ["in.txt"] and (tmp_path / "m" / "carved_w0_0.zip_extracted" / "abs" / "in.txt").read_text() == "y"


def test_reports_merge_and_dashboard(spark, tmp_path):
    frag = lambda s: [{"start_offset": s, "end_offset": s + 10, "size": 10}]
    for w, (name, fragments) in enumerate([("late", frag(500)), ("early", frag(100)), ("<none>", [])]):
        own = {"file_id": 0, "filename": name, "fragments": fragments}
        if w == 1:
            own |= dict(format="xml", status="complete", total_size=1024)
        (tmp_path / f"carve_report_w{w}.json").write_text(json.dumps({"files": [own]} | ({"error": "boom"} if w == 2 else {})))
    (tmp_path / "carve_report_w9.json").write_text("not json")
    target = merge_reports(spark, tmp_path)
    made = json.loads(target.read_text())
    assert [f["filename"] for f in made["files"]] == ["<none>", "early", "late"] and made["error"] == "boom"
    assert not list(tmp_path.glob("carve_report_w*.json"))
    page = tmp_path / "page.html"
    assert dashboard(spark, str(target), str(page))
    text = page.read_text()
    assert "early" in text and "card complete" in text and "&lt;none&gt;" in text and "<none>" not in text
    assert not dashboard(spark, str(tmp_path / "missing.json"), str(page))


def test_worker_reports_are_written_for_all(spark, tmp_path):
    files = spark.createDataFrame([], "worker_id int, file_id int, filename string, format string, status string, fragments array<struct<start_offset:bigint,end_offset:bigint,size:bigint>>, total_size bigint")
    assert [p.name for p in write_worker_reports(files, tmp_path, 2)] == ["carve_report_w0.json", "carve_report_w1.json"]
    assert reports(spark, f"{tmp_path}/carve_report_w*.json").count() == 2
    assert numbered_folder(str(tmp_path), "a/disk.dd").name == "disk.dd.1" and numbered_folder(str(tmp_path), "disk.dd").name == "disk.dd.2"


def test_reports_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    n = 3000
    one = "array(named_struct('start_offset', {0}, 'end_offset', {0} + 1, 'size', 1L))"
    files = spark.range(0, n, 1, 3).selectExpr("cast(id % 3 AS int) AS worker_id", "cast(id div 3 AS int) AS file_id", "concat('f\u00e4\\n,', id) AS filename", "'xml' AS format", "'complete' AS status", f"{one.format(f'(id * 7919) % {n}')} AS fragments", "id AS total_size")
    most, kind = [], type(files)
    collect = kind.collect
    monkeypatch.setattr(kind, "toLocalIterator", lambda *_, **__: pytest.fail("rows go through the driver"))
    monkeypatch.setattr(kind, "collect", lambda df: most.append(len(rows := collect(df))) or rows)
    monkeypatch.setattr(output, "CHUNK", 5000)
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        own = [json.loads(p.read_text()) for p in write_worker_reports(files, tmp_path, 4, "boom")]
        target = merge_reports(spark, tmp_path, "late")
        got = sorted((r["rank"], r["f"]["filename"]) for r in collect(ranked_files(spark, str(target))))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [[f["filename"] for f in r["files"]] for r in own] == [[f"f\u00e4\n,{i}" for i in range(w, n, 3)] for w in range(3)] + [[]] and {r["error"] for r in own} == {"boom"}
    made = json.loads(target.read_text())
    starts = [f["fragments"][0]["start_offset"] for f in made["files"]]
    assert starts == list(range(n)) and made["error"] == "late; boom" and max(most) <= 4
    assert got == [(i, f["filename"]) for i, f in enumerate(made["files"])]


def test_fragments_layout_and_totals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (2, 5, 6)], "f int, start_offset long, end_offset long")
    got = sorted((r["f"], r["fragment_id"], r["start_offset"], r["end_offset"], r["size"]) for r in report.coalesced(df, "f").collect())
    assert got == [(1, 0, 0, 20, 20), (1, 1, 30, 40, 10), (2, 0, 5, 6, 1)]
    arr = report.coalesced(df, "f").groupBy("f").agg(F.sort_array(F.collect_list(F.struct("start_offset", "end_offset", "size"))).alias("fr"))
    [one] = arr.where("f = 1").select(report.layout(F.col("fr")).alias("b"), report.total_size(F.col("fr")).alias("t")).collect()
    assert [(b["left_pct"], b["width_pct"], b["is_last"]) for b in one["b"]] == [(0.0, 50.0, False), (75.0, 25.0, True)] and one["t"] == 30


def test_custom_format_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"extension": ".Abc", "header_hex": "414243", "footer_hex": "5a5a"}, {"extension": "nof", "header_hex": "00ff"}]))
    assert custom_formats(spark, str(path)) == (("abc", b"ABC", b"ZZ"), ("nof", b"\0\xff", b""))
    path.write_text(json.dumps([{"extension": "x", "header_hex": "4g"}]))
    with pytest.raises(ValueError):
        custom_formats(spark, str(path))


def test_byte_functions_on_every_byte(spark):
    raw = bytes(range(256))
    df = spark.createDataFrame([(bytearray(raw),)], "b binary").withColumn("s", binary.latin(F.col("b")))
    r = df.select(
        binary.find(F.col("s"), "A").alias("f"), binary.rfind(F.col("s"), "\xff").alias("r"), binary.rfind(F.col("s"), "zz").alias("n"), F.length(binary.ascii_lower(F.col("s"))).alias("l"), binary.ascii_lower(F.col("s")).alias("low"),
        binary.count_of(F.col("s"), "\x80").alias("c"), binary.big_endian(F.col("b"), 1, 4).alias("be"), binary.little_endian(F.col("b"), 1, 4).alias("le"), binary.octal(F.lit(" 0017 ")).alias("o"), binary.control_count(F.col("s")).alias("k"),
        binary.earliest(binary.find(F.col("s"), "zz"), binary.find(F.col("s"), "C"), binary.find(F.col("s"), "B")).alias("e"),
    ).first()
    assert (r["f"], r["r"], r["n"], r["l"], r["c"], r["be"], r["le"], r["o"], r["k"], r["e"]) == (65, 255, -1, 256, 1, 0x01020304, 0x04030201, 15, 30, 66)
    assert r["low"].encode("latin-1") == raw.lower()


def test_stack_windows_against_a_stack(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<br>", "<i/>", "x", "<!-- <a> -->"]) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    got = {r["id"]: r for r in structure.balance(structure.events(spark.createDataFrame(docs, "id int, t string"), "id", "t", "html"), "id").collect()}
    for i, text in docs:
        from shardlight.functions.markup import Html

        parser = Html()
        events, _, _ = parser.events(text.encode())
        stack, bad = [], False
        for name, closes, _ in events:
            if not closes:
                stack.append(name)
            elif not stack or stack.pop() != name:
                bad = True
                break
        if events:
            assert got[i]["balanced"] == (not bad and not stack) and got[i]["n_tags"] == len(events) and (got[i]["first_bad_pos"] is not None) == bad
        else:
            assert i not in got


def test_continuation_predicate(spark):
    rows = [(["a", "b"], ["b", "a"], True), (["a", "b"], ["b"], True), (["a"], ["b"], False), ([], [], True), (["a"], [], True), ([], ["a"], False)]
    df = spark.createDataFrame([(s, c, w) for s, c, w in rows], "s array<string>, c array<string>, w boolean")
    assert all(r["got"] == r["w"] for r in df.withColumn("got", structure.continues(F.col("s"), F.col("c"))).collect())


def test_scan_is_native(spark, write):
    hits = scan.hits(Carver(spark).clusters(write(bytes(5000))), CarveOptions().active())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "PythonUDF" not in plan and "MapInArrow" not in plan


def test_command_line(spark, write, tmp_path):
    path = write(mixed_image(2, 10))
    assert cli.main(["-i", path, "-o", str(tmp_path / "o"), "-c", "512", "-w", "2", "-d"]) == 0
    folder = tmp_path / "o" / "disk.dd.1"
    report_ = json.loads((folder / "carve_report.json").read_text())
    assert report_["files"] and all((folder / f["filename"]).stat().st_size > 0 for f in report_["files"] if f["status"] == "complete")
    assert (folder / "dashboard.html").exists() and "formats: xml, html" in (folder / "audit_main.log").read_text()
    assert " files complete, " in (folder / "audit_w0.log").read_text() + (folder / "audit_w1.log").read_text()
    assert cli.main(["-i", str(tmp_path / "none"), "-o", str(tmp_path)]) == 1
    assert cli.main(["-i", path, "-o", str(tmp_path), "-c", "0"]) == 1
    assert cli.main(["dashboard", "-i", str(folder / "carve_report.json"), "-o", str(tmp_path / "d.html")]) == 0


def test_odd_headers_and_overlapping_ones_are_found(spark):
    from shardlight.functions.catalogue import linear

    rows = [("a", 0, bytearray(b"xA\\EByA\\EB"), bytearray()), ("b", 0, bytearray(b"XYXYXY.\n$^(["), bytearray()), ("c", 0, bytearray(b"none"), bytearray())]
    clusters = spark.createDataFrame(rows, "image string, start_offset long, bytes binary, halo binary")
    formats = [linear("e", b"A\\EB", b"!"), linear("x", b"XYXY", b"!"), linear("r", b"$^([", b"!"), linear("n", b".\n", b"!")]
    found = {(r["image"], r["start_offset"], r["format"]) for r in scan.hits(clusters, formats).collect()}
    assert found == {("a", 1, "e"), ("a", 6, "e"), ("b", 0, "x"), ("b", 2, "x"), ("b", 8, "r"), ("b", 6, "n")}


def test_failed_run_still_reports_what_was_found(spark, write, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(cli, "write_members", fail)
    assert cli.main(["-i", write(mixed_image(2, 10)), "-o", str(tmp_path / "o"), "-c", "512", "-w", "2"]) == 1
    made = json.loads((tmp_path / "o" / "disk.dd.1" / "carve_report.json").read_text())
    assert made["files"] and made["error"] == "OSError: disk full"
