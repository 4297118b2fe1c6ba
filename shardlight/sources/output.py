"""Reports on disk, worker logs and the dashboard page. Tasks write the rows of reports; the page is streamed, never held together."""

from __future__ import annotations

import html
import json
import logging
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import report
from ..plans.tables import kept, write_in_place
from .configs import ERROR, HEAD, ROW, report_files, reports

COLUMNS = ("file_id", "filename", "format", "status", "fragments", "total_size")
CHUNK = 1 << 20


def numbered_folder(base: str, image: str) -> Path:
    """``base/name.i`` for the first free i from 1, made."""
    i = 1
    while True:
        folder = Path(base) / f"{Path(image).name}.{i}"
        try:
            folder.mkdir(parents=True)
            return folder
        except FileExistsError:
            i += 1


def logger(name: str, file: Path | None = None, console: bool = True) -> logging.Logger:
    """To the console, and to a file if one is given."""
    log = logging.getLogger(f"shardlight.{name}")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(logging.INFO)
    log.propagate = False
    for h in [*([logging.StreamHandler(sys.stderr)] if console else []), *([logging.FileHandler(file)] if file else [])]:
        h.setFormatter(logging.Formatter("[{asctime}] [{name}] [{levelname}] {message}", style="{"))
        log.addHandler(h)
    return log


def _frame(path: Path, size: int, error: str | None) -> None:
    """A report with room for ``size`` bytes of rows."""
    with path.open("wb") as f:
        f.write(HEAD.encode())
        f.seek(size, 1)
        f.write((("\n    " if size else "") + "]" + (f",\n{ERROR}{json.dumps(error)}" if error else "") + "\n}").encode())


def _write_reports(rows: DataFrame | None, targets: dict[int, Path], error: str | None) -> None:
    """Rows (target, j), sorted by target first, into the reports of these numbers. Tasks write them, so the folder has to be a mounted one.

    Sorted rows become chunks, placed by the sizes of the partitions before them; only these sizes share a window.
    """

    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        held: list[bytes] = []
        at = size = 0
        for b in batches:
            for part, target, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (size >= chunk or (part, target) != own):
                    yield batch(own, at, held)
                    held, at, size = [], at + size, 0
                if (part, target) != own:
                    own, at = (part, target), 0
                held.append(f",\n{ROW}{j}".encode())
                size += len(held[-1])
        if held:
            yield batch(own, at, held)

    def batch(own: tuple, at: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["part", "target", "at", "bytes"])

    try:
        sizes: dict[int, int] = {}
        if rows is not None:
            chunks = kept(rows.select(F.spark_partition_id().alias("part"), F.col("target").cast("int").alias("target"), "j").mapInArrow(run, "part int, target int, at long, bytes binary"))
            parts = chunks.groupBy("target", "part").agg(F.sum(F.octet_length("bytes").cast("long")).alias("n"))
            before = Window.partitionBy("target").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
            sizes = {r["target"]: r["n"] - 1 for r in parts.groupBy("target").agg(F.sum("n").alias("n")).collect()}
            if unknown := sizes.keys() - targets.keys():
                raise KeyError(f"no report for {[*unknown]}")
        for k, path in targets.items():
            _frame(path, sizes.get(k, 0), error)
        if sizes:
            # the first row of a report goes without its comma
            start = F.col("base") + F.col("at")
            path = F.create_map(*[x for k, p in targets.items() for x in (F.lit(k), F.lit(str(p.absolute())))])[F.col("target")]
            placed = chunks.join(F.broadcast(parts), ["target", "part"])
            write_in_place(placed.select(path.alias("path"), (len(HEAD) + F.greatest(start - 1, F.lit(0))).alias("start_offset"), F.when(start == 0, F.expr("substring(bytes, 2)")).otherwise(F.col("bytes")).alias("bytes")))
    except BaseException:
        for path in targets.values():
            _frame(path, 0, error)
        raise


def write_worker_reports(files: DataFrame | None, folder: Path, workers: int = 1, error: str | None = None) -> list[Path]:
    """``carve_report_w{n}.json`` for each worker, also for those without files, and with ``error`` where the run failed.

    ``files`` is what was found until then, or None. Reports have no files where writing them fails.
    """
    out = {w: folder / f"carve_report_w{w}.json" for w in range(workers)}
    rows = None if files is None else files.orderBy("worker_id", "file_id").select(F.col("worker_id").alias("target"), F.to_json(F.struct(*COLUMNS)).alias("j"))
    _write_reports(rows, out, error)
    return [*out.values()]


def merge_reports(spark: SparkSession, folder: Path, error: str | None = None) -> Path:
    """One ``carve_report.json`` out of the workers' reports, which go; their errors are kept, each once."""
    parts = sorted(folder.glob("carve_report_w*.json"))
    errors, rows = [error] if error else [], None
    if parts:
        files, faults = report_files(spark, [str(p) for p in parts])
        errors += [r["error"] for r in faults.collect()]
        rows = report.in_order(files).select(F.lit(0).alias("target"), F.to_json(F.struct(*COLUMNS)).alias("j"))
    target = folder / "carve_report.json"
    _write_reports(rows, {0: target}, "; ".join(dict.fromkeys(errors)) or None)
    for p in parts:
        p.unlink()
    return target


def write_worker_logs(files: DataFrame, folder: Path, workers: int = 1) -> list[Path]:
    """``audit_w{n}.log`` for each worker: what it found, by format and status. A line a pair, whatever the number of files."""
    start = report.first_start(F.col("fragments"))
    found = files.groupBy("worker_id", "format", "status").agg(F.count("*").alias("n"), F.sum("total_size").alias("size"), F.min(start).alias("first"), F.max(start).alias("last"))
    lines: dict[int, list[str]] = {w: [] for w in range(workers)}
    for r in found.orderBy("worker_id", "format", "status").collect():
        lines[r["worker_id"]].append(f"{r['n']} {r['format']} files {r['status']}, {r['size']} bytes, starting from {r['first']} to {r['last']}")
    for w, own in lines.items():
        log = logger(f"w{w}", folder / f"audit_w{w}.log", console=False)
        for line in own or ["no files"]:
            log.info("%s", line)
    return [folder / f"audit_w{w}.log" for w in lines]


_STYLE = "body{font:14px sans-serif;margin:2em;background:#f6f7f9;color:#222}.cards{display:flex;gap:1em;margin:1em 0}.card{background:#fff;border-radius:6px;padding:1em 1.5em}.card b{display:block;font-size:1.8em}table{border-collapse:collapse;width:100%;background:#fff}td,th{padding:.5em .8em;border-bottom:1px solid #e4e6ea;text-align:left}.bar{position:relative;height:12px;background:#eceef2;min-width:160px}.bar i{position:absolute;height:12px;background:#5b7fbd}.bar i.last{background:#3a9d6e}.err{background:#fdecea;padding:1em}"
_SCRIPT = "function show(s){document.querySelectorAll('tr[data-status]').forEach(function(r){r.hidden=s!=='all'&&r.dataset.status!==s})}"


def dashboard(spark: SparkSession, report_path: str, target: str, log: logging.Logger | None = None) -> bool:
    """Writes the page; False, with a line in the log, where the report is missing or isn't one. Everything is escaped."""
    log = log or logging.getLogger("shardlight.dashboard")
    if not Path(report_path).is_file():
        log.error("no report at %s", report_path)
        return False
    files, faults = report_files(spark, [report_path])
    if files.isEmpty() and faults.isEmpty() and reports(spark, report_path).isEmpty():
        log.error("%s isn't a report", report_path)
        return False
    files = report.in_order(files)
    counts = report.status_counts(files).first().asDict()
    rows = files.select("filename", "format", "status", F.size("fragments").alias("n"), "total_size", "fragments", report.layout(F.col("fragments")).alias("bars"))
    e = lambda x: html.escape("" if x is None else str(x))
    cards = "".join(f'<div class="card {k}"><b>{counts[k]}</b>{k.replace("_", " ")}</div>' for k in ("files", *report.STATUSES))
    buttons = "".join(f"<button onclick=\"show('{s}')\">{s.replace('_', ' ')}</button> " for s in ("all", *report.STATUSES))
    faults = "".join(f"<p class=err>{e(x['error'])}</p>" for x in faults.collect())
    with open(target, "w") as page:
        page.write(f"<!doctype html><html><head><meta charset=utf-8><title>Recovered files</title><style>{_STYLE}</style><script>{_SCRIPT}</script></head><body><h1>Recovered files</h1>{faults}<div class=cards>{cards}</div>{buttons}<table><tr><th>File<th>Format<th>Status<th>Fragments<th>Bytes<th>Layout</tr>")
        for r in rows.toLocalIterator():
            bars = "".join(
                f'<i{" class=last" if b["is_last"] else ""} style="left:{b["left_pct"]:.2f}%;width:{b["width_pct"]:.2f}%" title="{f["start_offset"]} to {f["end_offset"]}, {f["size"]} bytes"></i>' for f, b in zip(r["fragments"] or [], r["bars"] or [], strict=True)
            )
            status = r["status"] or ""
            page.write(f'<tr data-status="{e(status)}"><td>{e(r["filename"])}</td><td>{e((r["format"] or "").upper())}</td><td>{e(status.replace("_", " ").capitalize())}</td><td>{max(0, r["n"])}</td><td>{r["total_size"] or 0:,}</td><td><div class=bar>{bars}</div></td></tr>')
        page.write("</table></body></html>")
    return True
