"""Command line: ``python -m shardlight.cli -i disk.dd -o out`` carves, ``... dashboard -i report.json -o page.html`` renders."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.catalogue import FORMATS
from .options import CarveOptions
from .plans.carver import Carver, write_files, write_members
from .plans.tables import kept
from .sources.configs import custom_formats
from .sources.image import size_of
from .sources.output import dashboard, logger, merge_reports, numbered_folder, write_worker_logs, write_worker_reports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shardlight", description="Recovers files from raw images.")
    p.add_argument("-i", "--image", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--formats", help=f"comma-separated, of {', '.join(FORMATS)}")
    p.add_argument("-c", "--cluster-size", type=int, default=4096)
    p.add_argument("-w", "--workers", type=int, default=1)
    p.add_argument("--config", help="JSON array of custom formats")
    p.add_argument("--max-search", type=int, default=1000)
    p.add_argument("--text-density", type=float, default=0.8)
    p.add_argument("-d", "--dashboard", action="store_true")
    p.add_argument("--profile", action="store_true", help="Python profiles of the tasks, in the output folder")
    p.add_argument("--compat", action="store_true", help="the cursor rules of a sequential carver")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("shardlight").getOrCreate()
    if argv[:1] == ["dashboard"]:
        p = argparse.ArgumentParser(prog="shardlight dashboard")
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        a = p.parse_args(argv[1:])
        return 0 if dashboard(spark, a.input, a.output, logger("dashboard")) else 1
    a = parser().parse_args(argv)
    log = logger("main")
    try:
        size_of(a.image)
        custom = custom_formats(spark, a.config) if a.config else ()
        opt = CarveOptions(a.cluster_size, a.workers, tuple(a.formats.split(",")) if a.formats else None, custom, a.max_search, a.text_density, a.compat)
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1
    folder = numbered_folder(a.output, a.image)
    log = logger("main", folder / "audit_main.log")
    for name in opt.unknown():
        log.warning("unknown format %s is left out", name)
    if custom:
        log.info("%d custom formats", len(custom))
    if a.profile:
        spark.conf.set("spark.sql.pyspark.udf.profiler", "perf")
    log.info("image of %d bytes in clusters of %d, %d workers", size_of(a.image), opt.cluster_size, opt.workers)
    log.info("formats: %s", ", ".join(f.name for f in opt.active()))
    code, error, files = 0, None, None
    try:
        files = kept(Carver(spark, opt).files(a.image))
        written = write_files(files, str(folder)).count()
        extracted = kept(write_members(files, str(folder)))
        for m in extracted.where("error IS NOT NULL").toLocalIterator():
            log.warning("%s: member %s isn't extracted: %s", m["filename"], m["member"], m["error"])
        log.info("%d files, %d members of archives", written, extracted.where("error IS NULL").count())
    except KeyboardInterrupt:
        code, error = 130, "interrupted"
    except Exception as e:  # noqa: BLE001 - the report says what went wrong, and the code is 1
        code, error = 1, f"{type(e).__name__}: {e}"[:2000]
    if error:
        log.error("%s", error)
    # with what was found until then, also after a failure
    write_worker_reports(files, folder, opt.workers, error)
    if files is not None:
        write_worker_logs(files, folder, opt.workers)
    target = merge_reports(spark, folder)
    if a.profile:
        spark.profile.dump(str(folder / "profile"))
    if a.dashboard:
        dashboard(spark, str(target), str(Path(folder) / "dashboard.html"), log)
    return code


if __name__ == "__main__":
    sys.exit(main())
