"""A whole run: image to clusters, clusters to hits, hits to files, files to contents."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.carve import ARROW, FOUND, Pieces, carve_hits, found_rows, numbered
from ..options import CarveOptions
from ..sources.image import Buffered, located, register, size_of, splits
from .tables import kept

FILE = ("image", "worker_id", "file_id", "filename", "format", "status", "fragments", "total_size", "pieces")


class Carver:
    """Carving one image. Tables are lazy but for ``files``, whose rounds are written to the shared folder.

    The walk runs in parallel over ranges of the image. A file that runs past its range blocks what lies in it; ranges that this
    concerns are walked again until nothing changes, so the result is that of one cursor over the whole image,
    whatever the number of ranges.
    """

    def __init__(self, spark: SparkSession, options: CarveOptions = CarveOptions(), split_bytes: int = 256 << 20):
        self.spark, self.options, self.split_bytes = spark, options, split_bytes
        register(spark)

    def clusters(self, path: str, **options: object) -> DataFrame:
        reader = self.spark.read.format("raw_image").option("clusterSize", self.options.cluster_size).option("halo", scan.halo_of(self.options.active()))
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(path)

    def hits(self, path: str, start: int = 0, end: int | None = None) -> DataFrame:
        bounds = {"startOffset": start} | ({"endOffset": end} if end is not None else {})
        found = scan.hits(self.clusters(path, **bounds), self.options.active())
        return scan.first_hits(found) if self.options.compat else found

    def files(self, path: str, start: int = 0, end: int | None = None) -> DataFrame:
        """(image, worker_id, file_id, filename, format, status, fragments, total_size, pieces)."""
        opt, size = self.options, size_of(path)
        ranges = splits(size, max(1, -(-(size - start) // self.split_bytes)), opt.cluster_size, start, end)
        step = ranges[0][1] - ranges[0][0] if ranges else 1
        hit = kept(self.hits(path, start, end).withColumn("split", F.least(F.lit(max(0, len(ranges) - 1)), F.floor((F.col("start_offset") - start) / step)).cast("int")))
        rounds: list[DataFrame] = []
        current: dict[int, int] = {}
        blocked: dict[int, list[tuple[int, int]]] = {}
        todo = list(range(len(ranges)))
        while todo:
            own = hit.join(F.broadcast(self._pairs([(k, 0) for k in todo]).select("split")), "split", "left_semi") if len(todo) < len(ranges) else hit
            rounds.append(kept(self._walked(own, path, {k: blocked.get(k, []) for k in todo})))
            current |= {k: len(rounds) - 1 for k in todo}
            now = self._crossing(self._latest(rounds, current), ranges)
            todo = [k for k in range(len(ranges)) if now.get(k, []) != blocked.get(k, [])]
            blocked = now
        if not rounds:
            rounds = [self.spark.createDataFrame([], f"image string, split int, {FOUND}")]
        workers = splits(size, opt.workers, opt.cluster_size, start, end)
        worker = F.lit(0)
        for k, (a, _) in enumerate(workers):
            worker = F.when(F.col("start_offset") >= a, k).otherwise(worker)
        return numbered(self._latest(rounds, current), worker).select(*FILE)

    def _pairs(self, pairs: list[tuple[int, int]]) -> DataFrame:
        """A table with a row a range at most: two numbers for each 256 MB of image."""
        return self.spark.createDataFrame(pairs, "split int, round int")

    def _latest(self, rounds: list[DataFrame], current: dict[int, int]) -> DataFrame:
        if len(rounds) == 1:
            return rounds[0]
        every = reduce(DataFrame.unionByName, [t.withColumn("round", F.lit(i)) for i, t in enumerate(rounds)])
        return every.join(F.broadcast(self._pairs(list(current.items()))), ["split", "round"], "left_semi").drop("round")

    def _crossing(self, found: DataFrame, ranges: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
        """Parts of files that lie in ranges after the one where they begin. Few: a range has one last file."""
        if not ranges:
            return {}
        start, step, last = ranges[0][0], ranges[0][1] - ranges[0][0], len(ranges) - 1
        upto = F.when(F.col("split") < last, (F.col("split") + 1).cast("long") * step + start).otherwise(F.lit(ranges[last][1]).cast("long"))
        over = found.select("split", F.explode("blocks").alias("b"), upto.alias("upto")).where("b.end_offset > upto").select("b.start_offset", "b.end_offset", "split")
        out: dict[int, list[tuple[int, int]]] = {}
        for s, e, own in sorted(tuple(r) for r in over.toLocalIterator()):
            for k in range(max(own + 1, min(last, (s - start) // step)), min(last, (e - 1 - start) // step) + 1):
                a, z = ranges[k]
                if max(s, a) < min(e, z):
                    out.setdefault(k, []).append((max(s, a), min(e, z)))
        return out

    def _walked(self, hit: DataFrame, path: str, blocked: dict[int, list[tuple[int, int]]]) -> DataFrame:
        opt = self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            formats = opt.active()
            source = Buffered(path)
            image = source.image()

            def of_split(first: tuple[int, int, int], rest: Iterator[tuple[int, int, int]], ahead: list) -> Iterator[tuple[int, int]]:
                yield first[1:]
                for x in rest:
                    if x[0] != first[0]:
                        ahead.append(x)
                        return
                    yield x[1:]

            rows = ((s, a, k) for b in batches for s, a, k in zip(*(b.column(c).to_pylist() for c in ("split", "start_offset", "priority")), strict=True))
            ahead = list(x for x in [next(rows, None)] if x)
            while ahead:
                first = ahead.pop()
                own = of_split(first, rows, ahead)
                out: list = []
                for f in carve_hits(image, own, formats, opt, blocked.get(first[0], ())):
                    out.append(f)
                    if len(out) == 1000:
                        yield batch(out, first[0])
                        out = []
                for _ in own:
                    pass
                if out:
                    yield batch(out, first[0])
            source.close()

        def batch(found: list, split: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([split] * len(found), pa.int32()), *found_rows(found, opt)], ["image", "split", *(n for n, _ in ARROW)])

        order = hit.repartition(max(1, len(blocked)), "split").sortWithinPartitions("split", "start_offset", F.desc("sig_len"), "priority")
        return order.select("split", "start_offset", "priority").mapInArrow(run, f"image string, split int, {FOUND}")


def _images(b: pa.RecordBatch, open_: dict[str, Buffered]) -> Iterator[tuple[dict, Pieces]]:
    for row in b.to_pylist():
        if row["image"] not in open_:
            open_[row["image"]] = Buffered(row["image"])
        yield row, Pieces(open_[row["image"]].image(), [(p["start_offset"], p["end_offset"], p["zeros"]) for p in row["pieces"]])


CONTENT = "image string, worker_id int, file_id int, filename string, seq long, offset long, content binary"


def contents(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The bytes of each file in rows of at most ``block``, so that no row grows with a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Buffered] = {}
        for b in batches:
            for row, f in _images(b, open_):
                for seq, offset in enumerate(range(0, f.length, block)):
                    f.seek(offset)
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("image", "worker_id", "file_id", "filename")} | {"seq": seq, "offset": offset, "content": f.read(block)}], _CONTENT)

    return files.select("image", "worker_id", "file_id", "filename", "pieces").mapInArrow(run, CONTENT)


_CONTENT = pa.schema([("image", pa.string()), ("worker_id", pa.int32()), ("file_id", pa.int32()), ("filename", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("content", pa.binary())])


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes every file below ``folder`` when an action runs: (filename, size). A task that is run again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = located(folder)
        open_: dict[str, Buffered] = {}
        for b in batches:
            for row, f in _images(b, open_):
                # written under a name of its own, then renamed: a lost task leaves no half file
                draft = f"{base}/.{row['filename']}.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as out:
                    while part := f.read(4 << 20):
                        out.write(part)
                where.move(draft, f"{base}/{row['filename']}")
                yield pa.RecordBatch.from_pydict({"filename": [row["filename"]], "size": pa.array([f.length], pa.int64())})

    where, base = located(folder)
    where.create_dir(base, recursive=True)
    return files.select("image", "filename", "pieces").mapInArrow(run, "filename string, size long")


def members(files: DataFrame, most_bytes: int = 64 << 20, most_ratio: int = 200) -> DataFrame:
    """Members of complete plain archives: (image, filename, member, content, error). Expansion is bounded in size and ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Buffered] = {}
        schema = pa.schema([("image", pa.string()), ("filename", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for b in batches:
            for row, f in _images(b, open_):
                key = {"image": row["image"], "filename": row["filename"]}
                try:
                    archive = zipfile.ZipFile(f)
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    yield pa.RecordBatch.from_pylist([key | {"member": None, "content": None, "error": type(e).__name__}], schema)
                    continue
                for info in archive.infolist():
                    if info.is_dir():
                        continue
                    limit = min(most_bytes, most_ratio * max(1, info.compress_size) + 1024)
                    content, error = None, None
                    try:
                        with archive.open(info) as m:
                            content = m.read(limit + 1)
                        if len(content) > limit:
                            content, error = None, "too large"
                    except Exception as e:  # noqa: BLE001 - hostile input; the kind of error is the result
                        error = type(e).__name__
                    yield pa.RecordBatch.from_pylist([key | {"member": info.filename, "content": content, "error": error}], schema)

    chosen = files.where("format = 'zip' AND status = 'complete'").select("image", "filename", "pieces")
    return chosen.mapInArrow(run, "image string, filename string, member string, content binary, error string")


def write_members(files: DataFrame, folder: str, most_bytes: int = 64 << 20, most_ratio: int = 200) -> DataFrame:
    """Writes the members of plain archives below ``folder`` when an action runs: (filename, member, size, error).

    A member that is too large, unreadable, or would leave its archive's folder isn't written, and says so in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = located(folder)
        for b in batches:
            for row in b.to_pylist():
                member, content, error = row["member"], row["content"], row["error"]
                parts = [p for p in (member or "").replace("\\", "/").split("/") if p not in ("", ".")]
                if content is not None and (not parts or ".." in parts):
                    error = "outside"
                elif content is not None:
                    target = "/".join([base, f"{row['filename']}_extracted", *parts])
                    where.create_dir(target.rpartition("/")[0], recursive=True)
                    draft = f"{target}.{uuid.uuid4().hex}"
                    with where.open_output_stream(draft) as out:
                        out.write(content)
                    where.move(draft, target)
                size = len(content) if content is not None and error is None else None
                yield pa.RecordBatch.from_pylist([{"filename": row["filename"], "member": member, "size": size, "error": error}], schema)

    schema = pa.schema([("filename", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("error", pa.string())])
    rows = members(files, most_bytes, most_ratio).select("filename", "member", "content", "error")
    return rows.mapInArrow(run, "filename string, member string, size long, error string")
