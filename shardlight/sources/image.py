"""Raw images: as a table of clusters through a Python data source, and as random access for the walk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.follow import Image

BUFFER, LOOKBEHIND = 16 << 20, 4 << 20
SCHEMA = "image string, cluster_id long, start_offset long, end_offset long, bytes binary, halo binary"
_ARROW = pa.schema([("image", pa.string()), ("cluster_id", pa.int64()), ("start_offset", pa.int64()), ("end_offset", pa.int64()), ("bytes", pa.binary()), ("halo", pa.binary())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is local, or on a mount that all executors share."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int:
    where, name = located(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


class Buffered:
    """One window of the image in memory; it keeps ``lookbehind`` bytes before the place that is read."""

    def __init__(self, path: str, buffer: int = BUFFER, lookbehind: int = LOOKBEHIND):
        where, name = located(path)
        self.file, self.buffer, self.lookbehind = where.open_input_file(name), buffer, lookbehind
        self.size = self.file.size()
        self.base, self.window = 0, memoryview(b"")

    def read(self, pos: int, n: int) -> bytes:
        n = max(0, min(n, self.size - pos))
        if not self.base <= pos <= pos + n <= self.base + len(self.window):
            self.base = max(0, pos - self.lookbehind)
            self.window = memoryview(self.file.read_at(max(self.buffer, pos - self.base + n), self.base))
        return bytes(self.window[pos - self.base : pos - self.base + n])

    def image(self) -> Image:
        return Image(self.size, self.read)

    def close(self) -> None:
        self.file.close()


def splits(size: int, workers: int, cluster: int, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Ranges on cluster boundaries, the last with the tail; an image too small for all gives fewer, never empty ones."""
    end = size if end is None else min(end, size)
    step = max(cluster, (end - start) // workers // cluster * cluster)
    edges = [*range(start, end, step)][:workers]
    return [(a, edges[i + 1] if i + 1 < len(edges) else end) for i, a in enumerate(edges)]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.cluster = int(options.get("clustersize", 4096))
        self.halo = int(options.get("halo", 15))
        self.start = int(options.get("startoffset", 0))
        self.end = int(options["endoffset"]) if "endoffset" in options else None
        self.parts = int(options["splits"]) if "splits" in options else None
        self.least, self.most = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``start_offset`` choose what is read; all filters are checked again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("start_offset",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(self.least, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = min(f.value + 1, self.most) if self.most is not None else f.value + 1
            yield f

    def partitions(self) -> list[Range]:
        size = size_of(self.path)
        start = max(self.start, self.least // self.cluster * self.cluster)
        end = min(x for x in (size, self.end, self.most) if x is not None)
        parts = self.parts or max(1, -(-(end - start) // (64 << 20)))
        return [Range(self.path, a, z) for a, z in splits(size, parts, self.cluster, start, end)] or [Range(self.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        source, c = Buffered(part.path, lookbehind=self.halo), self.cluster
        block = max(1, (4 << 20) // c) * c
        for at in range(part.start, part.end, block):
            lead = min(at, self.halo)
            raw = source.read(at - lead, lead + min(block, -(-(part.end - at) // c) * c))
            starts = range(lead, len(raw), c)
            cols = [
                pa.array([part.path] * len(starts)), pa.array([(at + s - lead) // c for s in starts], pa.int64()), pa.array([at + s - lead for s in starts], pa.int64()),
                pa.array([at - lead + min(s + c, len(raw)) for s in starts], pa.int64()), pa.array([raw[s : s + c] for s in starts], pa.binary()), pa.array([raw[max(0, s - self.halo) : s] for s in starts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)
        source.close()


class ImageSource(DataSource):
    """``spark.read.format("raw_image")``; options clusterSize, halo, startOffset, endOffset, splits."""

    @classmethod
    def name(cls) -> str:
        return "raw_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ImageReader:
        return ImageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
