"""Walking hits in order of offset, and the tables of files that come of it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import Format
from ..options import CarveOptions
from .follow import COMPLETE, Found, Image, follow

OFFICE = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
SPAN = "struct<start_offset:bigint,end_offset:bigint,size:bigint>"
PIECE = "struct<start_offset:bigint,end_offset:bigint,zeros:bigint>"
FOUND = f"start_offset long, format string, status string, fragments array<{SPAN}>, pieces array<{PIECE}>, total_size long, resume long, blocks array<{SPAN}>"


def _struct(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int64()) for n in names]))


_SPANS, _PIECES = _struct("start_offset", "end_offset", "size"), _struct("start_offset", "end_offset", "zeros")
ARROW = [("start_offset", pa.int64()), ("format", pa.string()), ("status", pa.string()), ("fragments", _SPANS), ("pieces", _PIECES), ("total_size", pa.int64()), ("resume", pa.int64()), ("blocks", _SPANS)]


class Pieces(io.RawIOBase):
    """A recovered file as a stream, read from the image when asked; zeros stand where a gap was."""

    def __init__(self, image: Image, pieces: Iterable[Iterable[int]]):
        self.image, self.parts, self.length, self.pos = image, [], 0, 0
        for start, end, zeros in pieces:
            for s, n in ((None, zeros), (start, end - start)):
                if n:
                    self.parts.append((self.length, s, n))
                    self.length += n

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.pos

    def seek(self, offset: int, whence: int = 0) -> int:
        self.pos = max(0, offset + (0, self.pos, self.length)[whence])
        return self.pos

    def read(self, n: int = -1) -> bytes:
        stop = self.length if n is None or n < 0 else min(self.length, self.pos + n)
        out = []
        for at, start, size in self.parts:
            a, z = max(at, self.pos), min(at + size, stop)
            if a < z:
                out.append(bytes(z - a) if start is None else self.image.read(start + a - at, z - a))
        self.pos = max(self.pos, stop)
        return b"".join(out)


def office_kind(names: Iterable[str]) -> str:
    have = set(names)
    return next((ext for member, ext in OFFICE if member in have), "zip")


def _settled(image: Image, found: Found) -> Found:
    """A whole archive with the main part of an office document is that document."""
    if found.format == "zip" and found.status == COMPLETE:
        try:
            with zipfile.ZipFile(Pieces(image, found.pieces)) as z:
                found.format = office_kind(z.namelist())
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, UnicodeDecodeError):
            pass
    return found


def carve_hits(image: Image, found_at: Iterable[tuple[int, int]], formats: list[Format], opt: CarveOptions, blocked: Iterable[tuple[int, int]] = ()) -> Iterator[Found]:
    """Files of hits (offset, format's index) that come by offset and, at one offset, by preference.

    A hit inside a file that was accepted before is no file of its own; ``blocked`` are the parts of such files from
    elsewhere. Clusters that broke a file, and those that a jump passed over, stay open unless ``opt.compat``.
    """
    taken = sorted(blocked)
    tried = -1
    for at, k in found_at:
        taken = [t for t in taken if t[1] > at]
        if any(s <= at for s, _ in taken) or at == tried:
            continue
        got = follow(image, at, formats[k], opt)
        if got is None:
            if opt.compat:
                tried = at
            continue
        taken += [(s, e) for s, e, _ in blocks(got, opt)]
        yield _settled(image, got)


def blocks(got: Found, opt: CarveOptions) -> list[tuple[int, int, int]]:
    """The parts of the image in which a file leaves no room for another."""
    if opt.compat:
        return [(got.start, got.resume, got.resume - got.start)]
    spans = [(s, e) for s, e in got.fragments]
    for a, z in got.foreign:
        spans = [p for s, e in spans for p in ((s, min(e, a)), (max(s, z), e)) if p[0] < p[1]]
    return [(s, e, e - s) for s, e in [(got.start, got.start + 1), *spans]]


def _lists(rows: list, kind: pa.ListType) -> pa.ListArray:
    """Lists of triples, by column: no Python object for each struct."""
    columns = [*zip(*chain.from_iterable(rows), strict=True)] or [()] * 3
    flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=[*kind.value_type])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), flat)


def found_rows(found: list[Found], opt: CarveOptions) -> list[pa.Array]:
    nested = {
        "fragments": [[(s, e, e - s) for s, e in f.fragments] for f in found],
        "pieces": [f.pieces for f in found],
        "blocks": [blocks(f, opt) for f in found],
    }
    flat = {"start_offset": [f.start for f in found], "format": [f.format for f in found], "status": [f.status for f in found], "total_size": [f.total for f in found], "resume": [f.resume for f in found]}
    return [_lists(nested[n], t) if n in nested else pa.array(flat[n], t) for n, t in ARROW]


def numbered(found: DataFrame, worker: Column) -> DataFrame:
    """Adds the worker, the number within it, and the name that both give."""
    w = found.withColumn("worker_id", worker.cast("int"))
    w = w.withColumn("file_id", F.row_number().over(Window.partitionBy("image", "worker_id").orderBy("start_offset")) - 1)
    part = F.when(F.col("status") != COMPLETE, "_partial").otherwise("")
    return w.withColumn("filename", F.concat(F.lit("carved_w"), "worker_id", F.lit("_"), "file_id", part, F.lit("."), "format"))


def search(data: bytes, formats: list[Format]) -> list[tuple[int, int]]:
    """Hits in a value that is in memory: (offset, format's index), by offset, longest signature and priority."""
    out = []
    low = data.lower() if any(f.text for f in formats) else data
    for k, f in enumerate(formats):
        hay = low if f.text else data
        for sig in f.signatures:
            what, n = sig.lower() if f.text else sig, len(sig)
            at = hay.find(what)
            while at >= 0:
                if at >= f.lead:
                    out.append((at - f.lead, -n, k))
                at = hay.find(what, at + max(1, n))
    return [(a, k) for a, _, k in sorted(out)]


def carve_values(rows: DataFrame, id_column: str, value_column: str, opt: CarveOptions = CarveOptions()) -> DataFrame:
    """Carves each value of a string or binary column as an image of its own: the id as ``image``, then the columns of files.

    Null values have no files. Formats are searched in all of the value; one row is one image, in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = opt.active()
        keys: list[str] = []
        files: list[Found] = []
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not value:
                    continue
                image = Image(len(value), lambda p, n, v=value: v[p : p + n])
                for got in carve_hits(image, search(value, formats), formats, opt):
                    keys.append(key)
                    files.append(got)
                    if len(files) == 1000:
                        yield batch(keys, files)
                        keys, files = [], []
        if files:
            yield batch(keys, files)

    def batch(keys: list[str], files: list[Found]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *found_rows(files, opt)], ["image", *(n for n, _ in ARROW)])

    own = rows.select(F.col(id_column).cast("string").alias("image"), F.col(value_column).cast("binary").alias("value"))
    files = numbered(own.mapInArrow(run, f"image string, {FOUND}"), F.lit(0))
    return files.select("image", "worker_id", "file_id", "filename", "format", "status", "fragments", "total_size", "pieces")
