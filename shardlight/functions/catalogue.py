"""The formats: signatures, structure, and what a gap jump needs to know of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from . import markup
from . import walkers as w


@dataclass(frozen=True)
class Format:
    """``make`` gives a fresh parser; ``lead`` is how far the file begins before its signature.

    ``accepts``, if given, is asked whether a cluster may continue a broken file. Formats of one's own are made the
    same way and go into ``CarveOptions.extra``.
    """

    name: str
    signatures: tuple[bytes, ...]
    make: Callable[[], Any]
    text: bool = False
    lead: int = 0
    max_gap_clusters: int = 0
    accepts: Callable[[bytes], bool] | None = None
    #: Bytes of which a cluster must hold one, or be dense text, to continue a text file.
    marks: bytes = b""

    @property
    def extension(self) -> str:
        return self.name


def _binary(name: str, *signatures: bytes, step: w.Step, whole: bool = False, **more: Any) -> Format:
    return Format(name, signatures, lambda: w.Walker(step, whole), **more)


_FOREIGN = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"PK\3\4", b"PK\1\2", b"Rar!", b"7z\xbc\xaf", b"\x1f\x8b\x08", b"BZh", b"RIFF", b"ID3", b"SQLi", b"MSWI", b"\x30\x26\xb2\x75", b"FLV\1", b"<?xm", b"{\\rt")
_FTYP = tuple(bytes([0, 0, 0, n]) + b"ftyp" for n in (0x10, 0x14, 0x18, 0x1C, 0x20, 0x24))
_ASF = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")


def _no_foreign_start(cluster: bytes) -> bool:
    return not cluster.startswith(_FOREIGN)


def linear(extension: str, header: bytes, footer: bytes) -> Format:
    """A format that is given by its first and last bytes alone."""
    if not header:
        raise ValueError(f"{extension}: a format needs a header")
    return _binary(extension, header, step=w.until(footer))


_ALL = (
    Format("xml", (b"<?xml", b"<html"), markup.Xml, True, marks=b"<"),
    Format("html", (b"<html", b"<!doctype html"), markup.Html, True, marks=b"<"),
    Format("json", (b'{"', b"[{"), markup.Json, True, marks=b"{}[]\\"),
    Format("rtf", (b"{\\rtf1",), markup.Rtf, True, marks=b"{}[]\\"),
    _binary("pdf", b"%PDF-", b"%pdf-", step=w.pdf, max_gap_clusters=10_000, accepts=_no_foreign_start),
    _binary("zip", b"PK\3\4", step=w.zip_),
    _binary("sqlite", b"SQLite format 3\0", step=w.sized(100, w.sqlite_size)),
    _binary("sqlitewal", b"\x37\x7f\x06\x82", b"\x37\x7f\x06\x83", step=w.sqlite_wal),
    _binary("jpg", b"\xff\xd8", step=w.jpg),
    _binary("png", b"\x89PNG\r\n\x1a\n", step=w.png),
    _binary("gif", b"GIF87a", b"GIF89a", step=w.gif),
    _binary("bmp", b"BM", step=w.sized(14, w.bmp_size)),
    _binary("tiff", b"II*\0", b"MM\0*", step=w.tiff, whole=True),
    _binary("pcx", *(bytes([10, n, 1]) for n in (0, 2, 3, 4, 5)), step=w.pcx),
    _binary("wav", b"RIFF", step=w.sized(12, w.riff_size(b"WAVE", 12, w.GB))),
    _binary("mp3", b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xf2", b"\xff\xfa", step=w.mp3),
    _binary("au", b".snd", step=w.sized(12, w.au_size)),
    _binary("wma", _ASF, step=w.asf(False)),
    _binary("wmv", _ASF, step=w.asf(True)),
    _binary("avi", b"RIFF", step=w.sized(12, w.riff_size(b"AVI ", 4, 10 * w.GB))),
    _binary("mp4", *_FTYP, step=w.boxes),
    _binary("mov", *_FTYP, b"\0\0\0\x08free", b"\0\0\0\x08wide", step=w.boxes),
    _binary("flv", b"FLV\1", step=w.flv),
    _binary("mpg", b"\0\0\1\xba", b"\0\0\1\xb3", step=w.mpg),
    _binary("7z", b"7z\xbc\xaf\x27\x1c", step=w.sized(32, w.seven_zip_size)),
    _binary("rar", b"Rar!\x1a\7\0", b"Rar!\x1a\7\1\0", step=w.rar),
    _binary("gz", b"\x1f\x8b\x08", step=w.gz),
    _binary("bz2", *(b"BZh%d" % n for n in range(1, 10)), step=w.bzip),
    _binary("tar", b"ustar", step=w.tar, lead=257),
    _binary("wim", b"MSWIM\0\0\0", step=w.wim),
)
FORMATS: dict[str, Format] = {f.name: f for f in _ALL}
FORMATS |= {"docx": FORMATS["zip"], "xlsx": FORMATS["zip"], "pptx": FORMATS["zip"], "tif": FORMATS["tiff"]}
