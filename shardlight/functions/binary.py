"""Byte functions as columns. Bytes are read as Latin-1 text, one character a byte, so positions are byte positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def latin(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def ascii_lower(s: Column) -> Column:
    """Lowers A to Z and no other byte."""
    return F.translate(s, _UPPER, _LOWER)


def find(s: Column, what: str, start: int = 0) -> Column:
    """First position from 0, or -1."""
    return F.locate(what, s, start + 1) - 1


def rfind(s: Column, what: str) -> Column:
    """Last position of a single character, or -1."""
    return F.when(F.instr(s, what) == 0, -1).otherwise(F.length(s) - F.instr(F.reverse(s), what))


def strip_nul(s: Column) -> Column:
    return F.rtrim(s, F.chr(F.lit(0)))


def count_of(s: Column, what: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))


def big_endian(b: Column, at: int, n: int) -> Column:
    """``at`` from 0; up to 7 bytes."""
    return F.conv(F.hex(F.substring(b, at + 1, n)), 16, 10).cast("long")


def little_endian(b: Column, at: int, n: int) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(b, at + k + 1, 1)) for k in reversed(range(n))]), 16, 10).cast("long")


def octal(s: Column) -> Column:
    return F.conv(F.trim(s), 8, 10).cast("long")


def earliest(*positions: Column) -> Column:
    """The smallest of several ``find`` results that isn't -1, or null."""
    return F.least(*[F.nullif(p, F.lit(-1)) for p in positions]) if len(positions) > 1 else F.nullif(positions[0], F.lit(-1))


def control_count(s: Column) -> Column:
    """Bytes below 32 other than tab, newline and return, and 127."""
    return F.regexp_count(s, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))


def looks_like_text(s: Column) -> Column:
    """Not empty without its closing NULs, and at least 95 in 100 bytes aren't control bytes."""
    own = strip_nul(s)
    return (F.length(own) > 0) & (1 - control_count(own) / F.length(own) >= 0.95)


def header_size(kind: str, b: Column) -> Column:
    """Size of a file that its first bytes give, null where they don't fit the format."""
    page = F.when(big_endian(b, 16, 2) == 1, 65536).otherwise(big_endian(b, 16, 2))
    rules = {
        "sqlite": (page * big_endian(b, 28, 4), lambda n: (n > 0) & (n <= 10 << 30)),
        "bmp": (little_endian(b, 2, 4), lambda n: (little_endian(b, 6, 4) == 0) & n.between(54, 100 << 20) & (little_endian(b, 10, 4) >= 54) & (little_endian(b, 10, 4) < n)),
        "wav": (little_endian(b, 4, 4) + 8, lambda n: (latin(F.substring(b, 9, 4)) == "WAVE") & n.between(20, (1 << 30) + 8)),
        "avi": (little_endian(b, 4, 4) + 8, lambda n: (latin(F.substring(b, 9, 4)) == "AVI ") & n.between(12, (10 << 30) + 8)),
        "au": (big_endian(b, 4, 4) + big_endian(b, 8, 4), lambda n: big_endian(b, 4, 4).between(24, 1 << 20) & (big_endian(b, 8, 4) != 0xFFFFFFFF)),
        "7z": (little_endian(b, 12, 7) + little_endian(b, 20, 7) + 32, lambda n: n <= 10 << 30),
        "wim": (F.greatest(*[little_endian(b, k, 7) + little_endian(b, k + 8, 7) for k in (48, 72, 96)]), lambda n: little_endian(b, 8, 4).between(120, 1024) & (n <= 100 << 30)),
    }
    size, good = rules[kind]
    return F.when(good(size), size)
