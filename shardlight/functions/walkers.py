"""Structure of binary formats, one element at a time.

``step(view, state)`` reads the element at ``state.pos`` and returns the next state, or raises ``Need`` where bytes are missing
and ``Bad`` where the structure is broken. States are immutable, so a snapshot is free and a continuation can be tried on
any cluster. ``state.ok`` says that the header is verified; ``state.end`` is the file's size once it is known.
Positions beyond what was read cost nothing: whoever feeds the walker may skip those clusters.
"""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
FAR = 1 << 62


class Need(Exception):
    """More bytes are wanted."""


class Bad(Exception):
    """The structure is broken."""


class View:
    """The file's bytes from ``base`` on, as far as they are known."""

    __slots__ = ("base", "data")

    def __init__(self, data: bytes = b"", base: int = 0):
        self.data, self.base = data, base

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def get(self, pos: int, n: int) -> bytes:
        if pos + n > self.end:
            raise Need
        return self.data[pos - self.base : pos - self.base + n]

    def rest(self, pos: int) -> bytes:
        return self.data[max(0, pos - self.base) :]

    def find(self, what: bytes, pos: int) -> int:
        at = self.data.find(what, max(0, pos - self.base))
        return at if at < 0 else at + self.base


@dataclass(frozen=True)
class State:
    pos: int = 0
    mem: Any = None
    ok: bool = False
    end: int | None = None


Step = Callable[[View, State], State]


def le(b: bytes, at: int = 0, n: int = 4) -> int:
    return int.from_bytes(b[at : at + n], "little")


def be(b: bytes, at: int = 0, n: int = 4) -> int:
    return int.from_bytes(b[at : at + n], "big")


def must(good: object) -> None:
    if not good:
        raise Bad


def sized(n: int, size_of: Callable[[bytes], int | None]) -> Step:
    """A format whose size is a function of its first ``n`` bytes; None means that it never ends by itself."""

    def step(v: View, s: State) -> State:
        if s.ok:
            raise Need
        size = size_of(v.get(0, n))
        return State(FAR if size is None else size, None, True, size)

    return step


def sqlite_size(b: bytes) -> int:
    page, pages = be(b, 16, 2), be(b, 28)
    page = 65536 if page == 1 else page
    must(page and pages and page * pages <= 10 * GB)
    return page * pages


def bmp_size(b: bytes) -> int:
    size, pixels = le(b, 2), le(b, 10)
    must(not le(b, 6) and 54 <= size <= 100 * MB and 54 <= pixels < size)
    return size


def riff_size(kind: bytes, least: int, most: int) -> Callable[[bytes], int]:
    def size(b: bytes) -> int:
        must(b[8:12] == kind and least <= le(b, 4) <= most)
        return le(b, 4) + 8

    return size


def au_size(b: bytes) -> int | None:
    must(24 <= be(b, 4) <= MB)
    return None if be(b, 8) == 0xFFFFFFFF else be(b, 4) + be(b, 8)


def seven_zip_size(b: bytes) -> int:
    size = 32 + le(b, 12, 8) + le(b, 20, 8)
    must(size <= 10 * GB)
    return size


def wim(v: View, s: State) -> State:
    if s.ok:
        raise Need
    header = le(v.get(8, 4))
    must(120 <= header <= 1024)
    b = v.get(0, header)
    ends = [le(b, at, 7) + le(b, at + 8, 8) for at in (48, 72, 96, 120)[: 4 if header >= 144 else 3]]
    size = max(header, *ends)
    must(size <= 100 * GB)
    return State(size, None, True, size)


def asf(video: bool) -> Step:
    """Windows media; the presence of a video stream tells the two apart."""
    props, stream = bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365"), bytes.fromhex("c0ef19bc4d5bcf11a8fd00805f5c442b")

    def step(v: View, s: State) -> State:
        if s.ok:
            raise Need
        header = le(v.get(16, 8), 0, 8)
        must(30 <= header <= 50 * MB)
        b = v.get(0, header)
        at = b.find(props)
        must(at >= 0 and (stream in b) == video and at + 48 <= len(b))
        size = le(b, at + 40, 8)
        must(header <= size <= 10 * GB)
        return State(size, None, True, size)

    return step


def sqlite_wal(v: View, s: State) -> State:
    if not s.ok:
        b = v.get(0, 32)
        must(1 <= be(b, 8) <= 65536)
        return State(32, (be(b, 8), b[16:24]), True)
    page, salts = s.mem
    if v.get(s.pos, 16)[8:16] != salts:
        return replace(s, end=s.pos)
    v.get(s.pos, 24)
    return replace(s, pos=s.pos + 24 + page)


def png(v: View, s: State) -> State:
    if not s.pos:
        must(v.get(0, 8) == b"\x89PNG\r\n\x1a\n" and v.get(8, 8) == b"\0\0\0\rIHDR")
        return State(33, None, True)
    b = v.get(s.pos, 8)
    must(be(b) <= 100 * MB and b[4:].isalpha())
    after = s.pos + 12 + be(b)
    return replace(s, pos=after, end=after if b[4:] == b"IEND" else None)


def jpg(v: View, s: State) -> State:
    if not s.pos:
        return State(2)
    if s.mem == "scan":  # entropy-coded data up to the next marker
        data, at = v.rest(s.pos), 0
        while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
            if (m := data[at + 1]) >= 0xC0 and m != 0xFF and not 0xD0 <= m <= 0xD7:
                return replace(s, pos=s.pos + at, mem=None)
            at += 1
        keep = len(data) if at < 0 else at
        if not keep:
            raise Need
        return replace(s, pos=s.pos + keep)
    b = v.get(s.pos, 2)
    if s.ok and (b[0] != 0xFF or b[1] < 0xC0 or b[1] == 0xFF):
        return replace(s, pos=s.pos + 1, mem="scan")
    must(b[0] == 0xFF and 0xC0 <= b[1] < 0xFF)
    if b[1] == 0xD9:
        return replace(s, pos=s.pos + 2, end=s.pos + 2)
    if b[1] == 0xD8 or 0xD0 <= b[1] <= 0xD7:
        return replace(s, pos=s.pos + 2)
    size = be(v.get(s.pos, 4), 2, 2)
    if size < 2:
        must(s.ok)
        return replace(s, pos=s.pos + 2, mem="scan")
    return State(s.pos + 2 + size, "scan" if b[1] == 0xDA else None, True)


def gif(v: View, s: State) -> State:
    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    if not s.pos:
        return State(13 + table(v.get(0, 13)[10]), None, True)
    if s.mem == "sub":
        n = v.get(s.pos, 1)[0]
        return replace(s, pos=s.pos + 1 + n, mem="sub" if n else None)
    kind = v.get(s.pos, 1)[0]
    if kind == 0x3B:
        return replace(s, pos=s.pos + 1, end=s.pos + 1)
    if kind == 0x21:
        return replace(s, pos=s.pos + 2, mem="sub")
    if kind == 0x2C:
        return replace(s, pos=s.pos + 11 + table(v.get(s.pos, 10)[9]), mem="sub")
    return replace(s, pos=s.pos + 1)


def tiff(v: View, s: State) -> State:
    """Needs everything from the start; the chain of directories may end behind the pixels."""
    if s.ok:
        raise Need
    num = be if v.get(0, 2) == b"MM" else le
    width = b"\0\1\1\2\4\x08\1\1\2\4\x08\4\x08"  # by type
    at, end, seen = num(v.get(4, 4)), 8, set()
    must(at >= 8)
    while at and at not in seen and at < 50 * MB:
        seen.add(at)
        n = num(v.get(at, 2), 0, 2)
        must(0 < n < 4096)
        b = v.get(at + 2, 12 * n + 4)
        lists: dict[int, list[int]] = {}
        for i in range(0, 12 * n, 12):
            tag, kind, count = num(b, i, 2), num(b, i + 2, 2), num(b, i + 4)
            must(1 <= kind < len(width))
            size = width[kind] * count
            inline = size <= 4
            where = i + 8 if inline else num(b, i + 8)
            if not inline:
                end = max(end, where + size)
            if tag in (273, 279, 324, 325):
                must(size <= 50 * MB and kind in (3, 4))
                raw = b[where : where + size] if inline else v.get(where, size)
                lists[tag] = [num(raw, k, width[kind]) for k in range(0, size, width[kind])]
        for a, c in ((273, 279), (324, 325)):
            end = max([end, *(x + y for x, y in zip(lists.get(a, []), lists.get(c, []), strict=False))])
        end = max(end, at + 2 + 12 * n + 4)
        at = num(b, 12 * n)
    must(8 < end <= 10 * GB)
    return State(end, None, True, end)


def pcx(v: View, s: State) -> State:
    if not s.ok:
        b = v.get(0, 128)
        bits, planes, line = b[3], b[65], le(b, 66, 2)
        w, h = le(b, 8, 2) - le(b, 4, 2) + 1, le(b, 10, 2) - le(b, 6, 2) + 1
        must(b[0] == 10 and b[2] == 1 and bits in (1, 2, 4, 8) and 1 <= planes <= 4 and w > 0 and h > 0 and line and w * h <= 32768**2)
        return State(128, (h * planes * line, b[1] == 5 and bits == 8 and planes == 1), True)
    left, palette = s.mem
    if left <= 0:
        if palette and v.get(s.pos, 1) == b"\x0c":
            return replace(s, pos=s.pos + 769, end=s.pos + 769)
        return replace(s, end=s.pos)
    data, i = v.rest(s.pos), 0
    while left > 0 and i < len(data):
        if data[i] >= 0xC0:
            if i + 1 == len(data):
                break
            left -= data[i] & 0x3F
            i += 2
        else:
            left -= 1
            i += 1
    if not i:
        raise Need
    return replace(s, pos=s.pos + i, mem=(left, palette))


_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_BITS1 = (*range(32, 65, 8), *range(80, 129, 16), *range(160, 257, 32), 320)
_BITS2 = (*range(8, 65, 8), *range(80, 161, 16))


def mp3_frame(b: bytes) -> int:
    """Bytes of a layer III frame, 0 where the header isn't one."""
    version, layer, rate, bits = b[1] >> 3 & 3, b[1] >> 1 & 3, b[2] >> 2 & 3, b[2] >> 4
    if b[0] != 0xFF or b[1] < 0xE0 or version == 1 or layer != 1 or rate == 3 or bits in (0, 15):
        return 0
    kbps = (_BITS1 if version == 3 else _BITS2)[bits - 1]
    return (144 if version == 3 else 72) * kbps * 1000 // _RATES[version][rate] + (b[2] >> 1 & 1)


def mp3(v: View, s: State) -> State:
    frames = s.mem or 0
    if not s.pos and v.get(0, 3) == b"ID3":
        b = v.get(0, 10)
        must(all(x < 128 for x in b[6:]))
        return State(10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]), 0)
    if frames >= 4 and v.get(s.pos, 3) == b"TAG":
        return replace(s, pos=s.pos + 128, end=s.pos + 128)
    n = mp3_frame(v.get(s.pos, 4))
    if n:
        return State(s.pos + n, min(4, frames + 1), frames >= 3)
    must(s.ok)
    return replace(s, end=s.pos)


def boxes(v: View, s: State) -> State:
    """MP4 and MOV."""
    b = v.get(s.pos, 8)
    size = be(b)
    good = re.fullmatch(rb"[A-Za-z0-9 _]{4}", b[4:]) is not None
    if good and size == 1:
        size = be(v.get(s.pos, 16), 8, 8)
        good = size >= 16
    if good and 8 <= size <= 10 * GB:
        return State(s.pos + size, None, True)
    must(s.ok)
    return replace(s, end=s.pos)


def flv(v: View, s: State) -> State:
    if not s.pos:
        header = be(v.get(0, 9), 5)
        must(9 <= header <= 1024 and not be(v.get(header, 4)))
        return State(header + 4, 0, True)
    kind = v.get(s.pos, 1)[0]
    if kind in (8, 9, 18) and (size := be(v.get(s.pos, 11), 1, 3)) <= 50 * MB:
        return replace(s, pos=s.pos + 15 + size, mem=1)
    must(s.mem)
    return replace(s, end=s.pos)


def mpg(v: View, s: State) -> State:
    if s.pos > 500 * MB:
        return replace(s, end=s.pos)
    at = v.find(b"\0\0\1\xb9", s.pos)
    if at >= 0:
        return State(at + 4, None, True, at + 4)
    if v.end - 3 <= s.pos:
        raise Need
    return State(v.end - 3, None, True)


def _vint(v: View, pos: int) -> tuple[int, int]:
    out = 0
    for k in range(10):
        b = v.get(pos + k, 1)[0]
        out |= (b & 127) << 7 * k
        if b < 128:
            return out, pos + k + 1
    raise Bad


def rar(v: View, s: State) -> State:
    if not s.pos:
        b = v.get(0, 7)
        five = b[6] == 1
        must(not five or v.get(7, 1) == b"\0")
        return State(7 + five, (five, 0), True)
    five, blocks = s.mem
    try:
        if five:
            size, at = _vint(v, s.pos + 4)
            must(0 < size <= 2 * MB)
            kind, flag_at = _vint(v, at)
            flags, more = _vint(v, flag_at)
            must(1 <= kind <= 5)
            if flags & 1:
                _, more = _vint(v, more)
            extra = _vint(v, more)[0] if flags & 2 else 0
            after, last = at + size + extra, kind == 5
        else:
            b = v.get(s.pos, 7)
            kind, flags, size = b[2], le(b, 3, 2), le(b, 5, 2)
            must(0x72 <= kind <= 0x7B and size >= 7)
            after, last = s.pos + size + (le(v.get(s.pos, 11), 7) if flags & 0x8000 else 0), kind == 0x7B
    except Bad:
        must(blocks)
        return replace(s, end=s.pos)
    return replace(s, pos=after, mem=(five, 1), end=after if last else None)


def gz(v: View, s: State) -> State:
    inflater = zlib.decompressobj(31) if s.mem is None else s.mem.copy()
    data = v.rest(s.pos)
    if not data:
        raise Need
    got, rest = 0, data
    try:
        while rest and not inflater.eof:
            got += len(inflater.decompress(rest, MB))  # what is inflated isn't kept
            rest = inflater.unconsumed_tail
    except zlib.error as e:
        raise Bad from e
    used = s.pos + len(data) - len(inflater.unused_data)
    return State(used, inflater, s.ok or got > 0, used if inflater.eof else None)


def bzip(v: View, s: State) -> State:
    """A decompressor can't be copied, so it remembers what it was fed and a copy is fed again."""
    if s.mem is None:
        must(v.get(4, 6) in (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90"))
        return State(0, (b"", None), True)
    fed, live = s.mem
    data = v.rest(s.pos)
    if not data:
        raise Need
    try:
        if live is None or live[0] != len(fed):
            live = [0, bz2.BZ2Decompressor()]
            data, start = fed + data, 0
        else:
            start = len(fed)
        machine = live[1]
        machine.decompress(data, MB)
        while not machine.eof and not machine.needs_input:
            machine.decompress(b"", MB)
    except OSError as e:
        live[0] = -1
        raise Bad from e
    whole = data if not start else fed + data
    live[0] = len(whole)
    used = len(whole) - len(machine.unused_data)
    return State(v.end if not machine.eof else v.end - len(machine.unused_data), (whole, live), True, used if machine.eof else None)


def tar(v: View, s: State) -> State:
    b = v.get(s.pos, 512)
    if not any(b):
        if s.mem == "zero":
            return replace(s, pos=s.pos + 512, end=s.pos + 512)
        must(s.ok)
        return replace(s, pos=s.pos + 512, mem="zero")
    must(b[257:262] == b"ustar")
    digits = b[124:136].strip(b"\0 ")
    must(re.fullmatch(rb"[0-7]*", digits))
    size = int(digits or b"0", 8)
    must(size <= 50 * GB)
    return State(s.pos + 512 + -(-size // 512) * 512, None, True)


def zip_(v: View, s: State) -> State:
    if isinstance(s.mem, int):  # sizes follow the data: look for a descriptor that fits
        at = s.pos
        while (at := v.find(b"PK\7\x08", at)) >= 0:
            if le(v.get(at, 16), 8) == at - s.mem:
                return replace(s, pos=at + 16, mem=None)
            at += 1
        if v.end - 3 <= s.pos:
            raise Need
        return replace(s, pos=v.end - 3)
    kind = v.get(s.pos, 4)
    if kind == b"PK\3\4":
        b = v.get(s.pos, 30)
        data = s.pos + 30 + le(b, 26, 2) + le(b, 28, 2)
        if le(b, 6, 2) & 8 and not le(b, 18):
            return State(data, data, True)
        after = data + le(b, 18)
        # a descriptor behind known sizes is optional
        return State(after, "maybe" if le(b, 6, 2) & 8 else None, True)
    if kind == b"PK\7\x08" and s.mem == "maybe":
        return replace(s, pos=s.pos + 16, mem=None)
    if kind == b"PK\1\2":
        b = v.get(s.pos, 46)
        return replace(s, pos=s.pos + 46 + le(b, 28, 2) + le(b, 30, 2) + le(b, 32, 2), mem=None)
    if kind == b"PK\5\6":
        return replace(s, pos=s.pos + 22, end=s.pos + 22)
    if kind == b"PK\6\6":
        return replace(s, pos=s.pos + 12 + le(v.get(s.pos, 12), 4, 8), mem=None)
    if kind == b"PK\6\7":
        return replace(s, pos=s.pos + 20, mem=None)
    raise Bad


_KEYWORD = re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)|%%eof", re.I)
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)\b")
_ENDSTREAM = re.compile(rb"\s{0,2}endstream")


def pdf(v: View, s: State) -> State:
    if not s.pos:
        must(v.get(0, 5).lower() == b"%pdf-")
        return State(5, None, True)
    if s.mem == "exact":
        if not _ENDSTREAM.match(b := v.rest(s.pos)[:11]):
            v.get(s.pos, 11)
            raise Bad
        return replace(s, pos=s.pos + b.find(b"endstream") + 9, mem=None)
    if s.mem == "search":
        at = v.find(b"endstream", s.pos)
        if at >= 0:
            return replace(s, pos=at + 9, mem=None)
        if v.end - 8 <= s.pos:
            raise Need
        return replace(s, pos=v.end - 8)
    data = v.rest(0)
    m = _KEYWORD.search(data, max(0, s.pos - v.base))
    if not m:
        if v.end - 10 <= s.pos:
            raise Need
        return replace(s, pos=v.end - 10)
    end = v.base + m.end()
    if m[0][:1] == b"%":
        return replace(s, pos=end, end=end)
    known = _LENGTH.findall(data, max(0, m.start() - 2 * KB), m.start())
    return replace(s, pos=end + int(known[-1]), mem="exact") if known else replace(s, pos=end, mem="search")


def until(footer: bytes) -> Step:
    """A header, and the first footer after it; without a footer the file runs to the end of the image."""

    def step(v: View, s: State) -> State:
        if not footer:
            return State(FAR, None, True) if not s.ok else _raise_need()
        at = v.find(footer, s.pos)
        if at >= 0:
            return State(at + len(footer), None, True, at + len(footer))
        if v.end - len(footer) + 1 <= s.pos:
            if s.ok:
                raise Need
            return replace(s, ok=True)
        return State(v.end - len(footer) + 1, None, True)

    return step


def _raise_need() -> State:
    raise Need


GOING, DONE, BROKEN = "going", "done", "broken"


class Walker:
    """Feeds a walk with clusters. ``size`` is the file's size when the last verdict was ``DONE``."""

    def __init__(self, step: Step, whole: bool = False):
        self.step, self.whole = step, whole
        self.state, self.view = State(), View()

    def clone(self) -> Walker:
        other = Walker(self.step, self.whole)
        other.state, other.view = self.state, View(self.view.data, self.view.base)
        return other

    @property
    def verified(self) -> bool:
        return self.state.ok

    def idle(self) -> int:
        """Bytes that can be passed over without reading."""
        return 0 if self.whole else max(0, min(self.state.pos, FAR) - self.view.end - 4 * KB)

    def skip(self, n: int) -> str:
        self.view = View(b"", self.view.end + n)
        return self._verdict()

    def _verdict(self) -> str:
        return DONE if self.state.end is not None and self.state.end <= self.view.end else GOING

    @property
    def size(self) -> int:
        return self.state.end or 0

    def feed(self, chunk: bytes) -> str:
        v = self.view
        v.data += chunk
        try:
            while self.state.end is None:
                self.state = self.step(v, self.state)
        except Need:
            pass
        except Bad:
            return BROKEN
        if not self.whole:
            keep = min(len(v.data), max(0, self.state.pos - v.base - 4 * KB))
            v.data, v.base = v.data[keep:], v.base + keep
        return self._verdict()

    def after_gap(self) -> None:
        """A continuation is read afresh where the format was waiting for an exact place."""
        if self.state.mem in ("exact", "search"):
            self.state = replace(self.state, pos=self.view.end, mem=None)

    def finish(self) -> str:
        """At the end of the image: a picture without its optional palette is whole, and so are boxes before fewer than 8 zeros."""
        s = self.state
        if self.step is boxes and s.ok and s.end is None and (tail := self.view.rest(s.pos)) and len(tail) < 8 and not any(tail):
            self.state = replace(s, end=s.pos)
        if isinstance(s.mem, tuple) and s.mem and s.mem[0] == 0 and self.step is pcx and s.end is None:
            self.state = replace(s, end=s.pos)
        return self._verdict()
