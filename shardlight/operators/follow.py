"""Following one file through an image: cluster by cluster, over gaps, to its end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.catalogue import Format
from ..functions.walkers import BROKEN, DONE
from ..options import CarveOptions

COMPLETE, PARTIAL, AT_END = "complete", "partial", "incomplete_eof"


@dataclass
class Image:
    """Random access by offset; ``read`` may give fewer bytes only at the end."""

    size: int
    read: Callable[[int, int], bytes]


@dataclass
class Found:
    """``fragments`` are (start, end); ``pieces`` (start, end, zeros) say what to write, zeros standing before the bytes."""

    format: str
    start: int
    status: str
    fragments: list[list[int]]
    pieces: list[list[int]]
    resume: int  # where a sequential carver would go on
    foreign: list[list[int]] = field(default_factory=list)  # broken clusters, which may hold other files

    @property
    def total(self) -> int:
        return sum(e - s for s, e in self.fragments)


def _extend(spans: list[list[int]], start: int, end: int, fresh: bool = False) -> None:
    if spans[-1][1] == start and not fresh:
        spans[-1][1] = end
    else:
        spans.append([start, end, 0][: len(spans[0])])


def _may_continue(fmt: Format, cluster: bytes, dense: bool) -> bool:
    return dense or any(m in cluster for m in fmt.marks)


def _continuation(image: Image, fmt: Format, before: Any, pos: int, opt: CarveOptions) -> tuple[int, bytes, Any, str] | None:
    """The nearest later cluster that legally continues the file: (start, bytes, parser after it, verdict)."""
    for _ in range(max(opt.max_search_clusters, fmt.max_gap_clusters)):
        chunk = image.read(pos, opt.cluster_size) if pos < image.size else b""
        if not chunk:
            return None
        dense = fmt.text and len(chunk) - chunk.count(0) >= opt.cluster_size * opt.text_density
        if (not fmt.text or _may_continue(fmt, chunk, dense)) and (fmt.accepts is None or fmt.accepts(chunk)):
            parser = before.clone()
            parser.after_gap()
            verdict = parser.feed(chunk)
            if verdict != BROKEN and (not fmt.text or parser.tags or dense):
                return pos, chunk, parser, verdict
        pos += len(chunk)
    return None


def follow(image: Image, start: int, fmt: Format, opt: CarveOptions) -> Found | None:
    """The file of this format that starts here, or None where its header proves false."""
    size = opt.cluster_size
    at, pos = start, min((start // size + 1) * size, image.size)
    before, parser = fmt.make(), fmt.make()
    logical = 0  # bytes of the file before the cluster at hand
    out = Found(fmt.extension, start, COMPLETE, [[start, pos]], [[start, pos, 0]], pos)
    verdict = parser.feed(image.read(start, pos - start))
    while True:
        if verdict == DONE:
            keep = parser.advance if fmt.text else parser.size - logical
            out.fragments[-1][1] = out.pieces[-1][1] = at + keep
            out.resume = pos
            return out
        if verdict == BROKEN:
            if not parser.verified:
                return None
            out.foreign.append([at, pos])
            last = out.pieces[-1]
            last[1] = at  # the broken cluster isn't part of what is written, unless zeros keep offsets right
            jump = _continuation(image, fmt, before, pos, opt)
            if jump is None:
                out.status, out.resume = PARTIAL, pos
                out.pieces = [p for p in out.pieces if p[1] > p[0] or p[2]]
                return out
            begin, chunk, parser, verdict = jump
            zeros = 0
            if not fmt.text:
                last[1] = pos
                zeros = begin - pos
            out.pieces = [p for p in out.pieces if p[1] > p[0] or p[2]]
            at, pos = begin, begin + len(chunk)
            logical = _known(before)
            _extend(out.fragments, at, pos, fresh=True)
            out.pieces.append([at, pos, zeros])
            continue
        if pos >= image.size or opt.max_file_bytes is not None and out.total >= opt.max_file_bytes:
            verdict = parser.finish()
            if verdict == DONE:
                logical = _known(parser) - (pos - at)
                continue
            out.status, out.resume = AT_END, pos
            return out
        if (jumpable := parser.idle() // size) > 0:
            # payload that needs no look: whole clusters are taken unread
            end = min(pos + jumpable * size, image.size)
            _extend(out.fragments, pos, end)
            _extend(out.pieces, pos, end)
            at, logical = pos, _known(parser)
            verdict = parser.skip(end - pos)
            pos = end
            continue
        before = parser.clone()
        logical = _known(parser)
        chunk = image.read(pos, size)
        at, pos = pos, pos + len(chunk)
        _extend(out.fragments, at, pos)
        _extend(out.pieces, at, pos)
        verdict = parser.feed(chunk)


def _known(parser: Any) -> int:
    """Bytes of the file that a binary parser has taken so far."""
    view = getattr(parser, "view", None)
    return view.end if view is not None else 0
