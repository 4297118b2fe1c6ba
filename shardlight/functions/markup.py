"""Text formats: a tokeniser that may be cut anywhere, and the stack of what is open.

Each parser takes a cluster at a time. A tag, comment or string that a cluster cuts is carried to the next. A text file is done
when, at the end of a cluster that had tags, nothing is open. The same rules for whole documents, without Python, are in
``operators.structure``.
"""

from __future__ import annotations

import copy
import re

from .walkers import BROKEN, DONE, GOING

_CONTROL = bytes(b for b in range(32) if b not in (9, 10, 13))
_TAG = re.compile(rb"<(/)?([A-Za-z0-9_]+)([^>]*)>")
VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr !doctype".split())
Event = tuple[bytes, bool, int]


class Text:
    """``stack`` is a linked list, (name, below), so a snapshot shares it."""

    verified = True

    def __init__(self) -> None:
        self.stack: tuple | None = None
        self.held = b""
        self.more: tuple | None = None  # clusters after ``held`` that the unfinished tag fills: a linked list, (cluster, below)
        self.inside = b""  # what ends the comment, section or string that is open
        self.tags = 0
        self.done_at: int | None = None

    def clone(self) -> Text:
        return copy.copy(self)

    def after_gap(self) -> None:
        """Nothing to forget: the stack is what a continuation must fit."""

    def idle(self) -> int:
        return 0

    def finish(self) -> str:
        return DONE if self.done_at is not None else GOING

    @property
    def advance(self) -> int:
        """Bytes of the last cluster up to the end of its last tag."""
        return self.done_at or 0

    def unfinished(self, cluster: bytes) -> bool:
        """Whether the tag that is carried goes on past this cluster, whatever its length."""
        return False

    def events(self, data: bytes) -> tuple[list[Event], bytes, bool]:
        """(name, closes, end) of each tag, what is carried on, and whether the bytes are impossible in this format."""
        raise NotImplementedError

    def feed(self, cluster: bytes) -> str:
        cluster = cluster.rstrip(b"\0")
        self.done_at, self.tags = None, 0
        if len(cluster) != len(cluster.translate(None, _CONTROL)):
            return BROKEN
        if self.unfinished(cluster):
            self.more = (cluster, self.more)
            return GOING
        parts = [cluster]
        while self.more:
            parts.append(self.more[0])
            self.more = self.more[1]
        data = b"".join([self.held, *reversed(parts)])
        carried = len(data) - len(cluster)
        found, self.held, bad = self.events(data)
        if bad:
            return BROKEN
        for name, closes, end in found:
            if not closes:
                self.stack = (name, self.stack)
            elif self.stack is None or self.stack[0] != name:
                return BROKEN
            else:
                self.stack = self.stack[1]
            last = end
        self.tags = len(found)
        if found and self.stack is None:
            self.done_at = max(0, last - carried)
            return DONE
        return GOING


class Xml(Text):
    OPENERS = ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"))

    def unfinished(self, cluster: bytes) -> bool:
        # with as many bytes as the longest opener, what is carried is no comment or section
        return not self.inside and len(self.held) >= 9 and b">" not in cluster

    def keep(self, name: bytes, rest: bytes) -> bool:
        return not rest.rstrip().endswith((b"/", b"?"))

    def events(self, data: bytes) -> tuple[list[Event], bytes, bool]:
        out: list[Event] = []
        at = 0
        while True:
            if self.inside:
                end = data.find(self.inside, at)
                if end < 0:
                    return out, data[max(at, len(data) - 2) :], False
                at, self.inside = end + 3, b""
            at = data.find(b"<", at)
            if at < 0:
                return out, b"", False
            opener = next((o for o in self.OPENERS if data.startswith(o[0], at)), None)
            if opener:
                at, self.inside = at + len(opener[0]), opener[1]
                continue
            end = data.find(b">", at)
            if end < 0:
                return out, data[at:], False
            m = _TAG.match(data, at, end + 1)
            if m and self.keep(name := m[2].lower(), m[3]):
                out.append((name, bool(m[1]), end + 1))
            at = end + 1


class Html(Xml):
    OPENERS = ((b"<!--", b"-->"),)

    def keep(self, name: bytes, rest: bytes) -> bool:
        return name not in VOID and not rest.rstrip().endswith(b"/")


_JSON = re.compile(rb'"|[{}\[\]]')
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_LEGAL = b" \t\r\n{}[]:,-+.0123456789truefalsnE"
_PAIR = {b"}": b"{", b"]": b"["}


class Json(Text):
    def events(self, data: bytes) -> tuple[list[Event], bytes, bool]:
        out: list[Event] = []
        at, outside = 0, []
        while True:
            if self.inside:
                m = _STRING_END.match(data, at)
                if not m:
                    odd = (len(data) - at - len(data[at:].rstrip(b"\\"))) % 2
                    return out, data[len(data) - odd :], bool(b"".join(outside).translate(None, _LEGAL))
                at, self.inside = m.end(), b""
            m = _JSON.search(data, at)
            outside.append(data[at : m.start() if m else len(data)])
            if not m:
                return out, b"", bool(b"".join(outside).translate(None, _LEGAL))
            at = m.end()
            if m[0] == b'"':
                self.inside = b'"'
            else:
                out.append((_PAIR.get(m[0], m[0]), m[0] in _PAIR, at))


_RTF = re.compile(rb"\\.|[{}]", re.S)


class Rtf(Text):
    def events(self, data: bytes) -> tuple[list[Event], bytes, bool]:
        found = [m for m in _RTF.finditer(data) if m[0][:1] != b"\\"]
        odd = (len(data) - len(data.rstrip(b"\\"))) % 2
        return [(b"{", m[0] == b"}", m.end()) for m in found], data[len(data) - odd :], False
