"""Structure of single files: every sample whole, cut anywhere, and broken."""

import random
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardlight.functions import markup
from shardlight.functions.catalogue import FORMATS, linear
from shardlight.functions.walkers import BROKEN, DONE, GOING
from shardlight.operators.carve import Pieces, carve_hits, search
from shardlight.operators.follow import Image, follow
from shardlight.options import CarveOptions
from shardlight.queries import samples


def image_of(data):
    return Image(len(data), lambda p, n: data[p : p + n])


def carved(data, cluster=64, **more):
    opt = CarveOptions(cluster, **more)
    formats = opt.active()
    found = list(carve_hits(image_of(data), search(data, formats), formats, opt))
    return [(f, Pieces(image_of(data), f.pieces).read()) for f in found]


def fed(name, *chunks):
    parser = FORMATS[name].make()
    return [parser.feed(c) for c in chunks], parser


@pytest.mark.parametrize("cluster", [64, 512, 4096])
@pytest.mark.parametrize("name", [n for n, _ in samples()])
def test_sample_is_whole_at_any_cluster_size(name, cluster):
    data = dict(samples())[name]
    found = carved(b"junk!" * 13 + data + bytes(2 * cluster), cluster)
    own = [(f, body) for f, body in found if f.start == 65]
    assert [(f.format, f.status, body) for f, body in own] == [(name, "complete", data)]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(n for n, _ in samples() if n != "tiff")), st.lists(st.integers(1, 400), min_size=1, max_size=6))
def test_verdict_does_not_depend_on_how_the_file_is_cut(name, sizes):
    data = dict(samples())[name] + bytes(1100)
    parser, at, k = FORMATS[name].make(), 0, 0
    verdict = GOING
    while verdict == GOING and at < len(data):
        n = sizes[k % len(sizes)]
        verdict = parser.feed(data[at : at + n])
        at, k = at + n, k + 1
    assert verdict == DONE and parser.size == len(data) - 1100


@pytest.mark.parametrize("name", [n for n, _ in samples()])
def test_cut_image_is_incomplete_and_never_longer(name):
    data = dict(samples())[name]
    for f, body in carved(data[: len(data) * 2 // 3]):
        assert f.status in ("incomplete_eof", "complete", "partial") and len(body) <= len(data)


@pytest.mark.parametrize("name", [n for n, _ in samples()])
def test_noise_after_the_signature_does_no_harm(name):
    for seed in range(20):
        rng = random.Random(seed)
        sig = FORMATS[name].signatures[0]
        follow(image_of(bytes(FORMATS[name].lead) + sig + rng.randbytes(3000)), 0, FORMATS[name], CarveOptions(64, max_search_clusters=5))


@pytest.mark.parametrize(
    "name, head",
    [
        ("jpg", b"\xff\xd8\x41\x41\x41\x41"), ("jpg", b"\xff\xd8\xff\x01\0\0"), ("sqlite", b"SQLite format 3\0" + bytes(84)), ("tar", b"x" * 600), ("mp3", b"\xff\xfb\x90\0" + bytes(2000)),
        ("png", b"\x89PNG\r\n\x1a\n" + bytes(8)), ("gz", b"\x1f\x8b\x08" + b"\xff" * 100), ("bz2", b"BZh9" + bytes(40)), ("mp4", b"\0\0\0\x10ft\xffp" + bytes(40)), ("rar", b"Rar!\x1a\7\0" + bytes(40)), ("pcx", b"\x0a\x05\x01\x03" + bytes(200)),
    ],
)
def test_false_headers(name, head):
    verdicts, parser = fed(name, head)
    assert verdicts == [BROKEN] and (not parser.verified or name == "rar")


def test_pdf_streams():
    head = b"%pdf-1.4\n<< /Length 100 >>\nstream\n"
    assert fed("pdf", head + b"A" * 100 + b"\nendstream\n%%EOF")[0] == [DONE]
    assert fed("pdf", head + b"A" * 10, b"A" * 90 + b"\nendstream\n%%eof")[0] == [GOING, DONE]
    assert fed("pdf", head + b"A" * 120)[0] == [BROKEN]
    assert fed("pdf", b"%PDF-1.4\n<< /Length 5 0 R >>\nstream\nabc\nendstream %%EOF")[0] == [DONE]


def test_zip_descriptor_and_split_header():
    body = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 20, 8, 0, 0, 0, 0, 0, 0, 1, 0) + b"n" + b"hello"
    rest = b"PK\7\x08" + struct.pack("<III", 0, 5, 5) + b"PK\5\6" + bytes(18)
    assert fed("zip", body + rest)[0] == [DONE]
    assert fed("zip", body[:3], body[3:] + rest[:6], rest[6:])[0] == [GOING, GOING, DONE]
    assert fed("zip", body + b"PK\7\x08" + struct.pack("<III", 0, 5, 5) + b"random garbage")[0] == [BROKEN]


def test_mp4_tail_of_zeros_and_sqlite_wal_salts():
    # fewer than 8 zeros may be the head of a next box; they are a tail only where the image ends
    verdicts, parser = fed("mp4", struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + bytes(3))
    assert verdicts == [GOING] and parser.finish() == DONE and parser.size == 16
    assert fed("mp4", struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + bytes(8))[1].size == 16
    wal = bytes.fromhex("377f0683") + bytes(4) + struct.pack(">I", 1024) + bytes(4) + b"saltsalt" + bytes(8)
    assert fed("sqlitewal", wal + bytes(8) + b"otherone" + bytes(8))[1].size == 32


def test_jpeg_thumbnail_does_not_end_the_picture():
    data = dict(samples())["jpg"]
    assert data.index(b"\xff\xd9") < len(data) - 2 and fed("jpg", data)[1].size == len(data)


def test_payload_is_skipped_unread():
    size = 50_000_000
    head = b"BM" + struct.pack("<III", size, 0, 54)
    read = []

    def get(p, n):
        read.append(n)
        return (head + bytes(max(0, p + n - len(head))))[p : p + n] if p < len(head) else bytes(n)

    f = follow(Image(size + 10_000, get), 0, FORMATS["bmp"], CarveOptions())
    assert (f.status, f.total, len(f.fragments)) == ("complete", size, 1) and sum(read) < 100_000


# text


def names(kind, *chunks):
    parser, out = kind(), []
    for c in chunks:
        found, parser.held, bad = parser.events(parser.held + c)
        assert not bad
        out += [("/" if closes else "") + name.decode() for name, closes, _ in found]
    return out


def test_html_and_xml_tags():
    assert names(markup.Html, b"<html><body><img src=x><br/><p>a</p></body></html>") == ["html", "body", "p", "/p", "/body", "/html"]
    assert names(markup.Html, b"<p><!-- <b> </i> --></p>") == ["p", "/p"]
    assert names(markup.Html, b"<p><!-- <b> -", b"-><i> --", b"></p>") == ["p", "i", "/p"]
    assert names(markup.Xml, b"<?xml version='1.0'?><root><node><e/></node></root>") == ["root", "node", "/node", "/root"]
    assert names(markup.Xml, b"<r><![CDATA[ <x> ]", b"]><!-- </r> --></r>") == ["r", "/r"]


def test_json_and_rtf_brackets():
    assert names(markup.Json, rb'{"a": "}]\"{", "b": [1, 2]}') == ["{", "[", "/[", "/{"]
    assert names(markup.Json, rb'{"a": "x\\', b'"}') == ["{", "/{"]  # the backslash is escaped, so the quote closes
    assert names(markup.Json, b'{"a": "x\\', b'"y"}') == ["{", "/{"]
    assert names(markup.Rtf, rb"{\rtf1 \{ \} {a}}") == ["{", "{", "/{", "/{"]
    parser = markup.Json()
    assert parser.events(b'{"key": 1} x')[2] and markup.Json().feed(b'{"key": 1\x01}') == BROKEN


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"<a>", b"</a>", b"<b x='1'>", b"</b>", b"<!--", b"-->", b"<![CDATA[", b"]]>", b"t", b"<e/>"]), max_size=25), st.integers(1, 9))
def test_tags_do_not_depend_on_cuts(parts, n):
    data = b"".join(parts)
    assert names(markup.Xml, data) == names(markup.Xml, *[data[i : i + n] for i in range(0, len(data), n)])


def test_stack_rules():
    def run(data):
        p = markup.Xml()
        return p.feed(data), p

    assert run(b"<a><b></b></a>")[0] == DONE
    assert run(b"<a><b></a></b>")[0] == BROKEN and run(b"</a>")[0] == BROKEN
    v, p = run(b"<a><b></b>")
    twin = p.clone()
    assert v == GOING and twin.feed(b"</a>") == DONE and p.stack is not None


# gaps


def padded(*parts, fill=b"\0"):
    return b"".join(p.ljust(64, fill) for p in parts)


def test_xml_over_a_gap():
    image = padded(b"<?xml version='1.1'?><list><entry>one</entry>", b"other words </span> and more of them", b"<entry>two</entry></list>")
    [(f, body)] = carved(image, formats=("xml",))
    assert f.status == "complete" and b"<entry>two</entry>" in body and b"other" not in body
    assert [s for s, _ in f.fragments] == [0, 128] and f.fragments[0][1] == 128


def test_json_over_a_gap():
    image = padded(b'[{"k": {"list": [1, ', b' "words", } ] that are foreign', b'2]}}]', fill=b" ")
    [(f, body)] = carved(image, formats=("json",))
    assert f.status == "complete" and b"[1,2]}}]" in body.replace(b" ", b"") and b"foreign" not in body


def test_pdf_over_a_gap_keeps_offsets():
    head = b"%PDF-1.7\n7 0 obj << /Length 20 >> endobj\nstream\n"
    [(f, body)] = carved(head + b"A" * (64 - len(head)) + b"B" * 64 + b"CCCC\nendstream\n%%eof".ljust(64, b"\0"), formats=("pdf",))
    assert f.status == "complete" and body == head + b"A" * (64 - len(head)) + b"B" * 64 + b"CCCC\nendstream\n%%eof"


def test_png_over_a_gap_is_filled_with_zeros():
    data = dict(samples())["png"]
    cut = 64 * 94  # foreign bytes stand where the next chunk should begin
    [(f, body)] = carved(data[:cut] + b"\xee" * 192 + data[cut:].ljust(128, b"\0"), formats=("png",))
    assert (f.status, len(f.fragments)) == ("complete", 2)
    assert body == data[:cut] + b"\xee" * 64 + bytes(128) + data[cut:]


def test_no_continuation_is_partial_and_leaves_the_cluster_open():
    image = padded(b"<?xml version='1.0'?><root><item>", b"</wrong><html><body></body></html>", b"", b"")
    found = carved(image, formats=("xml", "html"))
    assert [(f.format, f.status) for f, _ in found] == [("xml", "partial"), ("xml", "complete")]
    assert [f.status for f, _ in carved(image, formats=("xml", "html"), compat=True)] == ["partial"]


def test_wav_and_avi_share_a_signature():
    s = dict(samples())
    for name in ("wav", "avi"):
        assert carved(s[name] + bytes(64))[0][0].format == name
    assert carved(s["avi"] + bytes(64), compat=True, formats=("wav", "avi")) == []


def test_custom_format():
    header, footer = b"\x89XYZ\r\n", b"IEND\xaeB`\x82"
    image = header + b"A" * 58 + b"B" * 20 + footer + bytes(40)
    [(f, body)] = carved(image, formats=("rtf",), custom=(("xyz", header, footer),))
    assert (f.format, f.status, len(body)) == ("xyz", "complete", 64 + 20 + len(footer))
    with pytest.raises(ValueError):
        linear("x", b"", b"")


def test_two_files_in_one_cluster():
    image = padded(b"<html></html>", b"") + padded(b"{\"a\":[]} {\"b\":{}}")
    assert len(carved(image, formats=("html", "json"))) >= 2


def test_options():
    for bad in ({"cluster_size": 0}, {"workers": 0}, {"max_search_clusters": 0}, {"text_density": 1.5}, {"formats": ("nope",)}):
        with pytest.raises(ValueError):
            CarveOptions(**bad)
    opt = CarveOptions(formats=(" PNG", "docx", "zip", "nope"))
    assert [f.name for f in opt.active()] == ["png", "zip"] and opt.unknown() == ["nope"]
    assert CarveOptions(max_file_bytes=100).max_file_bytes == 100


@pytest.mark.parametrize("cut", [700, 4096])
@pytest.mark.parametrize("kind", [markup.Html, markup.Xml])
def test_tag_of_any_length_is_carried(kind, cut):
    page = b"<html><p>a</p><e src='data:" + b"QUJD" * 50_000 + b"'/><p>b</p></html>"
    parser, verdicts = kind(), []
    for at in range(0, len(page), cut):
        verdicts.append(parser.feed(page[at : at + cut]))
    assert set(verdicts[:-1]) == {GOING} and verdicts[-1] == DONE
    assert parser.advance == len(page) - len(page) // cut * cut
    parser = kind()
    assert parser.feed(b"<html><e src='" + b"x" * 70_000) == GOING
    other = parser.clone()
    assert other.feed(b"yy") == GOING
    assert (parser.feed(b"'/></html>"), parser.advance) == (DONE, 10)
    assert (other.feed(b"'/></html>"), other.advance) == (DONE, 10)


@pytest.mark.parametrize("name", ["mp4", "mov"])
def test_box_boundary_in_the_last_bytes_of_a_cluster(name):
    head = b"\0\0\0\x10ftypisomabcd" if name == "mp4" else b"\0\0\0\x08wide"
    for short in range(1, 9):
        fill = 512 - len(head) - short - 8
        data = head + (fill + 8).to_bytes(4, "big") + b"free" + bytes([7]) * fill + (3008).to_bytes(4, "big") + b"mdat" + bytes(range(250)) * 12
        assert [(f.status, body) for f, body in carved(data + bytes(1024), 512, formats=(name,))] == [("complete", data)]
        # at the end of the image a few zeros are no box
        assert [f.status for f, _ in carved(data + bytes(5), 512, formats=(name,))] == ["complete"]


def test_search_finds_what_expressions_find():
    rng, formats = random.Random(4), CarveOptions().active()
    sigs = [s for f in formats for s in f.signatures]
    for _ in range(200):
        data = b"".join(rng.choice([rng.choice(sigs), rng.choice(sigs).upper(), rng.randbytes(rng.randint(0, 9)), b'{"{"', b"\0\0\0"]) for _ in range(rng.randint(0, 40)))
        found = [(m.start() - f.lead, -len(s), k) for k, f in enumerate(formats) for s in f.signatures for m in re.finditer(re.escape(s), data, re.I if f.text else 0) if m.start() >= f.lead]
        assert search(data, formats) == [(a, k) for a, _, k in sorted(found)]
