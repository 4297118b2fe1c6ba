"""The tree model against enumeration and on labelled pages; fingerprints against a naive transform."""

import io
import itertools
import wave

import numpy as np
import pytest

from shardlight.llm import html, media

SF = "/root/testdata/sf0.001"


def test_marginals_against_enumeration():
    model = html.fit()
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        unary = rng.normal(size=(n, 2))
        total = np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=n):
            p = np.exp(model.root[labels[0]] + sum(unary[i, x] for i, x in enumerate(labels)) + sum(model.edge[labels[parent[i]], labels[i]] for i in range(1, n)))
            for i, x in enumerate(labels):
                total[i, x] += p
        assert html.marginals(parent, depth, unary, model) == pytest.approx(total[:, 1] / total.sum(1), abs=1e-9)


def test_parse_repairs_tags():
    t = html.parse("<html><body><p>a<p>b<br>c<ul><li>x<li>y</ul></i><script>if (a<b) {}</script><!-- <p>no --><img src=x>d &amp; e")
    assert t.tags[1:] == ["html", "body", "p", "p", "ul", "li", "li"] and t.parent[3] == t.parent[4] == 2
    assert [x.strip() for _, x in t.pieces if x] == ["a", "b", "c", "x", "y", "d & e"]


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html.extract(pages).collect()
    assert len(rows) == len(source)
    found = lost = noise = 0
    for r in rows:
        tree = html.parse(source[r["page_id"]])
        within = [False] * len(tree.tags)
        for i in range(1, len(tree.tags)):
            within[i] = tree.tags[i] == "article" or within[tree.parent[i]]
        want = [w for i, t in tree.pieces if within[i] for w in t.split()]
        got = r["text"].split()
        found += len(got)
        lost += max(0, len(want) - len(got))
        noise += len(set(got) - set(want))
    assert lost < 0.05 * found and noise < 0.05 * found


@pytest.mark.parametrize("k", range(len(html.LABELLED)))
def test_held_out_layouts(k):
    """Trained on the other layouts, the model finds most of the words of each."""
    page = html.LABELLED[k]
    tree = html.parse(page)
    label = np.array(["data-content" in h for h in tree.hints])
    [(text, elements, _, _)] = html.extract_pages([page.replace(" data-content", "")], html.fit(html.LABELLED[:k] + html.LABELLED[k + 1 :]), 0.5)
    assert elements == len(label) - 1
    words = lambda keep: sum((t.split() for i, t in tree.pieces if keep(i)), [])
    want, other, got = words(lambda i: label[i]), words(lambda i: not label[i]), text.split()
    assert len(set(got) & set(want)) >= 0.85 * len(set(want))
    assert sum(w in set(got) - set(want) for w in other) <= 0.35 * len(other)


def test_labels_from_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<div class=x><p>one two three four five six seven eight nine ten eleven twelve</p></div>")], "page_id long, url string, html string")
    labelled = spark.createDataFrame([(x,) for x in html.LABELLED] + [(None,)], "html string")
    assert html.extract(pages, labelled=labelled).collect() == html.extract(pages).collect()


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 150_000 + "</x>" * 150_000, "<div>" * 200_000, "<p><i>" * 100_000, "<svg>" * 100_000, "<!--" * 100_000, "<p>x<noscript>" * 60_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.extract_pages([page], html.fit(), 0.5)
    assert time.process_time() - began < 20


def test_hidden_elements_end_where_they_should():
    text = lambda page: [x for _, x in html.parse(page).pieces if x]
    assert text("<svg/><p>a</p><svg-icon></svg-icon><p>b</p><template-x>c</template-x>") == ["a", "b", "c"]
    assert text("<svg><text>no</text></svg><p>a<noscript>b") == ["a", "b"]
    assert text("<STYLE>p{}</style ><p>a<script>var x='<p>no") == ["a"]


def test_html_edge_cases(spark):
    deep = "<div>" * 3000 + "deep text in the middle of it all" + "</div>" * 3000
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "no tags at all", "x"), (2, "u", "no tags at all", "x"), (3, "u", "<p>" + "word " * 200_000 + "</p>", "x"), (4, "u", deep, "x"), (5, "u", "<<<>>><p", "x"), (6, "u", "<script>var x", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] is None and by[None]["text"] == "" and by[None]["elements"] == 0 and by[6]["text"] == ""
    assert by[4]["elements"] == 3000
    assert html.extract(df.where("false")).collect() == []


# media


def naive_peaks(x):
    frames = [x[i * media.HOP : i * media.HOP + media.FRAME] for i in range(max(0, (len(x) - media.FRAME) // media.HOP + 1))]
    k = np.arange(media.FRAME)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), k) / media.FRAME)
    s = np.array([np.abs(dft @ (f * np.hanning(media.FRAME))) for f in frames])
    out = []
    for t in range(len(s)):
        for f in range(s.shape[1]):
            near = s[max(0, t - media.NEAR_T) : t + media.NEAR_T + 1, max(0, f - media.NEAR_F) : f + media.NEAR_F + 1]
            if s[t, f] >= near.max() - 1e-9 and s[t, f] > media.FLOOR * s[t].mean() and s[t, f] > 1e-6:
                out.append((t, f))
    return out


def sound(seed, n=6000):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 8000
    return sum(np.sin(2 * np.pi * rng.uniform(200, 3500) * t) * np.exp(-((t - rng.uniform(0, n / 8000)) ** 2) / 0.002) for _ in range(12)) * 0.2 + rng.normal(size=n) * 0.001


def test_peaks_and_pairs_against_loops():
    x = sound(0)
    t, f = media.peaks(x)
    want = naive_peaks(x)
    assert list(zip(t.tolist(), f.tolist(), strict=True)) == want and len(want) > 5
    at, code = media.pairs(t, f)
    loops = [(t1, f1 << 20 | f2 << 8 | (t2 - t1)) for t1, f1 in want for t2, f2 in want if 0 < t2 - t1 <= media.ZONE_T and abs(f1 - f2) <= media.ZONE_F]
    assert list(zip(at.tolist(), code.tolist(), strict=True)) == loops


def test_blocks_do_not_change_the_result(monkeypatch):
    x = sound(3, 60_000)
    whole = [v.tolist() for v in media.peaks(x)]
    monkeypatch.setattr(media, "BLOCK", 17)
    assert [v.tolist() for v in media.peaks(x)] == whole


def test_codes_survive_a_shift():
    x = sound(1)
    a = set(media.fingerprint(media.write_wav(x))[5].tolist())
    b = set(media.fingerprint(media.write_wav(np.concatenate([np.zeros(media.HOP * 40), x])))[5].tolist())
    c = set(media.fingerprint(media.write_wav(sound(2)))[5].tolist())
    assert len(a & b) > 0.8 * len(a) and len(a & c) < 0.3 * len(a)


@pytest.mark.parametrize("width, channels", [(1, 1), (2, 2), (3, 1), (4, 2)])
def test_wav_widths(width, channels):
    x = np.linspace(-0.9, 0.9, 50)
    ints = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    one = [int(v).to_bytes(width, "little", signed=True) if width > 1 else bytes([int(v) + 128]) for v in ints]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, 44100, 0, "NONE", ""))
        w.writeframes(b"".join(v * channels for v in one))
    got, rate, n = media.read_wav(out.getvalue())
    assert (rate, n) == (44100, channels) and got == pytest.approx(x, abs=0.02)


def test_media_edge_cases(spark):
    good = media.write_wav(sound(5))
    rows = [(1, None, 1), (2, b"", 1), (3, b"RIFF nonsense", 1), (4, good[:30], 1), (5, media.write_wav(np.zeros(10)), 1), (6, media.write_wav(np.zeros(4000)), 1), (None, good, 1), (7, good, 1), (7, good, 1), (8, media.write_wav(np.tile(sound(6), 200)), 1)]
    df = spark.createDataFrame([(i, None if w is None else bytearray(w), p) for i, w, p in rows], "vec_id long, wav binary, peaks int")
    got = media.fingerprints(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[1]["error"] == "null" and {by[i]["error"] for i in (2, 3)} == {"unreadable"} and by[5]["code"] == by[6]["code"] == []
    assert by[None]["code"] == by[7]["code"] and by[8]["samples"] == 6000 * 200 and all(len(r["code"]) == len(r["time_ms"]) and r["time_ms"] == sorted(r["time_ms"]) for r in got if r["code"])
    assert media.fingerprints(df.where("false")).collect() == []
    vectors = spark.createDataFrame([(1, [0.5] * 9, 0), (2, None, 0), (3, [None, 1.0], 0), (4, [], 0), (None, [1.0], 0)], "vec_id long, embedding array<float>, wav int")
    tones = {r["vec_id"]: r["wav"] for r in media.with_tones(vectors).collect()}
    assert tones[2] is tones[3] is tones[4] is None and tones[1] and tones[None]




def test_any_rate_and_length_of_a_recording(spark):
    x = np.sin(np.arange(300_000) / 7) * np.hanning(300_000)
    wav = bytearray(media.write_wav(x))
    high = wav[:24] + (0xFFFFFFFF).to_bytes(4, "little") + wav[28:]
    rows = {r["vec_id"]: r for r in media.fingerprints(spark.createDataFrame([(1, high), (2, wav), (3, wav[:1001])], "vec_id long, wav binary")).collect()}
    assert rows[1]["sample_rate"] == 0xFFFFFFFF and rows[1]["code"] == rows[2]["code"] and rows[2]["samples"] == 300_000
    assert rows[3]["error"] is None and rows[3]["samples"] == 478
    t, f = media.peaks(x)
    own = media.Recording(bytes(wav))
    t2, f2 = media.peaks(own)
    whole = media.peaks(own[:])
    assert (t2 == whole[0]).all() and (f2 == whole[1]).all() and len(t) > 0
