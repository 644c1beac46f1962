"""Operators that treat each text by itself or by learned tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import html_extract, langid, licenses, media, mixing, pii, queries, toxicity
from tests.llm import brute, jpeg
from tests.llm.test_pairs import table

PERSONAL = [
    None, "", "a@b.c d@e", "mail me: Jo.hn+x@mail-1.example.com, or x@y.z_w@v.u!", "a@@b.cc a@b..c", "@" * 50, "1.2.3.4 256.1.1.1 1.2.3 01.002.0003.255 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 49927398716", "card 4111111111111111, 0000000000000", "+1 (555) 010-9999 +44.20.7946.0958 ++1 2 +12345678901234567",
    "é\u0001é@x.y ü+49 30 123456\u0001 𝄞1.1.1.1", "1 " * 3000, "9" * 5000, "a" * 5000 + "@", "1." * 2000,
]


def test_personal_data_against_plain_version(spark):
    rng = random.Random(1)
    letters = "a1.@+ -_0()%5\u0001é"
    texts = PERSONAL + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(150)]
    got = {r["doc_id"]: r for r in pii.digests(table(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = brute.base_pii(text)
        base = [s for s in got[k]["spans"].split(",") if s.split(":")[0] in pii.KINDS]
        assert base == want, text
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s.startswith(x) for s in want) for x in pii.KINDS]


def test_telling_terms_are_found_and_masked(spark):
    rng = random.Random(2)
    common = [f"c{chr(97 + k)}" for k in range(20)]
    filler = lambda: " ".join(rng.choice(common) for _ in range(30))
    texts = [f"{filler()} zanzibar boss@corp.example {filler()} {k}" for k in range(3)] + [f"{filler()} {k}" for k in range(100)]
    docs = table(spark, [t.translate(str.maketrans("0123456789", "abcdefghij")) if k > 2 else t for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["spans"] for r in pii.digests(docs).collect()}
    for k in range(3):
        spans = [s.split(":") for s in got[k].split(",")]
        terms = {texts[k][int(a) : int(b)] for kind, a, b in spans if kind == "removed"}
        assert "zanzibar" in terms and spans[0][0] == "email"
    assert not any(got[k] for k in range(3, 103))
    masked = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in masked[0] and "zanzibar" not in masked[0] and masked[50] == docs.where("doc_id = 50").first()["text"]
    assert pii.sanitise(docs).columns == docs.columns


def test_spans_of_the_method_against_plain_version(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 3, 3))))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "token", hexes(5000), "a" * 50, "1" * 50 + "a1" * 20, f"{hexes(24)}@x.y {hexes(24)}"]
    for k in range(400):
        body = text(rng.randrange(3, 60))
        if k % 8 == 0:
            body = f"{body} token = \"{hexes(40)}\" {text(9)}"
        if k % 8 == 1:
            body = f"{text(4)} Director Müller wrote boss@corp.example {text(3)} {body}"
        if k % 8 == 2:
            body = f"{body} call {rng.choice(('him', 'her', 'us'))} +49 30 {rng.randrange(10**6, 10**7)} now {text(5)}"
        texts.append(body)
        if k % 40 == 0:
            texts.append(body)
    got = {r["doc_id"]: r for r in pii.digests(table(spark, texts)).collect()}
    want = brute.pii_spans(texts)
    assert [got[k]["spans"] for k in range(len(texts))] == want
    kinds = {x.split(":")[0] for spans in want for x in spans.split(",") if x}
    assert kinds >= {"email", "phone", "secret", "removed"}
    masked = {r["doc_id"]: r["text"] for r in pii.sanitise(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        at, out = 0, ""
        for kind, a, b in sorted(((kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in want[k].split(",") if x)), key=lambda x: x[1:]):
            if a < at:
                at = max(at, b)
                continue
            out += (t or "")[at:a] + {"generalised": "[TERM]", "removed": ""}.get(kind, f"[{kind.upper()}]")
            at = b
        assert masked[k] == (out + t[at:] if t is not None else None)


def test_personal_data_of_repeated_rows_and_clashing_names(spark):
    docs = table(spark, ["mail a@b.cc", "mail a@b.cc", None, "x"], [1, 1, 1, None])
    docs = docs.withColumn("base", F.lit("mine")).withColumn("id", F.lit(7)).withColumn("__spans", F.lit(3)).withColumn("near", F.lit(3))
    assert sorted(r["n_email"] for r in pii.digests(docs).collect()) == [0, 0, 1, 1]
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "mail [EMAIL]", "mail [EMAIL]", "x"]
    assert pii.digests(docs.where("false")).count() == 0 and pii.sanitise(docs.where("false")).count() == 0


def test_media_round_trip(spark):
    texts = [None, "", "x", "é" * 500, "a" * 191, "a" * 192, "a" * 193, "".join(chr(k) for k in range(1, 2000)), "long " * 20000]
    got = {r["doc_id"]: r for r in media.digests(table(spark, texts)).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    clips = media.to_clips(table(spark, texts))
    blobs = {r["doc_id"]: bytes(r["media"]) for r in clips.collect()}
    assert all(hashlib.sha256(blobs[k]).hexdigest() == got[k]["media_sha256"] and len(blobs[k]) == got[k]["media_bytes"] for k in blobs)
    rows = media.clip_rows(clips).collect()
    for k in blobs:
        mine = sorted((r["first_frame"], r["n_frames"]) for r in rows if r["doc_id"] == k)
        assert sum(n for _, n in mine) == got[k]["payload_bytes"] // 192 and mine[0][0] == 0


def test_media_random_frames_by_a_second_reader():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 192 * n).astype(np.uint8) for n in (1, 2, 10)] + [np.full(192, 255, np.uint8), np.zeros(192, np.uint8)]
    blobs = media.encode(payloads)
    assert all((f.ravel() == p).all() for f, p in zip(media.decode(blobs), payloads, strict=True))
    for blob, payload in zip(blobs, payloads, strict=True):
        listed, named = jpeg.frames(blob)
        assert listed == named and len(listed) == len(payload) // 192
        seen = np.concatenate([jpeg.read_grey(f)[::8, ::8].ravel() for f in listed])
        assert (seen == payload).all()
        for k, f in enumerate(listed):
            whole = media.decode_jpeg(f)
            assert whole.shape == (64, 192) and (whole == np.kron(payload[k * 192 : k * 192 + 192].reshape(8, 24), np.ones((8, 8)))).all()


def _foreign(rng, kind, base):
    """A frame of another writer: grey, three full components, or subsampled ones, with restarts or without its tables."""
    tables = {0x00: (media.USUAL_DC[0], bytes(range(12))), 0x01: (media.USUAL_DC[1], bytes(range(12))), 0x10: media.USUAL_AC[0], 0x11: media.USUAL_AC[1]}
    factors = {"grey": [(1, 1)], "444": [(1, 1)] * 3, "420": [(2, 2), (1, 1), (1, 1)], "422": [(2, 1), (1, 1), (1, 1)], "bare": [(2, 2), (1, 1), (1, 1)]}[kind]
    quant = [3] + [rng.integers(2, 40) for _ in range(63)]
    planes = []
    for k, (h, v) in enumerate(factors):
        levels = np.where(rng.random((2 * v, 3 * h, 64)) < 0.15, rng.integers(-9, 10, (2 * v, 3 * h, 64)), 0)
        levels[..., 0] = (base - 128) * 8 // 3 + rng.integers(-3, 4, levels.shape[:2]) if k == 0 else 5
        planes.append(levels)
    h, v = factors[0]
    shape = (16 * v - 3, 24 * h - 5)
    frame, luma = jpeg.write(planes, factors, quant, tables, shape, restart=2 if kind in ("422", "grey") else 0, with_tables=kind != "bare")
    return frame, luma[: shape[0], : shape[1]]


@pytest.mark.parametrize("kind", ["grey", "444", "420", "422", "bare"])
def test_media_foreign_frames(spark, kind):
    rng = np.random.default_rng(5)
    made = [_foreign(rng, kind, base) for base in (40, 40, 40, 200, 200)]
    for frame, luma in made:
        got = media.decode_jpeg(frame)
        assert got.shape == luma.shape and np.abs(got.astype(int) - luma).max() <= 1
    good = media.avi([f for f, _ in made])
    at = good.index(b"idx1")
    bare = bytearray(good[:at])  # without an index
    bare[4:8] = (len(bare) - 8).to_bytes(4, "little")
    other = good.replace(b"00dc", b"01dc") if kind == "grey" else good  # frames of no video stream
    empty = media.avi([])
    cut_off = good[: at - len(made[-1][0]) // 2]
    rows = spark.createDataFrame([(1, good), (2, bytes(bare)), (3, None), (4, b"junk"), (5, b""), (6, empty), (7, cut_off), (8, good.replace(b"MJPG", b"H264")), (9, other), (1, good)], "doc_id long, media binary")
    rows = rows.withColumn("shot", rows["doc_id"])
    got = {}
    for r in media.clip_rows(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["first_frame"], r["n_frames"], r["end_s"], r["error"] is None))
    want = [(0, 3, 3 / 25, True), (3, 2, 5 / 25, True)]
    assert sorted(got[1]) == sorted(want * 2) and sorted(got[2]) == want and 3 not in got and 6 not in got
    assert all(len(got[k]) == 1 and not got[k][0][3] for k in (4, 5, 7, 8)) and (kind != "grey" or 9 not in got)
    assert media.clip_rows(rows.where("false")).count() == 0 and media.digests(table(spark, [])).count() == 0


def test_media_broken_frames_are_errors():
    rng = np.random.default_rng(6)
    frame, _ = _foreign(rng, "420", 90)
    blob = media.encode([rng.integers(0, 256, 192 * 3).astype(np.uint8)])[0]
    for bad in (b"", frame[:50], frame[: len(frame) // 2], frame.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xd9"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode_jpeg(bad)
    for bad in (b"", b"RIFF" + bytes(60), blob[:200], blob[:-40]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.clip_histograms(bad)
    for _ in range(300):  # changed bytes give an error or rows, nothing else
        broken = bytearray(blob if rng.random() < 0.5 else media.avi([frame]))
        for _ in range(rng.integers(1, 6)):
            broken[rng.integers(len(broken))] = rng.integers(256)
        try:
            media.shots_of(media.clip_histograms(bytes(broken))[0])
        except (ValueError, IndexError, struct.error):
            pass


def test_media_repeated_rows_and_clashing_names(spark):
    docs = table(spark, ["abc", "abc", None], [1, 1, None]).withColumn("n_bytes", F.lit("x")).withColumn("feature", F.lit("x"))
    got = media.digests(docs).collect()
    assert len(got) == 3 and len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 1}) == 1


@pytest.mark.parametrize("levels", [[0, 200], [0, 0, 200], [0, 200, 0, 200], [0, 0, 200, 200, 100], [0, 200, 200, 200, 0, 0], [0, 0, 90, 90, 200, 200, 20, 20], list(range(0, 256, 16)), [7] * 9])
def test_media_cuts_in_short_and_much_cut_clips(levels):
    frames = np.repeat(np.array(levels, np.uint8)[:, None], 192, axis=1)
    frames[:, :19] = np.random.default_rng(3).integers(0, 256, (len(levels), 19)).astype(np.uint8) if len(set(levels)) > 1 else 7  # a tenth is noise
    assert media.shots(frames).tolist() == [0] + [k for k in range(1, len(levels)) if levels[k] != levels[k - 1]]


def test_media_cuts_of_part_of_a_frame():
    frames = np.zeros((6, 192), np.uint8)
    frames[2:4, :60] = 200  # 31 % of the samples, two cuts among five transitions
    assert media.shots(frames).tolist() == [0, 2, 4]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>First <b>bold</b>  para.<p>Second&nbsp;one<br>line</p><div class="share">Share</div><p>a &lt; b &#233;</p></article>
<section id="comments"><p>Nice</p></section><form>Name <input></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    pages = [PAGE, None, "", "plain text", "<p>unclosed <b>x", "<article><p>cut off", "<" * 50, "<article></article>", PAGE]
    rows = spark.createDataFrame([(k, f"u{k}", p, 1) for k, p in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract(rows).collect()}
    assert got[0]["text"] == "Head & more\nFirst bold para.\nSecond one\nline\na < b é" == got[8]["text"]
    assert [got[k]["text"] for k in (1, 2, 5, 7)] == ["", "", "cut off", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_html_without_article():
    page = "<div>Home | About</div><div class='sidebar'>side text</div><div><p>A long paragraph of text that goes on and on for a while.</p><p>Short.</p><p>Another long paragraph with <b>bold</b> words &amp; more.</p></div><div id='comments'><p>nice</p></div><footer>x</footer>"
    assert html_extract.main_text(page) == "A long paragraph of text that goes on and on for a while.\nShort.\nAnother long paragraph with bold words & more."
    assert html_extract.main_text("plain") == "plain"


LONG = [f"Paragraph {k} of text that goes on and on for a while, and a while more." for k in range(4)]


def test_html_without_article_keeps_all_of_it():
    bars = "".join(f"<div class='share'>Share {k}</div>" for k in range(4))
    p = [f"<p>{x}</p>" for x in LONG]
    page = f"<div>Home | About</div><nav>x</nav><h2>Title</h2><p>Sh is.</p>{p[0]}{bars}{p[1]}<form>a<p>b<p>c<p>d</form><p>Short.</p>{bars}{p[2]}{p[3]}<footer>y</footer><div>Legal</div>"
    assert html_extract.main_text(page) == "\n".join(["Title", "Sh is.", LONG[0], LONG[1], "Short.", LONG[2], LONG[3]])
    assert html_extract.main_text(f"<nav>{p[0]}</nav>") == ""


def test_html_article_within_marked_parts():
    article = f"<article><div class='entry-header'><h1>Title</h1></div><header class='header'>By x</header><p>{LONG[0]}</p><div class='ads'>Buy</div></article>"
    want = f"Title\nBy x\n{LONG[0]}"
    assert html_extract.main_text(f"<div class='form search'>{article}</div><div>Other</div>") == want
    # articles of readers and of sidebars stay out where the page has one of its own
    assert html_extract.main_text(f"{article}<section id='comments'><article>Nice</article></section><aside><article>More</article></aside>") == want


def test_html_matches_articles_of_the_pages(spark, sf_dir):
    import html

    for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_html_line_blocks_decide_without_article_marks(spark, sf_dir):
    """The same text where the pages' article elements are made plain: element names and classes only shut lines out."""
    same = total = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        total += 1
        same += html_extract.main_text(r["html"]) == html_extract.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
    assert same >= 0.95 * total


def test_html_text_outside_an_article():
    article = f"<article><p>{LONG[0]}</p><p>Sh is.</p></article>"
    want = f"{LONG[0]}\nSh is."
    around = f"<div>{LONG[1]}</div>"
    assert html_extract.main_text(around + article + around * 3) == want
    assert html_extract.main_text(f"<p>x</p>{article}<p>y</p>{article}<p>z</p>") == f"{want}\n{want}"
    assert html_extract.main_text("<article><p>a</p><p>b</p></article>" + around) == "a\nb"


def test_html_of_clashing_names_and_long_pages(spark):
    long = "<article>" + "<p>Some words of text, and more.</p>" * 20_000 + "</article><footer>x</footer>"
    rows = spark.createDataFrame([(1, "u", long, "t", 3)] * 2 + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in html_extract.extract(rows).collect())
    assert got == [(0, None, 0), (1, "u", 20_000 * 30 - 1), (1, "u", 20_000 * 30 - 1)]


def test_language(spark):
    rng = random.Random(4)
    vocab = {"en": "the of and with which that".split(), "de": "der und nicht schön über ich".split(), "fr": "les était où ça vous être".split()}
    rows = [(k, " ".join(rng.choice(vocab[x]) for _ in range(12)), x) for k in range(150) for x in [rng.choice(list(vocab))]]
    rows += [(900, None, "en"), (901, "", None), (902, "123 ---", "de"), (903, "THE OF AND", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model[0] == ["de", "en", "fr"] and model[1].shape == ((1 << langid.BITS) + 1, 3)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in rows[:150])
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_language_against_plain_version(spark):
    """The same predictions as without hashing, and posteriors near by (buckets are shared by few grams)."""
    rng = random.Random(6)
    vocab = {"en": "the of and with which that this".split(), "de": "der und nicht schön über ich das".split(), "nl": "de het een niet dat ik over".split()}
    make = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    train = [(make(x, 15), x) for x in vocab for _ in range(30)] * 2  # repeated rows
    texts = [make(rng.choice(list(vocab)), rng.choice((2, 4, 9))) for _ in range(200)] + [None, "", "1 2", "?!", "der " * 50_000]
    model = langid.fit(spark.createDataFrame([(k, t, x, 1) for k, (t, x) in enumerate(train)], "doc_id long, text string, lang string, bucket int"))
    docs = table(spark, texts).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    want = brute.bayes(train, texts)
    assert [got[k]["lang_pred"] for k in range(len(texts))] == [x for x, _ in want]
    assert all(abs(got[k]["score"] - p) < 0.05 for k, (_, p) in enumerate(want))
    tied = langid.fit(spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], round(r["score"], 6)) for r in langid.predict(table(spark, ["abc", "cab"]), tied).collect()} == {("a", 0.5)}


def test_language_held_out(spark, sf_dir):
    got = queries.op10_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_lexicon_intersection_is_edit_distance():
    terms = [("idiot", False, 3.0, 2.0), ("worthless", False, 2.0, 1.0), ("abc", False, 1.0, 1.0), ("achlich", True, 4.0, 4.0)]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(0)
    for _ in range(6000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            if rng.random() < 0.4:
                word[at : at + 2] = reversed(word[at : at + 2])
            else:
                word[at : at + rng.randrange(2)] = rng.choice(["", "x", "t", "i"])
        word = "".join(word) or "q"
        allowed = [k for k, (t, s, *_) in enumerate(terms) if (word.startswith(t) if s else brute.distance(word, t) <= lexicon.allowance(t, s))]
        got = lexicon.find({word}).get(word)
        assert (got is None) == (not allowed), word
        if got and not terms[got[0]][1]:
            assert brute.distance(word, terms[got[0]][0]) == got[1]


def test_toxicity_features_against_plain_version():
    terms = [("idiot", False, 3.0, 2.0), ("worthless", False, 2.0, 1.0), ("abc", False, 1.0, 1.0), ("achlich", True, 4.0, 4.0), ("idiom", False, 3.0, 0.0)]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(5)
    pool = ["idiot", "idoit", "idiots", "IDIOM", "worthles", "wortless", "achlichkeit", "ab", "abc", "abcd", "said", "the word", '"', "“", "”", "'x'", '"idiot', 'idiot"', '"plain', 'kind"', "id1ot", "1di0t", "$a1d", "w0rth1ess", "@bc", "x9idiot", "idiot@abc", "\n", "„", "« abc »", "1", ".", "plain", "words", "of", "no", "kind"]
    texts = ["", "idiot", '"idiot"', 'at the end "idiot"', '"idiot" "plain" idiot', '5" idiot 6"', '"' + "a " * 148 + 'idiot"', '"' + "a " * 142 + 'idiot"', "“idiot\n”", "‘an idiot’s’", "idiot " * 200, "a " * 49 + "idiot " + "a " * 49 + "idiot"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(150))) for _ in range(120)]
    for text in texts:
        assert toxicity.features(text, lexicon) == pytest.approx(brute.toxic_features(text, terms)), text


def test_toxicity_context():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0, 2.0)])
    rate = lambda text: toxicity.features(text, lexicon)[0]
    abuse, quoted, said, fuzzy = map(rate, ("you are an idiot now", 'he read an "idiot" aloud', "the word idiot is", "you are an idiotx now"))
    assert abuse > fuzzy > quoted > 0 and said > 0 and said < abuse
    assert rate('he read aloud "idiot"') == pytest.approx(rate('he read an "idiot"')) and rate('he read aloud "idiot"') < abuse
    assert 0 < rate("you are an idoit now") == rate("you an 1d10t now") == fuzzy and rate("you odiit") == 0.0
    assert toxicity.features("", lexicon) == [0.0, 0.0]


@pytest.fixture(scope="module")
def abuse(spark):
    """A model, its terms, and the held-out texts with terms that it finds."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, train=queries._fold(3) != 1)
    terms = {t for t, stem, *_ in model[0].terms if not stem and len(t) >= 5}
    held = toxicity.score(docs, model, held_out=queries._fold(3) == 1).where("held_out AND predicted = 1").select("doc_id").join(docs, "doc_id")
    texts = [r["text"] for r in held.collect() if terms & set(toxicity.WORDS.findall(r["text"].lower()))]
    assert (model[1][:-1] >= 0).all() and len(texts) > 50
    return model, terms, texts


def _insert(rng, word):
    k = rng.randrange(1, len(word))
    return word[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[k:]


def _delete(rng, word):
    k = rng.randrange(1, len(word))
    return word[:k] + word[k + 1 :]


def _replace(rng, word):
    k = rng.randrange(1, len(word))
    return word[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[k + 1 :]


def _swap(rng, word):
    k = rng.choice([k for k in range(len(word) - 1) if word[k] != word[k + 1]])
    return word[:k] + word[k + 1] + word[k] + word[k + 2 :]


def _disguise(rng, word):
    return word.lower().translate(str.maketrans("oeals", "03@1$"))


@pytest.mark.parametrize("way", [_insert, _delete, _replace, _swap, _disguise])
def test_toxicity_of_misspelled_terms(spark, abuse, way):
    """Held-out toxic texts that are found are found again with each term misspelled."""
    model, terms, texts = abuse
    rng = random.Random(1)
    changed = [toxicity.WORDS.sub(lambda m: way(rng, m.group()) if m.group().lower() in terms else m.group(), t) for t in texts]
    table = spark.createDataFrame(list(enumerate(changed)), "doc_id long, text string")
    assert toxicity.score(table, model).where("predicted = 1").count() >= 0.9 * len(texts)


def test_toxicity_of_quoted_terms(spark, abuse):
    """Held-out toxic texts are clean with all hits in quotation marks, and toxic with marks around other words."""
    model, _, texts = abuse

    def quote(text, hit):
        known = model[0].find(set(toxicity.WORDS.findall(text.lower())))
        return toxicity.WORDS.sub(lambda m: f"“{m.group()}”" if (m.group().lower() in known) == hit else m.group(), text)

    table = lambda hit: spark.createDataFrame([(k, quote(t, hit)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert toxicity.score(table(True), model).where("predicted = 0").count() >= 0.95 * len(texts)
    assert toxicity.score(table(False), model).where("predicted = 1").count() == len(texts)


def test_share_of_quoted_hits():
    """Chosen on planted rows alone: a share that keeps the quoted clean and the half quoted toxic."""
    n = len(toxicity.SHARES)
    rows = [(((0.0, 0.0),) * n, 0, False, k % 4) for k in range(200)] + [(((3.0, 3.0),) * n, 1, False, k % 4) for k in range(50)]
    assert toxicity.quoted_share(rows) == 0
    clean = tuple((float(k != 3),) * 2 for k in range(n))
    assert toxicity.quoted_share(rows + [(clean, 0, True, k % 4) for k in range(20)]) == 3


def test_toxicity_model(spark):
    rng = random.Random(8)
    clean = [f"k{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    texts, labels = [], []
    for k in range(300):
        words = [rng.choice(clean) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["scumbag", "moronic"])
        texts.append(" ".join(words))
        labels.append((k, int(k % 4 == 0)))
    texts += [None, "", "a scumbaq here"]
    docs = table(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(0, 1), (7, None)], "doc_id long, toxic int"))
    assert {t for t, *_ in model[0].terms} >= {"scumbag", "moronic"}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k]["predicted"] == y for k, y in labels)
    assert got[300]["predicted"] == got[301]["predicted"] == 0 and got[302]["score"] > got[301]["score"]
    twice = docs.union(docs).withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(1))  # repeated rows, clashing names
    assert sorted((r["doc_id"], r["score"]) for r in toxicity.score(twice, model).collect()) == sorted([(k, r["score"]) for k, r in got.items()] * 2)
    assert toxicity.clean(twice, model).columns == twice.columns
    long = table(spark, [" ".join(clean) * 200 + " moronic scumbag" * 9000])
    assert toxicity.score(long, model).first()["predicted"] == 1
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["score"] < 0.7}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def _known_texts():
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    return {k: (folder / f).read_text() for k, f in names.items() if (folder / f).exists()} | licenses.TEXTS


def test_licences(spark, tmp_path):
    """Whole texts wrapped and framed in many ways, notices, and the SQL on the same rows."""
    import textwrap

    import duckdb

    wrap = lambda t, n: "\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    comment = lambda t, c: "\n".join(f"{c} {x}".rstrip() for x in t.split("\n"))
    texts, want = [], []
    for name, text in _known_texts().items():
        frames = [text, text.upper().replace("LICENSE", "LICENCE"), text.replace("\n", "\r\n"), text.replace(",", " ;")]
        if name in licenses.TEXTS:
            frames += [comment(f"{title}\n\nCopyright (c) 2020 Jo\nCopyright The Authors of It\n\n{wrap(text, n)}", c) for title in licenses.TITLES[name] if title != "BSD License" for n, c in ((40, "#"), (60, " *"), (72, "//"), (79, ""))]
        texts += frames
        want += [name] * len(frames)
        texts.append(text + " more")
        want.append(None)
    texts += [None, "", "permission", "Copyright notice and nothing else, without warranty", texts[0], "long licence " * 100_000]
    want += [None, None, None, None, want[0], None]
    docs = table(spark, texts).withColumn("digest", F.lit("x")).withColumn("notices", F.lit("x"))
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want
    lines = ["x\nLicenced under the Apache License,  Version 2.0\nReleased under the MIT Licence!", "# SPDX-License-Identifier: GPL-3.0\n", "this software is licensed under the GNU general public license, version 3", "no such license"]
    rows = docs.unionByName(table(spark, lines * 2, [900, 901, 902, 903] * 2), allowMissingColumns=True)
    out = licenses.scan(rows).toPandas()
    notices = out[out.doc_id >= 900].sort_values("doc_id").notices.tolist()
    assert notices == [x for x in ("Apache-2.0,MIT", "GPL-3.0", "GPL-3.0", "") for _ in range(2)]
    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: tuple("" if x is None or x != x else str(x) for x in r)
    assert sorted(map(key, db.execute(licenses.scan_sql()).fetchall())) == sorted(map(key, out[["doc_id", "text_sha256", "license_id", "notices"]].itertuples(index=False)))
    assert licenses.scan(table(spark, [])).count() == 0


def test_targets_and_flow():
    for sizes in ([10, 10, 10], [1, 100, 5, 0, 30], [0, 0], [], [7], [1000, 1, 1, 1, 1, 1]):
        assert mixing.source_targets(sizes) == pytest.approx(brute.targets(sizes))
    # two sources share a pattern; repetition is spread before a third copy is taken
    given = mixing.flow([10.0, 10.0, 10.0], [(0,), (1,), (0, 1)], [30.0, 15.0])
    assert sum(given) == pytest.approx(45) and max(given) <= 20 + 1e-6


def test_flow_is_optimal():
    """Against all whole-numbered flows: as much as possible, then as cheap as possible."""
    import itertools

    rng = random.Random(13)
    price = lambda g, x: sum((k - 1) ** 2 * max(0, min(g - (k - 1) * x, x)) for k in (1, 2, 3))
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 4)
        supply = [rng.randrange(4) for _ in range(n)]
        member = [tuple(sorted(rng.sample(range(m), rng.randrange(0, m + 1)))) for _ in range(n)]
        quota = [rng.randrange(8) for _ in range(m)]
        best = None
        for g in itertools.product(*(range(3 * x + 1) for x in supply)):
            fits = all(sum(g[p] for p in part) <= sum(quota[s] for s in {s for p in part for s in member[p]}) for size in range(1, n + 1) for part in itertools.combinations(range(n), size))
            if fits:
                best = min(best or (1, 0), (-sum(g), sum(map(price, g, supply))))
        got = mixing.flow([float(x) for x in supply], member, [float(x) for x in quota])
        assert (-sum(got), sum(map(price, got, supply))) == pytest.approx(best)


def test_flow_of_many_patterns():
    rng = random.Random(14)
    member = [tuple(sorted(rng.sample(range(40), rng.randrange(1, 5)))) for _ in range(5000)]
    supply = [float(rng.randrange(1, 10**6)) for _ in member]
    size = [sum(x for x, s in zip(supply, member, strict=True) if k in s) for k in range(40)]
    targets = [t * sum(supply) / sum(size) for t in mixing.source_targets(size)]
    given = mixing.flow(supply, member, targets)
    assert sum(given) == pytest.approx(sum(targets)) and all(0 <= g <= 3 * x * (1 + 1e-9) for g, x in zip(given, supply, strict=True))


def test_mixing_of_repeats_ties_and_long_texts(spark):
    docs = table(spark, ["a b", "a b", "c", "x " * 300_000, "d e"] + ["f g h"] * 60, [1, 1, 1, 2, None] + [k // 2 for k in range(100, 160)]).withColumn("size", F.lit("x")).withColumn("copies", F.lit("x")).withColumn("__id", F.lit(1))
    got = mixing.by_source(docs).collect()
    assert len(got) == 65 and {r["size"] for r in got} == {1, 2, 3, 300_000}
    copies = {}
    for r in got:
        copies.setdefault(r["doc_id"], set()).add(r["copies"])
    kept = mixing.sampled(docs)
    assert set(kept.columns) == set(docs.columns) and kept.count() == sum(r["copies"] > 0 or max(copies[r["doc_id"]]) > 0 for r in got)


def test_mixing(spark):
    rng = random.Random(3)
    texts = [None, ""] + [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(400)]
    docs = table(spark, texts)
    rows = mixing.by_source(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken = {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(brute.words(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, brute.targets([sizes[s] for s in order]), strict=True):
        assert abs(taken[s] - t) <= 40
        assert all(r["target"] == pytest.approx(t) and r["source_size"] == sizes[s] for r in rows if source[r["doc_id"]] == s)
    again = {(r["doc_id"], r["taken"]) for r in mixing.by_source(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    kept = mixing.sampled(docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["copies"]}
    assert mixing.by_source(table(spark, [])).count() == 0
    assert mixing.by_source(table(spark, [None, ""])).count() == 2


def test_mixing_of_overlapping_sources(spark):
    rows = [(k, ["a"] if k % 3 == 0 else ["b", "a", "a"] if k % 3 == 1 else [None], "x y z") for k in range(300)] + [(900, [], "x"), (901, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, tags array<string>, text string")
    got, plan = mixing.mix(docs, F.col("tags"), mixing.n_words(F.col("text")), F.col("doc_id"), [F.col("doc_id")])
    assert plan.sources == ["a", "b", None] and plan.sizes == [600, 300, 300]
    copies = {r["doc_id"]: r["copies"] for r in got.collect()}
    assert copies[900] == copies[901] == 0 and len(copies) == 302
    assert 3 * sum(copies.values()) == pytest.approx(sum(plan.targets), abs=10)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "copies" in out.columns
