"""Operators against brute-force versions, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard as zstd
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, as_bag
from provenance_spark.llm import (decontaminate_ac, html_lineblock, langid_ppm, license_index, line_site, mix_budget, quality_fm, simhash_cover,
                                  topk_nra, warc_zdict)
from provenance_spark.llm.components import connected_components
from provenance_spark.llm.queries import ORACLE, QUERIES, TARGETS
from provenance_spark.session import workspace_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in each column, empty and blank texts, a very long one, repeated rows, clashing column names.
ROWS = [(1, "Alpha beta gamma delta epsilon", "en", "src1", 5), (1, "Alpha beta gamma delta epsilon", "en", "src1", 5), (2, None, "en", "src1", None),
        (3, "", None, None, 0), (4, " \n\t\n ", "de", "src2", 3), (None, "Alpha beta", "en", "src1", 9), (5, "12 34 !!", "en", "x", 1),
        (6, "lorem ipsum dolor sit amet " * 20000, "la", "src3", 2), (7, "Kelvin İ été \U0001f600 naïve", "fr", "src1", 3)]
EXTRA = ", found int, kept string, language string, score double, id string, host string, raw_text string, epoch int, hash string"


def docs(spark, rows=ROWS, extra=False):
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, 1, "k", "l", 0.5, "i", "h", "r", 2, "z") for r in rows], DOCS + EXTRA)


# ---- SimHash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash_cover"](spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    for r, f, c in zip(rows, fps, roots, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{f:016x}", least[c])


def test_covering_masks_miss_no_pair():
    rng = random.Random(3)
    for radius in (2, 4):
        masks = simhash_cover.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & d for m in masks)


def test_links_of_random_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):  # chains: each one to three bits from the one before
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash_cover._signed(f),) for f in fps], "fp long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash_cover.links(frame), "a", "b").collect()}
    roots = brute_components(fps)
    mine = [parts.get(simhash_cover._signed(f), simhash_cover._signed(f)) for f in fps]
    assert len(set(zip(mine, roots, strict=True))) == len(set(mine)) == len(set(roots))


def test_simhash_awkward_rows(spark):
    got = {(r["id"], r["fp"], r["component_id"]) for r in simhash_cover.near_duplicates(docs(spark, extra=True)).collect()}
    assert {(2, 0, 2), (3, 0, 2), (4, 0, 2)} <= got and any(i is None for i, _, _ in got)
    kept = simhash_cover.keep_one(docs(spark, extra=True))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7] and kept.columns == docs(spark, extra=True).columns
    assert simhash_cover.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- decontamination


def test_decontamination_in_blocks_and_offsets(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, "..."),
                                   (None, "alpha beta"), (2, "short item")], "item_id long, text string")
    text = "é x ONE two-three, four five six seven eight nine ten eleven! y Short\titem z short items"
    rows = [(1, text, "en", "s", 0), *ROWS]
    for block in (1, 2, 1000):
        frame = docs(spark, rows, extra=True).withColumnRenamed("found", "other")
        every = decontaminate_ac.annotate(frame, bench, block=block).collect()
        assert len(every) == len(rows)  # null and empty texts pass every block
        out = next(r["found"] for r in every if r["text"] == text)
        assert out["n_words"] == 19 and sorted(out["items"]) == ["1", "2"]
        assert [(r["first"], r["last"]) for r in out["runs"]] == [(2, 12), (14, 15)]
        assert [text[s["start"]:s["stop"]] for s in out["spans"]] == ["ONE two-three, four five six seven eight nine ten eleven", "Short\titem"]
    clean = decontaminate_ac.clean(docs(spark, rows, extra=True), bench)
    assert clean.count() == len(ROWS) and clean.columns == docs(spark, rows, extra=True).columns
    assert decontaminate_ac.clean(docs(spark), bench.limit(0)).count() == len(ROWS)
    assert decontaminate_ac.clean(docs(spark, []), bench).count() == 0


# ---- language ID


def test_language_accuracy_and_exact_code_length(spark):
    got = QUERIES["op6_langid_ppm"](spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("s"), F.max("score").alias("t")).first()
    assert r["a"] > 0.97 and 0 <= r["s"] <= r["t"] <= 1


def test_code_length_equals_direct_ppm():
    texts = [b"abracadabra", b"abba abba", b"cab"]
    w = np.concatenate([langid_ppm.byte_windows(t) for t in texts])
    keys, n = np.unique(w, return_counts=True)
    model = langid_ppm.Model(["x"], [(keys, n)])
    counts = {}
    for t in texts:
        padded = langid_ppm.PAD + t
        for i in range(3, len(padded)):
            for k in range(4):
                ctx = counts.setdefault(padded[i - k:i], {})
                ctx[padded[i]] = ctx.get(padded[i], 0) + 1

    def bits(raw):
        padded, total = langid_ppm.PAD + raw, 0.0
        for i in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                ctx = counts.get(padded[i - k:i])
                if ctx is None:
                    continue
                whole = sum(ctx.values()) + len(ctx)
                if padded[i] in ctx:
                    total -= np.log2(ctx[padded[i]] / whole)
                    break
                total -= np.log2(len(ctx) / whole)
            else:
                total += 8
        return total

    probes = [b"abracadabra", b"zebra \xc3\xa9", b"", b"caba" * 50]
    assert np.allclose(model.lengths(probes)[:, 0], [bits(p) for p in probes], rtol=1e-5)


def test_language_awkward_rows(spark):
    model = langid_ppm.fit(docs(spark, extra=True), "lang", "text", F.col("doc_id"))
    out = langid_ppm.annotate(docs(spark, extra=True), model, to="out")
    got = {r["doc_id"]: r["out"]["lang"] for r in out.collect()}
    assert got[2] == got[3] == got[4] == got[5] == "und" and got[6] == "la" and got[7] == "fr"
    kept = langid_ppm.known_language(docs(spark, extra=True), model)
    assert kept.count() == 5 and kept.columns == docs(spark, extra=True).columns
    nothing = langid_ppm.fit(docs(spark, []), "lang", "text", F.col("doc_id"))
    assert {(r["o"]["lang"], r["o"]["score"]) for r in langid_ppm.annotate(docs(spark), nothing, to="o").collect()} == {("und", 0.0)}


def test_rare_language_beside_a_long_noisy_document(spark):
    rng = random.Random(9)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000))
    rare = ["yksi kaksi kolme neljä viisi kuusi", "hyvää huomenta kaikille ystäville"]
    rows = [(0, noise, "en", "s", 1), *[(1 + i, f"the common words of a plain sentence {i}", "en", "s", 1) for i in range(40)],
            *[(50 + i, t, "fi", "s", 1) for i, t in enumerate(rare)]]
    model = langid_ppm.fit(docs(spark, rows), "lang", "text", F.col("doc_id"), nodes=3000)
    alone = langid_ppm.fit(docs(spark, rows[41:]), "lang", "text", F.col("doc_id"))
    probes = [t.encode() for t in ["kolme ystäville huomenta", "the plain words of a sentence", *rare]]
    assert model.langs == ["en", "fi"] and len(model.known) < 3300
    assert np.allclose(model.lengths(probes)[:, 1], alone.lengths(probes)[:, 0])  # the rare language's tree is whole
    assert model.predict(probes, [True] * 4)[0] == ["fi", "en", "fi", "fi"]
    # A tree of equally common strings is thinned, never lost.
    tiny = langid_ppm.fit(docs(spark, [rows[0], *rows[41:]]), "lang", "text", F.col("doc_id"), nodes=60)
    assert tiny.langs == ["en", "fi"] and all(len(levels[3][0]) for levels in tiny.trees)


def test_shares_of_nodes():
    assert langid_ppm.shares({"a": 5, "b": 1000, "c": 400}, 705) == {"a": 5, "c": 350, "b": 350}
    assert langid_ppm.shares({"a": 5, "b": 10}, 100) == {"a": 5, "b": 10} and langid_ppm.shares({}, 10) == {}


# ---- quality


def test_quality_separates_held_out(spark):
    got = QUERIES["op1_quality_fm"](spark, SF_MID)
    assert got.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, 8)))
    at, value = quality_fm.features(b"Some words and some MORE words!! 12\nline")
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
    margin, _ = m.margins(at, value, np.array([0]))
    assert margin[0] == pytest.approx(0.3 + m.linear[at] @ value + pairs)


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 0), (3, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality_fm.fit(docs(spark, extra=True), labels)
    out = quality_fm.annotate(docs(spark, extra=True), m, to="out").collect()
    by = {r["doc_id"]: r["out"] for r in out}
    assert len(out) == len(ROWS) and all(0 <= s <= 1 for s in by.values()) and by[2] == by[3]
    empty = quality_fm.fit(docs(spark), labels.limit(0))
    assert quality_fm.annotate(docs(spark, []), empty, to="out").count() == 0
    assert quality_fm.fit(docs(spark, []), labels).bias == 0.0


# ---- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="ad">Buy now</div><!-- <p>hidden</p> -->
<article><h1>Caf&eacute; &amp; more</h1><p>First   para
with&nbsp;a <b>bold</b> word<p>Second &#8212; short.<div class="share-buttons">Share it</div><ul><li>one<li>two</ul><form>Name <input name=x></form>
<p>Last.</p></article><aside>Related</aside><section id="comments"><p>A long reader comment that would pass any threshold of text length, really, it does.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_lineblock.extract(PAGE) == "Café & more\nFirst para with a bold word\nSecond — short.\none\ntwo\nLast."


def test_line_blocks_without_an_article_element():
    menu = "".join(f"<div><a href=/{i}>Link number {i}</a></div>" for i in range(12))
    body = "".join(f"<p>Paragraph {i} of the article with enough words in it to weigh something.</p>" for i in range(4))
    page = f"<body><div class=menu>{menu}</div>{menu}<div id=c><h2>Head</h2>{body}<div class=ad>x</div><p>End.</p></div><div class='cookie-notice'>{body}</div>"
    got = html_lineblock.extract(page).split("\n")
    assert got[0] == "Head" and got[-1] == "End." and len(got) == 6


def test_marks_do_not_replace_the_windows():
    story = [f"Paragraph {i} of a story that stands in no marked element, with enough words in it to weigh something." for i in range(6)]
    body = "".join(f"<p>{p}</p>" for p in story)
    cards = "".join(f"<article class=card><h3><a href=/{i}>Another story {i}</a></h3><p>A teaser of some other story, which ends after a few words.</p></article>"
                    for i in range(8))
    extract = html_lineblock.extract
    assert extract(f"<body><div id=story><h1>Head</h1>{body}</div><div>{cards}</div></body>").split("\n") == ["Head", *story]
    assert extract(f"<body><div>{cards}</div><div id=story>{body}</div></body>").split("\n") == story
    assert extract(f"<body><main><h1>Head</h1></main><div id=story>{body}</div></body>").split("\n") == ["Head", *story]
    # Marks settle a close call: a note outside goes, the article's own short parts and lists of links stay.
    note = "<div>A note outside the article that is long enough to surge, though not by far, when alone.</div>"
    links = "".join(f"<li><a href=/{i}>Something else to read {i}</a></li>" for i in range(9))
    page = f"<body>{note}<article>{body}<div class=ad>x</div><p>End.</p><ul>{links}</ul></article>{note}</body>"
    assert extract(page).split("\n") == [*story, "End.", *(f"Something else to read {i}" for i in range(9))]
    assert extract("<article><a href=/><h1>All of it</h1><p>is a link</p></a></article>") == "All of it\nis a link"


STORY = "<h1>A title here</h1>" + "".join(
    f"<p>Paragraph {i} with a good deal of text that goes on for a while, so that it surely is an article, {i} times.</p>" for i in range(4))


@pytest.mark.parametrize("wrapper", [
    '<div class="no-sidebar">', '<div class="page has-sidebar">', '<div class="with-sidebar">', '<div class="header-fixed">', '<div class="social-science">',
    '<div class="widget-area">', '<div id="ad-free">', '<div class="comments-open">', '<article class="has-comments">', '<article class="discussion">',
    '<form id="form1">', "<fieldset>", '<div class="sidebar">', '<div class="comments">', '<div class="site-header">'])
def test_html_wrapper_names_lose_no_page(wrapper):
    tag = wrapper[1:].split()[0].strip(">")
    page = f"<body><ul><li><a href=x>home</a></li><li><a href=y>away</a></li></ul>{wrapper}{STORY}</{tag}><footer>foot</footer></body>"
    assert html_lineblock.extract(page).split("\n") == html_lineblock.extract(f"<div>{STORY}</div>").split("\n")
    assert len(html_lineblock.extract(page).split("\n")) == 5


@pytest.mark.parametrize("part, texts", [
    ('<section id="discussion"><p>Long discussion text that goes on for a good while here.</p></section>', ["Long discussion text that goes on for a good while here."]),
    ('<section id="related-work"><h2>R</h2><p>Related work.</p></section>', ["R", "Related work."]), ('<h2 id="search">Search</h2>', ["Search"]),
    ('<p class="notice-board">The board.</p>', ["The board."]), ("<ul><li><a href=1>Ref one</a></li><li><a href=2>Ref two</a></li></ul>", ["Ref one", "Ref two"]),
    ("<p><a href=1>a</a></p><p><a href=1>b</a></p><p><a href=1>c</a></p><div>Short end.</div>", ["a", "b", "c", "Short end."]),
    ('<div class="share">Tell your friends</div><p class="ad">Buy it now</p>', [])])
def test_html_parts_of_an_article(part, texts):
    assert html_lineblock.extract(f"<body><article>{STORY}{part}</article></body>").split("\n")[5:] == texts


@pytest.mark.parametrize("part", [
    '<div class="footer-content">Some footer text which is fairly long, as footers are, with a lot of words in it to be seen as text.</div>',
    '<div class="cookie-text">We use cookies to make this site better and to learn what you like, so please agree to all of them now.</div>',
    f'<div id="comments">{STORY * 3}</div>', f'<section class="user-comments">{STORY * 9}</section>',
    '<form><p>Write to us with your name, your address and all that you would like to tell the editors of this page, please.</p></form>'])
def test_html_asides_go(part):
    assert html_lineblock.extract(f"<body><div>{STORY}</div>{part}</body>").count("\n") == 4


def test_html_windows_equal_brute_force():
    """Surges and dives of unmarked pages recomputed from the definition, on pages of random line lengths."""
    rng = random.Random(6)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 0, 5, 20, 60, 120]) for _ in range(rng.randint(1, 25))]
        page = "".join(f"<div><p>{'x' * n}{i:02d}</p></div>" if n else f"<div><a href=u>link {i:02d}</a></div>" for i, n in enumerate(sizes))
        weight = [n + 2 if n else 0 for n in sizes]
        runs, now = [], []
        for i in range(len(weight)):  # a stretch ends where WINDOW lines weigh nothing
            if weight[i]:
                if now and i - now[-1] > html_lineblock.WINDOW:
                    runs.append(now)
                    now = []
                now = [*range(now[0], i + 1)] if now else [i]
        runs += [now] if now else []

        def peak(run):
            return max(sum(weight[i] for i in run[n:n + html_lineblock.WINDOW]) for n in range(len(run)))

        kept = [r for r in runs if peak(r) >= html_lineblock.SURGE]
        if runs and not kept:
            kept = [max(runs, key=lambda r: sum(weight[i] for i in r))]
        want = [f"{'x' * sizes[i]}{i:02d}" if sizes[i] else f"link {i:02d}" for r in kept for i in r]
        assert html_lineblock.extract(page) == "\n".join(want), sizes


def test_html_awkward_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "plain < text"), (2, "u", "plain < text"), (3, "u", "<p>" * 5000 + "deep" + "<a b='" * 2000), (4, "u", "<script>x")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_lineblock.extract_pages(frame).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 4, None)} == {""}
    assert [r["text"] for r in got if r["page_id"] == 2] == ["plain < text"] * 2 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_lineblock.extract_pages(frame.limit(0)).count() == 0


def test_html_query_equals_article_markup(spark):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    for r in QUERIES["op2_html_lineblock"](spark, SF_SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# ---- WARC


def test_warc_round_trip_and_frames(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u 2", None), (5, None, ""), (None, "u", "same"), (4, "u4", "é" * 100000), (1, "u1", "same")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    archives = warc_zdict.write_archives(frame, workspace_path(spark, "warc"), archive_bytes=1 << 12)
    got = warc_zdict.read_archives(archives).collect()
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"] or 0)
    assert sorted((key(r) for r in got)) == sorted([(False, 3, "revisit", 1), (False, 1, "response", 0), (False, 1, "response", 0), (False, 2, "response", 0),
                                                    (False, 5, "revisit", 2), (True, 0, "revisit", 1), (False, 4, "response", 0)])
    for r in got:
        if r["payload"] is not None:
            assert r["payload_digest"] == b32encode(hashlib.sha1(r["payload"]).digest()).decode() and r["payload_bytes"] == len(r["payload"])
    for a in archives.collect():
        raw = open(a["path"].removeprefix("file:"), "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        press, rest, n = zstd.ZstdCompressionDict(raw[8:8 + size]), raw[8 + size:], 0
        while rest:  # each record is a frame of its own
            one = zstd.ZstdDecompressor(dict_data=press).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = one.unused_data, n + 1
        assert n == a["n_records"]
    assert warc_zdict.read_archives(warc_zdict.write_archives(frame.limit(0), workspace_path(spark, "warc"))).count() == 0


# ---- top-k


def test_top_k_with_ties_blocks_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_nra, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk_nra, "SHARD", 40)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(150)]
    rows += [(200, [0.5] * 6), (201, [0.5] * 6), (220, [0.5] * 6), (300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5),
             (320, [1.0, 2.0]), (321, []), (None, [1.0] * 6), (200, [0.5] * 6)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = sorted(tuple(r) for r in topk_nra.top_k(frame, F.col("id") % 20 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    ok = {i: np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 6 - len(v))) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ok:
        if q % 20 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk_nra.top_k(frame.limit(0), F.col("id") % 20 == 0, 5).count() == 0


def test_reading_stops_before_the_ends_of_the_lists():
    rng = np.random.default_rng(4)
    vectors = np.floor(64 * rng.normal(0, 0.02, (4000, 16)))
    vectors[:40] = 60
    best = topk_nra.TopK(np.array([10_000]), np.full((1, 16), 30.0), 20)
    alive = best._alive(*(x.astype(np.float32) for x in (np.full((1, 16), 30.0), np.zeros((1, 16)), vectors, np.sort(vectors, axis=0))),
                        np.zeros((1, 4000), bool), best.least(slice(0, 1)))
    assert alive is not None and 20 <= alive.sum() <= 0.05 * 4000


# ---- mixing, lines, licences: awkward rows (their values are held against SQL)


def test_mixture_awkward_rows(spark):
    got = mix_budget.mixture(docs(spark, extra=True), TARGETS, 0.5, 3, 1).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] * r["copies"] for r in got) <= 0.5 * total
    out = mix_budget.mixed(docs(spark, extra=True).drop("epoch"), TARGETS, 0.9, 3, 1)
    assert out.columns == [*docs(spark, extra=True).drop("epoch").columns, "epoch"]
    assert mix_budget.mixture(docs(spark, []), TARGETS, 0.5, 3, 1).count() == 0


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 1000), ("d1", "de", "f", 5)],
                                   "domain string, language string, site string, total long")
    got = {r["site"]: r["share"] for r in mix_budget.budgets(leaves, mix_budget.Targets(), 800, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "e": 395, "f": 5}
    got = {r["site"]: r["share"] for r in mix_budget.budgets(leaves, mix_budget.Targets(domain={"d1": 0}), 800, 1).collect()}
    assert got == {"a": 10, "b": 390, "c": 400, "e": 0, "f": 0}


def test_line_dedup_awkward_rows(spark):
    rows = [(i, f"Menu \n\nown line {i}\nMENU", "en", "h", 1) for i in range(10)] + [(20, "Menu\r\nMenu", "en", "other", 1), *ROWS]
    frame = docs(spark, rows, extra=True)
    out = {r["doc_id"]: r["out"] for r in line_site.annotate(frame, "source", "text", to="out").where("source in ('h', 'other') or doc_id in (2, 4)").collect()}
    assert out[5]["text"] == "\nown line 5" and (out[5]["n_lines"], out[5]["n_dropped"]) == (3, 2) and out[20]["text"] == "Menu\r\nMenu"
    assert out[2]["text"] in (None, "\nown line 2")
    cleaned = line_site.cleaned(frame, "source")
    assert cleaned.columns == frame.columns and cleaned.count() == len(rows)
    assert [r["text"] for r in cleaned.where("doc_id = 2 and source = 'src1'").collect()] == [None]
    assert line_site.cleaned(docs(spark, []), "source").count() == 0
    small = docs(spark, [(10 * n + i, f"Menu\nown line {i} of {n}", "en", f"h{n}", 1) for n in (2, 3, 4) for i in range(n)])
    texts = {r["doc_id"]: r["text"] for r in line_site.cleaned(small, "source").collect()}
    assert texts[31] == "own line 1 of 3" and texts[43] == "own line 3 of 4" and texts[20] == "Menu\nown line 0 of 2"
    copies = docs(spark, [(i, "Same page\nof one text", "en", "h", 1) for i in range(50)])
    assert line_site.cleaned(copies, "source").select("text").distinct().count() == 1  # copies of a page aren't boilerplate
    assert line_site.cleaned(copies, "source").first()["text"] == "Same page\nof one text"


def test_licence_texts_and_awkward_rows(spark):
    notice = license_index.TEMPLATES[0][1]
    rows = [(100, "// Copyright X\n" + notice.upper().replace(" ", "\n * "), "en", "s", 1), (101, notice.replace("sublicense and or sell", "resell"), "en", "s", 1),
            (102, "see the MIT   License, mit-license and the Apache License. General Public License", "en", "s", 1), (103, "summit license", "en", "s", 1), *ROWS]
    got = {(r["doc_id"]): r for r in license_index.scan(docs(spark, rows, extra=True)).collect()}
    assert got[100]["labels"] == "mit" and got[100]["score"] == pytest.approx(1) and got[100]["n_base"] == 0
    assert got[101]["labels"] == "" and got[103]["base_labels"] == "" and got[2]["n_words"] == 0 and got[2]["first_word"] is None
    r = got[102]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 2, 10, "apache,gpl,mit")
    assert license_index.scan(docs(spark, rows)).count() == len(rows) and license_index.scan(docs(spark, [])).count() == 0


def test_licence_in_a_file_full_of_other_anchors(spark):
    # Two words each of the other templates stand in the long file alone, so all of them are rarer than the isc notice's anchors.
    texts = {t: text.split() for t, (label, text, _) in enumerate(license_index.TEMPLATES) if label != "isc"}
    isc = next(text for label, text, _ in license_index.TEMPLATES if label == "isc")
    every = [w for _, text, _ in license_index.TEMPLATES for w in set(text.split())]
    own = {t: sorted(w for w in set(ws) if every.count(w) == 1)[:2] for t, ws in texts.items()}
    rare = sum(own.values(), [])
    assert len(rare) > 12
    rows = [(i, f"{isc} file {i}", "en", "s", 1) for i in range(30)]
    rows += [(100 + 9 * n + t, " x ".join(w for w in ws if w not in own[t]), "en", "s", 1) for n in range(3) for t, ws in texts.items()]
    rows += [(999, " ordinary words ".join([*rare, isc]), "en", "s", 1)]
    found = license_index.scan(docs(spark, rows))
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[0]["labels"] == got[999]["labels"] == "isc" and got[999]["score"] == pytest.approx(1)
    con = duckdb.connect()
    documents = docs(spark, rows).toPandas()  # noqa: F841  (DuckDB finds it by name)
    sql = con.execute(f"SELECT * FROM ({ORACLE['op10_license_index']})").fetchall()
    assert as_bag(found.columns, [tuple(r) for r in found.collect()]) == as_bag([c[0] for c in con.description], sql)


# ---- the pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages, now = [], table
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF_SMALL)
        path = workspace_path(spark, "brute")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        stages.append(now.collect())
    letters = [r for r in table.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert sorted(r["doc_id"] for r in stages[0]) == sorted(r["doc_id"] for r in letters)
    assert all(s[0].asDict().keys() == set(table.columns) for s in stages[:4])
    assert len(stages[1]) == len(stages[0]) and all(r["n_chars"] == len(r["text"]) for r in stages[1])
    roots = brute_components([brute_fingerprint(r["text"]) for r in stages[1]])
    least = {}
    for r, c in zip(stages[1], roots, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(least.values())
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))) + " "
    wins = set()
    for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect():
        w = norm(r["text"]).split()
        wins |= {" " + " ".join(w[i:i + 10]) + " " for i in range(max(1, len(w) - 9))}
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(r["doc_id"] for r in stages[2] if not any(x in norm(r["text"]) for x in wins))
    tokens = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stages[3])
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stages[4])
    assert 0.3 * tokens < taken <= 0.6 * tokens and {r["epoch"] for r in stages[4]} <= {1, 2, 3}
    assert sorted((r["doc_id"], r["epoch"]) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted((r["doc_id"], r["epoch"]) for r in stages[4])


def test_held_out_rule(spark):
    from provenance_spark.llm.common import held_out
    frame = spark.range(200).withColumn("h", held_out(F.col("id"), 5, 0))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in frame.collect())


@pytest.mark.parametrize("limit", [0, 1 << 18])
def test_warc_copies_are_the_same_broadcast_or_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(warc_zdict, "MAX_COPIES", limit)
    rows = [(5, "u", "a"), (2, "u", "a"), (9, None, "b"), (None, "v", "b"), (4, "w", None), (3, "w", ""), (3, "w", ""), (7, "x", "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    planned = warc_zdict.plan_records(frame, "page_id", "url", "html")
    assert ("strategy=broadcast" in planned._jdf.queryExecution().analyzed().toString()) == (limit > 0)
    got = sorted(((r["id"], r["first"], None if r["payload"] is None else bytes(r["payload"])) for r in planned.collect()), key=repr)
    want = [(5, 2, None), (2, None, b"a"), (9, None, b"b"), (None, 9, None), (4, 3, None), (3, None, b""), (3, None, b""), (7, None, b"c")]
    assert got == sorted(want, key=repr)
