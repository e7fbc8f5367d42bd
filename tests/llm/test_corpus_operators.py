"""Operators 5 to 10 and the pipeline against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DATA
from tidemark.llm import components, flac, golay, html_text, language, media, mixing, packing, simhash

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 5000), (5, "der die das und " * 400), (5, "der die das und " * 400), (None, "a b c"), (6, "漢字 😀 é" * 50), (7, "Von."), (8, "von.")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("fp", "key", "component_id", "ids", "start", "length", "media", "pcm", "place", "position")})


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# -- 5 --
@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": (i + 1) ** 0.5 for i in range(20)}, {"x": 0.99, "y": 0.01}, {"only": 1}])
def test_schedule_deviates_less_than_a_block(weights):
    whole, period = mixing.shares(weights)
    assert sum(whole.values()) == period and min(whole.values()) >= 1
    done = Counter()
    for slot, (source, k, release, deadline, at) in enumerate(mixing.schedule(whole, period)):
        assert at == slot and release <= slot < deadline and k == done[source]
        done[source] += 1
        assert all(abs(done[s] - whole[s] * (slot + 1) / period) < 1 for s in whole)
    assert done == whole


def test_mix_numbers_every_row_once(spark):
    rows = [(i % 40, f"t{i}", "hot" if i % 3 else f"s{i % 7}" if i % 2 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("slot", "block", "position", "place")})
    found = mixing.mix(df, block_rows=4).collect()
    assert len(found) == 900 and len({r.position for r in found}) == 900
    for s, n in Counter(r[2] for r in rows).items():
        places = sorted(r.block for r in found if r.source == s)
        assert Counter(places) == Counter(i // 4 for i in range(n))
    assert all(r.release <= r.slot < r.deadline for r in found)
    half = mixing.mix(df, horizon=50, block_rows=4).collect()
    assert {r.position for r in half} == {r.position for r in found if r.slot < 50}
    assert mixing.mix(df.limit(0)).count() == 0


def test_op5(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()
    sizes = Counter(r.source for r in docs)
    total = sum(n**0.7 for n in sizes.values())
    found = mixing.op5_source_mixing(spark, DATA).collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter((r.doc_id, r.source) for r in docs)
    # Brute force: at each slot, of the blocks that are released, the one whose deadline is next; ties by source.
    whole, period = mixing.shares({k: n**0.7 / total for k, n in sizes.items()})
    assert all(abs(whole[k] / period - n**0.7 / total) < 0.01 for k, n in sizes.items())
    done, expected = Counter(), {}
    for slot in range(period):
        free = [s for s in whole if done[s] * period // whole[s] <= slot]
        s = min(free, key=lambda s: (-(-(done[s] + 1) * period // whole[s]), s))
        expected[s, done[s]] = slot
        done[s] += 1
    for s, n in sizes.items():
        own = sorted((r for r in found if r.source == s), key=lambda r: r.position)
        for i, r in enumerate(own):
            rounds, k = divmod(i // mixing.BLOCK_ROWS, whole[s])
            slot = expected[s, k] + rounds * period
            assert (r.block, r.slot, r.position) == (i // mixing.BLOCK_ROWS, slot, slot * mixing.BLOCK_ROWS + i % mixing.BLOCK_ROWS)
            assert (r.release, r.deadline) == (r.block * period // whole[s], -(-(r.block + 1) * period // whole[s]))


# -- 6 --
def test_piece_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        got = packing.piece_lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got) and got == sorted(got, reverse=True)


def test_op6_gives_each_id_once(spark, documents, odd):
    by = {}
    for r in packing.op6_packing(spark, DATA).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(documents)
    for i, text in documents.items():
        ids = np.array([*TOKENIZER.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset, 1 << r.bucket) == (at, len(ids), 0, r.length)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    every = [r.sequence_id for rows in by.values() for r in rows]
    assert len(set(every)) == len(every)
    pieces = packing.default_pack(odd)
    assert pieces.where("doc_id = 1").select("start", "length", "doc_tokens").collect() == [(0, 1, 1)]
    assert pieces.where("doc_id = 5").count() == 2 * len(packing.piece_lengths(pieces.where("doc_id = 5").first().doc_tokens))
    assert packing.default_pack(odd.limit(0)).count() == 0


# -- 7 --
def simhash_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """The smallest member of each fingerprint's component, by comparing all pairs."""
    own, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i] ^ own[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(own))]


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    own = golay.keys(words)
    assert set((own >= 0).sum(1)) <= {1, 6}
    for errors in (1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, errors, replace=False)) for _ in words])
        for a, b in zip(own, golay.keys(words ^ flips)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_every_link_has_a_common_key():
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 800)
    for errors in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in base], np.uint64).view(np.int64)
        sides = []
        for fps in (base, base ^ flips):
            key, row = simhash.keys(fps[:, None])
            own = [set() for _ in fps]
            for k, r in zip(key, row):
                own[r].add(k)
            sides.append(own)
        assert all(a & b for a, b in zip(*sides))


def wide_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh3_128_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) >> 36


def test_wide_fingerprints_and_keys():
    rng = random.Random(4)
    for text in ("", " ", "One", "one two three four", "one two three four five six", " ".join(rng.choice("abcdefgh") for _ in range(300))):
        p, q = simhash.fingerprint(text, simhash.WIDE)
        assert p << 28 | q == wide_of(text)
    base = [rng.getrandbits(92) for _ in range(300)]
    for errors in (0, 5, 8):
        sides = []
        for fps in (base, [x ^ sum(1 << b for b in rng.sample(range(92), errors)) for x in base]):
            key, row = simhash.keys(np.array([[x >> 28, x & (1 << 28) - 1] for x in fps], np.uint64).view(np.int64))
            own = [set() for _ in fps]
            for k, r in zip(key, row):
                own[r].add(k)
            sides.append(own)
        assert all(a & b for a, b in zip(*sides))


def test_wide_scheme_finds_near_copies(spark):
    """Pairs by the 5-word likeness that a few changed words leave: nearly all from 0.9 on, no unlike ones."""
    rng = random.Random(6)
    rows, likeness = [], {}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for i in rng.sample(range(200), rng.choice([1, 2, 3, 4, 60])):
            other[i] = f"x{k}"
        a, b = grams(words), grams(other)
        likeness[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.WIDE).collect()}
    linked = {k: found[2 * k + 1] == 2 * k for k in likeness}
    near = [k for k, v in likeness.items() if v >= 0.9]
    assert sum(linked[k] for k in near) >= 0.95 * len(near) > 100
    assert not any(linked[k] for k, v in likeness.items() if v < 0.5)
    assert all(found[2 * k] == 2 * k for k in likeness)


@pytest.mark.parametrize("bucket_rows", [25, 100_000])
def test_links_give_all_components(spark, bucket_rows):
    rng = np.random.default_rng(5)
    fps = set()
    for b in rng.integers(0, 1 << 63, 20).tolist():
        for _ in range(60):
            fps.add(b ^ sum(1 << int(q) for q in rng.choice(64, rng.integers(0, 6), replace=False)))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_rows)).collect()
    root = {r.node: r.root for r in found}
    assert [root.get(x, x) for x in signed] == [signed[i] for i in classes([x & (1 << 64) - 1 for x in signed])]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_rounds_keep_small_plans(spark):
    """What Spark takes a table's size to be doubled its digits in every round, until they filled the driver."""
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


def test_op7(spark, documents, odd):
    ids = sorted(documents)
    fps = [simhash_of(documents[i]) for i in ids]
    expected = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(spark, DATA).collect()} == expected
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.fp == 0} == {1} and {r.component_id for r in found if r.doc_id in (7, 8)} == {7}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# -- 8 --
PAGE = """<html><body class="home"><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies</p></div><div id="wrap"><div class="menu"><a href=x>Home</a></div>
<div class="content post-12"><h2>Title &amp; more</h2><p>First para with <a href=y>link</a> and<br>break here.<p>Second<ul><li>one<li>two</ul><div class="ad-slot">BUY</div>
<script>x<y</script><!-- no --><div class=comments><p>Nice post</p></div></div><aside>side</aside></div><form><input><p>mail</p></form><footer>&copy;</footer>"""


def test_extraction_of_an_unknown_template():
    assert html_text.vote(PAGE)[0] == ">body.home>div>div.content.post-#"
    assert html_text.extract(PAGE, None) == "Title & more\n\nFirst para with link and break here.\n\nSecond\n\none\n\ntwo"


def test_host_paths_win_over_a_page(spark):
    """A page whose sidebar is larger than its article is put right by its host's other pages."""
    page = lambda a, b: f'<body><div class="story">{"<p>" + a + "</p>"}</div><div class="extra">{"<p>" + b + "</p>"}</div></body>'
    rows = [(i, "http://h.example/p%d" % i, page("story " * 30, "x")) for i in range(5)] + [(9, "http://h.example/9", page("short story", "noise " * 50)), (10, None, None), (11, "http://k.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    for few in (0, 100):
        found = {r.page_id: r.text for r in html_text.main_texts(df, few).collect()}
        assert found[9] == "short story" and found[10] == "" and found[11] == "" and len(found) == 8
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<", "<a", "<p", "</", "<p>x", "a < b > c", "<script>", "<!--", "<div " + 'a="' * 500, "<b>" * 5000, "<div>" * 2000 + "x", "&amp;&#10;&nosuch;", "<td>a<td>b", "x" * 100_000])
def test_extraction_of_broken_pages(page):
    assert isinstance(html_text.extract(page, None), str)


def test_op8_reads_the_articles(spark):
    import html as H
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html_text.op8_html_extraction(spark, DATA).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        parts = [" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


SAYS = lambda word, n: f"{word} is what this part of the page says. " * n


@pytest.mark.parametrize("inner", ["div class=body", "blockquote", "section"])
def test_title_lead_and_closing_stay(spark, inner):
    page = f"<body><header>site</header><article><h1>Title</h1><p>{SAYS('lead', 1)}</p><{inner}><p>{SAYS('body', 30)}</p></{inner.split()[0]}><p>{SAYS('end', 1)}</p></article><footer>f</footer></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    expected = ["Title", SAYS("lead", 1).strip(), SAYS("body", 30).strip(), SAYS("end", 1).strip()]
    assert {r.text for r in html_text.main_texts(df).collect()} == {"\n\n".join(expected)}


def test_a_page_of_another_template_keeps_its_article(spark):
    usual = lambda i: f'<body><div class="story"><p>{SAYS("story", 20 + i)}</p></div></body>'
    other = f'<body><div class="story">Read on</div><div class="essay"><p>{SAYS("essay", 20)}</p></div></body>'
    df = spark.createDataFrame([(i, f"http://h.example/{i}", usual(i)) for i in range(5)] + [(9, "http://h.example/9", other)], "page_id long, url string, html string")
    for few in (0, 100):
        assert SAYS("essay", 20).strip() in {r.page_id: r.text for r in html_text.main_texts(df, few).collect()}[9]


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "layout-sidebar-right", "page--nav-open", "content-with-ads", "cookie-page"])
def test_layout_wrappers_keep_their_article(name):
    page = f'<body><div class="{name}"><div class="post"><h2>T</h2><p>{SAYS("post", 9)}</p></div><div class="sidebar">noise here</div><div class="comments"><p>{SAYS("comment", 12)}</p></div></div></body>'
    assert html_text.extract(page, None) == f"T\n\n{SAYS('post', 9).strip()}"


ARTICLE = f"<article><h1>Title</h1><p>{SAYS('story', 9)}</p>%s</article>"


@pytest.mark.parametrize(
    "inner, kept",
    [
        ('<div class="related-work"><p>Earlier work on this.</p></div>', "Earlier work on this."),
        ('<p class="share-price">The price rose.</p>', "The price rose."),
        ('<section id="search-theory"><p>We search.</p></section>', "We search."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>", "Let x=1 hold."),
        ("<p>See <button>Copy</button>this line.</p>", "See this line."),
        ('<div class="post-comments"><p>First!</p></div><div class="ad-slot-3">BUY</div><div class="newsletter-box">mail</div>', None),
        ("<p>It's <b title=don't>Bob's</b> <img alt='a > b' src=x> line.</p>", "It's Bob's line."),
        ("<p>A <img src=" + "x" * 6000 + "> picture.</p>", "A picture."),
        ('<p>An <i title="open>odd</i> quote.</p>', "An odd quote."),
    ],
)
def test_articles_keep_what_is_theirs(inner, kept):
    text = html_text.extract(f"<body><nav><a href=/>Home</a></nav>{ARTICLE % inner}<footer>f</footer></body>", None)
    assert text == "\n\n".join(["Title", SAYS("story", 9).strip(), *([kept] if kept else [])])


def test_an_unclosed_link_ends_with_its_block():
    page = f"<body><div class=menu><a href=/>Home<a href=/x>News</div><div class=list><a href=/1>One</a><a href=/2>Two</a></div>{ARTICLE % ''}</body>"
    assert html_text.extract(page, None) == f"Title\n\n{SAYS('story', 9).strip()}"
    page = f"<body><p><a href=/>Home<p><a href=/x>News {'' }</p>{ARTICLE % '<p>See <a href=/y>this</a>.</p>'}</body>"
    assert html_text.extract(page, None).endswith("See this.")


def test_long_class_lists_keep_their_containers_apart():
    long = lambda i: " ".join(f"utility-{c}{c}{c}-{'abcdefghijkl'[i]}" for c in "abcdefghij")
    deep = "".join(f'<div class="{long(i)}">' for i in range(12))
    listing = "".join(f'<p><a href="/{i}">{SAYS("listing", 1)}</a></p>' for i in range(20))
    page = f'<body>{deep}<div class="story"><p>{SAYS("story", 30)}</p></div><div class="listing">{listing}</div>{"</div>" * 12}</body>'
    assert html_text.extract(page, None) == SAYS("story", 30).strip()


def test_long_paths_differ():
    long = " ".join(f"utility-class-{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    page = f'<body class="{long}"><div class="{long}"><div class="story"><p>{SAYS("story", 9)}</p></div><div class="extra"><p>{SAYS("extra", 9)}</p></div></div></body>'
    paths = [p for p, _ in html_text.blocks(page)[1]]
    assert len(set(paths)) == len(paths) and max(map(len, paths)) <= html_text.PATH_CHARS
    assert html_text.extract(page, paths[-2]) == SAYS("story", 9).strip()


# -- 9 --
def test_op9_accuracy_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = language.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    assert sum(r.rejected for r in found) < 0.01 * len(found)


def test_language_of_odd_rows(spark, odd):
    train = spark.createDataFrame([(i, "the and of with that this" if i % 2 else "der die das und nicht ein", "en" if i % 2 else "de") for i in range(50)] + [(90, None, "fr"), (91, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert {k for k, _ in model.dictionaries} == {"en", "de"}
    found = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == "und" and found[1].score == 0 and found[1].rejected
    assert found[5].lang_pred == "de" and not found[5].rejected
    twice = language.predict(language.predict(odd, model), model)
    assert twice.columns == language.predict(odd, model).columns and twice.count() == len(ODD)
    assert language.predict(odd.limit(0), model).count() == 0
    nothing = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.classify("½ ² 5", language.compressors(model))[0] == "und"


def test_margin_of_a_very_long_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = language.compressors(language.fit(docs, F.col("doc_id") % 2 == 1))
    text = " ".join(r.text for r in docs.where("lang = 'en' and doc_id % 2 = 0").orderBy("doc_id").collect() if r.text) * 2
    short, long = language.classify(text[:300_000], by), language.classify(text, by)
    assert len(text) > 1_000_000 and short[0] == long[0] == "en" and long[1] > 0.75 * short[1]


@pytest.mark.parametrize("lang", ["de", None])
def test_samples_of_one_id_are_bounded(spark, lang):
    """All rows of a language under one id, or none; repeated rows; ids don't decide alone which rows are learned from."""
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice("der die das und nicht ein mit sich auf".split()) for _ in range(30))
    for doc_id in (1, 2, 3, None):
        rows = [(doc_id, say(), "de") for _ in range(1500)] + [(5, "the same text again", "en")] * 3000 + [(i, "le la les et dans", lang) for i in range(20)]
        model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=64)
        sizes = {k: len(v) for k, v in model.dictionaries}
        assert set(sizes) == {"de", "en"} and sizes["de"] > 3000 and sizes["en"] == len("the same text again")


def test_excerpts_come_from_the_whole_text(spark):
    rows = [(i, "a" * 5000 + "bcd " * 5000, "x") for i in range(60)]
    (_, content), = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).dictionaries
    assert content.count(b"bcd") > 10_000 and b"aaaa" in content


def test_answers_are_those_of_direct_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.predict(docs.limit(80), model).collect()}
    for r in docs.limit(80).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert found[r.doc_id].lang_pred == "und"
            continue
        raw = " ".join("".join(c if c.isalpha() else " " for c in r.text.lower()).split(" ")).encode()
        raw = b" ".join(raw.split()) if not r.text[0].isspace() and r.text[-1].isalpha() and r.text[0].isalpha() else language.normalise(r.text)
        raw += bytes(256)
        size = {}
        for lang, content in model.dictionaries:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = sum(len(zstandard.ZstdCompressor(level=6, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + 32768])) for i in range(0, len(raw), 32768))
        best = min(size, key=size.get)
        rest = min(v for k, v in size.items() if k != best)
        assert found[r.doc_id].score == pytest.approx(1 - size[best] / rest, abs=0.01)
        assert found[r.doc_id].lang_pred == best or rest - size[best] < 5


# -- 10 --
def read_flac(stream):
    """A plain decoder, bit by bit, that needs no seek table: (samples as bytes, the subframes' kinds)."""
    assert stream[:4] == b"fLaC"
    at, last, total = 4, False, 0
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(stream[at + 4 + 10 : at + 4 + 18], "big") & (1 << 36) - 1
        at += 4 + size
    out, kinds = [], []
    while len(out) < total:
        bits = int.from_bytes(stream[at : at + 3000].ljust(3000, b"\0"), "big")
        pos = 0

        def take(n):
            nonlocal pos
            pos += n
            return bits >> (24000 - pos) & ((1 << n) - 1)

        def signed(n):
            v = take(n)
            return v - (1 << n) if v >> (n - 1) else v

        assert take(14) == 0x3FFE and take(2) == 0 and take(4) == 2 and take(4) == 4 and take(4) == 0 and take(3) == 1
        take(1)
        lead = take(8)
        for _ in range({0: 0, 6: 1, 14: 2, 30: 3}[lead >> 7 and next(lead >> s for s in (5, 4, 3) if lead >> s in (6, 14, 30))]):
            take(8)
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        kinds.append(kind)
        if kind == 0:
            x = [signed(8)] * 576
        elif kind == 1:
            x = [signed(8) for _ in range(576)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            coefficients, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order] if kind < 32 else None, 0
            if kind >= 32:
                width = take(4) + 1
                shift = signed(5)
                coefficients = [signed(width) for _ in range(order)]
            method, parts = take(2), take(4)
            for p in range(1 << parts):
                k = take(4 + method)
                for _ in range((576 >> parts) - (order if p == 0 else 0)):
                    q = 0
                    while not take(1):
                        q += 1
                    u = q << k | (take(k) if k else 0)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coefficients, reversed(x[-order:]))) >> shift if order else 0))
        at += (pos + 7) // 8 + 2
        out += x
    return bytes(v + 128 for v in out), kinds


def test_flac_round_trip():
    rng = random.Random(1)
    wave = bytes(int(128 + 100 * np.sin(i / 20)) for i in range(576 * 20))
    bursts = bytes(int(128 + (100 if i // 144 % 2 else 3) * np.sin(i / 3)) for i in range(576 * 4))
    payloads = [media.filled(x) for x in (b"", b"a", rng.randbytes(5000), b"abc" * 4000, bytes([0, 255] * 576), bytes(576), wave, ("é漢" * 9000).encode(), bursts)]
    streams = flac.encode(payloads)
    assert [s for s, _ in flac.decode(streams)] == payloads
    plain = [read_flac(s) for s in streams]
    assert [p for p, _ in plain] == payloads
    seen = {k for _, kinds in plain for k in kinds}
    assert {0, 1, 31 + flac.LPC_ORDER} <= seen and seen & {8, 9, 10, 11, 12}
    assert len(streams[6]) < 0.6 * len(wave)
    for start, n in ((0, 1), (575, 2), (5000, 1200), (len(wave) - 3, 10)):
        assert flac.read_samples(streams[6], start, n) == wave[start : start + n]


def test_many_frames_and_long_numbers(monkeypatch):
    payload = os.urandom(576 * 2100)
    stream = flac.encode([payload])[0]
    assert flac.decode([stream])[0][0] == payload
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2097152, 67108864):
        data, sizes = flac.encode_frames(np.zeros((1, 576), np.uint8), np.array([n]))
        assert flac.decode_frames(np.frombuffer(data, np.uint8), np.array([0]), sizes, np.array([n])).tobytes() == bytes(576)


def test_damage_is_found():
    stream = flac.encode([media.filled(b"some text " * 300)])[0]
    for at in range(len(stream) - 400, len(stream), 37):
        with pytest.raises(ValueError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 8]) + stream[at + 1 :]])


def test_op10(spark, documents):
    for r in media.op10_media_columns(spark, DATA).collect():
        raw = documents[r.doc_id].encode()
        payload = media.filled(raw)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        stream = flac.encode([payload])[0]
        if len(payload) < 20_000:
            assert read_flac(stream)[0] == payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        x = [v - 128 for v in payload]
        energy = [sum(v * v for v in x[i : i + 576]) for i in range(0, len(x), 576)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"n={len(x)};energy={sum(energy)};loudest={max(energy)};quietest={min(energy)};low={min(x)};high={max(x)};crossings={crossings}"
        assert [p.sample_offset for p in r.points] == list(range(0, len(payload), 576))
        begin = flac.layout(stream)[0]
        assert all(stream[begin + p.media_offset : begin + p.media_offset + 2] == b"\xff\xf8" for p in r.points)


def test_media_blocks(spark, odd):
    stored = media.encode_media(odd.select("doc_id", "media", "pcm", F.lit(1).alias("feature"), F.col("text").cast("binary").alias("payload")))
    decoded = media.decode_media(stored)
    assert decoded.count() == len(ODD) and media.decode_media(stored.limit(0)).count() == 0
    blocks = media.pcm_blocks(decoded).where("doc_id = 4").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == media.filled(b"x" * 5000) and [b.sample_offset for b in blocks] == list(range(0, 5184, 576))


# -- pipeline --
def wide_classes(fps, bits):
    """The first members of the components of all pairs within so many bits."""
    root = list(range(len(fps)))
    for j in range(len(fps)):
        for i in range(j):
            if (fps[i] ^ fps[j]).bit_count() <= bits and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


def test_pipeline_dedup_tells_rows_apart_by_id_and_text(spark):
    import corpus_pipeline as P

    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    rows = [(5, b), (1, a), (5, a), (5, b), (None, c), (7, None), (8, " ")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in order], "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.withColumns({n: F.lit("clash") for n in ("_key", "fp", "component_id")})
        kept = P.drop_near_duplicates(spark, docs, DATA)
        assert kept.columns == P.COLUMNS
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (5, b), (None, c), (7, None)]))


def test_pipeline_stages_against_brute_force(spark, documents, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == P.COLUMNS
    ids = {n: sorted({r.doc_id for r in rows}) for n, rows in kept.items()}
    assert len(ids["language_id"]) > 0.99 * len(documents)
    fps = [wide_of(documents[i]) for i in ids["language_id"]]
    first = lambda bits: {ids["language_id"][i] for i in wide_classes(fps, bits)}
    assert first(13) <= set(ids["near_dedup"]) <= first(8)
    assert ids["secret_scan"] == ids["near_dedup"] and not any("token = \"" in r.text for r in kept["secret_scan"])
    assert set(ids["source_mix"]) <= set(ids["near_dedup"]) and ids["packing"] == ids["source_mix"]
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"])
    assert P.run(spark, DATA).count() == len(kept["packing"])


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    import corpus_pipeline as P

    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD] + [(20, "the of and", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, docs in enumerate((odd, odd.limit(0))):
        for name, stage in P.STAGES:
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")


def test_pipeline_mix_keeps_every_document_in_order(spark, tmp_path):
    """A source far beyond its weight, and many small ones with short last blocks."""
    import corpus_pipeline as P

    rows = [(i, f"t{i}", "en", "hot" if i < 700 else f"s{i % 60}", 2) for i in range(1000)] + [(1000, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    P.mix_sources(spark, docs, DATA).write.parquet(f"{tmp_path}/mix")
    files = sorted(f for f in os.listdir(f"{tmp_path}/mix") if f.endswith(".parquet"))
    found = [i for f in files for i in pq.read_table(f"{tmp_path}/mix/{f}")["doc_id"].to_pylist()]
    assert sorted(found) == list(range(1001))
    assert found == [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]


def test_pipeline_gives_the_ids_by_length(spark, tmp_path):
    import corpus_pipeline as P

    texts = {1: "one two three " * 900, 2: "", 3: "漢字 😀 é" * 50}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    P.pack_documents(spark, docs, DATA).write.parquet(f"{tmp_path}/stage")
    found = spark.read.parquet(f"{tmp_path}/stage").collect()
    for i, text in texts.items():
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
        assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    for f in os.listdir(f"{tmp_path}/stage"):
        if f.endswith(".parquet"):
            lengths = pq.read_table(f"{tmp_path}/stage/{f}")["length"].to_pylist()
            assert lengths == sorted(lengths)
    pieces = P.pack_documents(spark, docs, DATA)
    back = packing.write_buckets(pieces, f"{tmp_path}/buckets")
    assert {d for d in os.listdir(f"{tmp_path}/buckets") if "=" in d} == {f"bucket={r.length.bit_length() - 1}" for r in found}
    assert back.dtypes == pieces.dtypes and sorted(back.collect()) == sorted(pieces.collect())
    assert packing.write_buckets(pieces.limit(0), f"{tmp_path}/none").count() == 0
