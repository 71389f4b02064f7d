"""Each text operator against brute force, an exact round trip or held-out labels, and on odd tables."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from jobweave.llm import avi, brown, decontaminate, html_text, licenses, minhash, packing, quality, suffix, warc
from jobweave.llm import queries as registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score int, kept string, key string, n int, w string"
WORDS = "the of and river stone light under seven old makes all rights reserved cc by general public license".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.randint(20, 120))) for _ in range(8)]
    texts = [None, "", " \n\t", "x", "Two words", "a" * 700, "\x00\x01 é 日本 " * 30, "long " * 6000]
    while len(texts) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        texts.append(" ".join(w) if rng.random() < 0.7 else rng.choice(base))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z") for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """The exchange of words ends early, but where a test asks for more."""
    monkeypatch.setattr(brown, "SETTLED", 0.5)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_grouping_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(1, rng.choice((1, 2, 5))) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.grouping_suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


ODD = [(None, "a b c"), (1, "x y " * 90), (1, "x y " * 90), (1, "z y " * 90), (None, "x y " * 90), (None, "q " + "z y " * 90), (2, None), (2, ""), (None, None), (7, "z y " * 40), (7, "end"), (1, "a b c")]


def order_of(row):
    """Documents come by doc_id, those without one last, and then by their digests."""
    return row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).hexdigest()


def removed(texts):
    seen, out = set(), []
    for i, t in sorted(texts, key=order_of):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def dedup_rows(docs):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs).collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK", 1 << 14)
    assert dedup_rows(docs) == removed(corpus())


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_of_repeated_and_missing_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    assert dedup_rows(spark.createDataFrame(ODD, "doc_id long, text string")) == removed(ODD)


def test_suffix_sort_decides_every_removal(docs, monkeypatch):
    """In text order instead of the order that the grouping gives, no copies go, only runs of one word."""
    monkeypatch.setattr(suffix, "grouping_suffix_array", lambda s: list(range(len(s))))
    rows = [("k", i, 0, 0, (t or "").encode()) for i, t in corpus() if len(t or "") >= 100]
    assert {rows[k][1] for k, _, _ in suffix.repeats(rows)} <= {5, 6, 7}
    monkeypatch.undo()
    assert {rows[k][1] for k, _, _ in suffix.repeats(rows)} == {i for i, n, gone, *_ in removed(corpus()) if gone}


def test_windows_that_share_a_key_are_told_apart(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)).encode() for _ in range(6)]
    want = [a.tolist() for a in suffix.repeated_windows([*texts, *texts[:2]])]
    monkeypatch.setattr(suffix, "mix64", lambda x: x & np.uint64(1))
    assert [a.tolist() for a in suffix.repeated_windows([*texts, *texts[:2]])] == want


def near(texts, width):
    sets = {i: minhash.shingle_set(t, width) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(minhash.near_duplicates(docs, width)).items()}
    assert got == near(corpus(), width)


@pytest.mark.parametrize("block", [minhash.BLOCK, 1])
def test_near_duplicates_across_small_blocks(docs, monkeypatch, block):
    """With blocks of one document all meetings of blocks take place."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(minhash.near_duplicates(docs, 2)).items()}
    assert got == near(corpus(), 2)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue black white"
    rows = spark.createDataFrame([(5, a), (5, b), (5, a), (None, a + " x"), (None, "only this here"), (9, b.upper()), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows, 2).collect()), key=str)
    assert got == sorted([(5, 9, 5, True), (5, 4, 5, True), (5, 9, 5, True), (None, 10, 5, False), (None, 2, None, True), (9, 4, 5, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    left = sorted((tuple(r) for r in minhash.one_of_each(rows, 2).collect()), key=str)
    assert left == sorted([(5, a), (5, b), (None, "only this here"), (None, None), (3, "")], key=str)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rows = sorted(packing.packed(docs, path).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    end, last = 0, None
    for r in rows:
        end = 0 if r["sequence_id"] != last else end
        assert r["offset"] == end and r["length"] + end <= packing.LIMIT
        end, last = end + r["length"], r["sequence_id"]
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for i, t in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k): (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) == math.ceil(sum(r["length"] for r in rows) / packing.LIMIT)


def test_swaps_empty_bins():
    for sizes, places in (([6, 4, 4, 6], [0, 1, 1, 2]), ([5, 5, 8, 2, 1, 4, 5], [0, 0, 1, 1, 2, 2, 3]), ([6, 3, 8, 1, 2], [0, 0, 1, 1, 2])):
        found = packing.searched(sizes, places, 10)
        assert len(set(found)) == math.ceil(sum(sizes) / 10) and max(np.bincount(found, sizes)) <= 10


def test_swap_search_saves_bins_on_corpus_lengths(spark):
    """The first placement alone needs more sequences than the lengths allow; the search ends at the least number and at a greater squared fill."""
    rows = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), packing.tokenizer_path()).select("length").collect()
    sizes = [r[0] for r in rows]
    first = packing.first_places(sizes, packing.LIMIT)
    found = packing.searched(sizes, first, packing.LIMIT)
    least = math.ceil(sum(sizes) / packing.LIMIT)
    assert len(set(found)) <= least + 1 < len(set(first)) and packing.squared_fill(sizes, found) > packing.squared_fill(sizes, first)
    assert max(np.bincount(found, sizes)) <= packing.LIMIT


def test_media_round_trip(docs):
    rng = np.random.default_rng(3)
    units = np.concatenate([rng.integers(0, 256, (40, 192)), np.full((2, 192), 255), rng.integers(0, 2, (9, 192)) * 255]).astype(np.uint8)
    assert (avi.decoded(avi.frames_of(avi.avi(avi.coded(units)))) == units).all()
    got = by_id(avi.features(docs))
    for i, t in corpus():
        n, load = avi.payload(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]))
    clips = avi.clips(avi.media(docs)).collect()
    assert sum(c["n_frames"] for c in clips) == sum(len(avi.payload(t)[1]) // 192 for _, t in corpus())


def test_shots_find_a_cut():
    units = np.concatenate([np.full((20, 192), 40), np.full((20, 192), 200)]).astype(np.uint8)
    assert avi.shots(units)[0] == [0, 20]


def test_html():
    page = '<nav><a href=/>m n o p</a></nav><article><header><h1>Head</h1></header><p>one&nbsp;two <b>th</b>ree<div class="ad">buy</div><p>four five &lt;x&gt;<script>var a="<p>z</p>"</script></article><div class="comments"><p>nice one</div>'
    assert html_text.main_text(page) == "Head one two three four five <x>"
    assert [html_text.main_text(x) for x in (None, "", "<p", "<nav>a b</nav>", "plain words here")] == ["", "", "", "", "plain words here"]


@pytest.mark.parametrize("wrapper", ['<div class="content-wrapper has-sidebar">', '<div id="page" class="header-fixed">', '<div class="has-sidebar"><div id="no-ads" class="sticky-header">'])
def test_html_wrappers_named_as_boilerplate(wrapper):
    page = '<body><div class="nav"><a href="/">n o</a></div><article><h1>Head</h1><p>one two three four five six seven</p><div class="ad">buy</div></article><div class="comments"><article><p>nice one</p></article></div></body>'
    wrap = lambda page: page.replace("<body>", "<body>" + wrapper).replace("</body>", "</div>" * wrapper.count("<div") + "</body>")
    assert html_text.main_text(page) == html_text.main_text(wrap(page)) == "Head one two three four five six seven"
    pages = ["".join(f for f, _ in p) for p in html_text.labelled_pages(150, seed=5)]
    named = [p for p in pages if "<article" in p or "<main" in p]
    assert np.mean([html_text.main_text(wrap(p)) == html_text.main_text(p) != "" for p in named]) > 0.75


def test_html_scan_chooses_the_region():
    """On unseen labelled pages: the run with the greatest sum against all words that are likelier article."""
    weights, pages = html_text.learned(), html_text.labelled_pages(120, seed=99)

    def right(scan):
        total = 0
        for page in pages:
            want = "".join(re.sub(r"</?(b|a|i|em|small|span)\b[^>]*>", "", f) if inside else " " for f, inside in page)
            total += html_text.main_text("".join(f for f, _ in page), weights, scan) == " ".join(re.sub("<[^>]*>", " ", want).split())
        return total / len(pages)

    assert right(True) > 0.65 and right(False) < 0.4


def test_html_keeps_all_article_text():
    body = "<p data-x=don't>It is one and two.</p><p>more <math><mi>x</mi></math> of it</p><noscript><p>no script here at all</p></noscript><object><p>inside of an object</p></object>"
    more = '<section class="related-work"><h2>Related work</h2><p>others made it under the old light of the river</p></section><section class="legal story"><p>of the law and of the seven rivers</p></section>'
    text = "It is one and two. more x of it no script here at all inside of an object Related work others made it under the old light of the river of the law and of the seven rivers"
    page = f'<nav><ul><li><a href="/">n</a></li></ul></nav><article><h1>Head of it</h1>{body}{more}<form><label>name</label><button>send</button></form></article><footer>the end</footer>'
    assert html_text.main_text(page) == "Head of it " + text


def test_html_on_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (2, None, "<article>" + "<p>word</p>" * 20_000), (3, "u", "\x00<p")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"][:9], r["n_chars"]) for r in html_text.extract(pages).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "word word", 99_999), (3, "u", "\x00", 1)], key=str)


def test_warc_links_records():
    raw = warc.response(1, "http://a/b", '<html lang="en"><head><title>T &amp; t</title></head><body>Hi<p>you <a href="/x">there</a></body>')
    source, _, _, body = warc.parsed(raw)
    meta, text = warc.derived(raw)
    assert meta[2] == text[2] == source["warc-record-id"] and meta[1] != text[1]
    assert text[12] == "Hi\nyou there" and "outlink: /x L a/@href" in meta[12] and "title: T & t" in meta[12]
    assert text[7] == warc.digest(body) and text[9] == warc.digest(text[12].encode()) and b"WARC-Refers-To: " + source["warc-record-id"].encode() in text[11]
    assert warc.derived(None)[0][0] == "invalid" and warc.derived(raw[:-30] + b"x" * 30)[0][0] == "invalid"


def test_warc_links_and_payload_digests():
    page = '<a data-href="/wrong" href="/right"><a title="href=\'/no\'" HREF=/two><area href=\'/three\'><link rel=x href="/css"><a name=n><abbr href="/never">'
    assert list(warc.outlinks(page)) == [("a", "/right"), ("a", "/two"), ("area", "/three"), ("link", "/css")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    for given, want in ((warc.digest(b"<p>hi"), True), (warc.digest(b"other"), False), ("md5:x", None), (None, None)):
        head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")] + [("WARC-Payload-Digest", given)] * (given is not None)
        assert [r[17] for r in warc.derived(warc.record(head, block))] == [want, want]


def crawled(body, *http):
    block = "".join(f"{x}\r\n" for x in ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=latin-1", *http, "")).encode("latin-1") + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Warcinfo-ID", "<urn:x:0>"), ("WARC-Block-Digest", warc.digest(block))], block)


def test_warc_keeps_source_headers(spark):
    raw = crawled(b"<p>hi", "Set-Cookie: a=1", "Last-Modified: today", "Set-Cookie: b=2")
    source, _, _, _ = warc.parsed(raw)
    rows = warc.derivatives(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "page_id long, record binary")).collect()
    assert [r["record_type"] for r in rows] == ["metadata", "conversion", "invalid"]
    for r in rows[:2]:
        assert [tuple(x) for x in r["http_headers"]] == [("Content-Type", "text/html; charset=latin-1"), ("Set-Cookie", "a=1"), ("Last-Modified", "today"), ("Set-Cookie", "b=2")]
        assert [x["name"] for x in r["warc_headers"]] == ["WARC-Type", "WARC-Record-ID", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Block-Digest", "Content-Length"]
        assert r["source_block_digest"] == source["warc-block-digest"] and r["body_error"] is None
    for line in ("source-http-header: Set-Cookie: a=1", "source-http-header: Set-Cookie: b=2", "source-warc-header: WARC-IP-Address: 10.0.0.1", "source-block-digest: " + source["warc-block-digest"]):
        assert f"{line}\r\n" in rows[0]["text"] and f"{line}\r\n".encode() in bytes(rows[0]["record"])


def test_warc_undoes_codings():
    page = "<p>caf\u00e9 and more text</p>".encode("latin-1")
    chunks = lambda b: b"".join(b"%x;x=y\r\n%s\r\n" % (len(b[k : k + 7]), b[k : k + 7]) for k in range(0, len(b), 7)) + b"0\r\n\r\n"
    zipped, raw = gzip.compress(page[:9]) + gzip.compress(page[9:]), zlib.compressobj(wbits=-15)
    chunked, in_gzip, in_deflate = "Transfer-Encoding: chunked", "Content-Encoding: gzip", "Content-Encoding: deflate"
    whole = [
        (page,), (chunks(page), chunked), (zipped, in_gzip), (zlib.compress(page), in_deflate), (raw.compress(page) + raw.flush(), in_deflate), (chunks(zipped), chunked, in_gzip),
        (chunks(zipped), "Transfer-Encoding: gzip, chunked"), (page, chunked, in_gzip), (gzip.compress(zlib.compress(page)), in_deflate, "content-encoding: X-GZIP"),
    ]
    for body, *http in whole:
        text = warc.derived(crawled(body, *http))[1]
        assert (text[12], text[16]) == ("caf\u00e9 and more text", None), http
    broken = [
        (page, "Content-Encoding: br", "", "br: not known"), (zipped[:10] + b"\x07" * 40, in_gzip, "", "gzip: broken"), (b"\xff" * 40, in_deflate, "", "deflate: broken"),
        (chunks(page)[:20], chunked, "caf\u00e9", "chunked: cut"), (chunks(page)[:26], chunked, "caf\u00e9 an", "chunked: cut"), (b"3\r\n<p>\r\n2\r\nabcdef\r\n", chunked, "", "chunked: broken"), (gzip.compress(page)[:-8], in_gzip, "caf\u00e9 and more text", "gzip: cut"),
    ]
    for body, http, want, error in broken:
        meta, text = warc.derived(crawled(body, http))
        assert (text[12], text[16], meta[16]) == (want, error, error) and f"body-error: {error}\r\n" in meta[12]


def test_language_model(docs):
    count = Counter()
    for i, t in corpus():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*brown.words_of(t), brown.END])
    n, v = sum(count.values()), len(count)
    for i, r in by_id(brown.perplexity_scores(docs)).items():
        w = [*brown.words_of(dict(corpus())[i]), brown.END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_language_model_without_listed_words(docs, monkeypatch):
    """With a short list, most words take the way of unlisted ones; base scores stay the same."""
    want = {i: r["base_score"] for i, r in by_id(brown.perplexity_scores(docs)).items()}
    monkeypatch.setattr(brown, "LISTED", 20)
    assert {i: r["base_score"] for i, r in by_id(brown.perplexity_scores(docs)).items()} == pytest.approx(want)



@pytest.mark.parametrize("seed", [3, 4])
def test_brown_gains_against_recounted_likelihood(seed):
    """Each move of one word changes the recounted likelihood by the difference of its gains."""
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 30, 4000)
    ids = ids[np.r_[True, ids[1:] != ids[:-1]]]
    classes = rng.integers(0, 5, 30)

    def counted(of):
        g = np.zeros((brown.ALL, brown.ALL))
        np.add.at(g, (of[ids[:-1]], of[ids[1:]]), 1)
        return g

    right, left = np.zeros((30, brown.ALL)), np.zeros((30, brown.ALL))
    np.add.at(right, (ids[:-1], classes[ids[1:]]), 1)
    np.add.at(left, (ids[1:], classes[ids[:-1]]), 1)
    g = counted(classes)
    gain = brown.gains(right, left, classes, g, 8)
    assert gain == pytest.approx(brown.gains(right, left, classes, g)[:, :8])
    for w in range(30):
        for c in range(8):
            moved = classes.copy()
            moved[w] = c
            risen = brown.likelihood(counted(moved)) - brown.likelihood(g)
            assert gain[w, c] - gain[w, classes[w]] == pytest.approx(risen, abs=1e-6)


def test_language_model_scores_by_brute_force(docs, monkeypatch):
    """Transitions, emissions and scores from plain counts, given the classes; probabilities after any word sum to one."""
    monkeypatch.setattr(brown, "LISTED", 200)
    m = brown.train(docs)
    number = {w: k for k, w in enumerate(m.listed)}
    of = lambda w: int(m.classes[number[w]]) if w in number else brown.CLASSES + brown.tail_class(w)
    texts = {i: [*brown.words_of(t), brown.END] for i, t in corpus()}
    trained = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in trained for w in t)
    pairs = Counter((of(a), of(b)) for t in trained for a, b in zip([brown.END, *t[:-1]], t, strict=True))
    out_of, in_to = Counter(), Counter()
    for (a, b), n in pairs.items():
        out_of[a] += n
        in_to[b] += n
    share = np.array([in_to[c] for c in range(brown.ALL)]) / sum(in_to.values()) + 1e-6
    share /= share.sum()
    held = Counter()
    for w, c in count.items():
        held[of(w)] += c if w in number else c + 1
    emits = lambda w: count[w] / held[of(w)] if w in number else (count[w] + 1) / (held[of(w)] + 1)
    moves = lambda a, b: (pairs[a, b] + brown.PRIOR * share[b]) / (out_of[a] + brown.PRIOR)
    got = by_id(brown.perplexity_scores(docs))
    for i, t in texts.items():
        want = sum(math.log10(moves(of(a), of(b)) * emits(b)) for a, b in zip([brown.END, *t[:-1]], t, strict=True))
        assert got[i]["score"] == pytest.approx(want), i
    for c in (0, 3, brown.CLASSES + 2):
        known = sum(moves(c, of(w)) * emits(w) for w in count)
        unknown = sum(moves(c, d) / (held[d] + 1) for d in range(brown.CLASSES, brown.ALL))
        empty = sum(moves(c, d) for d in range(brown.CLASSES) if not held[d])
        assert known + unknown + empty == pytest.approx(1)


def test_exchange_raises_the_likelihood(docs, monkeypatch):
    monkeypatch.setattr(brown, "SETTLED", 0.01)
    risen = brown.train(docs).risen
    assert len(risen) > 2 and all(b >= a for a, b in zip(risen, risen[1:])) and risen[-1] > risen[0]


def test_language_model_counts_repeated_rows(spark):
    rows = [(1, "a b a zz"), (1, "a b a zz"), (1, "a b"), (None, "a zz"), (None, "a zz"), (4, None)]
    got = brown.perplexity_scores(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")).collect()
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 or i is None for w in [*brown.words_of(t), brown.END])
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got if r["doc_id"]) == [(1, 3, sum(count[w] > 0 for w in (b"a", b"b", brown.END))), *[(1, 5, 1 + sum(count[w] > 0 for w in (b"a", b"b", b"a", b"zz")))] * 2, (4, 1, 1)]
    assert len({r["score"] for r in got if r["n_tokens"] == 5}) == 1


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(registry.op10_compression_quality(spark, sf))
    marks = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"quality": "min"}).collect()
    right = [got[m[0]]["predicted"] == m[1] for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert np.mean(right) >= 0.9


def test_quality_sees_differences_alone(spark):
    """Texts of equal differences get equal scores; without dictionaries all texts get one score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries, curve = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    idle = quality.scored(docs, ["doc_id"], ([(b, b) for _, b in dictionaries], curve))
    assert idle.select("score").distinct().count() == 1
    assert len(curve) == len(quality.LEVELS) + 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    show = lambda f: sorted(tuple("" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float | int) else str(x) for x in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert show(got) == show(want)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short one"), (3, None), (4, ""), (5, "a b c d e f g")], "item_id long, text string")
    texts = ["x ALPHA beta, gamma delta epsilon zeta eta theta iota kappa y", "alpha beta gamma delta epsilon zeta eta theta iota no", "a short  one here", "alpha beta gamma delta epsilon zeta", None, ""]
    rows = by_id(decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items))
    assert [rows[k]["item_ids"] for k in range(6)] == ["1", "1", "2", "", "", ""]  # 6 of 6, 5 of 6 and 2 of 6 shingles
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_of_odd_rows(spark, monkeypatch, bound):
    """Rows that share an id are judged each; nulls, a very long text, repeated items and clashing columns; sent to all executors or shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    items = spark.createDataFrame([(1, item, "a"), (1, "quite another text of one two three", "b"), (1, item, "c"), (None, item, "d"), (2, "two words", "e")], "item_id long, text string, n string")
    texts = [(7, " ".join(item.split()[:9])), (7, " ".join(item.split()[5:])), (7, f"x {item} y"), (None, item), (None, None), (8, "w " * 300_000 + item), (8, "Quite another text of one two three"), (9, "some two words"), (9, "some two words")]
    docs = spark.createDataFrame([(*t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id int, need string")
    got = sorted(((r["doc_id"], r["item_ids"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()), key=str)
    assert got == sorted([(7, "", 0), (7, "", 0), (7, "1", 1), (None, "1", 1), (None, "", 0), (8, "1", 1), (8, "1", 1), (9, "2", 1), (9, "2", 1)], key=str)
    kept = decontaminate.without_items(docs, items)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [0, 1, 4]


def test_licenses_and_quality_on_odd_rows(spark):
    texts = [(None, None), (None, "All rights reserved"), (1, "all rights reserved"), (1, "all rights reserved"), (2, "x " * 300_000 + "cc by"), (2, "")]
    docs = spark.createDataFrame([(*t, "a", 3) for t in texts], "doc_id long, text string, label string, score int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(None, 0, 0, ""), (None, 3, 1, "reserved"), (1, 3, 1, "reserved"), (1, 3, 1, "reserved"), (2, 300_002, 1, "cc-by"), (2, 0, 0, "")], key=str)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "y"), (None, 0, 0, "z")], "doc_id long, quality int, toxic int, label string")
    assert quality.scores(docs, labels).count() == 6 and all(0 <= r[0] <= 1 for r in quality.scores(docs, labels).select("score").collect())
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_licenses_across_lines(spark):
    """Every template broken after any three words, far inside a text, and wordings with a word missing or too many missing."""
    filler = " ".join(f"w{k}" for k in range(400))
    texts, want = [], []
    for label, text in licenses.TEMPLATES:
        w = text.split()
        for before in (0, 13, 31, 50, 390):
            notice = "\n * ".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3))
            texts.append(" ".join(filler.split()[:before]) + "\n" + notice + "\n" + filler)
            want.append((label, 1.0))
    mit = next(t for _, t in licenses.TEMPLATES if t.startswith("permission is hereby granted free of charge to any person obtaining"))
    texts += ["\n".join(mit.replace("hereby ", "").split()), "\n".join(mit.replace("hereby granted free ", "").split())]
    want += [("mit", 14 / 15), ("", 0.0)]
    assert all(len(t.split()) <= licenses.BLOCKS[1] // 2 for _, t in licenses.TEMPLATES)
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, (label, score) in enumerate(want):
        assert (label in got[k]["labels"].split(",")) and got[k]["score"] == pytest.approx(score), (k, texts[k][:200])
    line = "\n".join([*("x" * 3 for _ in range(40)), " ".join(f"y{k}" for k in range(47)) + " " + mit])
    assert by_id(licenses.scan(spark.createDataFrame([(0, line)], "doc_id long, text string")))[0]["labels"] == "mit"


def test_every_operator_takes_an_empty_table(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [minhash.near_duplicates(nothing), suffix.dedup(nothing), brown.perplexity_scores(nothing), packing.packed(nothing, packing.tokenizer_path()), avi.features(nothing)]
    made += [licenses.scan(nothing), decontaminate.contamination(nothing, items), quality.scores(nothing, labels), html_text.extract(pages), warc.derivatives(warc.responses(pages))]
    assert [m.count() for m in made] == [0] * 10


def test_rows_with_null_ids_and_repeats(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert avi.features(rows).count() == licenses.scan(rows).count() == brown.perplexity_scores(rows).count() == quality.scores(rows, labels).count() == 4
    assert suffix.dedup(rows).count() == minhash.near_duplicates(rows).count() == 4
    assert packing.packed(rows, packing.tokenizer_path()).count() == 4


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pipeline_stages_keep_rows_with_repeated_and_missing_ids(spark):
    """Each stage on rows that share or lack an id, on texts that are null, empty or whole copies, and on clashing columns."""
    import corpus_pipeline as p

    one, two = "the river of stone and light was under seven old trees by the open water today", "others made a quite different text of many more words that nobody had read before now"
    texts = [(5, one), (5, two), (None, one + " x"), (None, "some words of its own"), (None, None), (8, ""), (6, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], PIPELINE)
    made = p.near_duplicate_stage(spark, docs, SF)
    assert made.schema.names == docs.schema.names and rows_of(made) == rows_of(docs.where("text is null or text in ('', 'some words of its own') or doc_id = 5"))
    passage = " ".join(f"passage{k}" for k in range(30))
    texts = [(5, "first text with " + passage), (5, passage + " ends the other"), (None, "no id but " + passage + " and more"), (None, "short"), (7, passage), (7, passage), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), t, 1) for i, t in texts], PIPELINE + ", kept string, row int")
    got = {(r["doc_id"], r["kept"]): (r["text"], r["n_chars"]) for r in p.suffix_stage(spark, docs, SF).collect()}
    order = sorted(texts, key=order_of)
    assert len(got) == 5 and (7, passage) not in got and got[9, None] == (None, 0) and got[None, "short"] == ("short", 5)
    first = next(t for t in order if t[0] == 5)
    assert got[first] == (first[1], len(first[1]))
    for key in ((5, texts[0][1]), (5, texts[1][1]), (None, texts[2][1])):
        if key != first:
            assert "passage15" not in got[key][0] and got[key][1] == len(got[key][0])
    labels = p.quality_stage(spark, docs, SF)
    assert labels.columns == docs.columns
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(5, item, "en", "s", 1), (5, "clean words", "en", "s", 1), (None, "x " + item, "en", "s", 1), (None, None, "en", "s", 0)], PIPELINE)
    assert rows_of(p.decontamination_stage(spark, docs, SF)) == rows_of(docs.where("text is null or text = 'clean words'"))
    assert p.packing_stage(spark, docs, SF).count() == 4


def test_pipeline_stages_take_an_empty_table(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], PIPELINE), SF).count() == 0, name


def test_pipeline_against_brute_force(spark):
    """Every stage's rows and texts from its own input, worked out plainly but for the classifier's scores and the tokenizer's ids."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"]: r["score"] for r in quality.scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    now = stages["quality classifier"](spark, docs, SF).checkpoint()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in texts.items() if scored[i] >= 0.7}
    assert {r["doc_id"]: r["text"] for r in now.collect()} == left and 0 < len(left) < len(texts)
    groups = near(list(left.items()), 5)
    left = {i: t for i, t in left.items() if groups[i][2]}
    now = stages["MinHash near-dedup"](spark, now, SF).checkpoint()
    assert {r["doc_id"]: r["text"] for r in now.collect()} == left
    seen, cut = set(), {}
    for i in sorted(left):
        raw = (left[i] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(raw[at : at + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g).decode(errors="ignore")
        if kept.strip() or not gone.any():
            cut[i] = kept
    now = stages["suffix-array dedup"](spark, now, SF).checkpoint()
    assert {r["doc_id"]: r["text"] or "" for r in now.collect()} == cut and all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] != left[r["doc_id"]])
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        items.append({tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set())
    clean = {}
    for i, t in cut.items():
        w = words(t)
        shingles = {k: {tuple(w[at : at + k]) for at in range(len(w) - k + 1)} for k in range(1, 6)}
        if not any(item and 100 * len(item & shingles[len(next(iter(item)))]) >= 80 * len(item) for item in items):
            clean[i] = t
    now = stages["benchmark decontamination"](spark, now, SF).checkpoint()
    assert {r["doc_id"]: r["text"] or "" for r in now.collect()} == clean
    placed = stages["best-fit packing"](spark, now, SF).collect()
    ran = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, placed)) == sorted(map(key, ran)) and {r["doc_id"] for r in placed} == set(clean)
