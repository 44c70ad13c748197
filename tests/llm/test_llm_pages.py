"""HTML extraction and WARC: planted pages, damaged archives, odd rows."""

from __future__ import annotations

import gzip
import hashlib
import re
from html import unescape

from helpers import by_id

from vectable.llm import html, warc
from vectable.llm.queries import op1, op2

PAGES = "page_id long, url string, html string"


def test_main_text_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Head</header><nav><ul><li><a>Home</a><li>More</ul></nav><div class="ad banner">Buy</div><!-- <p>no</p> -->
    <article><h1>A &amp; B</h1><p>One <b>two</b>
      three<br>four<p>Five&nbsp;&#233;<aside>Side</aside><form>Form<button>Go</button></form><section id="comments"><p>Nice!</p></section>
    <ul><li>x<li>y</ul></article><div id="sidebar">Bar</div><footer>Foot</footer></body>"""
    assert html.main_text(page) == "A & B\nOne two three four\nFive é\nx\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""
    assert html.main_text("</div></p>plain <a href='x>y'>link</a>") == "plain link"
    assert html.main_text("<p>" * 3000 + "deep") == "deep"
    assert html.main_text("<div class='post'><p>a</p>b</div>") == "a\nb"


def test_names_that_only_look_like_furniture():
    kept = [
        "<body class='no-sidebar'><article><p>Text</p></article></body>",
        "<html class='no-footer'><body><article><p>Text</p></article></body></html>",
        "<article class='post comments-open'><p>Text</p></article>",
        "<article class='widget-post'><p>Text</p></article>",
        "<body class='has-sidebar widget'><main class='banner'><p>Text</p></main></body>",
        "<article><section id='notice-of-meeting'><p>Text</p></section></article>",
        "<article><section class='related-work'><p>Text</p></section></article>",
        "<article><div class='banner-story'><p>Text</p></div></article>",
        "<div class='widget-area'><main><p>Text</p></main></div><div>Outside</div>",
        "<div class='widget-area'><article><p>Text</p><div class='ad'>Buy</div></article></div>",
        "<div class='sidebar'><article>Teaser</article></div><div><p>Text</p></div>",
    ]
    assert [html.main_text(page) for page in kept] == ["Text"] * len(kept)
    gone = "ad ads-top ad-slot main-nav nav-primary site-footer cookie-notice sidebar left-sidebar-inner comment comment-12 comments-list comment-author related share-bar navbar2".split()
    for name in gone:
        assert html.main_text(f"<article><p>Text</p><div class='x {name} y'><p>Out</p></div></article>") == "Text", name
    assert html.main_text("<aside class='x'><article>Out</article></aside><p>Text</p>") == "Text"


def test_tree_removes_what_all_pages_of_a_host_share(spark):
    rows = [
        (n, f"https://Site.example/{n}", f"<body><div class='top'>All topics, all days</div><div class='post'><p>Story {n} is new</p></div><div class='x'>Call us</div></body>")
        for n in range(8)
    ]
    rows += [(50, "http://one.example/", "<body><div class='top'>All topics</div><p>Alone</p></body>"), (51, None, None), (52, "::", "")]
    pages = spark.createDataFrame(rows + rows[:1], PAGES).selectExpr("*", "1 as text", "2 as host", "3 as _extra")
    got = html.extract(pages)
    assert set(got.columns) == {"page_id", "url", "text", "host", "_extra"}
    text = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 12
    assert all(text[n] == f"Story {n} is new" for n in range(8))
    assert (text[50], text[51], text[52]) == ("All topics\nAlone", "", "")
    tree = {(r.host, r.path): r for r in html.site_style_tree(pages).collect()}
    shared, own = tree["site.example", "#>body>div.top"], tree["site.example", "#>body>div.post>p"]
    assert shared.importance < 0.1 and own.importance > 0.8
    assert html.extract(pages.limit(0)).count() == 0


def test_tree_judges_nodes_inside_an_article(spark):
    page = "<article><h1>Title {0}</h1><p>Story {0}</p><div class='box'>Get our letter</div></article><p>Outside {0}</p>"
    rows = [(n, f"http://large.example/{n}", page.format(n)) for n in range(12)]
    rows += [(20 + n, f"http://small.example/{n}", page.format(n)) for n in range(3)]
    rows += [(40, "http://large.example/x", "<article><div class='box'>Get our letter</div></article><p>Only here</p>")]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [text[n] for n in range(12)] == [f"Title {n}\nStory {n}" for n in range(12)]
    assert [text[20 + n] for n in range(3)] == [f"Title {n}\nStory {n}\nGet our letter" for n in range(3)]
    assert text[40] == "Only here"


def test_copies_of_a_page_count_once(spark):
    page = "<div class='post'><p>Story</p></div>"
    rows = [(n, "http://two.example/a", page) for n in range(2)]
    rows += [(10 + n, f"http://many.example/{n}", f"<div class='top'>Topics</div><div class='post'><p>Copied story</p></div><!-- {n} -->") for n in range(40)]
    rows += [(60 + n, f"http://many.example/{n}", f"<div class='top'>Topics</div><div class='post'><p>Story {n}</p></div>") for n in range(6)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    text = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert text[0] == text[1] == "Story"
    assert {text[10 + n] for n in range(40)} == {"Copied story"} and [text[60 + n] for n in range(6)] == [f"Story {n}" for n in range(6)]
    assert {r.pages for r in html.site_style_tree(pages).filter("path = '#>div.post>p'").collect()} == {1, 7}


def test_html_query(spark, sf_dir):
    pages = by_id(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    for r in op1(spark, sf_dir).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def record(payload: bytes, name="<urn:page:1>", digest=None) -> bytes:
    digest = digest or hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    return head.encode() + b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_salvage_of_plain_records():
    good = [record(b"first"), record(b"WARC/1.0\r\nnot a record"), record(b"")]
    found = list(warc.salvage(b"".join(good)))
    assert [f["payload"] for f in found] == [b"first", b"WARC/1.0\r\nnot a record", b""]
    bad = [b"junk" + good[0], good[0][:-9], record(b"x", digest="0" * 40), good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), b"WARC/1.0\r\nA: b\r\n\r\n"]
    for piece in bad:
        found = list(warc.salvage(good[1] + piece + good[2] + b"tail"))
        gaps = [f for f in found if "gap_bytes" in f]
        kept = [f["payload"] for f in found if "gap_bytes" not in f]
        assert kept[0] == b"WARC/1.0\r\nnot a record" and kept[-1] == b"" and gaps[-1]["gap_bytes"] == 4
        assert sum(g["gap_bytes"] for g in gaps) + sum(len(record(k)) for k in kept) == len(good[1] + piece + good[2]) + 4
    assert list(warc.salvage(b"")) == []
    assert [f["gap_bytes"] for f in warc.salvage(b"nothing")] == [7]


def test_salvage_of_members():
    packed = [gzip.compress(record(bytes([65 + n]) * 2000), mtime=0) for n in range(5)]
    broken = bytearray(packed[2])
    broken[30] ^= 255
    content = packed[0] + packed[1][:-7] + bytes(broken) + packed[3] + b"\0" * 5 + packed[4]
    found = list(warc.salvage(content))
    assert [f["payload"][:1] for f in found if "gap_bytes" not in f] == [b"A", b"D", b"E"]
    assert [f["gap_bytes"] for f in found if "gap_bytes" in f] == [len(packed[1]) - 7 + len(broken), 5]
    assert [f["start"] for f in found][0] == 0
    both = list(warc.salvage(gzip.compress(record(b"p") + record(b"q"))))
    assert [f["payload"] for f in both] == [b"p", b"q"]


def test_archives_of_odd_rows(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a b/\r\nX: y", long), (5, None, long), (5, "u", long), (3, "", None), (None, "u", "x"), (9, "u", "WARC/1.0\r\n\r\n"), (2, "u", "x")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as size", "3 as payload")
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_archives(pages, path, compression=compression)
        got = warc.read_archives(spark, path).collect()
        assert all(r.reason is None for r in got) and len(got) == 7
        first = [r for r in got if r.record_id == "<urn:page:1>"][0]
        assert (first.record_type, first.refers_to, first.payload_bytes, first.uri) == ("revisit", "<urn:page:5>", 1200, "http://a%20b/%20%20X:%20y")
        assert sorted(r.record_type for r in got if r.record_id == "<urn:page:5>") == ["response", "response"]
        assert {r.record_id: r.payload_bytes for r in got}["<urn:page:3>"] == 0
    warc.write_archives(pages.limit(0), str(tmp_path / "empty"))
    assert warc.read_archives(spark, str(tmp_path / "empty")).count() == 0


def test_address_of_any_length(spark, tmp_path):
    url = "data:text/html," + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "<p>one</p>"), (2, "u", "y" * 2000), (3, url, "y" * 2000)], PAGES)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_archives(pages, path, compression=compression)
        got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
        assert len(got) == 3 and all(r.reason is None for r in got.values())
        assert got["<urn:page:1>"].uri == got["<urn:page:3>"].uri == url
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nA: " + b"x" * 100_000
    found = list(warc.salvage(cut + record(b"after")))
    assert [f.get("gap_bytes") or f["payload"] for f in found] == [len(cut), b"after"]


def test_warc_query(spark, sf_dir):
    pages = by_id(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    best = {}
    for i, p in sorted(pages.items()):
        best[p.html] = i
    got = op2(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        raw = pages[r.page_id].html.encode()
        chosen = best[pages[r.page_id].html] if len(raw) >= 1000 else r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if chosen == r.page_id else ("revisit", chosen))
