import hashlib
import html as entities
import io
import os
import re

import pytest
from pyarrow import fs

from sharegate.llm import html_text, queries, warc
from sharegate.llm.common import shared_folder

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header>
<nav><a href=/a>A</a></nav><div class="cookie-notice">We use cookies and more cookies on this page</div>
<div id="wrap"><div class="col-8 content"><h2>Head &amp; line</h2><p>One <b>two</b>
 three<p>Four &eacute;&#33; <a href="#">link</a> five<br>six.<div class="ad">buy buy buy</div><ul><li>a<li>b</ul><script>var x="</p><p>no"</script>
<!-- <p>hidden</p> --><table><tr><td>x<td>y</table></div><div class="sidebar-right"><p>side side side side</p></div></div>
<section id="comments"><p>A comment that is much longer than anything else on this page, indeed, much much longer, to win</p></section>
<form><input value=q>Find</form><footer>foot</footer></body></html>"""


def test_page_text():
    page = html_text.Page(PAGE)
    assert page.text(None) == "Head & line\nOne two three\nFour é! link five six.\na\nb\nx\ny"
    assert html_text.Page("").text(None) == "" and html_text.Page("just  text").text(None) == "just text"
    assert html_text.Page("<article>a<p>b &amp c <i").text(None) == "a\nb & c"
    assert html_text.Page("<div>" * 3000 + "deep").text(None) == "deep"
    deep = html_text.Page("<div class='a'><form><label>x</label></i></ul><p>t" * 20_000)  # long and deep pages take linear time and memory
    assert len(deep.nodes) == 60_001 and max(len(n[1]) for n in deep.nodes) < 3000


def test_titles_leads_and_parts_beside_the_best_container_stay():
    of = lambda n: " ".join(["text"] * n)
    page = lambda x: html_text.Page(f"<html><body><div class='teaser'><p>{of(5)} out</p></div>{x}</body></html>").text(None)
    assert page(f"<article><h1>title</h1><p>lead</p><div class='body'><p>{of(85)}</p></div></article>") == f"title\nlead\n{of(85)}"
    assert page(f"<div id='wrap'><p>{of(55)}</p><div class='text'>{of(45)}</div></div>") == f"{of(55)}\n{of(45)}"
    assert page(f"<div id='a'><div><h1>title</h1></div><div class='b'><div class='story'>{of(90)}</div></div></div>") == f"title\n{of(90)}"
    assert page(f"<div id='a'><section><p>{of(9)}</p></section><section><p>{of(90)}</p></section></div>") == f"{of(9)}\n{of(90)}"
    assert page(f"<div id='a'><blockquote>said</blockquote><div class='text'>{of(90)}</div></div>") == f"said\n{of(90)}"


def test_layout_words_do_not_drop_the_article():
    story = "<p>" + "a long story " * 20 + "</p>"
    for tag in ("main class='content has-sidebar'", "div class='content no-sidebar'", "article class='post comments-open'", "article class='post category-social'",
                "div class='page-with-header'", "article data-role='share'", "div data-id='banner'", "div class='page layout-social'", "div class='banner-page'"):
        name = tag.split()[0]
        page = html_text.Page(f"<body><div class='sidebar'><p>side</p></div><{tag}>{story}<div class='share-box'>share</div></{name}></body>")
        assert page.text(None) == ("a long story " * 20).strip(), tag
    page = html_text.Page(f"<body><div class='post'>{story}</div><div id='comments'>{story}{story}</div><div role='complementary'>{story * 9}</div></body>")
    assert page.text(None) == ("a long story " * 20).strip()


def test_articles_inside_forms_and_headers():
    story = "a long story " * 20
    of = lambda x: html_text.Page(f"<html><body><nav><a href=/>home</a></nav>{x}<footer>foot</footer></body></html>").text(None)
    assert of(f"<form id=f><div class=content><h1>Title</h1><p>{story}</p></div></form>") == f"Title\n{story.strip()}"
    assert of(f"<table><tr><td><form><p>{story}</p><label>Name <input></label></form></td></tr></table>") == story.strip()
    assert of(f"<form><fieldset><p>{story}</p></fieldset></form>") == story.strip()
    assert of(f"<dialog open><article><p>{story}</p></article></dialog>") == story.strip()
    assert of(f"<div class=post><p>{story}</p><form><p>Your name and {story[:60]}</p><textarea>x</textarea></form></div>") == story.strip()
    assert of(f"<div class=post><p>short</p></div><form><label>Your name</label><p>mail us at once</p></form>") == "short"
    assert of(f"<article><header><div><h1>Title</h1><p>by me</p></div><nav><h2>On this page</h2></nav></header><p>{story}</p></article>") == f"Title\n{story.strip()}"


def test_stray_quotes_in_tags():
    of = lambda x: html_text.Page(f"<html><body>{x}</body></html>").text(None)
    assert of("""<p class="x"">one</p><p>two</p>""") == "one\ntwo"
    assert of("""<p title=it's>don't <b class='y'>lose</b> this</p><p>that's all</p>""") == "don't lose this\nthat's all"
    assert of("""<p title = "a > b" data-x='>'>one<!--> two<!-- > --> <i class=a"b>three</p>""") == "one two three"
    assert of("<p>one</p><p title='never closed>two</p>") == "one\ntwo"
    assert of("<title-bar>bar</title-bar><p a=b=c>one</p>") == "bar\none"
    assert html_text.Page("<p " + "a='x\" =" * 200_000 + ">late").text(None) == "late"


def test_what_readers_wrote_goes():
    story, note = "<p>" + "a long story " * 20 + "</p>", "<p>I do not agree</p>"
    for name in ("feedback", "user-posts", "userPosts", "reader-opinions", "talkback", "discussion", "post-responses"):
        page = html_text.Page(f"<body><div class='post'>{story}<div class='{name}'>{note}</div></div><div id='{name}'>{note}</div></body>")
        assert page.text(None) == ("a long story " * 20).strip(), name
    assert html_text.Page(f"<body><div class='user-content'>{story}</div></body>").text(None) == ("a long story " * 20).strip()


def test_two_layouts_of_a_host(spark):
    story = lambda i: f"<p>{'a long article text ' * 20}{i}</p>"
    first = lambda i: f"<html><body><div class='txt'>{story(i)}</div></body></html>"
    second = lambda i: f"<html><body><div class='txt'><p>short teaser</p></div><article class='long'>{story(i)}</article></body></html>"
    rows = [(i, "http://h.example/", first(i) if i < 12 else second(i)) for i in range(18)] + [(3, "http://h.example/", first(3)), (20, "http://h.example/", second(20) * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).collect())
    text = lambda i: f"{'a long article text ' * 20}{i}"
    assert got[:19] == sorted([(i, text(i)) for i in range(18)] + [(3, text(3))])
    assert got[19][0] == 20 and got[19][1] == "\n".join([text(20)] * 300)
    paths = html_text.host_paths(df).collect()
    assert len(paths) == 1 and [(p.path, p.votes) for p in paths[0].paths] == [("/html/body/div.txt", 13), ("/html/body/article.long", 6)]


def test_host_consensus_beats_an_odd_page(spark):
    body = lambda art, other: f"<html><body><div class='txt'>{art}</div><div class='teaser{len(art) % 7}'>{other}</div></body></html>"
    rows = [(i, f"http://h.example/{i}", body("<p>" + "long article text " * 20 + f"{i}</p>", "<p>next</p>"), "x") for i in range(5)]
    rows += [(9, "http://h.example/9", body("<p>short</p>", "<p>" + "a teaser that is longer " * 9 + "</p>"), "x"), (10, None, None, "x"), (11, "http://other/", "<p>free", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got[9] == ("short", 5) and got[10] == ("", 0) and got[11] == ("free", 4) and got[3][0].endswith("text 3")
    assert html_text.main_text(df.limit(0)).count() == 0


def test_main_text_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def _pages(spark):
    long = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(5, "http://b.example.com:80/x?y", long), (2, "http://a.example.com/\n", long), (9, "http://a.example.com/", long), (7, None, None), (None, "http://z/", ""),
            (3, "nohost", "short"), (4, "http://a.example.com/", "short"), (2, "http://a.example.com/\n", long), (None, "u", "y" * 150)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, archive string, digest string")


@pytest.mark.parametrize("ranged", [True, False])
def test_archives_and_index(spark, monkeypatch, ranged):
    if not ranged:
        monkeypatch.setattr(warc, "file_system", lambda *_: None)
    rows, df = _pages(spark)
    archives, index = shared_folder(spark), shared_folder(spark)
    warc.write_archives(df, archives)
    warc.write_index(spark, archives, index)
    asked = df.select(warc.capture_key(warc.clean_url(df.url), df.page_id).alias("key"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in warc.read_captures(warc.lookup(asked, index), archives).collect()), key=repr)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and "é" in h and i != 2
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None, None if revisit else h or ""))
    assert got == sorted(want, key=repr)
    missing = spark.createDataFrame([("zz)/ 1",), ("",)], "key string")
    assert warc.lookup(missing, index).count() == 0


def test_lookups_read_ranges(spark):
    """A capture of a long archive costs its own bytes and a buffer, and the index scan skips long bodies."""
    df = spark.createDataFrame([(i, f"http://h/{i}", chr(97 + i) * 3_000_000) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    archives, index = shared_folder(spark), shared_folder(spark)
    warc.write_archives(df, archives)
    system, folder = warc.file_system(spark, archives)
    names = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if "/part-" in f.path]
    reads = []

    class Counted(io.FileIO):
        def readinto(self, buffer):
            reads.append(super().readinto(buffer))
            return reads[-1]

    seen = [(at, n) for name in names for at, n, _ in warc.records(io.BufferedReader(Counted(name), warc.GAP_BYTES))]
    assert len(seen) == 6 and sum(reads) < 7 * warc.GAP_BYTES
    warc.write_index(spark, archives, index)
    asked = df.where("page_id IN (1, 4)").select(warc.capture_key(df.url, df.page_id).alias("key"))
    got = {r.page_id: r.html for r in warc.read_captures(warc.lookup(asked, index), archives).collect()}
    assert got == {i: chr(97 + i) * 3_000_000 for i in (1, 4)}


def test_runs():
    gap, most = warc.GAP_BYTES, warc.RUN_BYTES
    near = [("a", 0, 10), ("a", 14, 10), ("a", 24 + gap, 5)]
    ranges = [*near, ("a", 30 + 2 * gap + 1, 1), ("b", 0, most + 7), ("b", most + 11, 3)]
    assert list(warc.runs(ranges)) == [near, ranges[3:4], ranges[4:5], ranges[5:]] and list(warc.runs([])) == []


def test_many_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i % 40}", f"page {i}") for i in range(1500)], "page_id long, url string, html string")
    archives, index = shared_folder(spark), shared_folder(spark)
    monkeypatch.setattr(warc, "PART_LINES", 400)
    warc.write_archives(df, archives)
    warc.write_index(spark, archives, index)
    assert spark.read.parquet(index).select("part").distinct().count() > 1
    asked = df.where("page_id % 7 = 0").select(warc.capture_key(warc.clean_url(df.url), df.page_id).alias("key"))
    assert sorted(r.page_id for r in warc.read_captures(warc.lookup(asked, index), archives).collect()) == list(range(0, 1500, 7))


def test_no_pages(spark):
    df = _pages(spark)[1].limit(0)
    archives, index = shared_folder(spark), shared_folder(spark)
    warc.write_archives(df, archives)
    warc.write_index(spark, archives, index)
    asked = df.select(warc.capture_key(warc.clean_url(df.url), df.page_id).alias("key"))
    assert warc.read_captures(warc.lookup(asked, index), archives).count() == 0
