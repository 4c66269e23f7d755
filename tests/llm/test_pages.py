"""WARC round trips and main text."""

import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

from quarterglass.llm import main_text as M
from quarterglass.llm import warc
from quarterglass.llm.common import shared_folder


def odd_pages(spark):
    big = "<p>" + "same " * 40 + "</p>"
    rows = [
        (1, "http://www.Example.org:80/a?b=1#f", big, "x"), (2, "https://example.org/a b\tc", big, "x"), (3, None, None, "x"), (4, "", "", None),
        (5, "no url at all", "short", "x"), (6, "http://example.org/", "short", "x"), (7, "http://u:p@münchen.example/ü", "ü\r\n\r\nWARC/1.1\r\n" * 30, "x"),
        (8, "http://example.org/", "ü\r\n\r\nWARC/1.1\r\n" * 30, "x"), (9, "http://example.org/long", "y" * 300_000, "x"), (1, "http://www.Example.org:80/a?b=1#f", big, "x"),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def expected(rows):
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min(j for j, _, h, _ in rows if (h or "") == (html or ""))
        refers = first if len(data) >= 100 and first != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_are_a_round_trip(spark):
    rows, pages = odd_pages(spark)
    found = warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_empty_table_and_null_ids(spark):
    _, pages = odd_pages(spark)
    assert not warc.archive_and_read(pages.limit(0)).collect()
    nulls = pages.withColumn("page_id", F.lit(None).cast("long"))
    assert {r.record_type for r in warc.archive_and_read(nulls.filter("page_id IS NULL").dropDuplicates(["url"])).collect()} == {"response"}


def test_files_are_warc_and_lookups_find_each_capture(spark, tmp_path):
    rows, pages = odd_pages(spark)
    folder = shared_folder(spark, "warc-test")
    captures = warc.write_archives(pages, folder)
    top = warc.write_index(captures, folder, block_lines=2, files=3)
    for c in captures.collect():
        with open(f"{folder}/{c.file}", "rb") as file:
            file.seek(c.at)
            fields, payload = warc.parse(gzip.decompress(file.read(c.bytes)))
        assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest() or fields["warc-type"] == "revisit" and not payload
    known = {(c.key, c.file, c["at"], c.bytes) for c in captures.collect()}
    asked = captures.select("key").union(spark.createDataFrame([("aaa",), ("zzz",), ("org,example)/a 0",)], "key string"))
    assert {tuple(r) for r in warc.lookup(asked, top, folder).select("key", "file", "at", "bytes").collect()} == known


def test_keys(spark):
    rows = [("http://WWW.Example.org:80/A?b#c",), ("https://u@a.b.c:8080",), (None,), ("odd url",)]
    frame = spark.createDataFrame(rows, "url string").select(warc.reversed_host_key(F.col("url"), F.lit(7)).alias("k"))
    tail = " 00000000000000000007"
    assert [r.k for r in frame.collect()] == ["org,example,www)/A?b" + tail, "c,b,a:8080)/" + tail, ")/" + tail, ")odd%20url" + tail]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/x>menu</a></ul></nav><!-- <p>gone</p> --><div class="ad">buy <div>now</div> it</div>
<div class='cookie-notice'>We use cookies</div><aside>side</aside>
<article><header><h1>Head &amp; line</h1></header><p><b>One&nbsp;two
 three<br>four<p>Five<ul><li>six<li>seven</ul><form><input name=q>search</form><p data-x="a>b">eight &lt;tag&gt; &#233;</p>
<div class="shadow loading">nine</div></article>
<section id="comments"><p>first!</p></section><footer>&copy; f</footer></body></html>"""


def test_blocks():
    assert [b for b, _ in M.blocks_of(PAGE)] == ["Head & line", "One two three four", "Five", "six", "seven", "eight <tag> é", "nine"]
    assert M.blocks_of("") == [] and M.blocks_of("plain text < 3 & more") == [("plain text < 3 & more", False)]
    assert M.blocks_of("<nav>menu<article><p>kept") == [("kept", True)] and M.blocks_of("<p hidden>no</p><p>yes") == [("yes", False)]
    assert M.blocks_of("<script>never closed <p>x") == [] and M.blocks_of("<!-- open <p>x") == []


def test_figures_and_math_of_an_article_stay():
    figure = "<figure class=wide><pre>x = 1</pre><table><tr><td>cell</table><img src=a><figcaption>Caption</figcaption></figure>"
    math = "so <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds"
    own = lambda page: [b for b, _ in M.blocks_of(page)]
    assert own(f"<article><p>One{figure}<p>{math}</article><p>after") == ["One", "x = 1", "cell", "Caption", "so a=2 holds", "after"]
    assert own(f"<p>One</p>{figure}<p>{math}") == ["One", "so", "holds"]
    assert own(f"<article><aside>{math}{figure}</aside><p>kept</article>") == ["kept"]


def test_articles_in_dropped_parts_go():
    own = lambda page: [b for b, _ in M.blocks_of(page)]
    comments = "<section id=comments><article class=comment><p>first!</article><article><p>second</article></section>"
    teaser = "<aside><article><h3>teaser</h3></article> more </aside>"
    for page in (f"<article><p>kept</article>{comments}{teaser}<p>end", f"<article><p>kept{comments}{teaser}<p>end</article>", f"<main><p>kept{teaser}{comments}<p>end</main>"):
        assert own(page) == ["kept", "end"]
    assert own("<article><p>kept<article class='comment odd'><p>no<article>nor this</article></article><p>end</article><p>out") == ["kept", "end", "out"]
    assert M.blocks_of("<article><article class=comment>no</article><p>end</article><p>out") == [("end", True), ("out", False)]
    assert own("<article class=sponsored><p>kept<article><p>part</article></article>") == ["kept", "part"]
    assert own("<body><div class=ad>buy <div>now</div><article><p>kept</article></body></div>") == ["kept"]
    assert own("<div class=has-sidebar><main><p>kept</main></div>") == ["kept"] and own("<article><nav>menu<article>x</article></article><p>kept") == ["kept"]


def test_repeated_runs_equal_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(30):
        tokens, page = rng.integers(0, 4, 300), np.repeat(np.arange(10), 30)
        least = rng.integers(2, 4, 300)
        truth = np.zeros(300, bool)
        pages_of = {}
        for at in range(300 - 4 + 1):
            if page[at] == page[at + 3]:
                pages_of.setdefault(tuple(tokens[at : at + 4]), set()).add(page[at])
        for at in range(300 - 4 + 1):
            if page[at] == page[at + 3] and len(pages_of[tuple(tokens[at : at + 4])]) >= least[at]:
                truth[at : at + 4] = True
        assert (M.repeated_runs(tokens, page, 4, least) == truth).all()


def test_template_of_a_host_goes_and_copies_stay(spark):
    notice = " ".join(f"n{i}" for i in range(30))
    rows = [(k, f"http://h.example/{k}", f"<div>{notice}</div><div>own text {k} " + " ".join(f"u{k}x{i}" for i in range(30)) + "</div>") for k in range(12)]
    rows += [(50 + k, f"http://h.example/c{k}", "<div>" + " ".join(f"c{i}" for i in range(40)) + "</div>") for k in range(5)]
    rows += [(90, None, None), (91, "", ""), (92, "http://other.example/", f"<article><p>{notice}</p></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("cell", F.lit(2))
    found = {r.page_id: r.text for r in M.extract(frame).collect()}
    assert all(notice not in found[k] and found[k].startswith(f"own text {k} ") for k in range(12))
    assert all(found[50 + k] == " ".join(f"c{i}" for i in range(40)) for k in range(5))
    assert found[90] == found[91] == "" and found[92] == notice and not M.extract(frame.limit(0)).collect()


def test_groups_of_a_host_do_not_change_its_text(spark):
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = []
    for k in range(60):
        notice = f"<div>{text('rare')}</div>" if k % 20 == 0 else f"<div>{text('two')}</div>" if k % 30 == 1 else ""
        thanks = f"<p>{text('most')}</p>" if k % 3 else f"<p>{text('few')}</p>" if k < 30 else ""
        rows.append((k, f"http://h.example/{k}", f"{notice}<article><p>{text(f'a{k}x')}</p>{thanks}</article><div>{text(f'b{k}x')}</div>"))
    rows += [(100 + k, f"http://h.example/c{k}", f"<script>{k}</script><div>{text('copy')}</div>") for k in range(9)]
    rows += [(200 + k, f"http://h.example/e{k}", None) for k in range(3)] + [(None, "http://h.example/n", f"<div>{text('rare')} and more</div>")] * 2
    rows += [(300, "http://other.example/", f"<div>{text('rare')}</div>"), (301, None, "<p>none")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    one, many = (sorted(map(tuple, M.extract(frame, group_chars=n).collect()), key=str) for n in (4_000_000, 1500))
    assert one == many and len(one) == len(rows)
    found = {r[0]: r[2] for r in many}
    assert not any(text("rare") in found[k] for k in (0, 20, 40, None)) and text("two") in found[1] and text("rare") in found[300]
    assert not any(text("most") in found[k] for k in range(60)) and all(text("few") in found[k] for k in range(0, 30, 3))
    assert all(found[100 + k] == text("copy") for k in range(9))


def test_articles_of_all_pages(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in M.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article)]
        assert found[r.page_id].text == "\n\n".join(filter(None, blocks)) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_parts_of_other_names_stay():
    own = lambda page: [b for b, _ in M.blocks_of(page)]
    for page in (
        '<div class="layout has-sidebar"><article><p>Main text</p></article></div>', "<div id=page class=no-sidebar><article><p>Main text</article></div>",
        '<article><p class="ad-hoc">Main text</p></article>', '<article><div class="search-algorithms">Main text</div></article>',
        '<article><section class="related">Main text</section></article>', '<div class="menu-open"><p>Main text</p></div>', '<p class="adverbs notice-period">Main text',
    ):
        assert own(page) == ["Main text"], page
    assert own("<article><p>press <button>OK</button> or <label>Name</label> now</p></article>") == ["press OK or Name now"]
    for name in ("sidebar", "left-sidebar", "nav-links", "site-footer", "comment-list", "Cookie-Notice", "page ads", "sidebar_left", "advert"):
        assert own(f'<article><p>kept</p><div class="{name}">no</div></article>') == ["kept"], name


def test_odd_pages_take_time_in_proportion():
    import time

    def seconds(page):
        start = time.perf_counter()
        M.blocks_of(page)
        return time.perf_counter() - start

    for part in ("<a b='c ", '<a b="c', "<!x ", "<a 'x>' ", "<p class='ad", "<!-- ", "<script>", "<nav><article>", "<b <i ", "&amp", "<a b='>' c=\"'>"):
        short, long = (min(seconds(part * n) for _ in range(2)) for n in (2_000, 40_000))
        assert long < 60 * max(short, 2e-3), part
    assert M.blocks_of("<p>one <a b='c>two</a> three") == [("one two three", False)] and M.blocks_of("<p title=\"a>b\">x</p> <q") == [("x", False), ("<q", False)]


def test_copies_of_a_page_in_any_task_have_its_text(spark):
    notice, article = " ".join(f"n{i}" for i in range(30)), " ".join(f"c{i}" for i in range(40))
    rows = [(k, f"http://h.example/{k}", f"<script>{k}</script><div>{notice}</div><article>{article}</article>") for k in range(300)]
    rows += [(1000 + k, f"http://h.example/o{k}", f"<div>{notice}</div><article>own {k}</article>") for k in range(5)] + [(None, None, "<p>a")] * 9
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    for chars in (4_000_000, 2_000):
        found = M.extract(frame, group_chars=chars).collect()
        assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
        assert {r.text for r in found} == {article, "a", *(f"own {k}" for k in range(5))}
