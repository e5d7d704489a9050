from pyspark.sql import functions as F

from loomspan.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>
<div class="{box}"><h1>{title}</h1><p>First &amp; <b>bold</b>&nbsp;text<br>goes   on here for a while<p>Second paragraph, unclosed
<script>if (a < b) document.write("</p>");</script><ul><li>one<li>two</ul><div class="ad-slot">Buy now</div></div>
<aside>Other stories and much more text that is not the article, going on and on and on and on</aside>
<div id="comments"><p>{comment}</p></div><form><label>Mail</label><input value="x"></form>
<footer>&copy; 2024</footer></body></html>"""


def page(box="post-12 entry", title="Title", comment="A reader says a lot. " * 40):
    return PAGE.format(box=box, title=title, comment=comment)


def test_main_text():
    assert html.extract(page(), []) == "Title First & bold text goes on here for a while Second paragraph, unclosed one two"


def test_paths_are_generalised():
    assert html.vote(page("post-12 entry"))[0] == html.vote(page("entry post-99"))[0] == "html>body>div.entry.post-N"


def test_odd_markup():
    assert html.extract(None, []) == "" and html.extract("", []) == "" and html.extract("<p>", []) == ""
    assert html.extract("just text", []) == "just text"
    assert html.extract("<p>a<!-- b --><![CDATA[c < d]]>e", []) == "ac < de"
    assert html.extract('<div title="a > b">x</div><p>y &lt;z&gt; &#65;&unknown;', []) == "x y <z> A&unknown;"
    assert html.extract("<table><tr><td>a<td>b<tr><td>c</table>", []) == "a b c"
    assert html.extract("<p>a <a href=x>link</a> b</p><script>x", []) == "a link b"
    assert html.extract('<p>broken <b title="x>y</p>', []) != ""
    assert html.extract("<p>" * 5000 + "deep", []) == "deep"


def test_names_of_layouts_and_of_parts():
    assert html.extract('<div class="layout with-sidebar"><div class="text"><p>The article.</p></div><div class="sidebar">Side</div></div>', []) == "The article."
    assert html.extract('<body><main><p>One.</p><section class="readerComments"><p>Me too!</p></section><div id="newsletter2">Join</div></main>', []) == "One."


def test_host_consensus_beats_one_page(spark):
    """One page of the host has a longer side box; the host's votes still take its article."""
    body = "<html><body><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div></body></html>"
    rows = [(k, "http://www.h.org/x", body.format("long article text " * 20, "short box")) for k in range(30)]
    rows.append((99, "https://h.org/y", body.format("brief article", "a very long side box " * 30)))
    rows.append((100, "http://other.org", "<html><body><main><p>Only this.</p></main></body></html>"))
    rows += [(101, None, None), (102, "no host", "<p>t</p>"), (103, None, "<p>u</p>"), (0, "http://www.h.org/x", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "paths": F.lit(2), "text": F.lit(3)})
    got = {r.page_id: r for r in html.extract_pages(pages).collect()}
    assert got[99].text == "brief article" and got[100].text == "Only this." and got[101].text == "" and got[102].text == "t" and got[103].text == "u"
    assert got[5].n_chars == len(got[5].text) and got[5].text.startswith("long article")
    assert html.extract_pages(pages).count() == len(rows)
    shuffled = html.extract_pages(pages, broadcast_bytes=0)
    assert {r.page_id: r.text for r in shuffled.collect()} == {k: r.text for k, r in got.items()}
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_whole_table_against_the_markup(spark, sf_dir):
    import html as h
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract_pages(pages).collect():
        inner = source[r.page_id].split("<article>")[1].split("</article>")[0]
        want = " ".join(h.unescape(re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want


def test_article_in_several_containers(spark):
    """Without article or main: text in differently classed siblings is taken whole, by the page and by its host."""
    lead, rest, third = "lead words " * 82, "rest of it " * 91, "a third part " * 100
    source = f"<html><body><nav><a href='/'>Home</a></nav><div class='content'><div class='lead'><p>{lead}</p></div><div class='rest'><p>{rest}</p></div>{{}}</div><div class='links'>{'<a href=x>more to read</a> ' * 30}</div></body></html>"
    two, three = source.format(""), source.format(f"<div class='third'><p>{third}</p></div>")
    whole = " ".join(f"{lead}{rest}".split())
    assert html.extract(two, []) == whole and html.extract(three, []) == " ".join(f"{lead}{rest}{third}".split())
    rows = [(k, "http://h.org/", (two, three)[k % 2]) for k in range(10)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == whole and got[1].endswith("third part")
    assert html.extract(two, ["html>body>div.content>div.rest", "html>body>div.content>div.lead"]) == whole


def test_parts_inside_an_article_are_not_judged_by_names_alone():
    whole = html.extract("<body><nav><a href=/>Home</a></nav><article><header><h1>The heading</h1></header><p>Text one.</p><p class='notice'>Important.</p><div class='related-work'><p>Others did this before.</p></div></article><div class='notice'>Elsewhere</div></body>", [])
    assert whole == "The heading Text one. Important. Others did this before."
    linked = html.extract("<article><p>Text one.</p><div class='related'><a href=1>More of this</a> <a href=2>and that</a></div><section class='comments'><p>I like it</p></section><article class='comment'>Me too</article><footer>By me</footer></article>", [])
    assert linked == "Text one."
    plain = "<body><div class='header'>The site</div><div class='content'><p>A long text of the article itself.</p><p class='alert'>Mind the gap.</p></div><div class='share'>Tell your friends about this page</div></body>"
    assert html.extract(plain, []) == "A long text of the article itself. Mind the gap."
    assert html.extract("<body><header><h1>Site</h1></header><main><p>One.</p></main></body>", []) == "One."


def test_forms():
    assert html.extract("<body><form id=aspnet><div class=menu>x</div><div><p>The whole page stands in a form.</p><label>Mail</label></div></form></body>", []) == "The whole page stands in a form."
    assert html.extract("<body><form><article><p>The article in it.</p></article></form><p>Other text that is longer than it</p></body>", []) == "The article in it."
    assert html.extract("<body><div><p>The article, longer than the form.</p><form><p>Search here</p></form></div></body>", []) == "The article, longer than the form."


def test_tags_that_are_not_closed():
    for tag in ("iframe", "textarea", "title", "noframes", "xmp", "noembed"):
        assert html.extract(f"<body><{tag} src=x><article><p>The article.</p></article></body>", []) == "The article.", tag
    for tag in ("script", "style"):
        assert html.extract(f"<body><{tag}>var a = 1;<article><p>The article.</p></article></body>", []) == "The article.", tag
    assert html.extract("<body><iframe>no frames</iframe><article><p>a<script>b</script>c</p></article></body>", []) == "ac"


def test_all_classes_count():
    """Containers that differ in the seventh class only have paths of their own."""
    one, two = ("<body><div class='a b c d e f {}'><p>" + "word " * 50 + "</p></div></body>").format("g"), ("<body><div class='a b c d e f {}'><p>" + "word " * 50 + "</p></div></body>").format("h")
    assert html.vote(one)[0] != html.vote(two)[0]


def test_deep_and_long_pages():
    """50,000 nested containers with text in each, and end tags that close nothing: linear time, with and without paths."""
    import time
    import tracemalloc

    deep = "<body>" + "".join(f"<div class='c{k % 7}'>t{k}</section>" for k in range(50_000))
    began = time.time()
    tracemalloc.start()
    assert html.extract("<p>x" + deep, ["html>body>div.cN", "body>div.cN"]).startswith("t0 t1 ")
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert html.vote(deep) is not None
    assert time.time() - began < 60 and held < 200 << 20
    assert html.extract("<iframe>" * 50_000 + "<p>end", []) == "end"


def test_voting_against_a_plain_version(spark):
    """A table of hosts with pages of several layouts: votes, winners and texts as a plain version finds them."""
    import random
    from collections import Counter, defaultdict

    r = random.Random(8)
    rows = []
    for k in range(120):
        boxes = [f"<div class='{c}{r.randint(1, 9)}'><p>{' '.join(r.choice(['alpha', 'beta', 'gamma']) for _ in range(r.randint(1, 60)))}</p></div>" for c in ("post", "side", "extra")]
        r.shuffle(boxes)
        rows.append((k, f"https://www.h{k % 4}.org/{k}", f"<html><body>{''.join(boxes)}</body></html>"))
    votes = defaultdict(Counter)
    scores = Counter()
    for _, url, source in rows:
        path, score = html.vote(source)
        votes[url.split("/")[2][4:]][path] += 1
        scores[url.split("/")[2][4:], path] += score
    want = {}
    for k, url, source in rows:
        h = url.split("/")[2][4:]
        whole = sum(votes[h].values())
        paths = sorted((p for p, n in votes[h].items() if n >= html.WINNING_SHARE * whole), key=lambda p: (-votes[h][p], -round(scores[h, p], 3), p))
        page = html.Page(source)
        text = ""
        for path in paths:
            text = text or page.text_of({i for i in range(len(page.steps)) if page.path(i) == path})
        want[k] = text
    got = {x.page_id: x.text for x in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and len({html.vote(x[2])[0] for x in rows}) > 1
