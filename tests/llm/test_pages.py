"""Main text extraction: fixed pages, wrapper induction, and pages that are odd."""

import itertools
import random
import sys

import pytest
from pyspark.sql import functions as F

from quernstone.llm import html as web
from quernstone.llm.common import read

DATA = "/root/testdata/sf0.001"


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def alone(spark, *pages):
    """Each page on a host of its own."""
    rows = [(i, f"https://h{i}.example/x", p) for i, p in enumerate(pages)]
    return [r.text for r in web.extract(frame(spark, rows)).orderBy("page_id").collect()]


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><div class=ad>Buy!</div><!-- <p>comment</p> --><article><header><h1>Title  of
 it</h1><p>By someone</p></header><p>One <b>bold</b>&nbsp;&amp; <i>it<br>alic</i>.<p>Two &lt;tag&gt; &#233;<ul><li>a<li><p>b</p></ul>
<form><input value=1>Subscribe</form><div id="comments"><p>First!</p></div><blockquote>Q<p>R</blockquote><span hidden>no</span>
<table><tr><td>c1<td>c2<tr><th>d</table><div class="sidebar">s</div><pre>x
 y</pre>text &copy 2020 a < b</article><section class="comments">Reader</section><footer>&copy; me</footer></body></html>"""


def test_article_without_what_is_around_it(spark):
    assert alone(spark, ARTICLE) == ["\n".join([
        "Title of it", "One bold & it alic.", "Two <tag> é", "a", "b", "Q", "R", "c1 c2", "d", "x y", "text © 2020 a < b",
    ])]


def test_given_pages_match_a_plain_reading(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in read(spark, DATA, "pages").collect()}
    for r in web.extract(read(spark, DATA, "pages")).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def words(seed, n=8):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 99)) for _ in range(n))


def test_constant_nodes_are_template_and_varying_ones_content(spark):
    body = "<div><div>Welcome to our site</div><div><h2>{}</h2><p>{}</p><p>{}</p></div><div>All rights belong to us</div></div>"
    pages = [(i, "https://same.example/p", body.format(words(i, 3), words(100 + i), words(200 + i))) for i in range(12)]
    pages += [(20, "https://same.example/q", "<div><div>Welcome to our site</div><div><p>Only one</p></div></div>")]
    got = {r.page_id: r.text for r in web.extract(frame(spark, pages)).collect()}
    assert got[3] == "\n".join([words(3, 3), words(103), words(203)]) and got[20] == "Only one"


def test_copies_of_an_article_are_not_template(spark):
    page = "<article><h1>Same</h1><p>{}</p></article>".format(words(1))
    pages = [(i, "https://c.example", page + f"<!-- {i} -->") for i in range(50)]
    pages += [(100 + i, "https://c.example", f"<article><p>{words(i)}</p></article>") for i in range(10, 16)]
    got = {r.page_id: r.text for r in web.extract(frame(spark, pages)).collect()}
    assert got[7] == "Same\n" + words(1) and got[111] == words(11)


def on_host(spark, bodies, host="same.example"):
    rows = [(i, f"https://{host}/{i}", b) for i, b in enumerate(bodies)]
    return [r.text for r in web.extract(frame(spark, rows)).orderBy("page_id").collect()]


def test_only_induction_tells_parts_of_pages_without_article(spark):
    """No article, no telling tag or class: constant slots are template, from two pages on, and in each of two layouts."""
    page = "<div><div><span>Fine Site</span></div><div><div><h2>{0}</h2><p>{1}</p><p>Same in both.</p></div><div>Made by us</div></div></div>"
    assert on_host(spark, [page.format(words(1), words(2)), page.format(words(3), words(4)).replace("Same in both.", "Other")]) == [
        f"{words(1)}\n{words(2)}\nSame in both.", f"{words(3)}\n{words(4)}\nOther"
    ]
    other = "<table><tr><td>Fine Site</td></tr></table><section><h3>{0}</h3><ul><li>{1}</li></ul></section><table><tr><td>Shop now</td></tr></table>"
    pages = [page.format(words(k), words(50 + k)).replace("Same in both.", words(90 + k)) for k in range(4)]
    pages += [other.format(words(20 + k), words(70 + k)) for k in range(9)]
    got = on_host(spark, pages)
    assert got[2] == f"{words(2)}\n{words(52)}\n{words(92)}" and got[7] == f"{words(23)}\n{words(73)}"


NAMED = '<article><h2 id="related-work">{0}</h2><section id="social-impact"><p>{1}</p></section><p class="share-price">{2}</p><div class="notice-period">{3}</div></article>'


def test_names_inside_an_article_delete_nothing_by_themselves(spark):
    text = "\n".join(words(k) for k in range(4))
    assert alone(spark, NAMED.format(*[words(k) for k in range(4)])) == [text]
    pages = [NAMED.format(*[words(k) for k in range(4)])] + [f"<article><h2>{words(10 + k)}</h2><p>{words(30 + k)}</p></article>" for k in range(12)]
    assert on_host(spark, pages)[0] == text


def test_an_ambiguous_element_that_most_pages_have_is_template(spark):
    page = '<article><p>{0}</p><div class="td-related-x"><p>{1}</p></div></article>'
    assert on_host(spark, [page.format(words(k), words(40 + k)) for k in range(12)]) == [words(k) for k in range(12)]


def test_formulas_teasers_and_linked_paragraphs_stay(spark):
    assert alone(
        spark,
        "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>",
        f"<article>Read this</article><div><p>{words(1, 30)}</p><p>{words(2, 30)}</p></div>",
        "<div><p><a href=x>All of it</a></p><p>b</p></div>",
    ) == ["Let x=1 be", f"Read this\n{words(1, 30)}\n{words(2, 30)}", "All of it\nb"]


def test_constant_texts_of_few_articles_are_content(spark):
    pages = [f"<article><p>{words(k)}</p><p>Licensed alike.</p></article>" for k in range(6)]
    assert on_host(spark, pages) == [f"{words(k)}\nLicensed alike." for k in range(6)]


def test_any_number_of_blocks_gives_the_same_texts(spark):
    pages = read(spark, DATA, "pages")
    whole = sorted(map(tuple, web.extract(pages.repartition(1)).collect()))
    assert sorted(map(tuple, web.extract(pages.repartition(7)).collect())) == whole


ODD = [
    (None, ""), ("", ""), ("   ", ""), ("plain & text", "plain & text"), ("<p>a", "a"), ("<article><p>a</p><p>b <b", "a\nb"),
    ("<p>a<script>never closed", "a"), ("<!-- open <p>x", ""), ("</p></div>x</body>", "x"), ("<p>1 < 2 <3</p>", "1 < 2 <3"),
    ('<p title="a > b">c</p>', "c"), ("<p title=\"open>c</p>", "c"), ("<P>&amp;lt; &#x41; &bogus; &amp</P>", "&lt; A &bogus; &"),
    ("<article></article>", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<main><div>m</div></main><p>out</p>", "m"),
    ("<body><p>a</p><![CDATA[x]]><?php y ?></body>", "a\nx"), ("\0<p>é　ü</p>", "\0\né ü"),
    ("<article>a<article>b</article>c</article>", "a\nb\nc"),
    ('<body class="menu-open"><main class="with-sidebar"><div class="has-sidebar">a</div><div class="sub-menu">b</div></main>', "a"),
    ('<article class="post no-comments">a</article><ol class="commentlist"><li><article class="comment-body">b</article></ol>', "a"), ("<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
]


@pytest.mark.parametrize("page, text", ODD)
def test_odd_pages(page, text):
    sys.setrecursionlimit(1_000_000)
    _, blocks, has_main = web.parse(page or "")
    assert "\n".join(t for _, t in web.texts(blocks, has_main)) == text


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "not a url", None), (2**60 + 1, "HTTP://User@Host:80/x", "<p>b</p>")]
    docs = frame(spark, rows).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = web.extract(docs).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=repr) == sorted([(1, "a"), (1, "a"), (None, ""), (2**60 + 1, "b")], key=repr)
    assert web.extract(docs.limit(0)).count() == 0
    hosts = [r[0] for r in docs.select(web.host_of(F.col("url"))).collect()]
    assert hosts == ["", "", "", "host"]


def test_deep_and_wide_pages_align(spark):
    deep = "<div>" * 2000 + "x" + "</div>" * 2000
    wide = "<p>a</p><h2>b</h2>" * 3000
    pages = [(i, "https://d.example", p) for i, p in enumerate([deep, wide] * 4)]
    assert web.extract(frame(spark, pages)).count() == 8


def test_matching_finds_the_largest_alignment():
    def tree(tag, *children):
        return web.Shape(tag, list(children))

    a = tree("body", tree("nav", tree("ul")), tree("div", tree("p"), tree("h2"), tree("p")), tree("footer"))
    b = tree("body", tree("aside"), tree("div", tree("h2"), tree("p")), tree("footer"))
    web.number(b)
    assert web._weight(a, b, {}) == 5
    web.match(a, b, {})
    nav, div, footer = a.children
    assert nav.slot == 0 and div.slot == b.children[1].slot and footer.slot == b.children[2].slot
    assert [c.slot for c in div.children] == [0, b.children[1].children[0].slot, b.children[1].children[1].slot]


def plain_weight(a, b):
    """Of the largest order-preserving match, by trying every choice of pairs of children."""
    if a.tag != b.tag:
        return 0
    best = 0
    for n in range(min(len(a.children), len(b.children)) + 1):
        for left in itertools.combinations(a.children, n):
            for right in itertools.combinations(b.children, n):
                weights = [plain_weight(x, y) for x, y in zip(left, right)]
                best = max(best, sum(weights)) if all(weights) else best
    return best + 1


@pytest.mark.parametrize("seed", range(25))
def test_matching_agrees_with_all_choices(seed):
    r = random.Random(seed)

    def tree(depth):
        return web.Shape(r.choice("ab" if depth else "a"), [tree(depth + 1) for _ in range(r.randint(0, 3 if depth < 2 else 0) if depth else 4)])

    a, b = tree(0), tree(0)
    assert web._weight(a, b, {}) == plain_weight(a, b)
    web.number(b)
    web.match(a, b, {})

    def pairs(node):
        return [(node, node.slot)] + [p for c in node.children for p in pairs(c)]

    of = {slot: node for node, slot in pairs(b)}
    matched = [(node, slot) for node, slot in pairs(a) if slot]
    assert len(matched) == plain_weight(a, b) == len({s for _, s in matched})
    assert all(node.tag == of[slot].tag for node, slot in matched) and [s for _, s in matched] == sorted(s for _, s in matched)


def test_shapes_are_reread_as_they_were():
    sys.setrecursionlimit(1_000_000)
    for page in (ARTICLE, "", "<div>" * 2000 + "x", "<p>a<h2>b</h2><ul><li>c<li>d</ul>"):
        tree = web.shape([web.parse(page)[0]])
        assert web.reread(web.written(tree)).key == tree.key
