import html
import json
import random
import re

import pyarrow.parquet as pq
import pytest

from pairlens.llm.queries import op11_main_text
from pairlens.llm.wrappers import Wrappers, bare, fold, main_text, merge, parse, pattern, slot_map, slots

SCHEMA = "page_id long, url string, html string"


def article(page):
    """What stands in the article element, block by block; enough for the given pages, whose markup is plain."""
    inside = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside[1] if inside else ""))
    return "\n".join(b for b in blocks if b)


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_whole_table(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    found = op11_main_text(spark, sf).collect()
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found) == sorted((r["page_id"], r["url"], a := article(r["html"]), len(a)) for r in rows)


def expression(page):
    return pattern(parse(page)[0])


def test_expressions():
    assert expression("<p>a<p>b<p>c") == "<html>(<p>#</p>)+</html>"
    assert expression("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p></div>") == "<html><div>(<h2>#</h2>(<p>#</p>)+)+</div></html>"
    assert expression("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "<html><ul>(<li>#(<ul>(<li>#</li>)+</ul>)?</li>)+</ul></html>"
    assert expression("<script>a<p>b</script><!-- <p> --><b>x <i>y</b><style>p{}</style>") == "<html>#</html>"
    one, two = (parse(p)[0] for p in ("<h1>a</h1><p>b</p><div class=x>c</div>", "<h1>a</h1><p>b</p><p>c</p><table><tr><td>d</table>"))
    both = merge(one, two)
    assert pattern(both) == "<html><h1>#</h1>(<p>#</p>)+(<div x>#</div>)?(<table><tr><td>#</td></tr></table>)?</html>"
    assert pattern(merge(both, one)) == pattern(merge(both, both)) == pattern(both)


def test_a_wrapper_has_each_page_it_comes_from():
    r = random.Random(3)

    def part(depth):
        kinds = r.choices(["<p>t</p>", "<h2>t</h2>", "<div class=c>t</div>", "<ul>", "<section>"], k=r.randint(1, 5))
        return "".join(k if len(k) > 9 or depth > 2 else f"{k}{part(depth + 1)}</{k[1:]}" if k[-1] == ">" and "</" not in k else k for k in kinds)

    trees = [bare(parse(part(0))[0]) for _ in range(60)]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = bare(merge(wrapper, t))
    for t in trees:
        assert -1 not in slot_map(bare(wrapper), bare(t))


def test_blocks_and_references():
    tree, found, linked = parse('<div>a&nbsp;&amp;\n b<br>c &lt;p&gt; &#233;<a href="x>y">link</a></div>tail <p>one<p>two &copy')
    assert found == ["a & b c <p> élink", "tail", "one", "two ©"]
    assert linked == [4, 0, 0, 0]
    assert parse(None) == parse("") and parse("")[1] == []
    assert parse("<p>" * 3000 + "x" + "<div>" * 3000 + "y")[1] == ["x", "y"]
    assert parse("<p>a <!-- never closed <p>b")[1] == ["a"] and parse('<p>a<b title="open>x</p><p>c')[1][0].startswith("a")
    assert [len(s[2]) for s in slots(parse("<p>w</p>" * 20_000)[0])] == [20_000]


DIVS = """<html><head><title>x</title></head><body class="has-sidebar"><div id="top" class="site-header"><div class="logo">Site</div></div>
<div class="m1"><ul><li><a href=a>Home</a><li><a href=b>News {i}</a></ul></div>
<div class="wrap"><div class="c"><h1>Title {i}</h1><p>First para &amp; more text number {i} of the story with many words in it.</p><p>Second para {j}
that goes on and on.</p><div class="cookie-notice">We use cookies</div><p>Share this story with your friends.</p></div><div class="s">Latest: <a href=x>one</a> <a href=y>two</a></div></div>
<form><input name=q><button>Go</button>Search</form><div class="comments"><div class="comment"><p>Nice post {i}, I liked it very very much indeed, more than others.</p></div></div>
<div class="f">Copyright me</div></body></html>"""


def test_pages_without_an_article_element(spark):
    rows = [(i, f"http://a.example/{i}", DIVS.format(i=i, j=i * 7)) for i in range(12)]
    found = texts(main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    for i in range(12):
        assert found[i] == f"Title {i}\nFirst para & more text number {i} of the story with many words in it.\nSecond para {i * 7} that goes on and on."


@pytest.mark.parametrize("inner", ['<aside>x</aside>', '<div class="ad-slot">x</div>', "<form>x</form>", '<section id="comments"><p>x x x x x</p></section>', '<div class="share-links">x</div>', "<footer>x</footer>", '<p class="notice">x</p>', "<div hidden>x</div>"])
def test_inside_an_article(spark, inner):
    page = f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>one</p>{inner}<p class='post-header-text'>two</p></article></main><article class=comment><p>long long comment text</p></article>"
    assert texts(main_text(spark.createDataFrame([(1, "http://b.example", page)], SCHEMA))) == {1: "T\none\ntwo"}


def test_odd_rows(spark):
    page = "<article><p>one</p><p>two</p></article><footer>f</footer>"
    rows = [(1, None, page), (1, None, page), (None, "no host", page), (2, "http://c.example", None), (3, "http://c.example", ""), (4, "http://c.example", "plain text"), (5, "http://d.example", "<nav>only</nav>"), (6, "https://u:p@E.example:80/x", page + "é" * 100_000)]
    rows += [(10 + i, "http://d.example", "<article><p>same in all</p></article>") for i in range(9)]  # copies are no template
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", text string, host string").repartition(3)
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in main_text(df).collect()), key=repr)
    want = [(1, "one\ntwo", 7)] * 2 + [(None, "one\ntwo", 7), (2, "", 0), (3, "", 0), (4, "plain text", 10), (5, "", 0), (6, "one\ntwo", 7)] + [(10 + i, "same in all", 11) for i in range(9)]
    assert found == sorted(want, key=repr)
    assert main_text(df.limit(0)).collect() == []


def test_one_wrapper_for_each_host(spark):
    pages = ["<article><h1>a</h1><p>b</p></article>", "<article><h1>a</h1><p>b</p><p>c</p><ul><li>d</ul></article>", "<nav>x</nav><article><h1>a</h1><p>b</p></article>"]
    rows = [(i, f"http://{'ab'[i % 2]}.example/", pages[i % 3]) for i in range(30)]
    w = {r["host"]: r["wrapper"] for r in Wrappers(spark.createDataFrame(rows, SCHEMA)).wrappers.collect()}
    want = "<html>(<nav>#</nav>)?<article><h1>#</h1>(<p>#</p>)+(<ul><li>#</li></ul>)?</article></html>"
    assert w == {"a.example": want, "b.example": want}


def test_fold_is_stable():
    r = random.Random(5)
    for _ in range(300):
        items = [[r.choice("abc"), "", ["#", "", []]] for _ in range(r.randint(0, 14))]
        once = fold(json.loads(json.dumps(items)))
        assert [pattern(x) for x in fold(json.loads(json.dumps(once)))] == [pattern(x) for x in once]
