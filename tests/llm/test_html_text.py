import re
import sys
from html.parser import HTMLParser

from tanglemap.llm.html_text import extract_text, render


def test_layout():
    assert render("<title>t</title><p>One <b>two</b>\n three<p>Four<br>five") == "One two three\n\nFour\nfive"
    assert render("<ul><li>a<li>b<ol start=4><li>x<li>y</ol></ul>z") == "- a\n- b\n  4. x\n  5. y\n\nz"
    assert render("<table><tr><th>Name<th>V<tr><td>long name<td>1<tr><td>é<td>22</table>") == "Name       V\nlong name  1\né          22"
    assert render("<pre>\n a\n   b</pre>") == " a\n   b"
    assert render("a<div hidden>b</div><div style='color:red;display:none'>c</div><script>d</script><!-- e --><input type=hidden value=f>g") == "ag"
    assert render("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>") == "s\ns\nyes"
    assert render("&lt;b&gt; &amp; a < b > c &copy;") == "<b> & a < b > c ©"
    assert render("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"


def test_tables_with_spans():
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A  B\n   C"
    assert render("<table><tr><td>a<td rowspan=3>tall<td>b<tr><td>c<td>d<tr><td>e<td>f<tr><td>g<td>h</table>") == "a  tall  b\nc        d\ne        f\ng  h"
    assert render("<table><tr><td colspan=2>a heading over both<tr><td>x<td>y<tr><td>long cell<td>z</table>") == "a heading over both\nx          y\nlong cell  z"
    assert render("<table><thead><tr><th rowspan=0>H<th>I<tbody><tr><td>1<td>2</table>") == "H  I\n1  2"
    assert render("<table><tr><td rowspan=2 colspan=2>Q<td>1<tr><td>2<tr><td>a<td>b<td>3</table>") == "Q     1\n      2\na  b  3"
    assert render("<table><tr><td>one<br>two<td>x<tr><td colspan=99999999999>end<td rowspan=x>y</table>") == "one  x\ntwo\nend  y"


def test_visibility():
    assert render("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z") == "yes\nz"
    assert render("<div style='display:none'>no<b style='visibility:visible'>no</b></div>z") == "z"
    assert render("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert render("<table style='visibility:collapse'><tr><td>a<td style='visibility:visible'>b</table>") == "b"
    assert render("<p style='visibility:hidden; visibility:visible'>x") == "x"
    assert render("<pre style='visibility:hidden'>a<i style='visibility:visible'>b</i></pre>") == "b"
    assert render("<noscript>n</noscript><template>t</template><textarea>&lt;w</textarea><select><option>o<option>p</select>") == "<w\no\np"


def test_hand_made_page():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><header><h1>Head  line</h1></header>
    <nav><ul><li><a href=x>One</a></li><li>Two<ul><li>Inner</ul></ul></nav><p>Some <em>text</em>,<br>next.
    <blockquote>Quoted<p>twice</blockquote><ol><li>first<li><p>second</ol><hr>
    <table><caption>Prices</caption><tr><th>Item</th><th>Cost</th></tr><tr><td>Tea</td><td>2.50</td></tr></table><footer>End</footer></body></html>"""
    assert render(page) == "Head line\n\n- One\n- Two\n  - Inner\n\nSome text,\nnext.\n\n  Quoted\n\n  twice\n\n1. first\n2. second\n\nPrices\nItem  Cost\nTea   2.50\n\nEnd"


def test_broken_input():
    assert render(None) == "" and render("") == "" and render("<p") == "" and render("</p></div>x") == "x"
    deep = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert render("<div>" * 5000 + "deep") == "deep" and render("<ul><li>" * 200 + "x").endswith("- x")
    finally:
        sys.setrecursionlimit(deep)
    assert render("<!-- open") == "" and render("<script>open") == ""
    assert render("<table><tr><td>a<table><tr><td>b</table>c</table>d").split() == ["a", "b", "c", "d"]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_whole_pages_against_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_text(pages).collect():
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        assert re.sub(r"\s", "", "".join(plain.out)) == re.sub(r"\s", "", re.sub(r"(?m)^\s*- ", "", r["text"]))


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "<p>x", "old"), (2, "<p>x", "old"), (None, "<b>n", "old"), (3, "<i>" * 2_000 + "y" * 300_000, None)], "page_id long, html string, text string")
    assert sorted(((r["page_id"] or 0), r["text"]) for r in extract_text(pages).collect()) == [(0, "n"), (1, ""), (2, "x"), (2, "x"), (3, "y" * 300_000)]
    assert extract_text(pages.limit(0)).count() == 0
