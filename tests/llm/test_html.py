import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest

from braidql.llm import html_layout
from braidql.llm.html_layout import render_html
from braidql.llm.queries import QUERIES


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
        ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x | y\n  | z"),
        ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na | b"),
        ("<table><tr><td align=right>7<tr><td>123</table>", "  7\n123"),
        ("<pre>\n x\n  y</pre>", " x\n  y"),
        ("a<span hidden>b</span>c<i style='display: none'>d</i>", "ac"),
        ("<style>.h{display:none}</style><p class='x h'>no<p>yes", "yes"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<script>var t='</p>';</script><noscript>n</noscript>ok<!-- c -->", "ok"),
        ("<head><title>T</title></head><body>B", "B"),
        ("<title>T</title>B", "B"),
        ("<details><summary>S</summary>h</details><details open><summary>S</summary>v</details>", "S\nS\nv"),
        ("&lt;b&gt; &amp; &eacute;&nbsp;x", "<b> & é x"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("</p>a</div></nothing>b", "ab"),
        ("<p>a<h2>b</h2>c", "a\n\nb\n\nc"),
        ("<q>x</q>", "“x”"),
        ("<input type=hidden value=a><input type=submit value=Go>", "Go"),
        ("<blockquote>a<br>b</blockquote>", "  a\n  b"),
        ("a < b and c > d", "a < b and c > d"),
        ("<a href='x>y'>t</a>", "t"),
    ],
)
def test_layout(page, want):
    assert render_html(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<math><semantics><mi>y</mi><annotation>tex</annotation></semantics></math>", "y"),
        ("<map name=m><p>in map<area></p></map>", "in map"),
        ("<object data=x><param name=a>fallback</object>", "fallback"),
        ("<svg><title>t</title><defs><text>d</text></defs><g>loose<path d='M0'/><text>A</text><text>B<tspan>C</tspan></text></g></svg>z", "A\nBC\nz"),
        ("<style>@media print{.nav{display:none}}</style><p class=nav>n", "n"),
        ("<style>@media (max-width:600px){.x{display:none}}</style><p class=x>n", "n"),
        ("<style>@media screen and (min-width:600px){@media all{.x{display:none}}}</style><p class=x>n<p>y", "y"),
        ("<style>@media print{.a{color:red}.x{display:none}} .y{display:none}</style><p class=x>n<p class=y>y", "n"),
        ("<style media=print>.x{display:none}</style><p class=x>n", "n"),
        ("<style>@import 'a.css'; .x{color:red;display:none}</style><p class=x>n<p>y", "y"),
    ],
)
def test_drawings_and_conditional_rules(page, want):
    assert render_html(page) == want


def test_deep_and_broken_pages():
    assert render_html("<div>" * 30_000 + "x") == "x"
    assert "x" in render_html("<table><tr><td>" * 200 + "x")
    assert render_html("<ul>" * 50 + "<li>x") == "- x"
    assert render_html("<" * 1000 + "a") == "<" * 1000 + "a"
    assert render_html("<!-- never closed") == ""
    assert render_html("<td colspan=99999999 rowspan=99999999>x") == "x"
    assert len(render_html("<table>" + "<tr><td>" + "w " * 5000 + "<td>x" + "<tr><td>s<td>y" * 300 + "</table>")) < 200_000


class Words(HTMLParser):
    """Visible words by a plain walk over tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head", "noscript", "template") or "hidden" in a or "display:none" in a.get("style", "").replace(" ", ""):
            self.off += tag not in html_layout.VOID

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "noscript", "template") and self.off:
            self.off -= 1

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_query_keeps_all_visible_words(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op2_html_layout"](spark, sf).collect()
    assert len(rows) == len(pages)
    letters = lambda s: re.sub(r"[\W\d_]+", "", s)
    for r in rows:
        walk = Words()
        walk.feed(pages[r.page_id])
        assert letters(r.text) == letters(unescape("".join(walk.out)))
        assert r.n_lines == (len(r.text.split("\n")) if r.text else 0)


def test_rules_of_style_sheets():
    """Conditions of @-blocks, specificity, important declarations, descendants and children."""
    show = lambda css, body: render_html(f"<style>{css}</style>{body}")
    assert show("@media print{.np{display:none}}", "<p class=np>hello</p><p>bye") == "hello\n\nbye"
    assert show("#a{display:block}.b{display:none}", "<p id=a class=b>specific wins") == "specific wins"
    assert show(".b{display:none}p{display:block}", "<p class=b>gone") == ""
    assert show("p{display:none!important}#a{display:block}", "<p id=a style='display:block'>gone") == ""
    assert show(".menu li{display:none}", "<div class=menu><ul><li>gone</ul></div><ul><li>kept</ul>") == "- kept"
    assert show(".menu > a{display:none}", "<div class=menu><a>gone</a><b><a>kept</a></b></div>") == "kept"
    assert show("div .x b{display:none}", "<div><p class=x><i><b>gone</b>kept</i></div><p class=x><b>too</b>") == "kept\n\ntoo"
    assert show("[aria-hidden=true]{display:none}[data-x]{visibility:hidden}", "<p aria-hidden=true>gone<p aria-hidden=false>kept<p data-x>gone") == "kept"
    assert show(".a:hover{display:none}.a + .b{display:none}", "<p class=a>kept<p class=b>too") == "kept\n\ntoo"
    assert show("td{visibility:hidden}td b{visibility:visible}", "<table><tr><td>gone<b>seen</b></table>") == "seen"


def test_tags_without_an_end_take_linear_time():
    for page in ("<a " * 100_000, "<a '" * 50_000 + '<b "', ("<a " * 10 + "\"'") * 20_000, "<a \"" * 99_999 + "><p>x"):
        start = time.perf_counter()
        render_html(page)
        assert time.perf_counter() - start < 5
    assert render_html("a <b c") == "a <b c" and render_html("x <a '> y <b>z</b>") == "x <a '> y z"


def test_nested_tables_and_wide_columns_are_aligned():
    page = "<table><tr><td>a<td>b<tr><td>long<td>c</table>"
    for _ in range(30):
        page = f"<table><tr><td>{page}</table>"
    assert render_html(page) == "a    | b\nlong | c"
    wide = "w" * 200
    assert render_html(f"<table><tr><td>{wide}<td>x<tr><td>s<td>y</table>") == f"{wide} | x\n{'s'.ljust(200)} | y"
    assert render_html("<table>" * 3000 + "<tr><td>x") == "x"


def invented(r):
    """(mark-up, text) of a page made of blocks whose layout is plain."""
    word = lambda: r.choice(["alpha", "beta", "γδ", "x", "longer-word", "1 &lt; 2"])
    words = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    plain = lambda s: s.replace("&lt;", "<")

    def items(kind, level):
        html, lines = "", []
        for i in range(r.randint(1, 4)):
            own, mark = words(), "- " if kind == "ul" else f"{i + 1}. "
            html += f"<li>{own}"
            lines.append(mark + plain(own))
            if level < 2 and r.random() < 0.3:
                inner, below = items(r.choice(["ul", "ol"]), level + 1)
                html += inner
                lines += [" " * len(mark) + x for x in below]
            html += r.choice(["</li>", ""])
        return f"<{kind}>{html}</{kind}>", lines

    html, blocks = "", []
    for _ in range(r.randint(0, 8)):
        kind = r.choice(["p", "h2", "ul", "ol", "table", "pre", "hidden"])
        if kind in ("p", "h2"):
            own = words()
            html += f"<{kind}>\n  {own.replace(' ', r.choice([' ', '  ', chr(10)]))} </{kind}>"
            blocks.append([plain(own)])
        elif kind in ("ul", "ol"):
            own, lines = items(kind, 0)
            html += own
            blocks.append(lines)
        elif kind == "pre":
            own = [words() + "  " + word() for _ in range(3)]
            html += "<pre>\n" + "\n".join(own) + "</pre>"
            blocks.append([plain(x) for x in own])
        elif kind == "hidden":
            html += f"<p {r.choice(['hidden', 'style=display:none', 'class=no'])}>{words()}</p><script>{words()}</script><!-- {words()} -->"
        else:
            cells = [[words() for _ in range(r.choice([2, 3]))] for _ in range(r.randint(1, 4))]
            html += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>"
            size = [max(len(plain(row[k])) for row in cells if k < len(row)) for k in range(max(map(len, cells)))]
            blocks.append([" | ".join(plain(c).ljust(size[k]) for k, c in enumerate(row)).rstrip() for row in cells])
    return "<style>.no{display:none}</style>" + html, "\n\n".join("\n".join(b) for b in blocks)


def test_query_lays_pages_out(spark, tmp_path):
    r = random.Random(12)
    made = [invented(r) for _ in range(150)]
    spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.text, x.n_lines) for x in QUERIES["op2_html_layout"](spark, str(tmp_path)).collect()}
    for i, (_, text) in enumerate(made):
        assert got[i] == (text, text.count("\n") + 1 if text else 0)
