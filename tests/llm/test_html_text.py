import re

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import html_text as op
from tidemark.llm.queries import QUERIES

CASES = [
    (None, None), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z", "- x\n- y\n  1. 1\n  2. 2\n\nz"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>n<th>value<tr><td>long name<td>2</table>", "n         | value\nlong name | 2"),
    ("<table><tr><td colspan=2>wide cell here<td>c<tr><td>a<td>b<td>d</table>", "wide cell here | c\na | b          | d"),
    ("<table><tr><td rowspan=2>r<td>q<tr><td>w</table>", "r | q\n  | w"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
    ("x<script>var t='</p>';</script><style>p{}</style><!-- no -->y<p hidden>no</p><p style='x:y; display : none'>no</p>", "xy"),
    ("<title>no</title><h1>T</h1>text", "T\n\ntext"), ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    ("&lt;a&gt; &amp;amp; &eacute;", "<a> &amp; é"), ("<div>a</span></div></p>b", "a\n\nb"), ("a < b > c", "a < b > c"),
    ("<a href='x>y'>z</a", "z"), ("<details><summary>S</summary>no</details>", "S"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
    ("<blockquote>a<p>b</blockquote>", "> a\n\n> b"), ("<img alt=pic>", "pic"), ("a<hr>b", "a\n----\nb"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_cases(html, want):
    assert op.to_text(html) == want


STRAY_QUOTES = [
    ('<p><a href="x"">one</a> two</p><p>three</p><p>four', "one two\n\nthree\n\nfour"),
    ("<p title=it's>one two three</p><p>four</p>", "one two three\n\nfour"), ("<p>a<!-->b</p><p>c", "ab\n\nc"), ("a<!--->b<!-- x -->c", "abc"),
    ('<p "quoted name">a</p>b', "a\n\nb"), ("<p class = 'x>y' id=a\"b>c", "c"), ("<p a=>b", "b"), ("<img alt=it's>", "it's"), ("<img x'y alt = \"p>q\">", "p>q"),
]


@pytest.mark.parametrize("html, want", STRAY_QUOTES)
def test_stray_quotes_swallow_nothing(html, want):
    assert op.to_text(html) == want


@pytest.mark.parametrize("html, want", [
    ("<head><title>T</title>Hello <a>Home</a><p>x", "Hello Home\n\nx"), ("<head><title>T</title><span>a<div>b", "a\nb"),
    ("<html><head> <meta charset=x> <style>s</style><noscript><img alt=no></noscript>\n<img alt=pic>", "pic"),
    ("<head><title>T</title></head><body>a", "a"), ("<head><title>T</title>&nbsp;a", "\xa0a"), ("<head><script>x</script><custom-a>b", "b"),
])
def test_head_ends_at_text_or_other_tags(html, want):
    assert op.to_text(html) == want


def test_depth_changes_nothing_around():
    for n in (10, 140, 149, 150, 151, 200, 5000):
        deep = "<span>" * n + "in<b hidden>no<i>no</i></b><div>x</div>y" + "</span>" * n
        assert op.to_text(f"<div><span>{deep}</span></div><p>after") == "in\nx\ny\n\nafter"
        grid = f"<table><tr><td>{'<div>' * n}<table><tr><td>a</td><td>b</td></tr></table>{'</div>' * n}</td><td>c<tr><td>long<td>d</table>e"
        assert re.sub(r"[\s|]+", " ", op.to_text(grid)) == "a b c long d e"
        assert op.to_text(grid).split("\n")[-3].startswith("long") and op.to_text(grid).endswith("\n\ne")
        closed = "<div>" * n + "<details><summary>S</summary>no<p>no</details>" + "</div>" * n + "z"
        assert op.to_text(closed) == "S\nz"


def test_depth_costs_no_search():
    for html in ("<p><table>" + "<div>" * 100000, "<ul><li>" * 50000, "<table><tr><td>" * 30000, "<svg>" * 100000):
        assert op.to_text(html + "x").endswith("x") or "svg" in html


@pytest.mark.parametrize("html, want", [
    ("a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math> b", "a x=1 b"),
    ("<svg><title>no</title><defs><text>no</text></defs>no<g><text>Sales</text><text x=1><tspan>2024</tspan></text></g></svg>", "Sales 2024"),
    ("<svg><style/><path d='M0'/><text>t</text></svg>after", "t after"), ("<svg><path><p>out", "out"), ("<svg/>x", "x"),
    ("<svg><foreignObject><p>in</p></foreignObject><text display=none>no</text></svg>", "in"), ("<svg><desc>no<p>no</desc><text>y</text></svg>", "y"),
    ("<select><option>one<option selected>two</select>z", "one\ntwo\nz"), ("<svg><title/><text>x</text></svg>", "x"),
    ("<select><optgroup label=G><option label=L>no</option><option>b</optgroup></select>", "G\nL\nb"),
    ("<datalist><option>no</datalist><map>m<area alt=no></map>a", "ma"), ("<table><tr><td><svg><text>c</text></svg><td>d</table>", "c | d"),
    ("<div>" * 300 + "<svg>no<title>no</title><text>c</text></svg><select><option label=L>no</select>", "c\nL"),
])
def test_formulas_charts_and_options_are_shown(html, want):
    assert op.to_text(html) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <table> <tr> <td> </td> </table> <li> <ul> </ul> <ol> <div> </div> a b & &amp; < > \" ' <!-- --> <pre> <b"
                                " <br/> <script> </script> <details> <td colspan=2>".split() + [" ", "\n"]), max_size=40))
def test_never_fails(parts):
    text = op.to_text("".join(parts))
    assert isinstance(text, str) and not any(x != x.rstrip(" ") and "<pre>" not in parts for x in text.split("\n"))


def test_deep_and_long():
    assert op.to_text("<div>" * 50000 + "x") == "x"
    assert op.to_text("<ul><li>" * 3000 + "deep").endswith("deep")
    assert op.to_text("<p>word " * 20000).count("word") == 20000


def test_all_words_outside_of_hidden_parts_stay(spark):
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = QUERIES["op6_html"][0](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        from html import unescape

        seen = re.sub(r"(?s)<(head|script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", rows[r.page_id])
        assert re.sub(r"^- ", "", r.text, flags=re.M).split() == unescape(seen).split()


def test_rows_stay(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None), (2, "", "x")], "page_id long, html string, title string")
    out = op.extract(pages)
    assert out.columns == ["page_id", "html", "title", "text"] and sorted(str(r.text) for r in out.collect()) == ["", "None", "a", "a"]
    assert op.extract(pages.limit(0)).count() == 0


def test_a_text_is_put_at_once_and_shallow_pages_are_not_searched_for_depth(monkeypatch):
    puts, searched = [], []
    put, flatten = op.Lines.put, op.flatten
    monkeypatch.setattr(op.Lines, "put", lambda self, text: (puts.append(text), put(self, text))[1])
    monkeypatch.setattr(op, "flatten", lambda root: (searched.append(root), flatten(root))[1])
    assert op.to_text("<p> one\n two\t\tthree <b> four</b>five \f<i>\xa0</i> six") == "one two three four" + "five \xa0 six"
    assert puts == ["one two three", " four", "five", " \xa0", " six"] and not searched
    assert op.to_text("<b>" * op.MAX_DEPTH + "x") == "x" and len(searched) == 1
