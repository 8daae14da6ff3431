import time
from html.parser import HTMLParser

import duckdb
import pytest

from amalgam.llm.html_text import page_text

CASES = {
    "blocks": ("<h1>A <i>b</i></h1><p>one<br>two<p>three   four<div>five</div>six", "A b\n\none\ntwo\n\nthree four\n\nfive\nsix"),
    "implied": ("<title>t</title>text<li>a<li>b</li><dl><dt>c<dd>d</dl>", "text\n- a\n- b\n\nc\n  d"),
    "lists": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li value=9>y<li>z</ol>", "- a\n- b\n  - c\n- d\n\n3. x\n9. y\n10. z"),
    "table": ("<table><tr><th>Name<th>N<tr><td>apple<td align=right>5<tr><td>fig<td>12</table>", "Name   N\napple   5\nfig    12"),
    "spans": ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    "foster": ("<table>stray<tr><td>x</table>", "stray\n\nx"),
    "hidden": ("<style>.g,#h{display:none}p.v{visibility:hidden}</style><p hidden>a<p class=g>b<p id=h>c<p style='display: none'>d<p class=v>e <b style='visibility:visible'>f</b></p>g", "f\n\ng"),
    "raw": ("<script>if (a<b) '</p>'</script>x<noscript>n</noscript><textarea>a\n b</textarea>", "xa\n b"),
    "pre": ("<pre>\n a\n   b\n</pre>c", " a\n   b\n\nc"),
    "entities": ("&lt;b&gt; &amp;amp; &copy &#x41; 1 < 2", "<b> &amp; © A 1 < 2"),
    "details": ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details><dialog>z</dialog>", "s\nt\ny"),
    "select": ("<select><option>a<option selected>b</select> <input type=submit value=Go><input value=no>", "b Go"),
    "misnested": ("<b>a<p>b</b>c</p></div></table>d", "a\n\nbc\n\nd"),
    "comment": ("a<!-- <p>no -->b<![CDATA[x]]>c<!-- open", "abc"),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    page, want = CASES[name]
    assert page_text(page)[1] == want


def test_bounds():
    assert page_text(None) == ("", "") == page_text("")
    assert page_text("<div>" * 50_000 + "x")[1] == "x"
    assert page_text("<table><tr><td>" * 500 + "x")[1].strip() == "x"
    assert page_text("<td>" + "a " * 100_000)[1].count("a") == 100_000
    assert len(page_text("<table>" + "<tr><td>" + "w" * 50_000 + "<td>x<tr><td>a<td>b" * 50 + "</table>")[1]) < 3_000_000


class Words(HTMLParser):
    """All words outside head, script and style, in order."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_all_words_of_the_pages():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        other = Words()
        other.feed(page)
        plain = lambda s: "".join(s.split())
        marks = page_text(page)[1].replace("\n- ", "\n")
        marks = marks[2:] if marks.startswith("- ") else marks
        assert plain(marks) == plain("".join(other.words))


@pytest.mark.parametrize("rest", ["<tr><td>a<td>b", "<tbody><tr><td>a<td>b", "<thead><tr><th>a<th>b", "<td>a<td>b", "</colgroup><tr><td>a<td>b"])
def test_colgroup_without_its_end(rest):
    assert page_text(f"<table><colgroup><col><col>{rest}</table>c")[1] == "a  b\n\nc"
    assert page_text(f"<table><colgroup><col>x{rest}</table>")[1] == "x\n\na  b"


def test_svg_and_math_text():
    assert page_text("<p>a <svg><title>t</title><desc>d</desc><defs/><circle r=1 /><text>b</text></svg> <math><mi>x</mi><annotation>no</annotation></math> c")[1] == "a b x c"


def test_hidden_parts_of_tables():
    hidden = "style='visibility:hidden'"
    assert page_text(f"<table><tr {hidden}><td>no<tr><td>b</table>")[1] == "b"
    assert page_text(f"<table><tbody {hidden}><tr><td>no<tr style='visibility:visible'><td>b<td {hidden}>no</table>")[1] == "b"
    assert page_text(f"<table {hidden}><caption>no</caption><tr><td style='visibility:visible'>c<td>no</table>")[1] == "c"


def test_hidden_at_any_depth():
    assert page_text("<div>" * 600 + "<div hidden><div>no</div></div>" + "</div>" * 600 + "x")[1] == "x"


@pytest.mark.parametrize("page,text", [("<a " * 350_000, "<a"), ("<table>" + "x<br>" * 200_000, "x"), ("<i>" * 300_000 + "y", "y"), ("</b>" * 250_000 + "z", "z"), ("<table><tr><td>" * 60_000 + "w", "w")])
def test_a_megabyte_of_hostile_markup(page, text):
    began = time.perf_counter()
    assert text in page_text(page)[1]
    assert time.perf_counter() - began < 20


def test_comment_behind_the_last_tag():
    assert page_text("<p>a</p>b<!-- no")[1] == "a\n\nb" and page_text("a<!-- no")[1] == "a" and page_text("<p>a <b")[1] == "a <b"
