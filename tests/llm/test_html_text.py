import html.parser
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geofuse.llm import html_text
from geofuse.llm.html_text import render


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("a <b>b</b>c\n\n d&amp;e &copy;", "a bc d&e ©"),
        ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide one here<tr><td>c<td>d<br>e</table>", "a  b\nwide one here\nc  d\n   e"),
        ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\nin  ner"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>w<td rowspan=0>a<td>b<tr><td>v<td>c<tr><td>u<td>d<tbody><tr><td>t<td>s</table>", "w  a  b\nv     c\nu     d\nt  s"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
        ("<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd  e"),
        ("<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><p style='x-display:none'>yes</p>", "yes"),
        ("<head><title>no</title></head><script>if(a<b)'</p>'</script><style>p{}</style><noscript>no</noscript>yes", "yes"),
        ("<!-- no --><!doctype html><?x no>yes<!-- <b>no", "yes"),
        ("<pre>\n  two\n    four</pre>", "  two\n    four"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("1 < 2 <3 and </ > x", "1 < 2 <3 and x"),
        ("<a title='>'>t</a><a title=\"a>b\">u</a>", "tu"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<textarea>a<b></textarea> <q>q</q>", 'a<b> "q"'),
        ("<option>a<option>b", "a\nb"),
    ],
)
def test_layout(source, text):
    assert render(source) == text


class Words(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_word_is_lost(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = html_text.op7_html_text(spark, sf).collect()
    assert len(out) == len(pages)
    squeeze = lambda s: sorted(re.sub(r"\s+", "", s))
    for r in out:
        w = Words()
        w.feed(pages[r["page_id"]])
        w.close()
        text = re.sub(r"(?m)^ *(- |\d+\. )", "", r["text"])
        got, want = squeeze(text), squeeze(re.sub(r"(?m)^ *(- |\d+\. )", "", "".join(w.out)))
        assert abs(len(got) - len(want)) <= 0.02 * len(want) + 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "<tr>", "</table>", "<", ">", "'", '"', "<a href='", "x y", "&amp;", "<br>", "</p>", "<!--", "-->", "<pre>", "<ol>"])))
def test_anything_is_accepted(parts):
    render("".join(parts))


def test_long_and_deep():
    assert render("<div>" * 50000 + "x") == "x"
    assert render("<a " * 100000 + "x").count("<a") == 100000
    assert render("<b>w</b> " * 50000).count("w") == 50000
    render("<p '" * 20000 + ">")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "<p>x"), (3, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'t' text", "'u' url")
    out = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(pages).collect())
    assert out == [(0, "x"), (1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_depth_changes_nothing():
    page = "<div hidden>no<font></div>yes<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e<b>f</b></pre>"
    for depth in (0, 300, 3000):
        assert render("<font>" * depth + page) == "yes\n\n- a\n- b\n\nc  d\n\nef"
    assert render("<div hidden>" + "<b>" * 300 + "<div>no</div>no</div>yes") == "yes"
    assert render("<ul><li>" * 5000 + "x").strip(" -") == "x"
    assert render("<table><tr><td>" * 1000 + "x") == "x"
    assert render("<p>" + "<table><tr><td>" + "<b>" * 20000 + "<div>x</div>" * 20000).count("x") == 20000


@pytest.mark.parametrize(
    "source,text",
    [
        ("<math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "a=1"),
        ("<svg><title>no</title><defs><text>no</text></defs>no<rect/><g><text>y<tspan>es</tspan></text></g></svg>", "yes"),
        ("<select><option>no<option selected>yes<option>no</select> <select><option disabled>no<option>first</select>", "yes first"),
        ("<select multiple><option>a<option>b</select>", "a b"),
        ("<select hidden><option>no</select>x", "x"),
    ],
)
def test_drawn_and_chosen_text(source, text):
    assert render(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>v</p>no<b>no<i style='VISIBILITY:visible'>w</i></b></div>x", "v\n\nw\nx"),
        ("<p style='visibility:hidden;visibility:visible'>yes</p><p style='visibility:collapse'>no<b hidden style='visibility:visible'>no</b></p>", "yes"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>a<tr><td>no<td>no</table>", "a"),
        ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>no<tr><td>a</table>", "a"),
        ("<ul><li style='visibility:hidden'>no<span style='visibility:visible'>a</span><li>b</ul>", "  a\n- b"),
        ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"),
        ("<ol reversed><li>a<li>b<li>c</ol><ol reversed start=9><li>d<li>e</ol>", "3. a\n2. b\n1. c\n\n9. d\n8. e"),
        ("<ol type=a start=26><li>x<li>y</ol><ol type=I><li>x<li value=14>y</ol>", "z. x\naa. y\n\nI. x\nXIV. y"),
        ("<ol type=i start=0><li>x<li>y</ol>", "0. x\ni. y"),
        ("<input type=submit value=Go><input type=reset><input type=hidden value=no><input value=v placeholder=no><input placeholder=p><input type=checkbox value=no>", "Go Reset v p"),
        ("<div style='visibility:hidden'><input value=no><q>no</q><select><option>no</select></div>x", "x"),
    ],
)
def test_visibility_numbers_and_controls(source, text):
    assert render(source) == text


# A second renderer, over trees instead of sources: events of a walk, folded to lines.

INLINE, PLAIN, SET_APART = ("b", "span", "i"), ("div", "section", "dd"), ("p", "h1", "blockquote")


def source_of(tree):
    if isinstance(tree, str):
        return tree
    tag, style, children = tree
    head = f"<{tag} style='{style}'>" if style else f"<{tag}>"
    return head if tag == "br" else head + "".join(map(source_of, children)) + f"</{tag}>"


def walk(tree, dark, parent):
    if isinstance(tree, str):
        yield ("text", "" if dark else tree)
        return
    tag, style, children = tree
    if style == "display:none":
        return
    dark = {"visibility:hidden": True, "visibility:visible": False}.get(style, dark)
    inside = lambda: (e for k in children for e in walk(k, dark, tag))
    if tag == "br":
        yield ("br",)
    elif tag in INLINE:
        yield from inside()
    elif tag in ("ul", "ol"):
        edge = "flush" if parent == "li" else "gap"
        yield (edge,)
        nth = 0
        for k in children:
            item = not isinstance(k, str) and k[0] == "li" and k[1] != "display:none"
            nth += item
            if item:
                hidden = {"visibility:hidden": True, "visibility:visible": False}.get(k[1], dark)
                mark = "- " if tag == "ul" else f"{nth}. "
                yield ("flush",)
                yield ("in", len(mark), " " * len(mark) if hidden else mark)
                for e in k[2]:
                    yield from walk(e, hidden, "li")
                yield ("flush",)
                yield ("out",)
                yield ("flush",)
            else:
                yield from walk(k, dark, tag)
        yield (edge,)
    else:
        edge = "gap" if tag in SET_APART else "flush"
        yield (edge,)
        if tag in ("blockquote", "dd"):
            yield ("in", 2, None)
        yield from inside()
        if tag in ("blockquote", "dd"):
            yield ("flush",)
            yield ("out",)
        yield (edge,)


def folded(events):
    """A mark stands right before the first line inside its item; an item without lines hands it back to the one around it."""
    lines, text, levels, mark, apart = [], "", [], "", False
    for kind, *rest in [*events, ("flush",)]:
        if kind == "text":
            text += rest[0]
        elif kind == "in":
            levels.append((rest[0], rest[1], mark))
            mark = mark if rest[1] is None else rest[1]
        elif kind == "out":
            _, own, outer = levels.pop()
            if own is not None:
                mark = outer if mark == own else ""
        else:
            words = text.split()
            text = ""
            if words:
                if apart and lines:
                    lines.append("")
                apart = False
                lead = " " * sum(n for n, _, _ in levels)
                lines.append(lead[: len(lead) - len(mark)] + mark + " ".join(words))
                mark = ""
                if kind == "gap":
                    apart = True
            elif kind in ("br", "gap"):
                apart = apart or bool(lines)
    return "\n".join(lines)


TEXTS = st.sampled_from(["a", " b ", "c d", "\n", " ", "e"])
STYLES = st.sampled_from(["", "", "", "display:none", "visibility:hidden", "visibility:visible"])
FLOW = st.recursive(
    st.one_of(TEXTS, st.just(("br", "", []))),
    lambda kids: st.one_of(
        st.tuples(st.sampled_from(["div", "section", "blockquote", "b", "span"]), STYLES, st.lists(kids, max_size=4)),
        st.tuples(st.sampled_from(["ul", "ol"]), STYLES, st.lists(st.tuples(st.just("li"), STYLES, st.lists(kids, max_size=3)), max_size=4)),
        st.tuples(st.sampled_from(["p", "h1"]), STYLES, st.lists(TEXTS, max_size=3)),
    ),
    max_leaves=14,
)


@settings(max_examples=400, deadline=None)
@given(st.lists(FLOW, max_size=5))
def test_equals_a_second_renderer_over_trees(trees):
    assert render("".join(map(source_of, trees))) == folded(e for t in trees for e in walk(t, False, "body"))
