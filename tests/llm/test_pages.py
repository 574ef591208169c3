"""Main text of pages: article contents, page layouts, awkward markup."""

import re
from html import unescape

import pytest
from cases import by_rows

from jobsift.llm import tag_paths as T
from jobsift.llm.blocks import importable

S = "This is a longer sentence of the story, with commas, and it goes on for a while. "
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def clean(*parts):
    return " ".join(" ".join(parts).split())


def article(html):
    inner = re.search("<article>(.*?)</article>", html or "", re.S).group(1)
    return clean(unescape(re.sub("</?[a-z0-9]+>", lambda m: "" if m.group(0) in ("<b>", "</b>") else " ", inner)))


def test_articles_of_all_pages(spark):
    from jobsift.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op11_main_text"](spark, sf).collect()
    assert len(rows) == len(html)
    assert all(r.text == article(html[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_a_page_without_semantic_elements():
    html = f"""<body class="page with-sidebar"><div id="top"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>
    <div class="wrap"><div class="c1"><h1>The headline</h1><p>{S * 4}</p><p>{S * 3}&amp; more&nbsp;text</p><h2>Part two</h2>
    <ul><li>{S}</li><li>short item</li></ul><table><tr><td>1<td>2</table><p>End.</p></div>
    <div class="c2"><div class="box"><ul><li><a href=1>One thing happened</a></li></ul></div><p>Sign up today.</p></div></div>
    <div id="readerComments"><div class="c"><p>{S * 5}</p></div></div><div class="bottom">2020 Site.</div></body>"""
    assert T.main_text(html) == clean("The headline", S * 4, S * 3, "& more text Part two", S, "short item 1 2 End.")


def test_parts_that_the_page_marks_are_left_out():
    html = f"""<body><header><h2>Site</h2></header><aside>{S * 6}</aside><main><article><header><h1>Head</h1><p>By me, today.</p>
    </header><section><p>{S * 5}</section><section><p>Tiny.</p><form><p>Type here.</p></form><div class="cookie-notice">{S}</div>
    <button>Go.</button></section><footer>Tags: a, b.</footer></article><section class="comments"><article><p>{S * 3}</article>
    </section></main><script>var a="<p>no</p>"</script><!-- <p>no</p> --><div role="navigation">{S}</div><p hidden>{S}"""
    assert T.main_text(html) == clean("Head", S * 5, "Tiny.")


def test_ratios_select_running_text():
    menu = "".join(f"<li>Item {i}" for i in range(9))
    html = f"<div><div class=l><ul>{menu}</ul></div><div class=t><p>{S * 3}<p>{S * 2}<p>Yes.</div></div>"
    blocks = T.read_blocks(html)
    paths = [T._path(b.element) for b in blocks]
    ratio = T.path_ratios(blocks, paths)
    assert ratio[paths[-1]] == 1 > T.THRESHOLD > ratio[paths[0]]
    assert T.main_text(html) == clean(S * 5, "Yes.")


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), (" \n ", ""), ("plain words only, no tags.", "plain words only, no tags."), ("<p", ""),
    ("a<b", "a"), ("<p>x<", "x<"), ("5 < 6 and 7 > 3.", "5 < 6 and 7 > 3."), ("<a " + '"' * 100000, ""),
    ("<a" * 200000, ""), ("<!--" * 100000, ""), ("<script>x", ""), ("<p>One.<p>Two.", "One. Two."),
    ("a</b>b<br>c", "ab c"), ("&lt;b&gt; is &#8364;&#x41;&copy", "<b> is €A©"), ("<P CLASS='x>y'>Some text.</P>", "Some text."),
    ("İ <style>İ</style>stays.", "İ stays."), ("</div></p>loose, ends.", "loose, ends."), ("<nav>" + S, ""),
    ("<table><tr><td>" + S + "<td>b</table>", clean(S, "b")), ("<p>" + "word, " * 200000, clean("word, " * 200000)),
], ids=range(21))
def test_awkward_markup(html, want):
    assert T.main_text(html) == want


def test_deep_nesting_ends():
    assert T.main_text("<div>" * 5000 + S).strip() == S.strip()


def test_rows_and_columns(spark):
    importable(spark)
    rows = [(1, "u", f"<p>{S}", "old", "x"), (1, "u", f"<p>{S}", "old", "x"), (None, None, None, None, None), (2, "v", "", "t", "y")]
    out = T.extract_main_text(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    one = (1, "u", clean(S), len(clean(S)))
    assert by_rows(map(tuple, out.collect())) == by_rows([one, one, (None, None, "", 0), (2, "v", "", 0)])
    assert T.extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []
