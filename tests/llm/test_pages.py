"""Main text against the articles of the given pages, and layouts without an article element."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import pages

SF = "/root/testdata/sf0.01"
P1 = "The river rose in the night and by the morning it had reached the doors of the houses that stand at the foot of the hill, where the people had been told to leave, but most of them had stayed with their animals and waited for the boats to come."
P2 = "It was not until the second day that the help arrived, and by then the bridge was gone and the road to the town was under water for the most part of its length, so that the carts had to go around by the old mill on the other side."


def plain_article(page):
    """Blocks of the article of a given page: its h1 and paragraphs, tags out, br as a space."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in parts) if x)


def test_whole_table(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = pages.op13_html_extraction(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        want = plain_article(source[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, want, len(want))


LAYOUTS = {
    "blocks without containers": (
        f"<html><body><div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>About</a></div><div><h1>The flood</h1><div>{P1}</div>"
        f"<div>It was over.</div><div>{P2}</div></div><div><a href=/x>Read the next one of the stories that are in the paper</a></div><div>© The Paper</div></body></html>",
        ["The flood", P1, "It was over.", P2],
    ),
    "containers by name": (
        f"<body class='has-sidebar'><div id=page class='no-header'><div class='cookieNotice'>{P2}</div><div class=site-header>The Paper</div><div class=content><h2>The flood</h2><p>{P1}"
        f"<p>{P2}</div><div class='sidebar-left'><p>{P1}</p></div><section id='comments'><article><p>{P1}</p></article></section></div></body>",
        ["The flood", P1, P2],
    ),
    "parts inside the article": (
        f"<main><article><header><h1>Flood</h1><p>By A. Writer</p></header><p>Short one.</p><aside>{P2}</aside><p>{P1}</p><ul><li>One<li>Two <b>th</b>ree</ul>"
        f"<form><input><label>Your mail</label><button>Send</button></form><div role=alert>{P2}</div><div class='share'>Tell it</div><footer>Tags</footer></article></main><p>{P2}</p>",
        ["Flood", "Short one.", P1, "One", "Two three", P2],
    ),
    "a form around the page": (f"<form><article><p>{P1}</p></article><input></form>", [P1]),
    "references and white space": ("<article><p>a&nbsp;&lt;b&gt; &amp;amp; &#233;\n\t c&eacute;<wbr>d &unknown; x<br>y</p></article>", ["a <b> &amp; é céd &unknown; x y"]),
    "scripts, comments and quotes": (
        f"<article><script>var t='</p><p>no</p>'</script ><style>p{{}}</style><!-- <p>no</p> --><![CDATA[x]]><p title='a > b' data-x=\"</p>\">{P1}</p><p hidden>no</p><p style='display: none'>no</p></article>",
        [P1],
    ),
    "breaks": (f"<div>{P1}<br><br>{P2}<br>{P1}</div>", [P1, f"{P2} {P1}"]),
    "other script": (f"<div><a href=/>меню</a></div><div>{'Вода поднялась ночью и к утру дошла до домов у подножия холма. ' * 5}</div>", [("Вода поднялась ночью и к утру дошла до домов у подножия холма. " * 5).strip()]),
    "container of all": (f"<div class='widget'><p>{P1}</p><p>{P2}</p></div>", [P1, P2]),
    "text alone": (P1, [P1]),
    "unclosed": (f"<article><p>{P1}<p><b>x <a href='/", [P1, "x"]),
    "empty": (None, []), "blank": (" \n<p> </p>&nbsp;", []), "links only": ("<ul><li><a href=/>One</a><li><a href=/>Two</a></ul>", []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert pages.main_text(page) == "\n".join(want)


def test_open_blocks_inherit():
    b = [pages.Block("x", 0, False, False, k == 4) for k in range(7)]
    labels = [pages.GOOD, pages.SHORT, pages.GOOD, pages.SHORT, pages.SHORT, pages.NEAR, pages.BAD]
    assert pages.second_pass(b, labels) == [True, True, True, True, True, True, False]
    assert pages.second_pass(b[:3], [pages.BAD, pages.NEAR, pages.SHORT]) == [False] * 3


def test_long_pages_take_linear_time():
    for page in ("<a href=\"x " * 100_000, "<p title='" * 100_000, "<" * 300_000, "<div>" * 30_000 + "x" * 10, "&" * 300_000, "<!--" * 100_000, "<script>" * 50_000):
        began = time.time()
        pages.main_text(page)
        assert time.time() - began < 20
    assert pages.main_text(f"<article>{f'<p>{P1}</p>' * 5_000}</article>") == "\n".join([P1] * 5_000)


def test_odd_tables(spark):
    rows = [(None, None, None), (1, "u", None), (1, "u", f"<p>{P1}</p>"), (1, "u", f"<p>{P1}</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "row", "label"):
        table = table.withColumn(name, F.lit("clash"))
    got = pages.extract_text(table)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, None, ""), (1, "u", ""), (1, "u", P1), (1, "u", P1)], key=repr)
    assert pages.extract_text(table.limit(0)).collect() == []
