import html
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tillroll.llm import html_extract as H
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "The river of the town is in the north and it was for a long time the border of the land, as they say, and it is still that."
OTHER = "Das Haus ist in der Stadt und die Stadt ist mit dem Fluss für die Leute auch ein Ort, an dem sich der Handel und das Leben treffen."


def test_query_against_the_article_elements(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op3_html_extract"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a\n\t b<p>c&nbsp;d", "a b\nc d"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><p>out</p>", "T\nx"),
    ("<article><p>one</p><div class='ad-box'>buy</div><!-- <p>no</p> --><aside>s</aside><p>two <b>b</b>old</p>"
     "<section id=comments><p>first!</p></section><form>f</form></article>", "one\ntwo bold"),
    ("<main><script>if (a<b) '</p>'</script><style>p{}</style><p title='a>b'>x &lt; y</p></main>", "x < y"),
    ("<article><p>a<script>x", "a"), ("<article><p>1 < 2 and <3", "1 < 2 and <3"), ("<article><p>a</p></article><p class=cookieNotice>c</p>", "a"),
    (f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Title</h2><div>{LONG}</div><p>short one</p><div>{OTHER}</div><div><a href=z>{LONG}</a></div>",
     f"Title\n{LONG}\nshort one\n{OTHER}"),
    (f"<ul><li><a href=q>Contact us here, at any time of the day, please</a></li></ul><p>tail</p><p>{LONG}</p>", f"tail\n{LONG}"),
    ("<article>" + "<p>w</p>" * 20_000 + "</article>", "\n".join(["w"] * 20_000)),
])
def test_pages(page, text):
    assert H.extract(page) == text


@given(st.text(st.sampled_from("<>/!-\"'= apdivscrt&;")))
def test_any_markup_ends(page):
    H.extract(page)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, H.extract_pages(df).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)]
    assert H.extract_pages(df.limit(0)).count() == 0
