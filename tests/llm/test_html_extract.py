import html
import re

from stridegraph.llm.html_extract import extracted, main_text


def test_pages_give_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br|div|ul|li)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>Head &amp; title</h1></header><p>First <i>par</i>agraph of the text,
with   spaces &lt;here&gt; and words enough to be text.</p><ul><li>one</li><li>two</li></ul><div class="ad">Buy now</div><form><input value=x>send</form>
<p>Last.</p></article><section id="comments"><p>A long comment that a reader wrote about the text above, and more.</p></section></main>
<aside><p>Sidebar text that is long enough to look like text of some kind.</p></aside><footer>&copy; all</footer></body></html>"""


def test_parts_that_are_not_text_go():
    assert main_text(PAGE) == "Head & title First paragraph of the text, with spaces <here> and words enough to be text. one two Last."


def test_without_article_the_densest_region_is_taken():
    body = "".join(f"<p>Sentence number {i} of the main text, long enough to be dense with words.</p>" for i in range(6))
    page = f"<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div id=x><h2>Heading</h2>{body}</div><div><a href=1>next</a><a href=2>last</a></div></body>"
    got = main_text(page)
    assert got.startswith("Heading Sentence number 0") and got.endswith("number 5 of the main text, long enough to be dense with words.")


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("plain") == "plain" and "b" in main_text("<p>a<b>b<p>c</x></div>")
    rows = [(1, "u", None), (1, "u", "<p>x"), (None, None, "<article><p>y</p></article>" * 2)]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "x", "y y"]


PROSE = "This sentence is part of the main text, and it is long enough to count as such. " * 3


def test_pages_without_article_or_main():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h1>A heading</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div><p><a href='#'>About</a> | <a href='#'>Imprint</a></p></div></body>"
    want = " ".join(["A heading", PROSE.strip(), "Short.", PROSE.strip()])
    assert main_text(page) == want
    table = f"<table><tr><td>{links}</td><td><p>{PROSE}</p><p>{PROSE}</p></td></tr></table>"
    assert main_text(table) == " ".join([PROSE.strip()] * 2)


def test_a_name_does_not_drop_most_of_the_text():
    for name in ("search-results", "skip-content", "related", "notice", "alert"):
        page = f"<body><div id='{name}'><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div></body>"
        assert main_text(page) == " ".join([PROSE.strip()] * 2)
        page = f"<body><article><p>{PROSE}</p><div class='{name}'>See also this.</div><p>{PROSE}</p></article></body>"
        assert main_text(page) == " ".join([PROSE.strip()] * 2)


def test_deep_nesting_takes_linear_time(spark):
    import time

    page = lambda n: "<div>" * n + f"<p>{PROSE}</p>" + "</div></b>" * n
    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        assert main_text(page(n)) == PROSE.strip()
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5
    names = ("text", "n_chars", "row")
    docs = spark.createDataFrame([(1, "u", page(5), *["x"] * 3)] * 2 + [(None, None, None, *["x"] * 3)], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in names))
    rows = extracted(docs).collect()
    assert sorted(r.text for r in rows) == ["", PROSE.strip(), PROSE.strip()] and extracted(docs.limit(0)).count() == 0
