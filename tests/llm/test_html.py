import html
import re

import pytest

from lintel.llm.html_text import extract_main_text, main_text, op3_html_main_text

P = "<p>" + "word " * 40 + "</p>"
WORDS = " ".join(["word"] * 40)
CASES = {
    "": "", "plain text only": "plain text only", "<p>a<b>b</b>c</p><p>d</p>": "abc d", "<p>x < y & z &lt;b&gt; &amp;amp; &#x41;&nbsp;q": "x < y & z <b> &amp; A q", "<script>var a='<p>hi</p>'</script><p>ok": "ok",
    "<!-- <p>no</p> --><p>one<p>two<ul><li>a<li>b</ul>": "one two a b", "<p>a<br>b</p>": "a b", "<title>t</title><style>p{}</style><p>x</p>": "x", "<p>unclosed <a href='x": "unclosed <a href='x", "a<!--": "a", "a<!-- <b>": "a", "a<script>b<i>c": "a", "<p>a<!doctype x": "a", "a<![CDATA[<b>&amp;]]>c": "a<b>&amp;c",
}


@pytest.mark.parametrize("page", CASES)
def test_small(page):
    assert main_text(page) == CASES[page]


@pytest.mark.parametrize(
    "extra",
    ["<nav><ul><li><a href=x>Home page</a></ul></nav>", "<header><h2>Site name here</h2></header>", "<footer>&copy; all of it " + "foot " * 60 + "</footer>", "<aside>" + "<p>side " * 90 + "</aside>", "<div class='cookie-notice'><p>" + "accept " * 90 + "</p></div>", '<div id="ad-top">' + "buy " * 99 + "</div>",
     "<form><label>Name</label><textarea>your text</textarea><select><option>one</select></form>", "<div id=comments><p>" + "first! " * 200 + "</p></div>", "<section class=related-posts><p>" + "more " * 90 + "</p></section>", "<noscript>enable it</noscript>", "<div hidden>" + "secret " * 99 + "</div>", "<div role='navigation'>a b c</div>"],
)
@pytest.mark.parametrize("shell", ["<html><body>{x}<article><h1>T</h1>{p}{p}</article></body></html>", "<body><div id=content class='main has-sidebar'><h1>T</h1>{p}{p}</div>{x}", "{x}<main><h1>T</h1>{p}{x}{p}</main>"])
def test_boilerplate_goes(shell, extra):
    if "<main>" in shell and extra.startswith("<header>"):
        shell = shell.replace("{p}{x}", "{p}")  # an article's own header belongs to it
    assert main_text(shell.format(x=extra, p=P)) == f"T {WORDS} {WORDS}"


def test_density_without_names():
    """Only density tells the menu and the list of links from the text."""
    links = "".join(f"<li><a href='{i}'>link {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><h1>T</h1>{P}{P}<p>short</p></div><div>{links}</div></body>"
    assert main_text(page) == f"T {WORDS} {WORDS} short"


def test_density_selects_and_lists_clean(sf):
    """Density alone finds nearly all articles; with no list of names the whole body finds none."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    whole = [main_text(p) for p in pages]
    same = lambda **how: sum(main_text(p, **how) == w for p, w in zip(pages, whole)) / len(pages)
    assert same(named=False) > 0.95 and same(named=False, dense=False) == 0
    junk = "<div><div><h3>More of it</h3><p>Read more here</p><p>And here</p></div></div>"
    page = f"<body>{junk}<div><h1>T</h1>{P}{P}<div id=comments><p>" + "first " * 90 + f"</p></div></div>{junk}</body>"
    assert main_text(page) == f"T {WORDS} {WORDS}" and main_text(page, dense=False) != main_text(page) != main_text(page, named=False)


HARD = {
    "open tags": lambda n: "<a " * n, "one end": lambda n: "<a " * n + ">", "quotes": lambda n: '<a href="x> y' * n + "'", "mixed quotes": lambda n: "<a b='\"> y" * n, "nested": lambda n: "<div>" * n + "x", "strange ends": lambda n: "<div>" * n + "</x>" * n,
    "scripts": lambda n: "<script>" + "</script " * n, "paragraph around": lambda n: "<p><table><td>" + "<div>" * n, "comments": lambda n: "<!--" * n, "items": lambda n: "<ul>" + "<span>" * n + "<li>" * n, "classes": lambda n: "<a " + "class='" * n + ">", "bold": lambda n: "<b><p>" * n,
}


@pytest.mark.parametrize("kind", HARD)
def test_time_in_proportion(kind):
    """A page eight times as long takes about eight times as long, not 64 times."""
    import time

    def took(n):
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            main_text(HARD[kind](n))
            best = min(best, time.process_time() - began)
        return best

    assert took(40_000) < 24 * max(took(5_000), 0.004)


def test_deep_and_long():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<article>" + "<p>" + "word " * 400_000 + "</article>")) == 5 * 400_000 - 1


def test_frame(spark):
    rows = [(1, "u", "<p>\U0001f600 a", "t"), (1, "u", "<p>\U0001f600 a", "t"), (2, None, None, None), (None, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("", 0), ("\U0001f600 a", 3), ("\U0001f600 a", 3)] and extract_main_text(df.limit(0)).collect() == []


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op3_html_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))
