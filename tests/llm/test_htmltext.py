"""Main text of hand-built pages, and templates over the pages of a host."""

from tracewright.llm import htmltext

CASES = [
    ("<nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Four&nbsp;five</article><footer>end</footer>", "Head & more\nOne two three\nFour five"),
    ("", ""), (None, ""), ("plain  text", "plain text"), ("<p>a</p>b<p>c", "a\nb\nc"), ("<p>x < y &lt; z &#233;&eacute;&#x1F600;</p>", "x < y < z éé😀"),
    ("<article><header><h1>T</h1></header><p>body</p><footer>tags</footer><aside>more</aside></article>", "T\nbody"),
    ("<header>site</header><main><p>m</p><form><input value=1><label>mail</label></form></main>", "m"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes</p><noscript>no</noscript>", "yes"),
    ("<article><p>keep</p><div id='comments'><article class='comment'><p>reader</p></article></div></article>", "keep"),
    ("<div class='cookie-notice'>accept</div><div class='sidebar widget'>side</div><div class=content><p>text</p></div>", "text"),
    ("<div role='navigation'>n</div><p hidden>h</p><p aria-hidden='true'>h</p><p style='display: none'>h</p><p>shown</p>", "shown"),
    ("<nav>open menu<article><p>text</p></article>", "text"), ("<article><p>cut off", "cut off"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "a b\nc"), ("<article></article><p>outside</p>", "outside"), ("</p></div><p>x</p>", "x"),
    ("<article><ul class='shared'><li>one</li></ul><p>shadow ads-free</p></article>", "one\nshadow ads-free"), ("<title>t</title><body><p>b", "b"),
]


def test_hand_built_pages(spark, long_text):
    rows = [(i, f"http://host{i}/", h, "x") for i, (h, _) in enumerate(CASES)] + [(500, None, f"<p>{long_text}</p>" * 2, "y"), (0, "http://host0/", CASES[0][0], "x")]
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    for i, (source, want) in enumerate(CASES):
        assert got[i] == want, source
    flat = " ".join(long_text.split())
    assert got[500] == flat + "\n" + flat and all(r.n_chars == len(r.text) for r in out)


def page(k, article="", host="h.example"):
    return (k, f"https://user@{host.upper()}:80/{k}", f"<body><div class='top'>Site name</div><div><p>Our motto</p></div>{article}<div class='low'>All rights reserved</div></body>")


def texts(spark, rows):
    return {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_template_of_a_host_goes(spark):
    rows = [page(k, f"<div><p>story {k}</p><p>shared by some</p></div>" if k % 2 else f"<div><p>story {k}</p></div>") for k in range(20)]
    assert texts(spark, rows) == {k: f"story {k}" + ("\nshared by some" if k % 2 else "") for k in range(20)}


def test_few_or_equal_pages_make_no_template(spark):
    few = [page(k, f"<p>story {k}</p>") for k in range(htmltext.PAGES - 1)]
    assert texts(spark, few)[0] == "Site name\nOur motto\nstory 0\nAll rights reserved"
    copies = [page(k, "<p>one story</p>") for k in range(50)]
    assert set(texts(spark, copies).values()) == {"Site name\nOur motto\none story\nAll rights reserved"}


def test_articles_are_not_template(spark):
    rows = [page(k, f"<article><p>same on all</p><p>{k}</p></article>") for k in range(12)]
    assert texts(spark, rows) == {k: f"same on all\n{k}" for k in range(12)}


def test_empty_table(spark):
    assert htmltext.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_broken_markup_takes_time_by_its_length():
    import time

    many = ["<a href=\"" * 120_000, "<b>" * 300_000, "<" * 1_000_000, "<!" * 500_000, "<a '" * 250_000, "<b>" * 100_000 + "<option></option>" * 30_000, "<b>" * 50_000 + "</i>" * 200_000,
            "<nav>" + "<b>" * 100_000 + "<article>" * 60_000, "<p>" * 300_000, "<ul>" + "<li><b>" * 120_000, "<script>" * 100_000, "<!--" * 250_000, "&amp" * 250_000, "<div class='" * 80_000]
    for source in many:
        start = time.time()
        htmltext.Page(source)
        assert time.time() - start < 8, source[:20]


def test_an_endless_quote_hides_nothing_before_it():
    page = htmltext.Page("<article><p title=\"a > b\">one <i>two</i></p><p>three <a href=\"x>four</a></p></article>")
    assert [t for t, _, _ in page.blocks] == ["one two", "three four"]
