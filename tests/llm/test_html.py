from seqloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var x = "</p><article>";</script></head><body>
<header>Site &amp; name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy {n}</div>
<div class="cookie-notice">We use cookies</div><aside class="sidebar"><p>Side</p></aside>
<article><h1>Title  {n} &lt;b&gt;</h1><p><b>Bold {n}.<br><p>One
 two&nbsp;three &amp;amp; four</p><form><p>Mail</p><input></form><ul><li>item <i>a</i></li><li>b</ul>
<div class="share">Share this</div><section class="comments"><p>First!</p></section><p>Last {n}</article><footer>&copy; {n}</footer>"""


def want(n):
    return f"Title {n} <b>\nBold {n}.\nOne two three &amp; four\nitem a\nb\nLast {n}"


def test_slots_of_the_template(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i), "x") for i in range(12)]
    rows += [(50, "http://alone.example/", PAGE.format(n=50), "x"), (51, None, PAGE.format(n=51), "x"), (52, "http://h0.example/e", "", "x"), (53, "http://h0.example/n", None, "x"), (0, rows[0][1], rows[0][2], "x"), (54, "not a url", "<p>only &#233; text", "x"), (55, "http://h1.example/t", PAGE.format(n=55)[:700], "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in [*range(12), 50, 51]:
        assert by[i].text == want(i) and by[i].n_chars == len(want(i))
    assert by[52].text == by[53].text == "" and by[54].text == "only é text"
    assert "Buy" not in by[55].text and html.main_text(df.limit(0)).collect() == []


def test_equal_occurrence_vectors_make_a_class(spark):
    rows = [(i, "http://h.example/", f"<body><main><h2>x</h2>{'<p>a</p>' * (i % 3)}<div>{i}</div></main></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", html.host("url"))
    vectors = html.token_vectors(df)
    sizes = df.groupBy("host").count().withColumnRenamed("count", "n_pages")
    t = html.templates(vectors, sizes).first()
    assert t.container == "body/main"
    once = [c for c in t.template if c.once]
    assert len(once) == 1 and set(once[0].paths) == {"body", "body/main", "body/main/h2", "body/main/div"}
    assert any(c.paths == ["body/main/p"] and not c.once for c in t.template)


def test_vectors_don_t_depend_on_how_pages_are_dealt(spark):
    rows = [(i, "http://h.example/", f"<body>{'<p>a</p>' * (i % 4)}<!--{i}--></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", html.host("url"))
    assert sorted(html.token_vectors(df.repartition(7)).collect()) == sorted(html.token_vectors(df.coalesce(1)).collect())


def test_text_that_every_page_repeats_in_neutral_elements_is_template(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><p>Story {n}</p><p>and more {n}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"http://plain.example/{i}", page.format(n=i)) for i in range(8)]
    rows += [(20 + i, "http://same.example/", page.format(n=0)) for i in range(5)]  # one page five times has no template
    rows += [(30, "http://plain.example/a", "<body><article><p>Welcome to our site</p></article></body>"), (31, "http://plain.example/e", page.replace("Story {n}", "").replace("and more {n}", ""))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    by = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert [by[i] for i in range(8)] == [f"Story {i}\nand more {i}" for i in range(8)]
    assert {by[20 + i] for i in range(5)} == {"Welcome to our site\nStory 0\nand more 0\nAll rights kept"}
    assert by[30] == "Welcome to our site" and by[31] == "Welcome to our site\nAll rights kept"


def host_pages(spark, pages, name="one.example"):
    df = spark.createDataFrame([(i, f"http://{name}/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(html.main_text(df).collect(), key=lambda r: r.page_id)]


def prose(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n)) + "."


def test_slots_of_neutral_elements(spark):
    """Neither article nor main nor telling names: what varies most is main text, links and rails are not."""
    page = "<body><div class='a1'><ul><li><a href='/'>Go {i}</a></li><li><a>More {i}</a></li></ul></div><h1>Title {i}</h1><div class='b2'><p>{one}</p><p>{two}</p></div><div class='c3'>Rail text {i}</div><div class='d4'>Made by {i} with care</div></body>"
    pages = [page.format(i=i, one=prose(i), two=prose(i + 100)) for i in range(6)]
    want = [f"Title {i}\n{prose(i)}\n{prose(i + 100)}" for i in range(6)]
    assert host_pages(spark, pages) == want
    # a page that looks otherwise goes by the host's template, not by its own text: the ablated one differs
    short = page.format(i=9, one="Few words.", two="No more.").replace("Rail text 9", prose(500))
    assert host_pages(spark, [*pages, short])[-1] == "Title 9\nFew words.\nNo more." != html.extract(short)


def test_elements_are_numbered_among_their_like(spark):
    page = "<body><div>Menu {i}</div><div><p>{one}</p><p>And {i}</p></div><div>Foot {i}</div></body>"
    assert host_pages(spark, [page.format(i=i, one=prose(i)) for i in range(5)]) == [f"{prose(i)}\nAnd {i}" for i in range(5)]
    parts = "<body><div class='all'><div><p>{a}</p></div><div><p>{b}</p></div></div></body>"
    assert host_pages(spark, [parts.format(a=prose(i, 65), b=prose(i + 50, 35)) for i in range(5)]) == [f"{prose(i, 65)}\n{prose(i + 50, 35)}" for i in range(5)]


def test_teasers_around_the_text(spark):
    page = "<body><article><p>Teaser {i}</p></article><div class='body'><p>{one}</p></div><article><p>Other {i}</p></article></body>"
    assert host_pages(spark, [page.format(i=i, one=prose(i)) for i in range(5)]) == [prose(i) for i in range(5)]
    assert html.extract(page.format(i=1, one=prose(1))) == prose(1)


def test_a_word_that_stands_once_is_no_name(spark):
    page = "<body><article><p>{one}</p>{more}<div class='share'>Share {i}</div><section class='comments'><p>Reader {i}: {long}</p></section></article></body>"
    pages = [page.format(i=i, one=prose(i), more="<div class='share price'><p>Share price rose</p></div>" if i == 3 else "", long=prose(i + 900)) for i in range(60)]
    got = host_pages(spark, pages)
    assert got == [prose(i) + ("\nShare price rose" if i == 3 else "") for i in range(60)]


def test_menus_inside_the_container(spark):
    page = "<body><main><p>{one} <a href='/'>a link {i}</a> goes on.</p><ul><li><a>Next {i}</a></li><li><a>Last {i}</a></li></ul></main></body>"
    got = host_pages(spark, [page.format(i=i, one=prose(i)) for i in range(5)])
    assert got == [f"{prose(i)} a link {i} goes on." for i in range(5)]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "<p>" + prose(1) + "</p>" + "</div>" * 20_000
    long = "<body><article>" + "".join(f"<p>{prose(i, 5)}</p></b></div>" for i in range(20_000)) + "</article></body>"
    walk = html.Walk()
    for _ in range(20_000):
        walk.open("div", {})
    assert sum(map(len, walk.paths)) < 20_000 * (html.LONG + 40)
    got = host_pages(spark, [deep, long])
    assert got[0] == prose(1) and got[1].count("\n") == 19_999


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(None, None, "<article>x</article>", "c", "d"), (1, "http://h.example/", None, "c", "d"), (1, "http://h.example/", "<p>a", "c", "d"), (1, "http://h.example/", "<p>a", "c", "d")], "page_id bigint, url string, html string, container string, host string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.main_text(df).collect()) == [(0, "x", 1), (1, "", 0), (1, "a", 1), (1, "a", 1)]
