"""The element tree, selectors, and the extractors on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import nodes as N
from pagequarry.operators import emails, names, records, services, structure
from pagequarry.sources.pages import parse_pages


def page(spark, *htmls, url="https://www.site.example.com/a/"):
    rows = [(i, url, h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def tree(spark, html):
    rows = structure.html_nodes(parse_pages(page(spark, html))).orderBy("node_id").collect()
    return [(r.tag, r.node_id, r.end_id, r.parent_id, r.depth) for r in rows]


def test_unclosed_tags_nest(spark):
    assert tree(spark, "<p><b>x<p>y</p>z</div></b>") == [
        ("p", 1, 3, 0, 0), ("b", 2, 3, 1, 1), ("p", 3, 3, 2, 2)]


def test_end_tag_closes_up_to_its_name(spark):
    assert tree(spark, "<div><i><br>a</div><p>b") == [
        ("div", 1, 3, 0, 0), ("i", 2, 3, 1, 1), ("br", 3, 3, 2, 2), ("p", 4, 4, 0, 0)]


def test_text_leaves_out_scripts_styles_and_comments(spark):
    html = "<div>a<script>var x = '</p>';</script><!-- c --><style>p{}</style>b &amp; <b>c</b></div>"
    df = parse_pages(page(spark, html))
    assert df.select(structure.first_text("div")).head()[0] == "ab & c"
    assert df.select(structure.first_text("script")).head()[0] == "var x = '</p>';"


def test_missing_body_is_an_error_and_does_not_fail_the_job(spark):
    rows = {r.page_id: r for r in records.scrape_records(page(spark, None, "", "<title>Good Shop</title>")).collect()}
    assert rows[0].error and rows[0].business_name is None
    assert rows[1].error is None and rows[1].business_name == "Site"
    assert rows[2].error is None and rows[2].business_name == "Good Shop"


def test_extra_columns_pass_through(spark):
    df = page(spark, "<p>x</p>").withColumn("tags", F.array(F.lit("a"))).withColumn("n", F.lit(1.5))
    row = parse_pages(df).head()
    assert row.tags == ["a"] and row.n == 1.5 and row.text == "x"


def test_batches_split_by_node_count(spark):
    df = page(spark, *["<p>a</p><p>b</p>"] * 20).coalesce(1)
    out = parse_pages(df, max_nodes_per_batch=3).orderBy("page_id").collect()
    assert [r.page_id for r in out] == list(range(20)) and all(len(r.nodes) == 2 for r in out)


@pytest.mark.parametrize("selector, hits", [
    (".logo img", 2), ("header .logo img", 1), ("a img", 1), ("div.logo", 2), ("#x", 1), ('img[src*="LOGO" i]', 1)])
def test_selectors(spark, selector, hits):
    html = ('<header><div class="big logo"><img src="/logo.png"></div></header>'
            '<div class="logo" id="x"><a><img src="b.png"></a></div><img src="c.png">')
    df = structure.css_matches(parse_pages(page(spark, html)), [selector])
    assert df.count() == hits


def test_siblings_stop_at_the_same_or_a_higher_heading(spark):
    html = "<h2>a</h2><p>1</p><h3>b</h3><h4>c</h4><div>2</div><h2>d</h2><p>3</p>"
    rows = structure.heading_siblings(parse_pages(page(spark, html))).orderBy("node_id").collect()
    assert [r.sibling_tags for r in rows] == [["p", "h3", "h4", "div"], ["h4", "div"], ["div"], ["p"]]


def services_of(spark, html):
    return services.with_services(emails.parse_with_emails(page(spark, html))).select("service_list").head()[0]


@pytest.mark.parametrize("html, expected", [
    ('<div class="my-Service-box"><div class="card"><p>x</p><span class="title">Roofing work</span></div></div>', ["Roofing work"]),
    ("<h2>What we do</h2><div><p>Tiling</p><li>Painting</li></div><h3>Sub</h3><ol><li>Drilling</li></ol>",
     ["Tiling", "Painting", "Drilling"]),
    ('<h2>Solutions</h2><section class="Grid-3"><div class="col-4"><h5>Plumbing</h5></div></section>', ["Plumbing"]),
    ("<p>Our services are great</p>", ["Our services are great"]),
    ("<p>we offer this</p><p>Roofing; Tiling</p>", ["we offer this", "Roofing", "Tiling"]),
    ('<meta property="og:description" content="Experts in Roofing and Tiling. More">', ["Roofing", "Tiling"]),
    ('<meta name="description" content=""><meta property="og:description" content="We offer Roofing">', []),
    ('<div id="services"><li>Home</li><li>abc</li><li>Roofing</li></div>', ["Roofing"]),
    ("<p>nothing here</p>", []),
])
def test_services(spark, html, expected):
    assert services_of(spark, html) == expected


def test_later_methods_need_a_low_raw_count(spark):
    three = '<div class="services"><li>Roofing A</li><li>Roofing A</li><li>Roofing A</li></div>'
    assert services_of(spark, three + "<h2>Solutions</h2><ul><li>Painting</li></ul>") == ["Roofing A"]


def name_of(spark, html):
    return names.with_name(emails.parse_with_emails(page(spark, html))).select("business_name").head()[0]


@pytest.mark.parametrize("html, expected", [
    ("<title>Coca-Cola</title>", "Coca"), ("<title> - </title>", "-"), ("<title>A | B - C</title>", "A"),
    ('<script type="application/ld+json">[{"name":"List"}]</script><title>T1</title>', "T1"),
    ('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"name":{"a":1},"publisher":{"name":"Pub"}}</script>', "Pub"),
    ('<script type="application/ld+json">{"publisher":{"x":1},"organization":{"name":"Org"}}</script>', "Site"),
    ('<script type="application/ld+json">{"publisher":"x","organization":{"name":"Org"}}</script>', "Org"),
    ('<meta property="og:title" content=""><meta name="og:title" content="No">', "Site"),
    ('<meta name="application-name" content="App"><div class="brand">Brand</div>', "App"),
])
def test_names(spark, html, expected):
    assert name_of(spark, html) == expected


def test_contact_page_in_the_same_corpus_and_shared_by_many(spark):
    root = "https://hub.example.com"
    rows = [(i, f"{root}/p{i}", '<a href="/Impressum">IMPRESSUM</a>') for i in range(50)]
    rows += [(90, f"{root}/Impressum", '<a href="mailto: x@example.com ?s=1">m</a>'), (91, f"{root}/z", "none")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.email for r in records.scrape_records(df).collect()}
    assert all(got[i] == "x@example.com" for i in [*range(50), 90]) and got[91] is None


def test_regex_emails_next_to_letters_and_pipes(spark):
    texts = ["müller@x.de", "a.b+c@x-y.example.co", "x@y.c|m", "a@b.c", "a@b.example.", "ä a@b.example x@z.png"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", emails.regex_emails(F.col("t")).alias("e"))
    got = {r.t: r.e for r in df.collect()}
    assert list(got.values()) == [[], ["a.b+c@x-y.example.co"], ["x@y.c|m"], [], ["a@b.example"], ["a@b.example"]]


def test_logo_needs_integer_sizes(spark):
    from pagequarry.operators import logos
    html = '<a href="#"><img src="l.png" width=" 20 " height="200" class="MyLogo"></a><img src="k.png" width="20px" height="20">'
    df = parse_pages(page(spark, html)).select(F.explode(logos.images()).alias("i")).select("i.value", "i.score")
    assert {(r.value, r.score) for r in df.collect()} == {
        ("https://www.site.example.com/a/l.png", 50 + 15 + 10 + 15), ("https://www.site.example.com/a/k.png", 50)}


def test_node_intervals_are_consistent(spark):
    from support import SF
    df = parse_pages(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))
    n = N.exploded(df)
    bad = n.alias("a").join(n.alias("b"), F.expr("a.page_id = b.page_id AND a.parent_id = b.node_id")).where(
        "a.end_id > b.end_id OR a.node_id <= b.node_id OR a.depth != b.depth + 1")
    assert bad.count() == 0
