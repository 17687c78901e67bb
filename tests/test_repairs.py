"""Cases that once gave wrong rows: line breaks in CSV cells, hidden text, repeated keys, odd URLs, charsets."""

import random

from pyspark.sql import functions as F

from pagequarry.functions import nodes
from pagequarry.functions.urls import authority
from pagequarry.operators import linkage, maintain
from pagequarry.operators.shared import ranked
from pagequarry.sources import files, pages, sinks


def test_lead_names_with_breaks_quotes_and_commas_come_back(spark, tmp_path):
    names = ["Foo\nBar GmbH", 'say "hi", twice', "a,b;c", "tab\there", "plain", "\"", "x\n\ny"]
    leads = spark.createDataFrame([(i, f"https://s{i}.example.com", n) for i, n in enumerate(names)],
                                  "row_idx long, url string, business_name string").repartition(3)
    sinks.write_leads(leads, str(tmp_path / "leads"))
    back = files.lead_scan(spark, str(tmp_path / "leads")).orderBy("row_idx").collect()
    assert [(r.url, r.business_name) for r in back] == [(f"https://s{i}.example.com", n) for i, n in enumerate(names)]
    upload = files.lead_upload(spark, str(tmp_path / "leads")).orderBy("row_idx").collect()
    assert [r.business_name for r in upload] == names


def test_row_order_is_gapless_over_uneven_splits(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for i in range(12):
        lines = [f"{i}-{j}-" + "x" * rng.choice([0, 1, 300]) for j in range(rng.randint(0, 400))]
        (tmp_path / f"f{i:03d}.txt").write_text("".join(f"{line}\n" for line in lines))
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.text_log_scan(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == want and [r.pos for r in rows] == list(range(len(want)))


def test_text_inside_a_template_is_hidden_at_any_depth(spark):
    html = "<body><p>seen</p><template><ul><li>Hidden <b>deep</b></li></ul></template><ruby>a<rp>(<i>x</i></rp></ruby><p>end</p></body>"
    r = pages.parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).head()
    assert r.text == "seenaend"
    assert next(n.raw for n in r.nodes if n.tag == "template") == "Hidden deep"


def test_the_last_of_repeated_json_keys_counts(spark):
    html = '<script type="application/ld+json">{"name":"A B","name":"Real Name"}</script>'
    fresh = spark.newSession()
    parsed = pages.parse_pages(fresh.createDataFrame([(1, html)], "page_id long, html string"))
    name = F.transform(nodes.json_ld(), lambda v: nodes.json_string(v, "$.name"))
    assert parsed.select(name.alias("n")).head().n == ["Real Name"]


def test_repeated_map_keys_do_not_multiply_leads(spark):
    leads = spark.createDataFrame([(0, "https://www.a.example.com/x", "A"), (1, "https://b.example.com", "B")],
                                  "row_idx long, url string, business_name string")
    entries = spark.createDataFrame([(0, "a.example.com", "old", "x", "f0"), (1, "a.example.com", "new", "y", "f1")],
                                    "pos long, domain string, main_folder string, inner_folder string, ftp_name string")
    rows = linkage.domain_map_left_join(leads, entries, 7).orderBy("row_idx").collect()
    assert [(r.row_idx, r.main_folder) for r in rows][0] == (0, "new") and len(rows) == 2
    folders = spark.createDataFrame([(0, "f1", "m", "i")], "folder_idx long, folder string, main_folder string, inner_folder string")
    assert [(r.row_idx, r.folder) for r in linkage.domain_map_then_deployed(leads, folders, entries).collect()] == [(0, "f1")]
    merged = maintain.merge_map(entries.select("pos", "domain", "main_folder"), entries.select("pos", "domain", "inner_folder", "main_folder"), "domain")
    assert [(r.domain, r.main_folder) for r in merged.collect()] == [("a.example.com", "new")]


def test_urls_without_an_authority_have_a_host(spark):
    urls = ["https://A.example.com/x", "x//b.example.com/y", "nothing", None, "https:///c/d"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(authority("u").alias("a")).collect()
    assert [r.a for r in rows] == ["a.example.com", "b.example.com", None, None, ""]


def test_bodies_in_the_named_charset(spark):
    cases = [("Grüße €", "windows-1252"), ("Grüße", "ISO-8859-1"), ("Привет", "windows-1251"), ("Žluť", "iso-8859-2"), ("Привет", "koi8-r"), ("日本", "utf-16"), ("é", "utf-8"), ("é", "utf-8")]
    df = spark.createDataFrame([(bytearray(t.encode(c)), f"text/html; charset={c}") for t, c in cases] + [(bytearray("é".encode()), None)],
                               "body binary, kind string")
    assert [r.t for r in df.select(pages.decoded_body(F.col("body"), F.col("kind")).alias("t")).collect()] == [t for t, _ in cases] + ["é"]


def test_rank_over_row_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    assert [r.n for r in ranked(files.text_log_scan(spark, str(tmp_path)), "pos", name="n").orderBy("n").collect()] == [1, 2, 3]


def test_streams_over_several_batches(spark, tmp_path):
    from pagequarry.streaming import streams
    batches = [[(1, "a.example.com/x", "<title>Old</title>"), (2, "b.example.com", "<title>B</title>")],
               [(1, "a.example.com/x", "<title>Newer</title>"), (3, "k.example.com", "<title>K</title>"), (3, "k.example.com", "<title>K2</title>")],
               [(4, " ", "<title>D</title>"), (2, "b.example.com", "<title>B</title>")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("https://k.example.com",)], "url string")
    fresh = streams.new_urls(streams.folder_stream(spark, str(tmp_path / "in")), known).collect()
    assert sorted(r.url for r in fresh) == ["https://a.example.com/x", "https://b.example.com"]
    merged = streams.extract_upsert(streams.folder_stream(spark, str(tmp_path / "in"))).collect()
    names = {r.page_id: r.business_name for r in merged}
    assert len(merged) == len(names) == 4 and names[1] == "Newer" and names[3] == "K2"
