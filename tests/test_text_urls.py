"""Text and URL expressions against plain Python."""

import random
import re
import time
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagequarry.functions import rules, text, urls
from pagequarry.operators import emails, names

BASES = ["https://a.example.com/", "http://b.example.org/start?ref=a", "https://c.example.net", "https://d.example.com:8443/x/y",
         "https://e.example.com/x/y/", "https://f.example.com/x//y/z?q#f"]
REFS = ["", "/", "g", "./g", "g/", "../g", "../../g", "../../../g", "/../g", "/./g", ".", "..", "./", "../", "g/.", "g/..", "a//b",
        "a//", "?y", "g?y", "#s", "g#s", "g?y/./x", "//h.example.com/p", "https://i.example.com/q/../r", "mailto:x@example.com",
        "data:image/png;base64,AAAA", "a/b/../c", "/a/b/../../c/./d", "ä ö.png", "x;y=1/../z"]


def test_resolve_url_equals_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string")
    got = {(x.b, x.r): x.u for x in df.select("b", "r", urls.resolve_url("b", "r").alias("u")).collect()}
    wrong = {p: (got[p], urljoin(*p)) for p in pairs if got[p] != urljoin(*p)}
    assert not wrong


def test_netloc_and_image_path(spark):
    us = BASES + ["//x.example.com/a", "no-scheme.example.com/a", "https://u:p@h.example.com:1/x.PNG?y=.gif", "https://müller.example/ä.jpg;v=1",
                  "https://a.example.com/x.png/", ""]
    df = spark.createDataFrame([(u,) for u in us], "u string")
    ext = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico")
    for r in df.select("u", urls.netloc("u").alias("n"), urls.is_image_url("u").alias("i")).collect():
        assert r.n == urlparse(r.u).netloc, r.u
        assert r.i == urlparse(r.u).path.lower().endswith(ext), r.u


def test_normalize_keeps_null(spark):
    df = spark.createDataFrame([(None,), (" x.example.com ",), ("HTTP://y.example.com",)], "u string")
    assert [r[0] for r in df.select(urls.normalize_url("u")).collect()] == [
        None, "https://x.example.com", "https://HTTP://y.example.com"]


def test_batch_folder_never_truncates(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "n long")
    assert [r[0] for r in df.select(urls.batch_folder("n")).collect()] == ["000007", "1234567"]


def test_clean_title(spark):
    titles = ["Biz - Home", "Coca-Cola", "A | B", "A -", "- A", "A –\n B\nC", "A - B", "x-\u0085y", " plain "]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    for r in df.select("t", names.clean_title("t").alias("c")).collect():
        assert r.c == (re.sub(r"[-–|]\s*(.+?)$", "", r.t.strip()).strip() or None), repr(r.t)


def similarity(a, b):
    a, b = a.lower(), b.lower()
    if a in b or b in a:
        return 0.9
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0


def test_drop_near_duplicates_equals_the_loop(spark):
    rng = random.Random(3)
    vocabulary = ["roof", "tile", "Wood", "paint", "garden", "x", "door work"]
    lists = [[" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 40))] for _ in range(60)]

    def loop(items):
        kept = []
        for t in (" ".join(i.split()) for i in items):
            if len(t) > 3 and t.lower() not in [k.lower() for k in kept] and not any(similarity(t, k) > 0.8 for k in kept):
                kept.append(t)
        return kept[:15]

    df = spark.createDataFrame([(x,) for x in lists], "i array<string>")
    got = [r[0] for r in df.select(text.drop_near_duplicates(F.col("i"))).collect()]
    assert got == [loop(x) for x in lists]


def test_similarity(spark):
    pairs = [("Foo bar", "foo BAR baz"), ("a b c", "b c d"), ("", "x"), ("  ", "x y"), ("same", "same"), ("a b", "b a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.similarity("a", "b").alias("s")).collect():
        assert abs(r.s - similarity(r.a, r.b)) < 1e-12, r


def test_safe_folder_name(spark):
    cases = {"Müller & Söhne": "Muller__Sohne", "../etc/passwd": "etc_passwd", "a b  c": "a_b_c", "._x_.": "x", "Ünï/cödé.txt": "Uni_code.txt",
             "日本": "", "www.x.example": "www.x.example"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.f for r in df.select("s", text.safe_folder_name("s").alias("f")).collect()} == cases


def test_email_search_equals_the_plain_pattern(spark):
    rng = random.Random(8)
    letters = ["a", "B", "7", ".", "-", "_", "%", "+", "@", "@", "é", " ", "|", "<", "com", ".de", "x.org", "\U0001f600"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(8000)]
    texts += ["a@b.com.x@y.org", ".info@a.de", "éinfo@a.de", "é.info@a.de", "a@b.cc@d.ee", "a@b.c|d", "-%-@a.bc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all("t", F.lit("(?U)" + rules.EMAIL_PATTERN), F.lit(0))
    rows = df.select("t", plain.alias("a"), F.regexp_extract_all("t", F.lit(emails.EMAIL_SEARCH), F.lit(1)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a or []) for r in rows) > 500


def test_email_search_is_linear_in_long_runs(spark):
    runs = spark.range(1).select(F.explode(F.array(*[F.concat(F.repeat(F.lit(r), 2_500_000), F.lit(" i@a.de")) for r in ("a.", "ab", "-_", "@.", "a@")])).alias("t"))
    started = time.perf_counter()
    found = runs.select(emails.regex_emails("t").alias("e")).collect()
    assert [list(r.e) for r in found] == [["i@a.de"]] * 5 and time.perf_counter() - started < 30
