"""Queries over pages: URL family, node table, and the four extractors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions import rules, text, urls
from ..operators import emails, logos, names, records, report, services, structure
from ..operators.shared import skew_join
from ..sources import pages as page_source
from . import fixtures as fx
from .registry import query

SITES = "(" + fx.oracle_text(fx.SITES, "customer") + ") s"
NETLOC = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def netloc_sql(u):
    return NETLOC.format(u=u)


def normalized_sql(u):
    return f"CASE WHEN starts_with(trim({u}), 'http://') OR starts_with(trim({u}), 'https://') THEN trim({u}) ELSE 'https://' || trim({u}) END"


def display_sql(u):
    host = f"replace({netloc_sql(u)}, 'www.', '')"
    label = f"split_part({host}, '.', 1)"
    return f"CASE WHEN contains({host}, '.') AND length({label}) >= 3 THEN upper({label}[1:1]) || lower({label}[2:]) END"


def unescaped_sql(c):
    """Decode the entities of the test pages; HTML allows them without the semicolon."""
    for entity, char in [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&amp;?", "&")]:
        c = f"regexp_replace({c}, '{entity}', '{char}', 'g')"
    return c


TITLE_SQL = "regexp_extract(html, '<title>(.*?)</title>', 1)"
RAW_CLEAN_SQL = rf"nullif(trim(regexp_replace(trim({TITLE_SQL}), '[-–|]\s*(.+?)$', '')), '')"
CLEAN_SQL = rf"nullif(trim(regexp_replace(trim({unescaped_sql(TITLE_SQL)}), '[-–|]\s*(.+?)$', '')), '')"
EMAILS_SQL = r"""list_filter(regexp_extract_all({c}, '[^\x00-\x7F]?\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b'),
    lambda e: NOT regexp_matches(e, '^[^\x00-\x7F]|(\.png|\.jpg|\.gif|\.svg)$|[%&=;]'))"""


def parsed_pages(spark, d):
    return page_source.parse_pages(fx.spread(fx.pages(spark, d), "page_id"))


def parsed_sites(spark, d):
    return emails.parse_with_emails(fx.spread(fx.site_pages(spark, d), "page_id"))


def all_urls(spark, d):
    """Page URLs as they are and the raw URLs of the synthetic sites."""
    return fx.pages(spark, d).select("url").unionByName(fx.sites(spark, d).select(F.col("raw_url").alias("url")))


ALL_URLS = f"(SELECT url FROM pages UNION ALL SELECT raw_url FROM {SITES}) u"


# ------------------------------------------------------------------ URLs

#: Pages that name their charset in the response, in a meta element, by a mark, or not at all.
FETCHED = [("gb18030", "text/html; charset=GBK", ""), ("shift_jis", None, '<meta charset="Shift_JIS">'), ("utf-16-le", None, "\ufeff"),
           ("utf-8", None, ""), ("euc_kr", "text/html; charset='euc-kr'", ""), ("big5", "", "<META content='text/html; charset=big5'>")]
FAR = "屋"


@query("page_scan", f"""SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars,
    CASE page_id % 6 WHEN 1 THEN '{FETCHED[1][2]}' WHEN 5 THEN '{FETCHED[5][2].replace("'", "''")}' ELSE '' END || '{FAR}' || url AS head FROM pages""")
def page_scan(spark, d):
    """The given pages as they were stored, and a first line of each fetched in one of six charsets."""
    pages = page_source.page_scan(spark, f"{d}/pages.parquet")
    kinds = F.array(*[F.struct(F.lit(c).alias("charset"), F.lit(t).cast("string").alias("content_type"), F.lit(h).alias("head")) for c, t, h in FETCHED])
    lines = pages.withColumn("k", F.get(kinds, (F.col("page_id") % len(FETCHED)).cast("int"))) \
        .select("page_id", "url", F.col("k.content_type").alias("content_type"), F.col("k.charset").alias("charset"),
                F.concat("k.head", F.lit(FAR), "url").alias("line"))
    heads = page_source.decoded_pages(fx.encoded(lines)).select("page_id", F.col("html").alias("head"))
    return pages.select("page_id", "url", F.char_length("html").cast("long").alias("n_chars")).join(heads, "page_id")


@query("keep_url_only", f"SELECT url FROM {ALL_URLS}")
def keep_url_only(spark, d):
    return all_urls(spark, d).withColumn("email", F.lit("x")).select("url")


@query("normalize_url", f"SELECT url, {normalized_sql('url')} AS normalized FROM {ALL_URLS}")
def normalize_url(spark, d):
    return all_urls(spark, d).select("url", urls.normalize_url("url").alias("normalized"))


@query("url_netloc", f"SELECT url, {netloc_sql('url')} AS netloc FROM (SELECT {normalized_sql('url')} AS url FROM {ALL_URLS})")
def url_netloc(spark, d):
    return all_urls(spark, d).select(urls.normalize_url("url").alias("url")).select(
        "url", urls.netloc("url").alias("netloc"))


@query("domain_key", f"""SELECT url, nullif(regexp_replace(lower({netloc_sql('trim(url)')}), '^www\\.', ''), '') AS domain_key
    FROM {ALL_URLS}""")
def domain_key(spark, d):
    return all_urls(spark, d).select("url", urls.domain_key("url").alias("domain_key"))


@query("domain_slug", f"""SELECT host, regexp_replace(split_part(regexp_replace(lower(host), '^www\\.', ''), '.', 1), '[^a-z0-9]', '', 'g') AS slug
    FROM (SELECT {netloc_sql('url')} AS host FROM pages UNION ALL SELECT upper(host) FROM {SITES})""")
def domain_slug(spark, d):
    hosts = fx.pages(spark, d).select(urls.netloc("url").alias("host")).unionByName(
        fx.sites(spark, d).select(F.upper("host").alias("host")))
    return hosts.select("host", urls.domain_slug("host").alias("slug"))


@query("domain_display_name", f"SELECT url, {display_sql('url')} AS display_name FROM (SELECT {normalized_sql('url')} AS url FROM {ALL_URLS})")
def domain_display_name(spark, d):
    return all_urls(spark, d).select(urls.normalize_url("url").alias("url")).select(
        "url", urls.domain_display_name("url").alias("display_name"))


REFERENCES = ["/kontakt", "logo.svg", "../up/./b", "?q=1", "#top", "//cdn.example.com/x", "https://a.example.com/z", "",
              "mailto:x@example.com", "a//b/.."]


@query("resolve_url", f"""
    WITH b AS (SELECT *, CASE WHEN n % 4 = 3 THEN '/x/' ELSE '/' END AS dir, split_part(url, ':', 1) AS scheme,
                      CASE n % 4 WHEN 0 THEN '/' WHEN 1 THEN '/start' WHEN 2 THEN '' ELSE '/x/y' END AS path FROM {SITES})
    SELECT url, ref, CASE ref WHEN '/kontakt' THEN root || ref WHEN 'logo.svg' THEN root || dir || ref
        WHEN '../up/./b' THEN root || '/up/b' WHEN '?q=1' THEN root || path || ref
        WHEN '#top' THEN url || ref WHEN '//cdn.example.com/x' THEN scheme || ':' || ref
        WHEN '' THEN url WHEN 'a//b/..' THEN root || dir || 'a/' ELSE ref END AS resolved
    FROM b, (SELECT unnest({REFERENCES}) AS ref)""")
def resolve_url(spark, d):
    refs = fx.sites(spark, d).select("url", F.explode(F.lit(REFERENCES)).alias("ref"))
    return refs.select("url", "ref", urls.resolve_url("url", "ref").alias("resolved"))


def _with_tails(df, tails):
    return df.withColumn("tail", F.explode(tails))


@query("is_image_url", f"""
    SELECT root || path AS url, regexp_matches(lower(path), '^[^?#;]*\\.(jpe?g|png|gif|svg|webp|ico)([?#;].*)?$') AS is_image
    FROM {SITES}, (SELECT unnest(['/a.PNG', '/b.jpg?x=1', '/c.bmp', '/d?f=e.png', '/e.ico#f', '/g.webp;v=1', '/png']) AS path)""")
def is_image_url(spark, d):
    paths = F.lit(["/a.PNG", "/b.jpg?x=1", "/c.bmp", "/d?f=e.png", "/e.ico#f", "/g.webp;v=1", "/png"])
    return _with_tails(fx.sites(spark, d), paths).select(F.concat("root", "tail").alias("url")) \
        .select("url", urls.is_image_url("url").alias("is_image"))


@query("logo_basename", f"""
    SELECT root || path AS url, name AS basename FROM {SITES}, (SELECT unnest(
      [{{'path': '/img/a.png', 'name': 'a.png'}}, {{'path': '/b.jpg?x=1', 'name': 'b.jpg'}}, {{'path': '/logo', 'name': 'logo.png'}},
       {{'path': '/dir/', 'name': 'logo.png'}}], recursive := true))""")
def logo_basename(spark, d):
    paths = F.lit(["/img/a.png", "/b.jpg?x=1", "/logo", "/dir/"])
    return _with_tails(fx.sites(spark, d), paths).select(F.concat("root", "tail").alias("url")) \
        .select("url", urls.logo_basename("url").alias("basename"))


# ------------------------------------------------------------------ text rules

WORDS_SQL = "['" + "', '".join(rules.BOILERPLATE_WORDS) + "']"


@query("common_text_filter", f"""
    SELECT conv_id, turn, text FROM conversations
    WHERE length(text) >= 4 AND len(list_filter({WORDS_SQL}, lambda w: contains(lower(text), w))) = 0""")
def common_text_filter(spark, d):
    return fx.table(spark, d, "conversations").where(~text.is_boilerplate("text")).select("conv_id", "turn", "text")


@query("service_length_filter", """
    SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) > 3 AND length(line) < 120""")
def service_length_filter(spark, d):
    lines = fx.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(text.length_between("line", rules.SERVICE_LENGTH))


@query("email_is_valid_mailto", f"""
    SELECT n, 'mailto:' || k || tail AS href, CASE tail WHEN '@example.com?subject=x' THEN k || '@example.com'
      WHEN '@b.example@c' THEN k || '@b.example@c' WHEN ' @example.org ' THEN k || ' @example.org' END AS email
    FROM {SITES}, (SELECT unnest(['@example.com?subject=x', '@local', '', '@b.example@c', '@b@c.example', ' @example.org ']) AS tail)""")
def email_is_valid_mailto(spark, d):
    tails = F.lit(["@example.com?subject=x", "@local", "", "@b.example@c", "@b@c.example", " @example.org "])
    hrefs = _with_tails(fx.sites(spark, d), tails).select("n", F.concat(F.lit("mailto:"), "k", "tail").alias("href"))
    return hrefs.select("n", "href", emails.mailto_address(F.col("href")).alias("email"))


@query("email_false_positive", f"""
    SELECT 'a' || k || tail AS email, tail NOT IN ('@example.com', '@2x.jpeg', '@2x.webp', '@x.PNG') AS rejected
    FROM {SITES}, (SELECT unnest(['@example.com', '@2x.png', '@2x.jpeg', '@2x.webp', '@x.PNG', '@x.svg', '%20@example.com']) AS tail)""")
def email_false_positive(spark, d):
    tails = F.lit(["@example.com", "@2x.png", "@2x.jpeg", "@2x.webp", "@x.PNG", "@x.svg", "%20@example.com"])
    found = _with_tails(fx.sites(spark, d), tails).select(F.concat(F.lit("a"), "k", "tail").alias("email"))
    return found.select("email", emails.is_false_positive("email").alias("rejected"))


NEXT_PART = "(SELECT a.p_partkey AS part, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) p"
JACCARD_SQL = """CAST(len(list_intersect(string_split(x, ' '), string_split(y, ' '))) AS DOUBLE)
    / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' '))))"""


def neighbour_names(spark, d):
    part = fx.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("x")).join(
        part.select((F.col("p_partkey") - 1).alias("part"), F.col("p_name").alias("y")), "part")


@query("text_similarity", f"""SELECT part, round(CASE WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE {JACCARD_SQL} END, 9) AS similarity
    FROM {NEXT_PART}""")
def text_similarity(spark, d):
    return neighbour_names(spark, d).select("part", F.round(text.similarity("x", "y"), 9).alias("similarity"))


@query("words_jaccard", f"SELECT part, round({JACCARD_SQL}, 9) AS jaccard FROM {NEXT_PART}")
def words_jaccard(spark, d):
    return neighbour_names(spark, d).select("part", F.round(
        text.jaccard(text.words(F.lower("x")), text.words(F.lower("y"))), 9).alias("jaccard"))


# ------------------------------------------------------------------ node table

@query("html_nodes", """
    SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY ALL""")
def html_nodes(spark, d):
    return structure.html_nodes(parsed_pages(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"


def _n(source, pattern):
    return f"CAST(len(regexp_extract_all({source}, '{pattern}')) AS BIGINT)"


@query("css_simple_match", f"""
    SELECT page_id, selector, n FROM (
      SELECT page_id, 'h1' AS selector, {_n('html', '<h1>')} AS n FROM pages
      UNION ALL SELECT page_id, '.ad', {_n('html', 'class="ad"')} FROM pages
      UNION ALL SELECT page_id, 'a[href*="/" i]', {_n('html', '<a href="[^"]*/')} FROM pages) WHERE n > 0""")
def css_simple_match(spark, d):
    return structure.css_matches(parsed_pages(spark, d), ["h1", ".ad", 'a[href*="/" i]']) \
        .groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@query("css_descendant_match", f"""
    SELECT page_id, selector, n FROM (
      SELECT page_id, 'article p' AS selector, {_n(ARTICLE, '<p>')} AS n FROM pages
      UNION ALL SELECT page_id, 'nav li a', {_n(NAV, '<a ')} FROM pages) WHERE n > 0""")
def css_descendant_match(spark, d):
    return structure.css_matches(parsed_pages(spark, d), ["article p", "nav li a"]) \
        .groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@query("direct_parent", f"""
    SELECT n * 2 AS page_id, i.src, i.parent_tag, i.parent_href FROM {SITES}, LATERAL (SELECT unnest(CASE n % 7
      WHEN 0 THEN [{{'src': '/img/a.png', 'parent_tag': 'div', 'parent_href': NULL}}]
      WHEN 1 THEN [{{'src': '/img/a.png', 'parent_tag': 'div', 'parent_href': NULL}}]
      WHEN 2 THEN [{{'src': 'logo-' || k || '.svg', 'parent_tag': 'a', 'parent_href': '/'}}]
      WHEN 3 THEN [{{'src': '/b1.png', 'parent_tag': 'div', 'parent_href': NULL}}, {{'src': '/h1.png', 'parent_tag': 'div', 'parent_href': NULL}}]
      WHEN 6 THEN [{{'src': '/logo.bmp', 'parent_tag': 'body', 'parent_href': NULL}}] ELSE [] END) AS i)""")
def direct_parent(spark, d):
    return structure.direct_parents(parsed_sites(spark, d), "img").select(
        "page_id", F.col("attrs")["src"].alias("src"), "parent_tag", "parent_href")


@query("following_siblings_until_heading", f"""
    SELECT n * 2 AS page_id, 'Unsere Leistungen' AS heading, 'ul' AS sibling_tags FROM {SITES} WHERE n % 8 = 2
    UNION ALL SELECT n * 2, 'Andere', 'ul' FROM {SITES} WHERE n % 8 = 2
    UNION ALL SELECT n * 2, 'Head ' || k, '' FROM {SITES} WHERE n % 5 = 3""")
def following_siblings_until_heading(spark, d):
    return structure.heading_siblings(parsed_sites(spark, d)).select(
        "page_id", "heading", F.array_join("sibling_tags", " ").alias("sibling_tags"))


LI = """SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS text,
    unnest(range(1, 1 + len(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)))) AS pos FROM pages"""


@query("next_sibling", f"""SELECT page_id, pos, text, lead(text) OVER (PARTITION BY page_id ORDER BY pos) AS next_text FROM ({LI})""")
def next_sibling(spark, d):
    rows = structure.next_siblings(parsed_pages(spark, d), "nav li")
    first = F.min("node_id").over(Window.partitionBy("page_id"))
    return rows.select("page_id", ((F.col("node_id") - first) / 2 + 1).cast("long").alias("pos"), "text", "next_text")


@query("first_match", f"""SELECT page_id, trim({unescaped_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS h1 FROM pages""")
def first_match(spark, d):
    return parsed_pages(spark, d).select("page_id", structure.first_text("h1").alias("h1"))


@query("limit_per_scope", f"SELECT page_id, pos, text FROM ({LI}) WHERE pos <= 3")
def limit_per_scope(spark, d):
    return structure.first_k(parsed_pages(spark, d), "nav li", 3)


@query("title_from_raw_html", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def title_from_raw_html(spark, d):
    return fx.pages(spark, d).select("page_id", names.title_from_raw_html("html").alias("title"))


@query("meta_lookup", f"""SELECT n * 2 AS page_id, CASE WHEN n % 5 = 2 THEN 'OG ' || k END AS site_name,
    CASE WHEN n % 8 = 4 THEN 'We offer: Roofing ' || k || ' & Tiling ' || k || '. Call us.' END AS description FROM {SITES}""")
def meta_lookup(spark, d):
    return parsed_sites(spark, d).select(
        "page_id", N.meta_content([("property", "og:site_name"), ("name", "og:site_name")]).alias("site_name"),
        N.meta_content([("name", "description"), ("property", "og:description")]).alias("description"))


@query("jsonld_fields", f"""
    SELECT n * 2 AS page_id, 'Biz ' || k || ' GmbH' AS name, NULL AS logo FROM {SITES} WHERE n % 5 = 1
    UNION ALL SELECT n * 2, NULL, 'https://cdn.example.com/l.svg' FROM {SITES} WHERE n % 7 IN (1, 2)""")
def jsonld_fields(spark, d):
    docs = parsed_sites(spark, d).select("page_id", F.explode(N.json_ld()).alias("v"))
    return docs.select("page_id", N.json_string(F.col("v"), "$.name").alias("name"),
                       N.json_string(F.col("v"), "$.logo").alias("logo"))


@query("link_text_match", f"SELECT n * 2 AS page_id, CASE WHEN n % 6 = 3 THEN '/kontakt' END AS href FROM {SITES}")
def link_text_match(spark, d):
    return parsed_sites(spark, d).select("page_id", emails.contact_href().alias("href"))


# ------------------------------------------------------------------ e-mail

@query("email_regex_candidates", f"""
    SELECT 'pages' AS source, page_id AS id, unnest({EMAILS_SQL.format(c='html')}) AS email FROM pages
    UNION ALL SELECT 'documents', doc_id, unnest({EMAILS_SQL.format(c='text')}) FROM documents""")
def email_regex_candidates(spark, d):
    pages = fx.pages(spark, d).select(F.lit("pages").alias("source"), F.col("page_id").alias("id"),
                                      F.explode(emails.regex_emails("html")).alias("email"))
    documents = fx.table(spark, d, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"),
        F.explode(emails.regex_emails("text")).alias("email"))
    return pages.unionByName(documents)


@query("email_mailto_candidates", f"""SELECT n * 2 AS page_id, CASE n % 6 WHEN 0 THEN 'info' ELSE 'b' END || k || '@example.com' AS email
    FROM {SITES} WHERE n % 6 IN (0, 2)""")
def email_mailto_candidates(spark, d):
    return parsed_sites(spark, d).select("page_id", F.explode(emails.mailto_emails()).alias("email"))


@query("email_contact_page", f"SELECT n * 2 AS page_id, root || '/kontakt' AS contact_url, 'kontakt' || k || '@example.net' AS email FROM {SITES} WHERE n % 6 = 3")
def email_contact_page(spark, d):
    corpus = emails.parse_with_emails(fx.spread(fx.site_corpus(spark, d), "page_id"))
    fields = records.materialize(corpus.select(
        "page_id", "url", emails.own_email().alias("email"), emails.contact_url().alias("contact_url")), "emails")
    missing = fields.where("email is null and contact_url is not null")
    return emails.with_contact_emails(missing, emails.emails_by_url(fields)).select("page_id", "contact_url", "email")


@query("email_first", f"SELECT n * 2 AS page_id, {fx.EXPECTED_OWN_EMAIL} AS email FROM {SITES}")
def email_first(spark, d):
    return parsed_sites(spark, d).select("page_id", emails.own_email().alias("email"))


@query("first_wins_dedupe", f"""SELECT n * 2 AS page_id, CASE n % 6 WHEN 0 THEN 'info' || k || '@example.com' WHEN 1 THEN 'sales' || k || '@example.org'
    WHEN 2 THEN 'b' || k || '@example.com; a' || k || '@example.org' ELSE '' END AS emails FROM {SITES}""")
def first_wins_dedupe(spark, d):
    return parsed_sites(spark, d).select("page_id", F.array_join(emails.page_emails(), "; ").alias("emails"))


# ------------------------------------------------------------------ logo

def _logo_candidates(spark, d, make):
    df = parsed_sites(spark, d).withColumn("imgs", logos.images())
    return df.select("page_id", F.explode(make()).alias("c")).select(
        "page_id", "c.value", F.col("c.score").cast("long").alias("score"), "c.method")


_IMAGE = "CASE n % 7 WHEN 0 THEN root || '/img/a.png' WHEN 1 THEN root || '/img/a.png' WHEN 2 THEN root || CASE WHEN n % 4 = 3 THEN '/x/' ELSE '/' END || 'logo-' || k || '.svg' END"


@query("logo_selector_candidates", f"""
    SELECT n * 2 AS page_id, {_IMAGE} AS value, CASE n % 7 WHEN 2 THEN 105 ELSE 70 END::BIGINT AS score,
      unnest(CASE n % 7 WHEN 2 THEN ['img.logo', 'img[src*="logo" i]'] ELSE ['.logo img', 'img[alt*="logo" i]'] END) AS method
    FROM {SITES} WHERE n % 7 IN (0, 1, 2)
    UNION ALL SELECT n * 2, root || '/h1.png', 50, '.header img' FROM {SITES} WHERE n % 7 = 3
    UNION ALL SELECT n * 2, root || '/b1.png', 50, '.brand img' FROM {SITES} WHERE n % 7 = 3""")
def logo_selector_candidates(spark, d):
    return _logo_candidates(spark, d, logos.selector_candidates)


@query("logo_score", f"""
    SELECT n * 2 AS page_id, {_IMAGE} AS value, CASE n % 7 WHEN 2 THEN 105 ELSE 70 END::BIGINT AS score FROM {SITES} WHERE n % 7 IN (0, 1, 2)
    UNION ALL SELECT n * 2, root || '/h1.png', 50 FROM {SITES} WHERE n % 7 = 3
    UNION ALL SELECT n * 2, root || '/b1.png', 50 FROM {SITES} WHERE n % 7 = 3""")
def logo_score(spark, d):
    return parsed_sites(spark, d).select("page_id", F.explode(logos.images()).alias("i")).select(
        "page_id", "i.value", F.col("i.score").cast("long").alias("score"))


@query("logo_icon", f"SELECT n * 2 AS page_id, root || '/favicon.ico' AS value, 10::BIGINT AS score, 'icon' AS method FROM {SITES} WHERE n % 7 IN (4, 5)")
def logo_icon(spark, d):
    return _logo_candidates(spark, d, logos.icon_candidates)


@query("logo_og_image", f"SELECT n * 2 AS page_id, 'https://cdn.example.com/og.jpg?x=1' AS value, 30::BIGINT AS score, 'og:image' AS method FROM {SITES} WHERE n % 7 = 5")
def logo_og_image(spark, d):
    return _logo_candidates(spark, d, logos.og_image_candidates)


@query("logo_jsonld", f"SELECT n * 2 AS page_id, 'https://cdn.example.com/l.svg' AS value, 80::BIGINT AS score, 'json-ld' AS method FROM {SITES} WHERE n % 7 IN (1, 2)")
def logo_jsonld(spark, d):
    return _logo_candidates(spark, d, logos.json_ld_candidates)


@query("logo_best", f"SELECT n * 2 AS page_id, {fx.EXPECTED_LOGO} AS logo FROM {SITES}")
def logo_best(spark, d):
    return logos.with_logo(parsed_sites(spark, d)).select("page_id", "logo")


# ------------------------------------------------------------------ name

def _name_candidates(df, make):
    return df.select("page_id", F.explode(make()).alias("c")).select(
        "page_id", "c.value", F.col("c.score").cast("long").alias("score"), "c.method")


@query("name_title", f"SELECT page_id, {CLEAN_SQL} AS value, 70::BIGINT AS score FROM pages WHERE {CLEAN_SQL} IS NOT NULL")
def name_title(spark, d):
    return _name_candidates(parsed_pages(spark, d), names.title_candidates).drop("method")


@query("name_jsonld", f"SELECT n * 2 AS page_id, 'Biz ' || k || ' GmbH' AS value, 90::BIGINT AS score, 'json-ld' AS method FROM {SITES} WHERE n % 5 = 1")
def name_jsonld(spark, d):
    return _name_candidates(parsed_sites(spark, d), names.json_ld_candidates)


@query("name_headers", f"""
    SELECT n * 2 AS page_id, 'Firma ' || k AS value, 80::BIGINT AS score, '.company-name' AS method FROM {SITES} WHERE n % 5 = 2
    UNION ALL SELECT n * 2, 'Head ' || k, 60, 'h1' FROM {SITES} WHERE n % 5 = 3
    UNION ALL SELECT n * 2, 'Head ' || k, 70, 'header h1' FROM {SITES} WHERE n % 5 = 3""")
def name_headers(spark, d):
    return _name_candidates(parsed_sites(spark, d).drop("regex_emails"), names.header_candidates)


@query("name_meta", f"SELECT n * 2 AS page_id, 'OG ' || k AS value, 80::BIGINT AS score, 'og:site_name' AS method FROM {SITES} WHERE n % 5 = 2")
def name_meta(spark, d):
    return _name_candidates(parsed_sites(spark, d), names.meta_candidates)


@query("name_domain", f"SELECT url, {display_sql('url')} AS value, 30::BIGINT AS score FROM pages WHERE {display_sql('url')} IS NOT NULL")
def name_domain(spark, d):
    return fx.pages(spark, d).select("url", F.explode(names.domain_candidates()).alias("c")).select(
        "url", "c.value", F.col("c.score").cast("long").alias("score"))


@query("name_best", f"""SELECT url, coalesce({CLEAN_SQL}, {display_sql('url')}) AS business_name FROM pages
    UNION ALL SELECT url, {fx.EXPECTED_NAME} FROM {SITES}""")
def name_best(spark, d):
    # Each by itself: pages in many splits would hide that the sites are one.
    both = fx.spread(fx.pages(spark, d), "page_id").unionByName(fx.spread(fx.site_pages(spark, d), "page_id"))
    return names.with_name(page_source.parse_pages(both)).select("url", "business_name")


@query("candidate_top1", f"SELECT page_id, url, coalesce({RAW_CLEAN_SQL}, {display_sql('url')}) AS business_name FROM pages")
def candidate_top1(spark, d):
    return fx.pages(spark, d).select("page_id", "url", names.native_name("html", "url").alias("business_name"))


@query("candidate_union", f"""
    SELECT method, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT 'title' AS method FROM {SITES} WHERE n % 5 < 4 UNION ALL SELECT 'json-ld' FROM {SITES} WHERE n % 5 = 1
      UNION ALL SELECT unnest(['.company-name', 'og:site_name']) FROM {SITES} WHERE n % 5 = 2
      UNION ALL SELECT unnest(['h1', 'header h1']) FROM {SITES} WHERE n % 5 = 3 UNION ALL SELECT 'domain' FROM {SITES}) GROUP BY ALL""")
def candidate_union(spark, d):
    return parsed_sites(spark, d).select(F.explode(names.name_candidates()).alias("c")) \
        .groupBy("c.method").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ services

_THREE = "'Roofing ' || k || '; Tiling ' || k || '; Gardening ' || k"
_FOUR = "'Roofing ' || k || '; Roofing ' || k || ' plus; Tiling  ' || k"
_S, _A, _B = (f"concat({fx._joined(p, 1, 10)})" for p in ("Svc", "SvcA", "SvcB"))


def _raw(spark, d, column):
    return services.with_raw_services(parsed_sites(spark, d)).select(
        "page_id", F.array_join(column, "; ").alias("items")).where("items != ''")


@query("services_sections", f"""
    SELECT n * 2 AS page_id, CASE n % 8 WHEN 0 THEN {_THREE} || '; ' || {_THREE} || '; ' || {_THREE}
      WHEN 1 THEN {_FOUR} || '; ' || {_FOUR} WHEN 6 THEN {_S} || '; ' || {_S}
      ELSE {_A} || '; ' || {_B} || '; ' || {_A} END AS items FROM {SITES} WHERE n % 8 IN (0, 1, 6, 7)""")
def services_sections(spark, d):
    return _raw(spark, d, "services_m1")


@query("services_after_headings", f"SELECT n * 2 AS page_id, {_THREE} AS items FROM {SITES} WHERE n % 8 = 2")
def services_after_headings(spark, d):
    return _raw(spark, d, "services_m2")


@query("services_phrase_paragraphs", f"SELECT n * 2 AS page_id, 'Wir bieten ' || {_THREE} AS items FROM {SITES} WHERE n % 8 = 3")
def services_phrase_paragraphs(spark, d):
    return _raw(spark, d, "services_m3")


@query("services_meta_description", f"SELECT n * 2 AS page_id, 'Roofing ' || k || '; Tiling ' || k AS items FROM {SITES} WHERE n % 8 = 4")
def services_meta_description(spark, d):
    return _raw(spark, d, "services_m4")


@query("services_dedup", f"""SELECT n * 2 AS page_id, unnest(string_split({fx.EXPECTED_SERVICES}, '; ')) AS service,
    unnest(range(1, 1 + len(string_split({fx.EXPECTED_SERVICES}, '; ')))) AS pos FROM {SITES}""")
def services_dedup(spark, d):
    kept = services.with_services(parsed_sites(spark, d))
    # With a plain posexplode Spark first filters by the list's size, which computes all methods again for that.
    return kept.select("page_id", F.posexplode_outer("service_list").alias("p", "service")).where("p is not null").select(
        "page_id", "service", (F.col("p") + 1).cast("long").alias("pos"))


@query("top15_services", f"""SELECT n * 2 AS page_id, CAST(coalesce(len(string_split({fx.EXPECTED_SERVICES}, '; ')), 0) AS BIGINT) AS n_services
    FROM {SITES}""")
def top15_services(spark, d):
    return services.with_services(parsed_sites(spark, d)).select(
        "page_id", F.size("service_list").cast("long").alias("n_services"))


# ------------------------------------------------------------------ records

@query("scrape_record", f"""
    SELECT url, {EMAILS_SQL.format(c='html')}[1] AS email, NULL AS logo, coalesce({CLEAN_SQL}, {display_sql('url')}) AS business_name,
      NULL AS services, NULL AS error FROM pages""")
def scrape_record(spark, d):
    return records.scrape_records(fx.spread(fx.pages(spark, d), "page_id")).drop("page_id")


@query("scrape_record_sites", f"""
    SELECT url, {fx.EXPECTED_EMAIL} AS email, {fx.EXPECTED_LOGO} AS logo, {fx.EXPECTED_NAME} AS business_name,
      {fx.EXPECTED_SERVICES} AS services, NULL AS error FROM {SITES}""")
def scrape_record_sites(spark, d):
    sites = fx.spread(fx.site_pages(spark, d), "page_id")
    return records.scrape_records(sites, fx.spread(fx.contact_pages(spark, d), "page_id")).drop("page_id")


@query("page_contact_join", f"SELECT n * 2 AS page_id, root || '/kontakt' AS contact_url, n * 2 + 1 AS contact_page_id FROM {SITES} WHERE n % 6 = 3")
def page_contact_join(spark, d):
    links = parsed_sites(spark, d).select("page_id", emails.contact_url().alias("contact_url")) \
        .where("contact_url is not null")
    corpus = fx.site_corpus(spark, d).select(F.col("page_id").alias("contact_page_id"), F.col("url").alias("contact_url"))
    links = records.materialize(links, "links")
    return skew_join(links, corpus, "contact_url", ["page_id"], how="inner").select("page_id", "contact_url", "contact_page_id")


@query("scrape_success_stats", """SELECT CAST(count(*) FILTER (page_id % 50 != 49) AS BIGINT) AS success,
    CAST(count(*) FILTER (page_id % 50 = 49) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total FROM pages""")
def scrape_success_stats(spark, d):
    broken = F.when(F.col("page_id") % 50 != 49, F.col("html"))
    pages = fx.spread(fx.pages(spark, d), "page_id").withColumn("html", broken)
    return report.scrape_success_stats(page_source.parse_pages(pages).withColumnRenamed("parse_error", "error"))
