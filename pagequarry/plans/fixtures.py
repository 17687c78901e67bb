"""Inputs built by construction from the provided tables.

The texts below are plain SQL that Spark and DuckDB both run, over a table
named in braces.  Spark builds pages and lead tables from them; the oracles use
them only to know a row's key facts and state expected values in closed form.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROOT = """CASE c_custkey % 4
    WHEN 0 THEN concat('https://www.biz', k, '.example.com')
    WHEN 1 THEN concat('http://biz', k, '.example.org')
    WHEN 2 THEN concat('https://biz', k, '.example.net')
    ELSE concat('https://biz', k, '.example.com:8443') END"""

# One row per customer: key, raw and normalised URL, host, domain key.
SITES = f"""
SELECT c_custkey AS n, k, c_nationkey, c_mktsegment,
  CASE c_custkey % 4
    WHEN 0 THEN concat('https://www.biz', k, '.example.com/')
    WHEN 1 THEN concat('http://biz', k, '.example.org/start?ref=a')
    WHEN 2 THEN concat('biz', k, '.example.net')
    ELSE concat(' https://biz', k, '.example.com:8443/x/y ') END AS raw_url,
  CASE c_custkey % 4
    WHEN 0 THEN concat('https://www.biz', k, '.example.com/')
    WHEN 1 THEN concat('http://biz', k, '.example.org/start?ref=a')
    WHEN 2 THEN concat('https://biz', k, '.example.net')
    ELSE concat('https://biz', k, '.example.com:8443/x/y') END AS url,
  CASE c_custkey % 4
    WHEN 0 THEN concat('www.biz', k, '.example.com')
    WHEN 1 THEN concat('biz', k, '.example.org')
    WHEN 2 THEN concat('biz', k, '.example.net')
    ELSE concat('biz', k, '.example.com:8443') END AS host,
  CASE c_custkey % 4
    WHEN 0 THEN concat('biz', k, '.example.com')
    WHEN 1 THEN concat('biz', k, '.example.org')
    WHEN 2 THEN concat('biz', k, '.example.net')
    ELSE concat('biz', k, '.example.com:8443') END AS domain_key,
  {_ROOT} AS root
FROM (SELECT *, CAST(c_custkey AS VARCHAR(20)) AS k FROM {{customer}}) c
"""

# Pages of the sites; facets depend on independent moduli of the key.
_HEAD = """CASE n % 5
    WHEN 0 THEN concat('<title>Biz', k, ' - Home</title>')
    WHEN 1 THEN concat('<title>Biz', k, ' - Home</title><script type="application/ld+json">{{"name":"Biz ', k, ' GmbH"}}</script>')
    WHEN 2 THEN concat('<title>Biz', k, ' - Home</title><meta property="og:site_name" content=" OG ', k, ' ">')
    WHEN 3 THEN concat('<title>Biz', k, ' - Home</title>')
    ELSE '' END"""
_LOGO_HEAD = """CASE WHEN n % 7 IN (1, 2) THEN '<script type="application/ld+json">{{"logo":"https://cdn.example.com/l.svg"}}</script>'
    WHEN n % 7 IN (4, 5) THEN '<link rel="shortcut icon" href="/favicon.ico">' ELSE '' END"""
_OG = """CASE WHEN n % 7 = 5 THEN '<meta property="og:image" content="https://cdn.example.com/og.jpg?x=1">' ELSE '' END"""
_DESCRIPTION = """CASE WHEN n % 8 = 4 THEN concat('<meta name="description" content="We offer: Roofing ', k, ' &amp; Tiling ', k, '. Call us.">') ELSE '' END"""
_LOGO_BODY = """CASE n % 7
    WHEN 0 THEN '<div class="logo"><img src="/img/a.png" alt="Logo"></div>'
    WHEN 1 THEN '<div class="logo"><img src="/img/a.png" alt="Logo"></div>'
    WHEN 2 THEN concat('<a href="/"><img class="logo" src="logo-', k, '.svg" width="120" height="60"></a>')
    WHEN 3 THEN '<div class="brand"><img src="/b1.png"></div><div class="header"><img src="/h1.png" width="120px" height="60"></div>'
    WHEN 6 THEN '<img class="logo" src="/logo.bmp">'
    ELSE '' END"""
_NAME_BODY = """CASE n % 5
    WHEN 2 THEN concat('<div class="company-name"> Firma ', k, ' </div>')
    WHEN 3 THEN concat('<header><h1>Head ', k, '</h1></header>') ELSE '' END"""
_EMAIL_BODY = """CASE n % 6
    WHEN 0 THEN concat('<a href="mailto:info', k, '@example.com?subject=x">Mail</a>')
    WHEN 1 THEN concat('<div><p>sales', k, '@example.org</p></div>')
    WHEN 2 THEN concat('<div>a', k, '@example.org</div><a href="mailto:b', k, '@example.com">Mail</a>')
    WHEN 3 THEN '<a href="/kontakt">Kontakt</a>'
    WHEN 4 THEN '<div>see logo@2x.png</div>'
    ELSE concat('<div>x', k, '%20@example.com</div>') END"""


def _items(prefix, lo, hi):
    return ", ".join(f"'<li>{prefix}{i:02d}x', k, '</li>'" for i in range(lo, hi + 1))


_SERVICES_BODY = f"""CASE n % 8
    WHEN 0 THEN concat('<section id="services" class="services"><ul><li>Roofing ', k, '</li><li>Tiling ', k, '</li><li>Gardening ', k, '</li></ul></section>')
    WHEN 1 THEN concat('<section id="services"><ul><li>Roofing ', k, '</li><li>Roofing ', k, ' plus</li><li>Contact us</li><li>Tiling  ', k, '</li></ul></section>')
    WHEN 2 THEN concat('<h2>Unsere Leistungen</h2><ul><li>Roofing ', k, '</li><li>Tiling ', k, '</li><li>Gardening ', k, '</li></ul><h2>Andere</h2><ul><li>Painting ', k, '</li></ul>')
    WHEN 3 THEN concat('<p>Wir bieten Roofing ', k, ', Tiling ', k, ', Gardening ', k, '</p><div>end</div>')
    WHEN 6 THEN concat('<section id="services"><ul>', {_items('Svc', 1, 17)}, '</ul></section>')
    WHEN 7 THEN concat('<section id="services"><ul>', {_items('SvcA', 1, 10)}, '</ul></section><div class="offerings"><ul>', {_items('SvcB', 1, 10)}, '</ul></div>')
    ELSE '' END"""

SITE_PAGES = f"""
SELECT n * 2 AS page_id, url,
  concat('<!DOCTYPE html><html><head>', {_HEAD}, {_LOGO_HEAD}, {_OG}, {_DESCRIPTION}, '</head><body>',
         {_NAME_BODY}, {_LOGO_BODY}, {_EMAIL_BODY}, {_SERVICES_BODY}, '</body></html>') AS html
FROM ({SITES}) s
"""
CONTACT_PAGES = f"""
SELECT n * 2 + 1 AS page_id, concat(root, '/kontakt') AS url,
  concat('<html><body><p>kontakt', k, '@example.net</p></body></html>') AS html
FROM ({SITES}) s
"""

# Expected answers of the synthetic sites, from the key alone.
EXPECTED_NAME = """CASE n % 5 WHEN 1 THEN concat('Biz ', k, ' GmbH') WHEN 2 THEN concat('Firma ', k)
    ELSE concat('Biz', k) END"""
EXPECTED_OWN_EMAIL = """CASE n % 6 WHEN 0 THEN concat('info', k, '@example.com') WHEN 1 THEN concat('sales', k, '@example.org')
    WHEN 2 THEN concat('b', k, '@example.com') END"""
EXPECTED_EMAIL = """CASE n % 6 WHEN 0 THEN concat('info', k, '@example.com') WHEN 1 THEN concat('sales', k, '@example.org')
    WHEN 2 THEN concat('b', k, '@example.com') WHEN 3 THEN concat('kontakt', k, '@example.net') END"""
EXPECTED_LOGO = """CASE n % 7 WHEN 0 THEN concat(root, '/img/a.png') WHEN 1 THEN 'https://cdn.example.com/l.svg'
    WHEN 2 THEN concat(root, CASE WHEN n % 4 = 3 THEN '/x/' ELSE '/' END, 'logo-', k, '.svg')
    WHEN 3 THEN concat(root, '/h1.png') WHEN 4 THEN concat(root, '/favicon.ico')
    WHEN 5 THEN 'https://cdn.example.com/og.jpg?x=1' END"""


def _joined(prefix, lo, hi):
    return ", '; ', ".join(f"'{prefix}{i:02d}x', k" for i in range(lo, hi + 1))


EXPECTED_SERVICES = f"""CASE n % 8
    WHEN 0 THEN concat('Roofing ', k, '; Tiling ', k, '; Gardening ', k)
    WHEN 1 THEN concat('Roofing ', k, '; Tiling ', k)
    WHEN 2 THEN concat('Roofing ', k, '; Tiling ', k, '; Gardening ', k)
    WHEN 3 THEN concat('Wir bieten Roofing ', k, '; Tiling ', k, '; Gardening ', k)
    WHEN 4 THEN concat('Roofing ', k, '; Tiling ', k)
    WHEN 6 THEN concat({_joined('Svc', 1, 10)})
    WHEN 7 THEN concat({_joined('SvcA', 1, 10)}, '; ', {_joined('SvcB', 1, 5)}) END"""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(spark, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run a fixture text over provided tables."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def oracle_text(text: str, *names: str) -> str:
    return text.format(**{n: n for n in names})


def sites(spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, SITES, "customer")


def site_pages(spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, SITE_PAGES, "customer")


def contact_pages(spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, CONTACT_PAGES, "customer")


def site_corpus(spark, sf_dir: str) -> DataFrame:
    """Site pages and the contact pages some of them point to."""
    return site_pages(spark, sf_dir).unionByName(contact_pages(spark, sf_dir))


def pages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


#: Rows that a task gets of a table that is spread.
ROWS_PER_TASK = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table is one file and one split; spread it before per-row work.
    A table with splits enough for all cores is left as it is read: those grow with it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)), F.col(key))


# ------------------------------------------------------------------ lead tables

# A third of the named leads share one of forty names; some are really named
# like a numbered repeat.
LEADS = f"""
SELECT n AS row_idx, raw_url, url, host, domain_key,
  CASE WHEN n % 10 = 9 THEN NULL WHEN n % 20 = 7 THEN concat('Biz', CAST(n % 40 AS VARCHAR(20)), '_', CAST(n % 3 + 1 AS VARCHAR(20)))
    WHEN n % 3 = 0 THEN concat('Biz', CAST(n % 40 AS VARCHAR(20))) ELSE concat('Biz Haus ', k) END AS business_name,
  CASE WHEN n % 6 < 4 THEN concat('info', k, '@example.com') END AS email,
  CASE WHEN n % 5 = 0 THEN concat(root, '/img/a.png') END AS logo,
  CASE n % 4 WHEN 1 THEN concat('Roofing ', k, '; Tiling') WHEN 2 THEN concat('Roofing ', k, '; Tiling; Gardening') END AS services,
  CASE WHEN n % 7 = 3 THEN concat('Request error: ', k) END AS error,
  CASE WHEN n % 4 > 0 THEN n % 4 END AS stage,
  CASE WHEN n % 2 = 1 AND n % 8 < 6 THEN '2024-02-01' WHEN n % 2 = 1 THEN '' END AS next_send,
  CASE WHEN n % 3 > 0 THEN concat('https://sites.example.com/old/', k) END AS template_url
FROM ({SITES}) s
"""
_FOLDER = """CASE n % 6 WHEN 0 THEN upper(concat('Biz Haus ', k)) WHEN 1 THEN concat('Werk_', k)
    WHEN 2 THEN concat('Shop biz', k, '.example.net') WHEN 3 THEN concat('biz', k) WHEN 4 THEN concat('Biz_Haus_', k)
    ELSE concat('my_biz', k, '_site') END"""
# Published folders, and the map of some domains to them.
FOLDERS = f"""
SELECT n AS folder_idx, {_FOLDER} AS folder, concat('Site ', k, CASE WHEN n % 9 = 0 THEN ' HAUS' ELSE '' END) AS site_name,
  lpad(CAST(n % 7 + 1 AS VARCHAR(20)), 6, '0') AS main_folder, CASE WHEN n % 11 = 5 THEN '' ELSE concat('in', k) END AS inner_folder,
  CASE n % 3 WHEN 0 THEN 'elegant,minimalist,modern' WHEN 1 THEN 'elegant,modern' ELSE 'minimalist' END AS styles
FROM ({SITES}) s
"""
DOMAIN_MAP = f"""
SELECT domain_key AS domain, lpad(CAST(n % 9 + 1 AS VARCHAR(20)), 6, '0') AS main_folder, concat('biz', k) AS inner_folder,
  {_FOLDER} AS ftp_name
FROM ({SITES}) s WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
"""
# Paths of generated files: two generations, three styles, one stray folder name.
ARTIFACTS = f"""
SELECT concat('/srv/out/', generation, '/', site, '/', style, '/index.html') AS path, generation, site, style FROM (
  SELECT CASE WHEN c_nationkey < 12 THEN 'website_templates_20240301-101500' ELSE 'website_templates_20231231-235959' END AS generation,
    CASE WHEN n % 13 = 0 THEN '__pycache__' ELSE concat('site_', k) END AS site, style
  FROM ({SITES}) s CROSS JOIN (SELECT 'modern' AS style UNION ALL SELECT 'elegant' UNION ALL SELECT 'minimalist') t) x
"""


def encoded(lines: DataFrame) -> DataFrame:
    """``page_id, url, content_type, body`` of ``page_id, url, content_type, charset, line``: bodies as servers send them."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            bodies = [t.encode(c) for t, c in zip(b.column("line").to_pylist(), b.column("charset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("content_type"), pa.array(bodies, pa.binary())],
                                             ["page_id", "url", "content_type", "body"])
    return lines.mapInArrow(run, "page_id long, url string, content_type string, body binary")
