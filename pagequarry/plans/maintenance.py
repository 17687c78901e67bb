"""Queries over lead tables: sources, sinks, linkage, maintenance, reports."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.text import safe_folder_name
from ..operators import linkage, maintain, matching, report
from ..operators.shared import last_per_key, materialize, new_path, ranked
from ..sources import files, parts, sinks
from . import fixtures as fx
from .extraction import ALL_URLS, all_urls, netloc_sql, normalized_sql
from .registry import query

COUNTER = 12
BASE = rules.SITE_BASE_URL
YEAR = 2024
SITE_START = 5000


def sql(text):
    return "(" + fx.oracle_text(text, "customer") + ")"


LEADS, DOMAIN_MAP, FOLDERS = sql(fx.LEADS), sql(fx.DOMAIN_MAP), sql(fx.FOLDERS)
CSV_COLUMNS = ["url", "email", "logo", "business_name", "services", "error", "template_url"]


def leads(spark, d):
    return fx.built(spark, d, fx.LEADS, "customer")


def domain_map(spark, d):
    return fx.built(spark, d, fx.DOMAIN_MAP, "customer")


def folders(spark, d):
    return fx.built(spark, d, fx.FOLDERS, "customer")


# ------------------------------------------------------------------ sources and sinks

SPLIT = 16 << 20


@contextmanager
def small_ranges(spark, size):
    """Input splits of a few hundred bytes, so that the given tables' files are cut inside records; of at most ``SPLIT``
    bytes, so that those of large tables do not grow with them."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(size, SPLIT)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _range(rows):
    """A size of input splits that cuts files of so many rows into a few dozen pieces."""
    return max(700, rows * 8)


LONG_NAME = """coalesce(business_name, 'Unnamed') || CASE row_idx % 3 WHEN 0 THEN chr(10) || 'the "best", since' || chr(10) || chr(10) || '1990'
      WHEN 1 THEN chr(10) || 'more' ELSE ',"x' END"""


@query("lead_scan", f"""
    SELECT row_number() OVER (ORDER BY row_idx) AS position, {normalized_sql('raw_url')} AS url, email, NULL AS logo,
      CASE WHEN row_idx % 9 != 0 THEN {LONG_NAME} END AS business_name, services, NULL AS error, 'kept' AS extra FROM {LEADS} l""")
def lead_scan(spark, d):
    """Cells hold line breaks, quotes and commas; the files are read in ranges that end inside them."""
    path = new_path(spark, "lead-csv")
    rest = F.when(F.col("row_idx") % 3 == 0, '\nthe "best", since\n\n1990').when(F.col("row_idx") % 3 == 1, "\nmore").otherwise(',"x')
    name = F.when(F.col("row_idx") % 9 == 0, F.lit("N/A")).otherwise(F.concat(F.coalesce("business_name", F.lit("Unnamed")), rest))
    table = leads(spark, d)
    sinks.write_leads(table.select("row_idx", F.col("raw_url").alias("url"), "email", name.alias("business_name"),
                                   "services", F.lit("kept").alias("extra")), path)
    with small_ranges(spark, _range(table.count())):
        good, _ = files.split_rejects(files.lead_scan(spark, path))
    return ranked(good, "row_idx", name="position").drop("row_idx")


@query("lead_scan_headerless", f"SELECT row_number() OVER (ORDER BY row_idx) AS position, {normalized_sql('bare')} AS url FROM (SELECT row_idx, trim(raw_url) AS bare FROM {LEADS} l)")
def lead_scan_headerless(spark, d):
    path = new_path(spark, "headerless")
    table = leads(spark, d)
    lines = table.select("row_idx", F.concat(F.trim("raw_url"), F.lit(',"ignored\nhttps://no.example.com,\n"')).alias("value"))
    sinks.write_lines(lines, path, "row_idx")
    with small_ranges(spark, _range(table.count())):
        found = files.lead_scan_headerless(spark, path)
    return ranked(found, "row_idx", name="position").select("position", "url")


@query("lead_scan_lenient", f"SELECT {normalized_sql('trim(raw_url)')} AS url FROM {LEADS} l WHERE row_idx % 10 != 9")
def lead_scan_lenient(spark, d):
    path = new_path(spark, "lenient")
    k = F.col("row_idx").cast("string")
    line = F.when(F.col("row_idx") % 10 == 9, k).when(F.col("row_idx") % 10 == 8, F.concat_ws(",", k, F.trim("raw_url"), F.lit("x"), F.lit("y"))) \
        .when(F.col("row_idx") % 10 == 7, F.concat(F.lit('"a\n""b,\n",'), F.trim("raw_url"))).otherwise(F.concat_ws(",", k, F.trim("raw_url")))
    table = leads(spark, d)
    body = table.select("row_idx", line.alias("value"))
    head = body.groupBy().agg(F.lit(-1).cast("long").alias("row_idx"), F.lit("id,url").alias("value"))
    # One file, as it has one header: the range partition of a single range.
    sinks.write_lines(head.unionByName(body), path, "row_idx", parts=1)
    with small_ranges(spark, _range(table.count())):
        return files.lead_scan_lenient(spark, path).select("url")


@query("json_map_scan", f"SELECT folder, main_folder, inner_folder, NULL AS domain FROM {FOLDERS} f WHERE folder_idx % 7 != 0")
def json_map_scan(spark, d):
    path = new_path(spark, "maps")
    doc = F.when(F.col("folder_idx") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.create_map(
        "folder", F.struct("main_folder", "inner_folder"))))
    folders(spark, d).select(doc.alias("value")).write.text(path)
    return files.json_map_scan(spark, path, "struct<main_folder:string,inner_folder:string,domain:string>", "folder")


#: Order keys of one file of the log.
LOG_KEYS = 250_000


def _deploy_log(spark, d):
    k = F.col("o_orderkey").cast("string")
    flat = F.concat(F.lit('{"site'), k, F.lit('": "https://sites.example.com/'), k, F.lit('"}'))
    nested = F.to_json(F.struct(F.concat(F.lit("{'site"), k, F.lit("': {'elegant': 'https://sites.example.com/e/"), k,
                                         F.lit("', 'modern': 'https://sites.example.com/m/"), k, F.lit("'}}")).alias("v")))
    result = F.when(F.col("o_orderkey") % 2 == 0, flat).otherwise(F.regexp_extract(nested, r'^\{"v":(.*)\}$', 1))
    value = F.concat(F.lit('{"timestamp": "'), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit('", "success": '),
                     (F.col("o_orderstatus") != "F").cast("string"), F.lit(', "result": '), result,
                     F.lit(', "target_directory": "/srv/{[\\"}", "server": "host"}'))
    path = new_path(spark, "deploy-log")
    # A range of keys is an array in a file of its own, as a log is rotated; a third of the records are broken into lines.
    orders = fx.table(spark, d, "orders").withColumn("file", F.floor(F.col("o_orderkey") / LOG_KEYS))
    ends = orders.groupBy("file").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    body = orders.join(F.broadcast(ends), "file").select("o_orderkey", "file", F.concat(
        F.when(F.col("o_orderkey") == F.col("lo"), "[").otherwise(","),
        F.when(F.col("o_orderkey") % 3 == 0, F.replace(value, F.lit(', "'), F.lit(',\n    "'))).otherwise(value),
        F.when(F.col("o_orderkey") == F.col("hi"), "\n]").otherwise("")).alias("value"))
    sinks.write_files(body, path, "file", "o_orderkey")
    with small_ranges(spark, 20 * _range(orders.count())):
        return files.deploy_log_scan(spark, path)


@query("deploy_log_scan", """
    SELECT o_orderdate AS timestamp, o_orderstatus != 'F' AS success, 'site' || o_orderkey AS site, NULL AS style,
      'https://sites.example.com/' || o_orderkey AS url FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderdate, o_orderstatus != 'F', 'site' || o_orderkey, s,
      'https://sites.example.com/' || s[1] || '/' || o_orderkey FROM orders, (SELECT unnest(['elegant', 'modern']) AS s) WHERE o_orderkey % 2 = 1""")
def deploy_log_scan(spark, d):
    return files.deploy_results(_deploy_log(spark, d)).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "success", "site", "style", "url")


LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"


def _log_lines(events):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), level, F.lit(" - "),
        F.col("event_type")).alias("value"))


def _text_log(spark, d):
    path = new_path(spark, "log")
    sinks.write_lines(_log_lines(fx.table(spark, d, "events")), path, "event_id")
    return files.text_log_scan(spark, path)


@query("text_log_scan", f"""SELECT row_number() OVER (ORDER BY event_id) AS position, date_trunc('second', ts)::TIMESTAMP AS at,
    {LEVEL_SQL} AS level, event_type || CASE event_id % 5 WHEN 0 THEN chr(10) || ' * Running on ' || event_id || chr(10) || chr(10) || '2024-01-02 - no head'
      WHEN 1 THEN chr(10) ELSE '' END AS message FROM events""")
def text_log_scan(spark, d):
    """Records of one to five lines; the ranges end inside them."""
    path = new_path(spark, "log")
    events = fx.table(spark, d, "events")
    more = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n * Running on "), F.col("event_id").cast("string"), F.lit("\n\n2024-01-02 - no head"))) \
        .when(F.col("event_id") % 5 == 1, "\n").otherwise("")
    sinks.write_lines(_log_lines(events).select("event_id", F.concat("value", more).alias("value")), path, "event_id")
    with small_ranges(spark, 2 * _range(events.count())):
        records = files.log_records(spark, path)
    return files.log_fields(ranked(records, "pos", name="position")).select(
        "position", F.col("at").cast("timestamp_ntz").alias("at"), "level", "message")


ARTIFACTS = fx.ARTIFACTS


def _artifact_paths(spark, d):
    return fx.built(spark, d, fx.ARTIFACTS, "customer")


@query("artifact_scan", f"SELECT generation, site, style FROM {sql(fx.ARTIFACTS)} a WHERE site != '__pycache__'")
def artifact_scan(spark, d):
    return files.artifact_scan(_artifact_paths(spark, d).select("path")).select("generation", "site", "style")


@query("lead_write", f"""SELECT row_number() OVER (ORDER BY row_idx) AS position, url, email, logo, business_name, services, error,
    template_url FROM {LEADS} l""")
def lead_write(spark, d):
    path = new_path(spark, "lead-write")
    sinks.write_leads(leads(spark, d).select("row_idx", *CSV_COLUMNS), path)
    return ranked(files.lead_scan(spark, path), "row_idx", name="position").drop("row_idx")


def _with_folders(spark, d):
    return leads(spark, d).withColumn("folder", F.concat(F.lit("f"), F.col("row_idx").cast("string")))


def _json(c):
    return f"coalesce('\"' || {c} || '\"', 'null')"


SERVICES_JSON = """CASE WHEN services IS NULL THEN '[]' ELSE '["' || array_to_string(string_split(services, ';'), '","') || '"]' END"""


@query("site_json_export", f"""SELECT 'f' || row_idx AS folder, '{{"url":' || {_json('url')} || ',"business_name":'
      || {_json("coalesce(business_name, " + netloc_sql('url') + ")")} || ',"email":' || {_json('email')} || ',"logo":' || {_json("CASE WHEN logo IS NOT NULL THEN 'a.png' END")}
      || ',"logo_file":' || {_json("CASE WHEN logo IS NOT NULL THEN 'a.png' END")} || ',"services":' || {SERVICES_JSON} || ',"error":' || {_json('error')} || '}}' AS document FROM {LEADS} l""")
def site_json_export(spark, d):
    path = new_path(spark, "site-json")
    sinks.write_documents(report.site_documents(_with_folders(spark, d)), path)
    return spark.read.parquet(path)


@query("site_details_text", f"""SELECT 'f' || row_idx AS folder, 'URL: ' || url || chr(10) || 'Business Name: ' || coalesce(business_name, 'N/A') || chr(10)
      || 'Email: ' || coalesce(email, 'N/A') || chr(10) || 'Logo: ' || CASE WHEN logo IS NULL THEN 'N/A' ELSE 'a.png' END || chr(10) || 'Services:' || chr(10)
      || CASE WHEN services IS NULL THEN '  No services found' ELSE '  1. Roofing ' || row_idx || chr(10) || '  2. Tiling' || CASE WHEN row_idx % 4 = 2 THEN chr(10) || '  3. Gardening' ELSE '' END END
      || CASE WHEN error IS NULL THEN '' ELSE chr(10) || chr(10) || 'Errors: ' || error END AS details FROM {LEADS} l""")
def site_details_text(spark, d):
    return report.site_details(_with_folders(spark, d))


@query("email_report", f"""
    SELECT 1 AS section, row_idx, email AS line FROM {LEADS} l WHERE email IS NOT NULL
    UNION ALL SELECT 2, row_idx, 'Business: ' || coalesce(business_name, 'Unknown Business') || chr(10) || 'Email: ' || email || chr(10) || 'Website: ' || url
      FROM {LEADS} l WHERE email IS NOT NULL
    UNION ALL SELECT 3, NULL, 'Total: ' || count(email) || ' emails out of ' || count(*) || ' websites' FROM {LEADS} l""")
def email_report(spark, d):
    return report.email_report(leads(spark, d))


@query("site_index_rows", f"""SELECT row_number() OVER (ORDER BY row_idx) AS position, {netloc_sql('url')} AS website, coalesce(business_name, 'N/A') AS business_name,
    coalesce(email, 'N/A') AS email, logo IS NOT NULL AS has_logo, CASE WHEN services IS NULL THEN 'N/A'
      WHEN row_idx % 4 = 2 THEN 'Roofing ' || row_idx || '; Tiling...' ELSE 'Roofing ' || row_idx || '; Tiling' END AS services FROM {LEADS} l""")
def site_index_rows(spark, d):
    return report.site_index(leads(spark, d))


TAGLINE = "CASE WHEN services IS NULL THEN 'professional services' WHEN row_idx % 4 = 2 THEN 'Roofing ' || row_idx || ', Tiling and Gardening' ELSE 'Roofing ' || row_idx || ' and Tiling' END"


@query("rendered_pages", f"""
    SELECT 'f' || row_idx AS folder, style, 'f' || row_idx || '/' || style || '/index.html' AS path,
      '<!DOCTYPE html><html><head><title>' || name || '</title></head><body class="' || style || '-template"><header>'
      || CASE WHEN logo IS NULL THEN '' ELSE '<img class="logo" src="a.png">' END || '<h1>' || name || '</h1></header><p>' || {TAGLINE}
      || '</p><ul class="services">' || CASE WHEN services IS NULL THEN '' ELSE '<li>Roofing ' || row_idx || '</li><li>Tiling</li>' || CASE WHEN row_idx % 4 = 2 THEN '<li>Gardening</li>' ELSE '' END END
      || '</ul><footer>' || CASE WHEN email IS NULL THEN '' ELSE '<a href="mailto:' || email || '">' || email || '</a>' END || ' &copy; {YEAR} ' || name || '</footer></body></html>' AS html
    FROM (SELECT *, coalesce(business_name, {netloc_sql('url')}) AS name FROM {LEADS} l), (SELECT unnest(['modern', 'elegant', 'minimalist']) AS style)""")
def rendered_pages(spark, d):
    path = new_path(spark, "rendered")
    sinks.write_pages(sinks.rendered_pages(fx.spread(_with_folders(spark, d), "row_idx"), YEAR), path)
    return spark.read.parquet(path)


@query("map_write", f"SELECT domain, main_folder, inner_folder, ftp_name FROM {DOMAIN_MAP} m")
def map_write(spark, d):
    path = new_path(spark, "map")
    sinks.write_map(domain_map(spark, d), path, "domain")
    return files.json_map_scan(spark, path, "struct<main_folder:string,inner_folder:string,ftp_name:string>", "domain")


MAPPED = f"""(SELECT l.*, coalesce(m.main_folder, '{COUNTER:06d}') AS main_folder,
    coalesce(m.inner_folder, split_part(l.domain_key, '.', 1)) AS inner_folder
    FROM {LEADS} l LEFT JOIN {DOMAIN_MAP} m ON m.domain = l.domain_key)"""


def _url_sql(style, where="x"):
    return f"'{BASE}/' || {where}.main_folder || '/' || {where}.inner_folder || '/{style}/index.html'"


NEW_URLS = f"""{_url_sql('elegant')} AS template_url, {_url_sql('elegant')} AS elegant_url,
    {_url_sql('minimalist')} AS minimalist_url, {_url_sql('modern')} AS modern_url"""


@query("snapshot_before_update", f"""
    SELECT 'leads' AS kind, row_idx, {_url_sql('elegant')} AS template_url FROM {MAPPED} x
    UNION ALL SELECT 'backup', row_idx, template_url FROM {LEADS} l""")
def snapshot_before_update(spark, d):
    """The table lies in parts of 100 rows; the version before the update is its backup."""
    folder, table = new_path(spark, "snapshots"), leads(spark, d)
    parts.create_by_range(table, folder, "row_idx", 100)
    updated = maintain.update_template_urls(table, domain_map(spark, d), COUNTER)
    now = parts.update_by_range(materialize(updated), folder, "row_idx", 100)
    return parts.read_table(spark, folder, updated.drop("changed").schema, now).select(F.lit("leads").alias("kind"), "row_idx", "template_url").unionByName(
        parts.read_table(spark, folder, table.schema, 0).select(F.lit("backup").alias("kind"), "row_idx", "template_url"))


# ------------------------------------------------------------------ projections

@query("ensure_columns", f"SELECT url, email, NULL AS logo, '' AS modern_url FROM {LEADS} l")
def ensure_columns(spark, d):
    some = leads(spark, d).select("url", "email")
    return maintain.ensure_columns(maintain.ensure_columns(some, ["url", "email", "logo"]), ["modern_url"], "")


@query("fill_defaults", f"""SELECT row_idx, coalesce(email, 'Missing email') AS email, coalesce(business_name, 'Missing business_name') AS business_name,
    coalesce(logo, 'N/A') AS logo, coalesce(services, 'N/A') AS services, coalesce(template_url, '#') AS template_url FROM {LEADS} l""")
def fill_defaults(spark, d):
    return report.fill_defaults(leads(spark, d)).select("row_idx", "email", "business_name", "logo", "services", "template_url")


@query("safe_folder_name", f"""SELECT row_idx, 'Caf_Uber_' || row_idx || '_Sohne-Co' AS folder FROM {LEADS} l
    UNION ALL SELECT -1 - row_idx, regexp_replace({netloc_sql('url')}, ':', '') FROM {LEADS} l""")
def safe_name(spark, d):
    df = leads(spark, d)
    k = F.col("row_idx").cast("string")
    odd = F.concat(F.lit("  ._Caf / Über "), k, F.lit("\tSöhne-Co!? _."))
    return df.select("row_idx", safe_folder_name(odd).alias("folder")).unionByName(
        df.select((-1 - F.col("row_idx")).alias("row_idx"), safe_folder_name(urls.folder_source_name(F.lit(None).cast("string"), "url")).alias("folder")))


@query("services_split", f"""SELECT row_idx, CASE WHEN services IS NULL THEN '' WHEN row_idx % 4 = 2 THEN 'Roofing ' || row_idx || '|Tiling|Gardening'
    ELSE 'Roofing ' || row_idx || '|Tiling' END AS items FROM {LEADS} l""")
def services_split(spark, d):
    return leads(spark, d).select("row_idx", F.array_join(report.services_split("services"), "|").alias("items"))


@query("services_join", f"SELECT row_idx, services FROM {LEADS} l WHERE services IS NOT NULL")
def services_join(spark, d):
    return leads(spark, d).where("services is not null").select(
        "row_idx", report.services_join(report.services_split("services")).alias("services"))


@query("services_preview", f"""SELECT row_idx, CASE WHEN services IS NULL THEN NULL WHEN row_idx % 4 = 2 THEN 'Roofing ' || row_idx || '; Tiling...'
    ELSE 'Roofing ' || row_idx || '; Tiling' END AS preview FROM {LEADS} l""")
def services_preview(spark, d):
    return leads(spark, d).select("row_idx", report.services_preview("services").alias("preview"))


@query("first2_services", f"SELECT row_idx, 'Roofing ' || row_idx || '; Tiling' AS items FROM {LEADS} l WHERE services IS NOT NULL")
def first2_services(spark, d):
    return leads(spark, d).where("services is not null").select(
        "row_idx", F.array_join(F.slice(report.services_split("services"), 1, 2), "; ").alias("items"))


@query("first3_services", f"""SELECT row_idx, 'Roofing ' || row_idx || '; Tiling' || CASE WHEN row_idx % 4 = 2 THEN '; Gardening' ELSE '' END AS items
    FROM {LEADS} l WHERE services IS NOT NULL""")
def first3_services(spark, d):
    return leads(spark, d).where("services is not null").select(
        "row_idx", F.array_join(F.slice(report.services_split("services"), 1, 3), "; ").alias("items"))


@query("tagline_phrase", f"SELECT row_idx, {TAGLINE} AS tagline FROM {LEADS} l")
def tagline_phrase(spark, d):
    return leads(spark, d).select("row_idx", report.tagline_phrase(report.services_split("services")).alias("tagline"))


@query("site_urls", f"SELECT row_idx, {NEW_URLS} FROM (SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN lpad(CAST(row_idx AS VARCHAR), 6, '0') ELSE CAST(row_idx + 12345678 AS VARCHAR) END AS main_folder, 'in' || row_idx AS inner_folder FROM {LEADS} l) x")
def site_urls(spark, d):
    number = F.when(F.col("row_idx") % 2 == 0, F.col("row_idx")).otherwise(F.col("row_idx") + 12345678)
    placed = leads(spark, d).select("row_idx", urls.batch_folder(number).alias("main_folder"),
                                    F.concat(F.lit("in"), F.col("row_idx").cast("string")).alias("inner_folder"))
    return linkage.with_site_urls(placed).select("row_idx", *rules.SITE_URL_COLUMNS)


@query("site_search", f"SELECT folder_idx, folder FROM {FOLDERS} f WHERE contains(lower(folder), 'haus') OR contains(lower(site_name), 'haus')")
def site_search(spark, d):
    sites = folders(spark, d).withColumnRenamed("site_name", "business_name")
    return report.site_search(sites, " HAUS ").select("folder_idx", "folder")


@query("select_by_position", f"SELECT row_idx, url FROM {LEADS} l WHERE row_idx IN (SELECT s_suppkey FROM supplier)")
def select_by_position(spark, d):
    chosen = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_idx"))
    return maintain.select_by_position(leads(spark, d), chosen).select("row_idx", "url")


@query("log_level_tag", f"SELECT event_id, CASE {LEVEL_SQL} WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS level FROM events")
def log_level_tag(spark, d):
    return _log_lines(fx.table(spark, d, "events")).select("event_id", report.log_level("value").alias("level"))


# ------------------------------------------------------------------ linkage

@query("domain_map_left_join", f"SELECT row_idx, domain_key, main_folder, inner_folder FROM {MAPPED} x")
def domain_map_left_join(spark, d):
    return linkage.domain_map_left_join(leads(spark, d), domain_map(spark, d), COUNTER) \
        .select("row_idx", "domain_key", "main_folder", "inner_folder")


BY_NAME = f"""(SELECT row_idx, min(folder_idx) AS folder_idx FROM {LEADS} l JOIN {FOLDERS} f ON lower(f.folder) = lower(l.business_name) GROUP BY 1)"""
HOST = f"lower({netloc_sql('url')})"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"
BY_MAP = f"""(SELECT row_idx, min(folder_idx) AS folder_idx, any_value(m.main_folder) AS main_folder, any_value(m.inner_folder) AS inner_folder
    FROM {LEADS} l JOIN {DOMAIN_MAP} m ON m.domain = CASE WHEN {BARE} IN (SELECT domain FROM {DOMAIN_MAP}) THEN {BARE} ELSE {HOST} END
    JOIN {FOLDERS} f ON f.folder = m.ftp_name GROUP BY 1)"""
BY_PART = f"""(SELECT row_idx, min(folder_idx) AS folder_idx
    FROM (SELECT row_idx, CASE WHEN {BARE} IN (SELECT domain FROM {DOMAIN_MAP}) THEN {BARE} ELSE {HOST} END AS dk FROM {LEADS} l) l
    JOIN {FOLDERS} f ON contains(lower(f.folder), dk) OR contains(dk, lower(f.folder)) WHERE dk != '' GROUP BY 1)"""
STAGED = f"""(SELECT s.row_idx, s.stage, f.folder_idx, f.folder, f.styles, CASE WHEN stage = 2 THEN s.main_folder ELSE f.main_folder END AS main_folder,
      CASE WHEN stage = 2 THEN s.inner_folder ELSE f.inner_folder END AS inner_folder
    FROM (SELECT DISTINCT ON (row_idx) * FROM (
        SELECT 1 AS stage, row_idx, folder_idx, NULL AS main_folder, NULL AS inner_folder FROM {BY_NAME} a
        UNION ALL SELECT 2, row_idx, folder_idx, main_folder, inner_folder FROM {BY_MAP} b
        UNION ALL SELECT 3, row_idx, folder_idx, NULL, NULL FROM {BY_PART} c) ORDER BY row_idx, stage) s
    JOIN {FOLDERS} f USING (folder_idx))"""


@query("name_exact_match", f"SELECT row_idx, folder FROM {BY_NAME} x JOIN {FOLDERS} f USING (folder_idx)")
def name_exact_match(spark, d):
    return linkage.name_exact_match(leads(spark, d).select("row_idx", "business_name"), folders(spark, d)).select("row_idx", "folder")


@query("domain_map_then_deployed", f"SELECT row_idx, folder, x.main_folder, x.inner_folder FROM {BY_MAP} x JOIN {FOLDERS} f USING (folder_idx)")
def domain_map_then_deployed(spark, d):
    return linkage.domain_map_then_deployed(leads(spark, d).select("row_idx", "url"), folders(spark, d), domain_map(spark, d)) \
        .select("row_idx", "folder", "main_folder", "inner_folder")


@query("partial_match", f"SELECT row_idx, folder FROM {BY_PART} x JOIN {FOLDERS} f USING (folder_idx)")
def partial_match(spark, d):
    return linkage.partial_match(leads(spark, d).select("row_idx", "url"), folders(spark, d), domain_map(spark, d)) \
        .select("row_idx", "folder")


@query("staged_linkage", f"SELECT row_idx, stage, folder_idx, folder, main_folder, inner_folder FROM {STAGED} x")
def staged_linkage(spark, d):
    return linkage.staged_linkage(leads(spark, d), folders(spark, d), domain_map(spark, d))


CONTAINED = f"""(SELECT folder_idx, min(row_idx) AS row_idx FROM {FOLDERS} f JOIN (SELECT row_idx, lower(trim(business_name)) AS name FROM {LEADS} l) l
    ON contains(name, replace(lower(folder), '_', ' ')) OR contains(replace(lower(folder), '_', ' '), name) WHERE name != '' GROUP BY 1)"""
LABEL = "split_part(domain_key, '.', 1)"


@query("folder_lead_containment", f"SELECT folder_idx, row_idx, {LABEL} AS domain_label FROM {CONTAINED} c JOIN {LEADS} l USING (row_idx)")
def folder_lead_containment(spark, d):
    return linkage.folder_lead_containment(folders(spark, d), leads(spark, d)).select("folder_idx", "row_idx", "domain_label")


@query("folder_domain_containment", f"""
    WITH named AS (SELECT folder_idx, {LABEL} AS label, 'name' AS source FROM {CONTAINED} c JOIN {LEADS} l USING (row_idx)),
      lab AS (SELECT row_idx, {LABEL} AS label FROM {LEADS} l),
      hit AS (SELECT folder_idx, min(row_idx) AS row_idx FROM {FOLDERS} f JOIN lab ON contains(replace(lower(folder), '_', ''), label)
              WHERE folder_idx NOT IN (SELECT folder_idx FROM named) GROUP BY 1)
    SELECT folder_idx, source, regexp_replace(label, '[^a-z0-9]', '', 'g') AS domain_label FROM named
    UNION ALL SELECT folder_idx, 'domain', regexp_replace(label, '[^a-z0-9]', '', 'g') FROM hit JOIN lab USING (row_idx)
    UNION ALL SELECT folder_idx, 'folder', regexp_replace(split_part(lower(folder), '.', 1), '[^a-z0-9]', '', 'g') FROM {FOLDERS} f
      WHERE folder_idx NOT IN (SELECT folder_idx FROM named) AND folder_idx NOT IN (SELECT folder_idx FROM hit)""")
def folder_domain_containment(spark, d):
    return linkage.folder_domain_containment(folders(spark, d), leads(spark, d)).select("folder_idx", "source", "domain_label")


@query("site_style_cross", f"""SELECT folder_idx, style, CASE style WHEN 'minimalist' THEN '#F44336' END AS accent_color
    FROM {FOLDERS} f, (SELECT unnest(['modern', 'elegant', 'minimalist']) AS style)""")
def site_style_cross(spark, d):
    return linkage.site_style_cross(folders(spark, d).select("folder_idx")).select("folder_idx", "style", "accent_color")


@query("semi_membership", f"SELECT url FROM {ALL_URLS} WHERE url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'http://'))")
def semi_membership(spark, d):
    known = fx.pages(spark, d).where(F.col("url").startswith("http://"))
    return linkage.semi_membership(all_urls(spark, d), known)


@query("deployed_status_join", f"SELECT folder_idx AS site_idx, folder, folder IN (SELECT ftp_name FROM {DOMAIN_MAP} m) AS deployed FROM {FOLDERS} f")
def deployed_status_join(spark, d):
    sites = folders(spark, d).select(F.col("folder_idx").alias("site_idx"), "folder")
    return linkage.deployed_status(sites, domain_map(spark, d).select(F.col("ftp_name").alias("folder")))


FOLDER_MAP = f"""(SELECT folder_idx AS pos, folder, main_folder, inner_folder, CASE WHEN folder_idx % 3 = 0 THEN NULL WHEN folder_idx % 3 = 1
    THEN 'Biz' || folder_idx // 2 || '.example.com' ELSE 'www.biz' || folder_idx // 2 || '.example.com' END AS domain FROM {FOLDERS} f)"""


@query("reverse_map_build", f"""
    SELECT DISTINCT ON (key) key, folder AS ftp_name, main_folder, inner_folder FROM (
      SELECT *, 0 AS seq, lower(folder) AS key FROM {FOLDER_MAP} a UNION ALL SELECT *, 1, lower(domain) FROM {FOLDER_MAP} b WHERE domain IS NOT NULL
      UNION ALL SELECT *, 2, 'www.' || lower(domain) FROM {FOLDER_MAP} c WHERE domain IS NOT NULL AND NOT starts_with(lower(domain), 'www.'))
    ORDER BY key, pos DESC, seq DESC""")
def reverse_map_build(spark, d):
    i = F.col("folder_idx")
    half = F.floor(i / 2).cast("string")
    domain = F.when(i % 3 == 1, F.concat(F.lit("Biz"), half, F.lit(".example.com"))) \
        .when(i % 3 == 2, F.concat(F.lit("www.biz"), half, F.lit(".example.com")))
    return linkage.reverse_map(folders(spark, d).select(i.alias("pos"), "folder", "main_folder", "inner_folder", domain.alias("domain")))


# ------------------------------------------------------------------ totals

@query("url_coverage", f"""SELECT count(*)::BIGINT AS total, count(template_url)::BIGINT AS with_urls, (count(*) - count(template_url))::BIGINT AS missing_urls,
    (count(template_url) * 100 // count(*))::BIGINT AS percent FROM {LEADS} l""")
def url_coverage(spark, d):
    return report.url_coverage(leads(spark, d))


@query("email_totals", f"SELECT count(email)::BIGINT AS valid, count(*)::BIGINT AS total FROM {LEADS} l")
def email_totals(spark, d):
    return report.email_totals(leads(spark, d))


@query("stage_counts", f"""SELECT count(*)::BIGINT AS total_leads, count(*) FILTER (stage = 1)::BIGINT AS stage1, count(*) FILTER (stage = 2)::BIGINT AS stage2,
    count(*) FILTER (stage = 3)::BIGINT AS stage3, count(*) FILTER (stage = 3 AND coalesce(next_send, '') = '')::BIGINT AS completed FROM {LEADS} l""")
def stage_counts(spark, d):
    return report.stage_counts(leads(spark, d))


@query("send_result_summary", "SELECT count(*)::BIGINT AS total, count(*) FILTER (c_acctbal >= 0)::BIGINT AS success, count(*) FILTER (c_acctbal < 0)::BIGINT AS failed FROM customer")
def send_result_summary(spark, d):
    results = fx.table(spark, d, "customer").select((F.col("c_acctbal") >= 0).alias("success"))
    return report.send_result_summary(results)


@query("gallery_stats", f"""SELECT count(DISTINCT generation || '/' || site)::BIGINT AS total_sites, count(DISTINCT generation || '/' || site || '/' || style)::BIGINT AS total_templates
    FROM {sql(fx.ARTIFACTS)} a WHERE site != '__pycache__'""")
def gallery_stats(spark, d):
    return report.gallery_stats(report.styles_per_site(files.artifact_scan(_artifact_paths(spark, d).select("path"))))


@query("styles_per_site", f"""SELECT generation, site, string_agg(DISTINCT style, ', ' ORDER BY style) AS styles FROM {sql(fx.ARTIFACTS)} a
    WHERE site != '__pycache__' GROUP BY 1, 2""")
def styles_per_site(spark, d):
    return report.styles_per_site(files.artifact_scan(_artifact_paths(spark, d).select("path"))) \
        .withColumn("styles", F.array_join("styles", ", "))


@query("generation_summary", f"""
    SELECT count(*) FILTER (error IS NULL)::BIGINT AS processed, count(error)::BIGINT AS skipped,
      (SELECT string_agg(error, '|' ORDER BY row_idx) FROM (SELECT row_idx, error FROM {LEADS} l WHERE error IS NOT NULL ORDER BY row_idx LIMIT 10)) AS errors,
      CASE WHEN count(error) > 10 THEN '...and ' || (count(error) - 10) || ' more errors' END AS more FROM {LEADS} l""")
def generation_summary(spark, d):
    return report.generation_summary(leads(spark, d).select("row_idx", "error")).withColumn("errors", F.array_join("errors", "|"))


@query("first10_errors", f"SELECT row_idx, error FROM {LEADS} l WHERE error IS NOT NULL ORDER BY row_idx LIMIT 10")
def first10_errors(spark, d):
    return report.first_errors(leads(spark, d))


@query("max_batch_folder", f"""SELECT max(n)::BIGINT AS highest, greatest({COUNTER}, max(n) + 1)::BIGINT AS next_folder
    FROM (SELECT CASE WHEN c_custkey % 5 != 0 THEN c_custkey END AS n FROM customer)""")
def max_batch_folder(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("x"), urls.batch_folder(k + 900000))).otherwise(urls.batch_folder(k))
    return report.next_batch_folder(fx.table(spark, d, "customer").select(name.alias("name")), COUNTER)


@query("changed_row_count", f"SELECT count(*)::BIGINT AS changed FROM {MAPPED} x WHERE NOT (coalesce(template_url, '') = {_url_sql('elegant')})")
def changed_row_count(spark, d):
    new = linkage.with_site_urls(linkage.domain_map_left_join(leads(spark, d), domain_map(spark, d), COUNTER))
    fresh = {f: F.col(f) for f in ("elegant_url", "minimalist_url", "modern_url")}
    old = leads(spark, d).select("row_idx", F.col("template_url").alias("old_template_url"))
    both = new.join(old, "row_idx").withColumns({f"old_{k}": v for k, v in fresh.items()})
    return maintain.changed_row_count(both.withColumn("changed", maintain.url_changes()))


@query("log_level_counts", f"SELECT CASE {LEVEL_SQL} WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS level, count(*)::BIGINT AS n FROM events GROUP BY 1")
def log_level_counts(spark, d):
    return report.log_level_counts(_text_log(spark, d))


# ------------------------------------------------------------------ order and windows

@query("unique_folder_suffix", f"""
    WITH RECURSIVE o AS (
        SELECT row_number() OVER (ORDER BY row_idx) AS i, row_idx, replace(coalesce(business_name, replace(host, ':', '')), ' ', '_') AS name FROM {LEADS} l),
      r AS (
        SELECT 0::BIGINT AS i, NULL::BIGINT AS row_idx, NULL::VARCHAR AS name, NULL::VARCHAR AS folder, []::VARCHAR[] AS used
        UNION ALL SELECT i, row_idx, name, folder, list_append(used, folder) FROM (
          SELECT i, row_idx, name, used, CASE WHEN NOT list_contains(used, name) THEN name ELSE name || '_' ||
              list_min(list_filter(range(1, len(kin) + 2), lambda x: NOT list_contains(kin, name || '_' || x))) END AS folder
          FROM (SELECT o.i, o.row_idx, o.name, r.used, list_filter(r.used, lambda u: starts_with(u, o.name || '_')) AS kin
                FROM r JOIN o ON o.i = r.i + 1)))
    SELECT row_idx, name, folder FROM r WHERE i > 0""")
def unique_folder_suffix(spark, d):
    return maintain.unique_folders(maintain.folder_names(leads(spark, d)))


@query("unique_folder_rank", f"""
    SELECT row_idx, folder || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END AS folder FROM (
      SELECT c_custkey AS row_idx, c_mktsegment AS folder, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)""")
def unique_folder_rank(spark, d):
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_mktsegment").alias("name"))
    return maintain.unique_folders(rows).select("row_idx", "folder")


@query("site_id_sequence", f"SELECT row_idx, '{rules.SITE_ID_PREFIX}' || ({SITE_START} + row_number() OVER (ORDER BY row_idx)) AS site_id FROM {LEADS} l")
def site_id_sequence(spark, d):
    return maintain.site_ids(leads(spark, d).select("row_idx"), SITE_START)


@query("row_position", f"SELECT url, row_number() OVER (ORDER BY page_id) AS position FROM pages")
def row_position(spark, d):
    return ranked(fx.pages(spark, d).select("page_id", "url"), "page_id", name="position").select("url", "position")


@query("first_k_per_scope", """SELECT o_custkey, o_orderkey, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) WHERE pos <= 3""")
def first_k_per_scope(spark, d):
    orders = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ranked(orders, "o_orderkey", ["o_custkey"], name="pos").where("pos <= 3")


@query("last_wins_dedupe", f"""SELECT business_name AS folder, '{rules.SITE_ID_PREFIX}' || ({SITE_START} + max(n)) AS site_id FROM (
    SELECT business_name, row_number() OVER (ORDER BY row_idx) AS n FROM {LEADS} l) WHERE business_name IS NOT NULL GROUP BY 1""")
def last_wins_dedupe(spark, d):
    ids = maintain.site_ids(leads(spark, d).select("row_idx", F.col("business_name").alias("folder")), SITE_START)
    return last_per_key(ids.where("folder is not null"), ["folder"], F.col("row_idx")).select("folder", "site_id")


@query("most_recent_generation", f"""SELECT generation, site, style FROM {sql(fx.ARTIFACTS)} a WHERE site != '__pycache__'
    AND right(generation, 15) = (SELECT max(right(generation, 15)) FROM {sql(fx.ARTIFACTS)} b)""")
def most_recent_generation(spark, d):
    return maintain.most_recent_generation(files.artifact_scan(_artifact_paths(spark, d).select("path"))) \
        .select("generation", "site", "style")


@query("keep_last_50", "SELECT o_orderkey AS pos, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def keep_last_50(spark, d):
    return report.keep_last(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus"))


@query("history_desc", "SELECT o_orderkey AS pos, o_orderstatus FROM orders ORDER BY o_orderkey DESC")
def history_desc(spark, d):
    return report.history_desc(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus"))


@query("sites_by_name", f"SELECT site_name AS business_name, folder FROM {FOLDERS} f ORDER BY lower(site_name), folder")
def sites_by_name(spark, d):
    return report.sites_by_name(folders(spark, d).select(F.col("site_name").alias("business_name"), "folder"))


# ------------------------------------------------------------------ table maintenance

@query("append_url_if_new", f"""
    SELECT url FROM pages WHERE starts_with(url, 'http://')
    UNION ALL SELECT DISTINCT url FROM (SELECT {normalized_sql('url')} AS url FROM {ALL_URLS}) WHERE url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'http://'))""")
def append_url_if_new(spark, d):
    known = fx.pages(spark, d).where(F.col("url").startswith("http://")).select("url")
    batch = all_urls(spark, d)
    again = batch.select(F.concat(F.lit(" "), "url").alias("url"))
    blank = batch.select(F.lit("  ").alias("url"))
    return maintain.append_new_urls(known, batch.unionByName(again).unionByName(blank))


@query("reset_enrichment", f"SELECT url FROM {LEADS} l")
def reset_enrichment(spark, d):
    return maintain.reset_enrichment(leads(spark, d))


@query("upsert_subdomain", """
    WITH old AS (SELECT 'biz' || c_custkey AS subdomain, c_custkey + 1 AS position FROM customer WHERE c_mktsegment != 'BUILDING'),
      new AS (SELECT 'biz' || c_custkey AS subdomain, c_custkey FROM customer WHERE c_mktsegment != 'FURNITURE')
    SELECT subdomain, coalesce(o.position, (SELECT max(position) FROM old) + row_number() OVER (PARTITION BY o.position IS NULL ORDER BY n.c_custkey)) AS position,
      CASE WHEN n.subdomain IS NULL THEN 'old' ELSE 'modern' END AS style,
      'https://' || subdomain || '.example.com' AS url FROM old o FULL JOIN new n USING (subdomain)""")
def upsert_subdomain(spark, d):
    c = fx.table(spark, d, "customer").withColumn("subdomain", F.concat(F.lit("biz"), F.col("c_custkey").cast("string")))
    facts = {"website_path": F.lit("gen/site"), "active": F.lit(True), "date_added": F.lit("2024-01-01 00:00:00")}
    old = c.where("c_mktsegment != 'BUILDING'").select("subdomain", (F.col("c_custkey") + 1).alias("position")).withColumns(
        {**facts, "style": F.lit("old"), "document_root": F.lit("x"), "url": F.concat(F.lit("https://"), "subdomain", F.lit(".example.com"))})
    new = c.where("c_mktsegment != 'FURNITURE'").select("subdomain", F.col("c_custkey").alias("seq")).withColumns(
        {**facts, "style": F.lit("modern")})
    return maintain.upsert_subdomains(old, new).select("subdomain", "position", "style", "url")


@query("delete_by_position", f"SELECT row_idx, url FROM {LEADS} l WHERE row_idx NOT IN (SELECT s_suppkey FROM supplier)")
def delete_by_position(spark, d):
    gone = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_idx"))
    return maintain.delete_by_position(leads(spark, d), gone, "row_idx").select("row_idx", "url")


@query("upsert_domain_map", f"""
    SELECT domain, main_folder, inner_folder, ftp_name FROM {DOMAIN_MAP} m
    UNION ALL SELECT DISTINCT domain_key, '{COUNTER:06d}', {LABEL}, domain_key FROM {LEADS} l WHERE domain_key NOT IN (SELECT domain FROM {DOMAIN_MAP} m)""")
def upsert_domain_map(spark, d):
    return maintain.upsert_domain_map(domain_map(spark, d), leads(spark, d), COUNTER)


@query("merge_map_update", f"""
    SELECT coalesce(o.folder, n.folder) AS folder, CASE WHEN n.folder IS NULL THEN o.main_folder END AS main_folder, CASE WHEN n.folder IS NULL THEN o.inner_folder ELSE n.domain END AS inner_folder
    FROM {FOLDERS} o FULL JOIN (SELECT ftp_name AS folder, domain FROM {DOMAIN_MAP} m UNION ALL SELECT 'new' || n_nationkey, n_name FROM nation) n ON o.folder = n.folder""")
def merge_map_update(spark, d):
    old = folders(spark, d).select("folder", "main_folder", "inner_folder")
    new = domain_map(spark, d).select(F.col("ftp_name").alias("folder"), F.col("domain").alias("inner_folder")).unionByName(
        fx.table(spark, d, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("folder"), F.col("n_name").alias("inner_folder")))
    return maintain.merge_map(old, new.withColumn("main_folder", F.lit(None).cast("string")), "folder")


@query("update_template_urls", f"""SELECT row_idx, {NEW_URLS}, row_idx % 3 != 0 AND {_url_sql('elegant')} IS NOT NULL AS changed FROM {MAPPED} x""")
def update_template_urls(spark, d):
    """Every third lead has its URLs already, so nothing changes there."""
    plain = leads(spark, d).drop(*rules.SITE_URL_COLUMNS)
    known = maintain.update_template_urls(plain.where("row_idx % 3 = 0"), domain_map(spark, d), COUNTER)
    before = plain.join(known.select("row_idx", *rules.SITE_URL_COLUMNS), "row_idx", "left")
    return maintain.update_template_urls(before, domain_map(spark, d), COUNTER) \
        .select("row_idx", *rules.SITE_URL_COLUMNS, "changed")


@query("backfill_from_deployment", f"""
    SELECT row_idx, CASE WHEN contains(styles, 'elegant') THEN {_url_sql('elegant')} ELSE l.template_url END AS template_url,
      CASE WHEN contains(styles, 'elegant') THEN {_url_sql('elegant')} ELSE '' END AS elegant_url,
      CASE WHEN contains(styles, 'minimalist') THEN {_url_sql('minimalist')} ELSE '' END AS minimalist_url,
      CASE WHEN contains(styles, 'modern') THEN {_url_sql('modern')} ELSE '' END AS modern_url,
      x.row_idx IS NOT NULL AS changed
    FROM {LEADS} l LEFT JOIN (SELECT * FROM {STAGED} s WHERE main_folder != '' AND inner_folder != '') x USING (row_idx)""")
def backfill_from_deployment(spark, d):
    deployed = folders(spark, d).withColumn("styles", F.split("styles", ","))
    return maintain.backfill_from_deployment(leads(spark, d), deployed, domain_map(spark, d)) \
        .select("row_idx", *rules.SITE_URL_COLUMNS, "changed")


# ------------------------------------------------------------------ near duplicates

@query("near_duplicate_pairs", r"""
    WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\x{00A0}]+'), lambda x: x != ''))) AS ws FROM documents),
      g AS (SELECT ws, min(doc_id) AS rep FROM w WHERE len(ws) > 0 GROUP BY ws),
      t AS (SELECT rep, len(ws) AS n, unnest(ws) AS word FROM g),
      c AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b ON a.word = b.word AND a.rep < b.rep GROUP BY ALL)
    SELECT 'near' AS kind, a, b, round(o / (na + nb - o)::DOUBLE, 9) AS similarity FROM c WHERE o / (na + nb - o)::DOUBLE > 0.8
    UNION ALL SELECT 'copy', g.rep, w.doc_id, 1.0 FROM w JOIN g ON w.ws = g.ws WHERE w.doc_id != g.rep""")
def near_duplicate_pairs(spark, d):
    found = matching.near_duplicates(fx.spread(fx.table(spark, d, "documents"), "doc_id"), "doc_id", "text")
    return found.withColumn("similarity", F.round("similarity", 9))


@query("near_duplicate_names", f"""
    WITH n AS (SELECT DISTINCT lower(name) AS s FROM (SELECT business_name AS name FROM {LEADS} l UNION ALL SELECT p_name FROM part) WHERE name != '')
    SELECT a.s AS a, b.s AS b, CASE WHEN contains(a.s, b.s) OR contains(b.s, a.s) THEN 0.9 ELSE 1.0 END::DOUBLE AS similarity FROM n a JOIN n b ON a.s < b.s
    WHERE contains(a.s, b.s) OR contains(b.s, a.s) OR list_sort(string_split(a.s, ' ')) = list_sort(string_split(b.s, ' '))""")
def near_duplicate_names(spark, d):
    names = leads(spark, d).select(F.col("business_name").alias("name")).unionByName(
        fx.table(spark, d, "part").select(F.col("p_name").alias("name")))
    return matching.similar_names(names.where("name is not null"), "name")
