"""Streaming queries; each returns the table its sink wrote."""

from pyspark.sql import functions as F

from ..operators.shared import materialize, new_path
from ..sources import sinks
from ..streaming import logs, streams
from . import fixtures as fx
from .extraction import CLEAN_SQL, EMAILS_SQL, display_sql
from .maintenance import LEVEL_SQL, _log_lines
from .registry import query


@query("stream_progress", """SELECT count(*)::BIGINT AS completed, count(*) FILTER (event_type != 'error')::BIGINT AS success,
    count(*) FILTER (event_type = 'error')::BIGINT AS failed, 100.0 * count(*) / (2 * count(*)) AS percent,
    concat_ws(' ', CASE WHEN {0} >= 3600 THEN ({0} // 3600) || 'h' END, CASE WHEN {0} % 3600 >= 60 THEN ({0} % 3600 // 60) || 'm' END, ({0} % 60) || 's') AS elapsed
    FROM events""".format("(floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT)"))
def stream_progress(spark, d):
    """Half of the work is done: as many results again are expected."""
    total = 2 * fx.table(spark, d, "events").count()
    return streams.progress(streams.table_stream(spark, d, "events"), F.col("event_type") == "error", total, "ts")


@query("stream_new_urls", "SELECT url FROM pages WHERE NOT starts_with(url, 'http://')")
def stream_new_urls(spark, d):
    known = fx.pages(spark, d).where(F.col("url").startswith("http://"))
    return streams.new_urls(streams.table_stream(spark, d, "pages"), known)


@query("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    return streams.first_seen(streams.table_stream(spark, d, "events"), "user_id", "ts", "60 days")


@query("stream_extract_upsert", f"""
    SELECT page_id, url, {EMAILS_SQL.format(c='html')}[1] AS email, coalesce({CLEAN_SQL}, {display_sql('url')}) AS business_name FROM pages""")
def stream_extract_upsert(spark, d):
    return streams.extract_upsert(streams.table_stream(spark, d, "pages")).select("page_id", "url", "email", "business_name")


@query("stream_log_levels", f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour,
    CASE WHEN {LEVEL_SQL} = 'ERROR' OR event_id % 5 = 0 THEN 'error' WHEN {LEVEL_SQL} = 'WARNING' THEN 'warning' ELSE 'info' END AS level,
    count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def stream_log_levels(spark, d):
    """A log of records of one to four lines in five files, cut inside records too; each file is a micro-batch."""
    path, parts = new_path(spark, "log-stream"), 5
    more = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("Traceback:"), F.lit(""), F.lit("  ERROR: no answer"))).otherwise(F.array().cast("array<string>"))
    lines = _log_lines(fx.table(spark, d, "events")).select("event_id", F.posexplode(F.concat(F.array("value"), more)).alias("line", "value")) \
        .select((F.col("event_id") * 4 + F.col("line")).alias("place"), "value")
    lines = materialize(lines, "log-lines")
    last = lines.agg(F.max("place")).head()[0] or 0
    for k in range(parts):  # one after the other, as a log grows; 4 k + 2 is inside a record
        lo, hi = (4 * (last * i // parts // 4) + 2 if i else -1 for i in (k, k + 1))
        here = lines.where((F.col("place") >= lo) & ((F.col("place") < hi) | F.lit(k == parts - 1)))
        sinks.write_lines(here, f"{path}/{k:03d}", "place", parts=1)
    return logs.log_levels(logs.log_stream(spark, path, 1), F.lit("events"))
