"""File sources: lead tables, JSON maps, deployment logs, text logs, artifact trees."""

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.text import null_tokens_to_null, strip
from ..functions.urls import normalize_url
from ..operators.shared import materialize
from . import records

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"  # a path is written with one or three slashes


def with_row_order(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Position from 0 of each row of a file scan: by path, then by place in the file.

    ``monotonically_increasing_id`` alone follows the order of the tasks, which
    is not that of the files.  Within one split of a file it is gapless, so a
    row's place in its split is exact; the rows of each split are counted, and a
    running total over the splits, one row each, gives its offset.  Use it
    directly on a scan; the counting reads the files once more.
    """
    placed = df.withColumns({"_path": F.regexp_replace("_metadata.file_path", _SCHEME, ""),
                             "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    splits = placed.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return placed.join(offsets, ["_path", "_block"]).withColumn(name, F.col("_offset") + F.col("_at")) \
        .drop("_path", "_block", "_at", "_offset")


def csv_records(spark, path: str) -> DataFrame:
    """``path, idx, value``: the records of CSV files, which may hold line breaks in cells.  Written once: later steps read it."""
    found = records.cut_records(spark, path, "\n", records.csv_line)
    text = F.regexp_replace("value", r"^(?:[ \t\r]*\n)+|\r\z", "")
    text = F.when(F.col("idx") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return materialize(found.select("path", "idx", text.alias("value")).where(F.trim("value") != ""), "csv-records")


def header_names(rows: DataFrame) -> list[str]:
    """Cells of the first record of the first file; blank and repeated names get their position."""
    head = rows.where("idx = 0").orderBy("path").select("value").head()
    cells = next(csv.reader(io.StringIO(head.value, newline="")), []) if head else []
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The cells of ``value`` as text columns; missing ones are NULL, further ones dropped."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return rows.withColumn("value", cells).select("value.*", "row_idx")


def finish_leads(raw: DataFrame, trim=True) -> DataFrame:
    """Null tokens, missing columns, URL scheme; keeps every further column."""
    df = raw.withColumns({c: null_tokens_to_null(c) for c in raw.columns if c != "row_idx"})
    df = df.withColumns({c: F.lit(None).cast("string") for c in rules.LEAD_COLUMNS if c not in df.columns})
    return df.withColumn("url", normalize_url("url", trim))


def lead_scan(spark, path: str) -> DataFrame:
    """Lead CSV with a ``url`` column, all text, in row order.  Rows without a
    URL keep NULL there; see ``split_rejects``."""
    rows = csv_records(spark, path)
    names = header_names(rows)
    if "url" not in names:
        raise ValueError("the lead file needs a 'url' column")
    return finish_leads(parsed(records.numbered(rows, "row_idx", skip=1), names))


def split_rejects(leads: DataFrame):
    return leads.where("url is not null"), leads.where("url is null")


def _first_cells(rows: DataFrame) -> DataFrame:
    return finish_leads(parsed(records.numbered(rows, "row_idx"), ["url"]), trim=False)


def lead_scan_headerless(spark, path: str) -> DataFrame:
    """Without a ``url`` header the first cells of all rows are URLs, the header's too."""
    return _first_cells(csv_records(spark, path))


def lead_upload(spark, path: str) -> DataFrame:
    """Uploaded CSV: with a ``url`` header as it is, else headerless."""
    rows = csv_records(spark, path)
    names = header_names(rows)
    return finish_leads(parsed(records.numbered(rows, "row_idx", skip=1), names), trim=False) if "url" in names else _first_cells(rows)


def lead_scan_lenient(spark, path: str) -> DataFrame:
    """Ragged CSV text: the ``url`` column if the first record names one, else the
    first column; rows too short to have it are skipped."""
    rows = csv_records(spark, path)
    names = header_names(rows)
    at = names.index("url") if "url" in names else 0
    cells = parsed(records.numbered(rows, "row_idx", skip=int("url" in names)), [f"_c{i}" for i in range(at + 1)])
    urls = cells.where(F.col(f"_c{at}").isNotNull()).select(F.col(f"_c{at}").alias("url"), "row_idx")
    return finish_leads(urls, trim=False)


def json_map_scan(spark, path: str, value_type: str, key="key", whole_file=False) -> DataFrame:
    """``key -> struct`` documents, one per line (or one per file), as rows.
    Missing paths and corrupt documents are empty."""
    try:
        docs = spark.read.text(path, wholetext=whole_file)
    except AnalysisException:
        docs = spark.createDataFrame([], "value string")
    entries = docs.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, "_v"))
    return entries.select(key, "_v.*")


_LOG = "timestamp string, success boolean, result string, target_directory string, server string"


def deploy_log_scan(spark, path: str) -> DataFrame:
    """Deployment records in append order, of files with one array or with an object after the other, however they are
    broken into lines; ``result`` stays text (see ``deploy_results``).  A record without its last brace is no record."""
    found = records.cut_records(spark, path, "}", records.json_piece, level=None).where("ended")
    text = F.concat(F.regexp_extract("value", r"(?s)\{.*", 0), F.lit("}"))
    rows = materialize(found.select("path", "idx", text.alias("value")), "json-records")
    return records.numbered(rows, "pos").withColumn("value", F.from_json("value", _LOG)).select("value.*", "pos") \
        .withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))


def deploy_results(log: DataFrame) -> DataFrame:
    """One row per published URL.  ``result`` is a map of URLs, or a map of maps
    that may be written with single quotes, or a message."""
    nested = F.from_json("result", "map<string,map<string,string>>")
    flat = F.from_json("result", "map<string,string>")
    by_site = F.when(F.exists(F.map_values(nested), lambda m: m.isNotNull()), nested) \
        .otherwise(F.transform_values(flat, lambda k, v: F.create_map(F.lit(""), v)))
    return log.select("*", F.explode_outer(by_site).alias("site", "_urls")) \
        .select("*", F.explode_outer("_urls").alias("style", "url")).drop("_urls", "result") \
        .withColumn("style", F.nullif("style", F.lit("")))


def text_log_scan(spark, path: str) -> DataFrame:
    return with_row_order(spark.read.text(path), "pos")


#: How a log record starts: its time.
LOG_HEAD = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - "


def log_records(spark, path: str) -> DataFrame:
    """``pos, value``: log records in file order, each with the lines that continue it; see ``log_fields``.  Lines before a
    file's first record are one."""
    found = records.cut_records(spark, path, "\n", records.log_line(LOG_HEAD), leading=True)
    text = F.regexp_replace("value", r"\r(?=\n|\z)", "")
    return records.numbered(materialize(found.select("path", "idx", text.alias("value")), "log-records"), "pos")


def artifact_listing(spark, root: str) -> DataFrame:
    """Paths of all files under a root; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def artifact_scan(paths: DataFrame) -> DataFrame:
    """Generation, site, style and file name out of ``…/<generation>/<site>/<style>/<file>``."""
    pattern = r"([^/]*_[0-9]{8}-[0-9]{6})/([^/]+)/([^/]+)/([^/]+)$"
    parts = {n: F.regexp_extract("path", pattern, i) for i, n in enumerate(["generation", "site", "style", "file"], 1)}
    return paths.select("path", *[c.alias(n) for n, c in parts.items()]) \
        .where((F.col("generation") != "") & (F.col("site") != "__pycache__"))


def log_fields(lines: DataFrame) -> DataFrame:
    """Time, level and message of log lines or records; a continuation line by itself has none of the first two."""
    pattern = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - ([A-Z]+) - (.*)$"
    level = F.nullif(F.regexp_extract("value", pattern, 3), F.lit(""))
    return lines.select("*", F.try_to_timestamp(F.regexp_extract("value", pattern, 1)).alias("at"), level.alias("level"),
                        F.when(level.isNotNull(), F.regexp_extract("value", pattern, 4)).otherwise(strip("value")).alias("message"))
