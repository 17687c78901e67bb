"""Writers.  All write new folders: a path that is being read is never overwritten."""

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, or_default
from ..functions.urls import logo_basename, netloc
from ..operators.linkage import site_style_cross
from ..operators.report import services_split, tagline_phrase


def in_order(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Range-partitioned by the order, so part files concatenate to a sorted table."""
    return df.repartitionByRange(*([parts] if parts else []), F.col(order)).sortWithinPartitions(order)


def write_leads(leads: DataFrame, path: str) -> None:
    """Lead table as CSV in row order, with all its columns."""
    in_order(leads, "row_idx").drop("row_idx").write.csv(path, header=True, escape='"', emptyValue="")


def write_lines(lines: DataFrame, path: str, order: str, parts: int | None = None) -> None:
    """One file per range; ``parts=1`` where the format needs a single file, which one task then writes."""
    in_order(lines, order, parts).select("value").write.text(path)


def write_files(lines: DataFrame, path: str, file: str, order: str) -> None:
    """One file for each number ``file``, in the order of the numbers and its lines in order; rows without a value are left
    out.  A task holds the rows of a file or a few."""
    named = lines.where("value is not null").select(F.format_string("%012d", F.col(file)).alias("file"), order, "value")
    count = max(1, named.select("file").distinct().count())
    named.repartitionByRange(count, "file").sortWithinPartitions("file", order).select("file", "value").write.partitionBy("file").text(path)


def write_map(entries: DataFrame, path: str, key: str) -> None:
    """One ``{key: {...}}`` document per line."""
    rest = [c for c in entries.columns if c != key]
    entries.select(F.to_json(F.create_map(F.col(key), F.struct(*rest))).alias("value")).write.text(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """``folder, document`` rows as a table: a directory per lead would not scale."""
    docs.write.parquet(path)


def rendered_pages(sites: DataFrame, year: int) -> DataFrame:
    """Three documents per site: ``folder, style, path, html``.

    ``sites`` has ``folder, url, business_name, email, logo, services``.
    """
    def escaped(s):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            s = F.replace(s, F.lit(plain), F.lit(entity))
        return s

    def item(s):
        return F.concat(F.lit("<li>"), escaped(s), F.lit("</li>"))

    name = escaped(or_default("business_name", netloc("url")))
    listed = services_split("services")
    logo = F.when(blank_to_null("logo").isNotNull(), F.concat(
        F.lit('<img class="logo" src="'), escaped(logo_basename("logo")), F.lit('">'))).otherwise(F.lit(""))
    email = F.when(blank_to_null("email").isNotNull(), F.concat(
        F.lit('<a href="mailto:'), escaped(F.col("email")), F.lit('">'), escaped(F.col("email")), F.lit("</a>"))).otherwise(F.lit(""))
    slots = sites.select("folder", name.alias("_name"), logo.alias("_logo"), escaped(tagline_phrase(listed)).alias("_tagline"),
                         F.array_join(F.transform(listed, item), "").alias("_items"), email.alias("_email"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("_name"), F.lit('</title></head><body class="'),
        F.col("style_class"), F.lit('"><header>'), F.col("_logo"), F.lit("<h1>"), F.col("_name"),
        F.lit("</h1></header><p>"), F.col("_tagline"), F.lit('</p><ul class="services">'), F.col("_items"),
        F.lit("</ul><footer>"), F.col("_email"), F.lit(f" &copy; {year} "), F.col("_name"), F.lit("</footer></body></html>"))
    return site_style_cross(slots).select(
        "folder", "style", F.concat_ws("/", "folder", "style", F.lit("index.html")).alias("path"), html.alias("html"))


@contextmanager
def concurrent_files(spark, most: int):
    """A task that writes partitioned files keeps up to ``most`` open; with more it sorts its rows as usual."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_pages(pages: DataFrame, path: str) -> None:
    """Partitioned by the three styles, not by site.  A task keeps a file of each style open, so it need not sort its pages."""
    with concurrent_files(pages.sparkSession, 8):
        pages.write.partitionBy("style").parquet(path)

