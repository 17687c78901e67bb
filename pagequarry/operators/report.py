"""Projections and totals for reports over lead tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import _c, blank_to_null, let, or_default, strip
from ..functions.urls import logo_basename, netloc  # noqa: F401
from .shared import ranked, union_all


def services_split(col, trim=True) -> Column:
    parts = F.split(_c(col), ";", -1)
    parts = F.transform(parts, lambda s: strip(s)) if trim else parts
    return F.when(blank_to_null(col).isNull(), F.array().cast("array<string>")).otherwise(parts)


def services_join(col) -> Column:
    return F.array_join(_c(col), "; ")


def services_preview(col) -> Column:
    """More than two: the first two and an ellipsis; else all."""
    return F.when(blank_to_null(col).isNotNull(), let(services_split(col), lambda s: F.when(
        F.size(s) > 2, F.concat(F.array_join(F.slice(s, 1, 2), "; "), F.lit("..."))).otherwise(F.array_join(s, "; "))))


def tagline_phrase(services: Column, default="professional services") -> Column:
    """First three services as ``a``, ``a and b`` or ``a, b and c``."""
    def phrase(s):
        n = F.size(s)
        return F.when(n == 0, F.lit(default)).when(n == 1, s[0]).otherwise(F.concat_ws(
            " and ", F.array_join(F.slice(s, F.lit(1), n - 1), ", "), F.element_at(s, F.greatest(n, F.lit(1)))))
    return let(F.transform(F.slice(services, 1, 3), lambda s: strip(s)), phrase)


def fill_defaults(leads: DataFrame) -> DataFrame:
    """Display defaults: NULL and the empty string count as missing."""
    named = {c: or_default(c, f"Missing {c}") for c in ("email", "business_name")}
    linked = {c: or_default(c, "#") for c in rules.SITE_URL_COLUMNS if c in leads.columns}
    shown = {c: or_default(c, "N/A") for c in ("logo", "services", "error") if c in leads.columns}
    return leads.withColumns({**named, **linked, **shown})


def site_documents(leads: DataFrame) -> DataFrame:
    """One JSON document per lead with a URL; services are split but not trimmed."""
    site = F.struct(
        F.col("url"), or_default("business_name", netloc("url")).alias("business_name"),
        blank_to_null("email").alias("email"),
        *[F.when(blank_to_null("logo").isNotNull(), logo_basename("logo")).alias(c) for c in ("logo", "logo_file")],
        services_split("services", trim=False).alias("services"), blank_to_null("error").alias("error"))
    return leads.where(blank_to_null("url").isNotNull()) \
        .select("folder", F.to_json(site, {"ignoreNullFields": "false"}).alias("document"))


def site_details(leads: DataFrame) -> DataFrame:
    """The same facts as a text block with numbered services."""
    listed = F.transform(services_split("services"), lambda s, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), s))
    lines = F.concat(
        F.array(F.concat(F.lit("URL: "), F.col("url")),
                F.concat(F.lit("Business Name: "), or_default("business_name", "N/A")),
                F.concat(F.lit("Email: "), or_default("email", "N/A")),
                F.concat(F.lit("Logo: "), F.when(blank_to_null("logo").isNotNull(), logo_basename("logo"))
                         .otherwise(F.lit("N/A"))),
                F.lit("Services:")),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("  No services found"))),
        F.when(blank_to_null("error").isNotNull(), F.array(F.lit(""), F.concat(F.lit("Errors: "), F.col("error"))))
        .otherwise(F.array().cast("array<string>")))
    return leads.where(blank_to_null("url").isNotNull()).select("folder", F.array_join(lines, "\n").alias("details"))


def site_index(leads: DataFrame) -> DataFrame:
    return ranked(leads, "row_idx", name="position").where(blank_to_null("url").isNotNull()).select(
        "position", netloc("url").alias("website"), or_default("business_name", "N/A").alias("business_name"),
        or_default("email", "N/A").alias("email"), blank_to_null("logo").isNotNull().alias("has_logo"),
        F.coalesce(services_preview("services"), F.lit("N/A")).alias("services"))


def email_report(leads: DataFrame) -> DataFrame:
    """Lines of the e-mail report as ``section, row_idx, line``: addresses, detail blocks, total."""
    found = leads.where(blank_to_null("email").isNotNull())
    addresses = found.select(F.lit(1).cast("long").alias("section"), "row_idx", F.col("email").alias("line"))
    details = found.select(F.lit(2).cast("long").alias("section"), "row_idx", F.concat_ws(
        "\n", F.concat(F.lit("Business: "), F.coalesce("business_name", F.lit("Unknown Business"))),
        F.concat(F.lit("Email: "), F.col("email")),
        F.concat(F.lit("Website: "), F.coalesce("url", F.lit("Unknown URL")))).alias("line"))
    totals = email_totals(leads).select(F.lit(3).cast("long").alias("section"), F.lit(None).cast("long").alias("row_idx"), F.concat(
        F.lit("Total: "), F.col("valid").cast("string"), F.lit(" emails out of "),
        F.col("total").cast("string"), F.lit(" websites")).alias("line"))
    return union_all(addresses, details, totals)


def email_totals(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count(blank_to_null("email")).alias("valid"), F.count("*").alias("total"))


def url_coverage(leads: DataFrame, column="template_url") -> DataFrame:
    """Total, with URL, missing, and the whole percentage (0 for no rows)."""
    counted = leads.agg(F.count("*").alias("total"), F.count(column).alias("with_urls"))
    percent = F.coalesce(F.try_divide(F.col("with_urls") * 100, F.col("total")), F.lit(0.0)).cast("long")
    return counted.withColumn("missing_urls", F.col("total") - F.col("with_urls")).withColumn("percent", percent)


def scrape_success_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("error").isNull()).alias("success"),
                       F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("total"))


def stage_counts(leads: DataFrame) -> DataFrame:
    done = (F.col("stage") == 3) & blank_to_null("next_send").isNull()
    return leads.agg(F.count("*").alias("total_leads"),
                     *[F.count_if(F.col("stage") == i).alias(f"stage{i}") for i in (1, 2, 3)],
                     F.count_if(done).alias("completed"))


def send_result_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("success"),
                       F.count_if(~F.col("success")).alias("failed"))


def styles_per_site(artifacts: DataFrame) -> DataFrame:
    """Styles of each site, by name; a site has few styles, so each list is short."""
    return artifacts.select("generation", "site", "style").distinct().groupBy("generation", "site") \
        .agg(F.sort_array(F.collect_list("style")).alias("styles"))


def gallery_stats(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("total_sites"),
                     F.coalesce(F.sum(F.size("styles")), F.lit(0)).cast("long").alias("total_templates"))


def generation_summary(outcomes: DataFrame, k: int = rules.ERROR_PREVIEW) -> DataFrame:
    """Counts, the first ``k`` errors in row order, and ``...and n more errors``."""
    counts = outcomes.agg(F.count_if(F.col("error").isNull()).alias("processed"),
                          F.count_if(F.col("error").isNotNull()).alias("skipped"))
    shown = first_errors(outcomes, k).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("row_idx", "error"))), lambda e: e["error"]).alias("errors"))
    more = F.when(F.col("skipped") > k, F.concat(
        F.lit("...and "), (F.col("skipped") - k).cast("string"), F.lit(" more errors")))
    return counts.withColumn("errors", shown.scalar()).withColumn("more", more)


def first_errors(outcomes: DataFrame, k: int = rules.ERROR_PREVIEW) -> DataFrame:
    return outcomes.where("error is not null").orderBy("row_idx").limit(k).select("row_idx", "error")


def next_batch_folder(folders: DataFrame, counter: int) -> DataFrame:
    """Highest six-digit folder and the number to use next."""
    number = F.regexp_extract("name", "^([0-9]{6})$", 1).try_cast("int")
    top = folders.agg(F.max(number).cast("long").alias("highest"))
    return top.withColumn("next_folder", F.greatest(F.lit(counter).cast("long"), F.col("highest") + 1))


def log_level(line) -> Column:
    c = _c(line)
    return F.when(c.contains("ERROR"), "error").when(c.contains("WARNING"), "warning").otherwise("info")


def log_level_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(log_level("value").alias("level")).agg(F.count("*").alias("n"))


def site_search(sites: DataFrame, term: str) -> DataFrame:
    """Sites whose name or folder contains the term, case-insensitively."""
    t = term.lower().strip()
    return sites.where(F.lower("business_name").contains(t) | F.lower("folder").contains(t))


def sites_by_name(sites: DataFrame) -> DataFrame:
    return sites.orderBy(F.lower("business_name"), "folder")


def history_desc(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("pos"))


def keep_last(log: DataFrame, n: int = rules.LOG_RETENTION) -> DataFrame:
    """The last ``n`` records by append order: a top-k, no full sort."""
    return log.orderBy(F.desc("pos")).limit(n)
