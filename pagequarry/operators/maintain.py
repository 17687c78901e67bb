"""Keeping the lead table and its maps current."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import blank_to_null, safe_folder_name, strip
from ..functions.urls import batch_folder, domain_key, first_label, folder_source_name, normalize_url
from .greedy import WIDTH, taken_before
from .linkage import domain_map_left_join, semi_membership, staged_linkage, with_site_urls
from .shared import last_per_key, materialize, one_per_key, ranked, running_total, skew_join, union_all


def ensure_columns(df: DataFrame, columns, default=None) -> DataFrame:
    missing = {c: F.lit(default).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def reset_enrichment(leads: DataFrame) -> DataFrame:
    return leads.select("url")


def append_new_urls(leads: DataFrame, batch: DataFrame) -> DataFrame:
    """Leads plus the URLs of the batch that are neither empty nor known."""
    fresh = batch.where(strip("url") != "").select(normalize_url("url").alias("url")).distinct()
    return leads.unionByName(semi_membership(fresh, leads), allowMissingColumns=True)


def upsert_subdomains(existing: DataFrame, incoming: DataFrame, base=rules.SUBDOMAIN_BASE,
                      root=rules.DOCUMENT_ROOT) -> DataFrame:
    """Replace by ``subdomain`` in place, append the rest after the last position.

    ``incoming`` has ``seq, subdomain, website_path, style, active, date_added``;
    entries that miss a key field are ignored and the last entry of a key wins,
    at the place of its first.
    """
    complete = incoming.where(" and ".join(f"{c} != ''" for c in ("subdomain", "website_path", "style")))
    firsts = complete.groupBy("subdomain").agg(F.min("seq").alias("_first"))
    new = last_per_key(complete, ["subdomain"], F.col("seq")).drop("seq").join(firsts, "subdomain") \
        .withColumns({"document_root": F.concat_ws("/", F.lit(root), "website_path", "style"),
                      "url": F.concat(F.lit("https://"), "subdomain", F.lit(f".{base}"))})
    facts = ["website_path", "style", "date_added", "active", "document_root", "url"]
    both = existing.alias("o").join(new.alias("n"), "subdomain", "full").select(
        "subdomain", F.col("o.position").alias("position"), F.col("n._first").alias("_first"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in facts])
    both = materialize(both, "subdomains")
    last = existing.agg(F.coalesce(F.max("position"), F.lit(0)).alias("p")).scalar()
    added = ranked(both.where("position is null"), "_first", name="_rank") \
        .withColumn("position", (last + F.col("_rank")).cast("long"))
    return union_all(both.where("position is not null").drop("_first"), added.drop("_first", "_rank"))


def delete_by_position(df: DataFrame, positions: DataFrame, column="position") -> DataFrame:
    """Rows at positions out of range are simply not there to delete."""
    return df.join(positions.select(column).distinct(), column, "left_anti")


def select_by_position(df: DataFrame, positions: DataFrame, column="row_idx") -> DataFrame:
    return df.join(positions.select(column).distinct(), column, "left_semi")


def merge_map(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed update: a key in ``new`` replaces the whole old entry.  Of repeated keys
    the last counts (see ``one_per_key``)."""
    old, new = one_per_key(old, [key]), one_per_key(new, [key])
    rest = [c for c in old.columns if c != key]
    return old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full").select(
        key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def upsert_domain_map(domain_map: DataFrame, leads: DataFrame, counter: int) -> DataFrame:
    """Old entries, plus a default entry for each lead domain that has none."""
    domains = leads.select(domain_key("url").alias("domain")).where("domain is not null").distinct()
    fresh = domains.join(domain_map.select("domain"), "domain", "left_anti").select(
        "domain", batch_folder(F.lit(counter)).alias("main_folder"), first_label("domain").alias("inner_folder"),
        F.col("domain").alias("ftp_name"))
    return domain_map.select("domain", "main_folder", "inner_folder", "ftp_name").unionByName(fresh)


def url_changes() -> Column:
    """True where any URL column differs from its ``old_`` value; NULL and blank differ from a URL."""
    tests = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in rules.SITE_URL_COLUMNS]
    return tests[0] | tests[1] | tests[2] | tests[3]


def _remember_urls(leads: DataFrame) -> DataFrame:
    leads = ensure_columns(leads, rules.SITE_URL_COLUMNS, "")
    return leads.withColumns({f"old_{c}": F.col(c) for c in rules.SITE_URL_COLUMNS})


def _forget(df: DataFrame) -> DataFrame:
    return df.withColumn("changed", url_changes()).drop(*[f"old_{c}" for c in rules.SITE_URL_COLUMNS])


def update_template_urls(leads: DataFrame, domain_map: DataFrame, counter: int, base=rules.SITE_BASE_URL) -> DataFrame:
    """All leads with refreshed URL columns and a ``changed`` flag."""
    joined = domain_map_left_join(_remember_urls(leads), domain_map, counter)
    return _forget(with_site_urls(joined, base)).drop("domain_key", "main_folder", "inner_folder")


def backfill_from_deployment(leads: DataFrame, folders: DataFrame, domain_map: DataFrame,
                             base=rules.SITE_BASE_URL) -> DataFrame:
    """All leads; those linked to a folder get the URLs of the styles it has."""
    links = staged_linkage(leads, folders, domain_map).where(
        blank_to_null("main_folder").isNotNull() & blank_to_null("inner_folder").isNotNull())
    styles = folders.select("folder_idx", "styles")
    linked = links.join(styles, "folder_idx").select("row_idx", "main_folder", "inner_folder", "styles")
    df = _remember_urls(leads).join(linked, "row_idx", "left")
    df = with_site_urls(df, base)
    of_style = {"template_url": "elegant", "elegant_url": "elegant", "minimalist_url": "minimalist", "modern_url": "modern"}
    kept = {c: F.when(F.array_contains("styles", s), F.col(c)).otherwise(F.col(f"old_{c}")) for c, s in of_style.items()}
    return _forget(df.withColumns(kept)).drop("main_folder", "inner_folder", "styles")


def changed_row_count(updated: DataFrame) -> DataFrame:
    return updated.agg(F.count_if("changed").alias("changed"))


def most_recent_generation(artifacts: DataFrame) -> DataFrame:
    """Rows of the newest time-stamped generation."""
    stamp = F.try_to_timestamp(F.regexp_extract("generation", r"([0-9]{8}-[0-9]{6})$", 1), F.lit("yyyyMMdd-HHmmss"))
    newest = artifacts.agg(F.max_by("generation", stamp).alias("g")).scalar()
    return artifacts.where(F.col("generation") == newest)


# ------------------------------------------------------------------ folder names and ids

def folder_names(leads: DataFrame) -> DataFrame:
    """Leads with a URL and the file-safe name their folder wants."""
    return leads.where(blank_to_null("url").isNotNull()).withColumn(
        "name", safe_folder_name(folder_source_name("business_name", "url")))


def site_ids(leads: DataFrame, start: int, prefix=rules.SITE_ID_PREFIX) -> DataFrame:
    """Consecutive ids in row order, carrying on after ``start``."""
    return ranked(leads, "row_idx", name="_n").withColumn(
        "site_id", F.concat(F.lit(prefix), (F.col("_n") + start).cast("string"))).drop("_n")


def unique_folders(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Give every row (``row_idx, name``) its own folder, as if taken in row order:
    the name itself if free, else the first free of ``name_1, name_2, …``.

    A repeat's number is its rank among the repeats of its name, shifted by the
    numbers that rows really named ``name_k`` took first.  Row ``name_k`` takes
    its own name unless a repeat was given it before.  With the children of a
    name sorted by ``k``, child ``k`` is first in time exactly if
    ``taken_before(k) < k - repeats_before(first row of the child)``, where
    ``taken_before`` counts the smaller children that were first.  That count is
    found in a fixed number of passes (``greedy.taken_before``), one set of them per
    level of names such as ``name_1_1``.  No step puts a name's rows into one task.
    """
    own = materialize(ranked(rows.select("row_idx", "name"), "row_idx", ["name"], name="r"), "named")
    child = r"^(.+)_([1-9][0-9]{0,17})$"
    names = own.where("r = 1").select("name", F.col("row_idx").alias("t1"))
    kids = names.select("name", "t1", F.regexp_extract("name", child, 1).alias("parent"),
                        F.regexp_extract("name", child, 2).try_cast("long").alias("k")).where("parent != ''")
    kids = kids.join(names.select(F.col("name").alias("parent")), "parent", "left_semi") \
        .withColumn("depth", F.size(F.regexp_extract_all("name", F.lit(r"_[1-9][0-9]*(?=(_[1-9][0-9]*)*$)"), F.lit(0))))
    kids = materialize(kids, "kids")
    depths = [r.depth for r in kids.select("depth").distinct().orderBy("depth").collect()]  # a handful
    lost, skips = None, None
    for depth in depths:
        level = kids.where(F.col("depth") == depth)
        parents = level.select(F.col("parent").alias("name")).distinct().withColumn("_p", F.lit(True))
        repeats = _repeats(skew_join(own, parents, "name", ["row_idx"], how="inner").drop("_p"), lost)
        repeats = repeats.where("i > 0")
        marks = union_all(
            repeats.select(F.col("name").alias("parent"), F.col("row_idx").alias("at"), F.lit(1).alias("v")),
            level.select("parent", F.col("t1").alias("at"), F.lit(0).alias("v"), "name", "k"))
        counted = running_total(marks, "at", F.col("v"), ["parent"], name="before").where("v = 0")
        rooms = materialize(counted.select("parent", "name", "k", (F.col("k") - F.col("before")).alias("room")), "rooms")
        solved = materialize(taken_before(rooms, "parent", "k", "room", width), "children").withColumn("first", F.col("taken") < F.col("room"))
        lost_here = solved.where(~F.col("first")).select("name")
        skips_here = solved.where("first").groupBy(F.col("parent").alias("name"), (F.col("k") - F.col("taken")).alias("i")) \
            .agg(F.count("*").alias("v"))
        lost = lost_here if lost is None else lost.unionByName(lost_here)
        skips = skips_here if skips is None else skips.unionByName(skips_here)
    numbered = _repeats(own, lost)
    if skips is None:
        shifted = numbered.withColumn("shift", F.lit(0))
    else:
        # Skips stand before the repeat of the same number.
        line = union_all(numbered.select("row_idx", "name", "i", (F.col("i") * 2 + 1).alias("at"), F.lit(0).alias("v")),
                         skips.select("name", (F.col("i") * 2).alias("at"), "v"))
        shifted = running_total(line, "at", F.col("v"), ["name"], name="shift").where("row_idx is not null")
    suffix = F.concat("name", F.lit("_"), (F.col("i") + F.col("shift")).cast("string"))
    return shifted.select("row_idx", "name", F.when(F.col("i") == 0, F.col("name")).otherwise(suffix).alias("folder"))


def _repeats(own: DataFrame, lost: DataFrame | None) -> DataFrame:
    """Adds ``i``: 0 where the row keeps its name, else its number among the repeats."""
    if lost is None:
        return own.withColumn("i", F.col("r") - 1)
    flag = lost.withColumn("_lost", F.lit(1))
    return skew_join(own, flag, "name", ["row_idx"]).withColumn(
        "i", F.col("r") - 1 + F.coalesce("_lost", F.lit(0))).drop("_lost")
