"""Linking leads to published folders: by name, by domain map, by partial match.

Every step works on distinct keys (names, domains, folders) and joins its
answer back to the leads once, so a name or domain that holds a third of all
leads is resolved once and only the way back needs salting.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import blank_to_null, or_default, strip
from ..functions.urls import authority, batch_folder, domain_key, domain_slug, first_label, netloc, site_url
from .automaton import first_contained, first_overlap
from .shared import first_per_key, last_per_key, lookup_join, materialize, one_per_key, skew_join, union_all


def domain_map_left_join(leads: DataFrame, domain_map: DataFrame, counter: int) -> DataFrame:
    """Adds ``domain_key, main_folder, inner_folder``; unmapped domains get the
    current batch folder and their first label."""
    places = [c for c in ("pos",) if c in domain_map.columns]
    mapped = one_per_key(domain_map.select(F.col("domain").alias("domain_key"), F.col("main_folder").alias("_main"),
                                           F.col("inner_folder").alias("_inner"), *places), ["domain_key"])
    joined = lookup_join(leads.withColumn("domain_key", domain_key("url")), mapped, "domain_key", ["row_idx"])
    known = F.col("domain_key").isNotNull()
    return joined.withColumns({
        "main_folder": F.when(known, F.coalesce("_main", batch_folder(F.lit(counter)))),
        "inner_folder": F.when(known, F.coalesce("_inner", first_label("domain_key")))}).drop("_main", "_inner")


def _first_folders(folders: DataFrame, key) -> DataFrame:
    """The first folder, in folder order, for each key."""
    return first_per_key(folders.select(key.alias("_key"), "folder_idx", "folder", "main_folder", "inner_folder"),
                         ["_key"], F.col("folder_idx"))


def name_exact_match(leads: DataFrame, folders: DataFrame, how: str = "inner") -> DataFrame:
    """Leads whose business name equals a folder name, ignoring case."""
    named = leads.withColumn("_key", F.lower(blank_to_null("business_name")))
    return lookup_join(named, _first_folders(folders, F.lower("folder")), "_key", ["row_idx"], how).drop("_key")


def _deployed_hosts(leads: DataFrame, folders: DataFrame, domain_map: DataFrame) -> DataFrame:
    """The deployed folder that each host of the leads is mapped to."""
    hosts = leads.select(authority("url").alias("_host")).where("_host != ''").distinct()
    places = [c for c in ("pos",) if c in domain_map.columns]
    entries = one_per_key(domain_map.select(F.col("domain").alias("_try"), "ftp_name", "main_folder", "inner_folder", *places), ["_try"])
    tries = hosts.select("_host", F.posexplode(F.array_distinct(F.array(
        F.regexp_replace("_host", r"^www\.", ""), F.col("_host")))).alias("_at", "_try"))
    hits = first_per_key(tries.join(entries, "_try"), ["_host"], F.col("_at"))
    names = folders.groupBy(F.col("folder").alias("ftp_name")).agg(F.min("folder_idx").alias("folder_idx"))
    return hits.join(names, "ftp_name").select(
        "_host", "folder_idx", F.col("ftp_name").alias("folder"), "main_folder", "inner_folder")


def domain_map_then_deployed(leads: DataFrame, folders: DataFrame, domain_map: DataFrame) -> DataFrame:
    """Leads whose domain is mapped to a folder that is deployed.  The key
    without ``www.`` is preferred where it is mapped."""
    keyed = leads.withColumn("_host", authority("url"))
    return lookup_join(keyed, _deployed_hosts(leads, folders, domain_map), "_host", ["row_idx"], "inner").drop("_host")


def linkage_domain(domain_map: DataFrame, leads: DataFrame) -> DataFrame:
    """Adds ``_domain``: the lower-cased authority, without ``www.`` only where that form is mapped."""
    host = authority("url")
    bare = F.regexp_replace(host, r"^www\.", "")
    keyed = leads.withColumn("_bare", F.nullif(bare, F.lit(""))).withColumn("_host", F.nullif(host, F.lit("")))
    known = domain_map.select(F.col("domain").alias("_bare"), F.lit(True).alias("_known")).distinct()
    return lookup_join(keyed, known, "_bare", ["row_idx"]).withColumn(
        "_domain", F.when(F.col("_known"), F.col("_bare")).otherwise(F.col("_host"))).drop("_bare", "_host", "_known")


def partial_match(leads: DataFrame, folders: DataFrame, domain_map: DataFrame) -> DataFrame:
    """Leads whose domain contains a folder name or lies in one; first folder wins."""
    keyed = materialize(linkage_domain(domain_map, leads), "domains")
    low = folders.select(F.lower("folder").alias("_folder"), "folder_idx")
    hit = first_overlap(keyed.where("_domain is not null"), low, "_domain", "_folder", "folder_idx")
    full = hit.join(folders.select("folder_idx", "folder", "main_folder", "inner_folder"), "folder_idx")
    return lookup_join(keyed, full, "_domain", ["row_idx"], "inner").drop("_domain")


def staged_linkage(leads: DataFrame, folders: DataFrame, domain_map: DataFrame) -> DataFrame:
    """The first stage that succeeds decides: 1 name, 2 domain map, 3 partial.

    Names and hosts are looked up in one pass over the leads; those without an answer go on.
    """
    columns = ["folder_idx", "folder", "main_folder", "inner_folder"]

    def link(n):
        return F.when(F.col("folder_idx").isNotNull(), F.struct(F.lit(n).cast("long").alias("stage"), *columns))

    keys = leads.select("row_idx", "url", "business_name")
    named = name_exact_match(keys, folders, "left").select("row_idx", "url", link(1).alias("_named"))
    both = lookup_join(named.withColumn("_host", authority("url")), _deployed_hosts(keys, folders, domain_map), "_host", ["row_idx"])
    looked = materialize(both.select("row_idx", "url", F.coalesce("_named", link(2)).alias("_link")), "looked_up")
    done = looked.where("_link is not null").select("_link.stage", "row_idx", *[f"_link.{c}" for c in columns])
    rest = looked.where("_link is null").select("row_idx", "url")
    by_part = partial_match(rest, folders, domain_map).select(F.lit(3).cast("long").alias("stage"), "row_idx", *columns)
    return done.unionByName(by_part)


def folder_lead_containment(folders: DataFrame, leads: DataFrame) -> DataFrame:
    """For each folder the first lead, in row order, whose name contains the
    folder (``_`` read as blank) or lies in it; adds the lead's domain label."""
    usable = leads.where(netloc(strip("url")) != "").select(
        "row_idx", F.lower(strip("business_name")).alias("_name")).where("_name != ''")
    shown = folders.withColumn("_shown", F.replace(F.lower("folder"), F.lit("_"), F.lit(" ")))
    hit = materialize(first_overlap(shown, usable, "_shown", "_name", "row_idx"), "hits")
    labels = leads.select("row_idx", first_label(domain_key("url")).alias("domain_label"))
    return skew_join(shown, hit.join(labels, "row_idx"), "_shown", ["folder_idx"], how="inner").drop("_shown")


def folder_domain_containment(folders: DataFrame, leads: DataFrame) -> DataFrame:
    """Domain label for each folder: from a lead whose name matches, else from
    the first lead whose label lies in the folder name, else from the folder itself."""
    by_name = materialize(folder_lead_containment(folders, leads).select(
        "folder_idx", "domain_label", F.lit("name").alias("source")), "by_name")
    labels = leads.select("row_idx", first_label(domain_key("url")).alias("_label"))
    rest = materialize(folders.join(by_name.select("folder_idx"), "folder_idx", "left_anti").select(
        "folder_idx", "folder", F.replace(F.lower("folder"), F.lit("_"), F.lit("")).alias("_joined")), "unnamed")
    hit = first_contained(rest, labels.where("_label is not null"), "_joined", "_label", "row_idx")
    answer = hit.join(labels, "row_idx").select("_joined", F.col("_label").alias("domain_label"))
    by_label = skew_join(rest, answer, "_joined", ["folder_idx"]).select(
        "folder_idx", F.coalesce("domain_label", F.lower("folder")).alias("domain_label"),
        F.when(F.col("domain_label").isNotNull(), "domain").otherwise("folder").alias("source"))
    return by_name.unionByName(by_label).withColumn("domain_label", domain_slug("domain_label"))


def site_style_cross(sites: DataFrame, styles=rules.STYLES) -> DataFrame:
    """Every site in every style; the three styles are a constant of the plan."""
    names = ("style", "primary_color", "secondary_color", "accent_color", "font", "style_class")
    rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, s)]) for s in styles])
    return sites.withColumn("_s", F.explode(rows)).select(*sites.columns, "_s.*")


def semi_membership(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Batch rows whose URL is not known yet."""
    return lookup_join(batch, known.select("url").distinct(), "url", how="left_anti")


def deployed_status(sites: DataFrame, deployed: DataFrame) -> DataFrame:
    """Flags the sites that are deployed."""
    live = deployed.select("folder").distinct().withColumn("_live", F.lit(True))
    return lookup_join(sites, live, "folder", ["site_idx"]).withColumn("deployed", F.col("_live").isNotNull()).drop("_live")


def reverse_map(folder_map: DataFrame) -> DataFrame:
    """Folder map turned round: keyed by folder, domain and ``www.`` domain; later entries win."""
    domain = F.lower("domain")
    keys = F.array(F.lower("folder"), domain,
                   F.when(~domain.startswith("www."), F.concat(F.lit("www."), domain)))
    rows = folder_map.select(
        "pos", F.col("folder").alias("ftp_name"), or_default("main_folder", "").alias("main_folder"),
        or_default("inner_folder", "").alias("inner_folder"), F.posexplode(keys).alias("at", "key")).where("key is not null")
    return last_per_key(rows, ["key"], F.struct("pos", "at")).select("key", "ftp_name", "main_folder", "inner_folder")


def with_site_urls(df: DataFrame, base: str = rules.SITE_BASE_URL) -> DataFrame:
    """The four URL columns from ``main_folder`` and ``inner_folder``; the
    template URL is the elegant one.  Rows without folders keep what they had."""
    def url(style, old):
        fresh = F.when(F.col("main_folder").isNotNull() & F.col("inner_folder").isNotNull(),
                       site_url("main_folder", "inner_folder", style, base))
        return F.coalesce(fresh, F.col(old)) if old in df.columns else fresh
    styles = {"template_url": "elegant", "elegant_url": "elegant", "minimalist_url": "minimalist", "modern_url": "modern"}
    return df.withColumns({c: url(s, c) for c, s in styles.items()})
