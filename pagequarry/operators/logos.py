"""Logo image of a page: scored candidates from selectors, icon, og:image and JSON-LD."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.nodes import (NODES, ancestors, attr, attr_filled, best, first, json_ld, json_string, matches_rule,
                               parent, rule_table)
from ..functions.text import _c, built_once, let
from ..functions.urls import is_image_url, resolve_url

_CANDIDATES = "array<struct<value:string,score:int,method:string>>"


def image_score(img: Column, nodes=NODES, s=rules.LOGO_SCORES) -> Column:
    def bonus(test, points):
        return F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0))

    def size(name):
        return F.coalesce(F.trim(attr(img, name)), F.lit("0")).try_cast("int")

    home_link = let(parent(img, nodes), lambda up: (up["tag"] == "a") & up["attrs"]["href"].isin("/", "#"))
    return (
        F.lit(s["base"])
        + bonus(F.lower(attr(img, "alt")).contains("logo"), s["alt"])
        + bonus(F.lower(attr(img, "src")).contains("logo"), s["src"])
        + bonus(F.exists(img["classes"], lambda c: F.lower(c).contains("logo")), s["class"])
        + bonus(size("width").between(*rules.LOGO_WIDTH) & size("height").between(*rules.LOGO_HEIGHT), s["size"])
        + bonus(home_link, s["home_link"]))


@built_once
def images(nodes=NODES, base_url=None) -> Column:
    """The page's usable images with their score and ancestors."""
    base_url = F.col("url") if base_url is None else base_url
    found = F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "img") & attr_filled(n, "src")),
        lambda n: F.struct(
            n["node_id"].alias("node_id"), n["tag"].alias("tag"), n["id"].alias("id"), n["classes"].alias("classes"),
            n["attrs"].alias("attrs"), resolve_url(base_url, attr(n, "src")).alias("value"),
            image_score(n, nodes).alias("score"),
            F.transform(ancestors(n, nodes), lambda a: F.struct(
                a["node_id"].alias("node_id"), a["tag"].alias("tag"), a["id"].alias("id"),
                a["classes"].alias("classes"), a["attrs"].alias("attrs"))).alias("above")))
    return F.filter(found, lambda i: is_image_url(i["value"]))


@built_once
def selector_candidates(imgs="imgs", selectors=rules.LOGO_SELECTORS) -> Column:
    """Images matched by each selector in turn; one image may appear several times."""
    # Bound before the selectors: a column named inside their lambda would be computed again for each.
    return let(_c(imgs), lambda found: F.flatten(F.transform(rule_table(selectors), lambda r: F.transform(
        F.filter(found, lambda i: matches_rule(i, r, i["above"])),
        lambda i: F.struct(i["value"].alias("value"), i["score"].cast("int").alias("score"),
                           r["selector"].alias("method"))))))


def _single(value: Column, score: int, method: str) -> Column:
    none = F.array().cast(_CANDIDATES)
    return let(value, lambda v: F.when(v.isNotNull() & is_image_url(v), F.array(F.struct(
        v.alias("value"), F.lit(score).alias("score"), F.lit(method).alias("method")))).otherwise(none))


@built_once
def icon_candidates(nodes=NODES) -> Column:
    link = first(F.filter(nodes, lambda n: (n["tag"] == "link") & F.exists(
        F.split(F.lower(F.coalesce(attr(n, "rel"), F.lit(""))), r"\s+"),
        lambda t: t.contains("icon") | t.contains("shortcut"))))
    href = F.nullif(link["attrs"]["href"], F.lit(""))
    return _single(resolve_url(F.col("url"), href), rules.LOGO_SCORES["icon"], "icon")


@built_once
def og_image_candidates(nodes=NODES) -> Column:
    tag = first(F.filter(nodes, lambda n: (n["tag"] == "meta")
                         & F.coalesce(attr(n, "property") == "og:image", F.lit(False))))
    content = F.nullif(tag["attrs"]["content"], F.lit(""))
    return _single(resolve_url(F.col("url"), content), rules.LOGO_SCORES["og_image"], "og:image")


@built_once
def json_ld_candidates(nodes=NODES) -> Column:
    urls = F.transform(json_ld(nodes), lambda v: resolve_url(F.col("url"), json_string(v, "$.logo")))
    return F.transform(F.filter(urls, lambda u: u.isNotNull() & is_image_url(u)), lambda u: F.struct(
        u.alias("value"), F.lit(rules.LOGO_SCORES["json_ld"]).alias("score"), F.lit("json-ld").alias("method")))


@built_once
def logo_candidates() -> Column:
    return F.concat(selector_candidates(), icon_candidates(), og_image_candidates(), json_ld_candidates())


def with_logo(parsed):
    """Adds ``logo_candidates`` and ``logo``."""
    return parsed.withColumn("imgs", images()).withColumn("logo_candidates", logo_candidates()) \
        .withColumn("logo", best(F.col("logo_candidates"))).drop("imgs")
