"""Business name of a page: scored candidates from title, JSON-LD, headings, meta tags and domain."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.nodes import (NODES, ancestors, best, candidate, first, json_is_object, json_ld, json_string, matches_rule,
                               meta_content, present, rule_table, select, steps, text_of)
from ..functions.text import built_once, _c, blank_to_null, let, strip
from ..functions.urls import domain_display_name


def title_from_raw_html(html) -> Column:
    return F.regexp_extract(_c(html), r"<title>(.*?)</title>", 1)


def clean_title(title) -> Column:
    """Cut the title at its first dash or bar that has text after it."""
    return blank_to_null(strip(F.regexp_replace(strip(title), "(?Ud)" + rules.TITLE_TAIL_PATTERN, "")))


@built_once
def title_candidates(nodes=NODES) -> Column:
    title = first(select("title", nodes))
    return present([candidate(clean_title(text_of(title)), rules.NAME_TITLE_SCORE, "title")])


@built_once
def json_ld_candidates(nodes=NODES) -> Column:
    def of_one(v):
        def long_enough(s):
            return F.when(F.char_length(s) > 1, s)

        org = F.when(json_is_object(v, "$.publisher"), json_string(v, "$.publisher.name")) \
            .when(json_is_object(v, "$.organization"), json_string(v, "$.organization.name"))
        return present([candidate(long_enough(json_string(v, "$.name")), rules.NAME_JSONLD_SCORE, "json-ld"),
                        candidate(long_enough(org), rules.NAME_JSONLD_ORG_SCORE, "json-ld organization")])
    return F.flatten(F.transform(json_ld(nodes), of_one))


def _fits(value: Column) -> Column:
    return let(value, lambda v: F.when(F.char_length(v).between(*rules.NAME_LENGTH), v))


@built_once
def header_candidates(nodes=NODES, table=rules.NAME_HEADER_RULES) -> Column:
    """The first match of each rule, if its text has a name's length."""
    rows = rule_table([s for s, _ in table], [score for _, score in table])
    # Only elements with a class or an id, or of a tag that a rule ends in, can match one.
    tags = sorted({t for t in (re.match(r"\w*", steps(s)[-1])[0] for s, _ in table) if t})

    def of_rules(likely):
        return F.transform(rows, lambda r: F.struct(
            _fits(text_of(first(F.filter(likely, lambda n: matches_rule(n, r, ancestors(n, nodes)))))).alias("value"),
            r["score"].alias("score"), r["selector"].alias("method")))
    found = let(F.filter(nodes, lambda n: (F.size(n["classes"]) > 0) | n["id"].isNotNull() | n["tag"].isin(*tags)), of_rules)
    return F.filter(found, lambda c: c["value"].isNotNull())


@built_once
def meta_candidates(nodes=NODES, table=rules.NAME_META_RULES) -> Column:
    return present([candidate(_fits(meta_content([("property", p), ("name", p)], nodes)), score, p)
                    for p, score in table])


@built_once
def domain_candidates(url="url") -> Column:
    return present([candidate(domain_display_name(url), rules.NAME_DOMAIN_SCORE, "domain")])


@built_once
def name_candidates() -> Column:
    return F.concat(title_candidates(), json_ld_candidates(), header_candidates(), meta_candidates(),
                    domain_candidates())


def with_name(parsed):
    """Adds ``name_candidates`` and ``business_name``."""
    return parsed.withColumn("name_candidates", name_candidates()) \
        .withColumn("business_name", best(F.col("name_candidates")))


@built_once
def native_name(html, url) -> Column:
    """Title and domain only, straight from raw HTML: no parsing, all native."""
    return best(F.concat(present([candidate(clean_title(title_from_raw_html(html)), rules.NAME_TITLE_SCORE, "title")]),
                         domain_candidates(url)))
