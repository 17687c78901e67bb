"""Element-level operators on parsed pages, one row per element or match."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import (NODES, exploded, first, matches_rule, ancestors, next_sibling, parent, rule_table,
                               select, siblings_until_heading, text_of)


def html_nodes(parsed: DataFrame) -> DataFrame:
    return exploded(parsed)


def css_matches(parsed: DataFrame, selectors) -> DataFrame:
    """Every match of every selector: ``page_id, selector, node_id, tag, text``."""
    hits = F.flatten(F.transform(rule_table(selectors), lambda r: F.transform(
        F.filter(NODES, lambda n: matches_rule(n, r, ancestors(n))),
        lambda n: F.struct(r["selector"].alias("selector"), n["node_id"].alias("node_id"), n["tag"].alias("tag"),
                           text_of(n).alias("text")))))
    return parsed.select("page_id", F.explode(hits).alias("m")).select("page_id", "m.*")


def _per_match(parsed: DataFrame, selector: str, make) -> DataFrame:
    return parsed.select("page_id", F.explode(F.transform(select(selector), make)).alias("m")).select("page_id", "m.*")


def direct_parents(parsed: DataFrame, selector: str) -> DataFrame:
    return _per_match(parsed, selector, lambda n: F.struct(
        n["node_id"].alias("node_id"), n["attrs"].alias("attrs"), parent(n)["tag"].alias("parent_tag"),
        parent(n)["attrs"]["href"].alias("parent_href")))


def next_siblings(parsed: DataFrame, selector: str) -> DataFrame:
    def row(n):
        s = next_sibling(n)
        return F.struct(n["node_id"].alias("node_id"), text_of(n).alias("text"), s["tag"].alias("next_tag"),
                        text_of(s).alias("next_text"))
    return _per_match(parsed, selector, row)


def heading_siblings(parsed: DataFrame, tags=("h1", "h2", "h3", "h4")) -> DataFrame:
    headings = F.filter(NODES, lambda n: n["tag"].isin(*tags))
    rows = F.transform(headings, lambda h: F.struct(
        h["node_id"].alias("node_id"), text_of(h).alias("heading"),
        F.transform(siblings_until_heading(h), lambda s: s["tag"]).alias("sibling_tags")))
    return parsed.select("page_id", F.explode(rows).alias("m")).select("page_id", "m.*")


def first_text(selector: str) -> Column:
    return text_of(first(select(selector)))


def first_k(parsed: DataFrame, selector: str, k: int) -> DataFrame:
    """The first ``k`` matches of each page, in document order."""
    hits = F.transform(F.slice(select(selector), 1, k), lambda n, i: F.struct(
        (i + 1).cast("long").alias("pos"), text_of(n).alias("text")))
    return parsed.select("page_id", F.explode(hits).alias("m")).select("page_id", "m.*")
