"""Selecting elements from a page's node array with higher-order functions.

A page's nodes are in document order and ``nodes[i].node_id = i + 1``; the
descendants of ``n`` are exactly the slice ``node_id + 1 .. end_id``.
"""

import json
import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import let, strip

NODE_TYPE = ("struct<node_id:int,end_id:int,parent_id:int,depth:int,tag:string,id:string,"
             "classes:array<string>,attrs:map<string,string>,text_start:int,text_len:int,raw:string>")

NODES, TEXT = "nodes", "text"  # default column names
_SIMPLE = re.compile(r'(\w+)?(?:\.([\w-]+))?(?:#([\w-]+))?(?:\[(\w+)([*^])="([^"]*)"( i)?\])?')

_STEP = "struct<tag:string,cls:string,id:string,attr:string,part:string>"
_RULES = f"array<struct<selector:string,score:int,outer:array<{_STEP}>,last:{_STEP}>>"


def steps(selector: str) -> list[str]:
    """Simple selectors of a descendant selector, outermost first."""
    return re.split(r" +(?![^\[]*\])", selector)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def attr(n: Column, name: str) -> Column:
    return n["attrs"][name]


def attr_filled(n: Column, name: str) -> Column:
    return F.coalesce(attr(n, name), F.lit("")) != ""


def matches(n: Column, selector: str) -> Column:
    """Test one node against a simple selector: ``tag``, ``.class``, ``#id``,
    ``[attr*="v" i]``, ``[attr^="v"]`` or a combination."""
    tag, cls, ident, name, op, value, ignore_case = _SIMPLE.fullmatch(selector).groups()
    tests = []
    if tag:
        tests.append(n["tag"] == tag)
    if cls:
        tests.append(F.array_contains(n["classes"], cls))
    if ident:
        tests.append(F.coalesce(n["id"] == ident, F.lit(False)))
    if name:
        v = F.coalesce(attr(n, name), F.lit(""))
        v, value = (F.lower(v), value.lower()) if ignore_case else (v, value)
        tests.append(v.contains(value) if op == "*" else v.startswith(value))
    return all_of(tests)


def inside(n: Column, a: Column) -> Column:
    """``a`` is a proper ancestor of ``n``."""
    return (a["node_id"] < n["node_id"]) & (n["node_id"] <= a["end_id"])


def ancestors(n: Column, nodes=NODES) -> Column:
    """Proper ancestors, innermost first: follows the parent links, one step per level."""
    def up(s, _):
        above = F.element_at(nodes, s["at"])
        return F.struct(above["parent_id"].alias("at"), F.array_append(s["seen"], above).alias("seen"))
    start = F.struct(n["parent_id"].alias("at"), F.array().cast(f"array<{NODE_TYPE}>").alias("seen"))
    return F.when(n["depth"] > 0, F.aggregate(
        F.sequence(F.lit(1), F.greatest(n["depth"], F.lit(1))), start, up, lambda s: s["seen"])) \
        .otherwise(F.array().cast(f"array<{NODE_TYPE}>"))


def rule_table(selectors, scores=None) -> Column:
    """Selectors as data: a constant array of rules for ``matches_rule``.

    A rule is a row and not an expression, so the plan does not grow with the
    number of selectors.  Attribute tests are ``*=`` tests that ignore case.
    """
    def step(simple):
        tag, cls, ident, name, _, value, _ = _SIMPLE.fullmatch(simple).groups()
        return {"tag": tag, "cls": cls, "id": ident, "attr": name, "part": value.lower() if value else None}
    table = [{"selector": s, "score": scores[i] if scores else 0, "outer": [step(x) for x in steps(s)[:-1]],
              "last": step(steps(s)[-1])} for i, s in enumerate(selectors)]
    return F.from_json(F.lit(json.dumps(table)), _RULES)


def matches_step(n: Column, r: Column) -> Column:
    """Test one node against one simple selector of a rule table."""
    return ((r["tag"].isNull() | (r["tag"] == n["tag"]))
            & (r["cls"].isNull() | F.array_contains(n["classes"], r["cls"]))
            & (r["id"].isNull() | F.coalesce(r["id"] == n["id"], F.lit(False)))
            & (r["attr"].isNull() | F.coalesce(F.contains(F.lower(n["attrs"][r["attr"]]), r["part"]), F.lit(False))))


def matches_rule(n: Column, r: Column, above: Column) -> Column:
    """Test a node and its ancestors against a descendant selector of up to three steps."""
    b = F.get(r["outer"], F.lit(1))
    # All ancestors lie on one path, so nesting is the order of their ids.
    nested = F.when(F.size(r["outer"]) == 0, F.lit(True)).otherwise(F.exists(
        above, lambda x: matches_step(x, F.get(r["outer"], F.lit(0)))
        & (b.isNull() | F.exists(above, lambda y: (x["node_id"] < y["node_id"]) & matches_step(y, b)))))
    return matches_step(n, r["last"]) & nested


def select_rule(r: Column, nodes=NODES) -> Column:
    return F.filter(nodes, lambda n: matches_rule(n, r, ancestors(n, nodes)))


def select(selector: str, nodes=NODES) -> Column:
    """All nodes matching a selector, in document order."""
    if steps(selector) == [selector]:
        return F.filter(nodes, lambda n: matches(n, selector))
    return let(F.get(rule_table([selector]), F.lit(0)), lambda r: select_rule(r, nodes))


def first(selected: Column) -> Column:
    return F.try_element_at(selected, F.lit(1))


def descendants(n: Column, nodes=NODES) -> Column:
    return F.slice(nodes, n["node_id"] + 1, n["end_id"] - n["node_id"])


def parent(n: Column, nodes=NODES) -> Column:
    return F.when(n["parent_id"] > 0, F.element_at(nodes, F.greatest(n["parent_id"], F.lit(1))))


def later_siblings(n: Column, nodes=NODES) -> Column:
    """Following element siblings: they lie between the node's own end and its parent's."""
    up = F.when(n["parent_id"] > 0, F.element_at(nodes, F.greatest(n["parent_id"], F.lit(1)))["end_id"]) \
        .otherwise(F.size(nodes))
    return F.filter(F.slice(nodes, n["end_id"] + 1, up - n["end_id"]),
                    lambda s: s["parent_id"] == n["parent_id"])


def next_sibling(n: Column, nodes=NODES) -> Column:
    """The next sibling starts right after the node's last descendant."""
    return let(F.try_element_at(nodes, n["end_id"] + 1), lambda s: F.when(s["parent_id"] == n["parent_id"], s))


def _heading_level(n: Column) -> Column:
    return F.when(n["tag"].isin("h1", "h2", "h3", "h4", "h5", "h6"), F.substring(n["tag"], 2, 1).cast("int"))


def siblings_until_heading(n: Column, nodes=NODES) -> Column:
    """Later siblings of a heading up to the next h1-h3 of its own or a higher level."""
    def until_stop(later):
        stop = F.array_min(F.transform(
            F.filter(later, lambda s: s["tag"].isin("h1", "h2", "h3")
                     & (_heading_level(s) <= F.coalesce(_heading_level(n), F.lit(10)))),
            lambda s: s["node_id"]))
        return let(stop, lambda at: F.filter(later, lambda s: at.isNull() | (s["node_id"] < at)))
    return let(later_siblings(n, nodes), until_stop)


def raw_text(n: Column, text=TEXT) -> Column:
    """Text of an element; script and style elements hold theirs apart."""
    own = F.coalesce(n["raw"], F.lit(""))
    return F.when(n["tag"].isin("script", "style"), own) \
        .otherwise(F.substr(text, n["text_start"] + 1, n["text_len"]))


def text_of(n: Column, text=TEXT) -> Column:
    return strip(raw_text(n, text))


def meta_content(names, nodes=NODES) -> Column:
    """Trimmed content of the first meta tag found; ``names`` lists
    ``(attribute, value)`` pairs by preference.  The first *tag* decides, even
    when its content is empty."""
    found = F.coalesce(*[
        first(F.filter(nodes, lambda n: (n["tag"] == "meta") & F.coalesce(attr(n, a) == v, F.lit(False))))
        for a, v in names])
    return F.nullif(strip(F.coalesce(found["attrs"]["content"], F.lit(""))), F.lit(""))


def json_ld(nodes=NODES) -> Column:
    """JSON-LD scripts whose top level is an object; of a repeated key the last counts."""
    # Read when the expression is built, so it must be set before; without it such objects are no JSON.
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    scripts = F.filter(nodes, lambda n: (n["tag"] == "script") & F.coalesce(
        attr(n, "type") == "application/ld+json", F.lit(False)) & n["raw"].isNotNull())
    return F.filter(F.transform(scripts, lambda n: F.try_parse_json(n["raw"])),
                    lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def json_string(v: Column, path: str) -> Column:
    """String at a path of a variant; NULL if absent, empty or not a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING",
                  F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def json_is_object(v: Column, path: str) -> Column:
    """Is there a non-empty object at the path?"""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))


def exploded(parsed, *extra):
    """Flat view of the node arrays: one row per element."""
    return parsed.select("page_id", *extra, F.explode("nodes").alias("n")).select("page_id", *extra, "n.*")


def best(candidates: Column) -> Column:
    """Value with the highest score; the earliest wins a tie."""
    ranked = F.transform(candidates, lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c["value"].alias("value")))
    return F.array_min(ranked)["value"]


def candidate(value: Column, score, method: str) -> Column:
    return F.struct(value.alias("value"), F.lit(score).cast("int").alias("score"), F.lit(method).alias("method"))


def present(candidates) -> Column:
    """Array of the candidates that have a value, in the given order."""
    return F.filter(F.array(*candidates), lambda c: c["value"].isNotNull())
