"""Services of a page.  Four methods run in turn; each later one only where the
raw count so far is too low.  All of it is per-row work on the node array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.nodes import (NODES, attr, descendants, first, matches_step, meta_content, next_sibling, raw_text,
                               rule_table, siblings_until_heading, text_of)
from ..functions.text import (_c, built_once, contains_any, drop_near_duplicates, is_service_text, let, split_on_first_separator,
                              strip)


def _none() -> Column:
    return F.array().cast("array<string>")


def _texts(ns: Column) -> Column:
    return F.filter(F.transform(ns, lambda n: text_of(n)), lambda t: is_service_text(t))


def _has_class(n: Column, classes) -> Column:
    return F.arrays_overlap(n["classes"], F.array(*[F.lit(c) for c in classes]))


def _card_titles(cards: Column, nodes: Column) -> Column:
    """Text of the first title element in each card."""
    titles = F.transform(cards, lambda c: text_of(first(F.filter(
        descendants(c, nodes),
        lambda n: n["tag"].isin(rules.CARD_TITLE_TAGS) | _has_class(n, rules.CARD_TITLE_CLASSES)))))
    return F.filter(titles, lambda t: F.coalesce(is_service_text(t), F.lit(False)))


@built_once
def labelled(nodes=NODES) -> Column:
    """Nodes with a class or an id: the only ones a section selector can match."""
    return F.filter(nodes, lambda n: (F.size(n["classes"]) > 0) | n["id"].isNotNull())


@built_once
def sections(from_nodes="labelled", selectors=rules.SERVICE_SECTION_SELECTORS) -> Column:
    """Matches of every selector in turn; a section may appear more than once."""
    # Bound before the selectors: a column named inside their lambda would be computed again for each.
    return let(_c(from_nodes), lambda ns: F.flatten(F.transform(rule_table(selectors), lambda r: F.filter(
        ns, lambda n: matches_step(n, r["last"])))))


@built_once
def section_services(nodes=NODES, found="sections") -> Column:
    def items(s):
        return _texts(F.slice(F.filter(descendants(s, nodes), lambda n: n["tag"].isin(rules.SECTION_ITEM_TAGS)),
                              1, rules.SECTION_ITEM_LIMIT))

    def cards(s):
        return _card_titles(F.slice(F.filter(descendants(s, nodes), lambda n: _has_class(n, rules.CARD_CLASSES)),
                                    1, rules.CARD_LIMIT), nodes)

    return F.flatten(F.transform(found, lambda s: F.concat(items(s), cards(s))))


@built_once
def heading_services(nodes=NODES, keywords=rules.SERVICE_HEADING_KEYWORDS) -> Column:
    headings = F.slice(F.filter(nodes, lambda n: n["tag"].isin("h1", "h2", "h3", "h4")), 1, rules.HEADING_LIMIT)
    telling = F.filter(headings, lambda h: contains_any(F.lower(raw_text(h)), keywords))

    def of_sibling(s):
        def inner(tags, limit):
            return _texts(F.slice(F.filter(descendants(s, nodes), lambda n: n["tag"].isin(tags)), 1, limit))
        grid = contains_any(F.lower(F.array_join(s["classes"], " ")), rules.GRID_WORDS)
        grid_items = F.slice(F.filter(
            descendants(s, nodes),
            lambda n: _has_class(n, rules.GRID_ITEM_CLASSES)
            | F.coalesce(attr(n, "class"), F.lit("")).contains(rules.GRID_ITEM_CLASS_PART)), 1, rules.GRID_ITEM_LIMIT)
        return F.when(s["tag"].isin("ul", "ol"), inner(["li"], rules.SIBLING_LIST_LIMIT)) \
            .when(s["tag"] == "div", inner(rules.SIBLING_DIV_TAGS, rules.SIBLING_DIV_LIMIT)) \
            .when(grid, _card_titles(grid_items, nodes)).otherwise(_none())

    return F.flatten(F.transform(telling, lambda h: F.flatten(
        F.transform(siblings_until_heading(h, nodes), of_sibling))))


@built_once
def phrase_paragraphs(nodes=NODES, phrases=rules.SERVICE_PHRASES) -> Column:
    """Texts of paragraphs with a telling phrase, each with the paragraph right after it."""
    ps = F.slice(F.filter(nodes, lambda n: n["tag"] == "p"), 1, rules.PARAGRAPH_LIMIT)
    telling = F.filter(ps, lambda p: contains_any(F.lower(raw_text(p)), phrases))

    def with_next(p):
        following = let(next_sibling(p, nodes), lambda s: F.when(s["tag"] == "p", F.array(text_of(s))).otherwise(_none()))
        return F.concat(F.array(text_of(p)), following)
    return F.filter(F.flatten(F.transform(telling, with_next)), lambda t: t != "")


def _parts(text: Column, separators) -> Column:
    parts = F.transform(split_on_first_separator(text, separators, _none()), strip)
    return F.filter(parts, lambda t: is_service_text(t, rules.SERVICE_PART_LENGTH))


def paragraph_services(paragraphs: Column, so_far: Column) -> Column:
    """Parts of the paragraphs in order; a short paragraph also counts whole
    while fewer than two items are known."""
    def step(acc, text):
        short = F.char_length(text) < rules.SERVICE_LENGTH[1]
        return let(F.concat(acc, _parts(text, rules.PARAGRAPH_SEPARATORS)), lambda known: F.when(
            short & (F.size(known) + so_far < 2), F.array_append(known, text)).otherwise(known))
    return F.aggregate(paragraphs, _none(), step)


def description_services(description: Column, patterns=rules.DESCRIPTION_PATTERNS) -> Column:
    def of_pattern(p):
        def items(text):
            whole = F.filter(F.array(text), lambda t: is_service_text(t))
            return F.when(contains_any(text, rules.DESCRIPTION_SEPARATORS),
                          _parts(text, rules.DESCRIPTION_SEPARATORS)).otherwise(whole)
        return let(strip(F.regexp_extract(description, "(?iU)" + p, 1)), items)
    return F.coalesce(F.concat(*[of_pattern(p) for p in patterns]), _none())


def with_raw_services(parsed):
    """Adds the raw items of each method: ``services_m1`` … ``services_m4``."""
    methods = service_methods()
    return (parsed
            .withColumn("labelled", labelled()).withColumn("sections", sections())
            .withColumn("services_m1", section_services()).withColumn("services_m2", methods[0])
            .withColumn("services_m3", methods[1]).withColumn("services_m4", methods[2])
            .drop("labelled", "sections"))


@built_once
def service_methods():
    """Methods 2 to 4, each gated by the raw count of the ones before."""
    n1, n2, n3 = (F.size(F.col(f"services_m{i}")) for i in (1, 2, 3))
    description = meta_content([("name", "description"), ("property", "og:description")])
    return (F.when(n1 < 3, heading_services()).otherwise(_none()),
            F.when(n1 + n2 < 2, paragraph_services(phrase_paragraphs(), n1 + n2)).otherwise(_none()),
            F.when(n1 + n2 + n3 < 2, description_services(description)).otherwise(_none()))


@built_once
def raw_services() -> Column:
    return F.concat("services_m1", "services_m2", "services_m3", "services_m4")


@built_once
def kept_services() -> Column:
    return drop_near_duplicates(raw_services())


def with_services(parsed):
    """Adds ``service_list`` (array) and ``services`` (joined, NULL if none)."""
    return with_raw_services(parsed).withColumn("service_list", kept_services()) \
        .withColumn("services", F.nullif(F.array_join("service_list", "; "), F.lit("")))
