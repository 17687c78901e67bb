"""Contact e-mail of a page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.nodes import NODES, attr, first, matches, raw_text
from ..functions.text import built_once, _c, contains_any, ends_with_any, strip
from ..functions.urls import resolve_url
from ..sources.pages import parse_pages
from .shared import first_per_key, skew_join


def is_false_positive(email) -> Column:
    e = _c(email)
    return ends_with_any(e, rules.EMAIL_REJECT_SUFFIXES) | contains_any(e, rules.EMAIL_REJECT_CHARS) \
        | e.startswith(rules.EMAIL_REJECT_PREFIXES[0]) | e.startswith(rules.EMAIL_REJECT_PREFIXES[1])


#: Finds what ``rules.EMAIL_PATTERN`` finds, in time linear in the text.  An address needs its ``@`` right after a run of
#: local-part letters, so of all places in a run only its first word boundary can start one: a run is entered at
#: its start or where the last address ended, and left at once if that place fails.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_SEARCH = rf"(?U)(?:\G|(?<!{_LOCAL}))(?:\B{_LOCAL})*+({rules.EMAIL_PATTERN})"


@built_once
def regex_emails(raw) -> Column:
    """All plausible addresses in raw text, in order.  Texts without ``@`` skip the regex."""
    c = _c(raw)
    found = F.regexp_extract_all(c, F.lit(EMAIL_SEARCH), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(c.contains("@"), F.filter(found, lambda e: ~is_false_positive(e))).otherwise(none)


def mailto_address(href: Column) -> Column:
    """Address of a mailto link, or NULL if it is not one."""
    email = strip(F.split(F.replace(href, F.lit("mailto:"), F.lit("")), r"\?")[0])
    host = F.try_element_at(F.split(email, "@", -1), F.lit(2))
    return F.when(F.coalesce(host.contains("."), F.lit(False)), email)


@built_once
def mailto_emails(nodes=NODES) -> Column:
    links = F.filter(nodes, lambda n: matches(n, 'a[href^="mailto:"]'))
    return F.filter(F.transform(links, lambda n: mailto_address(attr(n, "href"))), lambda e: e.isNotNull())


@built_once
def contact_href(nodes=NODES, words=rules.CONTACT_LINK_WORDS) -> Column:
    """Target of the first link whose text names a contact page."""
    return first(F.filter(nodes, lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()
                          & contains_any(F.lower(raw_text(n)), words)))["attrs"]["href"]


@built_once
def page_emails(regex: str = "regex_emails") -> Column:
    """All addresses of a page, mailto links before plain text, without repeats."""
    return F.array_distinct(F.concat(mailto_emails(), F.col(regex)))


@built_once
def own_email(regex: str = "regex_emails") -> Column:
    return first(page_emails(regex))


@built_once
def contact_url() -> Column:
    return resolve_url(F.col("url"), contact_href())


def with_contact_emails(records: DataFrame, by_url: DataFrame) -> DataFrame:
    """Fill missing e-mails from the contact page each record points to.

    ``records`` has ``page_id, email, contact_url``; ``by_url`` has
    ``url, email`` for the corpus.  Contact addresses are made distinct before
    they meet the corpus, so both sides of that join are unique per key; only
    the way back may be skewed.
    """
    need = F.when(F.col("email").isNull(), F.col("contact_url"))
    records = records.withColumn("_need", need)
    wanted = records.where("_need is not null").select("_need").distinct()
    found = wanted.join(by_url.select(F.col("url").alias("_need"), F.col("email").alias("_found")), "_need")
    return skew_join(records, found, "_need", ["page_id"]) \
        .withColumn("email", F.coalesce("email", "_found")).drop("_need", "_found")


def emails_by_url(fields: DataFrame) -> DataFrame:
    """One address per URL (the page with the lowest id speaks for a URL)."""
    return first_per_key(fields.where("email is not null").select("url", "page_id", "email"),
                         ["url"], F.col("page_id")).select("url", "email")


def parse_with_emails(pages: DataFrame) -> DataFrame:
    """Parsed pages plus the regex addresses, taken before the raw HTML is dropped."""
    return parse_pages(pages.withColumn("regex_emails", regex_emails("html")))
