"""Page to lead record."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import emails
from .logos import with_logo
from .names import with_name
from .services import with_services
from .shared import materialize


def page_fields(pages: DataFrame) -> DataFrame:
    """All fields of every page in one narrow pass: no shuffle, one parse."""
    parsed = emails.parse_with_emails(pages)
    parsed = with_services(with_name(with_logo(parsed)))
    failed = F.col("parse_error").isNotNull()
    return parsed.select(
        "page_id", "url", emails.own_email().alias("email"), emails.contact_url().alias("contact_url"),
        "logo", F.when(~failed, F.col("business_name")).alias("business_name"), "services",
        F.col("parse_error").alias("error"))


def scrape_records(pages: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Lead records of ``pages``; contact pages are looked up in ``corpus``
    (by default among the pages themselves).

    The extracted fields are tiny next to the HTML, so they are written once and
    the contact lookup works on them instead of parsing pages again.
    """
    fields = materialize(page_fields(pages), "fields")
    if corpus is None:
        known = fields
    else:
        # One narrow pass: only URL and address leave it, the HTML is never shuffled.
        known = emails.parse_with_emails(corpus).select("page_id", "url", emails.own_email().alias("email"))
    full = emails.with_contact_emails(fields, emails.emails_by_url(known))
    return full.select("page_id", *rules.LEAD_COLUMNS)
