"""URL expressions.  ``parse_url`` is not used: it drops ports and user-info and
returns NULL for hosts with umlauts or blanks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import _c, capitalized, ends_with_any, let, or_default, strip

# scheme, authority, path, query, fragment
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(col, i) -> Column:
    return F.regexp_extract(_c(col), _PARTS, i)


def normalize_url(col, trim=True) -> Column:
    u = strip(col) if trim else _c(col)
    return F.when(u.startswith("http://") | u.startswith("https://"), u) \
        .otherwise(F.concat(F.lit("https://"), u))


def netloc(col) -> Column:
    return F.regexp_extract(_c(col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(col) -> Column:
    """Path without query, fragment and the parameters of the last segment."""
    return F.regexp_replace(_part(col, 3), r";[^/]*$", "")


def _after_slashes(u: Column) -> Column:
    """What follows the first ``//``, up to the next slash; for URLs without an authority."""
    return F.lower(F.split(F.try_element_at(F.split(u, "//"), F.lit(2)), "/")[0])


def authority(col) -> Column:
    """Lower-cased authority, else the text after ``//``."""
    u = strip(col)
    return F.when(netloc(u) != "", F.lower(netloc(u))).otherwise(_after_slashes(u))


def domain_key(col) -> Column:
    """Lower-cased authority without one leading ``www.``; NULL if none."""
    u = strip(col)
    host = F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")
    return F.nullif(F.when(netloc(u) != "", host).otherwise(_after_slashes(u)), F.lit(""))


def first_label(domain) -> Column:
    return F.split(_c(domain), r"\.")[0]


def domain_slug(domain) -> Column:
    d = F.regexp_replace(F.lower(_c(domain)), r"^www\.", "")
    return F.regexp_replace(first_label(d), "[^a-z0-9]", "")


def domain_display_name(url) -> Column:
    labels = F.split(F.replace(netloc(url), F.lit("www."), F.lit("")), r"\.", -1)
    name = capitalized(labels[0])
    return F.when((F.size(labels) > 1) & (F.char_length(name) >= 3), name)


def is_image_url(col) -> Column:
    return ends_with_any(F.lower(url_path(col)), rules.IMAGE_SUFFIXES)


def logo_basename(col) -> Column:
    return let(F.element_at(F.split(url_path(col), "/"), -1),
               lambda name: F.when(name.contains("."), name).otherwise(F.lit("logo.png")))


def _drop_dots(segments: Column) -> Column:
    """Remove ``.`` and apply ``..`` over an array of path segments."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        segments, empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))


def resolve_url(base, ref) -> Column:
    """Resolve a reference against a base URL (RFC 3986, section 5.2)."""
    b, r = _c(base), _c(ref)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)?", 1)

    def path_of(p):
        relative = F.split(F.concat(p["dir"], p["ref"]), "/", -1)
        # Empty middle segments vanish from merged paths but not from rooted ones.
        segments = F.when(p["ref"].startswith("/"), F.split(p["ref"], "/", -1)).otherwise(
            let(relative, lambda x: F.filter(x, lambda s, i: (s != "") | (i == 0) | (i == F.size(x) - 1))))
        path = let(segments, lambda x: F.concat(
            F.array_join(_drop_dots(x), "/"),
            F.when(F.element_at(x, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))))
        return let(path, lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)))

    def against(p):
        root = F.concat(scheme, F.lit("//"), netloc(b))
        return F.when(p["ref"] == "", F.concat(
            root, p["base"], F.when(p["query"] != "", p["query"]).otherwise(_part(b, 4)), p["fragment"])) \
            .otherwise(F.concat(root, path_of(p), p["query"], p["fragment"]))

    base_path = _part(b, 3)
    parts = F.struct(
        base_path.alias("base"), _part(r, 3).alias("ref"), _part(r, 4).alias("query"), _part(r, 5).alias("fragment"),
        F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", "")).alias("dir"))
    return (F.when(r == "", b)
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(r.startswith("//"), F.concat(scheme, r))
            .when(r.isNotNull() & b.isNotNull(), let(parts, against)))


def site_url(main_folder, inner_folder, style, base=rules.SITE_BASE_URL) -> Column:
    return F.concat_ws("/", F.lit(base), _c(main_folder), _c(inner_folder), F.lit(style), F.lit("index.html"))


def batch_folder(number) -> Column:
    """Zero-padded to six digits; longer numbers keep all their digits."""
    s = _c(number).cast("string")
    return F.lpad(s, F.greatest(F.lit(6), F.char_length(s)), F.lit("0"))


def folder_source_name(business_name, url) -> Column:
    return or_default(business_name, netloc(url))
