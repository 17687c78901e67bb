"""URL filter: rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

Everything here is DataFrame expressions.  The filter is a table of 256-bit
blocks; a URL touches one block only, so a probe is one equi-join on the block
number, however large the list.  Possible hits meet the list itself, which
removes the false positives.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_join

#: verdict, host, path; a rule fits its host and all subdomains, paths that start with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS_PER_URL, WORDS, MARKS = 16, 4, 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ``://``; A-Z of the host lower-cased."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, _PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without slashes at its end; no query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else null; of equal length, the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _words(url: Column) -> list[Column]:
    """Per word of the block, the bits of a URL: two of 64 in each of four words."""
    h = F.xxhash64(F.lit("bits"), url)

    def bit(k):
        at = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def blocked_bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """``block, w0..w3``: one row per block in use, by an aggregate with map-side combine."""
    marks = listed.select(_block(F.col(url), blocks).alias("block"),
                          *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col(url)))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_urls(candidates: DataFrame, listed: DataFrame, url: str) -> DataFrame:
    """Those of the distinct ``url`` values that are on the list: filter first, then the exact join."""
    listed = materialize(listed.select(url).where(F.col(url).isNotNull()).distinct(), "listed")
    blocks = max(1, listed.count() * BITS_PER_URL // (64 * WORDS))
    probe = candidates.select(url, _block(F.col(url), blocks).alias("block"),
                              *[w.alias(f"m{i}") for i, w in enumerate(_words(F.col(url)))])
    passes = [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)]
    maybe = probe.join(blocked_bloom(listed, url, blocks), "block")
    for p in passes:
        maybe = maybe.where(p)
    return maybe.select(url).join(listed, url, "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col="page_id", url_col="url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``.

    ``listed`` has canonical URLs in a column ``canonical``.  The rule decides;
    without one, a listed URL is blocked and any other allowed.  A null URL has
    an empty host and path and is allowed.  Equal URLs are looked up once.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    host, path = host_and_path("url")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_verdict"),
                       F.nullif(canonical(F.col("host"), F.col("path")), F.lit("")).alias("canonical"))
    distinct = rows.select("canonical").where("canonical is not null").distinct()
    hits = materialize(listed_urls(distinct, listed, "canonical"), "hits")
    judged = skew_join(rows, hits.withColumn("_hit", F.lit(True)), "canonical", ["page_id"])
    return judged.select("page_id", "host", "path", "rule", F.coalesce(
        "_verdict", F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("_hit", F.lit(False)).alias("listed"))


def listing(pages: DataFrame, words: str, url_col="url") -> DataFrame:
    """Canonical URLs of the pages on hosts that match a pattern, as a list for ``judge_urls``."""
    host, path = host_and_path("url")
    rows = pages.select(pages[url_col].cast("string").alias("url")).select(host.alias("host"), path.alias("path"))
    return rows.where(F.col("host").rlike(words)).select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()
