"""URL rules with redirect equivalence.

Every url gets the verdict of the longest rule that fits its host (or a parent domain) and path.
Urls without a rule take part through aliases: redirects (meta refresh, or a given table of
redirects) and canonical links are edges between url keys; distributed connected components over
these edges carry a block decision to all aliases. An explicit allow has precedence: a page with an allow rule is never
blocked by its aliases, and a component with an allowed member passes no block on.

A url's key is its lower-case host without a leading ``www.``, its path without a closing slash, and its query
without tracking parameters; scheme and fragment do not count. Urls with one key are one node, with or without links.

All links of a page count; relative ones are resolved against its url or its ``<base href>``, and ``&amp;`` in them is decoded.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is
allowed; null html has no links; links to other schemes or to a place in the page itself are none; very long urls and pages are whole;
repeated rows each give a row; an empty table gives an empty table; other columns are ignored. Rules of equal
length: the one listed first wins.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` block or allow, for ``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def url_key(url: Column) -> Column:
    """Null where the url has no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)") & (p != "")), "&")
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct<verdict, rule>; null if none fits."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        own = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))
        out = F.when(fits, own) if out is None else out.when(fits, own)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def resolve(url: str, stated: str, href: str) -> str | None:
    """``href`` as an absolute url, seen from ``url`` or from the base that the page states; null if it names no other page."""
    try:
        out = urljoin(urljoin(url, html.unescape(stated)) if stated else url, html.unescape(href))
    except ValueError:  # no url
        return None
    return out if "://" in out and not href.startswith("#") else None


_HREF = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
_CANONICAL = r"""\brel\s*=\s*["']?canonical\b"""


def page_links(pages: DataFrame) -> DataFrame:
    """``src, dst`` urls of all canonical links and meta refreshes found in ``html``."""
    page = F.col("html")
    links = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda tag: tag.rlike("(?i)" + _CANONICAL))
    canonical = F.transform(links, lambda tag: F.regexp_extract(tag, "(?i)" + _HREF, 1))
    metas = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda tag: tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    refresh = F.transform(metas, lambda tag: F.regexp_extract(tag, r"""(?i)\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*["']?([^"'\s>]+)""", 1))
    found = F.array_distinct(F.filter(F.concat(canonical, refresh), lambda x: x != ""))
    rows = pages.where(page.rlike("(?i)canonical|refresh") & F.col("url").contains("://")).select("url", F.regexp_extract(page, r"(?is)<base\b[^>]*?" + _HREF, 1).alias("stated"), F.explode(found).alias("href"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0)
            seen = pa.array(map(resolve, *(c.to_pylist() for c in batch.columns)), pa.string())
            yield pa.RecordBatch.from_arrays([urls.cast(pa.string()), seen], ["src", "dst"])

    return rows.mapInArrow(run, "src string, dst string").where("dst is not null")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages`` (``page_id, url, html``).

    ``redirects`` is an optional table of further ``src, dst`` urls. ``component`` is the least url key
    of the page's aliases, null without any.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    components = connected_components(links.select(url_key(F.col("src")).alias("u"), url_key(F.col("dst")).alias("v")))

    host, path = host_and_path(F.coalesce("url", F.lit("")))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), url_key(F.coalesce("url", F.lit(""))).alias("key")).withColumn("own", match_rule(F.col("host"), F.col("path"), rules))

    # Decisions on nodes come from pages and from the ends of links, which need not be pages.
    ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
    end_host, end_path = host_and_path(F.col("url"))
    decided = own.where("own is not null").select("key", F.col("own.verdict").alias("verdict")).unionByName(ends.select(url_key(F.col("url")).alias("key"), match_rule(end_host, end_path, rules)["verdict"].alias("verdict")).where("verdict is not null"))
    decided = decided.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    nodes = components.select(F.col("node").alias("key"), "component")
    # a key without a link is a component of its own: all urls with this key share its decision
    mine = F.coalesce("component", "key")
    spread = decided.join(nodes, "key", "left").groupBy(mine.alias("group")).agg(F.max("block").alias("block"), F.max("allow").alias("allow")).where("block and not allow").select("group", F.lit(True).alias("blocked"))
    out = own.join(nodes, "key", "left").withColumn("group", mine).join(spread, "group", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
