"""HTML pages: metadata by regular expressions in the JVM; the main content, which needs balanced tags, in a pandas UDF."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from docloom import profiles as P

from .text import format_timestamp, normalize, null_if_empty

# Blocks that never hold content, and classes of navigation.
DROPPED_TAGS = ["script", "style", "noscript", "form", "svg", "footer", "header", "nav", "aside"]
OLD_DROPPED_TAGS = DROPPED_TAGS[:7]
CLOSING_TAGS = r"p|div|li|tr|section|article|h\d"
_NAV_BLOCK = r"""(?is)<div[^>]+class=["'][^"']*(?:nav|menu|breadcrumb|sidebar|top-bar|head-box|footer|header|link|share|print|close)[^"']*["'][^>]*>.*?</div>"""


def meta(page: Column, name: str, tidy: Callable[[Column], Column] = normalize) -> Column:
    """The content of a meta tag, whichever attribute comes first; null without one."""
    q = """["']"""
    first = rf"(?is)<meta[^>]+name={q}{re.escape(name)}{q}[^>]+content={q}(.*?){q}"
    second = rf"(?is)<meta[^>]+content={q}(.*?){q}[^>]+name={q}{re.escape(name)}{q}"
    found = F.when(page.rlike(first), F.regexp_extract(page, first, 1)).when(page.rlike(second), F.regexp_extract(page, second, 1))
    return null_if_empty(tidy(found))


def title_tag(page: Column) -> Column:
    return F.regexp_extract(page, "(?is)<title>(.*?)</title>", 1)


def strip_tags(page: Column, tags: list[str] | None = None, navigation: bool = True, entities_too: bool = True) -> Column:
    """Text of a page: dropped blocks, comments and tags become blanks, breaks and closing block tags become line ends."""
    out = F.regexp_replace(page, rf"(?is)<({'|'.join(tags or DROPPED_TAGS)}).*?>.*?</\1>", " ")
    if navigation:
        out = F.regexp_replace(out, _NAV_BLOCK, " ")
    for pattern, by in ((r"(?is)<!--.*?-->", " "), (r"(?is)<br(?U:\s)*/?>", "\n"), (rf"(?is)</({CLOSING_TAGS})>", "\n"), (r"(?is)<[^>]+>", " ")):
        out = F.regexp_replace(out, pattern, by)
    return normalize(out, entities=entities_too)


def markup_only(title: Column) -> Column:
    """``&lt;``, ``&gt;`` and ``&amp;`` decoded, blanks and tabs run together and cut at the ends; other entities stay as they are."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(title, r"[ \t]+", " "))


def metadata(page: Column, tidy: Callable[[Column], Column] = normalize, title: Callable[[Column], Column] = normalize, cell_text: Callable[[Column], Column] = strip_tags) -> Column:
    """struct<title, pub_date, source>, each from the first of several places that has it; empty if none has.

    ``tidy`` is what becomes of the values found (by default entities are decoded too), ``title`` of the title tag's, ``cell_text`` of table cells.
    """
    cell = lambda name: null_if_empty(cell_text(F.regexp_extract(page, rf"(?is)<th>\s*{name}\s*</th>\s*<td[^>]*>(.*?)</td>", 1)))
    stamp = null_if_empty(F.regexp_extract(page, r"""(?i)class=["']fwrq["'][^>]+value=['"](\d{10,13})['"]""", 1))
    owner = null_if_empty(tidy(F.regexp_extract(page, r"(?i)主办单位[:：]\s*([^<\n]+)", 1)))
    none = F.lit("")
    return F.struct(
        F.coalesce(meta(page, "ArticleTitle", tidy), title(title_tag(page)), none).alias("title"),
        F.coalesce(meta(page, "PubDate", tidy), format_timestamp(stamp), cell("发文日期"), none).alias("pub_date"),
        F.coalesce(meta(page, "ContentSource", tidy), meta(page, "SiteName", tidy), cell("发布机构"), owner, none).alias("source"),
    )


# ------------------------------------------------------------------ main content
_BODY = re.compile(r"(?is)<body[^>]*>(.*?)</body>")
_BLOCK_TAG = re.compile(r"(?is)<(/?)(div|article|section)[^>]*>")
_CLEANERS = [(re.compile(rf"(?is)<({'|'.join(DROPPED_TAGS)}).*?>.*?</\1>"), " "), (re.compile(_NAV_BLOCK), " "), (re.compile(r"(?is)<!--.*?-->"), " "), (re.compile(r"(?is)<br\s*/?>"), "\n"), (re.compile(rf"(?is)</({CLOSING_TAGS})>"), "\n"), (re.compile(r"(?is)<[^>]+>"), " ")]


def plain_text(page: str) -> str:
    """``strip_tags`` for one page inside a worker."""
    for pattern, by in _CLEANERS:
        page = pattern.sub(by, page)
    page = entities.unescape(re.sub(r"\r\n?", "\n", page.replace("\0", " ")))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", page)).strip()


def balanced_blocks(body: str, words: list[str]) -> list[str]:
    """Inner text of every block whose opening tag mentions one of ``words``, in order of opening.

    One pass with a stack for each kind of tag pairs every opening tag with its own closing tag.
    """
    open_tags: dict[str, list[tuple[int, int, str]]] = {"div": [], "article": [], "section": []}
    found: list[tuple[int, str]] = []
    for m in _BLOCK_TAG.finditer(body):
        stack = open_tags[m[2].lower()]
        if not m[1]:
            stack.append((m.start(), m.end(), m[0].lower()))
        elif stack and m[0].lower().rstrip(">").rstrip() == "</" + m[2].lower():
            start, inner, tag = stack.pop()
            if any(w.lower() in tag for w in words):
                found.append((start, body[inner : m.start()]))
    return [text for _, text in sorted(found)]


def select_content(page: str) -> str:
    """The longest content block of over 40 characters; else a general block of 200 or more; else the whole body."""
    m = _BODY.search(page)
    body = m[1] if m else page
    for words, least in ((P.CONTENT_WORDS, 0), (P.CONTENT_FALLBACK_WORDS, 200)):
        texts = [t for t in map(plain_text, balanced_blocks(body, words)) if len(t) > 40 and len(t) >= least]
        if texts:
            return max(texts, key=len)
    return plain_text(body)


@pandas_udf(StringType())
def main_content(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: select_content(p) if isinstance(p, str) else p)


def page_text(page: Column) -> Column:
    """Title, date and source on lines of their own, an empty line, and the main content."""
    m = metadata(page)
    head = F.array_join(F.filter(F.array(m["title"], m["pub_date"], m["source"]), lambda x: x != ""), "\n")
    body = F.coalesce(main_content(page), F.lit(""))
    return F.array_join(F.filter(F.array(head, body), lambda x: x != ""), "\n\n")


# ------------------------------------------------------------------ the validation report's simpler selection
# Blocks that the report looks into.
_PREFERRED = [r"""(?is)<div[^>]+class=["'][^"']*(?:detail-news|article-content|TRS_Editor|Custom_UnionStyle)[^"']*["'][^>]*>(.*?)</div>""", r"(?is)<article[^>]*>(.*?)</article>"]
_GENERAL = [
    r"""(?is)<div[^>]+(?:id|class)=["'][^"']*(?:content|article|main|detail|正文|TRS_Editor|Custom_UnionStyle)[^"']*["'][^>]*>(.*?)</div>""",
    r"""(?is)<section[^>]+(?:id|class)=["'][^"']*(?:content|article|main|detail)[^"']*["'][^>]*>(.*?)</section>""",
]


def strip_tags_simply(page: Column) -> Column:
    """Without navigation classes and entities: what clause markers of raw pages are counted in."""
    return strip_tags(page, OLD_DROPPED_TAGS, navigation=False, entities_too=False)


def select_simply(page: Column) -> Column:
    """The longest preferred block of over 40 characters, else general block of over 200, else the body; blocks end at the first closing tag."""
    body = F.coalesce(null_if_empty(F.regexp_extract(page, "(?is)<body[^>]*>(.*?)</body>", 1)), page)

    def longest(patterns: list[str], least: int) -> Column:
        blocks = F.concat(*[F.regexp_extract_all(body, F.lit(p), 1) for p in patterns])
        texts = F.filter(F.transform(blocks, lambda b: strip_tags_simply(b)), lambda t: F.length(t) > least)
        return F.aggregate(texts, F.lit(None).cast("string"), lambda a, t: F.when(a.isNull() | (F.length(t) > F.length(a)), t).otherwise(a))

    return F.coalesce(longest(_PREFERRED, 40), longest(_GENERAL, 200), strip_tags_simply(body))
