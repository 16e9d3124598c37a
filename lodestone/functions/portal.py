"""Pages of a help-desk portal by projection: folders, article links, attachments and articles, without a parse in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_whitespace, strip_boilerplate

# What the addresses of a portal hold.
ATTACHMENT, ARTICLE, FOLDER, CATEGORY = r"/helpdesk/attachments/(\d+)", r"/support/solutions/articles/(\d+)", r"/support/solutions/folders/(\d+)", r"/support/solutions/(\d+)"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of the first tag, empty where it has none."""
    return F.regexp_extract(tag, rf"""(?is)^<[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1)


def inner_text(tag: Column) -> Column:
    bare = F.regexp_replace(tag, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return collapse_whitespace(bare)


def _first_of_each(rows: Column, key: str) -> Column:
    """Structs of an array, of each key the first."""
    return F.filter(rows, lambda x, i: F.array_position(F.transform(rows, lambda y: y[key]), x[key]) == i + 1)


def _anchors(html: Column, address: str, make) -> Column:
    found = F.filter(_all(html, ANCHOR), lambda a: attribute(a, "href").rlike(address))
    return _first_of_each(F.transform(found, lambda a: make(F.regexp_extract(attribute(a, "href"), address, 1), a)), "id")


def _name(a: Column) -> Column:
    """The title attribute, since the text is shortened or has a count."""
    title = attribute(a, "title")
    return F.when(title != "", collapse_whitespace(title)).otherwise(inner_text(a))


def attachments(html: Column) -> Column:
    """array<struct<id, filename, url>> of a page, each attachment once."""
    return _anchors(html, ATTACHMENT, lambda id_, a: F.struct(id_.alias("id"), _name(a).alias("filename"), attribute(a, "href").alias("url")))


def article_links(html: Column) -> Column:
    """array<struct<id, title, url>>: anchors of the class c-link, and those within div.article-title."""
    titled = F.array_join(_all(html, r"""(?is)<div[^>]*class\s*=\s*["'][^"']*\barticle-title\b[^>]*>.*?</div>"""), "")
    linked = F.array_join(F.filter(_all(html, ANCHOR), lambda a: attribute(a, "class").rlike(r"(^|\s)c-link(\s|$)")), "")
    return _anchors(F.concat(titled, linked), ARTICLE, lambda id_, a: F.struct(id_.alias("id"), inner_text(a).alias("title"), attribute(a, "href").alias("url")))


def folders(html: Column) -> Column:
    """array<struct<id, name, url, category, category_id>> of the list of all folders, each once."""
    sections = F.filter(F.split(html, r"""(?i)(?=<div[^>]*class\s*=\s*["'](?:[^"']*\s)?cs-s[\s"'])"""), lambda s: s.rlike(r"""(?is)^<div[^>]*class\s*=\s*["'](?:[^"']*\s)?cs-s[\s"']"""))

    def of(section: Column) -> Column:
        head = F.regexp_extract(section, r"""(?is)<h3[^>]*class\s*=\s*["'][^"']*heading[^>]*>.*?(<a\s.*?</a>)""", 1)
        category, number = inner_text(head), F.regexp_extract(attribute(head, "href"), CATEGORY, 1)
        make = lambda id_, a: F.struct(id_.alias("id"), _name(a).alias("name"), attribute(a, "href").alias("url"), category.alias("category"), number.alias("category_id"))
        return _anchors(section, FOLDER, make)

    return _first_of_each(F.flatten(F.transform(sections, of)), "id")


def article(html: Column, spans: Sequence[tuple[str, str]] = ()) -> Column:
    """struct<title, body_text, category, folder, folder_id, updated_at, attachments> of an article's page; null where it has no body.  `spans` are notices that all bodies share."""
    body = F.regexp_extract(html, r"""(?is)<(?:article[^>]*class\s*=\s*["'][^"']*\barticle-body\b|\w+[^>]*id\s*=\s*["']article-body["'])[^>]*>(.*?)</(?:article|div|section)>""", 1)
    head = F.regexp_extract(html, r"""(?is)<h2[^>]*class\s*=\s*["'][^"']*\bheading\b[^>]*>(.*?)</h2>""", 1)
    crumbs = _all(F.regexp_extract(html, r"""(?is)<div[^>]*class\s*=\s*["'][^"']*\bbreadcrumb\b[^>]*>(.*?)</div>""", 1), ANCHOR)
    folder = F.get(F.filter(crumbs, lambda a: attribute(a, "href").rlike(FOLDER)), F.lit(0))
    category = F.get(F.filter(crumbs, lambda a: attribute(a, "href").rlike(CATEGORY) & ~attribute(a, "href").rlike(FOLDER)), F.lit(0))
    modified = collapse_whitespace(F.regexp_extract(F.regexp_replace(html, r"(?s)<[^>]*>", "\n"), r"Modified on:\s*([^\n]+)", 1))
    title = inner_text(F.regexp_replace(head, r"(?is)<(a|span)\b.*?</\1>", ""))
    return F.when(body != "", F.struct(
        title.alias("title"), strip_boilerplate(inner_text(body), spans).alias("body_text"), F.coalesce(inner_text(category), F.lit("")).alias("category"), F.coalesce(inner_text(folder), F.lit("")).alias("folder"),
        F.coalesce(F.regexp_extract(attribute(folder, "href"), FOLDER, 1), F.lit("")).alias("folder_id"), F.when(modified != "", modified).alias("updated_at"), attachments(html).alias("attachments"),
    ))
