"""Text of pages and articles: column functions that stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.4
STUB_CHARS = 200


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_ends(text: Column) -> Column:
    """Without white space at either end, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_boilerplate(text: Column, spans: Sequence[tuple[str, str]]) -> Column:
    """Without the first span from each start marker to the end marker after it, both included; then collapsed."""
    for start, end in spans:
        s = F.instr(text, start)
        rest = F.substr(text, s + len(start))
        e = F.instr(rest, end)
        cut = F.concat(F.substr(text, F.lit(1), s - 1), F.substr(rest, e + len(end)))
        text = F.when((s > 0) & (e > 0), cut).otherwise(text)
    return collapse_whitespace(text)


def absolute_url(path: Column, base: str) -> Column:
    return F.when(path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def is_stub(body: Column, n_attachments: Column) -> Column:
    return (F.length(strip_ends(body)) < STUB_CHARS) & (n_attachments > 0)


def content_stream(body: Column, n_attachments: Column) -> Column:
    return F.when(is_stub(body, n_attachments), "pdf").otherwise("diagnostic_article")


def article_markdown(title: Column, body: Column) -> Column:
    """Bullets that begin a line as list items, at most one blank line in a row, the title as a heading."""
    body = F.regexp_replace(strip_ends(body), r"(?m)^\s*[•▪◦·]\s*", "- ")
    body = F.regexp_replace(body, r"\n{3,}", "\n\n")
    return strip_ends(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def estimate_tokens(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int") + 1)).cast("int")


def truncate_tokens(text: Column, most: int) -> Column:
    return F.substring(text, 1, int(most * CHARS_PER_TOKEN))


def breadcrumb(category: Column, folder: Column, title: Column, label: Column) -> Column:
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" > ", full(category), full(folder), full(title), F.when(label != "", F.concat(F.lit("p."), label)))


def chunk_id(doc: Column, page_index: Column, ordinal: Column) -> Column:
    return F.concat(doc, F.lit(":"), F.coalesce(F.concat(F.lit("p"), page_index.cast("string")), F.lit("pna")), F.lit(":c"), F.format_string("%02d", ordinal))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def text_key(text: Column) -> Column:
    return collapse_whitespace(F.lower(text))


def source_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def first_line(text: Column) -> Column:
    return F.split(text, "\n")[0]


# -- HTML by projection

def html_title(html: Column) -> Column:
    return collapse_whitespace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), 1)


def html_visible(html: Column) -> Column:
    """Text outside of scripts, styles, comments and tags, with the five basic references decoded."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return collapse_whitespace(bare)


# -- bytes

# First bytes of file formats.
MAGIC = (
    ("25504446", ".pdf"), ("89504E470D0A1A0A", ".png"), ("FFD8FF", ".jpg"), ("47494638", ".gif"), ("52494646", ".webp"),
    ("49492A00", ".tif"), ("4D4D002A", ".tif"), ("504B0304", ".zip"), ("D0CF11E0", ".doc"),
)


def detect_suffix(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for magic, suffix in reversed(MAGIC):
        out = F.when(head.startswith(magic), suffix).otherwise(out)
    return out


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "25504446"


def looks_like_html(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"^[\x20\x09-\x0D]*(<!DOCTYPE|<!doctype|<html|<HTML|<\?xml)")


# -- page labels and tiers

# How footers print a page number, most telling first.
FOOTER_PATTERNS = (r"(?i)\bpage\s+(\d{1,4})\s+of\s+\d{1,4}\b", r"(?i)\bpage\s+(\d{1,4})\b", r"^\s*[-\u2013\u2014]\s*(\d{1,4})\s*[-\u2013\u2014]\s*$", r"^\s*(\d{1,4})\s*$")
EDGE_LINES = 3
LARGEST_LABEL = 2000


def page_tier(chars: Column, images: Column) -> Column:
    return F.when(chars <= 100, "scanned").when((chars < 600) & (images >= 1), "diagram_heavy").otherwise("plain_text")


def label_from_text(text: Column) -> Column:
    """Page number of the last three, then first three, non-blank lines, pattern by pattern."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip_ends), lambda x: x != "")
    n = F.size(lines)
    tail = F.slice(lines, F.greatest(F.lit(1), n - (EDGE_LINES - 1)), EDGE_LINES)
    edges = F.when(n == 0, lines).otherwise(F.concat(tail, F.slice(lines, 1, EDGE_LINES)))

    def found(pattern: str) -> Column:
        numbers = F.transform(edges, lambda x: F.regexp_extract(x, pattern, 1).try_cast("int"))
        return F.get(F.filter(numbers, lambda x: x.between(1, LARGEST_LABEL)), F.lit(0))

    return F.coalesce(*[found(p) for p in FOOTER_PATTERNS]).cast("string")


def resolve_label(text: Column, page_index: Column, embedded: Column) -> Column:
    """struct(label, source): the file's own label, else the text's, else the position."""
    own, read = F.nullif(embedded, F.lit("")), label_from_text(text)
    label = F.coalesce(own, read, (page_index + 1).cast("string"))
    source = F.when(own.isNotNull(), "embedded").when(read.isNotNull(), "text").otherwise("index")
    return F.struct(label.alias("label"), source.alias("source"))


def has_table_signal(text: Column) -> Column:
    gaps = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S {2,}\S")))
    return text.rlike(r"(?i)\b(?:[EFH][\s:.\-]?\d{1,2}|FC\s?\d{1,2}|fault\s+code|error\s+code)\b") | (gaps >= 3)


def looks_like_header(row: Column) -> Column:
    """Some cell has text and none is a number."""
    number = lambda c: F.replace(F.trim(c), F.lit("."), F.lit("")).rlike(r"^[0-9]+$") & (F.regexp_count(c, F.lit(r"\.")) <= 1)
    return F.exists(row, lambda c: F.trim(c) != "") & ~F.exists(row, number)
