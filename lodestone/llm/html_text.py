"""Main text of HTML pages by composite text density.

The page is parsed to a tree; elements that are never an article's text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are taken out by element, role and class.  A class or id
counts by whole words of it, alone or with words that go with them (site-footer,
not no-sidebar), and not where the element holds most of the page's unlinked
text, unless an article or main that neither holds it nor lies in it has text.
For every node
that is left the characters for each tag are computed and adjusted for links;
the sum of its children's densities says how much text hangs together below a
node.  The container of the largest sum is the core.  The outermost article
around it, or else the main element, stays whole but for what was taken out;
without either the core does.  On the way from there up to the body, what
stands beside stays unless it is mostly links, however short it is: headlines,
lead paragraphs, lists, further sections.  Outside of an article or main that
holds the core, other things than articles and headlines stay only if they are
also at least as dense as the thinnest node between the core and the body.  A
mostly linked section or div beside the way is looked through for parts that
are not.  Headings stay even if they are links.

Blocks are joined in page order by a blank line, white space within a block
becomes one space, character references are decoded; nothing else is dropped
or capped.  Every step is a loop over nodes in page order, so neither depth
nor length of a page costs more than its size.

Defined results for odd input: null or empty html, and pages without text,
give the empty text.  A page without a body is its own body.  Of equal sums
the first node in the page is the core.  An unfinished tag at the end is no
text, and neither are marked sections and declarations, however malformed.  Repeated rows get equal results.  Extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center details div html main section table tbody td tr ul ol dl".split())
DROPPED = frozenset(
    "script style noscript template nav aside footer form button input select textarea label fieldset iframe object embed applet canvas svg audio video map dialog menu head title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus replies"
    " respond pagination pager toolbar widget skip banner".split()
)
ARTICLE_WORDS = frozenset("comment comments ad advert advertisement sponsored promo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HEADED = HEADINGS | {"article", "main"}
TEXTUAL = frozenset("p blockquote pre".split())
SECTIONS = frozenset("article center details div main section".split())
#: Words that may stand beside a dropped one in a class or id: site-footer, post-comments, ad-slot.  Any other word there makes it another name: no-sidebar, share-price.
AFFIXES = frozenset(
    "site page main global primary secondary top bottom left right middle side header head foot mobile desktop sticky fixed small large dark light inner outer wrapper wrap container"
    " section area block box bar panel list items item links link buttons button icons icon group row slot unit zone title form thread post posts article articles entry blog user"
    " reader message policy text js wp id trail bottombar leaderboard google gpt media menu menus".split()
)
#: An open element of the key ends where one of these opens.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "option", "optgroup"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "head": frozenset({"body"}),
}
#: Ends in these do not reach elements outside of them.
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
SEPARATORS = re.compile(r"[^a-z]+")
BLANKS = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page(HTMLParser):
    """Nodes in page order: tag, parent, attributes; and the texts with their nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs = [""], [-1], [{}]
        self.items: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a node begins or ends
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        open_, tags = self.open, self.tags
        for at in range(len(open_) - 1, 0, -1):
            up = tags[open_[at]]
            if tag in CLOSED_BY.get(up, ()):
                self._close(at)
                break
            if up in SCOPE and up not in CLOSED_BY:
                break
        node = len(tags)
        tags.append(tag)
        self.parents.append(open_[-1])
        self.attrs.append({k: v or "" for k, v in reversed(attrs) if k in ("class", "id", "role", "hidden", "style", "aria-hidden")})
        self.items.append((node, None))
        if tag not in VOID:
            open_.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        open_, tags = self.open, self.tags
        for at in range(len(open_) - 1, 0, -1):
            up = tags[open_[at]]
            if up == tag:
                self._close(at)
                return
            if up in SCOPE and tag not in SCOPE:
                return

    def parse_marked_section(self, i, report=1):
        """As browsers read it: what begins with <![ is a comment up to the next >."""
        return self.rawdata.find(">", i) + 1 or -1

    def _close(self, at: int) -> None:
        for node in reversed(self.open[at:]):
            self.items.append((node, None))
        del self.open[at:]

    def handle_data(self, data):
        self.items.append((self.open[-1], data))


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return tag != "article" and attrs.get("role", "").lower() in DROPPED_ROLES


def _named(tag: str, attrs: dict[str, str]) -> bool:
    """A class or id says that this is no article's text."""
    if not attrs or tag in ("html", "body", "main"):
        return False
    dropped = ARTICLE_WORDS if tag == "article" else DROPPED_WORDS
    for token in " ".join((attrs.get("class", ""), attrs.get("id", ""))).lower().split():
        words = {w for w in SEPARATORS.split(token) if w}
        if words & dropped and words <= DROPPED_WORDS | AFFIXES:
            return True
    return False


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(UNFINISHED.sub("", html))
    page.close()
    tags, parents = page.tags, page.parents
    n = len(tags)
    body = next((i for i in range(n) if tags[i] == "body"), 0)

    named = [_named(tags[i], page.attrs[i]) for i in range(n)]
    if any(named):
        # an element that holds most of the unlinked text is not dropped by its name, unless an article or main elsewhere has text
        hard, link, plain, last = [False] * n, [False] * n, [0] * n, list(range(n))
        for i in range(1, n):
            hard[i] = hard[parents[i]] or _dropped(tags[i], page.attrs[i])
            link[i] = link[parents[i]] or tags[i] == "a"
        for node, text in page.items:
            if text is not None and not hard[node] and not link[node]:
                plain[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[parents[i]] += plain[i]
            last[parents[i]] = max(last[parents[i]], last[i])
        texts = [i for i in range(n) if tags[i] in ("article", "main") and not named[i] and plain[i]]
        for i in range(n):
            if named[i] and 2 * plain[i] > plain[0] and all(k <= i <= last[k] or i < k <= last[i] for k in texts):
                named[i] = False

    holds = [False] * n  # an article or the main element lies below
    for i in range(n - 1, 0, -1):
        holds[parents[i]] = holds[parents[i]] or holds[i] or (tags[i] in ("article", "main") and not named[i] and not _dropped(tags[i], page.attrs[i]))
    gone, in_link, in_article = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = parents[i], tags[i]
        in_link[i] = in_link[up] or tag == "a"
        in_article[i] = in_article[up] or tag in ("article", "main")
        own = (named[i] or _dropped(tag, page.attrs[i])) and not (holds[i] and tag not in DROPPED)
        if tag == "header":  # an article's own header has its headline
            own = not in_article[up]
        gone[i] = gone[up] or own

    chars, marks, link_chars, link_marks = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.items:
        if text is not None and not gone[node]:
            k = len("".join(text.split()))
            chars[node] += k
            if in_link[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            up = parents[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            marks[up] += marks[i] + 1
            link_marks[up] += link_marks[i] + (tags[i] == "a")
    if not chars[body]:
        body = 0
    share = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(1, marks[i]), link_chars[i], link_marks[i]
        base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
        density[i] = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / max(0.1, math.log(base) if base > 1 else 0.1)
        if i:
            sums[parents[i]] += density[i]

    below = [False] * n  # of the body
    below[body] = True
    for i in range(1, n):
        below[i] = below[i] or below[parents[i]]
    core = max((i for i in range(n) if below[i] and not gone[i] and (i == body or tags[i] in CONTAINER)), key=lambda i: (sums[i] or density[i] * (i == body), -i))
    path, at = set(), core
    while True:
        path.add(at)
        if at == body:
            break
        at = parents[at]
    threshold = min((density[i] for i in path), default=0.0)
    # page order: the outermost is the first
    root = next((i for i in sorted(path) if tags[i] == "article"), next((i for i in sorted(path) if tags[i] == "main"), core))
    marked = next((i for i in sorted(path) if tags[i] in ("article", "main")), body)
    path, at = set(), root
    while True:
        path.add(at)
        if at == body:
            break
        at = parents[at]
    stays, inside, looked = [False] * n, [False] * n, [False] * n
    for i in range(n):
        if gone[i] or not below[i]:
            continue
        up, tag = parents[i], tags[i]
        inside[i] = i == marked or inside[up]
        if i in path:
            stays[i] = i == root
            looked[i] = i != root
        elif stays[up]:
            stays[i] = True
        elif looked[up] and chars[i]:
            wanted = inside[i] or tag in HEADED or density[i] >= threshold
            linked = 2 * link_chars[i] > chars[i]
            if linked and tag in TEXTUAL:
                linked = link_chars[i] == chars[i]
            if up in path and tag in HEADINGS:
                linked = False
            stays[i] = wanted and not linked
            looked[i] = linked and tag in SECTIONS

    # text that stands in the path itself, beside its elements, is the page's too
    blocks: list[list[str]] = [[]]
    for node, text in page.items:
        if text is None:
            if tags[node] in BLOCK:
                blocks.append([])
            elif tags[node] == "br":
                blocks[-1].append(" ")
        elif stays[node] or (node in path and not gone[node]):
            blocks[-1].append(text)
    joined = (BLANKS.sub(" ", "".join(b)).strip() for b in blocks if b)
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: a map without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
