"""Main text of web pages by the distribution of text over line blocks.

A page becomes a list of lines: one per block element, with its text stripped of markup. Sums of the
lines' text lengths outside links over a sliding window rise sharply where the article starts (surge) and fall to
nothing where it ends (dive); text between a surge and the next dive is kept, with single links and short lines in
it and short lines directly before it. Lines in parts that the markup names as menus, headers, footers,
sidebars, notices, adverts, forms or comments are left out first, unless a class word names what holds the bulk of
the page. Markup of an article is a weight: lines in it count MARKED times, and lines outside
are left out unless they have more than MARKED times its text.
"""

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
                   r"""<(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Content that is no text, up to the closing tag.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "canvas",
       "audio", "video", "head", "title", "noframes", "noembed", "xmp", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "img", "input", "nobr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog",
         "menu", "menubar", "toolbar", "status"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored",
         "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer",
         "masthead", "topbar", "sidebar", "aside", "related", "recommended", "widget", "notice", "cookie", "cookies",
         "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing", "social",
         "comment", "comments", "disqus", "reply", "replies", "pagination", "pager", "login", "copyright", "legal",
         "disclaimer", "toolbar", "alert"}
#: Words that name topics as well: in a class of several words they count only beside words that name parts of a page.
TOPICS = {"legal", "social", "copyright", "promotion", "promo", "login", "alert"}
PARTS = {"links", "link", "icons", "bar", "buttons", "button", "box", "media", "text", "info", "list", "wrapper", "container", "block", "section",
         "area", "message", "site", "page", "main", "top", "bottom"}
ARTICLE = {"article", "main"}
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
TARGET = re.compile(r"(?:^|[\s\"'])(?:name|id)\s*=", re.I)  # without an address: a place that links lead to
WINDOW, SURGE, MARKED = 3, 86, 4
#: Elements that are closed implicitly as often as not.
LOOSE = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
#: Content of RAW elements in which tags are plain characters.
PLAIN = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}


def _names_boilerplate(token: str) -> bool:
    """Whether one class or id says so by a word of WORDS."""
    words = {w for w in re.split(r"[^a-z]+", token) if w}
    return bool(WORDS & words - TOPICS) or bool(WORDS & words) and words <= WORDS | PARTS


def _named_boilerplate(name: str, rest: str) -> int:
    """2 for parts whose element, role or style says so, 1 for class words, else 0."""
    named = 0
    if name in BOILERPLATE:
        return 2
    if name in ARTICLE or name in ("html", "body") or not rest:
        return 0
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if key in ("class", "id") and any(map(_names_boilerplate, value.split())):
            named = 1
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return named


def _raw_end(page: str, at: int, name: str, parent: str | None) -> int:
    """Where the content of a RAW element ends: after its closing tag, or where its parent ends if that comes first."""
    close = re.compile(rf"</{re.escape(name)}\s*(?:[^>]*)>", re.I).search(page, at)
    if close and (name in PLAIN or parent is None):
        return close.end()
    depth = 0
    if parent:
        for m in re.compile(rf"<(/?){re.escape(parent)}(?=[\s/>])", re.I).finditer(page, at, close.start() if close else len(page)):
            depth += -1 if m[1] else 1
            if depth < 0 or parent in LOOSE:
                return m.start()
    return close.end() if close else len(page)


def _settled(found: list[tuple[str, bool, tuple, int, int]]) -> list[tuple[str, bool, int, int]]:
    """Blocks with class words believed, but for parts with more than half of the text and no article beside them."""
    sizes, articles = {}, {}
    total = sum(n for _, b, _, _, n in found if not b)
    in_article = sum(a > 0 and not b for _, b, _, a, _ in found)
    for _, b, parts, a, n in found:
        for part in parts:
            sizes[part] = sizes.get(part, 0) + (0 if b else n)
            articles[part] = articles.get(part, 0) + (a > 0 and not b)
    believed = {k for k, n in sizes.items() if 2 * n <= total or articles[k] < in_article}
    return [(text, b or not believed.isdisjoint(parts), a, n) for text, b, parts, a, n in found]


def line_blocks(page: str) -> list[tuple[str, bool, int, int]]:
    """(text, in boilerplate, number of the outermost article or 0, characters outside links) of every block of text, in page order."""
    out: list[tuple[str, bool, tuple, int, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements that matter: name, boilerplate, article, part by class words
    boiler = article = at = linked = parts = articles = 0
    in_link, closed, loose = False, True, None  # a link without its end goes no further than its block

    def end_block():
        nonlocal linked, in_link
        in_link = in_link and closed
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, boiler > 0, tuple(x[3] for x in stack if x[3]), articles if article else 0, max(0, len(text) - linked)))
        linked = 0

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at:m.start()])
        linked += m.start() - at if in_link else 0
        at = m.end()
        if m["cdata"] is not None:
            held.append(html.escape(m["cdata"], quote=False))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "a":
            in_link = not m["close"] and bool(HREF.search(m["rest"]) or not TARGET.search(m["rest"]))
            after = ANCHOR.search(page, at) if in_link else None
            closed = bool(after and after[1])
        if m["close"]:
            loose = None if name not in INLINE else loose
            if name not in INLINE or any(x[0] == name for x in stack):
                end_block() if name not in INLINE else None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        for _, b, a, _ in stack[k:]:
                            boiler, article = boiler - b, article - a
                        del stack[k:]
                        break
            continue
        if name in RAW:
            if name in ("svg", "math") and m["rest"].endswith("/"):
                continue
            if name not in ("button", "svg", "math", "select", "textarea", "title"):
                end_block()
            if name == "head" and not re.compile(r"</head\s*[^>]*>", re.I).search(page, at):
                continue
            at = _raw_end(page, at, name, loose or (stack[-1][0] if stack else None))
            continue
        if name not in INLINE:
            end_block()
        if name in VOID or m["rest"].endswith("/"):
            continue
        b = _named_boilerplate(name, m["rest"])
        a = name in ARTICLE or not b and bool(re.search(r"""role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articleBody""", m["rest"], re.I))
        if name in INLINE and not b:
            continue
        if name in LOOSE and not b and not a:
            loose = name
            continue  # of no consequence
        loose = None
        if b and name in INLINE:
            end_block()
        parts += b == 1
        stack.append((name, b == 2, a, parts if b == 1 else 0))
        articles += a and not article
        boiler, article = boiler + (b == 2), article + a
    end_block()
    return _settled(out)


def dense_spans(lengths: list[int], window: int = WINDOW, surge: int = 1) -> list[tuple[int, int]]:
    """Line ranges between surges and dives of the sums of `lengths` over `window` lines.

    A surge is a line with text whose window sums to `surge` or more; the dive is the next line whose
    whole window has no text.
    """
    running = [0]
    for n in lengths:
        running.append(running[-1] + n)
    spans, start = [], None
    for k, n in enumerate(lengths):
        total = running[min(k + window, len(lengths))] - running[k]
        if start is None and n > 0 and total >= surge:
            start = k
        elif start is not None and total == 0:
            spans.append((start, k))
            start = None
    return spans + ([(start, len(lengths))] if start is not None else [])


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surges and dives, and lines with text directly before. Links weigh nothing; a surge needs
    `surge` characters in a window, or a quarter of the densest window if that is less."""
    blocks = [(t, a, free) for t, b, a, free in line_blocks(page or "") if not b]
    inside = sum(free for _, a, free in blocks if a)
    if any(a for _, a, _ in blocks) and (1 + MARKED) * inside >= sum(free for _, _, free in blocks):
        blocks = [(t, a, free) for t, a, free in blocks if a]
    if not any(free for _, _, free in blocks):
        blocks = [(t, a, len(t)) for t, a, _ in blocks]  # links alone
    sizes = [free for _, _, free in blocks]
    weights = [free * (MARKED if a else 1) for _, a, free in blocks]
    densest = max((sum(sizes[k:k + window]) for k in range(len(sizes))), default=0)
    kept, last = [], 0
    for start, end in dense_spans(weights, window, max(1, min(surge, densest // 4))):
        while start > last and weights[start - 1]:
            start -= 1
        if last and blocks[last - 1][1] and blocks[last - 1][1] == blocks[start][1]:
            start = last  # a dive between two surges of one article is no end
        kept += [t for t, _, _ in blocks[start:end]]
        last = end
    return " ".join(kept)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", window: int = WINDOW) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of `pages`; null and empty pages have empty texts.

    Repeated rows are extracted each; other columns are ignored.
    """
    def work(columns):
        texts = [main_text(x, window) for x in columns[2]]
        return [columns[0], columns[1], texts, list(map(len, texts))]

    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id, url))
    named = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return map_rows(named, ["page_id", "url", "html"], f"page_id {kind}, url {url_kind}, text string, n_chars long", work)
