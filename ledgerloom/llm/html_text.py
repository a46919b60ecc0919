"""Main text of a page by the distribution of text over line blocks.

Markup is stripped to lines: one line per block of text. Elements that are never part of the
article (menus, footers, adverts, forms, comments, ...) leave a stretch of empty lines instead.
Text lengths are summed over a sliding window of lines; a surge point is where the sum rises from
zero, a dive point is where it falls back, and the text between a surge and its dive is a region.
If the page marks its article, only lines inside it have a length. Otherwise regions that reach a
share of the strongest one show where the article is: all lines between the first and the last of
them are kept, and all lines in the element around the container of them, however short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import prepare

WINDOW = 3  # lines of a block
SHARE = 0.2  # of the strongest region, for a strong region of a page without a marked article

# Element names and the words of class, id or role that name them.
_RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "svg", "xmp", "noframes"}
_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_MAIN = {"article", "main"}
_CONTAINERS = {"html", "body", "div", "section", "center", "td"}
_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "menubar", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo",
    "search", "alert", "modal", "overlay",
}
# Inside a marked article only these blocks are left out by a cue, and only if a whole class, id or
# role says so: it names a left-out element and adds words of layout at most.
_BLOCKS = {"div", "section", "aside", "ul", "ol"}
_LAYOUT_WORDS = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "group", "icons", "inner", "items", "left",
    "link", "links", "list", "outer", "panel", "posts", "right", "section", "slot", "top", "unit", "wrap", "wrapper",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S
)
_CUE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_CUE_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

SCHEMA = "page_id long, url string, text string, n_chars long"


def _words(cue: str) -> list[str]:
    return [w.lower() for w in _CUE_WORDS.findall(_CAMEL.sub(" ", cue))]


def _left_out(name: str, attributes: str, by_cue: bool, in_article: bool) -> bool:
    if name in _OUT:
        return True
    if not by_cue or not attributes or name in ("html", "body"):
        return False
    cues = [(m[1].lower(), m[2].strip("\"'")) for m in _CUE.finditer(attributes)]
    if not in_article:
        return any(w in _OUT_WORDS for _, cue in cues for w in _words(cue))
    if name not in _BLOCKS:
        return False
    # The id of a section is an anchor that repeats its heading.
    tokens = [t for kind, cue in cues if kind != "id" or name != "section" for t in cue.split()]
    named = [set(_words(t)) for t in tokens]
    return any(words & _OUT_WORDS and words <= _OUT_WORDS | _LAYOUT_WORDS for words in named)


def lines_of(html: str, by_cue: bool = True) -> list[tuple[str, bool, tuple[int, ...]]]:
    """(text, inside a marked article, containers from the outermost on) per line; left-out elements become empty lines."""
    lines: list[tuple[str, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    open_tags: list[str] = []
    open_at: list[int] = []  # place of each open tag in the page, which tells elements apart
    out_depth = 0  # depth of open_tags at which a left-out element began; 0 if none
    main_depth = 0
    at, size = 0, len(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            path = tuple(i for name, i in zip(open_tags, open_at) if name in _CONTAINERS)
            lines.append((text, bool(main_depth), path))

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            if not out_depth:
                parts.append(html[at:])
            break
        if not out_depth and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in _INLINE and not out_depth:
                flush()
            if name in open_tags and not (out_depth and name == "p" and name not in open_tags[out_depth:]):
                depth = len(open_tags) - open_tags[::-1].index(name)
                # A stray end tag of an inline element does not close the blocks around it.
                if name not in _INLINE or all(t in _INLINE for t in open_tags[depth - 1 :]):
                    del open_tags[depth - 1 :], open_at[depth - 1 :]
            if out_depth > len(open_tags):
                out_depth = 0
                lines += [("", False, ())] * WINDOW
            if main_depth > len(open_tags):
                main_depth = 0
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name not in _INLINE and not out_depth:
            flush()
        if name in _VOID or m[3].endswith("/") and name not in _OUT:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_tags:
            # These close their open predecessor, and with it inline elements left open.
            _close_implied(open_tags, name)
            del open_at[len(open_tags) :]
        open_tags.append(name)
        open_at.append(at)
        if not out_depth and _left_out(name, m[3], by_cue, bool(main_depth)):
            flush()
            out_depth = len(open_tags)
            lines += [("", False, ())] * WINDOW
        elif not main_depth and not out_depth and name in _MAIN:
            main_depth = len(open_tags)
    if not out_depth:
        flush()
    return lines


def _close_implied(open_tags: list[str], name: str) -> None:
    i = len(open_tags)
    while i and (open_tags[i - 1] in _INLINE or open_tags[i - 1] == name):
        i -= 1
        if open_tags[i] == name:
            del open_tags[i:]
            return


def main_text(html: str | None) -> str:
    if not html:
        return ""
    # A cue on a wrapper of the whole page would leave nothing: then only element names count.
    lines = lines_of(html)
    lines = lines if any(text for text, *_ in lines) else lines_of(html, by_cue=False)
    marked = any(inside for text, inside, _ in lines if text)
    sizes = [len(text) if inside or not marked else 0 for text, inside, _ in lines]
    blocks = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    # A surge is the first line of text whose block follows an empty block, a dive the first
    # empty block after it.
    regions, start = [], None
    for i, block in enumerate(blocks + [0]):
        if block and start is None:
            start = i
        elif not block and start is not None:
            regions.append((start, i, sum(sizes[start:i])))
            start = None
    least = 0 if marked else SHARE * max((weight for *_, weight in regions), default=0)
    strong = [(a, b) for a, b, weight in regions if weight >= least]
    if not strong:
        return ""
    first, end = strong[0][0], strong[-1][1]
    # Left-out elements stand inside an article too, so its title and short sections may be regions
    # of their own: they count by their place in the page.
    around = commonprefix([lines[i][2] for a, b in strong for i in range(a, b) if sizes[i]])[:-1]
    return "\n".join(
        text
        for i, (text, _, path) in enumerate(lines)
        if sizes[i] and (first <= i < end or path[: len(around)] == around)
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html).

    NULL or empty html, and pages without text, give the empty text; broken or truncated markup is
    read as far as it goes. Rows of repeated or NULL page_ids are all kept; an empty table gives
    an empty result. Other columns are not read.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
