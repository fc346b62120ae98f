"""Operator 4, main text of web pages by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags). Blocks of one root-to-block tag path are taken together: text
length and punctuation for each block of the path are its two ratios. Both are smoothed over the blocks in page order, fused by
their product, and the paths over a threshold (a share of the page's weighted mean) are content. The content's nodes are the smallest
element that holds nearly all of their score, or all marked articles where only the whole page does: what it holds beside them
(titles, short paragraphs, lists) belongs to it; blocks elsewhere belong to the text if their own path is over the threshold.

Elements whose tag or role is a menu, footer, sidebar, dialog or script never count. A form, and an element whose id or class names
such a part, doesn't count either, unless
  it has a name of the page's layout and holds nearly all text of the page (a wrapper), prose for the most part, and its articles;
  only its id names it, with a word that may be a topic too, it is inside a marked article, and its paths are over the threshold in
  spite of a penalty;
  a marked article within holds half of the page's text; or nothing else is left of the page and it is prose.
Names after has, with or no ("has-sidebar") and headers of an article or entry name nothing.

Edge cases: null and empty html give empty text; unclosed and stray tags are repaired as browsers do it for paragraphs, list items
and table cells; an unclosed script, style or text area reaches to the end of the page; text without any tag is one block; a page of
any length or depth is one row, in linear time; ties take the earlier element; repeated rows give repeated results; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship, whole, with_long

#: Share of the score that the article holds; threshold as a share of the mean; blocks on each side that smooth a block.
HOLDS, THRESHOLD, REACH = 0.9, 0.3, 1
#: What is left of the score of a named part; length from which a block with a mark is prose whatever its element.
PENALTY, PROSE = 0.5, 60
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAMED = frozenset(("class", "id", "role", "aria-label"))
#: Elements whose content is raw text up to their end; other elements whose text is never read.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_UNREAD = frozenset("noscript template object svg math canvas audio video select".split())
#: Unread elements that end where a block begins.
_BREAKABLE = frozenset(("svg", "math", "select"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NOISE_TAGS = frozenset("nav footer aside button dialog menu menuitem fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of the page's layout, which wrappers have too; names of other parts.
_LAYOUT = frozenset(
    "nav navbar navigation menu submenu topbar breadcrumb breadcrumbs sidebar side rail aside footer foot header masthead banner toolbar search widget modal overlay popup login signup skip".split()
)
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification newsletter subscribe subscription share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond discussion pagination pager copyright legal".split()
)
#: Names that may be topics of an article's sections, if they stand in an id.
_TOPICS = frozenset("related recommended recommendations discussion side legal copyright search navigation advertising".split())
_NEGATES = frozenset("has with without no not".split())
_TITLED = frozenset("article entry post content story title page section".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_MARKED = frozenset(("article", "main"))
#: Elements whose names say nothing; elements that an article is more than; elements of prose.
_UNNAMED = frozenset("body html h1 h2 h3 h4 h5 h6".split())
_SMALL = frozenset("p li td th tr tbody blockquote pre h1 h2 h3 dd dt ul ol dl table section".split())
_PROSE_TAGS = frozenset("p h1 h2 h3 blockquote pre".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _names(value: str) -> set[str]:
    """Words of a class or id that name a part of a page."""
    out: set[str] = set()
    for token in _CAMEL.sub(r"\1-\2", value).lower().split():
        words = {w for w in _SPLIT.split(token) if w}
        if words & _NEGATES:
            continue
        if words & _TITLED:
            words.discard("header")
        out |= words & (_LAYOUT | _PARTS)
    return out


class Page:
    """Elements in the order in which they begin, as columns, and the blocks (element, text) that may be content."""

    def __init__(self, page: str):
        self.parent, self.name, self.depth, self.path = [-1], ["#"], [0], [0]
        #: Never read; inside a marked article; names of parts; whether they may be a topic.
        self.noise, self.inside, self.parts, self.topic = [False], [False], [frozenset()], [False]
        self.blocks: list[tuple[int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _begin(self, name: str, attrs: str, above: int) -> int:
        inside = self.inside[above] or self.name[above] in _MARKED
        noise, label, parts, ids = name in _NOISE_TAGS or name == "header" and not inside, name, set(), set()
        if "=" in attrs and not noise:
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key not in _NAMED:
                    continue
                if key == "class":
                    label += "." + value.strip()
                if key == "role" and set(_SPLIT.split(value.lower())) & _NOISE_ROLES:
                    noise = True
                elif name not in _UNNAMED and key == "id":
                    ids |= _names(value)
                elif name not in _UNNAMED:
                    parts |= _names(value)
        if name == "form":
            parts.add("form")
        self.topic.append(not parts and ids <= _TOPICS)
        parts |= ids
        self.parent.append(above)
        self.name.append(name)
        self.depth.append(self.depth[above] + 1)
        self.path.append(self._paths.setdefault((self.path[above], label), len(self._paths) + 1))
        self.noise.append(noise or self.noise[above])
        self.inside.append(inside)
        self.parts.append(frozenset(parts))
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack, open_, text, at, end, last = [0], {}, [], 0, len(page), page.rfind(">")
        holder, unread = 0, []

        def flush() -> None:
            if text:
                joined = "".join(text)
                text.clear()
                if not self.noise[holder] and (clean := " ".join((html.unescape(joined) if "&" in joined else joined).split())):
                    self.blocks.append((holder, clean))

        def cut(to: int) -> None:
            while len(stack) > to:
                open_[self.name[stack.pop()]].pop()

        def place(names) -> int:
            return max((open_[n][-1] for n in names if open_.get(n)), default=-1)

        while at < end:
            m = _TAG.search(page, at) if at <= last else None
            start = m.start() if m else end
            if not unread and start > at:
                text.append(page[at:start])
            if m is None:
                break
            at = m.end()
            name = (m["name"] or m["odd"] or "").lower()
            if not name:
                continue
            closing, attrs = m["close"] == "/" or page.startswith("</", start), m["attrs"] or ""
            if name in _RAW and not closing:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at) if not attrs.endswith("/") else None
                at = close.end() if close else at if attrs.endswith("/") else end
                if not unread:
                    flush()
                continue
            if unread:
                if closing and name == unread[-1]:
                    unread.pop()
                    continue
                if not closing and name in _UNREAD and not attrs.endswith("/"):
                    unread.append(name)
                    continue
                leaves = closing and name not in unread and place((name,)) > 0 or not closing and unread[-1] in _BREAKABLE and name not in _INLINE and name not in _VOID and (name in _CLOSES or name in _PROSE_TAGS or name in ("div", "ul", "ol", "table", "section", "article"))
                if not leaves or name == "option":
                    continue
                unread.clear()
            if name in _INLINE:
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in _UNREAD:
                if not closing and not attrs.endswith("/"):
                    unread.append(name)
                    if name not in _BREAKABLE:
                        flush()
                continue
            flush()
            if name in _VOID:
                holder = stack[-1]
                continue
            if closing:
                if open_.get(name):
                    cut(open_[name][-1])
            else:
                if name in _CLOSES:
                    if (first := place(_CLOSES[name])) > place(_SCOPE[name]):
                        cut(first)
                elif self.name[stack[-1]] == "p":
                    cut(len(stack) - 1)
                if not attrs.endswith("/"):
                    open_.setdefault(name, []).append(len(stack))
                    stack.append(self._begin(name, attrs, stack[-1]))
            holder = stack[-1]
        flush()

    def under(self, values: list[tuple[int, float]]) -> list[float]:
        """For each element the sum of the values of it and of all that it holds."""
        out = [0.0] * len(self.parent)
        for e, x in values:
            out[e] += x
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def ratios(page: Page, found: list[tuple[int, str]]) -> list[tuple[float, float]]:
    """Text length and punctuation for each block of its path, for each block."""
    sums: dict[int, list[int]] = {}
    for e, t in found:
        s = sums.setdefault(page.path[e], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + len(t), s[1] + len(_PUNCTUATION.findall(t)), s[2] + 1
    return [(a / n, b / n) for a, b, n in (sums[page.path[e]] for e, _ in found)]


def _without_parts(page: Page) -> list[tuple[int, str]]:
    """The blocks that are in no named part of the page, by the rules above."""
    found = page.blocks
    if not any(page.parts):
        return found
    sizes = [(e, len(t)) for e, t in found]
    size, total = page.under(sizes), sum(n for _, n in sizes)
    in_article = page.under([(e, n) for e, n in sizes if page.inside[e] or page.name[e] in _MARKED])
    prose = [len(t) if (len(t) >= PROSE or page.name[e] in _PROSE_TAGS) and _PUNCTUATION.search(t) else 0 for e, t in found]
    prose_size = page.under([(e, n) for (e, _), n in zip(found, prose, strict=True)])
    named = [False] * len(page.parent)
    for e in range(1, len(named)):
        named[e] = named[page.parent[e]] or bool(page.parts[e])
    score = [a * (1 + b) for a, b in ratios(page, found)]
    plain = [(s, n) for s, (e, n) in zip(score, sizes, strict=True) if not named[e]]
    mean = sum(s * n for s, n in plain) / sum(n for _, n in plain) if plain else 0.0
    content = page.under([(e, n if PENALTY * s >= THRESHOLD * mean else 0) for s, (e, n) in zip(score, sizes, strict=True)])
    out = [False] * len(page.parent)
    for e in range(1, len(out)):
        out[e] = out[page.parent[e]]
        if names := page.parts[e]:
            wraps = names <= (_LAYOUT | {"form"}) and size[e] >= HOLDS * total and 2 * prose_size[e] >= size[e] and 2 * in_article[e] >= in_article[0]
            topic = page.topic[e] and page.inside[e] and bool(plain) and 2 * content[e] >= size[e]
            out[e] = out[e] or not (wraps or topic)
        elif page.name[e] in _MARKED and 2 * size[e] >= total:
            out[e] = False
    return [x for x in found if not out[x[0]]] or [x for x, n in zip(found, prose, strict=True) if n]


def extract(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    tree = Page(page or "")
    found = _without_parts(tree)
    if not found:
        return ""
    own, fused = ratios(tree, found), []
    for i in range(len(found)):
        near = own[max(0, i - REACH) : i + REACH + 1]
        fused.append(sum(r[0] for r in near) / len(near) * (1 + sum(r[1] for r in near) / len(near)))
    sizes = [len(t) for _, t in found]
    mean = sum(f * n for f, n in zip(fused, sizes, strict=True)) / sum(sizes)
    score = tree.under([(e, n if f >= THRESHOLD * mean else 0) for (e, _), f, n in zip(found, fused, sizes, strict=True)])
    best = max((e for e in range(len(score)) if score[e] >= HOLDS * score[0]), key=lambda e: (tree.depth[e], -e))
    kept = [False] * len(score)
    if tree.name[best] in ("#", "html", "body"):
        kept = [name in _MARKED and score[e] > 0 for e, name in enumerate(tree.name)]
    if not any(kept):
        while tree.name[best] in _SMALL and tree.parent[best] >= 0:
            best = tree.parent[best]
        kept[best] = True
    for e in range(1, len(kept)):
        kept[e] = kept[e] or kept[tree.parent[e]]
    return "\n\n".join(t for (e, t), r in zip(found, own, strict=True) if kept[e] or r[0] * (1 + r[1]) >= THRESHOLD * mean)


def _extracted(frames):
    for pdf in frames:
        texts = [extract(h) for h in pdf["html"]]
        yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def apply(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    source = pages.select(whole(id).alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").alias("html"))
    return with_long(source.mapInPandas(_extracted, "id string, url string, text string, n_chars long")).withColumnsRenamed({"id": id, "url": url})
