"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the tag path from the root.  Over all
blocks of a path, text length and punctuation are added up; their ratios to the
number of the path's blocks are smoothed along the page (neighbours at most double
a path's own), multiplied, and paths above a share of the page's mean are content,
on every page; ``article`` and ``main`` only weigh their blocks' paths.  Headings,
lists, quotes and tables that stand in the same element as content belong to it,
and so does a heading right before it, unless most of their text is links.

Elements that never hold the article (menus, footers, scripts, ...) are left out
before anything is counted.  Forms, page headers and elements whose class, id or
role says that they are something else are left out if they hold a minor share of
the page's text; what wraps most of it stays (one block alone is no wrapper where
an article or main element has text, too).

Each page is worked on alone in its task.  Defined cases: null html is empty and
gives an empty text; broken markup is read as far as it goes; repeated rows are
pages of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>|[^>]*+>)", re.S
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"""(?:^|[\s/])hidden(?=[\s/=>]|$)(?!\s*=\s*["']?false)""", re.I)
_UNSEEN = re.compile(r"""(?:^|[\s/"'])(?:style\s*=\s*(?:"[^"]*?|'[^']*?|)display\s*:\s*none|aria-hidden\s*=\s*["']?true)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،]")

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "head nav footer aside button select option datalist menu script style noscript template svg canvas "
    "iframe object audio video dialog textarea title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: a block's holder is the deepest element that is none of them.
TEXTUAL = HEADINGS | frozenset(
    "p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split()
)
CLOSED_BY_SAME = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
}

#: Words of class, id or role that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebars?|side|widgets?|menus?|nav\w*|"
    r"breadcrumbs?|footers?|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|"
    r"overlay|newsletters?|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|disqus|replies|reply|respond|search|pagination|pager|skip|legal|copyright|"
    r"navigation|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?=$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?=$|[\s_-])", re.I)

SHARE_OF_MEAN = 0.5
MINOR_SHARE = 0.5
MOST_LINKED = 0.6
#: What article and main elements add to the weight of a path that is wholly inside.
ARTICLE_WEIGHT = 0.5
#: Characters of a sentence beside the comments that tells them from a wrapper of the page.
SENTENCE = 60


def _hidden(attributes: str) -> bool:
    """Whether an element is hidden by an attribute, not by a word in another's value."""
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    return bool(_UNSEEN.search(attributes) or _HIDDEN.search(_VALUE.sub("=''", attributes)))


class Block:
    __slots__ = ("ids", "linked", "path", "text")

    def __init__(self, path: str, ids: tuple[int, ...], text: str, linked: int) -> None:
        self.path, self.ids, self.text, self.linked = path, ids, text, linked


def blocks(page: str) -> tuple[list[Block], set[int]]:
    """Blocks of text in page order, and the numbers of article and main elements.

    Marked elements with a minor share of the text are left out, and comments.
    """
    out: list[Block] = []
    places: set[int] = set()
    marked: set[int] = set()
    commented: set[int] = set()
    stack: list[tuple[str, int, bool]] = []  # name, number, left out
    words: list[str] = []
    linked: list[str] = []
    number = at = links = 0

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                line = [(name, n) for name, n, _ in stack if name not in INLINE]
                out.append(Block("/".join(name for name, _ in line), tuple(n for _, n in line), text,
                                 len(" ".join(html.unescape("".join(linked)).split()))))
            words.clear()
            linked.clear()

    def pop(to: int) -> None:
        nonlocal links
        if any(name not in INLINE for name, _, _ in stack[to:]):
            flush()
        links -= sum(name == "a" for name, _, _ in stack[to:])
        del stack[to:]

    def hear(text: str) -> None:
        if text and not (stack and stack[-1][2]):
            words.append(text)
            if links:
                linked.append(text)

    while (tag := _TAG.search(page, at)) is not None:
        hear(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                pop(depth)
            continue
        attributes = tag[3]
        if name in VOID:
            if name == "br":
                hear(" ")
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == "p"), None)
            if depth is not None and all(stack[d][0] in INLINE or d == depth for d in range(depth, len(stack))):
                pop(depth)  # a block ends an open paragraph
            if name in CLOSED_BY_SAME:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] in CLOSED_BY_SAME[name]:
                        break
                    if stack[d][0] == name or {stack[d][0], name} in ({"dt", "dd"}, {"td", "th"}):
                        pop(d)
                        break
        number += 1
        marks = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if "=" in attributes else ""
        in_article = any(n in places for _, n, _ in stack)
        away = (
            bool(stack and stack[-1][2])
            or name in LEFT_OUT
            or _hidden(attributes)
        )
        if (
            name == "form"
            or (marks and name not in ("html", "body", "article", "main") and MARKED.search(marks))
            or (not in_article and (name == "header" or HEADER.search(marks)))
        ):
            marked.add(number)
        if marks and name not in ("html", "body", "article", "main") and COMMENTS.search(marks):
            commented.add(number)
        if (name in ("article", "main") or "main" in marks.lower().split()) and not away:
            places.add(number)
        links += name == "a"
        stack.append((name, number, away))
    if not page.startswith("<", at):
        hear(page[at:])
    flush()
    held: dict[int, list[int]] = {}
    for b in out:
        for n in marked.intersection(b.ids):
            held.setdefault(n, []).append(len(b.text))
    total = sum(len(b.text) for b in out)
    placed = any(places.intersection(b.ids) and not marked.intersection(b.ids) for b in out)
    minor = {n for n, sizes in held.items() if sum(sizes) < MINOR_SHARE * total or (placed and len(sizes) == 1)}
    # Comments go whatever their share, unless they wrap the page's article.
    for n in commented.difference(minor).intersection(held):
        wrapped = any(n in b.ids and (places.intersection(b.ids[b.ids.index(n) :]) or b.path.endswith("/h1")) for b in out)
        beside = (b for b in out if not marked.intersection(b.ids))
        if not wrapped and any(len(b.text) >= SENTENCE and _PUNCTUATION.search(b.text) for b in beside):
            minor.add(n)
    return [b for b in out if not minor.intersection(b.ids)], places


def _smooth(values: list[float]) -> list[float]:
    """Weighed 1 : 2 : 1 with both neighbours on the page."""
    n = len(values)
    return [
        (values[max(0, i - 1)] + 2 * values[i] + values[min(n - 1, i + 1)]) / 4 for i in range(n)
    ]


def _holder(block: Block) -> int:
    """The number of the deepest element that is not of running text; 0 for the page."""
    names = block.path.split("/")
    return next((n for name, n in zip(reversed(names), reversed(block.ids), strict=False) if name not in TEXTUAL), 0)


def main_text(page: str) -> str:
    found, places = blocks(page)
    if not found:
        return ""
    length: dict[str, int] = {}
    marks: dict[str, int] = {}
    linked: dict[str, int] = {}
    count: dict[str, int] = {}
    inside: dict[str, int] = {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        linked[b.path] = linked.get(b.path, 0) + b.linked
        count[b.path] = count.get(b.path, 0) + 1
        inside[b.path] = inside.get(b.path, 0) + bool(places.intersection(b.ids))
    own_texts = [length[b.path] / count[b.path] for b in found]
    own_stops = [marks[b.path] / count[b.path] for b in found]
    texts = [min(2 * own, value) for own, value in zip(own_texts, _smooth(own_texts), strict=True)]
    stops = [min(2 * own, value) for own, value in zip(own_stops, _smooth(own_stops), strict=True)]
    fused: dict[str, float] = {}
    for b, text, stop in zip(found, texts, stops, strict=True):
        weight = (1 - linked[b.path] / length[b.path]) * (1 + ARTICLE_WEIGHT * inside[b.path] / count[b.path])
        fused[b.path] = fused.get(b.path, 0.0) + math.sqrt(text * (1 + stop)) * weight / count[b.path]
    mean = sum(fused[b.path] for b in found) / len(found)
    content = [b for b in found if fused[b.path] >= SHARE_OF_MEAN * mean and linked[b.path] <= MOST_LINKED * length[b.path]]
    chosen = set(map(id, content))
    holders = set(map(_holder, content))
    kept: list[str] = []
    follows = False  # content comes next
    for b in reversed(found):
        name = b.path.rpartition("/")[2]
        if id(b) in chosen:
            follows = True
        elif b.linked > MOST_LINKED * len(b.text):
            follows = False
            continue
        elif not (name in TEXTUAL and _holder(b) in holders) and not (name in HEADINGS and follows):
            follows = False
            continue
        kept.append(b.text)
    return "\n".join(reversed(kept))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, no shuffle."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
