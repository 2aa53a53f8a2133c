"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's length is its
text outside links, or zero inside menus, adverts and the like. The sums of a few
neighbouring lengths are the line-block distribution: it surges where the article
begins and dives where it ends, and the lines between are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, unpacked

#: Lines in a sliding window; length of a window's text from which it surges.
LINES, SURGE = 3, 80

#: Element and attribute names (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head iframe menu nav noscript object select svg template".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: What else a compound class or id of boilerplate (site-footer, ad-slot) may be made of; has-sidebar or no-comments are none.
PARTS = frozenset("area bar block bottom box button buttons container form global icons inner item items left link links list main media module outer page panel placeholder post posts primary right row secondary section site slot top unit wrap wrapper".split())
#: Of DROPPED and ROLES, what can be a layout around the whole page.
LAYOUT = frozenset("fieldset form header".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)|\Z)"
    # A quoted value may hold '>' if what follows it can follow a value; else its quote is taken as never closed
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']|\"[^\">]*\"|'[^'>]*'|\"[^\">]*>[^\"]*\"(?=[\s/>])|'[^'>]*>[^']*'(?=[\s/>]))*+)(?:>|\Z)"
    r"|(?P<open>[^>]*)(?:>|\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _named(word: str) -> bool:
    """Whether a class or id is a boilerplate word, or made of such words and PARTS."""
    parts = set(_WORD.findall(word))
    return not BOILERPLATE.isdisjoint(parts) and parts <= BOILERPLATE | PARTS


def _boilerplate(name: str, attrs: str, in_article: bool) -> str:
    """'' for no boilerplate, 'always', or 'named' for what may also be a layout around the text."""
    if name in DROPPED or name == "header" and not in_article:
        return "named" if name in LAYOUT else "always"
    if not attrs or name in ("html", "body", "main"):
        return ""
    found = ""
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip() in ROLES - LAYOUT:
            return "always"
        if key == "role" and value.strip() in LAYOUT or key in ("class", "id") and any(_named(word) for word in value.split()):
            found = "named"
    return found


def _tree(html: str) -> tuple[list[tuple[int, str, str]], list[tuple[int, str | None]]]:
    """Elements in page order (parent, name, boilerplate), the root first; texts and, as None, breaks, each with its element."""
    elements: list[tuple[int, str, str]] = [(-1, "", "")]
    articles = [False]  # whether in article or main
    pieces: list[tuple[int, str | None]] = []
    stack = [0]
    blocks = [0]  # for each place of the stack, the last place up to it that holds a block (0: none)
    places: dict[str, list[int]] = {}  # of the open elements of a name, so that no tag walks the stack
    at = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            places[elements[e][1]].pop()
        del stack[k:], blocks[k:]

    for m in [*_PIECE.finditer(html), None]:
        if piece := html[at : m.start() if m else len(html)]:
            pieces.append((stack[-1], unescape(piece)))
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            pieces.append((stack[-1], None))
        elif name == "br":
            pieces.append((stack[-1], " "))
        if m["close"]:
            if places.get(name):
                close(places[name][-1])
            continue
        attrs = m["attrs"] or m["open"] or ""
        if name not in VOID and not attrs.rstrip().endswith("/"):
            if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):  # these end an open one of their kind
                if places.get(name) and places[name][-1] >= blocks[-1]:
                    close(places[name][-1])
            top = stack[-1]
            boilerplate = _boilerplate(name, attrs, articles[top])
            places.setdefault(name, []).append(len(stack))
            blocks.append(len(stack) if name in BLOCKS else blocks[-1])
            stack.append(len(elements))
            elements.append((top, name, boilerplate))
            articles.append(articles[top] or name in ("article", "main"))
            if boilerplate:
                pieces.append((stack[-1], ""))
    pieces.append((stack[-1], None))
    return elements, pieces


def _dropped(elements: list[tuple[int, str, str]], pieces: list[tuple[int, str | None]]) -> list[bool]:
    """Whether each element is in boilerplate.

    What is named like boilerplate but holds the page's main element, its only article or
    nearly all its text is a layout around the text: its lines' lengths decide.
    """
    n = len(elements)
    link = [False] * n
    for e, (parent, name, _) in enumerate(elements[1:], 1):
        link[e] = link[parent] or name == "a"
    prose, longest = [0] * n, [0] * n
    for e, text in pieces:
        if text and not link[e]:
            size = len("".join(text.split()))
            prose[e] += size
            longest[e] = max(longest[e], size)
    # Of all in an element, and of what is in no boilerplate below it
    clear, marked, has_main, marked_clear = prose[:], [False] * n, [False] * n, [False] * n
    for e in range(n - 1, 0, -1):
        parent, name, boilerplate = elements[e]
        if not boilerplate and name in ("article", "main"):
            marked[e] = marked_clear[e] = True
            has_main[e] |= name == "main"
        prose[parent] += prose[e]
        marked[parent] |= marked[e]
        has_main[parent] |= has_main[e]
        if not boilerplate:
            clear[parent] += clear[e]
            longest[parent] = max(longest[parent], longest[e])
            marked_clear[parent] |= marked_clear[e]
    outside, most, article = clear[0], longest[0], marked_clear[0]
    dropped = [False] * n
    for e, (parent, name, boilerplate) in enumerate(elements[1:], 1):
        dropped[e] = dropped[parent]
        if not boilerplate or dropped[e]:
            continue
        if boilerplate == "always":
            keep = False
        elif article:
            keep = has_main[e]
        elif marked[e]:
            keep = has_main[e] or prose[e] > outside
        else:
            nearly_all = 5 * prose[e] > 4 * prose[0]
            keep = most < SURGE and (nearly_all or name in LAYOUT and prose[e] > outside) or name in LAYOUT and nearly_all
        dropped[e] = not keep
        if keep:
            outside, most, article = outside + clear[e], max(most, longest[e]), article or marked_clear[e]
    return dropped


def lines(elements: list[tuple[int, str, str]], pieces: list[tuple[int, str | None]]) -> Iterator[tuple[str, int, bool, int]]:
    """(text, length, in article, element) of each block in page order; length 0 for boilerplate."""
    dropped = _dropped(elements, pieces)
    article, link = [False] * len(elements), [False] * len(elements)
    for e, (parent, name, _) in enumerate(elements[1:], 1):
        article[e] = article[parent] or name in ("article", "main") and not dropped[e]
        link[e] = link[parent] or name == "a"
    text: list[str] = []
    length, gap = 0, False
    for e, piece in pieces:
        gap |= dropped[e]
        if piece is None:
            if line := " ".join("".join(text).split()):
                if gap:
                    yield from [("", 0, False, 0)] * LINES
                yield line, length, article[e], e
                gap = dropped[e]
            text, length = [], 0
        elif not dropped[e]:
            text.append(piece)
            length += 0 if link[e] else len("".join(piece.split()))


def _strongest(sizes: list[int]) -> int:
    return max((sum(sizes[i : i + LINES]) for i in range(len(sizes))), default=0)


def _sharing(elements: list[tuple[int, str, str]], found: list[tuple[str, int, bool, int]], surging: list[int]) -> set[int]:
    """Lines in the containers of the surging ones: the least elements that aren't a list or paragraph and hold other lines too.

    Of a container that is the whole page, and of lines of links only, those directly in it.
    """
    n = len(elements)
    held = [0] * n
    for text, _, _, e in found:
        held[e] += bool(text)
    for e in range(n - 1, 0, -1):
        held[elements[e][0]] += held[e]
    containers = set()
    for k in surging:
        e = found[k][3]
        while e and (held[e] < 2 or elements[e][1] not in BLOCKS or elements[e][1] in PARAGRAPHS):
            e = elements[e][0]
        containers.add(e)
    page = [e in containers and elements[e][1] in ("", "html", "body") for e in range(n)]
    under = [False] * n  # in a container that isn't the whole page
    for e in range(n):
        under[e] = e in containers and not page[e] or e > 0 and under[elements[e][0]]
    shared = set()
    for k, (text, size, _, e) in enumerate(found):
        if not text:
            continue
        while e and elements[e][1] not in BLOCKS:
            e = elements[e][0]
        parent, name, _ = elements[e]
        direct = e in containers or e > 0 and parent in containers
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if size and (under[e] or direct) or direct and (heading or under[e]):
            shared.add(k)
    return shared


def main_text(html: str | None) -> str:
    """The article's blocks, joined by empty lines; '' if there is none.

    Where article or main elements hold the strongest surge, only their lines have a length
    and any text makes the distribution surge; elsewhere a window needs SURGE characters, and
    shorter pieces stay between two surges and in a surge's container.
    """
    if not html:
        return ""
    elements, pieces = _tree(html)
    found = list(lines(elements, pieces))
    inside, outside = (_strongest([n if a == marks else 0 for _, n, a, _ in found]) for marks in (True, False))
    marked = any(a for _, _, a, _ in found) and not outside >= max(SURGE, inside + 1)
    surge = 1 if marked else SURGE
    sizes = [(len(t) if a else 0) if marked else n for t, n, a, _ in found]
    sums = [sum(sizes[i : i + LINES]) for i in range(len(sizes))]
    regions: list[tuple[int, int, int]] = []  # the greatest sum, the first and the last line between a surge and its dive
    start = None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            sized = [k for k in range(start, i) if sizes[k]]
            regions.append((max(sums[start:i]), sized[0], sized[-1]))
            start = None
    if not regions:
        return ""
    surging = [r for r in regions if r[0] >= surge] or [max(regions, key=lambda r: r[0])]
    keep = {k for _, first, last in surging for k in range(first, last + 1)}
    if not marked:
        keep.update(k for k in range(surging[0][1], surging[-1][2]) if sizes[k])
        long = [k for _, first, last in surging for k in range(first, last + 1) if sizes[k] >= min(SURGE, max(sizes[first : last + 1]))]
        keep |= _sharing(elements, found, long)
    return "\n\n".join(found[k][0] for k in sorted(keep) if found[k][0])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), 512):
            some = batch.slice(k, 512)
            texts = [main_text(h) for h in some.column(some.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*some.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (code points) for each row of pages(html, ...).

    Null and empty pages, and pages without text outside boilerplate, give ''. Pages
    are read whole, one by one; cut-off markup, comments and scripts end with the page.
    Repeated rows give a row each, an empty table none, and nothing is shuffled. A kept
    column named like an output gives way to it; other columns have no part.
    """
    outputs = ("text", "n_chars")
    df = pages.select(kept_columns(keep, outputs), F.col("html"))
    kind = df.schema["kept"].dataType.simpleString()
    return df.mapInArrow(_extract, f"kept {kind}, text string, n_chars bigint").select(*unpacked(keep, outputs), *outputs)
