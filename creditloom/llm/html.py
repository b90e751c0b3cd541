"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of tags.  Blocks
of one path are judged together: how long they are and how much punctuation they
hold.  Ratios are smoothed along the page, both are multiplied, and paths below
a threshold are left out, below a mark (``article``, ``main``) as elsewhere; there
ratios weigh ``MARK_WEIGHT`` times as much.

Menus, footers, hidden parts and reader comments never count.  Forms and parts
with telling class names do not either, unless one of them holds most of the
page's text: then it is the page's frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creditloom.llm.text import mapped, steps, with_arrays, with_fields

#: Element names by their part in the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main"
    " menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = set("aside button dialog footer head header label menu nav option select".split())
#: Elements that only format text: they do not part paths.
INLINE = set(
    "a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub sup tt"
    " u var".split()
)
MARKS = {"article", "main"}
MARK_WEIGHT = 8.0
#: An element of the key is closed by a start tag of the values.
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
_ROLE = (
    r"ads?|advert\w*|banner|breadcrumbs?|complementary|consent|contentinfo|cookies?|disclaimer"
    r"|footer|header|hidden|login|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related"
    r"|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget"
)
_PLACE = (
    r"bar|block|bottom|box|container|content|global|holder|inner|item|left|links?|list|main|outer"
    r"|page|panel|post|primary|right|secondary|section|site|slot|top|unit|wrap|wrapper|\d+"
)
#: A name made of parts that tell of the layout, such as ``top-nav`` or ``sidebar_left``.
ROLES = re.compile(rf"(?:(?:{_PLACE})[_-])*(?:{_ROLE})(?:[_-](?:{_ROLE}|{_PLACE}))*", re.I)
_TALK = r"comments?|commentlist|discussion|disqus\w*|repl(?:y|ies)|responses?|respond"
#: Names of reader comments.
COMMENTS = re.compile(
    rf"(?:(?:{_PLACE}|user|reader)[_-])*(?:{_TALK})"
    rf"(?:[_-](?:{_PLACE}|area|author|body|form|meta|text|thread|{_TALK}))*",
    re.I,
)
PUNCTUATION = re.compile(r"[.,;:!?、。，！？；]")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/>]|\Z)",
    re.I,
)


class Block:
    """Text between two block-level tags; ``frames`` are the numbers of those it lies in."""

    __slots__ = ("path", "text", "frames", "marked")

    def __init__(self, path: str, text: str, frames: tuple[int, ...], marked: bool):
        self.path, self.text, self.frames, self.marked = path, text, frames, marked


#: What an element says of its text: nothing, that it may be a frame around something
#: else than content (a form, a class name), or that it is no content.
PLAIN, FRAME, NONE = 0, 1, 2

#: A frame that holds this share of the text or more is no frame around something else.
MOST = 0.5


def _nature(name: str, attributes: str, marked: bool) -> int:
    heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
    nature = PLAIN
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key = key.lower()
        if key == "hidden":
            return NONE
        if key == "id" and (heading or name == "p"):  # the target of a link
            continue
        for token in "".join(values).split():
            if COMMENTS.fullmatch(token):
                return NONE
            if ROLES.fullmatch(token):
                nature = FRAME
    if name in MARKS or name in ("html", "body"):
        return PLAIN
    if name in BOILERPLATE:
        return PLAIN if name == "header" and marked else NONE
    return FRAME if name == "form" else nature


#: An open element: its name, whether it or one around it is no content, the frames
#: it lies in, and whether it lies below a mark.
Open = tuple[str, bool, tuple[int, ...], bool]


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order without sure boilerplate; broken markup is read as browsers do, roughly."""
    out: list[Block] = []
    stack: list[Open] = []
    parts: list[str] = []
    path: str | None = None
    frames = 0

    def close_block() -> None:
        nonlocal path
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(path or "", text, *((stack[-1][2], stack[-1][3]) if stack else ((), False))))
            parts.clear()
        path = None

    def add(text: str) -> None:
        nonlocal path
        if stack and stack[-1][1]:  # also inside a sentence, as a button is
            return
        if path is None and not text.isspace():
            path = "/".join(s[0] for s in stack if s[0] not in INLINE)
        parts.append(text)

    at = 0
    while at < len(html):
        found = _TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        closing, name = found.group(1), (found.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCKS or name == "br":
            close_block()
        if closing:
            names = [s[0] for s in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            continue
        _close_implied(stack, name)
        _, none, inside, marked = stack[-1] if stack else ("", False, (), False)
        nature = _nature(name, found.group(3), marked)
        if nature == FRAME:
            inside = (*inside, frames)
            frames += 1
        stack.append((name, none or nature == NONE, inside, marked or name in MARKS))
    close_block()
    return out


def unframed(blocks: list[Block]) -> list[Block]:
    """The blocks outside of all frames but those around the page's content.

    Such a frame holds most of the text, and all that is marked as content.
    """
    held: dict[int, list[int]] = {}
    for block in blocks:
        for frame in block.frames:
            mine = held.setdefault(frame, [0, 0])
            mine[0] += len(block.text)
            mine[1] += block.marked
    total, marked = sum(len(b.text) for b in blocks), sum(b.marked for b in blocks)
    around = {f for f, (size, marks) in held.items() if size >= MOST * total and marks == marked}
    return [b for b in blocks if around.issuperset(b.frames)]


def _close_implied(stack: list[Open], name: str) -> None:
    """Close what a start tag ends: an open paragraph, or an item by the next one."""
    for i in range(len(stack) - 1, -1, -1):
        open_name = stack[i][0]
        if open_name == "p" and name in BLOCKS or name in CLOSED_BY.get(open_name, ()):
            del stack[i:]
            return
        if open_name in BLOCKS and open_name not in ("p", "li", "dt", "dd"):
            return


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted mean with two neighbours on either side."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, mode="full")[2:-2]
    return np.convolve(values, kernel, mode="full")[2:-2] / weight


def content_of(blocks: list[Block], strictness: float = 0.5) -> list[Block]:
    """The blocks of the paths that hold the main text."""
    blocks = unframed(blocks)
    if len(blocks) < 2:
        return blocks
    lengths = np.array([len(b.text) for b in blocks], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], dtype=float)
    names, path = np.unique([b.path for b in blocks], return_inverse=True)
    counts = np.bincount(path)
    text_ratio = (np.bincount(path, lengths) / counts)[path]
    mark_ratio = (np.bincount(path, marks) / counts)[path]
    fused = _smoothed(text_ratio) * (_smoothed(mark_ratio) + 0.05)
    fused *= np.where([b.marked for b in blocks], MARK_WEIGHT, 1.0)
    by_path = np.bincount(path, fused) / counts
    limit = min(strictness * fused.std(), by_path.max())
    kept = by_path >= limit
    return [b for b, p in zip(blocks, path) if kept[p]]


def main_text(html: str) -> str:
    return " ".join(b.text for b in content_of(blocks_of(html)))


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html``.

    The whole page is read.  Null, empty and textless pages give an empty text;
    a page without markup is its own text; equal pages give equal texts.  An
    input column called ``name`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, html):
            found = [main_text(x or "") for x in batch.column(html).to_pylist()]
            yield with_arrays(batch, {name: pa.array(found, pa.string())})

    return mapped(pages, run, with_fields(pages.schema, [T.StructField(name, T.StringType())]))
