"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of tags (and
classes).  Per path, text length and punctuation are summed and divided by the
number of blocks on it: the path's two ratios.  Link text doesn't count.  Both
ratios are smoothed over neighbouring blocks in page order, fused by
multiplication, and compared with a threshold from the page's own spread.  Blocks
over the threshold are content nodes; the innermost element that holds all of them,
or the <article> or <main> around it, is the article.  Every block of the article is
returned, short ones too, and a level-one heading outside it, but for parts
that are no text of it (navigation, adverts, forms, comments and the like, told by
tag, or by a whole word of role, class or id), which have ratio zero and are left
out.  Names don't tell where they stand on what holds the bulk of the page's text and
no <article> or <main> of some length is outside it, nor on a page with no other text.

Pages are read one by one in a map: no shuffle, one page in memory.

Blocks are joined by two line feeds.

Cases: a null or empty page, or one without text, gives an empty text; very long and
very deep pages take time in proportion; ties in the ratios leave all their blocks on one
side of the threshold; unclosed and stray tags, and a page cut off in a tag, are read as far as they go; formulas in
<math> and what <noscript> and <object> hold are text; an <svg> without an end is passed over by its tags alone; character
references without a semicolon are decoded as browsers do; repeated rows are read
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is passed over.
RAW = frozenset("script style template iframe textarea title noframes svg".split())
#: Those whose content is no markup, so that it goes on to the end of the page without an end tag.
ENDLESS = frozenset("script style iframe textarea title noframes".split())
#: Elements that part blocks.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open paragraph.
ENDS_P = BLOCK - frozenset("br caption tbody td tfoot th thead tr legend optgroup option body html head".split())
#: Elements that are no text of an article.
APART = frozenset("nav header footer aside form button select option menu dialog head script style".split())
#: Words in class, id or role that say the same.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside"
    " header masthead footer cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login form"
    " share sharing social related recommended comments comment respond reply replies disqus pagination pager toolbar widget complementary contentinfo search skip legal copyright".split()
)
#: These may stand in an article with a heading of their own; their names don't set them apart.
CONTENT = frozenset("article main body html".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
#: An element with more than BULK of the page's text has no name that sets it apart, unless <article> or <main> elements outside it hold REST of that text.
BULK, REST = 1 / 2, 1 / 4
#: Elements that can be the article.
HOLDERS = frozenset(("article", "main", "section", "div", "td", "body", "html", ""))


class Element:
    __slots__ = ("tag", "parent", "apart", "named", "path", "linked", "depth", "main", "chars", "main_chars")

    def __init__(self, tag: str, marks: str, parent: "Element | None", apart: bool, named: bool, paths: dict) -> None:
        self.tag, self.parent = tag, parent
        self.apart = apart or (parent.apart if parent else False)
        self.named = named
        self.linked = tag == "a" or (parent.linked if parent else False)
        # A path is its parent's number and its own last step, so deep pages stay small.
        self.path = paths.setdefault((parent.path if parent else -1, tag + marks), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.main = tag in ("article", "main") or (parent.main if parent else False)
        # Characters without links and parts apart; those in an <article> or <main>.
        self.chars = self.main_chars = 0


def set_apart(elements: list[Element]) -> None:
    """Sets apart what names tell, inherited; elements come after their parents."""
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.main_chars += e.main_chars
    page = elements[0]
    for e in elements[1:]:
        bulk = e.chars > BULK * page.chars and page.main_chars - e.main_chars < REST * e.chars
        e.apart = e.apart or e.parent.apart or (e.named and not bulk)


def named_apart(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether a word of an element's class, id or role may set it apart; its class for the path."""
    marks, words = "", set()
    for kind, value in MARK.findall(attributes):
        value = value.strip("\"'")
        words.update(value.lower().split())
        if kind.lower() == "class":
            marks = "." + ".".join(value.split())
    return tag not in CONTENT and not words.isdisjoint(APART_WORDS), marks


def blocks(page: str, names: bool = True) -> list[tuple[Element, str, int, bool]]:
    """(element, text, length of its link text, set apart) of each block, in page order.

    A block is set apart if all of its text is.  Without ``names`` only tags tell.
    """
    paths: dict[tuple[int, str], int] = {}
    root = Element("", "", None, False, False, paths)
    here, out = root, []
    elements = [root]
    spoken: list[Element] = []
    open_: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    owner, linked = root, 0

    def flush() -> None:
        nonlocal parts, linked, spoken
        text = SPACE.sub(" ", "".join(parts)).strip(" ")
        if text:
            out.append((owner, text, linked, spoken))
        parts, linked, spoken = [], 0, []

    def say(raw: str) -> None:
        nonlocal owner, linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not parts or not text.isspace():
                # A block belongs to the innermost block element around its first text.
                if not any(p.strip() for p in parts):
                    owner = here
                n = len(text.strip())
                if here.linked:
                    linked += n
                elif not here.apart:
                    here.chars += n
                    here.main_chars += n if here.main else 0
                if n:
                    spoken.append(here)
            parts.append(text)

    def leave(e: Element) -> None:
        """Close ``e`` and all that is open inside it."""
        nonlocal here
        while here is not e.parent:
            open_[here.tag] -= 1
            here = here.parent

    def close(tag: str) -> None:
        nonlocal here
        if not open_[tag]:
            return  # a stray end
        e = here
        while e.tag != tag:
            e = e.parent
        leave(e)

    at, size = 0, len(page)
    unended: set[str] = set()
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if tag in BLOCK:
                flush()
            close(tag)
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            e = here  # implied ends
            while e.parent is not None and e.tag not in ("article", "body", "td", "table", "ul", "ol", "dl", "div", "section", "main"):
                if (e.tag == "p" and tag in ENDS_P) or (e.tag == tag and tag in ("li", "td", "th", "tr", "option")) or ({e.tag, tag} <= {"dd", "dt"}):
                    leave(e)
                    break
                e = e.parent
        if tag in VOID:
            continue
        if tag in RAW and tag not in unended and not (tag == "svg" and m[2].rstrip().endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            if end or tag in ENDLESS:
                at = end.end() if end else size
                continue
            unended.add(tag)  # read on as markup
        if not m[2].rstrip().endswith("/"):
            named, marks = named_apart(tag, m[2])
            here = Element(tag, marks, here, tag in APART, named and names, paths)
            elements.append(here)
            open_[tag] += 1
    flush()
    set_apart(elements)
    return [(e, text, linked, all(x.apart for x in spoken)) for e, text, linked, spoken in out]


def smoothed(x: np.ndarray) -> np.ndarray:
    """Weighted mean with the two blocks on either side."""
    weights = np.array([1, 2, 3, 2, 1], float)
    return np.convolve(np.pad(x, 2), weights, "valid") / np.convolve(np.pad(np.ones(len(x)), 2), weights, "valid")


def path_scores(found: list[tuple[Element, str, int, bool]]) -> np.ndarray:
    """The fused ratio of each block's path."""
    length, points, number = defaultdict(float), defaultdict(float), defaultdict(int)
    for e, text, linked, _ in found:
        length[e.path] += max(0, len(text) - linked)
        points[e.path] += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
        number[e.path] += 1
    apart = np.array([x for _, _, _, x in found])
    text_ratio = np.array([length[e.path] / number[e.path] for e, _, _, _ in found])
    point_ratio = np.array([points[e.path] / number[e.path] for e, _, _, _ in found])
    text_ratio[apart], point_ratio[apart] = 0.0, 0.0
    return np.where(apart, 0.0, smoothed(text_ratio) * (1 + smoothed(point_ratio)))


def lineage(e: Element) -> list[Element]:
    """``e`` and its ancestors, innermost first."""
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out


def held_by(nodes: list[Element]) -> Element:
    """The innermost holder of all nodes; the <article> or <main> around it, if there is one."""
    common = nodes[0]
    for e in nodes[1:]:
        while e is not common:
            if e.depth >= common.depth:
                e = e.parent
            else:
                common = common.parent
    up = lineage(common)
    return next((e for e in up if e.tag in ("article", "main")), None) or next(e for e in up if e.tag in HOLDERS)


def within(e: Element, holder: Element) -> bool:
    while e.depth > holder.depth:
        e = e.parent
    return e is holder


def headed(e: Element) -> bool:
    """Whether a block is a level-one heading."""
    while e.tag not in BLOCK and e.parent is not None:
        e = e.parent
    return e.tag == "h1"


def main_text(page: str | None, names: bool = True) -> str:
    found = blocks(page or "", names)
    if not found:
        return ""
    scores = path_scores(found)
    most = scores.max()
    if most <= 0:
        return main_text(page, names=False) if names else ""
    threshold = min(scores.std(), most / 2)
    article = held_by([e for (e, _, _, apart), score in zip(found, scores) if score >= threshold and not apart])
    return "\n\n".join(text for e, text, _, apart in found if not apart and (within(e, article) or headed(e)))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
