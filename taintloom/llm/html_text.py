"""The main text of web pages by tag-path ratios.

Every block of text belongs to a path of tags from the root to its block element. Text length, punctuation,
links and the number of blocks are summed for each path; a path's ratio is its text and punctuation for each
block, with linked text taken off. Ratios are smoothed along the order of first appearance and fused with those
of the path itself and with what the path's tags, roles and class names say: nothing for page furniture, much for
paths in article and main elements. Paths whose ratio passes the threshold choose the content: the lowest element
around all of their blocks, and around the whole article or main elements that hold them. All of its blocks but
those without a ratio are the result, short ones too, and the headings before it.

Elements are numbered as they open, and paths are numbers in a table: no step looks at all open elements, so time
and memory grow with the page, however deep it is nested.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from taintloom.llm.common import prepare

# Elements of HTML by what they do to blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
INLINE |= MATH
ANNOTATIONS = ("annotation", "annotation-xml")  # the formula once more in another notation
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
FURNITURE_TAGS = frozenset("nav footer aside script style noscript template head title textarea select button iframe object svg menu dialog input datalist canvas audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# a name is furniture if all its parts say so or only say where; one part of a longer name says nothing
_OTHERS = r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|sidebar|side-?bar|footer|related|recommend\w*|widgets?|comments?|respond|reply|replies|disqus"
_LAYOUT = r"banners?|nav|navbar|navigation|menu\w*|breadcrumbs?|masthead|topbar|cookies?|consent|gdpr|notices?|notification|alerts?|popup|modal|newsletter|subscri\w*|signup|login|share|sharing|social\w*|pagination|pager|skip-?link|toolbar|hidden|site-?header"
_WHERE = r"site|page|global|main|primary|secondary|top|bottom|footer|header|area|container|wrapper|wrap|box|list|bar|block|section|item|links?|buttons?|icons?|form|posts?|articles?|slot|unit|inner|thread|title|text|message|overlay|toggle|dropdown|mobile|media|us|me|js"
FURNITURE_NAMES = re.compile(rf"(?i)(?<!\S)(?:(?:{_WHERE})[_-]+)*(?:{_OTHERS}|{_LAYOUT})(?:[_-]+(?:{_OTHERS}|{_LAYOUT}|{_WHERE}))*(?!\S)")
# articles under these names are others than the page's own
OTHERS_NAMES = re.compile(rf"(?i)(?<![^\s_-])(?:{_OTHERS})(?![^\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# parts of a text, never all of it
PARTS = HEADINGS | frozenset("p li ul ol td th tr blockquote pre".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟]")
TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


#: What a path's tags and names say of its text.
FURNITURE, PLAIN, MAIN = 0.0, 1.0, 30.0
#: Share of the page's sentences that makes a form the page itself, as some servers wrap pages in one.
WRAPS = 0.8


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    parent: Element | None
    order: int  # its number, and that of the last element within it
    last: int
    depth: int
    path: int
    hard: bool  # furniture by tag, role or style, its own or of an element around it
    named: bool  # furniture by a class name alone
    others: bool  # a name of other articles than the page's own is among them
    main: bool  # an article or main element
    outer: Element | None  # the outermost article or main element around it that is no furniture
    about: bool  # within an article or main element, furniture or not
    heading: bool
    form: Element | None  # the form around it
    holder: Element | None = None  # the element that text in it belongs to
    wraps: bool = False  # a form that holds the article

    @property
    def furniture(self) -> bool:
        return self.hard or self.named


@dataclass(slots=True, eq=False)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def _root() -> Element:
    root = Element("", None, 0, 0, 0, 0, False, False, False, False, None, False, False, None)
    root.holder = root
    return root


def _element(tag: str, rest: str, parent: Element, order: int, paths: dict[tuple[int, str, bool], int]) -> Element:
    a = _attributes(rest)
    role = a.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
    hard, named, others = parent.hard, parent.named, parent.others
    if named and main and (tag == "main" or role == "main" or not others):
        named = others = False  # a class name alone does not hide the page's main element
    if not hard:
        # a header is the page's own unless it heads the article
        header = tag == "header" and parent.outer is None
        gone = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        if not main and tag not in INLINE and tag not in ("html", "body"):
            for k in ("class", "id"):
                for m in FURNITURE_NAMES.finditer(a.get(k, "")):
                    named, others = True, others or bool(OTHERS_NAMES.search(m[0]))
        hard = tag in FURNITURE_TAGS or header or role in FURNITURE_ROLES or gone
        if hard:
            named = others = False
    path = paths.setdefault((parent.path, tag, hard or named), len(paths) + 1)
    e = Element(tag, parent, order, order, parent.depth + 1, path, hard, named, others, main, parent.outer, parent.about or main, parent.heading or tag in HEADINGS, parent.form)
    if main and e.outer is None and not e.furniture:
        e.outer = e
    if e.form is not None and main and not e.furniture:
        e.form.wraps = True
    if tag == "form":
        e.form = e
    e.holder = e if tag not in INLINE or e.furniture else parent.holder
    return e


def _tells(b: Block) -> bool:
    """A block with a sentence that is not a link."""
    return b.linked * 2 < len(b.text) and bool(PUNCTUATION.search(b.text))


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, texts decoded and with single spaces; blocks without text are left out."""
    open_: list[Element] = [_root()]
    where: dict[str, list[int]] = {}  # for each tag the places of its open elements
    paths: dict[tuple[int, str, bool], int] = {}
    endless: set[str] = set()
    out: list[Block] = []
    now: Block | None = None
    links = made = 0

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(open_[-1].holder)
            out.append(now)
        elif now.element is not (h := open_[-1].holder) and not text.isspace():
            now = Block(h)
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def close() -> Element:
        nonlocal links
        e = open_.pop()
        where[e.tag].pop()
        links -= e.tag == "a"
        e.last = made
        return e

    def close_to(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Close elements down to the outermost of tags above the innermost of stop."""
        nonlocal now
        least = max((where[t][-1] for t in stop if where.get(t)), default=0)
        above = [(own, bisect_right(own, least)) for t in tags if (own := where.get(t))]
        at = min((own[i] for own, i in above if i < len(own)), default=None)
        if at is not None:
            while len(open_) > at:
                close()
            now = None

    def after(tag: str, at: int) -> int | None:
        """The place behind the next end tag, if there is one."""
        if tag in endless:
            return None
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
        if end is None:
            endless.add(tag)
            return None
        return end.end()

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(unescape(html[at:]))
            break
        if lt > at:
            add(unescape(html[at:lt]))
        m = TOKENS.match(html, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m["name"] is None:
            if m["cdata"]:
                add(m["cdata"])
            continue
        tag = m["name"].lower()
        if m["close"]:
            if tag == "br":
                add(" ")
            elif where.get(tag):
                while True:
                    e = close()
                    if e.tag not in INLINE or e.furniture:
                        now = None
                    if e.tag == tag:
                        break
            elif tag == "p":
                now = None
            continue
        if tag in ENDS_P:
            close_to(("p",), ("button", "table", "object", "td", "th"))
        if tag in CLOSES:
            close_to(CLOSES[tag], BOUNDARY.get(tag, ("select",)))
        if tag in VOID or tag not in INLINE and m["rest"].endswith("/") and tag not in ENDS_P and tag not in RAW:
            if tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            elif tag not in INLINE:
                now = None
            continue
        if tag in ANNOTATIONS:
            at = after(tag, at) or at
            continue
        if tag not in INLINE:
            now = None
        if tag in RAW or tag in ("noscript",):
            at = after(tag, at) or size
            continue
        made += 1
        open_.append(_element(tag, m["rest"], open_[-1], made, paths))
        where.setdefault(tag, []).append(len(open_) - 1)
        links += tag == "a"
    for e in open_:
        e.last = made
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def priors(every: list[Block]) -> list[float]:
    """What the elements around each block say of it."""
    told = sum(len(b.text) for b in every if not b.element.furniture and _tells(b))
    within: dict[Element, tuple[int, int]] = {}
    for b in every:
        if b.element.form is not None and not b.element.furniture and _tells(b):
            n, size = within.get(b.element.form, (0, 0))
            within[b.element.form] = n + 1, size + len(b.text)
    wraps = {f for f, (n, size) in within.items() if n >= 3 and size >= WRAPS * told}

    def one(e: Element) -> float:
        if e.furniture or e.form is not None and not e.form.wraps and e.form not in wraps:
            return FURNITURE
        return PLAIN if e.outer is None else MAIN

    out = [one(b.element) for b in every]
    if not any(p and _tells(b) for p, b in zip(out, every)):
        # names have hidden all sentences: articles among them are the page's own then
        lifted = [p or (PLAIN if b.element.named and b.element.about else FURNITURE) for p, b in zip(out, every)]
        if any(p and _tells(b) for p, b in zip(lifted, every)):
            out = lifted
    return out if any(out) else [PLAIN if b.element.named else FURNITURE for b in every]


def path_ratios(every: list[Block], said: list[float]) -> list[float]:
    """For each block the ratio of its path: its own, fused with the smoothed one and with what is said of it."""
    sums: dict[tuple[int, float], np.ndarray] = {}
    for b, p in zip(every, said):
        s = sums.setdefault((b.element.path, p), np.zeros(4))
        s += (len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)
    # smoothed over the paths that may be content: furniture in between says nothing of its neighbours
    keys = [k for k in sums if k[1]]
    if not keys:
        return [0.0] * len(every)
    text, marks, linked, count = np.array([sums[k] for k in keys]).T
    own = np.maximum((text - linked) / count * np.log1p(marks + 1) * (1 - linked / text), 1e-9)
    padded = np.pad(own, 1, mode="edge")
    smooth = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    fused = dict(zip(keys, (np.sqrt(own * smooth) * [p for _, p in keys]).tolist()))
    return [fused.get((b.element.path, p), 0.0) for b, p in zip(every, said)]


def extract(html: str | None) -> str:
    """The main text, its blocks joined by an empty line; empty if there is none."""
    every = blocks(html or "")
    ratios = path_ratios(every, priors(every)) if every else []
    found = [b for b, r in zip(every, ratios) if r > 0]
    if not found:
        return ""
    values = np.array(list({b.element.path: r for b, r in zip(every, ratios) if r > 0}.values()))
    threshold = min(max(values.std() * 0.5, values.max() * 0.1), values.max())
    best = _content_element([b for b, r in zip(every, ratios) if r >= threshold])
    inside = [best.order <= b.element.order <= best.last for b in found]
    first = inside.index(True)
    start = _headed(found, first, best)
    return "\n\n".join(b.text for i, b in enumerate(found[start:], start) if i < first or inside[i])


def _content_element(passing: list[Block]) -> Element:
    """The lowest element around all passing blocks, and around the article and main elements that hold them."""
    held = [b.element.outer or b.element for b in passing]
    best, end = min(held, key=lambda e: e.order), max(e.order for e in held)
    while best.last < end:
        best = best.parent
    # a cell with blocks of its own is a column of the page's layout
    while best.parent is not None and best.tag in PARTS and not (best.tag == "td" and all(e is not best for e in held)):
        best = best.parent
    return best


def _headed(found: list[Block], first: int, best: Element) -> int:
    """Where the headings start that stand before the content element, with the lines between: beside it, in an
    element around both with no list of links between, or right before it."""
    start, around = first, best
    for i in range(first - 1, -1, -1):
        e = found[i].element
        while not around.order <= e.order <= around.last:
            around = around.parent
        within = around.tag not in ("", "html", "body") and (around is best.parent or found[i].linked * 2 <= len(found[i].text))
        if e.heading and (within or i == start - 1):
            start = i
        elif not within:
            break
    return start


TEXT = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])


@F.pandas_udf(TEXT)
def _extracted(pages: pd.Series) -> pd.DataFrame:
    texts = [extract(h) for h in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars, from the whole html; columns of these names are replaced.

    A null or empty page has an empty text. Broken markup is read as far as it goes: unclosed elements end
    with the page. Time and memory grow with a page's length alone, not with its depth. Rows are independent, so repeats, ties and empty tables need no care.
    """
    prepare(pages.sparkSession)
    out = pages.withColumn("__text", _extracted(F.col(html)))
    return out.withColumns({c: F.col(f"__text.{c}") for c in TEXT.names}).drop("__text")
