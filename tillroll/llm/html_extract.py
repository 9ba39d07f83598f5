"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Structure decides first: blocks in menus, headers, footers,
sidebars, notices, adverts, forms, comments and hidden parts are boilerplate; where a page has an article
container, blocks outside it are boilerplate too.

Pass one classifies every other block alone by length, link density and stop-word density: ``good``,
``bad`` or undecided (``short`` or ``near``). Inside an article container a block of enough text is good
unless it is mostly links, whatever its stop words, as the container says more than they do.

Pass two gives undecided blocks the label of their nearest decided neighbours: both sides alike decide;
otherwise a heading follows the next decided block, other blocks the nearer one (ties: good).
Neighbours are looked for among the blocks that structure left open. Without any they are good, and so are
``near`` blocks of a page without a good one.

The text of a block has its character references decoded and its white space turned into single blanks;
blocks are joined in page order by ``\\n``. Nothing is capped.

Defined results: a null or empty page has the empty text; unclosed tags, comments and scripts end with the
page; repeated rows are extracted alike; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.common import text_slices

# Thresholds of pass one.
SHORT_CHARS = 40          # shorter blocks are undecided
LONG_CHARS = 100          # blocks from here on may be good by themselves
LINKED, ALL_LINKED = 0.5, 0.9
STOP_HIGH, STOP_LOW = 0.25, 0.1

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object svg math select canvas audio video".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "section summary table tbody td tfoot th thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
CONTAINER = frozenset("article main".split())
# Words of class and id names, and roles, that mark boilerplate.
MARKS = frozenset(("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                   "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar "
                   "sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead header topbar footer footnav comment "
                   "comments commentlist respond reply replies disqus discussion share sharing social related recommended widget widgets pagination "
                   "pager toolbar skip copyright legal").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Frequent words of four languages.
STOP_WORDS = frozenset((
    "the of and to in a is that for it with as was on be by this are from or an at not have has but they you we he she "
    "de la le les et des en un une du que est pour dans qui par sur au pas avec il elle ce se ne plus "
    "der die das und zu den von mit sich auf für ist im dem nicht ein eine als auch es an werden aus "
    "el los las del por con para su al lo como y no una más").split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    linked: int       # characters inside links
    heading: bool
    fixed: bool       # boilerplate by structure
    inside: bool      # in an article container
    label: str = ""


def _boilerplate(name: str, attrs: str) -> bool:
    if not attrs or name in CONTAINER or name in ("html", "body"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id") and not MARKS.isdisjoint(w.lower() for w in _NAME.findall(value)):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _container(name: str, attrs: str) -> bool:
    return name in CONTAINER or bool(attrs) and bool(re.search(r"role=[\"']?main\b|articleBody", attrs))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # open elements: (name, boilerplate, container, link); the counts tell how many are open
    stack: list[tuple[str, bool, bool, bool]] = []
    bad = box = link = 0
    heading = False

    def flush() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, heading, bad > 0, box > 0))
        parts, linked = [], 0

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if not bad or not text.isspace():
                said = html.unescape(text) if "&" in text else text
                parts.append(said)
                if link:
                    linked += len("".join(said.split()))
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end = name.lower(), bool(m["end"] or m["end2"])
        attrs = (m["attrs"] or m["attrs2"] or "") if not end else ""
        if not end and name in RAW:
            if not attrs.endswith("/") or name not in ("svg", "math"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in BLOCK:
            flush()
            heading = name in HEADINGS and not end
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if end:
            if any(e[0] == name for e in stack):
                while True:
                    e = stack.pop()
                    bad, box, link = bad - e[1], box - e[2], link - e[3]
                    if e[0] == name:
                        break
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            e = stack.pop()
            bad, box, link = bad - e[1], box - e[2], link - e[3]
        # a header inside an article holds its title
        aside = name in ASIDE and not (name == "header" and box) or _boilerplate(name, attrs)
        e = (name, aside, _container(name, attrs) and not bad, name == "a")
        if not attrs.endswith("/") or name in BLOCK or name == "a":
            stack.append(e)
            bad, box, link = bad + e[1], box + e[2], link + e[3]
    flush()
    return out


def pass_one(b: Block, has_container: bool) -> str:
    if b.fixed or has_container and not b.inside:
        return "bad"
    size = len(b.text)
    share = b.linked / max(1, size - b.text.count(" "))
    if share > (ALL_LINKED if b.inside else LINKED):
        return "bad" if size >= SHORT_CHARS or b.linked and not b.inside else "short"
    if b.inside:
        return "good" if size >= SHORT_CHARS else "short"
    if size < SHORT_CHARS:
        return "short"
    ws = b.text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in ws) / len(ws)
    if stops >= STOP_HIGH and size >= LONG_CHARS:
        return "good"
    return "near" if stops >= STOP_LOW or size >= LONG_CHARS else "short"


def pass_two(found: list[Block]) -> None:
    decided = [(i, b.label) for i, b in enumerate(found) if b.label in ("good", "bad")]
    open_ = [i for i, b in enumerate(found) if b.label not in ("good", "bad")]
    k = 0
    for i in open_:
        while k < len(decided) and decided[k][0] < i:
            k += 1
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None or after is None:
            found[i].label = (before or after or (0, "good"))[1]
        elif before[1] == after[1]:
            found[i].label = before[1]
        elif found[i].heading:
            found[i].label = after[1]
        else:
            gap = (i - before[0]) - (after[0] - i)
            found[i].label = "good" if gap == 0 else before[1] if gap < 0 else after[1]


def extract(page: str | None) -> str:
    found = blocks(page or "")
    has_container = any(b.inside and not b.fixed for b in found)
    for b in found:
        b.label = pass_one(b, has_container)
    if not any(b.label == "good" for b in found):  # nothing certain: the text-like blocks are the best there are
        for b in found:
            b.label = "good" if b.label == "near" else b.label
    pass_two([b for b in found if not b.fixed and (b.inside or not has_container)])
    return "\n".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "html"):
            texts = [extract(t) for t in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
