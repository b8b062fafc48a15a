"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags; what stands in scripts, styles, forms and other elements that
never hold article text is left out. First pass: each block is decided by its length, link density and
density of function words; where it stands (article, menu, header, footer, sidebar, advert, notice,
comment) shifts how much of these it must show. Classes that name a sidebar, advert or the like are a hint only: an article or
main element inside such an element is judged as an article, and if a page has no good block elsewhere, all
blocks under such hints are judged as if they had none. Second pass: blocks too short to decide
take the label of their nearest decided neighbours; where the two disagree, the nearer one's, and on a tie the place decides. So do
long blocks of an article without function words (tables, code, other languages). Menus are no neighbours to an article's blocks.
Blocks labelled good are the main text, in page order.

Character references are decoded, white space inside a block becomes one space, ends are trimmed, blocks are joined by
two line feeds. Nothing else is dropped or capped.

Defined results: a null or empty html gives an empty text; markup that is not closed ends with the page; a page without
any good block gives an empty text; a null page_id or url stays null; repeated rows are returned each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

#: Elements by what they do to text.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas title".split())
DROPPED = frozenset("head form button select option audio video map dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MENUS = frozenset("nav menu header footer aside".split())
BODIES = frozenset("article main".split())
#: Words of class, id and role that name what is not article text.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverti[sz]ement|banner|promo\w*|sponsor\w*|sidebar|side-bar|aside|menu\w*|nav\w*|breadcrumbs?|footer|foot|masthead|header|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|search|pagination|pager|skip|copyright|legal|disclaimer|contentinfo|navigation|complementary|dialog)(?:$|[\s_-])",
    re.I,
)
#: Words of class and id that name the article itself.
BODY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-]|body|content|text)", re.I)
#: Frequent function words of English, French, German and Spanish.
STOP = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more most no
    not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais même ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur
    al algo como con cuando del donde el ella ellos era es esta este esto fue ha hay la las lo los más me mi muy ni nos o para pero por porque se ser si sin sobre su sus también te tiene todo una uno unos y ya""".split()
)
#: Blocks of fewer characters are ambiguous unless their links or their place decide.
SHORT, LINKED, STOPPED = 70, 0.5, 0.08
#: The same inside an article: more links, fewer function words.
BODY_LINKED, BODY_STOPPED = 0.8, 0.04

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*)(?:>|$)", re.S)
_MARK = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _plain(parts: list[str]) -> str:
    """Character references decoded, white space to one space, ends trimmed."""
    return " ".join(html.unescape("".join(parts)).split())


#: HINTED: a menu by class, id or role alone.
IN_BODY, NEUTRAL, HINTED, IN_MENU = 1, 0, -1, -2


@dataclass
class Block:
    """Text of one block, how much of it is in links, where it stands, and its label (None: undecided)."""

    place: int
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    good: bool | None = None


@dataclass
class _Open:
    tag: str
    place: int
    dropped: bool


def _place(tag: str, attributes: str, outer: _Open) -> tuple[int, bool]:
    """Where an element's text stands, and whether it is left out."""
    if tag in DROPPED or _HIDDEN.search(attributes):
        return IN_MENU, True
    place = outer.place
    marks = " ".join(b or c or d for _, b, c, d in _MARK.findall(attributes)) if "=" in attributes else ""
    if tag in ("body", "html"):
        return place, outer.dropped
    if tag in BODIES and place != IN_MENU and not (marks and ASIDE.search(marks)):
        place = IN_BODY
    elif tag in MENUS:
        place = IN_MENU
    elif marks and place != IN_MENU and ASIDE.search(marks):
        place = HINTED
    elif marks and place == NEUTRAL and BODY.search(marks):
        place = IN_BODY
    return place, outer.dropped


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    stack = [_Open("", NEUTRAL, False)]
    out = [Block(NEUTRAL)]
    links, at, end, broken = 0, 0, len(page), -1

    def text(piece: str) -> None:
        if piece and not stack[-1].dropped:
            if out[-1].place != stack[-1].place:
                out.append(Block(stack[-1].place))
            out[-1].parts.append(piece)
            if links:
                out[-1].linked.append(piece)

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag, closing, attributes = token[2].lower(), bool(token[1]), token[3] or ""
        if tag == "br":  # one is white space, a second one parts blocks
            if broken >= 0 and not page[broken : token.start()].strip():
                out.append(Block(stack[-1].place))
            else:
                text(" ")
            broken = at
            continue
        if tag in BLOCKS:
            out.append(Block(stack[-1].place))
        if tag == "a":
            links = 0 if closing else 1
        elif tag in RAW and not closing:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag in VOID:
            continue
        elif closing:
            if any(x.tag == tag for x in stack[1:]):
                while stack.pop().tag != tag:
                    pass
        elif not attributes.endswith("/") or tag in BLOCKS:
            if tag in ("p", "li") and stack[-1].tag == tag:
                stack.pop()
            place, dropped = _place(tag, attributes, stack[-1])
            stack.append(_Open(tag, place, dropped))
        if tag in BLOCKS:
            out[-1].place = stack[-1].place
    for block in out:
        block.text = _plain(block.parts)
    return [b for b in out if b.text]


def _first_pass(block: Block) -> None:
    """Label a block by length, link density and density of function words; ambiguous ones stay undecided."""
    size = len(block.text)
    linked = len(_plain(block.linked))
    inside = block.place == IN_BODY
    if block.place in (HINTED, IN_MENU):
        block.good = False
    elif linked > (BODY_LINKED if inside else LINKED) * size:
        block.good = None if inside and size < SHORT else False
    elif size < SHORT:
        block.good = None
    else:
        words = block.text.lower().split(" ")
        dense = sum(w.strip(".,;:!?\"'()") in STOP for w in words) >= (BODY_STOPPED if inside else STOPPED) * len(words)
        block.good = dense or (None if inside else False)


def _second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours of the first pass."""
    labels = [b.good for b in blocks]
    _inherit(blocks, labels, [i for i, b in enumerate(blocks) if labels[i] is not None], False)
    _inherit(blocks, labels, [i for i, b in enumerate(blocks) if labels[i] is not None and b.place in (IN_BODY, NEUTRAL)], True)


def _inherit(blocks: list[Block], labels: list[bool | None], decided: list[int], inside: bool) -> None:
    k = 0
    for i, block in enumerate(blocks):
        while k < len(decided) and decided[k] < i:
            k += 1
        if labels[i] is not None or (block.place == IN_BODY) != inside:
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if before is None and after is None:
            block.good = inside
        elif before is None or after is None:
            block.good = labels[after if before is None else before]
        elif labels[before] == labels[after] or i - before != after - i:
            block.good = labels[before if i - before <= after - i else after]
        else:
            block.good = inside


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    for released in (False, True):
        for block in blocks:
            if released and block.place == HINTED:
                block.place = NEUTRAL
            _first_pass(block)
        _second_pass(blocks)
        if any(b.good for b in blocks):
            break
    return "\n\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    only = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return only.mapInArrow(run, "page_id long, url string, text string, n_chars long")
