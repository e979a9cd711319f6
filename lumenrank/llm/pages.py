"""Operator 13, main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides
every block on its own: by link density, by length and by the share of stop
words, and by what the markup says of its container (navigation, footer,
aside, form, a class or id that names an advert, a notice, comments ...). What
is too short, or has too few stop words, to be decided alone is left open. The
second pass lets open blocks inherit the label of their nearest decided
neighbours. Inside ``article`` or ``main`` the markup already speaks for a
block, so there only its links or its container can speak against it.

Where the blocks so judged share next to no word with the stop-word list
(another language, another script), density says nothing and length decides. If
the containers leave nothing of a page, it is read again without them.

Row-wise in Arrow batches inside the tasks, linear in the length of a page:
no shuffle, nothing on the driver.

Defined results: a null, empty or blank page has an empty text. Rows with the
same id are extracted independently, one row each; null ids and addresses are
carried. Text outside all blocks is a block of its own; unclosed tags end
with their container. An empty table gives an empty result. Other columns of
the table are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.quality import STOP_WORDS
from lumenrank.llm.registry import query

# Element names of the HTML standard.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
BOILER = frozenset(
    "nav footer aside form menu dialog noscript template svg math object canvas audio video select button fieldset "
    "datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "td": "tr table", "th": "tr table", "tr": "table tbody thead tfoot"}
BOILER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# Words of class and id names that tell what a container holds.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus dialog footer footnav form gdpr header legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos "
    "promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toc toolbar topbar widget widgets".split()
)
NEGATIONS = frozenset("has is no not with without".split())
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


class Limits(NamedTuple):
    """Where the block rules cut; lengths in characters."""

    links: float = 0.2  # share of characters inside links that speaks against a block
    links_inside: float = 0.6  # the same inside article or main
    short: int = 70  # shorter blocks are left open
    long: int = 200  # blocks that may be good by themselves
    stop_low: float = 0.15  # share of stop words below which a block is bad
    stop_high: float = 0.22  # and from which it is good
    page_stop: float = 0.03  # of all blocks judged by words; below, stop words decide nothing


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    inside: bool  # of article or main
    boiler: bool  # of a container that is not part of the text
    heading: bool


class _Open(NamedTuple):
    """State below a start tag."""

    name: str
    boiler: bool = False
    inside: bool = False
    link: bool = False
    form: bool = False
    heading: bool = False
    header: bool = False


def names_boiler(value: str) -> bool:
    """Whether a class or id attribute names something beside the text."""
    for name in value.split():
        parts = [x.lower() for x in _CLASS_WORD.findall(name)]
        if parts and parts[0] not in NEGATIONS and not BOILER_NAMES.isdisjoint(parts):
            return True
    return False


def _attributes(html: str, at: int, lost: set[str]) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` and the place after the tag's ``>``; ``lost`` remembers quotes that never close."""
    found: dict[str, str] = {}
    n = len(html)
    while at < n:
        m = _ATTRIBUTE.match(html, at)
        if not m:
            end = html.find(">", at)
            return found, n if end < 0 else end + 1
        name, at = m[1].lower(), m.end()
        value = ""
        if m[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote not in lost:
                end = html.find(quote, at + 1)
                if end < 0:
                    lost.add(quote)
                else:
                    value, at = html[at + 1 : end], end + 1
                    found.setdefault(name, value)
                    continue
            m = _BARE.match(html, at)
            value, at = m[0], m.end()
        found.setdefault(name, value)
    return found, n


def _opened(name: str, attributes: dict[str, str], top: _Open) -> _Open:
    boiler, inside, form = top.boiler, top.inside, top.form
    role = attributes.get("role", "").lower()
    hints = "" if name in ("html", "body", "main") else f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if name in ("article", "main") or role == "main":
        inside = True
        if form and boiler:  # a form around the whole page
            boiler = form = False
    if (
        name in BOILER
        or (name == "header" and not top.inside)
        or role in BOILER_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or ("style" in attributes and _HIDDEN.search(attributes["style"]))
        or (hints != " " and hints and names_boiler(unescape(hints)))
    ):
        form = not boiler and name == "form"
        boiler = True
    heading, header = top.heading or name in HEADINGS, top.header or name == "header"
    return _Open(name, boiler, inside, top.link or name == "a", form, heading, header)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in its order, those without text left out."""
    found: list[Block] = []
    stack, open_names = [_Open("")], Counter()
    state = stack[0]  # of the block being read
    parts: list[str] = []
    linked = breaks = 0
    lost: set[str] = set()

    def flush() -> None:
        nonlocal parts, linked, breaks
        if parts:
            boiler = state.boiler or (state.header and not state.heading)
            found.append(Block(" ".join("".join(parts).split()), linked, state.inside, boiler, state.heading))
            parts, linked = [], 0
        breaks = 0

    def say(raw: str) -> None:
        nonlocal linked, state, breaks
        text = unescape(raw) if "&" in raw else raw
        if text.isspace() or not text:
            if parts:
                parts.append(" ")
            return
        if not parts:
            state = stack[-1]
        if stack[-1].link:
            linked += len("".join(text.split()))
        parts.append(text)
        breaks = 0

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        name = m[0].lower()
        attributes, at = _attributes(html, m.end(), lost)
        if name == "br":
            if parts:
                parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name not in INLINE:
            flush()
        if closing:
            _close(stack, open_names, name)
            continue
        if name in RAW:
            at = _after_raw(html, at, name)
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            _imply_ends(stack, open_names, name)
        elif name == "a":
            _close(stack, open_names, "a")
        stack.append(_opened(name, attributes, stack[-1]))
        open_names[name] += 1
    flush()
    return found


def _after_raw(html: str, at: int, name: str) -> int:
    """The place behind the end tag of an element whose content is no markup."""
    m = _RAW_END[name].search(html, at)
    if not m:
        return len(html)
    end = html.find(">", m.end())
    return len(html) if end < 0 else end + 1


_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def _cut(stack: list[_Open], open_names: Counter, at: int) -> None:
    for x in stack[at:]:
        open_names[x.name] -= 1
    del stack[at:]


def _close(stack: list[_Open], open_names: Counter, name: str) -> None:
    """An end tag: an inline one reaches no further than its block, any other closes what it holds."""
    if not open_names[name]:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            _cut(stack, open_names, k)
            return
        if name in INLINE and stack[k].name not in INLINE:
            return


def _imply_ends(stack: list[_Open], open_names: Counter, name: str) -> None:
    """A block's start tag ends an open paragraph, and an item the item before it."""
    limits = CELLS.get(name, "").split()
    if not (open_names["p"] or limits and open_names[name]):
        return
    for k in range(len(stack) - 1, 0, -1):
        own = stack[k].name
        if own == "p" or own == name and limits:
            _cut(stack, open_names, k)
            if own == name:
                return
        elif own in limits or (own not in INLINE and not limits):
            return


def stop_share(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    """(stop words, words) of a text; a word is a run of letters."""
    words = _LETTERS.findall(text.lower())
    return sum(map(stop_words.__contains__, words)), len(words)


GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


def first_pass(found: list[Block], stop_words: frozenset[str], limits: Limits, containers: bool = True) -> list[str]:
    """A label for every block on its own; ``NEAR`` and ``SHORT`` are open."""
    open_ = [not (containers and (b.boiler or b.inside)) for b in found]
    shares = [stop_share(b.text, stop_words) if o else (0, 0) for b, o in zip(found, open_)]
    hits, words = (sum(x) for x in zip(*shares)) if shares else (0, 0)
    judged = hits >= limits.page_stop * words
    labels = []
    for b, (own, n) in zip(found, shares):
        size = len(b.text)
        links = b.linked / max(1, len(b.text.replace(" ", "")))
        if containers and b.boiler:
            label = BAD
        elif containers and b.inside:
            label = BAD if links > limits.links_inside else SHORT if links > limits.links else GOOD
        elif links > limits.links or "©" in b.text:
            label = BAD
        elif size < limits.short:
            label = BAD if b.linked else SHORT
        elif judged and own < limits.stop_low * n:
            label = BAD
        elif size > limits.long and (not judged or own >= limits.stop_high * n):
            label = GOOD
        else:
            label = NEAR
        labels.append(label)
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether a block is part of the text; open ones go by their nearest decided neighbours.

    A nearly good block needs one good neighbour, a short one two. A heading
    belongs to what follows it. Nearly good blocks count as decided for the
    short ones once they are.
    """
    labels = list(labels)
    for open_ in (NEAR, SHORT):
        decided = [x if x in (GOOD, BAD) else None for x in labels]
        before, last = [], None
        for x in decided:
            before.append(last)
            last = x or last
        after, last = [], None
        for x in reversed(decided):
            after.append(last)
            last = x or last
        after.reverse()
        for k, x in enumerate(labels):
            if x == open_:
                around = (before[k] == GOOD) + (after[k] == GOOD)
                good = after[k] == GOOD if found[k].heading else around >= (1 if open_ == NEAR else 2)
                labels[k] = GOOD if good else BAD
    return [x == GOOD for x in labels]


def main_text(html: str | None, stop_words: Iterable[str] = STOP_WORDS, limits: Limits = Limits()) -> str:
    """The text of a page, one line per block."""
    found = blocks(html or "")
    words = stop_words if isinstance(stop_words, frozenset) else frozenset(stop_words)
    for containers in (True, False):
        kept = second_pass(found, first_pass(found, words, limits, containers))
        if any(kept):
            return "\n".join(b.text for b, keep in zip(found, kept) if keep)
    return ""


def extract_text(
    pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
    stop_words: Iterable[str] = STOP_WORDS, limits: Limits = Limits(),
) -> DataFrame:
    """The columns of ``keep`` and ``text``, the main text of each page."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructType

    words = frozenset(stop_words)
    kept = pages.select(*keep).schema
    schema = StructType(list(kept.fields)).add("text", StringType())

    def run(batches):
        for batch in batches:
            source = batch.column(len(kept))
            text = pa.array([main_text(source[i].as_py(), words, limits) for i in range(len(source))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text], names=[*kept.names, "text"])

    return pages.select(*keep, F.col(html).cast("string")).mapInArrow(run, schema)


@query()
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
