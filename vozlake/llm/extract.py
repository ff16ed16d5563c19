"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags.  Pass one decides each block by its share of stop words,
its length and the share of its text inside links: long prose is good; linked text, and text in
navigation, notices, adverts, forms or comments, is bad; short blocks and medium prose stay open.
Inside an article blocks stay open whatever they link to, outside its navigation and other such parts.
Pass two gives an open block the label of its nearest decided neighbours: both agree, or the nearer one
counts; neighbours in the same article are asked first, and a tie inside an article is good.

Null and empty pages give an empty text.  Comments, scripts, styles and other raw elements are
skipped whole, also when they never end; unknown or unclosed tags do no harm.  Character references are
decoded, white space inside a block becomes one blank, and kept blocks are joined by line breaks.
Time grows with a page's length, however its tags are nested or left open.
Each page is read whole and on its own; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm.common import bounded_batches

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
MOST_LINKED = 0.33

#: Frequent function words.
STOP_WORDS = {
    "en": "the of and to in a is that it for on with as are was be by this at from or an not have has but they which you he his her their we one all there been if more when will would who what so no can were had do our about into than them its out up".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec aux ou son cette mais comme on tout nous sa ses été être elle deux leur si ces y aussi dont où fait même sans".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está nos".split(),
}
STOP_LISTS = {word: tuple(k for k, words in enumerate(STOP_WORDS.values()) if word in words) for words in STOP_WORDS.values() for word in words}

RAW = frozenset("script style noscript template iframe svg select textarea title audio video button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOUNDARIES = BLOCKS | {"br"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("nav footer aside form menu dialog head".split())
CONTENT = frozenset("article main".split())
ROOTS = frozenset("html body".split())
#: Parts of class, id and role names of what isn't the article, and of what may hold it.
BESIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
CONTENT_NAMES = frozenset("article body content entry main page post story text wrapper container".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*+"|'[^']*+')*+|[^<>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'/=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|\S+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    beside: bool
    article: int  # number of the article or main element it lies in, 0 for none
    label: str = ""


@dataclass
class Element:
    name: str
    beside: bool
    article: int


@dataclass
class Reader:
    """Cuts one page into blocks."""

    blocks: list[Block] = field(default_factory=list)
    open: list[Element] = field(default_factory=list)
    # Open elements by name: of the page, and of each article that is open inside.
    scopes: list[Counter] = field(default_factory=lambda: [Counter()])
    roots: Counter = field(default_factory=Counter)
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    tag: str = ""
    links: int = 0
    articles: int = 0
    breaks: int = 0

    def read(self, page: str) -> list[Block]:
        at, ends = 0, len(page)
        while at < ends:
            found = MARKUP.search(page, at)
            if not found:
                break
            self.say(page[at : found.start()])
            at = found.end()
            if found["name"]:
                at = self.meet(page, found["name"].lower(), bool(found["end"]), found["rest"], at)
        self.say(page[at:])
        self.close()
        return self.blocks

    def say(self, text: str) -> None:
        if text:
            self.pieces.append((text, self.links > 0))
            if not text.isspace():
                self.breaks = 0

    def meet(self, page: str, name: str, ends: bool, rest: str, at: int) -> int:
        """Take in a tag; returns where to read on."""
        if name in RAW and not ends:
            if rest.endswith("/") and name == "svg":
                return at
            over = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            return over.end() if over else len(page)
        if name == "a":
            self.links = 0 if ends else 1
        elif name == "br":
            self.pieces.append((" ", False))
            self.breaks += 1
            if self.breaks > 1:
                self.close()
        elif name in BLOCKS:
            self.close()
            if ends:
                self.leave(name)
            else:
                self.enter(name, rest)
        return at

    def enter(self, name: str, rest: str) -> None:
        self.tag = name
        if name in ("p", "li", "hr", *HEADINGS) and not rest:
            return  # holds no more blocks, and often isn't closed
        above = self.open[-1] if self.open else Element("", False, 0)
        if name in CONTENT:
            self.articles += not above.article
            self.push(Element(name, above.beside and bool(above.article), above.article or self.articles))
            return
        beside = above.beside or name in BESIDE or (name == "header" and not above.article) or named_beside(rest, name)
        self.push(Element(name, beside, above.article))

    def push(self, element: Element) -> None:
        self.open.append(element)
        if element.name in CONTENT:
            self.scopes.append(Counter())
        self.scopes[-1][element.name] += 1
        self.roots[element.name] += element.name in ROOTS

    def pop(self) -> str:
        name = self.open.pop().name
        self.scopes[-1][name] -= 1
        self.roots[name] -= name in ROOTS
        if name in CONTENT:
            self.scopes.pop()
        return name

    def leave(self, name: str) -> None:
        self.tag = ""
        # A stray end tag closes nothing, and no article.
        if (self.roots if name in ROOTS else self.scopes[-1])[name]:
            while self.pop() != name:
                pass

    def close(self) -> None:
        """End the present block."""
        if self.pieces:
            text = " ".join(html.unescape("".join(t for t, _ in self.pieces)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, inside in self.pieces if inside)
                above = self.open[-1] if self.open else Element("", False, 0)
                self.blocks.append(Block(text, linked, self.tag, above.beside, above.article))
            self.pieces.clear()
        self.breaks = self.links = 0


def named_beside(rest: str, name: str) -> bool:
    """Whether class, id or role name a part beside the article, or the element is hidden."""
    if not rest or name in ("html", "body"):
        return False
    names: set[str] = set()
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key in ("class", "id", "role"):
            names.update(part.lower() for part in NAME_PART.findall(value))
    return not names.isdisjoint(BESIDE_NAMES) and names.isdisjoint(CONTENT_NAMES)


def stop_share(text: str) -> float:
    """Share of stop words, by the list that fits best."""
    words = WORD.findall(text.lower())
    fits = [0] * len(STOP_WORDS)
    for lists in filter(None, map(STOP_LISTS.get, words)):
        for k in lists:
            fits[k] += 1
    return max(fits) / len(words) if words else 0.0


def first_pass(block: Block) -> str:
    n = len(block.text)
    if block.beside:
        return "bad"
    if block.article and (n < SHORT or block.linked > MOST_LINKED * n):
        return "open"  # a line of the article may well be a link
    if block.linked > MOST_LINKED * n:
        return "bad"
    if n < SHORT:
        return "bad" if "©" in block.text else "open"
    share = stop_share(block.text)
    if share >= STOP_HIGH:
        return "good" if n > LONG else "near"
    if share >= STOP_LOW:
        return "near"
    return "open" if block.article else "bad"


def decided_before(blocks: list[Block], first: list[str], order: range) -> list[tuple[int, str] | None]:
    """For each block the last decided one in this order: of its own article without what is beside it, or of the page."""
    found: list[tuple[int, str] | None] = [None] * len(blocks)
    on_page = in_article = None
    article = 0
    for k in order:
        block = blocks[k]
        if block.article != article:
            article, in_article = block.article, None
        found[k] = in_article if article else on_page
        if first[k] in ("good", "bad"):
            on_page = (k, first[k])
            in_article = in_article if block.beside else on_page
    return found


def second_pass(blocks: list[Block]) -> None:
    """Decide the open blocks from the labels of the first pass."""
    first = [block.label for block in blocks]
    before = decided_before(blocks, first, range(len(blocks)))
    after = decided_before(blocks, first, range(len(blocks) - 1, -1, -1))
    for k, block in enumerate(blocks):
        if first[k] in ("good", "bad"):
            continue
        sides = [(abs(k - at), label) for at, label in filter(None, (before[k], after[k]))]
        labels = {label for _, label in sides}
        if not labels:
            block.label = "good" if block.article or first[k] == "near" else "bad"
        elif len(labels) == 1:
            block.label = labels.pop()
        elif first[k] == "near":
            block.label = "good"
        else:
            (steps, label), (other, _) = sorted(sides)
            block.label = label if steps < other else "good" if block.tag in HEADINGS or block.article else "bad"


def labelled(page: str | None) -> list[Block]:
    """All blocks of a page, good or bad."""
    blocks = Reader().read(page or "")
    for block in blocks:
        block.label = first_pass(block)
    second_pass(blocks)
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(block.text for block in labelled(page) if block.label == "good")


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each whole page."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, _main_text(F.col(f"`{page}`")))


def digest(pages: DataFrame) -> DataFrame:
    rows = extract(pages.select("page_id", "url", F.col("html").alias("body")), "body", "text")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
