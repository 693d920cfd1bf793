"""Main text of web pages from flat text blocks and a decision tree.

Method: the html is read as a flat list of text blocks (text between block
tags).  A block has its number of words, its link density (share of words
inside links), the same of the block before and after it, whether it is a
heading, and the zone of its innermost marked container: article (1), unmarked
(0), a container named like furniture (-1; a form, a header or a word of its
class, id or role), or a nav, footer, aside, menu, dialog or hidden element
(-2); and the number of words outside links that the page has in higher zones.
Where these are few, the words and link densities of the block and its
neighbours decide in zones 0 and -1.
A decision tree (Gini splits) trained on the small labelled table EXAMPLES
keeps or drops each block; no block is judged by its words alone.

Scripts, styles, other raw-text elements, comments and controls are never
text.  Character references are decoded, white space inside a block becomes
one blank, blocks are joined by an empty line.

Edge cases: null or empty html gives an empty text; html that breaks off, has
unclosed or stray tags, or no tags at all is read as far as it goes; nothing
is cut or capped.  Time and memory are linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: html's block, raw-text and void elements
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object "
                     "select button canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the main text.
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
#: Elements and words of class, id or role that mark page furniture or the article.
FURNITURE_TAGS = frozenset("nav footer aside form menu header dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense adbox sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs footer header masthead sidebar side aside widget cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search share "
    "sharing social related recommended recommendations comment comments commentlist reply replies respond disqus "
    "responses feedback guestbook discussion toolbar pagination pager tags copyright legal disclaimer complementary "
    "contentinfo skip warning announcement message toast paywall promoted commercial cta adslot adunit sidenav rail".split())
ARTICLE_WORDS = frozenset("article articlebody content main post entry story maincontent".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
MARK_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """One flat text block."""
    text: str
    words: int
    link_density: float
    zone: int
    heading: bool


class _Reader:
    """Collects blocks while the tags go by."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, zone inside, whether it may close by itself
        self.depth: Counter[str] = Counter()  # open elements of each tag
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.links = 0
        self.hidden = 0
        self.heading = False
        self.zone = 0

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            self.parts.append(raw)
            if self.links:
                self.linked.append(raw)

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                n = len(text.split())
                inside = len(html.unescape(" ".join(self.linked)).split()) if self.linked else 0
                self.blocks.append(Block(text, n, min(1.0, inside / n), self.zone, self.heading))
            self.parts, self.linked = [], []

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            self.links = 0
            while self.open and self.open[-1][2] and tag not in ("html", "body"):
                self._close()  # an unclosed p or li with a mark ends at the next block
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links = 1
        if tag in HEADINGS:
            self.heading = True
        zone, hide = self._zone(tag, attributes)
        if tag in VOID_TAGS:
            return
        if tag in BLOCK_TAGS and tag not in ("p", "li", "td", "tr", "th", "dd", "dt", *HEADINGS) or zone != self.zone or hide:
            self.open.append((tag, self.zone, tag in ("p", "li", "dd", "dt")))
            self.depth[tag] += 1
            if hide:
                zone = -2
            if zone != self.zone and tag not in BLOCK_TAGS:
                self.flush()
            self.zone = zone

    def _zone(self, tag: str, attributes: str) -> tuple[int, bool]:
        words: set[str] = set()
        hide = False
        if attributes.strip(" /"):
            for m in ATTRIBUTE.finditer(attributes):
                name = m.group(1).lower()
                value = m.group(2) or m.group(3) or m.group(4) or ""
                if name in ("class", "id", "role"):
                    words.update(w.lower() for w in MARK_WORD.findall(value))
                    words.update(w.lower() for w in re.split(r"[^A-Za-z]+", value))
                elif name == "hidden" or name == "aria-hidden" and value == "true" or (
                        name == "style" and re.search(r"display\s*:\s*none", value)):
                    hide = True
        marks = words & FURNITURE_WORDS
        if marks == {"header"} and words & ARTICLE_WORDS:
            marks = set()  # the head of the article, not of the site
        furniture = tag in FURNITURE_TAGS or bool(marks)
        article = tag in ARTICLE_TAGS or bool(words & ARTICLE_WORDS)
        if tag in ("html", "body", *HEADINGS):
            return self.zone, hide
        if tag in ARTICLE_TAGS and not marks:
            furniture = False
        if tag == "header" and self.zone == 1 and not marks:
            return 1, hide  # the article's own head: its title
        if self.zone < 0:
            # furniture stays furniture, but a form or a head around the article does not swallow it
            loose = all(t not in ("nav", "footer", "aside") for t, z, _ in self.open) and tag in ARTICLE_TAGS
            inside = any(z == 1 for _, z, _ in self.open)
            if loose and not furniture and not inside:
                return 1, hide
            return (-2 if tag in ASIDE_TAGS else self.zone), hide
        return (-2 if tag in ASIDE_TAGS else -1 if furniture else 1 if article else self.zone), hide

    def _close(self) -> None:
        tag, zone, _ = self.open.pop()
        self.depth[tag] -= 1
        if zone != self.zone:
            self.flush()
        self.zone = zone

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "a":
            self.links = 0
        if tag in HEADINGS:
            self.heading = False
        if self.depth[tag]:
            while self.open[-1][0] != tag:
                self._close()
            self._close()


def blocks_of(page: str | None) -> list[Block]:
    """Flat text blocks of a page in order."""
    page = page or ""
    reader = _Reader()
    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            reader.text(page[pos:])
            break
        reader.text(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        m = TAG.match(page, at) or LOOSE_TAG.match(page, at)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[at:at + 3]) and page.find(">", at) < 0:
                break  # a tag that breaks off
            reader.text("<")
            pos = at + 1
            continue
        tag, pos = m.group(2).lower(), m.end()
        if m.group(1):
            reader.end(tag)
        elif tag in RAW_TAGS:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
        else:
            reader.begin(tag, m.group(3))
    reader.flush()
    return reader.blocks


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "zone", "words_in_higher_zones", "heading"]


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    plain = {z: sum(b.words * (1 - b.link_density) for b in blocks if b.zone > z) for z in (-2, -1, 0, 1)}
    edge = Block("", 0, 0.0, 0, False)
    rows = []
    for before, b, after in zip([edge, *blocks[:-1]], blocks, [*blocks[1:], edge]):
        rows.append([b.words, b.link_density, before.words, before.link_density, after.words, after.link_density,
                     b.zone, plain[b.zone], float(b.heading)])
    return np.array(rows, float).reshape(-1, len(FEATURES))


#: Labelled blocks: the FEATURES in order, then 1 for main text and 0 for the rest.
EXAMPLES = [
    # page furniture by its container, short and long, with and without links
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 150, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 150, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, -1, 150, 0, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, -1, 150, 0, 0), (60, 0.0, 30, 0.0, 45, 0.0, -1, 150, 0, 0), (25, 0.2, 50, 0.0, 0, 0.0, -1, 150, 0, 0),
    (4, 0.0, 80, 0.0, 20, 0.0, -1, 150, 1, 0), (35, 0.0, 4, 0.0, 6, 1.0, -1, 150, 0, 0), (9, 0.0, 120, 0.0, 0, 0.0, -1, 150, 0, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, -1, 150, 0, 0), (18, 0.0, 2, 1.0, 60, 0.0, -1, 150, 0, 0), (70, 0.1, 6, 0.0, 5, 0.5, -1, 150, 0, 0),
    (5, 0.0, 40, 0.0, 4, 1.0, -1, 150, 1, 0), (90, 0.0, 70, 0.0, 80, 0.0, -1, 150, 0, 0), (14, 0.5, 90, 0.0, 0, 0.0, -1, 150, 0, 0),
    # text of a marked article: titles, short and long paragraphs, paragraphs with links
    (8, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1, 1), (9, 0.0, 6, 1.0, 40, 0.0, 1, 0, 1, 1), (1, 0.0, 30, 0.0, 50, 0.0, 1, 0, 0, 1),
    (2, 0.0, 1, 0.0, 3, 0.0, 1, 0, 0, 1), (60, 0.0, 8, 0.0, 70, 0.0, 1, 0, 0, 1), (200, 0.0, 60, 0.0, 10, 0.0, 1, 0, 0, 1),
    (40, 0.2, 30, 0.0, 35, 0.1, 1, 0, 0, 1), (12, 0.6, 40, 0.0, 60, 0.0, 1, 0, 0, 1), (5, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1),
    (7, 0.0, 90, 0.0, 9, 0.0, 1, 0, 0, 1), (3, 0.0, 60, 0.0, 4, 1.0, 1, 0, 1, 1), (6, 1.0, 3, 0.0, 30, 0.0, 1, 0, 1, 1),
    (4, 0.0, 3, 1.0, 2, 0.0, 1, 0, 0, 1), (30, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1),
    (2, 0.0, 17, 0.0, 1, 1.0, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0, 1), (6, 0.0, 1, 1.0, 3, 1.0, 1, 0, 0, 1),
    (3, 0.0, 4, 1.0, 5, 1.0, 1, 0, 1, 1), (25, 0.0, 4, 1.0, 5, 1.0, 1, 0, 0, 1), (2, 0.0, 5, 1.0, 0, 0.0, 1, 0, 0, 1),
    # lists of links inside the article's container
    (4, 1.0, 5, 1.0, 6, 1.0, 1, 0, 0, 0), (3, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0), (7, 1.0, 6, 1.0, 5, 1.0, 1, 0, 0, 0),
    (4, 1.0, 30, 0.0, 5, 1.0, 1, 0, 0, 0), (3, 1.0, 60, 0.0, 2, 1.0, 1, 0, 0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 1, 0, 0, 0),
    # a link between paragraphs
    (2, 1.0, 20, 0.1, 17, 0.0, 1, 0, 0, 1), (3, 1.0, 15, 0.0, 12, 0.0, 1, 0, 0, 1), (2, 1.0, 90, 0.0, 1, 0.0, 1, 0, 0, 1),
    (1, 1.0, 2, 0.0, 30, 0.0, 1, 0, 0, 1),
    # unmarked blocks of a page that marks its article
    (6, 0.0, 3, 1.0, 9, 0.0, 0, 150, 0, 0), (30, 0.0, 5, 0.0, 60, 0.0, 0, 150, 0, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 150, 0, 0),
    (15, 0.1, 80, 0.0, 10, 0.0, 0, 150, 0, 0), (5, 0.0, 1, 0.0, 7, 0.0, 0, 150, 1, 0),
    # pages that mark no article: long runs of text, titles before text, short ones between text
    (60, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.0, 50, 0.0, 40, 0.1, 0, 0, 0, 1), (25, 0.05, 30, 0.0, 28, 0.0, 0, 0, 0, 1),
    (18, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (120, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (35, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1, 1), (9, 0.0, 0, 0.0, 35, 0.0, 0, 0, 1, 1), (4, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1),
    (6, 0.0, 30, 0.0, 45, 0.0, 0, 0, 0, 1), (3, 0.0, 25, 0.0, 20, 0.0, 0, 0, 1, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    # and their furniture
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (5, 0.8, 3, 1.0, 40, 0.0, 0, 0, 0, 0),
    (10, 0.7, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (30, 0.8, 50, 0.0, 6, 0.9, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (6, 0.5, 5, 1.0, 0, 0.0, 0, 0, 0, 0),
    # long unmarked text, its titles and short paragraphs where the marked containers hold a few words only
    (300, 0.0, 3, 0.0, 0, 0.0, 0, 3, 0, 1), (120, 0.05, 2, 0.0, 80, 0.0, 0, 8, 0, 1), (45, 0.0, 120, 0.0, 60, 0.0, 0, 2, 0, 1),
    (8, 0.0, 3, 0.0, 150, 0.0, 0, 3, 1, 1), (6, 0.0, 60, 0.0, 70, 0.0, 0, 10, 0, 1), (60, 0.2, 30, 0.0, 4, 1.0, 0, 10, 0, 1),
    (2, 1.0, 1, 1.0, 8, 0.0, 0, 3, 0, 0), (30, 0.8, 5, 1.0, 4, 1.0, 0, 8, 0, 0), (3, 0.0, 2, 1.0, 3, 1.0, 0, 5, 0, 0),
    (1, 0.0, 20, 0.0, 9, 0.0, 0, 0, 0, 1), (20, 0.0, 2, 0.0, 19, 0.0, 0, 0, 0, 1), (3, 0.0, 1, 1.0, 20, 0.0, 0, 2, 1, 1),
    (19, 0.0, 2, 0.0, 38, 0.0, 0, 0, 0, 1), (2, 0.0, 1, 1.0, 19, 0.0, 0, 0, 1, 1), (38, 0.0, 19, 0.0, 0, 0.0, 0, 0, 0, 1),
    (19, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 1), (15, 0.0, 8, 0.0, 2, 0.0, 0, 0, 0, 1), (9, 0.0, 12, 0.0, 14, 0.0, 0, 3, 0, 1),
    (17, 0.0, 0, 0.0, 3, 0.0, 0, 2, 0, 1), (20, 0.0, 18, 0.0, 7, 0.0, 0, 1, 0, 1), (6, 0.0, 16, 0.0, 0, 0.0, 0, 4, 0, 1),
    # and where they hold the text
    (3, 0.0, 19, 0.0, 0, 0.0, 0, 19, 0, 0), (6, 0.0, 15, 0.0, 0, 0.0, 0, 15, 0, 0), (4, 0.0, 0, 0.0, 2, 0.0, 0, 23, 0, 0),
    (12, 0.0, 3, 0.0, 8, 1.0, 0, 18, 0, 0), (2, 0.0, 0, 0.0, 15, 0.0, 0, 17, 1, 0),
    (80, 0.0, 10, 0.0, 6, 0.0, 0, 400, 0, 0), (120, 0.0, 4, 1.0, 50, 0.0, 0, 300, 0, 0), (30, 0.0, 60, 0.0, 9, 0.0, 0, 40, 0, 0),
    # text in a container named like furniture, with little outside it: an article or short notes
    (300, 0.0, 0, 0.0, 0, 0.0, -1, 0, 0, 1), (80, 0.0, 8, 0.0, 70, 0.0, -1, 0, 0, 1), (60, 0.1, 75, 0.0, 40, 0.0, -1, 4, 0, 1),
    (45, 0.0, 90, 0.0, 5, 1.0, -1, 10, 0, 1), (40, 0.0, 3, 1.0, 2, 1.0, -1, 0, 0, 1), (8, 0.0, 0, 0.0, 80, 0.0, -1, 0, 1, 1),
    (6, 0.0, 3, 1.0, 50, 0.0, -1, 0, 1, 1), (5, 0.0, 60, 0.0, 70, 0.0, -1, 3, 0, 1), (4, 0.0, 50, 0.0, 45, 0.0, -1, 0, 0, 1),
    (12, 0.0, 1, 1.0, 8, 0.0, -1, 10, 0, 0), (15, 0.0, 10, 0.0, 0, 0.0, -1, 3, 0, 0), (18, 0.0, 2, 1.0, 1, 0.0, -1, 1, 0, 0),
    (20, 0.0, 0, 0.0, 12, 0.0, -1, 0, 0, 0), (4, 0.0, 0, 0.0, 0, 0.0, -1, 0, 0, 0), (16, 0.0, 18, 0.0, 3, 0.0, -1, 8, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, -1, 0, 0, 0), (4, 1.0, 80, 0.0, 2, 1.0, -1, 0, 0, 0),
    (2, 0.0, 0, 0.0, 80, 0.0, -1, 0, 1, 1), (3, 0.0, 1, 1.0, 60, 0.0, -1, 0, 1, 1), (1, 0.0, 60, 0.0, 70, 0.0, -1, 0, 0, 1),
    (2, 0.0, 1, 1.0, 45, 0.0, -1, 9, 1, 1), (8, 0.0, 0, 0.0, 80, 0.0, -1, 10, 1, 1), (60, 0.0, 8, 0.0, 70, 0.0, -1, 10, 0, 1),
    (4, 0.0, 50, 0.0, 60, 0.0, -1, 9, 0, 1), (120, 0.0, 3, 1.0, 0, 0.0, -1, 8, 0, 1), (35, 0.1, 8, 0.0, 45, 0.0, -1, 7, 0, 1),
    (50, 0.0, 40, 0.0, 3, 0.0, -1, 6, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, -1, 9, 0, 1), (2, 0.0, 90, 0.0, 40, 0.0, -1, 5, 1, 1),
    (20, 0.0, 90, 0.0, 0, 0.0, -1, 0, 0, 1), (14, 0.0, 60, 0.0, 1, 1.0, -1, 0, 0, 1), (10, 0.0, 120, 0.0, 8, 0.0, -1, 4, 0, 1),
    (3, 0.0, 45, 0.0, 2, 1.0, -1, 2, 0, 1),
    (1, 1.0, 1, 1.0, 40, 0.0, -1, 0, 0, 0), (2, 1.0, 2, 1.0, 80, 0.0, -1, 9, 0, 0), (5, 1.0, 90, 0.0, 6, 1.0, -1, 9, 0, 0),
    (2, 0.0, 0, 0.0, 3, 0.0, -1, 23, 0, 0), (17, 0.0, 0, 0.0, 3, 0.0, -1, 23, 0, 0), (14, 0.0, 1, 0.0, 0, 0.0, -1, 1, 0, 0),
    (13, 0.0, 3, 0.0, 20, 0.0, -1, 20, 0, 0), (11, 0.0, 2, 0.0, 0, 0.0, -1, 23, 0, 0), (1, 0.0, 1, 0.0, 11, 0.0, -1, 23, 1, 0),
    (3, 0.0, 1, 0.0, 0, 0.0, -1, 5, 0, 0), (9, 0.0, 6, 1.0, 1, 0.0, -1, 2, 0, 0), (16, 0.0, 1, 1.0, 2, 0.0, -1, 4, 0, 0),
    (7, 0.0, 12, 0.0, 9, 0.0, -1, 6, 0, 0), (10, 0.1, 20, 0.0, 16, 0.0, -1, 15, 0, 0), (5, 0.0, 16, 0.0, 20, 0.0, -1, 0, 0, 0),
    (19, 0.0, 19, 0.0, 19, 0.0, -1, 20, 0, 0), (6, 0.0, 20, 0.0, 0, 0.0, -1, 12, 0, 0), (20, 0.0, 3, 0.0, 2, 0.0, -1, 0, 0, 0),
    (2, 0.0, 9, 0.0, 14, 0.0, -1, 3, 1, 0), (8, 0.0, 14, 0.0, 1, 1.0, -1, 9, 0, 0), (22, 0.0, 18, 0.0, 4, 0.0, -1, 2, 0, 0),
    (40, 0.9, 3, 1.0, 5, 1.0, -1, 0, 0, 0), (30, 0.0, 25, 0.0, 40, 0.0, -1, 40, 0, 0), (200, 0.0, 150, 0.0, 90, 0.0, -1, 300, 0, 0),
    # nav, footer, aside, menu, dialog and hidden elements, whatever the rest of the page holds
    (300, 0.0, 0, 0.0, 0, 0.0, -2, 0, 0, 0), (80, 0.0, 8, 0.0, 70, 0.0, -2, 0, 0, 0), (60, 0.1, 75, 0.0, 40, 0.0, -2, 4, 0, 0),
    (45, 0.0, 90, 0.0, 5, 1.0, -2, 10, 0, 0), (8, 0.0, 0, 0.0, 80, 0.0, -2, 0, 1, 0), (5, 0.0, 60, 0.0, 70, 0.0, -2, 3, 0, 0),
    (6, 0.0, 3, 1.0, 50, 0.0, -2, 0, 1, 0), (12, 0.0, 1, 1.0, 8, 0.0, -2, 10, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, -2, 0, 0, 0),
    (40, 0.0, 3, 1.0, 2, 1.0, -2, 0, 0, 0), (4, 0.0, 50, 0.0, 45, 0.0, -2, 0, 0, 0), (30, 0.0, 25, 0.0, 40, 0.0, -2, 200, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, -2, 200, 0, 0), (15, 0.0, 60, 0.0, 0, 0.0, -2, 200, 0, 0), (200, 0.0, 150, 0.0, 90, 0.0, -2, 300, 0, 0),
]


@dataclass
class Tree:
    """A split (feature, value: go left if at most value) or a leaf."""
    keep: bool = False
    feature: int = -1
    value: float = 0.0
    left: Tree | None = None
    right: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Gini splits until the leaves are pure; ties go to the first feature and the smallest value."""
    if depth == 0 or y.min() == y.max():
        return Tree(keep=bool(y.mean() >= 0.5))
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])
        for a, b in zip(cuts[:-1], cuts[1:]):
            left = x[:, f] <= (a + b) / 2
            cost = sum(p.sum() * 2 * q * (1 - q) for p, q in ((left, y[left].mean()), (~left, y[~left].mean())))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2)
    if best is None:
        return Tree(keep=bool(y.mean() >= 0.5))
    _, f, value = best
    left = x[:, f] <= value
    return Tree(False, f, value, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def trained() -> Tree:
    """The tree of the labelled table."""
    table = np.array(EXAMPLES, float)
    return grow(table[:, :-1], table[:, -1])


def _mark(tree: Tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if tree.feature < 0:
        out[rows] = tree.keep
        return
    low = x[rows, tree.feature] <= tree.value
    _mark(tree.left, x, rows[low], out)
    _mark(tree.right, x, rows[~low], out)


def classify(tree: Tree, blocks: list[Block]) -> np.ndarray:
    """Which blocks are main text."""
    out = np.zeros(len(blocks), bool)
    if blocks:
        _mark(tree, features(blocks), np.arange(len(blocks)), out)
    return out


def main_text(page: str | None, tree: Tree) -> str:
    """Main text blocks joined by an empty line."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, classify(tree, blocks)) if keep)


def extract(page: Column) -> Column:
    """Main text of an html column."""
    tree = trained()

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return texts(page)
