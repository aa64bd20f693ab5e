"""Main text of web pages from flat text blocks.

A page becomes a flat list of blocks, each with its words, the share of them in links, the same
of the blocks before and after, and whether it lies inside elements made for an article or for
something else. A decision tree, trained on the small labelled table of `html_labels`, keeps the
blocks of the article. A page needs no other page, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.llm.arrowtext import slabs
from carelattice.llm.decision_tree import grow, share_of_one
from carelattice.llm.html_labels import LABELLED

# Elements by their role.
_SILENT = frozenset(
    "script style noscript template iframe svg math head title select option textarea button"
    " object canvas audio video".split()
)
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small"
    " span strike strong sub sup time tt u var wbr input".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form table td ul ol dl figure"
    " fieldset dialog menu details".split()
)
# What may stand in a head; anything else ends one that is never closed.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
_ARTICLE = frozenset("article main".split())
_BESIDES = frozenset("nav footer aside form menu dialog".split())
# Parts of class, id and role names of what stands beside an article.
_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner"
    r"|cookies?|consent|notice|alert|comments?|replies|disqus|sidebar|side|menu|nav(?:bar|igation)?"
    r"|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter"
    r"|subscribe|popup|modal|widget|pagination|pager|copyright|legal|login|search"
    r"|complementary|contentinfo)(?:$|[^a-z])"
)

FEATURES = (
    "words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after",
    "in_article", "in_besides",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_besides: bool

    @property
    def link_share(self) -> float:
        return self.linked / self.words


class _Blocks(HTMLParser):
    """Collects the text blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.silent: list[str] = []
        # (element, inside an article, inside something beside it)
        self.open: list[tuple[str, bool, bool]] = []

    def finish(self) -> None:
        """End the current block; white space in it becomes single spaces."""
        words = "".join(self.parts).split()
        if words:
            _, article, besides = self.open[-1] if self.open else ("", False, False)
            self.blocks.append(
                Block(" ".join(words), len(words), min(self.linked, len(words)), article, besides)
            )
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag not in _IN_HEAD:
            self.silent = []
        if tag in _SILENT:
            if tag not in ("head", "title", "object"):
                self.parts.append(" ")
            self.silent.append(tag)
            return
        if self.silent:
            if tag != "body":
                return
            self.silent = []  # a head that was never closed
        if tag in _INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.links += 1
            return
        self.finish()
        self.links = 0 if tag not in _VOID else self.links
        if tag not in _CONTAINERS:
            return
        _, article, besides = self.open[-1] if self.open else ("", False, False)
        named = tag not in ("html", "body") and any(
            _NAMES.search(value.lower()) for key, value in attrs if value and key in ("class", "id", "role")
        )
        if tag in _ARTICLE:
            article = True
        elif tag in _BESIDES or named or (tag == "header" and not article):
            besides = True
        self.open.append((tag, article, besides))

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _INLINE or tag in _SILENT:
            return
        self.finish()
        if tag in _CONTAINERS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.silent = []
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())


def text_blocks(html: str) -> list[Block]:
    """All text blocks of a page in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.finish()
    return parser.blocks


def block_features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """One row of FEATURES for each block; a page's ends have neighbours without words."""
    around = [(0, 0.0), *((b.words, b.link_share) for b in blocks), (0, 0.0)]
    return [
        (*around[i + 1], *around[i], *around[i + 2], float(b.in_article), float(b.in_besides))
        for i, b in enumerate(blocks)
    ]


@cache
def trained_tree():
    """The tree of the labelled table; the same wherever it is trained."""
    rows, labels = [], []
    for page in LABELLED:
        blocks = text_blocks("<html><body>" + "".join(html for html, _ in page) + "</body></html>")
        wanted = [label for _, label in page if label is not None]
        if len(blocks) != len(wanted):
            raise ValueError("the labelled table does not fit its blocks")
        rows += block_features(blocks)
        labels += wanted
    return grow(np.array(rows), np.array(labels, float))


def main_text(html: str) -> str:
    """The article's blocks, one line each."""
    blocks = text_blocks(html)
    tree = trained_tree()
    return "\n".join(
        block.text
        for block, row in zip(blocks, block_features(blocks), strict=True)
        if share_of_one(tree, row) >= 0.5
    )


def extract_pages(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The text is empty where nothing of the article is found, for null and for empty html. Markup
    that is cut off or never closed ends with the page. Repeated rows are answered each, an empty
    table gives an empty result, and other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, 8 << 20):
            texts = [main_text(html.as_py()) for html in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_column).alias("page_id"), F.coalesce(F.col(html_column), F.lit("")).alias("html"),
        F.col(url_column).cast("string").alias("url"),
    )
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
