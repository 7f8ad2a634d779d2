"""Operator 10: main text of web pages.

The standard library's parser streams events into lines: a line is the text of one block element, with the number of tags
read for it and the containers it stands in. A line's ratio is its characters outside links over its tags; ratios are smoothed by
a Gaussian, and the lines above a threshold (the smoothed ratios' standard deviation, their mean at most) form clusters. The
region is the innermost article or main element that holds most of the clusters' text, or the one around it that has further
clusters or a heading above it, or else the deepest container that holds all clusters. An article is kept whole, short lines too. Of a plain container
lines of links alone go, but for a paragraph between two of text; and of the whole body what stands before the clusters and the headings above them, and after the clusters and the short
paragraphs that go on with them.

What is never text is left out at once: scripts, styles, templates, controls, and what is hidden. Menus, footers, forms, asides, headers outside
an article, and what a role, id or class names as one of these, as adverts, notices or comments, is weak evidence, which the share of a container weighs: one that holds
over nine tenths of the page's characters stays, a form one that holds over half; one whose characters are mostly links goes whatever it holds. A class or id names something only as a whole: all its parts are
such names or general words of page building (`article-comments`, but not `no-comments`, `has-sidebar`, `related-work` or `form-of-life`). Comments without a telling
name are known by a heading that says so (a plural or a number: `Comments`, `3 replies`; neither `Discussion` nor `Reply`) below some text.

Null, empty and text-free pages give an empty text. Unclosed and crossed tags end with the container they are in, a tag that
the page's end cuts off is dropped, cut-off references are read as the parser reads them. White space is that of str.split(). Repeated rows give repeated rows, an empty
table none; columns beside page_id, url and html are left out. A very long or deep page is one parser's work, in time and memory that grow with it; of containers that hold equally much (ties), the deepest is the region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.base import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BREAKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul caption".split())
#: Elements that a line's place is told by.
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol search section table ul head".split())
NEVER = frozenset("button canvas datalist head iframe input math noscript object script select style svg template textarea title".split())
#: Elements that are no main text unless they hold most of the page.
WEAK = frozenset("aside dialog fieldset footer menu nav search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of a class or id.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner bio breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices popup promo promos promoted promotion rail related respond share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Names of comments, and general words that may stand beside a name.
COMMENTS = frozenset("comment comments disqus respond".split())
GENERAL = frozenset(
    "area article articles aside author bar block blocks blog body bottom box byline button buttons center col column container content count desktop entry fb feed field fixed full global group head header heading icon icons inner inline item items js large latest left level link links list logo main mobile module news outer page panel post posts primary reader replies reply right row secondary section site slot small sticky stories story text thread title tools top ui unit user view web widget wide wp wrap wrapper".split()
)
#: Headings of comments: a number of them, a plural, or an invitation. Fixed values in four languages.
_COMMENTED = re.compile(
    r"\d+ (comments?|responses?|repl(y|ies)|kommentare?|commentaires?|comentarios?):?"
    r"|((reader|user|your|all) )?(comments|kommentare|commentaires|comentarios)( \(?\d+\)?)?:?"
    r"|(responses|replies|discussion) \(?\d+\)?:?|(leave|post|add|write) a (comment|reply):?",
    re.IGNORECASE,
)
_COPYRIGHT = re.compile(r"(©|\(c\)|copyright\b).*|.*\ball rights reserved\b.*", re.IGNORECASE)
_UNSEEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
#: What a container is named as; FORM may wrap a page.
PLAIN, OTHER, REMARKS, FORM = range(4)


def named(value: str) -> int:
    """What one of the classes or ids names as a whole: REMARKS, OTHER that is not main text, or PLAIN."""
    best = PLAIN
    for name in value.split():
        parts = [x.lower() for x in _PARTS.split(name) if len(x) > 1]
        hits = [x for x in parts if x in NAMES]
        if hits and all(x in NAMES or x in GENERAL for x in parts):
            best = max(best, REMARKS if COMMENTS.intersection(parts) else OTHER)
    return best


#: Lines' spread of the Gaussian.
SIGMA = 1.0


def _kernel(sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


class Lines(HTMLParser):
    """Lines of a page: text, tags, link characters, container; containers: name, parent, and what they are named as. A container's number is below those in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents, self.names = ["page"], [-1], [PLAIN]
        self.open: list[tuple[str, int, bool]] = []  # element, the container it is in or is, whether it is left out
        self.at, self.out, self.links, self.articles = 0, False, 0, 0
        self.pieces: list[str] = []
        self.tags = self.link_chars = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.blocks: list[str] = []  # the block element of each line

    def end_line(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.lines.append((text, self.tags, self.link_chars, self.at))
                self.blocks.append(next((x[0] for x in reversed(self.open[-8:]) if x[0] in BREAKS), ""))
                self.tags = 0
            self.pieces, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BREAKS:
            self.end_line()
        elif tag in ("br", "td", "th"):
            self.pieces.append(" ")
        if tag == "p":  # a paragraph ends the one before it
            if self.open and self.open[-1][0] == "p":
                self.pop(len(self.open) - 1)
        elif tag == "li" and self.open and self.open[-1][0] == "li":
            self.pop(len(self.open) - 1)
        if tag in VOID:
            return
        kind = FORM if tag == "form" else OTHER if tag in WEAK or tag == "header" and not self.articles else PLAIN
        out = self.out or tag in NEVER
        if attrs and not out and tag not in ("body", "html"):
            for name, value in attrs:
                value = value or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
                    out = True
                elif tag in ARTICLE:
                    continue
                elif name == "role" and value.lower() in ROLES:
                    kind = kind or (FORM if value.lower() == "form" else OTHER)
                elif name in ("class", "id") and value:
                    kind = kind if kind == FORM else max(kind, named(value))
        if tag in CONTAINERS:
            self.kinds.append(tag)
            self.parents.append(self.at)
            self.names.append(kind)
            self.at = len(self.kinds) - 1
        else:
            out = out or kind > PLAIN
        self.open.append((tag, self.at, out))
        self.out = out
        self.links += tag == "a"
        self.articles += tag in ARTICLE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self, to: int) -> None:
        for tag, _, _ in self.open[to:]:
            self.links -= tag == "a"
            self.articles -= tag in ARTICLE
        del self.open[to:]
        _, self.at, self.out = self.open[-1] if self.open else ("", 0, False)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BREAKS:
            self.end_line()
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop(k)
                break
            if self.open[k][0] in CONTAINERS and tag not in CONTAINERS:
                break  # an end tag without its start in this container

    def handle_data(self, data):
        if not self.out:
            self.pieces.append(data)
            if self.links:
                self.link_chars += len(data)

    def finish(self) -> None:
        self.close()
        self.end_line()
        self.leave_out()

    def sums(self, amounts: list[int]) -> list[int]:
        """What the lines of each container and of those in it amount to."""
        held = [0] * len(self.kinds)
        for (*_, at), n in zip(self.lines, amounts, strict=True):
            held[at] += n
        for c in range(len(held) - 1, 0, -1):
            held[self.parents[c]] += held[c]
        return held

    def leave_out(self) -> None:
        """Drops the lines of containers that are named as something else, and those of comments under a heading of their own."""
        held, links = self.sums([len(x[0]) for x in self.lines]), self.sums([min(x[2], len(x[0])) for x in self.lines])
        total = held[0]

        def other(c: int) -> bool:
            if self.names[c] == PLAIN:
                return False
            if 2 * links[c] > held[c]:
                return True
            return held[c] < total if self.names[c] == REMARKS else 2 * held[c] <= total if self.names[c] == FORM else 10 * held[c] <= 9 * total

        gone = [other(c) for c in range(len(held))]
        # Lines come in the page's order: while a container is open, those around it neither end nor change.
        known: dict[int, bool] = {-1: False}
        stopped, fresh, text_before, kept = set(), [True] * len(held), False, []
        for k, (text, _, _, at) in enumerate(self.lines):
            heading = self.blocks[k] in HEADINGS
            if heading:
                stopped.discard(at)
                if text_before and _COMMENTED.fullmatch(text):
                    if fresh[at] and at and 2 * held[at] <= total:
                        gone[at] = True  # the heading opens a container of its own
                    else:
                        stopped.add(at)
            fresh[at] = False
            path = []
            c = at
            while c not in known:
                path.append(c)
                c = self.parents[c]
            for c in reversed(path):
                up = self.parents[c]
                known[c] = known[up] or up in stopped or gone[c]
            if not (known[at] or gone[at] or at in stopped):
                kept.append(k)
                text_before = text_before or not heading
        self.lines, self.blocks = [self.lines[k] for k in kept], [self.blocks[k] for k in kept]


def clusters(lines: list[tuple[str, int, int, int]], sigma: float = SIGMA) -> np.ndarray:
    """Which lines' smoothed ratio is above the threshold."""
    ratio = np.array([max(0, len(text) - links) / max(1, tags) for text, tags, links, _ in lines])
    kernel = _kernel(sigma)
    reach = len(kernel) // 2
    smooth = np.convolve(np.pad(ratio, reach, "edge"), kernel, "valid")
    found = smooth >= min(smooth.std(), smooth.mean())
    return found if found.any() else np.ones(len(lines), bool)


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The page's main text, a line for each block."""
    page = Lines()
    if html:
        cut = html.rfind("<")
        if cut > html.rfind(">") and re.match(r"[A-Za-z/!]", html[cut + 1 :]):
            html = html[:cut]  # a tag that the page's end cut off
        page.feed(html)
    page.finish()
    lines = page.lines
    if not lines:
        return ""
    dense = clusters(lines, sigma)
    held = page.sums([len(x[0]) if d else 0 for x, d in zip(lines, dense.tolist(), strict=True)])
    n = len(held)
    last, first, head = list(range(n)), [len(lines)] * n, [len(lines)] * n  # the last container in each, its first line and first heading
    for k in range(len(lines) - 1, -1, -1):
        at = lines[k][3]
        first[at] = k
        if page.blocks[k] in HEADINGS:
            head[at] = k
    for c in range(n - 1, 0, -1):
        up = page.parents[c]
        last[up], first[up], head[up] = max(last[up], last[c]), min(first[up], first[c]), min(head[up], head[c])
    articles = [c for c, kind in enumerate(page.kinds) if kind in ARTICLE and 2 * held[c] >= held[0]]
    region = articles[-1] if articles else max(c for c in range(n) if held[c] == held[0])
    for c in reversed(articles[:-1]):  # one around it that has more of the clusters, or a heading above it
        if c <= region <= last[c] and (held[c] > held[region] or head[c] < first[region]):
            region = c
    kept = [k for k, line in enumerate(lines) if region <= line[3] <= last[region]]
    if not articles:
        kept = _of_plain(page, kept, dense, page.kinds[region] in ("page", "html", "body"))
    return "\n".join(lines[k][0] for k in kept)


def _of_plain(page: Lines, kept: list[int], dense: np.ndarray, body: bool) -> list[int]:
    """What of the lines of a region that is no article belongs to the text."""
    lines = page.lines
    mostly_links = [2 * line[2] > len(line[0]) for line in lines]
    if body:
        spots = [i for i, k in enumerate(kept) if dense[k]]
        a, b = spots[0], spots[-1]
        i = a
        while i and not mostly_links[kept[i - 1]]:  # up to the first heading above, with what stands between
            i -= 1
            if page.blocks[kept[i]] in HEADINGS:
                a = i
        while b + 1 < len(kept) and page.blocks[kept[b + 1]] == "p" and lines[kept[b + 1]][3] == lines[kept[b]][3] and not mostly_links[kept[b + 1]] and not _COPYRIGHT.fullmatch(lines[kept[b + 1]][0]):
            b += 1
        kept = kept[a : b + 1]
    alone = [lines[k][2] >= len(lines[k][0]) for k in kept]  # a link and nothing else

    def between(i: int) -> bool:
        return page.blocks[kept[i]] == "p" and 0 < i < len(kept) - 1 and not alone[i - 1] and not alone[i + 1]

    return [k for i, k in enumerate(kept) if not alone[i] or between(i)]


def extract(df: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html), which may have further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(html, sigma) for html in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
