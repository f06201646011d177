"""Main text of web pages: text-to-tag ratios over streamed parser events.

The standard library's ``HTMLParser`` streams events; no tree is built.  They
cut a page into blocks (one per block element, a "line").  Every block carries
its text, the tags met in it, its link text, and the container it stands in.
A block's text-to-tag ratio is its count of non-link characters over its tags;
the ratios are smoothed with a Gaussian and blocks above a threshold form the
content clusters, as in ratio-based extraction.  The clusters choose the
*region*: the article or main element (else the body) that holds most of
their text.  All blocks of an article or main are the result, so a short paragraph
between long ones stays.  Where the page has neither, the clusters choose the
blocks too: runs above the threshold, short gaps bridged, their edges cut back to
blocks that are above it by their own ratio, paragraphs or headings.  Blocks inside
boilerplate elements (menus, headers, footers, sidebars, adverts, notices, comments)
never count, nor those of forms, unless a form is wrapped round an article, a main or
most of the clustered text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, unpacked

SKIP = frozenset("script style noscript template head title nav aside footer button select option textarea "
                 "iframe object svg canvas dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 "
                  "h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr "
                  "ul".split())
ENDS_P = BLOCK - {"html", "body"}
REGION = frozenset(("article", "main", "body"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of boilerplate in class, id and role, as any word of a name.
BOILER = frozenset("ad ads advert adverts advertisement advertising sponsored sidebar "
                   "sidenav navbar nav navigation breadcrumb breadcrumbs footer comments commentlist "
                   "disqus cookie cookies gdpr popup newsletter masthead pagination contentinfo complementary".split())
#: Names that also stand for content: boilerplate only as a whole name, or before a part of a page.
AMBIGUOUS = frozenset("sponsor promo promotion banner menu comment respond replies reply consent notice notices alert "
                      "modal overlay subscribe signup share sharing social related recommended toolbar widget skip "
                      "pager search".split())
PART = frozenset("area articles bar box button buttons container form icons item items link links list media panel posts "
                 "section stories text thread wrapper".split())
_LAYOUT = frozenset(("has", "no", "with", "without"))
_LEGAL = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)
_SPACES = re.compile(r"\s+")


def _boiler(tag: str, attrs) -> bool:
    """Whether an element's names or style mark it; names never mark a heading."""
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            if tag in HEADING:
                continue
            for name in v.lower().split():  # "has-sidebar" tells of a page's layout
                parts = re.split(r"[^a-z0-9]+", name)
                plain = len(parts) == 1 or len(parts) == 2 and parts[1] in PART
                if _LAYOUT.isdisjoint(parts) and (not BOILER.isdisjoint(parts) or plain and parts[0] in AMBIGUOUS):
                    return True
        elif k == "hidden" or k == "aria-hidden" and v == "true":
            return True
        elif k == "style" and v and re.search(r"display\s*:\s*none", v, re.I):
            return True
    return False


class _Blocks(HTMLParser):
    """Events to blocks: (region number, text, tags, link characters, form number, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, skipped, region, form
        self.forms: list[list] = []  # outer form, holds an article or main
        self.skipped = 0
        self.regions = [("body", -1)]  # kind, parent
        self.links = 0
        self.blocks: list[list] = []
        self.pieces: list[str] = []
        self.tags, self.link_chars = 0, 0

    def region(self) -> int:
        return self.open[-1][2] if self.open else 0

    def form(self) -> int:
        return self.open[-1][3] if self.open else -1

    def cut(self) -> None:
        text = _SPACES.sub(" ", "".join(self.pieces)).strip()
        if text:
            element = next((t for t, *_ in reversed(self.open) if t in BLOCK), "body")
            self.blocks.append([self.region(), text, self.tags, self.link_chars, self.form(), element])
        if text or self.pieces:
            self.tags = self.link_chars = 0
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.cut()
            return
        if tag in ENDS_P and any(t == "p" for t, *_ in self.open[-4:]):  # an open paragraph ends here
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self.end(i)
                    break
                if self.open[i][0] in BLOCK:
                    break
        if tag == "body":  # also ends a head left open
            for i, (t, *_) in enumerate(self.open):
                if t == "head":
                    self.end(i)
                    break
        if tag in BLOCK:
            self.cut()
        region = self.region()
        skip = tag in SKIP or tag not in ("html", "body", "main") and _boiler(tag, attrs)
        if tag == "header" and not any(t in ("article", "main") for t, *_ in self.open):
            skip = True
        if tag in REGION and not skip and not self.skipped:
            if tag != "body":
                self.regions.append((tag, region))
                region = len(self.regions) - 1
                f = self.form()
                while f >= 0:
                    self.forms[f][1] = True
                    f = self.forms[f][0]
        form = self.form()
        if tag == "form":
            self.forms.append([form, False])
            form = len(self.forms) - 1
        self.open.append((tag, skip, region, form))
        self.skipped += skip
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end(self, i: int) -> None:
        if any(t in BLOCK for t, *_ in self.open[i:]):
            self.cut()
        for t, skip, *_ in self.open[i:]:
            self.skipped -= skip
            self.links -= t == "a"
            if skip and not self.skipped:
                self.tags = 0  # the tags of boilerplate thin no text
        del self.open[i:]

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            t = self.open[i][0]
            if t == tag:
                self.end(i)
                return
            if t in BLOCK and tag not in BLOCK and tag not in SKIP:
                return  # an inline end tag doesn't close blocks

    def handle_data(self, data):
        if not self.skipped:
            self.pieces.append(data)
            if self.links:
                self.link_chars += len(data)


def blocks_of(html: str, sigma: float = 1.0) -> tuple[list[list], list[tuple[str, int]]]:
    """Blocks and regions of a page, without those of forms that only are forms."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.cut()
    if not p.forms:
        return p.blocks, p.regions
    weight, total = [0] * len(p.forms), 0
    for b, c in zip(p.blocks, content_clusters(p.blocks, sigma)[0]):
        f = b[4]
        total += c * len(b[1])
        while f >= 0:
            weight[f] += c * len(b[1])
            f = p.forms[f][0]
    kept = [b for b in p.blocks if b[4] < 0 or p.forms[b[4]][1] or 2 * weight[b[4]] > total]
    return kept, p.regions


def content_clusters(blocks: list[list], sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For each block whether its smoothed text-to-tag ratio is above the threshold (the
    standard deviation of the ratios, the mean at most), and whether its own ratio is."""
    ratio = np.array([max(0, len(b[1]) - b[3]) / max(1, b[2]) for b in blocks], float)
    if len(ratio) < 2:
        return np.ones(len(ratio), bool), np.ones(len(ratio), bool)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(ratio, kernel)[reach:reach + len(ratio)]
    smooth /= np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]
    least = min(smooth.std(), smooth.mean())
    return smooth >= least, ratio >= least


def _runs(blocks: list[list], content: np.ndarray, own: np.ndarray, gap: int = 3) -> np.ndarray:
    """True for the blocks of content runs.  A run begins and ends with a block above the
    threshold by its own ratio, or with paragraphs and headings without links beside it;
    runs up to ``gap`` blocks apart are one."""
    firm = content & own
    soft = np.array([b[5] == "p" and not b[3] and not _LEGAL.match(b[1]) or b[5] in HEADING for b in blocks], bool)
    keep = firm.copy()
    at = np.flatnonzero(firm)
    for a, b in zip(at, at[1:]):
        if b - a <= gap + 1:
            keep[a:b] = True
    for i in range(1, len(blocks)):  # after a run
        keep[i] |= keep[i - 1] and soft[i] and blocks[i][5] not in HEADING
    for i in range(len(blocks) - 2, -1, -1):  # before one
        keep[i] |= keep[i + 1] and soft[i]
    return keep


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page: its blocks joined by line feeds, "" if none."""
    if not html:
        return ""
    blocks, regions = blocks_of(html, sigma)
    if not blocks:
        return ""
    content, own = content_clusters(blocks, sigma)
    weight = [0] * len(regions)
    for (r, text, *_), c in zip(blocks, content):
        if c:
            while r >= 0:  # a region holds what its inner regions hold
                weight[r] += len(text)
                r = regions[r][1]
    # the innermost article or main that holds most of the clustered text
    total, best = weight[0], 0
    for r in range(1, len(regions)):
        if 2 * weight[r] > total:
            best = r
    if not best and any(weight[1:]):  # several articles side by side: all of them
        chosen = {r for r in range(1, len(regions)) if weight[r]}
    else:
        chosen = {best}
    if len(regions) == 1:  # nothing but the body
        return "\n".join(b[1] for b, k in zip(blocks, _runs(blocks, content, own)) if k)
    out = []
    for r, text, *_ in blocks:
        while r >= 0 and r not in chosen:
            r = regions[r][1]
        if r >= 0:
            out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` ("" if none) and ``n_chars`` (code points).

    Null and empty html give an empty text.  Whole pages of any length are
    parsed, one at a time.  Columns of ``pages`` with the names of results
    give way to the results.
    """
    new = ("text", "n_chars")
    kept = [c for c in pages.columns if c.lower() not in (*new, html.lower())]
    src = pages.select(packed(pages, kept), F.col(f"`{html}`").cast("string").alias("_html"))

    def extract(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["_in", *new])

    schema = src.drop("_html").schema.add("text", "string").add("n_chars", "long")
    return src.mapInArrow(extract, schema).select(*unpacked(kept), *new)
