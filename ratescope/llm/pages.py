"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: tags without an end, tags inside a block, and tags whose content is no text of the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong strike sub sup time tt u var wbr br img".split())
HIDDEN = set("script style noscript template head title iframe object svg canvas math audio video select textarea button option".split())
#: Tags that hold something else than the article, and words in class, id or role that say so.
ASIDE = set("nav footer aside form menu dialog fieldset".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|menu|nav|navbar|navigation|"
    r"breadcrumb|breadcrumbs|sidebar|side|aside|footer|header|masthead|topbar|toolbar|cookie|cookies|consent|notice|popup|modal|overlay|"
    r"comment|comments|disqus|reply|replies|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search|"
    r"pagination|pager|widget|contentinfo|complementary|alert)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
MAIN = set("article main".split())
#: A header by its class word is part of the article inside one, or where it says so.
HEADER_WORD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-]|\d)", re.IGNORECASE)
ARTICLE_HEADER = re.compile(r"(?:^|\s)(?:post|entry|article|story|content)[_-]+header(?:$|\s)", re.IGNORECASE)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element of the same kind, and where that search stops.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPE = set("article aside blockquote body div footer form header html main nav ol section table td th ul".split())
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


class Blocks(HTMLParser):
    """Blocks of a page in order: (path of block tags from the root, numbers of its marks, text, letters inside links).

    A mark is an open element that is an article (``main``), page furniture by its tag (``aside``), or perhaps furniture: a form or an
    element with a class word that says so (``perhaps``).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, int | None]] = []  # tag, step of the path, hidden, number of the mark
        self.marks: list[str] = []
        self.blocks: list[tuple[tuple[str, ...], tuple[int, ...], str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            path = tuple(step for tag, step, _, _ in self.open if tag not in INLINE)
            self.blocks.append((path, tuple(o[3] for o in self.open if o[3] is not None), text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        if any(o[0] not in INLINE for o in self.open[at:]):
            self.flush()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        if ends:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in ends:
                    self._pop(at)
                    break
                if self.open[at][0] in SCOPE and self.open[at][0] not in ends:
                    break
        if tag == "br" or tag not in INLINE:
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        shown = dict(attrs)
        hidden = tag in HIDDEN or "hidden" in shown or shown.get("aria-hidden") == "true"
        # the header of an article is part of it, the header of the page is not
        inside = any(o[0] in MAIN for o in self.open)
        mark = None
        if tag in MAIN:
            mark = "main"
        elif tag != "form" and tag in ASIDE or (tag == "header" and not inside):
            mark = "aside"
        elif tag == "form":
            mark = "perhaps"
        elif tag not in ("html", "body"):
            words = HEADER_WORD.sub(" ", named) if inside or ARTICLE_HEADER.search(named) else named
            mark = "perhaps" if ASIDE_WORDS.search(words) else None
        if mark:
            self.marks.append(mark)
        self.open.append((tag, f"{tag}.{named}" if named else tag, hidden, len(self.marks) - 1 if mark else None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if self.open[at][0] in SCOPE and tag in INLINE:
                return

    def handle_data(self, data):
        if any(o[2] for o in self.open):
            return
        self.parts.append(data)
        if any(o[0] == "a" for o in self.open):
            self.linked += len(data.strip())


def blocks_of(html: str) -> Blocks:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def furniture(page: Blocks, text: np.ndarray) -> np.ndarray:
    """Whether each block is page furniture.

    Furniture by tag is furniture with all below it. An element that is perhaps furniture is not if it holds most of the page's
    text; nor does it count for the articles in it, unless articles outside of all such elements hold as much text.
    """
    kinds = page.marks
    tagged = np.array([any(kinds[m] == "aside" for m in b[1]) for b in page.blocks], dtype=bool)
    held = np.zeros(len(kinds))
    for block, size, out in zip(page.blocks, text, tagged, strict=True):
        if not out:
            held[list(block[1])] += size
    total = text[~tagged].sum()
    perhaps = [kind == "perhaps" and 2 * held[m] <= total for m, kind in enumerate(kinds)]

    def around(block: tuple) -> tuple[bool, bool, bool]:
        """Whether a block is in an article, whether in something that is perhaps furniture inside it, and outside it."""
        last = max((m for m in block[1] if kinds[m] == "main"), default=None)
        if last is None:
            return False, any(perhaps[m] for m in block[1]), False
        return True, any(perhaps[m] for m in block[1] if m > last), any(perhaps[m] for m in block[1] if m < last)

    found = [around(b) for b in page.blocks]
    article, within, outside = (np.array([f[k] for f in found], dtype=bool) for k in range(3))
    body = article & ~within & ~tagged
    counts = text[body & ~outside].sum() >= text[body & outside].sum()
    return tagged | within | (outside & counts)


def content_blocks(page: Blocks, threshold: float) -> list[str]:
    """The blocks whose path is content.

    Each path from root to block is a group: text outside links per block and punctuation per block are its
    two ratios. Both are smoothed along the page over the blocks next to each one, and fused by their product and, but for headings, the share of
    the path's text that is outside links. A path is content if its mean
    fused ratio reaches ``threshold`` times the mean of all, weighted by text. Page furniture (navigation, footers,
    adverts and the like, see ``furniture``) has no ratio. Where a page says which part is the article and that has text, the
    blocks outside it have none either.
    """
    if not page.blocks:
        return []
    text = np.array([max(0, len(b[2]) - b[3]) for b in page.blocks], dtype=float)
    live = ~furniture(page, text)
    main = live & np.array([any(page.marks[m] == "main" for m in b[1]) for b in page.blocks], dtype=bool)
    if text[main].sum():
        live = main
    # the same path may be furniture in one place only
    names = [(b[0], bool(on)) for b, on in zip(page.blocks, live, strict=True)]
    paths = {path: k for k, path in enumerate(dict.fromkeys(names))}
    of = np.array([paths[name] for name in names])
    marks = np.array([len(PUNCTUATION.findall(b[2])) for b in page.blocks], dtype=float)
    n = np.bincount(of)

    def smoothed(values: np.ndarray) -> np.ndarray:
        ratio = np.where(live, (np.bincount(of, values) / n)[of], 0.0)
        padded, weight = np.pad(ratio, 1), np.pad(live.astype(float), 1)
        sums = padded[:-2] + 2 * padded[1:-1] + padded[2:]
        weights = weight[:-2] + 2 * weight[1:-1] + weight[2:]
        return np.where(live, sums / np.maximum(weights, 1), 0.0)

    total = (text * live).sum()
    if not total:
        return []
    lengths = np.bincount(of, [len(b[2]) for b in page.blocks])
    heading = np.array([path[-1].split(".")[0] in HEADINGS if path else False for path, _ in paths], dtype=bool)
    unlinked = np.where(heading, 1.0, np.bincount(of, text) / lengths)
    fused = smoothed(text) * (1 + smoothed(marks))
    by_path = np.bincount(of, fused) / n * unlinked
    mean = (by_path[of] * text * live).sum() / total
    good = (by_path >= threshold * mean) & (by_path > 0)
    return [b[2] for k, b, on in zip(of, page.blocks, live, strict=True) if on and good[k]]


def main_text(html: str | None, threshold: float = 0.05) -> str:
    """The article of a page: its blocks in page order, joined by an empty line; empty if there is none."""
    return "\n\n".join(content_blocks(blocks_of(html or ""), threshold))


def extract_pages(pages: DataFrame, html_column: str = "html", threshold: float = 0.05) -> DataFrame:
    """All columns of ``pages`` but the html, with text and n_chars; one map over the scan, page by page.

    Null and empty pages, and pages without text, give an empty text. Nothing is cut.
    """
    kept = [c for c in pages.columns if c != html_column]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), threshold) for h in batch.column(len(kept))]
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*kept, F.col(html_column)).mapInArrow(read, schema)
