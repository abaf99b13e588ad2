"""Main text of HTML pages: flat text blocks judged by a decision tree.

A page becomes a flat list of text blocks. A block is described by its word count and link density, those
of the blocks before and after it, and where it stands. A small decision tree, grown once per job on the
labelled blocks of `labelled_pages()`, says which blocks belong to the article; these are joined in order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HINT = re.compile(r"[a-z]+")
#: Elements whose content is text up to their own end tag, whatever stands in it, and never text of the page.
_RAW = frozenset("script style textarea title".split())
#: Other elements whose content is never text of the page; of a formula, only the source code kept beside it.
_SILENT = frozenset("noscript template svg select iframe object canvas audio video button datalist annotation annotation-xml".split())
#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of class, id or role, that tell of something other than the article.
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_ASIDE_HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related rail search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tags toolbar widget widgets complementary contentinfo".split()
)
_COMMENT_HINTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
_ARTICLE_TAGS = frozenset("article main".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "outside_article", "aside", "header", "comment", "heading")


@dataclass
class Block:
    """Text of one block with what is known of its place."""

    text: str
    words: int
    linked: int
    in_article: bool
    aside: bool
    header: bool
    comment: bool
    heading: bool
    marked: bool


@dataclass
class _Open:
    """An open element, with what holds for it and the elements around it."""

    tag: str = ""
    article: bool = False
    aside: bool = False
    header: bool = False
    #: A header between this element and the article around it.
    title: bool = False
    comment: bool = False
    heading: bool = False
    marked: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    held: Counter[str] = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    marked: bool = False

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            here = self.stack[-1] if self.stack else _Open()
            # A header inside the article holds its title; one around or outside it belongs to the page.
            self.blocks.append(Block(
                text, text.count(" ") + 1, len(html.unescape("".join(self.linked)).split()), here.article,
                here.aside, here.header and not here.title, here.comment, here.heading, self.marked or here.marked,
            ))
        self.pieces, self.linked = [], []

    def open(self, tag: str, attributes: str) -> None:
        found = {n.lower(): (a or b or c) for n, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        names = " ".join(found.get(n, "") for n in ("class", "id", "role")).lower().split()
        # "with-sidebar" and the like tell of the whole page's layout, not of this element.
        hints = {w for n in names if tag not in ("body", "html") and not n.startswith(("with-", "has-", "no-", "is-")) for w in _HINT.findall(n)}
        comment = bool(hints & _COMMENT_HINTS)
        article = tag in _ARTICLE_TAGS and not comment
        around = self.stack[-1] if self.stack else _Open()
        header = tag == "header" or "header" in hints
        self.stack.append(_Open(
            tag, around.article or article, around.aside or not article and (tag in _ASIDE_TAGS or bool(hints & _ASIDE_HINTS)), around.header or header,
            not article and (around.title or header and around.article), around.comment or comment, around.heading or tag in _HEADING, around.marked or "data-main" in attributes,
        ))
        self.held[tag] += 1

    def end(self) -> None:
        self.held[self.stack.pop().tag] -= 1

    def close(self, tag: str) -> None:
        if self.held[tag]:
            while self.stack[-1].tag != tag:
                self.end()
            self.end()


#: Opening the first ends an open one of the second kind that nothing else has interrupted.
_ENDS_ITSELF = {"p": ("p",), "li": ("li", "p"), "dt": ("dd", "dt", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), **{h: ("p",) for h in _HEADING}}


def _tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of every tag; comments, declarations and raw text have no name."""
    at, in_head = 0, False
    while found := _MARKUP.search(source, at):
        at = found.end()
        tag, closing, attributes = (found[2] or "").lower(), bool(found[1]), found[3] or ""
        if tag in _RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if not end and in_head:
                end = re.compile(r"(?=</head\s*>|<body\b)", re.I).search(source, at)
            at, tag = end.end() if end else len(source), ""
        elif tag == "head":
            in_head = not closing
        elif tag in _BLOCK:
            in_head = False
        yield found.start(), at, closing, tag, attributes


def _silent_ends(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, tuple[int, int]]:
    """Where the page goes on (offset, number of the next tag) after the silent element that a tag opens.

    An element without end tag ends where an element around it does, at the next block, or where its like
    begins if it cannot hold that; without any of these its tag counts for nothing.
    """
    ends: dict[int, tuple[int, int]] = {}
    if not any(t[3] in _SILENT for t in tags):
        return ends
    open_: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    ended: set[int] = set()

    def close(tag: str, k: int, whole: bool) -> None:
        while True:
            name, begun = open_.pop()
            held[name] -= 1
            if name in _SILENT:
                ends[begun] = (tags[k][0], k)
                if whole and name == tag:
                    ends[begun] = (tags[k][1], k + 1)
                    ended.add(begun)
            if name == tag:
                return

    for k, (_, _, closing, tag, attributes) in enumerate(tags):
        if not tag or tag in _VOID:
            continue
        if closing:
            if not held[tag]:
                continue
            if tag not in _BLOCK and tag not in _SILENT:
                # The end of an inline element does not reach out of its block.
                inner = next(name for name, _ in reversed(open_) if name == tag or name in _BLOCK)
                if inner != tag:
                    continue
            close(tag, k, True)
        elif tag in _BLOCK or not attributes.endswith("/"):
            if tag in ("button", "select") and held[tag]:
                close(tag, k, False)
            open_.append((tag, k))
            held[tag] += 1
    block = None
    for k in range(len(tags) - 1, -1, -1):
        if tags[k][3] in _SILENT and not tags[k][2] and not tags[k][4].endswith("/"):
            if k not in ended and block is not None and (k not in ends or block < ends[k][1]):
                ends[k] = tags[block][0], block
        if tags[k][3] in _BLOCK or tags[k][3] == "head":
            block = k
    return ends


def page_blocks(source: str) -> list[Block]:
    """Text blocks of a page in order; unclosed and stray tags are taken as browsers do, roughly.

    A head needs no treatment: what it may hold is raw, silent or void, and anything else ends it.
    """
    page, at, k = _Page(), 0, 0
    tags = list(_tags(source))
    silent = _silent_ends(tags)
    while k < len(tags):
        start, end, closing, tag, attributes = tags[k]
        if start > at:
            piece = source[at:start]
            page.pieces.append(piece)
            if page.in_link:
                page.linked.append(piece)
        at, k = silent.get(k, (end, k + 1))
        if tag == "head":
            page.end_block()
        elif tag in _BLOCK:
            page.end_block()
            if closing:
                page.close(tag)
            elif tag != "hr":
                while page.stack and page.stack[-1].tag in (_ENDS_ITSELF.get(tag) or ("p",)):
                    page.end()
                page.open(tag, attributes)
        elif tag == "br":
            page.pieces.append(" ")
            page.linked.append(" ")
        elif tag == "a":
            page.in_link = not closing
    tail = source[at:]
    page.pieces.append(tail)
    if page.in_link:
        page.linked.append(tail)
    page.end_block()
    return page.blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), len(FEATURES)))
    if blocks:
        own = np.array([(b.words, min(b.linked / b.words, 1.0)) for b in blocks], float)
        out[:, :2] = own
        out[1:, 2:4], out[:-1, 4:6] = own[:-1], own[1:]
        has_article = any(b.in_article for b in blocks)
        out[:, 6:] = [(b.in_article, has_article and not b.in_article, b.aside, b.header, b.comment, b.heading) for b in blocks]
    return out


@dataclass(frozen=True)
class Tree:
    """Decision tree as arrays: feature (-1 at a leaf), threshold, children and answer of every node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    answer: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(x) and (inner := self.feature[node] >= 0).any():
            goes_left = x[np.arange(len(x)), np.maximum(self.feature[node], 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return self.answer[node]


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Tree that splits at the largest fall of Gini impurity (the first feature and threshold among equals)."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, bool(y[rows].mean() >= 0.5) if len(rows) else True])
        best = (1e-12, -1, 0.0)
        if left and 0 < y[rows].sum() < len(rows):
            whole = y[rows].mean() * (1 - y[rows].mean()) * len(rows)
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = x[rows, f] <= cut
                    rest = sum(y[rows][m].mean() * (1 - y[rows][m].mean()) * m.sum() for m in (low, ~low))
                    if whole - rest > best[0] + 1e-12:
                        best = (whole - rest, f, cut)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[here][:2] = best[1:]
            nodes[here][2] = grow(rows[low], left - 1)
            nodes[here][3] = grow(rows[~low], left - 1)
        return here

    grow(np.arange(len(x)), depth)
    return Tree(*(np.array([n[k] for n in nodes]) for k in range(5)))


_PROSE = "The keeper walked along the wall each morning and wrote down what the sea had left there, so that nobody would have to rely on memory alone."
#: Labelled templates: article blocks carry `data-main`, every other block is none. Each `{}` is some prose.
LABELLED_TEMPLATES = (
    "<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></nav><div class=ad>Buy a new lamp today and save.</div><article><h1 data-main>Of walls and seas</h1><p data-main>{}<p data-main>{}</p><p data-main>In.</p></article><footer>&copy; the paper. All rights.</footer></body>",
    "<body><header><a href=/>The Paper</a> <p>News that keeps</p></header><div class=cookie-notice>We use small files to make this page work. Do you agree?</div><main><h1 data-main>Morning</h1><p data-main>{} {}</p><ul><li data-main>first of all</li><li data-main>then <a href=/x>the rest</a></li></ul><aside><p>{}</p></aside></main><div class=comments><h3>Comments</h3><p>{}</p><p>I agree.</p></div><footer><a href=/i>Imprint</a> | <a href=/c>Contact</a></footer></body>",
    "<body><div id=menu><a href=/a>Start</a> <a href=/b>About us</a></div><div class=content><h2 data-main>Harbour notes</h2><p data-main>{}</p><p data-main>{}</p><p data-main>{}</p></div><div class=sidebar><h3>More</h3><p>{}</p><p><a href=/q>A walk on the other side of town</a></p></div><div class=footer>All rights reserved by the harbour office.</div></body>",
    "<body><div><a href=/a>One</a></div><div><a href=/b>Two</a></div><div><a href=/c>Three</a></div><h1 data-main>The mill</h1><p data-main>{}</p><p data-main>{} <a href=/z>More of it</a></p><p data-main>{}</p><div><a href=/d>Next page</a></div><div><a href=/e>Back to the top of the list</a></div></body>",
    "<body><article><header><h1 data-main>A bridge</h1><p data-main>By the editor</p></header><p data-main>{}</p><blockquote data-main>{}</blockquote><table><tr><td data-main>Length</td><td data-main>120 feet</td></tr></table><form><p>Your name</p></form><p data-main>{}</p><div class=share>Tell a friend about it</div><footer>Filed under bridges</footer></article><section id=comments><article class=comment><p>{}</p></article></section></body>",
    "<body><div class=header><p>{}</p><p>The daily page of the whole county</p></div><article><p data-main>{}</p></article><div><p>{}</p></div><p>Call the office between nine and five.</p></body>",
    "<body><form><label>Search</label></form><p data-main>{}</p><p data-main>So it was.</p><p data-main>{}</p><div class=related><p>{}</p></div></body>",
    "<body><article><h1 data-main>Of bells</h1><p data-main>{}</p><p data-main>{}</p><section class=comments><h2>Three readers wrote</h2><p>{}</p><p>{}</p></section></article><div class=comments><p>{}</p></div></body>",
    "<body><h1 data-main>Of ropes</h1><p data-main>{}</p><p data-main>{}</p><div id=comments><p>{}</p><p>{}</p></div></body>",
    "<body><article><h1 data-main>Short news</h1><p data-main>Closed.</p><p data-main><a href=/full>Read it whole</a></p></article><div class=advert><p>Now with two handles</p></div></body>",
)
#: Words of the prose that fills a template, in turn, starting anew at each of them.
PROSE_WORDS = (24, 1, 60, 6, 140, 3, 12)


def labelled_pages() -> list[str]:
    """The labelled table: every template with every rotation of the lengths, so that length alone proves nothing."""
    def prose(words: int) -> str:
        given = _PROSE.split()
        return " ".join((given * (words // len(given) + 1))[:words])

    return [
        t.format(*(prose(PROSE_WORDS[(start + k) % len(PROSE_WORDS)]) for k in range(t.count("{}"))))
        for t in LABELLED_TEMPLATES for start in range(len(PROSE_WORDS))
    ]


def article_tree() -> Tree:
    """Tree grown on the labelled table; its size is that of the table."""
    pages = [page_blocks(p) for p in labelled_pages()]
    return grow_tree(np.vstack([block_features(p) for p in pages]), np.array([b.marked for p in pages for b in p], float))


def extract_text(df: DataFrame, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, the columns of `keep`, `text` and `n_blocks` (blocks taken) of every row.

    Blocks are joined by two line ends; references are decoded, white space in a block is one space. A page
    of null, without markup or without an article block gives the blocks that the tree takes, or the empty
    text. Repeated rows are treated alike; an empty table gives no rows; other columns are not read.
    """
    tree = article_tree()
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(source).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page in batch.column("_html"):
                blocks = page_blocks(page.as_py() or "")
                taken = [b.text for b, yes in zip(blocks, tree.predict(block_features(blocks))) if yes]
                texts.append("\n\n".join(taken))
                counts.append(len(taken))
            kept = [n for n in batch.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*kept, "_text", "_blocks"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_html").dtypes)
    out = rows.mapInArrow(run, f"{kinds}, _text string, _blocks int")
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"), F.col("_blocks").alias("n_blocks"))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"), keep=("url",))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
