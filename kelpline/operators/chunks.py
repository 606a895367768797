"""Article chunker: structural anchors of regulation HTML to articles, with a reason for every anchor that is dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.batches import CUT, pieces
from kelpline.functions.text import EXCERPT_MAX, TEXT_MAX, html_text

#: Documents of the corpus, with their last article.
DOCUMENTS = (
    ("ETS", "02003L0087-20240301", "Directive 2003/87/EC", 33),
    ("FuelEU", "32023R1805", "Regulation (EU) 2023/1805", 32),
    ("MRV", "32015R0757", "Regulation (EU) 2015/757", 26),
    ("CBAM", "32023R0956", "Regulation (EU) 2023/956", 36),
)
#: Fixed value: least characters, blanks aside, of an article that isn't empty.
MIN_BODY = 40

#: Classes of an article's block, its heading and its title (two dialects), and how an article's id begins.
BLOCK_CLASS, ID_PREFIX = "eli-subdivision", "art_"
PART_CLASSES = {"heading": {"oj-ti-art", "title-article-norm"}, "title": {"oj-sti-art", "stitle-article-norm"}}

_TAG = re.compile(r"<(/?)(div|p)\b([^>]*)>", re.I)
_ATTR = re.compile(r"""([\w-]+)\s*=\s*"([^"]*)\"""")


class _Block:
    """An article's block while the page is read: where it starts, and its parts (start and end of the element and of its content)."""

    def __init__(self, anchor: str, start: int):
        self.anchor, self.start, self.end = anchor, start, None
        self.parts: dict[str, tuple[int, int, int, int]] = {}


def article_blocks(page: str) -> list[_Block]:
    """Blocks in page order, by one pass over the tags with a stack of the open divs; one that is never closed ends with the page."""
    found: list[_Block] = []
    stack: list[_Block | None] = []
    waiting: list[tuple[str, int, int]] = []  # paragraphs of a part that are open
    for m in _TAG.finditer(page):
        closing, name, attrs = bool(m[1]), m[2].lower(), {} if m[1] else {k.lower(): v for k, v in _ATTR.findall(m[3])}
        if name == "div" and closing:
            if not m[3] and stack:
                block = stack.pop()
                if block:
                    block.end = m.start()
        elif name == "div":
            is_block = BLOCK_CLASS in attrs.get("class", "").split() and attrs.get("id", "").startswith(ID_PREFIX)
            stack.append(_Block(attrs["id"], m.start()) if is_block else None)
            found.extend(b for b in stack[-1:] if b)
        elif closing:
            for part, start, inner in waiting:
                for block in filter(None, stack):
                    if start > block.start:
                        block.parts.setdefault(part, (start, inner, m.start(), m.end()))
            waiting.clear()
        else:
            classes = set(attrs.get("class", "").split())
            waiting.extend((part, m.start(), m.end()) for part, names in PART_CLASSES.items() if classes & names)
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page; pages are looked at few at a time, and blocks go out as soon as they are as many bytes as a batch may be."""
    names = ["doc_key", "place", "anchor", "heading_html", "title_html", "body_html"]
    for batch in pieces(batches, "html"):
        of, columns, held = [], [[] for _ in names[1:]], 0

        def out() -> pa.RecordBatch:
            kinds = pa.int32(), *[pa.string()] * 4
            return pa.RecordBatch.from_arrays([batch.column("doc_key").take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)  # noqa: B023

        for i, page in enumerate(batch.column("html")):
            page = page.as_py() or ""
            for place, block in enumerate(article_blocks(page)):
                end, body, at = len(page) if block.end is None else block.end, [], block.start
                for start, _, _, stop in sorted(block.parts.values()):
                    body += [page[at:start], " "]
                    at = stop
                inner = {part: page[span[1] : span[2]] for part, span in block.parts.items()}
                row = place, block.anchor, inner.get("heading"), inner.get("title"), "".join([*body, page[at:end]])
                of.append(i)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                held += len(row[-1])
                if held > CUT:
                    yield out()
                    of, columns, held = [], [[] for _ in names[1:]], 0
        if of:
            yield out()


def raw_blocks(pages: DataFrame) -> DataFrame:
    """(doc_key, place, anchor, heading_html, title_html, body_html) of (doc_key, html). Balanced tags are beyond regular expressions."""
    key = dict(pages.dtypes)["doc_key"]
    return pages.select("doc_key", "html").mapInArrow(_blocks, f"doc_key {key}, place int, anchor string, heading_html string, title_html string, body_html string")


def judged(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Blocks with their article number, heading, title, text, excerpt, and reason to drop them, null if they stay. limits: (doc_key, max_article).

    Texts are cut before the limits are joined, so what is shuffled is no longer than an article may be.
    """
    b = blocks.filter(~F.contains("anchor", F.lit("."))).withColumn("art", F.regexp_replace("anchor", "^art_", ""))
    b = b.withColumn("num", F.regexp_extract("art", r"(?i)^(\d+)([a-z]*)$", 1)).withColumn("suffix", F.lower(F.regexp_extract("art", r"(?i)^(\d+)([a-z]*)$", 2)))
    b = b.withColumn("num", F.expr("try_cast(num as bigint)"))
    # One row each; the explode keeps what uses a text from computing it again.
    texts = F.struct(*[html_text(F.col(f"{c}_html")).alias(c) for c in ("body", "heading", "title")])
    b = b.select("doc_key", "place", "art", "num", "suffix", F.explode(F.array(texts)).alias("_t"))
    heading, article = F.col("_t.heading"), F.concat(F.lit("Article "), F.col("art"))
    b = b.select(
        "doc_key", "place", "art", "num", "suffix", F.when(heading.rlike("(?i)^article"), heading).otherwise(article).alias("heading"), "_t.title", F.substring("_t.body", 1, TEXT_MAX).alias("text"),
        F.replace(F.substring("_t.body", 1, EXCERPT_MAX), F.lit("\n"), F.lit(" ")).alias("excerpt"), F.col("_t.body").rlike(rf"(?:\S\s*+){{{MIN_BODY}}}").alias("_filled"),
    )
    reason = (
        F.when(F.col("num").isNull(), "number format")
        .when((F.col("max_article") > 0) & (F.col("num") > F.col("max_article")), "above limit")
        .when(~F.col("_filled"), "empty body")
    )
    return b.join(limits, "doc_key", "left").withColumn("reason", reason).drop("_filled")


#: The outcome of a block that becomes an article; that of others is their reason, or null where an equal article came before.
KEPT = "kept"


def marked(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """Judged blocks with their ``outcome``. Of equal articles of a document the first that stays counts; later ones aren't looked at, so they aren't dropped either."""
    same = Window.partitionBy("doc_key", "art")
    blocks = judged(raw_blocks(pages), limits).withColumn("_first", F.min(F.when(F.col("reason").isNull(), F.col("place"))).over(same))
    outcome = F.when(F.col("reason").isNull(), F.when(F.col("place") == F.col("_first"), KEPT)).when((F.col("reason") != "empty body") | F.coalesce(F.col("place") <= F.col("_first"), F.lit(True)), F.col("reason"))
    return blocks.withColumn("outcome", outcome).drop("_first")


def chunk(pages: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, dropped): two readings of ``marked``."""
    blocks = marked(pages, limits)
    articles = blocks.filter(F.col("outcome") == KEPT).select("doc_key", "art", "num", "suffix", "heading", "title", "text", "excerpt", "place")
    return articles, blocks.filter(F.col("outcome") != KEPT).select("doc_key", "art", "reason")


def in_order(articles: DataFrame) -> DataFrame:
    """Articles by document, number and suffix: 3, 3a, 3b, 4."""
    return articles.orderBy("doc_key", "num", "suffix")


def first_n(articles: DataFrame, n: int) -> DataFrame:
    """At most n articles of each document, by number and suffix."""
    order = Window.partitionBy("doc_key").orderBy("num", "suffix")
    return articles.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")
