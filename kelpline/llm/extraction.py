"""HTML extraction: the blocks of a page, and nearest-URL page differencing.

A page is cut into blocks of text. What markup names as menu, header, footer, sidebar, notice, advert, form, script, style or
reader comment goes, but for a frame that holds the page's article. Where a page marks its article (``article``, ``main``), only blocks inside are its text.

Then every page is differenced: its blocks are aligned by longest common subsequence with those of the ``NEAR`` pages before and after it by URL path
in its host, and blocks shared with at least half of them are deleted. Markup protects: a block inside a marked article is deleted only where its element has a name
that may be boilerplate's (``related-work``, ``share-count``), as pages of one host quote the same passages. A neighbour that leaves a page no
block of its own is a copy of it and has no say.

The pages' block hashes, never their texts, are range-partitioned by (host, path, key), so a host with a third of all pages spans many partitions; pages near a
border are guests in the next partition. What goes back to a page is a bitmap of its deleted blocks.

Defined cases: null and empty html give an empty text; a null URL is the host and path ""; equal rows are one page, and answered alike;
a single page of a host keeps all blocks; unclosed elements end where HTML ends them (at the next paragraph, item or cell), with their parent or the page.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, n_partitions

#: Pages before and after a page that it is held against.
NEAR = 4
#: Bits of alignment rows that are held at once; longer alignments are halved.
MAX_BITS = 1 << 31

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w=-])(hidden)(?![\w=-])")
_RAW = frozenset("script style title textarea noscript template iframe svg math object head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_SPACE = frozenset("br td th img wbr".split())
_DROP = frozenset("nav footer aside form menu dialog button select search".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads advert adverts advertisement banner promo sponsor sponsored cookie "
    "cookies consent notice notices alert popup modal newsletter subscribe signup login search social share sharing related recommended comment comments disqus reply "
    "replies respond copyright pagination pager toolbar complementary contentinfo form dialog".split()
)
_HEADER_WORDS = frozenset(["header"])
_COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: Elements that hold others: an id names what these are, but only the place of a heading or paragraph; comments come in these.
_HOLDERS = frozenset("article aside center dd details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td th tr ul".split())
#: Blocks that class words don't drop: titles are parts of what they name, as elements within a line are of the line.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 caption legend summary figcaption".split())
#: A class such as has-sidebar or page-with-nav tells of a page that has one, or none; it doesn't name one.
_TELLS = frozenset("has have no not with without".split())
#: Start tags that end an open element of the key, unless one of its containers was opened since.
_ENDED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "td": frozenset("td th tr tbody thead tfoot".split()), "th": frozenset("td th tr tbody thead tfoot".split()), "tr": frozenset("tr tbody thead tfoot".split()),
    "tbody": frozenset("tbody tfoot".split()), "thead": frozenset("tbody tfoot".split()), "tfoot": frozenset(["tbody"]),
}
#: Elements that a stray end tag inside them doesn't reach beyond, but for those of the table itself.
_CELL = frozenset("td th caption".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())


def _names(name: str, attrs: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role that stand alone, those that are a part of a longer name, and whether the element is hidden."""
    alone: set[str] = set()
    parts: set[str] = set()
    hidden = False
    for key, a, b, c, bare in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "role") or (key == "id" and name in _HOLDERS):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
                if len(words) == 1:
                    alone.update(words)
                elif not _TELLS.intersection(words):
                    parts.update(words)
        hidden = hidden or bool(bare) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    if name not in _HOLDERS:
        alone, parts = alone - _COMMENT_WORDS, parts - _COMMENT_WORDS
    return alone, parts, hidden


def _closed(tags: list[tuple[str, int]], name: str) -> int | None:
    """Place in the open elements of the one that an end tag closes, if any."""
    for i in range(len(tags) - 1, -1, -1):
        if tags[i][0] == name:
            return i
        if tags[i][0] in _CELL and name not in _TABLE:
            return None
    return None


def _ended(tags: list[tuple[str, int]], name: str) -> int | None:
    """Place in the open elements of the outermost one that a start tag ends, as HTML has it for paragraphs, list items and cells."""
    found = None
    for i in range(len(tags) - 1, -1, -1):
        open_name = tags[i][0]
        if name in _ENDED_BY.get(open_name, ()):
            found = i
        elif open_name in _BLOCK and open_name not in _ENDED_BY:
            break
    return found


def page_lines(page: str | None) -> tuple[list[str], list[bool], bool]:
    """Blocks of a page in order, which of them differencing may delete, and whether they come from a marked article.

    An element that would be dropped but holds ``main``, or the only articles of the page, is its frame and stays. Where the page has more
    text outside of it than in it, that text stays too.
    """
    page = page or ""
    every, inside, asked, seen_mark, mains, articles = _parsed(page, frozenset())
    frames = mains if seen_mark else mains | articles
    if not frames:
        return (inside, asked, True) if seen_mark else (every, [True] * len(every), False)
    all_blocks, marked_blocks, marked_asked, _, _, _ = _parsed(page, frames)
    if sum(map(len, marked_blocks)) >= sum(map(len, inside if seen_mark else every)):
        return marked_blocks, marked_asked, True
    return all_blocks, [True] * len(all_blocks), False


def page_blocks(page: str | None) -> tuple[list[str], bool]:
    """Blocks of a page before differencing, and whether they come from a marked article."""
    blocks, _, marked = page_lines(page)
    return blocks, marked


def _parsed(page: str, frames: frozenset[int]) -> tuple[list[str], list[str], list[bool], bool, frozenset[int], frozenset[int]]:
    """Blocks, those in marked articles and which of these have a doubtful name, whether there is such an article, and places of the dropped
    elements that hold main or article. Those at ``frames`` stay."""
    every: list[str] = []
    inside: list[str] = []
    asked: list[bool] = []
    doubtful: list[int] = []  # for each open element with a doubtful name, how many block elements were open around it
    piece: list[str] = []
    marked = 0  # open article and main elements
    seen_mark = False
    drop = ""
    outer: list[tuple[str, int]] = []  # open block elements, with their places
    inner: list[tuple[str, int]] = []  # the same from the dropped element on
    comments = False
    mains: set[int] = set()
    articles: set[int] = set()
    only_headings, heading_depth = 0, 0  # inside a header of a marked article: open elements of its name
    header_tag, in_heading = "", False
    at, end = 0, len(page)
    low = None

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(piece)).split())
        piece.clear()
        if text:
            every.append(text)
            if marked:
                inside.append(text)
                asked.append(bool(doubtful))

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not drop and (not only_headings or in_heading):
            piece.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if drop:
            if closing:
                to = _closed(inner, name)
                if to is not None:
                    del inner[to:]
                    if not inner:
                        drop = ""
                    continue
                if name not in _BLOCK or any(t in _CELL for t, _ in inner) and name not in _TABLE or _closed(outer, name) is None:
                    continue
                drop = ""  # the parent's end
            else:
                to = _ended(inner, name)
                if to is None and name in ("article", "main") and drop != "article" and sum(t == drop for t, _ in inner) == 1:
                    low = low if low is not None else page.lower()
                    to = 0 if low.find(f"</{drop}", at) < 0 else None  # never closed
                if to is not None:
                    del inner[to:]
                    if not inner:
                        drop = ""
            if drop:
                if name in _RAW and not attrs.endswith("/"):
                    low = low if low is not None else page.lower()
                    to = low.find(f"</{name}", at)
                    if to >= 0:
                        at = to
                    continue
                if (name in _BLOCK or name == drop) and name not in _VOID and not attrs.endswith("/"):
                    if name in ("article", "main"):
                        alone, parts, hidden = _names(name, attrs)
                        if not hidden and not (alone | parts) & _COMMENT_WORDS and (name == "main" or not comments):
                            (mains if name == "main" else articles).update(i for _, i in inner)
                    inner.append((name, m.start()))
                continue
        if not closing and name in _RAW:
            if attrs.endswith("/"):
                continue
            low = low if low is not None else page.lower()
            to = low.find(f"</{name}", at)
            if to < 0 and name in ("head", "noscript", "object", "svg", "math"):
                continue
            if name in ("title", "textarea", "script", "style", "template", "iframe") and to < 0:
                break
            at = page.find(">", to)
            at = end if at < 0 else at + 1
            continue
        if name in _SPACE:
            piece.append(" ")
        if name not in _BLOCK and not attrs:
            continue
        if name in _BLOCK:
            close_block()
        if name in _BLOCK and name not in _VOID and not attrs.endswith("/"):
            to = _closed(outer, name) if closing else _ended(outer, name)
            if to is not None:
                del outer[to:]
                while doubtful and doubtful[-1] >= to:
                    doubtful.pop()
            if not closing:
                outer.append((name, m.start()))
        if closing:
            if name in ("article", "main") and marked:
                marked -= 1
            if only_headings and name == header_tag:
                only_headings -= 1
            if name in _HEADING:
                in_heading = False
            continue
        if name in _VOID or attrs.endswith("/"):
            continue
        alone, parts, hidden = _names(name, attrs) if attrs else (set(), set(), False)
        words = alone | parts
        if name in ("article", "main"):
            if (words & _COMMENT_WORDS or hidden) and m.start() not in frames:
                drop = name
            else:
                marked += 1
                seen_mark = True
        elif m.start() in frames:
            pass
        elif name not in ("body", "html") and (name in _DROP or hidden or ((name in _BLOCK or name in _CELL) and name not in _PARTS and (alone if marked else words) & _DROP_WORDS)):
            close_block()
            drop = name
        elif name == "header" or (words & _HEADER_WORDS and name in _BLOCK and name not in ("body", "html")):
            if not marked:
                drop = name
            elif not only_headings:
                only_headings, header_tag = 1, name
            elif name == header_tag:
                only_headings += 1
        elif only_headings and name == header_tag:
            only_headings += 1
        if drop:
            if name in _BLOCK:
                outer.pop()
            inner = [(name, m.start())]
            comments = bool(words & _COMMENT_WORDS)
        elif name in _HEADING:
            in_heading = True
        if not drop and marked and parts & _DROP_WORDS and name in _BLOCK:
            doubtful.append(len(outer) - 1)
    close_block()
    return every, inside, asked, seen_mark, frozenset(mains), frozenset(articles)


def lcs_mask(a: list[int], b: list[int]) -> list[bool]:
    """Which entries of ``a`` are in a longest common subsequence with ``b``. Rows of the alignment are whole-row bit operations."""
    mask = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        mask[lo] = True
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        mask[hi_a] = True
    mid_a, mid_b = a[lo:hi_a], [x for x in b[lo:hi_b] if x in set(a[lo:hi_a])] if hi_a > lo else []
    if mid_a and mid_b:
        mask[lo:hi_a] = _halved(mid_a, mid_b) if len(mid_a) * len(mid_b) > MAX_BITS and len(mid_a) > 1 else _aligned(mid_a, mid_b)
    return mask


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each entry of ``b``, the row so far: a 0 bit where the common length grows."""
    full = (1 << len(a)) - 1
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _aligned(a: list[int], b: list[int]) -> list[bool]:
    rows, mask = list(_rows(a, b)), [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            mask[i] = True
    return mask


def _halved(a: list[int], b: list[int]) -> list[bool]:
    """The same in linear space: both halves of ``a`` against the best cut of ``b``."""
    h = len(a) // 2
    head = [0, *(h - r.bit_count() for r in _rows(a[:h], b))]
    tail = [0, *(len(a) - h - r.bit_count() for r in _rows(a[h:][::-1], b[::-1]))][::-1]
    cut = max(range(len(b) + 1), key=lambda k: head[k] + tail[k])
    return lcs_mask(a[:h], b[:cut]) + lcs_mask(a[h:], b[cut:])


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(own: list[int], neighbours: list[list[int]]) -> list[bool]:
    """Which lines of a page at least half of its neighbours have in the same order, copies of the page aside."""
    masks = [m for m in (lcs_mask(own, other) for other in neighbours) if not all(m)]
    return [2 * sum(votes) >= len(masks) > 0 for votes in zip(*masks, strict=True)] if masks else [False] * len(own)


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


LINED = "k1 long, k2 long, host string, path string, lines array<long>, asked binary"


def _lined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        rows = []
        for k1, k2, url, page in zip(pdf["k1"], pdf["k2"], pdf["url"], pdf["html"], strict=True):
            blocks, asked, _ = page_lines(page)
            if blocks:
                rows.append((k1, k2, *host_and_path(url), [line_hash(x) for x in blocks], bytes(asked)))
        if rows:
            yield pd.DataFrame(rows, columns=["k1", "k2", "host", "path", "lines", "asked"])


def _at_borders(targets: dict[int, list[tuple[int, int]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The first and last rows of each partition, as guests of the partitions that they are near to. targets: for each partition the others, with the rows between."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail = None, None
        for pdf in filter(len, batches):
            head = pd.concat([head, pdf]).head(NEAR) if head is None or len(head) < NEAR else head
            tail = pd.concat([tail, pdf]).tail(NEAR)
        if head is None:
            return
        own = int(head["pid"].iloc[0])
        for other, gap in targets[own]:
            near = tail.iloc[::-1] if other > own else head
            if gap < NEAR:
                yield near.head(NEAR - gap).assign(pid=other, guest=True)

    return run


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, gone) of the pages of one sorted partition that lose blocks. Holds NEAR pages on either side of the one at hand."""
    held: list[dict] = []
    at = 0  # place in ``held`` of the first row that waits

    def answered(whole: bool) -> Iterator[tuple]:
        nonlocal at
        while at < len(held) and (whole or at + NEAR < len(held)):
            row = held[at]
            if not row["guest"]:
                near = [list(held[i]["lines"]) for i in range(max(0, at - NEAR), min(len(held), at + NEAR + 1)) if i != at and held[i]["host"] == row["host"]]
                gone = [s and bool(a) for s, a in zip(shared_lines(list(row["lines"]), near), row["asked"], strict=True)]
                if any(gone):
                    yield row["k1"], row["k2"], bytes(gone)
            at += 1
        cut = max(0, at - NEAR)
        del held[:cut]
        at -= cut

    for pdf in filter(len, batches):
        rows = []
        for row in pdf.to_dict("records"):
            if not held or (held[-1]["k1"], held[-1]["k2"]) != (row["k1"], row["k2"]):
                held.append(row)
                rows.extend(answered(False))
        if rows:
            yield pd.DataFrame(rows, columns=["k1", "k2", "gone"])
    rows = list(answered(True))
    if rows:
        yield pd.DataFrame(rows, columns=["k1", "k2", "gone"])


def deleted_blocks(keyed: DataFrame) -> DataFrame:
    """(k1, k2, gone): a byte for each block of the pages that lose some, 1 where it goes. keyed: k1, k2, url, html."""
    order = ["host", "path", "k1", "k2"]
    lined = checkpointed(keyed.mapInPandas(_lined, LINED))
    ranged = checkpointed(lined.repartitionByRange(n_partitions(keyed), *order).sortWithinPartitions(*order).withColumns({"pid": F.spark_partition_id(), "guest": F.lit(False)}))
    rows = {r["pid"]: r["n"] for r in ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    pids = sorted(rows)
    targets: dict[int, list[tuple[int, int]]] = {}
    for i, pid in enumerate(pids):
        targets[pid] = []
        for others in (pids[i + 1 :], pids[:i][::-1]):
            gap = 0
            for other in others:
                if gap >= NEAR:
                    break
                targets[pid].append((other, gap))
                gap += rows[other]
    guests = ranged.mapInPandas(_at_borders(targets), ranged.schema)
    return ranged.unionByName(guests).repartition(n_partitions(keyed), "pid").sortWithinPartitions("pid", *order).mapInPandas(_by_range, "k1 long, k2 long, gone binary").dropDuplicates(["k1", "k2"])


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_deleted`` for each range of a partition, which may hold several."""
    def pieces() -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            pids = pdf["pid"].to_numpy()
            for a, b in itertools.pairwise(np.r_[0, np.flatnonzero(np.diff(pids)) + 1, len(pids)]):
                yield pdf.iloc[a:b]

    for _, of_range in itertools.groupby(pieces(), key=lambda p: p["pid"].iloc[0]):
        yield from _deleted(of_range)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        texts = []
        for page, gone in zip(pdf["html"], pdf["gone"], strict=True):
            blocks = page_lines(page)[0]
            texts.append("\n".join(blocks if gone is None else [x for x, g in zip(blocks, gone, strict=True) if not g]))
        yield pd.DataFrame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    # Ids pass through pandas as text, where a null among them doesn't turn them into floating-point numbers.
    keyed = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", *[F.xxhash64(F.lit(k), "page_id", "url", "html").alias(f"k{k}") for k in (1, 2)])
    marks = deleted_blocks(keyed.select("k1", "k2", "url", "html"))
    texts = keyed.join(marks, ["k1", "k2"], "left").select("page_id", "url", "html", "gone").mapInPandas(_texts, "page_id string, url string, text string, n_chars long")
    return texts.withColumn("page_id", F.col("page_id").cast("long"))
