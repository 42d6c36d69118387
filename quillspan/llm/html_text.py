"""Operator 4, main text of web pages by nearest-URL page differencing.

Each page is read into blocks of text with what is known of their place (menus, footers, adverts and the like by element,
class or role; the article by its element). Of every page a small outline (block hashes, a sketch of each block's words) is put
in order of host, URL path and id, dealt out by range so that a large host spreads over many tasks. A page's neighbours are
the nearest pages of its host in that order that are no copies of it; each part of the order hands its outermost distinct pages
to the parts beside it, so a part's edge hides no neighbour. The blocks of a page and its neighbour are aligned by longest
common subsequence, and a shared block is template text; inside an article element, only a block that several neighbours
share is. What goes is joined back to the pages by a key.

Copies are told by what two pages do not share: where that says the same, or one page has nothing of its own, shared blocks are
no template. A run of copies is held as one page, however long it is.

Defined cases: a null or empty page has an empty text; malformed and unclosed markup is read to the end of the page; repeated
rows each get their row; a null URL is a host of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@-][\w:.@-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
SPACE = re.compile(r"\s+")

# Elements by what they do to text.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object audio video xmp noframes".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu fieldset datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
PLAIN_ROOTS = frozenset(("html", "body", "article", "main"))
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar widget widgets share sharing social related recommended comment comments disqus respond replies breadcrumb breadcrumbs menu nav navbar navigation footer popup modal overlay newsletter subscribe subscription signup login search pagination pager toolbar masthead skip".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TASK_PAGES, MOST_PAGES = 200, 20_000  #: pages that a task has at least and, where there are many, about at most
NEIGHBOURS = 4  #: distinct pages to each side that a page is held against
SEVERAL = 3  #: distinct neighbours that must share a block of an article before it is template text
SAMPLE = 50  #: places sampled for each part of the order
BROADCAST_ROWS = 100_000  #: pages with template text up to which what goes is sent to every executor; beyond, pages are shuffled
SKETCH = 16  #: hashes kept of a block's words
CELLS = 1 << 27  #: cells of a table of lengths that is kept, a bit each

Block = tuple[str, bool]  #: text, and whether it stands inside the page's article


def is_noise(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element's text is none of the article's."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside_main
    if tag in PLAIN_ROOTS or not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id") and not NOISE.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
        if name == "role" and value in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, without those of dropped elements; character references are decoded."""
    out: list[Block] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, inside the article
    opened: Counter = Counter()  # elements of the stack, so that no tag has to look through it
    at, end = 0, len(page)

    def close() -> None:
        if piece:
            text = SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if text:
                out.append((text, bool(stack) and stack[-1][2]))
            piece.clear()

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            piece.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                at = over.end() if over else end
            piece.append(" ") if piece else None
            continue
        if tag in INLINE and (tag in VOID or closing or not attributes):
            if tag == "br":
                piece.append(" ")
            if not closing:
                continue
            if not opened[tag]:
                continue
        if tag not in INLINE:
            close()
        if tag in VOID:
            continue
        if closing:
            while opened[tag]:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            opened[stack.pop()[0]] -= 1  # an open paragraph ends where a block begins
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag in INLINE and not (dropped or is_noise(tag, attributes, inside)):
            continue  # an inline element matters only where its text goes
        stack.append((tag, dropped or is_noise(tag, attributes, inside), inside or tag in MAIN and not dropped))
        opened[tag] += 1
    close()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """For each beginning of ``a`` a row of bits over ``b``: 0 where one more element of ``b`` makes the longest common subsequence longer."""
    masks: dict = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for line in a:
        both = row & masks.get(line, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and each beginning of ``b``."""
    row = deque(_rows(a, b), maxlen=1)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """A longest common subsequence of two lists of lines, as the places in each.

    Rows of the table of lengths are bits of whole numbers, 64 cells an instruction, and equal lines are never paired up. A table of more than
    ``CELLS`` cells is not kept: the longer list is halved where the two halves' lengths are greatest together.
    """
    if not a or not b:
        return [], []
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        left, right = common_lines(a[:half], b[:at]), common_lines(a[half:], b[at:])
        return left[0] + [half + k for k in right[0]], left[1] + [at + k for k in right[1]]
    rows = list(_rows(a, b))
    i, j = len(a), len(b)
    left, right = [], []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> (j - 1) & 1:
                j -= 1
                left.append(i)
                right.append(j)
    return left[::-1], right[::-1]


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; equal beginnings and ends need no search."""
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    found, _ = common_lines(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*range(head), *(head + k for k in found), *range(len(a) - tail, len(a))]


class Page:
    """What neighbours are told by: the hash of every block, whether it stands in the article, and a sketch of its words."""

    def __init__(self, key: int, marks: list[int], inside: list[bool], sketches: list[bytes]):
        self.key, self.marks, self.inside, self.sketches = key, marks, inside, sketches

    def rest(self, shared: list[int]) -> set[int]:
        gone = set(shared)
        return {x for k, s in enumerate(self.sketches) if k not in gone for x in array("I", s)}


def mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def sketch(text: str) -> bytes:
    """The least ``SKETCH`` hashes of the block's runs of three words."""
    words = text.split(" ")
    runs = {zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))}
    return array("I", sorted(runs)[:SKETCH]).tobytes()


def are_copies(a: Page, b: Page) -> bool:
    """Whether the blocks that two pages do not share say the same, or one has none: then shared blocks are no template.

    How much they share says nothing: a short article under a large template shares most of its page.
    """
    if a.marks == b.marks:
        return True
    left, right = a.rest(shared_places(a.marks, b.marks)), b.rest(shared_places(b.marks, a.marks))
    return not left or not right or 2 * len(left & right) >= max(len(left), len(right))


def passed(recent: list[Page], page: Page) -> list[Page]:
    """The last distinct pages, the last one at the end, once ``page`` is passed; one stands for all copies of it."""
    if not page.marks:
        return recent
    return [r for r in recent if not are_copies(r, page)][-NEIGHBOURS:] + [page]


def sides(pages: list[Page], before: list[Page], after: list[Page]) -> Iterator[tuple[Page, list[Page], list[Page]]]:
    """Every page of a host with its nearest distinct pages to both sides, the nearest first."""

    def walk(run: Iterable[Page], recent: list[Page]) -> list[list[Page]]:
        out = []
        for page in run:
            recent = passed(recent, page)
            out.append(recent[-2::-1] if page.marks else [])
        return out

    yield from zip(pages, walk(pages, before), reversed(walk(reversed(pages), after)))


def template(page: Page, back: list[Page], ahead: list[Page]) -> list[int]:
    """Places of the page's blocks that are template text.

    Outside an article one neighbour tells. Inside, a passage may well stand on two pages (a licence, a quotation), so there
    a block is template only if ``SEVERAL`` neighbours or more were looked at and all of them share it.
    """
    if not any(page.inside):
        near = back[:1] or ahead[:1]
        return shared_places(page.marks, near[0].marks) if near else []
    near = sorted([*enumerate(back), *enumerate(ahead)], key=lambda x: x[0])[:NEIGHBOURS]
    if len(near) < SEVERAL:
        return []
    gone = {k for k, inside in enumerate(page.inside) if inside}
    kept = len(gone)
    for _, other in near:
        gone.intersection_update(shared_places(page.marks, other.marks))
        if not gone:
            return []
    return sorted(gone) if len(gone) < kept else []


def main_text(blocks: list[Block], shared: set[int]) -> str:
    """The article's blocks where the page has an article, else every block; those that are template text go."""
    article = any(inside for _, inside in blocks)
    return "\n".join(text for k, (text, inside) in enumerate(blocks) if k not in shared and (inside or not article))


def batches_of(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names))


def place(host: str, path: str, page_id: int | None) -> tuple:
    return host, path, page_id is not None, page_id or 0


def bounds(pages: DataFrame, parts: int, n: int) -> list[tuple]:
    """Where each part of the order but the first begins, from a sample of the pages' places (the pages themselves are not read)."""
    places = pages.select("host", "path", "page_id")
    some = sorted(place(*r) for r in (places if n <= parts * SAMPLE else places.sample(parts * SAMPLE / n, seed=1)).collect()) if parts > 1 else []
    return [some[k * len(some) // parts] for k in range(1, parts)] if some else []


def outlines(pages: DataFrame, starts: list[tuple]) -> DataFrame:
    """``part, key, host, path, page_id, marks, inside, sketches`` of every page."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks_of(page) for page in b.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    pa.array([bisect_right(starts, place(*p)) for p in batches_of(b, "host", "path", "page_id")], pa.int32()),
                    *(b.column(c) for c in ("key", "host", "path", "page_id")),
                    pa.array([[mark(t) for t, _ in x] for x in found], pa.list_(pa.int64())),
                    pa.array([[i for _, i in x] for x in found], pa.list_(pa.bool_())),
                    pa.array([[sketch(t) for t, _ in x] for x in found], pa.list_(pa.binary())),
                ],
                names=["part", "key", "host", "path", "page_id", "marks", "inside", "sketches"],
            )

    return pages.mapInArrow(run, "part int, key long, host string, path string, page_id long, marks array<long>, inside array<boolean>, sketches array<binary>")


def parts_of(batches) -> Iterator[tuple[int, list[tuple[str, list[Page]]]]]:
    """Each part of the order with its hosts' pages; rows come sorted."""
    part, hosts = None, []
    for b in batches:
        for n, host, *page in batches_of(b, "part", "host", "key", "marks", "inside", "sketches"):
            if n != part:
                if hosts:
                    yield part, hosts
                part, hosts = n, []
            if not hosts or hosts[-1][0] != host:
                hosts.append((host, []))
            hosts[-1][1].append(Page(*page))
    if hosts:
        yield part, hosts


def ends(batches) -> Iterator[pa.RecordBatch]:
    """Of each part its first and last host, and the distinct pages that the parts beside it look at."""
    for part, hosts in parts_of(batches):
        (first, begin), (last, end) = hosts[0], hosts[-1]
        head: list[Page] = reduce(passed, reversed(begin), [])
        tail: list[Page] = reduce(passed, end, [])
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pickle.dumps((len(hosts) == 1, first, last, head, tail))], pa.binary())], names=["part", "ends"])


def carried(known: list[tuple[int, bytes]]) -> dict[int, tuple[list[Page], list[Page]]]:
    """For each part the distinct pages of its first host before it, and of its last host behind it."""
    parts = [(part, *pickle.loads(e)) for part, e in sorted(known)]
    before, after = {}, {}
    host, recent = None, []
    for part, single, first, last, _, tail in parts:
        before[part] = recent if host == first else []
        host, recent = last, reduce(passed, tail, before[part] if single else [])
    host, recent = None, []
    for part, single, first, last, head, _ in reversed(parts):
        after[part] = recent if host == last else []
        host, recent = first, reduce(passed, head, after[part] if single else [])
    return {part: (before[part], after[part]) for part in before}


def templates(pages: DataFrame) -> DataFrame:
    """``t_key`` and ``places`` of the pages that have template text."""
    spark = pages.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = pages.count()
    parts = max(1, min(most, n // TASK_PAGES), n // MOST_PAGES)
    known = staged(outlines(pages, bounds(pages, parts, n)), "outlines")
    dealt = known.repartition(parts, "part").sortWithinPartitions("part", "host", "path", "page_id", "key")
    beside = carried([(r["part"], bytes(r["ends"])) for r in dealt.mapInArrow(ends, "part int, ends binary").collect()])
    sent = spark.sparkContext.broadcast(pickle.dumps(beside))

    def run(batches) -> Iterator[pa.RecordBatch]:
        beside = pickle.loads(sent.value)
        for part, hosts in parts_of(batches):
            before, after = beside[part]
            keys, places = [], []
            for k, (_, own) in enumerate(hosts):
                for page, back, ahead in sides(own, before if k == 0 else [], after if k == len(hosts) - 1 else []):
                    if gone := template(page, back, ahead):
                        keys.append(page.key)
                        places.append(gone)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["t_key", "places"])

    # Repeated rows have the same neighbours, and one entry.
    return dealt.mapInArrow(run, "t_key long, places array<int>").dropDuplicates(["t_key"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(blocks_of(page), set(gone or ())) for page, gone in batches_of(b, "html", "places")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    url = F.coalesce("url", F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/]*:?//([^/?#]*)", 1)), r"^.*@|:[0-9]*$", "")
    path = F.regexp_extract(url, r"^[^:/]*:?//[^/?#]*([^?#]*)", 1)
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("*", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url", "html").alias("key"))
    gone = staged(templates(given), "templates")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    found = given.join(gone, F.col("key") == F.col("t_key"), "left")
    return found.select("page_id", "url", "html", "places").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
