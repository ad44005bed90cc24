"""Main text of web pages: nearest-URL page differencing, with the markup as its guard.

Each page is parsed into lines: the text of its blocks, menus and notices included. Pages of a host are ordered by URL
path; each is paired with the neighbour that shares the longer path prefix, their lines are aligned by longest common
subsequence, and shared lines are deleted. The alignment is found exactly, in memory for a few rows of lines: bits of a
whole row are worked on at once, and long pages are halved where a longest alignment passes.

The markup guards on both sides. Lines inside an article or main element stay though they are shared: pages of a host
may have articles in common. Lines that markup calls no article text (menus, headers, footers, sidebars, forms,
adverts, notices, comments, and what stands beside an article that has more text) go though no neighbour shares them. All
others are open, and the differencing alone decides on them: those of pages without such elements, and link lists inside
an article. On a page without article or main whose every line is in parts told by class or id alone, those lines are
open too, unless all such names are of adverts or notices. If no line would be left, the page is a copy of its
neighbour, and no open line is deleted. Scripts and styles are no lines.

All pages are cut into ranges of the order (host, path, id, a hash of the html, url), so no task gets a whole host. The first
and the last pages of a range are sent to the ranges beside it too, so each page meets its nearest URLs of the whole host.
There are ``RANGES_A_TASK`` ranges for each shuffle partition at most (or 1,024), dealt to them in turn.

Nulls and edges: null html is empty; a null url is a host of its own; repeated pages are pages of their own (ties in
the path are ordered by id, a hash of the html and url); tags cut off at the end of a page are dropped; empty tables give no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table

# HTML element names and the usual names of page parts.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head header iframe input menu nav noscript object option select svg template textarea title video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
#: Without an end tag these take the rest of the page; of the others only the tag itself goes.
_TO_END = frozenset({"script", "style", "textarea", "title"})
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PARTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside a part's name in a dashed class; beside others (ad-free-content) the name says nothing.
FRAMES = frozenset("area bar block bottom box button buttons container form frame group inner item items label left link links list outer panel right row section slot text title top unit wrap wrapper".split())
_CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
_SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())

#: A quote opens a value only behind an equals sign, and only if it is closed again.
_VALUES = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_VALUES}>|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>{_VALUES})(?:>|\Z)", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

DROPPED_LINE, OPEN, ARTICLE = 0, 1, 2
#: Names of parts that a page without article and main may also give its article.
_VAGUE = frozenset("header masthead menu related sidebar toolbar widget".split())
_NAMED = 1 << 20  # depth of a dropped element that is none but by such a name
#: The order of the pages.
KEY = ("host", "path", "id", "mark", "address")
#: Each range costs the driver a sample of some hundred keys.
RANGES_A_TASK = 4


def _names_part(word: str) -> bool:
    """Whether a word of a class or id names a part of a page that is no article text."""
    pieces = word.split("-")
    return pieces[-1] in PARTS or pieces[0] in PARTS and all(x in PARTS or x in FRAMES or x.isdigit() for x in pieces[1:])


def _part(name: str, attrs: str) -> int:
    """Whether an element is no article text: 2 by its name, role, class or id, 1 by a vague class or id alone, else 0."""
    if name in DROPPED:
        return 2
    found = 0
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return 2
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for word in filter(_names_part, re.split(r"[\s_]+", value)):
                found = max(found, 1 if set(word.split("-")) & PARTS <= _VAGUE else 2)
    return found


def parse_blocks(html: str) -> list[tuple[int, str]]:
    """(state, text) of the lines of a page in order."""
    stack: list[tuple[str, int, int]] = []  # element, dropped depth, article depth
    dropped = article = 0
    lines: list[tuple[int, str, int]] = []
    vague: set[int] = set()  # places of lines that are dropped by vague names alone
    endless: set[str] = set()  # raw elements without a further end tag
    text: list[str] = []
    beside: list[str] = []  # of dropped elements inside the block
    linked = total = 0
    links = 0
    named = True  # whether all of ``beside`` is dropped by vague names alone

    def flush() -> None:
        nonlocal linked, total, named
        for pieces in (text, beside):
            if pieces:
                block = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
                if block and pieces is beside:
                    if named:
                        vague.add(len(lines))
                    lines.append((DROPPED_LINE, block, 0))
                elif block:
                    lines.append((ARTICLE if article and not (total and linked > 0.5 * total) else OPEN, block, article))
                pieces.clear()
        linked = total = 0
        named = True

    def leave(depth: int) -> None:
        nonlocal dropped, article, links
        while len(stack) > depth:
            name, was_dropped, was_article = stack.pop()
            if name == "a":
                links = max(0, links - 1)
            dropped, article = was_dropped, was_article

    def words(piece: str) -> None:
        nonlocal linked, total, named
        if piece and dropped:
            beside.append(piece)
            named = named and (dropped % _NAMED == 0 or not piece.strip())
        elif piece:
            text.append(piece)
            size = len(piece.strip())
            total += size
            linked += size if links else 0

    at = 0
    while m := _TOKEN.search(html, at):
        words(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"]:
            raw = m["raw"].lower()
            if not (raw == "svg" and m[0].endswith("/>") or raw in endless):
                if end := _RAW_END[raw].search(html, at):
                    at = end.end()
                elif raw in _TO_END:
                    at = len(html)
                else:
                    endless.add(raw)
            if raw in ("title", "textarea"):
                flush()
            continue
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in _SCOPES and name not in BLOCK), None)
            if depth is not None and stack[depth][0] == name:
                leave(depth)
            continue
        while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
            leave(len(stack) - 1)
        if name in BLOCK:  # an open paragraph, and what is open inside it, ends where a block begins
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in _SCOPES), None)
            if depth is not None and stack[depth][0] == "p" and name != "br":
                leave(depth)
        if name in VOID or (m["attrs"] or "").rstrip().endswith("/"):
            continue
        stack.append((name, dropped, article))
        if name == "a":
            links += 1
        if part := _part(name, m["attrs"] or "") or 2 * bool(dropped % _NAMED):
            dropped += _NAMED if part == 1 else 1
        elif dropped:
            dropped += _NAMED
        elif name in ("article", "main"):
            article += 1
    words(re.sub(r"</?\Z", "", html[at:]))
    flush()
    size = lambda inner: sum(len(x) for state, x, a in lines if state != DROPPED_LINE and bool(a) == inner)
    inside = any(a for _, _, a in lines)
    if inside and size(True) < size(False):
        inside = False  # what is marked as the article is its smaller part: its title, say
        vague.clear()
    elif not lines or any(state != DROPPED_LINE for state, _, _ in lines):
        vague.clear()
    return [(OPEN if i in vague and not inside else state if a or not inside else DROPPED_LINE, x) for i, (state, x, a) in enumerate(lines)]


#: Bits of the rows that are kept to trace an alignment back.
_AREA = 1 << 23


def _masks(b: list[str], wanted: set[str]) -> dict[str, int]:
    """For each wanted line the bits of its places in ``b``."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        if line in wanted:
            places[line].append(j)
    masks = {}
    for line, at in places.items():
        if len(at) < 16:
            masks[line] = sum(1 << j for j in at)
        else:
            bits = np.zeros(len(b), np.uint8)
            bits[at] = 1
            masks[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return masks


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of ``a``, the places j of ``b`` where a longest common subsequence with b[: j + 1] is no longer than with b[:j], as bits."""
    masks, every = _masks(b, set(a)), (1 << len(b)) - 1
    row = every
    for line in a:
        hits = row & masks.get(line, 0)
        row = (row + hits | row - hits) & every
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The lengths of longest common subsequences of ``a`` with b[:j], for each j."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    out: set[int] = set()
    parts = [(0, len(a), 0, len(b))]
    while parts:
        low, high, left, right = parts.pop()
        n, m = high - low, right - left
        if not n or not m:
            continue
        if n > 1 and n * m > _AREA:
            # halves of ``a`` meet where their longest ones add up to the longest of all
            middle = low + n // 2
            head = _lengths(a[low:middle], b[left:right])
            tail = _lengths(a[middle:high][::-1], b[left:right][::-1])[::-1]
            cut = left + int(np.argmax(head + tail))
            parts += [(low, middle, left, cut), (middle, high, cut, right)]
            continue
        rows = [x.to_bytes(m // 8 + 1, "little") for x in _rows(a[low:high], b[left:right])]
        flat_at = lambda i, j: rows[i][j >> 3] >> (j & 7) & 1  # noqa: B023, E731
        i, j = n, m
        while i and j:
            if flat_at(i - 1, j - 1):
                j -= 1
            else:
                i -= 1
                if not i or flat_at(i - 1, j - 1):
                    out.add(low + i)
                    j -= 1
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """``common_lines``, where equal beginnings and ends are aligned first: both are part of some longest one."""
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    end = 0
    while end < least - low and a[-1 - end] == b[-1 - end]:
        end += 1
    middle = common_lines(a[low : len(a) - end], b[low : len(b) - end])
    return {*range(low), *(low + i for i in middle), *range(len(a) - end, len(a))}


def difference(lines: list[tuple[int, str]], other: list[tuple[int, str]]) -> tuple[str, int, int]:
    """The text of the kept lines of a page, held against its neighbour's; how many lines are not in it only because of the alignment, and how many by their markup."""
    shared = shared_lines([x for _, x in lines], [x for _, x in other])
    kept = [i for i, (state, _) in enumerate(lines) if state != DROPPED_LINE]
    gone = {i for i in kept if i in shared and lines[i][0] == OPEN}
    if len(gone) == len(kept):
        gone = set()
    return "\n".join(lines[i][1] for i in kept if i not in gone), len(gone), len(lines) - len(kept)


def placed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the columns of ``KEY``."""
    address = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z]*://", "")
    host = F.regexp_extract(address, r"^[^/?#]*", 0)
    path = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z]*://[^/?#]*", ""), r"[?#].*$", "")
    ties = (F.coalesce(F.col("page_id").cast("string"), F.lit("None")).alias("id"), F.xxhash64("html").alias("mark"), F.coalesce("url", F.lit("")).alias("address"))
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), *ties)


def range_ends(rows: DataFrame, count: int) -> list[tuple[tuple, tuple]]:
    """The first and the last key of each of about ``count`` ranges of the rows, in order."""
    if count < 2:
        return []
    key = F.struct(*KEY)
    ranged = rows.select(*KEY).repartitionByRange(count, *KEY).withColumn("range", F.spark_partition_id())
    found = ranged.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    return sorted((tuple(r["first"]), tuple(r["last"])) for r in found)


def parsed(rows: DataFrame, ends: list[tuple[tuple, tuple]]) -> DataFrame:
    """page_id, url, the columns of ``KEY`` and the packed blocks of each page, for its range and (not ``own``) for those it borders on."""
    firsts, lasts = [first for first, _ in ends], [last for _, last in ends]

    def run(texts: pa.Array, *keys: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=1)
        out, ranges = [], []
        for i, key in enumerate(zip(*(k.to_pylist() for k in keys), strict=True)):
            blocks = parse_blocks(texts[i].as_py() or "")
            out.append(packer.compress("\n".join(f"{state}{block}" for state, block in blocks).encode("utf-8", "replace")))
            at = max(0, bisect_right(firsts, key) - 1)
            ranges.append([at])
            if at and key == firsts[at]:
                ranges[-1].append(at - 1)
            if at + 1 < len(ends) and key == lasts[at]:
                ranges[-1].append(at + 1)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(ranges, pa.list_(pa.int32()))], ["blocks", "ranges"])

    done = rows.select("page_id", "url", *KEY, F.arrow_udf(run, "struct<blocks:binary,ranges:array<int>>")("html", *KEY).alias("done"))
    flat = done.select("page_id", "url", *KEY, "done.blocks", F.posexplode("done.ranges").alias("copy", "range"))
    return flat.withColumn("own", F.col("copy") == 0).drop("copy")


def _unpacked(blob: bytes) -> list[tuple[int, str]]:
    text = zstandard.ZstdDecompressor().decompress(blob).decode()
    return [(int(x[0]), x[1:]) for x in text.split("\n")] if text else []


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(pages: DataFrame, group: int = 400) -> DataFrame:
    """page_id, url, text, n_shared (lines that would be in the text without the neighbour) and n_marked (lines deleted by their markup) of every row of (page_id, url, html).

    ``group`` pages or more are a range, the result is the same for all.
    """
    limit_batches(pages.sparkSession)
    rows = placed(pages)
    tasks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = range_ends(rows, min(max(1024, RANGES_A_TASK * tasks), -(-pages.count() // group)))
    kind = dict(pages.dtypes)["page_id"]
    names = ["range", "own", "host", "path", "blocks", "page_id", "url"]

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = now = None  # rows, as lists of range, own, host, path, blocks, page_id and url

        def lines(row: list) -> list[tuple[int, str]]:
            if isinstance(row[4], bytes):
                row[4] = _unpacked(row[4])
            return row[4]

        def text(before: list | None, row: list, after: list | None) -> tuple[str, int, int]:
            near = [(-_prefix(row[3], x[3]), k, x) for k, x in ((0, before), (1, after)) if x is not None and (x[0], x[2]) == (row[0], row[2])]
            return difference(lines(row), lines(min(near, key=lambda x: x[:2])[2]) if near else [])

        def result(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind_of_id, pa.string(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_shared", "n_marked"])

        for batch in batches:
            kind_of_id, done = batch.schema.field("page_id").type, []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                after = list(row)
                if now is not None and now[1]:
                    done.append((*now[5:], *text(last, now, after)))
                last, now = now, after
            if done:
                yield result(done)
        if now is not None and now[1]:
            yield result([(*now[5:], *text(last, now, None))])

    dealt = parsed(rows, ends).repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range", *KEY)
    return dealt.select(*names).mapInArrow(differ, f"page_id {kind}, url string, text string, n_shared int, n_marked int")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars, n_shared and n_marked of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
