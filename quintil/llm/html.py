"""Main text of web pages by nearest-URL page differencing.

A page is read into blocks of text in page order; each block knows whether markup names its place (navigation, advert,
form, comments and the like) or puts it into an article. Pages are ordered by URL path within their host and paired with
the neighbour that shares the longer beginning of the path. The blocks of a pair are aligned by a longest common
subsequence. Blocks in a named place go; where the page marks no article, blocks shared with the pair go too. Blocks of
a marked article stay even if the pair shares them, since articles quote and copy each other. The alignment decides on an
article's paragraphs and headings whose class only holds such a name as a part (``share-line``, ``related-work``): those
that the pair shares go, the others stay. Of an article's own header the headings stay.

Null html counts as empty and gives an empty text. Unclosed and cut-off markup is read as far as it goes: an element such
as a script that is never closed ends at the next tag, and a self-closed drawing or formula holds nothing. A null URL has
the empty host. Equal rows are paired once and each keeps its row. Other columns are not kept, but for ``kept``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintil.operators.order import order_rank

OUT, NEUTRAL, MAIN, UNSURE = 0, 1, 2, 3  # unsure: in an article, under a name that only holds a place's name as a part
# Element names of HTML by their role in a page.
RAW = frozenset("script style textarea title noscript template svg math iframe object xmp noembed noframes".split())
HIDDEN = frozenset("nav footer aside form button select dialog menu head datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
NESTED = frozenset(
    "div section article main nav header footer aside form ul ol dl table figure dialog menu button select span details fieldset blockquote hgroup head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adbox|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w+|"
    r"signup|nav|navbar|navigation|menus?|submenu|breadcrumbs?|pager|pagination|sidebar|widgets?|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|disqus|replies|respond|footer|header|masthead|topbar|toolbar|skip|copyright|login|search)(?:$|[\s_-])",
    re.I,
)
# A comment, a declaration, or a tag with quoted or bare attributes; the last form takes a tag whose quotes do not close.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w=-])(hidden)(?![\w=-])")
SPACE = re.compile(r"\s+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
NEXT_TAG = re.compile(r"<[a-zA-Z/!]")


def _marked(tag: str, attributes: str) -> bool:
    """Whether attributes name a place outside the text."""
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if m[5] or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and tag not in ("html", "body") and NAMES.search(value):
            return not (tag in ("article", "main") and not re.search("comment|repl", value, re.I))
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _named_in_part(attributes: str) -> bool:
    """Whether what marks a place is a part of a class or identifier, and nothing else."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if m[5] or name in ("aria-hidden", "style", "role") and _marked("p", m[0]):
            return False
        if name in ("class", "id") and any(NAMES.fullmatch(part) for part in value.split()):
            return False
    return True


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each block that holds text."""
    page = page or ""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open nesting elements and the zone inside them
    zone, single, at = NEUTRAL, None, 0  # single: zone of an open block that is not nested, such as a named paragraph
    endless: set[str] = set()  # elements known not to be closed any more

    def flush() -> None:
        nonlocal single
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, zone if single is None else single))
        single = None

    for m in iter(lambda: TAG.search(page, at), None):
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if name in ("svg", "math") and attributes.rstrip().endswith("/"):
                continue
            end = None if name in endless else ENDS[name].search(page, at)
            if end is None:
                endless.add(name)
                end = NEXT_TAG.search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th", "dt"):
            parts.append(" ")
        if name in NESTED:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if name == "span" and stack[i][1] != zone:
                            flush()
                        zone = stack[i][1]
                        del stack[i:]
                        break
            else:
                inside = zone
                if zone != OUT:
                    if name in HIDDEN or _marked(name, attributes) or name == "header":
                        inside = OUT
                    elif name in ("article", "main"):
                        inside = MAIN
                if name == "span" and inside != zone:
                    flush()
                stack.append((name, zone))
                zone = inside
        elif name in BLOCKS and not closing:
            if name in HEADINGS and zone == OUT and stack and stack[-1] == ("header", MAIN):
                single = MAIN  # the title of an article
            elif zone != OUT and _marked(name, attributes):
                single = UNSURE if zone == MAIN and _named_in_part(attributes) else OUT
    parts.append(page[at:])
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence, by Hirschberg's halving over bit-parallel rows."""
    shared = set(a) & set(b)
    left, right = [(i, x) for i, x in enumerate(a) if x in shared], [x for x in b if x in shared]
    out: set[int] = set()

    def lengths(x: list[int], y: list[int]) -> np.ndarray:
        """Length of the common subsequence of x with each beginning of y."""
        masks: dict[int, int] = {}
        for i, v in enumerate(y):
            masks[v] = masks.get(v, 0) | 1 << i
        full = (1 << len(y)) - 1
        row = full
        for v in x:
            match = masks.get(v, 0)
            row = ((row + (row & match)) | (row & ~match)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]

    work = [(left, right)]
    while work:
        x, y = work.pop()
        while x and y and x[0][1] == y[0]:
            out.add(x[0][0])
            x, y = x[1:], y[1:]
        while x and y and x[-1][1] == y[-1]:
            out.add(x[-1][0])
            x, y = x[:-1], y[:-1]
        if not x or not y:
            continue
        if len(x) == 1:
            if x[0][1] in y:
                out.add(x[0][0])
            continue
        half = len(x) // 2
        up = lengths([v for _, v in x[:half]], y)
        down = lengths([v for _, v in x[half:]][::-1], y[::-1])[::-1]
        cut = int(np.argmax(up + down))
        work += [(x[:half], y[:cut]), (x[half:], y[cut:])]
    return out


def _line_ids(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) >> 1 for t in lines]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_blocks, n_shared) for every page; ``n_shared`` counts blocks aligned with the pair's."""
    named = pages.select(
        pages[key].alias("k"),
        pages[url].alias("u"),
        pages[page].alias("p"),
        F.xxhash64(pages[key], pages[url], pages[page]).alias("row"),
    )
    address = F.regexp_extract(F.coalesce("u", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("u", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 2)
    places = named.select("row", F.lower(address).alias("host"), path.alias("path")).distinct()
    ranked = order_rank(places, ["path", "row"], "rank", ["host"])

    def near(shift: int) -> DataFrame:
        return ranked.select("host", (F.col("rank") + shift).alias("rank"), F.col("row").alias(f"row{shift}"), F.col("path").alias(f"path{shift}"))

    both = ranked.join(near(1), ["host", "rank"], "left").join(near(-1), ["host", "rank"], "left")

    def alike(other: str) -> Column:
        """Length of the common beginning of two paths, in segments."""
        mine, theirs = F.split("path", "/"), F.split(other, "/")
        equal = F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.array_position(F.concat(equal, F.array(F.lit(False))), False)

    before = F.col("row-1").isNull() | (F.col("row1").isNotNull() & (alike("path1") >= alike("path-1")))
    pairs = both.select("row", F.when(before, F.col("row1")).otherwise(F.col("row-1")).alias("pair"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages as packed texts, zones and line ids; the markup stays behind."""
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            found = [blocks(p.as_py()) for p in batch.column("p")]
            packed = [packer.compress("\n".join([t for t, _ in page]).encode()) for page in found]
            zones = ["".join([str(z) for _, z in page]) for page in found]
            ids = [_line_ids([t for t, _ in page]) for page in found]
            arrays = [pa.array(packed, pa.binary()), pa.array(zones, pa.string()), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("u"), batch.column("row"), *arrays], ["k", "u", "row", "packed", "zones", "ids"])

    kinds = [(f.name, f.dataType) for f in named.schema if f.name in ("k", "u", "row")]
    kinds += [("packed", T.BinaryType()), ("zones", T.StringType()), ("ids", T.ArrayType(T.LongType()))]
    parsed = named.mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in kinds]))
    lines = parsed.select(F.col("row").alias("pair"), F.col("ids").alias("theirs")).dropDuplicates(["pair"])
    against = pairs.where("pair IS NOT NULL").join(lines, "pair").select("row", "theirs")
    schema = T.StructType(
        [
            T.StructField(key, pages.schema[key].dataType),
            T.StructField(url, pages.schema[url].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_blocks", T.LongType()),
            T.StructField("n_shared", T.LongType()),
        ]
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_main_text(*(v.as_py() for v in row)) for row in zip(*(batch.column(c) for c in ("packed", "zones", "ids", "theirs")))]
            texts, sizes, shared = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            arrays = [batch.column("k"), batch.column("u"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [key, url, "text", "n_blocks", "n_shared"])

    return parsed.join(against, "row", "left").select("k", "u", "packed", "zones", "ids", "theirs").mapInArrow(decide, schema)


def _main_text(packed: bytes, zones: str, ids: list[int], theirs: list[int] | None) -> tuple[str, int, int]:
    texts = zstandard.ZstdDecompressor().decompress(packed).decode().split("\n") if zones else []
    shared = common(ids, theirs) if theirs else set()
    chosen = [t for i, (t, zone) in enumerate(zip(texts, zones)) if zone == str(MAIN) or zone == str(UNSURE) and i not in shared]
    if not chosen:
        chosen = [t for i, (t, zone) in enumerate(zip(texts, zones)) if zone == str(NEUTRAL) and i not in shared]
    return "\n\n".join(chosen), len(texts), len(shared)
