"""Main text of web pages by nearest-URL differencing.

Pages are ordered by host, URL path and page_id and dealt to ranges of that order, so a host with a third of all pages spans
many tasks. Each page is paired with its neighbour of the same host: the nearest page before that is no copy of it, or else the
nearest after, among NEAR pages on each side. Each range also gets the NEAR pages before and after it, so the pairing is the same under any ranges. Pages are
told apart into lines (blocks of text); the lines of every page are aligned with its neighbour's by their longest common
subsequence, and shared lines go. Structure assists where the alignment can't be right: a line inside an article (or, on a page without one, the main element)
stays although the neighbour shows it too (a host may repeat a paragraph), unless its container is named like what is not content, and a line that is not shared still goes where its container
is by element or by name a menu, advert, notice or the like, as those differ from page to page. All other lines stay. A neighbour that
shares nearly all lines outside articles (a print view, a page of the template alone) is a copy and is passed over; a page among copies
alone keeps its lines. ``shared_lines`` tells how many lines went by the alignment, ``named_lines`` how many by structure alone.

A tag that never ends takes the rest of the page with it, as in browsers, so reading a page is linear in its length.

Null or empty html gives empty text. A page alone with its host, or with a null url's empty host, has no
neighbour and keeps its lines. Pages of one url are neighbours. Repeated rows each give a row with the same text; an
empty table gives no rows; other columns of the pages are not read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table

SCHEMA = "page_id long, url string, text string, n_chars long, shared_lines long, named_lines long"
#: Elements by role.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title", "math", "audio", "video"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "datalist", "fieldset"}
CONTENT = {"article", "main"}
CONTAINERS = {"div", "section", "header", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "blockquote", "details", "body", "html", "center", "address", "hgroup", "search"} | DROPPED | CONTENT
BLOCKS = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "figcaption", "summary", "caption", "legend", "option", "optgroup"} | CONTAINERS
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Names of adverts, navigation, share bars and comments, also inside an article.
INSIDE = set(
    "ad ads adv advert adverts advertisement advertisements adsense advertising "
    "nav navbar navigation menubar breadcrumb breadcrumbs pagination pager "
    "sharing sharebar share-bar share-buttons share-links social-share social-bar social-buttons social-links "
    "comment comments commentlist comment-list comment-form disqus".split()
)
ADVERTS = set("ad ads adv advert adverts advertisement advertisements adsense advertising".split())
#: Words that name what is not content, and words that are subjects of texts too and name it only beside another.
NAMES = (INSIDE - {"comment"}) | set("sponsor sponsored promo menu toolbar masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login".split())
LOOSE = set(
    "promotion banner header related recommended recommendations trending notice notices alert subscription search share social comment reply replies respond "
    "discussion copyright legal skip complementary contentinfo".split()
)
#: Words of place and shape, which alone name nothing.
PLACES = set("site page main top bottom left right global primary secondary bar box block list links buttons container wrapper inner area user users post posts article articles story stories form section panel content".split())
#: Whole classes that name notices, adverts and comments on containers, and the usual id of a comment form.
ALONE, FORM_ID = set("notice notices alert sponsored respond replies reply related recommended recommendations trending".split()), "respond"
ROLES = set("navigation complementary contentinfo banner search menu menubar toolbar dialog alertdialog".split())
ROLES_INSIDE = set("navigation menu menubar toolbar".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
ARTICLE = re.compile(r"<article[\s/>]", re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z]+")
STAY, GO, OPEN, LIKELY = 1, 0, 2, 3
#: Share of the open characters from which two pages are copies, and pages that are looked at on each side for one that is none.
COPY, NEAR = 0.9, 4
#: Between the parts of a key; sorts before what URLs hold.
SEPARATOR = "\x01"


def named(value: str) -> bool:
    """Whether all words of a name are of what is not content, and not a loose one alone."""
    found = [w.lower() for w in CAMEL.split(value) if w]
    strong, loose = sum(w in NAMES for w in found), sum(w in LOOSE for w in found)
    known = strong + loose + sum(w in PLACES for w in found) == len(found)
    return known and (strong > 0 or loose > 0 and len(found) > 1)


def unwanted(attributes: str, tag: str = "div", inside: bool = False) -> bool:
    """Whether an element's attributes name it as something other than content, or hide it.

    Names count as a whole. An id is an anchor except on containers. Inside an article ids of adverts, navigation, share bars and comments
    count, classes of containers as outside and those that name a notice or the like alone, and of paragraphs, headings and inline elements adverts alone. Other names are left to the alignment.
    """
    if not attributes.strip():
        return False
    container = tag in CONTAINERS
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and any(w in (ROLES_INSIDE if inside else ROLES) for w in value.lower().split()):
            return True
        if name == "class" or name == "id" and container:
            for whole in value.split():
                low = whole.lower()
                if low in (INSIDE if container else ADVERTS) or not inside and named(whole):
                    return True
                if container and (low in ALONE or named(whole) if name == "class" else low == FORM_ID):
                    return True
    return False


def likely(attributes: str) -> bool:
    """Whether a container inside an article has a name of loose words: its lines go where the neighbour shares them."""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for whole in (m[2] or m[3] or m[4] or "").split():
                found = [w.lower() for w in CAMEL.split(whole) if w]
                if any(w in LOOSE for w in found) and all(w in LOOSE or w in PLACES for w in found):
                    return True
    return False


def lines(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order, each with STAY (inside an article, or the main element of a page without one), LIKELY (there too, in a container named like what is not content), GO (known not to be content) or OPEN."""
    content = {"article"} if ARTICLE.search(page) else CONTENT
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    held: list[str] = []
    opened: dict[str, int] = {}  # how many of each element are on the stack
    skip_block = False
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((GO if skip_block else stack[-1][1], text))

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag in BLOCKS:
                flush()
                skip_block = False
            elif tag in ("td", "th"):
                held.append(" ")
            if opened.get(tag):
                if tag not in BLOCKS:
                    flush()
                while True:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
            skip_block = False
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if tag in VOID or m[3].endswith("/"):
            continue
        role = stack[-1][1]
        inside = role in (STAY, LIKELY)
        bad = unwanted(m[3], tag, inside)
        if tag in CONTAINERS:
            if tag in DROPPED or bad or (tag == "header" and not inside):
                role = GO
            elif tag in content and role != GO:
                role = STAY
            elif role == STAY and likely(m[3]):
                role = LIKELY
            stack.append((tag, role))
            opened[tag] = opened.get(tag, 0) + 1
        elif bad and tag in BLOCKS:
            skip_block = True
        elif bad:
            flush()
            stack.append((tag, GO))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    common = set(a) & set(b)
    for j, line in enumerate(b):
        if line in common:
            where.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def copies(page: list[tuple[int, str]], other: list[tuple[int, str]]) -> bool:
    """Whether the open lines of two pages are nearly all equal, by characters of the shorter side."""
    a, b = ([t for role, t in p if role == OPEN] for p in (page, other))
    least = min(sum(map(len, a)), sum(map(len, b)))
    return bool(least) and sum(len(a[k]) for k in shared(a, b)) >= COPY * least


def own_lines(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> tuple[str, int, int]:
    """The lines of a page that are its own content; how many went because the neighbour shares them, and how many by structure alone."""
    same = shared([t for _, t in page], [t for _, t in neighbour]) if neighbour else set()
    kept, by_alignment, by_structure = [], 0, 0
    for k, (role, t) in enumerate(page):
        if role == STAY:
            kept.append(t)
        elif k in same:
            by_alignment += 1
        elif role == GO:
            by_structure += 1
        else:
            kept.append(t)
    return "\n".join(kept), by_alignment, by_structure


def main_text(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> str:
    return own_lines(page, neighbour)[0]


def ordered(pages: DataFrame) -> DataFrame:
    """Pages with their place among all, as one string: host, path, page_id (nulls first)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(known, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(known, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    number = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))
    return rows.withColumns({"host": host, "key": F.concat_ws(SEPARATOR, host, path, number)})


def in_range(bounds: list[str]) -> Column:
    """The number of bounds that a key reaches: coarse ones first, then those between two coarse ones."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    some, coarse = F.lit(bounds), F.lit(bounds[::step])
    reached = lambda b: F.size(F.filter(b, lambda x: x <= F.col("key")))
    c = reached(coarse)
    return F.when(c == 0, 0).otherwise((c - 1) * step + reached(F.slice(some, (c - 1) * step + 1, F.lit(step))))


def beside(edges: list[tuple[int, str]]) -> dict[str, list[int]]:
    """From the first and last keys of each range: keys and the other ranges that need their pages as neighbours."""
    edges = sorted(edges, key=lambda e: (e[0], e[1].encode()))
    host = lambda e: e[1].split(SEPARATOR)[0]
    out: dict[str, list[int]] = {}
    at = 0
    while at < len(edges):
        end = at
        while end < len(edges) and edges[end][0] == edges[at][0]:
            end += 1
        for part, own in ((edges[max(0, at - NEAR) : at], edges[at]), (edges[end : end + NEAR], edges[end - 1])):
            for e in part:
                if host(e) == host(own):
                    out.setdefault(e[1], []).append(own[0])
        at = end
    return out


def dealt(pages: DataFrame, n: int) -> DataFrame:
    """Pages dealt to n ranges of the order, and the pages around each range to it too (own is false)."""
    rows = ordered(pages)
    spark = pages.sparkSession
    keys = rows.select("key")
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, 50 * n / max(1, pages.count()))))) if n > 1 else keys.limit(0)
    drawn = sorted((r["key"] for r in sample.collect()), key=str.encode)
    bounds = sorted({drawn[len(drawn) * k // n] for k in range(1, n)} if drawn else set(), key=str.encode)
    rows = rows.withColumn("r", in_range(bounds))
    if not bounds:
        return rows.withColumn("own", F.lit(True)).repartitionById(1, "r")
    placed = rows.select("key", "r").withColumn("k", F.lit(0))
    ends = [placed.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(by))).where(F.col("k") <= NEAR) for by in (F.asc("key"), F.desc("key"))]
    edges = [(e["r"], e["key"]) for e in ends[0].union(ends[1]).select("r", "key").distinct().collect()]
    also = spark.createDataFrame(list(beside(edges).items()), "key string, also array<int>")
    rows = rows.join(F.broadcast(also), "key", "left")
    to = F.concat(F.array("r"), F.coalesce("also", F.array().cast("array<int>")))
    return rows.select("page_id", "url", "html", "host", "key", F.posexplode(to).alias("k", "r")).withColumn("own", F.col("k") == 0).repartitionById(len(bounds) + 1, "r")


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, shared_lines, named_lines) of each page."""
    spark = pages.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = ranges or min(n, pages.count() // 100 + 1)  # ranges of a few pages would send most pages twice
    near = dealt(pages, n).withColumn("_tie", F.xxhash64("html")).sortWithinPartitions("key", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                for page_id, url, source, host, own in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "own")), strict=True):
                    yield page_id, url, host, own, lines(source)

        def made(done: list[tuple]) -> pa.RecordBatch:
            ids, urls, texts, *counts = (list(x) for x in zip(*done, strict=True))
            numbers = [pa.array(x, pa.int64()) for x in (map(len, texts), *counts)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "shared_lines", "named_lines"])

        held: list[tuple] = []  # the pages around the next one to settle, at most NEAR on each side
        at = 0
        done: list[tuple] = []

        def settle() -> None:
            page_id, url, host, own, page = held[at]
            if own:
                around = [*range(at - 1, max(-1, at - NEAR - 1), -1), *range(at + 1, min(len(held), at + NEAR + 1))]
                known = (held[k][4] for k in around if host and held[k][2] == host)
                done.append((page_id, url, *own_lines(page, next((p for p in known if not copies(page, p)), None))))

        for row in rows_of():
            held.append(row)
            if len(held) - at > NEAR:
                settle()
                at += 1
                if at > NEAR:
                    held.pop(0)
                    at -= 1
            if len(done) >= 1000:
                yield made(done)
                done.clear()
        while at < len(held):
            settle()
            at += 1
        if done:
            yield made(done)

    return arrow_map(near.select("page_id", "url", "html", "host", "own"), run, SCHEMA)


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
