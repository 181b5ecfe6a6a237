"""Main text of web pages by differences between pages of near URLs, with markup where these say nothing.

A page's text lines are aligned, by a longest common subsequence, with those of the pages of its host whose
URL paths are nearest. A line that most of them share belongs to the site, and so does a zone (a path of
elements) of a host if most of its lines are shared. Copies of a page are no evidence: pages that share most of
what is rare among their neighbours are passed over. Markup breaks the ties: elements for menus, forms and the
like are the site's, and where a page has an article, lines outside it are not its text.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, numbered, written
from .url_filter import host_of, path_of

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[^>]*+>?)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose text is never shown or never the page's own, block elements, telling names.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea".split())
ASIDE = frozenset("nav footer aside form menu dialog button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies sharing share sidebar "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that may stand beside those in a compound name ("site-footer", "ad-box"); with any other ("related-work") it tells nothing.
BESIDE = frozenset("area bar block bottom box buttons container content global inner left links list main outer page panel primary right secondary section site top wrap wrapper".split())
REPLIES = frozenset("comment comments disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that make a zone: containers, not the blocks inside them.
CONTAINERS = frozenset("address article aside blockquote details div dl fieldset figure footer form header main menu nav ol section table ul dialog button".split())
_SPACE = re.compile(r"\s+")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)")
#: What markup says of an element: the site's, nothing, the article's.
SITE, OPEN, ARTICLE = -1, 0, 1


def _names(rest: str) -> tuple[list[str], set[str]]:
    """The names in an element's class and id, and the words of its role."""
    names: list[str] = []
    roles: set[str] = set()
    for kind, *value in _ATTRIBUTE.findall(rest):
        got = "".join(value).lower().split()
        if kind.lower() == "role":
            roles.update(got)
        else:
            names += got
    return names, roles


def _telling(name: str) -> bool:
    """Does a class or id name a part of the site? All its words must."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    return any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words)


class _Zones:
    """The open elements that matter: containers, and others that a name tells to be the site's."""

    def __init__(self, low: str, last: dict[str, int]):
        self.has_article, self.last = "<article" in low, last
        #: (tag, zone, markup, whether it holds readers' comments, whether its tag alone is the site's)
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, OPEN, False, False)]
        self.open: dict[str, int] = {}

    def _push(self, tag: str, label: str, markup: int, replies: bool, plain: bool) -> None:
        zone = xxhash.xxh3_64_intdigest(f"{self.stack[-1][1]}/{label}")
        self.stack.append((tag, zone, markup, replies, plain))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self._pop() != tag:
                pass

    def start(self, tag: str, rest: str, at: int) -> None:
        top = self.stack[-1][0]
        if (top == "p" and tag in BLOCKS) or (top == "li" and tag == "li"):  # closed by what follows
            self._pop()
        if tag in VOID or tag in ("html", "body"):
            return
        names, roles = _names(rest) if "=" in rest else ([], set())
        named = bool(roles & ROLES) or any(map(_telling, names))
        if tag not in CONTAINERS and not named and not self.open.get(tag):
            return
        if self.last.get(tag, -1) < at and tag not in ("p", "li"):
            return
        _, _, markup, replies, plain = self.stack[-1]
        replies = replies or any(REPLIES.intersection(re.split(r"[_-]+", n)) for n in names if _telling(n))
        if tag == "article" or (tag == "main" and not self.has_article):
            # a name round an article does not make it the site's, an element for menus and the like does
            markup = SITE if replies or plain else ARTICLE
        elif tag in ASIDE or (tag == "header" and markup != ARTICLE):
            markup, plain = SITE, True
        elif named and tag != "main":
            markup = SITE
        self._push(tag, ".".join([tag, *sorted(re.sub(r"\d+", "", n) for n in names)]), markup, replies, plain)


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, zone, markup) of a page's lines that markup leaves: blocks in page order, white space single, references decoded.

    A zone is a hash of the path of containers, with their names, and the block. An element that is closed nowhere
    opens no zone that would swallow the rest of the page. Where a page has an article, ``main`` round it tells nothing.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    low, leaf, at = page.lower(), "", 0
    last = {m[1].lower(): m.start() for m in _CLOSE.finditer(page)}
    zones = _Zones(low, last)

    def flush() -> None:
        line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if line:
            _, zone, markup, *_ = zones.stack[-1]
            out.append((line, _hash(f"{zone}/{leaf}"), markup))

    while True:
        mark = _MARK.search(page, at)
        text = page[at : mark.start() if mark else len(page)]
        if text and zones.stack[-1][2] != SITE:
            parts.append(text)
        if not mark:
            break
        at = mark.end()
        if mark["raw"] is not None and zones.stack[-1][2] != SITE:
            parts.append(html.escape(mark["raw"], quote=False))
        if not mark["tag"]:
            continue
        tag, closing = mark["tag"].lower(), bool(mark["close"])
        if tag in SILENT and not closing:
            end = low.find(f"</{tag}", at) if last.get(tag, -1) >= at else -1
            if tag != "head" or end >= 0:
                at = len(page) if end < 0 else end
            continue
        block = tag in BLOCKS or tag in CONTAINERS
        if block:
            flush()
        if closing:
            zones.close(tag)
        else:
            zones.start(tag, mark["rest"], at)
        if block:
            leaf = "" if closing or tag in CONTAINERS else tag
        elif tag in ("br", "td", "th"):
            parts.append(" ")
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines lie on a longest common subsequence with b: bit vectors, rows kept for the way back."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    where: dict[int, int] = {}
    for k, v in enumerate(y):
        where[v] = where.get(v, 0) | (1 << k)
    full = (1 << len(y)) - 1
    row = full
    rows = [row]  # a zero bit: the subsequence grows at that column
    for v in x:
        u = row & where.get(v, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    hit = [False] * len(x)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            hit[i] = True
    return [True] * lead + hit + [True] * tail


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


#: Pages before and after in the order of host and path that may be compared, and how many of them are.
REACH, NEAR = 8, 4
#: Pages that a task compares at once.
PAGES = 2048
#: A zone is the site's if this share of its lines is; what is assumed before (share, lines) by what markup says.
SITE_SHARE, BEFORE = 0.5, {ARTICLE: (0.02, 50), OPEN: (0.2, 5)}
#: So many zones, and numbers of lines to delete, are broadcast at most (their number is checked); beyond, they are joined by shuffle.
BROADCAST_ZONES, BROADCAST_LINES = 100_000, 1_000_000


def are_copies(a: list[int], b: list[int], shared: list[bool], sizes: list[int], often: dict[int, int], pages: int) -> bool:
    """Do two pages share most of a's text that is rare among the pages about them? Equal pages are copies too."""
    if a == b:
        return True
    rare = [(n, s) for x, n, s in zip(a, sizes, shared, strict=True) if 2 * often[x] <= pages]
    total = sum(n for n, _ in rare)
    return total > 0 and 2 * sum(n for n, s in rare if s) >= total


def site_lines(rows: list[tuple[str, str, list[int], list[int]]], k: int) -> list[bool] | None:
    """Which lines of page k of an order (host, path, line hashes, sizes) most of its nearest pages share; None without any.

    The nearest pages are those of the host, REACH either way, whose paths have the longest common start, nearer
    ones first (ties: the one before). The first NEAR of them that are no copies count.
    """
    host, path, marks, sizes = rows[k]
    about = [j for d in range(1, REACH + 1) for j in (k - d, k + d) if 0 <= j < len(rows) and rows[j][0] == host]
    about.sort(key=lambda j: -len(os.path.commonprefix((path, rows[j][1]))))
    own, often = set(marks), dict.fromkeys(marks, 1)
    for j in about:
        for x in own.intersection(rows[j][2]):
            often[x] += 1
    number, count = 0, [0] * len(marks)
    for j in about:
        if own.isdisjoint(rows[j][2]):
            number += 1
        else:
            shared = common_lines(marks, rows[j][2])
            if are_copies(marks, rows[j][2], shared, sizes, often, len(about) + 1):
                continue
            number += 1
            count = [c + s for c, s in zip(count, shared, strict=True)]
        if number == NEAR:
            break
    return [2 * c > number for c in count] if number else None


_ROW = "page_id long, mark long, host string, path string, lines array<long>, zones array<long>, markup array<tinyint>, sizes array<int>"
_FOUND = "page_id long, mark long, host string, zones array<long>, markup array<tinyint>, site array<boolean>"


def _compare(t: pa.Table) -> pa.Table:
    """The own pages of a block with the lines that belong to the site."""
    t = t.sort_by("_at")
    cols = {n: t.column(n).to_pylist() for n in ("host", "path", "lines", "sizes", "_own")}
    rows = list(zip(cols["host"], cols["path"], cols["lines"], cols["sizes"], strict=True))
    own = [k for k, mine in enumerate(cols["_own"]) if mine]
    t = t.select(["page_id", "mark", "host", "zones", "markup"]).take(pa.array(own, pa.int64()))
    return t.append_column("site", pa.array([site_lines(rows, k) for k in own], pa.list_(pa.bool_())))


def site_zones(found: DataFrame) -> DataFrame:
    """(host, zone): zones of a host whose lines belong to the site, most of them.

    The share of site lines among the zone's lines on pages that could be compared, blended with what markup
    lets expect; counts combine before the shuffle.
    """
    lines = found.where("site is not null").select("host", F.explode(F.arrays_zip("zones", "markup", "site")).alias("l"))
    by = lines.groupBy("host", F.col("l.zones").alias("zone")).agg(F.count("*").alias("n"), F.count_if("l.site").alias("s"), F.max("l.markup").alias("m"))
    share = F.lit(None).cast("double")
    for m, (mean, weight) in BEFORE.items():
        share = F.when(F.col("m") == m, (F.col("s") + mean * weight) / (F.col("n") + weight)).otherwise(share)
    return by.where(share > SITE_SHARE).select("host", "zone")


def deletions(found: DataFrame) -> DataFrame:
    """(page_id, mark, gone): the numbers of the lines to delete, for pages that have any.

    Lines in a zone of the site go; so do shared lines outside an article. In an article single shared
    lines stay: quotations, licences and the like are its text.
    """
    zones = written(site_zones(found))
    site = F.coalesce("site", F.expr("cast(array() as array<boolean>)")).alias("site")
    lines = found.select("page_id", "mark", "host", "zones", "markup", site)
    lines = lines.select("page_id", "mark", "host", F.posexplode(F.arrays_zip("zones", "markup", "site")).alias("k", "l"))
    lines = lines.select("page_id", "mark", "host", "k", F.col("l.zones").alias("zone"), (F.coalesce("l.site", F.lit(False)) & (F.col("l.markup") == OPEN)).alias("line"))
    zones = F.broadcast(zones.withColumn("all", F.lit(True))) if zones.count() <= BROADCAST_ZONES else zones.withColumn("all", F.lit(True))
    gone = lines.join(zones, ["host", "zone"], "left").where(F.col("line") | F.coalesce("all", F.lit(False)))
    return gone.groupBy("page_id", "mark").agg(F.sort_array(F.collect_list(F.col("k").cast("int"))).alias("gone"))


def _mark(url: Column, page: Column) -> Column:
    return F.xxhash64(url, page)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty page has the text ''; so has one without shown text. A null URL belongs to the host '' and
    the path ''. Rows that are equal as a whole are one page and get the same text; other columns are not
    carried. A page of a host that has no other page is judged by markup alone. A page's article stays if
    nothing of it would be left. Very long pages cost their length in time and memory of one task.

    Pages are parsed where they lie, for the hashes of their lines. These are put in the order of host and path
    and compared in blocks of PAGES, so a host with a third of all pages spreads over many tasks. The
    numbers of the lines to delete go back to the pages, which are parsed again for their text.
    """
    base = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    base = base.withColumn("mark", _mark(F.col("url"), F.col("html")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                lines = [page_lines(p) for p in part.column(4).to_pylist()]
                column = lambda kind, of: pa.array([[of(x) for x in ls] for ls in lines], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(4)), column(pa.int64(), lambda x: _hash(x[0])), column(pa.int64(), lambda x: x[1]), column(pa.int8(), lambda x: x[2]), column(pa.int32(), lambda x: len(x[0]))],
                    names=[x.split()[0] for x in _ROW.split(", ")],
                )

    rows = base.select("page_id", "mark", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").mapInArrow(hashed, _ROW)
    order = numbered(rows.dropDuplicates(["page_id", "mark"]), "host", "path", "page_id", "mark")
    found = written(in_blocks(order, PAGES, REACH).groupBy("_b").applyInArrow(_compare, _FOUND))
    gone = written(deletions(found))
    small = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES
    side = gone.select(F.col("page_id").alias("_p"), F.col("mark").alias("_k"), "gone")
    side = F.broadcast(side) if small else side
    pages = base.join(side, base.page_id.eqNullSafe(F.col("_p")) & (F.col("mark") == F.col("_k")), "left").select("page_id", "url", "html", "gone")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ["\n".join(main_lines(p, g)) for p, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(text, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def main_lines(page: str, gone: list[int] | None) -> list[str]:
    """A page's lines without the deleted ones, by their numbers: those of the article, if it has one."""
    lines = page_lines(page)
    drop = set(gone or ())
    inside = [(k, x[0]) for k, x in enumerate(lines) if x[2] == ARTICLE]
    if inside:
        return [x for k, x in inside if k not in drop] or [x for _, x in inside]
    return [x[0] for k, x in enumerate(lines) if k not in drop]
