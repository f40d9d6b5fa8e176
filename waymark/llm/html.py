"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block of its markup. Within a host pages are ordered by URL path, and each is
compared with its nearest pages in that order: lines on a longest common subsequence of the two are what the site puts
on every page, and are deleted. What the markup itself says is not the article (menus, headers, footers, asides, forms
and the like) is deleted as well, and what it says is the article is kept, since articles share passages too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import hot_keys, salted_join, stored, wide_hash

#: Pages of a host, next to each other by URL, that are compared within a group; the last group takes up to twice as many.
GROUP = 64
#: Nearest pages that a page is compared with.
NEAREST = 4
#: A page that shares more than this share of the characters outside of marked boilerplate is a copy: not compared.
COPY = 0.8
#: Cells of a table of common subsequences that is kept to trace one back; larger ones are halved first.
CELLS = 2**24

# The elements of HTML by their part in a page, and words in class and id that name what is no article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUTSIDE = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav header footer aside form button select datalist object svg math canvas audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar sidebar aside footer header masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond share sharing social "
    "breadcrumb breadcrumbs pagination pager related recommended trending widget toc skip".split()
)
# What an article may have itself, and names that say what a page has elsewhere.
TITLES = frozenset("header masthead".split())
ABOUT = ("has-", "no-", "with-", "without-", "is-", "hide-", "show-")
#: Elements that end when another of their kind begins, or when these do.
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "option": frozenset("option".split()), "td": frozenset("td th p".split()), "tr": frozenset("tr td th p".split())}

TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Za-z]+")

#: What a line is: of the article, of an element that is not the article, of neither.
ARTICLE, MARKED, PLAIN = 1, 2, 0


def _labelled(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's class, id, role or hidden attribute says that it is no part of an article."""
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key in ("class", "id"):
            for own in value.split():
                # An article is named as a whole, "comment"; other elements also in part, "site-footer".
                parts = {own} if name in ("article", "main") else set() if own.startswith(ABOUT) else set(WORD.findall(own))
                if parts & NAMES - (TITLES if inside else frozenset()):
                    return True
    return False


class Page:
    """The lines of a page, each with what it is.

    Elements that are never closed end with the element around them; a closing tag without its element is ignored. A
    page that breaks off is read up to there.
    """

    def __init__(self, html: str):
        self.lines: list[str] = []
        self.scopes: list[int] = []
        #: Open elements and the number of their mark or -1; marks that hold until an article within takes them back.
        self.open: list[tuple[str, int]] = []
        self.marks: list[bool] = []
        self.marked: list[list[int]] = []
        self.seen = False
        self.articles = self.mains = 0
        self.sure: list[bool] = []
        self.held: list[str] = []
        self.read(html)
        self.flush()
        self.settle()

    def read(self, html: str) -> None:
        at, size, tag = 0, len(html), TAG
        lower = None
        while at < size:
            cut = html.find("<", at)
            if cut < 0:
                cut = size
            if cut > at:
                self.held.append(html[at:cut])
            if cut == size:
                return
            following = html[cut + 1 : cut + 2]
            if html.startswith("<!--", cut):
                end = html.find("-->", cut + 2 if html.startswith("<!-->", cut) else cut + 4)
                at = size if end < 0 else end + 3
            elif following in ("!", "?"):
                end = html.find(">", cut)
                at = size if end < 0 else end + 1
            elif following.isascii() and following.isalpha() or (following == "/" and html[cut + 2 : cut + 3].isascii() and html[cut + 2 : cut + 3].isalpha()):
                found = tag.match(html, cut)
                if not found and tag is TAG:
                    # A quote that is never closed: from here on tags end at the first ">".
                    tag = LOOSE
                    found = tag.match(html, cut)
                if not found:
                    return
                at, name = found.end(), found[1].lower()
                if following == "/":
                    self.end(name)
                elif name in RAW and not found[2].endswith("/"):
                    if lower is None:
                        lower = html.lower()
                        if len(lower) != size:  # a letter whose small form is longer
                            lower = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
                    end = lower.find(f"</{name}", at)
                    at = size if end < 0 else (html.find(">", end) + 1 or size)
                else:
                    self.start(name, found[2])
            else:
                self.held.append("<")
                at = cut + 1

    def block(self, name: str) -> None:
        if name not in INLINE:
            self.flush()

    def start(self, name: str, attributes: str) -> None:
        self.block(name)
        while self.open and name in CLOSES and self.open[-1][0] in CLOSES[name]:
            self.pop()
        if name in VOID or attributes.endswith("/") and name not in INLINE:
            return
        inside = bool(self.articles or self.mains)
        outside = name in OUTSIDE and not (name == "header" and inside)
        named = name not in ("html", "body") and bool(attributes) and _labelled(name, attributes, inside)
        mark = -1
        if outside or named:
            mark = len(self.marks)
            self.marks.append(True)
            # Only a form or a name may turn out to hold the whole page.
            self.sure.append(outside and name != "form")
        elif name in ("article", "main"):
            if not self.seen:
                for _, number in self.open:
                    if number >= 0 and not self.sure[number]:
                        self.marks[number] = False
            if not any(number >= 0 and self.marks[number] for _, number in self.open):
                self.seen = True
        self.open.append((name, mark))
        self.count(name, mark, 1)

    def count(self, name: str, mark: int, by: int) -> None:
        if mark < 0 and name == "article":
            self.articles += by
        elif mark < 0 and name == "main":
            self.mains += by

    def pop(self) -> None:
        name, mark = self.open.pop()
        self.count(name, mark, -1)

    def end(self, name: str) -> None:
        self.block(name)
        if any(own == name for own, _ in self.open):
            while self.open[-1][0] != name:
                self.pop()
            self.pop()

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.held)).split())
        self.held.clear()
        if text:
            self.lines.append(text)
            self.scopes.append(ARTICLE if self.articles else 3 if self.mains else PLAIN)
            self.marked.append([number for _, number in self.open if number >= 0])

    def settle(self) -> None:
        """Marks that hold decide; then lines of articles, and of the main element where there is no article."""
        article = ARTICLE if ARTICLE in (own := [s for s, m in zip(self.scopes, self.marked) if not any(self.marks[k] for k in m)]) else 3
        has = article in own
        for i, marks in enumerate(self.marked):
            if any(self.marks[k] for k in marks):
                self.scopes[i] = MARKED
            else:
                self.scopes[i] = ARTICLE if self.scopes[i] == article else MARKED if has else PLAIN


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, by bits."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Which places of a lie on a longest common subsequence of a and b; of several the one found first from the end."""
    shared = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in shared]
    return [places[i] for i in _trace([a[i] for i in places], [y for y in b if y in shared])]


def _trace(a: list[int], b: list[int]) -> list[int]:
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n == 1:
        return [0] if a[0] in b else []
    if n * m > CELLS:
        half = n // 2
        cut = int(np.argmax(_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]))
        return _trace(a[:half], b[:cut]) + [half + i for i in _trace(a[half:], b[cut:])]
    table = np.zeros((n + 1, m + 1), np.int32)
    right = np.array(b)
    for i in range(n):
        # Along a row the lengths never fall, so a running maximum takes the best match to the left.
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(right == a[i], table[i, :-1] + 1, 0)))
    found, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def _parsed(pages: DataFrame, kept: list[str], schema: str, cells: Callable[[Page], list]) -> DataFrame:
    """The columns kept of each page, and what cells makes of its markup."""
    own = StructType.fromDDL(schema)
    kinds = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells(Page(x.as_py() or "")) for x in batch.column(len(kept))]
            made = [pa.array([f[k] for f in found], kind.type) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *kinds.names])

    return pages.select(*kept, "html").mapInArrow(run, StructType([*pages.select(*kept).schema, *own]))


def _signature(page: Page) -> list:
    return [[xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x in page.lines], [len(x) for x in page.lines], page.scopes]


def _kept_lines(page: Page) -> list:
    return [[None if s == MARKED else x for x, s in zip(page.lines, page.scopes)], page.scopes]


def _signatures(pages: DataFrame) -> DataFrame:
    """Stored rows of the pages' keys, hosts, paths, and their lines' hashes, sizes and scopes; with group, a number of
    neighbours by URL within a host: GROUP and up to twice as many, and rank, the place in the host.

    One range shuffle of these narrow rows. Places are counted within its partitions and moved by what earlier ones hold
    of the host, one row per partition and host.
    """
    host = F.coalesce(F.translate(F.regexp_extract("url", "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", "://[^/?#]*([^#]*)", 1), F.lit(""))
    keyed = pages.select("key", host.alias("host"), path.alias("path"), "html")
    rows = stored(_parsed(keyed, ["key", "host", "path"], "hashes array<long>, sizes array<int>, scopes array<int>", _signature), "page-signatures")
    order = ["host", "path", "key"]
    cut = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("path"), "page-order")
    counts = cut.groupBy("host", "slice").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_host = Window.partitionBy("host")
    before = F.coalesce(F.sum("n").over(by_host.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("host", "slice", "first", before.alias("earlier"), F.sum("n").over(by_host).alias("total"))
    placed = cut.join(counts, ["host", "slice"]).withColumn("rank", F.col("earlier") + F.col("at") - F.col("first"))
    last = F.greatest(F.floor(F.col("total") / GROUP) - 1, F.lit(0))
    return placed.select("key", "host", "hashes", "sizes", "scopes", "rank", F.least(F.floor(F.col("rank") / GROUP), last).alias("part"))


def _compare(table: pa.Table) -> pa.Table:
    """key, rank and shared, for each line of a page of the group whether one of its nearest pages has it too."""
    table = table.sort_by("rank")
    pages = list(zip(*[[np.array(x.as_py() or [], np.int64) for x in table.column(c)] for c in ("hashes", "sizes", "scopes")]))
    weights = [dict(zip(h[s != MARKED].tolist(), w[s != MARKED].tolist())) for h, w, s in pages]
    lines = [h.tolist() for h, _, _ in pages]
    totals = [sum(w.values()) for w in weights]
    out = []
    for i in range(len(pages)):
        shared, taken = np.zeros(len(lines[i]), bool), 0
        for step in range(1, len(pages)):
            for j in (i - step, i + step):
                if 0 <= j < len(pages) and taken < NEAREST:
                    same = sum(weights[i][x] for x in weights[i].keys() & weights[j].keys())
                    if same > COPY * min(totals[i], totals[j]):
                        continue
                    shared[common_lines(lines[i], lines[j])] = True
                    taken += 1
            if taken >= NEAREST:
                break
        out.append(shared.tolist())
    return pa.table({"key": table.column("key"), "rank": table.column("rank"), "shared": pa.array(out, pa.list_(pa.bool_()))})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and the numbers of lines: n_lines of the page, n_shared of them deleted because a
    near page of the host has them, n_marked deleted because of the markup alone, for every row of pages.

    A line is deleted where one of the NEAREST pages of its host by URL (path and query; ties by a hash of the row), within
    groups of GROUP and up to twice as many, shares it on a longest common subsequence. Pages that share more than COPY of
    either's text are copies of one article and are passed over for the next. Lines of an article or main element are
    kept. Null or empty html gives an empty text; pages of a null url, or one without host, count as one host's;
    repeated rows are copies of each other; further columns are not read.
    """
    key = wide_hash(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", "html", key.alias("key"))
    signatures = _signatures(rows)
    found = signatures.groupBy("host", "part").applyInArrow(_compare, "key struct<a: long, b: long>, rank long, shared array<boolean>")
    # Rows equal in all three columns are one key; the first of them by place speaks for all.
    found = stored(found.groupBy("key").agg(F.min_by("shared", "rank").alias("shared"), F.count("*").alias("n")), "page-shared")
    lines = _parsed(rows, ["page_id", "url", "key"], "lines array<string>, scopes array<int>", _kept_lines)
    # Equal rows are told apart by the partition they come from, so that a key of many is spread.
    joined = salted_join(lines.withColumn("slice", F.spark_partition_id()), found.drop("n"), "key", hot_keys(found, "key", "n"), hint="merge")
    joined = joined.select("page_id", "url", F.arrays_zip("lines", "scopes", "shared").alias("line"))
    is_article, is_marked = (lambda x: x["scopes"] == ARTICLE), (lambda x: x["scopes"] == MARKED)
    count = lambda rule: F.size(F.filter("line", rule)).cast("long")
    kept = F.filter("line", lambda x: is_article(x) | ~is_marked(x) & ~x["shared"])
    text = F.array_join(F.transform(kept, lambda x: x["lines"]), " ")
    counts = [F.size("line").cast("long").alias("n_lines"), count(lambda x: ~is_article(x) & x["shared"]).alias("n_shared"), count(lambda x: is_marked(x) & ~x["shared"]).alias("n_marked")]
    return joined.select("page_id", "url", text.alias("text"), *counts).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_marked")
