"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block. All distinct lists of lines are ordered by (host, URL path); each page
is paired with the nearest before it (or else after it) on its host that lies outside its run of near copies, their lines
are aligned by longest common subsequence, and shared lines are deleted as part of the host's template. Near copies
share COPY of the characters of one of them.

Markup adds two things: lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
dropped, shared or not (two pages need not have the same menu), and lines inside a declared article (article, main, or
an articleBody property) stay, shared or not (articles quote the same licence or passage). All lines take part in the
alignment. Script and style are no lines.

The alignment works on line hashes: an order by ranges, and neighbours passed between ranges, so that a large host is no
single task. Whole lines move only if more than BROADCAST_PAGES pages have something to delete.

Defined cases: null, empty and textless pages give an empty text; a page without a neighbour on its host, or with
near copies only, shares nothing; a null url is a host of its own with an empty path; copies and repeated rows share
one result; other columns are ignored, whatever their names; unclosed and misnested tags are tolerated; a long page is
one row of lines.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineora.llm.common import cut, small_batches

#: Fixed values of the HTML standard and of common page markup.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas audio video button select textarea dialog menu".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "template"))
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar cookie cookies consent notice popup modal newsletter subscribe share sharing social related comment comments disqus".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def _is_dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        words = value.strip("\"'").lower().split()
        if name.lower() == "role" and DROPPED_ROLES & {*words}:
            return True
        if name.lower() in ("class", "id") and any(DROPPED_NAMES & {w, *re.split(r"[-_]", w)[:1]} for w in words) and tag not in ("body", "html", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return True
    return False


def _is_article(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or any(("role", "main") == (n.lower(), v.strip("\"'").lower()) or ("itemprop", "articlebody") == (n.lower(), v.strip("\"'").lower()) for n, v in (_ATTRIBUTE.findall(attributes) if "=" in attributes else ()))


DROP, PLAIN, ARTICLE = 0, 1, 2


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The page's text lines in order, each DROP (in what markup says is no main text), ARTICLE (inside a declared article) or PLAIN."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    aside: list[str] = []
    dropped = article = 0

    def flush(held: list[str], kind: int) -> None:
        if held:
            if text := " ".join(_html.unescape("".join(held)).split()):
                out.append((text, kind))
            held.clear()

    def end_block() -> None:
        flush(aside, DROP)
        flush(parts, ARTICLE if article else PLAIN)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if text := page[at : m.start() if m else end]:
            (aside if dropped else parts).append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag in DROPPED:
            end_block()
        elif tag == "br":
            (aside if dropped else parts).append(" ")
        if m[1]:
            depth = next((i for i in reversed(range(len(stack))) if stack[i][0] == tag), None)
            if depth is not None:
                for _, d, a in stack[depth:]:
                    dropped -= d
                    article -= a
                del stack[depth:]
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag and not stack[-1][1]:
                stack.pop()
            d, a = _is_dropped(tag, m[3]), _is_article(tag, m[3])
            stack.append((tag, d, a))
            dropped += d
            article += a
    end_block()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Indexes of a on a longest common subsequence with b (Hunt and Szymanski)."""
    places: dict[object, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k] = j
                links[k] = link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _parse(batches):
    for batch in batches:
        found = [lines_of(x.as_py()) for x in batch.column("html")]
        pick = lambda f, kind: pa.array([[f(*x) for x in page] for page in found], pa.list_(kind))  # noqa: B023, E731
        columns = [pick(lambda t, _: t, pa.string()), pick(lambda _, k: k, pa.int8()), pick(lambda t, _: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63), pa.int64()), pick(lambda t, _: len(t), pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "lines", "kinds", "hashes", "sizes"])


#: Pages that share so much of the characters of one of them are copies, not pages of one template.
COPY = 0.8
#: Up to so many pages with lines to delete (about 100 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_PAGES = 200_000


def compared(a: dict, b: dict) -> tuple[set[int], bool]:
    """Indexes of a's lines shared with b (hashes and sizes of lines), and whether the pages are near copies."""
    shared = shared_lines(list(a["hashes"]), list(b["hashes"]))
    same = sum(int(a["sizes"][i]) for i in shared)
    return shared, same >= COPY * min(int(sum(a["sizes"])), int(sum(b["sizes"])))


def _rows(frame):
    return (None if h is None else {"hashes": h, "sizes": s} for h, s in zip(frame["hashes"], frame["sizes"], strict=True))


def _is_copy(page, other):
    import pandas as pd

    return pd.Series([b is not None and compared(a, b)[1] for a, b in zip(_rows(page), _rows(other), strict=True)], dtype=bool)


def _shared(page, before, after):
    import pandas as pd

    out = []
    for a, *others in zip(_rows(page), _rows(before), _rows(after), strict=True):
        found = (compared(a, b) for b in others if b is not None)
        out.append(sorted(next((shared for shared, copy in found if not copy), ())))
    return pd.Series(out)


def _host_path_mark(df: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "mark": F.sha2(F.to_json(F.struct("hashes", "kinds")), 256)})


def shared_with_neighbours(pages: DataFrame) -> DataFrame:
    """pages: host, path, page_id, mark, hashes, sizes. (host, mark, shared): for each distinct list of lines the indexes
    of those it shares with the nearest page by (host, path) that is no near copy."""
    keys = ["host", "path", "page_id", "mark"]
    place = F.min(F.struct("path", "page_id")).alias("place")
    lists = pages.groupBy("host", "mark").agg(place, F.first(F.struct("hashes", "sizes")).alias("page")).select("host", "mark", "place.*", "page")
    ranged = cut(lists.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    spot = F.struct("host", "page")
    order = Window.partitionBy("range").orderBy(*keys)
    along = Window.orderBy("range")  # a row for each range
    ends = ranged.groupBy("range").agg(F.max_by(spot, F.struct(*keys)).alias("last")).select(F.col("range").alias("__range"), F.lag("last").over(along).alias("__last"))
    empty = F.lit(None).cast("struct<hashes:array<bigint>,sizes:array<int>>")
    same = lambda side: F.coalesce(F.when(F.col(f"{side}.host") == F.col("host"), F.col(f"{side}.page")), empty)
    near = ranged.join(F.broadcast(ends), F.col("range") == F.col("__range")).withColumn("prev", F.coalesce(F.lag(spot).over(order), "__last")).drop("__range", "__last")
    # a run of near copies begins where a page is none of the page before it
    begins = ~F.pandas_udf(_is_copy, "boolean")("page", same("prev"))
    runs = cut(near.withColumn("begins", begins).withColumns({"left": F.when(F.col("begins"), F.struct("prev")), "right": F.when(F.col("begins"), spot)}), "runs")
    left = F.last("left", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("range").orderBy(*(F.col(k).desc() for k in keys))
    right = F.last("right", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    of_range = runs.groupBy("range").agg(F.max_by("left", F.when(F.col("begins"), F.struct(*keys))).alias("left"), F.min_by("right", F.when(F.col("begins"), F.struct(*keys))).alias("right"))
    earlier = F.last("left", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("right", True).over(along.rowsBetween(1, Window.unboundedFollowing))
    of_range = of_range.select(F.col("range").alias("__range"), earlier.alias("__left"), later.alias("__right"))
    met = runs.withColumns({"__l": left, "__r": right}).join(F.broadcast(of_range), F.col("range") == F.col("__range"))
    met = met.select("host", "mark", "page", F.coalesce("__l", "__left")["prev"].alias("before"), F.coalesce("__r", "__right").alias("after"))
    return met.select("host", "mark", F.pandas_udf(_shared, "array<int>")("page", same("before"), same("after")).alias("shared"))


def marked_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, lines, kinds and shared (indexes of the lines that the page's neighbour has too) for every row of pages."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    parsed = _host_path_mark(cut(rows.mapInArrow(_parse, "page_id long, url string, lines array<string>, kinds array<byte>, hashes array<long>, sizes array<int>"), "lines"))
    found = shared_with_neighbours(parsed.select("host", "path", "page_id", "mark", "hashes", "sizes"))
    found = cut(found.where(F.size("shared") > 0).select(F.col("host").alias("__host"), F.col("mark").alias("__mark"), "shared"), "shared")
    small = found.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    met = parsed.join(F.broadcast(found) if small else found.hint("merge"), (F.col("host") == F.col("__host")) & (F.col("mark") == F.col("__mark")), "left")
    return met.select("page_id", "url", "lines", "kinds", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text for every row of pages."""
    kind = lambda i: F.element_at("kinds", i + 1)
    stays = lambda _, i: (kind(i) == ARTICLE) | ((kind(i) == PLAIN) & ~F.array_contains("shared", i))
    return marked_lines(pages, page_id, url, html).select("page_id", "url", F.array_join(F.filter("lines", stays), "\n").alias("text"))
