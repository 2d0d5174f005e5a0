"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one per block element; scripts, styles, and controls are no lines. Pages are put
in the order of their host and URL path; each is paired with the neighbour on the same host whose path
shares the longer beginning (the one before it, if equal), the two pages' lines are aligned
by a longest common subsequence, and lines that both share are deleted, with these exceptions:

* a neighbour that is a copy (see `is_copy`) says nothing, or two copies of an article would delete each other;
* inside an explicit article or main element a shared line goes only if the neighbours on both sides have
  it, and paragraphs and headings stay: two articles may quote the same passage;
* on pages without such an element a shared line goes if it stands before the page's first or after its
  last own line, or if the neighbours on both sides have it.

Menus, adverts and footers may differ on every page; no alignment finds those. So of what is left,
lines go that the markup names as such (`DROPPED`, `NAMES`, `ROLES`), and on pages with an article
or main element lines outside it. `n_shared` and `n_named` count what either step deleted.

A page without neighbours, or with copies only, is judged by its markup alone. Null html is empty; null URLs
are of one host without a name. Rows with equal keys are pages of their own, equal URLs are in the order of key and html.
Very long pages cost time in proportion to their lines times those that both pages have, by 64-bit words.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head".split()
)
#: Elements whose content is never markup, up to their end tag (to the end of the page for the first two).
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
#: Controls and drawings: dropped up to their end tag if no block element begins before it, else only up to the next tag.
CONTROLS = frozenset("svg object select button canvas audio video".split())
DROPPED = frozenset("nav footer aside form head menu dialog search".split())
#: Words of class and id, and roles, that name what is not the article; words that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager footer masthead comment comments disqus replies respond social "
    "share sharing related recommended widget skip copyright disclaimer toc".split()
)
BESIDE = frozenset("left right top bottom site page main global primary secondary wrapper wrap container box block list item items inner outer bar area section links buttons wide mobile header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
PROTECTED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
#: Elements that are tracked until their end tag; others only begin or end lines, or nothing.
TRACKED = frozenset("div section article main nav header footer aside form ul ol dl table figure body html head menu dialog search details span blockquote fieldset".split())
#: Of a line: in the body, in the article, in the article and protected, named as something else.
BODY, INSIDE, SAFE, NAMED = range(4)
#: Partitions that pages are dealt into at most; they are sorted and read as streams, so their size is no matter of memory.
RANGES = 20_000

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>?")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
BLANKS = re.compile(r"\s+")


def _named(rest: str) -> tuple[bool, bool]:
    """Whether attributes name something that is not the article; whether they make it the main part."""
    main = False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            main |= value == "main"
            if value in ROLES:
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name in ("class", "id"):
            for token in value.split():
                words = set(re.split(r"[^a-z0-9]+", token)) - {""}
                if not NAMES.isdisjoint(words) and words <= NAMES | BESIDE:
                    return True, False
    return False, main


def _raw_end(html: str, name: str, at: int) -> int:
    """Where the content of an element that began before `at` ends, or `at` itself if it is not to be dropped."""
    end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
    if name in RAW:
        return end.end() if end else len(html) if name in ("script", "style") else at
    tags = TAG.finditer(html, at, end.start() if end else len(html))
    block = next((m.start() for m in tags if m[2].lower() in BLOCK), None)
    return end.end() if end and block is None else max(at, html.find("<", at))


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """The lines of a page, and of each whether it is BODY, INSIDE, SAFE or NAMED."""
    lines: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, named as something else, main
    named = main = 0
    kind, at, n = "", 0, len(html)

    def flush() -> None:
        if parts:
            text = BLANKS.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                lines.append(text)
                kinds.append(NAMED if named else BODY if not main else SAFE if kind in PROTECTED else INSIDE)

    while at < n:
        i = html.find("<", at)
        if i < 0:
            i = n
        if i > at:
            parts.append(unescape(html[at:i]))
        if i == n:
            break
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), i):
            end = html.find(">", i)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG.match(html, i)
        if not m:
            parts.append("<")
            at = i + 1
            continue
        at = m.end()
        closing, name, rest = m[1], m[2].lower(), m[3]
        if name in RAW or name in CONTROLS:
            if not closing and not rest.endswith("/"):
                at = _raw_end(html, name, at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK or name == "span" and stack and stack[-1][1]:
            flush()
            kind = "" if closing else name
        if name in VOID or name not in TRACKED:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(bad for _, bad, _ in stack[k:]):
                        flush()
                    for _, bad, x in stack[k:]:
                        named, main = named - bad, main - x
                    del stack[k:]
                    break
            continue
        if rest.endswith("/"):
            continue
        bad, is_main = _named(rest)
        is_main |= name in ("article", "main")
        if (is_main or name == "body") and named and not any(d and e in ("nav", "footer", "aside") for e, d, _ in stack):
            stack = [(e, False, x) for e, _, x in stack]  # an advert or head that was never closed
            named = 0
        # What is the article by its element's name is it whatever its classes say.
        bad = (bad or name in DROPPED or name == "header" and not main) and not is_main and name not in ("body", "html")
        if bad:
            flush()
        stack.append((name, bad, is_main and not named))
        named, main = named + bad, main + (is_main and not named)
    flush()
    return lines, kinds


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`, by bit-parallel rows over the lines that both have."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    where: dict[int, int] = {}
    for k, i in enumerate(at):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(at)) - 1
    rows, s = [], full
    for x in b:
        u = s & where[x]
        s = ((s + u) | (s - u)) & full
        rows.append(s)
    out, i, j = set(), len(at) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(at[i])
            i, j = i - 1, j - 1
    return out


def is_copy(lines: list[str], common: set[int], same_path: bool) -> bool:
    """Whether a neighbour that shares `common` is the page again: it has nine tenths of its characters, or half of them under the same path."""
    n = sum(map(len, lines))
    return sum(len(lines[i]) for i in common) >= (0.5 if same_path else 0.9) * n


def site_lines(lines: list[str], kinds: list[int], aligned: list[set[int]]) -> set[int]:
    """Places of the lines that are the site's, from the places shared with each neighbour that is no copy, the nearest first."""
    if not aligned:
        return set()
    several = set.intersection(*aligned) if len(aligned) > 1 else set()
    several = {i for i in several if kinds[i] != SAFE}
    if INSIDE in kinds or SAFE in kinds:
        return several | {i for i in aligned[0] if kinds[i] in (BODY, NAMED)}
    own = [i for i in range(len(lines)) if i not in aligned[0] and kinds[i] != NAMED]
    return several | {i for i in aligned[0] if kinds[i] == NAMED or own and not own[0] < i < own[-1]}


def named_lines(kinds: list[int]) -> set[int]:
    """Places of the lines that the markup puts outside the article."""
    article = INSIDE in kinds or SAFE in kinds
    return {i for i, k in enumerate(kinds) if k == NAMED or article and k == BODY}


def _hashes(lines: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def main_text(page: dict, neighbours: list[dict]) -> tuple[str, int, int]:
    """The text of a page (lines, kinds, hashes, path) beside its neighbours on the host, and how many lines differencing and markup deleted."""
    near = sorted(neighbours, key=lambda s: -_prefix(s["path"], page["path"]))
    aligned = [(shared(page["hashes"], s["hashes"]), s["path"] == page["path"]) for s in near]
    gone = site_lines(page["lines"], page["kinds"], [common for common, same in aligned if not is_copy(page["lines"], common, same)])
    named = named_lines(page["kinds"]) - gone
    return "\n\n".join(x for i, x in enumerate(page["lines"]) if i not in gone and i not in named), len(gone), len(named)


def extract(pages: DataFrame, key: str = "page_id", per_range: int = 1000) -> DataFrame:
    """(key, url, text, n_chars, n_shared, n_named) of every page; other columns are not read."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = (F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", i) for i in (1, 2))
    rows = pages.select(F.col(key).alias("key"), "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(host).alias("host"), path.alias("path"))
    rows = rows.withColumn("at", F.concat_ws("\x01", "host", "path", F.lpad(F.coalesce(F.col("key").cast("string"), F.lit("")), 20, "0")))
    # Ranges of (host, path): bounds from a sample of about 10 URLs a range, some megabytes at most.
    n = rows.count()
    ranges = max(1, min(RANGES, n // per_range))
    found = sorted(r[0] for r in rows.select("at").sample(min(1.0, 10 * ranges / max(n, 1)), seed=7).limit(20 * ranges).collect()) if ranges > 1 else []
    bounds = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array([bisect_right(bounds, x) for x in b.column("at").to_pylist()], pa.int32())], ["at", "range"])

    def parse(batches):
        for b in batches:
            parsed = [lines_of(h) for h in b.column("html").to_pylist()]
            of = b.column("range").to_pylist()
            of = [bisect_right(bounds, x) if r is None else r for x, r in zip(b.column("at").to_pylist(), of)]
            arrays = [b.column(c) for c in ("key", "url", "host", "path", "at")] + [pa.array(of, pa.int32()), pa.compute.is_valid(b.column("range"))]
            arrays += [pa.array([p[0] for p in parsed], pa.list_(pa.string())), pa.array([p[1] for p in parsed], pa.list_(pa.int32())), pa.array([_hashes(p[0]) for p in parsed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    NAMES = ["key", "url", "host", "path", "at", "range", "copy", "lines", "kinds", "hashes"]
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, url string, host string, path string, at string, range int, copy boolean, lines array<string>, kinds array<int>, hashes array<long>"
    # Every range also gets copies of the last page before it and of the first after it: two rows a range.
    ends = keep(rows.select("at").mapInArrow(dealt, "at string, range int").groupBy("range").agg(F.min("at").alias("first"), F.max("at").alias("last")), "pages-ends")
    order = W.orderBy("range")
    ends = ends.select(F.struct(F.col("first").alias("at"), F.lag("range").over(order).alias("range")).alias("a"), F.struct(F.col("last").alias("at"), F.lead("range").over(order).alias("range")).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").where("range IS NOT NULL")
    copies = rows.join(F.broadcast(ends), "at").select(*rows.columns, "range")
    both = rows.withColumn("range", F.lit(None).cast("int")).union(copies).mapInArrow(parse, schema)
    laid = both.repartition("range").sortWithinPartitions("range", "at", "hashes")

    def difference(batches):
        """Streams pages in order; each is judged when the one after it is known."""
        out: list[tuple] = []

        def judge(before, page, after) -> None:
            if page is not None and not page["copy"]:
                sides = [s for s in (before, after) if s and s["range"] == page["range"] and s["host"] == page["host"]]
                out.append((page["key"], page["url"], *main_text(page, sides)))

        def batch():
            cols = list(zip(*out)) if out else [[]] * 5
            types = (key_type, pa.string(), pa.string(), pa.int32(), pa.int32())
            k, u, texts, gone, named = (pa.array(c, t) for c, t in zip(cols, types))
            out.clear()
            return pa.RecordBatch.from_arrays([k, u, texts, pa.compute.utf8_length(texts).cast(pa.int64()), gone, named], [key, "url", "text", "n_chars", "n_shared", "n_named"])

        before = page = None
        for b in batches:
            key_type = b.schema.field("key").type
            for i in range(0, b.num_rows, 100):
                for after in b.slice(i, 100).to_pylist():
                    judge(before, page, after)
                    before, page = page, after
                yield batch()
        if page is not None:
            judge(before, page, None)
            yield batch()

    return laid.mapInArrow(difference, f"`{key}` {kind}, url string, text string, n_chars long, n_shared int, n_named int")
