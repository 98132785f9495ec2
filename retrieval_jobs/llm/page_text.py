"""Main text of web pages: each page is differenced with the page of the nearest URL on its host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_slices, slices

TEXT = re.compile("[^<]+")
TAG = re.compile("<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag whose quotes are closed.
REST = re.compile(r"((?:[^'\">]+|\"[^\"]*\"|'[^']*')*+)>")
CLOSING = re.compile("</([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "math", "canvas"}
CHROME = {"head", "nav", "footer", "aside", "menu", "dialog", "button", "select", "legend", "datalist"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements of one paragraph; their id names the paragraph, often by its text.
TEXTUAL = INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre"}
#: What an element that begins ends, if it is still open: a paragraph can't hold a block, nor an item an item.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words that mark what isn't the article, where they are a whole name in class, id or role, or a name of several words with such of the second list.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "recommended", "related", "replies",
    "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
PLACE_WORDS = {
    "area", "articles", "bar", "bottom", "box", "buttons", "column", "container", "content", "form", "global", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "local", "main", "outer", "overlay", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "stories", "sub", "top", "unit", "wrap", "wrapper",
}

WRAPPER_SHARE = 0.5  # a form with so much of a page's text is round the page, not a part of it
TEASER_SHARE = 0.1  # articles with less of a page's text aren't what the page is about
PRIOR = 10  # lines' worth of what all hosts say about a slot, beside what its own host says
COMMON_PAGES = 3  # a line that so many different pages of a host share, and half of them at least, is the host's
BROADCAST_ROWS = 200_000  # pages with deletions that at most go to every executor; more are joined by a shuffle
LCS_BYTES = 1 << 24  # of a difference's table at most; larger ones are cut in halves


class _Page:
    """A page read from its start: a stack of open elements, and the lines that end where blocks begin and end.

    What the reader asks of the stack is kept beside it, so that no step walks it: where elements of a name are open, where the innermost
    block is, how many elements of chrome, and which of those may turn out to be none.
    """

    def __init__(self):
        self.open: list[tuple[str, bool, int, bool]] = []  # name, is block, number of its path, is chrome
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.lost: list[int] = []  # places of chrome elements that never end
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.chrome = self.forms = 0

    def has(self, name: str) -> bool:
        return bool(self.at.get(name))

    def push(self, name: str, block: bool, label: str, chrome: bool, ends: bool) -> None:
        path = self.open[-1][2] if self.open else 0
        if block:
            path = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path)
            self.blocks.append(len(self.open))
        if chrome and not ends:
            self.lost.append(len(self.open))
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, block, path, chrome))
        self.chrome += chrome

    def end_line(self) -> None:
        if self.parts:
            line = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if line:
                zone = (1 if self.has("main") else 0) + (2 if self.has("article") else 0)
                self.lines.append((line, self.open[-1][2] if self.open else 0, zone, self.forms if self.has("form") else 0))

    def pop(self, k: int) -> None:
        """Ends the k-th open element and all inside it."""
        while len(self.open) > k:
            name, block, _, chrome = self.open.pop()
            self.at[name].pop()
            self.chrome -= chrome
            if block:
                self.blocks.pop()
            if self.lost and self.lost[-1] == len(self.open):
                self.lost.pop()

    def find(self, names: set[str], within: set[str]) -> int:
        """The innermost open element of one of the names, not beyond one of within; -1 if there is none."""
        k = max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)
        return k if k > max((self.at[x][-1] for x in within if self.at.get(x)), default=-1) else -1

    def forgive(self) -> None:
        """Chrome that never ends is left, since an article begins in it."""
        for k in self.lost:
            name, block, path, _ = self.open[k]
            self.open[k] = (name, block, path, False)
            self.chrome -= 1
        self.lost.clear()


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """A page's text blocks in order, each with a number for the path of its elements, and where it stands: 1 in a main element, 2 in an article, 3 in both, 0 elsewhere.

    What stands in chrome is left out: menus, footers, sidebars, controls of forms, scripts, styles, the head, and elements
    whose class, role or id says so (an id only where the element isn't a piece of text itself); a header
    or a name ``header`` counts outside articles. What stands in a chrome element is chrome, so an article among the comments is none;
    only an element that never ends is left when an article or main element begins in it. A form is left out, but one with
    WRAPPER_SHARE of the text is round the page, and there only its controls and labels are. Text of inline chrome
    leaves its block's other text in one line.
    Block elements end a line; white space and line breaks inside become one space; character references
    are decoded. Tags that never end are left out up to the next one. The time is in proportion to the page, whatever its markup.
    """
    at, out, whole = 0, _Page(), True
    last_end = page.rfind(">")
    closings = {m[1].lower(): m.start() for m in CLOSING.finditer(page)}
    while at < len(page):
        text = TEXT.match(page, at)
        if text:
            at = text.end()
            if not out.chrome:
                out.parts.append(text[0])
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = TAG.match(page, at)
        if not tag and not page.startswith(("<!", "<?"), at):
            if not out.chrome:
                out.parts.append("<")
            at += 1
            continue
        if at > last_end:  # a tag that never ends
            at += 1
            rest = TEXT.match(page, at)
            at = rest.end() if rest else at
            continue
        if not tag:
            at = page.index(">", at) + 1
            continue
        closing, name = tag[1], tag[2].lower()
        end = REST.match(page, tag.end()) if whole else None
        if end:
            more, at = end[1], end.end()
        else:  # quotes that aren't closed: from here on the next > ends a tag
            whole = False
            stop = page.find(">", tag.end())
            more, at = page[tag.end() : stop], stop + 1
        if name in INLINE and "=" not in more and not (name == "label" and out.has("form")):
            if name == "br":
                out.parts.append(" ")
            elif out.open and not out.open[-1][1] or closing:
                _inline(out, name, bool(closing), False)
            continue
        if name not in INLINE and name not in RAW:
            out.end_line()
        if closing:
            if name in INLINE:
                _inline(out, name, True, False)
            elif (k := out.find({name}, set())) >= 0:
                out.pop(k)
        elif name in RAW:
            if not more.endswith("/"):
                at = _after_raw(page, name, at)
        elif name in VOID or (more.endswith("/") and name not in INLINE):
            continue
        elif name in INLINE:
            _inline(out, name, False, (name == "label" and out.has("form")) or _is_chrome(name, more, True))
        else:
            if (k := out.find({"p"}, {"button", "table", "td", "th"})) >= 0:
                out.pop(k)
            if name in ENDS and (k := out.find(ENDS[name], HOLDS[name])) >= 0:
                out.pop(k)
            if name in ("article", "main"):
                out.forgive()
            if name == "form":
                out.forms += 1
            kind = ATTRIBUTE.search(more)
            label = name + ("." + (kind[2] or kind[3] or kind[4] or "") if kind and kind[1].lower() == "class" else "")
            out.push(name, True, label, _is_chrome(name, more, out.has("article") or out.has("main")), closings.get(name, -1) >= at)
    out.end_line()
    held: dict[int, int] = {}
    for line, _, _, form in out.lines:
        held[form] = held.get(form, 0) + len(line)
    around = {form for form, size in held.items() if not form or size >= WRAPPER_SHARE * sum(held.values())}
    return [(line, path, zone) for line, path, zone, form in out.lines if form in around]


def main_lines(lines: list[tuple[str, int, int]]) -> list[bool]:
    """Which of a page's lines are its main text: those of the main element, or of the articles where there is none and they aren't mere teasers, or all."""
    if any(zone & 1 for _, _, zone in lines):
        return [bool(zone & 1) for _, _, zone in lines]
    size = sum(len(x) for x, _, zone in lines if zone)
    if size and size >= TEASER_SHARE * sum(len(x) for x, _, _ in lines):
        return [bool(zone) for _, _, zone in lines]
    return [True] * len(lines)


def _inline(out: _Page, name: str, closing: bool, chrome: bool) -> None:
    """Inline elements are followed only from one that is chrome on, to find its end; they end no line, and a block ends them."""
    if not closing:
        if chrome or (out.open and not out.open[-1][1]):
            out.push(name, False, name, chrome, True)
    elif out.has(name) and out.at[name][-1] > (out.blocks[-1] if out.blocks else -1):
        out.pop(out.at[name][-1])


def _after_raw(page: str, name: str, at: int) -> int:
    """Where an element ends whose content isn't markup."""
    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME or (name == "header" and not in_article):
        return True
    if name in ("html", "body") or "=" not in attributes:
        return False
    for found in ATTRIBUTE.finditer(attributes):
        if found[1].lower() == "id" and name in TEXTUAL:
            continue
        for value in (found[2] or found[3] or found[4] or "").lower().split():
            words = {w for w in re.split(r"[^a-z0-9]+", value) if not w.isdigit()} - {""}
            if name in ("article", "main") and len(words) > 1:
                continue
            marks = words & (CHROME_WORDS if in_article else CHROME_WORDS | {"header"})
            if marks and words - marks <= PLACE_WORDS:
                return True
    return False


def shared_lines(one: Sequence, two: Sequence) -> list[int]:
    """Positions in one of a longest common subsequence of lines with two.

    Lines that the other side lacks, and what is equal at both ends, are set aside first. The rest is
    a table of one bit per pair of lines, a row of it being one integer; a table of more than LCS_BYTES is
    cut in halves (each with the half of two that fits it best), so memory stays bounded.
    """
    start = 0
    while start < min(len(one), len(two)) and one[start] == two[start]:
        start += 1
    end = 0
    while end < min(len(one), len(two)) - start and one[-1 - end] == two[-1 - end]:
        end += 1
    both = set(one[start : len(one) - end]) & set(two[start : len(two) - end])
    places = [k for k in range(start, len(one) - end) if one[k] in both]
    found = _common([one[k] for k in places], [x for x in two[start : len(two) - end] if x in both])
    return [*range(start), *(places[k] for k in found), *range(len(one) - end, len(one))]


def _rows(one: Sequence, two: Sequence) -> Iterator[int]:
    """After each line of one: bit j is 0 where two's line j makes the common subsequence longer."""
    masks: dict = {}
    for j, x in enumerate(two):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    for x in one:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _common(one: Sequence, two: Sequence) -> list[int]:
    if not one or not two:
        return []
    if len(one) > 1 and len(one) * (len(two) // 8 + 32) > LCS_BYTES:
        half = len(one) // 2

        def lengths(a: Sequence, b: Sequence) -> np.ndarray:
            row = 0
            for row in _rows(a, b):  # noqa: B007 - the last one counts
                pass
            bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
            return np.append(0, np.cumsum(1 - bits.astype(np.int64)))

        cut = int(np.argmax(lengths(one[:half], two) + lengths(one[half:][::-1], two[::-1])[::-1]))
        return _common(one[:half], two[:cut]) + [half + k for k in _common(one[half:], two[cut:])]
    rows = list(_rows(one, two))
    i, j, out = len(one), len(two), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def _split_url(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.rpartition("@")[2].lower(), parts.path)
    except ValueError:
        return ("", url or "")


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page (row, page_id, url, html), its place, and the hashes of its lines and of their slots."""
    for batch in sized_slices(batches, 3):
        hosts, paths, lines, slots, whole = [], [], [], [], []
        for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            host, path = _split_url(url)
            found = page_lines(page or "")
            hosts.append(host)
            paths.append(path)
            lines.append([_number(x) for x, _, _ in found])
            slots.append([x - (1 << 63) for _, x, _ in found])
            whole.append(_number("\n".join(x for x, _, _ in found)))
        numbers = [pa.array(x, pa.list_(pa.int64())) for x in (lines, slots)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *numbers, pa.array(whole, pa.int64())], names=["row", "page_id", "host", "path", "lines", "slots", "content"])


def _difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the lines (row, host, content, lines, slots, other) that a page shares with its neighbour."""
    for batch in slices(batches, 1024):
        shared = [shared_lines(own, other or []) for own, other in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shared, pa.list_(pa.int32()))], names=["row", "host", "content", "lines", "slots", "shared"])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page (page_id, url, html, gone)."""
    for batch in sized_slices(batches, 2):
        texts, n_lines, n_gone = [], [], []
        for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            lines, gone = page_lines(page or ""), set(gone or [])
            texts.append("\n\n".join(x for k, ((x, _, _), kept) in enumerate(zip(lines, main_lines(lines), strict=True)) if kept and k not in gone))
            n_lines.append(len(lines))
            n_gone.append(len(gone))
        counts = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], n_lines, n_gone)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_lines", "n_deleted"])


def _neighbours(pages: DataFrame) -> DataFrame:
    """For each page (row, page_id, host, path) the row of the page of the same host with the nearest URL.

    Pages are range-partitioned by (host, path, page_id); the page before and the one after are found
    inside a part, and for the first and last rows of a part by a second pass over those rows alone, so a
    host of any size is spread over tasks. Nearer is the one whose path begins with more of the same segments.
    """
    light = pages.select("row", "page_id", "host", "path")
    ranged = light.repartitionByRange("host", "path", "page_id", "row").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part", "host").orderBy("path", "page_id", "row")
    across = Window.partitionBy("host").orderBy("path", "page_id", "row")
    me = F.struct("row", "path")
    local = ranged.withColumns({"before": F.lag(me).over(inner), "after": F.lead(me).over(inner)})
    local = materialize(local, "page-order")
    edges = local.where("before is null or after is null").select("row", F.lag(me).over(across).alias("edge_before"), F.lead(me).over(across).alias("edge_after"))
    full = local.join(edges, "row", "left").withColumns({"before": F.coalesce("before", "edge_before"), "after": F.coalesce("after", "edge_after")})

    def common(other: str):
        same = F.zip_with(F.split("path", "/"), F.split(F.col(other)["path"], "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.coalesce(F.array_position(same, False), F.lit(0))  # 0 when all are equal

    def rank(other: str):
        return F.when(F.col(other).isNull(), -1).when(common(other) == 0, 1_000_000).otherwise(common(other))

    return full.select("row", F.when(rank("after") > rank("before"), F.col("after.row")).otherwise(F.col("before.row")).alias("neighbour"))


def _deletions(differenced: DataFrame) -> DataFrame:
    """Of the shared lines of different pages (row, host, content, lines, slots, shared), those that are the host's: host, content, gone.

    Two things tell a host's own lines from passages that its articles have in common. A line is the
    host's if COMMON_PAGES or more of its different pages share it with their neighbours, and half of
    them at least. And a shared line is the host's if most lines in the same slot, on this host's
    pages and with PRIOR lines' worth of all hosts' pages, are shared ones: frames are the same from
    page to page, articles aren't.
    """
    at = F.posexplode(F.arrays_zip("lines", "slots"))
    lines = differenced.select("host", "content", "shared", at.alias("pos", "x")).select("host", "content", "pos", "x.lines", "x.slots", F.array_contains("shared", F.col("pos")).alias("both"))
    slots = materialize(lines.groupBy("host", "slots").agg(F.count("*").alias("n"), F.sum(F.col("both").cast("long")).alias("s")), "page-slots")
    overall = slots.groupBy("slots").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    pages = differenced.groupBy("host").agg(F.count("*").alias("pages"))
    shared = materialize(lines.where("both").drop("both"), "shared-lines")
    often = shared.groupBy("host", "lines").agg(F.count_distinct("content").alias("times")).join(pages, "host").where((F.col("times") >= COMMON_PAGES) & (2 * F.col("times") >= F.col("pages"))).select("host", "lines", F.lit(True).alias("often"))
    prior = (F.col("all_s") + 0.5) / (F.col("all_n") + 1)
    frame = slots.join(overall, "slots").where((F.col("s") + PRIOR * prior) / (F.col("n") + PRIOR) >= 0.5).select("host", "slots", F.lit(True).alias("frame"))
    judged = shared.join(materialize(often, "host-lines"), ["host", "lines"], "left").join(materialize(frame, "host-slots"), ["host", "slots"], "left")
    return judged.where(F.coalesce("often", "frame", F.lit(False))).groupBy("host", "content").agg(F.collect_list("pos").alias("gone"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars, n_lines, n_deleted.

    A page's lines are its text blocks outside recognised chrome (``page_lines``). Each is held against
    the page of the nearest URL on its host that isn't a copy of it: the longest common subsequence of all
    their lines is what the two share. Shared lines are deleted where they are the host's (``_deletions``):
    shared by many of its pages, or standing in a slot whose lines are mostly shared. Passages that articles have
    in common stay. Of what is left, the text is the article (or main element) where the page marks
    one, else all of it. Lines are joined by a blank line. n_lines counts the lines compared and n_deleted
    those deleted.

    Only hashes of lines are sent between tasks. Pages of a host with equal lines are compared once.
    A null or empty page has the text ``""``. Pages with a null or broken URL have one host together.
    Repeated rows are kept, each with its text. Further columns are left aside. An empty table gives no rows.
    """
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    named = read.select(_row_key().alias("row"), "page_id", "url", "html")
    schema = "row string, page_id long, host string, path string, lines array<long>, slots array<long>, content long"
    frames = materialize(named.mapInArrow(_frames, schema), "page-frames")
    first = F.min_by(F.struct("row", "path", "page_id", "lines", "slots"), F.struct("path", "page_id", "row")).alias("p")
    different = materialize(frames.where(F.size("lines") > 0).groupBy("host", "content").agg(first).select("host", "content", "p.*"), "different-pages")
    others = different.select(F.col("row").alias("neighbour"), F.col("lines").alias("other"))
    paired = different.join(_neighbours(different), "row").join(others, "neighbour", "left")
    shape = "row string, host string, content long, lines array<long>, slots array<long>, shared array<int>"
    differenced = materialize(paired.select("row", "host", "content", "lines", "slots", "other").mapInArrow(_difference, shape), "differenced")
    gone = materialize(_deletions(differenced), "deletions")
    rows = materialize(frames.select("row", "host", "content").join(gone, ["host", "content"]).select("row", "gone").dropDuplicates(["row"]), "page-deletions")
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = named.join(F.broadcast(rows) if few else rows, "row", "left").select("page_id", "url", "html", "gone")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_lines long, n_deleted long")


def _row_key() -> Column:
    return F.concat_ws("-", F.xxhash64("page_id", "url", "html"), F.xxhash64(F.lit(1), "page_id", "url", "html"))
