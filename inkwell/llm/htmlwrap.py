"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages become token streams of block tags and text slots, with adjacent repetitions folded into repeated groups. A slot
says what holds it: an article, a main element, an element that is boilerplate by its kind, class or role, or none of
these. The distinct streams of a host are aligned one after another: what matches stays, what one side lacks becomes an
optional group, or one more turn of a repeated group, and texts become slots. Streams are counted before they meet, and
a host's streams are aligned in groups of about GROUP whose wrappers are then aligned, so a host of any size is many
small groups.

Every page is parsed once and matched against its host's wrapper, and its text comes from the slots it fills. Of a
host whose wrapper has an article (or else a main element), a page with that element gives the slots within it, all of
them. Any other page gives all slots but those of boilerplate, and of these go the texts that are the template's: those
that most pages that fill a slot have there.

Defined results: a null or empty html has an empty text. A null url is a host of its own. Fewer than LEAST distinct
pages with a slot tell nothing of it, and its texts stay. Exact copies of a page count once in that. Streams of which
the product of lengths is over CELLS are aligned part by part, which keeps them matched but finds fewer repetitions.
Repeated rows get the same text each. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Streams that are aligned in one group; longest unit of a repetition; bytes of wrappers that may be broadcast (beyond
#: it they are joined by host); cells of the table of an alignment, and the length of the parts beyond it.
GROUP, UNIT, BROADCAST_BYTES = 256, 6, 8 << 20
CELLS, PART = 1 << 20, 256
#: Distinct pages that must hold a text in a slot, besides most of those with the slot, for it to be the template's.
LEAST = 3

# Element names by role.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "head", "title"}
SKIP = RAW | {"nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
# Elements whose end tags may be left out; streams leave them out always.
OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "body", "html", "head"}
#: Words of class, id and role that mark boilerplate.
NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "gdpr", "legal", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget",
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, frozenset[str]]]:
    """(kind, name or text, words of class, id and role); kinds: open, close, text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], frozenset()
            return
        if m.start() > at:
            yield "text", page[at : m.start()], frozenset()
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), frozenset()
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, frozenset()
            continue
        words = frozenset(w for a in _ATTRIBUTE.finditer(m[3]) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())) if m[3] else frozenset()
        yield "open", name, words
        if name in ("script", "style", "textarea", "title", "noscript", "iframe") and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            yield "close", name, frozenset()
            at = end.end() if end else n


def walk(page: str) -> Iterator[tuple[str, str, list[tuple[str, bool]]]]:
    """Tokens with the stack of open elements, each with whether it is boilerplate: closing tags close what they
    match, a new block closes an open paragraph, and the first article or main region closes open boilerplate that
    lacks its closing tag."""
    stack: list[tuple[str, bool]] = []
    seen = False
    for kind, value, words in tokens(page):
        if kind == "open":
            if value not in INLINE and stack and stack[-1][0] == "p":
                stack.pop()
                yield "close", "p", stack
            if value in ("article", "main") and not seen:
                seen = True
                while any(noise and name not in ("head", "nav") for name, noise in stack):
                    stack.pop()
            if value in VOID:
                yield "void", value, stack
                continue
            inside = any(name in ("article", "main") for name, _ in stack)
            noise = value in SKIP or (value == "header" and not inside) or (value not in ("html", "body", "article", "main") and bool(words & NOISE))
            stack.append((value, noise))
            yield "open", value, stack
        elif kind == "close":
            names = [name for name, _ in stack]
            if value in names:
                del stack[len(names) - 1 - names[::-1].index(value) :]
            yield "close", value, stack
        else:
            yield "text", value, stack


# ---- wrappers ---------------------------------------------------------------------------------------------------
# An expression is a list of items: a symbol, ["+", expression] for one or more, ["?", expression] for none or one,
# ["*", expression] for any number.


def grouped(part: list, least: int, many: bool) -> list:
    """A group of `part`, at least 0 or 1 times and perhaps many times."""
    return ["+" if least else "*", part] if many else ["?", part]


def fold(items: list) -> list:
    """Fold adjacent repetitions of up to UNIT items into repeated groups, shortest units first, until none is left."""
    changed = True
    while changed:
        changed = False
        for size in range(1, UNIT + 1):
            out, i = [], 0
            while i < len(items):
                unit = items[i : i + size]
                j = i + size
                while len(unit) == size and items[j : j + size] == unit:
                    j += size
                if j > i + size and not (size == 1 and isinstance(unit[0], list)):
                    out.append(["+", unit])
                    i, changed = j, True
                elif out and isinstance(out[-1], list) and out[-1] == ["+", unit] and len(unit) == size:
                    i, changed = i + size, True
                else:
                    out.append(items[i])
                    i += 1
            items = out
        if len(items) > 1:
            once = [items[0]]
            for x in items[1:]:
                if not (isinstance(x, list) and x == once[-1]):
                    once.append(x)
                elif x[0] == "?":
                    once[-1] = ["*", x[1]]
            changed |= len(once) < len(items)
            items = once
    return items


#: Symbols of text: within an article, within a main element, elsewhere, within boilerplate.
IN_ARTICLE, IN_MAIN, PLAIN, NOISY = "#a", "#m", "#", "#!"


def stream(page: str) -> list:
    """The folded token stream of a page."""
    return fold(page_blocks(page)[0])


def page_blocks(page: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The symbols of a page: block tags, and text that is not blank; its blocks of text outside boilerplate, each with
    the number of its symbol."""
    out: list[str] = []
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    at = -1

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append((at, text))

    for kind, value, stack in walk(page):
        if kind == "void":
            if value == "hr":
                close()
            else:
                held.append(" ")
        elif kind == "text":
            names = {name for name, _ in stack}
            if any(noise for _, noise in stack):
                symbol = None if names & RAW else NOISY
            else:
                symbol = IN_ARTICLE if "article" in names else IN_MAIN if "main" in names else PLAIN
                if held and at >= 0 and value.strip() and out[at] in (IN_ARTICLE, IN_MAIN, PLAIN) and out[at] != symbol and out[-1] == out[at]:
                    close()
            if value.strip() and symbol and (not out or out[-1] != symbol):
                out.append(symbol)
            if symbol and symbol != NOISY:
                if value.strip():
                    at = len(out) - 1
                held.append(value)
        elif value not in INLINE:
            close()
            if not any(name in RAW for name, _ in stack) and not (kind == "close" and value in OPTIONAL_END):
                out.append(value if kind == "open" else "/" + value)
    close()
    return out, blocks


def align(a: list, b: list) -> list:
    """The least general expression, without alternatives, that both match: a longest common subsequence stays; what
    one side has alone becomes optional; a repeated group absorbs the other side's single turns."""

    def core(x: object) -> object:
        return x[1] if isinstance(x, list) else [x]

    def same(x: object, y: object) -> bool:
        return x == y or (isinstance(x, list) or isinstance(y, list)) and core(x) == core(y)

    def joined(x: object, y: object) -> object:
        if x == y:
            return x
        kinds = {k[0] if isinstance(k, list) else "1" for k in (x, y)}
        return grouped(core(x), not kinds & {"?", "*"}, bool(kinds & {"+", "*"}))

    n, m = len(a), len(b)
    if n * m > CELLS:
        parts = -(-max(n, m) // PART)
        cut = lambda x, k: x[k * len(x) // parts : (k + 1) * len(x) // parts]
        return [item for k in range(parts) for item in align(cut(a, k), cut(b, k))]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def optional(part: list) -> None:
        if len(part) == 1 and isinstance(part[0], list):
            kind, part = part[0]
        else:
            kind = "1"
        if part and out and isinstance(out[-1], list) and out[-1][1] == part:
            out[-1] = grouped(part, out[-1][0] == "+", True)
        elif part and out[-len(part) :] == part:
            del out[-len(part) :]
            out.append(["+", part])
        elif part:
            out.append(grouped(part, 0, kind in ("+", "*")))

    while i < n or j < m:
        if i < n and j < m and same(a[i], b[j]):
            out.append(joined(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        i0, j0 = i, j
        while i < n and (j >= m or best[i + 1][j] >= best[i][j + 1]) and not (j < m and same(a[i], b[j])):
            i += 1
        while j < m and not (i < n and same(a[i], b[j])) and (i >= n or best[i][j + 1] >= best[i + 1][j]):
            j += 1
        if [y for x in a[i0:i] for y in core(x)] == b[j0:j] and i - i0 == 1:
            out.append(grouped(b[j0:j], 0, a[i0][0] in ("+", "*")))
            continue
        optional(a[i0:i])
        optional(b[j0:j])
    return out


def symbols(expression: list) -> Iterator[str]:
    for x in expression:
        if isinstance(x, list):
            yield from symbols(x[1])
        else:
            yield x


class Matcher:
    """Matches symbols against an expression: each is given the number of the place in the expression it stands for."""

    def __init__(self, expression: list) -> None:
        self.symbols = list(symbols(expression))
        self.follow: list[set[int]] = [set() for _ in self.symbols]
        self.at = 0
        first, self.last, self.empty = self._build(expression)
        self.start = self._by_symbol(first)
        self.next = [self._by_symbol(f) for f in self.follow]

    def _build(self, expression: list) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for x in expression:
            if isinstance(x, list):
                f, l, e = self._build(x[1])
                if x[0] in ("+", "*"):
                    for p in l:
                        self.follow[p] |= f
                e = e or x[0] in ("?", "*")
            else:
                f, l, e = {self.at}, {self.at}, False
                self.at += 1
            for p in last:
                self.follow[p] |= f
            first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return first, last, empty

    def _by_symbol(self, places: set[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for p in sorted(places):
            out.setdefault(self.symbols[p], []).append(p)
        return out

    def match(self, page: list[str]) -> list[int] | None:
        """The place of each symbol, or None if the expression does not match."""
        if not page:
            return [] if self.empty else None
        steps: list[dict[int, int]] = [{p: -1 for p in self.start.get(page[0], ())}]
        for x in page[1:]:
            step: dict[int, int] = {}
            for s in steps[-1]:
                for p in self.next[s].get(x, ()):
                    step.setdefault(p, s)
            steps.append(step)
        ends = self.last & steps[-1].keys()
        if not ends:
            return None
        out = [min(ends)]
        for step in reversed(steps[1:]):
            out.append(step[out[-1]])
        return out[::-1]


@lru_cache(maxsize=64)
def matcher(wrapper: str) -> Matcher:
    return Matcher(json.loads(wrapper))


# ---- operators --------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """names: the symbols, one space between; at and texts: the blocks; page: a hash of the html."""
    for batch in batches:
        for part in slices(batch, "_html"):
            rows = [page_blocks(page) for page in part.column("_html").to_pylist()]
            made = [
                pa.array([" ".join(names) for names, _ in rows], pa.string()),
                pa.array([[i for i, _ in blocks] for _, blocks in rows], pa.list_(pa.int32())),
                pa.array([[t for _, t in blocks] for _, blocks in rows], pa.list_(pa.string())),
            ]
            rest = [c for c in part.schema.names if c != "_html"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, "names", "at", "texts"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of the html), names, at, texts; materialised."""
    kind = pages.schema["page_id"].dataType.simpleString()
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), html.alias("_html"))
    return materialize(rows.mapInArrow(_parse, f"page_id {kind}, url string, host string, page long, names string, at array<int>, texts array<string>"), "parsed", {"compression": "zstd"})


def _infer(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list | None = None
    for value in rows.sort_values(["n", "value"], ascending=[False, True])["value"]:
        part = json.loads(value) if value[:1] == "[" else fold(value.split())
        wrapper = part if wrapper is None else align(wrapper, part)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "value": [json.dumps(fold(wrapper or []))], "n": [int(rows["n"].sum())]})


def infer_wrappers(parsed: DataFrame) -> DataFrame:
    """host, wrapper (JSON), region (the element that holds main text, or empty), pages; from all parsed pages."""
    level = materialize(parsed.groupBy("host", F.col("names").alias("value")).agg(F.count(F.lit(1)).alias("n")), "streams")
    most = level.groupBy("host").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
    while True:
        groups = -(-most // GROUP)
        dealt = level.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(groups)))
        level = dealt.groupBy("host", "_b").applyInPandas(_infer, "host string, value string, n long")
        if groups == 1:
            break
        level, most = materialize(level, "streams"), groups
    held = lambda name: F.col("value").contains(f'"{name}"')
    region = F.when(held("article"), "article").when(held("main"), "main").otherwise("")
    return materialize(level.select("host", F.col("value").alias("wrapper"), region.alias("region"), F.col("n").alias("pages")), "wrappers")


def _match(hosts: dict[str, tuple[str, str]] | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, keep, whole = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("host", "names", "at")]
            facts = [hosts[h] for h in columns[0]] if hosts is not None else list(zip(batch.column("wrapper").to_pylist(), batch.column("region").to_pylist(), strict=True))
            for (wrapper, root), names, at in zip(facts, columns[1], columns[2], strict=True):
                symbols_ = names.split()
                got = matcher(wrapper).match(symbols_)
                places.append([got[i] if got else -1 for i in at])
                want = {"article": IN_ARTICLE, "main": IN_MAIN}.get(root) if root in symbols_ else None
                whole.append(want is not None)
                keep.append([want is None or symbols_[i] == want for i in at])
            rest = ["page_id", "url", "host", "page", "texts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(places, pa.list_(pa.int32())), pa.array(keep, pa.list_(pa.bool_())), pa.array(whole, pa.bool_())], [*rest, "places", "keep", "whole"])

    return run


def match_pages(parsed: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, host, page, slots: array of (place in the wrapper, text) of the slots that may hold main text; whole:
    they are those of the region."""
    kind = parsed.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, page long, texts array<string>, places array<int>, keep array<boolean>, whole boolean"
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + 64), F.lit(0)).alias("b")).first()["b"]
    if size <= BROADCAST_BYTES:
        matched = parsed.mapInArrow(_match({r["host"]: (r["wrapper"], r["region"]) for r in wrappers.collect()}), schema)
    else:
        matched = parsed.join(wrappers.select("host", "wrapper", "region"), "host").mapInArrow(_match(None), schema)
    slots = F.filter(F.arrays_zip(F.col("places").alias("place"), F.col("texts").alias("text"), F.col("keep").alias("keep")), lambda x: x["keep"])
    return matched.select("page_id", "url", "host", "page", "whole", F.transform(slots, lambda x: F.struct(x["place"].alias("place"), x["text"].alias("text"))).alias("slots"))


def template_texts(matched: DataFrame) -> DataFrame:
    """host, template: hashes of the (place, text) pairs that are the template's."""
    cells = matched.where("NOT whole").select("host", "page", F.explode("slots").alias("s")).where("s.place >= 0")
    cells = cells.select("host", F.col("s.place").alias("place"), F.xxhash64("s.place", "s.text").alias("key"), "page").distinct()
    held = materialize(cells.groupBy("host", "place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "slots")
    filled = cells.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("_filled"))
    common = held.join(filled, ["host", "place"]).where("2 * n > _filled")
    return common.groupBy("host").agg(F.collect_set("key").alias("template"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    parsed = parse_pages(pages)
    matched = match_pages(parsed, infer_wrappers(parsed) if wrappers is None else wrappers)
    template = materialize(template_texts(matched), "templates")
    size = template.agg(F.coalesce(F.sum(F.size("template") * 8 + 64), F.lit(0)).alias("b")).first()["b"]
    out = matched.join(F.broadcast(template) if size <= BROADCAST_BYTES else template, "host", "left")
    kept = F.filter("slots", lambda x: ~F.array_contains("template", F.xxhash64(x["place"], x["text"])) | (x["place"] < 0))
    slots = F.when(F.col("template").isNull() | F.col("whole"), F.col("slots")).otherwise(kept)
    text = F.array_join(F.transform(slots, lambda x: x["text"]), "\n")
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
