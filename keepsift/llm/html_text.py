"""Main text of web pages: nearest-URL page differencing, with the markup as further evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keepsift.llm.common import integral, numbered, same
from keepsift.session import store

#: Pages of a host, neighbours by path, that are compared in one window.
BLOCK = 64
#: Two pages that share more of their lines than this are copies of one another, which tells nothing about templates.
COPIES = 0.5

# Elements of HTML.
_RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "title", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_NESTING = {
    "html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "blockquote",
    "figure", "details", "dialog", "fieldset", "address", "head", "button", "select", "svg", "math", "template", "noscript", "object", "menu",
    "video", "audio", "canvas", "map", "search",
}
#: Elements that hold no part of an article.
_OUTSIDE = {
    "nav", "footer", "aside", "form", "head", "button", "select", "svg", "math", "template", "noscript", "dialog", "menu", "object", "video",
    "audio", "canvas", "map", "search",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words in a class or id that name what is not the article.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "comment", "comments", "disqus",
    "replies", "login", "signup", "share", "sharing", "social", "related", "widget",
}
#: Lines outside of any marked body; in <main>; in <article>.
OPEN, MAIN, ARTICLE = 0, 1, 2

_TAG = re.compile(
    r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))"""
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[a-z0-9]+")


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(not the article, a header by its name, the article) as class, id and role have it."""
    names, roles, body = set(), set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            roles.update(value.split())
        elif name.lower() == "itemprop":
            body |= value == "articlebody"
        else:
            names.update(_WORD.findall(value))
    return bool(names & _NAMES or roles & _ROLES), "header" in names, body or "main" in roles


def page_lines(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, body, outside, part) of each line of a page: a block's text with single spaces.

    `body`: OPEN, MAIN or ARTICLE; `outside`: it lies in an element that by its name holds no part of an article; `part`:
    the number of the element that marks the body, 0 in none.
    Scripts, styles and comments are no lines. Any input is read: what is open at the end ends there.
    """
    lines: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements with the state inside them
    body, outside, part, parts, held = OPEN, False, 0, 0, []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((text, body, outside, part))

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if not m:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = html.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not slash and name in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            flush()
            continue
        if name not in _INLINE:
            flush()
        if slash:
            # A closing tag ends the nearest open element of its name, and what is open inside it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    body, outside, part = stack[-1][1:] if stack else (OPEN, False, 0)
                    break
            continue
        if name in _VOID:
            continue
        if stack and stack[-1][0] in ("p", "li") and name not in _INLINE and (stack[-1][0] == "p" or name == "li"):
            stack.pop()  # a paragraph ends where another block begins
            body, outside, part = stack[-1][1:] if stack else (OPEN, False, 0)
        drop, header, marked = _marks(attributes) if "=" in attributes else (False, False, False)
        level = ARTICLE if name == "article" or marked else MAIN if name == "main" else OPEN
        if name in ("html", "body") or (level and "comment" not in attributes.lower()):
            drop = False
        drop |= name in _OUTSIDE or (body == OPEN and (name == "header" or (header and not level)))
        if name in _NESTING or drop or marked:
            if drop != outside or level > body:
                flush()
            if name not in _VOID:
                if level > body:
                    part = parts = parts + 1
                body, outside = max(body, level), outside or drop
                stack.append((name, body, outside, part))
    flush()
    return lines


def beyond(lines: Sequence[tuple[str, int, bool, int]]) -> list[str]:
    """The lines that are aligned with those of neighbours: all of the page, whatever its markup."""
    return [line[0] for line in lines]


def own_bodies(lines: Sequence[tuple[str, int, bool, int]], shared: set[int]) -> tuple[int, set[int]]:
    """(body, parts) that hold the page's own text, as differencing has it: the innermost kind of body with a line that is
    not shared, and of its elements those with one. What is shared as a whole comes from the template, unless it is longer
    than the own text found without it. Where no line is the page's own, the innermost kind."""
    inside = [(body, part, len(text), place not in shared) for place, (text, body, outside, part) in enumerate(lines) if not outside]
    for level in (ARTICLE, MAIN):
        here = [x for x in inside if x[0] == level]
        own = {part for _, part, _, new in here if new}
        if own:
            kept, gone = (sum(n for _, part, n, _ in here if (part in own) == held) for held in (True, False))
            return level, own if kept > gone else {x[1] for x in here}
        if here and sum(x[2] for x in here) >= sum(x[2] for x in inside if x[3] and x[0] < level):
            return level, {x[1] for x in here}
    return OPEN, {0}


def main_text(lines: Sequence[tuple[str, int, bool, int]], shared: Sequence[int] = ()) -> str:
    """The text of the bodies that hold the page's own lines; in no marked body, the lines that are not `shared` (places
    within `beyond`). An article may repeat a passage, so shared lines in such a body stay. Lines in elements that hold no
    part of an article go."""
    gone = set(shared)
    level, parts = own_bodies(lines, gone)
    kept = [t for place, (t, body, outside, part) in enumerate(lines) if not outside and body == level and part in parts and (level or place not in gone)]
    return " ".join(kept)


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and b[:j] for every j, by bit vectors of len(b) bits."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        met = free & masks.get(x, 0)
        if met:
            free = ((free + met) | (free - met)) & full
    bits = np.unpackbits(np.frombuffer(free.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in `a` of a longest common subsequence of a and b, in linear memory (Hirschberg)."""
    common = set(a) & set(b)
    left, right = [i for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    values = [a[i] for i in left]
    out: list[int] = []
    todo = [(0, len(values), 0, len(right))]
    while todo:
        i, k, j, n = todo.pop()
        while i < k and j < n and values[i] == right[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < n and values[k - 1] == right[n - 1]:
            out.append(k - 1)
            k, n = k - 1, n - 1
        if i == k or j == n:
            continue
        if k - i == 1:
            if values[i] in right[j:n]:
                out.append(i)
            continue
        half = (i + k) // 2
        before = _lengths(values[i:half], right[j:n])
        after = _lengths(values[half:k][::-1], right[j:n][::-1])[::-1]
        cut = j + int(np.argmax(before + after))
        todo += [(i, half, j, cut), (half, k, cut, n)]
    return sorted(left[i] for i in out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, mark, host, path, html) -> the same without html, with the digests of the lines."""
    names = ["page_id", "mark", "host", "path", "lines"]
    for b in batches:
        held = []
        for html in b.column(4):
            found = beyond(page_lines(html.as_py() or ""))
            held.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t in found])
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(held, pa.list_(pa.int64()))], names)


def _difference(copies: float):
    """(host, sig, lines, before, after) -> (host, sig, shared): places of lines shared with either neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lines, *neighbours in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
                shared: set[int] = set()
                for other in neighbours:
                    hit = aligned(lines, other or [])
                    if len(hit) <= copies * max(len(lines), len(other or ())):
                        shared.update(hit)
                found.append(sorted(shared))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.list_(pa.int32()))], ["host", "sig", "shared"])

    return run, "host string, sig long, shared array<int>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, shared in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            texts.append(main_text(page_lines(html.as_py() or ""), shared or ()).encode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.binary()).cast(pa.string())], ["page_id", "url", "text"])


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; empty for NULL."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    host = F.lower(F.regexp_extract(u, pattern, 1))
    return host, F.when(host == "", F.regexp_extract(u, r"^([^?#]*)", 1)).otherwise(F.regexp_extract(u, pattern, 2))


def shared_lines(pages: DataFrame, block: int = BLOCK, copies: float = COPIES) -> DataFrame:
    """(page_id, mark, shared) of the pages (page_id, mark, host, path, html) that share lines with a page of near URL."""
    schema = "page_id long, mark long, host string, path string, lines array<long>"
    read = store(pages.mapInArrow(_read, schema), "lines").withColumn("sig", F.xxhash64("lines"))
    # Pages with the same lines are one; it stands at the first of their paths.
    different = read.where(F.size("lines") > 0).groupBy("host", "sig").agg(F.min("path").alias("path"), F.min("lines").alias("lines"))
    placed = numbered(different, "pos", ["path", "sig"], ["host"]).withColumn("block", F.expr(f"pos div {block}"))
    # The last page of a block stands before the next one as well, the first one behind the block before.
    near = F.array(
        F.struct(F.col("block").alias("in")),
        F.when(F.col("pos") % block == block - 1, F.struct((F.col("block") + 1).alias("in"))),
        F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.struct((F.col("block") - 1).alias("in"))),
    )
    dealt = placed.withColumn("in", F.explode(F.filter(near, lambda x: x.isNotNull()))).withColumn("in", F.col("in.in"))
    by_path = W.partitionBy("host", "in").orderBy("pos")
    met = dealt.select(
        "host", "sig", "lines", F.lag("lines").over(by_path).alias("before"), F.lead("lines").over(by_path).alias("after"), F.col("in"), F.col("block")
    )
    found = met.where(F.col("in") == F.col("block")).select("host", "sig", "lines", "before", "after").mapInArrow(*_difference(copies))
    found = found.where(F.size("shared") > 0)
    members = read.select("page_id", "mark", "host", "sig").distinct()
    return members.join(found, ["host", "sig"]).select("page_id", "mark", "shared")


def extract_text(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    block: int = BLOCK,
    copies: float = COPIES,
) -> DataFrame:
    """One row per page: page_id, url, text (the main text, its lines joined by one space), n_chars.

    Nearest-URL page differencing: the pages of a host are ordered by their URL's path, so neighbours have the nearest
    URLs. Each page is aligned with the one before and the one behind by a longest common subsequence of their text
    lines, and the lines they share go, as they come from the template. Only digests of lines travel for this, in
    blocks of `block` neighbours, so a large host is many tasks. Two pages that share more than `copies` of their lines
    are copies, and nothing goes.

    On every page, the lines that are left are the page's own, and the text is what holds them: the innermost marked
    bodies (<article>, itemprop articleBody, role main; else <main>) with own lines, as a whole, as articles may repeat
    passages; where none has any, the own lines outside of marked bodies. A marked body without own lines is part of the
    template and goes, unless it is longer than what else the page has of its own: then differencing tells nothing.

    Differencing alone does not give right results where a template's texts change from page to page, so lines in
    elements that hold no part of an article by their name, role, class or id (menus, headers, footers, asides, adverts,
    notices, forms, reader comments) go although no neighbour has them.

    Defined cases: a NULL or empty page has the empty text, a NULL URL the host ''. Rows that repeat an id or are equal
    keep their own rows; pages with the same lines are aligned as one. A page without neighbours shares nothing. Broken
    markup is read as far as it goes. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    host, path = url_parts(df[url_col])
    html = df[html_col].cast("string")
    pages = df.select(
        integral(df, id_col).alias("page_id"), df[url_col].alias("url"), F.xxhash64(df[url_col], html).alias("mark"), host.alias("host"), path.alias("path"), html.alias("html")
    )
    shared = store(shared_lines(pages.select("page_id", "mark", "host", "path", "html"), block, copies), "shared")
    met = pages.join(shared, same(pages, shared, "page_id", "mark"), "left").select(pages["page_id"], "url", "html", "shared")
    schema = f"page_id long, url {df.schema[url_col].dataType.simpleString()}, text string"
    return met.mapInArrow(_extract, schema).withColumn("n_chars", F.char_length("text").cast("long"))
