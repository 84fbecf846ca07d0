"""HTML extraction by nearest-URL page differencing.

A page is read into lines, one for each block with text. Pages are ordered by host and URL path; each is
paired with the neighbour of its host whose path it shares most of, their lines are aligned by longest
common subsequence, and common lines that are template text are deleted.

The markup goes first: a line inside menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts or styles is never text, and a line of an ``article`` or ``main`` element is text even if a neighbour
repeats it (copies of articles are common). Elements whose end tags may be left out end as in HTML. A class, id or
role counts as a name of such parts only if all its words say so ("comment-list", not "comments-policy"); an element
with such a word among others is judged by the share of its text that is links. Names never decide about the
outermost ``article`` and ``main``, nor cut an inline element out of a sentence.

Differencing decides about the other, plain lines, also about those beside an article. Pages of a host whose unmarked lines are equal are one
page, so a page is aligned with the nearest *different* page that has plain lines. A common line is template
text if a third different page of the host has it as a plain line; what only the two have is a copied
passage. Where a host has but two different pages no third can tell, and all that they share is deleted.

Only 64-bit hashes of lines are sorted and compared; of the html its unmarked lines are shuffled once, compressed.

Defined results: null or empty html gives an empty text; a null url is a host and path of its own kind
(both empty); repeated rows get equal rows; a page alone on its host keeps its unmarked lines; an
empty table gives an empty result; very long pages are read whole, in linear time, and aligned in linear space; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import map_rows, ship, stage
from weblake.operators.numbering import dense_ids

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("nav header footer aside form menu head title noscript dialog textarea".split())
# Elements without text of the page, which may stand in the middle of a sentence.
DROPPED = frozenset("template iframe object svg math canvas button select audio video map".split())
# Elements whose content isn't markup; what follows an unended one of the first two is not text.
RAW = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that may stand in the head; any other one, and text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
OPTIONAL = frozenset("p li dt dd option optgroup tr td th tbody thead tfoot".split())
CELLS = frozenset("table td th caption".split())
_INLINE_STOP = BLOCK - OPTIONAL | CELLS
_ITEM_STOP = BLOCK - {"address", "div", "p"}
# Elements that end open ones: (which, what such a search doesn't leave).
_ENDS = {
    "li": ({"li"}, _ITEM_STOP - {"li"}),
    **{name: ({"dt", "dd"}, _ITEM_STOP - {"dt", "dd"}) for name in ("dt", "dd")},
    "option": ({"option"}, BLOCK - {"option"}),
    "optgroup": ({"option", "optgroup"}, BLOCK - {"option", "optgroup"}),
    "tr": ({"tr"}, {"table"}),
    **{name: ({"td", "th"}, {"table", "tr"}) for name in ("td", "th")},
    **{name: ({"tbody", "thead", "tfoot"}, {"table"}) for name in ("tbody", "thead", "tfoot")},
    **{name: (HEADINGS, BLOCK - HEADINGS) for name in HEADINGS},
    "a": ({"a"}, _INLINE_STOP),
}
_PARAGRAPH_STOP = CELLS | {"button", "object", "template"}

# Names of what is never main text, of parts of the page layout, and of layout that an article has itself.
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
EXTRA = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices"
    " alert popup modal share sharing social related recommended newsletter subscribe subscription signup login".split()
)
LAYOUT = frozenset(
    "sidebar menu navbar nav navigation breadcrumb breadcrumbs footer pagination pager widget toolbar".split()
)
HEADING = frozenset({"header", "masthead"})
# Words beside those in a name that leave its meaning as it is.
NEUTRAL = frozenset(
    "area bar block body bottom box buttons container content entry form global group header holder inner item items js left"
    " link links list main media outer page panel post posts primary region right row secondary section site slot sticky sub"
    " text top unit user wrap wrapper".split()
)
# Names of an article's own parts: an element that has one, too, is judged by its links.
OWN = frozenset("article content entry post story".split())
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
# A quote opens a value after "=" only; one that nothing closes is an ordinary character.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_PART = re.compile(r"[^\W\d_]+")
# Elements deeper than this are siblings.
DEPTH = 256

# What a line is by the markup.
PLAIN, TEXT, MARKED = 0, 1, 2
# Pages that are aligned in one group, with two neighbours on either side.
GROUP_PAGES = 64
# Pairs of lines that one table of the alignment may hold.
LCS_CELLS = 1 << 22
# Different pages of a host that have a template line.
WITNESSES = 3


def _names(attributes: str, main: bool) -> str:
    """What class, id and role say of an element: "extra", "layout", "doubt" (a name that has more to it) or ""."""
    words = [w for a, b, c in _NAMED.findall(attributes) for w in (a or b or c).lower().split()] if attributes.strip() else []
    own = any(w in OWN for w in words)
    found = ""
    for word in words:
        parts = set(_PART.findall(word))
        extra, layout = parts & EXTRA, parts & (LAYOUT if main else LAYOUT | HEADING)
        if not extra and not layout:
            continue
        whole = parts <= EXTRA | LAYOUT | HEADING | NEUTRAL and not (own and not parts & COMMENTS)
        if whole and extra:
            return "extra"
        found = "layout" if whole or found == "layout" else "doubt"
    return found


def _is_comment(attributes: str) -> bool:
    words = [set(_PART.findall(w)) for a, b, c in _NAMED.findall(attributes) for w in (a or b or c).lower().split()]
    return any(parts & (COMMENTS | {"ad", "ads", "advert", "advertisement"}) and parts <= EXTRA | NEUTRAL for parts in words)


class _Element(NamedTuple):
    name: str
    why: str = ""  # why its lines are no text: "extra", "layout" or "dropped"
    main: bool = False
    soft: bool = False  # in an inline element with a name of what is no text
    link: bool = False
    judged: tuple[int, ...] | None = None  # before it: lines, characters, those of links, main elements


class _Page:
    """Lines of a page, from its tags and texts in order. Elements whose end tag may be left out end as in HTML."""

    def __init__(self):
        self.lines: list[tuple[int, str]] = []
        self.parts: list[tuple[str, _Element]] = []
        self.stack = [_Element("")]
        self.open: Counter = Counter()
        self.chars = self.linked = self.mains = 0
        self.links: list[tuple[int, int]] = []  # ranges of lines that are mostly links

    def text(self, text: str) -> None:
        if not text or self.stack[-1].why == "dropped":
            return
        if self.stack[-1].name == "head" and not text.isspace():
            self._cut(len(self.stack) - 1)
        self.parts.append((text, self.stack[-1]))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join(unescape("".join(x for x, _ in self.parts)).split())
        if text:
            element = self.parts[0][1]
            # An inline element is cut out only where it is the whole block.
            marked = element.why or all(e.soft for x, e in self.parts if not x.isspace())
            self.lines.append((MARKED if marked else TEXT if element.main else PLAIN, text))
            self.chars += sum(len(x) for x, _ in self.parts)
            self.linked += sum(len(x) for x, e in self.parts if e.link)
        self.parts.clear()

    def _cut(self, at: int) -> None:
        """Ends the elements from this place of the stack on."""
        if any(e.name in BLOCK and e.why != "dropped" for e in self.stack[at:]):
            self.flush()
        for e in reversed(self.stack[at:]):
            self.open[e.name] -= 1
            if e.judged and e.judged[3] == self.mains:
                chars, linked = self.chars - e.judged[1], self.linked - e.judged[2]
                if 2 * linked >= chars > 0:
                    self.links.append((e.judged[0], len(self.lines)))
        del self.stack[at:]

    def _end(self, names: Collection[str], stop: Collection[str]) -> bool:
        if any(self.open[name] for name in names):
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].name in names:
                    self._cut(at)
                    return True
                if self.stack[at].name in stop:
                    break
        return False

    def close(self, name: str) -> None:
        if name in HEADINGS:
            ended = self._end(HEADINGS, CELLS)
        elif name in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            ended = self._end({name}, {"table"})
        elif name in ("html", "body"):
            ended = False
        else:
            ended = self._end({name}, (CELLS - {name} if name != "table" else ()) if name in BLOCK else _INLINE_STOP)
        if not ended and name in BLOCK and self.stack[-1].why != "dropped":
            self.flush()

    def start(self, name: str, attributes: str) -> None:
        if self.open["head"] and name not in IN_HEAD and name not in DROPPED and self.stack[-1].why != "dropped":
            self._end({"head"}, ())
        if self.stack[-1].why != "dropped":
            if name in BLOCK and name not in OPTIONAL - {"p", "li", "dt", "dd"} or name == "p":
                self._end({"p"}, _PARAGRAPH_STOP)
            if name in _ENDS:
                self._end(*_ENDS[name])
            if name in BLOCK:
                self.flush()
        if name == "br":
            self.text(" ")
        if name in VOID or attributes.endswith("/"):
            return
        up = self.stack[-1]
        why, main, soft, judged = up.why, up.main, up.soft, None
        if why == "dropped" or name in DROPPED:
            why = "dropped"
        elif name in MAIN:
            if why == "layout" and _names(attributes, True) != "extra":
                why = ""  # a page's frame that is named after its sidebar or menu
            if main and _is_comment(attributes):
                why = "extra"
            elif not why:
                main = True
                self.mains += 1
        elif name in SKIPPED and not (name == "header" and main):
            # A form may be the frame of a whole page.
            why = "extra" if name not in ("form", "menu") else why or "layout"
        elif why != "extra" and name not in ("html", "body"):
            named = _names(attributes, main)
            if name not in BLOCK:
                soft = soft or named in ("extra", "layout")
            elif named == "doubt":
                judged = (len(self.lines), self.chars, self.linked, self.mains)
            else:
                why = named or why
        if len(self.stack) > DEPTH:
            self._cut(DEPTH)
        self.stack.append(_Element(name, why, main, soft, up.link or name == "a", judged))
        self.open[name] += 1

    def finish(self) -> list[tuple[int, str]]:
        self.flush()
        self._cut(1)
        change = Counter()
        for first, last in self.links:
            change[first] += 1
            change[last] -= 1
        out, inside = [], 0
        for at, (kind, text) in enumerate(self.lines):
            inside += change[at]
            out.append((MARKED if inside else kind, text))
        return out


def page_lines(html: str) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text, in page order; one pass over the html."""
    page = _Page()
    at, quoted = 0, True
    endless: set[str] = set()
    while start := _START.search(html, at):
        page.text(html[at : start.start()])
        at = start.start()
        if start[0] == "<!--":
            end = html.find("-->", at + 2)
            at = end + 3 if end >= 0 else len(html)
            continue
        if start[0] in ("<!", "<?"):
            end = html.find(">", at)
            if end < 0:
                break
            at = end + 1
            continue
        tag = _TAG.match(html, at) if quoted else None
        if not tag:
            # All that could end this tag is quoted: from here on the first ">" ends a tag.
            quoted, tag = False, _BARE.match(html, at)
        if not tag:
            break
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            page.close(name)
            continue
        if name in RAW and name not in endless:
            end = _RAW_END[name].search(html, at)
            if end or name in ("script", "style"):
                close = html.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else len(html)
                continue
            endless.add(name)
        page.start(name, tag[3])
    page.text(html[at:])
    return page.finish()


def main_text(lines: list[tuple[int, str]], shared: set[int]) -> str:
    """Lines of main elements, and plain lines but those whose number among these is in ``shared``, in page order."""
    kept, plain = [], 0
    for kind, text in lines:
        if kind == TEXT or kind == PLAIN and plain not in shared:
            kept.append(text)
        plain += kind == PLAIN
    return "\n".join(kept)


def _prefix_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and each prefix of ``b``."""
    length = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        length[1:] = np.maximum.accumulate(np.maximum(length[1:], np.where(b == x, length[:-1] + 1, 0)))
    return length


def common_lines(one: np.ndarray, two: np.ndarray) -> list[int]:
    """Places in ``one`` of a longest common subsequence of two lists of line hashes.

    Above ``LCS_CELLS`` pairs of lines, the first list is halved and the second one split where both halves give most
    (Hirschberg), so memory is linear in the lines.
    """
    lo = 0
    while lo < min(len(one), len(two)) and one[lo] == two[lo]:
        lo += 1
    hi = 0
    while hi < min(len(one), len(two)) - lo and one[len(one) - 1 - hi] == two[len(two) - 1 - hi]:
        hi += 1
    a, b = one[lo : len(one) - hi], two[lo : len(two) - hi]
    # Lines that the other page lacks can't be common.
    near = np.flatnonzero(np.isin(a, b))
    a, b = a[near], b[np.isin(b, a)]
    places: list[int] = []
    if len(a) > 1 and len(a) * len(b) > LCS_CELLS:
        half = len(a) // 2
        split = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        places = [*common_lines(a[:half], b[:split]), *(half + i for i in common_lines(a[half:], b[split:]))]
    elif len(a) and len(b):
        # length[i, j]: of the longest common subsequence of a[i:] and b[j:].
        length = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
        for i in range(len(a) - 1, -1, -1):
            row = np.maximum(length[i + 1, :-1], np.where(b == a[i], length[i + 1, 1:] + 1, 0))
            length[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j] and length[i, j] == length[i + 1, j + 1] + 1:
                places.append(i)
                i, j = i + 1, j + 1
            elif length[i + 1, j] >= length[i, j + 1]:
                i += 1
            else:
                j += 1
    middle = (lo + int(near[i]) for i in places)
    return [*range(lo), *middle, *range(len(one) - hi, len(one))]


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and host and path of the url."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path")
    )


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _read(page_id: int | None, url: str | None, host: str, html: str) -> tuple[int, list[tuple[int, str]], bytes]:
    """(key, unmarked lines, hashes of the plain ones).

    Pages of a host with equal unmarked lines have one key. Without plain lines there is nothing to judge,
    and the key is the row's own, so that copies don't meet.
    """
    lines = [(kind, text) for kind, text in page_lines(html) if kind != MARKED]
    hashes = [(kind, _hash(text.encode("utf-8", "replace"))) for kind, text in lines]
    plain = np.array([h for kind, h in hashes if kind == PLAIN], dtype="<i8").tobytes()
    own = hashes if plain else (page_id, url, hashes)
    return _hash(repr((host, own)).encode("utf-8", "replace")), lines, plain


def _outlines(pages: DataFrame) -> DataFrame:
    """(key, place, host, path, lines) of pages with plain lines; ``lines``: the hashes of those."""

    def make():
        def step(cols: dict) -> dict:
            read = [_read(*x) for x in zip(cols["page_id"], cols["url"], cols["host"], cols["html"])]
            kept = [i for i, (_, _, plain) in enumerate(read) if plain]
            out = {name: [cols[name][i] for i in kept] for name in ("place", "host", "path")}
            return {"key": [read[i][0] for i in kept], **out, "lines": [read[i][2] for i in kept]}

        return step

    page_id = F.lpad(F.coalesce("page_id", F.lit(0)).cast("string"), 20, "0")
    placed = _placed(pages).withColumn("place", F.concat_ws("\u0001", "host", "path", page_id))
    return map_rows(placed, make, "key long, place string, host string, path string, lines binary")


def _alike_paths(one: str, two: str) -> int:
    n = 0
    for a, b in zip(one, two):
        if a != b:
            break
        n += 1
    return n


def _shared_in_group(group: pd.DataFrame) -> pd.DataFrame:
    """Aligns each page of the group (not its outer neighbours) with the nearest one."""
    group = group.sort_values("id").reset_index(drop=True)
    host, path = group["host"].tolist(), group["path"].tolist()
    lines = [np.frombuffer(x, dtype="<i8") for x in group["lines"]]
    out: dict = {"key": [], "host": [], "at": [], "line": [], "alone": []}
    for i in np.flatnonzero(group["inner"]):
        beside = [j for j in range(i - 2, i + 3) if 0 <= j < len(group) and host[j] == host[i]]
        near = [j for j in beside if abs(j - i) == 1]
        if not near:
            continue
        j = max(near, key=lambda j: (_alike_paths(path[i], path[j]), -j))
        for k in common_lines(lines[i], lines[j]):
            for name, value in zip(out, (group["key"][i], host[i], k, lines[i][k], len(beside) == 2)):
                out[name].append(value)
    kinds = {"key": "int64", "host": "object", "at": "int32", "line": "int64", "alone": "bool"}
    return pd.DataFrame({name: pd.Series(out[name], dtype=kind) for name, kind in kinds.items()})


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, shared): which of the plain lines of the pages with this key are template text."""
    ship(pages.sparkSession)
    first = _outlines(pages).groupBy("key").agg(F.min(F.struct("place", "host", "path", "lines")).alias("r")).select("key", "r.*")
    different = first.withColumn("place", F.concat_ws("\u0001", "place", F.col("key").cast("string"))).withColumn("scope", F.lit("pages"))
    ordered = stage(dense_ids(different, "scope", "place", {}), "page-order").drop("scope", "place")
    # A page near a group's edge is also an outer neighbour of the next group.
    groups = F.array_distinct(F.array(*(F.floor((F.col("id") + by) / GROUP_PAGES) for by in range(-2, 3))))
    grouped = ordered.select("*", F.explode(groups).alias("group")).withColumn("inner", F.floor(F.col("id") / GROUP_PAGES) == F.col("group"))
    common = grouped.groupBy("group").applyInPandas(_shared_in_group, "key long, host string, at int, line long, alone boolean")
    common = stage(common, "common-lines")

    def make():
        def step(cols: dict) -> dict:
            own = [np.unique(np.frombuffer(x, dtype="<i8")) for x in cols["lines"]]
            return {"host": np.repeat(np.array(cols["host"], dtype=object), [len(x) for x in own]).tolist(), "line": np.concatenate(own).tolist()}

        return step

    held = map_rows(ordered.select("host", "lines"), make, "host string, line long").groupBy("host", "line").count()
    template = held.where(F.col("count") >= WITNESSES).drop("count")
    seen = common.where("not alone").join(template, ["host", "line"]).select("key", "at")
    return seen.unionByName(common.where("alone").select("key", "at")).groupBy("key").agg(F.collect_list("at").alias("shared"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def pack():
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def step(cols: dict) -> dict:
            out: dict = {"page_id": cols["page_id"], "url": cols["url"], "key": [], "packed": []}
            for x in zip(cols["page_id"], cols["url"], cols["host"], cols["html"]):
                key, lines, _ = _read(*x)
                out["key"].append(key)
                # No line has a line break in it.
                out["packed"].append(squeeze("\n".join(f"{kind}{text}" for kind, text in lines).encode("utf-8", "replace")))
            return out

        return step

    def extract():
        expand = zstandard.ZstdDecompressor().decompress

        def step(cols: dict) -> dict:
            texts = []
            for data, shared in zip(cols["packed"], cols["shared"]):
                lines = [(int(x[0]), x[1:]) for x in expand(data).decode().split("\n") if x]
                texts.append(main_text(lines, set(shared or ())))
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    packed = map_rows(_placed(pages), pack, "page_id long, url string, key long, packed binary")
    joined = packed.join(shared_lines(pages), "key", "left").select("page_id", "url", "packed", "shared")
    return map_rows(joined, extract, "page_id long, url string, text string, n_chars long")
