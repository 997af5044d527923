"""Main text of pages by template deduction over equivalence classes.

Pages of a host come from templates. A page is read as a tree of elements and the texts in
them. Its tokens are the paths of the elements (tags and classes) and the texts with the path
they stand in. A token's occurrence vector says how often it occurs on each page of the host;
pages with the same content count once. Tokens with one vector form an equivalence class. A
class whose tokens occur once per page, on enough pages, is valid: its elements, being paths,
nest into a template, and its texts are the template's own wording. What the template leaves
open are slots. A slot's element that holds most of the running text of its pages is a main
one, and what is in it, less the wording and the furniture, is extracted.

Vectors are never gathered: a vector is represented by the sum of a hash per (page, count),
so the class of a token is one aggregate, combined before the shuffle. Pages meet what was
deduced token by token; no table holds a host in a row.

Reading takes time and memory in proportion to the page, however deep or broken it is:
elements are numbers with a link to their parent, and a path is hashed from its parent's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import materialize

from .common import annotate, blocks, give_back

#: Share of a page's running text that a main slot holds, on average over its pages.
MAIN_SHARE = 0.6
#: Pages of different content that a valid class with wording needs.
MIN_PAGES = 5
#: A class whose texts are more than this share of its pages' running text is copies of a page, not a template.
MAX_WORDING = 0.3
#: What was deduced is sent to the tasks only while it has fewer tokens than this; else joined.
BROADCAST_TOKENS = 50_000

# Elements by role. Raw ones hold no markup, hidden ones no text of the page.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_HIDDEN = {"select", "noscript", "object", "svg", "math", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
           "sup", "time", "tt", "u", "var", "wbr"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "head"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"article", "main", "section", "div", "td", "body"}
# Names of furniture, in the languages of the pages, and words that only place or shape it.
_ROLES = set("""
nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share
sharing social ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner notice cookie cookies
consent gdpr popup modal newsletter subscribe signup login search comment comments commentlist replies reply disqus respond
complementary contentinfo
werbung anzeige anzeigen kommentar kommentare hinweis suche anmeldung fusszeile kopfzeile seitenleiste
publicite publicité annonce annonces commentaire commentaires recherche
publicidad anuncio anuncios comentario comentarios busqueda búsqueda aviso cabecera
""".split())
_PLACES = set("""
left right top bottom main primary secondary global site page box bar list wrapper wrap container section area block inner
outer unit slot item items links link text form content posts articles level 0
""".split())
_BLOCK_STARTS = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre",
                 "blockquote", "header", "footer", "nav", "aside", "main", "figure", "address"}
_CLOSED_BY = {"p": _BLOCK_STARTS | {"form", "hr", "fieldset"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
              "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"} | _BLOCK_STARTS,
              "select": _BLOCK_STARTS, "svg": _BLOCK_STARTS, "math": _BLOCK_STARTS}
_CLOSES = {by: {t for t, all_ in _CLOSED_BY.items() if by in all_} for by in set().union(*_CLOSED_BY.values())}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)([^<>]*+)>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in _RAW}
_NAMING = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")
_PART = re.compile(r"[-_]+")
# what tells that an element is furniture: its tag, or only its names
_SURE, _HINT = 2, 1
_WORDING = 1 << 40


def _is_role(value: str, within: bool) -> bool:
    """Whether one of the names is made of furniture's words and words that place it, and of nothing else.

    ``within`` an article or main element, a header is not furniture.
    """
    for name in value.split():
        parts = [p for p in _PART.split(name) if p]
        named = any(p in _ROLES and not (within and p == "header") for p in parts)
        if named and all(p in _ROLES or p in _PLACES for p in parts):
            return True
    return False


class Page:
    """Elements of a page in order, as numbers: tag, parent, path, role; and its texts with their element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.role, self.last = [""], [-1], [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self._open, self._counts = [0], {}
        self._within = [False]
        self._piece: list[str] = []
        self._read(source)
        self._flush()
        while len(self._open) > 1:
            self._pop(False)
        self.last[0] = len(self.tag)
        self._settle()

    def _flush(self) -> None:
        if self._piece:
            text = " ".join(html.unescape("".join(self._piece)).split())
            self._piece.clear()
            if text:
                self.texts.append((self._open[-1], text))

    def _pop(self, closed: bool) -> None:
        e = self._open.pop()
        self._counts[self.tag[e]] -= 1
        self.last[e] = len(self.tag)
        if not closed and self.tag[e] in _HIDDEN:
            self.role[e] = 0  # never closed, so nobody knows what it was to hide

    def _push(self, tag: str, attributes: str) -> None:
        above = self._open[-1]
        within = self._within[above]
        own, role = [tag], _SURE if tag in _FURNITURE or tag in _HIDDEN or (tag == "header" and not within) else 0
        if "=" in attributes and tag not in ("body", "html"):
            for m in _NAMING.finditer(attributes):
                value = _NUMBER.sub("0", " ".join((m[2] or m[3] or m[4] or "").lower().split()))
                if m[1].lower() == "class":
                    own.append("." + value)  # ids name a page as often as a place
                role = role or (_HINT if _is_role(value, within) else 0)
        body = tag in ("article", "main")
        self.tag.append(tag)
        self.parent.append(above)
        self.path.append(xxhash.xxh64_intdigest("".join(own).encode("utf-8", "surrogatepass"), self.path[above]))
        self.role.append(0 if body else role)
        self.last.append(0)
        self._within.append(within or body)
        self._open.append(len(self.tag) - 1)
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            return
        self._flush()
        closing = _CLOSES.get(tag, ())
        while self.tag[self._open[-1]] in closing:
            self._pop(True)
        foreign = tag in ("svg", "math") and attributes.endswith("/")
        if tag not in _VOID and not foreign:
            self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in _INLINE:
            return
        self._flush()
        if self._counts.get(tag):
            while self.tag[self._open[-1]] != tag:
                self._pop(False)
            self._pop(True)

    def _read(self, page: str) -> None:
        done, at, quoted, n = 0, 0, True, len(page)
        while (at := page.find("<", at)) >= 0:
            follows = page[at + 1:at + 2]
            m = None
            if follows in ("!", "?"):
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(mark, at + 2)
                end = n if end < 0 else end + len(mark)
            else:
                if quoted:
                    m = _TAG.match(page, at)
                    # no tag ends after this place if quotes are minded
                    quoted = m is not None or not _BARE_START.match(page, at)
                if m is None:
                    m = _BARE_TAG.match(page, at)
                if m is None:
                    at += 1
                    continue
                end = m.end()
            if at > done:
                self._piece.append(page[done:at])
            if m:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in _RAW:
                    self._flush()
                    close = _RAW_END[tag].search(page, end)
                    end = close.end() if close else n
                else:
                    self._start(tag, m[3])
            done = at = end
        if done < n:
            self._piece.append(page[done:])

    def _settle(self) -> None:
        """Decide which elements are furniture.

        Names are a hint only. An element with most of the page's text below headings is not furniture if it
        contains an article or main element, or if hardly any text of such elements is elsewhere; nor is any
        named one where nothing else has text.
        """
        n, parent, role = len(self.tag), self.parent, self.role
        sure = [False] * n
        for e in range(1, n):
            sure[e] = role[e] == _SURE or sure[parent[e]]
        mass, total = [0] * n, 0
        for e, text in self.texts:
            if not sure[e] and self.tag[e] not in _HEADINGS:
                mass[e] += len(text)
                total += len(text)
        bodies = [e for e in range(1, n) if self.tag[e] in ("article", "main")]
        holds = [False] * n
        for e in bodies:
            holds[parent[e]] = True
        for e in range(n - 1, 0, -1):
            mass[parent[e]] += mass[e]
            holds[parent[e]] |= holds[e]
        hinted = [e for e in range(1, n) if role[e] == _HINT and 2 * mass[e] > total]
        if hinted:
            # the largest article or main element around each element, after it, and closed before it
            around, after, before = [0] * n, [0] * (n + 1), [0] * (n + 1)
            for e in range(1, n):
                p = parent[e]
                around[e] = around[p] or (p if self.tag[p] in ("article", "main") else 0)
            for e in bodies:
                before[self.last[e]] = max(before[self.last[e]], mass[e])
                after[e] = mass[e]
            for e in range(1, n + 1):
                before[e] = max(before[e], before[e - 1])
            for e in range(n - 1, -1, -1):
                after[e] = max(after[e], after[e + 1])
            for e in hinted:
                inside = mass[around[e]] - mass[e] if around[e] else 0
                if holds[e] or 50 * max(inside, after[self.last[e]], before[e]) < total:
                    role[e] = 0
        for hints in (True, False):
            self.furniture = [False] * n
            for e in range(1, n):
                self.furniture[e] = self.furniture[parent[e]] or role[e] == _SURE or (hints and role[e] == _HINT)
            if any(not self.furniture[e] for e, _ in self.texts):
                break

    def text_token(self, element: int, text: str) -> int:
        """Token of a text: the text and the path that it stands in."""
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.path[element] ^ _WORDING)

    def running(self) -> list[tuple[int, str]]:
        return [(e, t) for e, t in self.texts if not self.furniture[e]]


_BARE_START = re.compile(r"</?[A-Za-z]")


def profile(source: str) -> tuple[list[int], list[int], list[float], list[int]]:
    """Tokens of a page that are not furniture, how often each occurs, its share of the running text, and its kind.

    Kinds: 0 an element, 1 one that may hold a main slot, 2 a text.
    """
    page = Page(source)
    found: dict[int, list] = {}
    running = page.running()
    mass = [0] * len(page.tag)
    for e, text in running:
        mass[e] += len(text)
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    total = mass[0]
    for e in range(1, len(page.tag)):
        if not page.furniture[e]:
            row = found.setdefault(page.path[e], [0, 0, 1 if page.tag[e] in _CONTAINERS else 0])
            row[0] += 1
            row[1] += mass[e]
    for e, text in running:
        row = found.setdefault(page.text_token(e, text), [0, 0, 2])
        row[0] += 1
        row[1] += len(text)
    share = [min(1.0, r[1] / total) if total else 0.0 for r in found.values()]
    return np.fromiter(found, np.uint64, len(found)).view(np.int64).tolist(), [r[0] for r in found.values()], share, [r[2] for r in found.values()]


def extract(source: str, deduced: set[int]) -> str:
    """Text of the page's main slot without furniture and the template's wording (``deduced``: paths and texts).

    Of several slots an article is preferred, then a main element, then one around the page's first
    heading, then the deepest. A page without a main slot gives all that is not furniture.
    """
    page = Page(source)
    running = page.running()
    kept = [(e, t) for e, t in running if page.text_token(e, t) not in deduced] or running
    slots = [e for e in range(1, len(page.tag)) if page.path[e] in deduced and not page.furniture[e]]
    if slots:
        heading = next((e for e in range(1, len(page.tag)) if page.tag[e] == "h1" and not page.furniture[e]), 0)
        depth = [0] * len(page.tag)
        for e in range(1, len(page.tag)):
            depth[e] = depth[page.parent[e]] + 1

        def worth(e: int) -> tuple[int, bool, int, int]:
            return ({"article": 2, "main": 1}.get(page.tag[e], 0), e <= heading < page.last[e], depth[e], -e)

        # the slots of the best path, and what is in them
        best = page.path[max(slots, key=worth)]
        inside = [False] * len(page.tag)
        for e in range(1, len(page.tag)):
            inside[e] = inside[page.parent[e]] or page.path[e] == best
        held = [(e, t) for e, t in kept if inside[e]]
        kept = held or kept
    return " ".join(t for _, t in kept)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; pages without one are a host of their own, the empty one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def tokens_of(pages: DataFrame, host_col: str = "host", page_col: str = "page", html_col: str = "html") -> DataFrame:
    """host, page, token, times, share, kind of every token of every page."""
    def setup():
        def work(texts: list[str]):
            found = [profile(t) for t in texts]
            return [[f[k] for f in found] for k in range(4)]
        return work

    named = pages.select(F.col(host_col).alias("host"), F.col(page_col).alias("page"), F.col(html_col).alias("body"))
    seen = annotate(named, "body", "tokens array<long>, times array<int>, shares array<float>, kinds array<tinyint>", setup, keep_text=False)
    return seen.select("host", "page", F.explode(F.arrays_zip("tokens", "times", "shares", "kinds")).alias("t")).select(
        "host", "page", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"),
        F.col("t.shares").alias("share"), F.col("t.kinds").alias("kind"))


def templates(rows: DataFrame) -> DataFrame:
    """Tokens of each host with their equivalence class: host, token, kind, pages, class, once, share.

    ``class`` is the hash of the occurrence vector (rows repeated whole weigh the same in all
    vectors), ``once`` says that the token occurs once on each page that has it, ``share`` is its mean
    share of the running text. ``pages`` counts pages of different content in 64 buckets, so it is
    never too large and good enough to tell a few from many.
    """
    # a sum, by halves, so that it does not overflow
    one = F.xxhash64("page", "times")
    vector = F.xxhash64(F.sum(one.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(one, 32)))
    return rows.groupBy("host", "token").agg(
        F.max("kind").alias("kind"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(page, 64) as int))"))).alias("pages"),
        vector.alias("class"),
        (F.max("times") == 1).alias("once"), F.avg("share").alias("share"))


def deduce(tokens: DataFrame, share: float = MAIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, token): elements that open a main slot, and the wording of templates.

    Tokens with one occurrence vector are a class, valid if they occur once per page. A container of
    a valid class with ``share`` of the running text opens a main slot. A text is wording if its class
    also has an element, so that it comes and goes with a part of the template, on at
    least ``min_pages`` pages, and the class's texts are not most of what these pages say.
    """
    classes = tokens.groupBy("host", "class").agg(
        F.bool_and("once").alias("valid"), F.max("pages").alias("pages"), F.bool_or(F.col("kind") < 2).alias("built"),
        F.sum(F.when(F.col("kind") == 2, F.col("share")).otherwise(0.0)).alias("said"),
        F.bool_or((F.col("kind") == 2) | ((F.col("kind") == 1) & (F.col("share") >= share))).alias("useful"))
    valid = classes.where(F.col("valid") & F.col("useful")).select(
        "host", "class", (F.col("built") & (F.col("pages") >= min_pages) & (F.col("said") <= MAX_WORDING)).alias("worded"))
    some = tokens.where((F.col("kind") == 2) & (F.col("pages") >= min_pages) | (F.col("kind") == 1) & (F.col("share") >= share))
    met = some.join(valid, ["host", "class"])
    return met.where((F.col("kind") == 1) | F.col("worded")).select("host", "token")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row of ``df``.

    Text is decoded, white space inside a block is one space, blocks are joined in page order
    by one space. A null or empty page, and one with nothing but furniture, has empty text. A
    null URL belongs to the empty host. Rows with the same id are pages of their own, and rows
    repeated whole have the same text; other columns are not handed on; no input gives no rows.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("body"),
                       host_of(F.col(url_col)).alias("host"))
    # pages with the same content on a host are one page of its vectors
    keyed = source.withColumn("page", F.xxhash64("host", F.coalesce("body", F.lit("")))).withColumn("host", F.xxhash64("host"))
    rows = tokens_of(keyed, html_col="body")
    deduced, n = materialize(deduce(templates(rows)), "deduced")
    hits = (rows.join(F.broadcast(deduced) if n <= BROADCAST_TOKENS else deduced, ["host", "token"], "left_semi")
            .groupBy("page").agg(F.collect_set("token").alias("deduced")))
    joined = keyed.join(hits, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in blocks(batch.column("body")):
                known = batch.column("deduced").slice(start, end - start).to_pylist()
                part = [extract(t, {k & 0xFFFFFFFFFFFFFFFF for k in d or ()}) for t, d in zip(texts, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, end - start) for c in ("id", "url")] + [pa.array(part, pa.string())],
                    ["id", "url", "text"])
        give_back()

    kinds = dict(source.dtypes)
    done = joined.select("id", "url", "body", "deduced").mapInArrow(run, f"id {kinds['id']}, url string, text string")
    return done.select(F.col("id").alias(id_col), "url", "text")
