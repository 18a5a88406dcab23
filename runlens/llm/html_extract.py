"""op6: main text of web pages by consensus host paths.

1. Every page is parsed into elements and text blocks. A block of a paragraph's length scores for the container it lies in, links count
   against it. The page's best containers are named by their generalised path (tags and classes from the body down, digits folded).
2. Spark sums the votes per host and path: every path that at least ``PAGES`` pages of the host vote for first is in the host's
   consensus, and the paths a page has text under are joined to it by host and path. The one most pages vote for is the page's.
3. Every page is parsed again: its text is that of the containers on its path. A page without any of the paths uses its own best
   container, and without one all blocks.

Menus, headers and footers of the page, side bars, notices, adverts, forms, scripts, styles, comments and hidden parts are left out by tag, role and
class or id words, inside the winning container too (a header or footer element inside an article belongs to it unless its
words say otherwise). Malformed markup is read as browsers do in the common cases: paragraphs, list items and cells close each
other, stray end tags are ignored, open elements end with the page.

Defined results: a null or empty page gives an empty text; a null url is a host of its own; repeated rows are extracted each; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value, few, slices, stored

PAGES = 1               # pages of a host that vote for a path first, from which it is in the consensus
PROSE = 25              # characters from which a block counts as prose
PART_BYTES = 8 << 20

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BARE = re.compile(r"""(?:^|\s)hidden(?=\s|/|$)""", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")

# Element names of HTML by how they take part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
                  "table tbody td tfoot th thead title tr ul".split())
DROP = frozenset("script style noscript template nav aside form button select option textarea iframe object svg math canvas audio video "
                 "dialog menu head title input label fieldset noframes".split())
PAGE_ONLY = frozenset(["header", "footer"])
ARTICLE = frozenset(["article", "main"])
CONTAINER = frozenset("article main section div td body blockquote center".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",)}
SCOPE = frozenset("table ul ol dl body article section div main td th button form aside nav header footer".split())
ENDS_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup"}
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup "
    "login comment comments disqus replies share sharing social related recommended widget toolbar pagination pager copyright".split())
KEEP_WORDS = frozenset("article content main story post entry body text".split())


class Page:
    """Elements (in order of their start) and text blocks of one page."""

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.dropped = ["#"], [""], [-1], [False]
        self.in_article = [False]
        self.blocks: list[tuple[int, str, int]] = []      # (element, text, characters in links)
        self._parse(source)

    def _drops(self, tag: str, attrs: dict[str, str], bare: str, parent: int) -> bool:
        if tag in DROP or _BARE.search(bare) or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROP_ROLES:
            return True
        if tag in PAGE_ONLY and not self.in_article[parent]:
            return True
        if "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return True
        if tag in ("body", "html", "article", "main"):
            return False
        words = set(_WORD.findall((attrs.get("class", "") + " " + attrs.get("id", "")).lower()))
        return bool(words & DROP_WORDS) and not words & KEEP_WORDS

    def _parse(self, source: str) -> None:
        stack, buf, links, link_depth, at, n = [0], [], 0, 0, 0, len(source)

        def flush():
            nonlocal links
            if buf:
                raw = "".join(buf)
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text and not self.dropped[stack[-1]]:
                    own = stack[-1]
                    self.blocks.append((own, text, links))
                buf.clear()
            links = 0

        def pop_to(k: int):
            nonlocal link_depth
            for e in stack[k:]:
                if self.tag[e] == "a":
                    link_depth -= 1
            del stack[k:]

        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                text = source[at:end]
                buf.append(text)
                if link_depth:
                    links += len(text.strip())
            if not m:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            tag = name.lower()
            if m.group(1) or m.group(4):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        if tag in BLOCK:
                            flush()
                        elif self.dropped[stack[k]] != self.dropped[stack[k - 1]]:
                            flush()
                        pop_to(k)
                        break
                    if self.tag[stack[k]] in SCOPE and tag not in SCOPE and tag not in ("html",):
                        break
                else:
                    if tag in BLOCK:
                        flush()
                continue
            if tag == "br":
                buf.append(" ")
                continue
            if tag in BLOCK:
                flush()
            close = CLOSES.get(tag, ())
            if tag in ENDS_P and tag != "p":
                close = (*close, "p")
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in close:
                    flush()
                    pop_to(k)
                    if t == "p" or tag not in ("tr", "tbody"):
                        break
                elif t in SCOPE and not (t in ("td", "th") and t in close):
                    break
            if tag in VOID:
                continue
            raw_attrs = m.group(3) if m.group(2) else m.group(6)
            attrs = {}
            if raw_attrs and not raw_attrs.isspace():
                attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(raw_attrs)}
            parent = stack[-1]
            drop = self.dropped[parent] or self._drops(tag, attrs, _ATTR.sub(" ", raw_attrs or ""), parent)
            if drop and not self.dropped[parent]:
                flush()
            if (raw_attrs or "").rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            self.tag.append(tag)
            kind = ".".join(sorted(_DIGITS.sub("#", c) for c in attrs.get("class", "").split()))
            self.label.append(f"{tag}.{kind}" if kind else tag)
            self.parent.append(parent)
            self.dropped.append(drop)
            self.in_article.append(self.in_article[parent] or tag in ARTICLE)
            stack.append(len(self.tag) - 1)
            if tag == "a":
                link_depth += 1
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = stop.start() if stop else n
        flush()

    def path(self, e: int) -> str:
        """Labels from below the body down (html and body may be left out of a page, so they are not named)."""
        parts = []
        while e > 0:
            if self.tag[e] not in ("html", "body"):
                parts.append(self.label[e])
            e = self.parent[e]
        return "/".join(reversed(parts))

    def scores(self) -> dict[int, float]:
        """Score of every container that holds prose."""
        out: dict[int, float] = defaultdict(float)
        for e, text, links in self.blocks:
            if len(text) < PROSE:
                continue
            worth, share = len(text) * max(0.0, 1 - links / len(text)), 1.0
            while e > 0 and share > 0.2:
                if self.tag[e] in CONTAINER:
                    out[e] += worth * share * (1.5 if self.tag[e] in ARTICLE else 1.0)
                    share /= 2
                e = self.parent[e]
        return out

    def best(self) -> list[tuple[int, float]]:
        return sorted(self.scores().items(), key=lambda x: (-x[1], x[0]))

    def text_under(self, roots: set[int] | None) -> str:
        if roots is None:
            return "\n".join(t for _, t, _ in self.blocks)
        inside = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            inside[e] = e in roots or inside[self.parent[e]]
        return "\n".join(t for e, t, _ in self.blocks if inside[e])


def extract(source: str, path: str | None) -> str:
    page = Page(source)
    if not page.blocks:
        return ""
    if path is not None:
        roots = present(page).get(path)
        if roots:
            return page.text_under(roots)
    top = page.best()
    return page.text_under({top[0][0]} if top else None)


def present(page: Page) -> dict[str, set[int]]:
    """The containers that hold text, by path."""
    by_path = defaultdict(set)
    seen = set()
    for b, _, _ in page.blocks:
        for e in _ancestors(page, b):
            if e in seen:
                break
            seen.add(e)
            if page.tag[e] in CONTAINER:
                by_path[page.path(e)].add(e)
    return by_path


def _ancestors(page: Page, e: int):
    while e > 0:
        yield e
        e = page.parent[e]


def host(url: str | Column = "url") -> Column:
    """Lower-case host of a url; '' if there is none."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def page_paths(pages: DataFrame) -> DataFrame:
    """``host, page, path, first, score``: the paths a page (hash of its source) has text under, whether its best container is there, and
    the score of its containers there."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part in slices(batches, PART_BYTES, "html"):
            rows = []
            for h, k, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                page = Page(source)
                scores, top = page.scores(), page.best()[:1]
                for p, roots in present(page).items():
                    rows.append((h, k, p, int(bool(top) and top[0][0] in roots), sum(scores.get(e, 0.0) for e in roots)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return (pages.where("html is not null").select("host", F.xxhash64("html").alias("page"), "html")
            .mapInArrow(run, "host string, page long, path string, first long, score double"))


def consensus(paths: DataFrame) -> DataFrame:
    """``host, path, first, score``: the paths that pages of a host vote for first."""
    return (paths.groupBy("host", "path").agg(F.sum("first").alias("first"), F.round(F.sum("score"), 3).alias("score"))
            .where(F.col("first") >= PAGES))


def chosen(paths: DataFrame) -> DataFrame:
    """``host, page, path``: of the consensus paths a page has text under, the one most pages vote for."""
    votes = few(stored(consensus(paths), "html_votes"))
    return (paths.select("host", "page", "path").join(votes, ["host", "path"]).groupBy("host", "page")
            .agg(F.min_by("path", F.struct(-F.col("first"), -F.col("score"), "path")).alias("path")))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    pages = pages.select("page_id", "url", "html", host().alias("host"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for part in slices(batches, PART_BYTES, "html"):
            text = [extract(s or "", p) for s, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], schema=schema)

    best = few(stored(chosen(stored(page_paths(pages), "html_page_paths")), "html_chosen"))
    joined = pages.withColumn("page", F.xxhash64("html")).join(best, ["host", "page"], "left")
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path").mapInArrow(
        run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    """op6's contract columns."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


by_value(common, sys.modules[__name__])
