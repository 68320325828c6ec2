"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a style node is a path of tags and classes. For every
node the distribution over pages of its presentation (order of child styles) and of its content
(text of the branch) is counted, and its importance is the larger of the two entropies, relative
to that of as many different pages. What hardly varies on ``least_pages`` pages or more is the
site's frame: branches below ``least_importance`` are cut from each page. What the parts of
a page are called (nav, footer, class "ad", role "banner", ...) is presentation as well: such nodes
have no importance on any site, which also serves hosts of few pages. A name or role cuts no branch that
holds the page's main part, its longest article or most of its text, nor a paragraph or heading.

The text is what is left of the page's articles and main part if they hold half of it or more, else of
its body. Should a frame take all of it, the page keeps its text.

Counts are combined in the tasks, then per (host, node, value), then per (host, node), so a host may
hold most pages. A node of little importance occurs on several pages, so a host has few of them
beside its pages; they are joined to pages by host. Null html is an empty page, a page without
a host is its own site, repeated pages count for the tree once per host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.sources.tables import materialise

LEAST_PAGES, LEAST_IMPORTANCE = 6, 0.1

# Element names and naming habits of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
NOT_TEXT = RAW | frozenset("head nav footer aside button select option datalist label input dialog menu object embed audio "
                           "video canvas map search".split())
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
    "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"})}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
NOT_IN_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "li", "dt", "dd", "caption", "option", "optgroup", "tbody", "thead", "tfoot", "legend"}
P_SCOPE = frozenset("article aside body button div section td th li main table figure blockquote form header footer nav".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar rail aside ad ads adbox adslot advert "
    "adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist respond replies disqus widget widgets pagination pager toolbar copyright colophon legal disclaimer".split())
WHOLE_NAMES = frozenset("hidden visually-hidden sr-only skip-link side-bar sign-up".split())
HEADER_NAMES = frozenset("header masthead banner".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond replies disqus".split())
#: "has-sidebar" says what a node goes with, not what it is.
STATES = frozenset("has have no not non with without is in hide hides show shows open closed enabled disabled layout page".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
_PARTS = re.compile(r"[_-]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
    r"([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_DIGITS = re.compile(r"[0-9]+")


def names(value: str) -> set[str]:
    """What the tokens of a class or id call a node."""
    out = set()
    for token in value.split():
        parts = set(_PARTS.split(token))
        if token in WHOLE_NAMES:
            out.add(token)
        elif not parts & STATES:
            out |= parts & NAMES
    return out


class Page:
    """Nodes of a page in page order and its blocks of text as (node, text) pieces."""

    def __init__(self, html: str) -> None:
        import xxhash
        self._hash = xxhash.xxh3_64_intdigest
        self.parent, self.path, self.tag, self.plain, self.article = [-1], [0], [""], [True], [0]
        self.named = [0]  # 1: called a part of the frame, 2: comments
        self.kids: list[list[int]] = [[]]
        self.blocks: list[list[tuple[int, str]]] = []
        self._block: list[tuple[int, str]] = []
        self._stack = [0]
        self._read(html)
        self._flush()
        self.unnamed = self.plain
        self.plain = self._without_named()

    def _without_named(self) -> list[bool]:
        """Nodes without the branches that are called parts of the frame. A name cuts no branch that holds
        the page's main part, its longest article or most of its text, and not all of the text."""
        size, whole = [0] * len(self.tag), 0
        for block in self.blocks:
            for node, text in block:
                if self.plain[node]:
                    n = len("".join(text.split()))
                    whole += n
                    while node >= 0:
                        size[node] += n
                        node = self.parent[node]
        holds = [False] * len(self.tag)
        real = [node for node in range(1, len(self.tag)) if self.plain[node] and size[node] and self.article[node] > self.article[self.parent[node]]]
        articles = [node for node in real if self.article[node] == 2]
        for node in {*[node for node in real if self.article[node] == 1], *([max(articles, key=size.__getitem__)] if articles else [])}:
            while node >= 0:
                holds[node] = True
                node = self.parent[node]
        out = list(self.plain)
        for node in range(1, len(self.tag)):
            most = size[node] * 2 > whole and not (self.named[node] == 2 and real)
            out[node] = out[node] and out[self.parent[node]] and not (self.named[node] and not holds[node] and not most)
        kept = any(out[node] and text.strip() for block in self.blocks for node, text in block)
        return out if kept else self.plain

    def _flush(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _text(self, raw: str) -> None:
        if raw:
            self._block.append((self._stack[-1], unescape(raw) if "&" in raw else raw))

    def _open(self, tag: str, attributes: str) -> int:
        up, node = self._stack[-1], len(self.tag)
        name, plain, named, article = tag, tag not in NOT_TEXT, int(tag in ("form", "fieldset")), self.article[up]
        if "=" in attributes or "hidden" in attributes.lower():
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):  # one after another, values whole; the first of a name counts
                found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
            classes = found.get("class", "")
            name = f"{tag}.{_DIGITS.sub('0', ' '.join(sorted(classes.split())))}"
            body = tag in ("html", "body", "article", "main")
            called = set() if body else names(classes) | names(found.get("id", ""))
            if article > 1 or tag in TEXT_TAGS:
                called -= HEADER_NAMES
            if tag in TEXT_TAGS:
                called &= WHOLE_NAMES
            if called:
                named = 2 if called & COMMENT_NAMES else 1
            if tag == "article" and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", classes):
                plain = False
            if found.get("role") in ROLES and not body:
                named = named or 1
            if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
                plain = False
            if found.get("role") == "article" or found.get("itemprop") == "articlebody":
                article = max(article, 2)
            elif found.get("role") == "main":
                article = max(article, 1)
        if tag == "header" and article < 2:
            plain = False
        article = max(article, {"article": 2, "main": 1}.get(tag, 0))
        self.parent.append(up)
        self.path.append(self._hash(f"{self.path[up]:x}/{name}"))
        self.tag.append(tag)
        self.plain.append(plain and self.plain[up])
        self.named.append(named)
        self.article.append(article)
        self.kids.append([])
        kids = self.kids[up]
        if not kids or kids[-1] != self.path[node]:
            kids.append(self.path[node])
        return node

    def _close_to(self, tags: frozenset | set, stop: frozenset | set) -> None:
        """Closes the outermost open element of ``tags`` inside the nearest of ``stop``."""
        cut = 0
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in tags:
                cut = i
            elif tag in stop:
                break
        if cut:
            del self._stack[cut:]

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                return
            self._text(html[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    self._flush()
                for i in range(len(self._stack) - 1, 0, -1):
                    if self.tag[self._stack[i]] == tag:
                        del self._stack[i:]
                        break
                    if self.tag[self._stack[i]] in P_SCOPE and tag not in BLOCK:
                        break  # an inline end tag doesn't close a block
                continue
            if tag in BLOCK:
                self._flush()
            if tag in NOT_IN_P:
                self._close_to({"p"}, P_SCOPE)
            if tag in CLOSED_BY:
                self._close_to(CLOSED_BY[tag], SCOPE[tag])
            if tag in ("br", "wbr"):
                if tag == "br":
                    self._text(" ")
                continue
            node = self._open(tag, m[3])
            if tag in RAW and not m[3].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
            elif tag not in VOID and not m[3].endswith("/>"):
                self._stack.append(node)

    def styles(self) -> dict[int, tuple[int, int]]:
        """Presentation and content of each style node outside what has no importance anyway."""
        mask = (1 << 64) - 1
        content = [0] * len(self.tag)
        for block in self.blocks:
            for node, text in block:
                words = " ".join(text.split())
                if words:
                    h = self._hash(words)
                    while node > 0:
                        content[node] = (content[node] * 0x100000001B3 + h) & mask
                        node = self.parent[node]
        out: dict[int, tuple[int, int]] = {}
        for node in range(1, len(self.tag)):
            if self.plain[node]:
                style, text = out.get(self.path[node], (0, 0))
                kids = self._hash(",".join(map(str, self.kids[node])))
                out[self.path[node]] = ((style * 31 + kids) & mask, (text * 0x100000001B3 + content[node]) & mask)
        return out

    def text(self, frame: frozenset[int] | set[int] = frozenset()) -> str:
        cut = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            cut[node] = cut[self.parent[node]] or self.path[node] in frame
        sizes = [0, 0, 0]
        for block in self.blocks:
            for node, text in block:
                if self.plain[node] and not cut[node]:
                    sizes[self.article[node]] += len("".join(text.split()))
        # the innermost kind that holds half of the text; what stands beside articles in a main part is text like them
        level = next((k for k in (2, 1) if sum(sizes[k:]) * 2 >= sum(sizes) and not (k == 2 and sizes[1])), 0)
        out = []
        for block in self.blocks:
            words = " ".join("".join([t for node, t in block if self.plain[node] and not cut[node] and self.article[node] >= level]).split())
            if words:
                out.append(words)
        return "\n".join(out) if out or not frame else self.text()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def tree(pages: DataFrame) -> DataFrame:
    """host, node, pages and importance of every style node; from host and html."""
    pages = pages.where("host IS NOT NULL").select("host", "html", F.xxhash64("html").alias("page"))
    # written first, so that its size is known: few pages are repeated, and texts need no shuffle
    repeated = materialise(pages.groupBy("host", "page").count().where("count > 1").select("host", "page", F.lit(True).alias("again")), "repeated")
    pages = pages.join(repeated, ["host", "page"], "left").select("host", "html", F.when(F.col("again"), F.col("page")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in common.buffered(batches, "html", 4 << 20):
            seen: Counter = Counter()
            for host, html, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "page")), strict=True):
                if page is not None:
                    if (host, page) in done:
                        continue
                    done.add((host, page))
                for node, values in Page(html or "").styles().items():
                    for kind, value in enumerate(values):
                        seen[host, page, _signed(node), kind, _signed(value)] += 1
            if seen:
                host, *numbers = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (*numbers, seen.values()))],
                                                 ["host", "page", "node", "kind", "value", "n"])

    # a repeated page counts once, whatever tasks have it
    counts = (pages.mapInArrow(run, "host string, page long, node long, kind long, value long, n long")
              .groupBy("host", "page", "node", "kind", "value").agg(F.sum("n").alias("n"))
              .groupBy("host", "node", "kind", "value").agg(F.sum(F.when(F.col("page").isNull(), F.col("n")).otherwise(1)).alias("n")))
    n = F.col("n").cast("double")
    entropy = (counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("pages"), F.sum(n * F.ln(n)).alias("s"))
               .withColumn("h", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.ln("pages"))).otherwise(1.0)))
    return entropy.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.max("h").alias("importance"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES,
            least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``keep`` columns and ``main``: the main text, empty if there is none."""
    rows = common.packed(pages, keep, html=html, _url=url).select("_row", "html", host_of(F.col("_url")).alias("host"))
    frame = (tree(rows).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
             .groupBy("host").agg(F.collect_list("node").alias("frame")))
    rows = rows.join(materialise(frame, "frames"), "host", "left").select("_row", "html", "host", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = [], {}
            for html, host, frame in zip(*(batch.column(c) for c in ("html", "host", "frame")), strict=True):
                if host.as_py() not in known:
                    known[host.as_py()] = {x & (1 << 64) - 1 for x in frame.as_py() or ()}
                texts.append(Page(html.as_py() or "").text(known[host.as_py()]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "main"])

    return rows.mapInArrow(run, common.with_fields(rows.select("_row"), "main string")).select("_row.*", "main")


def result(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"]).select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
