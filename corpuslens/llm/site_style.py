"""Main text of web pages by site style trees.

Pages of a host are merged into one tree of style nodes (an element's path of tags with their class
and id). A node is worth little if its presentation (the row of its children's styles) and its
content (the texts below it) hardly differ between the host's pages:

* presentation importance of a node on m pages: the entropy of its styles, to the base m;
* content importance: one minus the mean, over the distinct texts below it, of log_m of the pages that
  hold the text; outside the main part only the share of it that is not the text of links counts;
* node importance: ``(1 - g^l) * presentation + g^l * content`` for l styles, g = 0.9.

A page loses the branches whose importance is low beside that of the best branch next to them, and those
that mark-up itself names as no part of an article. Only counts of (host, node, feature) are shuffled,
summed up before that.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, map_columns

#: A branch goes if its importance is below this share of the best one's beside it and the node was seen on so many pages.
LEAST_IMPORTANCE, LEAST_PAGES, DECAY = 0.25, 4, 0.9
#: Elements below this depth are part of the node there, so that a page has few pairs of a node and one above it.
DEPTH = 48
#: Nodes of low importance that are broadcast at most (8 bytes each); more are joined by host, a host dealt out to so many parts.
BROADCAST_NODES, SALTS = 4_000_000, 16
#: The part of a page's unmarked text that its main or article elements hold at least to be taken for the whole.
MAIN_SHARE = 0.5

# Elements of HTML by what they are.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td template tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
DROPPED = set("nav footer aside form script style noscript template iframe svg select textarea object canvas dialog head title menu noembed noframes audio video".split())
#: Elements that class, id or role may mark as no part of the article.
MARKED = set("article aside details div dl footer form header main nav ol section span table ul".split())
# Words of class or id, and roles, by which pages mark what is no article. A name counts if it is one of the
# first, or all of its words are of the first or second and one of the first or third.
MARKS = set("ad ads adbox adslot adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav footer cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup comment comments commentlist disqus share sharing pagination pager login toolbar searchbox searchform".split())
FILLERS = set("area articles bar block bottom box button buttons center column container content foot form global head inner item items left link links list main message middle outer page panel post posts primary right rail secondary section site slot stories thread top unit widget wrap wrapper".split())
HALF_MARKS = set("alert aside discussion recommended related reply replies respond social skip subscription widget".split())
HEADER_MARKS = {"header", "masthead", "topbar", "sitehead", "page-header", "site-header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: An open element is closed by the start of one of these, if none of the others stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
HOLDERS = ("div", "article", "section", "main", "body", "td", "li", "blockquote", "aside", "footer", "header", "nav", "form", "table", "ul", "ol")

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_WORD = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def marked(name: str) -> bool:
    """Whether a name of class or id says that its element is no part of an article."""
    if name in MARKS:
        return True
    words = _WORD.findall(name)
    return len(words) > 1 and all(w in MARKS or w in FILLERS or w in HALF_MARKS for w in words) and any(w in MARKS or w in HALF_MARKS for w in words)


class Scanner:
    """Where tags end, in time linear in the page however quotes and brackets are left open."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.failed: set[int] = set()  # quotes from which no tag was found to end

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if there is none."""
        html, seen, i = self.html, [], at
        if self.last[">"] < at:
            return -1
        while (m := _STOP.search(html, i)) and m.start() not in self.failed:
            i, c = m.start(), m[0]
            if c == ">":
                return i
            seen.append(i)
            if self.last[c] <= i:  # the quote stays open, so it is none
                i += 1
                continue
            i = html.find(c, i + 1) + 1
        self.failed.update(seen)
        return html.find(">", at)


class Block:
    """A run of text in a node; ``linked``: how much of it is the text of links."""

    __slots__ = ("text", "node", "dropped", "inside", "linked")

    def __init__(self, text: str, node: int, dropped: bool, inside: int, linked: int):
        self.text, self.node, self.dropped, self.inside, self.linked = text, node, dropped, inside, linked


def _node(parent: int, tag: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{tag}.{name}") - (1 << 63)


def _keys(hosts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """One number for a host and a node; both are hashes."""
    return nodes ^ (hosts * np.int64(-7046029254386353131))


class Page:
    """A page's blocks, and its style nodes (the node above each, and its children in order).

    ``marks``: whether tags, classes, ids and roles that name what is no article count.
    """

    def __init__(self, html: str, marks: bool = True):
        self.marks = marks
        self.blocks: list[Block] = []
        self.children: dict[int, list[int]] = {}
        self.above: dict[int, int] = {}
        # open elements: tag, node, depth, dropped, inside (2: article, 1: main, 0: neither), whether a block
        self.stack: list[tuple[str, int, int, bool, int, bool]] = [("", 0, 0, False, 0, True)]
        self.open_at: dict[str, list[int]] = {}
        self.run: list[str] = []
        self.linked = 0
        self._scan(html)
        self.flush()

    def _scan(self, html: str) -> None:
        scanner, at, n = Scanner(html), 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.say(html[at:])
                return
            if lt > at:
                self.say(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt)
                at = n if end < 0 else end + 3
                continue
            m = _NAME.match(html, lt)
            if m is None:
                if html[lt + 1 : lt + 2] in ("!", "?") and scanner.last[">"] > lt:
                    at = html.find(">", lt) + 1
                else:
                    self.say("<")
                    at = lt + 1
                continue
            end = scanner.tag_end(m.end())
            if end < 0:
                self.say("<")
                at = lt + 1
                continue
            tag, attrs, at = m[2].lower(), html[m.end() : end], end + 1
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                raw = _RAW_END[tag].search(html, at)
                at = raw.end() if raw else n
                self.close(tag)

    def say(self, text: str) -> None:
        if self.stack[-1][3] and not self.stack[-1][5]:
            return  # text of an inline element that is dropped says nothing within its block
        self.run.append(text)
        if self.open_at.get("a"):
            self.linked += len(text)

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            if text:
                _, node, _, dropped, inside, _ = self.stack[-1]
                self.blocks.append(Block(text, node, dropped, inside, min(len(text), self.linked)))
            self.run, self.linked = [], 0

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.say(" ")
            return
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag in CLOSES:
                self._close_in_scope(CLOSES[tag], LISTS)
            if tag not in ("html", "body"):
                self._close_in_scope(("p",), HOLDERS)
        if tag in VOID or attrs.endswith("/") and tag in ("path", "rect", "circle", "use", "line", "polygon"):
            return
        _, node, depth, dropped, inside, _ = self.stack[-1]
        name, names, role, hidden = "", (), "", False
        if attrs.strip(" /\t\n\r"):
            got = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTR.findall(attrs))}
            name = _NUMBER.sub("", f"{got.get('class', '')}#{got.get('id', '')}").strip("#").lower()
            names, role = name.replace("#", " ").split(), got.get("role", "").lower()
            hidden = "hidden" in got and got["hidden"].lower() != "until-found" or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
            if role == "main" or got.get("itemprop") == "articleBody":
                inside = max(inside, 1)
        if not dropped:
            away = any(marked(x) for x in names)
            if self.marks:
                dropped = tag in DROPPED or role in ROLES or tag in MARKED and (away or inside < 2 and (tag == "header" or any(x in HEADER_MARKS for x in names)))
                # a page's frame is never marked as a whole; an article is if it is a comment or an advert
                if tag in ("html", "body", "main") or tag == "article" and not away:
                    dropped = False
            else:
                dropped = tag in DROPPED and tag not in ("nav", "footer", "aside", "menu")
            dropped = dropped or hidden
        if tag == "article":
            inside = 2
        elif tag == "main":
            inside = max(inside, 1)
        if block:
            depth += 1
            if depth <= DEPTH:
                child = _node(node, tag, name)
                self.children.setdefault(node, []).append(child)
                self.above[child] = node
                node = child
        self.open_at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, depth, dropped, inside, block or dropped == self.stack[-1][3] and self.stack[-1][5]))

    def _cut(self, i: int) -> None:
        """Close all open elements from the i-th on."""
        if any(e[5] and e[0] in BLOCKS for e in self.stack[i:]):
            self.flush()
        for e in reversed(self.stack[i:]):
            self.open_at[e[0]].pop()
        del self.stack[i:]

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self.open_at.get(t))), default=0)

    def _close_in_scope(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        i = self._last(tags)
        if i and i >= self._last(stops) or i and self.stack[i][0] in stops and i == self._last(stops):
            self._cut(i)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag not in ("body", "html") and self.open_at.get(tag):
            self._cut(self.open_at[tag][-1])

    def chain(self, node: int) -> Iterator[int]:
        """A node and those above it."""
        while node:
            yield node
            node = self.above[node]

    def features(self) -> Iterator[tuple[int, int, int, int]]:
        """(node, kind, feature, count) once a page: 0 the style of a node, 1 a text right in it, 2 a node above it (or itself),
        3 and 4 the length of its texts and that of their links outside the main part, 5 the node that it is right below."""
        for node, parent in self.above.items():
            row: list[int] = []
            for c in self.children.get(node, ()):
                if not row or row[-1] != c:
                    row.append(c)
            yield node, 0, xxhash.xxh64_intdigest(repr(row)) - (1 << 63), 1
            yield node, 5, parent, 1
        texts: set[tuple[int, str]] = set()
        size: Counter = Counter()
        linked: Counter = Counter()
        for b in self.blocks:
            texts.add((b.node, b.text))
            size[b.node] += len(b.text)
            linked[b.node] += b.linked if b.inside == 0 else 0
        for node, text in texts:
            yield node, 1, xxhash.xxh64_intdigest(text) - (1 << 63), 1
        for node, n in size.items():
            yield node, 3, 0, n
            yield node, 4, 0, linked[node]
            for above in self.chain(node):
                yield node, 2, above, 1

    def text(self, low: set[int] | None = None) -> str:
        """The blocks that stay: not marked as something else, not in a branch of low importance, and in the main or article elements if these hold most of it.

        Low branches stay if nine tenths of what is left would go with them: then the host's pages are copies of each other.
        """
        size = lambda blocks: sum(len(b.text) for b in blocks)
        kept = [b for b in self.blocks if not b.dropped]
        if low:
            below: dict[int, bool] = {0: False}

            def is_low(node: int) -> bool:
                way = []
                while node not in below:
                    way.append(node)
                    node = self.above[node]
                for n in reversed(way):
                    below[n] = below[self.above[n]] or n in low
                return below[way[0]] if way else below[node]

            high = [b for b in kept if not is_low(b.node)]
            if size(high) * 10 > size(kept):
                kept = high
        for least in (1, 2):  # the main part if there is one, in it the articles
            part = [b for b in kept if b.inside >= least]
            if part and size(part) >= MAIN_SHARE * size(kept) and (least == 1 or not any(b.inside == 1 for b in kept)):
                kept = part
        return "\n".join(b.text for b in kept)


def importance(pages: DataFrame, *, marks: bool = True) -> DataFrame:
    """host, node, parent, pages, styles, presentation, content, importance of every style node; ``pages``: host (a hash) and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if html:
                    for node, kind, feature, n in Page(html, marks).features():
                        counts[host, node, kind, feature] += n
            if counts:
                cols = [list(c) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(list(counts.values()), pa.int64())], names=["host", "node", "kind", "feature", "n"])

    seen = map_batches(pages.select("host", "html"), run, "host bigint, node bigint, kind bigint, feature bigint, n bigint")
    c = cut(seen.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    own = c.groupBy("host", "node").agg(
        of(0, F.col("n")).alias("pages"), of(0, F.lit(1)).alias("styles"), of(0, F.col("n") * F.log("n")).alias("nlogn"), F.max(F.when(F.col("kind") == 5, F.col("feature"))).alias("parent"),
        of(1, F.log("n")).alias("logs"), of(1, F.lit(1)).alias("texts"), of(3, F.col("n")).alias("size"), of(4, F.col("n")).alias("linked"),
    )
    leaf = own.where("texts > 0").select("host", F.col("node").alias("leaf"), "logs", "texts", "size", "linked")
    above = c.where("kind = 2").select("host", F.col("node").alias("leaf"), F.col("feature").alias("node"))
    content = above.join(leaf, ["host", "leaf"]).groupBy("host", "node").agg(*[F.sum(x).alias(x) for x in ("logs", "texts", "size", "linked")])
    t = own.where("pages > 0").select("host", "node", "parent", "pages", "styles", "nlogn").join(content, ["host", "node"], "left")
    base = F.log("pages")
    presentation = F.when(F.col("pages") > 1, (base - F.col("nlogn") / F.col("pages")) / base).otherwise(1.0)
    free = 1 - F.coalesce(F.col("linked") / F.col("size"), F.lit(0.0))
    held = F.when((F.col("pages") > 1) & (F.col("texts") > 0), F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("texts") / base) * free).otherwise(1.0)
    t = t.select("host", "node", "parent", "pages", "styles", presentation.alias("presentation"), held.alias("content"))
    g = F.pow(F.lit(DECAY), F.col("styles"))
    return t.withColumn("importance", (1 - g) * F.col("presentation") + g * F.col("content"))


def low_nodes(pages: DataFrame, *, marks: bool = True) -> DataFrame:
    """host, node of the branches that go: of low importance beside the best branch of the same parent."""
    t = cut(importance(pages, marks=marks))
    best = t.groupBy("host", "parent").agg(F.max("importance").alias("best"))
    few = t.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    return few.join(best, ["host", "parent"]).where(F.col("importance") < LEAST_IMPORTANCE * F.col("best")).select("host", "node")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_nodes: int = BROADCAST_NODES, marks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty html has an empty text.

    Pages without a url are pages of one host. Repeated rows give repeated results, and count as pages.
    Other columns are not read; an empty table gives an empty result.
    """
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    low = cut(low_nodes(p, marks=marks))
    few = low.count() <= broadcast_nodes
    if few:
        rows = low.toArrow()  # bounded by the count
        keys = np.sort(_keys(rows.column("host").to_numpy(), rows.column("node").to_numpy()))
        held = p.sparkSession.sparkContext.broadcast(keys)
        p = p.withColumn("low", F.lit(None).cast("array<bigint>"))
    else:
        by_host = low.groupBy("host").agg(F.collect_list("node").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(by_host, ["host", "salt"], "left")

    def make():
        keys = held.value if few else None

        def of_page(page: Page, host: int, low: list[int] | None) -> set[int]:
            if not few:
                return set(low or ())
            if not len(keys):
                return set()
            nodes = list(page.above)
            mine = _keys(np.int64(host), np.array(nodes, np.int64))
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            return {nodes[i] for i in np.flatnonzero(keys[at] == mine).tolist()}

        def run(htmls, hosts, lows):
            texts = []
            for h, host, x in zip(htmls.to_pylist(), hosts.to_pylist(), lows.to_pylist()):
                page = Page(h, marks) if h else None
                texts.append(page.text(of_page(page, host, x)) if page else "")
            return pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())

        return run

    return map_columns(p, make, ["html", "host", "low"], "text string, n_chars bigint", ["page_id", "url"])
