"""Operator 11: main text of web pages by consensus paths of their hosts.

* First pass: each page is parsed into blocks of text, and its containers (block-level elements) are scored: text of a block
  counts for the container it lies in and, less with every level, for those around it; links, menus, adverts and the like
  count against them. Every container with a share of the page's best score votes for its path: tags and classes from the
  root, with digits generalised, so that ``post-17`` and ``post-18`` are one.
* Spark adds the votes of a host's pages for each path (a partial sum, so a hot host is a few rows of each task) and
  keeps the host's ``WINNERS`` best paths.
* Second pass: a page's text is that of its containers on the best of its host's winning paths that it has; a page with
  none of them has its own best container. Headings and further parts of the same article around the container are
  added. Winners are sent to every task below a counted number of bytes, joined by host above it.

Text: blocks in page order, joined by one newline; character references decoded; white space inside a block (a line break
too) is one space; menus, headers (but for headings inside an article), footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out.

Defined results: null and empty pages, and pages without text, give an empty text. Urls that are null or have no host form one
group. Repeated rows vote and are answered each. A page cut off anywhere is read as if it were closed there. Elements nested
deeper than ``DEEPEST`` count as parts of the one at that depth. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready

#: nesting beyond which an element belongs to the one above it
DEEPEST = 256
#: last steps of a path that are compared
PATH_STEPS = 24
#: paths of a host that pages are read by, at most; other pages go by their own best container
WINNERS = 32
#: bytes of winning paths that are sent to every task
BROADCAST_BYTES = 8 << 20
#: share of a container's score that the one around it gets
LEVEL_SHARE = 0.9
#: votes of a page's best container; one with less than ``VOTE_SHARE`` of its score has none
VOTES, VOTE_SHARE = 1000, 0.5

# fixed values of the HTML standard
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag closes an open element of these kinds, up to an element of the scope
CLOSES = {
    **dict.fromkeys(BLOCK - {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html", "head"}, (frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption"}))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}

# what is not main text: elements, roles, and words of a class or id
SKIPPED_TAGS = frozenset((
    "script style title head noscript template iframe noembed noframes object canvas svg math audio video map "
    "nav menu footer aside form button select datalist option textarea dialog search").split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SKIPPED_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "promotions menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager sidebar sidebars side aside rail widget widgets footer foot "
    "masthead topbar toolbar comment comments commentlist commentary reply replies respond responses discussion disqus cookie cookies consent gdpr notice "
    "notices alert alerts popup popover modal overlay lightbox newsletter subscribe subscription signup login signin register share sharing shares social "
    "related recommended recommendation recommendations trending search searchbox skip copyright legal disclaimer feedback rating ratings").split())
HEADER_WORDS = frozenset({"header", "topheader", "siteheader"})
#: words before a skipped word that say an element has, or lacks, such a part
ABOUT_PARTS = frozenset("with no without has have after before".split())
NEVER_SKIPPED = frozenset({"html", "body", "main"})

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?>=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))|([^\s"'<>/=]+)""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"[.!?:;,。！？]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TEXT}


class Node:
    """An element: its place in the tree, and what kind of part it is."""

    __slots__ = ("tag", "parent", "step", "skipped", "header", "link", "block", "path", "score", "order", "depth")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.step, self.path, self.score = tag, None, 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.skipped = self.header = self.link = False
        self.block = tag in BLOCK


class Block:
    """Text of one block: its container, its text, and how much of it lies in links, skipped parts or headers."""

    __slots__ = ("node", "text", "link_chars", "skipped", "heading", "header")

    def __init__(self, node: Node, text: str, link_chars: int):
        self.node, self.text, self.link_chars = node, text, link_chars
        self.skipped, self.header = node.skipped, node.header
        self.heading = node.tag in HEADINGS

    def weight(self) -> float:
        """Characters for the main text, or against it."""
        n = len(self.text)
        if self.skipped:
            return -n
        if self.header:
            return 0.0
        plain = n - 3 * self.link_chars
        if self.heading or n >= 80 or plain < 0 or _SENTENCE.search(self.text):
            return float(plain)
        return plain / 2


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, alone in _ATTRIBUTE.findall(raw):
        out.setdefault((name or alone).lower(), a or b or c)
    return out


def words_of(names: str) -> Iterator[list[str]]:
    """Lower-case words of each name in a class or id."""
    for name in names.split():
        yield [w.lower() for w in _WORDS.findall(name)]


def part_of_page(tag: str, at: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is skipped, and whether it is a header."""
    if tag in NEVER_SKIPPED:
        return False, False
    if tag in SKIPPED_TAGS or "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in SKIPPED_ROLES:
        return True, False
    if "style" in at and _HIDDEN.search(at["style"]):
        return True, False
    header = tag == "header"
    for words in words_of(f"{at.get('class', '')} {at.get('id', '')}"):
        for i, w in enumerate(words):
            about = i and words[i - 1] in ABOUT_PARTS
            if w in SKIPPED_WORDS and not about and (tag != "article" or w.startswith("comment")):
                return True, False
            header = header or (w in HEADER_WORDS and not about and tag not in HEADINGS)
    return False, header


def generalised(tag: str, at: dict[str, str]) -> str:
    """A step of a path: the tag with its classes (or else its id), digits as ``#``."""
    names = sorted({_DIGITS.sub("#", c) for c in at.get("class", "").split()})
    if not names and at.get("id"):
        return f"{tag}#{_DIGITS.sub('#', at['id'].strip())}"
    return ".".join([tag, *names])


class Page:
    """The blocks of a page in order, each in its container."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        root = Node("", None, 0)
        whole = Node("html", root, 0)
        self.count = 0
        self.stack = [root, whole, Node("body", whole, 0)]      # there is one of each, whatever the markup says
        self.opened: dict[str, int] = {}                        # open elements of each tag: most scans of the stack find none
        self.parts: list[str] = []
        self.links = 0
        self.holder = self.stack[-1]
        self.read(source)
        self.flush()

    def flush(self) -> None:
        """End the open block."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.holder, text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def add(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and not (self.parts == [] and raw.isspace()):
            text = entities.unescape(raw) if "&" in raw else raw
            holder = top
            while not (holder.block or holder.skipped and not (holder.parent and holder.parent.skipped)) and holder.parent is not None:
                holder = holder.parent
            if self.parts and holder is not self.holder:
                self.flush()
            if not self.parts:
                self.holder = holder
            self.parts.append(text)
            if top.link:
                self.links += len(text.strip())

    def open(self, tag: str, raw: str) -> None:
        stack = self.stack
        if tag in CLOSES:
            kinds, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 2, -1) if any(map(self.opened.get, kinds)) else ():
                if stack[i].tag in kinds:
                    self.close_at(i)
                    break
                if stack[i].tag in scope:
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            self.close_at(len(stack) - 1)
        if tag in BLOCK or tag in ("br", "hr"):
            if tag == "br":
                self.parts.append(" ") if self.parts else None
            else:
                self.flush()
        if tag in VOID or tag in ("html", "body"):
            return
        self.opened[tag] = self.opened.get(tag, 0) + 1
        parent = stack[-1]
        if parent.depth >= DEEPEST:
            node = Node(tag, parent.parent, parent.order)      # a sibling at the greatest depth, on the same path
            node.step, node.skipped, node.header, node.link, node.block = parent.step, parent.skipped, parent.header, parent.link, parent.block
            stack.append(node)
            return
        self.count += 1
        node = Node(tag, parent, self.count)
        at = attributes(raw) if raw and not raw.isspace() else {}
        skipped, header = part_of_page(tag, at)
        node.skipped = parent.skipped or skipped
        node.header = parent.header or header
        node.link = parent.link or (tag == "a" and "href" in at)
        node.step = generalised(tag, at)
        stack.append(node)

    def close_at(self, i: int) -> None:
        if any(n.block for n in self.stack[i:]):
            self.flush()
        for node in self.stack[i:]:
            self.opened[node.tag] -= 1
        del self.stack[i:]

    def close(self, tag: str) -> None:
        stack = self.stack
        if tag in ("html", "body"):
            self.flush()
            return
        for i in range(len(stack) - 1, 2, -1) if self.opened.get(tag) else ():
            if stack[i].tag == tag:
                self.close_at(i)
                return
            if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
                return
        if tag == "p":
            self.flush()

    def read(self, source: str) -> None:
        """One pass over the markup."""
        at, size, last = 0, len(source), source.rfind(">")
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self.add(source[at:])
                return
            if lt > at:
                self.add(source[at:lt])
            after = source[lt + 1:lt + 2]
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                if end < 0:
                    return
                at = end + 3
            elif after in ("!", "?") or (after == "/" and not source[lt + 2:lt + 3].isalpha()):
                end = source.find(">", lt + 1)
                if end < 0:
                    return
                at = end + 1
            elif after.isascii() and after.isalpha() or after == "/":
                if lt > last:
                    return                                          # an unfinished tag at the end of the page
                tag = _TAG.match(source, lt)
                if tag is None:
                    return
                name, at = tag[2].lower(), tag.end()
                if tag[1]:
                    self.close(name)
                elif name in RAW_TEXT:
                    end = _RAW_END[name].search(source, at)
                    at = end.end() if end else size
                else:
                    self.open(name, tag[3])
            else:
                self.add("<")
                at = lt + 1

    # -------------------------------------------------------------- containers

    def path(self, node: Node) -> str:
        if node.path is None:
            steps, at = [], node
            while at is not None and at.parent is not None and len(steps) < PATH_STEPS:
                steps.append(at.step)
                at = at.parent
            node.path = ">".join(reversed(steps))
        return node.path

    def containers(self) -> list[Node]:
        """Containers that may hold the main text, scored, best first (ties: the first on the page)."""
        seen: dict[int, Node] = {}
        for block in self.blocks:
            node, weight = block.node, block.weight()
            if node.parent is not None and (node.tag == "p" or block.heading or node.tag in ("li", "td", "dt", "dd", "blockquote", "pre")):
                node = node.parent                                  # a paragraph counts for what it lies in
                while node.parent is not None and node.tag in ("ul", "ol", "dl", "tr", "tbody", "thead", "table", "li"):
                    node = node.parent
            share = 1.0
            while node is not None and node.parent is not None:
                if node.block:
                    node.score += weight * share if weight > 0 else weight
                    seen[id(node)] = node
                    share *= LEVEL_SHARE
                node = node.parent
        found = [n for n in seen.values() if n.score > 0 and not n.skipped and n.tag not in HEADINGS]
        return sorted(found, key=lambda n: (-n.score, n.order))

    def votes(self) -> list[tuple[str, int]]:
        """Paths of the page's best containers and their votes."""
        found = self.containers()
        out: dict[str, int] = {}
        for node in found:
            if node.score >= VOTE_SHARE * found[0].score:
                out[self.path(node)] = max(out.get(self.path(node), 0), int(VOTES * node.score / found[0].score))
        return list(out.items())

    def chosen(self, winners: list[str]) -> list[Node]:
        """Containers to read: those on the first winning path that the page has, else its best one."""
        best = self.containers()
        present: dict[str, list[Node]] = {}
        seen: set[int] = set()
        for block in self.blocks:
            node = block.node
            while node is not None and node.parent is not None and id(node) not in seen:
                seen.add(id(node))
                if node.block and not node.skipped:
                    present.setdefault(self.path(node), []).append(node)
                node = node.parent
        good = {id(n) for n in best}
        for path in winners:
            nodes = present.get(path, [])
            nodes = [n for n in nodes if id(n) in good] or nodes[:1]
            if nodes:
                return nodes
        return best[:1]

    def text(self, winners: list[str]) -> str:
        """The main text by the host's winning paths, best first."""
        nodes = {id(self.widened(n)) for n in self.chosen(winners)}
        out = []
        for block in self.blocks:
            if block.skipped or (block.header and not block.heading):
                continue
            node = block.node
            while node is not None and id(node) not in nodes:
                node = node.parent
            if node is not None:
                out.append(block.text)
        return "\n".join(out)

    def widened(self, node: Node) -> Node:
        """The article around a container, or what adds headings alone."""
        at = node.parent
        while at is not None and at.parent is not None and at.tag not in ("body", "html"):
            if at.tag == "article" and not at.skipped:
                node = at
            elif not self.only_headings(at, node):
                break
            else:
                node = at
            at = at.parent
        return node

    def only_headings(self, outer: Node, inner: Node) -> bool:
        added = False
        for block in self.blocks:
            node = block.node
            while node is not None and node is not inner and node is not outer:
                node = node.parent
            if node is outer:
                if not block.heading or block.skipped:
                    return False
                added = True
        return added


# ------------------------------------------------------------------ Spark jobs

def host_of(url: str = "url"):
    """The url's host in lower case: what lies between the first ``://`` and the next ``/``, ``?`` or ``#``; else empty."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^/?#]*?://([^/?#]*)", 1), F.lit("")))


def path_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes``: the votes of each host's pages for each path."""
    ready(pages)

    def vote(batches):
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                for path, n in Page(source.as_py() or "").votes():
                    hosts.append(host.as_py())
                    paths.append(path)
                    votes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "votes"])

    found = pages.select(host_of(url).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(vote, "host string, path string, votes long")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(votes: DataFrame, winners: int = WINNERS) -> DataFrame:
    """``host, paths``: each host's paths with most votes, best first (ties: the smaller path)."""
    place = Window.partitionBy("host").orderBy(F.desc("votes"), F.asc("path"))
    first = votes.withColumn("place", F.row_number().over(place)).where(F.col("place") <= winners)
    return first.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("paths")).select("host", F.col("paths.path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", winners: int = WINNERS,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id_col, url, text``: the main text of each row of ``pages``, read by the winning paths of its host."""
    ready(pages)
    best = winning_paths(path_votes(pages, url, html), winners).checkpoint()
    size = best.agg(F.sum(F.octet_length("host") + F.octet_length(F.concat_ws("", "paths")) + 16 * F.size("paths") + 64)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(html).cast("string").alias("_html"), host_of(url).alias("host"))
    rows = rows.join(F.broadcast(best) if size <= broadcast_bytes else best, "host", "left").select("_id", "_url", "_html", "paths")

    def read(batches):
        for batch in batches:
            texts = [Page(source.as_py() or "").text(paths.as_py() or []) for source, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url)]
    return rows.mapInArrow(read, f"_id {kinds[0]}, _url {kinds[1]}, text string").select(F.col("_id").alias(id_col), F.col("_url").alias(url), "text")
