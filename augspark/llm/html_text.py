"""Main text of web pages with site style trees.

The pages of a host are merged into one tree, whose nodes are the paths of elements (tag and class). A
node's importance mixes two entropies: how differently the pages present it, and how differently they
fill it. Branches that look and read the same on most pages of a host are noise, and go from each page.
So are single texts that stand in the same place on most of a host's distinct contents, in articles as well.
What an element says about itself (its tag, class or role) scales the importance: such a branch goes
unless its host's pages fill it differently, so that pages of hosts with few pages are cleaned as well. A
page of which nothing would be left gives its best branch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augspark.session import cut_lineage

# Weight of content against presentation per kind of child, and the importance below which a branch goes
ATTENUATION, THRESHOLD = 0.9, 0.5
# A node on fewer pages of a host says nothing
MIN_PAGES = 5
# A branch with more characters than this on an average page is text, however often it is copied
LONG_CHARS = 400
# What a telling tag or name leaves of a branch's importance, and what the names of ads and comments leave, which differ anyway
NAMED, OTHERS = 0.6, 0.4
# A text in the same place of more than this share of a host's distinct contents is noise
MOST = 0.5
# Hosts and nodes up to which the low nodes are broadcast; beyond that they are joined by host and salt
BROADCAST_NODES, SALTS = 100_000, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|([^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "noscript")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption button template svg".split()
)
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody tfoot tr td th caption dl dt dd figure figcaption".split())
# An opening tag of the key ends an open element of the value
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPOKEN = 0x5DEECE66D1CE4E5B
# Elements beyond which an opening tag ends nothing
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NO_TEXT_TAGS = set("head script style noscript template iframe svg math canvas object audio video button select textarea title".split())
_NAMED_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
_NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside rail footer header masthead topbar comment comments discussion replies reply respond disqus cookie cookies consent "
    "notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets search toolbar pagination pager copyright legal skip tags contentinfo complementary form dialog paywall".split()
)
# The same inside longer names, such as commentlist, topnav or pagefooter
_NOISE_NAMES = re.compile(
    r"comment(?!ary)|sidebar|footer|masthead|breadcrumb|advert|cookie|newsletter|sponsor|promo|banner"
    r"|(?<![a-z])(?:top|main|site|sub|side|page|global)(?:nav|menu)|(?:nav|menu)(?:bar|list|items?)(?![a-z])"
)
# Names of what others than the author say
_OTHERS = re.compile(r"(?<![a-z])(?:ads?|adv|adbox|adsense|discussion|repl(?:y|ies)|respond|disqus)(?![a-z])|advert|sponsor|promo|comment(?!ary)")
# Names of layouts that tell what stands beside them
_LAYOUT = re.compile(r"(?<![a-z])(?:with|has|no|without|show|hide)[-_][a-z0-9_-]+|[a-z]+[-_](?:open|closed|enabled|disabled|count)(?![a-z])")
_MAIN_TAGS = {"article", "main"}


@dataclass
class Node:
    """An open element: its path, whether text in it counts, and what a page says of it."""

    tag: str
    path: str
    dropped: bool  # by its tag, class or role, where the site style tree does not speak for it
    low: bool  # by the site style tree
    main: bool
    children: list[str]
    never: bool = False  # holds no text whatever the tree says
    skip: bool = False  # its own text is left out, that of blocks in it may not be
    named: bool = False
    branch: tuple[float, int] = (1.0, 0)  # scale and number of the outermost dropped element around it


class Page:
    """One reading of a page: blocks of text with their paths, and the child sequence of every block element."""

    def __init__(self, html: str, low_paths: frozenset[int] | set[int] = frozenset(), path_hash=None):
        self.blocks: list[tuple[str, tuple[str, ...], bool, bool, bool, bool, tuple[float, int]]] = []
        self.styles: list[tuple[str, str, int, bool]] = []
        self._branches = 0
        self.has_main = False
        self._low_paths, self._hash = low_paths, path_hash
        self._stack: list[Node] = [Node("", "", False, False, False, [])]
        self._text: list[str] = []
        self._read(html)

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            top = self._stack[-1]
            at = next((n for n in reversed(self._stack) if n.tag in _BLOCK or not n.tag), top)
            paths = tuple(dict.fromkeys(n.path for n in self._stack if n.path and n.tag in _BLOCK))
            common = bool(self._low_paths) and len(text) < LONG_CHARS and text_node(self._hash(at.path), _Hash()(text)) in self._low_paths
            self.blocks.append((text, paths, at.dropped or top.dropped, at.low or top.low, at.main, common, at.branch))

    def _close(self, depth: int) -> None:
        """Ends all open elements down to ``depth``."""
        while len(self._stack) > depth:
            node = self._stack[-1]
            if node.tag in _BLOCK:
                self._flush()
                self.styles.append((node.path, " ".join(node.children), len(set(node.children)), node.named))
            self._stack.pop()

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in _BLOCK:
            self._flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    self._close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _WALLS[tag]:
                    break
                if stack[i].tag in _ENDS[tag]:
                    self._close(i)
                    break
        parent = stack[-1]
        found: dict[str, str] = {}
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        main = parent.main or tag in _MAIN_TAGS or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        words, noise, others = set(), False, False
        if found and tag not in ("html", "body"):
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            words = {w.lower() for w in _WORDS.findall(names)}
            told = _LAYOUT.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())
            exact = set(_WORDS.findall(told)) & _NOISE_WORDS - ({"header"} if main else set())
            if tag in _MAIN_TAGS and not parent.main:
                noise = bool(exact & {"comment", "comments"})
            else:
                noise = bool(exact) or bool(_NOISE_NAMES.search(told))
            others = noise and bool(_OTHERS.search(told))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        never = parent.never or tag in _NO_TEXT_TAGS or hidden
        named = noise or tag in _NAMED_TAGS or (tag == "header" and not main)
        kind = tag + "".join("." + w for w in sorted(words))
        path = f"{parent.path}/{kind}" if tag in _BLOCK else parent.path
        held = bool(self._low_paths) and tag in _BLOCK and not others and spoken_for(self._hash(path)) in self._low_paths
        dropped = parent.dropped or never or (named and not held)
        branch = parent.branch
        if dropped and not parent.dropped:
            self._branches += 1
            branch = (OTHERS if others else NAMED, self._branches)
        if main and not dropped and not parent.main:
            self.has_main = True
        low = parent.low
        if tag in _BLOCK:
            parent_block = next(n for n in reversed(stack) if n.tag in _BLOCK or not n.tag)
            parent_block.children.append(kind)
            # all running text of articles shares a few paths, so that its texts are measured one by one
            known_text = main and (tag in _TEXT_TAGS or tag in _MAIN_TAGS) and not words
            if self._low_paths and not known_text and not named and self._hash(path) in self._low_paths:
                low = True
        if tag not in _VOID:
            skip = never or (tag not in _BLOCK and (parent.skip or (named and dropped)))
            stack.append(Node(tag, path, dropped, low, main, [], never, skip, named and not others, branch))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        match = _TOKEN.match
        while at < end:
            m = match(html, at)
            if m is None:  # cannot happen: the last alternative takes any character
                break
            at = m.end()
            text = m[7]
            if text is not None:
                if not self._stack[-1].skip:
                    self._text.append(text)
                continue
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                for i in range(len(self._stack) - 1, 0, -1):
                    if self._stack[i].tag == tag:
                        self._close(i)
                        break
                    if tag not in _BLOCK and self._stack[i].tag in _BLOCK:
                        break  # an inline end tag does not end blocks
                if tag == "br":
                    self._text.append(" ")
                continue
            if tag in _RAW:
                closed = _RAW[tag].search(html, at)
                at = closed.start() if closed else end
                if closed:
                    shut = html.find(">", at)
                    at = shut + 1 if shut >= 0 else end
                continue
            if tag in ("br", "wbr"):
                if tag == "br":
                    self._text.append(" ")
                continue
            self._open(tag, m[3] or m[6] or "")
        self._close(1)
        self._flush()

    def _ours(self) -> list[tuple[str, bool, bool]]:
        """Blocks of the main element, or of the whole body if the page has none: text, low, common.

        If all blocks are dropped, those of the dropped branch that is scaled least and has the most text; if
        the only main element is in a dropped branch and longer than all the rest, its blocks.
        """
        ours = [b for b in self.blocks if not b[2] and (b[4] or not self.has_main)]
        if not self.has_main:
            inner = [b for b in self.blocks if b[2] and b[4] and b[6][0] >= NAMED]
            if sum(len(b[0]) for b in inner) > sum(len(b[0]) for b in ours):
                ours = inner
        if not ours:
            sizes: dict[tuple[float, int], int] = {}
            for b in self.blocks:
                sizes[b[6]] = sizes.get(b[6], 0) + len(b[0])
            best = max(sizes, key=lambda k: (k[0], sizes[k]), default=None)
            ours = [b for b in self.blocks if b[6] == best]
        return [(b[0], b[3], b[5]) for b in ours]

    def content(self) -> str:
        """What tells the page from others of its host: its longest block, which copies with small changes mostly share."""
        return max((t for t, *_ in self._ours()), key=len, default="")

    def text(self) -> str:
        """Blocks of the main element, or of the whole body if the page has none, joined by line breaks."""
        ours = self._ours()
        # if every branch is low, importance tells no parts of the page apart
        kept = [(t, common) for t, low, common in ours if not low] or [(t, common) for t, _, common in ours]
        own = [t for t, common in kept if not common]
        # a page that is common text for the most part is a copy, not an article with notices
        copied = 2 * sum(map(len, own)) < sum(len(t) for t, _ in kept)
        return "\n".join(t for t, _ in kept) if copied else "\n".join(own)


def text_node(path: int, text: int) -> int:
    """The hash of a text in a place, from the hashes of both."""
    return path ^ text


def spoken_for(path: int) -> int:
    """The hash that says of a path that its importance stands up to what its names say."""
    return path ^ SPOKEN


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return F.when(host != "", host)


class _Hash:
    """64-bit signed hashes of strings, remembered for the strings of a task up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        from xxhash import xxh64_intdigest

        found = self.known.get(text)
        if found is None:
            found = xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)
            if len(self.known) < 200_000:
                self.known[text] = found
        return found


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and path: its child sequence, and each text that stands in it, once.

    content: the hash of the page's content, on its outermost elements and on the innermost element of each text.
    """
    path_hash = _Hash()
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            rows: list[tuple] = []
            for host, html in zip(batch.column(0)[a : a + 200].to_pylist(), batch.column(1)[a : a + 200].to_pylist(), strict=True):
                if host is None or not html:
                    continue
                page = Page(html)
                styles: dict[str, list] = {}
                for path, style, kinds, named in page.styles:
                    held = styles.setdefault(path, ["", 0, False])
                    held[0] += style + ";"
                    held[1] = max(held[1], kinds)
                    held[2] |= named
                texts: dict[tuple[int, int], int] = {}
                places: set[tuple[int, int]] = set()
                for text, paths, *_ in page.blocks:
                    value = _Hash()(text)
                    for path in paths:
                        key = (path_hash(path), value)
                        texts[key] = len(text)
                    if paths:
                        places.add(key)
                content = _Hash()(page.content())
                rows += [(host, path_hash(p), True, path_hash(s), k, None if "/" in p[1:] else content, named) for p, (s, k, named) in styles.items()]
                rows += [(host, p, False, v, n, content if (p, v) in places else None, False) for (p, v), n in texts.items()]
            if rows:
                names = ["host", "path", "is_style", "value", "size", "content", "named"]
                types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _node_sums(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Sums that nodes are measured by: one row per host and path, and one more per short text on several contents.

    Such a text is in ``text``, with the number of distinct contents that it stands in; the rows of a
    path add up. Elements have the largest number of contents of their child sequences.
    """
    seen = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(
        _observations, "host string, path bigint, is_style boolean, value bigint, size bigint, content bigint, named boolean"
    )
    counts = seen.groupBy("host", "path", "is_style", "value").agg(
        F.count("*").alias("c"), F.sum("size").alias("size"), F.count_distinct("content").alias("contents"), F.max("named").alias("named")
    )
    spread = F.col("c") * F.log(F.col("c").cast("double"))
    short = ~F.col("is_style") & (F.col("contents") >= MIN_PAGES) & (F.col("size") < F.col("c") * LONG_CHARS)
    return counts.groupBy("host", "path", F.when(short, F.col("value")).alias("text")).agg(
        F.sum(F.when(F.col("is_style"), F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("is_style"), spread)).alias("style_sum"),
        F.sum(F.when(F.col("is_style"), F.col("size"))).alias("kinds"),
        F.coalesce(F.sum(F.when(~F.col("is_style"), F.col("c"))), F.lit(0)).alias("texts"),
        F.coalesce(F.sum(F.when(~F.col("is_style"), spread)), F.lit(0.0)).alias("text_sum"),
        F.coalesce(F.sum(F.when(~F.col("is_style"), F.col("size"))), F.lit(0)).alias("chars"),
        F.sum(F.when(F.col("is_style") | short, F.col("contents"))).alias("contents"),
        F.max("named").alias("named"),
    )


def _importance(parts: DataFrame) -> DataFrame:
    names = ("pages", "style_sum", "kinds", "texts", "text_sum", "chars")
    sums = parts.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in names), F.max("named").alias("named"))
    base = F.log(F.col("pages").cast("double"))
    several = F.col("pages") > 1
    presentation = F.when(several, (base - F.col("style_sum") / F.col("pages")) / base).otherwise(1.0)
    content = F.when(several & (F.col("texts") > 0), 1 - F.col("text_sum") / F.col("texts") / base).otherwise(1.0)
    weight = F.pow(F.lit(ATTENUATION), F.greatest(F.col("kinds") / F.col("pages"), F.lit(1.0)))
    return sums.select("host", "path", "pages", "named", presentation.alias("presentation"), content.alias("content"), weight.alias("weight"), (F.col("chars") / F.col("pages")).alias("chars")).withColumn(
        "importance", (1 - F.col("weight")) * F.col("presentation") + F.col("weight") * F.col("content")
    )


def style_trees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The merged trees of all hosts: host, path (hash), pages, named, presentation, content, importance, chars.

    presentation: entropy of the child sequences, content: one minus the mean entropy of the texts, both
    with the logarithm to the base of the number of pages; 1 for a node on one page. Statistics cover all
    pages with a host and a text; pages of one host are spread over tasks by their nodes and texts.
    """
    return _importance(_node_sums(pages, url, html))


def _low_nodes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, node): paths of low importance, named paths of high importance, and texts in places that most contents of their host have."""
    parts = cut_lineage(_node_sums(pages, url, html))
    nodes = _importance(parts)
    held = nodes.where(F.col("named") & (F.col("pages") >= MIN_PAGES) & (F.col("importance") * NAMED >= THRESHOLD) & (F.col("chars") > 0))
    low = nodes.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < THRESHOLD) & (F.col("chars") < LONG_CHARS))
    hosts = parts.where("text is null").groupBy("host").agg(F.max("contents").alias("all_contents"))
    common = parts.where("text is not null").join(hosts, "host").where(F.col("contents") > F.col("all_contents") * MOST)
    spoken = held.select("host", F.col("path").bitwiseXOR(F.lit(SPOKEN)).alias("node"))
    return low.select("host", F.col("path").alias("node")).unionByName(spoken).unionByName(common.select("host", F.col("path").bitwiseXOR(F.col("text")).alias("node")))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """(key, url, text) per row: the main text, blocks in page order joined by line breaks; empty if there is none.

    Null pages count as empty. Pages without a host in their URL are cleaned by what their elements say of
    themselves only. Repeated rows are pages like any others. Other columns are not carried along.
    """
    low = cut_lineage(_low_nodes(pages, url, html).groupBy("host").agg(F.collect_set("node").alias("low")))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html")).withColumn("_host", host_of(F.col("url")))
    size = low.agg(F.sum(F.size("low")), F.count("*")).first()
    if (size[0] or 0) <= BROADCAST_NODES and size[1] <= BROADCAST_NODES:
        joined = rows.join(F.broadcast(low), F.col("_host") == F.col("host"), "left")
    else:
        salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = rows.withColumn("_at", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, (F.col("_host") == F.col("host")) & (F.col("_at") == F.col("_salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_hash = _Hash()
        held: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = []
                for page, low_paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    found = tuple(low_paths or ())
                    if found not in held:
                        if len(held) > 1000:
                            held.clear()
                        held[found] = frozenset(found)
                    texts.append(Page(page, held[found], path_hash).text() if page else "")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "url")}
    out = joined.select("key", "url", "html", "low").mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), F.col("text").alias(name))
