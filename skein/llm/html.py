"""Main text of web pages, without what a site repeats.

A page's elements are hashed from their names and content, like a Merkle tree, together with their
slot: the host and the names and classes of the elements around them. Spark counts on how many
pages of its host a subtree occurs. Subtrees that recur in a slot whose content mostly recurs (a
menu in several versions, say), or on most of the host's pages, are the site's template, and all
their text goes, whatever they are called and wherever they are, in the article too. A paragraph
that several articles share stays: what else is in its slot does not recur. What templates can't
tell, as on hosts with few pages, goes by the elements' names and classes; and where articles hold
most of what is left, the rest of the page goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass
from html import unescape

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import broadcast_if_small, checkpointed, fresh, map_rows, table
from skein.llm.hosts import host

#: A subtree recurs if so many of a host's pages have it; it is a template if more than this share of its slot's subtrees recur, or of the host's pages have it.
SHARE = 0.5
MIN_PAGES = 5
#: Templates go to all tasks if they have at most so many keys (8 bytes each) in all.
BROADCAST_KEYS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Their content is never main text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu title noembed noframes audio video map".split())
#: Elements within a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of a class, id or role that tell of something other than the article.
NOTICE = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended footer widget toolbar pagination pager contentinfo complementary search masthead alert notification disclaimer".split()
)
#: The same for what readers wrote.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words that name a subject as well, when an article's heading or section has them.
AMBIGUOUS = frozenset("ad ads alert banner comment comments consent cookie cookies disclaimer discussion login menu navigation newsletter notice notification popup privacy promotion reply replies related response search share sharing sidebar social sponsor sponsored subscription".split())
_TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Words of a class beside an ambiguous one that say nothing of a subject (share-bar, but not share-price).
LAYOUT = frozenset("area bar block body bottom box btn button buttons card container content footer form group header icon icons inner input item items left link links list main message panel post posts row section slot small teaser text title toggle top right unit wrap wrapper".split())
#: An element that begins where one of these is open ends it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_MAIN = ("article", "main")
_WHOLE = frozenset(("html", "body", "article", "main"))
#: Short parts of an article, which recur by chance; what holds them is counted.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th caption".split())
_NUMBER = re.compile(r"[0-9]+")


def _told(value: str) -> set[str]:
    """The words of a class or role inside an article, without ambiguous ones that another word gives a subject (search-story)."""
    found: set[str] = set()
    for name in value.lower().split():
        words = set(_WORD.findall(name))
        plain = {w for w in words if w in LAYOUT or w in NOTICE or w in COMMENTS or w.isdigit()}
        found |= words if words == plain else words - (AMBIGUOUS - COMMENTS)
    return found


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape("".join(value)))
    return found


class _Node:
    """dropped: 0, 1 (by a word of a class, which may name a layout around the article), or 2 (for good). key: 0 if it isn't counted."""

    __slots__ = ("tag", "parent", "dropped", "main", "slot", "parts", "key")

    def __init__(self, tag: str, parent: _Node | None, dropped: int, main: bool, slot: int) -> None:
        self.tag, self.parent, self.dropped, self.main, self.slot, self.parts, self.key = tag, parent, dropped, main, slot, [], 0


@dataclass(frozen=True)
class Block:
    """A run of text inside element; dropped if an element's name or class tells that it isn't main text; main in an article."""

    text: str
    element: _Node
    dropped: bool
    main: bool


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(page: str, host_name: str = "") -> tuple[list[_Node], list[Block]]:
    """(elements whose subtrees are counted, each with key and slot; blocks of text in the page's order).

    Scripts, styles and the like give neither. Markup may be unfinished: what is open at the end
    closes there, and an end tag closes what is open inside it. Every step looks at the top of the
    stack only, so that deep nesting costs no more than its length.
    """
    digest = xxhash.xxh64_intdigest
    root = _Node("", None, 0, False, digest(host_name.encode("utf-8", "surrogatepass")))
    stack, counted = [root], []
    opened: Counter[str] = Counter()
    blocks: list[Block] = []
    runs: tuple[list[str], list[str]] = ([], [])  # of main text, and of dropped text
    owner: list[_Node] = [root, root]

    def flush() -> None:
        for gone in (0, 1):
            if runs[gone]:
                text = " ".join("".join(runs[gone]).split())
                if text:
                    blocks.append(Block(text, owner[gone], bool(gone), owner[gone].main))
                runs[gone].clear()

    def text(raw: str) -> None:
        top = stack[-1]
        value = unescape(raw) if "&" in raw else raw
        top.parts.append(value)
        gone = 1 if top.dropped else 0
        if not runs[gone]:
            owner[gone] = top if top.tag not in INLINE else next(n for n in reversed(stack) if n.tag not in INLINE)
        runs[gone].append(value)

    def close() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        content = " ".join("".join(node.parts).split())
        node.parts.clear()
        if node.tag in INLINE:
            stack[-1].parts.append(content)
            return
        flush()
        if content:
            h = digest(content.encode("utf-8", "surrogatepass"), node.slot)
            stack[-1].parts.append(f" {h} ")
            if node.tag not in _WHOLE and not (node.main and node.tag in _PARTS):
                node.key = _signed(h)
                counted.append(node)

    def close_through(tag: str) -> None:
        while stack[-1].tag != tag:
            close()
        close()

    at = 0
    while (start := page.find("<", at)) >= 0:
        m = _TOKEN.match(page, start)
        if m is None:  # not a tag
            text(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text(page[at:start])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag] > 0:
                close_through(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _BLOCK_ENDS_P and opened["p"] > 0:
            close_through("p")
        if tag in _CLOSES and stack[-1].tag in _CLOSES[tag]:
            close()
        if tag not in INLINE:
            flush()
        attributes = _attributes(m[3]) if m[3] else {}
        top = stack[-1]
        inside = top.main
        judged = ("class", "role") if inside else ("class", "id", "role")
        named = {w for x in judged if x in attributes for w in (_told(attributes[x]) if inside else _WORD.findall(attributes[x].lower()))}
        if inside and tag in _TITLED:
            named -= AMBIGUOUS
        above = top.dropped
        # A form around everything holds the article, as other elements that notices are in do.
        form = tag == "form" and not inside
        if (tag in DROPPED and not form) or (tag == "header" and not inside) or not COMMENTS.isdisjoint(named) or "hidden" in attributes or _UNSEEN.search(attributes.get("style", "")):
            out = 2
        elif form or (tag not in ("html", "body") and not NOTICE.isdisjoint(named)):
            out = 1
        else:
            out = 0
        if tag in _MAIN and not inside and above < 2:
            above = 0
        name = tag if tag in _WHOLE else f"{tag}.{_NUMBER.sub('#', attributes.get('class', '').lower())}"
        slot = top.slot if tag in INLINE else digest(name.encode("utf-8", "surrogatepass"), top.slot)
        stack.append(_Node(tag, top, max(above, out), inside or (tag in _MAIN and not out), slot))
        opened[tag] += 1
    if at < len(page):
        text(page[at:])
    while len(stack) > 1:
        close()
    flush()
    return counted, blocks


def chosen(blocks: list[Block], gone: Container[int] = frozenset()) -> tuple[list[str], int]:
    """(texts of the main blocks, number of blocks inside elements whose keys are in gone).

    First all blocks of templates go, then those that names and classes drop. If what is left in
    articles is at least half of all that is left, it is the main text; else all of it is.
    """
    inside_template: dict[_Node, bool] = {}

    def removed(node: _Node) -> bool:
        path = []
        while node is not None and node not in inside_template:
            path.append(node)
            if node.key and node.key in gone:
                break
            node = node.parent
        found = node is not None and (inside_template[node] if node in inside_template else True)
        for n in path:
            inside_template[n] = found
        return found

    left = [b for b in blocks if not (gone and removed(b.element))]
    n_removed = len(blocks) - len(left)
    left = [b for b in left if not b.dropped]
    within = sum(len(b.text) for b in left if b.main)
    if 2 * within >= sum(len(b.text) for b in left):
        left = [b for b in left if b.main] or left
    return [b.text for b in left], n_removed


def templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """columns h, host, html to (key: subtrees that are templates; h, keys array<long>: the pages' subtrees).

    A subtree recurs if it is on min_pages pages of its host at least. It is a template if more
    than share of its slot's different subtrees recur, or if it is on more than share of the host's
    pages. Pages of one host whose longest blocks of main text are equal (copies, that is) count as
    one. Counts are summed before they are shuffled.
    """

    def hashed(hosts: list[str], values: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"of_host": [], "main": [], "subtrees": [], "html": [None] * len(values)}
        for name, value in zip(hosts, values):
            counted, blocks = parse(value or "", name)
            out["of_host"].append(_signed(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))))
            longest = max(chosen(blocks)[0], key=lambda t: (len(t), t), default="")
            out["main"].append(_signed(xxhash.xxh64_intdigest(longest.encode("utf-8", "surrogatepass"))))
            out["subtrees"].append([{"slot": _signed(s), "key": k} for k, s in {n.key: n.slot for n in counted}.items()])
        return out

    seen = map_rows(pages.select("h", "host", "html"), ["host", "html"], "of_host long, main long, subtrees array<struct<slot long, key long>>, html string", hashed)
    seen = checkpointed(seen.select("h", "of_host", "main", "subtrees"))
    n_pages = seen.select("of_host", "main").distinct().groupBy("of_host").agg(F.count(F.lit(1)).alias("pages"))
    once = seen.select("of_host", "main", F.inline("subtrees")).distinct()
    counts = checkpointed(once.groupBy("of_host", "slot", "key").agg(F.count(F.lit(1)).alias("n")))
    recurs = F.col("n") >= min_pages
    of_slot = counts.groupBy("of_host", "slot").agg(F.count(F.lit(1)).alias("distinct"), F.count_if(recurs).alias("recurring")).filter("recurring > 0")
    met = counts.filter(recurs).join(of_slot, ["of_host", "slot"]).join(broadcast_if_small(n_pages, F.lit(2), BROADCAST_KEYS), "of_host")
    found = met.filter((F.col("recurring") > share * F.col("distinct")) | (F.col("n") > share * F.col("pages"))).select("key").distinct()
    return found, seen.select("h", F.col("subtrees.key").alias("keys"))


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text", share: float = SHARE, min_pages: int = MIN_PAGES, removed_col: str | None = None, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """pages with out, the main text of html_col; every row and column stays.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined in the page's order by one space. A null or empty page, or one without text, has the
    empty text. Pages of a null url or one without :// share one host, the empty one. A column
    named out is replaced; so is removed_col, if given: how many of the page's blocks were in templates.

    Templates go to all tasks if they have at most broadcast_keys keys (8 bytes each), and pages
    stay where they are; else each page meets its own templates in a join by a hash of the page,
    so that no host is a hot key. The result is the same.
    """
    added = [out, *([removed_col] if removed_col else [])]
    placed = fresh(pages, *added, "__host", "__h", "__gone").withColumns({"__host": host(F.col(url_col)), "__h": F.xxhash64(url_col, html_col)})
    found, keys = templates(placed.select(F.col("__h").alias("h"), F.col("__host").alias("host"), F.col(html_col).alias("html")), share, min_pages)
    found = checkpointed(found)
    types = f"{out} string" + (f", {removed_col} long" if removed_col else "")

    def made(texts: list[str], n: int) -> tuple:
        return (" ".join(texts), n)[: len(added)]

    if found.count() <= broadcast_keys:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(found.toArrow().column("key").to_pylist()))
        rows = map_rows(placed, ["__host", html_col], types, lambda h, x: dict(zip(added, map(list, zip(*[made(*chosen(parse(v or "", k)[1], shared.value)) for k, v in zip(h, x)])))))
    else:
        own = keys.distinct().select("h", F.explode("keys").alias("key")).join(found, "key").groupBy(F.col("h").alias("__h")).agg(F.collect_set("key").alias("__gone"))
        met = placed.join(own, "__h", "left")
        rows = map_rows(met, ["__host", html_col, "__gone"], types, lambda h, x, g: dict(zip(added, map(list, zip(*[made(*chosen(parse(v or "", k)[1], frozenset(y or ()))) for k, v, y in zip(h, x, g)])))))
    return rows.select(*[c for c in pages.columns if c.lower() not in {a.lower() for a in added}], *added)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, and how many of its blocks were its site's."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), removed_col="n_template_blocks")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template_blocks")
