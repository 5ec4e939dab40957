"""Main text of web pages by consensus paths of each host.

Each page's containers are scored by the clean text they hold against text in menus, adverts and
the like. A container's path is its tags with their generalised classes (digits become #). Pages
vote for paths, the votes are summed by host in Spark, and every page is read again with its
host's winning path; a page without that path falls back to its own best container.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, cut

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Fixed tag lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
DROPPED = frozenset("script style noscript template textarea title iframe xmp head nav footer aside form select option button svg math canvas object dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body".split())
CLOSES_P = BLOCK - frozenset(("br", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"))
#: Fixed word lists of classes and ids: page furniture anywhere, only outside articles, and words beside them.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments commentlist replies respond disqus subscribe newsletter signup pagination pager".split())
OUTSIDE = frozenset("side notice notification alert header share sharing social promo promos promotion related recommended login search skip".split())
BESIDE = frozenset("area aside bar block bottom box buttons container content footer form global group header inner item items left link links list main outer page primary right secondary section site top widget wrap wrapper".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: A block of so many links or more that hold so much of its text is a menu.
MENU, MENU_LINKS, MENU_SHARE = frozenset("div section table tbody tr td ul ol li dl dd center".split()), 3, 0.75
#: Votes of a tag for equal text.
WEIGHT = {"article": 1.3, "main": 1.15, "section": 1.0, "div": 1.0, "td": 0.9, "body": 0.8}


class Node:
    __slots__ = ("depth", "dropped", "inside", "path", "pieces", "tag")

    def __init__(self, tag: str, path: int, depth: int, dropped: bool, inside: bool):
        self.tag, self.path, self.depth, self.dropped, self.inside, self.pieces = tag, path, depth, dropped, inside, []


def _step(path: int, name: str) -> int:
    """The path below `path`, as a 64-bit hash, so that deep pages stay linear."""
    return int.from_bytes(hashlib.blake2b(path.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _furniture(names: str, inside: bool) -> bool:
    """Whether a class or id names furniture: all parts of one of its words do, or stand beside."""
    for word in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", word) if x]
        named = [x in FURNITURE or not inside and x in OUTSIDE for x in parts]
        if any(named) and all(n or x in BESIDE for n, x in zip(named, parts, strict=True)):
            return True
    return False


def _noisy(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is page furniture, and its generalised class."""
    noisy = tag in DROPPED or tag == "header" and not inside
    if not attributes:
        return noisy, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    kind = re.sub(r"\d+", "#", " ".join(sorted(found.get("class", "").lower().split())))
    noisy = noisy or "hidden" in found or found.get("role", "").lower() in _NOISE_ROLE
    if not noisy and tag not in ("body", "html", "main", "article"):
        noisy = _furniture(found.get("class", ""), inside) or _furniture(found.get("id", ""), inside)
    return noisy, kind


def parse(html: str) -> Node:
    """Tree of elements; pieces are texts, child nodes, or None for a line break."""
    root = Node("html", 0, 0, False, False)
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, n = 0, len(html)
    while at < n:
        opening = html.find("<", at)
        if opening < 0:
            stack[-1].pieces.append(html[at:])
            break
        if opening > at:
            stack[-1].pieces.append(html[at:opening])
        m = _TOKEN.match(html, opening)
        if m is None:  # a lone < is text
            stack[-1].pieces.append("<")
            at = opening + 1
            continue
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] is not None:
                stack[-1].pieces.append(m[1].replace("&", "&amp;"))
            continue
        if m[2] or m[5]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "td", "body") and tag not in ("html", "body", "article", "main", "section", "div", "table", "tr"):
                    break  # a stray end tag closes nothing beyond
            continue
        if tag in VOID:
            stack[-1].pieces.append(None)
            continue
        if tag == "html" or tag == "body" and opened["body"] > 0:
            continue
        if tag == "body":
            close(1)
        if tag in CLOSES_P or tag in ("p", "li", "dd", "dt", "tr", "td", "th"):
            closing = ("p",) if tag in CLOSES_P and tag not in ("li", "dd", "dt") else {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, ("p",))
            if any(opened[x] > 0 for x in closing):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closing:
                        close(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
        inside = opened["article"] > 0
        noisy, kind = _noisy(tag, m[4] or m[7] or "", inside)
        up = stack[-1]
        held = tag in CONTAINER
        node = Node(tag, _step(up.path, f"{tag}.{kind}") if held else up.path, up.depth + held, up.dropped or noisy, inside)
        up.pieces.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if (m[4] or m[7] or "").endswith("/") and tag not in BLOCK:
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def text_of(node: Node) -> str:
    """Clean text: blocks in page order, white space inside a block as one space, joined by one space."""
    parts: list[str] = []
    todo: list = [iter(node.pieces)]
    ends: list[bool] = [False]
    while todo:
        x = next(todo[-1], todo)
        if x is todo:
            todo.pop()
            if ends.pop():
                parts.append(" ")
        elif x is None:
            parts.append(" ")
        elif isinstance(x, str):
            parts.append(x)
        elif not x.dropped:
            wide = x.tag in BLOCK
            if wide:
                parts.append(" ")
            todo.append(iter(x.pieces))
            ends.append(wide)
        elif x.tag in BLOCK or x.tag in DROPPED:
            parts.append(" ")
    return " ".join(unescape("".join(parts)).split())


def containers(root: Node) -> list[tuple[Node, int, int]]:
    """(node, clean characters, characters of furniture and links) of each container that is kept, in
    page order. Blocks outside articles that are mostly links are dropped: menus that nothing marks."""
    order: list[Node] = []
    kids: dict[int, list[Node]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        kids[id(node)] = below = [x for x in node.pieces if isinstance(x, Node)]
        todo += reversed(below)
    # text that is kept, text of links in it, how many links, text that is dropped
    clean, linked, links, noise = ({} for _ in range(4))
    for node in reversed(order):
        me, below = id(node), kids[id(node)]
        own = sum(len(x.strip()) for x in node.pieces if isinstance(x, str))
        clean[me] = (0 if node.dropped else own) + sum(clean[id(x)] for x in below)
        noise[me] = (own if node.dropped else 0) + sum(noise[id(x)] for x in below)
        is_link = node.tag == "a" and not node.dropped
        linked[me] = clean[me] if is_link else sum(linked[id(x)] for x in below)
        links[me] = 1 if is_link else sum(links[id(x)] for x in below)
        if node.tag in MENU and not node.inside and not node.dropped and links[me] >= MENU_LINKS and linked[me] >= MENU_SHARE * clean[me]:
            node.dropped = True
            noise[me], clean[me], linked[me], links[me] = noise[me] + clean[me], 0, 0, 0
    for node in order:  # what is below a dropped block goes with it
        if node.dropped:
            for x in kids[id(node)]:
                x.dropped = True
    return [(x, clean[id(x)] - linked[id(x)], noise[id(x)] + linked[id(x)]) for x in order if x.tag in CONTAINER and not x.dropped and clean[id(x)]]


def votes(root: Node) -> dict[int, tuple[float, int]]:
    """Vote and depth of each path: the share of the page's text that its containers hold, less where
    furniture and links are in them. Paths below a fifth of the page's best have no vote."""
    found = containers(root)
    whole = max((c for _, c, _ in found), default=0)
    score: dict[int, float] = {}
    depth: dict[int, int] = {}
    for node, clean, noise in found:
        if clean:
            score[node.path] = score.get(node.path, 0.0) + WEIGHT[node.tag] * (clean / whole) * clean / (clean + noise)
            depth[node.path] = node.depth
    top = max(score.values(), default=0)
    return {k: (v / top, depth[k]) for k, v in score.items() if v >= 0.2 * top}


def extract(html: str | None, path: int | None) -> str:
    """Text of the outermost containers on the path; without one, of the page's own best container."""
    if not html:
        return ""
    root = parse(html)
    best = votes(root)  # drops menus too
    found = containers(root)
    hits = [x for x, _, _ in found if x.path == path]
    if not hits and best:
        own = max(best, key=lambda p: (*best[p], p))
        hits = [x for x, _, _ in found if x.path == own]
    if not hits:
        return text_of(root)
    return " ".join(t for t in map(text_of, hits) if t)


#: A host table of at most so many rows is sent to all executors, else joined by a shuffle.
BROADCAST_HOSTS = 50_000


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    In: page_id, url, html; other columns are not read. A null or empty page has the empty text; a
    null url counts as a host of its own; repeated rows stay. Votes are summed before the shuffle,
    so a host with a third of all pages is no larger than another.
    """
    pages = pages.select("page_id", "url", "html").withColumn("_host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))))

    def vote(batches):
        for block in blocks(batches, 8 << 20, "html"):
            hosts, paths, depths, weights = [], [], [], []
            for html, host in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                for path, (weight, depth) in votes(parse(html)).items():
                    hosts.append(host)
                    paths.append(path)
                    depths.append(depth)
                    weights.append(round(weight * 1_000_000))
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(depths, pa.int32()), pa.array(weights, pa.int64())], names=["_host", "path", "depth", "weight"])

    cast = pages.where("html is not null and html <> ''").select("html", "_host").mapInArrow(vote, "_host string, path long, depth int, weight long")
    summed = cast.groupBy("_host", "path").agg(F.sum("weight").alias("weight"), F.max("depth").alias("depth"))
    winners = cut(summed.groupBy("_host").agg(F.max_by("path", F.struct("weight", "depth", "path")).alias("_path")), "hosts")
    small = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = pages.join(F.broadcast(winners) if small else winners, "_host", "left").select("page_id", "url", "html", "_path")

    def again(batches):
        for block in blocks(batches, 8 << 20, "html"):
            texts = [extract(h, p) for h, p in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([block.column(0).cast(pa.int64()), block.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(again, "page_id long, url string, text string, n_chars long")
