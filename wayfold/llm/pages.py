"""Main text of web pages: site template removal by recurring element subtrees, then structural rules.

Pages are parsed leniently (unclosed and misnested tags, truncated pages). Each block element with text is a subtree,
known by two hashes: of its content (tags and text), and of its skeleton (tags, classes and the shapes of its children,
runs of like ones as one). Spark counts each over the pages of a host. A subtree is template, and deleted, if

* it lies outside ``article`` and ``main``, and its content is on ``common`` pages or more and ``share`` of the host's, or
* it lies outside them, half of its text or more is in links, and its skeleton recurs as often, or
* it lies inside them, and its content is on nearly all pages (``share_inside``): articles may share passages.

Where that would take most of a page's text, only the subtrees of links go: such a page is one of several copies, not
all template. Then parts go that are never main text by their element, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments), as the template can't tell on hosts of few pages, and
so does what lies outside ``article`` or ``main``, where a page has such with text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th option img".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label map math menu meter nav noembed noframes noscript object optgroup option"
    " output progress script search select style svg template textarea title video xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promoted sidebar rail menu menus nav"
    " navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations toolbar pagination"
    " pager widget widgets masthead topbar skip paywall tracking".split()
)
#: Elements that are never template as a whole.
KEPT = frozenset("article body html main".split())
_OPEN_P = frozenset(BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend", "figcaption", "summary"})
#: An element that opens closes an open one of these, unless a wall stands between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Node:
    """An open element: its hashes so far, how much text it holds, and how much of that is in links."""

    __slots__ = ("tag", "out", "main", "id", "h", "shape", "last", "chars", "linked", "link")

    def __init__(self, tag: str, out: bool, main: bool, number: int, names: str = "", link: bool = False):
        self.tag, self.out, self.main, self.id, self.link = tag, out, main, number, link
        self.h, self.shape, self.last = hash_of(tag), hash_of(f"{tag}.{names}"), 0
        self.chars = self.linked = 0


#: Kinds of counted subtrees.
OUTSIDE, LINKS, INSIDE = range(3)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _left_out(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside_main:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, a, b, c, hidden in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if hidden or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            words = {x.lower() for x in _NAMES.findall(value)}
            if words & WORDS or "header" in words and not inside_main:
                return tag != "article" or bool(words & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"})
    return False


def parsed(html: str) -> tuple[list[tuple[str, list[int], bool]], dict[int, tuple[int, int, int, bool, int]]]:
    """(blocks, subtrees) of a page. A block that structure doesn't rule out: (text, its elements' numbers from outside, in main).

    A subtree by its number: (content, shape, parent, in main, characters; the last below 0 if most are in links), hashes signed.
    """
    trees: dict[int, tuple[int, int, int, bool, int]] = {}
    count = 1
    stack = [_Node("", False, False, 0)]
    found: list[tuple[str, list[int], bool]] = []
    parts: list[str] = []
    where: list[_Node] = stack[:]

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, [x.id for x in where[1:]], where[-1].main))

    def close(upto: int):
        nonlocal where
        while len(stack) > upto:
            node, top = stack.pop(), stack[-1]
            top.h = hash_of(f"{top.h},{node.h}")
            if node.shape != top.last:
                top.shape = hash_of(f"{top.shape},{node.shape}")
                top.last = node.shape
            top.chars += node.chars
            top.linked += node.linked
            if node.tag in BLOCKS:
                if node.chars and node.tag not in KEPT:
                    trees[node.id] = node.h, node.shape, top.id, node.main, -node.chars if 2 * node.linked >= node.chars else node.chars
                flush()
                where = stack[:]

    def text_at(a: int, b: int):
        nonlocal where
        if b > a:
            top, s = stack[-1], html[a:b]
            if not s.isspace():
                top.h = hash_of(f"{top.h}:{s}")
                top.chars += len(s)
                top.linked += top.link * len(s)
            if not top.out:
                parts.append(s)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text_at(at, n)
            break
        text_at(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in _OPEN_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS or stack[k].tag in ("td", "th"):
                    break
        elif tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in _CLOSES:
            gone, wall = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in wall:
                    break
                if stack[k].tag in gone:
                    close(k)
                    break
        if tag in BLOCKS:
            flush()
        elif tag in SPACED and not stack[-1].out:
            parts.append(" ")
        if tag in VOID:
            stack[-1].h = hash_of(f"{stack[-1].h},{tag}")
            if tag in BLOCKS:
                where = stack[:]
            continue
        top = stack[-1]
        out = top.out or _left_out(tag, m[3], top.main)
        names = " ".join(sorted(x for k, a, b, c, _ in _ATTR.findall(m[3]) if k.lower() == "class" for x in (a or b or c).split())) if m[3] else ""
        node = _Node(tag, out, top.main or tag in ("article", "main") and not out, count, names, top.link or tag == "a")
        count += 1
        stack.append(node)
        if tag in BLOCKS:
            where = stack[:]
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            to = end.start() if end else n
            node.h = hash_of(f"{node.h}:{html[at:to]}")
            at = to
    close(1)
    flush()
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return found, {k: (sign(h), sign(shape), *rest) for k, (h, shape, *rest) in trees.items()}


def _keys(tree: tuple[int, int, int, bool, int]) -> list[tuple[int, int]]:
    """(kind, hash) by which a subtree is counted."""
    content, shape, _, inside, chars = tree
    return [(INSIDE, content)] if inside else [(OUTSIDE, content), (LINKS, shape)] if chars < 0 else [(OUTSIDE, content)]


def main_text(html: str, gone: set[tuple[int, int]]) -> tuple[str, int, int]:
    """(text, template subtrees deleted, blocks in them) of a page, ``gone`` being its host's template."""
    blocks, trees = parsed(html)
    hit = {k: t for k, t in trees.items() if any(x in gone for x in _keys(t))}
    tops = {k: t for k, t in hit.items() if not _within(t[2], hit, trees)}
    if 2 * sum(abs(t[4]) for t in tops.values()) > sum(abs(t[4]) for t in trees.values() if t[2] not in trees):
        tops = {k: t for k, t in hit.items() if t[4] < 0}
        tops = {k: t for k, t in tops.items() if not _within(t[2], tops, trees)}
    left = [x for x in blocks if tops.keys().isdisjoint(x[1])]
    n = len(blocks) - len(left)
    if any(main for _, _, main in left):
        left = [x for x in left if x[2]]
    return "\n\n".join(t for t, _, _ in left), len(tops), n


def _within(k: int, some: dict, trees: dict) -> bool:
    """Whether subtree k or one around it is in ``some``."""
    while k in trees:
        if k in some:
            return True
        k = trees[k][2]
    return False


def _counted(batches):
    """Each page's host with the subtrees by which it counts."""
    kind = pa.list_(pa.struct([("kind", pa.int8()), ("h", pa.int64())]))
    for whole in batches:
        for b in common.slices(whole, "html"):
            keys = [sorted({x for t in parsed(x or "")[1].values() for x in _keys(t)}) for x in b.column(b.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("host")), pa.array([[{"kind": k, "h": h} for k, h in x] for x in keys], kind)], ["host", "keys"])


def _texts(batches):
    """Each page's text without its host's template."""
    for whole in batches:
        for b in common.slices(whole, "html"):
            rows = [main_text(html or "", {(x["kind"], x["h"]) for x in gone or ()}) for html, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            texts, trees, blocks = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in ([len(x) for x in texts], trees, blocks)]],
                ["page_id", "url", "text", "n_chars", "n_template", "n_removed"],
            )


def template(pages: DataFrame, *, common_pages: int = 2, share: float = 0.3, share_inside: float = 0.9) -> DataFrame:
    """Of (host, html): (host, gone), the subtrees (kind, h) that recur on the host's pages as the module says.

    A host's template has hardly more subtrees than a page has elements, as each is on a good part of the pages. Counts
    are added up before the shuffle; a hot host's are spread by the hash.
    """
    trees = common.arrow_map(pages, _counted, "host string, keys array<struct<kind: tinyint, h: bigint>>").select("host", F.explode("keys").alias("k"))
    sizes = pages.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    counts = trees.groupBy("host", "k").count().filter(F.col("count") >= common_pages)
    part = F.when(F.col("k.kind") == INSIDE, F.lit(share_inside)).otherwise(F.lit(share))
    # articles that are all of a host's few pages aren't told from template: nearly all pages are four at least
    enough = (F.col("k.kind") != INSIDE) | (F.col("count") > 3)
    often = counts.join(sizes, F.col("host") == F.col("_host")).filter(enough & (F.col("count") >= part * F.col("_pages")))
    return often.groupBy("host").agg(F.collect_list("k").alias("gone"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_removed) of each row: blocks joined by two line feeds, and what the template took.

    n_template: template subtrees deleted, n_removed: blocks in them that structure alone would have left. A null html
    is empty: its text is ''. The host is the url's, in lower case ('' for none). Repeated rows count as pages each and
    get the same text. An empty table gives an empty result; other columns don't matter. Pages are parsed twice, which
    costs less than keeping their blocks; the template is a table of its own, which Spark broadcasts if its size allows.
    """
    url = F.col(url_col)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    p = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    gone = common.staged(template(p.select("host", "html"), **options), "template")
    d = p.join(gone, "host", "left").select("page_id", "url", "html", "gone")
    return common.arrow_map(d, _texts, f"page_id {dict(p.dtypes)['page_id']}, url string, text string, n_chars bigint, n_template bigint, n_removed bigint")
