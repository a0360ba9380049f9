"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: a node stands for all elements with the same path of tags and
classes. Over the m pages that have it, a node has

- content features: the phrases of its own text. One found on k pages has the entropy log k / log(m + PRIOR),
  0 for a phrase of one page and near 1 for one that is everywhere; content importance of a branch is
  1 minus the mean entropy of the features in it,
- presentation styles: the sequences of its child elements. Its presentation importance is their entropy.

A branch's importance is the greater of both. Branches up to LOW are the site's, not the page's, and go from each page,
inside articles as outside. PRIOR stands for pages not seen, so that few pages are weak evidence.
Roles only help: what is no article on any page (nav, footer, form, advert classes) goes even where menus
and adverts vary too much, or pages are too few, for entropies to tell.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Set

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import id_type, small, table, written

#: Pages added to those seen, and the importance up to which a branch goes: its average phrase is on the square root of all pages.
PRIOR, LOW = 16, 0.5
#: The share of a page's text above which a path is what the page is about.
MOST = 0.8
#: Levels of a tree; what lies deeper counts as part of its ancestor there.
DEPTH = 64
#: Rows (numbers of copies; hosts' low nodes) up to which they are broadcast; beyond, pages meet them by key and a salt.
BROADCAST, SALTS = 500_000, 16

#: A value is quoted only right behind its equals sign; a stray quote is part of a name or value, as in browsers.
_PAIR = r"(?:[^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?![\"'])[^\s>]*))?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_PAIR})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
#: Raw text elements: nothing in them is markup until their end tag.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "caption", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements without importance by their role.
_UNSEEN = {"head"} | _RAW
_NONE = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "audio", "video", "object", "input", "label"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|footer|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|pagination|pager|widget)(?:$|[\s_-])",
    re.I,
)
_LOOKED_AT = {"class", "id", "role", "hidden", "aria-hidden", "itemprop", "itemtype"}
#: A class of these says something of the page's layout, not what the element is: has-sidebar, no-nav.
_MODIFIER = re.compile(r"(?:has|no|with|without)[_-]", re.I)
#: What names a section of reader comments or one of them.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|commentlist|disqus|respond|replies|responses)(?:$|[\s_-])", re.I)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")
_PHRASE = re.compile(r"[.,;:!?|\u00b7\u2022()\[\]\n\r\u2026\u2014]+")


class Node:
    """An element. `path` is a number for the path of tags and classes to it, made from its parent's."""

    __slots__ = ("tag", "path", "depth", "none", "word", "readers", "children", "parent", "block")

    def __init__(self, tag: str, name: str, none: bool, parent: Node | None):
        self.tag, self.none, self.word, self.readers, self.parent, self.children = tag, none, False, False, parent, []
        self.block = self if tag in _BLOCK else parent.block if parent else None  # the block that it is or lies in
        self.depth = parent.depth + 1 if parent else 0
        if parent is None:
            self.path = 0
        else:
            self.path = parent.path if self.depth > DEPTH else xxhash.xxh64_intdigest(f"{parent.path}/{name}") - (1 << 63)


def parse(text: str, roles: bool = True) -> Node:
    """The page as a tree; children are nodes or strings. Unclosed elements end where HTML lets them or at their parent's end.

    Without `roles` only what is never text (head, scripts, styles) lacks importance.
    """
    root = node = Node("", "", False, None)
    at, end, worded = 0, len(text), False
    opened: Counter[str] = Counter()  # tags of the elements that are open, so that an end tag without one costs nothing

    def left(last: Node) -> Node:
        """Close elements up to `last`; its parent is open then."""
        up = node
        while True:
            opened[up.tag] -= 1
            if up is last:
                return up.parent
            up = up.parent

    while at < end:
        m = _TOKEN.search(text, at)
        if m is None:
            node.children.append(text[at:])
            break
        if m.start() > at:
            node.children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = left(up)
            continue
        if tag in _BLOCK:  # an open paragraph ends at any block
            closing = _CLOSES.get(tag, {"p"}) | {"p"}
            while node.block is not None and node.block.tag in closing:
                node = left(node.block)
        attrs = m[3]
        name, none, word, readers = tag, tag in (_NONE if roles else _UNSEEN), False, False
        seen: set[str] = set()
        for a in _ATTRIBUTE.finditer(attrs):
            kind, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if kind in seen or kind not in _LOOKED_AT:
                continue  # the first of equal names counts
            seen.add(kind)
            if kind == "class":
                name = f"{tag}.{'.'.join(sorted(value.split()))}"
            if not roles:
                continue
            none = none or kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "role" and value.lower() in _ROLES
            if kind in ("class", "id") and tag not in ("html", "body"):
                named = [v for v in value.split() if not _MODIFIER.match(v)]
                word = word or tag not in ("article", "main") and any(map(_WORDS.search, named))
                readers = readers or any(map(_READERS.search, named))
            readers = readers or kind == "itemprop" and value.lower() == "comment" or kind == "itemtype" and value.lower().rstrip("/").endswith("/comment")
        if roles and tag == "header" and not (opened["article"] or opened["main"]):
            none = True
        new = Node(tag, name, none, node)
        new.word, new.readers = word and not none, readers and not none
        worded = worded or new.word or new.readers
        node.children.append(new)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = close.end() if close else end
            continue
        node = new
        opened[tag] += 1
    if worded:
        _judge_words(root)
    return root


def _judge_words(root: Node) -> None:
    """Branches that words of class or id name lose their importance, except those with an article, a main or most of the page's text.

    Reader comments go with the articles in them, if the page has an article or a main element of its own, or they are up to MOST of its text.
    """
    order, todo, theirs = [], [root], set()
    while todo:
        n = todo.pop()
        order.append(n)
        if n.readers or id(n.parent) in theirs:
            theirs.add(id(n))
        todo += [c for c in n.children if isinstance(c, Node) and not c.none]
    own = any(n.tag in ("article", "main") and id(n) not in theirs for n in order)
    held: dict[int, tuple[int, bool]] = {}
    for n in reversed(order):  # children first
        inner = [held[id(c)] for c in n.children if isinstance(c, Node) and not c.none]
        size = sum(x[0] for x in inner) + sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        held[id(n)] = size, n.tag in ("article", "main") or any(x[1] for x in inner)
    total = held[id(root)][0]
    for n in order:
        size, article = held[id(n)]
        n.none = n.none or n.word and not article and 2 * size <= total or n.readers and (own or not article and size <= MOST * total)


def _inner(root: Node) -> list[Node]:
    """Nodes with importance by their roles, parents first."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.none]
    return order


def styles(root: Node) -> Iterator[tuple[int, int, int, list[int] | None]]:
    """(path, kind, code, paths above and itself): for each path on the page its features (kind 0) and its style (kind 1)."""
    phrases: dict[int, set[str]] = {}
    style: dict[int, list[str]] = {}
    above: dict[int, list[int]] = {}
    for n in _inner(root):
        if n is root:
            continue
        if n.path not in above:
            above[n.path] = [n.path] if n.parent is root else [*above[n.parent.path], n.path]
        style.setdefault(n.path, []).append(" ".join(c.tag for c in n.children if isinstance(c, Node) and not c.none))
        for c in n.children:
            if isinstance(c, str) and not c.isspace():
                phrases.setdefault(n.path, set()).update(filter(None, map(str.strip, _PHRASE.split(c))))
    code = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
    for path, found in phrases.items():
        for phrase in found:
            yield path, 0, code(phrase), None
    for path, found in style.items():
        yield path, 1, code("\n".join(found)), above[path]


def _low(root: Node, low: Set[int]) -> set[int]:
    """Which of the paths in `low` go from this page: not those that hold an article, nor html, body, main or over MOST of its text."""
    order = _inner(root)
    held: dict[int, tuple[int, bool]] = {}
    size: dict[int, int] = {}
    kept = set()
    for n in reversed(order):  # children first
        inner = [held[id(c)] for c in n.children if isinstance(c, Node) and not c.none]
        own = sum(x[0] for x in inner) + sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        held[id(n)] = own, n.tag in ("article", "main", "html", "body") or any(x[1] for x in inner)
        if held[id(n)][1]:
            kept.add(n.path)
        elif n.path in low and (n.parent is None or n.parent.path != n.path):
            size[n.path] = size.get(n.path, 0) + own
    total = held[id(root)][0]
    return {path for path, own in size.items() if path not in kept and own <= MOST * total}


def main_text(root: Node, low: Set[int] = frozenset()) -> str:
    """The blocks of the page's articles, else of its main element, else of its body, without branches of no or low importance.

    A path of low importance stays on a page if it holds an article or over MOST of the page's text, as where a host has copies of one page only.
    """
    low = _low(root, low) if low else low
    articles, mains, todo = [], [], [root]
    while todo:
        n = todo.pop()
        if n.none or n.path in low:
            continue
        if n.tag == "article":  # those in it are its parts
            articles.append(n)
            continue
        if n.tag == "main":
            mains.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    tops = articles or mains[:1] or [root]
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if joined := _SPACE.sub(" ", html.unescape("".join(line))).strip():
            blocks.append(joined)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                end()
            elif isinstance(n, str):
                line.append(n)
            elif n.tag == "br":
                line.append(" ")
            elif n is top or not (n.none or n.path in low):
                if n.tag in _BLOCK:
                    end()
                    todo.append(None)
                todo += reversed(n.children)
        end()
    if low and not blocks:
        return main_text(root)
    return "\n".join(blocks)


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _meet(pages: DataFrame, found: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """`pages` with the columns of `found`, at most a row a key. Where it isn't `small`, a key's pages are dealt over all salts."""
    if small:
        return pages.join(F.broadcast(found), keys, "left")
    salted = pages.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], "left").drop("salt")


def importances(pages: DataFrame, prior: int = PRIOR, broadcast: int = BROADCAST, roles: bool = True) -> DataFrame:
    """(host, path, pages, importance) of every node of every host's tree that has text in it, from columns host and html.

    Host is a hash. Pages of a host with the same payload count once together, each as a part. A page is exchanged as
    some 24 bytes a phrase, added up before; no group is gathered.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
        for b in small(batches):
            rows = []
            for host, data, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                part = 1.0 / (copies or 1)
                for path, kind, code, up in styles(parse(data.as_py().decode("utf-8", "replace"), roles)):
                    rows.append((path ^ host, code, [host, *up] if kind else None, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["node", "code", "up", "k"])

    known = pages.where("html is not null and host <> ''").select(F.xxhash64("host").alias("host"), F.col("html").cast("binary").alias("html"), F.xxhash64("html").alias("digest"))
    copies = written(known.groupBy("host", "digest").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    seen = _meet(known, copies, ["host", "digest"], copies.count() <= broadcast).select("host", "html", "copies")
    each = seen.mapInArrow(run, "node long, code long, up array<long>, k double").groupBy("node", "code", "up").agg(F.round(F.sum("k"), 3).alias("k"))
    # a phrase's rows have no `up`, a style's have the host and all paths from the top
    log = F.log(F.greatest("k", F.lit(1.0)))
    node = written(each.groupBy("node", "up").agg(F.count("*").alias("n"), F.sum("k").alias("m"), F.sum(log).alias("log"), F.sum(F.col("k") * log).alias("klog")), "nodes")
    phrases = node.where("up is null").select("node", F.col("n").alias("features"), F.col("log").alias("spread"))
    nodes = node.where("up is not null").select("node", "up", "m", "klog").join(phrases, "node", "left")
    base = F.log(F.col("m") + prior)
    nodes = nodes.select(F.element_at("up", 1).alias("host"), F.element_at("up", -1).alias("path"), F.slice("up", 2, DEPTH).alias("up"), "m", F.coalesce("features", F.lit(0)).alias("features"), F.coalesce(F.col("spread") / base, F.lit(0.0)).alias("entropy"), ((F.log("m") - F.col("klog") / F.col("m")) / base).alias("style"))
    own = F.col("branch") == F.col("path")
    tree = nodes.withColumn("branch", F.explode("up")).groupBy("host", "branch").agg(
        F.sum("features").alias("features"), F.sum("entropy").alias("entropy"), F.max(F.when(own, F.col("style"))).alias("style"), F.max(F.when(own, F.col("m"))).alias("m")
    )
    importance = F.greatest("style", 1 - F.col("entropy") / F.col("features"))
    return tree.where("features > 0").select("host", F.col("branch").alias("path"), F.col("m").alias("pages"), importance.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST, roles: bool = True) -> DataFrame:
    """(id, url, text) of every row; text is "" where a page has none.

    Null html is an empty page, a null or odd url has no host and no tree of its own. Repeated rows stay, but
    copies count as one page of the host; an empty table gives no rows; other columns are ignored. Without `roles`
    the tree alone decides.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", _host("url"))
    low = written(importances(src, broadcast=broadcast, roles=roles).where(F.col("importance") <= LOW).groupBy("host").agg(F.collect_list("path").alias("paths")), "low-nodes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, frozenset[int]] = {}  # of this task's recent hosts
        for b in small(batches, 2):
            texts = []
            for i, (h, host) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                if host not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[host] = frozenset(b.column(4)[i].as_py() or ())
                texts.append(main_text(parse((h.as_py() or b"").decode("utf-8", "replace"), roles), sets[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = src.select("id", "url", F.col("html").cast("binary").alias("html"), F.xxhash64("host").alias("host"))
    few = (low.agg(F.sum(F.size("paths"))).first()[0] or 0) <= broadcast
    return _meet(rows, low, ["host"], few).select("id", "url", "html", "host", "paths").mapInArrow(run, f"id {id_type(pages, id_col)}, url string, text string")


def op8_site_tree(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
