"""Main text of HTML pages with site templates removed.

Each page becomes a tree; every element's subtree is hashed from its tag, its text and its
children.  Spark counts, per host, on how many different pages a subtree occurs, and deletes the
subtrees that recur on a large share of them; boxes outside running text also go when they recur on a
few pages, however many pages the host has.  What menus, adverts, forms and the like are by tag,
role or class name is dropped while the page is read.

The article container (article, main, or a box named like one) is what is kept where a page has one
that holds at least half of the page's paragraph text; else the whole body is.  Inside it only boxes (div, section, lists, tables ...) may be a template, never running
text such as paragraphs and headings, so an article copied to many pages of a host stays whole.

A form or a box with a boilerplate class name that turns out to hold the page's container or most of
its paragraph text is a wrapper and is read as if it had no name.
"""

from __future__ import annotations

import heapq
import html as _html
import itertools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import materialize
from gridweave.operators._joins import broadcast_if_small

#: A subtree is a template on hosts with at least this many different pages, if it is on this share of them; a
#: box outside running text also if it is on this many of them.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Such boxes, unless they hold most of a page's text and more than this many characters (an article with new dates).
BOXES = frozenset("div section ul ol dl table details fieldset figure header hgroup center address".split())
LONG_BOX = 500

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select".split())
DROPPED = frozenset("nav aside footer form button dialog menu head object canvas audio video datalist".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 "
                  "h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre body html article main".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot legend summary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent "
                  "gdpr notice popup modal overlay sidebar widget widgets related recommended share sharing social nav navbar "
                  "navigation menu breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond "
                  "newsletter subscribe signup login toolbar pagination pager skip".split())
#: Class names that begin so tell what an element has or is doing, not what it is.
STATES = frozenset("has with without no is show hide js".split())
MAIN_NAMES = frozenset("article content main post entry story".split())
#: A box is named like an article by a whole name of these, or by a name of several words that ends in one of MAIN_ENDS.
MAIN_ENDS, MAIN_BOXES = frozenset(("content", "body")), frozenset("div section td center".split())
#: How an element is dropped: not; by name or as a form, unless it wraps the page; by tag; always.
KEPT, NAMED, TAGGED, ALWAYS = range(4)
#: A wrapper has this many times the paragraph text outside the dropped elements (second: if an article is there).
WRAPS, WRAPS_BESIDE_ARTICLE = 2, 4
ADVERTS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion".split())
NOT_MAIN = frozenset("title subtitle headline heading header head meta byline author date info".split())
#: Text directly in these (outside links) is paragraph text; a container with less than this share of it is none.
PROSE = frozenset("#root html body article main section div center td p pre blockquote li dd".split())
MAJOR_SHARE = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|"
                    r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*+)>", re.S)
_CUT_TAG = re.compile(r"<[/!a-zA-Z][^<>]*\Z")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class _Node:
    __slots__ = ("tag", "parts", "dropped", "main", "named", "digest", "prose", "within", "own", "size", "drop", "best")

    def __init__(self, tag, drop, main, named, up=None):
        self.tag, self.parts, self.drop, self.main, self.named, self.digest = tag, [], drop, main, named, 0
        #: Set by _keep: whether it or one above it is dropped, and the largest article or main in it.
        self.dropped, self.best = True, None
        #: Whether its own text is paragraph text, whether it is in a container, and its characters of paragraph text
        #: without and with its children's.
        self.prose = tag in PROSE if tag in BLOCK or not up else up.prose and tag != "a"
        self.within, self.own, self.size = main or named or bool(up and up.within), 0, 0


def _kind(tag: str, attrs: str) -> tuple[int, bool]:
    """(how it is dropped, named like an article) of an element by tag, role, class and id."""
    if tag in ("body", "html"):
        return KEPT, False
    by_tag = KEPT if tag not in DROPPED else NAMED if tag == "form" else TAGGED
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return by_tag, False
    got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    style = got.get("style", "").replace(" ", "").lower()
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return ALWAYS, False
    role = got.get("role", "").lower()
    names = f"{got.get('class', '')} {got.get('id', '')}".lower().split()
    words = {w for parts in map(_NAME.findall, names) if parts and parts[0] not in STATES for w in parts}
    if words & {"comment", "comments"}:
        return (ALWAYS if tag in ("article", "main") else TAGGED), False
    if by_tag or role in ROLES or tag not in ("article", "main") and words & NAMES:
        return by_tag or NAMED, False
    if tag in ("article", "main"):
        return KEPT, bool(words & ADVERTS)  # an advert's name, see _keep
    return KEPT, tag in MAIN_BOXES and (role in ("main", "article") or any(map(_names_article, names)))


def _names_article(name: str) -> bool:
    parts = _NAME.findall(name)
    if len(parts) < 2:
        return bool(parts) and parts[0] in MAIN_NAMES
    return parts[-1] in MAIN_ENDS and parts[0] not in STATES and not NOT_MAIN.intersection(parts)


def parse(page: str) -> _Node:
    """Tree of a page; parts of a node are child nodes and decoded text."""
    root = _Node("#root", KEPT, False, False)
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if not m:
            text = _CUT_TAG.sub("", text)
        if text:
            stack[-1].parts.append(_html.unescape(text))
        if not m:
            break
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            _end(stack, tag)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size if tag in ("script", "style", "textarea", "title") else at
            if not stop and at < size:
                continue
            stack[-1].parts.append(" ")
            continue
        if tag in CLOSES_P:
            _close_open(stack, {"p"}, SCOPE | {"button"})
        if tag in CLOSES:
            _close_open(stack, CLOSES[tag], SCOPE - CLOSES[tag] if tag != "li" else SCOPE)
        if tag in BLOCK and stack[-1].tag == "head":
            stack.pop()  # its end tag may be left out
        drop, named = _kind(tag, m[3])
        node = _Node(tag, drop, tag in ("article", "main"), named, stack[-1])
        stack[-1].parts.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _close_open(stack, tags, scope):
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _end(stack, tag):
    if tag == "p" and not any(n.tag == "p" for n in stack[1:]):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCK and stack[i].tag in BLOCK:
            return  # a stray inline end tag ends no block


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def blocks(page: str) -> tuple[list[tuple[str, list[int]]], list[int], int, list[int]]:
    """(text blocks with the hashes of the boxes around them, distinct hashes of boxes, signature, countable boxes).

    Only the article container's blocks where there is one; the signature is a hash of all of them.
    Countable are the boxes that are templates by a number of pages.
    """
    import xxhash

    root = parse(page)
    order, todo = [], [root]
    while todo:  # without recursion: markup may be nested to any depth
        node = todo.pop()
        order.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, _Node)]
    _keep(root, order)
    for node in reversed(order):
        if not node.dropped:
            node.size = node.own + sum(p.size for p in node.parts if isinstance(p, _Node) and not p.dropped)
            inner = "\x1f".join(str(p.digest) if isinstance(p, _Node) else " ".join(p.split()) for p in node.parts)
            node.digest = xxhash.xxh64_intdigest(f"{node.tag}\x1e{inner}".encode("utf-8", "replace"))
    tops = _containers(root, [n for n in order if not n.dropped])
    inside = tops != [root]
    out: list[tuple[str, list[int]]] = []
    seen: dict[int, str] = {}
    for top in tops:
        _collect(top, inside, out, seen)
    held = dict.fromkeys(seen, 0)
    for words, path in out:
        for box in set(path):
            held[box] += len(words)
    most = max(LONG_BOX, sum(len(words) for words, _ in out) / 2)
    countable = sorted(box for box, tag in seen.items() if tag in BOXES and 0 < held[box] <= most)
    signature = xxhash.xxh64_intdigest("\x1e".join(t for t, _ in out).encode("utf-8", "replace"))
    return out, sorted(seen), _signed(signature), countable


def _keep(root, order):
    """Clear ``dropped`` of what is kept, wrappers of the page among it.

    A form or a box dropped by name is a wrapper if it holds a larger article or main than is outside,
    or most paragraph text.  What is dropped by tag stays so, but for an article or main in it when
    there is none elsewhere and it is most of the text.  Adverts and comments are no such article.
    """
    for node in reversed(order):
        inner = [p for p in node.parts if isinstance(p, _Node) and p.drop < TAGGED]
        if node.prose:
            node.own = sum(len("".join(p.split())) for p in node.parts if not isinstance(p, _Node))
        node.size = node.own + sum(p.size for p in inner)
        if node.main and not node.named and node.drop == KEPT and node.size:
            node.best = node
        else:
            node.best = max((p.best for p in inner if p.best), key=lambda n: n.size, default=None)
    text = articles = 0  # kept so far
    waiting, number, open_ = [], itertools.count(), root
    while open_:
        todo = [(open_, False)]
        while todo:
            node, inside = todo.pop()
            if node.drop and node is not open_:
                if node.drop == NAMED or node.drop == TAGGED and node.best:
                    heapq.heappush(waiting, (-(node.size if node.drop == NAMED else node.best.size), next(number), node))
                continue
            node.dropped = False
            inside = inside or node.main and not node.named
            text += node.own
            articles += node.own if inside else 0
            todo += [(p, inside) for p in node.parts if isinstance(p, _Node)]
        open_ = None
        while waiting and not open_:
            node = heapq.heappop(waiting)[2]
            if node.drop == NAMED and (node.best and node.best.size > articles
                                       or node.size > text * (WRAPS_BESIDE_ARTICLE if articles else WRAPS)):
                open_ = node
            elif node.drop == TAGGED and not articles and node.best.size > text:
                open_ = node.best


def _containers(root, nodes):
    """The articles outside main, else main, else the boxes named like one, if they hold enough; else the root."""
    tagged = _outermost([n for n in nodes if n.main])
    for tops in ([n for n in tagged if n.tag == "article"], [n for n in tagged if n.tag == "main"],
                 _outermost([n for n in nodes if n.named and not n.main])):
        if tops and sum(n.size for n in tops) >= MAJOR_SHARE * root.size:
            return tops
    return [root]


def _outermost(tops):
    """Containers that stand in no other of them, in page order."""
    inner = set()
    for top in tops:
        todo = [p for p in top.parts if isinstance(p, _Node)]
        while todo:
            node = todo.pop()
            inner.add(id(node))
            todo += [p for p in node.parts if isinstance(p, _Node)]
    return [t for t in tops if id(t) not in inner]


def _collect(top, inside, out, seen):
    """Add the blocks of ``top`` to ``out`` and the hashes and tags of its boxes to ``seen``."""
    text: list[str] = []

    def finish(path):
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            out.append((words, list(path)))

    path: list[int] = []
    todo: list = [("open", top)]
    while todo:
        what, node = todo.pop()
        if what == "text":
            text.append(node)
        elif what == "close":
            if node.tag in BLOCK:
                finish(path)
            if path and node is not top and path[-1] == _signed(node.digest) and _may_be_template(node, inside):
                path.pop()
        elif node.tag in ("br", "hr"):
            finish(path)
        elif not node.dropped and not (node.tag == "header" and not inside and not node.within):
            if node.tag in BLOCK:
                finish(path)
            if node is not top and _may_be_template(node, inside):
                path.append(_signed(node.digest))
                seen[_signed(node.digest)] = node.tag
            todo.append(("close", node))
            todo += [("open" if isinstance(p, _Node) else "text", p) for p in reversed(node.parts)]
        elif node.tag in BLOCK or node.tag in DROPPED:
            finish(path)
    finish(path)


def _may_be_template(node, inside) -> bool:
    return node.tag in BLOCK and node.tag not in ("body", "html") and not ((inside or node.within) and node.tag in TEXT_FLOW)


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, blocks, boxes, signature, countable) of every page; null html is empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64()))]))
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                urls = batch.column("url").to_pylist()
                got = [blocks(h.as_py() or "") for h in batch.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array([host_of(u) for u in urls], pa.string()),
                     pa.array([[{"text": t, "path": p} for t, p in g[0]] for g in got], kind),
                     pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.int64()),
                     pa.array([g[3] for g in got], pa.list_(pa.int64()))],
                    ["page_id", "url", "host", "blocks", "boxes", "signature", "countable"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, host string, blocks array<struct<text: string, path: array<long>>>, "
                               "boxes array<long>, signature long, countable array<long>")


def different_pages(parsed: DataFrame) -> DataFrame:
    """(host, signature, boxes, countable): pages with equal text count once, so copies of one page make no template."""
    return (parsed.where("host is not null").groupBy("host", "signature")
            .agg(F.first("boxes").alias("boxes"), F.first("countable").alias("countable")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, gone): the hashes of each host's template boxes by share of its pages.

    At most 1 / min_share times the mean number of boxes of a page can be in a host's list.
    """
    sizes = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    boxes = pages.select("host", F.explode("boxes").alias("box")).groupBy("host", "box").agg(F.count("*").alias("on"))
    return (boxes.where(F.col("on") >= min_pages * min_share).join(sizes, "host").where(F.col("on") >= min_share * F.col("n"))
            .groupBy("host").agg(F.collect_set("box").alias("gone")))


def counted_templates(parsed: DataFrame, pages: DataFrame, gone: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, boxes_hash, also): the template boxes by number of pages that are not in ``gone``, per list of boxes.

    A host may have any number of them, so every page gets its own only.
    """
    many = (pages.select("host", F.explode("countable").alias("box")).groupBy("host", "box").agg(F.count("*").alias("on"))
            .where(F.col("on") >= min_pages).drop("on"))
    by_share = gone.select("host", F.explode("gone").alias("box"))
    many = many.join(by_share, ["host", "box"], "left_anti")
    own = parsed.where("host is not null").select("host", "boxes_hash", F.explode("boxes").alias("box")).distinct()
    return own.join(many, ["host", "box"]).groupBy("host", "boxes_hash").agg(F.collect_set("box").alias("also"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text): the main text of every row, blocks joined by one space.

    Null and empty pages have the empty text; pages without a host have no templates; repeated rows
    get equal texts; an empty table gives no rows.
    """
    parsed = materialize(page_blocks(pages, id_col, url_col, html_col), "page-blocks")
    parsed = parsed.withColumn("boxes_hash", F.xxhash64("boxes"))
    different = materialize(different_pages(parsed), "different-pages")
    gone = materialize(templates(different, min_pages, min_share), "templates")
    also = materialize(counted_templates(parsed, different, gone, min_pages), "counted-templates")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["path"], F.col("gone")), F.lit(False))
                    & ~F.coalesce(F.arrays_overlap(b["path"], F.col("also")), F.lit(False)))
    return (parsed.join(broadcast_if_small(gone), "host", "left").join(broadcast_if_small(also), ["host", "boxes_hash"], "left")
            .select("page_id", "url", F.concat_ws(" ", F.transform(kept, lambda b: b["text"])).alias("text")))


def query(spark, sf_dir):
    """Main text of all pages."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
