"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one page of that host by simple tree matching (the largest
order-preserving match of two trees' nodes of equal tag; runs of like siblings are one node). A
matched node is a slot of the host's wrapper. Two kinds of things are template: a text that most of the
host's different contents that have its slot carry there, and an element whose class or id is
ambiguous about its part ("share-price", "td-ads") but which most of those contents have in one slot. How
many are most takes a prior: more evidence is asked for inside article and main elements, where text
is content unless much speaks against it. What varies is content.

Before that, parts are left out that are no article by their element, role, or a class or id that can
mean nothing else ("comments", "cookie-banner"). Where a page has article or main elements, content is
what stands in them, unless they are a mere teaser beside longer prose.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, checkpoint, new_folder, read, read_part, remove

SUPPORT = 0.5
PRIOR, MAIN_PRIOR = 0, 8  # contents without the text that are counted besides the host's own
TEASER = 3  # times that prose outside must be longer than an article that is left as one text among others

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
SKIPPED = {
    "nav", "footer", "aside", "form", "head", "header", "menu", "button", "select", "svg", "canvas", "object", "audio",
    "video", "dialog", "fieldset",
}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "body", "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "ul", "ol", "li",
    "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tfoot", "tr", "caption", "pre",
    "blockquote", "figure", "figcaption", "address", "details", "summary", "hgroup", "menu", "fieldset", "dialog", "head",
    "button", "select", "svg", "canvas", "object", "audio", "video", "center",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = BLOCKS - {"html", "body", "head", "button", "select", "svg", "canvas", "object", "audio", "video"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
LISTS = {"ul", "ol", "menu", "dl", "table"}
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "sidebar", "breadcrumb",
    "breadcrumbs", "comment", "comments", "disqus", "share", "sharing", "social", "related", "pagination", "pager", "navbar",
    "navigation", "menu", "masthead", "banner", "widget", "toolbar", "commentlist", "respond", "adsense", "adsbygoogle",
    "cookiebar", "cookiebanner", "topbar", "promoted", "sponsors",
}
#: With one of PARTS, words of a name that still can mean nothing else; any other word makes it ambiguous.
FURNITURE = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "entries", "footer",
    "form", "group", "header", "icon", "icons", "inner", "item", "items", "label", "left", "links", "list", "main", "outer", "overlay",
    "page", "panel", "placeholder", "post", "posts", "reader", "readers", "reply", "right", "row", "section", "signup", "site", "slot",
    "sticky", "stories", "sub", "text", "thread", "title", "top", "unit", "user", "wrap", "wrapper",
}
PROSE = {"p", "blockquote", "pre", "dd", "figcaption", "caption"} | {f"h{k}" for k in range(1, 7)}
WHOLE = {"nav", "header", "footer", "site-header", "site-footer", "page-header", "page-footer", "aside", "alert", "skip-link"}
#: Elements whose classes tell the layout of the page: only an article that is itself a comment or advert is left out.
FRAMES = {"html", "body", "main", "article"}
LAYOUT = {"has", "no", "with", "without", "is"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}


class Node:
    __slots__ = ("tag", "children", "blocks", "skip", "main", "parent", "part", "name")

    def __init__(self, tag: str, parent: Node | None, skip: bool, main: bool, name: str = ""):
        self.tag, self.parent, self.skip, self.main = tag, parent, skip, main
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.name = name  # an ambiguous class or id
        self.part: Node | None = self if name else parent.part if parent else None  # the nearest element with one


class Block:
    __slots__ = ("node", "parts", "linked", "chars")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.chars = node, [], 0, 0


def _judge(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element's attributes leave no doubt that it is no article, and else an ambiguous class or id, or ''."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, ""
    doubtful = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if name == "id" and tag in HEADINGS:
                continue  # an anchor
            for token in value.split():
                words = {w for w in re.split(r"[-_]+", token) if w}
                if tag in FRAMES:
                    if tag == "article" and (token in PARTS or token in ("comment-body", "comment-item")):
                        return True, ""
                elif token in WHOLE:
                    return True, ""
                elif re.split(r"[-_]+", token)[0] not in LAYOUT and not PARTS.isdisjoint(words):
                    if words <= PARTS | FURNITURE:
                        return True, ""
                    doubtful = doubtful or token
        elif name == "role" and value in ROLES:
            return True, ""
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True, ""
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, ""
    return False, doubtful


def parse(page: str) -> tuple[Node, list[Block], bool]:
    """The tree of block elements, its text blocks in order, and whether it has article or main elements."""
    root = Node("#root", None, False, False)
    node, blocks, has_main = root, [], False
    block: Block | None = None
    links = 0
    hidden = 0  # depth of skipped inline elements
    hidden_tag = ""
    at, size = 0, len(page)

    def add(text: str) -> None:
        nonlocal block
        if node.skip or hidden or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(node)
            node.blocks.append(len(blocks))
            blocks.append(block)
        block.parts.append(text)
        n = len(text) - text.count(" ")
        block.chars += n
        if links:
            block.linked += n

    while at < size:
        low = page.find("<", at)
        if low < 0:
            add(page[at:])
            break
        token = TOKEN.match(page, low)
        if token is None:  # a plain "<"
            add(page[at : low + 1])
            at = low + 1
            continue
        add(page[at:low])
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            if token[0].startswith("<![CDATA["):
                add(token[0][9:-3])
            continue
        tag = tag.lower()
        closing = bool(token[1] or token[4])
        attributes = token[3] if token[2] else token[6]
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in BLOCKS:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br" or tag in ("td", "th", "hr", "option"):
                if block is not None:
                    block.parts.append(" ")
                if tag == "hr":
                    block = None
            if hidden:
                if tag == hidden_tag:
                    hidden += -1 if closing else 1
            elif not closing and tag not in VOID and attributes and _judge(tag, attributes)[0]:
                hidden, hidden_tag = 1, tag
            continue
        block = None
        hidden = 0
        if closing:
            seek = node
            while seek is not root and seek.tag != tag:
                seek = seek.parent
            if seek is not root:
                node = seek.parent
                links = 0
            continue
        # implied ends
        if tag in ENDS_P:
            seek = node
            while seek is not root and seek.tag in ("p", *HEADINGS):
                if seek.tag == "p" or tag in HEADINGS:
                    node = seek.parent
                    break
                seek = seek.parent
        if tag in ENDS:
            seek = node
            while seek is not root and seek.tag not in LISTS:
                if seek.tag in ENDS[tag]:
                    node = seek.parent
                    break
                seek = seek.parent
        main = tag in MAIN and not node.skip
        within = node.main or main
        surely, name = _judge(tag, attributes)
        skip = node.skip or (tag in SKIPPED and not (tag == "header" and node.main)) or surely
        if node.tag == "header" and node.main and tag not in HEADINGS | {"hgroup", "header", "div"}:
            skip = True
        has_main = has_main or (main and not skip)
        child = Node(tag, node, skip, within and not skip, name)
        node.children.append(child)
        if not attributes.endswith("/") or tag in BLOCKS:
            node = child
    return root, blocks, has_main


def _runs(node: Node) -> list[list[Node]]:
    """Children, with runs of neighbours of one tag together."""
    out: list[list[Node]] = []
    for child in node.children:
        if out and out[-1][0].tag == child.tag:
            out[-1].append(child)
        else:
            out.append([child])
    return out


class Shape:
    """A tree without texts: runs of like siblings are merged into one node."""

    __slots__ = ("tag", "children", "slot", "key")

    def __init__(self, tag: str, children: list[Shape]):
        self.tag, self.children, self.slot = tag, children, 0
        self.key = xxhash.xxh3_64_intdigest(f"{tag} {[c.key for c in children]}")


def shape(nodes: list[Node]) -> Shape:
    """Of a run of like siblings: the union of their children's runs, in the order of the one with most."""
    groups = [_runs(n) for n in nodes]
    best = max(groups, key=len)
    rest: dict[str, list[Node]] = {}
    for g in groups:
        for run in g:
            rest.setdefault(run[0].tag, []).extend(run)
    seen, children = set(), []
    for run in best + [r for g in groups for r in g]:
        tag = run[0].tag
        if tag not in seen:
            seen.add(tag)
            children.append(shape(rest[tag]))
    return Shape(nodes[0].tag, children)


def number(tree: Shape) -> None:
    """Slots of a reference tree, in preorder from 1."""
    todo, n = [tree], 0
    while todo:
        node = todo.pop()
        n += 1
        node.slot = n
        todo.extend(reversed(node.children))


def _weight(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: nodes in the largest order-preserving match of two trees, 0 if the roots differ."""
    if a.tag != b.tag:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _table(a, b, memo)[-1][-1] + 1
    return memo[key]


def _table(a: Shape, b: Shape, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        row, last = [0], rows[-1]
        for j, y in enumerate(b.children):
            row.append(max(row[j], last[j + 1], last[j] + _weight(x, y, memo)))
        rows.append(row)
    return rows


def match(a: Shape, b: Shape, memo: dict) -> None:
    """Gives the nodes of `a` the slots of the nodes of `b` that they match; others keep 0."""
    a.slot = b.slot
    rows = _table(a, b, memo)
    i, j = len(a.children), len(b.children)
    while i and j:
        w = _weight(a.children[i - 1], b.children[j - 1], memo)
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            match(a.children[i - 1], b.children[j - 1], memo)
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1


def slots(root: Node, reference: Shape, seen: dict) -> dict[int, str]:
    """Slot of each node by its id: the reference's number, or the path below the last matched node."""
    tree = shape([root])
    if tree.key not in seen:
        if len(seen) > 5000:
            seen.clear()
        match(tree, reference, {})
        seen[tree.key] = tree
    out: dict[int, str] = {}
    todo = [([root], seen[tree.key], "")]
    while todo:
        nodes, place, path = todo.pop()
        name = f"{place.slot}" if place.slot else f"{path}/{place.tag}"
        for n in nodes:
            out[id(n)] = name
        by_tag: dict[str, list[Node]] = {}
        for n in nodes:
            for c in n.children:
                by_tag.setdefault(c.tag, []).append(c)
        for child in place.children:
            todo.append((by_tag[child.tag], child, name))
    return out


def candidates(blocks: list[Block]) -> list[tuple[Block, str]]:
    """Blocks with their clean text, but for empty ones and, outside main elements, menu entries (a link and no prose)."""
    out = []
    for b in blocks:
        if not b.node.main and b.chars and b.linked >= b.chars and b.node.tag not in PROSE:
            continue
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            out.append((b, text))
    return out


def content(found: list[tuple[Block, str]], has_main: bool) -> list[tuple[Block, str]]:
    """Of the candidates those in article or main elements, if there are any and they are no teaser beside longer prose."""
    if not has_main:
        return found
    inside = [(b, text) for b, text in found if b.node.main]
    prose = [len(text) for b, text in found if not b.node.main and b.node.tag == "p" and b.linked < b.chars]
    teaser = len(prose) > 1 and sum(prose) > TEASER * sum(len(text) for _, text in inside) and inside
    return found if teaser else inside


def texts(blocks: list[Block], has_main: bool) -> list[tuple[Block, str]]:
    """Content as a page by itself tells it, without a wrapper."""
    return content(candidates(blocks), has_main)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Signs:
    """A page's tree and candidates against a host's reference: hashes that are counted, and then looked up."""

    def __init__(self, page: str, reference: Shape, seen: dict):
        root, blocks, self.has_main = parse(page)
        self.found = candidates(blocks)
        self.slots = slots(root, reference, seen)

    def text(self, block: Block, text: str) -> int:
        return _hash(f"{self.slots[id(block.node)]}\0{text}")

    def part(self, node: Node) -> int:
        """Of an element with an ambiguous name, by its place in its parent's slot."""
        return _hash(f"{self.slots[id(node.parent)]}\0{node.tag}\0{node.name}\0")

    def parts(self, node: Node) -> Iterator[Node]:
        """The element with an ambiguous name that a node is or stands in, the one around that, and so on."""
        part = node.part
        while part is not None:
            yield part
            part = part.parent.part

    def counted(self) -> list[tuple[int, int, int]]:
        """Distinct (slot, sign, in main): each candidate's text, and each ambiguous element that holds one."""
        out = set()
        for block, text in self.found:
            node = block.node
            out.add((_hash(self.slots[id(node)]), self.text(block, text), int(node.main)))
            for part in self.parts(node):
                out.add((_hash(self.slots[id(part.parent)]), self.part(part), int(part.main)))
        return sorted(out)

    def kept(self, template: set[int]) -> str:
        left = [
            (block, text)
            for block, text in self.found
            if self.text(block, text) not in template and not any(self.part(p) in template for p in self.parts(block.node))
        ]
        return "\n".join(text for _, text in content(left, self.has_main))


def written(tree: Shape) -> str:
    """A shape as lines of depth and tag, in preorder."""
    lines, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.tag}")
        todo.extend((c, depth + 1) for c in reversed(node.children))
    return "\n".join(lines)


def reread(lines: str) -> Shape:
    """The shape that written() gave, numbered."""
    held: list[tuple[int, str, list[Shape]]] = []

    def close(depth: int) -> None:
        while held and held[-1][0] >= depth:
            _, tag, children = held.pop()
            tree = Shape(tag, children)
            if not held:
                done.append(tree)
            else:
                held[-1][2].append(tree)

    done: list[Shape] = []
    for line in lines.split("\n"):
        depth, tag = line.split(" ", 1)
        close(int(depth))
        held.append((int(depth), tag, []))
    close(0)
    number(done[0])
    return done[0]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, host, rank, shape): for each host of the task its page of least hash, whose shape may be the reference."""
    sys.setrecursionlimit(1_000_000)  # trees are walked by recursion, and pages may nest deeply
    best: dict[str, tuple[int, str]] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            rank = _hash(page or "")
            if host not in best or rank < best[host][0]:
                best[host] = (rank, page or "")
    block = TaskContext.get().partitionId()
    for host, (rank, page) in best.items():
        row = [[block], [host], [rank], [written(shape([parse(page)[0]]))]]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["block", "host", "rank", "shape"])


class Wrappers:
    """References and templates of the hosts of one block, read from its file."""

    def __init__(self, folder: str):
        sys.setrecursionlimit(1_000_000)
        rows = read_part(f"{folder}/block={TaskContext.get().partitionId()}", ["host", "shape", "signs"])
        self.shapes = dict(zip(rows.column("host").to_pylist(), rows.column("shape").to_pylist()))
        self.templates = {h: set(s or ()) for h, s in zip(rows.column("host").to_pylist(), rows.column("signs").to_pylist())}
        self.trees: dict[str, tuple[Shape, dict]] = {}

    def signs(self, host: str, page: str | None) -> Signs:
        if host not in self.trees:
            if host not in self.shapes:
                raise RuntimeError("a partition of the pages holds other hosts than when its wrappers were made")
            self.trees[host] = (reread(self.shapes[host]), {})
        return Signs(page or "", *self.trees[host])


def _observe(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    wrappers = None
    for batch in batches:
        wrappers = wrappers or Wrappers(folder)
        contents, nodes, signs = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            found = wrappers.signs(host, page.as_py())
            contents.append(_hash("\n".join(t for _, t in content(found.found, found.has_main))))
            nodes.append(sorted({_hash(name) for name in found.slots.values()}))
            signs.append([dict(zip(("slot", "sign", "main"), c)) for c in found.counted()])
        kind = pa.list_(pa.struct([("slot", pa.int64()), ("sign", pa.int64()), ("main", pa.int32())]))
        columns = [batch.column("host"), pa.array(contents, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(signs, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "content", "nodes", "signs"])


def _extract(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    wrappers = None
    for batch in batches:
        wrappers = wrappers or Wrappers(folder)
        hosts = batch.column("host").to_pylist()
        out = [wrappers.signs(h, p.as_py()).kept(wrappers.templates[h]) for h, p in zip(hosts, batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"]
        )


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html); other columns are ignored.

    Null or empty html gives an empty text, never null; a null url is a host of its own. Rows that
    repeat are extracted each. A text or ambiguous element is template where at least two of a host's
    different contents have it in one slot, and those are more than `support` of the contents that have
    the slot, with MAIN_PRIOR more counted inside article and main elements (equal contents count once,
    so copies of an article don't make it template). An empty table gives an empty result.

    Every page is counted. Counts are pre-aggregated, so a host with a third of all pages is spread
    over all tasks; pages are never shuffled. The wrappers of a block's hosts (a block is what one task
    reads) are joined to it and written to the shared folder, a file a block, which the tasks read: a
    file holds no more hosts than its block, and nothing of it passes through the driver.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    firsts = checkpoint(pages.mapInArrow(_firsts, "block int, host string, rank long, shape string"))
    references = checkpoint(firsts.groupBy("host").agg(F.min_by("shape", F.struct("rank", "shape")).alias("shape")))

    def deliver(wrappers: DataFrame) -> str:
        folder = new_folder(spark, "wrappers")
        firsts.select("block", "host").join(wrappers, "host").repartition("block").write.partitionBy("block").parquet(folder)
        return folder

    folder = deliver(references.withColumn("signs", F.lit(None).cast("array<long>")))
    seen = pages.mapInArrow(
        lambda it, folder=folder: _observe(it, folder),
        "host string, content long, nodes array<long>, signs array<struct<slot:long,sign:long,main:int>>",
    )
    contents = checkpoint(seen.groupBy("host", "content").agg(F.first("nodes").alias("nodes"), F.first("signs").alias("signs")))
    remove(spark, folder)
    having = contents.select("host", F.explode("nodes").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n"))
    carried = contents.select("host", F.explode("signs").alias("x")).groupBy("host", "x.slot", "x.sign").agg(
        F.count("*").alias("k"), F.max("x.main").alias("main")
    )
    prior = F.when(F.col("main") == 1, MAIN_PRIOR).otherwise(PRIOR)
    template = carried.where("k > 1").join(having, ["host", "slot"]).where(F.col("k") > (F.col("n") + prior) * support)
    # at most 1 / support times a slot's texts in a content can pass
    signs = template.groupBy("host").agg(F.collect_set("sign").alias("signs"))
    final = deliver(references.join(signs, "host", "left"))
    return pages.mapInArrow(lambda it: _extract(it, final), "page_id long, url string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
