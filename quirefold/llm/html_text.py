"""Main-text extraction by wrapper induction.

A page is parsed into a tree of its block elements; runs of equal siblings (paragraphs, list items) are one node of
its skeleton. The most frequent skeleton of a host is the host's reference, and simple tree matching aligns
every page's skeleton with it. Counts over all pages of the host tell, for each aligned node,
which texts recur over how many different articles: constant texts are template there and go, a node that varies is a slot,
and slots become content. Copies of a page are one article, so their text isn't taken for template.

Elements that are boilerplate by their meaning (menus, forms, scripts, adverts by class, comments) are cut on any page.
A page with an article or main element is read inside it; authors repeat themselves there, so a text is constant if at least
INNER_SHARE of the host's articles (INNER_PAGES at least) hold it, elsewhere if LEAST_SHARE of them (LEAST_PAGES) do.

Hosts with constant texts have a wrapper. A host has at most leaves of an average page / LEAST_SHARE of them, as each
is on that share of its pages. Wrappers are broadcast if there are at most BROADCAST_HOSTS of them, else joined by host,
with a host's pages dealt to SALTS parts.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import html_tree
from quirefold.functions.html_tree import Node, clean
from quirefold.llm.common import checkpointed, small_or_not

LEAST_SHARE, LEAST_PAGES, INNER_SHARE, INNER_PAGES = 0.1, 3, 0.5, 5
BROADCAST_HOSTS, SALTS = 2_000, 32
# Elements and names that mark boilerplate.
OFF = set(
    "head script style noscript template nav footer aside form button select input textarea iframe svg canvas object "
    "dialog menu audio video map".split()
)
OFF_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup sidebar widget widgets related recommended "
    "share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead toolbar comment comments "
    "disqus replies respond login search skip".split()
)
#: Names that mark boilerplate only alone or at the end of a compound (notice-period and search-results are content).
ENDS_ONLY = set("notice notices alert search skip login respond related recommended promotion social share sharing menu".split())
OFF_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu toolbar".split())
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TELLING = re.compile(r"class|id|role|hidden", re.I)
SHAPES = "host string, skeleton string, body long, leaves array<struct<node:int,text_hash:long,inner:boolean>>"


def _off(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OFF or (tag == "header" and not in_article):
        return True
    if not attributes or not TELLING.search(attributes):
        return False
    for name, a, b, c in ATTR.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id"):
            if any(_off_name(x) for x in value.split()):
                return True
        elif name == "role":
            if value in OFF_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _off_name(name: str) -> bool:
    """A class or id that marks boilerplate: by its last part, or by its first one if that is plain enough."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    return bool(parts) and (parts[-1] in OFF_NAMES or (parts[0] in OFF_NAMES and parts[0] not in ENDS_ONLY))


def parse(source: str) -> Node:
    """Block tree of a page with its boilerplate elements marked."""
    return html_tree.parse(source, _off)


def _label(node: Node) -> str:
    return node.tag + "!" * node.off


def skeleton(root: Node) -> str:
    """Nested labels with runs of equal siblings collapsed; numbers the nodes in pre-order, a run as one."""
    kinds: dict[tuple, int] = {}  # shapes by (label, shapes of children)
    shapes: list[tuple] = []
    sizes: list[int] = []
    kind_of: dict[int, int] = {}
    order = list(_walk(root))
    for node in reversed(order):  # children before parents
        inner: list[int] = []
        for part in node.parts:
            if not isinstance(part, str):
                k = kind_of[id(part)]
                if not inner or inner[-1] != k:
                    inner.append(k)
        key = (_label(node), *inner)
        if key not in kinds:
            kinds[key] = len(shapes)
            shapes.append(key)
            sizes.append(1 + sum(sizes[k] for k in inner))
        kind_of[id(node)] = kinds[key]
    root.index = 0
    for node in order:  # parents before children
        at, before = node.index + 1, None
        for part in node.parts:
            if isinstance(part, str):
                continue
            k = kind_of[id(part)]
            if before is not None and k != before:
                at += sizes[before]
            part.index, before = at, k
    out: list[str] = []
    todo: list = [kind_of[id(root)]]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        out.append(shapes[k][0])
        if len(shapes[k]) > 1:
            todo.append(")")
            for x in reversed(shapes[k][1:]):
                todo += [x, ","]
            todo[-1] = "("
    return "".join(out)


class Tree:
    """A skeleton read back: labels and children by number, and equal subtrees under one shape."""

    __slots__ = ("labels", "children", "shape", "sizes")

    def __init__(self, text: str, shapes: dict[tuple, int]):
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        open_nodes: list[int] = []
        for mark, label in re.findall(r"([(),]|^)([^(),]*)", text):
            if mark == ")":
                open_nodes.pop()
            if mark == "(":
                open_nodes.append(len(self.labels) - 1)
            if label:
                if open_nodes:
                    self.children[open_nodes[-1]].append(len(self.labels))
                self.labels.append(label)
                self.children.append([])
        n = len(self.labels)
        self.shape, self.sizes = [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            key = (self.labels[i], *(self.shape[c] for c in self.children[i]))
            self.shape[i] = shapes.setdefault(key, len(shapes))
            self.sizes[i] += sum(self.sizes[c] for c in self.children[i])


def match_trees(a: str, b: str) -> list[tuple[int, int]]:
    """Simple tree matching: a largest order-keeping match of two skeletons, as pairs of numbers.

    Equal subtrees at the front or the back of two rows of siblings are matched outright, as no match of
    theirs is larger; the rest is the usual dynamic program. Works off lists, so depth is no limit.
    """
    shapes: dict[tuple, int] = {}
    x, y = Tree(a, shapes), Tree(b, shapes)
    if not x.labels or not y.labels or x.labels[0] != y.labels[0]:
        return []
    done: dict[tuple[int, int], int] = {}
    rows: dict[tuple[int, int], tuple] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo[-1]
        if (i, j) in done:
            todo.pop()
            continue
        if x.shape[i] == y.shape[j]:
            done[i, j] = x.sizes[i]
            todo.pop()
            continue
        if (i, j) not in rows:
            p, q = x.children[i], y.children[j]
            front = 0
            while front < min(len(p), len(q)) and x.shape[p[front]] == y.shape[q[front]]:
                front += 1
            back = 0
            while back < min(len(p), len(q)) - front and x.shape[p[-1 - back]] == y.shape[q[-1 - back]]:
                back += 1
            rows[i, j] = (p[front : len(p) - back], q[front : len(q) - back], p[:front] + p[len(p) - back :], q[:front] + q[len(q) - back :])
            todo += [(u, v) for u in rows[i, j][0] for v in rows[i, j][1] if x.labels[u] == y.labels[v] and (u, v) not in done]
            continue
        p, q, same, _ = rows[i, j]
        table = _best(p, q, done)
        done[i, j] = 1 + sum(x.sizes[u] for u in same) + table[len(p)][len(q)]
        todo.pop()
    found, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        found.append((i, j))
        if x.shape[i] == y.shape[j]:
            todo.extend(zip(x.children[i], y.children[j], strict=True))
            continue
        p, q, same, other = rows[i, j]
        todo.extend(zip(same, other, strict=True))
        table, u, v = _best(p, q, done), len(p), len(q)
        while u and v:
            own = done.get((p[u - 1], q[v - 1]), 0)
            if own and table[u][v] == table[u - 1][v - 1] + own:
                u, v = u - 1, v - 1
                todo.append((p[u], q[v]))
            elif table[u][v] == table[u - 1][v]:
                u -= 1
            else:
                v -= 1
    return found


def _best(p: list[int], q: list[int], known: dict[tuple[int, int], int]) -> list[list[int]]:
    """Largest sums of matches over prefixes of two rows of siblings."""
    table = [[0] * (len(q) + 1)]
    for u in p:
        above, row = table[-1], [0]
        for k, v in enumerate(q):
            row.append(max(above[k + 1], row[k], above[k] + known.get((u, v), 0)))
        table.append(row)
    return table


def whole_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            out.append(" ")
            todo.extend(reversed(part.parts))
    return clean("".join(out))


def _walk(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(p for p in reversed(n.parts) if not isinstance(p, str))


def main_roots(root: Node) -> list[Node]:
    """Outermost article or main elements that aren't boilerplate; the whole page if there are none."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.off:
            continue
        if n.tag in ("article", "main"):
            found.append(n)
        else:
            todo.extend(p for p in reversed(n.parts) if not isinstance(p, str))
    mains = [n for m in found if m.tag == "main" for n in _walk(m) if n.tag == "article" and not n.off]
    if mains and len(mains) == 1 and len(found) == 1:
        return mains
    return found or [root]


def blocks(node: Node, template: set[int]) -> list[str]:
    """Texts of a subtree's blocks in page order, without boilerplate and template nodes."""
    out: list[str] = []
    run: list[str] = []

    def close():
        if run:
            text = clean("".join(run))
            if text:
                out.append(text)
            run.clear()

    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif not part.off and id(part) not in template:
            close()
            todo.append(None)
            todo.extend(reversed(part.parts))
        else:
            close()
    close()
    return out


def text_hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "big", signed=True)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Aligner:
    """Alignments of skeletons with references, remembered in a bounded memo."""

    def __init__(self):
        self.maps: dict[tuple[str, str], dict[int, int]] = {}

    def __call__(self, page: str, reference: str) -> dict[int, int]:
        key = (page, reference)
        if key not in self.maps:
            if len(self.maps) > 5_000:
                self.maps.clear()
            self.maps[key] = dict(match_trees(page, reference))
        return self.maps[key]


def extract_text(source: str, align: Aligner, reference: str | None = None, constants: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Main text of a page, less what a host's wrapper (reference skeleton, constant (node, text hash) pairs) marks as template."""
    root = parse(source)
    roots = main_roots(root)
    template: set[int] = set()
    if reference and constants:
        to = align(skeleton(root), reference)
        spots = {node for node, _ in constants}
        for n in _walk(root):
            if n is not root and to.get(n.index) in spots and (to[n.index], text_hash(whole_text(n))) in constants:
                template.add(id(n))
    return "\n\n".join(t for r in roots for t in blocks(r, template))


def _shapes(it):
    """For each page its skeleton, a hash of its article, and the nodes that bear text of their own."""
    for batch in it:
        rows = []
        for host, source in zip(batch["host"], batch["html"], strict=True):
            root = parse(source)
            shape = skeleton(root)
            roots = main_roots(root)
            inside = {id(n) for r in roots if r is not root for n in _walk(r)}
            body = text_hash("\n".join(t for r in roots for t in blocks(r, set())))
            seen: set[tuple] = set()
            off: set[int] = set()
            for n in _walk(root):
                if n.off or id(n) in off:
                    off.update(id(p) for p in n.parts if not isinstance(p, str))
                elif n is not root and any(isinstance(p, str) and not p.isspace() for p in n.parts):
                    if inside and id(n) not in inside:
                        continue  # not read anyway
                    seen.add((n.index, text_hash(whole_text(n)), id(n) in inside))
            rows.append((host, shape, body, [{"node": a, "text_hash": b, "inner": c} for a, b, c in seen]))
        yield pd.DataFrame(rows, columns=["host", "skeleton", "body", "leaves"])


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, constants) of hosts that have constant texts, from all pages (host, html)."""
    shapes = pages.select("host", "html").mapInPandas(_shapes, SHAPES)
    # Copies of an article count once; min() picks its skeleton and leaves, combined map-side.
    once = checkpointed(shapes.groupBy("host", "body").agg(F.min(F.struct("skeleton", "leaves")).alias("p")).select("host", "p.skeleton", "p.leaves"))
    kinds = once.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    reference = kinds.groupBy("host").agg(
        F.max(F.struct("n", "skeleton")).getField("skeleton").alias("reference"), F.sum("n").alias("articles")
    ).where(F.col("articles") >= LEAST_PAGES)
    # Texts that can't reach the limits under any alignment go first: by text alone, on the host.
    leaves = once.select("host", "skeleton", F.explode("leaves").alias("leaf")).select("host", "skeleton", "leaf.*")
    counts = checkpointed(leaves.groupBy("host", "skeleton", "node", "text_hash", "inner").agg(F.count("*").alias("n")))
    often = F.col("n") >= F.when(F.col("inner"), F.greatest(F.lit(INNER_PAGES), INNER_SHARE * F.col("articles"))).otherwise(
        F.greatest(F.lit(LEAST_PAGES), LEAST_SHARE * F.col("articles"))
    )
    could = counts.groupBy("host", "text_hash", "inner").agg(F.sum("n").alias("n")).join(small_or_not(reference), "host").where(often)
    texts = counts.join(could.drop("n"), ["host", "text_hash", "inner"])

    def aligned(it):
        align = Aligner()
        for batch in it:
            to = [align(s, r).get(n, -1) for s, r, n in zip(batch["skeleton"], batch["reference"], batch["node"], strict=True)]
            yield batch.drop(columns=["skeleton"]).assign(node=pd.Series(to, dtype="int32", index=batch.index))

    columns = "host string, reference string, articles long, node int, text_hash long, inner boolean, n long"
    mapped = texts.select("host", "reference", "articles", "skeleton", "node", "text_hash", "inner", "n").mapInPandas(aligned, columns)
    constant = (
        mapped.where("node >= 0")
        .groupBy("host", "reference", "articles", "node", "text_hash", "inner")
        .agg(F.sum("n").alias("n"))
        .where(often)
    )
    return constant.groupBy("host", "reference").agg(F.collect_set(F.struct("node", "text_hash")).alias("constants"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: the main text of the whole html.

    Blocks are joined by two line ends; a null or empty html, or one without main text, gives ''. Pages whose URL has no
    host form one group. Repeated rows give repeated results; other columns are ignored.
    """
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    wrappers = checkpointed(induce(source))
    known: dict[str, tuple] = {}
    if wrappers.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        known = {r["host"]: (r["reference"], frozenset((c["node"], c["text_hash"]) for c in r["constants"])) for r in wrappers.collect()}
        joined = source.withColumns({"reference": F.lit(None).cast("string"), "constants": F.lit(None).cast("array<struct<node:int,text_hash:long>>")})
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    shipped = pages.sparkSession.sparkContext.broadcast(known)

    def texts(it):
        align, near = Aligner(), {}
        for batch in it:
            found = []
            for host, source_text, reference, constants in zip(batch["host"], batch["html"], batch["reference"], batch["constants"], strict=True):
                wrapper = shipped.value.get(host) or (None, frozenset())
                if reference is not None:
                    if host not in near:
                        near.clear()  # pages come by host
                        near[host] = (reference, frozenset((c["node"], c["text_hash"]) for c in constants))
                    wrapper = near[host]
                found.append(extract_text(source_text, align, *wrapper))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})

    return joined.select("page_id", "url", "host", "html", "reference", "constants").mapInPandas(
        texts, "page_id long, url string, text string, n_chars long"
    )
