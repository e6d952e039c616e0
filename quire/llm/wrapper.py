"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. One page of each frequent page type is a reference; the other pages are aligned to it by simple tree
matching over block nodes. Leaves that keep their text over the aligned pages are template, leaves whose text varies are slots; blocks
that recur over the pages of a host or of a type are template wherever the reference stands.
A page's text is what lies in its article (or, without one, in its body), without containers that never hold the article and
without template leaves.

References travel with the tasks when all of them together are small (checked), else by a join on the host that Spark may split.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import stored

#: Fixed values of HTML: elements without content, raw text elements, elements that stay inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub "
             "sup time tt u var wbr br nobr".split())
ENDS_PARAGRAPH_IN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Elements, roles and name parts of containers that are not the article.
OUTSIDE_TAGS = set("nav footer aside form button select fieldset dialog menu head object video audio canvas".split()) | RAW
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUTSIDE_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus "
                    "breadcrumb breadcrumbs pagination pager sidebar footer header masthead topbar cookie cookies consent gdpr notice notices "
                    "popup modal overlay comment comments disqus reply replies respond related share sharing social newsletter subscribe "
                    "signup login search".split())
#: Parts that may stand beside such names in one word (site-footer), and elements whose names say nothing about them.
BESIDE_NAMES = set("site global top bottom left right primary secondary widget bar box list links buttons inner wrap wrapper container block area".split())
UNNAMED_TAGS = set("h1 h2 h3 h4 h5 h6 p".split())
HEADER_NAMES = {"header", "masthead"}
COMMENT_NAMES = {"comment", "comments", "reply", "replies", "disqus"}
#: Elements that hold text of a page and tell nothing of its type when they bear no name.
TEXT_BLOCKS = set("p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption #text".split())
#: Columns beside a page that do not go out.
WORKING = ("_host", "_html", "_kind", "_reference", "_leaves", "_blocks")
#: Below this length a row of the matching is a list, from it on an array; both hold the same numbers.
SHORT = 48
#: What equal text adds to a leaf's weight of 1: more than all nodes of a page together.
EQUAL = 1 << 32

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """A block element, or a leaf with the text of one block."""

    __slots__ = ("label", "children", "text", "outside", "article", "order", "own", "parent")

    def __init__(self, label: str, text: str | None, outside: bool, article: bool, order: int = -1, own: int = 0, parent: Node | None = None):
        self.label, self.children, self.text, self.outside, self.article, self.order = label, [], text, outside, article, order
        self.own, self.parent = own, parent


def _named(word: str, in_article: bool) -> bool:
    """Whether a whole class or id is a name from the list, alone or with other such names, numbers and parts that say no more."""
    parts = {x for x in SPLIT.split(word) if x and not x.isdigit()}
    found = parts & OUTSIDE_NAMES
    return bool(found - HEADER_NAMES if in_article else found) and parts <= OUTSIDE_NAMES | BESIDE_NAMES


def _outside(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """0 for an element that may hold the article, 1 for one that only its names speak against, 2 for others; and its names."""
    names, role, unseen = "", "", False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                role = value
            elif name in ("class", "id"):
                names += " " + value
            elif name == "hidden":
                unseen |= value.strip() != "until-found"
            elif name == "style":
                unseen |= bool(UNSEEN.search(value))
    if tag in ("html", "body"):
        return 0, names
    if tag in ("article", "main"):
        return 2 if any(_named(w, False) and set(SPLIT.split(w)) & COMMENT_NAMES for w in names.split()) else 0, names
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article or set(role.split()) & OUTSIDE_ROLES or unseen:
        return 2, names
    return int(bool(names) and tag not in UNNAMED_TAGS and any(_named(w, in_article) for w in names.split())), names


def _settle(nodes: list[Node]) -> None:
    """Names do not put out an element around most of the text of the page that has its title, its article or paragraphs."""
    if not any(x.own == 1 for x in nodes):
        return
    hard: set[int] = set()
    for x in nodes:
        if x.own == 2 or x.parent is not None and id(x.parent) in hard:
            hard.add(id(x))
    sums = {id(x): [0, 0] for x in nodes}
    for x in reversed(nodes):  # parents stand before their children
        if id(x) in hard:
            continue
        mine, tag = sums[id(x)], x.label.split(" ", 1)[0]
        mine[0] += len(x.text or "")
        mine[1] += 2 if tag in ("article", "main", "h1") else tag == "p"
        if x.parent is not None:
            above = sums[id(x.parent)]
            above[0] += mine[0]
            above[1] += mine[1]
    whole = sums[id(nodes[0])][0]
    around = [x for x in nodes if x.own == 1 and id(x) not in hard and 2 * sums[id(x)][0] > whole and sums[id(x)][1] > 1 and not COMMENT_NAMES & set(SPLIT.split(x.label))]
    for x in around:
        x.own = 0
    for x in nodes[1:] if around else ():
        x.outside = x.parent.outside or x.own > 0
        x.article = (x.parent.article or x.label.split(" ", 1)[0] in ("article", "main")) and not x.own


def parse(html: str) -> tuple[Node, list[Node]]:
    """The block tree of a page and its leaves in page order. Broken markup is read as far as it goes."""
    root = Node("#root", None, False, False)
    leaves: list[Node] = []
    nodes = [root]
    stack: list[tuple[str, Node]] = [("#root", root)]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                top = stack[-1][1]
                leaf = Node("#text", text, top.outside, top.article, len(leaves), 0, top)
                top.children.append(leaf)
                nodes.append(leaf)
                leaves.append(leaf)

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else n
            if tag not in ("script", "style", "template"):
                flush()
            continue
        flush()
        if ending:
            close(tag)
            continue
        if tag in VOID:
            continue
        limits = ENDS_PARAGRAPH_IN.get(tag)
        for k in range(len(stack) - 1, 0, -1):
            if limits is None:
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] != "p":
                    break
            elif stack[k][0] in limits:
                break
            elif stack[k][0] == tag or tag in ("td", "th") and stack[k][0] in ("td", "th") or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd"):
                del stack[k:]
                break
        top = stack[-1][1]
        out, names = _outside(tag, attributes, top.article)
        node = Node(tag + names, None, top.outside or out > 0, (top.article or tag in ("article", "main")) and not out, -1, out, top)
        top.children.append(node)
        nodes.append(node)
        stack.append((tag, node))
    flush()
    _settle(nodes)
    for x in nodes:
        x.parent = None  # no cycles, so that a page goes as soon as it is done with
    return root, leaves


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]], memo: dict[tuple[int, int], int] | None = None) -> None:
    """Simple tree matching of two nodes with one label; matched leaves are appended to ``pairs``.

    Child lists are matched in order by the largest sum of subtree matches, at every length: first as many leaves of equal text as
    there can be, then as many nodes.
    """
    memo = {} if memo is None else memo
    x, y, i, p, q = _trimmed(a, b)
    for c, d in [*zip(x[:i], y[:i]), *zip(x[p:], y[q:])]:
        _equal_leaves(c, d, pairs)
    for c, d in _matched(x[i:p], y[i:q], memo):
        if c.text is not None:
            pairs.append((c, d))
        else:
            align(c, d, pairs, memo)


def _trimmed(a: Node, b: Node) -> tuple[list[Node], list[Node], int, int, int]:
    """Both child lists, the length of their equal start, and where their equal ends begin. No other matching of equal ends counts more."""
    x, y = a.children, b.children
    i, p, q = 0, len(x), len(y)
    while i < p and i < q and _same(x[i], y[i]):
        i += 1
    while p > i and q > i and _same(x[p - 1], y[q - 1]):
        p, q = p - 1, q - 1
    return x, y, i, p, q


def _same(c: Node, d: Node) -> bool:
    return c.label == d.label and c.text == d.text and len(c.children) == len(d.children) and all(map(_same, c.children, d.children))


def _equal_leaves(c: Node, d: Node, pairs: list[tuple[Node, Node]]) -> None:
    if c.text is not None:
        pairs.append((c, d))
    for e, f in zip(c.children, d.children):
        _equal_leaves(e, f, pairs)


def _whole(c: Node) -> int:
    return 1 + EQUAL if c.text is not None else 1 + sum(map(_whole, c.children))


def _weight(c: Node, d: Node, memo: dict[tuple[int, int], int]) -> int:
    """What two nodes with one label match; 0 for others."""
    above = 0
    while c.label == d.label:
        if c.text is not None:
            return above + (1 + EQUAL if c.text == d.text else 1)
        above += 1
        if not c.children or not d.children:
            return above
        if len(c.children) > 1 or len(d.children) > 1:
            key = id(c), id(d)
            if key not in memo:
                x, y, i, p, q = _trimmed(c, d)
                memo[key] = sum(map(_whole, x[:i])) + sum(map(_whole, x[p:])) + _best(x[i:p], y[i:q], memo)
            return above + memo[key]
        c, d = c.children[0], d.children[0]
    return above


def _best(x: list[Node], y: list[Node], memo: dict[tuple[int, int], int]) -> int:
    if not x or not y:
        return 0
    if len(y) < SHORT:
        row = [0] * (len(y) + 1)
        for c in x:
            row = _next(row, c, y, memo)
        return row[-1]
    weights, row = _Weights(y, memo), np.zeros(len(y) + 1, np.int64)
    for c in x:
        row = weights.next(row, c)
    return int(row[-1])


def _next(above: list[int], c: Node, y: list[Node], memo: dict[tuple[int, int], int]) -> list[int]:
    row, most = [0], 0
    for j, d in enumerate(y):
        if above[j + 1] > most:
            most = above[j + 1]
        if c.label == d.label:
            w = above[j] + _weight(c, d, memo)
            if w > most:
                most = w
        row.append(most)
    return row


class _Weights:
    """Rows of the programme over a long list: nodes that are one chain down to a leaf get their weights per shape, others per pair."""

    def __init__(self, y: list[Node], memo: dict[tuple[int, int], int]):
        self.y, self.memo = y, memo
        shapes: dict[str, dict[tuple | None, list[int]]] = {}
        texts: dict[tuple, list[int]] = {}
        for j, d in enumerate(y):
            shape, text = self.chain(d)
            shapes.setdefault(d.label, {}).setdefault(shape, []).append(j)
            if shape is not None:
                texts.setdefault((shape, text), []).append(j)
        self.shapes = {k: {s: np.array(js) for s, js in v.items()} for k, v in shapes.items()}
        self.texts = {k: np.array(js) for k, js in texts.items()}

    @staticmethod
    def chain(d: Node) -> tuple[tuple | None, str | None]:
        labels = [d.label]
        while len(d.children) == 1:
            d = d.children[0]
            labels.append(d.label)
        return (tuple(labels), d.text) if not d.children else (None, None)

    def next(self, above: np.ndarray, c: Node) -> np.ndarray:
        row = above.copy()
        w = np.zeros(len(self.y), np.int64)
        shape, text = self.chain(c)
        for other, js in self.shapes.get(c.label, {}).items():
            if shape is None or other is None:
                w[js] = [_weight(c, self.y[j], self.memo) for j in js]
            else:
                w[js] = next((k for k, (s, t) in enumerate(zip(shape, other)) if s != t), min(len(shape), len(other)))
        if shape is not None and text is not None and (shape, text) in self.texts:
            w[self.texts[shape, text]] += EQUAL
        np.maximum(row[1:], above[:-1] + w, out=row[1:])
        return np.maximum.accumulate(row)


def _matched(x: list[Node], y: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """The pairs of the best matching in order. Every k-th row is kept, k the root of the length; rows between are made again on the way back."""
    if not x or not y:
        return []
    if len(y) < SHORT:
        row, step = [0] * (len(y) + 1), lambda above, c: _next(above, c, y, memo)
    else:
        row, step = np.zeros(len(y) + 1, np.int64), _Weights(y, memo).next
    k = len(x) if len(x) < SHORT else math.isqrt(len(x))
    kept = [row]
    for i, c in enumerate(x[:(len(x) - 1) // k * k]):
        row = step(row, c)
        if (i + 1) % k == 0:
            kept.append(row)
    found: list[tuple[Node, Node]] = []
    i, j = len(x), len(y)
    while i and j:
        first = (i - 1) // k * k
        rows = [kept[first // k]]
        for c in x[first:i]:
            rows.append(step(rows[-1], c))
        while i > first and j:
            row, above = rows[i - first], rows[i - first - 1]
            if row[j] == above[j]:
                i -= 1
            elif row[j] == row[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((x[i], y[j]))
    return found[::-1]


def _inside(leaves: list[Node]) -> list[Node]:
    return [x for x in leaves if x.article and not x.outside] or [x for x in leaves if not x.outside]


def main_text(leaves: list[Node], template: set[int]) -> str:
    """Blocks of the article (of the body when there is none) that are neither in an outside container nor template."""
    return "\n".join(x.text for x in _inside(leaves) if x.order not in template)


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _kind(page: Node) -> int:
    """The page type: labels of the outer containers, whatever text blocks stand between them."""
    found: set[str] = set()

    def walk(node: Node, path: str, depth: int) -> None:
        for c in node.children:
            if c.text is None and c.label not in TEXT_BLOCKS:
                found.add(f"{path}/{c.label}")
                if depth:
                    walk(c, f"{path}/{c.label}", depth - 1)

    walk(page, "", 2)
    return _number(*sorted(found))


def _key(leaves: list[Node]) -> int:
    """Equal for pages with the same text, whatever stands around it: such pages count once."""
    return _number(main_text(leaves, set()))


def _blocks(page: Node, leaves: list[Node]) -> Iterator[tuple[Node, int]]:
    """Leaves that may be text of the page, each with a number of its labels from the root and its text."""
    inside = {x.order for x in _inside(leaves)}
    ahead = [(page, "")]
    while ahead:
        node, path = ahead.pop()
        for c in node.children:
            if c.text is None:
                ahead.append((c, f"{path}/{c.label}"))
            elif c.order in inside:
                yield c, _number(path, c.text)


class _References:
    """Parsed reference pages of the last hosts and page types of a task."""

    def __init__(self, texts: dict[tuple[str, int], str] | None, usual: dict[str, int] | None):
        self.texts, self.usual, self.trees = texts, usual, {}

    def tree(self, host: str, page: Node, kind: int | None, html: str | None) -> tuple[int | None, Node | None, int | None]:
        """The page type of the reference, its tree and key."""
        if self.texts is not None:
            kind = _kind(page)
            if (host, kind) not in self.texts:
                kind = self.usual.get(host)
            html = self.texts.get((host, kind))
        if html is None:
            return None, None, None
        if (host, kind) not in self.trees:
            if len(self.trees) > 256:
                self.trees.clear()
            tree, leaves = parse(html)
            self.trees[host, kind] = tree, _key(leaves)
        return kind, *self.trees[host, kind]


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page type or NULL for the whole host, block or NULL for the page, key, hash of a page) of pages that have text."""
    for batch in batches:
        rows: dict[tuple, int] = {}
        for host, html, hashed in _columns(batch, "_host", "_html", "_hash"):
            page, leaves = parse(html)
            if not _inside(leaves):
                continue
            kind, key = _kind(page), _key(leaves)
            for block in [None, *{b for _, b in _blocks(page, leaves)}]:
                for k in (None, kind):
                    row = host, k, block, key
                    rows[row] = min(hashed, rows.get(row, hashed))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]], pa.array(list(rows.values()), pa.int64())],
                                         ["host", "kind", "block", "key", "hash"])


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_kind(parse(h)[0]) for h, in _columns(batch, "_html")], pa.int64())], [*batch.schema.names, "_kind"])


def _evidence(texts, usual):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References(texts and texts.value, usual and usual.value)
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for host, html, kind, reference in _columns(batch, "_host", "_html", "_kind", "_reference"):
                page, leaves = parse(html)
                kind, tree, key = references.tree(host, page, kind, reference)
                if tree is None or not _inside(leaves) or _key(leaves) == key:
                    continue  # a copy of the reference tells nothing
                pairs: list[tuple[Node, Node]] = []
                align(tree, page, pairs)
                for x, y in pairs:
                    s = sums.setdefault((host, kind, x.order), [0, 0])
                    s[0] += 1
                    s[1] += x.text == y.text
            columns = list(zip(*sums)) or [()] * 3
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["host", "kind", "leaf", "seen", "same"])
    return run


def _extraction(texts, usual, templates, recurring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References(texts and texts.value, usual and usual.value)
        for batch in batches:
            out = []
            for host, html, kind, reference, given, known in _columns(batch, "_host", "_html", "_kind", "_reference", "_leaves", "_blocks"):
                page, leaves = parse(html)
                dropped: set[int] = set()
                kind, tree, _ = references.tree(host, page, kind, reference)
                constant = templates.value.get((host, kind)) if templates else given
                if tree is not None and constant:
                    constant, pairs = set(constant), []
                    align(tree, page, pairs)
                    dropped = {y.order for x, y in pairs if x.order in constant and x.text == y.text}
                known = recurring.value.get(host) if recurring else known
                if known:
                    own = {b["block"] for b in known if b["kind"] is None or b["kind"] == _kind(page)}
                    dropped |= {x.order for x, b in _blocks(page, leaves) if b in own}
                out.append(main_text(leaves, dropped))
            kept = [c for c in batch.schema.names if c not in WORKING]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             [*kept, "text", "n_chars"])
    return run


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.9, small: int = 4 << 20, often: float = 0.4) -> DataFrame:
    """Adds text and n_chars to pages (page_id, url, html, others); html goes, columns named text or n_chars too.

    A block is template in either of two cases. It recurs: the same labels from the root and the same text stand on ``min_pages``
    different texts and on the share ``often`` of all texts of its host, or of the host's pages of one type. Or it is constant: pages
    are aligned to the reference of their type (of the host's most frequent type when theirs has under ``min_pages`` texts), and the
    reference leaf keeps its text in ``min_share`` of the pages where it is matched; these are 20, or on smaller hosts the share
    ``often``, ``min_pages`` at least. Pages of equal text count once for blocks, and those equal to the reference never for leaves.

    NULL html counts as empty; pages with a NULL url form one host; repeated rows stay; an empty table gives none. References and
    recurring blocks of all hosts together up to ``small`` bytes are broadcast, beyond that joined.
    """
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]+)", 1), F.lit(""))
    df = pages.select(*kept, F.lower(host).alias("_host"), F.coalesce(F.col("html"), F.lit("")).alias("_html"))
    hashed = F.xxhash64("_html")
    counts = df.select("_host", "_html", hashed.alias("_hash")).mapInArrow(_counted, "host string, kind bigint, block bigint, key bigint, hash bigint")
    counts = counts.groupBy("host", "kind", "block", "key").agg(F.min("hash").alias("hash")).groupBy("host", "kind", "block").agg(
        F.count("*").alias("n"), F.min("hash").alias("hash"))
    counts = stored(counts.where((F.col("n") >= min_pages) | F.col("block").isNull()), "wrapper-counts")
    totals = counts.where("block is null").select(F.col("host").alias("t_host"), F.col("kind").alias("t_kind"), F.col("n").alias("total"), "hash")
    blocks = counts.where("block is not null").join(totals, (F.col("host") == F.col("t_host")) & F.col("kind").eqNullSafe(F.col("t_kind"))).where(
        F.col("n") >= often * F.col("total"))
    blocks = stored(blocks.groupBy("host").agg(F.collect_list(F.struct("kind", "block")).alias("_blocks")), "wrapper-blocks")
    typed = totals.where("t_kind is not null")
    most = typed.groupBy("t_host").agg(F.max_by("t_kind", F.struct("total", "t_kind")).alias("usual"))
    first = stored(typed.join(most, "t_host").where((F.col("total") >= min_pages) | (F.col("t_kind") == F.col("usual"))).select(
        F.col("t_host").alias("r_host"), F.col("t_kind").alias("r_kind"), F.col("usual").alias("r_usual"), F.col("hash").alias("r_hash")), "wrapper-hosts")
    near = F.broadcast(first) if first.count() * 128 <= small else first
    references = stored(df.join(near, (F.col("_host") == F.col("r_host")) & (hashed == F.col("r_hash"))).groupBy("r_host", "r_kind", "r_usual").agg(
        F.min("_html").alias("_reference")), "wrapper-references")
    size = references.agg(F.coalesce(F.sum(F.length("_reference") * 4 + 64), F.lit(0)).alias("n")).first()["n"]
    size += blocks.agg(F.coalesce(F.sum(F.size("_blocks") * 32 + 64), F.lit(0)).alias("n")).first()["n"]
    context = pages.sparkSession.sparkContext
    texts = usual = templates = recurring = None
    if size <= small:
        found = references.collect()
        texts = context.broadcast({(r["r_host"], r["r_kind"]): r["_reference"] for r in found})
        usual = context.broadcast({r["r_host"]: r["r_usual"] for r in found})
        recurring = context.broadcast({r["host"]: r["_blocks"] for r in blocks.collect()})
        beside = df.withColumns({"_kind": F.lit(None).cast("long"), "_reference": F.lit(None).cast("string")})
    else:
        beside = df.mapInArrow(_kinds, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _kind bigint")
        usually = references.select(F.col("r_host").alias("u_host"), F.col("r_usual").alias("u_kind")).distinct()
        owned = references.select(F.col("r_host").alias("o_host"), F.col("r_kind").alias("o_kind"))
        beside = beside.join(usually, F.col("_host") == F.col("u_host"), "left").join(
            owned, (F.col("_host") == F.col("o_host")) & (F.col("_kind") == F.col("o_kind")), "left").withColumn(
            "_kind", F.coalesce("o_kind", "u_kind")).drop("u_host", "u_kind", "o_host", "o_kind")
        beside = beside.join(references.drop("r_usual"), (F.col("_host") == F.col("r_host")) & (F.col("_kind") == F.col("r_kind")), "left").drop("r_host", "r_kind")
    matched = beside.select("_host", "_html", "_kind", "_reference").mapInArrow(
        _evidence(texts, usual), "host string, kind bigint, leaf int, seen bigint, same bigint")
    matched = matched.groupBy("host", "kind", "leaf").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    enough = F.least(F.lit(20), F.greatest(F.lit(min_pages), F.ceil(F.col("total") * often)))
    constant = matched.join(totals.where("t_kind is null"), F.col("host") == F.col("t_host")).where(
        (F.col("seen") >= enough) & (F.col("same") >= F.col("seen") * min_share))
    constant = stored(constant.groupBy("host", "kind").agg(F.collect_list("leaf").alias("_leaves")), "wrapper-templates")
    if size <= small:  # a template is no longer than its reference
        templates = context.broadcast({(r["host"], r["kind"]): r["_leaves"] for r in constant.collect()})
        beside = beside.withColumns({"_leaves": F.lit(None).cast("array<int>"), "_blocks": F.lit(None).cast(blocks.schema["_blocks"].dataType)})
    else:
        constant = constant.select(F.col("host").alias("c_host"), F.col("kind").alias("c_kind"), "_leaves")
        beside = beside.join(constant, (F.col("_host") == F.col("c_host")) & (F.col("_kind") == F.col("c_kind")), "left").drop("c_host", "c_kind").join(
            blocks, F.col("_host") == F.col("host"), "left").drop("host")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema.fields)
    return beside.mapInArrow(_extraction(texts, usual, templates, recurring), schema + "text string, n_chars bigint")
