"""Main text of web pages by wrapper induction.

Pages of one host are folded into one tree, the host's wrapper: simple tree
matching pairs a page's nodes with the wrapper's in sibling order, and nodes
it leaves over become new ones at their place.  Every page is then matched
with the finished wrapper, and the texts of its nodes are votes for the
wrapper's nodes they are paired with.  A text that most of the pages that have
a node hold there is constant: it belongs to the host's template.  What varies
is a slot, and slots become content unless the element they fill is a menu,
header, footer, sidebar, notice, advert, form or comment by its tag, role or
class words.

Plan.  First scan: each page becomes a compact tree (block elements, hashes
of their texts; runs of equal leaves, such as paragraphs or list items, are
one node), about a tenth of the page; equal trees of a host are one row.  Trees
of one shape (without their texts) are folded once, with their number: a
host's shapes are dealt over parts of about ``CHUNK``, each part folds into a
tree, and ``FAN`` parts at a time into one until each host has one.  A part
passes on the nodes that ``MIN_PAGES`` of its pages have, so that classes
that differ on every page do not pile up.  Second scan, over the compact
trees: votes, summed in the tasks and by node and text.  Third scan: pages are
matched with their wrapper and extracted.  Trees and pages meet the wrapper by
a join on the host (adaptive execution broadcasts that table if its size
allows, or splits a hot host) and are never gathered by host; a task unpacks a
host's wrapper once.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, materialize, read_table, text_or_empty
from evtrail.llm.registry import query
from evtrail.llm.url_reputation import host_and_path

CHUNK = 250               # shapes of trees that one task folds, about
FAN = 16                  # folded trees that meet in one task
CELLS = 1 << 14           # of a matching table held whole; the same pairs are found row by row beyond
HOSTS = 64                # wrappers a task keeps unpacked
VOTES = 200_000           # votes a task has in hand
MIN_PAGES = 2             # distinct pages that have to hold a text before it counts as constant
CONSTANT_SHARE = 0.6      # of the distinct pages of the host that have the node
MAX_DEPTH = 200           # deeper elements count as children of the last one

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav aside footer form button dialog menu fieldset head input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
                "tbody": {"thead", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table div section article main body td th blockquote".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notification popup modal overlay newsletter subscribe subscription paywall share sharing social "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments disqus reply "
    "replies respond related recommended recommendations widget toolbar login signup search skip topbar masthead "
    "alert".split())
LAYOUT = frozenset("has no not with without".split())
ARTICLE_WORDS = frozenset("article post entry story content main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")   # names whole, values skipped over
_WORD = re.compile(r"\w")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _weight(text: str) -> int:
    """Characters of a text; none if it has no word character."""
    text = entities.unescape(text) if "&" in text else text
    return len(text.strip()) if _WORD.search(text) else 0


class Node:
    __slots__ = ("tag", "words", "drop", "items", "parent", "depth", "links", "by_word")

    def __init__(self, tag, words=(), drop=False, parent=None):
        self.tag, self.words, self.drop, self.parent = tag, words, drop, parent
        self.items: list = []                # texts and nodes in page order
        self.depth = parent.depth + 1 if parent else 0
        self.links = 0                       # characters inside links
        self.by_word = ""                    # "whole" or "part": dropped for a class or id only


def _attributes(tag: str, text: str) -> tuple[tuple[str, ...], bool, str]:
    """(class and id words, whether the element is dropped, and if only a
    class or id says so: "whole" if all of a name does, else "part").  A name
    that begins with a word of ``LAYOUT`` tells what else the page has."""
    if not text or "=" not in text and "hidden" not in text:
        return (), tag in DROPPED, ""
    words: list[str] = []
    drop, by_word = tag in DROPPED, ""
    for name, value in _ATTR.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                own = [w.lower() for w in _WORDS.findall(one)]
                words += own
                if own and own[0] not in LAYOUT and not DROPPED_WORDS.isdisjoint(own):
                    by_word = "whole" if by_word == "whole" or DROPPED_WORDS.issuperset(own) else "part"
        elif name == "role":
            drop |= value.lower() in DROPPED_ROLES
        elif name == "style":
            drop |= "display:none" in value.replace(" ", "").lower()
        elif name in ("hidden", "aria-hidden"):
            drop |= value.lower() != "false"
    return tuple(words), drop or by_word != "", "" if drop else by_word


def parse(page: str) -> Node:
    """Block tree of an HTML page, as browsers would nest it in the common
    cases: void and raw elements, implied ends, stray end tags.  Inline
    elements leave only their text."""
    root = node = Node("html")
    at, end, in_link = 0, len(page), 0
    lower = None
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else end]
        if text:
            node.items.append(text)
            if in_link:
                node.links += _weight(text)
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not page.endswith(">", 0, at):     # the page ends inside a tag
            break
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                lower = lower if lower is not None else page.lower()
                stop = lower.find("</" + tag, at)
                close = page.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else end
            continue
        if closing:
            if tag == "a":
                in_link = 0
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        words, drop, by_word = _attributes(tag, attrs)
        if tag in INLINE and not (drop and words):
            if tag == "a":
                in_link = 1
            elif tag in ("br", "wbr", "img"):
                node.items.append(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while node.parent and node.tag != "html":
                    node = node.parent
            continue
        closes = P_CLOSERS if tag in P_CLOSERS else ()
        up = node
        while closes and up.parent and up.tag not in SCOPES:
            if up.tag == "p":
                node = up.parent
                break
            up = up.parent
        if tag in SELF_CLOSERS:
            up = node
            while up.parent and up.tag not in SCOPES - {"td", "th"} | {"table"} - SELF_CLOSERS[tag]:
                if up.tag in SELF_CLOSERS[tag]:
                    node = up.parent
                up = up.parent
        child = Node(tag, words, drop, node)
        child.by_word = by_word
        node.items.append(child)
        if tag not in VOID and not attrs.endswith("/") and child.depth < MAX_DEPTH:
            node = child
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def own_texts(node: Node) -> list[str]:
    """The texts directly in an element, one for each stretch between blocks."""
    out, run = [], []
    for item in [*node.items, None]:
        if isinstance(item, str):
            run.append(item)
        elif run:
            if text := _clean(run):
                out.append(text)
            run = []
    return out


def _hash(*parts) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest("\x00".join(map(str, parts))) >> 1


# -------------------------------------------------- compact trees, STM ---

def compact(node: Node, at: dict | None = None) -> list:
    """[signature, text hashes, children]: block elements only; a run of
    leaves with one signature is one node with all their texts.  ``at`` takes
    the compact node of every element, by its identity."""
    kids: list[list] = []
    for item in node.items:
        if isinstance(item, str):
            continue
        kid = compact(item, at)
        if not kid[1] and not kid[2]:
            continue
        if kids and not kid[2] and kids[-1][0] == kid[0] and not kids[-1][2]:
            kids[-1][1].extend(kid[1])
            kid = kids[-1]
        else:
            kids.append(kid)
        if at is not None:
            at[id(item)] = kid
    own = [_hash(node.tag, *sorted(set(node.words))), [_hash(t) for t in own_texts(node)], kids]
    if at is not None:
        at[id(node)] = own
    return own


def _shape(node, memo: dict) -> tuple[int, int]:
    """(hash of the signatures, number of nodes) of a tree."""
    known = memo.get(id(node))
    if known is None:
        below = [_shape(kid, memo) for kid in node[2]]
        known = memo[id(node)] = hash((node[0], *(h for h, _ in below))), 1 + sum(n for _, n in below)
    return known


def _best_pairs(x, y, memo: dict) -> list[tuple]:
    """Pairs of two sibling lists, in order, whose matchings add up to most."""
    table = [[0] * (len(y) + 1)]
    for p in x:
        row, above = [0], table[-1]
        for j, q in enumerate(y):
            w = tree_match(p, q, memo) if p[0] == q[0] else 0
            row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
        table.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], y[j]))
    return pairs[::-1]


def _long_pairs(x, y, memo: dict) -> list[tuple]:
    """The pairs of ``_best_pairs`` for lists whose table would be large: a row
    is an array, every so many rows one is kept, and those between are made
    again on the way back.  Trees of one shape weigh the same; what was
    remembered to weigh a pair is forgotten, so ``memo`` does not grow with
    the table.  The shapes of all nodes are known already."""
    import numpy as np
    kinds: dict = {}
    for q in y:
        kinds.setdefault(_shape(q, memo)[0], (len(kinds), q))
    kind = np.array([kinds[_shape(q, memo)[0]][0] for q in y])
    weights: dict = {}

    def rows(above, nodes):
        for p in nodes:
            shape = _shape(p, memo)[0]
            if shape not in weights:
                if len(weights) * len(kinds) > CELLS << 6:
                    weights.clear()
                known = len(memo)
                weights[shape] = np.array([tree_match(p, q, memo) for _, q in kinds.values()], np.int64)
                while len(memo) > known:
                    memo.popitem()
            w = weights[shape][kind]
            row = above.copy()
            np.maximum(row[1:], np.where(w > 0, above[:-1] + w, 0), out=row[1:])
            above = np.maximum.accumulate(row)
            yield above

    step = math.isqrt(len(x)) + 1
    kept, row = [], np.zeros(len(y) + 1, np.int64)
    for lo in range(0, len(x), step):
        kept.append(row)
        for row in rows(row, x[lo:lo + step]):
            pass
    pairs, i, j = [], len(x), len(y)
    while i and j:
        lo = (i - 1) // step * step
        table = [kept[lo // step], *rows(kept[lo // step], x[lo:i])]
        while i > lo and j:
            if table[i - lo][j] == table[i - lo - 1][j]:
                i -= 1
            elif table[i - lo][j] == table[i - lo][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
    return pairs[::-1]


def tree_match(a, b, memo: dict) -> int:
    """Size of the largest simple matching of two compact trees; ``memo``
    keeps the pairs of children it is made of.  Equal subtrees at the ends of
    two sibling lists are paired without a table, which loses nothing."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key in memo:
        return memo[key][0]
    (shape, size), x, y = _shape(a, memo), a[2], b[2]
    if shape == _shape(b, memo)[0]:
        memo[key] = size, list(zip(x, y))
        return size
    lo, i, j = 0, len(x), len(y)
    while lo < min(i, j) and _shape(x[lo], memo)[0] == _shape(y[lo], memo)[0]:
        lo += 1
    while min(i, j) > lo and _shape(x[i - 1], memo)[0] == _shape(y[j - 1], memo)[0]:
        i, j = i - 1, j - 1
    best = _long_pairs if (i - lo) * (j - lo) > CELLS else _best_pairs
    pairs = [*zip(x[:lo], y[:lo]), *best(x[lo:i], y[lo:j], memo), *zip(x[i:], y[j:])]
    memo[key] = 1 + sum(tree_match(p, q, memo) for p, q in pairs), pairs
    return memo[key][0]


def aligned(a, b, memo: dict | None = None):
    """All pairs of nodes of a best matching, parents first."""
    memo = {} if memo is None else memo
    todo = [(a, b)] if tree_match(a, b, memo) else []
    while todo:
        pair = todo.pop()
        yield pair
        tree_match(*pair, memo)
        todo += memo[id(pair[0]), id(pair[1])][1]


# A wrapper's node is [signature, (), children, pages that have it, name].

def skeleton(tree, pages: int) -> list:
    """A compact tree without its texts, as a wrapper of so many pages."""
    return [tree[0], (), [skeleton(kid, pages) for kid in tree[2]], pages, 0]


def fold(wrapper: list, other: list) -> None:
    """Add a wrapper to another: pages of matched nodes are added up, others
    become new nodes before the next matched sibling."""
    memo: dict = {}
    for p, q in list(aligned(wrapper, other, memo)):
        p[3] += q[3]
        pairs = memo[id(p), id(q)][1]
        if len(pairs) == len(q[2]):
            continue
        mate = {id(y): x for x, y in pairs}
        rest, merged = iter(p[2]), []
        for kid in q[2]:
            known = mate.get(id(kid))
            if known is None:
                merged.append(kid)
                continue
            for x in rest:
                merged.append(x)
                if x is known:
                    break
        p[2] = [*merged, *rest]


def pruned(wrapper: list, least: int = 0) -> list:
    """Without the nodes that fewer pages have."""
    wrapper[2] = [pruned(kid, least) for kid in wrapper[2] if kid[3] >= least]
    return wrapper


def name_nodes(wrapper: list) -> None:
    """Name each node by its parent, signature and place among equal siblings."""
    wrapper[4] = _hash(wrapper[0])
    todo = [wrapper]
    while todo:
        node = todo.pop()
        seen: Counter = Counter()
        for kid in node[2]:
            kid[4] = _hash(node[4], kid[0], seen[kid[0]])
            seen[kid[0]] += 1
        todo += node[2]


def _tree_batches(batches):
    import marshal

    import pyarrow as pa
    from xxhash import xxh64_intdigest
    for b in batches:
        trees = [compact(parse(p)) for p in b.column(1).to_pylist()]
        blobs = [marshal.dumps(t, 2) for t in trees]
        shapes = [marshal.dumps(skeleton(t, 1), 2) for t in trees]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([xxh64_intdigest(x) >> 1 for x in of], pa.int64()) for of in (blobs, shapes)),
             pa.array(blobs, pa.binary())], ["host", "tree_hash", "shape", "tree"])


def _fold_batches(first: bool):
    """Rows sorted by host and part -> one wrapper of each."""
    def run(batches):
        import marshal

        import pyarrow as pa
        key, wrapper = None, None

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([key[1]], pa.int64()),
                 pa.array([wrapper[3]], pa.int64()), pa.array([marshal.dumps(pruned(wrapper, MIN_PAGES), 2)], pa.binary())],
                ["host", "part", "shape", "n", "tree"])

        for b in batches:
            for host, part, n, blob in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), b.column(4)):
                tree = marshal.loads(blob.as_py())
                tree = skeleton(tree, n) if first else tree
                if (host, part) == key:
                    fold(wrapper, tree)
                    continue
                if key:
                    yield close()
                key, wrapper = (host, part), tree
        if key:
            yield close()
    return run


class Wrappers:
    """Unpacked wrappers of the hosts a task has met last."""

    def __init__(self):
        self.known: dict = {}

    def of(self, host, blob, constants=None) -> tuple[list, frozenset]:
        """``blob`` and ``constants``: Arrow values, read for a new host only."""
        if host not in self.known:
            import marshal
            if len(self.known) >= HOSTS:
                self.known.clear()
            tree = marshal.loads(blob.as_py())
            name_nodes(tree)
            self.known[host] = tree, frozenset(
                (x["node"], x["constant"]) for x in (constants.as_py() if constants is not None else ()))
        return self.known[host]


def _vote_batches(batches):
    """Trees with their host's wrapper -> (host, node, constant, votes);
    constant -1: the page has the node."""
    import marshal

    import pyarrow as pa
    wrappers, votes = Wrappers(), Counter()

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array([v[i] for v in votes], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            + [pa.array(list(votes.values()), pa.int64())], ["host", "node", "constant", "votes"])
        votes.clear()
        return out

    for b in batches:
        for host, blob, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            for known, node in aligned(wrappers.of(host, packed)[0], marshal.loads(blob.as_py())):
                if node[1]:
                    votes[host, known[4], -1] += 1
                    votes.update({(host, known[4], t) for t in node[1]})
            if len(votes) > VOTES:
                yield flush()
    yield flush()


def host_wrappers(trees: DataFrame) -> DataFrame:
    """``trees``: distinct rows host, tree_hash, shape, tree.  One row for each
    host of at least ``MIN_PAGES`` of them: ``host``, ``wrapper``."""
    shapes = materialize(trees.groupBy("host", "shape")
                         .agg(F.count(F.lit(1)).alias("n"), F.first("tree").alias("tree")), "wrap-shapes")
    sizes = materialize(shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"),
                                                   F.sum("n").alias("pages"))
                        .where(F.col("pages") >= MIN_PAGES).select("host", "parts"), "wrap-sizes")
    left = sizes.agg(F.max("parts")).first()[0] or 1
    rows = shapes.join(sizes, "host").select("host", F.pmod("shape", "parts").alias("part"), "shape", "n", "tree")
    first = True
    while True:
        # frequent shapes first: they are what others are added to
        rows = materialize(rows.repartition("host", "part")
                           .sortWithinPartitions("host", "part", F.desc("n"), "shape")
                           .mapInArrow(_fold_batches(first), "host string, part long, shape long, n long, tree binary"),
                           "wrap-folded")
        if left == 1:
            return rows.select("host", F.col("tree").alias("wrapper"))
        first, left = False, -(-left // FAN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN))


def host_constants(pages: DataFrame) -> DataFrame:
    """``pages``: host, html.  One row per host with a template: ``host``,
    ``wrapper``, ``constants`` (node and hash of the text).  A node has fewer
    than 1 / ``CONSTANT_SHARE`` constants for each text a page holds there."""
    trees = in_arrow(pages, _tree_batches, "host string, tree_hash long, shape long, tree binary")
    # a copy of a page is no further evidence
    trees = materialize(trees.dropDuplicates(["host", "tree_hash"]), "wrap-trees")
    wrappers = host_wrappers(trees)
    votes = in_arrow(trees.join(wrappers, "host").select("host", "tree", "wrapper"), _vote_batches,
                     "host string, node long, constant long, votes long")
    votes = materialize(votes.groupBy("host", "node", "constant").agg(F.sum("votes").alias("votes"))
                        .where(F.col("votes") >= MIN_PAGES), "wrap-votes")
    have = votes.where("constant = -1").select("host", "node", F.col("votes").alias("pages"))
    constants = (votes.where("constant <> -1").join(have, ["host", "node"])
                 .where(F.col("votes") >= F.col("pages") * CONSTANT_SHARE)
                 .groupBy("host").agg(F.collect_list(F.struct("node", "constant")).alias("constants")))
    return wrappers.join(constants, "host")


# ------------------------------------------------------- extraction ------

def _dropped(node: Node, inside: bool) -> bool:
    return node.drop and not (inside and node.tag in HEADINGS)


def _blocks(start: Node, names: dict, inside: bool):
    """(block text, its node's name in the wrapper, heading) in page order.
    Of a header inside the article, headings stay."""
    out = []
    todo: list = [("node", start, False)]
    run: list[str] = []
    where = (names.get(id(start)), False)

    def flush():
        if run:
            if text := _clean(run):
                out.append((text, *where))
            run.clear()

    while todo:
        kind, item, only_headings = todo.pop()
        if kind == "text":
            if not only_headings:
                run.append(item)
            continue
        flush()
        if kind == "back":
            where = (names.get(id(item)), where[1])
            continue
        heading = item.tag in HEADINGS
        where = (names.get(id(item)), heading)
        header = item.tag == "header" or item is not start and "header" in item.words
        if header and not inside:
            continue
        keep = (only_headings or header) and not heading
        todo.append(("back", item, False))
        for child in reversed(item.items):
            if isinstance(child, str):
                todo.append(("text", child, keep))
            elif not _dropped(child, inside):
                todo.append(("back", item, False))
                todo.append(("node", child, keep))
    flush()
    return out


def _length(node: Node) -> tuple[int, int]:
    """(characters of text, of these in links) below a node, without dropped parts."""
    n = links = 0
    todo = [node]
    while todo:
        x = todo.pop()
        links += x.links
        for item in x.items:
            if isinstance(item, str):
                n += _weight(item)
            elif not item.drop:
                todo.append(item)
    return n, links


def spare_wrappers(root: Node) -> None:
    """Where no article or ``main`` is outside of dropped elements, those that
    only a class or id word would drop stay if they hold ``main``, or if they
    hold over half of the page's text and an article, or are named like
    content, or the word is only part of a name."""
    order, todo, reached = [], [(root, False)], False
    while todo:
        node, under = todo.pop()
        if node.drop and not node.by_word:
            continue
        under = under or node.drop
        order.append((node, under))
        reached |= node.tag in ("article", "main") and not under
        todo += [(x, under) for x in node.items if not isinstance(x, str)]
    if reached or not any(node.drop for node, _ in order):
        return
    size: dict[int, int] = {}
    holds: dict[int, int] = {}               # 1 with an article at or below, 2 with main
    for node, _ in reversed(order):          # inner elements first
        size[id(node)] = size.get(id(node), 0) + sum(_weight(x) for x in node.items if isinstance(x, str))
        if node.tag in ("article", "main") and (not node.drop or not ARTICLE_WORDS.isdisjoint(node.words)):
            holds[id(node)] = max(holds.get(id(node), 0), 1 + (node.tag == "main"))
        if node.parent:
            up = id(node.parent)
            size[up] = size.get(up, 0) + size[id(node)]
            holds[up] = max(holds.get(up, 0), holds.get(id(node), 0))
    for node, _ in order:
        if node.drop:
            most = 2 * size[id(node)] > size[id(root)]
            content = node.by_word == "part" or not ARTICLE_WORDS.isdisjoint(node.words)
            node.drop = not (holds.get(id(node), 0) + most > 1 or most and content)


def spare_emptied(root: Node) -> bool:
    """Keep the parts of an article or ``main`` that only a class or id word
    drops; for pages of which nothing else is left.  True if there are any."""
    todo, spared = [(root, False)], False
    while todo:
        node, inside = todo.pop()
        if node.drop and not (inside and node.by_word):
            continue
        spared |= node.drop
        node.drop = False
        inside |= node.tag in ("article", "main")
        todo += [(x, inside) for x in node.items if not isinstance(x, str)]
    return spared


def _holds_article(node: Node) -> bool:
    """Whether an article with text is below a node."""
    todo = [node]
    while todo:
        below = [x for x in todo.pop().items if not isinstance(x, str) and not x.drop]
        if any(x.tag == "article" and _length(x)[0] for x in below):
            return True
        todo += below
    return False


def content_roots(root: Node) -> list[Node]:
    """The elements that hold the main text, in page order: all articles and
    ``main`` elements (an article within ``main`` comes with what is around
    it; where one does, articles outside of ``main`` are teasers), else all
    elements named like one, else the whole page.  None is left out for its
    length."""
    found: dict[str, list] = {"article": [], "named": []}
    todo = [(root, False)]
    while todo:
        node, in_named = todo.pop()
        if node is not root:
            if node.drop:
                continue
            if node.tag in ("article", "main"):
                found["article"].append(node)
                continue
            if not in_named and not ARTICLE_WORDS.isdisjoint(node.words):
                found["named"].append(node)
                in_named = True
        todo += [(x, in_named) for x in reversed(node.items) if not isinstance(x, str)]
    if any(n.tag == "main" and _holds_article(n) for n in found["article"]):
        found["article"] = [n for n in found["article"] if n.tag == "main"]
    for kind in ("article", "named"):
        if any(_length(n)[0] for n in found[kind]):
            return found[kind]
    return [root]


def node_names(root: Node, wrapper: list) -> dict:
    """Names of the wrapper's nodes that a page's elements are paired with, by
    the element's identity."""
    at: dict = {}
    tree = compact(root, at)
    names = {id(node): known[4] for known, node in aligned(wrapper, tree)}
    return {element: names[id(node)] for element, node in at.items() if id(node) in names}


def main_text(page: str, wrapper: list | None = None, constants: frozenset = frozenset()) -> str:
    """Blocks of the page's content, joined by line feeds.  ``constants``:
    (node, text hash) of the wrapper."""
    root = parse(page)
    names = node_names(root, wrapper) if constants else {}
    spare_wrappers(root)
    roots = content_roots(root)
    if not any(_length(node)[0] for node in roots) and spare_emptied(root):
        roots = content_roots(root)
    whole = roots[0] is root
    if whole and not constants:               # no article, no template known: a list of nothing but links is a menu
        nodes, todo = [], [root]
        while todo:
            inner = [x for x in todo.pop().items if not isinstance(x, str) and not x.drop]
            nodes += inner
            todo += inner
        for node in reversed(nodes):          # inner elements first
            if node.tag in ("ul", "ol", "table", "div"):
                n, links = _length(node)
                node.drop = links == n > 0
    blocks = [b for node in roots for b in _blocks(node, names, not whole)]
    varying = [t for t, name, heading in blocks
               if heading or not names or (name, _hash(t)) not in constants]
    # a page whose every block is constant is a copy, not a template
    return "\n".join(varying or [t for t, _, _ in blocks])


def _extract_batches(batches):
    import pyarrow as pa
    wrappers = Wrappers()
    for b in batches:
        texts = []
        for host, page, blob, constants in zip(b.column(2).to_pylist(), b.column(3).to_pylist(),
                                               b.column(4), b.column(5)):
            known = wrappers.of(host, blob, constants) if blob.is_valid else ()
            texts.append(main_text(page, *known))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Defined cases: a null or empty html has an empty text; a null url, or one
    without a host, shares the template of the empty host; pages that repeat
    are extracted each, and copies count once as evidence for a template; an
    empty table gives an empty result; other columns are not read.
    """
    host, _ = host_and_path("url")
    own = pages.select("page_id", "url", host.alias("host"), text_or_empty("html").alias("html"))
    constants = materialize(host_constants(own.select("host", "html")), "wrap-constants")
    kind = own.schema["page_id"].dataType.simpleString()
    return in_arrow(own.join(constants, "host", "left").select("page_id", "url", "host", "html", "wrapper", "constants"),
                    _extract_batches, f"page_id {kind}, url string, text string, n_chars long")


@query("op4_wrapper_induction")
def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
