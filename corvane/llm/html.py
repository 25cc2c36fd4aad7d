"""Main text of web pages: gradient-boosted trees over the features of block nodes, decoded along the tree.

The trees (spark.ml) are trained on a bounded sample of the pages. Their labels come from the pages' own semantic
elements, and from altered copies in which furniture of known kind is planted and the article's element is replaced, so
that attributes, density and place count as well as the element's name. Decoding is a dynamic programme over the page's
tree: a path goes from outside into an article at most once, and out of it again at most once.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches

# fixed values: elements
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template textarea title select svg math iframe object canvas audio video button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
GROUPS = ("p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tfoot tr td th", "figure figcaption", "blockquote pre", "body html")
ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form fieldset", "li dt dd", "table tbody thead tfoot tr td th")
# fixed values: attribute words of furniture and of articles, planted in training copies
FURNITURE = {"nav": "menu nav navbar navigation breadcrumb topnav", "header": "header masthead site-header top-bar branding", "footer": "footer site-footer legal copyright colophon", "aside": "sidebar side widget related recommended trending", "div": "ad ads advert advertisement banner sponsor promo cookie cookie-notice notice consent newsletter subscribe popup modal share social toolbar pagination breadcrumbs", "section": "comments comment-list related-posts recommended reactions disqus responses", "form": "search login signup subscribe comment-form contact"}
ARTICLES = ("article", "main", "div post", "div content", "div article-body", "div entry-content", "section story", "div main-content", "section article")
SLOTS = 64
TURN = 2.0  # what it costs a path to go into an article or out of it
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_ABOVE = {t: i for i, g in enumerate(ABOVE) for t in g.split()}
N_PLAIN = 22
_KNOWN = tuple(frozenset(w for x in names for w in re.split("[ -]", x)) for names in (FURNITURE.values(), (a.partition(" ")[2] for a in ARTICLES)))
SIZE = N_PLAIN + len(GROUPS) + len(ABOVE) + 2 * SLOTS

# a start tag in which a skipped element ends that is never closed: a template only where the page's content must begin
CONTENT = frozenset("body article main".split())
FLOW = CONTENT | frozenset("section header footer nav aside p h1 h2 h3 h4 h5 h6 table figure blockquote".split())
# items of lists and tables close an open item of their own kind, unless a list or table began since
FAMILIES = {t: i for i, (own, around) in enumerate((("li", "ul ol menu dir"), ("dt dd", "dl"), ("tr", "table tbody thead tfoot"), ("td th", "tr table"))) for t in own.split()}
_WITHIN = [frozenset(w.split()) for w in ("ul ol menu dir", "dl", "table tbody thead tfoot", "tr table")]

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)(?:([^<>\"']*)(>))?|([!?]))")
_UP_TO = re.compile(r"[^>=]*")
_BLANK = re.compile(r"\s*")
_ATTR = re.compile(r"([a-zA-Z_:-][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z]+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int
    words: frozenset = frozenset()
    mark: int = -1  # label given in training copies
    kids: list = field(default_factory=list)
    runs: list = field(default_factory=list)  # (place among the page's runs, text) of own text
    own: int = 0
    chars: int = 0
    links: int = 0
    tags: int = 0
    stops: int = 0
    at: int = 0
    place: int = 0  # among its siblings


class _Scanner:
    """Tags of a page in one pass: what has been looked for in vain is never looked for again, so time is linear."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, place: int) -> int:
        if what in self.missing or (at := self.page.find(what, place)) < 0:
            self.missing.add(what)
            return -1
        return at

    def tag_end(self, place: int) -> int:
        """Where '>' ends the tag whose attributes begin at place, as browsers see it: quotes count after '=' alone.
        The end of the page where it isn't closed."""
        page, end = self.page, len(self.page)
        while True:
            place = _UP_TO.match(page, place).end()
            if place >= end or page[place] == ">":
                return place
            place = _BLANK.match(page, place + 1).end()
            if page[place : place + 1] in ('"', "'") and (close := self.find(page[place], place + 1)) >= 0:
                place = close + 1

    def tokens(self) -> list[tuple[int, int, str, bool, str]]:
        """(start and end of the text before, element, closing, attributes) of each tag; the element is empty at the
        page's end. Comments are passed over and so is what a raw element holds."""
        page, end, out, place, begin = self.page, len(self.page), [], 0, 0
        search, raw = _TAG.search, _CLOSE
        while place < end and (m := search(page, place)):
            at, place = m.start(), m.end()
            if m.group(5):  # a comment, a declaration or character data
                kind = ("--", "-->") if page.startswith("--", place) else ("[CDATA[", "]]>") if page.startswith("[CDATA[", place) else ("", ">")
                close = self.find(kind[1], place + len(kind[0]))
                out.append((begin, at, "!", False, ""))
                place = begin = close + len(kind[1]) if close >= 0 else end
                continue
            attrs = m.group(3)
            if not m.group(4):
                stop = self.tag_end(m.end(2))
                attrs, place = page[m.end(2) : stop], min(stop + 1, end)
            tag, closing = m.group(2).lower(), bool(m.group(1))
            out.append((begin, at, tag, closing, attrs))
            if tag in raw and not closing:
                if tag not in self.missing and (close := raw[tag].search(page, place)):
                    place = close.end()
                else:
                    self.missing.add(tag)
                    place = end if tag in ("script", "style") else place  # other raw elements without an end count for nothing
            begin = place
        out.append((begin, end, "", False, ""))
        return out


def _skips(tokens: list) -> dict[int, tuple[int, bool]]:
    """For each start tag of a skipped element the number of the tag that counts again, and whether the text before it
    does. An element without an end tag of its own ends where a block around it closes or the page's content goes on."""
    out: dict[int, tuple[int, bool]] = {}
    flow = {kind: [i for i, t in enumerate(tokens) if not t[3] and t[2] in kind] for kind in (CONTENT, FLOW)}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def lost(tag: str, at: int, end: int) -> None:
        own = flow[CONTENT if tag == "template" else FLOW]
        k = bisect.bisect_right(own, at)
        out[at] = min(end, own[k] if k < len(own) else end), False

    for i, (_, _, tag, closing, attrs) in enumerate(tokens):
        if closing:
            if count.get(tag):
                while True:
                    top, at = stack.pop()
                    count[top] -= 1
                    if top == tag:
                        if tag in SKIPPED:
                            out[at] = i + 1, True
                        break
                    if top in SKIPPED:
                        lost(top, at, i)
        elif tag in BLOCKS and tag != "hr" or tag in SKIPPED and tag not in RAW and not attrs.endswith("/"):
            stack.append((tag, i))
            count[tag] = count.get(tag, 0) + 1
    for tag, at in stack:
        if tag in SKIPPED:
            lost(tag, at, len(tokens) - 1)
    return out


def parse(page: str) -> Node:
    """The tree of block elements; inline elements belong to their block, text between blocks forms runs. A skipped
    element ends at its closing tag or at '/>'; without either, see _skips. Time is linear in the page's length."""
    tokens = _Scanner(page).tokens()
    skips = _skips(tokens) if any(t[2] in SKIPPED and t[2] not in RAW for t in tokens) else {}
    root = now = Node("html", None, 0)
    run: list[str] = []
    links, link, runs, total = 0, False, 0, 0
    opened: dict[str, int] = {}
    near: list[list[Node]] = [[] for _ in _WITHIN]  # open items and what they are items of, by family

    def flush() -> None:
        nonlocal run, links, runs, total
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            now.runs.append((runs, text))
            runs += 1
            now.own += len(text)
            total += len(text)
            now.links += min(links, len(text))
            now.stops += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        run, links = [], 0

    def leave(node: Node) -> Node:
        opened[node.tag] -= 1
        for own in near:
            if own and own[-1] is node:
                own.pop()
        return node.parent

    i, n, counts = 0, len(tokens), True
    while i < n:
        begin, end, tag, closing, attrs = tokens[i]
        if counts and end > begin:
            run.append(page[begin:end])
            links += end - begin if link else 0
        now.tags += tag not in ("", "!")
        i, counts = skips.get(i, (i + 1, True))
        if tag == "a":
            link = not closing
        elif tag in VOID and tag != "hr":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            link = False
            if closing:
                if opened.get(tag):
                    while now.tag != tag:
                        now = leave(now)
                    now = leave(now)
                continue
            if tag == "html":
                continue
            if now.tag == "p" and tag in CLOSES_P:
                now = leave(now)
            if tag in FAMILIES and (own := near[FAMILIES[tag]]) and own[-1].tag in FAMILIES and FAMILIES[own[-1].tag] == FAMILIES[tag]:
                item = own[-1]
                while now is not item:
                    now = leave(now)
                now = leave(now)
            words, mark = set(), -1
            for name, a, b, c in _ATTR.findall(attrs) if "=" in attrs else ():
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    words.update(w for w in _SPLIT.split((a or b or c).lower()) if len(w) > 1)
                elif name == "data-mark":
                    mark = int(a)
            kid = Node(tag, now, now.depth + 1, frozenset(words), mark, at=total, place=len(now.kids))
            now.kids.append(kid)
            if tag != "hr":
                now = kid
                opened[tag] = opened.get(tag, 0) + 1
                for k, within in enumerate(_WITHIN):
                    if tag in within or FAMILIES.get(tag) == k:
                        near[k].append(kid)
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """Parents before children; sums of subtrees are filled in."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.kids))
    for n in reversed(out):
        n.chars += n.own
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.tags += n.tags
            n.parent.stops += n.stops
    return out


@functools.lru_cache(100_000)
def _attribute_bits(words: frozenset) -> tuple[int, int, int]:
    """Slots of attribute words as bits; whether some are known of furniture and of articles."""
    bits = 0
    for w in words:
        bits |= 1 << zlib.crc32(w.encode()) % SLOTS
    return bits, int(bool(words & _KNOWN[0])), int(bool(words & _KNOWN[1]))


def _bits(values: list[int], width: int) -> np.ndarray:
    raw = np.array(values, dtype="<u8").reshape(-1, 1).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :width]


class Rows:
    """Features of the nodes of many pages. Depth counts up to 30: beyond it nothing is told by it."""

    def __init__(self):
        self.plain: list[tuple] = []
        self.groups: list[int] = []
        self.above: list[int] = []
        self.own: list[int] = []
        self.up: list[int] = []

    def add(self, nodes: list[Node]) -> None:
        total = max(nodes[0].chars, 1)
        told: dict[int, tuple] = {}  # by node: what its children inherit
        for n in nodes:
            up, bits = n.parent, _attribute_bits(n.words)
            if up is None:
                above = slots = kn0 = kn1 = 0
                around = (0.0, 0, 0, 0, 0, 0, 1)
            else:
                above, slots, kn0, kn1 = told[id(up)]
                around = (n.place / len(up.kids), len(up.kids), up.chars, up.links, up.tags, n.chars, 1)
            told[id(n)] = (above | (1 << _ABOVE[n.tag] if n.tag in _ABOVE else 0), slots | bits[0], kn0 | bits[1], kn1 | bits[2])
            self.plain.append((n.depth, n.chars, n.links, n.tags, len(n.kids), sum([k.tag == "p" for k in n.kids]), n.own, n.stops, n.at, total, len(n.words), bits[1], bits[2], kn0, kn1, *around))
            self.groups.append(1 << _GROUP[n.tag] if n.tag in _GROUP else 0)
            self.above.append(above)
            self.own.append(bits[0])
            self.up.append(slots)

    def __len__(self) -> int:
        return len(self.plain)

    def matrix(self, a: int, b: int) -> np.ndarray:
        depth, chars, links, tags, kids, p_kids, own, stops, at, total, words, known0, known1, up0, up1, place, siblings, up_chars, up_links, up_tags, _, _ = np.array(self.plain[a:b], dtype=np.float64).T
        some = np.maximum(chars, 1)
        has_up = siblings > 0
        above = np.maximum(up_chars, 1)
        of_up = lambda x: np.where(has_up, x, 0.0)
        plain = np.column_stack([np.minimum(depth, 30), np.log1p(chars), links / some, np.log1p(tags), chars / (tags + 1), kids, p_kids / np.maximum(kids, 1), own / some, 100 * stops / some, chars / total, at / total, place, np.log1p(siblings), of_up(chars / above), of_up(up_links / above), np.log1p(up_chars), of_up(up_chars / (up_tags + 1)), words, known0, known1, up0, up1])
        return np.concatenate([plain.astype(np.float32), _bits(self.groups[a:b], len(GROUPS)), _bits(self.above[a:b], len(ABOVE)), _bits(self.own[a:b], SLOTS), _bits(self.up[a:b], SLOTS)], axis=1, dtype=np.float32)


def decode(nodes: list[Node], margins: np.ndarray) -> list[bool]:
    """Which nodes are article. Of the labellings whose paths go outside, inside, cut (each at most once, in this
    order), the one with the largest sum of signed margins. A margin counts up to 3 either way, so that no one node
    outvotes all others."""
    worth = (np.clip(margins, -3, 3) * np.log1p([n.chars for n in nodes])).tolist()
    out, inside, after = [-w for w in worth], list(worth), [-w for w in worth]
    place = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        out[up] += max(out[i], inside[i] - TURN)
        inside[up] += max(inside[i], after[i] - TURN)
        after[up] += after[i]
    state = [0] * len(nodes)
    for i, n in enumerate(nodes):
        was = 0 if n.parent is None else state[place[id(n.parent)]]
        if was == 0:
            state[i] = 1 if inside[i] - TURN > out[i] else 0
        elif was == 1:
            state[i] = 1 if inside[i] >= after[i] - TURN else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def _planted(page: str, seed: int) -> str:
    """A training copy: furniture around and inside the article, which gets another element."""
    import random

    rng = random.Random(seed)
    m = re.search(r"<article\b[^>]*>", page, re.I)
    end = page.lower().rfind("</article>")
    if not m or end < m.end():
        return ""
    body = page[m.end() : end]
    words = re.sub(r"<[^>]*>|&\w+;", " ", body).split() or ["text"]
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    def furniture(kinds: list[str] | None = None) -> str:
        tag = rng.choice(kinds or list(FURNITURE))
        name = rng.choice(FURNITURE[rng.choice(("div", "section", "aside")) if tag in ("div", "section", "aside") else tag].split())
        attr = f'class="{name}"' if rng.random() < 0.6 else f'id="{name}"' if rng.random() < 0.6 or tag in ("div", "section") else ""
        shape = rng.random()
        if tag == "nav" or shape < 0.3:
            inside = "<ul>" + "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        elif "comment" in name or shape < 0.6:
            inside = "".join(f"<p>{some(3, 60)}</p>" for _ in range(rng.randint(1, 5)))
        elif tag == "form":
            inside = f"<label>{some(1, 3)}</label><input name=q><p>{some(2, 12)}</p>"
        else:
            inside = some(2, 40)
        if rng.random() < 0.4:
            h = rng.choice(("h1", "h2", "h3", "h4"))
            inside = f"<{h}>{some(1, 6)}</{h}>{inside}"
        return f'<{tag} {attr} data-mark="0">{inside}</{tag}>'

    def block(found: re.Match) -> str:
        if rng.random() < 0.75:
            return found.group()
        a, b = rng.choice((("<h2>", "</h2>"), ("<h3>", "</h3>"), ("<div>", "</div>"), ("<div><p>", "</p></div>"), ("<ul><li>", "</li></ul>"), ("<ol><li>", "</li></ol>"), ("<blockquote>", "</blockquote>"), ("<blockquote><p>", "</p></blockquote>"), ("<pre>", "</pre>"), ("<figure><figcaption>", "</figcaption></figure>"), ("<table><tr><td>", "</td></tr></table>"), ("<section><p>", "</p></section>"), ("<header><p>", "</p></header>")))
        text = found.group(1)
        return a + (text if len(a) < 5 or "h" not in a else " ".join(text.split()[:12])) + b

    body = re.sub(r"<p>((?:(?!</?p>).)*)</p>", block, body, flags=re.S)
    tag, _, name = rng.choice(ARTICLES).partition(" ")
    cuts = [c.start() for c in re.finditer(r"<p\b", body)]
    if cuts and rng.random() < 0.5:
        c = rng.choice(cuts)
        body = body[:c] + furniture(["aside", "div", "form"]) + body[c:]
    if rng.random() < 0.3:
        body += furniture(["section", "div", "form"])
    article = f'<{tag} class="{name}" data-mark="1">{body}</{tag}>'
    if rng.random() < 0.5:
        article = f"<div id=wrapper>{article}{furniture() if rng.random() < 0.7 else ''}</div>"
    before = page[: m.start()] + "".join(furniture(["header", "nav", "div"]) for _ in range(rng.randint(0, 3)))
    return before + article + "".join(furniture() for _ in range(rng.randint(1, 4))) + page[end + 10 :]


def _labelled(root: Node, nodes: list[Node]) -> list[int]:
    """1 within an article and not within planted or nested furniture, else 0."""
    marked = any(n.mark == 1 for n in nodes)
    state: dict[int, int] = {}
    for n in nodes:
        was = state[id(n.parent)] if n.parent is not None else 0
        inside = n.mark == 1 or not marked and n.tag == "article"
        state[id(n)] = 2 if was == 2 or was == 1 and (n.mark == 0 or n.tag in ("nav", "aside", "form", "footer")) else 1 if inside or was == 1 else 0
    return [int(state[id(n)] == 1) for n in nodes]


def _training_rows(batches):
    for b in batches:
        xs, ys = [], []
        for page, seed in zip(b.column("html").to_pylist(), b.column("seed").to_pylist(), strict=True):
            for text in (page, _planted(page, seed), _planted(page, seed + 1)):
                if text:
                    nodes, rows = nodes_of(root := parse(text)), Rows()
                    keep = [i for i, n in enumerate(nodes) if n.chars]
                    rows.add(nodes)
                    x, y = rows.matrix(0, len(rows)), _labelled(root, nodes)
                    xs += [x[i].tolist() for i in keep]
                    ys += [y[i] for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["x", "label"])


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: for each tree feature (-1 at leaves), threshold, left, right, value."""

    trees: tuple
    weights: tuple

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(16):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += w * value[at]
        return 2 * out


def fit(pages: DataFrame, max_pages: int = 250, trees: int = 30, depth: int = 5) -> Trees | None:
    """Trains on at most max_pages pages with an article element, those of the least hashes of id and page: the
    documented bound of the sample; each gives two altered copies. None where no page has one: extract() then keeps all but the
    furniture that is known by its element."""
    spark = pages.sparkSession
    small_batches(spark, 200)
    likely = pages.where(F.lower("html").contains("<article")).select("page_id", "html", F.xxhash64("page_id", "html").alias("seed"))
    total = likely.count()
    if not total:
        return None
    share = min(1.0, 2 * max_pages / total)
    few = likely.where(F.pmod("seed", F.lit(1_000_000)) < int(1e6 * share) + 1).orderBy("seed", "page_id").limit(max_pages)
    rows = cut(few.mapInArrow(_training_rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label"), "nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.4, seed=1, subsamplingRate=0.8).fit(rows)
    path = new_path(spark, "trees")
    model.save(path)
    found: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        found.setdefault(r.treeID, []).append(r.nodeData)
    out = []
    for k in sorted(found):
        own = sorted(found[k], key=lambda n: n.id)
        cutoff = [n.split.leftCategoriesOrThreshold[0] if n.leftChild >= 0 else 0.0 for n in own]
        out.append((np.array([n.split.featureIndex if n.leftChild >= 0 else -1 for n in own]), np.array(cutoff), np.array([n.leftChild for n in own]), np.array([n.rightChild for n in own]), np.array([n.prediction for n in own])))
    return Trees(tuple(out), tuple(model.treeWeights))


PER_CALL = 20_000  # nodes whose features are held at once


def _margins(pages: list[list[Node]], model: Trees | None) -> list[np.ndarray]:
    """Margins of the nodes of each page, computed for many pages at once."""
    if model is None:
        return [np.array([-1.0 if n.tag in ("nav", "header", "footer", "aside", "form") else 1.0 for n in nodes]) for nodes in pages]
    rows = Rows()
    for nodes in pages:
        rows.add(nodes)
    margins = np.concatenate([model.margins(rows.matrix(a, min(a + PER_CALL, len(rows)))) for a in range(0, len(rows), PER_CALL)] or [np.zeros(0)])
    return np.split(margins, np.cumsum([len(nodes) for nodes in pages])[:-1])


def main_texts(pages: list[str | None], model: Trees | None) -> list[str]:
    """Of each page the text of the article's blocks in page order, one to a line."""
    out: list[str] = []
    some: list[list[Node]] = []

    def decoded() -> None:
        for nodes, margins in zip(some, _margins(some, model), strict=True):
            keep = decode(nodes, margins) if nodes[0].chars else [False] * len(nodes)
            out.append("\n".join(t for _, t in sorted(r for n, k in zip(nodes, keep, strict=True) if k for r in n.runs)))
        some.clear()

    size = 0
    for page in pages:
        some.append(nodes_of(parse(page or "")))
        size += len(some[-1])
        if size > PER_CALL:
            decoded()
            size = 0
    if some:
        decoded()
    return out


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars in place of html. Null and empty pages, and pages without an
    article, have an empty text and 0 characters; broken markup never fails; repeated rows repeat; an empty table gives
    no rows. Columns other than these three are left out."""
    small_batches(pages.sparkSession, 500)

    def run(batches):
        for b in batches:
            texts = main_texts(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
