"""Main text of pages by a tree-structured graphical model (operator 10).

The DOM of a page is a tree of binary variables, article or not. Each element has a unary potential from its tag, the words
of its names, its own text and its links; each parent and child a pairwise potential by the child's kind. Sum-product
messages go up the tree once and down once and give the exact marginal of every element; both kinds of potentials are
fitted by gradient on the likelihood of labelled pages (``htmlpages``), whose expectations are those same marginals.
The text of elements whose marginal is at least one half is the article.

Cases: null or empty html gives an empty text; broken markup (unclosed, stray or misnested tags, cut-off scripts) is read as
a browser would roughly; very long pages and deep trees are read whole, without recursion; a page with no article gives an
empty text; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import htmlpages, runtime

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select option".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "button", "html", "head", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",)}
P_FENCE = ("button", "td", "th", "table", "object")
CONTAINERS = frozenset("article main section div body td".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?![^<]*[\"']))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|data-y|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


class Tree:
    """Elements of a page in page order, and its text runs (element, text)."""

    __slots__ = ("tag", "attr", "parent", "runs", "label")

    def __init__(self):
        self.tag: list[str] = ["html"]
        self.attr: list[str] = [""]
        self.parent: list[int] = [-1]
        self.label: list[int] = [-1]
        self.runs: list[tuple[int, str]] = []


class _Open:
    """The open elements of a page, and for each tag where on the stack its open elements lie.

    Every question the parser asks - the nearest open paragraph, the nearest list - is the end of one such row, so a page
    costs time in proportion to its length however deep it is nested and however many stray tags it has.
    """

    __slots__ = ("tags", "nodes", "at", "blocks")

    def __init__(self):
        self.tags, self.nodes = ["html"], [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def close(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of some tags; 0 if there is none."""
        return max((row[-1] for x in tags if (row := self.at.get(x))), default=0)

    def first_after(self, tags: tuple[str, ...], fence: int) -> int:
        """Place of the outermost open element of some tags inside the fence; 0 if there is none."""
        return min((row[bisect.bisect(row, fence)] for x in tags if (row := self.at.get(x)) and row[-1] > fence), default=0)


def parse(page: str | None, labels: bool = False) -> Tree:
    """The tree of block elements. Inline elements are no nodes: their text belongs to the block around them, links marked by \x00 and \x01."""
    t, page = Tree(), page or ""
    stack = _Open()
    nodes = stack.nodes
    at, size = 0, len(page)
    runs = t.runs
    find = _TAG.search
    while at < size:
        m = find(page, at)
        if m is None:
            runs.append((nodes[-1], page[at:]))
            break
        if m.start() > at:
            runs.append((nodes[-1], page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # end tag
            if tag == "a":
                runs.append((nodes[-1], "\x01"))
            k = stack.last((tag,))
            if k > (0 if tag in BLOCK else stack.blocks[-1]):  # an inline end tag doesn't close a block
                stack.close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            runs.append((nodes[-1], " "))
            continue
        if tag in CLOSES_P and (k := stack.last(("p",))) > stack.last(P_FENCE):
            stack.close(k)
        if tag in SAME:
            fence = stack.last(FENCE[tag])
            k = stack.first_after(SAME[tag], fence) if tag in ("tr", "tbody") else stack.last(SAME[tag])
            if k > fence:
                stack.close(k)
        if tag in BLOCK:
            t.tag.append(tag)
            t.attr.append(m[3])
            t.parent.append(nodes[-1])
            if labels:
                y = re.search(r'data-y="(\d)"', m[3])
                t.label.append(int(y[1]) if y else -1)
            runs.append((len(t.tag) - 1, ""))  # a block boundary
            if tag not in VOID:
                stack.push(tag, len(t.tag) - 1)
        elif tag == "a":
            runs.append((nodes[-1], "\x00"))
            stack.push(tag, nodes[-1])
        elif tag not in VOID:
            stack.push(tag, nodes[-1])
    return t


def pieces(t: Tree) -> list[tuple[int, str, int]]:
    """Blocks of text in page order: (element, text with white space folded, characters inside links)."""
    out: list[tuple[int, str, int]] = []
    owner, held = -1, []

    def flush():
        raw = "".join(held)
        if not raw.strip("\x00\x01 \n\t\r"):
            return
        linked = 0
        if "\x00" in raw or "\x01" in raw:
            linked = sum(len(x.split("\x01")[0]) for x in raw.split("\x00")[1:])
            raw = raw.replace("\x00", "").replace("\x01", "")
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((owner, text, linked))

    for node, text in t.runs:
        if node != owner or text == "":
            flush()
            owner, held = node, []
        held.append(text)
    flush()
    return out


def _bins(words: int, chars: int, linked: int, last: str, commas: int) -> tuple[str, ...]:
    share = linked / max(1, chars)
    return (
        f"#words{min(8, words.bit_length())}",
        f"#links{0 if not linked else 1 + min(3, int(share * 4))}",
        f"#end{'.' if last in '.!?' else 'w' if last.isalnum() else '-' if last else ''}",
        f"#comma{min(3, commas)}",
    )


def describe(t: Tree, blocks: list[tuple[int, str, int]]) -> list[list[str]]:
    """Features of every element: its tag, the words of its names, its own text."""
    words, chars, linked, last, commas = ([0] * len(t.tag) for _ in range(5))
    last = [""] * len(t.tag)
    for node, text, link in blocks:
        words[node] += text.count(" ") + 1
        chars[node] += len(text)
        linked[node] += link
        last[node] = text[-1]
        commas[node] += text.count(",")
    whole, heads = list(words), [0] * len(t.tag)
    for k in range(len(t.tag) - 1, 0, -1):  # words below each element; headings right below it
        whole[t.parent[k]] += whole[k]
        heads[t.parent[k]] += t.tag[k] in ("h1", "h2")
    out = []
    for k, tag in enumerate(t.tag):
        named = names(t.attr[k])
        f = [f"<{tag}", f"<{tag}{'' if named else ':bare'}", f"{t.tag[t.parent[k]] if k else ''}>{tag}", *named]
        if tag in CONTAINERS:
            f += (f"<{tag}#{min(2, heads[k])}", f"#below{min(12, whole[k].bit_length())}")
        f += _bins(words[k], chars[k], linked[k], last[k], commas[k]) if chars[k] else ("#none",)
        out.append(f)
    return out


_names: dict[str, tuple[str, ...]] = {}


def names(attr: str) -> tuple[str, ...]:
    """Words of class, id and role; \"hidden\" for elements that aren't shown."""
    if not attr:
        return ()
    hit = _names.get(attr)
    if hit is None:
        if len(_names) > 50_000:
            _names.clear()
        found = set()
        for m in _ATTR.finditer(attr):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "data-y" or key == "aria-hidden" and value != "true":
                continue
            found.update(f"@{x}" for x in _NAME.findall(value)) if key in ("class", "id", "role") else found.add("@hidden")
        hit = _names[attr] = tuple(sorted(found))
    return hit


def marginals(parent: list[int], unary: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(article) of every element and the joint of every (parent, child), by sum-product up and down the tree.

    unary: log odds of 1 against 0. edge[k]: log potentials (00, 01, 10, 11) of (parent of k, k). Parents come first.
    """
    n = len(parent)
    up, to_parent = list(unary), [0.0] * n
    for k in range(n - 1, 0, -1):  # messages to parents, as log odds
        a, b, c, d = edge[k]
        u = up[k]
        x0 = max(a, b + u)
        x1 = max(c, d + u)
        message = x1 + math.log(math.exp(c - x1) + math.exp(d + u - x1)) - x0 - math.log(math.exp(a - x0) + math.exp(b + u - x0))
        to_parent[k] = message
        up[parent[k]] += message
    full = list(up)
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    for k in range(1, n):
        a, b, c, d = edge[k]
        above = full[parent[k]] - to_parent[k]  # the parent without this child
        x0 = max(a, c + above)
        x1 = max(b, d + above)
        full[k] = up[k] + x1 + math.log(math.exp(b - x1) + math.exp(d + above - x1)) - x0 - math.log(math.exp(a - x0) + math.exp(c + above - x0))
        j = (a, b + up[k], c + above, d + above + up[k])
        top = max(j)
        e = [math.exp(x - top) for x in j]
        s = sum(e)
        joint[k] = (e[0] / s, e[1] / s, e[2] / s, e[3] / s)
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in full], joint


class PageModel:
    def __init__(self, unary: dict[str, float] | None = None, edge: dict[str, tuple[float, float, float, float]] | None = None):
        self.unary, self.edge = unary or {}, edge or {}
        self.base = self.edge.get("", (0.0, 0.0, 0.0, 0.0))
        self.known: dict[tuple[str, str], float] = {}

    def log_odds(self, features: list[str]) -> float:
        w = self.unary
        return w.get("", 0.0) + sum(w.get(f, 0.0) for f in features)

    def shown(self, t: Tree, blocks: list[tuple[int, str, int]]) -> list[float]:
        odds = [self.log_odds(f) for f in describe(t, blocks)]
        return marginals(t.parent, odds, [self.edge.get(tag, self.base) for tag in t.tag])[0]

    def text(self, page: str | None) -> str:
        t = parse(page)
        blocks = pieces(t)
        if not blocks:
            return ""
        p = self.shown(t, blocks)
        return "\n".join(text for node, text, _ in blocks if p[node] >= 0.5)


def train(pages: int = 1000, epochs: int = 10, rate: float = 0.2, decay: float = 1e-3, seed: int = 0) -> PageModel:
    """Stochastic gradient (Adagrad) on the log likelihood of labelled pages: observed minus expected statistics."""
    data = []
    for k in range(pages):
        t = parse(htmlpages.labelled_page(seed * 1_000_003 + k), labels=True)
        y = [max(0, x) for x in t.label]
        data.append((t.parent, t.tag, y, describe(t, pieces(t))))
    w: dict[str, float] = {}
    e: dict[str, list[float]] = {}
    gw: dict[str, float] = {}
    ge: dict[str, list[float]] = {}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            parent, tags, y, features = data[i]
            odds = [w.get("", 0.0) + sum(w.get(f, 0.0) for f in fs) for fs in features]
            edges = [tuple(e.setdefault(tag, [0.0] * 4)) for tag in tags]
            p, joint = marginals(parent, odds, edges)
            grad: dict[str, float] = {}
            for k, fs in enumerate(features):
                d = y[k] - p[k]
                if abs(d) > 1e-4:
                    for f in ("", *fs):
                        grad[f] = grad.get(f, 0.0) + d
            for f, d in grad.items():
                d -= decay * w.get(f, 0.0)
                gw[f] = gw.get(f, 1e-2) + d * d
                w[f] = w.get(f, 0.0) + rate * d / math.sqrt(gw[f])
            steps: dict[str, list[float]] = {}
            for k in range(1, len(parent)):
                s = steps.setdefault(tags[k], [0.0] * 4)
                s[2 * y[parent[k]] + y[k]] += 1
                for c in range(4):
                    s[c] -= joint[k][c]
            for tag, s in steps.items():
                g, v = ge.setdefault(tag, [1e-2] * 4), e[tag]
                for c in range(4):
                    d = s[c] - decay * v[c]
                    g[c] += d * d
                    v[c] += rate * d / math.sqrt(g[c])
    # a kind of child never seen in training takes the mean potential
    mean = [float(np.mean([v[c] for v in e.values()])) for c in range(4)] if e else [0.0] * 4
    return PageModel(w, {**{k: tuple(v) for k, v in e.items()}, "": tuple(mean)})


@functools.cache
def fitted() -> PageModel:
    """The model of the default training, fitted once a process: it depends on nothing but the generator and its seed."""
    return train()


def extracted(pages: DataFrame, model: PageModel, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row, its main text and that text's length in code points."""
    runtime.ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((model.unary, model.edge))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PageModel(*shared.value)
        for b in batches:
            texts = [m.text(x.as_py()) for x in b.column(width)]
            yield pa.record_batch([*b.columns[:width], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))
