"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element, and every run of text directly in a block element, is a variable: content or
not. Its own potential is a log-linear function of its tag, its class and id words, and the
length, punctuation and link share of its text; each pair of parent and child has a
potential for their two labels. One upward and one downward pass of sum-product messages give
the exact marginals, and runs of text whose marginal is content are the page's main text.
Both potentials are learned from labelled pages (pages_gold).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievegrid.llm.common import table
from sievegrid.llm.pages_gold import MARK, labelled_pages

#: Elements that begin and end a block; all others, unknown ones too, are part of the text around them.
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li link main menu meta nav noscript ol optgroup option p pre search section select source summary table tbody td template tfoot th thead tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I | re.A) for name in RAW}
#: Open elements that an opening tag ends, up to the given border.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAMING = frozenset(("class", "id", "role"))
_FOREIGN = frozenset(("svg", "math"))
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TEXT = "#text"
#: A feature of fewer nodes of the labelled pages is chance (an invented name).
LEAST_NODES = 4


class Tree:
    """tag, names and parent of each node; a #text node's text has its white space folded.

    marks are the values of the attribute `mark` (None where it is not there, or if no mark is named).
    """

    def __init__(self, source: str | None, mark: str | None = None):
        self.tag, self.names, self.parent, self.marks, self.text, self.links = ["#root"], [()], [-1], [None], [""], [0]
        self.mark = mark
        self._build(source or "")

    def _add(self, tag: str, parent: int, names: tuple = (), mark=None, text: str = "", links: int = 0) -> int:
        for column, value in ((self.tag, tag), (self.names, names), (self.parent, parent), (self.marks, mark), (self.text, text), (self.links, links)):
            column.append(value)
        return len(self.tag) - 1

    def _build(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # inline elements are on it too, with their block's node
        places: dict[str, list[int]] = defaultdict(list)  # where on the stack the elements of a name are
        run: list[str] = []
        linked, at = 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            if text:
                self._add(TEXT, stack[-1][1], text=text, links=min(linked, len(text)))
            run.clear()
            linked = 0

        def push(name: str, node: int) -> None:
            places[name].append(len(stack))
            stack.append((name, node))

        def close(depth: int) -> None:
            while len(stack) > depth:
                name, node = stack[-1]
                if node != stack[-2][1]:
                    flush()
                places[name].pop()
                stack.pop()

        def last(names) -> int:
            return max((places[n][-1] for n in names if places[n]), default=0)

        def pop(names, border=()) -> None:
            depth = last(names)
            if depth > last(border):
                close(depth)

        def write(piece: str) -> None:
            nonlocal linked
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if places["a"]:
                linked += len(piece.strip())

        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                write(source[at:])
                break
            if m.start() > at:
                write(source[at : m.start()])
            at = m.end()
            if m[1]:
                name = m[1].lower()
                if name == "br":
                    run.append(" ")
                else:
                    pop((name,), () if name in BLOCK else ("td", "th", "table"))
                continue
            name = (m[2] or m[4] or "").lower()
            if not name:
                continue
            attributes = m[3] if m[2] else m[5] or ""
            if name in RAW:
                if not (attributes.endswith("/") and last(_FOREIGN)):  # elsewhere the stroke means nothing
                    end = _RAW_END[name].search(source, at)
                    at = end.start() if end else len(source)
                continue
            if name in ("br", "wbr", "img"):
                run.append("" if name == "wbr" else " ")
                continue
            if name not in BLOCK and not (name == "ins" and "=" in attributes):
                if name not in VOID and not (attributes.endswith("/") and (name in _FOREIGN or last(_FOREIGN))):
                    push(name, stack[-1][1])
                continue
            flush()
            if name in _CLOSES_P:
                pop(("p",), ("button", "td", "th", "table", "li", "blockquote", "article", "section", "div", "main"))
            if name in _ENDS:
                pop(*_ENDS[name])
            if name not in VOID:
                push(name, self._add(name, stack[-1][1], *self._attributes(attributes)))
        flush()

    def _attributes(self, text: str) -> tuple[tuple, str | None]:
        if not text or "=" not in text:
            return (), None
        names, mark = set(), None
        for key, *values in _ATTRIBUTE.findall(text):
            value = next((v for v in values if v), "")
            if key.lower() in _NAMING:
                names.update(_NAME.findall(_CAMEL.sub(" ", value).lower()))
            elif key == self.mark:
                mark = value
        return tuple(sorted(names)), mark

    def features(self) -> list[list[str]]:
        """For each node: names of what holds for it."""
        n = len(self.tag)
        size, links, runs = [len(t) for t in self.text], list(self.links), [int(t == TEXT) for t in self.tag]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            links[p] += links[i]
            runs[p] += runs[i]
        out = []
        for i in range(n):
            t = self.tag[i]
            kind = "text" if t == TEXT else "node"
            share = links[i] / size[i] if size[i] else 0
            f = ["bias " + kind, f"{kind} links {0 if share < 0.05 else 1 if share < 0.5 else 2}", f"{kind} size {min(size[i].bit_length(), 10) // 2}"]
            f.append(f"{kind} of page {(10 * size[i] + 9) // size[0] // 3 if size[0] else 0}")
            if t == TEXT:
                x = self.text[i]
                f.append(f"text ends {x[-1] in '.!?:\"'}")
                f.append("text in " + self.tag[self.parent[i]])
            else:
                f.append("tag " + t)
                f += ["name " + x for x in self.names[i]]
                if runs[i] and size[i]:
                    f.append(f"node mean {min((size[i] // runs[i]).bit_length(), 9) // 2}")
            out.append(f)
        return out


def labels(tree: Tree) -> list[int]:
    """1 for each node within an element marked 1, unless a nearer one is marked 0."""
    out = [0] * len(tree.tag)
    for i in range(1, len(out)):
        out[i] = out[tree.parent[i]] if tree.marks[i] is None else int(tree.marks[i] == "1")
    return out


def _forest(pages: list[str]) -> tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Features, labels and parents (-1: a root) of the nodes of all pages, and the nodes of each depth below the roots."""
    rows, truth, parent = [], [], []
    for page in pages:
        tree = Tree(page, MARK)
        parent += [p + len(rows) if p >= 0 else -1 for p in tree.parent]
        rows += tree.features()
        truth += labels(tree)
    parent = np.array(parent)
    depth = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent.tolist()):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    return rows, np.array(truth, float), parent, [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]


def train(pages: list[str], ridge: float = 0.5, steps: int = 200) -> dict:
    """Both kinds of potentials from labelled pages, by penalised maximum likelihood of whole trees.

    The gradient is what the labels have of each feature and pair, less what the marginals of
    the current potentials expect; messages go through all pages at once, depth by depth.
    """
    rows, y, parent, levels = _forest(pages)
    there = Counter(f for r in rows for f in set(r))
    names = {f: k for k, f in enumerate(sorted(f for f, n in there.items() if n >= LEAST_NODES))}
    rows = [[names[f] for f in r if f in names] for r in rows]
    at = np.array([k for r in rows for k in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    child = np.concatenate(levels)
    seen = np.bincount(at, weights=y[owner], minlength=len(names))
    pairs = np.bincount((2 * y[parent[child]] + y[child]).astype(int), minlength=4).astype(float)
    value = np.zeros(len(names) + 4)
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        a, b, c, d = np.exp(value[-4:])
        up = np.bincount(owner, weights=value[at], minlength=len(rows))
        sent = np.zeros(len(rows))
        for level in reversed(levels):
            e = np.exp(np.clip(up[level], -40, 40))
            sent[level] = np.log((c + d * e) / (a + b * e))
            np.add.at(up, parent[level], sent[level])
        whole = up.copy()
        for level in levels:
            e = np.exp(np.clip(whole[parent[level]] - sent[level], -40, 40))
            whole[level] = up[level] + np.log((b + d * e) / (a + c * e))
        p = 1 / (1 + np.exp(-np.clip(whole, -40, 40)))
        above, below = (np.exp(np.clip(x, -40, 40)) for x in (whole[parent[child]] - sent[child], up[child]))
        joint = np.stack([np.full(len(child), a), b * below, c * above, d * above * below])
        slope = np.concatenate([seen - np.bincount(at, weights=p[owner], minlength=len(names)), pairs - (joint / joint.sum(0)).sum(1)]) - ridge * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        value += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return {"weights": {f: float(value[k]) for f, k in names.items()}, "pair": value[-4:].reshape(2, 2).tolist()}


def marginals(tree: Tree, model: dict) -> list[float]:
    """The probability of being content, for each node, by sum-product on the tree."""
    weights, n = model["weights"], len(tree.tag)
    local = [sum(weights.get(f, 0.0) for f in fs) for fs in tree.features()]
    (a, b), (c, d) = [[math.exp(v) for v in row] for row in model["pair"]]
    parent, exp, log = tree.parent, math.exp, math.log
    up, sent = local[:], [0.0] * n  # log-odds below and at a node; message to its parent
    for i in range(n - 1, 0, -1):
        e = exp(min(max(up[i], -40.0), 40.0))
        sent[i] = log((c + d * e) / (a + b * e))
        up[parent[i]] += sent[i]
    whole = up[:]
    for i in range(1, n):
        e = exp(min(max(whole[parent[i]] - sent[i], -40.0), 40.0))
        whole[i] = up[i] + log((b + d * e) / (a + c * e))
    return [1 / (1 + exp(-min(max(v, -40.0), 40.0))) for v in whole]


def main_text(source: str | None, model: dict) -> str:
    tree = Tree(source)
    if len(tree.tag) == 1:
        return ""
    p = marginals(tree, model)
    return "\n".join(t for t, tag, v in zip(tree.text, tree.tag, p, strict=True) if tag == TEXT and v >= 0.5)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null, empty and blank html, and pages without main text, give the empty text. Markup may
    be broken in any way; very long pages are read whole, in linear time. Repeated rows each
    give a row; other columns are not read. An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    @F.pandas_udf(StringType())
    def text(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, shared.value) for x in sources], dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
