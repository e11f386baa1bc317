"""Operator 8: HTML extraction by a tree-structured graphical model.

A page's DOM is a tree of binary variables: a node is content or not. Each node has a potential from what is
seen of it (tag, class words, length and punctuation of its text, share of links), and each parent-child pair one that
depends on the child's tag. All are learned by counting over labelled pages. Sum-product messages go
up from the leaves and down from the root, level by level for many pages at once; on a tree that gives exact
marginals. Text of nodes with a marginal of one half or more is the page's content.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A

#: Labelled pages that the potentials are learned from, and their greatest length: the bound on the training sample.
TRAIN_PAGES = 400
TRAIN_CHARS = 200_000
#: Elements nested deeper are children of the one at this depth, as browsers have it.
MAX_DEPTH = 512

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}
_SILENT = _RAW | {"head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "figcaption",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}
_SCOPE = {"ul", "ol", "dl", "table", "tr", "select", "body", "html", "article", "div", "section", "nav", "main", "aside", "td", "th"}


class Page:
    """Nodes in document order: parent, tag, class words, own text (None for elements)."""

    __slots__ = ("parent", "tag", "words", "text", "_parts", "_last")

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.words: list[str] = [""]
        self.text: list[str | None] = [None]
        self._parts: list[str] = []
        self._last = 0
        stack = [0]
        scopes: list[int] = []  # places in the stack of tags that implied ends don't cross
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        at, n = 0, len(source)

        def close(k: int) -> None:
            for place in range(len(stack) - 1, k - 1, -1):
                opened[self.tag[stack[place]]].pop()
            del stack[k:]
            while scopes and scopes[-1] >= k:
                scopes.pop()

        while at < n:
            if source[at] != "<":
                end = source.find("<", at)
                end = n if end < 0 else end
                self._say(stack[-1], source[at:end])
                at = end
                continue
            m = _NAME.match(source, at + 1)
            if m is None:
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 4)
                    at = n if end < 0 else end + 3
                elif source.startswith(("<!", "<?"), at):
                    end = source.find(">", at)
                    at = n if end < 0 else end + 1
                else:
                    self._say(stack[-1], "<")
                    at += 1
                continue
            end = m.end()
            while (stop := _STOP.search(source, end)) and stop.group() != ">":
                end = source.find(stop.group(), stop.end()) + 1
                if not end:
                    break
            if stop is None or not end:  # an unfinished tag: the rest is one
                break
            attributes = source[m.end() : stop.start()]
            at = stop.end()
            tag = m.group(2).lower()
            if m.group(1):
                if opened[tag]:
                    close(opened[tag][-1])
                continue
            if tag in _RAW:
                end_tag = _RAW_END[tag].search(source, at)
                at = end_tag.end() if end_tag else n
                continue
            closes = _CLOSES.get(tag) or (("p",) if tag in _BLOCK else ())
            k = max((opened[x][-1] for x in closes if opened[x]), default=0)
            if k and (not scopes or k >= scopes[-1]):
                close(k)
            words = " ".join(x for g in _CLASS.findall(attributes) for x in g if x).lower() if attributes else ""
            node = self._node(stack[-1], tag, words, None)
            if tag not in _VOID and not attributes.endswith("/") and len(stack) <= MAX_DEPTH:
                opened[tag].append(len(stack))
                if tag in _SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
        self._join()

    def _say(self, parent: int, text: str) -> None:
        text = html.unescape(text)
        if not text.isspace():
            if self.text[-1] is not None and self.parent[-1] == parent:
                self._parts.append(text)
            else:
                self._join()
                self._last = self._node(parent, "#text", "", "")
                self._parts = [text]

    def _join(self) -> None:
        if self._parts:
            self.text[self._last] = "".join(self._parts)

    def _node(self, parent: int, tag: str, words: str, text: str | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        return len(self.tag) - 1

    def looks(self) -> list[tuple]:
        """What is seen of each node."""
        n = len(self.tag)
        size, linked, in_link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            in_link[i] = in_link[p] or self.tag[i] == "a"
            if self.text[i] is not None:
                size[i] = len(self.text[i])
                linked[i] = size[i] if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        out: list[tuple] = []
        for i, (tag, t) in enumerate(zip(self.tag, self.text)):
            if t is None:
                share = 0 if not size[i] else 1 + int(3.99 * linked[i] / size[i])
                out.append((tag, share, size[i].bit_length(), self.words[i]))
            else:
                out.append((tag, self.tag[self.parent[i]], len(t).bit_length(), (t.count(".") + t.count(",")).bit_length(), in_link[i]))
        return out


def features_of(look: tuple) -> list[str]:
    """The features of a node that looks so."""
    if look[0] == "#text":
        return [f"in={look[1]}", f"length={look[2]}", f"stops={look[3]}", f"link={look[4]}"]
    return [f"tag={look[0]}", f"links={look[1]}", f"size={look[2]}", *(f"word={w}" for w in look[3].split())]


def edge_class(tag: str) -> str:
    return tag if tag == "#text" or tag in _INLINE or tag in _BLOCK else "other"


class TreeModel:
    """Potentials of a tree of binary variables, from counts."""

    def __init__(self, smoothing: float = 0.5):
        self.smoothing = smoothing
        self.seen: dict[str, Counter] = defaultdict(Counter)
        self.total: dict[str, Counter] = defaultdict(Counter)
        self.edges: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((2, 2)))
        self.root = np.zeros(2)
        self.unary: dict[str, tuple[float, float]] = {}
        self.pair: dict[str, np.ndarray] = {}

    def add(self, page: Page, label: list[int]) -> None:
        self.root[label[0]] += 1
        for i, look in enumerate(page.looks()):
            for f in features_of(look):
                self.seen[f][label[i]] += 1
                self.total[f.split("=")[0]][label[i]] += 1
            if i:
                self.edges[edge_class(page.tag[i])][label[page.parent[i]], label[i]] += 1

    def finish(self) -> TreeModel:
        s = self.smoothing
        kinds = Counter(f.split("=")[0] for f in self.seen)
        for f, c in self.seen.items():
            k = f.split("=")[0]
            self.unary[f] = tuple(float(np.log((c[y] + s) / (self.total[k][y] + s * (kinds[k] + 1)))) for y in (0, 1))
        everything = sum(self.edges.values(), np.zeros((2, 2)))
        self.default = np.log((everything + s) / (everything + s).sum(axis=1, keepdims=True))
        for e, c in self.edges.items():
            c = c + 2 * s * np.exp(self.default)
            self.pair[e] = np.log(c / c.sum(axis=1, keepdims=True))
        self.prior = np.log((self.root + s) / (self.root + s).sum())
        self.seen, self.total, self.edges = {}, {}, {}
        return self

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of every node of every page."""
        sizes = [len(p.tag) for p in pages]
        base = np.concatenate([[0], np.cumsum(sizes)])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base)])
        n = len(parent)
        depth = np.zeros(n, np.int32)
        own = np.zeros((n, 2))
        classes = [*self.pair, ""]
        code = {e: i for i, e in enumerate(classes)}
        table = np.stack([*(self.pair[e] for e in self.pair), self.default])
        edge = np.empty(n, np.int64)
        zero = (0.0, 0.0)
        known: dict[tuple, tuple[float, float, int]] = {}  # nodes that look the same have the same potentials
        for p, at in zip(pages, base.tolist()):
            levels: list[int] = []
            values: list[tuple[float, float, int]] = []
            for tag, up, look in zip(p.tag, p.parent, p.looks()):
                levels.append(levels[up] + 1 if up >= 0 else 0)
                value = known.get(look)
                if value is None:
                    seen = [self.unary.get(f, zero) for f in features_of(look)]
                    value = known[look] = (sum(x for x, _ in seen), sum(y for _, y in seen), code.get(edge_class(tag), len(classes) - 1))
                values.append(value)
            depth[at : at + len(levels)] = levels
            numbers = np.array(values)
            own[at : at + len(levels)] = numbers[:, :2]
            edge[at : at + len(levels)] = numbers[:, 2]
        return np.split(sum_product(parent, depth, own, table[edge], self.prior), base[1:-1])


def sum_product(parent: np.ndarray, depth: np.ndarray, own: np.ndarray, pair: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Marginals of state 1. ``own[i]`` are log potentials, ``pair[i][s, t]`` those of parent state s and state t."""
    up = own.copy()
    message = np.zeros_like(own)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    for nodes in reversed(levels[1:]):
        message[nodes] = np.logaddexp.reduce(pair[nodes] + up[nodes][:, None, :], axis=2)
        np.add.at(up, parent[nodes], message[nodes])
    belief = up.copy()
    belief[levels[0]] += prior
    for nodes in levels[1:]:
        p = parent[nodes]
        outside = belief[p] - message[nodes]
        outside -= np.logaddexp(outside[:, :1], outside[:, 1:])
        belief[nodes] += np.logaddexp.reduce(pair[nodes] + outside[:, :, None], axis=1)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def label_page(page: Page, truth: str) -> list[int]:
    """Content labels: a text node that occurs in the known text; an element most of whose text does."""
    plain = " ".join(truth.split())
    good, size = [0] * len(page.tag), [0] * len(page.tag)
    for i, t in enumerate(page.text):
        if t is not None:
            size[i] = len(t)
            good[i] = size[i] if " ".join(t.split()) in plain else 0
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    return [int(2 * g > s) for g, s in zip(good, size)]


def extract(page: Page, marginal: np.ndarray) -> tuple[str, int, int]:
    """Content text, content nodes and text nodes. Inline neighbours share a line; blocks and ``br`` begin one."""
    out: list[str] = []
    kept = total = 0
    fresh = True
    for i, (tag, t) in enumerate(zip(page.tag, page.text)):
        if t is None:
            fresh |= tag in _BLOCK or tag in ("br", "td", "th", "tr")
            continue
        total += 1
        p = page.parent[i]
        while page.tag[p] in _INLINE:
            p = page.parent[p]
        if marginal[i] >= 0.5:
            kept += 1
            words = " ".join(t.split())
            if fresh or not out or out[-1][0] != p:
                out.append((p, words))
            else:
                out[-1] = (p, f"{out[-1][1]}{' ' if t[:1].isspace() else ''}{words}")
            fresh = False
    return "\n".join(x for _, x in out), kept, total


def train(pages: DataFrame, documents: DataFrame, sample: int = TRAIN_PAGES) -> TreeModel | None:
    """A model from pages whose address ends in the number of the document they show; None without any.

    At most ``sample`` of them, those of least hash of their address, and of at most 200,000 characters. They are chosen by
    address, and only those chosen are fetched. Ties of hash go by address; repeated pages are chosen as often as they
    occur. Null addresses, pages, numbers and texts are left out; empty ones label nothing.
    """
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})([?#].*)?$', 1) AS bigint)").alias("doc_id")
    order = F.xxhash64("url").alias("order")
    address = pages.where(F.length("html") <= TRAIN_CHARS).select(order, "url", number).where(F.col("doc_id").isNotNull())
    count = address.count()
    if not count:
        return None
    bound = -(2**63) + min(2**64 - 1, 2**64 // count * 8 * sample)  # about eight times as many as wanted: most have a text, so enough stay
    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("truth")).where("truth IS NOT NULL")
    chosen = address.where(F.col("order") <= F.lit(bound)).join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy("order", "url").select("url", "doc_id").limit(sample).collect()
    if not chosen:
        return None
    few = F.broadcast(pages.sparkSession.createDataFrame(chosen, "url string, doc_id bigint").distinct())
    fetched = pages.where(F.length("html") <= TRAIN_CHARS).select("url", "html").join(few, "url")
    rows = known.join(F.broadcast(fetched), "doc_id").select(order, "url", "html", "truth").orderBy("order", "url", "html", "truth").limit(sample).collect()
    model = TreeModel()
    used = 0
    for r in rows:
        page = Page(r["html"])
        label = label_page(page, r["truth"])
        if any(label):
            model.add(page, label)
            used += 1
    return model.finish() if used else None


def extract_pages(
    pages: DataFrame, model: TreeModel | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, content_nodes, text_nodes) of every page.

    Null or blank pages give an empty text and zero nodes. Without a model all text outside scripts, styles and the head
    is content. Broken markup is read as far as it goes: unclosed tags are closed by their parents, an unfinished tag ends the
    page, elements nested deeper than 512 hang on the one at that depth. Time grows in proportion to a page's length.
    Repeated rows are extracted one by one; other columns don't matter; an empty table gives none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in A.slices(batch.column(2)):
                trees = [Page(x) for x in part.to_pylist()]
                m = shared.value
                marginal = [np.ones(len(t.tag)) for t in trees] if m is None else m.marginals(trees)
                got = [extract(t, p) for t, p in zip(trees, marginal)]
                text, kept, total = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(text, pa.string()),
                        pa.array(kept, pa.int32()), pa.array(total, pa.int32()),
                    ],
                    names=["page_id", "url", "text", "content_nodes", "text_nodes"],
                )

    return rows.mapInArrow(run, "page_id bigint, url string, text string, content_nodes int, text_nodes int")
