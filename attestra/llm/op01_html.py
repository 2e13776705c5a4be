"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.labelled_pages import PAGES

#: Pages of the table whose landmarks are used as labels, at most.
TRAINING_PAGES = 400
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
MARK = re.compile(r"""\sdata-main\s*=\s*["']?([01])""")
SPACE = re.compile(r"[\s\x00]+")

# Element names of the HTML standard by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover".split())
INLINE |= set("mmultiscripts mprescripts none mtable mtr mtd semantics annotation annotation-xml".split())
PARAGRAPH_ENDS = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html article section div main aside nav header footer".split())

# Parts of class, id and role names and what they tell.
HINTS = {
    "menu": "nav menu breadcrumb topbar toolbar pagination pager tabs", "advert": "ad ads advert adverts advertisement sponsor sponsored promo banner promotion",
    "comment": "comment comments reply replies discussion disqus respond", "side": "sidebar side aside related widget rail recommended popular trending",
    "frame": "footer foot header head masthead logo copyright imprint legal hero", "notice": "cookie cookies notice consent alert popup modal gdpr warning privacy overlay",
    "form": "form search login signup subscribe newsletter contact", "share": "share social follow tags meta",
    "content": "article content post entry story main text body page news blog prose",
}
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
ORDER = ["comment", "advert", "notice", "menu", "side", "share", "form", "frame", "content"]


@dataclass
class Node:
    tag: str
    parent: int
    hint: str
    mark: str
    chars: int = 0
    linked: int = 0
    runs: list = field(default_factory=list)


def hint(attributes: str) -> str:
    """What the element's class, id and role say; the less content-like hint wins."""
    kinds = {HINT_OF.get(w) for value in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", value.lower())}
    return next((k for k in ORDER if k in kinds), "none")


def parse(page: str) -> list[Node]:
    """The structural elements in page order; each run is ``(position, text)`` of one stretch of text between block boundaries."""
    nodes, stack, links, at = [Node("html", -1, "none", "")], [0], 0, 0
    inline: list[str] = []
    parts: list[str] = []
    order = 0

    def flush() -> None:
        nonlocal order
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                node = nodes[stack[-1]]
                node.runs.append((order, text))
                node.chars += len(text)
                order += 1

    while True:
        found = TOKEN.search(page, at)
        text = page[at: found.start() if found else len(page)]
        if text:
            parts.append(text)
            if links:
                nodes[stack[-1]].linked += len(text)
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not found[1]:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if found[1] else 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if found[3].endswith("/") and (name == "svg" or any(nodes[k].tag == "svg" for k in stack)):
            parts.append(" ")  # outside svg and math, HTML takes no notice of the slash
            continue
        flush()
        links = 0
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    del stack[k:]
                    break
            continue
        if name in ("html", "body", "head"):
            continue
        if name in PARAGRAPH_ENDS and nodes[stack[-1]].tag == "p":
            stack.pop()
        closes = CLOSED_BY.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag in closes:
                    del stack[k:]
                    break
                if tag in SCOPES:
                    break
        mark = MARK.search(found[3])
        nodes.append(Node(name, stack[-1], hint(found[3]) if found[3] else "none", mark[1] if mark else ""))
        stack.append(len(nodes) - 1)
    flush()
    return nodes


def features(node: Node) -> tuple[str, ...]:
    """Discrete evidence of one node: its name, its hint, how much text it has and how much of it is linked."""
    size = 0 if not node.chars else 1 + (node.chars > 25) + (node.chars > 80) + (node.chars > 300)
    share = "none" if not node.chars else "all" if node.linked > 0.7 * node.chars else "some" if node.linked > 0.2 * node.chars else "few"
    return (f"tag {node.tag}", f"hint {node.hint}", f"size {size}", f"link {share}")


def kind(node: Node) -> str:
    """The class of parent-child potential a node has towards its parent."""
    return f"{node.tag} {node.hint}" if node.hint != "none" else node.tag


def landmarks(nodes: list[Node]) -> list[int]:
    """Labels: marked elements where a page has marks, else the standard's landmarks; what lies below follows."""
    marked = any(n.mark for n in nodes)
    label = []
    for n in nodes:
        above = label[n.parent] if n.parent >= 0 else 0
        if marked:
            label.append(int(n.mark) if n.mark else above)
        elif n.tag in ("nav", "aside", "footer", "form", "header") or n.hint in ("comment", "advert", "notice", "menu", "side", "share"):
            label.append(0)
        else:
            label.append(1 if n.tag in ("article", "main") else above)
    return label


def tally(page: str) -> Counter:
    """What one labelled page adds to the model's counts."""
    nodes = parse(page)
    label, out = landmarks(nodes), Counter()
    for n, y in zip(nodes, label):
        for f in features(n):
            out["node", f, y] += 1
        out["label", "", y] += 1
        if n.parent >= 0:
            x = label[n.parent]
            for k in {kind(n), "any"}:
                out["edge", k, 2 * x + y] += 1
    return out


class Model:
    """Potentials from smoothed counts: of evidence given a label, and of a child's label given its parent's."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        total = [counts.get(("label", "", y), 0) + 1.0 for y in (0, 1)]
        self.prior = [t / sum(total) for t in total]
        seen = {f for what, f, _ in counts if what == "node"}
        self.ratio = {f: math.log((counts.get(("node", f, 1), 0) + 0.5) / (total[1] + 1)) - math.log((counts.get(("node", f, 0), 0) + 0.5) / (total[0] + 1)) for f in seen}
        general = self._edge([counts.get(("edge", "any", c), 0) + 1.0 for c in range(4)])
        self.edges = {"any": general}
        for k in {k for what, k, _ in counts if what == "edge"} - {"any"}:
            self.edges[k] = self._edge([counts.get(("edge", k, 2 * x + y), 0) + 4 * general[x][y] for x in (0, 1) for y in (0, 1)])

    @staticmethod
    def _edge(c: list[float]) -> list[list[float]]:
        return [[c[0] / (c[0] + c[1]), c[1] / (c[0] + c[1])], [c[2] / (c[2] + c[3]), c[3] / (c[2] + c[3])]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of content: sum-product up to the root, then down again."""
        n = len(nodes)
        evidence, up, edge = [1.0] * n, [(1.0, 1.0)] * n, [None] * n
        for i, node in enumerate(nodes):
            # the odds of content, damped: the pieces of evidence are not independent
            evidence[i] = math.exp(max(-12.0, min(12.0, 0.7 * sum(self.ratio.get(f, 0.0) for f in features(node)))))
            edge[i] = self.edges.get(kind(node)) or self.edges.get(node.tag) or self.edges["any"]
        belief = [[1.0, e] for e in evidence]
        for i in range(n - 1, 0, -1):  # children stand after their parents
            (a, b), e = belief[i], edge[i]
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = belief[nodes[i].parent]
            p[0], p[1] = p[0] * up[i][0], p[1] * up[i][1]
            s = p[0] + p[1]
            p[0], p[1] = p[0] / s, p[1] / s
        out = [0.0] * n
        root = [self.prior[0] * belief[0][0], self.prior[1] * belief[0][1]]
        out[0] = root[1] / (root[0] + root[1])
        for i in range(1, n):
            q = out[nodes[i].parent]
            rest = ((1 - q) / max(up[i][0], 1e-300), q / max(up[i][1], 1e-300))
            (a, b), e = belief[i], edge[i]
            y0 = a * (rest[0] * e[0][0] + rest[1] * e[1][0])
            y1 = b * (rest[0] * e[0][1] + rest[1] * e[1][1])
            out[i] = y1 / (y0 + y1)
        return out

    def text(self, page: str) -> str:
        nodes = parse(page)
        runs = sorted(run for node, p in zip(nodes, self.marginals(nodes)) if p > 0.5 for run in node.runs)
        return "\n".join(text for _, text in runs)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for page in batch.column(0).to_pylist():
            total.update(tally(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
             pa.array([total[k] for k in keys], pa.int64())], names=["what", "key", "case", "n"])


def train(pages: DataFrame, most: int = TRAINING_PAGES) -> Model:
    """Count labelled pages: those of ``labelled_pages`` and at most ``most`` given pages that have an article or main landmark.

    The given pages are drawn by the hash of their address and text; only counts
    come to the driver, a row per feature, label and element name or hint.
    """
    shown = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("url", "html").alias("_h")).filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    drawn = shown.orderBy("_h").limit(most).select("html")
    counted = drawn.mapInArrow(_tallies, "what string, key string, case int, n long").groupBy("what", "key", "case").agg(F.sum("n").alias("n"))
    # names of elements are the pages' own: only those seen often enough to tell come back, a bounded table
    rows = counted.orderBy(F.desc("n"), "what", "key", "case").limit(2000).collect()
    counts: Counter = Counter({(r["what"], r["key"], r["case"]): r["n"] / 8 for r in rows})
    for page in PAGES:
        for key, n in tally(page).items():
            counts[key] += 8 * n
    return Model(counts)


def _texts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [model.text(page) if page else "" for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text. A null, empty or contentless page has an empty text; repeated rows give repeated rows."""
    model = model or train(pages)
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(_texts(model), "page_id long, url string, text string")
