from __future__ import annotations

import html
import re
from collections import Counter

import pytest

from attestra.llm import op01_html as op
from attestra.llm.labelled_pages import PAGES


def wanted(page: str) -> str:
    """The article of the given pages, cut out with patterns that fit only their layout."""
    start, end = page.index("<article>"), page.find("</article>")
    blocks = re.split(r"</?(?:p|h1|article)\b[^>]*>", page[start: end if end >= 0 else len(page)])
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    made = {r["page_id"]: r["text"] for r in op.main_text(pages).collect()}
    assert made == {r["page_id"]: wanted(r["html"]) for r in pages.collect()}


def test_awkward_pages(spark):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (3, "u", "no markup at all", "c"), (None, None, "<p>", "d"), (5, "u", "<" * 50, "e"), (6, "u", "</p></div></html>", "f"),
            (7, "u", "<html><body><article><h1>T</h1><p>a &amp; b &#233;&nbsp;c<br>d<p>e <i>f</i>g<script>x='</p>'</script></article>", "g"), (7, "u", "<article><p>x</p></article>", "g"),
            (8, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "h"), (9, "u", "<article><p>" + "long text. " * 200_000 + "</p></article>", "i")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text STRING")
    made = op.main_text(pages).collect()
    assert sorted(str(r["page_id"]) for r in made) == sorted(str(r[0]) for r in rows)
    texts = {}
    for r in made:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert texts[1] == texts[2] == texts[None] == texts[6] == [""]
    assert sorted(texts[7]) == sorted(["T\na & b é c d\ne fg", "x"])
    assert texts[9] == [("long text. " * 200_000).strip()]
    assert op.main_text(pages.limit(0)).count() == 0


def test_labelled_pages_are_told(spark):
    counts: Counter = Counter()
    for page in PAGES:
        counts.update(op.tally(page))
    model = op.Model(counts)
    right = total = 0
    for page in PAGES:
        nodes = op.parse(page)
        for node, label, p in zip(nodes, op.landmarks(nodes), model.marginals(nodes)):
            if node.runs:
                total, right = total + 1, right + ((p > 0.5) == bool(label))
    assert right / total > 0.9


@pytest.mark.parametrize("seed", range(5))
def test_messages_give_the_exact_marginals(seed):
    import itertools
    import math
    import random

    rng = random.Random(seed)
    counts: Counter = Counter()
    for page in PAGES:
        counts.update(op.tally(page))
    model = op.Model(counts)
    nodes = [op.Node("html", -1, "none", "")] + [op.Node(rng.choice(["div", "p", "nav", "article"]), rng.randrange(i), rng.choice(["none", "advert", "content"]), "", rng.choice([0, 40, 500]))
                                                 for i in range(1, 9)]
    total, content = 0.0, [0.0] * len(nodes)
    for ys in itertools.product((0, 1), repeat=len(nodes)):
        weight = model.prior[ys[0]]
        for i, node in enumerate(nodes):
            if ys[i]:
                weight *= math.exp(max(-12.0, min(12.0, 0.7 * sum(model.ratio.get(f, 0.0) for f in op.features(node)))))
            if i:
                edge = model.edges.get(op.kind(node)) or model.edges.get(node.tag) or model.edges["any"]
                weight *= edge[ys[node.parent]][ys[i]]
        total += weight
        content = [c + weight * y for c, y in zip(content, ys)]
    assert model.marginals(nodes) == pytest.approx([c / total for c in content], abs=1e-9)


@pytest.mark.parametrize("piece", [
    "<select><option>one", "<noscript>", "<object data=x>", "<svg><g>", "<math><mi>x</mi>", '<svg viewBox="0 0 1 1"/>', "<svg class=a />", "<template>",
    "<svg><svg></svg></svg>", "<object><object></object></object>",
])
def test_rest_of_the_page_stays_after_unclosed_and_self_closed_elements(piece):
    page = f"<html><body><article><p>before</p>{piece}<p>after it</p></article><p>last</p></body></html>"
    text = " ".join(t for _, t in sorted(r for n in op.parse(page) for r in n.runs))
    assert "before" in text and "after it" in text and text.endswith("last")


def test_text_of_math_stays_in_its_paragraph():
    nodes = op.parse("<article><p>so <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds</p></article>")
    assert [t for n in nodes for _, t in n.runs if n.tag == "p"] == ["so x=2 holds"]
