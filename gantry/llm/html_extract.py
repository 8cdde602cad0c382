"""Main text of web pages by minimum cut.

A page is cut into blocks: runs of text without a block element's boundary in them. Each block
gets a cost for either label: markup that speaks of it (elements, classes and roles around it:
fixed log-odds, EVIDENCE and the constants beside it) plus what a classifier says of its text. The costs
become capacities to the two terminals, and blocks next to each other, or next among the children
of one element, are tied by edges whose capacity falls with their distance in the tree. The minimum
cut, found by maximum flow, is the cheapest labelling: a doubtful block goes with its
surroundings, a clear one does not.

The classifier (`fit`) is a logistic regression on length, links, punctuation, kind of element and place
on the page; pages without any of the elements in KINDS have weights of their own, fitted without that feature. Its labels are blocks that markup speaks of, in a sample of about SAMPLE pages; the same
blocks tell how often tied ones agree, which is the edges' capacity. Both are bounded (CLIP, NEAR, FAR): text
and neighbours together never outweigh an element of 4 or more, and decide where markup is silent. Without
blocks of both labels, costs and edges are the fixed ones of `_own_evidence` and FIXED.

Cases: null and empty html give an empty text; html without tags is one block; markup that is
cut off, never closed or wrongly nested is read as far as it goes; the texts of scripts, styles,
titles, templates, drawings, embedded pages and form fields are never blocks. Formulas, and what stands in
for media that a reader cannot play, are text of their block, `xmp` is a block. White space in a block
becomes one space; blocks are joined by one line break; nothing else is dropped or cut. Ids and urls
pass through row by row; other columns are ignored. Pages that share id and url count once in the sample.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import slices

MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))"
    r"|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
WORD_END = frozenset(".!?…:;\"»”")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are not markup, or never text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes template svg annotation annotation-xml select option button datalist".split())
#: Elements whose contents may hold tags of their own kind only as text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
#: A start tag ends an open element of these kinds, looked for up to the nearest of the barriers.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
BARRIERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

EVIDENCE = {
    "article": 5.0, "main": 4.0, "nav": -9.0, "aside": -9.0, "footer": -9.0, "header": -6.0, "noscript": -6.0, "form": -8.0, "menu": -8.0, "dialog": -9.0,
}
ROLES = {
    "main": 4.0, "article": 4.0, "navigation": -9.0, "banner": -6.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0,
    "dialog": -9.0, "alert": -9.0, "alertdialog": -9.0, "menu": -8.0, "menubar": -8.0, "form": -8.0,
}
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments reply replies disqus cookie cookies consent gdpr notice notices banner popup modal "
    "overlay share sharing social related recommended newsletter subscribe signup login widget toolbar pagination pager masthead "
    "copyright topbar".split())
GOOD_NAMES = frozenset("article content post entry story main body text".split())
BAD_NAME, GOOD_NAME, HIDDEN = -9.0, 2.0, -12.0
SCALE = 1000


def _evidence(tag: str, attributes: str, in_article: bool) -> float:
    """What one element says of the blocks in it."""
    total = EVIDENCE.get(tag, 0.0)
    if tag in ("header", "noscript") and in_article:
        total = 0.0  # the article's own headline, or what stands in for a part of it
    if not attributes or tag in ("html", "body"):
        return total
    good = bad = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            names = {t.lower() for t in TOKEN.findall(value)}
            bad = bad or not BAD_NAMES.isdisjoint(names)
            good = good or not GOOD_NAMES.isdisjoint(names)
            if "header" in names and not in_article:
                bad = True
        elif name == "role":
            total += ROLES.get(value.strip().lower(), 0.0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            total += HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            total += HIDDEN
    return total + (BAD_NAME if bad else GOOD_NAME if good else 0.0)


XMP_END = re.compile(r"</xmp(?=[\s/>]|\Z)", re.I)


class Block:
    __slots__ = ("text", "linked", "evidence", "parent", "depth", "tag")

    def __init__(self, text: str, linked: int, evidence: float, parent: int, depth: int, tag: str):
        self.text, self.linked, self.evidence, self.parent, self.depth, self.tag = text, linked, evidence, parent, depth, tag


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those of white space only left out."""
    found: list[Block] = []
    # (tag, evidence of all around, number, number of the parent's element, in an article)
    stack: list[tuple[str, float, int, int, bool]] = [("", 0.0, 0, -1, False)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = number = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] not in BLOCKS:
                    k -= 1
                tag, evidence, _, parent, _ = stack[k]
                found.append(Block(text, linked, stack[-1][1], parent, k, tag))
            parts.clear()
            linked = 0

    def pop_to(length: int) -> None:
        while len(stack) > length:
            open_tags[stack.pop()[0]] -= 1

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if open_tags.get("a"):
            linked += len(text.strip())

    end = len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "noscript" and not stack[-1][4]:
            flush()  # a notice of its own, but part of its block in an article
        if m.group(1):
            if tag in BLOCKS:
                flush()
            if tag == "br":
                parts.append(" ")
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    if stack[k][0] in BLOCKS:
                        flush()
                    k -= 1
                pop_to(k)
            continue
        if tag in RAW:
            # A slash at the end does not close these, but for the drawings.
            if tag == "svg" and m.group(3).endswith("/>"):
                continue
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at) if tag not in _CLOSE else _CLOSE[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes"):
                at = end
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if open_tags.get("p"):
                k = len(stack) - 1
                while stack[k][0] != "p":
                    k -= 1
                pop_to(k)
        if tag in ENDS:
            k = len(stack) - 1
            while k and stack[k][0] not in ENDS[tag] and stack[k][0] not in BARRIERS[tag]:
                k -= 1
            if stack[k][0] in ENDS[tag]:
                pop_to(k)
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag == "a" and open_tags.get("a"):
            k = len(stack) - 1
            while stack[k][0] != "a":
                k -= 1
            if all(s[0] not in BLOCKS for s in stack[k:]):
                pop_to(k)
        _, around, parent, _, in_article = stack[-1]
        number += 1
        own = _evidence(tag, m.group(3), in_article)
        stack.append((tag, around + own, number, parent, in_article or tag in ("article", "main")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag == "xmp":  # no markup, and no character references
            close = XMP_END.search(page, at)
            text = page[at:close.start() if close else end]
            at += len(text)
            parts.append(text)
            if open_tags.get("a"):
                linked += len(text.strip())
    flush()
    return found


_CLOSE = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I) for tag in RAW}


def _own_evidence(block: Block) -> float:
    """What a block's text says of it, beside its place; positive for content."""
    text, words = block.text, block.text.count(" ") + 1
    total = 0.2 + min(2.0, words / 20) - 4.0 * min(1.0, block.linked / len(text))
    if text[-1] in WORD_END:
        total += 0.5
    if block.tag == "h1":
        total += 0.5
    elif block.tag in ("li", "td", "th"):
        total -= 0.3
    if text[0] == "©" or "all rights reserved" in text[-200:].lower():
        total -= 3.0
    return total


#: Sizes of a block's features: words, links, sentence end, element, place on the page, legal notice.
BINS = (7, 4, 2, 4, 5, 2)
KINDS = {"p": 1, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2), **dict.fromkeys(("li", "td", "th", "dt", "dd"), 3)}
#: Pages that costs are fitted on, about.
SAMPLE = 4096
#: Most that a text may say, and most of one edge within an element and beyond it.
CLIP, NEAR, FAR = 2.0, 0.8, 0.4
#: How two tied blocks lie: neighbours in one element, neighbours 1, 2 or more steps apart, next in one element with others between.
BESIDE, BETWEEN = 0, 4


class Costs(NamedTuple):
    """What texts and neighbours say: a weight for each bin of each feature, the constant last; the same for pages
    whose elements say nothing; a capacity for each kind of tie."""

    weights: tuple[tuple[float, ...], ...] | None
    plain: tuple[tuple[float, ...], ...] | None
    edges: tuple[float, ...]


FIXED = Costs(None, None, (0.8, 0.4, 0.8 / 3, 0.2, 0.5))


def features(block: Block, place: int, of: int) -> tuple[int, ...]:
    """The bin of each feature in BINS."""
    text = block.text
    linked = block.linked / len(text)
    return (
        min((text.count(" ") + 1).bit_length() - 1, 6),
        0 if not linked else 1 if linked < 0.3 else 2 if linked < 0.7 else 3,
        int(text[-1] in WORD_END),
        KINDS.get(block.tag, 0),
        5 * place // of,
        int(text[0] == "©" or "all rights reserved" in text[-200:].lower()),
    )


def pairs(found: list[Block]) -> Iterator[tuple[int, int, int]]:
    """(block, block, kind of tie): neighbours on the page, and next blocks among one element's children."""
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            yield i - 1, i, BESIDE if a.parent == b.parent else min(1 + abs(a.depth - b.depth), 3)
        before = last.get(b.parent)
        if before is not None and before != i - 1:
            yield before, i, BETWEEN
        last[b.parent] = i


def ties(found: list[Block], costs: Costs = FIXED) -> list[tuple[int, int, int]]:
    """(block, block, capacity) of `pairs`."""
    return [(a, b, int(SCALE * costs.edges[kind])) for a, b, kind in pairs(found)]


def observe(found: list[Block]) -> Iterator[tuple[int, int, bool]]:
    """What a page shows to `fit`: (-1, features as a number, content?) of blocks that markup speaks of, (kind, 0, agree?) of ties."""
    said = [None if -4.0 < b.evidence < 4.0 else b.evidence > 0 for b in found]
    for i, (b, label) in enumerate(zip(found, said)):
        if label is not None:
            code = 0
            for x, size in zip(features(b, i, len(found)), BINS):
                code = code * size + x
            yield -1, code, label
    for a, b, kind in pairs(found):
        if said[a] is not None and said[b] is not None:
            yield kind, 0, said[a] == said[b]


def _logistic(design: np.ndarray, label: np.ndarray, n: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Weights of a logistic regression of rows that came `n` times, by Newton's method."""
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (label - p)) - ridge * w
        curve = (design * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, slope), -2.0, 2.0)
    return w


def _cut_up(w: np.ndarray) -> tuple[tuple[float, ...], ...]:
    """Weights by feature, the constant last."""
    ends = np.cumsum((*BINS, 1))
    return tuple(tuple(float(x) for x in w[end - size:end]) for end, size in zip(ends, (*BINS, 1)))


def costs_of(counts: dict[tuple[int, int, bool], int], ridge: float = 1.0, rounds: int = 25) -> Costs:
    """Weights and log-odds of agreement from counts of `observe`."""
    seen = sorted((code, label, n) for (kind, code, label), n in counts.items() if kind < 0)
    if len({label for _, label, _ in seen}) < 2:
        return FIXED
    design = np.zeros((len(seen), sum(BINS) + 1))
    design[:, -1] = 1.0
    for row, (code, _, _) in zip(design, seen):
        at = sum(BINS)
        for size in reversed(BINS):
            at -= size
            row[at + code % size] = 1.0
            code //= size
    label = np.array([x for _, x, _ in seen], float)
    n = np.array([x for _, _, x in seen], float)
    kinds = slice(sum(BINS[:3]), sum(BINS[:4]))
    bare = design.copy()
    bare[:, kinds] = 0.0
    weights, plain = (_cut_up(_logistic(x, label, n, ridge, rounds)) for x in (design, bare))
    agree = [np.log((counts.get((k, 0, True), 0) + 1) / (counts.get((k, 0, False), 0) + 1)) / 2 for k in range(BETWEEN + 1)]
    return Costs(weights, plain, tuple(float(np.clip(x, 0.0, NEAR if k == BESIDE else FAR)) for k, x in enumerate(agree)))


def text_costs(found: list[Block], costs: Costs = FIXED) -> list[float]:
    """Log-odds of content from each block's text and place, CLIP at most; positive for content."""
    if costs.weights is None or costs.plain is None:
        return [_own_evidence(b) for b in found]
    weights = costs.weights if any(b.tag in KINDS for b in found) else costs.plain
    sums = [weights[-1][0] + sum(w[x] for w, x in zip(weights, features(b, i, len(found)))) for i, b in enumerate(found)]
    return [max(-CLIP, min(CLIP, x)) for x in sums]


def minimum_cut(weights: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays with the source.

    A node's weight is its capacity from the source if positive, to the sink if negative; edges
    have one capacity for both directions. Flow is sent along shortest paths, all of one length
    at a time; at the end the nodes that cannot reach the sink any more are the source's.
    """
    n = len(weights)
    left = list(weights)
    to: list[int] = []
    room: list[int] = []
    around: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        around[a].append(len(to))
        around[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    while True:
        # Steps to the sink, from its side.
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] < 0)
        for i in queue:
            level[i] = 0
        while queue:
            i = queue.popleft()
            for e in around[i]:
                j = to[e]
                if level[j] < 0 and room[e ^ 1] > 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        sources = [i for i in range(n) if left[i] > 0 and level[i] > 0]
        if not sources:
            return [x < 0 for x in level]
        next_edge = [0] * n
        for s in sources:
            while left[s] > 0:
                path: list[int] = []
                i = s
                while left[i] >= 0 and i >= 0:
                    while next_edge[i] < len(around[i]):
                        e = around[i][next_edge[i]]
                        if room[e] > 0 and level[to[e]] == level[i] - 1 and level[i] > 0:
                            break
                        next_edge[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        next_edge[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if left[i] >= 0:
                    break
                flow = min(left[s], -left[i], min(room[e] for e in path))
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                left[s] -= flow
                left[i] += flow


def label_blocks(found: list[Block], costs: Costs = FIXED) -> tuple[list[int], list[bool]]:
    """Each block's own cost, and whether the cheapest labelling keeps it."""
    weights = [int(SCALE * (b.evidence + x)) for b, x in zip(found, text_costs(found, costs))]
    if not weights or min(weights) >= 0:
        return weights, [True] * len(weights)
    return weights, minimum_cut(weights, ties(found, costs))


def extract_text(page: str | None, costs: Costs = FIXED) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, k in zip(found, label_blocks(found, costs)[1]) if k)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Costs:
    """Costs from the `sample` pages whose id and url hash lowest.

    Tasks send counts by bin, so the driver gets at most 2 * 2240 + 10 numbers whatever a page holds.
    """
    place = F.xxhash64("page_id", "url")
    last = pages.select(place.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return FIXED
    chosen = pages.where(place <= last).groupBy("page_id", "url").agg(F.min("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 0):
            for page in batch.column(0):
                counts.update(observe(blocks(page.as_py() or "")))
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
            ["kind", "code", "label", "n"])

    seen = chosen.mapInArrow(run, "kind int, code int, label boolean, n bigint").groupBy("kind", "code", "label").agg(F.sum("n"))
    return costs_of({tuple(row)[:3]: row[3] for row in seen.collect()})


def extract(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`; costs are fitted on them if not given."""
    costs = fit(pages) if costs is None else costs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [extract_text(t.as_py(), costs) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
