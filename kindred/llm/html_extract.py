"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A logistic classifier gives each block the cost of being content and of
being boilerplate; these are capacities to the two terminals. Neighbours in reading order and neighbours in the DOM (next
blocks of the same parent and of the same grandparent) share smoothness edges. A maximum flow finds the cheapest cut; the
blocks on the source's side are content. Blocks whose own cost outweighs all their edges are decided beforehand, which never
changes the least minimum cut; what is left flows from each source to its nearest sinks, and what it reaches beyond them is
never searched again.

The classifier sees text, links, tag and surroundings of a block. It is trained on at most train_pages pages (a documented
bound, by hash order) whose semantic tags tell the label: blocks below article or main are content; blocks below nav, header,
footer, aside, form or menu, or outside of an article on a page that has one, are boilerplate. Those tags themselves are no
features.

Cases: a null or empty page, or one without text, has null text and no blocks; unclosed tags close with their parents;
unclosed scripts and comments reach to the end; a bare "<" is text; entities are decoded; equal costs go to boilerplate;
without training labels (no semantic tags anywhere) fixed weights serve; repeated rows get equal results; very long pages are
read whole, in time proportional to their length, also where tags never close; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, lean
from kindred.llm.toxicity import fit_logistic

TRAIN_PAGES = 300
NEXT, SIBLING, COUSIN = 0.6, 0.6, 0.2
#: Capacities are whole numbers, so that flows are exact.
UNIT = 1000
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg")}
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GOOD, _BAD = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "menu"))
_HIDDEN = frozenset(("title", "head"))
_HINT = re.compile(r"\b(?:ad|ads|advert|banner|promo|sponsor|cookie|share|social|comment|sidebar|breadcrumb|widget|menu|footer|nav)s?\b", re.I)
_TAGS = ("p", "li", "h", "td", "div", "pre")
WIDTH = 6 + len(_TAGS) + 9
_FALLBACK = np.zeros(WIDTH + 1)
_FALLBACK[:3], _FALLBACK[-1] = (2.0, -6.0, 1.0), -1.5


class Block:
    __slots__ = ("depth", "hint", "label", "links", "parent", "tag", "text", "up")

    def __init__(self, text, links, tag, depth, parent, up, label, hint):
        self.text, self.links, self.tag, self.depth, self.parent, self.up, self.label, self.hint = text, links, tag, depth, parent, up, label, hint


def tokens(page: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(text or None, tag, whether it closes, attributes) in order. Every search goes forward from where the last one ended, and none is made twice in vain."""
    at, size, ends = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, lt + 1)
        if name and page[lt + 1] != "/" and (tag := name[1].lower()) in _CLOSE:
            end = _CLOSE[tag].search(page, name.end())
            at = end.end() if end else size
            continue
        gt = page.find(">", lt) if ends and (name or page[lt + 1 : lt + 2] in ("!", "/", "?")) else -1
        if gt < 0:
            # A "<" that begins no tag, or one that nothing closes, is text.
            ends = ends and not (name or page[lt + 1 : lt + 2] in ("!", "/", "?"))
            yield "<", "", False, ""
            at = lt + 1
            continue
        if name:
            yield None, name[1].lower(), page[lt + 1] == "/", page[name.end() : gt]
        at = gt + 1


def blocks(page: str) -> list[Block]:
    """Text blocks in reading order. label: 1 below a content tag, 0 below a boilerplate tag, -1 else."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, -1, False)]  # tag, number, label, hinted
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    serial = links = in_link = hidden = 0

    def flush() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text and not hidden:
                tag, number, label, hint = stack[-1]
                out.append(Block(text, min(links, len(text)), tag, len(stack), stack[-2][1] if len(stack) > 1 else 0, stack[-3][1] if len(stack) > 2 else 0, label, hint))
            links = 0

    def pop() -> str:
        nonlocal hidden
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        hidden -= tag in _HIDDEN
        return tag

    for text, tag, closes, attributes in tokens(page):
        if text is not None:
            parts.append(text)
            if in_link:
                links += len(text.strip())
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closes else 1
            continue
        flush()
        if tag in _VOID:
            continue
        in_link = 0
        if closes:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag:
            pop()
        serial += 1
        _, _, label, hint = stack[-1]
        label = 0 if tag in _BAD or label == 0 else 1 if tag in _GOOD else label
        stack.append((tag, serial, label, hint or bool(attributes and _HINT.search(attributes))))
        open_tags[tag] += 1
        hidden += tag in _HIDDEN
        if tag == "body":
            hidden = 0
    flush()
    return out


def features(bs: list[Block]) -> np.ndarray:
    n = len(bs)
    x = np.zeros((n, WIDTH))
    for i, b in enumerate(bs):
        size = len(b.text)
        words = b.text.count(" ") + 1
        stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
        x[i, 0] = min(words, 400)
        x[i, 1] = b.links / size
        x[i, 2] = stops / words
        x[i, 3] = min(size / words, 20)
        x[i, 4] = b.hint
        x[i, 5] = b.depth
        t = b.tag[:1] if b.tag[:1] == "h" and b.tag[1:].isdigit() else b.tag
        if t in _TAGS:
            x[i, 6 + _TAGS.index(t)] = 1
    x[:, 0] = np.log1p(x[:, 0]) / 3
    x[:, 2] = np.minimum(x[:, 2], 1) * 3
    x[:, 3] /= 10
    x[:, 5] /= 10
    k = 6 + len(_TAGS)
    place = np.arange(n) / max(n - 1, 1)
    x[:, k], x[:, k + 1], x[:, k + 2] = np.abs(2 * place - 1), np.arange(n) == 0, np.arange(n) == n - 1
    for shift, at in ((1, k + 3), (-1, k + 6)):
        near = np.zeros((n, 3))
        if n > 1:
            near[max(shift, 0) : n + min(shift, 0)] = x[max(-shift, 0) : n + min(-shift, 0), :3]
        x[:, at : at + 3] = near
    return x


def edges(bs: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness edges (i, j), i < j, with their capacities."""
    out: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int], int] = {}
    for i, b in enumerate(bs):
        if i:
            out[i - 1, i] = int(NEXT * UNIT)
        for kind, group, cap in ((0, b.parent, SIBLING), (1, b.up, COUSIN)):
            j = seen.get((kind, group))
            if j is not None:
                out[j, i] = out.get((j, i), 0) + int(cap * UNIT)
            seen[kind, group] = i
    return out


def _decided(net: list[int], cap: list[dict[int, int]]) -> list[bool | None]:
    """The side of nodes that their own cost decides against all their edges, one after another; their edges become costs of the others."""
    side: list[bool | None] = [None] * len(net)
    held = [sum(c.values()) for c in cap]
    todo = list(range(len(net)))
    while todo:
        i = todo.pop()
        if side[i] is not None or -held[i] < net[i] <= held[i]:
            continue
        side[i] = net[i] > held[i]
        for j, c in cap[i].items():
            del cap[j][i]
            held[j] -= c
            net[j] += c if side[i] else -c
            todo.append(j)
        cap[i] = {}
    return side


def minimum_cut(net: list[int], links: dict[tuple[int, int], int]) -> list[bool]:
    """Whether each node is on the source's side of the least minimum cut. net: capacity from the source less that to the sink; links carry their capacity both ways."""
    n = len(net)
    net = list(net)
    cap: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in links.items():
        cap[i][j] = cap[i].get(j, 0) + c
        cap[j][i] = cap[j].get(i, 0) + c
    side = _decided(net, cap)
    # From each source in turn to its nearest sink. What a source reaches without a sink is closed for good: no edge leads
    # out of it any more, so it is the source's side and no later search enters it. So searches in vain cost one pass in all.
    for source in range(n):
        if side[source] is not None:
            continue
        while net[source] > 0:
            came, goal = {source: -1}, -1
            front = [source]
            while front and goal < 0:
                after = []
                for i in front:
                    for j, c in cap[i].items():
                        if c and j not in came and side[j] is None:
                            came[j] = i
                            if net[j] < 0:
                                goal = j
                                break
                            after.append(j)
                    if goal >= 0:
                        break
                front = after
            if goal < 0:
                for i in came:
                    side[i] = True
                break
            path, i = [], goal
            while came[i] >= 0:
                path.append((came[i], i))
                i = came[i]
            flow = min(net[source], -net[goal], *(cap[a][b] for a, b in path))
            net[source] -= flow
            net[goal] += flow
            for a, b in path:
                cap[a][b] -= flow
                cap[b][a] += flow
    return [bool(s) for s in side]


def terminal(x: np.ndarray, w: np.ndarray) -> list[int]:
    """log-odds of content, in units: -log P(boilerplate) less -log P(content)."""
    return np.rint(np.clip(x @ w[:-1] + w[-1], -6, 6) * UNIT).astype(int).tolist()


def extract(page: str | None, w: np.ndarray) -> tuple[str | None, int, int]:
    """(content, number of blocks, number of content blocks)."""
    bs = blocks(page or "")
    if not bs:
        return None, 0, 0
    side = minimum_cut(terminal(features(bs), w), edges(bs))
    kept = [b.text for b, s in zip(bs, side) if s]
    return "\n".join(kept) if kept else None, len(bs), len(kept)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for page in batch.column(1).to_pylist():
            bs = blocks(page or "")
            good = any(b.label == 1 for b in bs)
            y = np.array([0 if b.label < 0 and good else b.label for b in bs], np.int8)
            xs.append(features(bs).tobytes() if bs else b"")
            ys.append(y.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["page_id", "x", "y"])


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from at most train_pages pages; of rows that share a page_id one is read."""
    rows = frugal(pages).where("html IS NOT NULL AND page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    ids = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    # A bounded list of ids: the broadcast holds at most train_pages rows.
    sample = rows.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    got = sorted(sample.mapInArrow(_collect, "page_id long, x binary, y binary").collect(), key=lambda r: r["page_id"])
    x = np.concatenate([np.zeros((0, WIDTH)), *(np.frombuffer(r["x"]).reshape(-1, WIDTH) for r in got)])
    y = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r["y"], np.int8) for r in got)])
    x, y = x[y >= 0], y[y >= 0].astype(float)
    return fit_logistic(x, y, 1.0) if len(y) and 0 < y.mean() < 1 else _FALLBACK


def _run(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [extract(p, w) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["page_id", "text", "n_blocks", "n_content"])

    return lean(run)


def content(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every row."""
    w = fit(pages, train_pages)
    return frugal(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_run(w), "page_id long, text string, n_blocks int, n_content int")
