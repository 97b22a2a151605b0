"""Main text of web pages by minimum cut.

A page is cut into blocks of running text. A trained classifier gives each block a cost of being content and of being boilerplate; these
are the capacities of its edges to the two terminals. Neighbours in the page, and blocks under the same element, are tied by
smoothness edges, the more strongly the more alike their markup is. The minimum cut, found by maximum flow, separates content from boilerplate.

The classifier is a logistic regression over a block's text and link statistics and over the words of the markup around it: tags, classes,
ids and roles of the elements it stands in. It learns from a bounded sample of pages whose markup is plain (blocks in an article against those
under navigation, footers, adverts and the like), once with the markup words and once without, so pages without such markup are judged by
their text, and markup words that the sample doesn't know say nothing. How strong the ties are is learned too: of a grid of strengths, those under which the
cut labels most blocks of held-out pages right: with the markup words, without them, and with a third of the blocks curtailed besides.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, sample, small_batches
from .toxicity import logistic

#: Pages that the fit uses at most (those with the smallest hash of page_id), and blocks that a markup word has to stand around to be learned.
SAMPLE_PAGES, LEAST_BLOCKS = 1_000, 5
#: Strengths to choose from of the ties between neighbours, and between blocks of one parent element; share of them where one has markup words that the other lacks.
STRENGTHS, UNLIKE = (0.0, 0.3, 0.6, 1.2, 2.4, 4.0), 0.25
#: The classifier's log-odds count up to this, so that ties can outvote it.
MOST_ODDS = 3.5
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)|([^<]+|<)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "textarea", "title", "svg", "iframe", "select")}
#: What is no page text even where no end tag follows.
_TO_THE_END = frozenset("script style title textarea".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source noscript object canvas math mi mo mn ms mrow mtext mfrac msup msub msqrt mroot mover munder mtable mtr mtd annotation semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Markup words of plain boilerplate, from which the fit learns.
_PLAIN = frozenset("nav footer aside form menu dialog ad ads advert advertisement sponsored promo banner cookie cookies consent newsletter subscribe sidebar breadcrumb breadcrumbs pagination comment comments reply replies disqus share social related navigation contentinfo complementary hidden".split())
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES = {"p": frozenset("p"), "li": frozenset("li"), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_SPACE = re.compile(r"\s+")


_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text, with the words of the markup that it stands in."""

    text: str
    linked: int
    parent: int
    tag: str
    markup: frozenset[str]


#: Elements that hold a whole page or its content: their classes tell about the layout.
_FRAMES = frozenset("html body main article".split())


def _markup_words(tag: str, attrs: str) -> set[str]:
    """Words of an element's tag, class, id and role; `hidden` where it isn't shown."""
    words = {tag}
    for name, *values in _ATTR.findall(attrs):
        value, name = next((v for v in values if v), "").lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.add("hidden")
        elif name in ("class", "id", "role") and tag not in _FRAMES:
            words.update(_WORD.findall(value))
    return words


def blocks(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order, white space collapsed; empty ones are left out.

    A form's word is left out where the form holds more than half of the page's text.
    """
    out: list[Block] = []
    # open elements: tag, number, markup words of it and of those around it
    stack: list[tuple[str, int, frozenset[str]]] = [("", 0, frozenset())]
    parts: list[str] = []
    # first block of every form and the one after it, and tags that no end follows any more
    forms: list[tuple[int, int]] = []
    open_forms: dict[int, int] = {}
    endless: set[str] = set()
    linked = links = count = at = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                tag, parent, markup = next(x for x in reversed(stack) if x[0] not in _INLINE)
                if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "blockquote", "pre", "tr", "figcaption") and len(stack) > 1:
                    parent = next((x[1] for x in reversed(stack) if x[0] not in _INLINE and x[0] not in _CLOSES and not re.fullmatch("h[1-6]", x[0])), 0)
                out.append(Block(text, min(linked, len(text)), parent, tag, markup))
            parts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        for _, number, _ in stack[depth:]:
            if number in open_forms:
                forms.append((open_forms.pop(number), len(out)))
        del stack[depth:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            parts.append("<")
            at += 1
            continue
        at = m.end()
        closing, name, attrs, text = m.groups()
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if name is None:
            continue
        tag = name.lower()
        if tag in _RAW and not closing:
            if not attrs.rstrip().endswith("/") and tag not in endless:
                close = _RAW[tag].search(page, at)
                if close:
                    at = close.end()
                elif tag in _TO_THE_END:
                    at = len(page)
                else:
                    endless.add(tag)
            parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        end()
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                close_to(depth)
            continue
        while stack[-1][0] in _CLOSES.get(tag, ()) or stack[-1][0] == "p" and tag not in _INLINE and len(stack) > 1:
            close_to(len(stack) - 1)
        if tag not in _VOID and not attrs.rstrip().endswith("/"):
            count += 1
            if tag == "form":
                open_forms[count] = len(out)
            stack.append((tag, count, stack[-1][2] | _markup_words(tag, attrs)))
    end()
    close_to(1)
    total = sum(len(b.text) for b in out)
    for first, after in forms:
        if 2 * sum(len(b.text) for b in out[first:after]) > total:
            for b in out[first:after]:
                b.markup -= {"form"}
    return out


_END = re.compile(r"[.!?…:;][\"'”»)]*(?:\s|$)")


def features(found: list[Block]) -> np.ndarray:
    """Text and link statistics of each block and of its neighbours."""
    rows = []
    for b in found:
        words = b.text.count(" ") + 1
        rows.append((math.log1p(words), b.linked / len(b.text), min(3, len(_END.findall(b.text))) / 3, float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag == "p"), float(b.tag == "li"), len(b.text) / words / 10))
    x = np.array(rows, np.float64).reshape(-1, 7)
    before, after = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    before[1:], after[:-1] = x[:-1, :2], x[1:, :2]
    return np.concatenate([x, before, after], axis=1)


def _max_flow_side(n: int, source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (Dinic's method); ties hold both ways."""
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k in range(n):
        # only the difference has to flow
        both = min(source[k], sink[k])
        if source[k] > both:
            edge(s, k, source[k] - both, 0.0)
        elif sink[k] > both:
            edge(k, t, sink[k] - both, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        spot, path = [0] * (n + 2), []
        at = s
        while True:
            if at == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                at = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while spot[at] < len(out[at]):
                e = out[at][spot[at]]
                if cap[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    break
                spot[at] += 1
            else:
                if at == s:
                    break
                e = path.pop()
                at = to[e ^ 1]
                spot[at] += 1


@dataclass
class Model:
    bias: float
    slopes: list[float]
    #: Log-odds of the markup words that were learned.
    words: dict[str, float]
    #: Strengths of the ties.
    next: float = 0.6
    parent: float = 0.9

    def odds(self, found: list[Block]) -> np.ndarray:
        """The classifier's log-odds of being content."""
        markup = np.array([sum(self.words.get(w, 0.0) for w in b.markup) for b in found])
        return np.clip(features(found) @ np.array(self.slopes) + self.bias + markup, -MOST_ODDS, MOST_ODDS)

    def labels(self, found: list[Block]) -> list[bool]:
        """Whether each block is content."""
        if not found:
            return []
        odds = self.odds(found)
        # the costs are the negative logarithms of the probabilities
        content, boilerplate = np.logaddexp(0, -odds), np.logaddexp(0, odds)
        known = [b.markup & self.words.keys() for b in found]
        tie = lambda a, b, c: (a, b, c if known[a] == known[b] else c * UNLIKE)
        ties = [tie(k, k + 1, self.next) for k in range(len(found) - 1)]
        last: dict[int, int] = {}
        for k, b in enumerate(found):
            if b.parent in last:
                ties.append(tie(last[b.parent], k, self.parent))
            last[b.parent] = k
        return _max_flow_side(len(found), boilerplate.tolist(), content.tolist(), ties)

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b.text for b, keep in zip(found, self.labels(found)) if keep)


#: Where no page of the sample has plain markup: by text statistics, and the fixed words a little.
DEFAULT = Model(-2.0, [1.0, -3.0, 1.0, 0.5, 0.8, -0.8, 0.0, 0.15, -0.3, 0.15, -0.3], {w: -3.0 for w in _PLAIN} | {"article": 2.0, "main": 0.5})


def _plainly(b: Block) -> bool | None:
    """Whether a block's markup says content (True) or boilerplate (False); None if it says neither."""
    return False if b.markup & _PLAIN or "head" in b.markup or "header" in b.markup and "article" not in b.markup else True if b.markup & {"article", "main"} else None


def without_words(found: list[Block]) -> list[Block]:
    """Blocks whose markup says nothing."""
    return [Block(b.text, b.linked, b.parent, b.tag, frozenset()) for b in found]


def curtailed(found: list[Block]) -> list[Block]:
    """Blocks of `div` elements whose markup says nothing, of every third of which no more is left than its first two words: what the classifier can't be sure of."""
    out = [replace(b, tag="div") for b in without_words(found)]
    for b in out[1::3]:
        b.text = " ".join(b.text.split(" ")[:2]).rstrip(".,:;!?")
        b.linked = min(b.linked, len(b.text))
    return [b for b in out if b.text] if all(b.text for b in out) else without_words(found)


def _regression(sampled: list[tuple[list[Block], list[bool | None]]]) -> Model:
    """The classifier of blocks whose markup is plain."""
    telling = [(x, b, y) for found, said in sampled for x, b, y in zip(features(found), found, said) if y is not None]
    telling.sort(key=lambda r: (r[2], sorted(r[1].markup), r[0].tolist()))
    seen = Counter(w for _, b, _ in telling for w in b.markup)
    known = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if LEAST_BLOCKS <= n < len(telling)))}
    x, y = np.array([r[0] for r in telling]), np.array([r[2] for r in telling], float)
    markup = np.zeros((len(telling), len(known)))
    for k, (_, b, _) in enumerate(telling):
        markup[k, [known[w] for w in b.markup if w in known]] = 1
    # each block counts once with its markup and once without
    bias, slopes = logistic(np.c_[np.r_[x, x], np.r_[markup, np.zeros_like(markup)]], np.r_[y, y], 3.0)
    return Model(bias, slopes[: x.shape[1]].tolist(), {w: float(slopes[x.shape[1] + k]) for w, k in known.items()})


def right(model: Model, sampled: list[tuple[list[Block], list[bool | None]]]) -> int:
    """Blocks of plain markup that the cut labels as their markup says, with the markup words, without, and curtailed."""
    return sum(y is not None and y == kept for found, said in sampled for view in (found, without_words(found), curtailed(found)) for y, kept in zip(said, model.labels(view)))


def _ties(sampled: list[tuple[list[Block], list[bool | None]]]) -> tuple[float, float]:
    """Strengths under which most blocks of every fourth page are right when the others are learned from; of several the weakest."""
    held = sampled[::4]
    model = _regression([p for k, p in enumerate(sampled) if k % 4])
    return max(((n, p) for n in STRENGTHS for p in STRENGTHS), key=lambda t: (right(replace(model, next=t[0], parent=t[1]), held), -t[0] - t[1], -t[0]))


def fit(pages: DataFrame) -> Model:
    """The classifier and the ties, from up to SAMPLE_PAGES pages (page_id, html) with blocks of both kinds in plain markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = [blocks(page) for page in batch.column(0).to_pylist()]
            both = [found for found in pages_ if {True, False} <= {_plainly(b) for b in found}]
            columns = [[[getattr(b, c) for b in found] for found in both] for c in ("text", "linked", "parent", "tag")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [[sorted(b.markup) for b in found] for found in both]], _PAGE.types)], schema=_PAGE)

    few = sample(pages.filter("html is not null").select("page_id", "html"), "page_id", n=SAMPLE_PAGES)
    # no more than SAMPLE_PAGES pages of text
    rows = small_batches(few.select("html")).repartition(8).mapInArrow(releasing(run), "text array<string>, linked array<int>, parent array<int>, tag array<string>, markup array<array<string>>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["text"])
    sampled = [[Block(t, n, p, g, frozenset(m)) for t, n, p, g, m in zip(*(r[c] for c in _PAGE.names))] for r in rows]
    said = [(found, [_plainly(b) for b in found]) for found in sampled]
    if not said:
        return DEFAULT
    model = _regression(said)
    if len(said) < 8:
        return model
    return replace(model, **dict(zip(("next", "parent"), _ties(said))))


_PAGE = pa.schema([("text", pa.list_(pa.string())), ("linked", pa.list_(pa.int32())), ("parent", pa.list_(pa.int32())), ("tag", pa.list_(pa.string())), ("markup", pa.list_(pa.list_(pa.string())))])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id long, url string, text string, n_chars long) of every row of pages (page_id, url, html).

    Null or empty html, and pages without content: the empty text. n_chars counts code points. Pages of any length are read whole; rows
    with one page_id are pages of their own; other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [model.extract(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(releasing(run), "page_id long, url string, text string, n_chars long")
