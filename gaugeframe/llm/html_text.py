"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, as a stream of tags and text; block-level tags cut the text into flat
blocks.  A block is described by its words and link density, by those of its neighbours
before and after, and by what the elements around it say of themselves.  Elements and names
that mean furniture (``nav``, ``cookie-notice``) or content say so outright; a name that
only holds such a word beside others (``related-work``) is a hint, and one that speaks of
another part (``no-sidebar``, ``has-header``) says nothing.  A decision tree, grown by Gini
impurity on the small labelled table below, tells main text from the rest: the features
decide wherever names don't.

Work is a map over rows: no shuffle.  Defined cases: null, empty or text-free html gives an
empty text; unclosed and stray tags, comments and script are read as browsers do, near
enough; repeated rows each get a row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Fixed values of HTML: elements whose content isn't page text, that cut blocks, that hold others.
RAW = "script style title textarea noscript template iframe object svg math canvas audio video xmp noembed noframes".split()
CUTS = (
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul"
).split()
HOLDERS = "article aside blockquote button center details dialog div dl fieldset figure footer form header li main menu nav ol search section select span table td tr ul".split()
FURNITURE = "aside button dialog footer form header menu nav search select".split()
CONTENT = "article main".split()
#: Words in class, id or role that tell furniture or content.
FURNITURE_WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright "
    "disclaimer disqus footer form header hidden login menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup privacy "
    "promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags "
    "teaser toc toolbar widget widgets"
).split()
CONTENT_WORDS = "article body content entry main post story".split()
#: Words that don't change what a name with one of the above means, and words that make it speak of something else.
NEUTRAL_WORDS = (
    "area articles bar block bottom box btn buttons col column container desktop el entries fixed full global group holder icon icons inner item items js "
    "left level link links list local mini mobile module nr number outer page pane panel part posts primary right row secondary section site slot small "
    "sticky stories tab tertiary text title top unit view wide wrap wrapper zone"
).split()
OTHER_WORDS = "has hide hides is no non not show shows with without".split()

#: An attribute's name and value.  A quote opens a value only after "="; one that nothing closes is a plain character.
NAME, VALUE = r"(?:=[^\s/>=]*+|[^\s/>=]++)", r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{NAME}(?:{VALUE})?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"({NAME})({VALUE})?+")
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_raw, _cuts, _holders, _furniture, _content = map(frozenset, (RAW, CUTS, HOLDERS, FURNITURE, CONTENT))
_bad, _good, _neutral, _other = map(frozenset, (FURNITURE_WORDS, CONTENT_WORDS, NEUTRAL_WORDS, OTHER_WORDS))


#: What an element says of the text in it; a hint lowers what the elements around it say.
IS_CONTENT, SAYS_NOTHING, HINT, IS_FURNITURE = 1.0, 0.0, -0.5, -1.0


def meaning(name: str) -> float:
    """Of one name in class, id or role."""
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    if not words or _other.intersection(words):
        return SAYS_NOTHING
    if _bad.isdisjoint(words):
        return SAYS_NOTHING if _good.isdisjoint(words) else IS_CONTENT
    return IS_FURNITURE if all(w in _bad or w in _neutral or w in _good for w in words) else HINT


def role(tag: str, attributes: str) -> float:
    said = IS_CONTENT if tag in _content else IS_FURNITURE if tag in _furniture else SAYS_NOTHING
    if attributes:
        own: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip()[1:].strip()
            own.setdefault(name.lower(), value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[0] else value)
        unseen = "hidden" in own and not own["hidden"].lower().startswith("until")
        if unseen or NOT_SHOWN.search(own.get("style", "")) or own.get("aria-hidden", "").lower().startswith("true"):
            return IS_FURNITURE
        names = [meaning(n) for k in ("class", "id", "role") if k in own for n in own[k].split()]
        if tag in _content and IS_CONTENT in names or tag == "body":
            return said  # its own names agree, or are the whole page's
        if IS_FURNITURE in names:
            return IS_FURNITURE
        if said == SAYS_NOTHING and names:
            return IS_CONTENT if IS_CONTENT in names else min(names)
        if HINT in names and tag not in _content:
            return said
    return said


def around(stack: list[tuple[str, float]]) -> float:
    """What the elements around a block say: the nearest that is sure, less half for hints inside it."""
    hint = 0.0
    for _, r in reversed(stack):
        if r == HINT:
            hint = HINT
        elif r:
            return r + hint if r > 0 else r
    return hint


def blocks(page: str) -> list[tuple[str, int, float, float]]:
    """(text, words, link density, what the elements around say) of the flat blocks."""
    out: list[tuple[str, int, float, float]] = []
    stack: list[tuple[str, float]] = []
    text: list[str] = []
    linked, links, pos, n = [0], 0, 0, len(page)
    heading = False

    def flush():
        s = " ".join("".join(text).split())
        if s:
            words = len(s.split())
            near = around(stack)
            if heading and near < 0 and stack and stack[-1][0] == "header" and any(t == "article" for t, _ in stack):
                near = IS_CONTENT  # an article's own header holds its title
            out.append((s, words, min(1.0, linked[0] / words), near))
        text.clear()
        linked[0] = 0

    while pos < n:
        at = page.find("<", pos)
        at = n if at < 0 else at
        if at > pos:
            s = entities.unescape(page[pos:at]) if "&" in page[pos:at] else page[pos:at]
            text.append(s)
            if links:
                linked[0] += len(s.split())
        if at == n:
            break
        m = TOKEN.match(page, at)
        if not m:
            text.append("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _cuts:
                flush()
                heading = False
            if tag == "a":
                links = 0
            elif tag in _holders:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if k >= 0:
                    del stack[k:]
            continue
        if tag in _raw:
            end = RAW_END[tag].search(page, pos)
            if end is None:
                if tag in ("script", "style", "textarea", "title", "xmp"):
                    break
                continue
            close = page.find(">", end.start())
            pos = n if close < 0 else close + 1
            continue
        if tag in _cuts:
            flush()
            heading = tag in ("h1", "h2")
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            links = 1
        elif tag in _holders and not m[3].rstrip().endswith("/"):
            stack.append((tag, role(tag, m[3])))
    flush()
    return out


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "role"]
#: The labelled table: features as above, then 1 for main text.
LABELLED = """
45 0 30 0 60 0 1 1|80 .05 45 0 20 0 1 1|1 0 60 0 45 0 1 1|2 0 0 0 30 0 1 1|8 0 6 1 70 0 1 1|3 .3 40 0 50 .1 1 1|12 0 5 0 3 0 1 1|150 .1 1 1 5 1 1 1
4 0 2 0 2 0 1 1|1 0 1 0 0 0 1 1|6 0 90 0 12 0 1 1|60 .2 40 .2 30 1 1 1|20 0 20 0 8 1 1 1|9 .2 9 0 9 0 1 1|30 .4 60 0 40 0 1 1|5 0 12 1 40 0 1 1
1 1 1 1 1 1 -1 0|2 1 1 1 60 0 -1 0|8 0 1 1 6 0 -1 0|12 0 60 0 0 0 -1 0|40 0 3 0 8 0 -1 0|25 .1 30 0 4 1 -1 0|70 0 80 0 5 0 -1 0|6 .5 40 0 2 1 -1 0
15 0 15 0 15 0 -1 0|3 0 60 0 60 0 -1 0|120 0 30 0 10 0 -1 0|1 0 0 0 0 0 -1 0|10 .8 1 1 30 0 -1 0|30 0 0 0 90 0 -1 0|9 0 100 0 1 1 -1 0|18 0 5 1 20 0 -1 0
60 0 50 0 70 0 0 1|90 .1 8 0 60 0 0 1|25 0 60 0 40 0 0 1|8 0 3 1 80 0 0 1|30 .1 2 1 45 0 0 1|40 .2 40 .1 3 1 0 1|18 0 30 0 6 1 0 1|120 0 1 1 0 0 0 1
20 0 25 0 22 0 0 1|6 0 55 0 60 0 0 1|15 0 70 0 35 .1 0 1|50 0 0 0 0 0 0 1|35 .05 4 1 2 1 0 1|2 0 40 0 40 0 0 1|4 0 80 0 90 0 0 1|11 0 45 0 1 1 0 1
1 1 1 1 1 1 0 0|2 1 0 0 1 1 0 0|3 1 50 0 2 1 0 0|4 0 1 1 2 1 0 0|6 .8 60 0 5 .9 0 0|5 0 30 .9 4 0 0 0|12 .7 12 .7 40 0 0 0|2 0 2 1 1 1 0 0
7 0 3 0 0 0 0 0|40 .8 10 .7 12 .9 0 0|20 .6 8 .5 3 1 0 0|1 0 2 0 1 1 0 0|3 0 4 0 2 0 0 0|5 .4 6 .5 3 .6 0 0|9 .9 80 0 70 0 0 0|4 1 100 0 60 0 0 0
75 .3 60 .1 50 .2 0 1|22 .2 45 .05 60 0 0 1|3 0 70 0 65 0 0 1|10 .1 2 0 55 0 0 1|200 .05 180 .02 150 .1 0 1|16 0 90 .1 80 0 0 1
28 .9 30 .9 28 .9 0 0|14 .5 16 .6 12 .5 0 0|3 0 3 0 3 0 0 0|6 0 2 1 4 1 0 0|2 .5 2 .5 2 .5 0 0|60 .9 2 0 5 0 0 0
60 0 50 0 70 0 .5 1|25 0 60 0 40 0 .5 1|120 .02 1 1 0 0 .5 1|12 0 40 0 55 0 .5 1|30 .1 20 0 25 0 .5 1|8 0 45 0 60 0 .5 1|2 0 30 0 60 0 .5 1
6 .8 60 0 5 .9 .5 0|12 .7 12 .7 40 0 .5 0|3 1 4 1 50 0 .5 0|2 1 2 1 1 1 .5 0|40 .8 10 .7 12 .9 .5 0|5 .9 30 0 5 1 .5 0|4 1 80 0 4 1 .5 0
60 0 50 0 70 0 -.5 1|90 .05 8 0 60 0 -.5 1|35 0 40 0 30 0 -.5 1|120 0 1 1 0 0 -.5 1|45 .1 2 1 45 0 -.5 1|28 0 70 0 65 0 -.5 1
8 0 1 1 6 0 -.5 0|12 0 60 0 0 0 -.5 0|5 .5 6 .5 4 .6 -.5 0|2 1 1 1 3 1 -.5 0|20 .6 8 .5 3 1 -.5 0|15 0 3 0 5 0 -.5 0|7 .3 30 0 4 0 -.5 0
"""


class DecisionTree:
    """Binary tree by Gini impurity; thresholds halfway between neighbouring values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.root = self._grow(x, y, depth)

    def _grow(self, x, y, depth):
        if not depth or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = (np.inf, 0, 0.0)
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for t in (v[1:] + v[:-1]) / 2:
                left = x[:, j] <= t
                p, q = y[left].mean(), y[~left].mean()
                best = min(best, (left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q), j, float(t)))
        if best[0] == np.inf:
            return bool(y.mean() >= 0.5)
        _, j, t = best
        left = x[:, j] <= t
        return j, t, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def __call__(self, row) -> bool:
        node = self.root
        while not isinstance(node, bool):
            j, t, a, b = node
            node = a if row[j] <= t else b
        return node


@lru_cache(1)
def tree() -> DecisionTree:
    rows = np.array([[float(v) for v in r.split()] for r in re.split(r"[|\n]", LABELLED.strip())])
    return DecisionTree(rows[:, :-1], rows[:, -1])


def main_blocks(page: str | None) -> list[str]:
    """The blocks of the main text, in order."""
    found, judge, out = blocks(page or ""), tree(), []
    for i, (s, words, links, near) in enumerate(found):
        before = found[i - 1] if i else ("", 0, 0.0, 0)
        after = found[i + 1] if i + 1 < len(found) else ("", 0, 0.0, 0)
        if judge((words, links, before[1], before[2], after[1], after[2], near)):
            out.append(s)
    return out


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars) per row."""

    def make():
        def f(htmls, urls):
            texts = ["\n\n".join(main_blocks(h)) for h in htmls]
            return {"url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    kinds = {"url": "string", "text": "string", "n_chars": "long"}
    return per_text(pages, make, kinds, id_col, html_col, extra={"url": F.col(url_col)}).withColumnRenamed("doc_id", "page_id")
