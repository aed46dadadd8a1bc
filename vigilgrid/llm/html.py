"""Main text of web pages by a maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score by the element that holds them, tags score below
zero, noise elements and all they hold score zero; both weights are log odds of lying inside the article, learned from the pages that mark one. A
linear scan finds the run with the highest sum, and its words outside noise elements are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names by their role in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "search section select summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label link mark meta meter "
                   "output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object option script select style svg "
                  "template textarea title".split())
# Words of a class, id or role that say what an element is, and words beside them that say only where or how it lies.
NOISE_NAMES = re.compile(r"(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|contentinfo|disqus|footer|header|menu|modal|nav|navbar|navigation"
                         r"|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|widgets?)")
PLACE_NAMES = re.compile(r"(?:area|articles|bar|block|body|bottom|box|buttons?|container|content|form|global|group|inner|items?|left|links|list|main|outer|overlay"
                         r"|page|panel|posts?|primary|region|right|secondary|section|site|slot|strip|thread|top|unit|wrap|wrapper|\d*)")
#: Elements that hold a page or name a part of it; a class or id never makes them noise.
NEVER_NAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
# End tags that HTML lets a page leave out: a start tag closes the open elements listed for it, inside the nearest bound.
HEAD_CONTENT = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_CELLS = frozenset("td th".split())
_ROWS = _CELLS | {"tr"}
_PARTS = _ROWS | frozenset("caption colgroup tbody tfoot thead".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "td": _CELLS | {"caption"}, "th": _CELLS | {"caption"},
          "tr": _ROWS | {"caption", "colgroup"}, **dict.fromkeys("caption colgroup tbody tfoot thead".split(), _PARTS), "option": frozenset(["option"]),
          "optgroup": frozenset("option optgroup".split()), "rt": frozenset("rt rp".split()), "rp": frozenset("rt rp".split())}
# What may be left open inside a list item without keeping the next item from closing it.
_LOOSE = INLINE | {"p", "div", "address"}
_CELL_BOUNDS = frozenset("body button caption html object table td template th".split())
BOUNDS = {"p": _CELL_BOUNDS, "li": _CELL_BOUNDS | {"ol", "ul", "menu", "dir"}, "dt": _CELL_BOUNDS | {"dl"}, "dd": _CELL_BOUNDS | {"dl"},
          **dict.fromkeys(_PARTS, frozenset("body html table template".split())), **dict.fromkeys("option optgroup".split(), frozenset("body datalist html select".split())),
          **dict.fromkeys("rt rp".split(), frozenset("body html ruby".split()))}
_NAMED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Elements whose content is text up to their end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# Comments, declarations and tags. A quote counts at the start of a value only, and one that never ends is a plain character; no part gives
# back what it took, so a page is read in one go whatever it holds. A tag that never ends takes the rest of the page.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?+|</(?![a-zA-Z])[^>]*+>?+"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>?+""", re.S)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?+", re.I) for name in RAW}
#: Open elements at most; one more takes the place of the innermost, as browsers do.
DEEPEST = 512
#: Bounds of a learned weight, and the most a tag may score.
CLIP, TAG_MOST, WORD_LEAST = 8.0, -0.1, 0.5


def _depth(open_elements: list[tuple], names: frozenset[str], bounds: frozenset[str]) -> int | None:
    """Place of the innermost open element of ``names`` that no element of ``bounds`` encloses more closely."""
    for i in range(len(open_elements) - 1, -1, -1):
        if open_elements[i][0] in names:
            return i
        if open_elements[i][0] in bounds:
            return None
    return None


def implied_end(open_elements: list[tuple], name: str) -> int | None:
    """How many open elements stay when a start tag closes others by itself; None if it closes none."""
    to = None
    if name == "body" or open_elements and open_elements[-1][0] == "head" and name not in HEAD_CONTENT:
        to = _depth(open_elements, frozenset(["head"]), frozenset())
    elif name in CLOSES:
        at = len(open_elements)
        if name in ("li", "dt", "dd"):
            # Any block but a paragraph, div or address keeps the outer item open.
            while at and (open_elements[at - 1][0] in _LOOSE or open_elements[at - 1][0] not in BLOCKS | NOISE):
                at -= 1
            to = at - 1 if at and open_elements[at - 1][0] in CLOSES[name] else None
        else:
            while at and open_elements[at - 1][0] not in BOUNDS[name]:
                at -= 1
                if open_elements[at][0] in CLOSES[name]:
                    to = at
    if name in CLOSES_P:
        p = _depth(open_elements if to is None else open_elements[:to], frozenset(["p"]), _CELL_BOUNDS)
        to = p if p is not None else to
    return to


def noise_name(attributes: str) -> bool:
    """Whether a class, id or role names noise: whole names such as ``sidebar`` or ``site-footer``, not ``with-sidebar`` or ``market-share``."""
    for name in (n for x in _NAMED.findall(attributes) for n in "".join(x).lower().split()):
        told = [p for p in re.split("[-_]+", name) if not PLACE_NAMES.fullmatch(p)]
        if told and all(NOISE_NAMES.fullmatch(p) for p in told):
            return True
    return False


class _Elements:
    """Elements of a page in the order they open; number 0 stands for the page itself."""

    def __init__(self) -> None:
        self.names, self.parents, self.suspects, self.words = [""], [0], [False], [0]

    def opened(self, name: str, parent: int, attributes: str) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.suspects.append(name in NOISE or name not in NEVER_NAMED and bool(attributes) and noise_name(attributes))
        self.words.append(0)
        return len(self.names) - 1

    def noise(self) -> list[bool]:
        """Elements that are noise or lie in it. A suspect that holds ``main``, or the only ``article`` or a first heading beside more than half
        of the words outside other suspects, is what a page wraps its text in and no noise."""
        n = len(self.names)
        sole = "article" if self.names.count("article") == 1 else ""
        main, known = [x == "main" for x in self.names], [x == "h1" or x == sole for x in self.names]
        for e in range(n - 1, 0, -1):
            above = self.parents[e]
            main[above] |= main[e]
            known[above] |= main[e] or known[e] and (self.names[above] != "header" or self.names[e] != "h1")
        aside = [False] * n
        for e in range(1, n):
            aside[e] = aside[self.parents[e]] or self.suspects[e] and not known[e]
        plain = [0 if a else w for a, w in zip(aside, self.words)]
        for e in range(n - 1, 0, -1):
            plain[self.parents[e]] += plain[e]
        out = [False] * n
        for e in range(1, n):
            wraps = self.names[e] != "head" and (main[e] or known[e] and 2 * plain[e] > plain[0])
            out[e] = out[self.parents[e]] or self.suspects[e] and not wraps
        return out


def tokens(page: str) -> list[tuple[str, str, bool, str]]:
    """``(kind, feature, noise, text)``: kind is tag or words; the feature names the element.

    Malformed pages read as browsers read them; depth is bounded, so the time grows with the page's length.
    """
    elements = _Elements()
    open_elements: list[tuple[str, int, str]] = []
    counts: Counter = Counter()
    seen: list[tuple[str, str, int, str]] = []

    def close(to: int | None) -> None:
        if to is not None:
            counts.subtract(x[0] for x in open_elements[to:])
            del open_elements[to:]

    def words(start: int, end: int) -> None:
        if end > start:
            text = page[start:end]
            if open_elements and open_elements[-1][0] == "head" and not text.isspace():
                close(len(open_elements) - 1)
            _, e, holder = open_elements[-1] if open_elements else ("", 0, "none")
            elements.words[e] += _count_words(text)
            seen.append(("words", holder, e, text))

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        words(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name or page[at - 1] != ">":
            seen.append(("tag", "hidden", -1, ""))
            continue
        if name in RAW:
            if not m[1]:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            seen.append(("tag", "hidden", -1, ""))
            continue
        known = name if name in BLOCKS or name in INLINE or name in NOISE else "other"
        if m[1]:
            seen.append(("tag", f"/{known}", open_elements[-1][1] if open_elements else 0, name))
            if counts[name]:
                close(_depth(open_elements, frozenset([name]), BOUNDS.get(name, frozenset())))
            continue
        if counts["svg"] and name in BLOCKS:
            close(_depth(open_elements, frozenset(["svg"]), frozenset()))
        if name == "body" or name in CLOSES or counts["p"] and name in CLOSES_P or open_elements and open_elements[-1][0] == "head":
            close(implied_end(open_elements, name))
        void = name in VOID or m[3].endswith("/")
        if not void and len(open_elements) >= DEEPEST:
            close(len(open_elements) - 1)
        _, parent, holder = open_elements[-1] if open_elements else ("", 0, "none")
        e = elements.opened(name, parent, m[3])
        seen.append(("tag", known, e, name))
        if not void:
            open_elements.append((name, e, name if name in BLOCKS else holder))
            counts[name] += 1
    words(at, len(page))
    noise = elements.noise() + [True]
    return [(kind, ("noise" if noise[e] else f) if kind == "words" else f + "!" * (noise[e] and e >= 0), noise[e], text) for kind, f, e, text in seen]


def _count_words(text: str) -> int:
    return len(text.split())


def label_counts(page: str) -> Counter:
    """Tokens inside and outside the article by feature; empty unless the page marks exactly one."""
    seen = tokens(page)
    opened = [i for i, t in enumerate(seen) if t[0] == "tag" and t[3] == "article" and t[1].startswith("article")]
    closed = [i for i, t in enumerate(seen) if t[0] == "tag" and t[1].startswith("/article")]
    out: Counter = Counter()
    if len(opened) == len(closed) == 1:
        for i, (kind, feature, _, text) in enumerate(seen):
            out[kind, feature, opened[0] <= i <= closed[0]] += _count_words(text) if kind == "words" else 1
    return out


def learned_weights(pages: DataFrame, html_col: str = "html") -> dict[tuple[str, str], float]:
    """Weights by (kind, feature) from all labelled pages; features are element names, so they are few."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page or ""))
        rows = [(*k, v) for k, v in total.items()]
        if rows:
            kind, feature, inside, n = zip(*rows)
            yield pa.record_batch([pa.array(kind), pa.array(feature), pa.array(inside), pa.array(n, pa.int64())], ["kind", "feature", "inside", "n"])

    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(count, "kind string, feature string, inside boolean, n long")
    rows = counts.groupBy("kind", "feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")).collect()
    return {(r.kind, r.feature): max(-CLIP, min(CLIP, math.log((r.i + 1) / (r.o + 1)))) for r in rows}


def score(kind: str, feature: str, noise: bool, weights: dict[tuple[str, str], float]) -> float:
    """Noise is left out of the text anyway, so it neither extends a run nor parts one."""
    if noise:
        return 0.0
    if kind == "tag":
        return min(TAG_MOST, weights.get((kind, feature), -1.0))
    weight = weights.get((kind, feature), 1.0)
    return max(WORD_LEAST, weight) if weight >= 0 else weight


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run with the highest sum, the first of equals; empty if none is above zero."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The article's blocks, one a line; empty for null, empty and wordless pages."""
    seen = tokens(page or "")
    scores = [score(k, f, n, weights) * (_count_words(t) if k == "words" else 1) for k, f, n, t in seen]
    start, end = best_run(scores)
    blocks, now = [], []
    for kind, _, noise, text in seen[start:end]:
        if kind == "tag":
            if text in BLOCKS:
                blocks.append("".join(now))
                now = []
            elif text == "br":
                now.append(" ")
        elif not noise:
            now.append(html.unescape(text))
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extracted(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``pages`` (or ``carry``) and ``_main``, the main text of each row.

    Weights come from all rows that mark one article; where none does, words score above and tags
    below zero by default. Repeated rows are extracted each; no rows give no rows.
    """
    weights = learned_weights(pages, html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p, weights) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("row"), texts], ["row", "_main"])

    columns = [c for c in (pages.columns if carry is None else carry) if c != "_main"]
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    rows = pages.select(row, F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("_main", T.StringType())])
    return rows.mapInArrow(run, schema).select("row.*", "_main")
