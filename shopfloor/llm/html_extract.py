"""HTML extraction by the maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive, tags
negative, words inside menus, notices and the like strongly negative, with
weights that are log odds between content and the rest on labelled pages:
those whose markup names the content (article, main).  One linear scan finds
the contiguous stretch of the highest total.  The stretch is widened to the
element that holds it, and what stands in excluded elements is left out.

The weights are fitted on at most ``sample`` pages, chosen by a hash of their
key over the whole table; every page is scored.  A task holds one page's
tokens at a time, and nothing is shuffled but the sample's keys.

Defined cases: a null page is an empty page; a page without words gives an
empty text; a page without a positive stretch gives an empty text; equal
stretches: the first; unclosed and stray tags are repaired the way browsers do
in the common cases; repeated rows give repeated results; an empty table gives
an empty table; columns other than the page pass through.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

TAG_RE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG_RE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE_RE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: Elements whose words are never content.
EXCLUDED = frozenset(
    "nav header footer aside form script style noscript template iframe svg math canvas object select option button "
    "textarea input menu dialog title head video audio".split()
)
#: A class, id or role holding one of these words marks such an element too.
EXCLUDED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "aside footer header masthead toolbar comment comments commentlist respond disqus reply replies related share sharing "
    "social newsletter subscribe subscription signup login widget widgets pagination pager skip search contentinfo "
    "complementary".split()
)
CONTENT_WORDS = frozenset("articlebody".split())
#: Where a start tag ends open elements of these names without an end tag.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_P_INSIDE = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: In every page whose markup names its content (and in few others).
LABELLED_RE = r"(?i)<(?:article|main)\b|\brole\s*=[^>]*(?:main|&)|\bitemprop\s*=[^>]*(?:articlebody|&)"
#: Used where no page of the sample is labelled.
DEFAULT_WEIGHTS = {"word": 1.0, "excluded": -3.0, "tag": -3.25}


@dataclass
class Element:
    name: str
    parent: Element | None
    excluded: bool
    content: bool
    start: int = 0
    end: int = 0
    depth: int = field(default=0)


def _words_in(value: str) -> set[str]:
    """The words of a class, id or role, without those that say of an element
    that it has, or has not, such a part beside it."""
    value = re.sub(r"\b(?:has|with|without|no)[-_]\w+", " ", value)
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


def _open(name: str, attributes: str, parent: Element | None, at: int) -> Element:
    excluded, content = name in EXCLUDED or bool(parent and parent.excluded), name in ("article", "main")
    if attributes.strip():
        for key, *values in ATTRIBUTE_RE.findall(attributes):
            key, value = key.lower(), entities.unescape("".join(values))
            if key in ("class", "id", "role") and name not in ("html", "body"):
                found = _words_in(value)
                excluded = excluded or bool(found & EXCLUDED_WORDS)
                content = content or (key == "role" and "main" in found)
            elif key == "itemprop":
                content = content or value.lower() in CONTENT_WORDS
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                excluded = True
            elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                excluded = True
    return Element(name, parent, excluded, content and not excluded, at, at, parent.depth + 1 if parent else 0)


def tokens(page: str) -> Iterator[tuple[str, str, Element]]:
    """("text", decoded text, element), ("open", name, element) and ("close",
    name, element) in page order.  Elements' start and end are set to token
    numbers as they open and close."""
    root = Element("#page", None, False, False)
    stack, count, at, n = [root], 0, 0, len(page)

    def close_to(k: int) -> None:
        for e in stack[k:]:
            e.end = count
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        while 0 <= lt < n - 1 and not (page[lt + 1].isalpha() or page[lt + 1] in "/!?"):
            lt = page.find("<", lt + 1)
        if lt < 0 or lt >= n - 1:
            lt = n
        if lt > at:
            yield "text", entities.unescape(page[at:lt]), stack[-1]
            count += 1
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        tag = TAG_RE.match(page, lt) or LOOSE_TAG_RE.match(page, lt)
        if tag is None:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1  # a declaration, or a tag cut off by the end of the page
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k:
                yield "close", name, stack[k]
                count += 1
                close_to(k)
            continue
        if name in NO_P_INSIDE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close_to(k)
                    break
                if stack[k].name not in INLINE:
                    break
        elif name in CLOSES:
            ended, scope = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in scope:
                    break
                if stack[k].name in ended:
                    close_to(k)
                    break
        element = _open(name, tag[3], stack[-1], count)
        yield "open", name, element
        count += 1
        if name in VOID or tag[3].endswith("/") and name in ("svg", "path"):
            element.end = count
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
            element.end = count
        else:
            stack.append(element)
    close_to(0)


def _kind(what: str, value: str, element: Element) -> str:
    if what == "text":
        return "excluded" if element.excluded else "word"
    return value


def label_counts(page: str) -> Counter[tuple[str, bool]]:
    """How often each kind of token stands inside and outside the content that
    the markup names; empty if it names none."""
    found: Counter[tuple[str, bool]] = Counter()
    labelled = False
    for what, value, element in tokens(page):
        inside, e = False, element
        while e is not None and not inside:
            inside, e = e.content, e.parent
        inside = inside and not element.excluded
        labelled = labelled or inside
        found[_kind(what, value, element), inside] += len(value.split()) if what == "text" else 1
    return found if labelled else Counter()


def fit_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Smoothed log odds of each kind of token; words stay positive, tags and
    excluded words negative.  ``tag`` is for tags the sample does not hold."""
    inside = sum(n for (_, i), n in counts.items() if i)
    outside = sum(n for (_, i), n in counts.items() if not i)
    if not inside:
        return dict(DEFAULT_WEIGHTS)
    odds = {
        k: math.log((counts.get((k, True), 0) + 1) / (inside + 2)) - math.log((counts.get((k, False), 0) + 1) / (outside + 2))
        for k in {k for k, _ in counts}
    }
    word = max(0.5, odds.pop("word", 1.0))
    excluded = min(-0.5, odds.pop("excluded", -3.0))
    tags = {k: min(-0.25, v) for k, v in odds.items()}
    return {**tags, "word": word, "excluded": excluded, "tag": sum(tags.values()) / max(1, len(tags)) or -3.25}


def best_stretch(scores: list[float]) -> tuple[int, int, float]:
    """(start, end, total) of the contiguous stretch with the highest total;
    empty and 0 if no score is positive."""
    best, begin, end, run, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, begin, end = run, start, k + 1
    return begin, end, best


def _chain(element: Element) -> list[Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out


def main_text(page: str | None, weights: dict[str, float]) -> tuple[str, float]:
    """(text, score) of the page's main content."""
    stream = list(tokens(page or ""))
    scores = [
        weights[_kind(*t)] * len(t[1].split()) if t[0] == "text" else weights.get(t[1], weights["tag"]) for t in stream
    ]
    start, end, score = best_stretch(scores)
    if end == start:
        return "", 0.0
    words = [k for k in range(start, end) if stream[k][0] == "text" and not stream[k][2].excluded and stream[k][1].split()]
    if not words:
        return "", 0.0
    # the innermost element that holds the stretch, then outwards: to the
    # outermost element named as content, else out of paragraphs and phrases
    first, last = _chain(stream[words[0]][2]), {id(e) for e in _chain(stream[words[-1]][2])}
    holders = [e for e in first if id(e) in last]
    holder = next((e for e in reversed(holders) if e.content), None)
    if holder is None:
        holder = next(e for e in holders if e.name in ("div", "section", "td", "body", "#page", "html") or e.parent is None)
    if holder.name in ("body", "#page", "html"):
        low, high = start, end  # no element of its own: the stretch itself
        low = next((k for k in range(start, -1, -1) if stream[k][0] == "open" and stream[k][1] not in INLINE), low)
        high = next((k for k in range(end - 1, len(stream)) if stream[k][0] != "text" and stream[k][1] not in INLINE), high)
    else:
        low, high = holder.start, holder.end
    parts = []
    for what, value, element in stream[low:high]:
        if what == "text":
            if not element.excluded:
                parts.append(value)
        elif value not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split()), score


def learn_weights(pages: DataFrame, key_col: str, html_col: str, sample: int = 500) -> dict[str, float]:
    """Weights from at most ``sample`` pages whose markup may name their
    content, one a key, those with the lowest hash of their key."""
    keyed = pages.select(F.xxhash64(F.col(f"`{key_col}`")).alias("h"), F.col(f"`{html_col}`").alias("html"))
    keyed = keyed.where(F.col("html").rlike(LABELLED_RE))
    top = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not top:
        return dict(DEFAULT_WEIGHTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total += label_counts(page or "")
        kinds = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in kinds], pa.string()), pa.array([i for _, i in kinds], pa.bool_()), pa.array([total[k] for k in kinds], pa.int64())],
            names=["kind", "inside", "n"],
        )

    # one row for each of at most ``sample`` hashes, whatever the table holds
    chosen = keyed.where(F.col("h") <= max(top)).dropDuplicates(["h"]).select("html")
    rows = chosen.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return fit_weights({(r["kind"], r["inside"]): r["n"] for r in rows.collect()})


def extract_main_text(
    pages: DataFrame,
    html_col: str = "html",
    weights: dict[str, float] | None = None,
    key_col: str | None = None,
    sample: int = 500,
    prefix: str = "",
) -> DataFrame:
    """``pages`` without the page column and with ``text``, ``n_chars`` and
    ``score``.  Weights are learned from ``sample`` pages keyed by ``key_col``
    unless given.  Added names get ``prefix``; they must not be columns of
    ``pages``."""
    if weights is None:
        weights = learn_weights(pages, key_col, html_col, sample) if key_col else dict(DEFAULT_WEIGHTS)
    others = [c for c in pages.columns if c != html_col]
    fields = [pages.schema[c] for c in others] + [
        StructField(prefix + "text", StringType()),
        StructField(prefix + "n_chars", LongType()),
        StructField(prefix + "score", DoubleType()),
    ]
    names = [f.name for f in fields]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, weights) for page in batch.column(len(others)).to_pylist()]
            columns = [batch.column(k) for k in range(len(others))]
            columns += [
                pa.array([t for t, _ in found], pa.string()),
                pa.array([len(t) for t, _ in found], pa.int64()),
                pa.array([s for _, s in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(*[f"`{c}`" for c in [*others, html_col]]).mapInArrow(extract, StructType(fields))
