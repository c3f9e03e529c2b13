"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score above zero and tags below, with
weights from labelled pages: those whose author marked the text by ``article`` or ``main``. How
much likelier a tag, or a word in or out of a link, is inside the marked part than outside sets its
weight. One linear scan finds the contiguous region of the highest sum. The region is then widened
to the element that holds it (in a bare body to the like elements beside it), and what a page puts inside an article
without being part of it is left out; its words score nothing:

* elements whose tag says so: menus, headers, footers, asides, forms, scripts, styles. The headlines in
  an article's header stay;
* elements named so by class, id or role. The labelled pages teach which names stand for text
  and which don't; of names that they don't have, the last part that says something counts
  (``comments-area``, ``page-footer``), against a list. An element that holds most of the words it competes with
  isn't left out by a name that the list calls weak (``post-form``), by others only if nothing else holds words.

Blocks are the runs of text between block-level tags, in page order, joined by a blank line. In a
block character references are decoded and white space is one space; line breaks count as white space.

A null or empty page, or one without words, has the text ''. Rows may repeat, keys may be null; an
empty table gives no rows. Markup may be broken: tags without ends, stray ends and unquoted
attributes are read as browsers do in the simple cases, and like them elements deeper than ``DEEPEST``
aren't nested further. Reading takes time in proportion to the page, whatever its markup. Columns
other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

#: Labelled pages that weights are fitted on, about.
LABELLED = 2000

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z][^\s/>]*)")
_SIGN = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: Elements within one another that a page's tree has at most, as in browsers.
DEEPEST = 512

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset("script style noscript template svg iframe textarea title select button object canvas math".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_APART = frozenset("nav header footer aside form fieldset dialog menu head".split())
_HOLDERS = frozenset("article main section div td".split())
_MARKED = frozenset(("article", "main"))
_HEADLINES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_LOWER = {c: c + 32 for c in range(65, 91)}
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: What a class, id or role says of an element that isn't the article, surely or weakly; parts that say nothing.
_NAMED_APART = frozenset("nav navbar navigation menu menus masthead footer sidebar ad ads advert adverts advertisement cookie cookies consent gdpr comments disqus replies respond popup modal newsletter breadcrumb breadcrumbs pagination pager contentinfo complementary".split())
_NAMED_WEAKLY = frozenset("header aside banner sponsor sponsored promo notice notices subscribe subscription signup login form search comment alert share sharing social related recommended widget widgets copyright toolbar".split())
_EMPTY_PARTS = frozenset("area list section wrapper wrap container box block content inner outer primary secondary main left right top bottom links buttons button posts items item bar panel group holder region zone slot".split())
#: An open element of the first kind ends where one of the second starts.
_ENDED_BY = {"p": _BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


#: Names with one of these (has-sidebar, no-header) tell of a page's layout, not of a part.
_LAYOUT = frozenset("has no with without layout".split())
#: Words of labelled pages that a name must stand around to be learned, and the share of them inside below which it is none of the text.
LEARNED, OUTSIDE = 50, 0.1


class _Block:
    __slots__ = ("text", "words", "path", "apart", "at", "linked", "tagged")

    def __init__(self, text, words, linked, path, tagged, at):
        self.text, self.words, self.linked, self.path, self.apart, self.tagged, self.at = text, words, linked, path, tagged, tagged, at


class _Element:
    __slots__ = ("tag", "names", "tagged", "named")

    def __init__(self, tag: str, names: list[str], tagged: bool):
        self.tag, self.names, self.tagged, self.named = tag, names, tagged, ""


def _names(tag: str, attributes: str) -> list[str]:
    if tag in ("html", "body", "main", "article") or "=" not in attributes:
        return []
    return [name for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()]


def _named(names: list[str], learned: dict[str, float]) -> str:
    """Whether names tell that an element is apart: "surely", "weakly" or ""."""
    known = [learned[n.lower()] for n in names if n.lower() in learned]
    if known and max(known) >= OUTSIDE:
        return ""
    said = "surely" if known else ""
    for name in names:
        parts = [p.lower() for p in _PARTS.findall(name)]
        if name.lower() in learned or _LAYOUT.intersection(parts):
            continue
        telling = [p for p in parts if p not in _EMPTY_PARTS]
        if telling and telling[-1] in _NAMED_APART:
            said = "surely"
        elif telling and telling[-1] in _NAMED_WEAKLY:
            said = said or "weakly"
    return said


def _mark_named(blocks: list[_Block], elements: list[_Element], learned: dict[str, float]) -> None:
    """Set ``apart`` of blocks in elements that are named apart, sparing those that hold most of what they compete with."""
    for e in elements:
        if e.names and not e.tagged:
            e.named = _named(e.names, learned)
    if not any(e.named for e in elements):
        return
    free = [b for b in blocks if not b.tagged]
    marked = [b for b in free if any(elements[e].tag in _MARKED for e in b.path)]
    competing = marked or free
    total, held = sum(b.words for b in competing), Counter()
    for b in competing:
        held.update({e: b.words for e in b.path if elements[e].named})
    around = set()  # named elements that hold an article or main
    for b in marked:
        first = next(k for k, e in enumerate(b.path) if elements[e].tag in _MARKED)
        around.update(b.path[:first])
    alone = all(any(elements[e].named and e not in around for e in b.path) for b in competing)
    for e, n in held.items():
        if 2 * n > total and (elements[e].named == "weakly" or e in around or alone):
            elements[e].named = ""
    for b in free:
        b.apart = any(elements[e].named for e in b.path)


def _tag_end(page: str, at: int, ends: dict[int, int], last: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag, those in quotes passed over; -1 if none. ``ends`` holds what was found from each quote."""
    way = []
    while True:
        m = _SIGN.search(page, at)
        if not m:
            found = -1
            break
        q = m.start()
        if page[q] == ">":
            found = q
            break
        if q in ends:
            found = ends[q]
            break
        way.append(q)
        if q >= last[page[q]]:  # the quote never closes
            found = -1
            break
        at = page.index(page[q], q + 1) + 1
    ends.update(dict.fromkeys(way, found))
    return found


def read_page(page: str, learned: dict[str, float] | None = None) -> tuple[list[_Block], list[tuple[int, str]], list[str]]:
    """Blocks; (place, tag) of all tags; tag of each element. A block's path numbers its elements."""
    blocks, tags, elements = _read(page, learned)
    return blocks, tags, [e.tag for e in elements]


def _read(page: str, learned: dict[str, float] | None) -> tuple[list[_Block], list[tuple[int, str]], list[_Element]]:
    blocks: list[_Block] = []
    tags: list[tuple[int, str]] = []
    elements: list[_Element] = []
    stack: list[tuple[int, str, bool]] = []  # (element, tag, apart by its tag or one around it)
    held: list[str] = []
    linked = place = links = 0
    lower = None
    ends, last = {}, {c: page.rfind(c) for c in "\"'>"}

    def flush():
        nonlocal held, linked, place
        words = references.unescape("".join(held)).split()
        if words:
            blocks.append(_Block(" ".join(words), len(words), min(linked, len(words)), tuple(e for e, _, _ in stack), bool(stack and stack[-1][2]), place))
            place += 1
        held, linked = [], 0

    def close(k: int):
        nonlocal links
        if any(t in _BLOCKS for _, t, _ in stack[k:]):
            flush()
        links -= sum(t == "a" for _, t, _ in stack[k:])
        del stack[k:]

    def say(text: str):
        nonlocal linked
        held.append(text)
        if links:
            linked += len(text.split())

    at, n = 0, len(page)
    while at < n:
        m = _OPEN.search(page, at) if last[">"] >= at else None
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        start, sign = m.start(), m[0]
        if sign == "<!--":
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        if sign in ("<!", "<?"):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else n
            continue
        stop = _tag_end(page, m.end(), ends, last)
        if stop < 0:  # a quote never closes: the tag ends at the next sign that may end it
            stop = page.find(">", m.end())
            if stop < 0:
                say(page[start:])
                break
        at, tag, attributes = stop + 1, sign.lstrip("</").lower(), page[m.end() : stop]
        tags.append((place, tag))
        if sign[1] == "/":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == tag), -1)
            if k >= 0:
                close(k)
            elif tag in _BLOCKS:
                flush()
            continue
        if tag in _SKIPPED and not attributes.endswith("/"):
            if lower is None:  # letters beyond ASCII may change their number of characters
                lower = page.translate(_LOWER)
            stop = lower.find("</" + tag, at)
            stop = page.find(">", stop) if stop >= 0 else -1
            at = stop + 1 if stop >= 0 else n
            held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
        for k in range(len(stack) - 1, -1, -1):
            other = stack[k][1]
            if tag in _ENDED_BY.get(other, ()):
                close(k)
                break
            if other in ("table", "ul", "ol", "dl") or other in _HOLDERS and other != "td":
                break
        if tag in _BLOCKS:
            flush()
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS or len(stack) >= DEEPEST:
            continue
        inner = bool(stack and stack[-1][2])
        if tag in _HEADLINES and inner and stack[-1][1] in ("header", "hgroup", "div") and _in_marked_header(stack, elements):
            inner = False
        tagged = tag in _APART
        links += tag == "a"
        elements.append(_Element(tag, _names(tag, attributes), tagged))
        stack.append((len(elements) - 1, tag, inner or tagged))
    flush()
    _mark_named(blocks, elements, learned or {})
    return blocks, tags, elements


def _in_marked_header(stack: list[tuple[int, str, bool]], elements: list[_Element]) -> bool:
    """Whether the open elements are an article or main, its header, and nothing else that is apart."""
    apart = [t for e, t, _ in stack if elements[e].tagged]
    return apart == ["header"] and any(t in _MARKED for _, t, _ in stack[: next(k for k, x in enumerate(stack) if x[1] == "header")])


def count_features(page: str) -> Counter:
    """(feature, inside) of a labelled page; features are tags, and words in and out of links."""
    blocks, tags, elements = read_page(page)
    inside = [any(elements[e] in _MARKED for e in b.path) and not b.apart for b in blocks]
    seen: Counter = Counter()
    for b, i in zip(blocks, inside, strict=True):
        seen["linked word", i] += b.linked
        seen["word", i] += b.words - b.linked
    for place, tag in tags:  # a tag belongs to the block that follows it
        seen[tag if tag in _BLOCKS or tag in _VOID else "inline", place < len(inside) and inside[place]] += 1
    return seen


def count_names(page: str) -> Counter:
    """(name, inside): words of a labelled page around which a class, id or role stands, in and out of its article."""
    blocks, _, elements = _read(page, None)
    seen: Counter = Counter()
    for b in blocks:
        inside = any(elements[e].tag in _MARKED for e in b.path) and not b.tagged
        for name in {x.lower() for e in b.path for x in elements[e].names}:
            seen[name, inside] += b.words
    return seen


def fit_names(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """The share of words inside the text, for names that stand around LEARNED words or more."""
    total: Counter = Counter()
    for (name, _), n in counts.items():
        total[name] += n
    return {name: counts.get((name, True), 0) / n for name, n in total.items() if n >= LEARNED}


def fit_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of being inside, words held above zero and tags below."""
    total = {i: sum(n for (_, j), n in counts.items() if i == j) for i in (True, False)}
    weights = {}
    for f in {f for f, _ in counts}:
        odds = math.log((counts.get((f, True), 0) + 1) / (total[True] + 1)) - math.log((counts.get((f, False), 0) + 1) / (total[False] + 1))
        weights[f] = min(4.0, max(0.25, odds)) if f in ("word", "linked word") else -min(4.0, max(0.02, -odds))
    return weights


#: Used where no page is labelled.
PLAIN_WEIGHTS = {"word": 1.0, "linked word": 0.25}


def best_region(blocks: list[_Block], tags: list[tuple[int, str]], weights: dict[str, float]) -> tuple[int, int]:
    """First and last block of the region of the highest sum; (0, -1) if there is none."""
    score = [0.0] * (len(blocks) + 1)  # of the tags before each block
    other = weights.get("inline", -1.0)
    for place, tag in tags:
        score[place] += weights.get(tag, other)
    best, region, now, start = 0.0, (0, -1), 0.0, 0
    for k, b in enumerate(blocks):
        now += score[k]
        if now <= 0:
            now, start = 0.0, k
        if not b.apart:
            now += (b.words - b.linked) * weights["word"] + b.linked * weights["linked word"]
        if now > best:
            best, region = now, (start, k)
    return region


def extract(page: str | None, weights: dict[str, float], learned: dict[str, float] | None = None) -> str:
    """The main text of a page; ``learned`` has the shares of :func:`fit_names`."""
    blocks, tags, elements = read_page(page or "", learned)
    first, last = best_region(blocks, tags, weights)
    while first <= last and blocks[first].apart:
        first += 1
    if first > last:
        return ""
    region = [b for b in blocks[first : last + 1] if not b.apart]
    common = 0
    while all(len(b.path) > common and b.path[common] == region[0].path[common] for b in region):
        common += 1
    holders = [e for e in region[0].path[:common] if elements[e] in _HOLDERS]
    marked = [e for e in holders if elements[e] in _MARKED]
    if holder := marked[-1:] or holders[-1:]:
        region = [b for b in blocks if holder[0] in b.path and not b.apart]
    else:  # the body itself: what stands beside the region in like elements belongs to it
        above = region[0].path[:common]
        kinds = _TEXT | {elements[b.path[common]] for b in region if len(b.path) > common}
        region = [b for b in blocks if not b.apart and b.path[:common] == above and (len(b.path) == common or elements[b.path[common]] in kinds)]
    return "\n\n".join(b.text for b in region)


def learn_weights(pages: DataFrame, labelled: int = LABELLED) -> tuple[dict[str, float], dict[str, float]]:
    """Weights, and the shares of names, from about ``labelled`` of the pages that mark their text, drawn by a hash."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html")
    n = marked.count()
    if not n:
        return PLAIN_WEIGHTS, {}
    sample = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < min(1.0, labelled / n) * (1 << 20))

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                page = page.as_py()
                seen.update({("tag", *k): v for k, v in count_features(page).items()})
                seen.update({("name", *k): v for k, v in count_names(page).items()})
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*seen, strict=True)), pa.array(list(seen.values()), pa.int64())], ["kind", "feature", "inside", "n"])

    counted = sample.mapInArrow(count, "kind string, feature string, inside boolean, n long").groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n"))
    counts: dict[str, dict] = {"tag": {(f, False): 0 for f in ("word", "linked word")}, "name": {}}
    for r in counted.collect():  # tags and names of the sample
        counts[r["kind"]][r["feature"], r["inside"]] = r["n"]
    return fit_weights(counts["tag"]), fit_names(counts["name"])


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, learned: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page; weights and names are learned from the pages unless they are given."""
    if weights is None:
        weights, learned = learn_weights(pages)

    def run(batches):
        for batch in batches:
            texts = [extract(p.as_py(), weights, learned) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
