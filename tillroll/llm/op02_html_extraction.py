"""HTML extraction: the maximum-scoring contiguous region of a page, words positive and tags negative.

A page is read once into blocks (text between block-level tags) and tags. A word adds the weight of its block's element, a tag subtracts
its own; one linear scan keeps the best sum that ends at each place and so finds the region with the largest sum. Weights come from
pages that say where their content is (an ``article``, ``main`` or ``itemprop=articleBody`` element): log-odds of an element's words and of
a tag inside against outside, from a bounded sample (``SAMPLE`` pages of the smallest hash of id and url; one page of those alike in both), kept positive for words and
negative for tags. Inside the region, elements that never are content (menus, headers and footers of the page, sidebars, notices,
adverts, forms, reader comments, by element, role, or class and id) are cut out with all they hold, unless one proves to wrap the page
when it closes: it holds a ``main`` or articleBody, or most of the page's marked words (inside marked content: with a marked element, or all but a tenth); or, on a page that marks nothing, it is a form or was named
by class or id and holds most of the page's words (a comment list: all but a tenth). Elements inside such a wrapper are judged in turn; scripts, styles and comments of the
markup are no text at all. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Counting weights and extracting are Spark jobs over whole pages; only the table of weights (the names of elements in
the sample) passes the driver.

Defined results: null or empty html gives the empty text and 0; markup that is never closed ends with the page; a page without
a word outside of cut elements gives the empty text; repeated rows and null ids stay; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit

#: pages that weights are learned from, at most
SAMPLE = 20_000
#: fixed sets of the markup language
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset("nav aside form footer menu dialog input fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: words of class and id names
CUT_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars side aside widget widgets nav navbar navigation "
                       "menu menus breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
                       "signup login related recommended share sharing social toolbar pagination pager form search disclaimer tags skip").split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion feedback".split())
KEEP_WORDS = frozenset("article content main body post entry story text page container wrapper".split())
HOME = frozenset(("article", "main"))
TAG = re.compile(r"<(/?)([^\W\d_][^\s/>]*+)")
MARKING = ("role", "itemprop", "hidden", "aria-hidden", "class", "id")
BETWEEN = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+")
EQUALS = re.compile(r"\s*+=\s*+")
BARE = re.compile(r"[^\s>]*+")
PART = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")


def _attributes(page: str, at: int, unclosed: set[str]) -> tuple[int, dict[str, str | None]]:
    """The place of the > that ends a tag whose name ends at ``at`` (-1 if none does), and its attributes, values of any length.
    A quote that is never closed is skipped; ``unclosed`` remembers it, so that a page is read once however many there are."""
    found: dict[str, str | None] = {}
    n = len(page)
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= n:
            return -1, found
        if page[at] == ">":
            return at, found
        m = ATTRIBUTE.match(page, at)
        key, at = m[0].lower(), m.end()
        value = None
        m = EQUALS.match(page, at)
        if m:
            at = m.end()
            quote = page[at:at + 1]
            if quote in ('"', "'"):
                end = -1 if quote in unclosed else page.find(quote, at + 1)
                if end < 0:
                    unclosed.add(quote)
                    at += 1
                else:
                    value, at = page[at + 1:end], end + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(key, value)


def _marks(name: str, rest: dict[str, str | None], within: int) -> tuple[str, bool, bool]:
    """Why an element is cut out ("" if it is not), whether it says that it holds the content, and whether class or id call it something else."""
    cut, home = "element" if name in CUT or (name == "header" and not within) else "", name in HOME
    if name in ("form", "fieldset"):
        cut = "name"
    sure = other = False
    for key in MARKING if rest else ():
        if key not in rest:
            continue
        value = rest[key] or ""
        if key == "role":
            if value.lower() in CUT_ROLES:
                cut = cut or ("name" if value.lower() == "form" else "element")
        elif key == "itemprop":
            sure |= value.lower() == "articlebody"
        elif key == "hidden" and rest[key] is None or key == "aria-hidden" and value.lower() == "true":
            cut = "hidden"
        elif key in ("class", "id"):
            parts = {p for w in value.split() for p in PART.split(w) if p} | {p for w in value.lower().split() for p in re.split(r"[^a-z]+", w)}
            if parts & COMMENT_WORDS:
                other = True
                cut = cut if cut in ("hidden", "element") else "comments"
            elif parts & CUT_WORDS and not parts & KEEP_WORDS:
                other = True
                cut = cut or "name"
    return "" if name in ("html", "body", "article", "main") else cut, home or sure, other and name != "main" and not sure


def _settle(items: list[tuple], spans: list[list], proper: list[bool]) -> list[tuple]:
    """Items with the cuts of ``spans`` (first item, end, why, holds a main or articleBody, holds any marked element, opens in one), as they open, that do not prove to wrap the page.
    ``proper``: whether an item stands in marked content that is not called comments, advert or the like."""
    words, marked = [0], [0]
    for x, p in zip(items, proper, strict=True):
        n = len(x[0].split()) if x[0] is not None else 0
        words.append(words[-1] + n)
        marked.append(marked[-1] + n * p)
    reach = 0
    flags = [False] * len(items)
    for i, j, why, sure, nested, inside in spans:
        if i < reach:  # inside an element that is cut
            continue
        held, home = words[j] - words[i], marked[j] - marked[i]
        if why == "hidden":
            wraps = False
        elif marked[-1]:
            wraps = home > 0 and (sure or (nested or not inside) and 2 * home > marked[-1] or why in ("name", "comments") and 10 * home > 9 * marked[-1])
        else:
            wraps = why == "name" and 2 * held > words[-1] or why == "comments" and 10 * held > 9 * words[-1]
        if not wraps:
            flags[i:j] = [True] * (j - i)
            reach = max(reach, j)
    return [(x[0], x[1], f, *x[3:]) for x, f in zip(items, flags, strict=True)]


def read_page(page: str) -> list[tuple]:
    """Items of a page in order: (text, element, cut, home, inline tags) of a block, or (None, tag, cut, home, 0) of a block-level tag."""
    items: list[tuple] = []
    words: list[str] = []
    inline: list[str] = []
    element, elements, standing = "body", ["body"], Counter(body=1)
    depth: dict[str, int] = {}  # open elements by name
    spans: list[list] = []  # cuts as they open, see _settle
    cuts: list[tuple[str, int, int]] = []  # open cuts: name, its depth before, place in spans
    levels: dict[str, list[int]] = {}  # depths of the open cuts of a name
    homes: list[tuple[str, bool]] = []
    proper: list[bool] = []
    unclosed: set[str] = set()
    at, n = 0, len(page)

    def open_cut(name: str, why: str) -> None:
        cuts.append((name, depth.get(name, 0), len(spans)))
        levels.setdefault(name, []).append(depth.get(name, 0))
        spans.append([len(items), -1, why, False, False, any_proper()])

    def end_cut() -> tuple[str, int]:
        name, level, k = cuts.pop()
        levels[name].pop()
        spans[k][1] = len(items)
        if cuts:
            for f in (3, 4):
                spans[cuts[-1][2]][f] |= spans[k][f]
        return name, level

    def close_cuts(name: str) -> None:
        """Ends the cut that a closing tag closes, and those opened in it."""
        depth[name] = max(depth.get(name, 0) - 1, 0)
        if levels.get(name) and levels[name][-1] >= depth[name]:
            while end_cut() != (name, depth[name]):
                pass

    def any_proper() -> bool:
        return len(homes) > 0 and homes[-1][1]

    def close_block() -> None:
        text = SPACES.sub(" ", html.unescape("".join(words))).strip()
        if text:
            items.append((text, element, False, len(homes) > 0, tuple(inline)))
            proper.append(any_proper())
        words.clear()
        inline.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            words.append(page[at:])
            break
        if lt > at:
            words.append(page[at:lt])
        follow = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if follow in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (follow.isalpha() or follow == "/" and page[lt + 2:lt + 3].isalpha()):
            words.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        closing, name = bool(m[1]), m[2].lower()
        end, rest = _attributes(page, m.end(), unclosed)
        if end < 0:
            break
        whole, at = page[end - 1] == "/", end + 1
        if name in SILENT:
            if not closing and name != "head" and not whole:  # all it holds is skipped
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = n if stop < 0 else stop + 1
            continue
        if name in INLINE:
            if name == "br":
                words.append(" ")
            inline.append(name)
            if name in VOID:
                continue
            if closing:
                if levels.get(name) and levels[name][-1] >= depth[name] - 1:
                    close_block()
                close_cuts(name)
            else:
                cut, _, _ = _marks(name, rest, len(homes))
                if cut and rest:
                    close_block()
                    open_cut(name, cut)
                depth[name] = depth.get(name, 0) + 1
            continue
        close_block()
        while cuts and cuts[-1][0] in ("p", "li", "dt", "dd") and not (closing and name == cuts[-1][0]):
            end_cut()  # such an element ends where the next block begins
        cut, home, other = _marks(name, rest, len(homes)) if not closing else ("", False, False)
        if closing and homes and name == homes[-1][0]:
            homes.pop()
        opens = not closing and name not in VOID and not whole
        if cut:
            open_cut(name, cut)
        items.append((None, name, False, len(homes) > 0 or home, ()))
        proper.append(any_proper())
        if cut and not opens:
            end_cut()
        if closing:
            close_cuts(name)
            while len(elements) > 1 and elements[-1] != name and standing[name]:
                standing[elements.pop()] -= 1
            if len(elements) > 1 and elements[-1] == name:
                standing[elements.pop()] -= 1
        elif opens:
            if home:
                if cuts and not other:
                    spans[cuts[-1][2]][3] |= name != "article"
                    spans[cuts[-1][2]][4] = True
                homes.append((name, not other and (not homes or homes[-1][1])))
            elif homes and name == homes[-1][0]:
                homes.append((name, homes[-1][1]))
            depth[name] = depth.get(name, 0) + 1
            if name in ("p", "li", "dt", "dd", "td", "th", "tr") and elements[-1] == name:
                standing[elements.pop()] -= 1
            elements.append(name)
            standing[name] += 1
        element = elements[-1]
    close_block()
    while cuts:
        end_cut()
    return _settle(items, spans, proper) if spans else items


def count_items(items: list[tuple]) -> Counter:
    """(kind, element, inside the content) of a page that says where its content is; empty for others."""
    out: Counter = Counter()
    if any(x[3] for x in items):
        for text, name, cut, home, inline in items:
            side = home and not cut
            if text is None:
                out["tag", name, side] += 1
            else:
                out["word", name, side] += len(text.split())
                for t in inline:
                    out["tag", t, side] += 1
    return out


class Weights:
    """Positive weights of words by element, negative ones of tags."""

    def __init__(self, counts: dict[tuple[str, str, bool], int]):
        self.words, self.tags = {}, {}
        total = {(k, s): sum(n for (a, _, b), n in counts.items() if a == k and b == s) + 1 for k in ("word", "tag") for s in (True, False)}
        for kind, name in {(k, e) for k, e, _ in counts}:
            odds = math.log((counts.get((kind, name, True), 0) + 0.5) / total[kind, True]) - math.log((counts.get((kind, name, False), 0) + 0.5) / total[kind, False])
            if kind == "word":
                self.words[name] = min(max(0.5 + odds / 4, 0.2), 2.0)
            else:
                self.tags[name] = -min(max(0.4 - odds / 4, 0.01), 3.0)

    def word(self, name: str) -> float:
        return self.words.get(name, 1.0 if name in ("p", "h1", "h2", "h3", "blockquote", "pre", "article", "section") else 0.5)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.05 if name in ("p", "h1", "h2", "h3", "b", "i", "em", "strong", "br", "blockquote") else -0.5)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range [i, j) with the largest sum; the longer one of equals; empty if none is positive."""
    best = now = 0.0
    i = lo = hi = 0
    for k, s in enumerate(scores):
        if now <= 0:
            now, i = 0.0, k
        now += s
        if now > best or (now == best and best > 0 and k + 1 - i > hi - lo):
            best, lo, hi = now, i, k + 1
    return lo, hi


def main_text(page: str | None, weights: Weights) -> str:
    items = read_page(page or "")
    marked = any(x[3] and x[0] is not None and not x[2] for x in items)
    scores = []
    for text, name, cut, home, inline in items:
        size = len(text.split()) if text is not None else 0
        if cut:  # not shown in any case: a small hurdle, none inside marked content
            scores.append(0.0 if home else -min(0.2 * size, 1.0))
        elif text is None:
            scores.append(weights.tag(name))
        else:
            value = size * weights.word(name)
            value = max(value + sum(map(weights.tag, inline)), 0.1 * value)
            scores.append(-value if marked and not home else value)
    lo, hi = best_region(scores)
    return "\n".join(x[0] for x in items[lo:hi] if x[0] is not None and not x[2])


def learn_weights(pages: DataFrame, rows: int = SAMPLE) -> Weights:
    """Weights from a bounded sample of ``pages`` (page_id, html)."""
    kit.small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            total: Counter = Counter()
            for page in b.column("html").to_pylist():
                total.update(count_items(read_page(page or "")))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in total], pa.string()), pa.array([e for _, e, _ in total], pa.string()),
                                              pa.array([s for _, _, s in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
                                             names=["kind", "element", "inside", "n"])
    named = pages.select(F.xxhash64(F.lit(2), "page_id", "url").alias("h"), F.col("html").cast("string").alias("html"))
    last = named.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # the hash of that rank
    some = named.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    counts = (some.select("html").mapInArrow(run, "kind string, element string, inside boolean, n long")
              .groupBy("kind", "element", "inside").agg(F.sum("n").alias("n")).collect())  # as many as the sample's element names
    return Weights({(r.kind, r.element, r.inside): r.n for r in counts})


def html_extraction(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    weights = learn_weights(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(p, weights) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return (pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(kit.table(spark, sf_dir, "pages"))
