"""Main text of web pages by tree scoring."""

from __future__ import annotations

import heapq
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rollcall.llm.common import give_back

# Element names by role, and the words of class and id that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed".split())
DROPPED = frozenset("head script style noscript template iframe textarea title nav header footer aside button select option input svg canvas object menu dialog fieldset label audio video map xmp noframes noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("html table td th ul ol dl button object".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations teaser "
    "comment comments discussion disqus reply replies respond subscribe subscription newsletter signup login register search widget pagination pager skip hidden byline tags "
    "kommentare commentaires comentarios publicidad werbung anzeige".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

#: Words that mark what readers wrote.
READERS = frozenset("comment comments discussion disqus reply replies respond kommentare commentaires comentarios".split())
#: Words that make a "header" the article's own.
OWN = frozenset("entry post article story content".split())

#: How a tag begins; what ends it, or opens a value in quotes that may hold ">".
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ENDING = re.compile("[>\"']")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
CLASS_WORD = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: What attributes tell of an element.
PLAIN, SUSPECT, COMMENT = 0, 1, 2


def _marks(attributes: str) -> int:
    """Whether class, id, role or style mark an element as no article, or as comments of readers."""
    found = PLAIN
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id"):
            words = {w.lower() for w in CLASS_WORD.split(value)}
            if words & READERS:
                return COMMENT
            if (words & UNLIKELY) - (frozenset(["header"]) if words & OWN else frozenset()):
                found = SUSPECT
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            found = SUSPECT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found = SUSPECT
    return found


class _TagEnds:
    """Where tags end in one source. Values in quotes are passed over; what was found from a place on is
    kept, so that all searches together take time in proportion to the source."""

    def __init__(self, source: str) -> None:
        self.source, self.known = source, {}
        self.last = {q: source.rfind(q) for q in "\"'"}

    def find(self, at: int) -> int:
        """The offset after the ">" that ends a tag whose attributes begin at `at`; where quotes do not close,
        that of the next ">"."""
        first, passed = at, []
        while at not in self.known:
            passed.append(at)
            m = ENDING.search(self.source, at)
            if m is None or m[0] != ">" and m.start() == self.last[m[0]]:
                self.known[at] = -1
            elif m[0] == ">":
                self.known[at] = m.end()
            else:
                at = self.source.find(m[0], m.end()) + 1
        for k in passed:
            self.known[k] = self.known[at]
        return self.known[at] if self.known[at] >= 0 else self.source.find(">", first) + 1


class _Page:
    """Elements in page order with their parents, and pieces of text with the block they lie in.

    Elements of DROPPED go with all they hold. Forms, and elements that class, id, role or style mark
    as no article, are only suspects until the whole page is read: one that wraps half of the page's
    text and is a form or holds its title, or an article that is not itself marked, is the page, not a
    part to leave out. An article does not make comments of readers the page. Where nothing else has text,
    the suspect with most of it stays, and so on inside of it until there is some.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.holder = ["html"], [0], [0]
        self.dropped, self.linked, self.marks = [False], [False], [PLAIN]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self.open: Counter = Counter()
        stack = [0]
        for closing, name, attributes in self._tags(source, stack):
            if name in BLOCK:
                self.block += 1
            if name == "br":
                self._text(stack[-1], " ")
                continue
            if closing:
                self._close(stack, name)
                continue
            if name == "body" and self.tag[stack[-1]] == "head":
                self._cut(stack, len(stack) - 1)
            if name in BLOCK:
                self._close_open(stack, frozenset(["p"]))
            if name in CLOSES:
                self._close_open(stack, CLOSES[name])
            up, me = stack[-1], len(self.tag)
            self.tag.append(name)
            self.parent.append(up)
            self.holder.append(me if name in BLOCK else self.holder[up])
            own_header = name == "header" and (self.open["article"] or self.open["main"])
            self.dropped.append(self.dropped[up] or name in DROPPED and not own_header)
            marks = _marks(attributes) if attributes and name not in ("html", "body", "main") else PLAIN
            self.marks.append(SUSPECT if name == "form" else PLAIN if name == "article" and marks != COMMENT else marks)
            self.linked.append(self.linked[up] or name == "a")
            if name in RAW or name not in VOID and not attributes.endswith("/"):
                stack.append(me)
                self.open[name] += 1
        self._drop_suspects()

    def _tags(self, source: str, stack: list[int]) -> Iterator[tuple[str, str, str]]:
        """(closing, name, attributes) of each tag; text goes to the element on top of the stack. A "<"
        that begins no tag, or after which no ">" comes, is text."""
        at = start = 0
        last, ends = source.rfind(">"), _TagEnds(source)
        while (lt := source.find("<", at)) >= 0:
            tag = OPENING.match(source, lt) if lt < last else None
            other = None if tag or lt > last and not source.startswith("<!--", lt) else OTHER.match(source, lt)
            if not tag and not other:
                at = lt + 1
                continue
            self._text(stack[-1], source[start:lt])
            at = start = ends.find(tag.end()) if tag else other.end()
            if not tag:
                continue
            name = tag[2].lower()
            yield tag[1], name, source[tag.end() : at - 1]
            if name in RAW and not tag[1]:
                end = re.compile("</" + re.escape(name), re.I | re.A).search(source, at)
                at = start = end.start() if end else len(source)
        self._text(stack[-1], source[start:])

    def _text(self, element: int, text: str) -> None:
        if text and not self.dropped[element]:
            self.pieces.append((element, self.block, text))

    def _cut(self, stack: list[int], k: int) -> None:
        for e in stack[k:]:
            self.open[self.tag[e]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                return self._cut(stack, k)
            if name not in BLOCK and self.tag[stack[k]] in BLOCK:
                return  # an end tag of a phrase does not close the block around it

    def _close_open(self, stack: list[int], names: frozenset) -> None:
        if not any(self.open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                return self._cut(stack, k)
            if self.tag[stack[k]] in SCOPE or self.tag[stack[k]] in BLOCK and self.tag[stack[k]] != "p":
                return

    def _drop_suspects(self) -> None:
        n = len(self.tag)
        mass, titled, article = [0] * n, [False] * n, [False] * n
        for element, _, text in self.pieces:
            mass[element] += len(text.strip())
        for k in range(n - 1, 0, -1):
            titled[k] |= self.tag[k] in ("h1", "main") and not self.marks[k]
            article[k] |= self.tag[k] == "article" and not self.marks[k]
            up = self.parent[k]
            mass[up] += mass[k]
            titled[up] |= titled[k]
            article[up] |= article[k]
        page = lambda k: 2 * mass[k] >= mass[0] and (self.tag[k] == "form" or titled[k] or article[k] and self.marks[k] != COMMENT)
        suspect = [bool(self.marks[k]) and not page(k) for k in range(n)]
        # the suspect around each element (itself, if it is one), and the text of each that lies in no other inside
        around, own, inside = [0] * n, [0] * n, {}
        for k in range(1, n):
            around[k] = k if suspect[k] else around[self.parent[k]]
            if suspect[k] and mass[k]:
                inside.setdefault(around[self.parent[k]], []).append((-mass[k], k))
        for element, _, text in self.pieces:
            own[around[element]] += len(text.strip())
        spared, waiting, at = {0}, [], 0
        while not own[at]:
            for x in inside.get(at, ()):
                heapq.heappush(waiting, x)
            if not waiting:
                break
            at = heapq.heappop(waiting)[1]
            spared.add(at)
        for k in range(1, n):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]] or suspect[k] and k not in spared
        self.pieces = [x for x in self.pieces if not self.dropped[x[0]]]


def _squeeze(parts: list[str]) -> str:
    return " ".join(references.unescape("".join(parts)).split())


def main_text(source: str | None) -> str:
    """The blocks of the best container and of the siblings that go with it, joined by two newlines.

    Each block of at least 25 characters gives 1 point, 1 for each comma and 1 for each 100
    characters (at most 3) to the element around it, half to the next and a sixth and a ninth to those
    above. Points are discounted by the share of text that lies in links. The best container, or the
    article or main element around it, is kept with siblings that have a fifth of its points, or
    that are paragraphs of some length with few links. Where no block has points, the article, the
    main element or else the body is kept.
    """
    if not source:
        return ""
    page = _Page(source)
    tag, parent = page.tag, page.parent
    n = len(tag)
    blocks: dict[int, list] = {}  # block: element, parts, characters, characters in links
    for element, block, text in page.pieces:
        b = blocks.setdefault(block, [element, [], 0])
        b[1].append(text)
        if page.linked[element]:
            b[2] += len(text.strip())
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for b in blocks.values():
        text = b[1] = _squeeze(b[1])
        element = page.holder[b[0]]
        chars[element] += len(text)
        links[element] += min(b[2], len(text))
        if len(text) < 25 or tag[element] in HEADING:
            continue
        gain = 1.0 + text.count(",") + min(len(text) // 100, 3)
        up = parent[element] if tag[element] in PARAGRAPH else element
        for share in (1.0, 0.5, 1 / 6, 1 / 9):
            points[up] += gain * share
            if not up:
                break
            up = parent[up]
    for k in range(n - 1, 0, -1):
        chars[parent[k]] += chars[k]
        links[parent[k]] += links[k]
    score = [p * (1 - links[k] / max(chars[k], 1)) for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        best = next((k for name in ("article", "main", "body") for k in range(n) if tag[k] == name and not page.dropped[k]), 0)
    k = best
    while k:
        if tag[k] in ("article", "main"):
            best = k
            break
        k = parent[k]
    keep = [False] * n
    keep[best] = True
    if best and tag[best] not in ("article", "main", "body", "html"):
        bar = max(10.0, 0.2 * score[best])
        for k in range(1, n):
            if parent[k] == parent[best] and not page.dropped[k] and k != best:
                thin = links[k] / max(chars[k], 1)
                keep[k] = score[k] >= bar or tag[k] in HEADING or tag[k] in PARAGRAPH and (chars[k] > 80 and thin < 0.25 or 0 < chars[k] and thin == 0)
    for k in range(1, n):
        keep[k] = keep[k] or keep[parent[k]]
    # text that stands bare between kept and dropped elements belongs to its own element only
    out: dict[int, list[str]] = {}
    for element, block, text in page.pieces:
        if keep[element]:
            out.setdefault(block, []).append(text)
    return "\n\n".join(t for t in map(_squeeze, out.values()) if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep, text and n_chars (code points), one row per row.

    A null or empty page has an empty text; broken markup is read as far as it goes, in time that grows
    with the length of the page, however long; of containers with equal scores the first in page order
    is kept; null ids and repeated rows keep their rows; other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [main_text(x.as_py()) for x in rows.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])
        give_back()

    return pages.select(*keep, pages[html_col].alias("_html")).mapInArrow(each, schema)
