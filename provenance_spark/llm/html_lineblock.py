"""Main text of web pages by line-block distribution.

Markup is stripped: each block-level element's text becomes a line; scripts, menus, footers, dialogs and the like, by
their tag or role, leave a gap of empty lines. A line's weight is its text length, or 0 where links make up most of it. Weights are summed
over windows of ``WINDOW`` lines. The text surges where a window's sum rises from nothing and dives where a window's sum
falls to nothing again; what lies between two dives is kept when some window in it reaches ``SURGE``. If no
window does, the stretch with the largest sum is kept. A stretch below ``SURGE`` that shares its container with a kept
one stays too: it was cut off by something left out in between.

Names are one vote only. An element whose class or id has a whole token such as ``sidebar``, ``site-footer`` or ``cookie-text``, and any form, is suspect;
it goes where the text outside suspects outweighs it, and stays, name or not, where it holds most of the page's weight (``undecided``).
Suspects for readers' comments go wherever the text outside them surges at all.

Marks (``article`` or ``main``) decide close calls only. A stretch ends where a marked element begins or ends, and the
heaviest marked element or unmarked stretch says on which side of the marks the page's article is. On that side, marked
lines weigh ``MARKED`` times their length; on the other, a window must reach ``CLOSE`` times ``SURGE``. Of an ``article`` in which a stretch
is kept, every line stays, links and short ones included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provenance_spark.llm.common import bound_batches

WINDOW = 3
SURGE = 80
MARKED = 2
CLOSE = 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|noembed|noframes|xmp)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^<>]*)>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"([a-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br".split())
#: An open element of the first kind ends where one of its set opens.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
           "th": {"td", "th", "tr"}, "option": {"option"}}
ARTICLE = frozenset({"article", "main"})
CONTAINER = frozenset("div section td center".split()) | ARTICLE
NEVER = frozenset("head nav footer aside button dialog menu audio video canvas map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert newsletter subscribe subscription signup popup modal overlay nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar rail footer header masthead topbar toolbar related recommended recommendations "
    "share sharing social widget widgets pagination pager copyright legal disclaimer login search skip paywall".split())
#: What may stand before or after such a name within one token of a class or id, joined by - or _.
BEFORE = frozenset("site page main top bottom left right primary secondary global blog post user reader".split())
AFTER = frozenset("content text box wrapper wrap container inner bar area section block list links items panel banner thread form body button buttons icons".split())
#: Times by which a suspect must outweigh the rest to stay where a marked element holds text outside it.
OVERWHELM = 8


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    mark: int = 0
    title: bool = False
    container: int = 0
    suspect: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def weight(self) -> int:
        n = len(self.text())
        return n if self.linked <= n / 2 else 0


@dataclass
class Suspect:
    """An element whose name or tag speaks against it: of readers or not, and the suspect around it (0: none)."""

    readers: bool
    around: int


def named(token: str, names: frozenset[str]) -> bool:
    """Whether a token of a class or id is one of ``names``, alone or with the usual words around it."""
    words = re.split(r"[-_]+", token.lower())
    if len(words) > 1 and words[0] in BEFORE:
        words = words[1:]
    return words[0] in names and all(w in AFTER or w in names for w in words[1:])


def aside(tag: str, attrs: str, inside: bool) -> str:
    """What speaks against an element: "never" is out at once, "readers" and "aside" make it suspect, "" is nothing."""
    if tag in NEVER:
        return "never"
    if tag in ("html", "body"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs.strip() else {}
    if "hidden" in found or found.get("role", "").lower() in ROLES:
        return "never"
    if tag in HEADINGS or tag in INLINE:
        return ""
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    if any(named(t, READERS) for t in tokens):
        return "readers"
    if tag in ARTICLE:
        return ""
    if tag == "header":
        return "" if inside else "never"
    return "aside" if tag in FORMS or found.get("role", "").lower() == "form" or any(named(t, ASIDE) for t in tokens) else ""


def undecided(found: list[Line | None], suspects: list[Suspect], surge: int) -> set[int]:
    """The suspects that go. ``suspects`` counts from 1; those around come before those inside.

    The heaviest are heard first, readers' last. One that isn't of readers stays if it outweighs all text accepted so far and has a surge's weight of its
    own; one of readers stays only if neither marked text nor text of that weight was accepted. What stays is accepted, and the suspects in it are heard.
    """
    own, total, marked = [0] * (len(suspects) + 1), [0] * (len(suspects) + 1), [False] * (len(suspects) + 1)
    for line in found:
        if line is not None and line.parts:
            w = line.weight()
            own[line.suspect] += w
            marked[line.suspect] |= bool(line.mark and line.text())
            n = line.suspect
            while n:
                total[n] += w
                n = suspects[n - 1].around
    accepted, mark, gone = own[0], marked[0], set()
    heard = [n for n, x in enumerate(suspects, 1) if not x.around]
    while heard:
        n = min(heard, key=lambda n: (suspects[n - 1].readers, -total[n], n))
        heard.remove(n)
        enough = total[n] >= CLOSE * surge and total[n] > accepted * (OVERWHELM if mark else 1)
        if not mark and accepted < CLOSE * surge if suspects[n - 1].readers else enough:
            accepted += own[n]
            mark |= marked[n]
            heard += [k for k, x in enumerate(suspects, 1) if x.around == n]
        else:
            gone.add(n)
    for n, x in enumerate(suspects, 1):
        if x.around in gone:
            gone.add(n)
    return gone


def lines(page: str, surge: int = SURGE) -> list[Line | None]:
    """The page's lines in order; None stands for a gap that something left out makes."""
    out: list[Line | None] = [Line()]
    stack: list[tuple[str, str]] = []  # open elements and what speaks against them
    suspects: list[Suspect] = []
    doubts = [0]  # numbers of the open suspects
    boxes = [0]  # numbers of the open containers
    marks = [0]  # numbers of the open article and (below zero) main elements
    skipped = inside = links = titles = at = made = 0

    def pop(n: int) -> None:
        nonlocal skipped, inside, links, titles
        for tag, against in stack[n:]:
            skipped -= against == "never"
            if against in ("aside", "readers"):
                doubts.pop()
            inside -= tag in ARTICLE
            links -= tag == "a"
            titles -= tag == "h1"
            if tag in CONTAINER:
                boxes.pop()
            if tag in ARTICLE:
                marks.pop()
        del stack[n:]

    def text(raw: str) -> None:
        if raw and not skipped:
            line = out[-1]
            line.parts.append(html.unescape(raw))
            line.linked += len(line.parts[-1].strip()) * bool(links)
            if not raw.isspace():
                line.mark, line.title = marks[-1], bool(titles)
            line.container, line.suspect = boxes[-1], doubts[-1]

    def cut() -> None:
        if out[-1].parts:
            out.append(Line())

    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            cut()
        if m["end"] or m["end2"]:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if n is not None:
                pop(n)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends = {k for k, v in IMPLIED.items() if tag in v}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.rstrip().endswith("/") and tag not in ("a",):
            continue
        against = aside(tag, attrs, bool(inside))
        if against == "never" and not skipped:
            cut()
            out[-1:] = [None, Line()]
        stack.append((tag, against))
        skipped += against == "never"
        if against in ("aside", "readers"):
            suspects.append(Suspect(against == "readers", doubts[-1]))
            doubts.append(len(suspects))
        inside += tag in ARTICLE
        links += tag == "a"
        titles += tag == "h1"
        if tag in CONTAINER:
            made += 1
            boxes.append(made)
        if tag in ARTICLE:
            marks.append(made if tag == "article" else -made)
    text(page[at:])
    gone = undecided(out, suspects, surge) if suspects else ()
    return [None if line is not None and line.suspect in gone else line for line in out]


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text: lines between surge and dive points, joined by newlines. Empty for a null or empty page."""
    texts: list[str] = []
    weights: list[int] = []
    marks: list[int] = []
    titles: list[bool] = []
    boxes: list[int] = []
    for line in lines(page or "", surge):
        if line is None:
            for x, gap in ((texts, ""), (weights, 0), (marks, 0), (titles, False), (boxes, 0)):
                x.extend([gap] * window)
        elif t := line.text():
            texts.append(t)
            weights.append(line.weight())
            marks.append(line.mark)
            titles.append(line.title)
            boxes.append(line.container)
    if not any(weights):  # nothing but links: what is marked counts
        weights = [len(t) if m else 0 for t, m in zip(texts, marks, strict=True)]
    padded = [*weights, *[0] * window]
    sums = [sum(padded[i:i + window]) for i in range(len(weights))]
    stretches: list[list[int]] = []
    open_ = False
    for i, total in enumerate(sums):
        if total and not open_:
            stretches.append([])
        open_ = bool(total)
        if open_:
            stretches[-1].append(i)
    for s in stretches:  # a window begins before the line that fills it, and ends after
        while not weights[s[0]]:
            s.pop(0)
        while not weights[s[-1]]:
            s.pop()
    # Parts of a stretch, each in one marked element or in none; links at a part's ends go as they do at a stretch's.
    parts = [[i for i in run if i >= first] for s in stretches for _, g in groupby(s, key=lambda i: marks[i])
             for run in [list(g)] for first in [next((i for i in run if weights[i]), len(texts))]]
    parts = [s[:next(n for n in range(len(s), 0, -1) if weights[s[n - 1]])] for s in parts if s]
    mass = [sum(weights[i] for i in s) for s in parts]
    elements: dict[int, int] = {}
    for s, m in zip(parts, mass, strict=True):
        if marks[s[0]]:
            elements[marks[s[0]]] = elements.get(marks[s[0]], 0) + m
    heaviest = max(elements.values(), default=0)
    side = heaviest > 0 and heaviest >= max((m for s, m in zip(parts, mass, strict=True) if not marks[s[0]]), default=0)

    def surges(s: list[int]) -> bool:
        peak = max(sum(weights[i] for i in s[n:n + window]) for n in range(len(s)))
        marked = bool(marks[s[0]])
        return peak * (MARKED if marked and side else 1) >= surge * (CLOSE if elements and marked != side else 1)

    strong = [n for n, s in enumerate(parts) if surges(s)]
    if not strong and parts:
        strong = [max(range(len(parts)), key=lambda n: (bool(marks[parts[n][0]]) == side, mass[n]))]
    home = {boxes[i] for n in strong for i in parts[n] if texts[i]} - {0}
    kept = {n for n, s in enumerate(parts) if n in strong or any(boxes[i] in home for i in s)}
    for n in range(len(parts) - 2, -1, -1):  # a title right before its text
        if n + 1 in kept and parts[n][-1] + 1 == parts[n + 1][0] and all(titles[i] for i in parts[n]):
            kept.add(n)
    articles = {marks[parts[n][0]] for n in strong if marks[parts[n][0]] > 0}
    held = {i for n in kept for i in parts[n]} | {i for i, m in enumerate(marks) if m in articles}
    return "\n".join(texts[i] for i in sorted(held) if texts[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row. A null or empty page, or one without text, gives an empty text.

    Ids and urls pass through as they are, nulls and repeats included; other columns aren't read.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType for c in (id_col, url_col)]
    schema = T.StructType([T.StructField("page_id", kinds[0]), T.StructField("url", kinds[1]),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
