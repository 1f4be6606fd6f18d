"""The main text of web pages, by the distribution of text over line blocks.

Markup is stripped into lines, one a block of text, with a blank line wherever a
container begins or ends.  The text lengths of WINDOW lines on end are summed.
Where the sum surges the main text starts, where it dives to nothing it ends;
what lies between is kept, short lines included.  Lines of links and lines of a
part that says what it is (menu, header, footer, sidebar, notice, advert, form,
comments) have no length and are not kept; where an article is marked, lines
outside of it have none either.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store

WINDOW = 3
#: A sum surges when it reaches this many characters, or this part of the page's largest if that is less.
SURGE, SURGE_PART = 80, 0.25
#: Main text is from the first to the last stretch that has this part of the largest stretch's text.
STRETCH_PART = 0.25
#: An article counts as marked when its lines have this part of the page's text.
MARKED_PART = 0.25

# Names of elements, and words in class, id and role.
HIDDEN = "script style noscript template svg math iframe object canvas audio video textarea select button title".split()
LINES = "p li dt dd h1 h2 h3 h4 h5 h6 tr th caption figcaption summary legend address option pre br hr".split()
CONTAINERS = "html head body div section article main header footer nav aside form fieldset ul ol dl table thead tbody tfoot td blockquote figure details dialog menu center search hgroup".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
APART = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "dialog": "notice", "form": "form", "header": "header"}
NAMED = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip tabs tablist",
    "header": "header masthead topbar",
    "footer": "footer copyright colophon contentinfo",
    "sidebar": "sidebar aside complementary widget widgets related recommended recommendations teaser teasers trending tagcloud",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay alert dialog disclaimer banner paywall toast",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion",
    "form": "newsletter subscribe subscription signup login signin search form share sharing social",
    "comments": "comment comments commentlist disqus respond reply replies discussion reviews",
}
KIND_OF = {word: kind for kind, words in NAMED.items() for word in words.split()}
#: A class that has one of these words tells of something else than its element.
ABOUT_OTHERS = {"with", "without", "has", "no", "not"}
COMMENT_HEADING = re.compile(r"(\d+ )?(reader )?(comments?|responses?|replies|leave a (comment|reply)|kommentare?|commentaires?|comentarios?)( \(\d+\))?:?", re.I)

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(\s[^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*)*)?>")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN, _LINES, _CONTAINERS = map(frozenset, (HIDDEN, LINES, CONTAINERS))


def tags(page: str):
    """(text before, name, is end tag, attributes) of every tag, in one pass; the last has the name None.

    Comments, declarations and the insides of hidden elements are left out.
    """
    at, lower, size, missing = 0, None, len(page), set()
    held: list[str] = []
    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield "".join([*held, page[at:]]), None, False, ""
            return
        if lt > at:
            held.append(page[at:lt])
        m = _PLAIN.match(page, lt)
        if m and m[2].lower() not in _HIDDEN:
            at = m.end()
            yield "".join(held), m[2].lower(), bool(m[1]), m[3] or ""
            held.clear()
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                held.append("<")
                at = lt + 1
            continue
        stop = m.end()
        while (s := _STOP.search(page, stop)) and s[0] != ">":
            end = -1 if s[0] in missing else page.find(s[0], s.end())
            if end < 0:
                missing.add(s[0])
            stop = end + 1 if end >= 0 else s.end()
        if not s:
            yield "".join(held), None, False, ""
            return
        name, at = m[0].lower(), s.end()
        if name in _HIDDEN and not closing:
            if page[s.start() - 1] != "/" or name not in ("svg", "math", "iframe", "object", "canvas"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == size else re.sub("[A-Z]", lambda c: c[0].lower(), page)
                end = -1 if name in missing else lower.find(f"</{name}", at)
                if end < 0:
                    missing.add(name)
                    at = size if name in ("script", "style", "textarea", "title") else at
                else:
                    end = page.find(">", end)
                    at = size if end < 0 else end + 1
            continue
        yield "".join(held), name, closing, page[m.end() : s.start()]
        held.clear()


def kind_of(name: str, attributes: str) -> str | None:
    """What part of a page an element says it is."""
    kind = APART.get(name)
    for m in _ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true" and kind) or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden"
        if key in ("class", "id", "role"):
            if key == "role" and value == "main":
                return "main"
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if not ABOUT_OTHERS.intersection(words):
                    kind = next((KIND_OF[w] for w in words if w in KIND_OF), kind)
        elif key == "itemprop" and value.lower() == "articlebody":
            return "main"
    return kind or ("main" if name in ("article", "main") else None)


class Lines:
    """The lines of a page as (text, mostly links, heading level, innermost part, in an article); the parts' kinds and the parts around them.

    Part 0 is the page.
    """

    def __init__(self, page: str) -> None:
        self.rows: list[tuple[str, bool, int, int, bool]] = []
        self.kinds, self.around = ["page"], [0]
        self.wraps = [True]  # whether an article, a main element or an h1 lies in the part
        self.words: list[str] = []
        self.in_link, self.linked, self.heading = False, 0, 0
        self.open: list[tuple[str, int, bool]] = []  # name, innermost part, in an article
        self.names: Counter[str] = Counter()
        for text, name, closing, attributes in tags(page):
            if text:
                self.words.append(text)
                if self.in_link:
                    self.linked += len("".join(html.unescape(text).split()))
            if name == "a":
                self.in_link = not closing
            elif name is None or name in _LINES or name in _CONTAINERS:
                self.flush()
                if name and closing:
                    self.close(name)
                elif name:
                    self.begin(name, attributes)

    def flush(self) -> None:
        """End the line."""
        text = " ".join(html.unescape("".join(self.words)).split()) if self.words else ""
        if text:
            if self.heading and self.rows and COMMENT_HEADING.fullmatch(text):
                self.push("#comments", "comments")
            self.rows.append((text, 2 * self.linked > len(text.replace(" ", "")), self.heading, self.here(), self.inside()))
        self.words.clear()
        self.in_link, self.linked = False, 0

    def inside(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def push(self, name: str, kind: str | None = None, inside: bool = False) -> None:
        part = self.here()
        if kind:
            self.kinds.append(kind)
            self.around.append(part)
            self.wraps.append(False)
            part = len(self.kinds) - 1
        self.open.append((name, part, inside or self.inside()))
        self.names[name] += 1

    def pop(self) -> str:
        name = self.open.pop()[0]
        self.names[name] -= 1
        return name

    def wrap(self) -> None:
        part = self.here()
        while not self.wraps[part]:
            self.wraps[part] = True
            part = self.around[part]

    def blank(self) -> None:
        self.rows += [("", False, 0, 0, False)] * (WINDOW - 1)

    def begin(self, name: str, attributes: str) -> None:
        while self.open and self.open[-1][0] in _LINES and (self.open[-1][0] in ("p", *HEADINGS) or self.open[-1][0] == name):
            self.pop()  # its end tag is implied
        kind = kind_of(name, attributes) if name not in ("html", "head", "body", "br", "hr") else None
        self.heading = HEADINGS.index(name) + 1 if name in HEADINGS else 0
        if name in ("h1", "article", "main") or kind == "main":
            self.wrap()
        if name in _CONTAINERS:
            self.blank()
            if kind == "main":
                self.push(name, inside=True)
            else:
                self.push(name, "title" if kind == "header" and self.inside() else kind)
                if name in ("article", "main"):
                    self.wrap()
        elif kind not in (None, "main"):
            self.push(name, kind)

    def close(self, name: str) -> None:
        self.heading = 0
        if self.names[name]:
            while self.pop() != name:
                pass
        if name in _CONTAINERS:
            self.blank()


def stretches(lengths: list[int], surge: float) -> list[tuple[int, int]]:
    """Ranges of lines from where the sum of WINDOW lengths surges to where it dives to nothing."""
    sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
    found, at = [], 0
    while at < len(sums):
        if sums[at] < surge or not lengths[at]:
            at += 1
            continue
        end = at + 1
        while end < len(sums) and sums[end]:
            end += 1
        found.append((at, end))
        at = end
    return found


def main_text(page: str | None) -> str:
    """The main text of one page; empty for a null page and for one without any."""
    lines = Lines(page or "")
    rows, kinds = lines.rows, lines.kinds
    size = [0] * len(kinds)
    for row in rows:
        size[row[3]] += len(row[0])
    for p in range(len(kinds) - 1, 0, -1):
        size[lines.around[p]] += size[p]
    # A form, header or other part that holds most of the page, an article or its heading too, only wraps it.
    apart, titled = [False] * len(kinds), [False] * len(kinds)
    for p in range(1, len(kinds)):
        own = kinds[p] != "title" and not (lines.wraps[p] and kinds[p] not in ("comments", "hidden") and 2 * size[p] > size[0])
        apart[p], titled[p] = own or apart[lines.around[p]], kinds[p] == "title" or titled[lines.around[p]]
    free = [bool(r[0]) and not apart[r[3]] and (r[2] > 0 or not titled[r[3]]) for r in rows]
    marked = sum(len(r[0]) for r, f in zip(rows, free) if f and r[4])
    if marked and marked >= MARKED_PART * sum(len(r[0]) for r, f in zip(rows, free) if f and not r[1]):
        free = [f and r[4] for r, f in zip(rows, free)]
        lengths, surge, least = [len(r[0]) if f else 0 for r, f in zip(rows, free)], 1, 0
    else:
        lengths = [len(r[0]) if f and not r[1] else 0 for r, f in zip(rows, free)]
        sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
        surge, least = max(1, min(SURGE, SURGE_PART * max(sums, default=0))), STRETCH_PART
    found = stretches(lengths, surge)
    sizes = [sum(lengths[a:b]) for a, b in found]
    strong = [s for s, n in zip(found, sizes) if n >= least * max(sizes)]
    if not strong:
        return ""
    begin, end = strong[0][0], strong[-1][1]
    keep = [begin <= k < end and n > 0 for k, n in enumerate(lengths)]
    for a, b in found:
        if begin <= a < end:
            keep[a:b] = free[a:b]
    title = next((k for k in range(begin - 1, -1, -1) if free[k] and 0 < rows[k][2] < 3), None)
    if title is not None:
        keep[title] = True
    return " ".join(r[0] for r, k in zip(rows, keep) if k)


def extract(html_column: Column | str = "html") -> Column:
    """The main text of a column of pages.

    A null or empty page, and one of menus and such alone, gives the empty
    string.  Equal pages give equal texts; the time grows with the page's length.
    """

    @F.arrow_udf("string")
    def text(pages):
        import pyarrow as pa

        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return text(F.col(html_column) if isinstance(html_column, str) else html_column)


def add_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars`` (code points); columns of those names are replaced, all others and repeated rows kept."""
    store.small_batches(pages.sparkSession)
    keep = [c for c in store.others(pages, "text", "n_chars") if c != html_column]
    found = pages.select(*keep, extract(html_column).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
