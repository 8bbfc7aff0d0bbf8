"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page's markup is read once into flat blocks of text; each block knows its
word count and link density (share of words inside links), those of the block
before and after, whether it is a heading or ends like a sentence, and whether
it stands in an article, in a boilerplate element or in one whose class, id,
role or label names boilerplate by known words.  A decision tree over these numbers, grown on the
labelled pages of ``LABELLED`` (``label_table`` has them block by block), keeps
or drops each block.  The work is row-local: no shuffle, one page at a time.

Character references are decoded, white space inside a block becomes one
space, kept blocks are joined in page order by one space.

Edge cases: null, empty and text-free html give the empty text; unclosed or
stray tags close with their container; an unclosed script, style, textarea or
comment runs to the end of the page; an open head ends at the first body
element or text; self-closed svg and math are empty; the text of math belongs
to its block, annotations apart; very long pages, also of broken markup, are
read whole in time linear in their length; repeated rows
are treated alike; an empty table gives an empty result; other columns come
back untouched.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm.common import table, whole_row

# Elements by their part in a page.
SILENT = set(("head script style noscript template svg iframe object canvas audio video select option textarea "
              "button title").split())
#: Of these, the ones whose text is no markup: to their end tag or the end of the page; only if they have an end tag.
RAW, RAW_CLOSED = ("script", "style", "textarea"), ("title", "iframe")
#: Elements that can be self-closed, with all inside them; what an open head can hold; what the next of its kind ends.
FOREIGN = ("svg", "math")
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
SINGLE = ("button", "option")
#: Inside math, the elements that repeat a formula in another notation.
ANNOTATIONS = ("annotation", "annotation-xml")
BLOCKS = set(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
              "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
              "table tbody td tfoot th thead tr ul").split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav aside footer form menu dialog fieldset".split())
#: Words of classes, ids, roles and labels. Each of these names boilerplate wherever it stands ...
HINTS = set(("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
             "cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice "
             "pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup "
             "social sponsor sponsored subscribe subscription tags toolbar widget widgets").split())
#: ... these outside articles, and only among known words: an article can have a header or a discussion of its own ...
LOOSE_HINTS = set("dialog discussion form header login reply search teaser".split())
#: ... and these name what readers wrote, where an article is one of their texts.
TALK = set("comment comments discussion disqus replies reply respond".split())
#: Words that go with hints, and words that turn a name into a statement about the page.
PLAIN = set(("area bar block body bottom box button card col column container content entry fixed global group inner item left "
             "link links list main meta outer page panel post posts right row section site story text thread title top user "
             "wrap wrapper").split())
ABOUT = set("allowed closed disabled enabled has hidden hide is no not open show with without".split())

#: Elements that a start tag ends, if the lists and tables named after them were not opened since.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
        **dict.fromkeys(("td", "th"), (("td", "th"), ("table",))), "tr": (("td", "th", "tr"), ("table",))}

#: A tag without quotes, and the places that matter in one with quotes.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_END = {n: re.compile(rf"(</{n}(?=[\s/>])[^>]*>)", re.I) for n in RAW}
_END_INSIDE = {n: re.compile(rf"(</{n}(?=[\s/>])[^>]*>)|</(?:{'|'.join(FOREIGN)})(?=[\s/>])", re.I) for n in RAW}
_END_CLOSED = {n: re.compile(rf"(</{n}(?=[\s/>])[^>]*>)|<(?:/head|body|{n})(?=[\s/>])", re.I) for n in RAW_CLOSED}
_NAMED = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    __slots__ = ("begin", "heading", "links", "state", "text", "words")

    def __init__(self, begin: int, text: str, words: int, links: int, state: tuple, heading: bool):
        self.begin, self.text, self.words, self.links, self.state, self.heading = begin, text, words, links, state, heading


class Tags:
    """The tags of a page, found forwards: no character is read again for each ``<`` before it.

    A tag ends at the first ``>`` outside quotes; where its quotes do not pair
    up, at the first ``>``.  An opening quote that led to no end is remembered,
    since from there every later attempt would go the same way.
    """

    def __init__(self, page: str):
        self.page, self.last, self.dead = page, page.rfind(">"), set()

    def _end(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``; there is a ``>`` after it."""
        page, path, k = self.page, [], at
        while m := _SPECIAL.search(page, k):
            k = m.start()
            if page[k] == ">":
                return k + 1
            if k in self.dead:
                break
            path.append(k)
            close = page.find(page[k], k + 1)
            if close < 0:
                break
            k = close + 1
        self.dead.update(path)
        return page.index(">", at) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name and attributes of the next tag; comments and declarations have no name."""
        page = self.page
        while (lo := page.find("<", at)) >= 0:
            if page.startswith("<!--", lo):
                end = page.find("-->", lo + 4)
                return lo, len(page) if end < 0 else end + 3, "", "", ""
            if lo < self.last:
                if m := _PLAIN_TAG.match(page, lo):
                    return lo, m.end(), m[1], m[2], m[3]
                if m := _NAME.match(page, lo + 1):
                    hi = self._end(m.end())
                    return lo, hi, m[1], m[2], page[m.end():hi - 1]
                if page[lo + 1:lo + 2] in ("!", "?"):
                    return lo, page.index(">", lo) + 1, "", "", ""
            elif page.find("<", lo + 1) < 0 and _NAME.match(page, lo + 1):
                return lo, len(page), "", "", ""  # broken off within its last tag
            at = lo + 1
        return None


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[bool, bool, bool]:
    """Whether names hint at boilerplate anywhere, at least outside articles, and at readers' texts."""
    hint = loose = talk = False
    for m in _NAMED.finditer(attributes):
        value = "".join(filter(None, m.groups()[1:]))
        for token in [value] if m[1].lower() == "aria-label" else value.split():
            parts = {p.lower() for p in _PARTS.findall(token)}
            if parts & ABOUT:
                continue
            known = parts <= HINTS | LOOSE_HINTS | PLAIN
            found = bool(parts & HINTS) and (known or m[1].lower() != "aria-label")
            hint |= found
            loose |= found or known and bool(parts & LOOSE_HINTS) and not parts & {"entry", "post", "story", "body", "content", "main", "text"}
            talk |= known and bool(parts & TALK)
    return hint, loose, talk


def _silent_spans(page: str, unclosed: set[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Where comments and silent elements stand, and the begins of the silent ones that have no end tag.

    Those given as ``unclosed`` also end where their container's end is implied.
    """
    spans: list[tuple[int, int]] = []
    open_ended: set[int] = set()
    stack: list[tuple[str, int]] = []
    #: Places in the stack: of each name, of blocks, of silent elements.
    places: dict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    silent_at: list[int] = []
    tags, at = Tags(page), 0
    #: Raw elements without an end tag from here on.
    endless: set[tuple[str, bool]] = set()

    def end(k: int, lo: int, hi: int, own: bool) -> None:
        """Closes what the stack holds from ``k`` on, the first by its ``own`` end tag (from ``lo`` to ``hi``) or not."""
        own = own and (stack[k][0] in SILENT or stack[k][0] in ANNOTATIONS)
        if silent_at and silent_at[0] >= k:
            spans.append((stack[silent_at[0]][1], hi if own else lo))
        open_ended.update(stack[i][1] for i in silent_at[bisect_left(silent_at, k + own):])
        for held in (block_at, silent_at):
            while held and held[-1] >= k:
                held.pop()
        for name, _ in stack[k:]:
            places[name].pop()
        del stack[k:]

    def loose(k: int) -> bool:
        """Whether all silent elements above ``k`` are known to have no end tag."""
        return all(stack[i][1] in unclosed for i in silent_at[bisect_right(silent_at, k):])

    while tag := tags.next(at):
        text = at
        lo, at, slash, name, attributes = tag
        if stack and stack[-1][0] == "head" and not page[text:lo].isspace() and lo > text:
            end(len(stack) - 1, text, text, False)
        if not name:
            if page.startswith("<!--", lo):
                spans.append((lo, at))
            continue
        name = name.lower()
        if slash:
            # An end tag of an inline element leaves blocks open.
            if places[name] and (name in BLOCKS or name in SILENT or not block_at or block_at[-1] <= places[name][-1]):
                end(places[name][-1], lo, at, True)
            continue
        inside = any(places[n] for n in FOREIGN)
        silent = name in SILENT or name in ANNOTATIONS and bool(places["math"])
        empty = attributes.endswith("/")
        if places["head"]:
            k = places["head"][-1]
            if name == "body" or name not in IN_HEAD and len(stack) - 1 - k == len(silent_at) - bisect_right(silent_at, k) and loose(k):
                end(k, lo, lo, False)
        if empty and (inside or name in FOREIGN):
            continue
        if name in RAW or name in RAW_CLOSED:
            found = None
            if (name, inside) not in endless:
                found = (_END_CLOSED if name in RAW_CLOSED else _END_INSIDE if inside else _END)[name].search(page, at)
                if not found:
                    endless.add((name, inside))
            if found and found[1] or name in RAW and not inside:
                at = found.end() if found else len(page)
                spans.append((lo, at))
                continue
        if name in SINGLE and places[name]:
            end(places[name][-1], lo, lo, False)
        if unclosed:
            if name in BLOCKS and places["p"] and block_at[-1] == places["p"][-1] and loose(block_at[-1]):
                end(block_at[-1], lo, lo, False)
            ended, within = ENDS.get(name, ((), ()))
            for k in sorted(places[n][-1] for n in ended if places[n]):
                if k < len(stack) and loose(k) and all(not places[n] or places[n][-1] < k for n in within):
                    end(k, lo, lo, False)
        if name not in VOID and (not empty or silent):
            for held, holds in ((block_at, name in BLOCKS), (silent_at, silent)):
                if holds:
                    held.append(len(stack))
            places[name].append(len(stack))
            stack.append((name, lo))
    if stack:
        end(0, len(page), len(page), False)
    return spans, open_ended


def _without_silent(page: str) -> str:
    """The page with comments and silent elements blanked: offsets stay, \\0 is no text."""
    spans, unclosed = _silent_spans(page, set())
    if unclosed:
        spans, _ = _silent_spans(page, unclosed)
    out, at = [], 0
    for lo, hi in sorted(spans):
        if hi > at:
            out += [page[at:lo], "\0" * (hi - max(lo, at))]
            at = hi
    return "".join(out) + page[at:]


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    page = page.replace("\0", " ")
    if "<" in page:
        page = _without_silent(page)
    out: list[Block] = []
    #: (element, (in article, in furniture, hinted, among readers' texts)) of the open containers, and how many of each
    stack: list[tuple[str, tuple]] = [("", (0, 0, 0, 0))]
    opened: dict[str, int] = defaultdict(int)
    parts: list[tuple[str, bool]] = []
    begin, links, heading, at = 0, 0, False, 0

    def close() -> None:
        nonlocal parts
        if parts:
            text = "".join(t for t, _ in parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                linked = sum(len(t.split()) for t, in_link in parts if in_link)
                out.append(Block(begin, text, text.count(" ") + 1, linked, stack[-1][1][:3], heading))
            parts = []

    def add(lo: int, hi: int) -> None:
        nonlocal begin
        text = page[lo:hi]
        if "\0" in text:
            text = text.replace("\0", "")
        if text and (parts or not text.isspace()):
            if not parts:
                begin = lo
            parts.append((text, links > 0))

    def push(name: str, state: tuple) -> None:
        stack.append((name, state))
        opened[name] += 1

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    tags = Tags(page)
    while tag := tags.next(at):
        if tag[0] > at:
            add(at, tag[0])
        _, at, slash, name, attributes = tag
        name = name.lower()
        if name == "a":
            links = 0 if slash else 1
        elif name == "br":
            if parts:
                parts.append((" ", False))
        elif name in BLOCKS:
            close()
            links = 0
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit() and not slash
            if slash:
                if opened[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif name == "p":
                while stack[-1][0] == "p":
                    pop()
                if attributes and _hints(attributes)[0]:
                    # A hinted paragraph holds until the next block.
                    art, furniture, _, talk = stack[-1][1]
                    push("p", (art, furniture, 1, talk))
            elif name not in VOID:
                art, furniture, hint, talk = stack[-1][1]
                named, loose, talks = _hints(attributes) if attributes and name not in ("html", "body") else (False,) * 3
                if name in ("article", "main"):
                    # An article among readers' texts is one of them.
                    talk = int(talk or name == "article" and talks)
                    hint, art = talk, int(not talk or art)
                else:
                    if name in FURNITURE or (name == "header" and not art):
                        furniture = 1
                    if named or loose and not art:
                        hint, talk = 1, int(talk or talks)
                if not attributes.endswith("/"):
                    push(name, (art, furniture, hint, talk))
    if at < len(page):
        add(at, len(page))
    close()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after",
            "in an article", "in furniture", "hinted", "heading", "ends a sentence", "an article elsewhere")


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in found], float)
    density = np.array([b.links for b in found]) / words
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    x[:, 6:9] = [b.state for b in found]
    x[:, 9] = [b.heading for b in found]
    x[:, 10] = [b.text.rstrip("\"')»”’")[-1:] in tuple(".!?…:;") for b in found]
    x[:, 11] = x[:, 6].any() - x[:, 6]
    return x


class Tree:
    """A binary decision tree by Gini impurity; ``nodes`` has (feature, limit, left, right, label) rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(2 * y.sum() > len(y))))
        split = None
        if depth and 0 < y.sum() < len(y):
            split = min((c for f in range(x.shape[1]) for c in self._cuts(x[:, f], y, f, least)), default=None)
        if split:
            _, f, limit = split
            low = x[:, f] <= limit
            left, right = self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[at] = (f, limit, left, right, -1)
        return at

    @staticmethod
    def _cuts(v: np.ndarray, y: np.ndarray, f: int, least: int):
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ones, n = np.cumsum(y), len(y)
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if least <= i <= n - least:
                a, b = ones[i - 1], ones[-1] - ones[i - 1]
                impurity = a * (i - a) / i + b * (n - i - b) / (n - i)
                yield round(float(impurity), 9), f, float((v[i] + v[i - 1]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, limit, left, right, label = self.nodes[at]
            if f < 0:
                out[rows] = label
            elif len(rows):
                low = x[rows, f] <= limit
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


_SHORT = "The bridge was closed."
_LONG = ("The council met on Tuesday to hear the engineers, who said that the old bridge could carry light traffic for "
         "another decade if the two eastern arches were repaired before the winter floods arrived in the valley. ")
_MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul>'

#: Labelled pages: (markup, label of the blocks that begin in it); 1 is main text.
LABELLED: list[list[tuple[str, int]]] = [
    [("<body><nav>" + _MENU + "</nav><div class='ad'>Buy two lamps and get a third one free today.</div><article>", 0),
     (f"<h1>Bridge to reopen</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG * 2}</p><p>Works begin soon</p></article>", 1),
     ("<footer>&copy; 2020 The Valley Post. All rights reserved by its owners.</footer>", 0)],
    [("<body><header><h1>The Valley Post</h1><p>News from the valley since 1901.</p>" + _MENU + "</header><main>", 0),
     (f"<h2>Floods</h2><p>{_LONG * 3}</p><ul><li>Bring boots.</li><li>Water</li></ul><p><a href='/x'>Read the report.</a> "
      f"{_LONG}</p><blockquote>We saw it coming</blockquote><p>Yes.</p>", 1),
     ("<aside><h3>Most read</h3><ul><li><a href='/1'>Ten walks for a dry autumn day</a></li></ul><p>" + _LONG + "</p></aside>"
      "<section class='comments'><h3>Comments</h3><p>" + _LONG + "</p><p>I agree.</p></section></main>"
      "<footer><p>Imprint</p><p>" + _LONG + "</p></footer>", 0)],
    [("<body><div id='menu'>" + _MENU + "</div><div class='cookie-notice'><p>We use cookies to make this site work. " + _LONG
      + "</p></div>", 0),
     (f"<div class='content'><h1>A long walk</h1><p>{_LONG}</p><p>{_LONG * 2}</p><p>{_SHORT}</p><p>{_LONG}</p></div>", 1),
     ("<div class='related'><a href='/r'>Five more walks in the hills</a></div><form><p>Your name</p><label>Mail</label>"
      "<p>" + _LONG + "</p></form><div class='sidebar'><p>" + _LONG + "</p></div><div id='footer'><p>Contact us.</p></div>", 0)],
    [("<body><table><tr><td><a href='/'>Home</a></td><td><a href='/n'>All the news</a></td></tr></table>", 0),
     (f"<p>{_LONG * 2}</p><p>{_LONG}</p><h2>Later that day</h2><p>{_LONG}</p>", 1),
     ("<p><a href='/p'>Previous</a> | <a href='/n'>Next</a></p><p>Page 1 of 4</p>", 0)],
    [("<body><article><header>", 0), (f"<h1>Who pays</h1></header><p>{_LONG}</p><ol><li>Towns</li><li>Farms</li></ol>"
                                      f"<table><tr><td>1901</td><td>Twelve</td></tr></table><p>{_LONG}</p>", 1),
     ("<div class='share'><a href='/s'>Share</a> this page</div><aside><p>" + _LONG + "</p></aside><nav><a href='/t'>Top</a>"
      "</nav><div class='newsletter'><p>Sign up for our letter. " + _LONG + "</p></div>", 0),
     (f"<p>{_SHORT}</p><p>The end</p><pre>x = 1</pre><p><a href='/q'>Sources and further reading</a></p>", 1),
     ("<div class='comments'><p>First!</p><p>" + _LONG + "</p></div></article><div><p>Other pages of this site</p></div>"
      "<p>" + _SHORT + "</p><div>" + _LONG + "</div>", 0)],
    [("<body><div class='banner'>Sale ends tonight.</div><p>Skip to content</p><section><article>", 0),
     ("<p>Rain</p><p>Sun.</p><div>Wind from the west, then calm.</div><div><div>" + _LONG + "</div></div></article>", 1),
     ("</section><form class='search'><p>Search</p></form><div>Valley Post Media Group</div>", 0)],
    # Pages that break off, and articles with nothing after them.
    [("<body><nav>" + _MENU + "</nav><article>", 0), (f"<h1>Broken off</h1><p>{_LONG}<p>{_SHORT}<p>{_LONG} And then it", 1)],
    [("<body><article>", 0), (f"<p>{_SHORT}</p><p>{_LONG}</p><p>No end</p>", 1)],
    [("<body>", 0), (f"<h1>Alone</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p>", 1)],
    [("<body>", 0), (f"<p>{_LONG}", 1)],
    [("<body>", 0), (f"<p>{_SHORT}", 1)],
    [("<body><article>", 0), (f"<p>{_SHORT}", 1)],
    [("<body><article>", 0), ("<p>Word", 1)],
    [("<body>", 0), (f"<h1>Mixed</h1><p>See <a href='/1'>the whole report</a> today.</p><p>{_LONG}</p><p>By <a href='/2'>Ann Lee</a></p>"
                     f"<p>{_SHORT}</p><p>{_LONG}</p>", 1)],
    [("<body><article>", 0), (f"<p>{_LONG}</p><a href='/1'>Map</a><p>{_SHORT}</p><p>{_LONG}</p><p><a href='/2'>All about it</a></p><p>Yes.</p>", 1)],
    # Names that an article's own parts have, and articles that readers wrote.
    [("<body><div class='site-header'><p>The Valley Post</p></div><article>", 0),
     (f"<div class='entry-header'><h1>What was found</h1></div><p class='teaser'>{_SHORT}</p><section id='discussion'><h2>Discussion</h2>"
      f"<p>{_LONG}</p><p>{_SHORT}</p></section>", 1),
     ("</article><section id='comments'><h2>Two comments</h2><article class='comment-body'><p>" + _LONG + "</p></article>"
      "<article><p>" + _SHORT + "</p></article></section><div id='respond'><p>" + _LONG + "</p></div>", 0)],
    # Links: lists of them are furniture wherever they stand, unless an article holds them.
    [("<body><div><a href='/1'>Ten walks for a dry autumn day in the hills</a></div><div><a href='/2'>Why the bridge was "
      "closed for such a long time</a></div><p><a href='/3'>What to do now</a></p>", 0), (f"<p>{_LONG * 2}</p><p>{_SHORT}</p>", 1),
     ("<div><a href='/4'>Floods: what the engineers said about them last week</a></div><div><a href='/5'>All stories</a></div>", 0)],
    [("<body><article>", 0), (f"<p>{_LONG}</p><ul><li><a href='/1'>The report of the engineers</a></li><li><a href='/2'>Map</a></li>"
                              f"</ul><p><a href='/3'>What the council said in the spring of that year</a></p>", 1),
     ("</article><p><a href='/4'>What to read after this story</a></p><p>Printed on Tuesday.</p>", 0)],
]


def label_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    rows, labels = [], []
    for pieces in LABELLED:
        found = blocks("".join(p for p, _ in pieces))
        ends = np.cumsum([len(p) for p, _ in pieces])
        rows.append(features(found))
        labels += [pieces[int(np.searchsorted(ends, b.begin, "right"))][1] for b in found]
    return np.vstack(rows), np.array(labels)


def grown() -> Tree:
    return Tree(*label_table())


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    found = blocks(page or "")
    keep = tree.predict(features(found)) if found else []
    kept = [b.text for b, k in zip(found, keep, strict=True) if k]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", n_col: str = "n_chars",
            keep_html: bool = False) -> DataFrame:
    """``pages`` with the main text and its length (replacing columns of those names); html goes unless ``keep_html``."""
    tree = grown()
    rest = pages.drop(text_col, n_col, *([] if keep_html else [html_col]))
    row = whole_row(rest) if rest.columns else F.struct(F.lit(1).alias("_"))
    rows = pages.select(row.alias("_row"), F.col(f"`{html_col}`").alias("_html"))

    def texts(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                got = [main_text(p, tree) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()),
                     pa.array([len(g[0]) for g in got], pa.int64())], names=["_row", "_text", "_n"])

    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_n", T.LongType())])
    return rows.mapInArrow(texts, schema).select(
        *[F.col("_row").getField(c).alias(c) for c in rest.columns], F.col("_text").alias(text_col), F.col("_n").alias(n_col))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
