"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between tags that end a line of text.
Each block stands on a root-to-leaf tag path (inline tags are no part of it).
Blocks of one path are one kind of thing, so the path's figures decide about all
of them, a one-word paragraph included:

* text ratio: characters a block;
* punctuation ratio: punctuation marks a block;
* link ratio: the share of characters inside links.

Both ratios and the share outside links are fused to a score; scores are smoothed
over related paths (siblings, parent and children, grandparent); paths
at or above a share of the page's mean score, weighted by characters, are content.
Menus, footers, notices and the like that their tags, roles or class words name are
no candidates.  Paths under the element that holds nearly all content text
(headings, lists, tables between the paragraphs) are content too, unless they are
mostly links.
"""

from __future__ import annotations

import html as H
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

#: Share of the page's mean score that a path needs.
LEAST = 0.3
#: Share of content characters that the content element holds.
HOLDS = 0.8
#: A path with this share of link characters is a list of links.
LINKS = 0.6
#: Characters of a block by which a form is taken for the page's own frame.
FRAME = 200
#: Weight of a related path's score by its distance (steps between the paths).
NEAR = {1: 0.25, 2: 0.125}

# HTML element kinds, and words that name what is not main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp plaintext".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var img br wbr picture source map area".split())
#: Start tags that end an open element, up to the nearest of the elements that bound it.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "thead": ("thead tbody tfoot tr td th", "table"),
        "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
ENDS = {k: (set(a.split()), set(b.split())) for k, (a, b) in ENDS.items()}
#: Start tags that end an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
             "main menu nav ol p pre search section table ul li dt dd".split())
NO_TEXT = RAW | set("head nav aside footer button select template svg math object audio video canvas dialog menu search datalist map".split())
NO_ROLE = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
NO_WORD = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget rail related recommended recommendations "
              "notice cookie cookies consent gdpr banner alert popup modal overlay ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
              "promotion outbrain taboola comment comments commentlist disqus respond reply replies discussion reviews share sharing social newsletter subscribe "
              "subscription signup login search form toolbar pagination pager skip copyright disclaimer".split())
#: Before one of these words, NO_WORD only tells how the element is laid out.
LAYOUT = set("has with no without is show hide enable enabled disable".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|$)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:main|article)\b""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_other(tag: str, attrs: str) -> bool:
    """Whether the element's tag, role, classes or id say that it is no main text."""
    if tag in NO_TEXT:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key = m.group(1).lower()
        if key in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            value = H.unescape(m.group(2) or m.group(3) or m.group(4) or "")
            if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "role" and NO_ROLE & set(value.lower().split()) or key == "style" and _HIDDEN.search(value):
                return True
            if key in ("class", "id"):
                for name in value.split():
                    words = [w.lower() for w in _TOKEN.findall(name)]
                    if any(w in NO_WORD and (i == 0 or words[i - 1] not in LAYOUT) for i, w in enumerate(words)):
                        return True
    return False


class Page:
    """Elements (parent, tag, path, other) and blocks (element, text, link characters) of
    one page.  Paths are numbered as met; ``path_parent`` has the path above each."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.other = [-1], [""], [0], [False]
        self.path_parent = [-1]
        self._paths: dict[tuple[int, str], int] = {}
        self._open_tags: Counter = Counter()
        self._mains = 0  # open main and article elements
        self.mains: set[int] = set()  # main and article elements, by tag or role
        self.kept: set[int] = set()  # elements that hold a title or a main element
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[int] = [0]  # open block elements
        self._inline: dict[str, list[bool]] = {}  # open inline elements of the block, by tag: other
        self._run: list[str] = []
        self._links = self._in_link = self._in_other = 0
        self._read(source)
        self._flush()

    def _flush(self):
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._links, len(text))))
            self._run, self._links = [], 0

    def _text(self, text: str):
        if text and not self._in_other:
            text = H.unescape(text) if "&" in text else text
            self._run.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _close_to(self, depth: int):
        self._flush()
        for e in self._stack[depth:]:
            self._open_tags[self.tag[e]] -= 1
            self._mains -= e in self.mains
        del self._stack[depth:]
        self._inline, self._in_link, self._in_other = {}, 0, 0

    def _close_open(self, tags: set[str], bounds: set[str]):
        """Ends the outermost open element of ``tags`` above the nearest of ``bounds``."""
        at, left = None, sum(self._open_tags[t] for t in tags)
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if not left or tag in bounds:
                break
            if tag in tags:
                at, left = depth, left - 1
        if at is not None:
            self._close_to(at)

    def _open(self, tag: str, attrs: str):
        if tag in ENDS_P:
            self._close_open({"p"}, {"td", "th", "button", "object", "caption"})
        if tag in ENDS:
            self._close_open(*ENDS[tag])
        self._flush()
        if tag in VOID:
            return
        self._inline, self._in_link, self._in_other = {}, 0, 0
        above = self.path[self._stack[-1]]
        path = self._paths.setdefault((above, tag), len(self.path_parent))
        if path == len(self.path_parent):
            self.path_parent.append(above)
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.path.append(path)
        self.other.append(names_other(tag, attrs))
        self._stack.append(len(self.tag) - 1)
        self._open_tags[tag] += 1
        own = self._main(len(self.tag) - 1, attrs)
        self._mains += own
        if own or tag == "h1" and self._mains:
            for e in reversed(self._stack):
                if e in self.kept:
                    break
                self.kept.add(e)

    def _main(self, e: int, attrs: str) -> bool:
        own = not self.other[e] and (self.tag[e] in ("main", "article") or "role" in attrs and _MAIN_ROLE.search(attrs) is not None)
        if own:
            self.mains.add(e)
        return own

    def _close(self, tag: str):
        if not self._open_tags[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == tag:
                return self._close_to(depth)

    def _read(self, source: str):
        at = 0
        while True:
            lt = source.find("<", at)
            if lt < 0:
                return self._text(source[at:])
            self._text(source[at:lt])
            m = _TAG.match(source, lt)
            if not m:
                rest = source[lt + 1:lt + 2]
                gt = source.find(">", lt) if rest.isalpha() or rest == "/" else lt
                if gt < 0:  # a tag that the page's end cuts off
                    return None
                if gt == lt:
                    self._text("<")
                at = gt + 1
                continue
            at = m.end()
            if m["name"] is None:
                self._text((m["cdata"] or "").replace("&", "&amp;"))
                continue
            tag = m["name"].lower()
            if tag in INLINE:
                self._on_inline(tag, bool(m["end"]), m["attrs"])
            elif m["end"]:
                self._close(tag)
            else:
                if tag in RAW:  # its text is no markup
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    at = len(source) if end is None else source.find(">", end.end()) + 1 or len(source)
                    if tag not in ("noscript", "title"):
                        self._text(" ")
                    continue
                self._open(tag, m["attrs"])

    def _on_inline(self, tag: str, end: bool, attrs: str):
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                self._text(" ")
        elif not end:
            other = tag not in ("a", "label") and "=" in attrs and names_other(tag, attrs)
            self._inline.setdefault(tag, []).append(other)
            self._in_link += tag == "a"
            self._in_other += other
        elif self._inline.get(tag):
            self._in_other -= self._inline[tag].pop()
            self._in_link -= tag == "a"


def path_scores(blocks: list[tuple[int, str, int]], above: list[int]) -> dict[int, tuple[float, float]]:
    """{path: (smoothed score, link share)} of (path, text, link characters); ``above``
    has each path's parent, -1 for the root's."""
    figures: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, links in blocks:
        f = figures[path]
        f[0] += len(text)
        f[1] += len(_PUNCT.findall(text))
        f[2] += links
        f[3] += 1
    # (weight, weighted score) of each path, and summed over the children of a path.
    own = {p: (c ** 0.5, c ** 0.5 * (c / n) * (1 + m / n) * (1 - k / c) ** 2) for p, (c, m, k, n) in figures.items()}
    below: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for p, (w, s) in own.items():
        below[above[p]][0] += w
        below[above[p]][1] += s
    out = {}
    for p, (w, s) in own.items():
        up = above[p]
        siblings = (below[up][0] - w, below[up][1] - s) if up >= 0 else (0.0, 0.0)
        parent = own.get(up, (0.0, 0.0))
        grand = own.get(above[up], (0.0, 0.0)) if up >= 0 else (0.0, 0.0)
        children = below.get(p, (0.0, 0.0))
        weight = w + NEAR[1] * (parent[0] + children[0]) + NEAR[2] * (siblings[0] + grand[0])
        total = s + NEAR[1] * (parent[1] + children[1]) + NEAR[2] * (siblings[1] + grand[1])
        out[p] = (total / weight, figures[p][2] / figures[p][0])
    return out


def main_text(source: str | None, least: float = LEAST) -> str:
    """Blocks of the main text, joined by newlines; empty if there are none."""
    if not source:
        return ""
    page = Page(source)
    longest = [0] * len(page.tag)  # of the paragraphs inside
    for e, text, _ in page.blocks:
        if page.tag[e] == "p":
            longest[e] = max(longest[e], len(text))
    for e in range(len(page.tag) - 1, 0, -1):
        longest[page.parent[e]] = max(longest[page.parent[e]], longest[e])
    shut = [False] * len(page.tag)
    for e in range(1, len(page.tag)):  # parents come first
        tag = page.tag[e]
        shut[e] = shut[page.parent[e]] or (e not in page.kept and (page.other[e] or tag == "header" or tag == "form" and longest[e] < FRAME))
    blocks = [b for b in page.blocks if not shut[b[0]]]
    if not blocks:
        return ""
    paths = [page.path[e] for e, _, _ in blocks]
    scores = path_scores([(p, t, k) for p, (_, t, k) in zip(paths, blocks)], page.path_parent)
    chars = sum(len(t) for _, t, _ in blocks)
    mean = sum(len(t) * scores[p][0] for p, (_, t, _) in zip(paths, blocks)) / chars
    # Paths beside the page's main or article elements stand back.
    landmarks = {e for e in page.mains if not shut[e]}
    inside = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or e in landmarks
    if not any(inside[e] for e, _, _ in blocks):
        inside = [True] * len(page.tag)
    chosen = [inside[e] and scores[p][0] >= least * mean and scores[p][1] < LINKS for p, (e, _, _) in zip(paths, blocks)]
    # The deepest element that holds nearly all of the chosen text.
    held = [0] * len(page.tag)
    for yes, (e, text, _) in zip(chosen, blocks):
        if yes:
            held[e] += len(text)
    for e in range(len(page.tag) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    best = max((e for e in range(len(page.tag)) if held[e] >= HOLDS * held[0]), default=0)
    if held[0] and page.tag[best] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td"):
        best = page.parent[best]
    under = [False] * len(page.tag)
    for e in range(len(page.tag)):
        under[e] = e == best or (e > 0 and under[page.parent[e]])
    keep = [yes or (held[0] > 0 and under[e] and inside[e] and scores[p][1] < LINKS) for yes, p, (e, _, _) in zip(chosen, paths, blocks)]
    return "\n".join(text for yes, (_, text, _) in zip(keep, blocks) if yes)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.  Null html is empty and has the empty
    text; ids, urls and repeated rows pass through; other columns are left behind.
    A page is worked on whole, in the task that read it."""
    names = ["page_id", "url", "text", "n_chars"]
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def run(batches):
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=names)

    return own.mapInArrow(C.released(run), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
