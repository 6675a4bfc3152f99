"""Main-text extraction by a tree-structured graphical model over the DOM.

Every element of a page is on the way to content (content itself, or an element that holds
some) or not. Unary potentials read its tag, the words of its class, id and role, text length,
link density, place, and what the page says about it: whether it is in or beside an article
element or the part with most paragraph text, follows a heading of comments, or speaks like a notice.
Parent-child potentials couple the labels along the tree's edges. Sum-product messages run
upward (leaves to root) and downward, and give each element's exact marginal.
The text of elements with a marginal over one half, in page order, is the main text.

The potentials are trained by gradient ascent on labelled pages (`labelled_pages`, made from
a rule with a fixed seed: articles in named, neutral, nested or no containers, tables, bare or
plain text, amid menus, headers, sidebars, notices, adverts, forms, comments and footers). The
weights (a few kB) travel as a closure. Extraction is one pass without a shuffle; parsing is linear in a
page's length, and pages are never cut.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose inside is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: A start tag on the left ends an open element of the right.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "body": {"head"},
}
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
#: Such elements bound the search for an element to close.
SCOPES = frozenset("html body table td th ul ol dl div section article aside main nav header footer form select template".split())

TAG_GROUPS = [
    ("article",), ("main",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "select", "option", "button", "input", "label", "legend", "dialog"),
    ("script", "noscript", "template", "iframe"), ("style",), ("head", "title", "meta", "link"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("p", "blockquote", "pre"), ("ul", "ol", "dl"),
    ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th", "tfoot", "caption"), ("div",), ("section",), ("a",), ("figure", "figcaption"), ("textarea",), ("svg", "math", "canvas", "object", "audio", "video", "map"), ("body", "html", "#root"),
]
GROUP_OF = {t: k for k, ts in enumerate(TAG_GROUPS) for t in ts}
#: Words of class, id and role values, by what they speak for.
WORD_GROUPS = [
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "adbox", "adsense", "dfp"),
    ("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip", "tabs"),
    ("sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended", "popular", "trending", "complementary"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reviews"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "warning", "popup", "modal", "overlay", "dialog", "paywall"),
    ("header", "masthead", "topbar", "top", "logo", "brand", "site"),
    ("footer", "foot", "bottom", "copyright", "legal", "colophon", "contentinfo"),
    ("share", "social", "follow", "subscribe", "newsletter", "signup", "login", "search", "form"),
    ("article", "content", "post", "entry", "story", "body", "text", "main", "prose", "copy"),
    ("meta", "byline", "author", "date", "tags", "tag", "category", "categories", "hidden"),
]
WORD_OF = {w: k for k, ws in enumerate(WORD_GROUPS) for w in ws}
#: Tags and word groups (by position) whose inside does not count when the part with most paragraph text is sought.
POOR_TAGS = frozenset("nav menu footer aside form select button script style noscript template iframe head title svg textarea".split())
POOR_WORDS = frozenset((0, 1, 2, 3, 4, 6, 7))
ARTICLE_WORDS = 8
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 ul ol dl table figure b i em strong span a br".split())
#: How a heading of reader comments begins.
TALK = re.compile(
    r"\W*(?:\d+\W+)?(?:leave a |post a |reader |user |write a )?(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\b.{0,24}\Z",
    re.I | re.S,
)
#: Headings of comments that count them or ask for some.
COUNTED = re.compile(r"\d|\b(?:leave|post|write|add|reader|user)\b", re.I)
#: What reader comments carry: when, by whom, and how to answer.
MARK = re.compile(
    r"\b\d+\s*(?:seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago\b|\b(?:says|said|wrote|replied)\s*:?\s*\Z|\A\W*(?:reply|quote|report|permalink|upvote|like|antworten|répondre|responder)\W*\Z|"
    r"\b\d{1,2}[.:]\d{2}\s*(?:am|pm|uhr)?\s*\Z|\b(?:posted|commented)\s+(?:by|on|at)\b|\bvor\s+\d+\s+\w+\s*\Z|\bil y a \d+|\bhace \d+",
    re.I,
)
#: Words of notices, adverts and legal lines.
NOTICE = re.compile(
    r"©|\b(?:copyright|all rights reserved|cookies?|advertisement|sponsored|subscribe|newsletter|sign (?:up|in)|log ?in|privacy policy|terms of (?:use|service)|share this|follow us|"
    r"related (?:posts|articles|stories)|read (?:more|also)|skip to|werbung|anzeige|publicité|publicidad|tous droits|alle rechte|todos los derechos)\b",
    re.I,
)
NUMBERS, CONTEXT = 8, 13
FEATURES = len(TAG_GROUPS) + len(WORD_GROUPS) + NUMBERS + CONTEXT + 2

#: A tag up to its `>`; quoted values only follow `=`. Possessive throughout, so it never goes back over a character.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>?)""")
ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Tree:
    """Elements in page order; pieces are (element, text or None for a block edge)."""

    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


class Stack:
    """Open elements, with the places of each tag, so that finding the one to close takes no walk."""

    def __init__(self, tree: Tree):
        self.tree, self.open, self.places = tree, [0], {"#root": [0]}

    def push(self, element: int) -> None:
        self.places.setdefault(self.tree.tag[element], []).append(len(self.open))
        self.open.append(element)

    def close(self, names, bound=()) -> None:
        """Close the innermost of `names` and all within it, unless one of `bound` is further in."""
        at = max((p[-1] for n in names if (p := self.places.get(n))), default=0)
        if not at or any((p := self.places.get(n)) and p[-1] > at for n in bound if n not in names):
            return
        element, edge = self.open[at], False
        while len(self.open) > at:
            tag = self.tree.tag[self.open.pop()]
            self.places[tag].pop()
            edge |= tag in BLOCKS
        if edge:
            self.tree.pieces.append((element, None))


LISTS = frozenset("ul ol dl table select html".split())
_ENDS: dict[str, re.Pattern] = {}


def parse(page: str | None) -> Tree:
    """A tree from any text, well formed or not, in time linear in its length.

    Unclosed elements end with their parents, stray end tags do nothing. As in browsers, a tag that the page's end
    cuts off is dropped, and a `<` that begins no tag is text.
    """
    tree = Tree(["#root"], [""], [-1])
    stack, text, at = Stack(tree), page or "", 0
    n = len(text)
    while at < n:
        begin = text.find("<", at)
        while 0 <= begin < n - 1 and not (text[begin + 1] in "!?/" or text[begin + 1].isascii() and text[begin + 1].isalpha()):
            begin = text.find("<", begin + 1)
        if begin < 0 or begin == n - 1:
            begin = n
        if begin > at:
            tree.pieces.append((stack.open[-1], html_lib.unescape(text[at:begin])))
        if begin == n:
            break
        m = TAG.match(text, begin)
        if not m:  # a comment, declaration or instruction
            closer = "-->" if text.startswith("<!--", begin) else "]]>" if text.startswith("<![CDATA[", begin) else ">"
            if text.startswith(("<!-->", "<!--->"), begin):
                closer = ">"
            end = text.find(closer, begin + (4 if closer == "-->" else 2))
            at = end + len(closer) if end >= 0 else n
            continue
        at = m.end()
        if not m[4]:
            break
        ending, name, attrs = m[1], m[2].lower(), m[3]
        if ending:
            if name == "br" or name == "p" and not stack.places.get("p"):
                tree.pieces.append((stack.open[-1], None))
            else:
                stack.close((name,))
            continue
        if name in ENDS_P and stack.places.get("p"):
            stack.close(("p",), SCOPES)
        if name in CLOSES:
            stack.close(CLOSES[name], LISTS if name != "body" else ())
        if name in BLOCKS:
            tree.pieces.append((stack.open[-1], None))
        element = len(tree.tag)
        tree.tag.append(name)
        tree.attrs.append(attrs)
        tree.parent.append(stack.open[-1])
        if name in VOID or attrs.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name not in RAW:
            stack.push(element)
            continue
        if name not in _ENDS:
            _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I)
        end = _ENDS[name].search(text, at)
        inside = text[at : end.start() if end else n]
        if name in ("title", "textarea"):
            inside = html_lib.unescape(inside)
        tree.pieces += [(element, inside), (element, None)] if name in BLOCKS else [(element, inside)]
        at = end.end() if end else n
    return tree


def features(tree: Tree) -> np.ndarray:
    """(elements, FEATURES): tag group, attribute words, lengths, link density, depth and place, the page's context, hidden, constant."""
    n = len(tree.tag)
    tag, parent = tree.tag, tree.parent
    own, place = [0] * n, [-1.0] * n
    says: dict[int, str] = {}
    seen = 0
    for e, s in tree.pieces:
        if s:
            k = len(s) - s.count(" ")
            if place[e] < 0:
                place[e] = seen
            if own[e] < 200:
                says[e] = says.get(e, "") + s[:200]
            own[e] += k
            seen += k
    tags, words = len(TAG_GROUPS), len(WORD_GROUPS)
    b = tags + words
    c = b + NUMBERS
    f = np.zeros((n, FEATURES))
    poor, in_link, inside = [False] * n, [False] * n, [False] * n
    depth = [0] * n
    for e in range(n):
        p = parent[e]
        if p >= 0:
            depth[e], poor[e], in_link[e], inside[e] = depth[p] + 1, poor[p], in_link[p], inside[p]
        t = tag[e]
        if (k := GROUP_OF.get(t)) is not None:
            f[e, k] = 1
        poor[e] |= t in POOR_TAGS
        in_link[e] |= t == "a"
        inside[e] |= t in ("article", "main")
        if tree.attrs[e]:
            for m in ATTRIBUTE.finditer(tree.attrs[e]):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("hidden", "aria-hidden", "style"):
                    if name == "hidden" or value == "true" or re.search(r"display\s*:\s*none", value):
                        f[e, c + CONTEXT] = 1
                        poor[e] = True
                    continue
                if name == "role" and value == "main":
                    inside[e] = True
                for w in WORDS.findall(value):
                    if (g := WORD_OF.get(w.lower())) is not None:
                        f[e, tags + g] = 1
                        poor[e] |= g in POOR_WORDS
            if f[e, tags + ARTICLE_WORDS] and not poor[e] and t in ("div", "section", "td"):
                inside[e] = True
    below, links = list(own), [k if a else 0 for k, a in zip(own, in_link, strict=True)]
    mass = [0.0 if x or a else float(k) for k, x, a in zip(own, poor, in_link, strict=True)]
    article = [0] * n  # text of articles within
    for e in range(n - 1, 0, -1):
        p = parent[e]
        below[p] += below[e]
        links[p] += links[e]
        if not poor[e]:
            mass[p] += (below[e] - links[e]) if tag[e] in PARAGRAPHS else 0.7 * mass[e]
        article[p] += below[e] if inside[e] and not inside[p] else article[e]
        if place[p] < 0 or 0 <= place[e] < place[p]:
            place[p] = place[e]
    holders = [e for e in range(n) if not poor[e] and tag[e] not in PARAGRAPHS]
    top = max(holders, key=lambda e: (mass[e], e), default=0)
    upward = set()
    e = top
    while e >= 0:
        upward.add(e)
        e = parent[e]
    in_top = [False] * n
    marked = [0 < own[e] < 60 and bool(MARK.search(says[e].strip())) for e in range(n)]
    mark_below = list(marked)
    for e in range(n - 1, 0, -1):
        mark_below[parent[e]] |= mark_below[e]
    talk = talking(tree, own, says, mark_below, inside)
    rows = Counter(parent[e] for e in range(1, n) if tag[e] == "a")
    for e in range(n):
        p = parent[e]
        in_top[e] = e == top or p >= 0 and in_top[p]
        if 0 < own[e] < 400 and not inside[e] and NOTICE.search(says[e]):
            f[e, c + (3 if own[e] < 50 else 10)] = 1  # in an article such words are its own
        # One of a row of links without words of their own between them, not in a paragraph.
        f[e, c + 12] = tag[e] == "a" and rows[p] > 1 and own[p] < 0.3 * (below[p] - own[p]) and tag[p] != "p" or rows[e] > 1 and own[e] < 0.3 * (below[e] - own[e]) and tag[e] != "p"
        f[e, c + 11] = marked[e] and not amid_text(own, says, parent, e)
        t = tag[e]
        if p >= 0 and t not in BLOCKS and own[p] > below[e]:
            f[e, c + 7] = 1  # amid the text of its parent
        f[e, c + 8] = poor[e]
        f[e, c + 9] = poor[e] and (p < 0 or not poor[p])
    total = max(1.0, below[0])
    below_, own_ = np.array(below, dtype=float), np.array(own, dtype=float)
    f[:, b] = np.log1p(own_) / 8
    f[:, b + 1] = np.log1p(below_) / 8
    f[:, b + 2] = np.array(links) / np.maximum(below_, 1)
    f[:, b + 3] = below_ / total
    f[:, b + 4] = np.minimum(depth, 12) / 12
    f[:, b + 5] = np.maximum(place, 0) / total
    f[:, b + 6] = below_ == 0
    f[:, b + 7] = own_ > 80
    holds = np.array(article) > 0
    inside_ = np.array(inside)
    f[:, c] = inside_
    f[:, c + 1] = bool(holds.any() or inside_.any() and below_[inside_].any()) & ~inside_ & ~holds
    f[:, c + 2] = talk
    f[:, c + 4] = in_top
    f[sorted(upward), c + 5] = 1
    f[:, c + 6] = holds
    f[:, -1] = 1
    return f


def amid_text(own: list[int], says: dict[int, str], parent: list[int], e: int) -> bool:
    """Whether an element's words stand amid a longer text of its parent's own."""
    return parent[e] >= 0 and own[parent[e]] > 3 * own[e]


def talking(tree: Tree, own: list[int], says: dict[int, str], mark_below: list[bool], inside: list[bool]) -> list[bool]:
    """Elements among reader comments: what follows a heading of comments up to a heading of its rank, if it looks like comments.

    Comments carry marks (when, by whom, how to answer) or are several elements of one tag and class with parts of their own;
    or their heading counts them, asks for them, or stands beside the article element. A heading alone, before paragraphs, is a heading of the article.
    """
    n = len(tree.tag)
    children: dict[int, list[int]] = {}
    for e in range(1, n):
        children.setdefault(tree.parent[e], []).append(e)
    begun = [False] * n
    beside = any(tree.tag[e] in ("article", "main") for e in range(n))
    for below in children.values():
        rank, after = 0, []
        groups: list[tuple[int, list[int]]] = []
        for e in below:
            t = tree.tag[e]
            heading = int(t[1]) if len(t) == 2 and t[0] == "h" and t[1] in "123456" else 0
            if rank and heading and heading <= rank:
                rank = 0
            if not rank and heading > 1 and own[e] < 60 and TALK.match(says.get(e, "")):
                rank, after = heading, []
                groups.append((e, after))
            elif rank:
                after.append(e)
        for head, after in groups:
            parts = [(tree.tag[e], tree.attrs[e]) for e in after if len(children.get(e, ())) > 1]
            listed = [x for e in after if tree.tag[e] in ("ul", "ol", "div", "section") for x in children.get(e, ()) if len(children.get(x, ())) > 1]
            parts += [(tree.tag[e], tree.attrs[e]) for e in listed]
            if COUNTED.search(says[head]) or beside and not inside[head] or any(mark_below[e] for e in after) or any(parts.count(x) > 1 for x in set(parts[:50])):
                for e in (head, *after):
                    begun[e] = True
    out = [False] * n
    for e in range(n):
        out[e] = begun[e] or tree.parent[e] >= 0 and out[tree.parent[e]]
    return out


@dataclass
class Forest:
    """Several trees as one: rows, parents (-1 for roots), and rows by depth."""

    x: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray  # of each element's edge to its parent


def forest(trees: list[Tree]) -> tuple[Forest, np.ndarray]:
    sizes = [len(t.tag) for t in trees]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    parent = np.concatenate([np.where(np.array(t.parent) >= 0, np.array(t.parent) + o, -1) for t, o in zip(trees, offset[:-1], strict=True)])
    depth = np.zeros(len(parent), dtype=np.int64)
    for e in range(len(parent)):
        if parent[e] >= 0:
            depth[e] = depth[parent[e]] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    kind = np.array([0 if g not in BLOCKS else 1 for t in trees for g in t.tag])
    return Forest(np.concatenate([features(t) for t in trees]), parent, levels, kind), offset


def sum_product(f: Forest, u: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of content per element and expected edge counts (kind, parent label, child label).

    `u`: log-odds of content; `a` (2 kinds, 2, 2): log parent-child potentials.
    """
    n = len(u)
    log_unary = np.stack([np.zeros(n), u], axis=1)
    up = log_unary.copy()  # unary and all messages from below
    message = np.zeros((n, 2))
    for rows in reversed(f.levels[1:]):
        m = np.logaddexp(a[f.kind[rows], :, 0] + up[rows, None, 0], a[f.kind[rows], :, 1] + up[rows, None, 1])
        message[rows] = m - m.max(axis=1, keepdims=True)
        np.add.at(up, f.parent[rows], message[rows])
    belief = up.copy()
    pairs = np.zeros((2, 2, 2))
    for rows in f.levels[1:]:
        p = f.parent[rows]
        rest = belief[p] - message[rows]  # the parent without this child
        joint = rest[:, :, None] + a[f.kind[rows]] + up[rows][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        np.add.at(pairs, f.kind[rows], joint)
        down = np.logaddexp(rest[:, 0, None] + a[f.kind[rows], 0], rest[:, 1, None] + a[f.kind[rows], 1])
        belief[rows] = up[rows] + down - down.max(axis=1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pairs


@dataclass
class Model:
    w: np.ndarray
    a: np.ndarray


@functools.cache
def trained() -> Model:
    """The model of the rule's pages, made once a process."""
    return train(labelled_pages() + labelled_pages(400, 12, rich=True))


def train(pages: list[tuple[str, list[bool]]], rounds: int = 200) -> Model:
    """Fit on (html, flag of the root and each element) pages by Adam on the trees' log-likelihood."""
    trees = [parse(h) for h, _ in pages]
    f, _ = forest(trees)
    y = np.concatenate([flags for _, flags in pages]).astype(float)
    seen = np.zeros((2, 2, 2))
    has = f.parent >= 0
    np.add.at(seen, (f.kind[has], y[f.parent[has]].astype(int), y[has].astype(int)), 1)
    theta = np.zeros(FEATURES + 8)
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pairs = sum_product(f, f.x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2, 2))
        grad = np.concatenate([f.x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - 3e-5 * theta
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        theta += 0.15 * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.999**k)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2, 2))


def extract(pages: list[str | None], m: Model) -> list[str]:
    """Main text of each page: white space inside a block is one space, blocks join in page order by one space."""
    trees = [parse(h) for h in pages]
    f, offset = forest(trees)
    p, _ = sum_product(f, f.x @ m.w, m.a)
    out = []
    for t, o in zip(trees, offset, strict=False):
        good = p[o : o + len(t.tag)] > 0.5
        out.append(SPACE.sub(" ", "".join(" " if s is None else s for e, s in t.pieces if s is None or good[e])).strip())
    return out


#: Where the articles of labelled pages stand; `body` is straight in the page, `bare` and `plain` have no elements around the text.
MARKUPS = ("named", "named", "neutral", "nested", "body", "table", "named", "bare", "neutral", "plain")
NOTICES = (
    "\u00a9 2020", "Copyright", "All rights reserved", "Advertisement", "Sponsored", "Subscribe", "Newsletter", "Sign up", "Log in", "Privacy policy", "We use cookies", "Share this", "Follow us",
    "Related posts", "Read more", "Skip to",
)
#: What comments of labelled pages carry.
MARKS = ("{1} hours ago", "{1} days ago", "{0} says:", "{0} wrote:", "Reply", "12 May 2021, {1}:30", "Posted by {0}", "Permalink")
TALKS = ("Discussion", "{} replies", "Comments", "{} comments", "Comments ({})", "Leave a reply", "Responses", "Kommentare", "{} Commentaires", "Comentarios", "Reader comments")


def labelled_pages(n: int = 600, seed: int = 11, markups: tuple[str, ...] = MARKUPS, rich: bool = False) -> list[tuple[str, list[bool]]]:
    """Pages from a rule, with the flag (on the way to content) of the root and every element in page order.

    In `rich` ones articles have sections named like comments, links alone and in lists, linked headings and
    notice words amid prose; comments carry marks or parts.
    """
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiourstnlmdpcéñü") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    class Page:
        def __init__(self):
            self.out: list[str] = []
            self.flags: list[bool] = []

        def open(self, tag: str, good: bool, attrs: str = "") -> None:
            self.out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
            self.flags.append(good)

        def leaf(self, tag: str, good: bool, text: str, attrs: str = "") -> None:
            self.open(tag, good, attrs)
            self.out.append(f"{text}</{tag}>")

    def named(word: str) -> str:
        return r.choice([f'class="{word}"', f'id="{word}"', f'class="{word} wide"', f'class="site-{word}"', f'class="{word}-box"'])

    def boilerplate(p: Page, where: str) -> None:
        kinds = ["nav", "ad", "side", "comments", "notice", "header", "footer", "share", "form", "script", "bare", "picture", "links"]
        if rich:
            kinds = [k for k in [*kinds, "links", "links"] if where != "in" or k not in ("links", "bare") or r.random() < 0.3]
        kind = r.choice(kinds)
        tag, attrs = "div", ""
        if kind == "nav":
            tag, attrs = r.choice([("nav", ""), ("nav", named("menu")), ("div", named("nav")), ("ul", named("menu")), ("div", named("breadcrumb"))])
        elif kind == "side":
            tag, attrs = r.choice([("aside", ""), ("aside", named("sidebar")), ("div", named("sidebar")), ("div", named("related")), ("section", named("widget"))])
        elif kind == "comments":
            tag, attrs = r.choice([("section", named("comments")), ("div", named("comments")), ("div", named("comment")), ("ol", named("comments"))])
        elif kind == "header":
            tag, attrs = r.choice([("header", ""), ("header", named("masthead")), ("div", named("header"))])
        elif kind == "footer":
            tag, attrs = r.choice([("footer", ""), ("footer", named("footer")), ("div", named("footer")), ("div", named("copyright"))])
        elif kind == "form":
            tag, attrs = r.choice([("form", ""), ("form", named("search")), ("form", named("newsletter"))])
        elif kind == "script":
            p.leaf(r.choice(["script", "style", "noscript"]), False, "var a = 1; track(a);" if r.random() < 0.7 else words(3, 40))
            return
        elif kind == "bare":
            said = r.choice(NOTICES)
            text = words(2, 8) if where == "out" and r.random() < 0.5 else f"{words(0, 3 if rich else 4)} {said} {words(0, 3 if rich else 5)}"
            p.leaf("p" if where != "in" and r.random() < 0.3 else "div", False, text)
            return
        elif kind == "picture":
            p.open("svg", False)
            p.leaf(r.choice(["text", "title", "desc"]), False, words(1, 6))
            p.out.append("</svg>")
            return
        elif kind == "links":
            p.open(r.choice(["div", "div", "ul", "center"] if rich else ["div", "p", "ul", "center"]), False)
            between = r.choice([" | ", " ", "", "br"]) if rich else None
            for _ in range(r.randint(2 if rich else 3, 9)):
                p.leaf("a", False, words(1, 3), 'href="/x"')
                if between == "br":
                    p.open("br", False)
                else:
                    p.out.append(r.choice([" | ", " ", ""]) if between is None else between)
            p.out.append("</div></p></ul></center>")
            return
        else:
            attrs = named(r.choice({"ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "notice": ["cookie", "notice", "consent", "alert", "popup"], "share": ["share", "social", "subscribe", "newsletter"]}[kind]))
            tag = r.choice(["div", "div", "section", "aside"])
        p.open(tag, False, attrs)
        if kind in ("nav", "header", "footer", "side", "share") and r.random() < 0.7:
            inner = tag == "ul" or r.random() < 0.7
            if inner and tag != "ul":
                p.open("ul", False)
            for _ in range(r.randint(2, 8)):
                if inner:
                    p.open("li", False)
                p.leaf("a", False, words(1, 3), 'href="/x"')
                if inner:
                    p.out.append("</li>")
            if inner and tag != "ul":
                p.out.append("</ul>")
        if kind in ("side", "comments", "notice", "form", "ad", "footer", "header"):
            for _ in range(r.randint(0, 4 if kind == "comments" else 2)):
                if kind == "comments" and r.random() < 0.5:
                    p.open("div", False, named("comment"))
                    p.leaf("p", False, words(3, 50))
                    p.out.append("</div>")
                elif kind == "side" and r.random() < 0.4:
                    p.leaf("h3", False, words(1, 4))
                elif kind == "form" and r.random() < 0.6:
                    p.leaf(r.choice(["label", "button"]), False, words(1, 4))
                elif kind == "header" and r.random() < 0.6:
                    p.leaf("h1", False, words(1, 4))
                else:
                    p.leaf(r.choice(["p", "span", "div"]), False, words(3, 40))
        if r.random() < 0.6:
            p.out.append(words(2, 20))
        p.out.append(f"</{tag}>")

    def talk(p: Page) -> None:
        """Comments under a heading, without a telling class: several of one make, with marks or with parts."""
        p.leaf(r.choice(["h2", "h3", "h3", "h4"]), False, r.choice(TALKS if rich else [t for t in TALKS if COUNTED.search(t.format(1))]).format(r.randint(0, 40)))
        if not rich:
            for _ in range(r.randint(1, 5)):
                if r.random() < 0.5:
                    p.leaf("p", False, words(1, 40))
                else:
                    p.open("div", False)
                    p.leaf(r.choice(["b", "span", "h4"]), False, words(1, 2))
                    p.leaf("p", False, words(1, 40))
                    p.out.append("</div>")
            return
        make, listed = r.choice(["marks", "parts", "lines"]), r.random() < 0.3
        if listed:
            p.open("ul", False)
        for _ in range(r.randint(2, 5)):
            if make == "lines":
                p.leaf("p", False, words(1, 40))
                p.leaf("p", False, r.choice(MARKS).format(words(1, 1), r.randint(1, 23)))
                continue
            tag = "li" if listed else "div"
            p.open(tag, False)
            p.leaf(r.choice(["b", "span", "h4", "strong"]), False, words(1, 2))
            if make == "marks":
                p.leaf(r.choice(["span", "small", "time", "a"]), False, r.choice(MARKS).format(words(1, 1), r.randint(1, 23)))
            p.leaf("p", False, words(1, 40))
            p.out.append(f"</{tag}>")
        if listed:
            p.out.append("</ul>")

    def links(p: Page, good: bool, own: bool) -> None:
        """Links of the text: a list of sources, a sentence of links, or one alone. Lists of nothing but links are the text's in containers that tell."""
        kind = r.choice(["list", "sentence", "alone", "several"])
        if kind == "list":
            if not own or r.random() < 0.7:
                p.leaf(r.choice(["h2", "h3"]), good, r.choice(["Sources", "References", "Links", words(1, 3)]))
            p.open(r.choice(["ul", "ol"]), good)
            for _ in range(r.randint(1, 6)):
                p.open("li", good)
                p.leaf("a", good, words(1, 8), 'href="/s"')
                p.out.append((r.choice(["", ".", " " + words(1, 6)]) if own else " " + words(3, 9)) + "</li>")
            p.out.append("</ul></ol>")
            return
        p.open("p", good)
        for k in range(1 if kind == "alone" else r.randint(2, 4)):
            p.out.append("" if kind == "alone" else "See " if not k else r.choice([" and ", ", "]))
            p.leaf("a", good, words(1, 8), 'href="/s"')
        p.out.append(r.choice(["", "."]) + "</p>")

    def blocks(p: Page, own: bool) -> None:
        """The article's text; in a container that tells (`own`) it may speak like a notice."""
        if r.random() < 0.8:
            if r.random() < (0.15 if own or not rich else 0.04):
                p.open("header", True)
                p.leaf("h1", True, words(1, 9))
                p.out.append("</header>")
            else:
                p.leaf(r.choice(["h1", "h1", "h2"]), True, words(1, 9) if not own or r.random() < 0.9 else r.choice(NOTICES))
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            x = r.random()
            if rich and r.random() < 0.1:
                links(p, True, own)
            elif rich and r.random() < 0.08:
                p.leaf(r.choice(["h2", "h3"]), True, r.choice(["Discussion", "Comments", "Responses", "Replies", "Kommentare", "Comments on " + words(1, 3), "Discussion of " + words(1, 3)]))
                for _ in range(r.randint(1, 3)):
                    p.leaf("p", True, words(3, 60))
            elif rich and r.random() < 0.06:
                p.open("h2", True)
                p.leaf("a", True, words(1, 7), 'href="/s"')
                p.out.append("</h2>")
            elif rich and r.random() < 0.14:
                p.leaf("p", True, f"{words(4, 30)} {r.choice(NOTICES)} {words(4, 30)}")
            elif x < 0.62:
                p.open("p", True)
                if r.random() < 0.25:
                    p.open("b", True)
                    p.out.append(words(1, 60))
                    p.open("br", True)
                else:
                    p.out.append(words(1, 80) if not own or r.random() < 0.9 else f"{words(0, 3)} {r.choice(NOTICES)} {words(0, 3)}")
                    if r.random() < 0.25:
                        p.leaf(r.choice(["a", "em", "b", "span", "strong", "i", "code"]), True, words(1, 4), r.choice(["", 'href="/y"']))
                    p.out.append(" " + words(1, 40) + r.choice(["</p>", "</p>", ""]))
            elif x < 0.7:
                p.leaf(r.choice(["h2", "h3"]), True, words(1, 6))
            elif x < 0.78:
                p.open(r.choice(["ul", "ol"]), True)
                for _ in range(r.randint(1, 5)):
                    p.leaf("li", True, words(1, 15))
                p.out.append("</ul></ol>")
            elif x < 0.83:
                p.open("blockquote", True)
                p.leaf("p", True, words(3, 30))
                p.out.append("</blockquote>")
            elif x < 0.87:
                p.leaf("pre", True, words(3, 30))
            elif x < 0.9:
                p.open("table", True)
                for _ in range(r.randint(1, 3)):
                    p.open("tr", True)
                    for _ in range(2):
                        p.leaf("td", True, words(1, 5))
                    p.out.append("</tr>")
                p.out.append("</table>")
            elif x < 0.94:
                tag = r.choice(["div", "section"])
                p.open(tag, True)
                for _ in range(r.randint(1, 3)):
                    p.leaf("p", True, words(3, 60))
                p.out.append(f"</{tag}>")
            elif x < 0.96:
                p.open("figure", True)
                p.leaf("figcaption", True, words(2, 9))
                p.out.append("</figure>")
            else:
                boilerplate(p, "in")
            if r.random() < 0.12:
                boilerplate(p, "in")

    def article(p: Page, markup: str) -> None:
        """The article in one of MARKUPS, and what stands beside it in its container."""
        talks = r.random() < (0.3 if rich else 0.12)
        if markup == "named":
            tag, attrs = r.choice(
                [("article", "")] * 4 + [("article", named("post")), ("main", ""), ("main", named("content")), ("div", named("content")), ("div", named("article")), ("div", named("entry")), ("section", named("story"))]
            )
            opened = [(tag, attrs)] + ([("div", named(r.choice(["body", "text", "entry", "content"])))] if r.random() < 0.25 else [])
        elif markup == "neutral":
            opened = [(r.choice(["div", "section", "center"]), r.choice(["", "", 'class="row"', 'class="c12"', 'id="x1"', 'class="wide left"']))]
        elif markup == "nested":
            opened = [("div", r.choice(["", 'class="row"', 'class="inner"'])) for _ in range(r.randint(2, 5))]
        elif markup == "table":
            p.open("table", True, r.choice(["", 'width="100%"']))
            p.open("tr", True)
            if r.random() < 0.7:
                p.open("td", False)
                for _ in range(r.randint(2, 8)):
                    p.leaf("a", False, words(1, 3), 'href="/x"')
                    p.open("br", False)
                p.out.append("</td>")
            opened = [("td", "")]
        else:
            opened = []
        for tag, attrs in opened:
            p.open(tag, True, attrs)
        blocks(p, markup == "named")
        if talks and r.random() < 0.5:
            talk(p)
            talks = False
        p.out += [f"</{tag}>" for tag, _ in reversed(opened)]
        if markup == "table":
            p.out.append("</tr></table>")
        if talks:
            if opened and r.random() < 0.5:
                p.open("div", False)
                talk(p)
                p.out.append("</div>")
            else:
                talk(p)
                return
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            boilerplate(p, "out" if markup == "named" else "beside")

    pages = []
    while len(pages) < n:
        markup = markups[len(pages) % len(markups)]
        p = Page()
        if markup in ("plain", "bare"):
            text = "\n".join(words(3, 60) for _ in range(r.randint(1, 6)))
            if markup == "plain":
                pages.append((text, [True]))
                continue
            p.open("html", True)
            p.open("body", True)
            if r.random() < 0.5:
                boilerplate(p, "beside")
            p.out.append(words(8, 60))
            for _ in range(r.randint(0, 4)):
                p.open("br", True)
                p.out.append(words(3, 60))
            if r.random() < 0.5:
                boilerplate(p, "beside")
        else:
            head = r.random() < 0.9
            if head:
                p.out.append("<!DOCTYPE html>")
                p.open("html", True)
                p.open("head", False)
                p.leaf("title", False, words(1, 9))
                if r.random() < 0.6:
                    p.leaf("style", False, "p{margin:0}")
                if r.random() < 0.6:
                    p.leaf("script", False, 'var t="</p>";track(1);')
                p.out.append("</head>")
            p.open("body", True)
            wrap = r.random() < 0.3
            if wrap:
                p.open("div", True, r.choice(["", 'id="page"', 'class="wrapper"']))
            for _ in range(r.randint(0, 4)):
                boilerplate(p, "out" if markup == "named" else "beside")
            article(p, markup)
            p.out.append(("</div>" if wrap else "") + r.choice(["</body></html>", ""]))
        text = "".join(p.out)
        if len(parse(text).tag) == len(p.flags) + 1:
            pages.append((text, [True, *p.flags]))
    return pages


def extract_main_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Per row of `pages`: `keep` columns and `main_text`.

    Null and empty pages, and pages without content, give an empty text; a page without markup is its own main text. Repeated rows stay; an empty table gives
    an empty result; other columns are not read.
    """
    model = trained()

    def kernel():
        return lambda texts: {"main_text": pa.array(extract(texts, model), pa.string())}

    return map_text(pages, keep, kernel, "main_text string", text=html)
