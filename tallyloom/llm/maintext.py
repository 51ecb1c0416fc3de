"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that keeps no node below a dropped one.

Pages whose markup names their article serve as examples. Each is rebuilt in several ways: its article and its other parts
under other tags and attributes, or under none that say anything, among parts of other kinds made from the page's own
words. So the trees must also learn from density, links, depth and siblings, and not from tags alone.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, typed

# HTML's elements without an end, of raw text, and of blocks; and those whose text a reader never reads as prose.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
_UNREAD = _RAW | set("head select option button object svg math canvas audio video datalist".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Blocks that hold other blocks rather than text.
_HOLDERS = set("#page html body div section article main aside header footer nav form fieldset dialog details center".split())
# Which open elements a new one ends, and where the search for them stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
# What parts of pages are called, in tags or in parts of class and id names.
FAMILIES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topnav toc skip",
    "header": "header masthead branding topbar logo",
    "footer": "footer foot copyright colophon legal",
    "side": "sidebar aside rail widget widgets related recommended trending popular",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter disclaimer banner",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense",
    "form": "form search searchbox login register signup subscribe fieldset dialog",
    "comment": "comment comments reply replies respond discussion disqus thread",
    "content": "content article main post entry story articlebody prose",
}
_FAMILY: dict[str, set[int]] = {}
for _i, _words in enumerate(FAMILIES.values()):
    for _w in _words.split():
        _FAMILY.setdefault(_w, set()).add(_i)
_CONTENT = len(FAMILIES) - 1
_KINDS = "article main section div p pre blockquote figure h li ul table nav header footer aside form inline text other".split()
_KIND_OF = {k: _KINDS.index(v) for k, v in {
    **{k: k for k in _KINDS[:8]}, **{f"h{i}": "h" for i in range(1, 7)}, "li": "li", "dt": "li", "dd": "li", "ul": "ul", "ol": "ul", "dl": "ul", "menu": "nav", "nav": "nav", "figcaption": "figure",
    **{k: "table" for k in "table tbody thead tfoot tr td th caption".split()}, "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "form", "#text": "text"}.items()}
#: Buckets for the other parts of class and id names.
HASHED = 12
_SUMS = "chars words links linked stops controls images nodes prose items heads".split()
FEATURES = (
    *(f"is_{k}" for k in _KINDS), *(f"named_{f}" for f in FAMILIES), *(f"within_{f}" for f in FAMILIES), "within_other", *(f"token{i}" for i in range(HASHED)), "hidden", "within_hidden",
    "depth", *(f"sub_{s}" for s in _SUMS), "density", "link_density", "stop_density", "words_a_block", "share", "before", "own_chars",
    "siblings", "place", "like_siblings", "prev_chars", "next_chars", "prev_links", "next_links",
)
#: Pages that the trees are trained on, at most, and how many ways each is rebuilt; trees and their depth.
SAMPLE, WAYS, TREES, DEPTH = 400, 3, 30, 5
#: How much of its parent's score a node gets.
FOLLOW = 0.4

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_ATTR = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.,;:!?。，、](?:\s|$)")


class Page:
    """The nodes of one page in page order, a node's subtree being a run of them, and its pieces of text.

    Nodes are blocks, inline elements with a class, id or role, and what text stands loose in a block that holds others,
    so that it can be judged by itself. Every piece of text belongs to a node and to a block of text (a number that grows
    wherever a block begins or ends).
    """

    def __init__(self, source: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.names: list[str] = []
        self.hidden: list[bool] = []
        self.inner: list[list[int]] = []  # where a node's content stands in the source
        self.controls: list[int] = []
        self.images: list[int] = []
        self.pieces: list[tuple[int, int, bool, str]] = []  # node, block of text, inside a link, text
        self._read(source)

    def _open(self, tag: str, parent: int, names: str, hidden: bool, at: int) -> int:
        for column, x in ((self.tag, tag), (self.parent, parent), (self.end, 0), (self.names, names), (self.hidden, hidden), (self.inner, [at, at]), (self.controls, 0), (self.images, 0)):
            column.append(x)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, count = [self._open("#page", -1, "", False, 0)], {}
        run, linked, unread, pos, n = 0, 0, [], 0, len(source)
        loose = -1, -1, -1  # node, block of text, and the node made for its text

        def close(to: int, at: int) -> None:
            """Ends the nodes of the stack from place `to` on."""
            while len(stack) > to:
                i = stack.pop()
                self.end[i] = len(self.tag)
                self.inner[i][1] = at
                count[self.tag[i]] -= 1

        while pos < n:
            at = source.find("<", pos)
            at = n if at < 0 else at
            while at < n and not (source[at + 1 : at + 2].isalpha() and source[at + 1] < "{" or source[at + 1 : at + 2] in ("/", "!", "?")):
                at = source.find("<", at + 1)
                at = n if at < 0 else at
            if at > pos and not unread:
                text, node = source[pos:at], stack[-1]
                if self.tag[node] in _HOLDERS and not text.isspace():
                    if loose[:2] != (node, run):
                        loose = node, run, self._open("#text", node, "", False, pos)
                        self.end[-1] = len(self.tag)
                    node = loose[2]
                self.pieces.append((node, run, linked > 0, html.unescape(text) if "&" in text else text))
            if at == n:
                break
            if source.startswith("<!--", at):
                end = source.find("-->", at + 2 if source.startswith(("<!-->", "<!--->"), at) else at + 4)
                pos = n if end < 0 else end + 3
                continue
            m = _TAG.match(source, at)
            if m is None:
                # a declaration, an end without a name, or a tag that the page's end cuts off
                end = source.find(">", at)
                pos = n if end < 0 else end + 1
                continue
            pos, tag, rest = m.end(), m[2].lower(), m[3]
            if m[1]:
                if unread:
                    if tag in unread:
                        del unread[unread.index(tag) :]
                    continue
                if tag == "a":
                    linked = 0
                if tag in _BLOCK:
                    run += 1
                if count.get(tag):
                    k = len(stack) - 1
                    if tag in _BLOCK:
                        while self.tag[stack[k]] != tag:
                            k -= 1
                        close(k, at)
                    else:
                        low = max(0, k - 16)
                        while k > low and self.tag[stack[k]] != tag and self.tag[stack[k]] not in _BLOCK:
                            k -= 1
                        if self.tag[stack[k]] == tag:
                            close(k, at)
                continue
            if unread and tag != "body" and not (unread == ["head"] and tag in _BLOCK):
                if tag in _UNREAD and tag not in _RAW and not rest.endswith("/"):
                    unread.append(tag)
                elif tag in _RAW and not rest.endswith("/"):
                    pos = self._skip(source, tag, pos)
                continue
            if unread:
                unread.clear()  # a body, or a block, ends an open head
            if tag == "br":
                self.pieces.append((stack[-1], run, linked > 0, " "))
            elif tag == "hr":
                run += 1
            elif tag in ("input", "button", "select", "textarea"):
                self.controls[stack[-1]] += 1
            elif tag == "img":
                self.images[stack[-1]] += 1
            if tag in _VOID:
                continue
            if tag in _RAW:
                pos = self._skip(source, tag, pos)
            elif tag in _UNREAD:
                unread.append(tag)
            elif tag == "a":
                linked = 1
            if tag in _RAW or tag in _UNREAD:
                continue
            names, hidden = self._names(rest) if rest else ("", False)
            if tag in _BLOCK:
                run += 1
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] not in _BLOCK:
                    k -= 1
                if self.tag[stack[k]] == "p":
                    close(k, at)
                    k -= 1
                if tag in _ENDS:
                    ends, stops = _ENDS[tag]
                    low, k, found = max(0, len(stack) - 64), len(stack) - 1, None
                    while k > low and self.tag[stack[k]] not in stops:
                        if self.tag[stack[k]] in ends:
                            found = k
                        k -= 1
                    if found is not None:
                        close(found, at)
                if tag in ("html", "body") and count.get(tag):
                    continue
            elif not names and not hidden or tag == "a":
                continue
            i = self._open(tag, stack[-1], names, hidden, pos)
            count[tag] = count.get(tag, 0) + 1
            stack.append(i)
        count["#page"] = 1
        close(0, n)

    @staticmethod
    def _skip(source: str, tag: str, pos: int) -> int:
        """Where the raw text of such an element ends, its end tag included; the page's end if there is none."""
        m = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])[^>]*>").search(source, pos)
        return m.end() if m else len(source)

    @staticmethod
    def _names(rest: str) -> tuple[str, bool]:
        words, hidden = [], False
        for name, *values in _ATTR.findall(rest):
            value = "".join(values)
            if name.lower() in ("class", "id", "role"):
                words.append(value)
            elif name.lower() == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= name.lower() == "hidden" or value.lower() == "true"
        return " ".join(words), hidden

    def blocks(self, kept: np.ndarray | None = None) -> list[str]:
        """The text of each block, of the kept nodes' pieces only; white space is one space, and empty blocks are none."""
        out, last, held = [], -1, []
        for node, run, _, text in self.pieces:
            if kept is not None and not kept[node]:
                continue
            if run != last and held:
                out.append(" ".join("".join(held).split()))
                held = []
            last = run
            held.append(text)
        out.append(" ".join("".join(held).split()))
        return [x for x in out if x]


def describe(page: Page) -> np.ndarray:
    """The features of each node, as columns of FEATURES."""
    n = len(page.tag)
    end, parent = np.array(page.end), np.array(page.parent)
    own = np.zeros((n, len(_SUMS)))
    for node, _, linked, text in page.pieces:
        size = len(text) - text.count(" ")
        if not size or text.isspace():
            continue
        row = own[node]
        row[0] += size
        row[1] += len(text.split())
        row[3] += size * linked
        row[2] += linked
        row[4] += len(_STOPS.findall(text))
    own[:, 5], own[:, 6], own[:, 7] = page.controls, page.images, 1
    kinds = np.array([_KIND_OF.get(t, _KINDS.index("inline") if t not in _BLOCK else len(_KINDS) - 1) for t in page.tag])
    own[:, 8], own[:, 9], own[:, 10] = kinds == _KINDS.index("p"), kinds == _KINDS.index("li"), kinds == _KINDS.index("h")
    sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, 0)])
    sub = sums[end] - sums[:n]
    named, tokens = np.zeros((n, len(FAMILIES))), np.zeros((n, HASHED))
    for i, (tag, names) in enumerate(zip(page.tag, page.names, strict=True)):
        for f in _FAMILY.get(tag, ()):
            named[i, f] = 1
        if names:
            for w in _PART.findall(names):
                w = w.lower()
                for f in (hits := _FAMILY.get(w, ())):
                    named[i, f] = 1
                if not hits:
                    tokens[i, zlib.crc32(w.encode()) % HASHED] = 1
    hidden = np.array(page.hidden, float)
    within, covert, depth = named.copy(), hidden.copy(), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        within[i] = np.maximum(within[i], within[p])
        covert[i] = max(covert[i], covert[p])
    chars, all_chars = sub[:, 0], max(1.0, sub[0, 0])
    # siblings: neighbours in the order of (parent, node)
    order = np.argsort(parent, kind="stable")
    near = parent[order]
    same_prev = np.concatenate([[False], near[1:] == near[:-1]])
    prev, following = np.full(n, -1), np.full(n, -1)
    prev[order[same_prev]] = order[np.flatnonzero(same_prev) - 1]
    following[order[np.flatnonzero(same_prev) - 1]] = order[same_prev]
    starts = np.flatnonzero(~same_prev)
    size = np.diff(np.append(starts, n))
    siblings, place = np.zeros(n), np.zeros(n)
    siblings[order] = np.repeat(size, size)
    place[order] = (np.arange(n) - np.repeat(starts, size)) / np.maximum(1, np.repeat(size, size) - 1)
    pair = parent.astype(np.int64) * 64 + kinds
    _, back, many = np.unique(pair, return_inverse=True, return_counts=True)
    links = sub[:, 3] / np.maximum(1, chars)
    beside = lambda at, x: np.where(at >= 0, x[at], -1)
    columns = [
        np.log1p(sub[:, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]]),
        np.stack([
            chars / np.maximum(1, sub[:, 7]), links, 100 * sub[:, 4] / np.maximum(1, chars), sub[:, 1] / np.maximum(1, sub[:, 8] + sub[:, 9] + sub[:, 10]), chars / all_chars, sums[:n, 0] / all_chars, np.log1p(own[:, 0]),
            siblings, place, many[back] / np.maximum(1, siblings), beside(prev, np.log1p(chars)), beside(following, np.log1p(chars)), beside(prev, links), beside(following, links)], 1),
    ]
    return np.concatenate([np.eye(len(_KINDS))[kinds], named, within, within[:, :_CONTENT].max(1, keepdims=True), tokens, hidden[:, None], covert[:, None], depth[:, None], *columns], 1)


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the choice with the largest sum of scores (kept: plus, dropped: minus) in which nothing below a
    dropped node is kept. A node's score leans on its parent's. The page, its html and body are kept."""
    n = len(score)
    score = score + FOLLOW * np.where(np.array(page.parent) > 0, score[page.parent], 0.0)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    without = (sums[:n] - sums[np.array(page.end)]).tolist()
    gain, parent, value = score.tolist(), page.parent, [0.0] * n
    for i in range(n - 1, 0, -1):
        value[i] += gain[i]
        value[parent[i]] += max(value[i], without[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and (page.tag[i] in ("html", "body") or value[i] > without[i])
    return kept


class Trees:
    """Boosted regression trees as arrays, so that a task can apply them to all nodes of a page at once."""

    def __init__(self, model):
        feature, threshold, left, right, value, roots = [], [], [], [], [], []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            roots.append(len(feature))
            todo = [(tree._call_java("rootNode"), None, None)]
            while todo:
                node, of, side = todo.pop()
                me = len(feature)
                leaf = node.subtreeDepth() == 0
                for column, x in ((feature, 0 if leaf else node.split().featureIndex()), (threshold, 0.0 if leaf else node.split().threshold()), (left, me), (right, me), (value, weight * node.prediction())):
                    column.append(x)
                if of is not None:
                    side[of] = me
                if not leaf:
                    todo += [(node.leftChild(), me, left), (node.rightChild(), me, right)]
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int64) for x in (feature, left, right, roots))
        self.threshold, self.value = np.array(threshold), np.array(value)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Half the log-odds that a node holds main text."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at].sum(1)


def _articles(page: Page) -> list[int]:
    """The outermost article or main nodes outside other parts of a page."""
    bad = [bool({f for w in [t, *map(str.lower, _PART.findall(x))] for f in _FAMILY.get(w, ())} - {_CONTENT}) for t, x in zip(page.tag, page.names, strict=True)]
    found: list[int] = []
    for i in range(1, len(page.tag)):
        bad[i] |= bad[page.parent[i]]
        if not bad[i] and page.tag[i] in ("article", "main") and not any(j <= i < page.end[j] for j in found[-1:]):
            found.append(i)
    return found


_PARAGRAPH, _HEADING = re.compile(r"<p>([^<]+)</p>"), re.compile(r"(<h1>[^<]*</h1>)")


def dressed(inner: str, r: random.Random) -> str:
    """An article with some of its paragraphs as lists, tables, quotes, captions, loose text or partly links, and its title
    in a header; now and then only its beginning."""

    def other(m: re.Match) -> str:
        text, words, kind = m[1], m[1].split(), r.random()
        if kind > 0.5 or not words:
            return m[0]
        n = r.randint(1, 5)
        parts = [" ".join(words[i * len(words) // n : (i + 1) * len(words) // n]) for i in range(n)]
        tag = r.choice(["ul", "ol"])
        return [
            f"<{tag}>" + "".join(f"<li>{x}</li>" for x in parts) + f"</{tag}>", "<table>" + "".join(f"<tr><td>{x}</td><td>{len(x)}</td></tr>" for x in parts) + "</table>", f"<blockquote><p>{text}</p></blockquote>", f"<div>{text}</div>",
            f"<figure><img src='x'><figcaption>{parts[0]}</figcaption></figure>", f"<pre>{text}</pre>", f"<h2>{' '.join(words[:5])}</h2><p>{text}</p>", f"<p>{parts[0]} <a href='/x'>{' '.join(parts[1:])}</a></p>", f"<p><em>{text}</em></p>", f"<p>{' '.join(words[:6])}</p>",
        ][int(kind * 20)]

    if r.random() < 0.2:
        ends = [m.end() for m in _PARAGRAPH.finditer(inner)]
        inner = inner[: ends[min(len(ends), r.randint(1, 3)) - 1]] if ends else inner
        if r.random() < 0.5:
            inner = _PARAGRAPH.sub(lambda m: f"<p>{' '.join(m[1].split()[: r.randint(1, 8)])}</p>", inner)
    if r.random() < 0.2:
        inner = _HEADING.sub("", inner, count=1)
    elif r.random() < 0.2:
        inner = _HEADING.sub(rf"<header>\1{r.choice(['', '<p>By A. B.</p>'])}</header>", inner, count=1)
    return _PARAGRAPH.sub(other, inner) if r.random() < 0.6 else inner


def rebuilt(source: str, seed: int, plain: bool) -> tuple[str, list[str]] | None:
    """The page's article among parts of other kinds, under tags and attributes drawn anew, and the article's blocks of
    text; None if the markup names no article. plain: under tags and attributes that say nothing."""
    page = Page(source)
    found = _articles(page)
    if not found:
        return None
    r = random.Random(seed)
    inner = dressed("\n".join(source[page.inner[i][0] : page.inner[i][1]] for i in found), r)
    inside = Page(inner)
    if any(t in ("nav", "header", "footer", "aside", "form") or inside.names[i] for i, t in enumerate(inside.tag)):
        own = np.ones(len(inside.tag), bool)
        for i in range(1, len(own)):
            of = {f for w in [*[inside.tag[i]] * (inside.tag[i] != "header"), *map(str.lower, _PART.findall(inside.names[i]))] for f in _FAMILY.get(w, ())}
            own[i] = own[inside.parent[i]] and not of - {_CONTENT}
    else:
        own = None
    gold = inside.blocks(own)
    words = " ".join(gold).split() or ["word"]

    def some(least: int, most: int) -> str:
        n, at = r.randint(least, most), r.randrange(len(words))
        return html.escape(" ".join((words + words)[at : at + n]))

    def name(family: str, tags: str = "div section ul aside") -> tuple[str, str]:
        if plain:
            return "div", "div" + r.choice(["", f' class="c{r.randrange(99)}"'])
        word = r.choice(FAMILIES[family].split())
        word = r.choice([word, f"site-{word}", f"{word}-box", f"{word}_{r.randrange(9)}", f"page-{word}"])
        tag = r.choice(tags.split())
        return tag, f'{tag} {r.choice(["class", "id"])}="{word}"'

    def part(family: str, body: str, own_tag: str = "") -> str:
        tag, opening = name(family, "div section div")
        if own_tag and not plain and r.random() < 0.6:
            tag, opening = own_tag, r.choice([own_tag, opening.replace(tag, own_tag, 1)])
        return f"<{opening}>{body}</{tag}>"

    def listed(k: int, wordy: int = 3) -> str:
        links = [f'<a href="/{i}">{some(1, wordy)}</a>' for i in range(k)]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", lambda: " | ".join(links), lambda: "".join(f"<p>{x}</p>" for x in links)])()

    controls = lambda: f'<{r.choice(["form", "div"]) if not plain else "form"}><label>{some(1, 3)}</label><input name="q"><button>{some(1, 2)}</button></form>'
    prose = lambda least, most: "".join(f"<p>{some(3, 60)}.</p>" for _ in range(r.randint(least, most)))
    before = [part("menu", listed(r.randint(3, 12)), "nav"), part("header", r.choice([some(1, 6), f"<p>{some(1, 6)}</p>", f"<h1>{some(1, 4)}</h1>{listed(3)}"]), "header")]
    after = [part("footer", r.choice([f"&copy; 2024 {some(2, 12)}", listed(4), f"<p>{some(2, 20)}</p>{listed(3)}"]), "footer")]
    middle = [part("side", f"<h3>{some(1, 3)}</h3>{listed(r.randint(2, 8), 8)}", "aside"), part("form", controls(), "form")]
    if not plain:  # by their words alone these could be main text
        middle += [part("notice", r.choice([some(5, 40), f"<p>{some(5, 40)}.</p><button>OK</button>"])), part("advert", r.choice([some(3, 25), f"<p>{some(3, 25)}</p>", f"<a href='/'>{some(2, 8)}</a>"])), part("side", prose(1, 3), "aside")]
        # long parts of any kind, whatever the article's length
        before = [r.choice([p, part(f, prose(1, 3), t)]) if r.random() < 0.5 else p for p, f, t in zip(before, ("menu", "header"), ("nav", "header"), strict=True)]
        after = [part("footer", prose(1, 3), "footer")] if r.random() < 0.4 else after
        middle.append(part("header", r.choice([some(1, 6), listed(r.randint(1, 3))]), "header"))
        middle.append(part("comment", f"<h2>{some(1, 3)}</h2>" + "".join(f"<{x[1]}>{prose(1, 2)}</{x[0]}>" for x in (r.choice([name("comment", "div li article"), ("div", "div"), ("li", "li")]) for _ in range(r.randint(1, 6))))))
    else:
        middle.append(part("advert", some(3, 12)))
    parts = [p for p in before if r.random() < 0.8]
    r.shuffle(middle)
    ahead = [p for p in middle if r.random() < 0.3]
    behind = [p for p in middle if p not in ahead and r.random() < 0.5]
    tag, opening = name("content", "div section article main div")
    if not plain and r.random() < 0.5:
        tag = opening = r.choice(["article", "main"])
    if behind and r.random() < 0.4:  # a part inside the article
        inner = behind.pop() + inner if r.random() < 0.5 else inner + "</p>" + behind.pop()
    if not plain and r.random() < 0.25:
        inner += "</p>" + part("footer", r.choice([some(1, 8), listed(2), f"<p>{some(1, 8)}</p>"]), "footer")
    article = f"<{opening}>{inner}</{tag}>"
    if r.random() < 0.4:
        article = f"<div{'' if plain or r.random() < 0.5 else ' class=wrapper'}>{article}{''.join(behind)}</div>"
        behind = []
    body = "".join([*parts, *ahead, article, *behind, *(p for p in after if r.random() < 0.85)])
    return f"<html><head><title>{some(1, 8)}</title></head><body>{body}</body></html>", gold


def labelled(source: str, gold: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a page whose main text is known: a node is 1 if most of its text is in one of
    those blocks, or if a node below it is 1 (only so can that be kept). Nodes without text have no label and are left out."""
    page = Page(source)
    known: dict[str, int] = {}
    for g in gold:
        known[g] = known.get(g, 0) + 1
    runs: dict[int, list[int]] = {}
    for k, (_, run, _, _) in enumerate(page.pieces):
        runs.setdefault(run, []).append(k)
    good, size = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for pieces in runs.values():
        text = " ".join("".join(page.pieces[k][3] for k in pieces).split())
        hit = text in known
        for k in pieces:
            node, _, _, t = page.pieces[k]
            size[node] += len(t.strip())
            good[node] += hit * len(t.strip())
    own = good * 2 > size
    sums = np.concatenate([[0], np.cumsum(own)])
    texts = np.concatenate([[0.0], np.cumsum(size)])
    end = np.array(page.end)
    label = (sums[end] - sums[: len(end)]) > 0
    use = ((texts[end] - texts[: len(end)]) > 0) & ~np.isin(page.tag, ["#page", "html", "body"])
    return describe(page)[use], label[use]


def train(pages: DataFrame, examples: DataFrame | None = None, sample: int = SAMPLE) -> Trees | None:
    """The trees, trained on at most `sample` different pages, chosen by a hash; None where there is nothing to learn from.

    examples(html, text): pages with their main text, blocks parted by two line breaks. Without them, pages whose markup
    names their article are rebuilt WAYS times, one of them plainly.
    """
    given = examples is not None
    if given:
        rows = typed(examples, html="string", text="string").where("html is not null and text is not null")
    else:
        rows = pages.select("html", F.lit("").alias("text")).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    rows = rows.select("html", "text", F.xxhash64("html", "text").alias("h"))
    # copies count once, however many there are; only hashes are sorted
    chosen = rows.select("h").distinct().orderBy("h").limit(sample)
    rows = rows.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.struct("html", "text")).alias("r")).select("r.html", "r.text", "h").repartition(16, "h")  # at most `sample` hashes

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = [(source, text.split("\n\n"))] if given else [rebuilt(source, h + way, way == 0) for way in range(WAYS)]
                for page, gold in filter(None, made):
                    x, y = labelled(page, gold)
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y.astype(float))], ["x", "label"])

    scratch = Scratch(pages.sparkSession, "maintext")
    table = scratch.save(rows.mapInArrow(nodes, "x array<double>, label double"), "nodes")
    both = table.agg(F.min("label"), F.max("label")).first()
    trees = None
    if both[0] != both[1]:
        rows = table.select("label", array_to_vector("x").alias("features")).coalesce(4)
        trees = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, subsamplingRate=0.8, minInstancesPerNode=8).fit(rows))
    scratch.drop("nodes")
    return trees


def main_text(source: str | None, trees: Trees | None) -> str:
    """The kept blocks, in page order. Without trees, whatever no name or tag of another family covers is kept."""
    if not source:
        return ""
    page = Page(source)
    x = describe(page)
    if trees is None:
        first = FEATURES.index("within_menu")
        score = np.where(x[:, first : first + _CONTENT].any(1), -1.0, 1.0)
    else:
        score = np.clip(trees(x), -2, 2)
    return "\n\n".join(page.blocks(decode(page, score)))


def extract(pages: DataFrame, examples: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    The main text without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers'
    comments; character references decoded, white space of a block turned into one space, blocks parted by two line
    breaks. A null or empty html gives an empty text, and so does a page without main text. Very long, deep or broken
    pages are read whole, in time in proportion to their length; a comment or tag that never ends reaches to the page's
    end. Repeated rows give a row each; an empty table gives no rows; other columns stay out.
    """
    base = typed(pages, page_id="long", url="string", html="string")
    trees = train(base, examples, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, trees) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
