"""Main-text extraction from web pages: boosted trees over DOM nodes and hierarchical decoding."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.boosting import Trees, fit_trees
from countloom.llm.common import columns_of, text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video textarea select datalist button title".split())
#: Open elements that a start tag ends, and the elements beyond which it does not look.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table article section div main body aside nav form blockquote td".split())
TAGS = (
    "#run body div p article main section header footer nav aside ul ol li dl dt dd h1 h2 h3 h4 h5 h6 form fieldset table tbody tr td th "
    "blockquote pre figure figcaption address details span a"
).split()
#: Parts of class, id and role values that templates commonly use.
TOKENS = (
    "nav menu navbar breadcrumb header masthead topbar footer copyright legal sidebar widget aside related trending popular recommend ad ads advert "
    "advertisement sponsor sponsored promo banner cookie consent gdpr notice alert message paywall popup modal overlay share social follow subscribe "
    "newsletter signup login search form comment comments reply discussion disqus respond pagination pager tags tag meta byline author skip hidden "
    "article content main post entry story body text page container wrapper layout column"
).split()
_TAG_AT, _TOKEN_AT = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}
_PARTS = re.compile(r"[a-z]+")
#: A tag whose quoted values end; quantifiers keep what they took, so a match reads each character once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_NUMERIC = 24
WIDTH = _NUMERIC + 2 * len(TAGS) + len(TOKENS)
_MAIN = "\ue000"  # marks main text in training pages


class _Builder:
    """Nodes in page order. A run of text and plain inline elements is one ``#run`` node; a piece of text belongs to a node."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.tokens, self.hidden = ["#root"], [-1], [0], {}, []
        self.stack = [0]
        self.pieces: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        self.inputs: list[int] = []
        self.images: list[int] = []
        self.block, self.link, self.never, self.run = 0, False, [], -1
        self.open: Counter = Counter()  # elements on the stack, by tag
        last, at, scan = html.rfind(">"), 0, 0
        while (start := html.find("<", scan)) >= 0:
            found = self._markup(html, start, last)
            if found is None:
                scan = start + 1
                continue
            closing, name, attributes, end = found
            if start > at:
                self._text(html[at:start])
            at = scan = end
            if not name:
                continue
            name = name.lower()
            if closing:
                self._end(name)
                continue
            self._start(name, attributes)
            if name in _RAW_END:  # up to its end tag, this element holds no markup
                close = _RAW_END[name].search(html, at)
                at = scan = close.start() if close else len(html)
        self._text(html[at:])

    @staticmethod
    def _markup(html: str, start: int, last: int) -> tuple[str, str, str, int] | None:
        """(slash, tag, attributes, end) of the markup at ``start``, no tag for comments; None for a plain "<".

        A comment without an end goes to the end of the page. A tag whose quotes do not end stops at the next ">"; one
        without any ">" is text. ``last`` is the page's last ">", so no search is in vain and a page takes linear time.
        """
        if html.startswith("<!--", start):
            end = _COMMENT_END.search(html, start + 4)
            return "", "", "", end.end() if end else len(html)
        if start > last:
            return None
        named = _NAMED.match(html, start)
        if named:
            tag = _TAG.match(html, start)
            if tag:
                return tag[1], tag[2], tag[3], tag.end()
            end = html.index(">", start)
            return named[1], named[2], html[named.end() : end], end + 1
        if html[start + 1 : start + 2] in ("!", "?", "/") and html[start + 2 : start + 3] != ">":
            return "", "", "", html.index(">", start) + 1
        return None

    def _cut(self, k: int) -> None:
        self.open.subtract(self.tag[i] for i in self.stack[k:])
        del self.stack[k:]

    def _open(self, tag: str, attributes: str) -> int:
        node, up = len(self.tag), self.stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        if attributes:
            given = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(attributes)}
            names = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower()
            found = {_TOKEN_AT[w] for w in _PARTS.findall(names) if w in _TOKEN_AT}
            if found:
                self.tokens[node] = found
            if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
                self.hidden.append(node)
        return node

    def _break(self) -> None:
        self.block, self.run, self.link = self.block + 1, -1, False

    def _start(self, tag: str, attributes: str) -> None:
        if self.never and tag != "body":
            if tag in NEVER:
                self.never.append(tag)
            return
        if tag in NEVER:
            if not attributes.endswith("/"):
                self.never.append(tag)
            return
        self.never = []
        if tag == "html":
            return
        if tag in VOID:
            if tag == "br":
                self._text("\n")
            elif tag == "input":
                self.inputs.append(self.stack[-1])
            elif tag == "img":
                self.images.append(self.stack[-1])
            elif tag == "hr":
                self._break()
            return
        if tag in INLINE:
            if tag == "a":
                self.link = True
            if attributes and any(k in attributes for k in ("class", "id=", "role", "hidden")):
                self.stack.append(self._open(tag, attributes))
                self.open[tag] += 1
                self.run = -1
            return
        self._break()
        stack, names = self.stack, self.tag
        while names[stack[-1]] in INLINE or names[stack[-1]] == "p":
            self._cut(len(stack) - 1)
        ends = CLOSES.get(tag)
        if ends and any(self.open[t] > 0 for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                name = names[stack[k]]
                if name in ends:
                    self._cut(k)
                    break
                if name in SCOPE:
                    break
        stack.append(self._open(tag, attributes))
        self.open[tag] += 1

    def _end(self, tag: str) -> None:
        if self.never:
            if tag in self.never:
                while self.never.pop() != tag:
                    pass
            return
        if tag == "a":
            self.link = False
        if tag in ("body", "html") or tag in VOID:
            return
        inline = tag in INLINE
        if not inline:
            self._break()
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name == tag:
                self._cut(k)
                self.run = -1
                return
            if inline and name not in INLINE:
                return

    def _text(self, data: str) -> None:
        if self.never:
            return
        if "&" in data:
            data = unescape(data)
        if self.run < 0:
            if not data or data.isspace():
                if self.pieces and self.pieces[-1][1] == self.block:
                    node, block, text, link = self.pieces[-1]
                    self.pieces[-1] = (node, block, text + " ", link)
                return
            # an inline element with attributes decides for its own text
            self.run = self.stack[-1] if self.tag[self.stack[-1]] in INLINE else self._open("#run", "")
        self.pieces.append((self.run, self.block, data, self.link))


class PageNodes:
    """A page's nodes with parents before children, and its pieces of text."""

    def __init__(self, html: str, labelled: bool = False):
        b = _Builder(html)
        self.tag, self.parent, self.depth, self.tokens, self.hidden = b.tag, b.parent, b.depth, b.tokens, b.hidden
        self.main = np.zeros(len(b.tag), bool)
        if labelled:
            for node, _, text, _ in b.pieces:
                self.main[node] |= _MAIN in text
            b.pieces = [(n, k, t.replace(_MAIN, ""), a) for n, k, t, a in b.pieces]
            for i in range(len(b.tag) - 1, 0, -1):
                self.main[b.parent[i]] |= self.main[i]
        self.pieces, self.inputs, self.images = b.pieces, b.inputs, b.images

    def decode(self, open_log: np.ndarray, shut_log: np.ndarray) -> list[bool]:
        """The likeliest consistent choice: a node is open only below open nodes; a shut node shuts all below it.

        ``open_log`` and ``shut_log`` are each node's log probabilities given that its parent is open.
        """
        n, parent = len(self.tag), self.parent
        below, keep, open_log, shut_log = [0.0] * n, [False] * n, open_log.tolist(), shut_log.tolist()
        for i in range(n - 1, 0, -1):
            opened = open_log[i] + below[i]
            keep[i] = opened > shut_log[i]
            below[parent[i]] += max(opened, shut_log[i])
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[i] and keep[parent[i]]
        return keep

    def text(self, keep) -> str:
        blocks: list[list[str]] = []
        last = -1
        for node, block, text, _ in self.pieces:
            if keep[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n\n".join(b for b in joined if b)


def node_features(pages: list[PageNodes]) -> np.ndarray:
    """One row per node of all pages: sizes and densities of its subtree, place, siblings, tag, parent's tag, attribute parts."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = int(sizes.sum())
    parent = np.concatenate([np.array(p.parent) for p in pages]) + np.repeat(first, sizes)
    root = np.zeros(n, bool)
    root[first] = True
    parent[first] = first
    depth = np.concatenate([np.array(p.depth) for p in pages])
    tag = np.fromiter((_TAG_AT.get(t, -1) for p in pages for t in p.tag), np.int64, n)
    pieces = [(f + node, len(x := text.strip()), link, x.count(" ") + 1, x.count(".") + x.count(",") + x.count("!") + x.count("?")) for f, p in zip(first.tolist(), pages) for node, _, text, link in p.pieces]
    cells = np.array(pieces, np.float64).reshape(-1, 5)
    node = cells[:, 0].astype(np.int64)
    size, link = cells[:, 1], cells[:, 2]
    of_page = np.repeat(np.arange(len(pages)), [len(p.pieces) for p in pages])
    through = np.concatenate(([0.0], np.cumsum(size)))[:-1]
    base = np.zeros(len(pages))
    base[of_page[::-1]] = through[::-1]
    total = np.stack([np.bincount(node, w, n) for w in (size, size * link, cells[:, 3], cells[:, 4], np.ones(len(cells)))] + [np.ones(n), tag == _TAG_AT["p"], tag == _TAG_AT["li"]], axis=1)
    own_link = (total[:, 1] > 0.8 * np.maximum(total[:, 0], 1)) & (total[:, 0] > 0)
    extra = np.zeros((n, 3))
    extra[:, 0] = own_link
    for f, p in zip(first.tolist(), pages):
        for i in p.inputs:
            extra[f + i, 1] += 1
        for i in p.images:
            extra[f + i, 2] += 1
    total = np.concatenate((total, extra), axis=1)
    longest = total[:, 0].copy()
    start = np.full(n, np.inf)
    np.minimum.at(start, node, through - base[of_page])
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
    for d in range(len(cuts) - 2, -1, -1):
        here = by_depth[cuts[d] : cuts[d + 1]]
        np.add.at(total, parent[here], total[here])
        np.maximum.at(longest, parent[here], longest[here])
        np.minimum.at(start, parent[here], start[here])
    start[np.isinf(start)] = -1.0
    order = np.lexsort((np.arange(n), parent, root))
    order = order[: n - len(pages)]  # all but the roots, siblings together and in page order
    up = parent[order]
    new = np.concatenate(([True], up[1:] != up[:-1])) if len(up) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    index, count, mean, before, after, same = (np.zeros(n) for _ in range(6))
    if len(up):
        kids = np.diff(np.concatenate((heads, [len(up)])))
        letters = total[order, 0]
        index[order] = np.arange(len(up)) - heads[group]
        count[order] = kids[group]
        mean[order] = (np.bincount(group, letters) / kids)[group]
        before[order[1:]] = np.where(new[1:], 0, letters[:-1])
        after[order[:-1]] = np.where(new[1:], 0, letters[1:])
        _, which, times = np.unique(group * (len(TAGS) + 2) + tag[order], return_inverse=True, return_counts=True)
        same[order] = times[which]
    letters, words = np.maximum(total[:, 0], 1.0), np.maximum(total[:, 2], 1.0)
    whole = np.maximum(total[np.repeat(first, sizes), 0], 1.0)
    numeric = (
        np.log1p(total[:, 0]), total[:, 1] / letters, np.log1p(total[:, 2]), total[:, 3] / words, np.log1p(total[:, 4]), np.log1p(longest), total[:, 0] / np.maximum(total[:, 4], 1),
        letters / total[:, 5], np.log1p(total[:, 5]), total[:, 6], total[:, 7], total[:, 8] / np.maximum(total[:, 4], 1), total[:, 9], total[:, 10], depth, index, count,
        same / np.maximum(count, 1), total[:, 0] / np.maximum(total[parent, 0], 1), total[:, 0] / whole, start / whole, np.log1p(before), np.log1p(after), letters / np.maximum(mean, 1),
    )
    out = np.zeros((n, WIDTH), np.float32)
    for k, x in enumerate(numeric):
        out[:, k] = x
    known = np.flatnonzero(tag >= 0)
    out[known, _NUMERIC + tag[known]] = 1
    above = np.where(root, -1, tag[parent])
    known = np.flatnonzero(above >= 0)
    out[known, _NUMERIC + len(TAGS) + above[known]] = 1
    at = _NUMERIC + 2 * len(TAGS)
    for f, p in zip(first.tolist(), pages):
        for i, found in p.tokens.items():
            for k in found:
                out[f + i, at + k] = 1
        for i in p.hidden:
            out[f + i, at + _TOKEN_AT["hidden"]] = 1
    return out


def _semantic_main(html: str) -> list[str] | None:
    """The blocks of the page's ``article`` or ``main`` element, without what such an element may not hold; None without one."""
    page = PageNodes(html)
    for name in ("article", "main"):
        inside = np.zeros(len(page.tag), bool)
        for i in range(1, len(page.tag)):
            off = page.tag[i] in ("nav", "header", "footer", "aside", "form")
            inside[i] = not off and (inside[page.parent[i]] or page.tag[i] == name)
        found = page.text(inside).split("\n\n") if inside.any() else [""]
        if found != [""]:
            return found
    return None


def _densest_main(html: str) -> list[str] | None:
    """The blocks of the smallest subtree that holds most of the text outside links; None for a page without text.

    From the root down, the child with at least 0.6 of its parent's text is followed.
    """
    page = PageNodes(html)
    n = len(page.tag)
    size = np.zeros(n)
    for node, _, text, link in page.pieces:
        size[node] += 0 if link else len(text.strip())
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
    best = np.zeros(n, np.int64)  # each node's child with the most text
    for i in range(1, n):
        up = page.parent[i]
        if best[up] == 0 or size[i] > size[best[up]]:
            best[up] = i
    at = 0
    while best[at] and page.tag[best[at]] != "#run" and size[best[at]] >= 0.6 * size[at]:
        at = int(best[at])
    inside = np.zeros(n, bool)
    inside[at] = True
    for i in range(at + 1, n):
        inside[i] = inside[page.parent[i]] and page.tag[i] not in ("nav", "header", "footer", "aside", "form")
    return [t for t in page.text(inside).split("\n\n") if t] or None


def _other_text(html: str) -> list[str]:
    """The blocks of the page outside its ``article`` and ``main`` elements."""
    page = PageNodes(html)
    outside = np.ones(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        outside[i] = outside[page.parent[i]] and page.tag[i] not in ("article", "main")
    return [t for t in page.text(outside).split("\n\n") if t]


def _pick(rng, items):
    return items[int(rng.integers(len(items)))]


def _wrap(rng, tag: str, names: list[str], inner: str) -> str:
    kind = rng.random()
    name = _pick(rng, names)
    extra = _pick(rng, ["", "", "", " block", " box", " clearfix", " inner"])
    attr = f' class="{name}{extra}"' if kind < 0.7 else f' id="{name}"' if kind < 0.85 else f' class="{name}" id="{name}"' if kind < 0.9 else ""
    if tag == "div" and not attr:
        attr = f' class="{name}"'
    return f"<{tag}{attr}>{inner}</{tag}>"


def _clutter(rng, kind: str, texts: list[str]) -> str:
    """A made-up part of a page that is not main text, from the given texts."""
    line = lambda: _pick(rng, texts)
    words = lambda k: " ".join(line().split()[:k])
    links = "".join(f'<li><a href="/x">{words(int(rng.integers(1, 5)))}</a></li>' for _ in range(int(rng.integers(3, 9))))
    bare = " ".join(f'<a href="/x">{words(2)}</a>' for _ in range(int(rng.integers(3, 8))))
    paragraphs = lambda most: "".join(f"<p>{line()}</p>" for _ in range(int(rng.integers(1, most + 1))))
    if kind == "menu":
        return _pick(rng, [f"<nav><ul>{links}</ul></nav>", _wrap(rng, "nav", ["nav", "menu"], bare), _wrap(rng, "div", ["nav", "menu", "navbar", "breadcrumbs", "topbar menu"], _pick(rng, [f"<ul>{links}</ul>", bare]))])
    if kind == "header":
        inner = f"<{_pick(rng, ['h1', 'h2', 'p', 'div'])}>{words(6)}</{_pick(rng, ['h1', 'h2', 'p', 'div'])}>" + (f"<ul>{links}</ul>" if rng.random() < 0.5 else f"<p>{line()}</p>")
        return _wrap(rng, _pick(rng, ["header", "header", "div"]), ["header", "site-header", "masthead", "banner", "topbar"], inner)
    if kind == "footer":
        return _wrap(rng, _pick(rng, ["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "legal"], _pick(rng, [f"&copy; {line()}", f"<p>&copy; {words(5)}</p>{bare}", paragraphs(3)]))
    if kind == "sidebar":
        inner = f"<h3>{words(4)}</h3>" + _pick(rng, [f"<ul>{links}</ul>", paragraphs(4), f"<div>{line()}</div>"])
        return _wrap(rng, _pick(rng, ["aside", "div", "div", "section"]), ["sidebar", "side-bar", "widget", "related", "related-posts", "trending", "popular", "recommended"], inner)
    if kind == "notice":
        return _wrap(rng, _pick(rng, ["div", "div", "section", "aside", "p"]), ["notice", "cookie-notice", "cookie-banner", "cookies", "gdpr consent", "alert", "message", "paywall", "popup"], _pick(rng, [line(), f"<p>{line()}</p><button>OK</button>", f"<p>{line()}</p>"]))
    if kind == "advert":
        return _wrap(rng, _pick(rng, ["div", "div", "aside", "section", "p"]), ["ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo", "sponsor"], _pick(rng, [line(), f"<p>{line()}</p>", f'<a href="/x">{line()}</a>', f'<img src="/x"><p>{words(9)}</p>']))
    if kind == "form":
        inner = f'<label>{words(3)}</label><input name="q"><button>{words(1)}</button>' + (f"<p>{line()}</p>" if rng.random() < 0.5 else "")
        return _pick(rng, [f"<form>{inner}</form>", _wrap(rng, "form", ["search", "newsletter", "login", "subscribe", "signup"], inner), _wrap(rng, "div", ["newsletter", "subscribe", "signup"], f"<p>{words(12)}</p><form>{inner}</form>")])
    if kind == "share":
        return _wrap(rng, _pick(rng, ["div", "ul", "p"]), ["share", "social", "share-buttons", "tags", "follow", "pager", "pagination"], bare)
    each = "".join(_wrap(rng, _pick(rng, ["div", "li", "article"]), ["comment", "comment-body", "reply"], f"{_pick(rng, ['', f'<b>{words(1)}</b> '])}<p>{line()}</p>" + (f"<p>{line()}</p>" if rng.random() < 0.3 else "")) for _ in range(int(rng.integers(1, 6))))
    title = f"<h3>{words(2)}</h3>" if rng.random() < 0.6 else ""
    return _wrap(rng, _pick(rng, ["section", "div", "div", "ol"]), ["comments", "comment-list", "comments-area", "responses comments", "discussion", "disqus"], title + each)


def _main_html(rng, blocks: list[str], texts: list[str]) -> str:
    """The blocks as marked main text, with clutter between some of them."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    out = []
    for k, block in enumerate(blocks):
        text = _MAIN + escape(block)
        if k == 0 and rng.random() < 0.8:
            out.append(f"<h1>{text}</h1>")
            continue
        style = rng.random()
        words = text.split(" ")
        if style < 0.08 and len(words) > 8:
            cut = len(words) // 2
            text = " ".join(words[: cut - 2]) + f' <a href="/y">{" ".join(words[cut - 2 : cut])}</a> ' + " ".join(words[cut:])
        elif style < 0.16:
            text = f"<b>{text}<br>" if style < 0.12 else f"<em>{text}</em>"
        if style > 0.96:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif style > 0.92:
            out.append("<ul>" + "".join(f"<li>{_MAIN}{x}</li>" for x in text.replace(_MAIN, "").split(". ") if x) + "</ul>")
        elif style > 0.88 and len(words) < 15:
            out.append(f"<{_pick(rng, ['h2', 'h3'])}>{text}</h2>")
        elif style > 0.84:
            out.append(f"<div>{text}</div>")
        elif style > 0.82:
            out.append(f"<table><tr><td>{text}</td><td>{_MAIN}{escape(_pick(rng, blocks))}</td></tr></table>")
        else:
            out.append(f"<p>{text}" + ("" if rng.random() < 0.1 else "</p>"))
        if rng.random() < 0.12:
            out.append(_clutter(rng, _pick(rng, ["advert", "advert", "notice", "share", "sidebar", "form"]), texts))
    return "".join(out)


def training_page(rng, blocks: list[str], texts: list[str]) -> str:
    """A page of a random template around marked main text."""
    if rng.random() < 0.2:
        blocks = blocks[: int(rng.integers(1, 4))]
    inner = _main_html(rng, blocks, texts)
    if rng.random() < 0.25:
        inner += _clutter(rng, "comments", texts)
    names = ["content", "article", "article-body", "post", "post-body", "entry", "entry-content", "story", "main-content", "main", "text", "body"]
    main = _pick(rng, [f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", _wrap(rng, "div", names, inner), _wrap(rng, "section", names, inner), _wrap(rng, "article", names, inner), inner])
    before = [_clutter(rng, k, texts) for k in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.5]
    after = [_clutter(rng, k, texts) for k in ("sidebar", "comments", "share", "advert", "form", "notice") if rng.random() < 0.4]
    if rng.random() < 0.8:
        after.append(_clutter(rng, "footer", texts))
    if rng.random() < 0.3:
        after, before = after[1:], before + after[:1]
    body = "".join(before) + main + "".join(after)
    if rng.random() < 0.4:
        body = _wrap(rng, "div", ["page", "container", "wrapper", "layout"], body)
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def fit_pages(pages: list[str], variants: int = 8, seed: int = 0) -> Trees:
    """Fit the node classifier on pages with an ``article`` or ``main`` element, as they are and in ``variants`` other templates.

    Where no page has one, the densest subtree of each page stands for it, in the other templates only.
    Only nodes whose parent is open, that is holds main text, are examples: the classifier answers whether a node is
    open given that its parent is.
    """
    rng = np.random.default_rng(seed)
    mains = [(html, m) for html in pages if (m := _semantic_main(html))]
    named = bool(mains)
    mains = mains or [(html, m) for html in pages if (m := _densest_main(html))]
    texts = [t for html in pages for t in _other_text(html)]
    texts += [s for _, m in mains for b in m for s in [" ".join(b.split()[: int(rng.integers(4, 40))])] if s]
    x, y = [], []
    for html, blocks in mains:
        for k in range(0 if named else 1, variants + 1):
            page = PageNodes(training_page(rng, blocks, texts), labelled=True) if k else PageNodes(html)
            main = page.main
            if not k:
                for i in range(1, len(page.tag)):
                    off = page.tag[i] in ("nav", "header", "footer", "aside", "form")
                    main[i] = not off and (main[page.parent[i]] or page.tag[i] in ("article", "main"))
                text = np.zeros(len(page.tag), bool)
                text[[p[0] for p in page.pieces]] = True
                main &= text
                for i in range(len(page.tag) - 1, 0, -1):
                    main[page.parent[i]] |= main[i]
            asked = np.flatnonzero(main[page.parent])
            asked = asked[asked > 0]
            x.append(node_features([page])[asked])
            y.append(main[asked].astype(float))
    return fit_trees(np.concatenate(x), np.concatenate(y)) if x else fit_trees(np.zeros((0, WIDTH)), np.zeros(0))


def extract(trees: Trees, pages: list[str]) -> list[str]:
    """The main text of each page."""
    parsed = [PageNodes(p) for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(node_features(parsed))
    open_log, shut_log = -np.logaddexp(0.0, -odds), -np.logaddexp(0.0, odds)
    out, at = [], 0
    for p in parsed:
        n = len(p.tag)
        out.append(p.text(p.decode(open_log[at : at + n], shut_log[at : at + n])))
        at += n
    return out


def train(pages: DataFrame, sample: int = 200, html_col: str = "html") -> Trees:
    """Fit on at most about ``sample`` pages, those with the smallest hash of their html, in one task; copies count once."""
    d = columns_of(pages, html_col).where(F.col(html_col).isNotNull())
    share = min(1.0, sample / max(1, d.count()))
    few = d.where(F.pmod(F.xxhash64(html_col), F.lit(1_000_003)) < int(1_000_003 * share) + 1).select(F.lit("").alias("id"), F.col(html_col).alias("html")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([pd.DataFrame({"id": [], "html": []}), *frames]).sort_values(["id", "html"])
        t = fit_pages(part["html"].tolist())
        yield pd.DataFrame({"model": [pickle.dumps((t.feature, t.threshold, t.leaf, t.base))]})

    found = few.repartition(1).mapInPandas(run, "model binary").head()
    return Trees(*pickle.loads(found["model"])) if found else fit_pages([])


def main_text(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    The text holds the blocks of the page's open nodes in page order, joined by two line feeds; character references
    are decoded and white space inside a block is one space. Null and empty pages give the empty text. Ids may be null
    or repeat; further columns are ignored; an empty input gives no row. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html", 1 << 20):
            texts = extract(trees, [h or "" for h in part.column("html").to_pylist()])
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = columns_of(pages, id_col, url_col, html_col)
    d = d.select(d[id_col].cast("long").alias("page_id"), d[url_col].cast("string").alias("url"), d[html_col].cast("string").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
