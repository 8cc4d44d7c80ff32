"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the text runs in them are nodes with two states, content or not. Each node has a potential from its own features (tag, words of class, id and role,
length, share of links, end of sentence), each parent and child share one that depends on the child's kind. Sum-product messages up
and then down the tree give each text run's marginal; runs over one half are the page's text.

The potentials come from labelled pages that `labelled_pages` makes: layouts with and without semantic tags, in which each text run is known to be article text
or menu, header, footer, sidebar, notice, advert, form or comment.

Edge cases: null and empty pages, and pages without content, give the empty text; broken markup (unclosed tags and comments, stray end
tags, bare '<') is parsed as far as it goes, and only script, style, iframe, textarea and title without an end tag take the rest of the page; what is in <head> or hidden (the hidden attribute, display: none, visibility: hidden) is no text; null page_id or url stay; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factweave.llm.util import ship, slices

MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that may hide an element; what is hidden is no text of the page.
MAY_HIDE = re.compile(r"hidden|display|visibility", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose contents aren't markup: they end at their end tag only, as HTML has it.
RAW = frozenset("script style iframe textarea title".split())
#: Elements with markup inside whose contents are never text of the page. One that isn't closed itself ends with its parent, and only its own text up to the first block in it is left out.
SILENT = frozenset("noscript template svg object canvas video audio select option button".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta base source track param area br svg picture map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags before which an open element of these names ends.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
KINDS = {**dict.fromkeys("p blockquote pre figure figcaption".split(), "prose"), **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "heading"), **dict.fromkeys("ul ol li dl dt dd".split(), "list"), **dict.fromkeys("table thead tbody tfoot tr td th caption".split(), "table"), **dict.fromkeys("article main".split(), "article"), **dict.fromkeys("nav footer header aside form dialog menu".split(), "frame"), "#": "run"}
KIND_NAMES = ("prose", "heading", "list", "table", "article", "frame", "run", "box")


def attribute_values(attributes: str) -> Iterator[tuple[str, str]]:
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def hides(attributes: str) -> bool:
    return bool(MAY_HIDE.search(attributes)) and any(k == "hidden" and v.lower() != "until-found" or k == "style" and UNSEEN.search(v) for k, v in attribute_values(attributes))


class Silent:
    """An open silent element: what there was before it. `before` are its pieces, once they are a run of their own."""

    __slots__ = ("name", "nodes", "depth", "inline", "pieces", "links", "in_link", "head", "before")

    def __init__(self, *values):
        self.name, self.nodes, self.depth, self.inline, self.pieces, self.links, self.in_link, self.head = values
        self.before: list[str] | None = None


class Tree:
    """Nodes in page order: parent, tag, features; runs also have their text."""

    def __init__(self, page: str):
        self.parent, self.tag, self.words, self.text, self.links = [-1], ["#page"], [()], [None], [0]
        self.unseen = [False]  # hidden, or inside something hidden
        stack, pieces, links, in_link, at, head = [0], [], 0, 0, 0, False
        silent: list[Silent] = []
        heard = 0  # how many of them have had their own text left out, as a block began or ended in them
        inline: list[str] = []  # open inline elements of this block
        opened: dict[str, int] = {}  # how many elements of a name are open, so that a stray end tag costs nothing
        lines: dict[str, int] = {}  # the same of inline elements
        unheard: dict[str, int] = {}  # and of silent ones

        def cut(depth: int) -> None:
            for i in stack[depth:]:
                opened[self.tag[i]] -= 1
            del stack[depth:]

        def close_inline(depth: int) -> None:
            for x in inline[depth:]:
                lines[x] -= 1
            del inline[depth:]

        def flush() -> None:
            nonlocal links
            if pieces:
                run = " ".join(unescape("".join(pieces)).split())
                if run:
                    self.unseen.append(self.unseen[stack[-1]])
                    self.parent.append(stack[-1])
                    self.tag.append("#")
                    self.words.append(())
                    self.text.append(run)
                    self.links.append(min(links, len(run)))
                pieces.clear()
            links = 0

        def text(piece: str) -> None:
            nonlocal links
            if piece:
                pieces.append(piece)
                if in_link:
                    links += len(piece.strip())

        def leave_out() -> None:
            """The text of open silent elements before the first block in them. What an inner one goes back to lacks the outer one's text."""
            nonlocal links, heard
            if heard < len(silent):
                e = silent[heard]
                del pieces[e.pieces :]
                links, before = e.links, pieces[:]
                for e in silent[heard:]:
                    e.before, e.links = before, links
                heard = len(silent)

        def end_silent(k: int, whole: bool) -> None:
            """The k-th and those in it: closed by its own end tag, so that all of it is left out, or as something around it ended."""
            nonlocal links, in_link, head, heard
            e = silent[k]
            if whole:
                cut(e.depth)
                close_inline(e.inline)
                for column in (self.parent, self.tag, self.words, self.text, self.links, self.unseen):
                    del column[e.nodes :]
                in_link, head = e.in_link, e.head
            if whole and e.before is not None:
                pieces[:], links = e.before, e.links
            elif heard <= k:
                del pieces[e.pieces :]
                links = e.links
            for x in silent[k:]:
                unheard[x.name] -= 1
            del silent[k:]
            heard = min(heard, k)

        def begin_silent(name: str) -> None:
            unheard[name] = unheard.get(name, 0) + 1
            silent.append(Silent(name, len(self.tag), len(stack), len(inline), len(pieces), links, in_link, head))

        def ended() -> None:
            """Silent elements end with the element that they are in."""
            while silent and silent[-1].depth > len(stack):
                end_silent(len(silent) - 1, False)
            if not silent:
                close_inline(0)

        m = MARKUP.search(page)
        while m:
            text(page[at : m.start()] if not head else "")
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if name:
                end, attributes = m[1] or m[4], m[3] or m[6] or ""
                if name in RAW:
                    if not end and not attributes.endswith("/"):
                        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                        at = close.end() if close else len(page)
                elif name in SILENT:
                    k = next((k for k in range(len(silent) - 1, -1, -1) if silent[k].name == name), -1) if unheard.get(name) else -1
                    if k >= 0 and (end or name in ("option", "button")):  # neither of the two holds another of its kind
                        end_silent(k, bool(end))
                    if not end and not attributes.endswith("/"):
                        begin_silent(name)
                elif name == "head":
                    head = not end
                elif name in INLINE:
                    if not end and name not in VOID:
                        inline.append(name)
                        lines[name] = lines.get(name, 0) + 1
                        if hides(attributes):  # left out up to its end
                            begin_silent("#hidden")
                    elif end and lines.get(name):
                        close_inline(len(inline) - 1 - inline[::-1].index(name))
                        while silent and silent[-1].inline > len(inline):
                            end_silent(len(silent) - 1, False)
                    if name == "a":
                        in_link = 0 if end else 1
                    elif name == "br" or name in MATH:
                        pieces.append(" ")
                elif end:
                    leave_out()
                    flush()
                    in_link = 0
                    if opened.get(name):
                        cut(next(i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == name))
                    ended()
                else:
                    leave_out()
                    flush()
                    in_link, head = 0, False
                    least = silent[-1].depth if silent else 1  # what is in a silent element ends nothing around it
                    for x in ENDS.get(name, ("p",)):
                        while len(stack) > least and self.tag[stack[-1]] == x:
                            cut(len(stack) - 1)
                    if not silent:
                        close_inline(0)
                    words: tuple = ()
                    if attributes.strip("/ "):
                        found = []
                        for k, value in attribute_values(attributes):
                            if k in ("class", "id", "role"):
                                found += [t.lower() for t in TOKEN.findall(value)]
                        words = tuple(dict.fromkeys(found))
                    self.unseen.append(self.unseen[stack[-1]] or hides(attributes))
                    self.parent.append(stack[-1])
                    self.tag.append(name)
                    self.words.append(words)
                    self.text.append(None)
                    self.links.append(0)
                    if name not in VOID:
                        opened[name] = opened.get(name, 0) + 1
                        stack.append(len(self.tag) - 1)
            m = MARKUP.search(page, at)
        text(page[at:] if not head else "")
        leave_out()
        flush()

    def features(self) -> list[list[str]]:
        """Of each node. An element's length is that of all its runs."""
        n = len(self.tag)
        size, links = [0] * n, self.links
        for i in range(n - 1, 0, -1):
            if self.text[i] is not None:
                size[i] = len(self.text[i])
            size[self.parent[i]] += size[i]
        out = []
        for i in range(n):
            if self.text[i] is not None:
                out.append([f"run {min(size[i].bit_length(), 9)}", f"links {4 * links[i] // max(1, size[i])}"])
            else:
                out.append([f"{'semantic' if KINDS.get(self.tag[i]) in ('article', 'frame') else 'tag'} {self.tag[i]}", f"size {min(size[i].bit_length(), 12) // 2}", *(f"word {w}" for w in self.words[i] or ("(none)",) * (self.tag[i] in ("div", "section")))])
        return out


class Model:
    """node: log-odds of content for each feature; edge: for each kind of child, P(child's state | parent's state)."""

    def __init__(self, node: dict[str, float], edge: dict[str, tuple], prior: float):
        self.node, self.edge, self.prior = node, edge, prior

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node, exact on the tree: messages from leaves to root, then back."""
        n = len(tree.tag)
        own = [min(1 - 1e-9, max(1e-9, 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.node.get(f, 0.0) for f in fs))))))) for fs in tree.features()]
        on, off = list(own), [1 - x for x in own]  # a node's belief from below
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        edges = [self.edge[KINDS.get(t, "box")] for t in tree.tag]
        for i in range(n - 1, 0, -1):
            e, s = edges[i], on[i] + off[i]
            a, b = on[i] / s, off[i] / s
            m1, m0 = e[1] * a + (1 - e[1]) * b, e[0] * a + (1 - e[0]) * b  # to a parent that is content, that is not
            up[i] = (m1, m0)
            p = tree.parent[i]
            on[p] *= m1
            off[p] *= m0
            if on[p] + off[p] < 1e-200:
                on[p], off[p] = on[p] * 1e200, off[p] * 1e200
        result = [0.0] * n
        a, b = on[0] * self.prior, off[0] * (1 - self.prior)
        result[0] = a / (a + b)
        for i in range(1, n):
            q = result[tree.parent[i]]
            # the parent's belief without what came from this child
            a, b = q / max(up[i][0], 1e-300), (1 - q) / max(up[i][1], 1e-300)
            s = a + b
            a, b = a / s, b / s
            e = edges[i]
            x, y = on[i] * (e[1] * a + e[0] * b), off[i] * ((1 - e[1]) * a + (1 - e[0]) * b)
            result[i] = x / (x + y) if x + y > 0 else 0.5
        return result

    def text(self, page: str) -> str:
        tree = Tree(page)
        return "\n".join(t for t, p, gone in zip(tree.text, self.marginals(tree), tree.unseen, strict=True) if t is not None and p > 0.5 and not gone)


# --- labelled pages ----------------------------------------------------------------------------------------------------------

#: Class words of typical layouts, for content and for what surrounds it.
CONTENT_WORDS = "content article post entry main story body text page single prose blog news detail copy markdown".split()
OTHER_WORDS = {
    "nav": "nav menu navbar navigation topbar breadcrumb breadcrumbs links toc pagination pager tabs".split(),
    "header": "header masthead logo branding top site banner".split(),
    "footer": "footer foot copyright legal bottom colophon credits".split(),
    "aside": "sidebar aside widget related recommended popular trending archive tags side".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay banner disclaimer privacy".split(),
    "form": "form search login signup subscribe newsletter register contact".split(),
    "comments": "comments comment reply replies respond discussion disqus thread feedback reader".split(),
    "share": "share social sharing follow like tweet buttons".split(),
}
MARK = "\ue000"


def labelled_pages(n: int = 900, seed: int = 11) -> Iterator[str]:
    """Pages whose article text carries MARK at the start of each run."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def say(lo: int, hi: int, stop: float = 1.0) -> str:
        return (" ".join(word() for _ in range(r.randint(lo, hi)))).capitalize() + ("." if r.random() < stop else "")

    def attribute(words: list[str], often: float) -> str:
        if r.random() > often:
            return ""
        return f' {r.choice(("class", "class", "class", "id"))}="{" ".join(r.sample(words, min(len(words), r.choice((1, 1, 2)))))}"'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{say(1, 3, 0.1)}</a></li>' for _ in range(k))

    def block(kind: str, often: float) -> str:
        words = OTHER_WORDS[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section")
        named = r.random() < 0.6
        open_ = f"{tag}{attribute(words, 0.3)}" if named and tag != "section" else f"div{attribute(words, 1.0)}"
        inner = {
            "nav": lambda: f"<ul>{links(r.randint(3, 9))}</ul>" if r.random() < 0.8 else " | ".join(f"<a href=#>{say(1, 2, 0)}</a>" for _ in range(5)),
            "header": lambda: f"<div>{say(1, 4, 0)}</div><p>{say(3, 9, 0.5)}</p>" + r.choice(("", f"<ul>{links(4)}</ul>")),
            "footer": lambda: r.choice((f"&copy; {word()} {say(3, 15)}", f"<p>&copy; {say(2, 6)}</p><p>{say(5, 20)}</p>", f"<ul>{links(5)}</ul><p>{say(4, 9)}</p>")),
            "aside": lambda: f"<h3>{say(1, 3, 0)}</h3>" + r.choice((f"<ul>{links(r.randint(2, 7))}</ul>", f"<p>{say(5, 30)}</p>", f"<p>{say(8, 20)}</p><p>{say(8, 20)}</p>")),
            "ad": lambda: r.choice((say(3, 14), f"<p>{say(4, 20)}</p>", f"<a href=#>{say(3, 8, 0.5)}</a>")),
            "notice": lambda: f"<p>{say(6, 30)}</p>" + r.choice(("", f"<a href=#>{say(1, 2, 0)}</a>")),
            "form": lambda: f"<label>{say(1, 4, 0)}</label><input name=q>" + r.choice(("", f"<p>{say(3, 12)}</p>")),
            "comments": lambda: f"<h3>{say(1, 2, 0)}</h3>" + "".join(f'<{t}{attribute(words, 0.7)}><p>{say(3, 40)}</p></{t}>' for t in (r.choice(("div", "li", "div", "li", "div", "article")) for _ in range(r.randint(1, 6)))),
            "share": lambda: f"<ul>{links(3)}</ul>" if r.random() < 0.5 else say(1, 4, 0),
        }[kind]()
        return f"<{open_}>{inner}</{open_.split()[0]}>"

    def prose(brief: bool) -> str:
        x = r.random()
        text = MARK + say(*r.choice(((1, 4), (2, 9)) if brief else ((1, 4), (8, 30), (20, 60), (30, 120))), 0.9)
        if r.random() < (0.1 if brief else 0.3):
            text += f" <a href=/{word()}>{say(1, 3, 0)}</a> {say(3, 10)}"
        if x < 0.72:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>"
        if x < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{MARK}{say(1, 8, 0.2)}</h{k}>"
        if x > 0.99:
            return f"<figure><img src=a.png><figcaption>{MARK}{say(2, 20, 0.5)}</figcaption></figure>"
        if x < 0.88:
            return f"<ul>{''.join(f'<li>{MARK}{say(2, 20, 0.6)}</li>' for _ in range(r.randint(2, 5)))}</ul>"
        if x < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if x < 0.95:
            return f"<table><tr><td>{MARK}{say(1, 4, 0)}<td>{MARK}{say(1, 4, 0)}</tr></table>"
        return f"<div>{text}</div>" if x < 0.98 else f"<pre>{text}</pre>"

    for _ in range(n):
        often, brief = r.random(), r.random() < 0.25
        body = [f"<h1>{MARK}{say(2, 10, 0.3)}</h1>"] * (r.random() < 0.85) + [prose(brief) for _ in range(r.choice((1, 1, 2, 3, 40, 150) if brief else (1, 2, 4, 8, 15, 30)))]
        for kind in ("ad", "share", "aside", "form", "notice", "nav", "comments"):
            if r.random() < 0.15:
                body.insert(r.randint(1, len(body)), block(kind, often))
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        core = f"<{tag}{attribute(CONTENT_WORDS, 0.4 if tag in ('article', 'main') else 0.9)}>{''.join(body)}</{tag}>"
        if r.random() < 0.4:
            core = f"<{(t := r.choice(('div', 'main', 'section')))}{attribute(CONTENT_WORDS, 0.6)}>{core}{block(r.choice(('comments', 'aside', 'share')), often) if r.random() < 0.6 else ''}</{t}>"
        before = [block(k, often) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        after = [block(k, often) for k in ("comments", "aside", "share", "ad", "form", "footer") if r.random() < 0.5]
        if r.random() < 0.2:
            r.shuffle(before)
        page = "".join(before) + core + "".join(after)
        yield f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title></head><body>{f'<div id=wrap>{page}</div>' if r.random() < 0.3 else page}</body></html>"


class Labelled:
    """Trees with the state of each node, as arrays over all nodes of all pages; an element is content if any of its text is. Nodes without text have no state to learn from."""

    def __init__(self, pages: Iterator[str]):
        parent, depth, kind, state, known, rows, names = [], [], [], [], [], [], {}
        for page in pages:
            tree, base = Tree(page), len(parent)
            n = len(tree.tag)
            yes, size = [0] * n, [0] * n
            for i in range(n - 1, -1, -1):
                if tree.text[i] is not None:
                    hit = tree.text[i].startswith(MARK)
                    tree.text[i] = tree.text[i].replace(MARK, "")
                    size[i] = len(tree.text[i])
                    yes[i] = size[i] * hit
                if i:
                    yes[tree.parent[i]] += yes[i]
                    size[tree.parent[i]] += size[i]
            for i, fs in enumerate(tree.features()):
                parent.append(base + tree.parent[i] if i else -1)
                depth.append(depth[parent[-1]] + 1 if i else 0)
                kind.append(KIND_NAMES.index(KINDS.get(tree.tag[i], "box")))
                state.append(yes[i] > 0)
                known.append(size[i] > 0)
                rows += [(base + i, names.setdefault(f, len(names))) for f in fs]
        self.parent, self.depth, self.kind = (np.array(x, np.int64) for x in (parent, depth, kind))
        self.state, self.known, self.names = np.array(state, bool), np.array(known, bool), list(names)
        self.node, self.feature = np.array(rows, np.int64).reshape(-1, 2).T
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)]

    def shares(self) -> tuple[np.ndarray, float]:
        """P(content | the parent's state) for each kind of child, smoothed, and P(content) of roots."""
        inner = self.known & (self.parent >= 0)
        counts = np.ones((len(KIND_NAMES), 2, 2))
        np.add.at(counts, (self.kind[inner], self.state[self.parent[inner]].astype(int), self.state[inner].astype(int)), 1)
        roots = self.state[self.parent < 0]
        return counts[:, :, 1] / counts.sum(axis=2), (roots.sum() + 1) / (len(roots) + 2)

    def marginals(self, odds: np.ndarray, edge: np.ndarray, prior: float) -> np.ndarray:
        """P(content) of all nodes at given log-odds of their own: messages level by level, upward in logarithms, then downward."""
        on, off = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        up = np.zeros((len(odds), 2))  # a child's message to a parent that isn't content, that is
        for level in reversed(self.levels[1:]):
            a, b = on[level], off[level]
            for parent in (0, 1):
                e = edge[self.kind[level], parent]
                up[level, parent] = np.logaddexp(np.log(e) + a, np.log1p(-e) + b)
            np.add.at(on, self.parent[level], up[level, 1])
            np.add.at(off, self.parent[level], up[level, 0])
        p = np.zeros(len(odds))
        for d, level in enumerate(self.levels):
            if not d:
                x, y = np.log(prior) + on[level], np.log1p(-prior) + off[level]
            else:
                q, e = np.clip(p[self.parent[level]], 1e-12, 1 - 1e-12), edge[self.kind[level]]
                a, b = np.log(q) - up[level, 1], np.log1p(-q) - up[level, 0]
                x = on[level] + np.logaddexp(a + np.log(e[:, 1]), b + np.log(e[:, 0]))
                y = off[level] + np.logaddexp(a + np.log1p(-e[:, 1]), b + np.log1p(-e[:, 0]))
            p[level] = 1 / (1 + np.exp(np.clip(y - x, -500, 500)))
        return p


#: Steps of training and their size.
STEPS, RATE = 150, 0.05


def train(pages: Iterator[str]) -> Model:
    """Edge potentials are the shares of children's states by their parents'. A node's own potential is the sum of its features' log-odds, each kind of feature (tag, class words, size, links, ...) with a
    weight, as features of a node and of its runs overlap. These weights climb the likelihood of all states given the trees: the gradient of one is, over all nodes, the sum of state less marginal
    times the node's log-odds of that kind, and the marginals come from the messages. Steps are scaled by each weight's past gradients."""
    t = Labelled(pages)
    edge, prior = t.shares()
    seen = t.known[t.node]
    counts = np.ones((2, len(t.names)))
    np.add.at(counts, (t.state[t.node[seen]].astype(int), t.feature[seen]), 1)
    total = np.array([2 + (t.known & ~t.state).sum(), 2 + (t.known & t.state).sum()], float)
    odds = np.log(counts[1] / total[1]) - np.log(counts[0] / total[0])
    groups = list(dict.fromkeys(f.split()[0] for f in t.names))
    of = np.array([groups.index(f.split()[0]) for f in t.names])
    each = np.zeros((len(t.parent), len(groups)))
    np.add.at(each, (t.node, of[t.feature]), odds[t.feature])
    weight, past = np.full(len(groups), 0.5), np.full(len(groups), 1e-9)
    for _ in range(STEPS):
        rest = np.where(t.known, t.state - t.marginals(each @ weight, edge, prior), 0.0)
        gradient = rest @ each
        past = 0.9 * past + 0.1 * gradient**2
        weight = np.maximum(0.0, weight + RATE * gradient / np.sqrt(past))
    return Model(dict(zip(t.names, (weight[of] * odds).tolist(), strict=True)), {k: tuple(edge[i]) for i, k in enumerate(KIND_NAMES)}, float(prior))


_models: dict[str, Model] = {}


def default_model() -> Model:
    if "" not in _models:
        _models[""] = train(labelled_pages())
    return _models[""]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text for each row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [shared.value.text(h) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")
