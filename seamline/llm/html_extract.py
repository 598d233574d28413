"""HTML extraction by gradient-boosted trees over DOM nodes.

A forgiving parser builds the tree of block elements. Every node is described by its subtree's density of text, links
and punctuation, by the tokens of its attributes and those of its ancestors, by depth, and by its siblings. Boosted
trees, trained here on generated pages, give each node's chance of being main text. Decoding is hierarchical: the kept
nodes form a tree from the root, chosen to maximise the joint likelihood, so nothing is kept inside what is dropped.

A null or empty page has an empty text, and so has one without any text. Broken markup is read as far as it goes;
very long pages are read whole. Repeated rows get equal results; columns named like a result are replaced by it. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table

# --- parser ---------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+")
#: Elements whose content is no markup, or is never shown: scripts, styles, form fields, the page's title, frames.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "template"}
_CLOSE = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "button", "select", "noscript", "object", "math", "svg",
    "mi", "mo", "mn", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup",
    "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mfenced", "semantics", "annotation",
    "g", "path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text", "tspan", "use", "defs", "symbol", "desc",
}
#: Elements within a block that the trees judge by themselves.
OWN_NODE = {"button", "select", "noscript", "object", "math", "svg"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_P_BARRIER = {"td", "th", "table", "body", "html"}

#: Groups of attribute tokens, public naming habits of web pages.
GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar logo branding hero",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar aside side rail widget related recommended recommend popular trending more teaser",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog message toast paywall announcement",
    "remark": "comment comments reply replies respond disqus discussion commentlist feedback",
    "form": "form search login signup subscribe newsletter share social sharing follow contact input",
    "hidden": "hidden none sr invisible visuallyhidden",
    "body": "content article main post entry story text body articlebody page prose paragraph",
}
_GROUP_OF = {t: i for i, ts in enumerate(GROUPS.values()) for t in ts.split()}
#: Elements whose name says as much as a token.
_NAMED = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "ins": "advert", "article": "body", "main": "body"}
N_GROUPS = len(GROUPS)
TAGS = (
    {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"article", "main"}, {"section"}, {"div"}, {"p"},
    {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"table", "tbody", "tr", "thead"},
    {"td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"dialog", "details", "summary"},
    {"button", "select"}, {"noscript", "object"}, {"math"}, {"svg"},
)
_TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts}


class Page:
    """Nodes in document order and the text pieces, each with its node and block."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups = [-1], ["root"], [0]
        self.inside = [0]
        self.pieces: list[tuple[int, int, str, bool]] = []  # node, block, text, within a link
        self._parse(source)

    def _node(self, up: int, tag: str, attrs: str) -> int:
        bits = 1 << list(GROUPS).index(_NAMED[tag]) if tag in _NAMED else 0
        low = attrs.lower()
        if low.strip():
            for name, value in _ATTR.findall(low):
                if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                    for t in _TOKEN.findall(value):
                        g = _GROUP_OF.get(t)
                        if g is not None:
                            bits |= 1 << g
                elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    bits |= 1 << list(GROUPS).index("hidden")
        self.parent.append(up)
        self.tag.append(tag)
        self.groups.append(bits)
        self.inside.append(self.inside[up] | self.groups[up])
        return len(self.parent) - 1

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]  # open elements with the node that their text belongs to
        block = links = 0
        at, n = 0, len(s)
        while at < n:
            i = s.find("<", at)
            if i < 0:
                i = n
            if i > at:
                self.pieces.append((stack[-1][1], block, s[at:i], links > 0))
            if i >= n:
                break
            m = _TAG.match(s, i)
            if m is None:
                if s.startswith("<!--", i):
                    j = s.find("-->", i + 4)
                    at = n if j < 0 else j + 3
                elif s.startswith(("<!", "<?", "</"), i) or s[i + 1 : i + 2].isalpha():
                    j = s.find(">", i)
                    at = n if j < 0 else j + 1
                else:
                    self.pieces.append((stack[-1][1], block, "<", links > 0))
                    at = i + 1
                continue
            at, close, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
            if close:
                if tag == "p" and not any(t == "p" for t, _ in stack):
                    block += 1
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t == tag:
                        links -= sum(x == "a" for x, _ in stack[k:])
                        del stack[k:]
                        break
                    if tag in INLINE and t not in INLINE or t in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                        break
                if tag not in INLINE:
                    block += 1
                continue
            if tag in RAW:
                end = _CLOSE[tag].search(s, at)
                k = s.find(">", end.end()) if end else -1
                at = n if k < 0 else k + 1
                continue
            if tag in VOID:
                if tag == "hr":
                    block += 1
                else:
                    self.pieces.append((stack[-1][1], block, " ", False))
                continue
            if tag in INLINE:
                if tag == "a":
                    links += 1
                marked = tag in OWN_NODE or attrs and ("class" in attrs or "id" in attrs or "hidden" in attrs or "style" in attrs)
                node = self._node(stack[-1][1], tag, attrs) if marked else stack[-1][1]
                stack.append((tag, node))
                continue
            ends, scope = _ENDS.get(tag), _SCOPE.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if ends and t in ends and not (tag == "tr" and t in ("td", "th")) or t == "p":
                    links -= sum(x == "a" for x, _ in stack[k:])
                    del stack[k:]
                    break
                if t in scope or t in _P_BARRIER or t not in INLINE and not ends:
                    break
            block += 1
            stack.append((tag, self._node(stack[-1][1], tag, attrs)))

    def text(self, keep: list[bool]) -> str:
        blocks, last = [], None
        for node, block, piece, _ in self.pieces:
            if keep[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(entities.unescape(piece) if "&" in piece else piece)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


class Forest:
    """Several pages' nodes in one set of arrays, with levels of equal depth."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = [len(p.parent) for p in pages]
        self.ends = np.cumsum(sizes) if sizes else np.zeros(0, dtype=np.int64)
        starts = self.ends - sizes
        self.root = np.repeat(starts, sizes)
        up = np.concatenate([np.array(p.parent) for p in pages]) + self.root
        self.parent = np.where(up < self.root, self.root, up)
        depth = []
        for p in pages:
            d = [0] * len(p.parent)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth += d
        self.depth = np.array(depth)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 2))
        self.levels = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]  # from depth 1 on

    def gather(self, x: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        x = x.copy()
        for level in reversed(self.levels):
            np.add.at(x, self.parent[level], x[level])
        return x

    def features(self) -> np.ndarray:
        n, parent = len(self.parent), self.parent
        rows = []
        for p in self.pages:
            own = [[0, 0, 0, 0] for _ in p.parent]  # characters, words, linked characters, sentence marks
            for node, _, text, link in p.pieces:
                c = len(text)
                if c > 1 or text.strip():
                    o = own[node]
                    o[0] += c
                    o[1] += text.count(" ") + 1
                    o[2] += c if link else 0
                    o[3] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            rows += own
        own = np.array(rows, dtype=np.float64)
        tag = [t for p in self.pages for t in p.tag]
        kind = np.array([_TAG_OF.get(t, -1) for t in tag])
        one = kind[:, None] == np.arange(len(TAGS))
        extra = np.stack([np.ones(n), one[:, 8], one[:, 9]], axis=1)
        sums = self.gather(np.concatenate([own, extra], axis=1))
        chars, words, linked, marks, tags, paragraphs, titles = sums.T
        inner = np.flatnonzero(parent != np.arange(n))
        children = np.bincount(parent[inner], minlength=n).astype(float)
        by_parent = inner[np.argsort(parent[inner], kind="stable")]
        first = np.concatenate([[True], parent[by_parent][1:] != parent[by_parent][:-1]]) if len(by_parent) else np.zeros(0, bool)
        at = np.arange(len(by_parent))
        index = np.zeros(n)
        index[by_parent] = at - np.maximum.accumulate(np.where(first, at, 0))
        siblings = children[parent]
        bits = np.array([g for p in self.pages for g in p.groups])[:, None] >> np.arange(N_GROUPS) & 1
        above = np.array([g for p in self.pages for g in p.inside])[:, None] >> np.arange(N_GROUPS) & 1
        bad = [i for i, g in enumerate(GROUPS) if g != "body"]
        dense = np.stack(
            [
                np.log1p(chars), np.log1p(words), linked / (chars + 1), marks / (words + 1), words / tags, np.log1p(paragraphs),
                chars / (chars[self.root] + 1), np.log1p(own[:, 1]), self.depth, index / np.maximum(siblings, 1),
                np.log1p(siblings), linked[parent] / (chars[parent] + 1), words[parent] / tags[parent], np.log1p(tags),
                bits[:, bad].sum(1), above[:, bad].sum(1), np.minimum(titles, 2),
                above[:, -1] * (bits[:, bad].sum(1) + above[:, bad].sum(1)),
            ],
            axis=1,
        )
        return np.concatenate([dense, bits, above, one], axis=1).astype(np.float32)

    def decode(self, log_odds: np.ndarray) -> np.ndarray:
        """The likeliest set of kept nodes that holds the root and, with a node, its parent."""
        z = np.clip(log_odds, -12, 12)
        with_, without = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
        for level in reversed(self.levels):
            np.add.at(with_, self.parent[level], np.maximum(with_[level], without[level]))
            np.add.at(without, self.parent[level], without[level])
        keep = np.ones(len(z), dtype=bool)
        for level in self.levels:
            keep[level] = keep[self.parent[level]] & (with_[level] >= without[level])
        return keep

    def texts(self, log_odds: np.ndarray) -> list[str]:
        keep = self.decode(log_odds)
        return [p.text(keep[e - len(p.parent) : e].tolist()) for p, e in zip(self.pages, self.ends, strict=True)]


# --- boosted trees --------------------------------------------------------------------------------------------------


class Trees:
    """Gradient boosting of logistic loss with histogram splits; every tree is complete."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.4, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.start)
        nb, nf = self.bins, x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature = np.zeros(2**self.depth - 1, dtype=np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            leaf = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-6)
                at = leaf
                code = (at[:, None] * nf + np.arange(nf)) * nb + binned
                shape = (width, nf, nb)
                hg = np.bincount(code.ravel(), np.repeat(g, nf), width * nf * nb).reshape(shape).cumsum(2)
                hh = np.bincount(code.ravel(), np.repeat(h, nf), width * nf * nb).reshape(shape).cumsum(2)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                gain[(hh < self.least) | (th - hh < self.least)] = 0
                flat = gain.reshape(width, nf * nb)
                top = flat.argmax(1)
                for node in np.flatnonzero(flat[np.arange(width), top] > best):
                    j, k = divmod(int(top[node]), nb)
                    if k < len(cuts[j]):
                        feature[width - 1 + node], cut[width - 1 + node] = j, cuts[j][k]
                node = width - 1 + leaf
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[node]] > cut[node])
            n = 2**self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            z += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[node]] > cut[node])
            z += value[leaf]
        return z


# --- generated training pages ---------------------------------------------------------------------------------------


def training_page(rng: random.Random) -> str:
    """A page whose boilerplate elements carry the mark data-x on their outermost element."""
    syllables = ["ta", "ri", "mon", "el", "su", "ver", "ka", "lo", "ni", "per", "do", "she", "th", "an", "in", "qu", "é", "ü"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    mark = rng.choice([0.0, 0.06, 0.12])

    def sentence(a=3, b=18):
        ws = [word() for _ in range(rng.randint(a, b))]
        return " ".join(w + ("," if rng.random() < mark else "") for w in ws).capitalize() + rng.choice([".", ".", "?", "!", ""])

    def prose(a=1, b=8):
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def links(n, tag="li"):
        return "".join(f"<{tag}><a href='/{word()}'>{word()}</a></{tag}>" for _ in range(n))

    def attr(*names):
        style = rng.random()
        if style < 0.12:
            return ""
        name = rng.choice(names)
        name = rng.choice([name, f"{name}-{word()}", f"site-{name}", f"{word()}_{name}", name.capitalize()])
        return f' class="{name}"' if style < 0.7 else f' id="{name}"'

    def junk(kind):
        if kind == "menu":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            inner = links(rng.randint(3, 14)) if tag == "ul" else f"<ul>{links(rng.randint(3, 14))}</ul>"
            a = attr("menu", "nav", "breadcrumb", "navigation", "pagination")
            return f"<{tag} data-x{a if tag != 'ul' or a else ' class=menu'}>{inner}</{tag}>"
        if kind == "header":
            tag = rng.choice(["header", "header", "div"])
            a = attr("header", "masthead", "logo", "topbar") or (" class=header" if tag == "div" else "")
            return f"<{tag} data-x{a}>{rng.choice([f'<h1>{sentence(1, 5)}</h1>', f'<a href=/>{word()}</a>', f'<p>{sentence()}</p>', sentence()])}{rng.choice(['', f'<ul>{links(4)}</ul>'])}</{tag}>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            a = attr("footer", "copyright", "legal") or (" id=footer" if tag == "div" else "")
            return f"<{tag} data-x{a}>&copy; {rng.choice([prose(1, 2), f'<p>{prose(1, 3)}</p>', f'<ul>{links(5)}</ul>'])}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "aside", "div", "section"])
            a = attr("sidebar", "related", "widget", "recommended") or ("" if tag == "aside" else " class=sidebar")
            return f"<{tag} data-x{a}><h3>{word()}</h3>{rng.choice([f'<ul>{links(6)}</ul>', f'<p>{prose(1, 3)}</p>', f'<ul>{links(3)}</ul><p>{sentence()}</p>'])}</{tag}>"
        if kind == "advert":
            tag = rng.choice(["div", "div", "section", "ins", "aside"])
            a = attr("ad", "ads", "advert", "sponsored", "promo", "banner") or " class=ad"
            return f"<{tag} data-x{a}>{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p>', f'<a href=/>{sentence()}</a>', f'<h4>{word()}</h4><p>{prose(1, 2)}</p>'])}</{tag}>"
        if kind == "notice":
            tag = rng.choice(["div", "div", "section", "aside", "dialog"])
            a = attr("cookie-notice", "consent", "notice", "alert", "popup", "cookie") or " role=alert"
            return f"<{tag} data-x{a}>{rng.choice([prose(1, 3), f'<p>{prose(1, 4)}</p><button>{word()}</button>'])}</{tag}>"
        if kind == "remark":
            tag = rng.choice(["div", "section", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
            a = attr("comments", "comment-list", "commentlist", "replies", "discussion") or " class=comments"
            inner = "".join(f"<{item}{rng.choice(['', ' class=comment'])}>{rng.choice([prose(1, 5), f'<p>{prose(1, 5)}</p>' if item != 'p' else prose(1, 5)])}</{item}>" for _ in range(rng.randint(1, 8)))
            return f"<{tag} data-x{a}>{rng.choice(['', f'<h2>{sentence(1, 3)}</h2>']) if item != 'li' else ''}{inner}</{tag}>"
        a = attr("form", "newsletter", "subscribe", "login", "search")
        tag = rng.choice(["form", "form", "div"])
        if tag == "div" and not a:
            a = " class=newsletter"
        return f"<{tag} data-x{a}><p>{sentence()}</p><label>{word()}</label><input name=q><button>{word()}</button></{tag}>"

    def block():
        r = rng.random()
        if r < 0.72:
            body = prose(1, 9) if rng.random() < 0.85 else sentence(1, 3)
            if rng.random() < 0.15:
                body = f"<b>{body}<br>" if rng.random() < 0.4 else f"{body} <a href=/x>{word()}</a> {sentence()}"
            r = rng.random()
            if r < 0.03:
                body += f" <math><mi>{word()}</mi><mo>=</mo><mrow><mn>{rng.randint(1, 99)}</mn></mrow></math> {sentence()}"
            elif r < 0.06:
                body += f" <button data-x>{word()}</button>"
            elif r < 0.08:
                body += f" <select data-x>{''.join(f'<option>{word()}</option>' for _ in range(3))}</select>"
            elif r < 0.1:
                body += f" <svg data-x><g><text>{word()}</text></g></svg>"
            elif r < 0.12:
                return f"<noscript><p>{body}</p></noscript>"
            elif r < 0.14:
                return f"<object data=x><p>{body}</p></object>" if rng.random() < 0.5 else f"<p>{sentence()} <object data=x>{sentence()}</object></p>"
            return f"<p>{body}</p>" if rng.random() < 0.85 else f"<p>{body}"
        if r < 0.82:
            return f"<h{(k := rng.choice([2, 2, 3, 4]))}>{sentence(1, 7)}</h{k}>"
        if r < 0.9:
            return f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if r < 0.94:
            return f"<blockquote>{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p>'])}</blockquote>"
        if r < 0.97:
            return f"<table>{''.join(f'<tr><td>{word()}</td><td>{sentence(1, 5)}</td></tr>' for _ in range(rng.randint(2, 5)))}</table>"
        return f"<pre>{prose(1, 3)}</pre>" if rng.random() < 0.5 else f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"

    kinds = ["menu", "header", "footer", "side", "advert", "notice", "remark", "form"]
    before = [junk(k) for k in kinds if k not in ("footer", "remark") and rng.random() < 0.5]
    after = [junk(k) for k in kinds if k not in ("header",) and rng.random() < 0.5]
    if rng.random() < 0.2:
        before.append(rng.choice([f"<noscript data-x>{sentence()}</noscript>", f"<svg data-x><text>{word()}</text></svg>", f"<select data-x><option>{word()}</option></select>"]))
    rng.shuffle(before)
    rng.shuffle(after)
    blocks = [block() for _ in range(rng.randint(1, 14))]
    if rng.random() < 0.3:
        blocks.insert(rng.randrange(len(blocks) + 1), junk(rng.choice(["advert", "side", "form", "notice", "menu"])))
    title = f"<h1>{sentence(1, 9)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.35:
        title = f"<header>{title}</header>"
    if title and rng.random() < 0.1:
        before, title = [*before, title], ""
    inner = title + "".join(blocks)
    wrap = rng.random()
    if wrap < 0.4:
        inner = f"<article{rng.choice(['', '', attr('post', 'article', 'entry')])}>{inner}</article>"
    elif wrap < 0.7:
        inner = f"<div{attr('content', 'post-body', 'article', 'main', 'entry-content', 'story', word())}>{inner}</div>"
    elif wrap < 0.85:
        inner = f"<main>{rng.choice([inner, f'<article>{inner}</article>', f'<div>{inner}</div>'])}</main>"
    elif wrap < 0.95:
        inner = f"<section{attr('content', 'story')}>{inner}</section>"
    body = "".join(before) + inner + "".join(after)
    if rng.random() < 0.3:
        body = f"<div{attr('wrapper', 'page', 'container', 'site')}>{body}</div>"
    return f"<html><head><title>{word()}</title></head><body>{body}</body></html>"


def training_nodes(n_pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(n_pages):
        source = training_page(rng)
        page = MarkedPage(source)
        flags = page.flags
        out = np.zeros(len(flags), dtype=bool)
        for i in range(1, len(flags)):
            out[i] = flags[i] or out[page.parent[i]]
        xs.append(Forest([page]).features()[1:])
        ys.append(~out[1:])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


class MarkedPage(Page):
    """A page that remembers which nodes carry the training mark."""

    def __init__(self, source: str):
        self.flags = [False]
        super().__init__(source)

    def _node(self, up: int, tag: str, attrs: str) -> int:
        self.flags.append("data-x" in attrs)
        return super()._node(up, tag, attrs)


@functools.cache
def model(n_pages: int = 250, seed: int = 7) -> Trees:
    """Trees trained on ``n_pages`` generated pages; the same for the same arguments."""
    x, y = training_nodes(n_pages, seed)
    return Trees().fit(x, y)


# --- operator -------------------------------------------------------------------------------------------------------


def main_text(source: str | None, trees: Trees) -> str:
    return texts([source], trees)[0]


def extract(pages: DataFrame, trees: Trees | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with text, the main text: blocks in page order, white space collapsed. Null and empty: empty."""
    trees = trees or model()

    def start():
        return lambda html: {"text": texts(html, trees)}

    return map_rows(pages, {"html": html}, {"text": T.StringType()}, start, keep)


def texts(sources: list[str | None], trees: Trees, most: int = 4_000_000) -> list[str]:
    """Main texts, with the trees applied to the nodes of many pages at once."""
    out: list[str] = []
    held: list[Page] = []

    def flush():
        if held:
            forest = Forest(held)
            out.extend(forest.texts(trees.log_odds(forest.features())))
            held.clear()

    size = 0
    for s in sources:
        held.append(Page(s or ""))
        size += len(s or "")
        if size > most:
            flush()
            size = 0
    flush()
    return out


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
