"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its runs of text as leaves. Each
node is content or not; a node has a potential from its own features, and each
parent-child edge one from the two labels. Sum-product messages, leaves to root
and back, give exact marginals, all pages of a batch at once, depth by depth.
The potentials are trained by maximum likelihood (the gradient is what the same
messages yield) on labelled pages of many layouts made by ``labelled_pages``.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no markup: all up to the end tag of their name, whatever stands before it.
_PLAIN = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*>?", re.I) for k in ("script", "style", "textarea", "title", "iframe")}
#: Elements whose content is never text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "head"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
_BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary center button label legend dialog menu".split())
_P_ENDS = _BLOCK - {"button", "label", "summary", "legend"}
#: What a start tag closes when it is open within the nearest scope.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main"}

_TAGS = ("nav", "header", "footer", "aside", "form", "button", "article", "main", "section", "div", "p", "ul", "li", "table", "td", "blockquote", "pre", "figure", "body", "html", "#text")
_BAD = "nav menu navbar breadcrumb sidebar side widget related recommended share social footer foot header masthead banner cookie consent notice popup modal newsletter subscribe signup promo sponsor sponsored ad ads advert advertisement advertising comment comments reply replies respond disqus pagination pager tags tag login search toolbar copyright legal disclaimer alert form".split()
_GOOD = "article content post entry main story body text blog prose page".split()
_N = len(_TAGS) + 2 + 9 + 3


@dataclass
class Tree:
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[frozenset[str]] = field(default_factory=list)
    text: list[list[str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # code points of the run within links
    truth: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words: frozenset[str] = frozenset()) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append([])
        self.linked.append(0)
        return len(self.parent) - 1


def parse(page: str | None) -> Tree:
    """The tree of a page; never fails. Character references are decoded in text, not in markup."""
    tree = Tree()
    root = tree.add(-1, "html")
    stack: list[tuple[str, int]] = [("html", root)]
    links = 0
    raw: str | None = None
    run = -1
    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        tok, at = m.group(), m.end()
        if tok[0] == "<" and (n := _NAME.match(tok)) and (plain := _PLAIN.get(n[1].lower())) and tok[1] != "/" and not tok.endswith("/>"):
            if end := plain.search(page, at):
                at = end.end()
                continue
        if raw is not None:
            if tok.startswith("</") and (n := _NAME.match(tok)) and n[1].lower() == raw:
                raw = None
            elif not (raw == "head" and (n := _NAME.match(tok)) and n[1].lower() == "body"):
                continue
            else:
                raw = None
            if tok.startswith("</"):
                continue
        if tok[0] != "<" or len(tok) == 1 or tok[1] not in "/!?" and not tok[1].isalpha():
            if run < 0:
                if tok.isspace():
                    continue
                run = tree.add(stack[-1][1], "#text")
            tree.text[run].append(tok)
            if links:
                tree.linked[run] += len(tok)
            continue
        if tok[1] in "!?":
            continue
        n = _NAME.match(tok)
        if n is None:
            continue
        name = n[1].lower()
        if tok[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK:
                run = -1
                top = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if top:
                    del stack[top:]
            continue
        if name == "a":
            links += not tok.endswith("/>")
        elif name in _RAW:
            if not tok.endswith("/>"):
                raw = name
            if name in ("head",):
                run = -1
        elif name in _VOID:
            if name == "hr":
                run = -1
            elif name == "br" and run >= 0:
                tree.text[run].append(" ")
        elif name in _BLOCK:
            run, links = -1, 0
            if name in ("html", "body") and len(stack) > 1:
                continue
            if name in _P_ENDS:
                top = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in _SCOPE or stack[k][0] in ("td", "li", "blockquote")), 0)
                if top and stack[top][0] == "p":
                    del stack[top:]
            if name in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _CLOSES[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in _SCOPE and stack[k][0] not in ("div", "section", "article"):
                        break
            words: frozenset[str] = frozenset()
            if len(tok) > len(name) + 2:
                found = _ATTR.findall(tok)
                words = frozenset(w for a in found for w in (_WORDS.findall("".join(a[1:]).lower()) if a[0].lower() in ("class", "id", "role") else ["hidden"] if a[0].lower() != "style" or "display:none" in "".join(a[1:]).replace(" ", "").lower() else []))
            node = tree.add(stack[-1][1], name, words)
            stack.append((name, node))
    return tree


def blocks(tree: Tree) -> list[str]:
    """The text of each node that is a run: decoded, white space as single spaces, trimmed; else empty."""
    return [_SPACE.sub(" ", entities.unescape("".join(t))).strip() if t else "" for t in tree.text]


def features(tree: Tree, texts: list[str]) -> np.ndarray:
    n = len(tree.parent)
    x = np.zeros((n, _N))
    below, linked = np.zeros(n), np.zeros(n)
    base = len(_TAGS)
    for i in range(n - 1, -1, -1):
        below[i] += len(texts[i])
        linked[i] += min(tree.linked[i], len(texts[i]))
        if tree.parent[i] >= 0:
            below[tree.parent[i]] += below[i]
            linked[tree.parent[i]] += linked[i]
    for i in range(n):
        t, w = tree.tag[i], tree.words[i]
        x[i, _TAGS.index(t) if t in _TAGS else _TAGS.index("p")] = 1
        if w:
            bad, good = any(b in w for b in _BAD), any(g in w for g in _GOOD)
            x[i, base], x[i, base + 1] = bad or "hidden" in w, good and not bad
        size, dense = below[i], linked[i] / below[i] if below[i] else 0.0
        f = base + 2
        x[i, f + 0] = 1
        x[i, f + 1] = size == 0
        x[i, f + 2] = 0 < size < 25
        x[i, f + 3] = size >= 100
        x[i, f + 4] = size >= 400
        x[i, f + 5] = dense
        x[i, f + 6] = dense > 0.5
        x[i, f + 7] = t == "#text" and texts[i][-1:] in ".!?\"'”»"
        x[i, f + 8] = t == "#text" and ("©" in texts[i] or "|" in texts[i][:40])
        p = tree.parent[i]
        if p >= 0:
            x[i, f + 9] = tree.tag[p] in ("article", "main")
            x[i, f + 10] = tree.tag[p] in ("nav", "footer", "aside", "header", "form")
            x[i, f + 11] = t == "#text" and re.match("h[1-6]$", tree.tag[p]) is not None
    return x


@dataclass
class Model:
    unary: np.ndarray
    pair: np.ndarray  # 2 x 2, parent then child

    def flat(self) -> np.ndarray:
        return np.concatenate([self.unary, self.pair.ravel()])


def marginals(score: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray, need_pairs: bool = False):
    """Content marginals of a forest by messages up and down; also the summed edge marginals and the log partition.

    score: each node's content potential (0 for the other label). Log space.
    """
    n = len(score)
    node = np.zeros((n, 2))
    node[:, 1] = score
    up = node.copy()  # own potential and all that came from below
    msg = np.zeros((n, 2))  # to the parent, by its label
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)] if n else []
    for at in reversed(levels[1:]):
        msg[at] = np.logaddexp(pair[None, :, 0] + up[at, 0][:, None], pair[None, :, 1] + up[at, 1][:, None])
        np.add.at(up, parent[at], msg[at])
    full = up.copy()
    pairs = np.zeros((2, 2))
    z = np.logaddexp(up[levels[0], 0], up[levels[0], 1]).sum() if levels else 0.0
    for at in levels[1:]:
        p = parent[at]
        rest = full[p] - msg[at]  # the parent without this child
        down = np.logaddexp(rest[:, 0][:, None] + pair[None, 0, :], rest[:, 1][:, None] + pair[None, 1, :])
        if need_pairs:
            joint = rest[:, :, None] + pair[None] + up[at][:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(0)
        full[at] = up[at] + down
    prob = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))
    return prob, pairs, z


def _joined(trees: list[Tree], xs: list[np.ndarray]):
    offset = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + o) for t, o in zip(trees, offset, strict=False)])
    return np.concatenate(xs), parent, np.concatenate([np.array(t.depth) for t in trees])


def train(pages: list[tuple[str, list[str]]], steps: int = 150, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """Maximum likelihood on pages with the list of their content blocks; a node is content if a run below it is."""
    trees, xs, ys = [], [], []
    for page, content in pages:
        tree = parse(page)
        texts = blocks(tree)
        y = np.zeros(len(texts))
        left = list(content)
        for i, t in enumerate(texts):
            if t and t in left:
                left.remove(t)
                k = i
                while k >= 0 and not y[k]:
                    y[k] = 1
                    k = tree.parent[k]
        trees.append(tree)
        xs.append(features(tree, texts))
        ys.append(y)
    x, parent, depth = _joined(trees, xs)
    y = np.concatenate(ys).astype(int)
    kids = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[kids]], y[kids]), 1)
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    sq = np.full(x.shape[1] + 4, 1e-8)
    for _ in range(steps):
        prob, pairs, _ = marginals(x @ model.unary, model.pair, parent, depth, True)
        g = np.concatenate([x.T @ (y - prob), (seen - pairs).ravel()]) / len(y) - l2 * model.flat()
        sq = 0.95 * sq + 0.05 * g * g
        step = rate * 0.1 * g / np.sqrt(sq)
        model = Model(model.unary + step[:-4], model.pair + step[-4:].reshape(2, 2))
    return model


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with their content blocks: made up, so that labels are certain."""
    r = random.Random(seed)
    syll = "ba de ki lo mu ran sel tor vin wes po shi gra ten al".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sent = lambda a=4, b=18: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])
    para = lambda: " ".join(sent() for _ in range(r.choice([1, 1, 2, 3, 6])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}" + r.choice(["</li>", ""]) for _ in range(r.randint(3, 8))) + "</ul>"
    ad = lambda: f"<{(t := r.choice(['div', 'aside', 'section', 'p']))} {r.choice(['class', 'id'])}=\"{r.choice(['ad', 'ads', 'advert', 'ad-box', 'sponsored', 'promo', 'banner', 'ad ad-top'])}\">{r.choice([sent(), para(), link()])}</{t}>"
    notice = lambda: f'<div class="{r.choice(["cookie-notice", "cookie", "consent banner", "notice", "newsletter", "popup", "alert"])}">{para()}{r.choice(["", "<button>OK</button>", link()])}</div>'
    form = lambda: f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button><p>{sent()}</p></form>'
    side = lambda: r.choice([f"<aside><h3>{words(1, 3)}</h3>{menu()}<p>{sent()}</p></aside>", f'<div class="{r.choice(["sidebar", "side widget", "related", "share social"])}"><h4>{words(1, 2)}</h4>{menu()}<p>{para()}</p></div>'])
    notes = lambda: f"<{(t := r.choice(['section', 'div', 'ol']))} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comment-list', 'replies', 'disqus comments'])}\">" + "".join(f"<{(u := r.choice(['div', 'li', 'article', 'p']))} class=\"comment\"><p>{para()}</p></{u}>" for _ in range(r.randint(1, 4))) + f"</{t}>"
    foot = lambda: r.choice([f"<footer>&copy; {words(1, 3)} &middot; {r.choice([sent(), para()])}</footer>", f"<footer>{menu()}<p>{para()}</p></footer>", f'<div class="footer" id="foot">{para()} {link()}</div>'])
    head = lambda: r.choice([f"<nav>{menu()}</nav>", f"<header><h2>{words(1, 3)}</h2><nav>{menu()}</nav></header>", f'<div class="{r.choice(["menu", "navbar", "header", "breadcrumb nav"])}">{menu()}</div>', f"<header><p>{sent()}</p></header>"])
    pages = []
    for k in range(n):
        content: list[str] = []

        def say(text: str) -> str:
            content.append(" ".join(text.split()))
            return text

        def body_part() -> str:
            kind = r.random()
            if kind < 0.70:
                p = say(para())
                return r.choice([f"<p>{p}</p>", f"<p><b>{p}<br>", f"<p>{p}", f"<p><b>{p}</b></p>"])
            if kind < 0.76:
                return f"<h2>{say(words(2, 6))}</h2>"
            if kind < 0.82:
                return "<ul>" + "".join(f"<li>{say(sent())}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if kind < 0.86:
                return f"<blockquote><p>{say(para())}</p></blockquote>"
            if kind < 0.9:
                return "<table><tr>" + "".join(f"<td>{say(words(1, 5))}</td>" for _ in range(3)) + "</tr></table>"
            if kind < 0.94:
                a, b, c = words(2, 6), words(1, 3), words(3, 9)
                say(f"{a} {b} {c}.")
                return f'<p>{a} <a href="/x">{b}</a> {c}.</p>'
            if kind < 0.97:
                return ad()
            return f"<div>{say(para())}</div>"

        title = words(3, 9)
        inner = (f"<h1>{say(title)}</h1>" if r.random() < 0.85 else "") + "".join(body_part() for _ in range(r.choice([1, 2, 3, 5, 8, 12])))
        if r.random() < 0.15:
            inner += r.choice([side, form, ad, notice])()
        shell = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<div class="post entry">{}</div>', '<div class="article-body">{}</div>', "<section>{}</section>", "<div>{}</div>"])
        parts = [shell.format(inner)]
        for _ in range(r.randint(1, 3)):
            parts.insert(0, r.choice([head, head, ad, notice])())
        for _ in range(r.randint(0, 3)):
            parts.append(r.choice([side, form, notes, ad, notice])())
        parts.append(foot())
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + r.choice(["", "\n"]).join(parts) + "</body></html>"
        if k % 9 == 8:
            page = page.replace("</p>", "").replace("</li>", "")
        pages.append((page, content))
    return pages


@functools.cache
def trained(n: int = 240, seed: int = 7) -> Model:
    return train(labelled_pages(n, seed))


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The content blocks of each page in order, joined by newlines."""
    trees = [parse(p) for p in pages]
    texts = [blocks(t) for t in trees]
    if not trees:
        return []
    x, parent, depth = _joined(trees, [features(t, b) for t, b in zip(trees, texts, strict=True)])
    prob, _, _ = marginals(x @ model.unary, model.pair, parent, depth)
    out, at = [], 0
    for b in texts:
        out.append("\n".join(t for t, p in zip(b, prob[at : at + len(b)], strict=True) if t and p > 0.5))
        at += len(b)
    return out


def extract(pages: DataFrame, model: Model | None = None, page: str = "html", also: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``also`` and text, a row for each page; null or empty html gives an empty text."""
    model = model or trained()
    kept = pages.select(*also, page)
    fields = [f for f in kept.schema.fields if f.name in also]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = main_texts(part.column(len(also)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(also))], pa.array(texts, pa.string())], names=[*also, "text"])

    return kept.mapInArrow(frugal(run), schema)
