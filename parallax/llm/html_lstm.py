"""Main-text extraction: a bidirectional LSTM labels every block of a page.

The model is trained here, in numpy, on a bounded sample of pages.  Its
labels come from the structure that pages declare (an article, and what is
declared inside or outside of it); the sampled texts are also laid out in
many other page designs, so that the model learns what the names of page
parts mean rather than one site's layout."""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ._common import bound_batches
from .html_blocks import DIM, Block, Node, features, read_blocks

#: expected pages in the training sample; longer pages teach nothing
SAMPLE_PAGES, SAMPLE_CHARS = 150, 100_000
HIDDEN, STEPS, BATCH, RATE = 24, 400, 24, 0.01
#: made-up pages that may name their parts in any way; each is met several times
DESIGNS = 1500
#: blocks of a page that a training step sees, drawn anew from anywhere in the page at each step
WINDOW = 200
#: block slots that are labelled at once
SLOTS = 16_384

# Names of page parts, as plain lists: what marks the article, and what marks the rest.
MAIN_NAMES = ("article", "main", ".article", ".post", ".entry", ".story", ".main")
REST_NAMES = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset",
              ".nav", ".navbar", ".navigation", ".menu", ".breadcrumb", ".breadcrumbs", ".header", ".masthead", ".footer", ".sidebar",
              ".widget", ".notice", ".cookie", ".consent", ".alert", ".banner", ".popup", ".modal", ".newsletter", ".subscribe",
              ".ad", ".ads", ".advert", ".advertisement", ".sponsored", ".sponsor", ".promo", ".comments", ".comment", ".reply",
              ".replies", ".respond", ".related", ".recommended", ".share", ".social", ".login", ".search", ".copyright", ".contentinfo",
              ".complementary", ".toolbar", ".disclaimer")

# Words by which made-up pages name their parts.
PART_WORDS = {"article": ("article", "post", "entry", "story", "post-content", "article-body", "entry-content", "main-text"),
              "column": ("content", "main", "primary", "site-content"), "title": ("post-header", "article-header", "entry-title"),
              "menu": ("nav", "menu", "navbar", "top-menu", "navigation"), "header": ("header", "masthead", "site-header"),
              "crumbs": ("breadcrumb", "breadcrumbs"), "notice": ("notice", "cookie-notice", "consent", "alert", "banner"),
              "sidebar": ("sidebar", "widget-area", "secondary", "side"), "advert": ("ad", "advert", "ads", "sponsored", "promo"),
              "share": ("share", "social", "share-links"), "related": ("related", "recommended", "related-posts"),
              "popular": ("popular", "most-read", "widget"), "newsletter": ("newsletter", "subscribe", "signup"),
              "comments": ("comments", "responses", "discussion", "replies"), "comment": ("comment", "reply", "response"),
              "footer": ("footer", "site-footer", "bottom", "contentinfo"), "wrap0": ("wrapper", "container"), "wrap1": ("page", "site")}


def declared(block: Block) -> bool | None:
    """What the page itself says of a block: True in the article, False outside, None if it says nothing."""
    names = block.path
    if any(n in REST_NAMES for n in names):
        return False
    return True if any(n in MAIN_NAMES for n in names) else None


def _page_designs(texts: list[str], links: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """One made-up page: sampled texts laid out under declared parts."""
    line = lambda: rng.choice(texts)
    short = lambda: " ".join(line().split()[:rng.randint(1, 8)]) or "x"
    any_text = lambda: rng.choice((line, short))()
    page: list[tuple[Block, int]] = []
    top = rng.choice(((), ("div",), ("div", ".page"), ("div", ".wrapper", "div", ".container"), ("div", ".site")))

    def put(path, text, label, linked=False):
        page.append((Block(("html", "body", *top, *path), text, len(text) if linked else 0), label))

    def rest(names):
        name = rng.choice(names)
        path = (name,) if name[0] != "." else (rng.choice(("div", "div", "section", "ul", "p", "aside", "td")), name)
        if rng.random() < 0.3:
            path += (rng.choice(("div", "section")), rng.choice((".inner", ".box", ".content", ".text")))
        kind = rng.random()
        for _ in range(rng.randint(1, 6)):
            if kind < 0.4:
                put((*path, "ul", "li"), rng.choice(links) if links else short(), 0, True)
            else:
                put((*path, *rng.choice((("p",), (), ("div",), ("h3",), ("h2",), ("h1",), ("ol", "li")))), any_text(), 0, rng.random() < 0.2)

    before = ("nav", "header", ".nav", ".menu", ".header", ".masthead", ".breadcrumb", ".notice", ".cookie", ".banner", ".ad", ".advert",
              ".navigation", ".alert", ".search", "form", ".promo", ".consent", ".navbar", "aside", ".sidebar")
    after = REST_NAMES
    for _ in range(rng.randint(0, 4)):
        rest(before)
    main = rng.choice((("article",), ("main",), ("main", "article"), ("div", ".article"), ("article", ".post"), ("div", ".post"),
                       ("div", ".entry"), ("section", ".story"), ("div", ".main", "article"), ("div", ".content", "article"),
                       ("main", ".content"), ("article", ".content")))
    title = rng.choice((("h1",), ("h1",), ("h2",), ("header", "h1")))  # a header inside the article may hold its title
    put((*main, *title), short(), 1)
    for _ in range(rng.randint(1, 14)):
        put((*main, *rng.choice((("p",),) * 8 + (("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("blockquote",), ("pre",),
                                                (), ("div", "p"), ("section", "p"), ("figure", "figcaption"), ("table", "tr", "td")))),
            any_text(), 1, rng.random() < 0.02)
        if rng.random() < 0.2:  # parts that do not belong, inside the article
            name = rng.choice(REST_NAMES)
            for _ in range(rng.randint(1, 3)):
                put((*main, *((name,) if name[0] != "." else (rng.choice(("div", "aside", "section")), name)), *rng.choice((("p",), (), ("ul", "li")))),
                    any_text(), 0, rng.random() < 0.3)
    for _ in range(rng.randint(0, 4)):
        rest(after)
    if rng.random() < 0.3:  # a stray line beside the article
        put(rng.choice((("p",), ("div",), ("div", "p"))), any_text(), 0)
    return page


#: how a made-up page names its parts: by the words of its part, by made-up words, by codes, or not at all
SCHEMES = ("words", "foreign", "codes", "none", "none", "some")
MAIN, REST = "\ue000", "\ue001"


class _Design:
    """Draws the HTML of one page; every text begins with the mark of its label."""

    def __init__(self, texts: list[str], links: list[str], rng: random.Random):
        self.texts, self.links, self.rng = texts, links or texts, rng
        self.scheme = rng.choice(SCHEMES)
        self.names: dict[str, str] = {}

    def line(self, least: int = 1, most: int = 200) -> str:
        words = self.rng.choice(self.texts).split()
        while len(words) < least:
            words += self.rng.choice(self.texts).split() or ["x"]
        return escape(" ".join(words[:most]) or "x")

    def _name(self, part: str) -> str:
        """The class that this page gives to a part, the same each time."""
        rng = self.rng
        if part not in self.names:
            scheme = self.scheme if self.scheme != "some" else rng.choice(("words", "none", "foreign"))
            made = "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
            self.names[part] = {"none": "", "codes": f"{made[:2]}{rng.randint(0, 99)}", "foreign": made,
                                "words": rng.choice(PART_WORDS.get(part, (part,)))}[scheme]
        return self.names[part]

    def tag(self, part: str, inner: str, usual: str = "div") -> str:
        rng = self.rng
        tag = usual if self.scheme == "words" and rng.random() < 0.7 or self.scheme == "some" and rng.random() < 0.4 else "div"
        name = self._name(part)
        named = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def wrap(self, inner: str, depth: int) -> str:
        for i in range(depth):
            inner = self.tag(f"wrap{i}", inner, self.rng.choice(("div", "section")))
        return inner

    def link_list(self, mark: str = REST) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{mark}{escape(rng.choice(self.links))}</a>' if rng.random() < 0.5 else f'<a href="/{i}">{mark}{self.line(1, 4)}</a>'
                 for i in range(rng.randint(2, 7))]
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if style < 0.75 else "".join(f"<{t}>{x}</{t}>" for x in items for t in [rng.choice(("div", "p"))])

    def heading(self, text: str) -> str:
        tag = self.rng.choice(("h2", "h3", "h3", "h4", "div", "p"))
        return f"<{tag}>{text}</{tag}>"

    def body_part(self) -> str:
        """A stretch of the article."""
        rng, kind = self.rng, self.rng.random()
        tag = self.paragraph
        if kind < 0.7:
            return f"<{tag}>{MAIN}{self.line(6)}</{tag}>"
        if kind < 0.78:
            return self._sub()
        if kind < 0.86:
            return f"<{tag}>{MAIN}{self.line(1, 12)}</{tag}>"
        if kind < 0.92:
            of = rng.choice(("ul", "ol"))
            return f"<{of}>" + "".join(f"<li>{MAIN}{self.line(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + f"</{of}>"
        if kind < 0.96:
            return f"<blockquote><p>{MAIN}{self.line(3, 40)}</p></blockquote>"
        return rng.choice((f"<pre>{MAIN}{self.line(2, 30)}</pre>", f"<figure><figcaption>{MAIN}{self.line(2, 15)}</figcaption></figure>",
                           f"<table><tr><td>{MAIN}{self.line(1, 8)}</td><td>{MAIN}{self.line(1, 8)}</td></tr></table>"))

    def _sub(self) -> str:
        tag = self.rng.choice(("h2", "h3"))
        return f"<{tag}>{MAIN}{self.line(1, 8)}</{tag}>"

    def aside(self, part: str) -> str:
        """Something that does not belong, inside or outside of the article."""
        rng = self.rng
        if part == "share":
            return self.tag(part, " ".join(f'<a href="#">{REST}{self.line(1, 1)}</a>' for _ in range(rng.randint(2, 5))))
        if part in ("related", "popular"):
            return self.tag(part, self.heading(f"{REST}{self.line(1, 5)}") + self.link_list(), "aside")
        return self.tag(part, rng.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(f"{REST}{self.line(1, 18)}"), "aside")

    def comments(self) -> str:
        rng, n = self.rng, self.rng.randint(1, 6)
        out = self.heading(f"{REST}{rng.choice((f'{n} ', f'({n}) ', ''))}{self.line(1, 3)}") if rng.random() < 0.8 else ""
        style = rng.random()
        for _ in range(n):
            who = f"<{'b' if style < 0.3 else 'div'}>{REST}{self.line(1, 2)}</{'b' if style < 0.3 else 'div'}>" if style < 0.7 else ""
            when = f"<span> {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1999, 2026)}</span>" if style < 0.2 else ""
            said = "".join(f"<p>{REST}{self.line(2, 30)}</p>" for _ in range(1 if rng.random() < 0.8 else 2))
            one = who + when + (said if style < 0.9 else f"{REST}{self.line(2, 30)}")
            out += self.tag("comment", one, rng.choice(("li", "article", "div")))
        if rng.random() < 0.3:
            out += f"<form><label>{REST}{self.line(1, 3)}</label><input><button>{REST}{self.line(1, 2)}</button></form>"
        return self.tag("comments", out, "section")

    def footer(self) -> str:
        rng = self.rng
        bits = [f"<{t}>{REST}{rng.choice(('© ', '(c) ', '© 2024 ', ''))}{self.line(1, 6)}</{t}>" for t in [rng.choice(("p", "div", "small"))]]
        bits += [self.link_list()] if rng.random() < 0.6 else [f"<p>{REST}{self.line(2, 20)}</p>"] if rng.random() < 0.6 else []
        bits += [f"<p><a href='/x'>{REST}{self.line(1, 2)}</a></p>"] if rng.random() < 0.5 else []
        rng.shuffle(bits)
        return self.tag("footer", "".join(bits), "footer")

    def html(self) -> str:
        rng = self.rng
        self.paragraph = rng.choice(("p", "p", "p", "p", "p", "div"))
        title = f"<{t}>{MAIN}{self.line(1, 9)}</{t}>" if (t := rng.choice(("h1", "h1", "h1", "h2"))) and rng.random() < 0.9 else ""
        title = self.tag("title", title, "header") if rng.random() < 0.15 else title
        parts = [self.body_part() for _ in range(rng.choice((1, 2, 3, 4, 4, 5, 6, 8, 12, 20)))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            parts.insert(rng.randrange(len(parts) + 1), self.aside(rng.choice(("advert", "share", "related", "newsletter", "notice"))))
        text = "".join(parts)
        text = self.wrap(text, 1) if rng.random() < 0.25 else text
        article = self.tag("article", title + text, rng.choice(("article", "main", "section", "div")))
        behind = [self.aside(rng.choice(("share", "related", "popular", "newsletter", "advert"))) for _ in range(rng.choice((0, 0, 1, 2)))]
        if rng.random() < 0.5:
            behind.insert(rng.randrange(len(behind) + 1), self.comments())
        column = article + "".join(behind)
        column = self.tag("column", column, "main") if rng.random() < 0.5 else column
        side = [self.aside(rng.choice(("popular", "related", "advert", "newsletter", "notice"))) for _ in range(rng.choice((0, 0, 1, 2, 3)))]
        side = self.tag("sidebar", "".join(side), "aside") if side and rng.random() < 0.6 else "".join(side)
        column = side + column if rng.random() < 0.3 else column + side
        column = self.wrap(column, rng.choice((0, 0, 1, 2)))
        top = [self.tag("menu", self.link_list(), "nav")] if rng.random() < 0.8 else []
        top += [self.tag("header", f"<{t}>{REST}{self.line(1, 4)}</{t}>" + (f"<p>{REST}{self.line(2, 10)}</p>" if rng.random() < 0.3 else ""), "header")
                for t in [rng.choice(("h1", "h2", "div", "p", "a"))]] if rng.random() < 0.5 else []
        top += [self.aside("notice")] if rng.random() < 0.25 else []
        top += [self.tag("crumbs", self.link_list(), "nav")] if rng.random() < 0.2 else []
        rng.shuffle(top)
        end = self.footer() if rng.random() < 0.85 else ""
        end += self.aside("notice") if rng.random() < 0.15 else ""
        return "<html><body>" + self.wrap("".join(top) + column + end, rng.choice((0, 0, 1, 2))) + "</body></html>"


def _any_design(texts: list[str], links: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """One made-up page that may name its parts in any way or not at all."""
    out = []
    for b in read_blocks(_Design(texts, links, rng).html()):
        label = int(b.text.count(MAIN) > b.text.count(REST))
        b.text = " ".join(b.text.replace(MAIN, "").replace(REST, "").split()) or "x"
        b.linked = min(b.linked, len(b.text))
        out.append((b, label))
    return out


def _renamed(blocks: list[Block], rng: random.Random) -> list[Block]:
    """The blocks of a page whose parts have lost their names, or bear made-up ones, and whose tags say less."""
    codes = rng.random() < 0.5
    known: dict[int, Node] = {}
    fresh: dict[str, str] = {}

    def anew(node: Node | None) -> Node | None:
        if node is None:
            return None
        if id(node) not in known:
            tag, *names = node.names
            plain = "div" if tag in ("article", "main", "nav", "aside", "section", "header", "footer", "form") else tag
            names = [fresh.setdefault(x, f".{''.join(rng.choice('abcdefghiklmnoprstuvw') for _ in range(5))}") for x in names] if codes else []
            known[id(node)] = Node(anew(node.parent), (plain, *names))
        return known[id(node)]

    return [Block(anew(b.node), b.text, b.linked) for b in blocks]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with one output a block; ``weights`` are plain arrays."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 2):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.weights = {}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1.0  # remember at first
            self.weights |= {"w" + d: init(DIM, 4 * hidden), "u" + d: init(hidden, 4 * hidden), "c" + d: bias}
        self.weights |= {"out": init(2 * hidden, 1), "skip": np.zeros((DIM, 1), np.float32), "bias": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction over ``x`` (time, batch, DIM)."""
        n, h = self.hidden, self.weights["u" + d]
        z_all = x @ self.weights["w" + d] + self.weights["c" + d]
        s = c = np.zeros((x.shape[1], n), np.float32)
        out = np.zeros((*x.shape[:2], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_all[t] + s @ h
            gates, g = _sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, s, c, i, f, o, g, tc))
            c, s = m * c_new + (1 - m) * c, m * (o * tc) + (1 - m) * s
            out[t] = s
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds (time, batch) that a block is main text."""
        both = np.concatenate((self._run(x, mask, "f", None), self._run(x, mask, "b", None)), axis=2)
        w = self.weights
        return (both @ w["out"] + x @ w["skip"])[..., 0] + w["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over unmasked blocks, and its gradients by back-propagation through time."""
        n, w, total = self.hidden, self.weights, max(float(mask.sum()), 1.0)
        kept = {"f": [], "b": []}
        states = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate((states["f"], states["b"]), axis=2)
        logit = (both @ w["out"] + x @ w["skip"])[..., 0] + w["bias"][0]
        loss = float((mask * (np.logaddexp(0, logit) - y * logit)).sum() / total)
        dl = ((_sigmoid(logit) - y) * mask / total).astype(np.float32)
        flat = dl.reshape(-1, 1)
        grads = {"out": both.reshape(-1, 2 * n).T @ flat, "skip": x.reshape(-1, DIM).T @ flat, "bias": np.array([dl.sum()], np.float32)}
        d_both = dl[..., None] * w["out"][:, 0]
        for k, d in enumerate("fb"):
            ds_out, u = d_both[..., k * n:(k + 1) * n], w["u" + d]
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            du = np.zeros_like(u)
            ds = dc = np.zeros((x.shape[1], n), np.float32)
            for t, s, c, i, f, o, g, tc in reversed(kept[d]):
                m = mask[t][:, None]
                ds = ds + ds_out[t]
                ds_new, dc_new = ds * m, dc * m
                dc_new = dc_new + ds_new * o * (1 - tc * tc)
                dz = np.concatenate((dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), ds_new * tc * o * (1 - o), dc_new * i * (1 - g * g)), axis=1)
                du += s.T @ dz
                dz_all[t] = dz
                ds, dc = ds * (1 - m) + dz @ u.T, dc * (1 - m) + dc_new * f
            grads |= {"w" + d: x.reshape(-1, DIM).T @ dz_all.reshape(-1, 4 * n), "u" + d: du, "c" + d: dz_all.sum(axis=(0, 1))}
        return loss, grads

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together, memory bounded by ``SLOTS`` or one page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= SLOTS:
                stop += 1
            some = order[at:stop]
            x, mask = _padded([features(pages[i]) for i in some])
            score = self.scores(x, mask)
            for j, i in enumerate(some):
                out[i] = score[:len(pages[i]), j] > 0
            at = stop
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), DIM), np.float32), np.zeros((longest, len(rows)), np.float32)
    for j, r in enumerate(rows):
        x[:len(r), j], mask[:len(r), j] = r, 1.0
    return x, mask


def _window(x: np.ndarray, y: np.ndarray, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """A whole page, or ``WINDOW`` blocks of it around a drawn one."""
    if len(x) <= WINDOW:
        return x, y
    at = min(max(rng.randrange(len(x)) - WINDOW // 2, 0), len(x) - WINDOW)
    return x[at:at + WINDOW], y[at:at + WINDOW]


def _learnt(design: list[tuple[Block, int]]) -> tuple[np.ndarray, np.ndarray]:
    return features([b for b, _ in design]), np.array([y for _, y in design], np.float32)


def train(pages: list[list[Block]], steps: int = STEPS, seed: int = 2) -> Labeller:
    """Fit by Adam on real pages with declared labels and on made-up designs, half of each batch; of a page with more than
    ``WINDOW`` blocks a step sees so many in a row, from its start to its end each about as often."""
    rng = random.Random(seed)
    real, unnamed = [], []
    for blocks in pages:
        known = [declared(b) for b in blocks]
        if any(k for k in known):  # a page that declares its article: what it leaves open is outside
            labels = np.array([bool(k) for k in known], np.float32)
            real.append((features(blocks), labels))
            unnamed.append((features(_renamed(blocks, rng)), labels))
    texts = [b.text for blocks in pages for b in blocks] or ["text"]
    links = [b.text for blocks in pages for b in blocks if b.linked]
    made = [_learnt(design) for design in (_any_design(texts, links, rng) for _ in range(DESIGNS)) if design]
    model = Labeller(seed=seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        batch = [rng.choice(real) for _ in range(BATCH // 4)] + [rng.choice(unnamed) for _ in range(BATCH // 8)] if real else []
        for i in range(len(batch), BATCH):
            batch.append(rng.choice(made) if i % 5 > 1 and made else _learnt(_page_designs(texts, links, rng)))
        batch = [_window(x, y, rng) for x, y in batch]
        x, mask = _padded([x for x, _ in batch])
        y = np.zeros(mask.shape, np.float32)
        for j, (_, labels) in enumerate(batch):
            y[:len(labels), j] = labels
        _, grads = model.gradients(x, mask, y)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.weights[k] = (model.weights[k] - rate * (first[k] / (1 - 0.9 ** step))
                                / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def sample(pages: DataFrame, html: str, expected: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS, seed: int = 2) -> list[list[Block]]:
    """Blocks of a bounded sample, chosen by the hash of the page's text; ``expected`` pages of at most ``chars`` each."""
    rows = pages.select(F.col(html).alias("html")).where(F.char_length("html").between(1, chars))
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("html")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, expected / max(n, 1)))
    # copies of one page share a hash, so a limit above the expected size keeps the sample bounded
    found = rows.where(share).distinct().orderBy(F.xxhash64("html"), "html").limit(2 * expected).collect()
    return [read_blocks(r["html"]) for r in found]


def text_of(blocks: list[Block], main: np.ndarray) -> str:
    return "\n\n".join(b.text for b, m in zip(blocks, main) if m)


def extract(pages: DataFrame, html: str = "html", expected: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (replacing such columns).

    The labeller is trained on a bounded sample of the pages and then reads
    every page whole.  Blocks labelled as main text are joined in page order
    by an empty line; a null or empty page, or one without main text, gives
    an empty text.  Repeated pages get the same answer; no pages give none."""
    bound_batches(pages.sparkSession)
    model = train(sample(pages, html, expected))

    @F.pandas_udf("string")
    def main_text(pages: pd.Series) -> pd.Series:
        out: list[str] = []
        for some in _batches(pages):
            out += [text_of(b, m) for b, m in zip(some, model.label(some))]
        return pd.Series(out, dtype=object)

    rows = pages.drop("text", "n_chars").withColumn("text", main_text(F.col(html)))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def _batches(pages: pd.Series, chars: int = 4 << 20) -> Iterator[list[list[Block]]]:
    """Pages read a few MB at a time."""
    held, size = [], 0
    for page in pages:
        held.append(read_blocks(page))
        size += len(page or "")
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held
