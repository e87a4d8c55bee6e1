"""Main text of web pages by a recurrent block labeller (op7).

A page is scanned into its leaf blocks, in order: the texts between tags that break lines. Each block becomes a vector
of its hashed tag path (tags, classes, ids), its hashed words and a few measures. A bidirectional LSTM in numpy reads
a page's whole sequence and labels every block as article or not; the article's blocks are the page's text.

No table has labelled pages, so the labeller is trained on pages that `Maker` writes: menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around and within an article, in layouts by elements, by classes, by
neutral names, by tables, by nothing but paragraphs, and as plain text. What stands around an article often has the
words that such parts have on real pages; the article's words are random. Whole layouts can be held out, to score
blocks on pages of a kind that wasn't trained on. Training is bounded (``PAGES``, ``EPOCHS``), seeded, and done on the
driver; the weights are a few tens of thousands of numbers.

Defined results: null or empty html, and pages of which no block is labelled as article, have an empty text. Scripts,
styles, comments, the head, selections and markup are never text. A tag that isn't closed ends with its parent, an
unclosed script, style, title, text area or frame and an unclosed comment with the page, an unclosed quote with its
tag. Repeated rows are extracted each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read

PATHS, WORDS, MEASURES = 128, 96, 9
SIZE = PATHS + WORDS + MEASURES
HIDDEN = 16
PAGES, EPOCHS, BATCH, SEED = 1400, 20, 40, 5
#: Blocks in a padded batch of pages at most, but for a single page.
PADDED = 20_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside, and elements without text that may be left open.
_RAW = frozenset("script style title textarea iframe".split())
_SILENT = frozenset("select svg template".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Block:
    __slots__ = ("linked", "parts", "path", "size")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.parts, self.linked, self.size = path, [], 0, 0


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Path, text and share of linked characters of each leaf block."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []  # tags and what they add to the path
    now: Block | None = None
    links = silent = 0

    def pop(to: int) -> None:
        nonlocal links, silent
        links -= sum(t == "a" for t, _ in stack[to:])
        silent -= sum(t in _SILENT for t, _ in stack[to:])
        del stack[to:]

    def end() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(entities.unescape("".join(now.parts)).split())
            if text:
                out.append((now.path, text, now.linked / max(now.size, 1)))
        now = None

    def add(text: str) -> None:
        nonlocal now
        if silent:
            return
        if now is None:
            if not text.strip():
                return
            now = Block(tuple(x for _, x in stack))
        now.parts.append(text)
        now.size += len(text)
        now.linked += len(text) * (links > 0)

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[m.start() + 1] == "/":
            if tag not in _INLINE:
                end()
            known = [k for k, (t, _) in enumerate(stack) if t == tag]
            if known:
                pop(known[-1])
            continue
        if (tag in _RAW or tag == "head") and not m[2].endswith("/"):
            if tag != "head":
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            else:  # a head need not be closed
                close = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (close.start() if close[0][1] == "b" else close.end()) if close else at
            if tag not in _INLINE:
                end()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            end()
            while stack and (stack[-1][0] in _INLINE or stack[-1][0] in _CLOSES.get(tag, ()) or (stack[-1][0] == "p" and tag in _BREAKS_P)):
                pop(len(stack) - 1)
        if tag in _VOID or m[2].endswith("/"):
            continue
        named = " ".join(next((g for g in x if g), "") for x in _NAMED.findall(m[2])) if m[2] else ""
        if tag not in _INLINE or named:
            stack.append((tag, f"{tag} {named.lower()}"))
        else:
            stack.append((tag, tag))
        links += tag == "a"
        silent += tag in _SILENT
    end()
    return out


@lru_cache(maxsize=50_000)
def _path(step: str, depth: int) -> tuple[tuple[int, float], ...]:
    """The hashed features of one step of a path; ``depth`` is 0 for the innermost two, else 1."""
    tag, _, named = step.partition(" ")
    found = [f"t:{tag}"] + [f"n:{w}" for w in _SPLIT.split(named) if w]
    out = []
    for name in found:
        for salt in ("a", "b"):
            h = zlib.crc32(f"{salt}{depth}{name}".encode())
            out.append((h % PATHS, 1.0 if h & 0x10000 else -1.0))
    return tuple(out)


@lru_cache(maxsize=20_000)
def _whole_path(path: tuple[str, ...]) -> tuple[np.ndarray, bool, bool]:
    """The features of a path, whether a paragraph is in it, and whether a heading is."""
    row = np.zeros(PATHS, np.float32)
    for k, step in enumerate(path):
        for place, sign in _path(step, int(k < len(path) - 2)):
            row[place] += sign
    tags = {s.partition(" ")[0] for s in path}
    return np.clip(row, -3, 3), "p" in tags, bool(tags & {"h1", "h2", "h3"})


class _Buckets(dict):
    """The bucket of each word, kept for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = zlib.crc32(word.lower().strip(".,:;!?()").encode("utf-8", "replace")) % WORDS
        return found


_bucket = _Buckets()


def features(leaves: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    x = np.zeros((len(leaves), SIZE), np.float32)
    for i, (path, text, linked) in enumerate(leaves):
        row = x[i]
        row[:PATHS], paragraph, heading = _whole_path(path)
        found = text.split(" ")
        counts = np.bincount(list(map(_bucket.__getitem__, found)), minlength=WORDS)
        row[PATHS : PATHS + WORDS] = counts / np.sqrt(counts @ counts)
        points = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        row[PATHS + WORDS :] = min(np.log1p(len(text)) / 5, 2), linked, min(points / len(found), 1), paragraph, i / len(leaves), len(path) / 10, i < 3, heading, "©" in text
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output a block."""

    def __init__(self, seed: int = SEED):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((SIZE, 4 * h)) * 0.1).astype(np.float32)
            self.w[f"h{d}"] = (rng.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # forget gates begin open
            self.w[f"c{d}"] = bias
        self.w["o"] = (rng.standard_normal(2 * h) * 0.2).astype(np.float32)
        self.w["q"] = np.zeros(1, np.float32)

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, hidden) and, if wanted, what the way back needs; padding keeps the state."""
        h = HIDDEN
        steps, pages = x.shape[:2]
        inputs = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out, kept = np.zeros((steps, pages, h), np.float32), []
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + state @ self.w[f"h{d}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                kept.append((t, state, cell, i, f, o, g, squashed))
            state, cell = np.where(m, o * squashed, state), np.where(m, new, cell)
            out[t] = state
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, ka = self._direction("f", x, mask, keep)
        b, kb = self._direction("b", x, mask, keep)
        both = np.concatenate([a, b], -1)
        return _sigmoid(both @ self.w["o"] + self.w["q"]), both, (ka, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, kept = self.forward(x, mask, True)
        error = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"o": (both * error[..., None]).sum((0, 1)), "q": np.array([error.sum()], np.float32)}
        back = error[..., None] * self.w["o"]
        h = HIDDEN
        for d, part, steps in (("f", back[..., :h], kept[0]), ("b", back[..., h:], kept[1])):
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, state, cell, i, f, o, g, squashed in reversed(steps):
                m = mask[t][:, None]
                ds = ds + part[t]
                dn = np.where(m, ds * o * (1 - squashed**2) + dc, 0)
                dz = np.concatenate([dn * g * i * (1 - i), dn * cell * f * (1 - f), np.where(m, ds * squashed, 0) * o * (1 - o), dn * i * (1 - g**2)], 1)
                dz_all[t] = dz
                gh += state.T @ dz
                ds = np.where(m, 0, ds) + dz @ self.w[f"h{d}"].T
                dc = np.where(m, dn * f, dc)
            flat = dz_all.reshape(-1, 4 * h)
            grads |= {f"x{d}": x.reshape(-1, SIZE).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(0)}
        return grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The article's blocks of each page, as flags."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            most = max(1, PADDED // len(pages[order[-1]]))
            now, order = order[-most:], order[:-most]
            x, mask = pad([pages[k] for k in now])
            p = self.forward(x, mask)[0]
            for j, k in enumerate(now):
                out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), bool)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, True
    return x, mask


#: What such parts say on real pages; the words of menus are also those of single links.
TALK = {
    "menu": "Home|About us|Contact|News|Sport|Business|Login|Sign in|Sign up|Register|Products|Services|Blog|FAQ|Help|Sitemap|Careers|Support|Shop|Cart|Search|Archive|Categories|Tags|Share on Facebook|Tweet|Email this|Print|Next|Previous|Back to top|Startseite|Kontakt|Impressum|Accueil|Contactez-nous|Inicio|Contacto",
    "head": "Welcome to our site|The daily news|Menu|Skip to content|Toggle navigation|Your trusted source|Official website|Breaking news",
    "foot": "All rights reserved|Copyright 2021|Copyright 2019 by the authors|Privacy policy|Terms of use|Terms and conditions|Powered by WordPress|Legal notice|Follow us on Twitter|Alle Rechte vorbehalten|Datenschutz|Tous droits reserves|Mentions legales|Todos los derechos reservados|Aviso legal",
    "side": "Related articles|Most read|Recent posts|Popular now|You may also like|Read more|About the author|Trending|Latest news|Archives|Categories|See also|More stories",
    "ad": "Advertisement|Sponsored content|Buy now|Special offer|50 % off today|Free shipping on all orders|Order now and save|Click here for more|Anzeige|Limited time deal|Try it free for 30 days",
    "note": "We use cookies to improve your experience|This site uses cookies|Accept all cookies|By continuing you agree to our use of cookies|Please enable JavaScript|Your browser is out of date|Cookie settings|Diese Website verwendet Cookies|Ce site utilise des cookies",
    "form": "Subscribe to our newsletter|Enter your email address|Search|Submit|Your name|Password|Forgot your password?|Remember me|Sign up for free|Send message|Required fields",
    "talk": "Leave a reply|Comments|3 comments|Anonymous says|Reply|Report this comment|Posted by guest|Log in to comment|Great post, thanks for sharing|I totally agree with you|Load more comments|Show replies",
}
#: As often as they are named.
LAYOUTS = ("elements", "elements", "elements", "classes", "neutral", "mixed", "bare", "table", "plain")


class Maker:
    """Random pages with known articles, of the layouts named."""

    ARTICLE = {
        "elements": ["<article>", "<main>", "<main><article>", "<section><article>"],
        "classes": ['<div class="content">', '<div class="post">', '<div id="main-content">', '<section class="article-body">', '<div class="entry-content">', '<div class="story">', '<div class="container"><article>', '<div class="text">'],
        "neutral": ["<div>", '<div class="box">', '<div class="c1"><div class="c2">', '<div class="row"><div class="col">', '<div id="x12">', "<section>"],
        "bare": ["", "<div>", "<center>"],
        "table": ["<table><tr><td>", '<table width="100%"><tr><td valign="top">', "<td>"],
        "plain": [""],
    }
    AROUND = {
        "elements": {"menu": ["nav", "nav", "ul"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "ad": ["aside", "div class=ad"], "note": ['div role="alert"', "dialog"], "form": ["form"], "talk": ['section id="comments"']},
        "classes": {
            "menu": ['div class="menu"', 'ul class="navigation"', 'div class="breadcrumb"', 'ol class="breadcrumbs"', 'div class="share social"', 'div class="tags"', 'div class="pagination"', 'div id="nav"'], "head": ['div class="header"', 'div id="masthead"', 'div class="top-bar"'],
            "foot": ['div class="footer"', 'div id="copyright"', 'div class="site-footer"'], "side": ['div class="sidebar"', 'div class="widget"', 'div class="related"', 'section class="related-posts"', 'div class="author-bio"'],
            "ad": ['div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div class="promo"', 'div class="sponsored"'], "note": ['div class="cookie-notice"', 'div class="notice"', 'div class="consent banner"', 'div id="cookies"'],
            "form": ['form class="search"', 'div class="newsletter"', 'form id="login"', 'div class="subscribe"'], "talk": ['div class="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div id="disqus_thread"'],
        },
        "neutral": {k: ["div", 'div class="box"', 'div class="c3"', 'div class="row"', "ul" if k == "menu" else "section"] for k in TALK},
        "bare": {k: ["p", "div", "p", "center"] for k in TALK},
        "table": {k: ["td", 'td width="160"', 'td class="cell"'] for k in TALK},
    }

    def __init__(self, seed: int, layouts: tuple[str, ...] = LAYOUTS):
        self.r, self.layouts = random.Random(seed), layouts
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouéöü") + self.r.choice(["", "n", "r", "s", "t"])) for _ in range(90)]

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3)))) for _ in range(self.r.randint(low, high))]
        dirty, bar = self.r.random() < 0.1, " |" if self.r.random() < 0.04 else ""
        for k in range(len(out)):
            out[k] += bar
            if self.r.random() < 0.12 or k == len(out) - 1:
                out[k] += self.r.choice(".,.,.!?")
            if dirty:
                out[k] += self.r.choice(("%%%", "***", "###", "$$$", ""))
        return " ".join(out).capitalize()

    def said(self, kind: str, low: int, high: int) -> str:
        """Words of a part around the article: its own, random ones, or both."""
        known = self.r.choice(TALK[kind].split("|"))
        if kind in ("side", "talk") and high > 20:  # teasers and comments are prose
            return self.words(low, high) if self.r.random() < 0.7 else f"{known}. {self.words(low, high)}"
        chance = self.r.random()
        return known if chance < 0.55 else f"{known} {self.words(low, high)}" if chance < 0.75 else self.words(low, high)

    def around(self, opening: str, kind: str) -> str:
        r, tag = self.r, opening.split()[0]
        link = lambda: f'<a href="/{r.randint(0, 999)}">{self.said("menu", 1, 3)}</a>'
        para = lambda low, high: r.choice(("<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>")).format(self.said(kind, low, high))
        many = r.choice((1, 1, 2, 3, 4, 5, 6, 8))
        if kind == "menu":
            inside = "".join(f"<li>{link()}</li>" for _ in range(many))
            if tag not in ("ul", "ol"):
                inside = r.choice((f"<ul>{inside}</ul>", r.choice((" ", " | ", " &middot; ")).join(link() for _ in range(many)), "".join(f"<div>{link()}</div>" for _ in range(many))))
        elif kind == "head":
            inside = r.choice((f"<h1>{self.said(kind, 1, 4)}</h1>", f"<div class='logo'>{link()}</div>", "")) + para(1, 10)
        elif kind == "foot":
            inside = r.choice(("&copy; ", "&copy; ", "Copyright ", "&copy; 2020 ", f"&copy; {r.choice(self.syllables)}.example.com &middot; ", "")) + r.choice((para(2, 18), self.words(2, 20))) + r.choice(("", link(), " | ".join(link() for _ in range(3))))
        elif kind == "side":
            level = r.randint(2, 4)
            inside = f"<h{level}>{self.said(kind, 1, 4)}</h{level}>" * r.randint(0, 1) + r.choice((para(5, 40), "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>"))
        elif kind == "form":
            inside = f"<label>{self.said(kind, 1, 4)}</label><input type=text>" + r.choice(("", para(2, 20))) + f"<button>{self.said(kind, 1, 2)}</button>"
            inside = f"<form>{inside}</form>" if not opening.startswith("form") else inside
        elif kind == "talk":
            item = "li" if tag == "ol" else "div"
            inside = f"<h3>{self.said(kind, 1, 3)}</h3>" * r.randint(0, 1) + "".join(f'<{item} class="{r.choice(("comment", "reply", "comment-body", ""))}"><p>{self.said(kind, 3, 60)}</p></{item}>' for _ in range(r.randint(1, 5)))
        else:
            inside = "".join(para(3, 40) for _ in range(r.randint(1, 2)))
        return f"<{opening}>{inside}</{tag}>"

    def body(self, layout: str, some) -> str:
        """The article's own markup, with a mark at the begin of each block."""
        r, mark, out = self.r, "\x01", []
        if r.random() < 0.8:
            level = r.choice((1, 1, 1, 2))
            title = f"<h{level}>{mark}{self.words(2, 12)}</h{level}>" if layout != "bare" or r.random() < 0.6 else f"<p><b>{mark}{self.words(2, 12)}</b></p>"
            out.append(f"<header>{title}</header>" if layout == "elements" and r.random() < 0.15 else title)
        loose = r.random() < 0.3
        for _ in range(r.randint(1, 25)):
            low, high = r.choice(((1, 4), (5, 40), (20, 120)))
            text, kind = f"{mark}{self.words(low, high)}", r.random()
            if kind < 0.12 and loose:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.7:
                out.append(f"<p>{text}" + "</p>" * (not loose))
            elif kind < 0.74:
                out.append(f"<div>{text}</div>")
            elif kind < 0.82:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{text}</h{level}>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{mark}{self.words(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.96:
                out.append(f"<p>{text} <a href='/x'>{self.words(1, 4)}</a> {self.words(2, 20)}</p>")
            else:
                out.append(f"<pre>{text}</pre>")
            if layout in ("elements", "classes", "mixed") and r.random() < 0.05:
                out.append(some(("ad", "form", "side", "note"), 1, 1))
        if layout in ("elements", "classes", "mixed") and r.random() < 0.2:
            out.append(some(("talk", "menu", "side"), 1, 1))
        return "".join(out)

    def page(self) -> str:
        """Html with a mark at the begin of each of the article's blocks; the marks go before training."""
        r = self.r
        layout = r.choice(self.layouts)
        if layout == "plain":
            return r.choice(("", "<html><body>")) + "\x01" + "\n".join(self.words(3, 60) for _ in range(r.randint(1, 8)))
        style = lambda: r.choice(("elements", "classes")) if layout == "mixed" else layout
        some = lambda kinds, low, high: "".join(self.around(r.choice(self.AROUND[style()][k]), k) for k in (r.choice(kinds) for _ in range(r.randint(low, high))))
        opening = r.choice(self.ARTICLE[style()])
        article = opening + self.body(layout, some) + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
        before, after = some(("menu", "menu", "head", "ad", "note", "form", "side"), 0, 4), some(("foot", "foot", "side", "talk", "ad", "note", "form", "menu"), 0, 4)
        if layout == "table":
            before, after = (f"<table><tr>{x}</tr></table>" if x and r.random() < 0.7 else x for x in (before, after))
        return f"<html><body>{before}{article}{after}</body></html>"


def made(count: int, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of made pages; the marks are taken away before the features are made."""
    maker, out = Maker(seed, layouts), []
    for _ in range(count):
        leaves = blocks(maker.page())
        out.append((features([(p, t.replace("\x01", ""), s) for p, t, s in leaves]), np.array(["\x01" in t for _, t, _ in leaves])))
    return out


@lru_cache(maxsize=2)
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, layouts: tuple[str, ...] = LAYOUTS) -> Labeller:
    data, model = [x for x in made(pages, seed, layouts) if len(x[0])], Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    rng, step = np.random.default_rng(seed), 0
    data.sort(key=lambda x: len(x[0]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for b in rng.permutation(len(batches)):
            x, mask = pad([f for f, _ in batches[b]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, label) in enumerate(batches[b]):
                y[: len(label), j] = label
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def texts(pages: list[str], model: Labeller) -> list[str]:
    leaves = [blocks(p) for p in pages]
    labels = model.label([features(x) for x in leaves])
    return ["\n\n".join(t for (_, t, _), keep in zip(x, y, strict=True) if keep) for x, y in zip(leaves, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                found = texts(part.column("html").fill_null("").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
