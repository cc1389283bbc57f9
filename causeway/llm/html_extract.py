"""HTML extraction: a bidirectional LSTM labels every leaf block of a page.

A page is cut into leaf blocks (text between block-level tags, in page order).  A block is
a vector: hashed tag-path tokens (tags, words of class and id), hashed words, and a few
shares and lengths.  The LSTM reads the page's blocks in both directions, so each label
uses the whole page.  It is trained here, on pages written by ``training_pages``: layouts
of many kinds with text in invented words, so it learns layout and not a vocabulary.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import map_arrow, process_store, read, text_of

PATH_BINS, WORD_BINS, HIDDEN = 128, 32, 24
#: Pages and passes of the training; a bounded set that does not depend on the input.
TRAIN_PAGES, EPOCHS, SEED = 420, 7, 11
#: Pages without names of any kind, on which a labeller of its own is trained.
PLAIN_PAGES = 160

# The rest of a tag: names with or without a value.  A quote opens a value only directly after
# "=" and only if it is closed; elsewhere it is a character, so the tag ends at its own ">".
_REST = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
# Contents of the elements named here are no text; an svg may close itself, as foreign content.
_TAG = re.compile(r"<!--.*?(?:-->|$)"
                  r"|<svg(?=[\s/>])" + _REST + r"(?:(?<=/)>|>.*?(?:</svg\s*>|$))"
                  r"|<(script|style|noscript|template|textarea|iframe|title)(?=[\s/>])" + _REST + r">.*?(?:</\1\s*>|$)"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)(" + _REST + r")(?:>|$)"
                  r"|<[!?][^>]*(?:>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W_]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends when one of the second opens.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
                       "table ul".split()),
        "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
        "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


class Block:
    """A leaf: its path tokens, its text, and how many of its characters are links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, blank ones left out."""
    out, stack, parts, linked, at = [], [], [], 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block([t for _, tokens in stack for t in tokens], text, linked))
            parts.clear()
        linked = 0

    def say(raw):
        nonlocal linked
        if raw:
            raw = html.unescape(raw)
            parts.append(raw)
            if any(name == "a" for name, _ in stack):
                linked += len(raw.strip())

    for m in _TAG.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[2]:        # an end tag: closes up to its element, if there is one
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            for k in range(len(stack) - 1, -1, -1):     # elements that end here, through inline ones
                if name in ENDS.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            tokens = [name]
            for key, *values in _ATTRIBUTE.findall(m[4]):
                tokens += ["." + w.lower() for v in values if v for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", v) if w]
            if not m[4].rstrip().endswith("/") or name in INLINE:
                stack.append((name, tokens))
    say(page[at:])
    flush()
    return out


def _bin(token: str, bins: int) -> int:
    return zlib.crc32(token.encode()) % bins


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: path bins, word bins, shares and lengths."""
    store = process_store("html bins")
    path_bin, word_bin = store.setdefault("path", {}), store.setdefault("word", {})
    x = np.zeros((len(page), PATH_BINS + WORD_BINS + 10), dtype=np.float32)
    for k, b in enumerate(page):
        if len(path_bin) > 50_000:
            path_bin.clear()
        if len(word_bin) > 200_000:
            word_bin.clear()
        for token in b.path:
            if token not in path_bin:
                path_bin[token] = _bin(token, PATH_BINS)
            x[k, path_bin[token]] = 1
        words = _WORD.findall(b.text.lower())
        for w in words:
            if w not in word_bin:
                word_bin[w] = PATH_BINS + _bin(w, WORD_BINS)
        if words:
            x[k] += np.bincount([word_bin[w] for w in words], minlength=x.shape[1]).astype(np.float32) / len(words)
        n = len(b.text)
        x[k, -10:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1, b.linked / n), b.text[-1] in ".!?", b.text.count(",") / max(1, len(words)),
                      "©" in b.text, len(_DIGIT.findall(b.text)) / n, k / len(page), 1 / (1 + k), 1 / (len(page) - k))
    return x


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, rng, inputs, hidden):
        self.wx = (rng.normal(size=(inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
        self.wh = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden:2 * hidden] = 1

    def forward(self, x, mask):
        """x: (time, batch, inputs), mask: (time, batch, 1); outside the mask the state stays."""
        steps, batch, _ = x.shape
        n = self.wh.shape[0]
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        pre = x @ self.wx + self.b
        hs, tape = np.zeros((steps, batch, n), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-z[:, :3 * n]))
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            h_new = o * tc
            tape.append((h, c, i, f, o, g, tc))
            h, c = h + mask[t] * (h_new - h), c + mask[t] * (c_new - c)
            hs[t] = h
        return hs, tape

    def backward(self, x, mask, tape, dhs):
        n = self.wh.shape[0]
        dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
        dwh = np.zeros_like(self.wh)
        dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[t]
            dh = dh + dhs[t]
            dh_new, dc_new = dh * mask[t], dc * mask[t]
            dc_in = dc_new + dh_new * o * (1 - tc * tc)
            dz = np.concatenate([dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), dh_new * tc * o * (1 - o), dc_in * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = dh * (1 - mask[t]) + dz @ self.wh.T
            dc = dc * (1 - mask[t]) + dc_in * f
        flat = dz_all.reshape(-1, 4 * n)
        return x.reshape(len(flat), -1).T @ flat, dwh, flat.sum(axis=0)


class Labeller:
    """Bidirectional LSTM over a page's block vectors; a probability of main text a block."""

    def __init__(self, hidden=HIDDEN, seed=SEED):
        rng = np.random.default_rng(seed)
        inputs = PATH_BINS + WORD_BINS + 10
        self.left, self.right = Lstm(rng, inputs, hidden), Lstm(rng, inputs, hidden)
        self.w = (rng.normal(size=(2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    @property
    def parameters(self):
        return [self.left.wx, self.left.wh, self.left.b, self.right.wx, self.right.wh, self.right.b, self.w, self.c]

    @staticmethod
    def padded(pages):
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(pages), 1), np.float32)
        for k, p in enumerate(pages):
            x[:len(p), k] = p
            mask[:len(p), k] = 1
        return x, mask

    def forward(self, x, mask):
        a, tape_a = self.left.forward(x, mask)
        b, tape_b = self.right.forward(x[::-1], mask[::-1])
        hidden = np.concatenate([a, b[::-1]], axis=2)
        return 1 / (1 + np.exp(-(hidden @ self.w + self.c))), hidden, tape_a, tape_b

    def gradients(self, x, mask, y):
        p, hidden, tape_a, tape_b = self.forward(x, mask)
        dz = (p - y) * mask / mask.sum()
        dh = dz @ self.w.T
        n = self.left.wh.shape[0]
        flat = hidden.reshape(-1, 2 * n)
        ga = self.left.backward(x, mask, tape_a, dh[:, :, :n])
        gb = self.right.backward(np.ascontiguousarray(x[::-1]), mask[::-1], tape_b, dh[::-1, :, n:])
        return [*ga, *gb, flat.T @ dz.reshape(-1, 1), dz.sum(axis=(0, 1))]

    def fit(self, pages, labels, epochs=EPOCHS, batch=16, rate=0.01, seed=SEED):
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.parameters]
        v = [np.zeros_like(p) for p in self.parameters]
        order, step = np.argsort([len(p) for p in pages], kind="stable"), 0
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = self.padded([pages[k] for k in groups[g]])
                y, _ = self.padded([labels[k][:, None] for k in groups[g]])
                step += 1
                for q, d, a, b in zip(self.parameters, self.gradients(x, mask, y), m, v):
                    d = np.clip(d, -1, 1)
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    q -= (rate * 0.75 ** epoch * a / (1 - 0.9 ** step) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block is main text; pages go in groups of like length."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        for at in range(0, len(order), 64):
            group = order[at:at + 64]
            p = self.forward(*self.padded([vectors(pages[k]) for k in group]))[0]
            for j, k in enumerate(group):
                out[k] = (p[:len(pages[k]), j, 0] >= 0.5).tolist()
        return out


# Words of class names that layouts use, by what they hold.
LAYOUT = {
    "main": ("content", "main content", "post", "entry content", "article body", "story", "post content", "page content", "text", "body copy"),
    "menu": ("menu", "nav", "navbar", "main menu", "top nav", "breadcrumb", "breadcrumbs", "navigation", "tabs", "toc", "pagination", "pager"),
    "header": ("header", "site header", "masthead", "top bar", "banner", "branding", "logo"),
    "footer": ("footer", "site footer", "bottom", "copyright", "legal", "colophon", "credits"),
    "side": ("sidebar", "side bar", "aside", "widget", "related", "related posts", "recommended", "trending", "more stories", "popular", "rail", "tags"),
    "notice": ("cookie notice", "cookie banner", "notice", "consent", "gdpr", "alert", "modal", "popup", "overlay", "paywall", "disclaimer", "newsletter"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad slot", "adsbygoogle", "banner ad"),
    "form": ("form", "search", "search form", "login", "signup", "subscribe", "newsletter form", "contact form"),
    "comments": ("comments", "comment", "comment list", "comments area", "reader comments", "discussion", "replies", "responses", "disqus", "respond"),
    "share": ("share", "social", "share buttons", "social links", "follow us"),
}
STOCK = {"menu": "Home About Contact News Blog Login Products Services Help", "footer": "All rights reserved Privacy Terms Contact Imprint",
         "notice": "We use cookies to improve your experience Accept Decline Learn more", "ad": "Advertisement Sponsored Buy now Shop sale",
         "form": "Search Email Name Password Send Subscribe Sign up Submit", "comments": "Reply says Comments Leave a comment posted ago",
         "share": "Share Tweet Like Follow us Facebook Email Print", "side": "Related Popular Read more Latest posts Tags Archive",
         "header": "Skip to content Menu Welcome"}


def training_page(rnd: random.Random) -> tuple[str, list[str]]:
    """An invented page, and the texts of its main blocks in order."""
    syllables = ["".join(rnd.choice("bcdfghlmnprst") + rnd.choice("aeiouéäöñ") + rnd.choice(["", "", "n", "r", "s", "th"])) for _ in range(60)]
    common = ["".join(rnd.choices(syllables, k=1)) for _ in range(12)]
    style = rnd.random()

    def words(n):
        out = [rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n)]
        if style < 0.06:
            out = [w + rnd.choice(["$$$", "###", "***", "%%%", "&amp;&amp;"]) for w in out]
        elif style < 0.10:
            out = [w.upper() + "!!" for w in out]
        return out

    def sentence(n):
        ws = words(n)
        ws[0] = ws[0].capitalize()
        return (" | " if 0.10 < style < 0.13 else " ").join(w + ("," if rnd.random() < 0.1 else "") for w in ws) + "."

    def prose():
        return " ".join(sentence(rnd.randint(1, 16)) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])))

    def named(kind):
        tag = rnd.choice(["div", "div", "section"])
        names = rnd.choice(LAYOUT[kind]).split()
        text = rnd.choice(["-", "_", " ", ""]).join(names)
        return tag, rnd.choice([f' class="{text}"', f' id="{text}"', f" class='{text} {rnd.choice(['wide', 'box', 'col', 'wrap', 'block', 'clearfix'])}'"])

    def wrap(kind, inner, plain=None):
        if plain and rnd.random() < 0.6:
            return f"<{plain}>{inner}</{plain}>"
        tag, attributes = (plain or "div", named(kind)[1]) if plain and rnd.random() < 0.5 else named(kind)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def links(n, stock):
        items = [f'<a href="/{k}">{rnd.choice(STOCK[stock].split()) if rnd.random() < 0.4 else " ".join(words(rnd.randint(1, 4)))}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rnd.random() < 0.7 else rnd.choice([" ", " | ", "\n"]).join(items)

    def stock(kind):
        ws = STOCK[kind].split()
        return " ".join(rnd.choices(ws, k=rnd.randint(1, 5))) if rnd.random() < 0.4 else prose() if rnd.random() < 0.8 else prose() + " " + " ".join(ws)

    main: list[str] = []

    def keep(text):
        main.append(" ".join(html.unescape(text).split()))
        return text

    def noise():
        kind = rnd.choice(["ad", "ad", "share", "form", "notice", "side"])
        if kind == "form":
            return rnd.choice(["<form>", '<form class="search">']) + f"<label>{stock('form')}</label><input type=text><button>{stock('form')}</button></form>"
        if kind == "side":
            return wrap("side", (f"<h3>{stock('side')}</h3>" if rnd.random() < 0.5 else "") + (links(rnd.randint(1, 6), "side") if rnd.random() < 0.7 else f"<p>{prose()}</p>"), "aside")
        if kind == "notice":
            return wrap("notice", f"<p>{stock('notice')}</p>" if rnd.random() < 0.5 else stock("notice"))
        return f"<!-- {kind} -->" * (rnd.random() < 0.5) + wrap(kind, stock(kind) if kind == "ad" else links(3, "share"))

    parts = [f"<{rnd.choice(['h1', 'h1', 'h1', 'h2'])}>{keep(sentence(rnd.randint(1, 10)))}</h1>".replace("</h1>", "")]
    parts[0] += "</" + parts[0][1:3] + ">"
    broken = rnd.random() < 0.35
    for _ in range(rnd.choice([1, 2, 4, 7, 12, 25])):
        kind = rnd.random()
        if kind < 0.06:
            parts.append(f"<{rnd.choice(['h2', 'h3'])}>{keep(sentence(rnd.randint(1, 7)))}</h2>")
        elif kind < 0.10:
            parts.append("<ul>" + "".join(f"<li>{keep(sentence(rnd.randint(1, 9)))}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>")
        elif kind < 0.13:
            parts.append(f"<blockquote><p>{keep(prose())}</p></blockquote>")
        elif kind < 0.15:
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(' '.join(words(rnd.randint(1, 3))))}</td>" for _ in range(2)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
        elif kind < 0.17:
            parts.append(f"<figure><img src=x><figcaption>{keep(sentence(5))}</figcaption></figure>")
        elif kind < 0.22:
            parts.append(noise())
        elif broken and kind < 0.45:
            parts.append(f"<p><b>{keep(prose())}<br>")
        else:
            a, b = prose(), sentence(rnd.randint(1, 4))
            keep(a + " " + b)
            parts.append(f"<p>{a} {rnd.choice(['<a href=x>{}</a>', '<b>{}</b>', '<em>{}</em>', '{}']).format(b)}</p>")
    inner = "".join(parts)
    article = rnd.choice([f"<article>{inner}</article>"] * 3 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", wrap("main", inner),
                          wrap("main", inner, "article"), wrap("main", inner, "main"), f'<div class="container"><div class="row">{wrap("main", inner)}</div></div>'])
    head = []
    if rnd.random() < 0.4:
        head.append(wrap("header", f"<a href=/>{stock('header')}</a>" + (f"<p>{prose()}</p>" if rnd.random() < 0.3 else ""), "header"))
    if rnd.random() < 0.85:
        head.append(wrap("menu", links(rnd.randint(2, 9), "menu"), "nav"))
    if rnd.random() < 0.3:
        head.append(wrap("notice", f"<p>{stock('notice')}</p><button>{stock('form')}</button>"))
    if rnd.random() < 0.6:
        head.append(noise())
    rnd.shuffle(head)
    tail = []
    if rnd.random() < 0.35:
        n = rnd.randint(1, 6)
        one = lambda: rnd.choice(["<li class=comment>{}</li>", '<div class="comment">{}</div>', "<p>{}</p>", "<article class=comment><b>{0}</b><p>{0}</p></article>"]).format(prose())
        tail.append(wrap("comments", f"<h3>{stock('comments')}</h3>" + "".join(one() for _ in range(n))))
    for _ in range(rnd.choice([0, 0, 1, 2])):
        tail.append(noise())
    if rnd.random() < 0.9:
        tail.append(wrap("footer", rnd.choice(["&copy; ", "&copy; 2024 ", ""]) + f"{'.'.join(words(3))} &middot; " * (rnd.random() < 0.5) + stock("footer")
                         + (links(3, "footer") if rnd.random() < 0.4 else ""), "footer"))
    side = wrap("side", f"<h3>{stock('side')}</h3>" + links(rnd.randint(2, 8), "side") + (f"<p>{prose()}</p>" if rnd.random() < 0.4 else ""), "aside") if rnd.random() < 0.3 else ""
    body = "".join(head) + (side + article if rnd.random() < 0.5 else article + side) + "".join(tail)
    page = (f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{main[0]}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
            f"<body>{body}</body></html>")
    if rnd.random() < 0.1:      # cut off inside the article
        page = page[:page.index(inner) + rnd.randint(1, len(inner))]
    return page, main


def plain_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A page without classes, ids or sectioning tags, as (html, main blocks): a heading and
    blocks of prose in bare ``div`` or ``p``, between a list of links and a line of copyright."""
    _, prose = training_page(rnd)
    menu = STOCK["menu"].split()
    main, tag = [], rnd.choice(["div", "div", "p"])
    if rnd.random() < 0.8:
        main.append(prose[0])
    body = [f"<h1>{html.escape(prose[0])}</h1>"] if main else []
    for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])):
        words = " ".join(" ".join(rnd.choice(prose).split()) for _ in range(rnd.choice([1, 2, 4]))).rstrip(",;") + "."
        main.append(words)
        body.append(f"<{tag}>{html.escape(words)}</{tag}>")
    inner = rnd.choice(["{}", "{}", "<div>{}</div>", "<div><div>{}</div></div>"]).format("".join(body))
    links = [f'<a href="/{w}">{w}</a>' for w in rnd.sample(menu, min(len(menu), rnd.randint(2, 6)))]
    head = rnd.choice(["", "<div>{}</div>", "<ul><li>{}</li></ul>"]).format(rnd.choice([" ", " | "]).join(links))
    foot = rnd.choice(["", "<div>&copy; 2024 {}</div>", "<p>&copy; {}</p>"]).format(" ".join(STOCK["footer"].split()[:rnd.randint(1, 4)]))
    whole = head + inner + foot
    return rnd.choice(["<html><body>{}</body></html>", "{}", "<!DOCTYPE html><html><head><title>x</title></head><body>{}</body></html>"]).format(whole), main


def training_pages(n: int = TRAIN_PAGES, seed: int = SEED, write=training_page) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of invented pages; a block is main where the page's writer kept it."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        page, main = write(rnd)
        found, at, y = blocks(page), 0, []
        for b in found:
            hit = at < len(main) and (b.text == main[at] or main[at].startswith(b.text) and b is found[-1])
            at += hit
            y.append(float(hit))
        out.append((found, np.array(y, np.float32)))
    return out


#: Tags that tell the parts of a page apart.
SECTIONS = {"article", "main", "nav", "header", "footer", "aside", "section", "form"}


def nameless(page: list[Block]) -> bool:
    """Whether nothing but the words and plain tags can tell a page's parts apart: no block
    lies under a class, an id or a sectioning tag."""
    return not any(token[0] == "." or token in SECTIONS for b in page for token in b.path)


@dataclass
class Labellers:
    """A labeller for pages whose parts are named in some way, and one for nameless pages."""

    named: Labeller
    plain: Labeller

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        out: list = [None] * len(pages)
        for model, plain in ((self.named, False), (self.plain, True)):
            at = [k for k, p in enumerate(pages) if nameless(p) == plain]
            for k, labels in zip(at, model.label([pages[k] for k in at]) if at else []):
                out[k] = labels
        return out


def _fitted(pages: list[tuple[list[Block], np.ndarray]]) -> Labeller:
    return Labeller().fit([vectors(b) for b, _ in pages], [y for _, y in pages])


@lru_cache(maxsize=1)
def trained() -> Labellers:
    """The labellers, trained once in a process; the same weights every time."""
    return Labellers(_fitted(training_pages()), _fitted(training_pages(PLAIN_PAGES, SEED + 1, plain_page)))


def extract(pages: list[str], model: Labellers) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(bs, label) if keep) for bs, label in zip(found, model.label(found))]


def extract_text(pages: DataFrame, model: Labellers | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A NULL or empty html has the empty text; NULL keys stay; repeated rows give repeated
    results; an empty table gives an empty one.  Other columns are not read.  Row-local:
    the weights (a fixed size) go out with the tasks, a task holds a few pages at a time."""
    model = model or trained()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                texts = extract(b.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return map_arrow(slim, run, "page_id long, url string, text string, n_chars long", caches="html bins")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
