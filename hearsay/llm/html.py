"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into a tree of open elements (forgiving about unclosed ones) and cut
into leaf blocks: text between block-level tags.  Scripts, styles, form controls,
comments and the head hold no blocks.  A block is described by the tags and the
class, id and role words of its ancestors and by its text: length, links, ends of
sentences, signs.  The field labels the sequence of blocks main or not, with weights
for features, for neighbouring labels and for both ends; it is trained by maximum
likelihood (forward-backward, numpy, on the driver) and decoded by Viterbi in tasks.

Training pages are labelled pages laid out over paragraphs taken from a bounded
sample of the table (``SAMPLE_PAGES``, ``SAMPLE_LINES``, ``SAMPLE_WORDS``): many layouts and names for the article, the
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in and
around the article.

Defined cases: a null or empty page has an empty text; a page without main blocks has
an empty text; repeated rows give the same text; an empty table gives an empty table;
columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hearsay.llm.words import hash_order

SAMPLE_PAGES = 80
SAMPLE_LINES, SAMPLE_WORDS = 200, 400     # paragraphs of a sampled page, words of a paragraph
TRAIN_PAGES = 260
EPOCHS = 12
RATE = 0.05
DECAY = 1e-4
SEED = 11

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
SILENT = frozenset("script style textarea title head noscript template svg math iframe object select button "
                   "option canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p "
                   "pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("article main aside nav header footer form section table ul ol dl blockquote figure "
                     "dialog details menu address".split())
KEEPS_OPEN = frozenset("ul ol dl table td th body html article section main div".split())

#: what a new element closes: the nearest open one of the first names, unless one of the second comes before it
_CELLS = frozenset(("td", "th"))
IMPLIED = {"p": ({"p"}, KEEPS_OPEN), "li": ({"li"}, KEEPS_OPEN), "dt": ({"dt", "dd"}, KEEPS_OPEN),
           "tr": ({"tr", "td", "th"}, KEEPS_OPEN - _CELLS), "td": ({"td", "th"}, KEEPS_OPEN - _CELLS)}
#: the kinds that an open element of this name answers, by being closed or by standing before it
ANSWERS = {tag: [kind for kind, (gone, stop) in IMPLIED.items() if tag in gone or tag in stop]
           for tag in KEEPS_OPEN.union(*[gone for gone, _ in IMPLIED.values()])}
CLOSER = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"}

OPENING = re.compile(r"<(?:(!--)|([!?])|/?[A-Za-z])")
TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>\"']*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")


class Element:
    """An open element.  What a block needs to know of its ancestors is carried down, so that
    neither reading nor describing a block walks up: ``has`` is shared with the parent unless
    the element adds to it."""

    __slots__ = ("tag", "names", "parent", "silent", "linked", "inner", "own", "near", "has")

    def __init__(self, tag: str, names: list[str], parent: "Element | None", known) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        up = parent or ROOT
        self.silent = up.silent or tag in SILENT
        self.linked = up.linked or tag == "a"
        self.inner = tag if tag in SECTIONS else up.inner
        self.own = tag if tag in BLOCKS else up.own
        self.near = names or up.near
        new = [f"name:{w}" for w in names]
        if tag not in ("html", "body"):
            new.append(f"in:{tag}")
        if known is not None:
            new = [f for f in new if f in known]
        self.has = up.has if up.has.issuperset(new) else up.has.union(new)


class _Root:
    silent = linked = False
    inner = own = "none"
    near: list[str] = []
    has: frozenset[str] = frozenset()


ROOT = _Root()


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int                     # characters inside links

    def _path(self) -> list[Element]:
        path, e = [], self.element
        while e:
            path.append(e)
            e = e.parent
        return path[::-1]

    @property
    def tags(self) -> list[str]:
        """From the outside in."""
        return [e.tag for e in self._path()]


class _Tags:
    """Ends of tags: the first ``>`` outside quotes.  Every quote is followed once, however
    many broken tags lie before it."""

    def __init__(self, html: str) -> None:
        self.html, self.hopeless = html, set()
        self.stop = -1                 # first > or quote at or after the last asked place
        self.last = html.rfind(">")

    def end(self, at: int) -> int:
        """Place after the tag that is open at ``at``, or -1 where it never ends."""
        if at > self.last:
            return -1
        if self.stop < at:
            found = STOP.search(self.html, at)
            self.stop = found.start() if found else len(self.html)
        seen, place = [], self.stop
        while place < len(self.html) and place not in self.hopeless:
            sign = self.html[place]
            if sign == ">":
                return place + 1
            seen.append(place)
            back = self.html.find(sign, place + 1)
            found = STOP.search(self.html, back + 1) if back >= 0 else None
            if not found:
                break
            place = found.start()
        self.hopeless.update(seen)
        return -1


def leaf_blocks(html: str | None, known=None) -> list[Block]:
    """Blocks of a page; time and memory grow with its length.  ``known`` limits the ancestor
    features that are collected to those that a model has."""
    html = html or ""
    blocks: list[Block] = []
    open_now: Counter[str] = Counter()
    answers: dict[str, list[Element]] = {kind: [] for kind in IMPLIED}  # open elements, the nearest last
    top: Element | None = None
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, top, linked))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not (top and top.silent):
            text = unescape(raw)
            parts.append(text)
            if top and top.linked:
                linked += len(text.strip())

    def leave(element: Element) -> None:
        """Close an open element and all inside it."""
        nonlocal top
        while True:
            gone, top = top, top.parent
            open_now[gone.tag] -= 1
            for kind in ANSWERS.get(gone.tag, ()):
                answers[kind].pop()
            if gone is element:
                return

    def implied(kind: str) -> None:
        if answers[kind] and answers[kind][-1].tag in IMPLIED[kind][0]:
            leave(answers[kind][-1])

    tags, at, look, ends = _Tags(html), 0, 0, {}
    while True:
        opening = OPENING.search(html, look)
        if not opening:
            say(html[at:])
            break
        start = opening.start()
        look = start + 1
        if opening[1]:
            end = html.find("-->", start + 4)
            end = len(html) if end < 0 else end + 3
            say(html[at:start])
            at = look = end
            continue
        if opening[2]:
            end = html.find(">", start) + 1 if start < tags.last else 0
            if end:
                say(html[at:start])
                at = look = end
            continue
        end = tags.end(start)
        if end < 0:
            continue
        say(html[at:start])
        at = look = end
        found = TAG_NAME.match(html, start, end)
        tag, rest = found[2].lower(), html[found.end():end - 1]
        if found[1]:
            if tag in BLOCKS:
                flush()
            if open_now[tag]:
                element = top
                while element.tag != tag:
                    element = element.parent
                leave(element)
            continue
        if tag in BLOCKS:
            flush()
            implied("p")
            if tag in CLOSER:
                implied(CLOSER[tag])
        if tag == "br":
            parts.append(" ")
        if tag in VOID or rest.endswith("/"):
            continue
        names = [w for m in NAMED.finditer(rest) for w in NAME_WORD.findall(
            (m[1] or m[2] or m[3] or "").lower())] if rest else []
        top = Element(tag, names, top, known)
        open_now[tag] += 1
        for kind in ANSWERS.get(tag, ()):
            answers[kind].append(top)
        if tag in RAW:
            if tag not in ends or 0 <= ends[tag] < at:
                closing = re.compile(rf"</{tag}", re.I).search(html, at)
                ends[tag] = closing.start() if closing else -1
            at = look = ends[tag] if ends[tag] >= 0 else len(html)
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        e = b.element or ROOT
        has = {"bias", f"inner:{e.inner}", f"own:{e.own}", f"both:{e.inner}/{e.own}", *e.has,
               *(f"near:{w}" for w in e.near)}
        n, words = len(b.text), b.text.count(" ") + 1
        has.add(f"words:{min(words.bit_length(), 7)}")
        share = b.linked / n
        has.add("links:" + ("most" if share > 0.6 else "some" if share > 0.2 else "few" if share else "none"))
        if b.text[-1] in ".!?…":
            has.add("ends")
        if "," in b.text:
            has.add("comma")
        if any(c in b.text for c in "©®|»›"):
            has.add("signs")
        has.add(f"part:{min(3, 4 * i // len(blocks))}")
        out.append(sorted(has))
    return out


class Field:
    """Weights: two per feature, label to label, first and last label.  Label 1 is main."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.state = np.zeros((0, 2))
        self.move, self.first, self.last = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def scores(self, page: list[list[str]]) -> np.ndarray:
        rows: dict[tuple[str, ...], int] = {}  # blocks of equal features have equal scores
        at = [rows.setdefault(tuple(has), len(rows)) for has in page]
        out = np.zeros((len(rows), 2))
        for i, has in enumerate(rows):
            known = [k for k in map(self.index.get, has) if k is not None]
            out[i] = self.state[known].sum(axis=0)
        return out[at]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        s = self.scores(page).tolist()
        move = self.move.tolist()
        best, back = [self.first[y] + s[0][y] for y in (0, 1)], []
        for i in range(1, len(s)):
            came, now = [], []
            for y in (0, 1):
                stay = [best[z] + move[z][y] for z in (0, 1)]
                z = int(stay[1] > stay[0])
                came.append(z)
                now.append(stay[z] + s[i][y])
            back.append(came)
            best = now
        y = int(best[1] + self.last[1] > best[0] + self.last[0])
        labels = [y]
        for came in reversed(back):
            y = came[y]
            labels.append(y)
        return labels[::-1]

    def _expect(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: label shares per block, shares of label pairs summed."""
        n = len(s)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = self.first + s[0]
        for i in range(1, n):
            fore[i] = np.logaddexp(fore[i - 1][0] + self.move[0], fore[i - 1][1] + self.move[1]) + s[i]
        aft[-1] = self.last
        for i in range(n - 2, -1, -1):
            ahead = aft[i + 1] + s[i + 1]
            aft[i] = np.logaddexp(self.move[:, 0] + ahead[0], self.move[:, 1] + ahead[1])
        total = np.logaddexp(*(fore[-1] + self.last))
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = fore[:-1, :, None] + self.move[None] + (aft[1:] + s[1:])[:, None, :]
            pairs = np.exp(joint - total).sum(axis=0)
        return np.exp(fore + aft - total), pairs

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], epochs: int = EPOCHS,
            rate: float = RATE, seed: int = SEED) -> "Field":
        for page in pages:
            for has in page:
                for f in has:
                    self.index.setdefault(f, len(self.index))
        self.state = np.zeros((len(self.index), 2))
        coded = [[np.array([self.index[f] for f in has]) for has in page] for page in pages]
        speed = np.full(self.state.shape, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                page, y = coded[k], np.array(labels[k])
                if not len(y):
                    continue
                share, pairs = self._expect(np.stack([self.state[has].sum(axis=0) for has in page]))
                err = np.eye(2)[y] - share
                for has, e in zip(page, err):  # AdaGrad: rare features keep a large step
                    speed[has] += e * e
                    self.state[has] += rate * e / np.sqrt(speed[has]) - rate * DECAY * self.state[has]
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                self.move += 0.1 * rate * (seen - pairs)
                self.first += 0.1 * rate * err[0]
                self.last += 0.1 * rate * err[-1]
        return self


# ------------------------------------------------------------------ labelled pages

MAIN_NAMES = ("content", "post", "entry", "article-body", "story", "main-content", "post-content", "text",
              "entry-content", "article", "body-copy", "page-content")
OFF_NAMES = {
    "menu": ("menu", "navbar", "nav-links", "breadcrumbs", "topbar", "site-nav", "pagination", "toc"),
    "head": ("header", "site-header", "masthead", "branding", "top"),
    "foot": ("footer", "site-footer", "copyright", "bottom", "legal"),
    "side": ("sidebar", "widget", "related", "aside", "recommended", "popular", "more-stories", "trending"),
    "note": ("cookie", "notice", "cookie-notice", "consent", "banner", "alert", "gdpr", "popup", "modal", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor"),
    "form": ("newsletter", "subscribe", "signup", "search", "login", "contact-form"),
    "say": ("comments", "comment", "comment-list", "replies", "responses", "discussion", "disqus"),
    "share": ("share", "social", "tags", "byline-links", "follow"),
}
OFF_TAGS = {"menu": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div"),
            "side": ("aside", "div", "section"), "note": ("div", "section", "aside", "dialog"),
            "ad": ("div", "aside", "section"), "form": ("form", "div"),
            "say": ("section", "div", "ol"), "share": ("div", "ul")}
MARK = "\x01"  # put before main text while a page is laid out, gone before training


class _Layout:
    def __init__(self, lines: list[str], rng: np.random.Generator) -> None:
        self.lines, self.rng = lines, rng

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def line(self, short: bool = False) -> str:
        words = self.pick(self.lines).split()
        return escape(" ".join(words[:int(self.rng.integers(1, 5))] if short else words), quote=False)

    def off(self, kind: str) -> str:
        tag = self.pick(OFF_TAGS[kind])
        plain = tag not in ("div", "section", "ol", "ul") and self.rng.random() < 0.6
        name = "" if plain else f' {self.pick(("class", "id"))}="{self.pick(OFF_NAMES[kind])}"'
        some = range(int(self.rng.integers(1, 6)))
        link = lambda: f'<a href="/{int(self.rng.integers(999))}">{self.line(True)}</a>'
        if kind in ("menu", "share"):
            items = "".join(f"<li>{link()}</li>" for _ in some)
            body = items if tag == "ul" else f"<ul>{items}</ul>" if self.rng.random() < 0.7 else \
                " | ".join(link() for _ in some)
        elif kind == "say":
            wrap = "li" if tag == "ol" else "div"
            inner = f' class="{self.pick(("comment", "reply", "comment-body"))}"' if self.rng.random() < 0.6 else ""
            body = "".join(f"<{wrap}{inner}><b>{self.line(True)}</b><p>{self.line()}</p></{wrap}>" for _ in some)
            body = (f"<h3>{self.line(True)}</h3>" if self.rng.random() < 0.5 and tag != "ol" else "") + body
        elif kind == "form":
            body = f"<p>{self.line()}</p><label>{self.line(True)}</label><input name=q><button>Go</button>"
            body = body if tag == "form" else f"<form action=/s>{body}</form>"
        elif kind == "side":
            body = f"<h3>{self.line(True)}</h3>" + (
                f"<ul>{''.join(f'<li>{link()}</li>' for _ in some)}</ul>" if self.rng.random() < 0.5
                else "".join(f"<p>{self.line()}</p>" for _ in some[:2]))
        elif kind == "head":
            body = f"<h1>{self.line(True)}</h1><p>{self.line(True)}</p>" if self.rng.random() < 0.5 else link()
        elif kind == "foot":
            body = f"&copy; {self.line(True)} &middot; {self.line()}" if self.rng.random() < 0.6 else \
                f"<p>{self.line()}</p><ul><li>{link()}</li></ul>"
        else:
            body = self.line() if self.rng.random() < 0.6 else f"<p>{self.line()}</p>{link()}"
        return f"<{tag}{name}>{body}</{tag}>"

    def main(self) -> str:
        parts = [f"<h1>{MARK}{self.line(True)}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(int(self.rng.integers(2, 12))):
            r = self.rng.random()
            said = f"{MARK}{self.line()}"
            if r < 0.68:
                parts.append(f"<p>{said}</p>")
            elif r < 0.74:
                parts.append(f"<p><b>{said}<br>")
            elif r < 0.80:
                parts.append(f"<h2>{MARK}{self.line(True)}</h2>")
            elif r < 0.86:
                items = "".join(f"<li>{MARK}{self.line(self.rng.random() < 0.5)}</li>" for _ in range(3))
                parts.append(f"<ul>{items}</ul>")
            elif r < 0.90:
                parts.append(f"<blockquote>{said}</blockquote>")
            elif r < 0.93:
                parts.append(f"<p>{said} <a href=/x>{self.line(True)}</a> {self.line()}</p>")
            elif r < 0.96:
                parts.append(f"<div>{said}</div>")
            else:
                parts.append(f"<table><tr><td>{MARK}{self.line(True)}<td>{MARK}{self.line(True)}</table>")
        for kind in ("ad", "side", "form", "share", "note", "say"):
            if self.rng.random() < 0.22:
                at = len(parts) if kind in ("say", "share") else int(self.rng.integers(len(parts) + 1))
                parts.insert(at, self.off(kind))
        body, r = "".join(parts), self.rng.random()
        if r < 0.4:
            return f"<article>{body}</article>"
        if r < 0.55:
            return f"<main>{body}</main>"
        name = f'{self.pick(("class", "id"))}="{self.pick(MAIN_NAMES)}"'
        if r < 0.75:
            return f"<div {name}>{body}</div>"
        if r < 0.85:
            return f"<main><article><div {name}>{body}</div></article></main>"
        return f"<section {name}>{body}</section>" if r < 0.95 else f"<div>{body}</div>"

    def page(self) -> str:
        before = [self.off(k) for k in ("head", "menu", "note", "ad", "side") if self.rng.random() < 0.55]
        after = [self.off(k) for k in ("say", "side", "ad", "share", "form", "note", "foot") if self.rng.random() < 0.45]
        wrap = ('<div class="wrapper">', "</div>") if self.rng.random() < 0.3 else ("", "")
        return ("<html><head><title>t</title></head><body>" + wrap[0] + "".join(before) + self.main()
                + "".join(after) + wrap[1] + "</body></html>")


def labelled_pages(lines: list[str], count: int = TRAIN_PAGES, seed: int = SEED) -> tuple[list, list]:
    """Features and labels of ``count`` laid out pages over the given lines of prose."""
    layout = _Layout(lines, np.random.default_rng(seed))
    pages, labels = [], []
    for _ in range(count):
        blocks = leaf_blocks(layout.page())
        labels.append([int(MARK in b.text) for b in blocks])
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "-"
        pages.append(features(blocks))
    return pages, labels


def _prose(lines: int, words: int):
    """Paragraphs of a page for the training layouts, in order of a hash."""
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out = []
            for page in pages:
                found = {" ".join(b.text.replace(MARK, " ").split(" ", words)[:words]) for b in leaf_blocks(page, ())
                         if b.element and b.element.tag in ("p", "b", "li", "a", "div")}
                out.append(sorted(found, key=lambda x: (zlib.crc32(x.encode("utf-8", "replace")), x))[:lines])
            yield pd.Series(out)

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(read, "array<string>")


def sample_lines(pages: DataFrame, html_col: str = "html", rows: int = SAMPLE_PAGES, lines: int = SAMPLE_LINES,
                 words: int = SAMPLE_WORDS) -> list[str]:
    """Lines of prose for the training pages: at most ``lines`` paragraphs, of each at most
    ``words`` words, of at most ``rows`` different pages.  Pages are chosen by the hash of
    all of their text before any of it moves."""
    keyed = pages.where(F.length(html_col) > 0).select(hash_order(F.col(html_col)).alias("_k"), F.col(html_col).alias("_h"))
    keys = [r["_k"] for r in keyed.select("_k").distinct().orderBy("_k").limit(rows).collect()]
    found = (keyed.where(F.col("_k").isin(keys)).withColumn("_l", _prose(lines, words)("_h"))
             .groupBy("_k").agg(F.first("_l").alias("_l")).collect()) if keys else []
    said = sorted({x for r in found for x in r["_l"]})
    return [x for x in said if x.strip()] or ["Nothing was said here, and nothing more."]


def train(pages: DataFrame, html_col: str = "html") -> Field:
    return Field().fit(*labelled_pages(sample_lines(pages, html_col)))


def main_text(model: Field, html: str | None) -> str:
    blocks = leaf_blocks(html, model.index)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks))) if y)


def _extracting(model: Field):
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(model, p) for p in pages], dtype=object)

    extract.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(extract, StringType())


def extract(pages: DataFrame, model: Field | None = None, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every row."""
    named = pages.drop("text", "n_chars")
    return (named.withColumn("text", _extracting(model or train(named, html_col))(F.col(html_col)))
            .withColumn("n_chars", F.length("text").cast("long")))
