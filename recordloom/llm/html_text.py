"""Operator 12, HTML extraction: a recurrent block labeller reads a page's blocks and keeps those of its article.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements and
their classes.  Per block the labeller reads hashed features of its path and size and the mean vector of its
hashed words; a bidirectional LSTM in numpy runs over all blocks of the page, so that every block is classified
with the whole page as its context.  Blocks of the article are joined in page order.

The model is trained on the driver from at most PAGES pages, those with the lowest hashes of their html, so the
sample doesn't depend on ids or order.  Nobody has labelled them: a block is the article's if its innermost
element that says something (article, main; nav, footer, aside, form, ..; a class like ad, sidebar, comments,
cookie-notice) says so.  Each page is also shown in other layouts, made of its own texts: articles without
`article`, menus, sidebars, notices, adverts, forms and comments at different places under different names.

Cases.  Null and empty html, and pages without an article's block: empty text.  Tags may be unclosed, nested
wrongly or cut off; `<p>` ends an open paragraph, `<li>` an open item.  Very long pages and blocks are read whole;
a page is one sequence.  Equal pages have equal texts.  An empty table gives an empty result; repeated rows are
each returned.  Only page_id, url and html are read, whatever the other columns' names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import wordhash as wh
from recordloom.llm.storage import map_arrow

#: Pages that the model is trained on at most, and layouts that each of them is shown in.
PAGES, LAYOUTS = 200, 3
#: Buckets of path features and of words, the words' width, and the units of each direction.
PATHS, WORDS, WIDTH, UNITS = 4096, 4096, 8, 16
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Code points of a page that the model may be trained on, and innermost open elements that a path names.
SAMPLE_CHARS, DEEP = 1 << 18, 32
#: Blocks of pages that are classified at once.
AT_ONCE = 4096

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("script style template noscript textarea title iframe svg math select object head".split())
#: Elements of which text only ends with their own end tag.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
#: An element that ends another one of these when it begins.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
ENDS |= {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that a beginning paragraph, item or cell doesn't end beyond.
SCOPES = frozenset("article aside blockquote body details div dl fieldset figure footer form header html main nav ol section table td th ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"[\s\x1c-\x1f\x85\xa0]+")


class Block(NamedTuple):
    path: tuple[str, ...]  #: open block elements, each with the parts of its class, id and role: "div ad"
    text: str
    linked: int  #: code points inside links


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> str:
    names = (x for found in _NAMES.findall(attributes) for x in found if x)
    return " ".join([tag, *dict.fromkeys(p.lower() for n in names for p in _PARTS.findall(n))])


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page with text in them, in order."""
    out: list[Block] = []
    stack: list[str] = []
    pieces: list[str] = []
    opened: Counter[str] = Counter()
    linked = links = hidden = at = 0
    page, token = page or "", _TOKEN

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece) * (links > 0)

    def close() -> None:
        nonlocal linked
        if pieces:
            said = _SPACE.sub(" ", "".join(pieces)).strip()
            if said:
                out.append(Block(tuple(stack[-DEEP:]), said, linked))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden
        for e in stack[to:]:
            name = e.partition(" ")[0]
            opened[name] -= 1
            hidden -= name in HIDDEN
        del stack[to:]

    while at < len(page):
        open_at = page.find("<", at)
        if open_at < 0:
            break
        text(page[at:open_at])
        m = token.match(page, open_at)
        if m is None and token is _TOKEN and (m := _LOOSE.match(page, open_at)):
            token = _LOOSE  # a quote that never ends: from here on tags end at the next sign
        if m is None:  # a sign, no tag
            text("<")
            at = open_at + 1
            continue
        at = m.end()
        if not m.lastindex or m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if m[1]:
            close()
            if opened[tag] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].partition(" ")[0] == tag))
                links = 0
            continue
        close()
        links = 0
        ends = ENDS.get(tag)
        if ends:
            for i in range(len(stack) - 1, max(len(stack) - DEEP, 0) - 1, -1):
                name = stack[i].partition(" ")[0]
                if name in ends:
                    pop(i)
                elif name in SCOPES:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = (page.find(">", at) + 1) or len(page)
            continue
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(_element(tag, m[3]))
            opened[tag] += 1
            hidden += tag in HIDDEN
    if at < len(page):
        text(page[at:])
    close()
    return out


#: What elements and parts of class names say about the text in them, for training only.
ARTICLE_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "fieldset"}
OTHER_NAMES = {"ad", "ads", "advert", "banner", "sponsor", "sidebar", "comment", "comments", "cookie", "notice", "consent", "popup", "newsletter", "subscribe", "menu", "nav", "navbar", "navigation", "breadcrumb", "footer", "header", "share", "social", "related", "promo", "login", "search", "widget", "disclaimer", "respond", "replies", "masthead", "toolbar"}
ARTICLE_NAMES = {"article", "content", "post", "entry", "story", "text", "main", "body"}


def said_by_tags(path: tuple[str, ...]) -> bool | None:
    """Whether the innermost element that says something says that the block is the article's; None if nothing does."""
    for element in reversed(path):
        tag, *names = element.split()
        if tag in OTHER_TAGS or OTHER_NAMES.intersection(names):
            return False
        if tag in ARTICLE_TAGS or tag == "div" and ARTICLE_NAMES.intersection(names):
            return True
    return None


def _said(names: list[str], rnd: np.random.Generator) -> str:
    return names[rnd.integers(len(names))]


def relaid(found: list[Block], rnd: np.random.Generator) -> str:
    """A page in another layout, made of the texts of the given blocks."""
    main = [b.text for b in found if said_by_tags(b.path)] or [b.text for b in found]
    words = " ".join(b.text for b in found).split() or ["text"]
    esc = entities.escape
    say = lambda lo, hi: esc(" ".join(words[i] for i in rnd.integers(len(words), size=rnd.integers(lo, hi)))).capitalize()
    attr = lambda names: f' {_said(["class", "class", "id"], rnd)}="{_said(names, rnd)}"'
    items = lambda: "".join(f'<li><a href="/{i}">{say(1, 4)}</a></li>' for i in range(rnd.integers(2, 9)))
    paragraphs = lambda lo, hi, a=1, b=40: "".join(f"<p>{say(a, b)}</p>" for _ in range(rnd.integers(lo, hi)))
    wrap = lambda tags, names, inner: (lambda t: f"<{t}{attr(names)}>{inner}</{t}>")(_said(tags, rnd))
    nav = lambda: _said([f"<nav><ul>{items()}</ul></nav>", f"<nav>{items()}</nav>", wrap(["div", "ul"], ["menu", "nav", "navbar", "main-menu", "top-nav", "breadcrumbs", "navigation"], f"<ul>{items()}</ul>")], rnd)
    advert = lambda: wrap(["div", "div", "aside", "p"], ["ad", "ads", "advert", "banner", "sponsored", "ad-slot", "promo", "adsbygoogle"], say(2, 30))
    notice = lambda: wrap(["div", "section", "p", "dialog"], ["cookie-notice", "cookie", "notice", "consent", "cookie-banner", "popup", "newsletter", "alert-notice", "disclaimer"], say(4, 40) + _said(["", f"<button>{say(1, 3)}</button>"], rnd))
    sidebar = lambda: _said([f"<aside>{paragraphs(1, 3)}<ul>{items()}</ul></aside>", wrap(["div", "section"], ["sidebar", "right-sidebar", "widget", "related", "related-posts"], f"<h3>{say(1, 4)}</h3>{paragraphs(1, 3)}<ul>{items()}</ul>"), f"<aside>{paragraphs(1, 4, 5, 60)}</aside>"], rnd)
    form = lambda: f"<form{_said(['', ' class=search', ' id=login'], rnd)}><label>{say(1, 4)}</label><input><p>{say(1, 12)}</p><select><option>{say(1, 2)}</select><textarea>{say(1, 5)}</textarea><button>{say(1, 3)}</button></form>"
    one = lambda: _said([f"<div class=comment><p>{say(3, 60)}</p></div>", f"<li class=comment><b>{say(1, 3)}</b><p>{say(3, 60)}</p></li>", f"<p>{say(3, 60)}</p>", f"<article class=comment><p>{say(3, 60)}</p></article>"], rnd)
    comments = lambda: wrap(["div", "section", "div", "ol"], ["comments", "comment-list", "reader-comments", "user-comments", "comments-area", "replies", "respond"], _said(["", f"<h2>{say(1, 3)}</h2>"], rnd) + "".join(one() for _ in range(rnd.integers(1, 6))))
    header = lambda: _said([f"<header>{_said([f'<h1>{say(1, 5)}</h1>', f'<p>{say(1, 8)}</p>', nav(), say(1, 5)], rnd)}</header>", wrap(["div"], ["header", "site-header", "masthead", "page-header"], f"<p>{say(1, 8)}</p>")], rnd)
    footer = lambda: _said([f"<footer>{say(2, 20)}</footer>", f"<footer>{paragraphs(1, 4)}<ul>{items()}</ul></footer>", wrap(["div"], ["footer", "site-footer", "page-footer"], paragraphs(1, 3))], rnd)
    extra = {"nav": nav, "ad": advert, "notice": notice, "sidebar": sidebar, "form": form, "header": header}
    some = lambda p: "".join(make() for make in extra.values() if rnd.random() < p)
    start = rnd.integers(len(main))
    texts = main[start : start + rnd.integers(1, 14)]
    marks = lambda t: f"<{_said(['p', 'p', 'p', 'p', 'p', 'h2', 'li', 'blockquote', 'td', 'pre', 'div'], rnd)}>{_said(['', '<b>'], rnd)}{t}"
    closed = rnd.random() < 0.7
    body = [f"<h1>{esc(texts[0])}</h1>" if rnd.random() < 0.7 else f"<p>{esc(texts[0])}</p>"]
    for t in texts[1:]:
        shown = marks(esc(t))
        tag = shown[1 : shown.index(">")]
        body.append(shown + (f"</{tag}>" if closed or tag != "p" else ""))
        if rnd.random() < 0.06:
            body.append(_said([advert(), notice(), sidebar(), form(), nav(), _said([f"<footer>{say(1, 9)}</footer>", f"<div class=share>{say(1, 4)}</div>"], rnd)], rnd))
    inner = "".join(body)
    if rnd.random() < 0.25:
        inner += comments()
    opened = _said(["<article>", "<article>", "<article>", "<main>", '<main id="content"><article>', '<article class="post">', '<div class="article-body">', '<div class="post-content">', '<div id="content">', '<div class="entry-content">', '<div class="story">'], rnd)
    ended = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
    tail = (comments() if rnd.random() < 0.3 else "") + some(0.2)
    outer = _said([("", ""), ("", ""), ('<div class="page">', "</div>"), ('<div id="wrapper"><div class="container">', "</div></div>")], rnd)
    return f"<html><head><title>{say(1, 5)}</title></head><body>{outer[0]}{some(0.45)}{opened}{inner}{ended}{tail}{footer() if rnd.random() < 0.8 else ''}{outer[1]}</body></html>"


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % PATHS


@lru_cache(1 << 14)
def _path_features(path: tuple[str, ...]) -> tuple[int, ...]:
    inner = [e.split() for e in path]
    found = {f"{tag}" for tag, *_ in inner} | {f".{n}" for _, *names in inner for n in names}
    found |= {f"{a[0]}>{b[0]}" for a, b in zip(inner, inner[1:], strict=False)}
    for e in reversed(inner):  # the innermost elements that say something, each as one feature
        if e[0] in SCOPES | ARTICLE_TAGS | OTHER_TAGS and (e[0] not in ("div", "section", "ul", "ol", "table", "td", "th", "dl", "html", "body") or len(e) > 1):
            found.add("^" + e[0])
            found.update(f"^.{n}" for n in e[1:])
            break
    return tuple(sorted({_bucket(f) for f in found | {f"={path[-1]}" if path else "="}}))


#: Buckets of a block's size in bits and of the quarters of it that are links.
_SIZES = [_bucket(f"size {i}") for i in range(64)]
_LINKS = [_bucket(f"links {i}") for i in range(64)]


class Features(NamedTuple):
    paths: np.ndarray  #: buckets of all blocks' path features, one block after another
    path_at: np.ndarray  #: where each block's begin, and the end
    words: np.ndarray  #: buckets of all blocks' words
    word_at: np.ndarray


def features(pages: list[list[Block]]) -> list[Features]:
    """Of each page's blocks; the words of all pages are hashed together."""
    counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for part in wh.slices(pa.array([b.text.encode("utf-8", "replace").decode() for found in pages for b in found], pa.string())):
        w = wh.words(part)
        hashes.append(w.hashes)
        counts.append(w.counts)
    words = (np.concatenate(hashes) % np.uint64(WORDS)).astype(np.int64)
    word_at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    out, first = [], 0
    for found in pages:
        paths, at = [], [0]
        for b in found:
            paths.extend(_path_features(b.path))
            paths += _SIZES[len(b.text).bit_length()], _LINKS[min(4 * b.linked // max(len(b.text), 1), 63)]
            at.append(len(paths))
        ends = word_at[first : first + len(found) + 1]
        out.append(Features(np.array(paths, np.int64), np.array(at), words[ends[0] : ends[-1]], ends - ends[0]))
        first += len(found)
    return out


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows between the places at; 0 where there are none."""
    out = np.zeros((len(at) - 1, rows.shape[1]), rows.dtype)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(rows, at[:-1][full])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """A bidirectional LSTM over blocks.  path, word: features -> inputs of the gates of both directions."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        g = 4 * UNITS
        self.p = {
            "path": r.normal(0, 0.1, (PATHS, 2 * g)),
            "word": r.normal(0, 0.1, (WORDS, WIDTH)),
            "mix": r.normal(0, 0.1, (WIDTH, 2 * g)),
            "bias": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], UNITS), 2),
            "back0": r.normal(0, 0.2, (UNITS, g)),
            "back1": r.normal(0, 0.2, (UNITS, g)),
            "out": r.normal(0, 0.3, (2 * UNITS, 1)),
            "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        means = _sums(self.p["word"][f.words], f.word_at) / np.maximum(np.diff(f.word_at), 1)[:, None].astype(np.float32)
        return _sums(self.p["path"][f.paths], f.path_at) + means @ self.p["mix"] + self.p["bias"], means

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of both directions for x (page, block, gates), pages padded behind; with keep, what learning needs."""
        pages, longest, _ = x.shape
        h_all = np.zeros((pages, longest, 2 * UNITS), np.float32)
        kept = []
        for way in (0, 1):
            h, c = np.zeros((pages, UNITS), np.float32), np.zeros((pages, UNITS), np.float32)
            gates_in = x[:, :, way * 4 * UNITS : (way + 1) * 4 * UNITS]
            steps = range(longest) if way == 0 else range(longest - 1, -1, -1)
            back = self.p[f"back{way}"]
            for t in steps:
                live = (t < lengths)[:, None].astype(np.float32)
                z = gates_in[:, t] + h @ back
                i, f, o = (_sigmoid(z[:, k * UNITS : (k + 1) * UNITS]) for k in range(3))
                g = np.tanh(z[:, 3 * UNITS :])
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                h_new = o * tc
                if keep:
                    kept.append((way, t, i, f, o, g, c, tc, h, live))
                c, h = c_new * live, h_new * live
                h_all[:, t, way * UNITS : (way + 1) * UNITS] = h
        return h_all, kept

    def scores(self, pages: list[Features]) -> list[np.ndarray]:
        """Per page the chances that its blocks are the article's; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, f in enumerate(pages) if len(f.path_at) > 1), key=lambda i: len(pages[i].path_at))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * (len(pages[order[stop]].path_at) - 1) <= AT_ONCE:
                stop += 1
            group = [pages[i] for i in order[at:stop]]
            lengths = np.array([len(f.path_at) - 1 for f in group])
            x = np.zeros((len(group), lengths.max(), 8 * UNITS), np.float32)
            for j, f in enumerate(group):
                x[j, : lengths[j]] = self.inputs(f)[0]
            h, _ = self.run(x, lengths)
            said = _sigmoid(h @ self.p["out"] + self.p["shift"])[:, :, 0]
            for j, i in enumerate(order[at:stop]):
                out[i] = said[j, : lengths[j]]
            at = stop
        return out

    def learn(self, pages: list[tuple[Features, np.ndarray]], seed: int = 3) -> None:
        """Fit to pages of (features, whether each block is the article's) by Adam."""
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        rnd, n = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(pages))
            for at in range(0, len(pages), BATCH):
                n += 1
                for k, g in self.gradients([pages[i] for i in order[at : at + BATCH]]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)

    def gradients(self, batch: list[tuple[Features, np.ndarray]]) -> dict[str, np.ndarray]:
        """Of the mean log loss of a batch's blocks."""
        lengths = np.array([len(y) for _, y in batch])
        x = np.zeros((len(batch), lengths.max(), 8 * UNITS), np.float32)
        y = np.zeros((len(batch), lengths.max()), np.float32)
        means = []
        for j, (f, said) in enumerate(batch):
            x[j, : lengths[j]], mean = self.inputs(f)
            y[j, : lengths[j]] = said
            means.append(mean)
        h, kept = self.run(x, lengths, keep=True)
        inside = (np.arange(lengths.max()) < lengths[:, None]).astype(np.float32)
        error = (_sigmoid(h @ self.p["out"] + self.p["shift"])[:, :, 0] - y) * inside / inside.sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = np.einsum("pth,pt->h", h, error)[:, None]
        grad["shift"] = error.sum(keepdims=True).reshape(1)
        dh_all = error[:, :, None] * self.p["out"][:, 0]
        dx = np.zeros_like(x)
        dh = dc = None
        last = None
        for way, t, i, f, o, g, c, tc, before, live in reversed(kept):
            if way != last:
                dh, dc, last = np.zeros_like(before), np.zeros_like(before), way
            dh = (dh + dh_all[:, t, way * UNITS : (way + 1) * UNITS]) * live
            dc = dc * live + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"back{way}"] += before.T @ dz
            dx[:, t, way * 4 * UNITS : (way + 1) * 4 * UNITS] = dz
            dh, dc = dz @ self.p[f"back{way}"].T, dc * f
        for j, (f, _) in enumerate(batch):
            d = dx[j, : lengths[j]]
            np.add.at(grad["path"], f.paths, np.repeat(d, np.diff(f.path_at), axis=0))
            grad["mix"] += means[j].T @ d
            grad["bias"] += d.sum(0)
            per_word = (d @ self.p["mix"].T) / np.maximum(np.diff(f.word_at), 1)[:, None]
            np.add.at(grad["word"], f.words, np.repeat(per_word, np.diff(f.word_at), axis=0))
        return grad


def examples(pages: list[str], layouts: int = LAYOUTS, seed: int = 17) -> list[tuple[Features, np.ndarray]]:
    """Training pages: the given ones as they are, and each in other layouts; blocks of which nothing says what they are count as others."""
    rnd = np.random.default_rng(seed)
    out = []
    for page in pages:
        own = blocks(page)
        for found in [own, *(blocks(relaid(own, rnd)) for _ in range(layouts))]:
            if found:
                out.append(found)
    return [(f, np.array([bool(said_by_tags(b.path)) for b in found], np.float32)) for f, found in zip(features(out), out, strict=True)]


def train(pages: DataFrame, html: str = "html", most: int = PAGES) -> Labeller:
    """A labeller fitted to at most so many pages, of SAMPLE_CHARS at most, those with the lowest hashes of their html, each once.

    Without pages it is fitted to layouts of made-up text.
    """
    known = pages.filter(F.col(html).isNotNull() & (F.length(html) <= SAMPLE_CHARS)).select(F.xxhash64(html).alias("draw"), F.col(html).alias("html"))
    lowest = [r[0] for r in known.select("draw").distinct().orderBy("draw").limit(most).collect()]
    sample = [r[0] for r in known.filter(F.col("draw").isin(lowest)).groupBy("draw").agg(F.first("html").alias("html")).orderBy("draw").select("html").collect()] if lowest else []
    model = Labeller()
    rounds = max(1, most // max(len(sample), 1) // 4)
    model.learn(examples(sample or ["<article><p>some text of an article</p></article>"], LAYOUTS * min(rounds, 40)))
    return model


def article(found: list[Block], scores: np.ndarray) -> str:
    return " ".join(b.text for b, s in zip(found, scores, strict=True) if s >= 0.5)


def extract(pages: DataFrame, model: Labeller, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns with text.  The model's size is fixed, so it is broadcast."""
    source = pages.select(*keep, F.col(html).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model.p)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__html"), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.__new__(Labeller)
        labeller.p = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            texts: list[str] = []
            at = 0
            while at < len(column):  # some pages at a time: about a slice of bytes
                found, size = [], 0
                while at < len(column) and size < wh.SLICE_BYTES:
                    page = column[at].as_py()
                    size += len(page or "")
                    found.append(blocks(page))
                    at += 1
                texts += [article(b, s) for b, s in zip(found, labeller.scores(features(found)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_arrow(source, run, schema)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


#: For pages whose article is one `article` element without other things in it, as all given ones are.
ORACLE_SQL = r"""
WITH cut AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS t FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM cut),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM bare)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM plain
"""
