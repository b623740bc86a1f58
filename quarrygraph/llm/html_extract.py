"""Main text of HTML pages: a bidirectional LSTM labels every block of a page with the whole page in view.

A page's leaves are its runs of text between block-level tags. Each becomes a vector of its
hashed tag path (names, classes, ids and roles of its ancestors), its hashed words, and a few
measures. The network reads the sequence both ways and says main text or not for each leaf.
It is trained in numpy on generated pages, as no table marks main text. A page of more than WINDOW leaves is
read in windows: the state passes from one to the next, forth and then back, so that memory for vectors and states doesn't grow with the page.

Scripts, styles, comments, templates and the head never are text. Text in form controls isn't either.

Defined cases: a null or empty html gives an empty text; unclosed tags and stray ends are taken as
they come, and a quote that no other closes hides the rest of the page, as in a browser; repeated rows are extracted alike; null ids are kept; an empty table gives an empty result; further
columns are ignored; a page of any length is read whole, in time that grows in proportion.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices, small_batches

PATH, WORD, MEASURES, HIDDEN = 96, 64, 8, 16
SIZE = PATH + WORD + MEASURES
#: Leaves of a window, and about as many are labelled together.
WINDOW = 4_096

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|select|button)\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S | re.I
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


class Leaf:
    """A run of text; path has a bit for the slot of each name on its tag path, and of `last=` the last name."""

    __slots__ = ("path", "text", "linked", "depth")

    def __init__(self, path: int, text: str, linked: int, depth: int):
        self.path, self.text, self.linked, self.depth = path, text, linked, depth


class _Stack:
    """Open elements, with the slots that their names take counted, so that a leaf's path costs the same at any depth."""

    def __init__(self):
        self.tags: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter = Counter()
        self.slots = [0] * PATH
        self.mask = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.tags.append((tag, names))
        self.open[tag] += 1
        for name in names:
            slot = _slot(name, PATH)
            self.slots[slot] += 1
            self.mask |= 1 << slot

    def pop(self) -> str:
        tag, names = self.tags.pop()
        self.open[tag] -= 1
        for name in names:
            slot = _slot(name, PATH)
            self.slots[slot] -= 1
            if not self.slots[slot]:
                self.mask ^= 1 << slot
        return tag

    def top(self) -> str | None:
        return self.tags[-1][0] if self.tags else None

    def path(self) -> int:
        return self.mask | 1 << _slot("last=" + self.tags[-1][1][-1], PATH) if self.tags else 0


def leaves(page: str) -> list[Leaf]:
    """The page's runs of text, white space as one space, in order."""
    out: list[Leaf] = []
    stack = _Stack()
    parts: list[str] = []
    linked, in_link, in_head = 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(stack.path(), text, linked, len(stack.tags)))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not in_head:
            text = entities.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "head":
            in_head = not closing
            continue
        if tag == "body":
            in_head = False
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            while stack.open[tag] and stack.pop() != tag:
                pass
            continue
        if tag in CLOSES_P and stack.top() == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack.top() == tag:
            stack.pop()
        if tag not in VOID and not m[0].endswith("/>"):
            names = [tag]
            for key, a, b, c in _ATTRIBUTE.findall(m[4]):
                names += [f"{key[0]}.{x.lower()}" for x in _NAME.findall(a or b or c)]
            stack.push(tag, tuple(names))
    add(page[at:])
    flush()
    return out


@cache
def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


def vectors(page: list[Leaf], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for every leaf of page[start:stop]."""
    part = page[start:stop]
    out = np.zeros((len(part), SIZE), np.float32)
    out[:, :PATH] = np.unpackbits(np.frombuffer(b"".join(x.path.to_bytes(PATH // 8, "little") for x in part), np.uint8), bitorder="little").reshape(len(part), PATH)
    for k, leaf in enumerate(part):
        row = out[k]
        found = leaf.text.lower().split()
        for w in found:
            row[PATH + zlib.crc32(w.strip(".,:;!?()").encode("utf-8", "replace")) % WORD] += 1
        row[PATH : PATH + WORD] /= max(1.0, float(len(found))) ** 0.5
        n = len(leaf.text)
        row[PATH + WORD :] = (
            min(1.0, np.log1p(len(found)) / 6), min(1.0, leaf.linked / n), sum(leaf.text.count(c) for c in ".,;") / (len(found) + 1), leaf.text[-1] in ".!?\"”»",
            (start + k) / max(1, len(page) - 1), min(1.0, leaf.depth / 12), len(found) < 5, 1.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Two LSTMs, one for each direction, and an output unit on both states."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "wo", "bo")

    def __init__(self, seed: int = 9):
        rng, h = np.random.default_rng(seed), HIDDEN
        for d in "fb":
            setattr(self, "w" + d, rng.normal(0, 0.15, (SIZE, 4 * h)).astype(np.float32))
            setattr(self, "u" + d, rng.normal(0, 1 / h**0.5, (h, 4 * h)).astype(np.float32))
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            setattr(self, "b" + d, bias)
        self.wo, self.bo = rng.normal(0, 0.2, 2 * h).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """States over time of x (time, page, SIZE); a page that has ended keeps its state. state: what to begin with; has the last one afterwards."""
        w, u, b, h = getattr(self, "w" + d), getattr(self, "u" + d), getattr(self, "b" + d), HIDDEN
        pre = x @ w + b
        out = np.zeros((*x.shape[:2], h), np.float32)
        s, c = state if state else (np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = pre[t] + s @ u
            i, f, o, g = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, s, c, i, f, o, g, tc, m))
            c, s = np.where(m, c2, c), np.where(m, o * tc, s)
            out[t] = s
        if state is not None:
            state[:] = s, c
        return out

    def long_scores(self, page: list[Leaf]) -> np.ndarray:
        """`scores` of one page, window by window: one number a leaf is kept."""
        out = np.full(len(page), self.bo[0], np.float32)
        starts = range(0, len(page), WINDOW)
        for d, order, wo in (("f", starts, self.wo[:HIDDEN]), ("b", reversed(starts), self.wo[HIDDEN:])):
            state: list = []
            for a in order:
                x = vectors(page, a, a + WINDOW)[:, None, :]
                out[a : a + WINDOW] += self._run(x, np.ones(x.shape[:2], bool), d, state=state)[:, 0] @ wo
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The log-odds that each leaf is main text, page by page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = order[at : at + 1]
            while at + len(group) < len(order) and len(pages[order[at + len(group)]]) * (len(group) + 1) <= WINDOW:
                group.append(order[at + len(group)])
            at += len(group)
            x, mask = _pad([pages[k] for k in group])
            both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2) @ self.wo + self.bo
            for j, k in enumerate(group):
                out[k] = both[: len(pages[k]), j]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 4) -> Labeller:
        """Adam on the logistic loss of every leaf, through time over whole pages."""
        order, h = random.Random(seed), HIDDEN
        m1, m2 = ({k: np.zeros_like(getattr(self, k)) for k in self.NAMES} for _ in range(2))
        steps, step = epochs * -(-len(pages) // batch), 0
        for _ in range(epochs):
            ids = sorted(range(len(pages)), key=lambda k: len(pages[k]) + 10 * order.random())
            groups = [ids[a : a + batch] for a in range(0, len(ids), batch)]
            order.shuffle(groups)
            for group in groups:
                x, mask = _pad([pages[k] for k in group])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(group):
                    y[: len(labels[k]), j] = labels[k]
                kept: dict[str, list] = {"f": [], "b": []}
                both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], 2)
                d_z = (_sigmoid(both @ self.wo + self.bo) - y) * mask / mask.sum()
                grads = {"wo": np.einsum("tbh,tb->h", both, d_z), "bo": np.array([d_z.sum()], np.float32)}
                for n, d in enumerate("fb"):
                    u = getattr(self, "u" + d)
                    d_pre, g_u = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros_like(u)
                    d_s, d_c = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
                    for t, s, c, i, f, o, g, tc, m in reversed(kept[d]):
                        d_s = d_s + d_z[t][:, None] * self.wo[n * h : (n + 1) * h]
                        d_c2 = np.where(m, d_c + d_s * o * (1 - tc**2), 0)
                        d_a = np.concatenate([d_c2 * g * i * (1 - i), d_c2 * c * f * (1 - f), np.where(m, d_s * tc, 0) * o * (1 - o), d_c2 * i * (1 - g**2)], 1)
                        d_pre[t] = d_a
                        g_u += s.T @ d_a
                        d_s, d_c = np.where(m, 0, d_s) + d_a @ u.T, np.where(m, d_c2 * f, d_c)
                    flat = d_pre.reshape(-1, 4 * h)
                    grads |= {"w" + d: x.reshape(-1, SIZE).T @ flat, "u" + d: g_u, "b" + d: flat.sum(0)}
                step += 1
                lr = rate * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, g in grads.items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    getattr(self, k)[...] -= lr * m1[k] / (np.sqrt(m2[k]) + 1e-8)
        return self


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(1, *(len(p) for p in pages)) if pages else 1
    x, mask = np.zeros((n, len(pages), SIZE), np.float32), np.zeros((n, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


_SYLLABLES = "an er on re th in es ou de la en ti ung sch heit que os as ble ment ción eux ge be ver".split()
# Words and class names that pages use outside their main text.
_MENU = "home about contact login search news sports archive products services help faq privacy terms sitemap subscribe register".split()
_ASIDE = ["related articles", "most read", "popular posts", "you may also like", "tags", "categories", "recent posts"]
_NOTICE = ["we use cookies to improve your experience accept", "this site uses cookies", "sign up for our newsletter", "please enable javascript", "subscribe now for updates", "your privacy is important to us"]


def generated(n: int = 1_600, seed: int = 21) -> Iterator[tuple[str, list[str]]]:
    """Pages, and the blocks of their main text; M marks are removed from what the page shows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    junk = lambda w: w + r.choice(["###", "***", "&amp;&amp;", "%%%"])

    def sentence(a: int = 4, b: int = 16, noise: bool = False) -> str:
        out = [word() for _ in range(r.randint(a, b))]
        return (" ".join(map(junk, out) if noise else out) + r.choice([".", ".", ".", "!", "?"])).capitalize()

    def box(tag: str, names: list[str], inner: str) -> str:
        kind = r.choice(["class", "id", "class", "role"])
        return f'<{tag}{f" {kind}={chr(34)}{r.choice(names)}{chr(34)}" if r.random() < 0.8 else ""}>{inner}</{tag}>'

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    for _ in range(n):
        main: list[str] = []
        lang = r.random() < 0.15

        def main_block(tag: str, text: str, main: list[str] = main) -> str:
            main.append(" ".join(entities.unescape(re.sub(r"<[^>]*>", "", text)).split()))
            return f"<{tag}>{text}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>")

        def rich(text: str) -> str:
            w = text.split()
            if len(w) > 3 and r.random() < 0.35:
                k = r.randrange(len(w) - 1)
                w[k] = r.choice([link(w[k]), f"<b>{w[k]}</b>", f"<em>{w[k]}</em>"])
            return " ".join(w)

        menu = lambda k: "<ul>" + "".join(f"<li>{link(r.choice([word(), r.choice(_MENU)]))}</li>" for _ in range(k)) + "</ul>"  # noqa: E731, B023
        para = lambda: main_block("p", rich(" ".join(sentence(noise=lang) for _ in range(r.randint(1, 7)))))  # noqa: E731, B023
        ad = lambda: box(r.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "banner", "promo", "sponsored", "ad-slot"], r.choice(["<p>%s</p>", "%s"]) % r.choice([sentence(), "advertisement", sentence(3, 8)]))  # noqa: E731, B023
        side = lambda: box("aside" if r.random() < 0.5 else "div", ["sidebar", "related", "widget", "aside", "side"], f"<h3>{r.choice(_ASIDE)}</h3>" + menu(r.randint(2, 5)) + (f"<p>{sentence()}</p>" if r.random() < 0.5 else ""))  # noqa: E731, B023
        notice = lambda: box("div", ["cookie", "notice", "cookie-banner", "newsletter", "popup", "alert", "consent"], f"<p>{r.choice([r.choice(_NOTICE), sentence()])}</p>")  # noqa: E731, B023
        form = lambda: f'<form action="/s"><p>{r.choice([r.choice(_NOTICE), word(), sentence(2, 6)])}</p><label>{word()}</label><input name="q"></form>'  # noqa: E731, B023
        comments = lambda: box(r.choice(["section", "div"]), ["comments", "comment-list", "responses", "discussion", "comment"], f"<h3>{r.choice(['comments', '3 comments', 'replies', word()])}</h3>" + "".join(box(r.choice(["div", "li", "article"]), ["comment", "reply", "comment-body"], f"<p>{r.choice([word() + ' says', word()])}</p><p>{sentence()} {sentence()}</p>") for _ in range(r.randint(1, 4))))  # noqa: E731, B023
        title = " ".join(word() for _ in range(r.randint(3, 9)))
        body = [main_block("h1", title)]
        again = sentence(1, 6)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 30])):
            x = r.random()
            if x < 0.08:
                body.append(main_block("p", again if lang or r.random() < 0.5 else sentence(1, 5)))
            elif x < 0.72:
                body.append(para())
            elif x < 0.82:
                body.append(main_block(r.choice(["h2", "h3"]), " ".join(word() for _ in range(r.randint(1, 6)))))
            elif x < 0.9:
                body.append("<ul>" + "".join(main_block("li", rich(sentence(3, 9))) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.94:
                body.append(f"<blockquote>{para()}</blockquote>")
            elif x < 0.97:
                body.append("<table><tr>" + main_block("td", word()) + main_block("td", sentence(1, 4)) + "</tr></table>")
            else:
                body.append(r.choice([ad, side])())
        if r.random() < 0.12:
            body.append(comments())
        kind = r.random()
        article = f"<article>{''.join(body)}</article>" if kind < 0.6 else f"<main>{''.join(body)}</main>" if kind < 0.75 else box("div", ["content", "post", "entry-content", "main", "article-body", "story"], "".join(body))
        before = [f"<nav>{menu(r.randint(3, 8))}</nav>" if r.random() < 0.6 else box("div", ["menu", "nav", "navbar", "navigation"], menu(r.randint(3, 8)))]
        if r.random() < 0.4:
            before.insert(0, f"<header><p>{r.choice([word(), sentence(2, 6)])}</p>{r.choice(['', menu(3)])}</header>")
        if r.random() < 0.3:
            before.append(f'<div class="breadcrumb">{link(word())} &gt; {link(word())}</div>')
        before += [f() for f in (ad, notice, side, form) if r.random() < 0.3]
        after = [f() for f in (ad, comments, side, notice, form) if r.random() < 0.3]
        r.shuffle(after)
        foot = f"{r.choice(['&copy; ', ''])}{word()}.example.com &middot; {r.choice([sentence(), 'all rights reserved', sentence(8, 20)])}"
        after.append(f"<footer>{r.choice([foot, f'<p>{foot}</p>', f'<p>{foot}</p>' + menu(3)])}</footer>" if r.random() < 0.85 else box("div", ["footer", "bottom", "copyright"], foot))
        yield f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}<script>var a='</p>';</script></body></html>", main


@cache
def model() -> Labeller:
    pages, labels = [], []
    for page, main in generated():
        found = leaves(page)
        left, mark = list(main), []
        for leaf in found:
            hit = bool(left) and leaf.text == left[0]
            mark.append(float(hit))
            if hit:
                left.pop(0)
        pages.append(vectors(found))
        labels.append(np.array(mark, np.float32))
    return Labeller().fit(pages, labels)


def extract(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of every page."""
    found = [leaves(p or "") for p in pages]
    scores = labeller.scores([vectors(f) if len(f) <= WINDOW else np.zeros((0, SIZE), np.float32) for f in found])
    scores = [labeller.long_scores(f) if len(f) > WINDOW else s for f, s in zip(found, scores, strict=True)]
    return ["\n".join(leaf.text for leaf, z in zip(f, s, strict=True) if z > 0) for f, s in zip(found, scores, strict=True)]


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    small_batches(spark)
    labeller = model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 2 << 20):
                texts = extract(batch.column("html").to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, read_table(spark, sf_dir, "pages"))
