"""HTML extraction: a bidirectional LSTM in numpy labels every text block of a page as article or not.

A page becomes the sequence of its text blocks. A block is described by its tag path (hashed vectors of the different names, classes, ids
and roles of all elements around it, of which each dimension keeps the greatest value, so that no depth dilutes a mark; plain wrappers add
nothing, and the nearest other element counts once more as such), its words (hashed vectors) and a few shares (links, digits, capitals, stops). The network
reads the sequence in both directions, so every label sees the whole page.

No page comes labelled. The network is trained on a bounded sample of pages (``SAMPLE``, by hash of the id): as they are, with
the labels that their own semantic elements give, and rebuilt with the same texts in other markup (``KEEP`` and ``DROP`` below), so that
it learns what menus, notices, comments and the like look like where no element says so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.llm.textbytes import U64, SpanHash, words

SAMPLE = 240  # pages
REBUILT = 1000  # rebuilt pages, however few pages there are: every place must come often enough
EPOCHS = 6
HIDDEN = 12
PATHS, WORDS = 1 << 15, 1 << 12
PATH_WIDTH, WORD_WIDTH = 16, 8
BEGINNING = 5  # letters of a class or id whose beginning counts as a name as well

# Elements without an end tag, elements that do not end a block, elements whose content is not text, and elements that
# end an open one of the same kind (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mstyle semantics".split())
SILENT = frozenset("script style textarea select".split())
UNENDING = frozenset("script style".split())  # without an end tag these go to the end of the page
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}  # closing stops here
NEUTRAL = frozenset("html body div span section table tbody thead tfoot tr td th center font".split())  # without a name they say nothing
OUTSIDE = frozenset("nav header footer aside form head".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Markup of the rebuilt pages: places where an article stands and places where something else stands.
KEEP = ("article", "main", "section.content", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div#main", "div.story", "div.text", "article.post", "div.main-content")
DROP = ("nav", "header", "footer", "aside", "form", "div.sidebar", "div#sidebar", "div.menu", "ul.menu", "div.navbar", "div#header", "div.header", "div#footer", "div.footer",
        "div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.sponsored", "div.promo", "div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert",
        "div.newsletter", "div.subscribe", "div.popup", "div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "li.comment", "div.reply",
        "div.kommentare", "section.commentaires", "ul.comentarios", "div.reacties", "div#disqus_thread", "div#respond", "div.responses", "section.discussion", "div.reviews", "div.feedback",
        "div.related", "div.share", "div.social", "div.breadcrumb", "div.widget", "div.login", "div.search", "div.copyright", "div.legal", "div.pagination", "div.tags")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)", re.S)
_NAMED = re.compile(r"\b(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


_NO_ARTICLE = frozenset(part for place in DROP for part in re.findall(r"[a-z]+", place.partition(".")[2] or place.partition("#")[2]))


@lru_cache(maxsize=20_000)
def _described(tag: str, attributes: str) -> tuple[tuple[int, ...], tuple[int, ...], str, bool]:
    """Path buckets of an element, those it has as the nearest one, its training mark, and whether its names say that it holds no article."""
    names, mark = [] if tag in NEUTRAL else [tag], ""
    for kind, *values in _NAMED.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if kind.lower() == "data-keep":
            mark = value
        else:
            parts = re.findall(r"[a-z]+", value)
            names += [f".{part}" for part in parts] + [f".{part[:BEGINNING]}-" for part in parts if len(part) >= BEGINNING]
    buckets, nearest = (tuple(_bucket(mode + n, PATHS) for n in names) for mode in ("", "^"))
    return buckets, nearest, mark, any(n[1:] in _NO_ARTICLE for n in names)


class _Around:
    """An open element: what it and all elements around it say."""

    __slots__ = ("tag", "path", "held", "nearest", "mark", "article", "other")

    def __init__(self, tag: str, attributes: str, outer: _Around | None):
        buckets, nearest, mark, no_article = _described(tag, attributes)
        path, held = (outer.path, outer.held) if outer else ((), frozenset())
        new = tuple(dict.fromkeys(b for b in buckets if b not in held))
        self.tag, self.path, self.held = tag, path + new if new else path, held | frozenset(new) if new else held
        self.nearest = nearest or (outer.nearest if outer else ())
        self.mark = mark or (outer.mark if outer else "")
        inside = bool(outer and outer.article)
        self.article = inside or tag in ("article", "main")
        self.other = bool(outer and outer.other) or tag in OUTSIDE or inside and no_article


@lru_cache(maxsize=100_000)
def _bucket(name: str, size: int) -> int:
    data = np.frombuffer(name.encode("utf-8", "replace"), np.uint8)
    return int(SpanHash(data)(np.array([0]), np.array([len(data)]))[0] % U64(size))


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    linked: int  # characters inside links
    mark: str = ""
    article: bool = False  # inside article or main
    other: bool = False  # inside an element that says that it holds no article


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: white space is one space, character references are decoded, blank blocks are left out.

    Unclosed and stray tags are put up with; what stands in scripts, styles and form controls is no text.
    """
    out: list[Block] = []
    stack: list[_Around] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    parts: list[str] = []
    linked, silent = 0, ""
    endless: set[str] = set()  # form controls that no end tag follows any more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                at = stack[-1] if stack else None
                out.append(Block(text, at.path + at.nearest, linked, at.mark, at.article, at.other) if at else Block(text, (), linked))
            parts.clear()
        linked = 0

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()

    def close(tags: tuple[str, ...], scopes: tuple[str, ...] = ()) -> None:
        """End the nearest of these elements, unless one that they can't reach out of is nearer."""
        found = max((places[t][-1] for t in tags if places.get(t)), default=-1)
        if found > max((places[t][-1] for t in scopes if places.get(t)), default=-1):
            cut(found)

    at, end = 0, len(page)
    while at < end:
        if silent:  # skip to the end tag; a form control without one is read on from its start tag
            found = re.compile(f"</{silent}\\b[^>]*>", re.I).search(page, at)
            if not found and silent not in UNENDING:
                endless.add(silent)
            at, silent = (found.end() if found else end if silent in UNENDING else at), ""
            continue
        found = _TOKEN.match(page, at)
        if found is None:  # a tag that never ends
            parts.append(page[at])
            at += 1
            continue
        at = max(found.end(), at + 1)
        ending, tag, attributes, text = found.groups()
        if text is not None:
            parts.append(text)
            if places.get("a"):
                linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if ending:
            close((tag,))
            continue
        if tag in SILENT:
            silent = "" if attributes.endswith("/") or tag in endless else tag
            continue
        if tag in ENDS_P:
            close(("p",))
        elif tag in CLOSES:
            close(CLOSES[tag], SCOPES.get(tag, ()))
        elif tag == "a":
            close(("a",))
        if tag not in VOID and not attributes.endswith("/") and (tag != "a" or "href" in attributes.lower()):
            places.setdefault(tag, []).append(len(stack))
            stack.append(_Around(tag, attributes, stack[-1] if stack else None))
    flush()
    return out


SHARES = 7


def describe(sequence: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets and their block, word buckets and their block, shares by block."""
    path = np.array([b for x in sequence for b in x.path], np.int64)
    path_of = np.repeat(np.arange(len(sequence)), [len(x.path) for x in sequence])
    raw = [x.text.encode("utf-8", "replace") for x in sequence]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    start, end, word_of = words(data, bounds)
    word = (SpanHash(data, fold=True)(start, end) % U64(WORDS)).astype(np.int64) if len(start) else start

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    n = np.bincount(word_of, minlength=len(sequence))
    size = np.array([len(x.text) for x in sequence], float)
    shares = np.column_stack([
        np.log1p(n) / 4, np.minimum(np.array([x.linked for x in sequence]) / np.maximum(size, 1), 1), share((data >= 48) & (data < 58)), share((data >= 65) & (data < 91)),
        10 * share((data == 46) | (data == 33) | (data == 63)), np.arange(len(sequence)) / max(1, len(sequence)), np.full(len(sequence), 1 / max(1, len(sequence)))])
    return path, path_of, word, word_of, shares


def _mean(table: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, table.shape[1]))
    if len(bucket):
        rows, first = np.unique(owner, return_index=True)
        out[rows] = np.add.reduceat(table[bucket], first, axis=0)
        out[rows] /= np.bincount(owner, minlength=n)[rows][:, None]
    return out


def _greatest(table: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each owner's buckets the greatest value in each dimension; zeros without any."""
    out = np.zeros((n, table.shape[1]))
    if len(bucket):
        rows, first = np.unique(owner, return_index=True)
        out[rows] = np.maximum.reduceat(table[bucket], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embedding tables, one LSTM for each direction, a logistic output. All weights are numpy arrays in ``w``."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        inputs = PATH_WIDTH + WORD_WIDTH + SHARES
        self.w = {"path": rng.normal(0, 0.05, (PATHS, PATH_WIDTH)), "word": rng.normal(0, 0.1, (WORDS, WORD_WIDTH)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, inputs ** -0.5, (inputs, 4 * HIDDEN))
            self.w[f"h{side}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def inputs(self, described) -> np.ndarray:
        path, path_of, word, word_of, shares = described
        n = len(shares)
        return np.hstack([_greatest(self.w["path"], path, path_of, n), _mean(self.w["word"], word, word_of, n), shares])

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: steps x pages x inputs. Hidden states of every step."""
        steps, pages, _ = x.shape
        gates = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h, c, out = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((steps, pages, HIDDEN))
        for t in range(steps):
            z = gates[t] + h @ self.w[f"h{side}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """Chance of each block of each page to be article; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][4])), key=lambda i: len(pages[i][4]))
        while order:
            longest = len(pages[order[-1]][4])
            group = order[-max(1, min(256, 40_000 // longest)):]
            del order[-len(group):]
            x, back, n = self._padded([self.inputs(pages[i]) for i in group])
            states = np.concatenate([self._run(x, "f"), _reverse(self._run(back, "b"), n)], axis=2)
            p = _sigmoid(states @ self.w["out"] + self.w["bias"])
            for j, i in enumerate(group):
                out[i] = p[: n[j], j]
        return out

    @staticmethod
    def _padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(v) for v in inputs])
        x = np.zeros((n.max(), len(n), inputs[0].shape[1]))
        for j, v in enumerate(inputs):
            x[: n[j], j] = v
        return x, _reverse(x, n), n

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over all blocks, by back-propagation through time."""
        x, back, n = self._padded([self.inputs(p) for p in pages])
        steps, count = x.shape[:2]
        y, mask = np.zeros((steps, count)), np.zeros((steps, count))
        for j, label in enumerate(labels):
            y[: n[j], j], mask[: n[j], j] = label, 1
        tape: dict[str, list] = {"f": [], "b": []}
        forward, backward = self._run(x, "f", tape["f"]), self._run(back, "b", tape["b"])
        states = np.concatenate([forward, _reverse(backward, n)], axis=2)
        p = _sigmoid(states @ self.w["out"] + self.w["bias"])
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        d = mask * (p - y) / total
        grad = {"out": np.einsum("tp,tph->h", d, states), "bias": np.array([d.sum()])}
        d_states = d[:, :, None] * self.w["out"]
        dx = self._back(x, tape["f"], d_states[:, :, :HIDDEN], "f", grad)
        dx += _reverse(self._back(back, tape["b"], _reverse(d_states[:, :, HIDDEN:], n), "b", grad), n)
        grad["path"], grad["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for j, (path, path_of, word, word_of, _) in enumerate(pages):
            if len(path):
                won = self.w["path"][path] == x[path_of, j, :PATH_WIDTH]
                np.add.at(grad["path"], path, won * dx[path_of, j, :PATH_WIDTH])
            if len(word):
                size = np.bincount(word_of, minlength=n[j])[word_of][:, None]
                np.add.at(grad["word"], word, dx[word_of, j, PATH_WIDTH: PATH_WIDTH + WORD_WIDTH] / size)
        return grad, loss

    def _back(self, x: np.ndarray, tape: list, d_out: np.ndarray, side: str, grad: dict) -> np.ndarray:
        steps, pages, _ = x.shape
        dz = np.zeros((steps, pages, 4 * HIDDEN))
        dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        grad[f"h{side}"] = np.zeros_like(self.w[f"h{side}"])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"h{side}"] += h.T @ dz[t]
            dh, dc = dz[t] @ self.w[f"h{side}"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad[f"x{side}"], grad[f"c{side}"] = x.reshape(steps * pages, -1).T @ flat, flat.sum(axis=0)
        return dz @ self.w[f"x{side}"].T

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 0) -> float:
        """Adam over mini-batches; the mean loss of the last epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, [0.0]
        for _ in range(epochs):
            losses = []
            for chunk in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                grad, loss = self.gradients([pages[i] for i in chunk], [labels[i] for i in chunk])
                losses.append(loss)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        return float(np.mean(losses))


def _reverse(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each page's own steps in reverse order; padding stays behind."""
    t = np.arange(len(x))[:, None]
    return x[np.where(t < n, n - 1 - t, t), np.arange(x.shape[1])]


def _own_labels(sequence: list[Block]) -> np.ndarray | None:
    """1 inside article or main and outside nav, header, footer, aside, form and, within the article, places named like those of ``DROP``.

    None if the page has neither article nor main.
    """
    if not any(x.article for x in sequence):
        return None
    return np.array([float(x.article and not x.other) for x in sequence])


def _opened(markup: str, keep: str) -> tuple[str, str]:
    tag, kind, name = re.match(r"(\w+)([.#]?)(.*)", markup).groups()
    named = {"": "", ".": f' class="{name}"', "#": f' id="{name}"'}[kind]
    return f'<{tag}{named} data-keep="{keep}">', f"</{tag}>"


def rebuilt(rng: np.random.Generator, good: list[str], bad: list[str]) -> str:
    """A page of the given texts in random markup; elements carry the label of what stands in them."""
    def pick(texts: list[str]) -> str:
        return html.escape(texts[rng.integers(len(texts))], quote=False)

    def short(texts: list[str]) -> str:
        some = pick(texts).split()
        return " ".join(some[: rng.integers(1, 6)])

    def name() -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10)))

    def nested(inner: str) -> str:
        """In up to 40 wrappers that say nothing."""
        for _ in range(rng.integers(0, 41) if rng.random() < 0.15 else rng.integers(0, 4)):
            style = rng.integers(6)
            if style == 0:
                inner = f"<table><tbody><tr><td>{inner}</td></tr></tbody></table>"
            else:
                tag = ("div", "div", "div", "section", "span")[style - 1]
                inner = f"<{tag}{('', '', f' class={name()}', f' id={name()}')[rng.integers(4)]}>{inner}</{tag}>"
        return inner

    def other() -> str:
        place = DROP[rng.integers(len(DROP))]
        if rng.random() < 0.5:  # names known by their beginnings only
            tag, kind, named = re.match(r"(\w+)([.#]?)(.*)", place).groups()
            place = tag + kind + "-".join(part[:BEGINNING] + name() if len(part) >= BEGINNING else part for part in re.findall("[a-z]+", named))
        opened, closed = _opened(place, "0")
        style = rng.integers(6)
        if style == 0:
            inner = "<ul>" + "".join(f'<li><a href="/">{short(good if rng.random() < 0.5 else bad)}</a></li>' for _ in range(rng.integers(1, 8))) + "</ul>"
        elif style == 1:
            inner = "".join(f"<p>{pick(good if rng.random() < 0.6 else bad)}</p>" for _ in range(rng.integers(1, 4)))
        elif style == 2:
            inner = pick(good if rng.random() < 0.4 else bad)
        elif style == 3:
            inner = f"<h3>{short(bad)}</h3><div>{pick(good if rng.random() < 0.5 else bad)}</div>"
        else:  # a menu where no name says so
            opened, closed = f'<div data-keep="0"{"" if style == 4 else f" class={name()}"}>', "</div>"
            inner = (" ", "<br>", "</div><div>")[rng.integers(3)].join(f'<a href="/">{short(good if rng.random() < 0.5 else bad)}</a>' for _ in range(rng.integers(2, 8)))
            inner = f"<div>{inner}</div>"
        return opened + nested(inner) + closed

    def article() -> str:
        kind = rng.random()
        opened, closed = _opened(KEEP[rng.integers(len(KEEP))], "1") if kind < 0.6 else (f'<div data-keep="1"{"" if kind < 0.85 else f" class={name()}"}>', "</div>")
        level = rng.integers(1, 3)
        body = [f"<h{level}>{short(good)}</h{level}>"] if rng.random() < 0.8 else []
        cells = rng.random() < 0.15
        for _ in range(rng.integers(1, 9)):
            text, style = (short if rng.random() < 0.15 else pick)(good), rng.integers(8)
            if cells:
                body.append(f"<table><tr><td>{text}</td></tr></table>")
            else:
                body.append((f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li></ul>")[style - 3] if style >= 3 else f"<p>{text}</p>")
            if rng.random() < 0.08:
                body.append(other())
        if rng.random() < 0.5:
            body.append(other())
        return nested(opened + nested("".join(body)) + closed)
    before, after = ("".join(other() for _ in range(rng.integers(0, 4))) for _ in range(2))
    head = f'<html><head data-keep="0"><title>{short(good)}</title></head><body data-keep="0">'
    return head + nested(before + (article() if rng.random() < 0.95 else "") + after) + "</body></html>"


def train(pages: DataFrame, sample: int = SAMPLE, rebuilt_pages: int = REBUILT, id_col: str = "page_id", html_col: str = "html", seed: int = 0) -> Network:
    """Fit on ``sample`` pages, the smallest by hash of the id, and ``rebuilt_pages`` pages rebuilt from their texts."""
    known = pages.select(F.xxhash64(id_col).alias("h"), F.xxhash64(html_col).alias("g"), F.col(html_col).alias("html")).where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = known.select("h", "g").distinct().orderBy("h", "g").limit(sample)  # two numbers of each page; whole pages only of those chosen
    chosen = [tuple(r) for r in chosen.collect()]
    wanted = F.broadcast(pages.sparkSession.createDataFrame(chosen, "h long, g long"))  # at most sample rows
    rows = {(r["h"], r["g"]): r["html"] for r in known.join(wanted, ["h", "g"]).dropDuplicates(["h", "g"]).collect()}  # bounded by the sample
    rows = [(rows[key],) for key in chosen]
    sequences = [s for s in (blocks(r[0]) for r in rows) if s]
    found = [(s, y) for s in sequences if (y := _own_labels(s)) is not None]
    good = [b.text for s, y in found for b, keep in zip(s, y, strict=True) if keep] or ["Some words that stand for an article."]
    bad = [b.text for s, y in found for b, keep in zip(s, y, strict=True) if not keep] or ["Menu", "Some words that stand for a notice."]
    rng = np.random.default_rng(seed)
    for _ in range(rebuilt_pages):
        s = blocks(rebuilt(rng, good, bad))
        if s:
            found.append((s, np.array([float(b.mark == "1") for b in s])))
    network = Network(seed)
    network.fit([describe(s) for s, _ in found], [y for _, y in found], seed=seed)
    return network


def extracted(pages: DataFrame, network: Network, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page: the blocks labelled article, joined by one space; null html is empty.

    Every row gives a row, whatever its id or url. Other columns are not read. A page without a block labelled article has empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            column = batch.column(1)
            for i in range(len(column)):
                page = column[i].as_py() or ""
                held.append(blocks(page))
                size += len(page)
                if size > 4 << 20 or i + 1 == len(column):
                    texts = []
                    for sequence, p in zip(held, network.probabilities([describe(s) for s in held]), strict=True):
                        texts.append(" ".join(b.text for b, keep in zip(sequence, p >= 0.5, strict=True) if keep))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), pa.array(texts, pa.string())], ["key", "text"])
                    held, size, begin = [], 0, i + 1
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), F.col(html_col))
    out = rows.mapInArrow(run, f"key struct<id:{kinds[id_col]},url:{kinds[url_col]}>, text string")
    return out.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def extract(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``extracted`` with a network that ``train`` fits on the pages."""
    return extracted(pages, train(pages, sample, id_col=id_col, html_col=html_col), id_col, url_col, html_col)
