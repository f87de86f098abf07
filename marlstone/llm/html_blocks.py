"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks of text. Each block has features of its tag path (tags, classes, ids and roles of the
elements around it, hashed), of its words (hashed) and a few measures. A bidirectional LSTM in numpy reads the whole
sequence, so each block is judged with the rest of the page in view. It is trained here, on pages composed by rule from
texts of a bounded sample of the table, with menus, notices, forms, adverts, sidebars, comments and footers whose labels
are known by construction, and on the sample's own pages where their elements name the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, each_batch

PATH_BITS, WORD_BITS, EMBED, HIDDEN, MEASURES = 12, 9, 20, 16, 6
#: Rows at which a sum of rows stops growing with their number; all of them count.
FULL_ROWS = 40
#: Fixed values of HTML: elements that hold no text to read, that stand alone, and that don't break a line.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "object", "head", "select", "datalist", "textarea", "math", "canvas", "audio", "video", "title"}
#: Those of them that hold elements, one of their own kind too; the others hold text up to their first end tag.
NESTING = {"template", "svg", "object", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: End tags that HTML implies: (elements that are closed, elements behind which they are out of reach, opening tags that close them).
_ROWS, _HEADS, _ITEMS = {"tbody", "thead", "tfoot"}, {"caption", "colgroup"}, {"li", "dt", "dd"}
_BLOCKS = set("article aside blockquote center details dialog dir dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol pre search section summary table ul xmp".split())
_LIMITS = _BLOCKS | _ROWS | _HEADS | {"body", "button", "html", "marquee", "td", "th", "tr"}
IMPLIED = (
    ({"p"}, {"table", "td", "th", "caption", "button", "marquee"}, _BLOCKS | _ITEMS | {"p", "address", "div"}),
    ({"li"}, _LIMITS | {"dt", "dd"}, {"li"}), ({"dt", "dd"}, _LIMITS | {"li"}, {"dt", "dd"}), ({"option"}, _LIMITS | _ITEMS | {"optgroup"}, {"option", "optgroup"}), ({"optgroup"}, _LIMITS | _ITEMS, {"optgroup"}),
    ({"td", "th"}, {"table"}, _ROWS | _HEADS | {"td", "th", "tr"}), ({"tr"}, {"table"}, _ROWS | _HEADS | {"tr"}), (_ROWS, {"table"}, _ROWS | _HEADS), (_HEADS, {"table"}, _ROWS | _HEADS | {"td", "th", "tr"}),
)
#: The same by tag: the rules that it stands in, as one to be closed or as a limit, and the rules by which it closes others.
_STANDS = {t: [(k, t in rule[0]) for k, rule in enumerate(IMPLIED) if t in rule[0] | rule[1]] for t in set().union(*(r[0] | r[1] for r in IMPLIED))}
_CLOSES = {t: [k for k, rule in enumerate(IMPLIED) if t in rule[2]] for t in set().union(*(r[2] for r in IMPLIED))}
_MARK = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name: quotes count behind a sign of equality and where both are there.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: One attribute after the other, so that neither data-id nor what stands within a value is taken for an id.
_ATTR = re.compile(r"([^\s/=>]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]++)))?+")
NAMING = {"class", "id", "role"}


def _names(attributes: str) -> list[str]:
    """name:word of each word in the attributes that name an element; of a repeated attribute the first counts."""
    low = attributes.lower()
    if not any(x in low for x in NAMING):
        return []
    values: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(low):
        if name in NAMING:
            values.setdefault(name, a or b or c)
    return [f"{name}:{x}" for name, value in values.items() for x in re.split(r"[^a-z0-9]+", value) if x]


def _silent_end(page: str, tag: str, at: int) -> int:
    """Where a silent element ends that opened before ``at``. Those of elements' kind nest, those of text's end at the first end tag."""
    marks = re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)
    deep = 1
    for m in marks.finditer(page, at, page.rfind(">") + 1):  # every mark is closed there, so nothing is read twice
        if m[1]:
            deep -= 1
        elif tag in NESTING and not m[0].endswith("/>"):
            deep += 1
        if not deep:
            return m.end()
    return len(page)


@lru_cache(1 << 16)
def _path_bit(token: str) -> int:
    return 1 << (xxhash.xxh32_intdigest(token) >> (32 - PATH_BITS))


class Element:
    """An open element: its tokens, and as bits the rows of the path table for all tokens and neighbours down to it."""

    __slots__ = ("tag", "above", "tokens", "rows")

    def __init__(self, tag: str, tokens: tuple[str, ...], above: Element | None):
        self.tag, self.tokens, self.above = tag, tokens, above
        self.rows, last = (above.rows, above.tokens[-1]) if above else (0, None)
        for t in tokens:
            self.rows |= _path_bit(t) | (_path_bit(f"{last}>{t}") if last is not None else 0)
            last = t


class Marks:
    """Reads a page's tags, comments and declarations one after the other.

    Every character is read a bounded number of times: a comment that nothing closes ends with the page, a '<' behind the
    last '>' is text, and once a quoted attribute has run to the page's end, tags end at their next '>'.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, whether it opens, attributes) of the first from ``at`` on; a comment or declaration has no tag."""
        page = self.page
        while m := _MARK.search(page, at):
            start, at = m.span()
            if m[2] is None:
                end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                found = page.find(end, at)
                return start, found + len(end) if found >= 0 else len(page), "", True, ""
            if at > self.last:  # only comments and declarations can follow
                continue
            rest = _REST.match(page, at) if self.quotes else None
            if rest:
                return start, rest.end(), m[2].lower(), not m[1], rest[1]
            self.quotes, close = False, page.find(">", at)
            return start, close + 1, m[2].lower(), not m[1], page[at:close]
        return None


@dataclass
class Block:
    around: tuple[str, ...] | Element | None  # the tokens of the elements around it, outermost first, or the innermost element
    text: str
    linked: int = 0  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        if isinstance(self.around, tuple):
            return self.around
        found, e = [], self.around
        while e:
            found.append(e.tokens)
            e = e.above
        return tuple(t for tokens in reversed(found) for t in tokens)

    @property
    def rows(self) -> int:
        if isinstance(self.around, tuple):
            return Element("", self.around, None).rows
        return self.around.rows if self.around else 0


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with references decoded and white space made single; blocks without text don't count.

    Text within silent elements is left out. An unclosed silent element ends with the page. End tags that HTML lets one
    omit are implied, and all open elements count, however many.
    """
    page, at = page or "", 0
    stack: list[Element] = []
    standing: list[list[int]] = [[] for _ in IMPLIED]  # for each rule the places of its elements, -1 for a limit
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, links = 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, linked))
        parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        for k, _ in _STANDS.get(tag, ()):
            standing[k].pop()
        return tag

    marks = Marks(page)
    while at < len(page):
        mark = marks.after(at)
        start, end, tag, opening, attributes = mark or (len(page), len(page), "", True, "")
        piece, at = page[at:start], end
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)
        if not tag:
            continue
        if opening and tag in SILENT:
            if tag != "head" and not page.endswith("/>", 0, end):
                at = _silent_end(page, tag, at)
            continue
        if tag == "a":
            links = max(0, links + (1 if opening else -1))
        if tag in INLINE:
            continue
        close()
        if not opening:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        reach = [standing[k][-1] for k in _CLOSES.get(tag, ()) if standing[k] and standing[k][-1] >= 0]
        while reach and len(stack) > min(reach):
            pop()
        if tag not in VOID:
            tokens = [tag, *_names(attributes)]
            for k, closable in _STANDS.get(tag, ()):
                standing[k].append(len(stack) if closable else -1)
            stack.append(Element(tag, tuple(tokens), stack[-1] if stack else None))
            opened[tag] += 1
    close()
    return out


@lru_cache(1 << 16)
def _word_row(word: str) -> int:
    return xxhash.xxh32_intdigest(word) >> (32 - WORD_BITS)


_DIGIT, _NO_DIGITS = re.compile("[0-9]"), dict.fromkeys(range(48, 58))


@lru_cache(1 << 14)
def _path_rows(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((1 << PATH_BITS) // 8, "little"), np.uint8), bitorder="little"))


def _scale(sizes: np.ndarray) -> np.ndarray:
    """What a sum of rows is divided by: its length's root, and for long ones in proportion, so that they don't saturate."""
    return np.maximum(np.sqrt(np.maximum(sizes, 1)), sizes / np.sqrt(FULL_ROWS))[:, None]


def vectors(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(path features, word features, measures) of each block."""
    paths, words = [], []
    measures = np.zeros((len(blocks), MEASURES))
    for i, b in enumerate(blocks):
        paths.append(_path_rows(b.rows or 1))
        w = b.text.lower().split()
        words.append(np.fromiter(map(_word_row, w), np.int64, len(w)))
        digits = len(b.text) - len(b.text.translate(_NO_DIGITS)) if _DIGIT.search(b.text) else 0
        measures[i] = np.log1p(len(w)) / 5, min(1.0, b.linked / max(1, len(b.text))), i / max(1, len(blocks)), b.text[-1] in ".!?", len(b.text) / 500 if len(b.text) < 500 else 1.0, 4 * digits / max(1, len(b.text))
    return paths, words, measures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights by name; the block vector is the mean of its path rows, the mean of its word rows, and its measures."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 2) -> Labeller:
        r = np.random.default_rng(seed)
        size = 2 * EMBED + MEASURES
        w = {"path": r.normal(0, 0.3, (1 << PATH_BITS, EMBED)), "word": r.normal(0, 0.05, (1 << WORD_BITS, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for d in ("f", "b"):
            w |= {"x" + d: r.normal(0, size**-0.5, (size, 4 * HIDDEN)), "h" + d: r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), "c" + d: np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _input(self, page: tuple) -> np.ndarray:
        paths, words, measures = page
        x = np.zeros((len(paths), 2 * EMBED + MEASURES), np.float32)
        x[:, 2 * EMBED :] = measures
        for at, table, rows in ((0, self.w["path"], paths), (EMBED, self.w["word"], words)):
            sizes = np.array([len(r) for r in rows])
            full = np.flatnonzero(sizes)
            if len(full):
                flat = table[np.concatenate([rows[i] for i in full])]
                x[full, at : at + EMBED] = np.add.reduceat(flat, np.cumsum(sizes[full]) - sizes[full]) / _scale(sizes[full])
        return x

    def _direction(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """(time, batch, hidden); padding stands at the end and, for the backward reading, each sequence is reversed before."""
        steps, batch, _ = x.shape
        pre = x @ self.w["x" + d] + self.w["c" + d]
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        for t in range(steps):
            z = pre[t] + h @ self.w["h" + d]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            old, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, old, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def forward(self, pages: list[tuple], keep: dict | None = None) -> list[np.ndarray]:
        """Probability that a block belongs to the main text, for each block of each page."""
        lengths = np.array([len(p[0]) for p in pages])
        steps = int(lengths.max())
        x = np.zeros((steps, len(pages), 2 * EMBED + MEASURES), np.float32)
        for i, p in enumerate(pages):
            x[: lengths[i], i] = self._input(p)
        # position of each step in the reversed sequence, and back
        turn = np.where(np.arange(steps)[:, None] < lengths, lengths - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        columns = np.arange(len(pages))[None, :]
        kf, kb = ([], []) if keep is not None else (None, None)
        xb = x[turn, columns]
        hf, hb = self._direction(x, "f", kf), self._direction(xb, "b", kb)[turn, columns]
        both = np.concatenate([hf, hb], 2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])[:, :, 0]
        if keep is not None:
            keep.update(x=x, xb=xb, both=both, p=p, lengths=lengths, turn=turn, columns=columns, kf=kf, kb=kb)
        return [p[:n, i] for i, n in enumerate(lengths)]

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        k: dict = {}
        self.forward(pages, k)
        y, real = np.zeros_like(k["p"]), np.zeros_like(k["p"])
        for i, v in enumerate(labels):
            y[: len(v), i], real[: len(v), i] = v, 1
        d = ((k["p"] - y) * real / real.sum())[:, :, None].astype(np.float32)
        g = {"out": np.einsum("tbh,tbo->ho", k["both"], d), "bias": d.sum((0, 1))}
        back = d @ self.w["out"].T
        dx = np.zeros_like(k["x"])
        for name, x, kept, dh_all in (("f", k["x"], k["kf"], back[:, :, :HIDDEN]), ("b", k["xb"], k["kb"], back[:, :, HIDDEN:][k["turn"], k["columns"]])):
            steps, batch, _ = x.shape
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            dz = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w["h" + name])
            for t in range(steps - 1, -1, -1):
                h, old, i, f, o, c, tc = kept[t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * c * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)], 1)
                gh += h.T @ dz[t]
                dh, dc = dz[t] @ self.w["h" + name].T, dc * f
            g |= {"x" + name: np.einsum("tbi,tbj->ij", x, dz), "h" + name: gh, "c" + name: dz.sum((0, 1))}
            own = dz @ self.w["x" + name].T
            dx += own if name == "f" else own[k["turn"], k["columns"]]
        for at, name, which in ((0, "path", 0), (EMBED, "word", 1)):
            g[name] = np.zeros_like(self.w[name])
            for i, p in enumerate(pages):
                sizes = np.array([len(r) for r in p[which]])
                if sizes.sum():
                    rows = np.repeat(dx[: len(sizes), i, at : at + EMBED] / _scale(sizes), sizes, axis=0)
                    np.add.at(g[name], np.concatenate(p[which]), rows)
        return g


def train(pages: list[tuple], labels: list[np.ndarray], epochs: int = 12, batch: int = 24, rate: float = 0.01, seed: int = 2) -> Labeller:
    """Adam over shuffled batches of pages of like length."""
    model, rng = Labeller.new(seed), np.random.default_rng(seed)
    usable = [i for i in range(len(pages)) if len(pages[i][0])]
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    order, step = sorted(usable, key=lambda i: len(pages[i][0])), 0
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for _ in range(epochs):
        for j in rng.permutation(len(groups)):
            step += 1
            g = model.gradients([pages[i] for i in groups[j]], [labels[i] for i in groups[j]])
            for k, gk in g.items():
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                model.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


#: Where words of a path say what the element is for; used only to label training pages.
_OTHER = re.compile(r"^(nav|header|footer|aside|form|(class|id|role):(nav|navigation|menu|header|banner|footer|contentinfo|sidebar|aside|complementary|ad|ads|advert|advertisement|sponsor|promo|cookie|notice|consent|comment|comments|reply|share|social|related|search|newsletter|subscribe))$")


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page whose elements name the article: inside article or main, outside anything else by name. None if no element does."""
    if not any({"article", "main", "role:main"} & set(b.path) for b in blocks):
        return None
    best = "article" if any("article" in b.path for b in blocks) else "main"
    out = []
    for b in blocks:
        inside = best in b.path or best == "main" and "role:main" in b.path
        after = b.path[b.path.index(best) + 1 :] if best in b.path else b.path
        out.append(inside and not any(_OTHER.match(t) for t in after))
    return np.array(out, float)


def composed(texts: list[str], n: int, seed: int = 4) -> list[tuple[list[Block], np.ndarray]]:
    """Pages composed by rule, with labels: a main part under one of several names among parts of other kinds."""
    r = np.random.default_rng(seed)
    say = lambda lo, hi: " ".join(w[int(r.integers(max(1, len(w) - hi))) :][: int(r.integers(lo, hi + 1))] if (w := texts[int(r.integers(len(texts)))].split()) else ["text"])
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    out = []
    for _ in range(n):
        rows: list[tuple[tuple[str, ...], str, int, float]] = []

        def part(frame: tuple[str, ...], kind: str, label: float, rows=rows) -> None:
            if kind == "links":
                for _ in range(int(r.integers(3, 9))):
                    t = say(1, 3)
                    rows.append(((*frame, "ul", "li"), t, len(t), label))
            elif kind == "form":
                rows.append(((*frame, "form", "div"), say(1, 8), 0, label))
            else:
                for _ in range(int(r.integers(1, 4 if kind == "short" else 9))):
                    rows.append(((*frame, pick("p", "p", "div", "li")), say(3, 25 if kind == "short" else 60), 0, label))

        body = ("html", "body") if r.random() < 0.7 else ("html", "body", "div", pick("class:page", "id:wrapper", "class:container"))
        named = lambda *names: (pick("div", "section"), pick("class:", "id:") + pick(*names))
        before = [(("header",), "short"), (("nav",), "links"), (named("header", "banner", "masthead"), "short"), (named("nav", "menu", "navigation"), "links"), (named("cookie", "notice", "consent"), "short"), (named("ad", "ads", "advert", "sponsor", "promo"), "short"), (named("search"), "form")]
        later = [(("aside",), "short"), (named("sidebar", "related", "widget"), "links"), (named("ad", "ads", "advert", "promo"), "short"), (named("comments", "comment", "discussion", "reply"), "long"), (named("newsletter", "subscribe"), "form"), (named("share", "social"), "links"), (("footer",), "short"), (named("footer", "copyright"), "short")]
        for frame, kind in before:
            if r.random() < 0.4:
                part((*body, *frame), kind, 0.0)
        main = pick(("article",), ("main", "article"), ("main",), ("article",), ("div", "class:" + pick("content", "post", "article", "entry", "story")), ("div", "id:" + pick("content", "main", "article")))
        if r.random() < 0.4:  # a main part that no name tells: what stands around it and its own text must
            main = pick(("div",), ("section",), (pick("div", "section"), f"class:c{int(r.integers(10_000))}"), (pick("div", "section"), f"id:n{int(r.integers(10_000))}"), ("div", "div"), ())
        inner = (*body, *main)
        if r.random() < 0.8:
            rows.append(((*inner, pick("h1", "h1", "h2")), say(3, 12), 0, 1.0))
        for _ in range(int(r.integers(1, 4))):
            part(inner, "long", 1.0)
            if r.random() < 0.25:
                part((*inner, *pick(named("ad", "advert", "promo"), ("aside",), named("share", "related"))), "short", 0.0)
        if r.random() < 0.25:
            part((*inner, *pick(("footer",), named("comments", "comment"), ("form",))), "short", 0.0)
        for frame, kind in later:
            if r.random() < 0.45:
                part((*body, *frame), kind, 0.0)
        out.append(([Block(p, t, k) for p, t, k, _ in rows], np.array([x[3] for x in rows])))
    return out


def fit(pages: DataFrame, sample_rows: int = 160, composed_pages: int = 360, longest: int = 30_000) -> Labeller:
    """A labeller from at most ``sample_rows`` whole pages of at most ``longest`` characters (documented bounds; the same
    pages in every run) and ``composed_pages`` pages composed from their texts."""
    chosen = bounded_sample(pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull() & (F.length("html") <= longest)).select("page_id", "html"), "page_id", sample_rows)
    got = chosen.toPandas().sort_values(["page_id", "html"])
    cut = [blocks_of(h) for h in got["html"]]
    known = [(b, y) for b in cut if b and (y := own_labels(b)) is not None]
    texts = [b.text for page in cut for b in page if len(b.text) > 20] or ["some words of a page that has no text"]
    both = known + composed(texts, composed_pages)
    return train([vectors(b) for b, _ in both], [y for _, y in both])


def main_text(blocks: list[Block], probabilities: np.ndarray) -> str:
    return " ".join(b.text for b, p in zip(blocks, probabilities, strict=True) if p >= 0.5)


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages``.

    text joins by one space the blocks that the labeller calls main text, in page order; it is empty for a null or empty
    page or if there is none. n_chars counts its code points. Repeated rows are read each by itself. An empty table gives
    an empty result; other columns are not read.
    """
    model = model or fit(pages)
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.w.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [blocks_of(h.as_py()) for h in part.column(2)]
                texts, rest = [""] * len(cut), sorted((i for i, b in enumerate(cut) if b), key=lambda i: len(cut[i]))
                while rest:
                    # pages of like length together, at most 60,000 cells at a time
                    size = max(1, min(64, 60_000 // len(cut[rest[-1]])))
                    group, rest = rest[-size:], rest[:-size]
                    for i, p in zip(group, labeller.forward([vectors(cut[i]) for i in group]), strict=True):
                        texts[i] = main_text(cut[i], p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in cut], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return each_batch(pages.selectExpr("cast(page_id as long) as page_id", "url", "html"), ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long, n_blocks long", run)
