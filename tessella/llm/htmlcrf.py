"""Operator 8: main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the tags, classes, ids and roles of its
open ancestors. A two-state chain (article, other) scores each block by features of these ancestors and of its text,
and each step by a transition weight; Viterbi decodes the page. The weights are trained here, by maximum conditional likelihood
(forward-backward, full-batch Adam), on labelled pages that `labelled_pages` composes in many layouts. Training is
deterministic, takes about a second and runs on the driver; the weights (a few hundred numbers) travel with the task.

Edge cases: null or empty html gives an empty text; pages without article blocks give an empty text; unclosed and stray tags
are tolerated, at any depth of nesting; bytes that are no UTF-8 become U+FFFD; contents of script, style and the like are no text; very long pages are decoded whole; repeated rows
are extracted one by one; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import collections
import functools
import html as html_entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import texts
from tessella.runtime import ship_package

# HTML elements by their role in layout.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head noscript template svg iframe object canvas audio video math title".split())
# What may stand in a head; any other tag, or text, ends one that is open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Tags that an open tag closes when one of the same group opens.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Open:
    """An open tag: it points to its parent and holds what its whole path shows, so that a page's memory grows with its tags."""

    __slots__ = ("tag", "names", "parent", "marks")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Open | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.marks = _marks(names) | (parent.marks if parent else 0)


class Block:
    __slots__ = ("text", "linked", "place")

    def __init__(self, text: str, linked: int, place: Open | None):
        self.text, self.linked, self.place = text, linked, place

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and names of the open ancestors, outermost first."""
        names, at = [], self.place
        while at:
            names.append(at.names)
            at = at.parent
        return tuple(n for ns in reversed(names) for n in ns)


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """A tag and the letters-only parts of its class, id and role."""
    out = [tag]
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "")
            out += ["." + n for n in _NAME.findall(value.lower())]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space folded, character references decoded."""
    out: list[Block] = []
    stack: list[Open] = []
    is_open: collections.Counter[str] = collections.Counter()
    parts: list[str] = []
    linked, links, hidden, pos = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, stack[-1] if stack else None))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html_entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def close(upto: int) -> None:
        nonlocal links, hidden
        for o in stack[upto:]:
            links -= o.tag == "a"
            hidden -= o.tag in HIDDEN
            is_open[o.tag] -= 1
        del stack[upto:]

    def end_head() -> None:
        """Close a head that is the innermost open tag but for titles that nothing ends: </head> may be left out."""
        at = len(stack)
        while at and stack[at - 1].tag in ("head", "title"):
            at -= 1
        at = next((i for i in range(at, len(stack)) if stack[i].tag == "head"), -1)
        if at >= 0:
            close(at)

    n = len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        upto = m.start() if m else n
        if hidden and stack[-1].tag == "head" and page[pos:upto].strip():
            end_head()
        if upto > pos and not hidden:
            add(page[pos:upto])
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1) if is_open[tag] else -1
            if tag in BLOCK:
                flush()
            if at >= 0:
                if any(o.tag in BLOCK for o in stack[at:]):
                    flush()
                close(at)
            continue
        if hidden and tag not in IN_HEAD:
            end_head()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        for i in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
            if stack[i].tag in CLOSES[tag]:
                close(i)
                break
            if stack[i].tag in BLOCK and stack[i].tag != "p":
                break
        if tag in VOID or m[0].endswith("/>"):
            continue
        in_head = bool(stack) and stack[-1].tag == "head"
        if in_head and tag in ("script", "style", "title", "noscript"):
            end = re.compile(rf"</({tag}|head)\s*>", re.I).search(page, pos)  # tags in their content don't end the head
            if end and end[1].lower() == tag:
                pos = end.end()
                continue
        elif tag in ("script", "style", "title", "noscript") and not hidden:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)  # their content is not markup
            pos = end.end() if end else n
            continue
        stack.append(Open(tag, _names(tag, m[3] or ""), stack[-1] if stack else None))
        is_open[tag] += 1
        links += tag == "a"
        hidden += tag in HIDDEN
    flush()
    return out


# Words in class, id and role names, by what they usually mark.
HINTS = {
    "main": "article main content post entry story body text prose page blog news read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toc skip toolbar",
    "head": "header head masthead banner logo topbar branding",
    "foot": "footer foot copyright legal bottom colophon credits",
    "side": "sidebar side aside rail related recommended widget widgets trending popular more tags tagcloud archive author bio share social follow",
    "note": "notice cookie cookies consent gdpr alert warning message popup modal overlay newsletter subscribe signup login paywall",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted commercial dfp banner",
    "comments": "comment comments reply replies respond discussion disqus thread feedback review reviews",
    "form": "form search input field contact",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAGS = ("article", "main", "section", "div", "p", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "a", "button", "label", "option", "details", "dd", "fieldset", "address")
_FEATURES: dict[str, int] = {}
for _f in (
    ["bias"] + [f"<{t}" for t in TAGS] + [f"in:{k}" for k in HINTS] + ["in:heading", "linked:0", "linked:some", "linked:most", "long:0", "long:1", "long:2", "long:3", "long:4", "stop", "sign", "article+bad", "first", "last"]
):
    _FEATURES[_f] = len(_FEATURES)
_BAD = frozenset(("menu", "foot", "side", "note", "ad", "comments", "form"))
_BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "select", "fieldset", "label", "dialog"))


#: Bits above the features': the path holds an article's name, or one that articles don't have.
_GOOD, _ILL = 1 << len(_FEATURES), 2 << len(_FEATURES)


@functools.lru_cache(1 << 14)
def _marks(names: tuple[str, ...]) -> int:
    """The path features that a tag and its names give, as bits."""
    found, good, bad = set(), False, False
    for name in names:
        if name[0] == ".":
            hint = _HINT.get(name[1:])
            if hint:
                found.add(_FEATURES[f"in:{hint}"])
                bad |= hint in _BAD
                good |= hint == "main"
        else:
            if name in HEADINGS:
                found.add(_FEATURES["in:heading"])
            elif f"<{name}" in _FEATURES:
                found.add(_FEATURES[f"<{name}"])
            good |= name in ("article", "main")
            bad |= name in _BAD_TAGS
    return sum(1 << f for f in found) | _GOOD * good | _ILL * bad


@functools.lru_cache(1 << 14)
def _path_features(marks: int) -> tuple[int, ...]:
    if marks & _GOOD and marks & _ILL:
        marks |= 1 << _FEATURES["article+bad"]
    return tuple(i for i in range(len(_FEATURES)) if marks >> i & 1)


def features(blocks: list[Block]) -> list[list[int]]:
    """Active features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        f = [0, *_path_features(b.place.marks if b.place else 0)]
        f.append(_FEATURES["linked:0" if not b.linked else "linked:some" if 2 * b.linked < n else "linked:most"])
        f.append(_FEATURES[f"long:{0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 300 else 4}"])
        if b.text[-1] in ".!?…":
            f.append(_FEATURES["stop"])
        if "©" in b.text:
            f.append(_FEATURES["sign"])
        if i == 0:
            f.append(_FEATURES["first"])
        if i == len(blocks) - 1:
            f.append(_FEATURES["last"])
        out.append(f)
    return out


_SYLLABLES = "ka lo mi ren ta su vel dor an is ter no pri que ba zu fel or gin the of and".split()


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Composed pages with a label for each leaf block (1: article). Layouts, class names and texts vary."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b))).capitalize()
    sentence = lambda a=3, b=25: " ".join(say(2, 12) + rnd.choice(".....!?") for _ in range(max(1, rnd.randint(a, b) // 6)))
    pick = lambda kind: rnd.choice(HINTS[kind].split())
    pages = []
    for _ in range(count):
        html, labels = [], []

        def put(markup: str, label: int, html=html, labels=labels) -> None:
            html.append(markup)
            labels.append(label)

        def box(kind: str, tags: tuple[str, ...], fill, html=html) -> None:
            tag = rnd.choice(tags)
            name = f' {rnd.choice(("class", "class", "id"))}="{pick(kind)}"' if tag in ("div", "section", "ul", "p") or rnd.random() < 0.4 else ""
            html.append(f"<{tag}{name}>")
            fill()
            html.append(f"</{tag}>")

        def menu() -> None:
            for _ in range(rnd.randint(2, 7)):
                put(f"<li><a href='/{word()}'>{say(1, 3)}</a></li>", 0)

        def lines(a: int = 1, b: int = 3) -> None:
            for _ in range(rnd.randint(a, b)):
                tag = rnd.choice(("p", "div", "span"))
                put(f"<{tag}>{rnd.choice((sentence(), say(1, 5), '© ' + say(1, 6)))}</{tag}>" if tag != "span" else f"<div><span>{sentence()}</span></div>", 0)

        def advert() -> None:
            put(rnd.choice((sentence(), f"<p>{sentence()}</p>", f"<a href='#'>{say(2, 6)}</a>")), 0)

        def form() -> None:
            put(f"<label>{say(1, 3)}</label>", 0)
            put(f"<button>{say(1, 2)}</button>", 0)
            if rnd.random() < 0.4:
                put(f"<p>{sentence()}</p>", 0)

        def remarks() -> None:
            for _ in range(rnd.randint(1, 5)):
                put(f"<div><p>{rnd.choice((sentence(), sentence(10, 60)))}</p></div>", 0)

        def aside() -> None:
            if rnd.random() < 0.5:
                put(f"<h3>{say(1, 4)}</h3>", 0)
            menu() if rnd.random() < 0.6 else lines(1, 3)

        extras = {
            "ad": lambda: box("ad", ("div", "aside", "section", "p"), advert), "note": lambda: box("note", ("div", "section"), lines), "form": lambda: box("form", ("form",), form),
            "side": lambda: box("side", ("aside", "div", "section"), aside), "comments": lambda: box("comments", ("div", "section"), remarks), "menu": lambda: box("menu", ("nav", "div", "ul"), menu),
        }

        def story() -> None:
            if rnd.random() < 0.8:
                put(f"<h1>{say(3, 9)}</h1>", 1)
            for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 14))):
                kind = rnd.random()
                if kind < 0.7:
                    bold = rnd.random() < 0.3
                    text = rnd.choice((sentence(3, 80), sentence(), say(1, 4) + ".", say(1, 8)))
                    if rnd.random() < 0.2:
                        text += f" <a href='#'>{say(1, 3)}</a> {say(1, 5)}."
                    put(f"<p>{'<b>' if bold else ''}{text}{rnd.choice(('</p>', '<br>', '</p>', ''))}", 1)
                elif kind < 0.78:
                    put(f"<h2>{say(1, 6)}</h2>", 1)
                elif kind < 0.86:
                    html.append("<ul>")
                    for _ in range(rnd.randint(1, 4)):
                        put(f"<li>{rnd.choice((sentence(), say(1, 6)))}</li>", 1)
                    html.append("</ul>")
                elif kind < 0.92:
                    put(f"<blockquote>{sentence()}</blockquote>", 1)
                else:
                    extras[rnd.choice(("ad", "side", "note", "form", "ad"))]()

        if rnd.random() < 0.8:
            box("head", ("header", "div"), lambda: (put(f"<a href='/'>{say(1, 3)}</a>", 0), lines(0, 2), extras["menu"]() if rnd.random() < 0.4 else None))
        for kind in rnd.sample(("menu", "ad", "note", "side", "form"), rnd.randint(1, 4)):
            extras[kind]()
        tag, name = rnd.choice((("article", ""), ("article", pick("main")), ("main", ""), ("div", pick("main")), ("div", pick("main")), ("section", pick("main"))))
        if rnd.random() < 0.3:
            html.append(f'<div id="{pick("main")}">')
        html.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
        story()
        html.append(f"</{tag}>")
        for kind in rnd.sample(("comments", "ad", "side", "form", "note", "comments"), rnd.randint(0, 3)):
            extras[kind]()
        if rnd.random() < 0.9:
            box("foot", ("footer", "footer", "div"), lambda: (put(f"<p>&copy; {word()}.example &middot; {sentence()}</p>" if rnd.random() < 0.6 else f"&copy; {word()} &middot; {sentence()}", 0), menu() if rnd.random() < 0.4 else None))
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(html) + rnd.choice(("</body></html>", ""))
        pages.append((page, labels))
    return pages


class Crf:
    """Two-state linear chain: state scores W[feature, state], transitions A[from, to]."""

    def __init__(self, n: int = len(_FEATURES)):
        self.w, self.a = np.zeros((n, 2)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
        """Maximum conditional likelihood over all pages at once, padded to one length."""
        longest = max(len(y) for _, y in pages)
        n, size = len(pages), len(self.w)
        x, y, on = np.zeros((n, longest, size)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (fs, ys) in enumerate(pages):
            on[i, : len(ys)], y[i, : len(ys)] = True, ys
            for t, f in enumerate(fs):
                x[i, t, f] = 1.0
        seen = np.eye(2)[y] * on[..., None]
        both = on[:, 1:] & on[:, :-1]
        steps_seen = np.einsum("ntu,ntv,nt->uv", seen[:, :-1], seen[:, 1:], both.astype(float))
        theta = np.concatenate([self.w.ravel(), self.a.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = on.sum()
        for step in range(1, steps + 1):
            w, a = theta[: 2 * size].reshape(size, 2), theta[2 * size :].reshape(2, 2)
            s = x @ w
            fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            fwd[:, 0] = s[:, 0]
            for t in range(1, longest):
                new = s[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + a[0], fwd[:, t - 1, 1, None] + a[1])
                fwd[:, t] = np.where(on[:, t, None], new, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                z = s[:, t + 1] + bwd[:, t + 1]
                new = np.stack([np.logaddexp(a[u, 0] + z[:, 0], a[u, 1] + z[:, 1]) for u in (0, 1)], 1)
                bwd[:, t] = np.where(on[:, t + 1, None], new, 0.0)
            whole = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + bwd - whole[:, None, None]) * on[..., None]
            pair = np.exp(fwd[:, :-1, :, None] + a + (s + bwd)[:, 1:, None, :] - whole[:, None, None, None]) * both[..., None, None]
            grad = np.concatenate([np.einsum("ntf,ntu->fu", x, seen - p).ravel(), (steps_seen - pair.sum((0, 1))).ravel()]) / total - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.a = theta[: 2 * size].reshape(size, 2), theta[2 * size :].reshape(2, 2)
        return self

    def decode(self, fs: list[list[int]]) -> list[int]:
        """Viterbi; ties go to article."""
        if not fs:
            return []
        d = (self.w[:, 1] - self.w[:, 0]).tolist()
        (a00, a01), (a10, a11) = self.a.tolist()
        s0, s1, back = 0.0, sum([d[i] for i in fs[0]]), []
        for f in fs[1:]:
            e = sum([d[i] for i in f])
            from0, from1 = s1 + a10 > s0 + a00, s1 + a11 >= s0 + a01
            back.append((from0, from1))
            s0, s1 = (s1 + a10 if from0 else s0 + a00), (s1 + a11 if from1 else s0 + a01) + e
        state = int(s1 >= s0)
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


@functools.lru_cache(1)
def trained() -> Crf:
    pages = []
    for page, labels in labelled_pages():
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels) and blocks:
            pages.append((features(blocks), labels))
    return Crf().fit(pages)


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    ship_package(pages.sparkSession)
    crf = trained()
    base = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, crf) for h in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = lambda c: base.schema[c].dataType.simpleString()
    return base.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
