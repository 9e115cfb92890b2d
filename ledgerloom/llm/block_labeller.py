"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements around it. A block becomes a
vector of its hashed tag path (tags, classes, ids), its hashed words and a few shares (length, links, place). A bidirectional LSTM in
numpy reads a page's blocks in order and labels each as article or not, so that every label rests on the whole page. The weights are
trained on the driver with a fixed seed from ``TRAIN_PAGES`` made-up pages, whose layouts follow the fixed names below; inference runs in
the tasks, some pages at a time.

Scripts, styles, comments and the head are markup and never blocks. Character references are decoded and white space inside a block is
one space; article blocks are joined by two line breaks. Nothing is cut off.

Null, empty and markup-free pages of white space give an empty text. Repeated rows are rows of their own. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches

PATH_PLACES, WORD_PLACES, SHARES = 48, 16, 7
FEATURES = PATH_PLACES + WORD_PLACES + SHARES
HIDDEN = 16
TRAIN_PAGES, EPOCHS, PAGES_A_STEP, RATE = 600, 12, 24, 0.01
BATCH_BLOCKS = 4096

# Elements by their role in the markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("head iframe noscript object script style svg template textarea title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>?""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with visible text, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, tuple(n for _, names in stack for n in names), linked))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)

    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in HIDDEN_TAGS:
            if not closing and not found[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if tag == "head" and not end:  # an unclosed head ends where the body starts
                    end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else (at if tag == "head" else len(page))
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        in_link = 0
                        break
            elif tag not in VOID_TAGS:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if stack and stack[-1][0] in CLOSED_BY.get(tag, ()):
                    stack.pop()
                names = [t for value in _NAMES.findall(found[3]) for t in _TOKEN.findall(value.lower())]
                stack.append((tag, (f"<{tag}>", *names)))
        elif tag in ("img", "input", "button", "label"):
            parts.append(" ")
            if tag == "button" and not closing:
                flush()
    flush()
    return blocks


@lru_cache(maxsize=10_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_PLACES, np.float32)
    for depth, name in enumerate(reversed(path)):
        code = zlib.crc32(name.encode())
        out[code % PATH_PLACES] += (1.0 if code >> 16 & 1 else -1.0) / (1 + 0.2 * depth)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), FEATURES), np.float32)
    for k, block in enumerate(blocks):
        out[k, :PATH_PLACES] = _path_vector(block.path)
        words, hashed = block.text.lower().split(), [0.0] * WORD_PLACES
        for word in words:
            code = zlib.crc32(word.encode())
            hashed[code % WORD_PLACES] += 1.0 if code >> 16 & 1 else -1.0
        size, n = len(block.text), max(1, len(words))
        out[k, PATH_PLACES:PATH_PLACES + WORD_PLACES] = [v / n for v in hashed]
        out[k, PATH_PLACES + WORD_PLACES:] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 4, min(1.0, block.linked / size), k / len(blocks),
            (block.text.count(".") + block.text.count("!") + block.text.count("?")) / n, len(block.path) / 10, 1.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of the network, inference and training. Sequences are padded at the end; ``live`` marks real blocks."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = draw.normal(0, 0.2, (FEATURES, 4 * HIDDEN))
            self.w[f"h{side}"] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w["out"], self.w["bias"] = draw.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)

    def _run(self, x: np.ndarray, live: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; time runs along axis 1."""
        n, steps, _ = x.shape
        h, c, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.zeros((n, steps, HIDDEN))
        fed = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = fed[:, t] + h @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = live[:, t, None]
            new = f * c + i * g
            th = np.tanh(new)
            tape.append((t, h, c, i, f, o, g, th))
            c, h = np.where(on, new, c), np.where(on, o * th, h)
            out[:, t] = h
        return out, tape

    def chances(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, live, "f")[0], self._run(x, live, "b")[0]], axis=2)
        return _sigmoid((both @ self.w["out"])[:, :, 0] + self.w["bias"])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        states = {side: self._run(x, live, side) for side in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        wrong = np.where(live, _sigmoid((both @ self.w["out"])[:, :, 0] + self.w["bias"]) - y, 0) / live.sum()
        grads = {"out": np.einsum("nth,nt->h", both, wrong)[:, None], "bias": np.array([wrong.sum()])}
        back = wrong[:, :, None] * self.w["out"][:, 0]
        for k, side in enumerate("fb"):
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            dw, dz_all = np.zeros_like(self.w[f"h{side}"]), np.zeros((len(x), x.shape[1], 4 * HIDDEN))
            for t, h, c, i, f, o, g, th in reversed(states[side][1]):
                on = live[:, t, None]
                dh = dh + back[:, t, k * HIDDEN:(k + 1) * HIDDEN]
                own, cell = np.where(on, dh, 0), np.where(on, dc, 0)
                cell = cell + own * o * (1 - th ** 2)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), own * th * o * (1 - o), cell * i * (1 - g ** 2)], axis=1)
                dz_all[:, t] = dz
                dw += h.T @ dz
                dh, dc = np.where(on, dz @ self.w[f"h{side}"].T, dh), np.where(on, cell * f, dc)
            grads[f"h{side}"], grads[f"c{side}"] = dw, dz_all.sum(axis=(0, 1))
            grads[f"x{side}"] = np.einsum("ntf,ntz->fz", x, dz_all)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> Labeller:
        draw = np.random.default_rng(4)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(EPOCHS):
            order = sorted(draw.permutation(len(pages)), key=lambda k: len(pages[k][1]) // 8)
            chunks = [order[k:k + PAGES_A_STEP] for k in range(0, len(order), PAGES_A_STEP)]
            for k in draw.permutation(len(chunks)):
                x, live = padded([pages[p][0] for p in chunks[k]])
                y = np.zeros(live.shape)
                for row, p in enumerate(chunks[k]):
                    y[row, :len(pages[p][1])] = pages[p][1]
                step += 1
                for name, grad in self.gradients(x, live, y).items():
                    grad = np.clip(grad, -1, 1)
                    mean[name] = 0.9 * mean[name] + 0.1 * grad
                    square[name] = 0.999 * square[name] + 0.001 * grad ** 2
                    self.w[name] -= RATE * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(map(len, rows), default=1))
    x, live = np.zeros((len(rows), steps, FEATURES)), np.zeros((len(rows), steps), bool)
    for k, row in enumerate(rows):
        x[k, :len(row)], live[k, :len(row)] = row, True
    return x, live


# Class and id names that page authors give to the article and to what stands around it.
ARTICLE_NAMES = ("content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "story-body", "main", "main-content", "text", "page-content", "body-text", "prose")
AROUND_NAMES = {
    "nav": ("nav", "menu", "main-menu", "navbar", "topnav", "breadcrumb", "breadcrumbs", "navigation", "toc", "links", "pagination", "tabs"),
    "header": ("header", "masthead", "site-header", "branding", "top", "logo"),
    "aside": ("sidebar", "side", "widget", "related", "recommended", "popular", "tags", "teaser", "trending", "author-box", "rail"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "promotion"),
    "notice": ("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "warning", "paywall", "subscribe-notice"),
    "form": ("form", "login", "newsletter", "search", "subscribe", "signup", "contact-form", "search-form"),
    "comments": ("comments", "comment", "comment-list", "discussion", "responses", "replies", "reader-comments", "disqus"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon", "imprint", "share", "social"),
}


def made_page(draw: random.Random) -> tuple[str, set[str]]:
    """A page, and the texts of its article blocks."""
    letters = ["th", "on", "er", "en", "re", "ion", "ta", "le", "qu", "é", "sch", "un", "der", "ci", "ñ", "os", "ing", "at", "be", "ou"]
    word = lambda: "".join(draw.choices(letters, k=draw.randint(1, 4)))
    article: set[str] = set()

    def sentences(least: int, most: int) -> str:
        out = []
        for _ in range(draw.randint(least, most)):
            out.append(" ".join(word() for _ in range(draw.randint(1, 14))).capitalize() + draw.choice([".", ".", ".", "!", "?", ""]))
        return " ".join(out)

    def main(text: str) -> str:
        article.add(" ".join(text.split()))
        return text

    def paragraph() -> str:
        kind = draw.random()
        if kind < 0.08:
            return f"<h{draw.randint(2, 4)}>{main(sentences(1, 1))}</h2>"
        if kind < 0.14:
            return "<ul>" + "".join(f"<li>{main(sentences(1, 2))}</li>" for _ in range(draw.randint(2, 5))) + "</ul>"
        if kind < 0.18:
            return f"<blockquote><p>{main(sentences(1, 3))}</p></blockquote>"
        if kind < 0.21:
            return f"<pre>{main(sentences(1, 2))}</pre>"
        if kind < 0.24:
            return "<table>" + "".join(f"<tr><td>{main(word() + ' ' + word())}</td><td>{main(word() + ' ' + word())}</td></tr>" for _ in range(3)) + "</table>"
        text = main(sentences(1, draw.choice([1, 1, 3, 8])))
        if draw.random() < 0.15:
            first, _, rest = text.partition(" ")
            return f'<p><a href="/{word()}">{first}</a> {rest}</p>'
        return draw.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>", f"<div>{text}</div>"])

    def links() -> str:
        plain = draw.random() < 0.2
        items = [f"{word()} {word()}" if draw.random() < 0.4 else word() for _ in range(draw.randint(2, 9))]
        items = [i if plain else f'<a href="/{word()}">{i}</a>' for i in items]
        return draw.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " ".join(items), "".join(f"<p>{i}</p>" for i in items)])

    def around(role: str) -> str:
        tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "form": "form"}.get(role)
        tag = tag if tag and draw.random() < 0.6 else draw.choice(["div", "section", "div"])
        name = draw.choice(AROUND_NAMES[role])
        attr = "" if tag == role and draw.random() < 0.7 else draw.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="box {name}"'])
        if role == "nav":
            body = links()
        elif role == "header":
            body = draw.choice([f"<h1>{word()} {word()}</h1>", f"<p>{sentences(1, 1)}</p>", links(), f"<h2>{word()}</h2><p>{sentences(1, 2)}</p>"])
        elif role == "aside":
            body = draw.choice([f"<h3>{word()}</h3>" + links(), f"<p>{sentences(1, 4)}</p>", f"<h3>{sentences(1, 1)}</h3><p>{sentences(1, 3)}</p>"])
        elif role in ("ad", "notice"):
            body = draw.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>", f'<a href="/x">{sentences(1, 1)}</a>', f"<h4>{word()}</h4><p>{sentences(1, 2)}</p><button>{word()}</button>"])
        elif role == "form":
            body = f"<label>{word()}</label><input name=q><button>{word()}</button>" + draw.choice(["", f"<p>{sentences(1, 1)}</p>", f"<select><option>{word()}<option>{word()}</select>"])
        elif role == "comments":
            one = lambda: f'<div class="{draw.choice(["comment", "reply", "item"])}"><b>{word()}</b><p>{sentences(1, 4)}</p></div>'
            body = f"<h3>{word()}</h3>" + "".join(one() for _ in range(draw.randint(1, 6)))
        else:
            body = draw.choice([f"&copy; {sentences(1, 2)}", f"<p>&copy; {word()} {sentences(1, 2)}</p>", links() + f"<p>{sentences(1, 1)}</p>", sentences(1, 2)])
        return f"<{tag}{attr}>{body}</{tag}>"

    body = [f"<h1>{main(sentences(1, 1))}</h1>"] if draw.random() < 0.8 else []
    body += [paragraph() for _ in range(draw.randint(1, 14))]
    for role in ("ad", "aside", "notice", "form"):
        if draw.random() < 0.12:
            body.insert(draw.randint(0, len(body)), around(role))
    if draw.random() < 0.1:
        body.append(around("comments"))
    tag = draw.choice(["article", "article", "main", "div", "div", "section"])
    attr = "" if tag in ("article", "main") and draw.random() < 0.6 else f' {draw.choice(["class", "id"])}="{draw.choice(ARTICLE_NAMES)}"'
    middle = f"<{tag}{attr}>{''.join(body)}</{tag}>"
    if draw.random() < 0.3:
        middle = f"<div class='{draw.choice(['wrapper', 'container', 'row', 'page'])}'>{middle}</div>"
    before = [around(r) for r in ("header", "nav", "notice", "ad", "form") if draw.random() < 0.5]
    after = [around(r) for r in ("aside", "comments", "ad", "notice", "form", "nav") if draw.random() < 0.35] + ([around("footer")] if draw.random() < 0.85 else [])
    draw.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>", article


def trained_labeller() -> Labeller:
    draw, pages = random.Random(2), []
    while len(pages) < TRAIN_PAGES:
        page, article = made_page(draw)
        blocks = leaf_blocks(page)
        pages.append((features(blocks), np.array([b.text in article for b in blocks], float)))
    return Labeller().fit(pages)


def main_texts(labeller: Labeller, pages: list[str]) -> list[str]:
    """The article of each page; pages of like length share a padded batch."""
    blocks = [leaf_blocks(p) for p in pages]
    out, order = [""] * len(pages), sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    while order:
        group = [order.pop(0)]
        while order and (len(group) + 1) * len(blocks[order[0]]) <= BATCH_BLOCKS:
            group.append(order.pop(0))
        chances = labeller.chances(*padded([features(blocks[k]) for k in group]))
        for row, k in enumerate(group):
            out[k] = "\n\n".join(b.text for b, p in zip(blocks[k], chances[row], strict=False) if p >= 0.5)
    return out


def _extract(model):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = main_texts(model.value, [p or "" for p in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])
    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    pages = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(trained_labeller())
    return pages.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
