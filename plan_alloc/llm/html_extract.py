"""Main text of web pages by a linear-chain conditional random field.

A page is read into its leaf blocks: stretches of text between block-level tags,
each with its ancestors' tags and class words, its link share and its text's
shape. The field labels the blocks of a page as a chain (main text or not),
decoded by Viterbi. It is trained on labelled pages: the hand-labelled ones
below, whose main blocks carry a ``data-main`` mark that is no feature, and a
bounded sample of the table's pages that have one ``article`` element, which
labels its blocks (those in navigation, forms, asides and the like excepted).
The sample is used a second time with its ``article`` tags read as plain
divisions, so that the field doesn't lean on that tag alone.

Null and empty pages, and pages without main text, give an empty text. Character
references are decoded once, white space within a block becomes one space, and
blocks are joined by an empty line. Rows are judged one by one, in one pass.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import in_arrow

#: Elements of the markup language by kind.
BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("br hr img input meta link source wbr area base col embed track param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their text is no text of the page. The first kind holds no elements and runs to the page's end if unclosed;
#: of the second an unclosed tag hides nothing.
RAW = "script|style|iframe|textarea"
UNSEEN = frozenset("noscript template svg object math canvas audio video".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"']*/\Z")  # the slash is the value's
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
REMEMBERED = 50_000  # ancestries whose features a Python worker remembers at most


class Block:
    __slots__ = ("above", "linked", "main", "pieces", "tag", "text")

    def __init__(self, tag: str, above: tuple, main: bool):
        self.tag, self.above, self.main, self.pieces, self.linked, self.text = tag, above, main, [], 0, ""


def _unseen(tokens: list[re.Match]) -> dict[int, int]:
    """Start of each unseen element that is closed, and its end; an unclosed one ends with its tag."""
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for m in tokens:
        if m[3] is None or (tag := m[3].lower()) not in UNSEEN or (m[4] and not (m[4][0].isspace() or m[4][0] == "/")):
            continue
        if m[2]:
            if stacks.get(tag):
                ends[stacks[tag].pop()] = m.end()
        elif not (tag in ("svg", "math") and m[4].endswith("/") and not _UNQUOTED.search(m[4])):
            stacks.setdefault(tag, []).append(m.start())
    return ends


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, bool]] = []  # tag, class words, marked as main
    current: Block | None = None
    link = 0
    at = 0

    def add(raw: str) -> None:
        nonlocal current
        if raw:
            if current is None:
                if raw.isspace():
                    return
                current = Block(stack[-1][0] if stack else "", tuple((t, c) for t, c, _ in stack), any(m for *_, m in stack))
                out.append(current)
            current.pieces.append(raw)
            if link:
                current.linked += len(raw)

    tokens = list(_TOKEN.finditer(page))
    ends = _unseen(tokens)
    for m in tokens:
        if m.start() < at:  # within an unseen element
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = ends.get(m.start(), m.end())
        if at > m.end():
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m[2] else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCK:
            current = None
            link = 0
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                if stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS or (tag in ("li", "option", "tr", "td", "dt", "dd") and stack[-1][0] == tag)):
                    stack.pop()
                if tag not in VOID and not m[4].endswith("/"):
                    words = tuple(w for v in _CLASS.findall(m[4]) for w in _WORD.findall(v.lower())) if m[4] else ()
                    stack.append((tag, words, "data-main" in m[4]))
    if at < len(page):
        add(page[at:])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
    return [b for b in out if b.text]


def ancestry(block: Block) -> tuple[str, ...]:
    """Features of a block's place in the tree."""
    found = {"tag " + block.tag} | {"in " + t for t, _ in block.above} | {"class " + w for _, c in block.above for w in c}
    found.add(f"depth {min(6, len(block.above))}")
    return tuple(sorted(found))


def shape(block: Block, before: Block | None, after: Block | None) -> tuple[str, ...]:
    """Features of a block's text, and of how its neighbours stand to it."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    share = min(1.0, block.linked / max(1, sum(map(len, block.pieces))))
    out = [f"words {min(8, words.bit_length())}", f"linked {math.ceil(3 * share)}"]
    if text[-1] in ".!?:…\"'”»)*%&$#":
        out.append("ends")
    if n and (text[0] == "©" or "©" in text[:40]):
        out.append("copyright")
    if before is None:
        out.append("first")
    elif before.tag == block.tag and before.above == block.above:
        out.append("as before")
    if after is None:
        out.append("last")
    return tuple(out)


class Field:
    """Weights for main text of each feature, and of the chain's four steps."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.steps = np.zeros((2, 2))
        self.seen: dict[tuple, float] = {}

    def emission(self, blocks: list[Block]) -> list[float]:
        """Each block's score for main text (against 0 for not)."""
        get, out = self.weights.get, []
        for i, b in enumerate(blocks):
            key = (b.tag, b.above)
            s = self.seen.get(key)
            if s is None:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                s = self.seen[key] = sum(get(f, 0.0) for f in ancestry(b)) + get("bias", 0.0)
            out.append(s + sum(get(f, 0.0) for f in shape(b, blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels of the chain (Viterbi)."""
        (a, b), (c, d) = self.steps.tolist()
        no = yes = 0.0
        back: list[tuple[int, int]] = []
        for i, e in enumerate(self.emission(blocks)):
            if i:
                from_no, to = (0 if no + a >= yes + c else 1), (0 if no + b > yes + d else 1)
                no, yes = max(no + a, yes + c), max(no + b, yes + d) + e
                back.append((from_no, to))
            else:
                yes = e
        label = [int(yes > no)] if blocks else []
        for pair in reversed(back):
            label.append(pair[label[-1]])
        return label[::-1]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page) if page else []
        return "\n\n".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], *, rounds: int = 25, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps, page by page.

    ``pages``: the features of a page's blocks, and their labels.
    """
    index: dict[str, int] = {}
    data = []
    for feats, labels in pages:
        if labels:
            rows = [np.array([index.setdefault(f, len(index)) for f in (*fs, "bias")]) for fs in feats]
            data.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(labels)))
    w, s = np.zeros(len(index)), np.zeros((2, 2))
    gw, gs = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            flat, of, y = data[k]
            n = len(y)
            e = np.zeros((n, 2))
            e[:, 1] = np.bincount(of, w[flat], n)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = e[0]
            for i in range(1, n):
                fwd[i] = e[i] + np.logaddexp(fwd[i - 1, 0] + s[0], fwd[i - 1, 1] + s[1])
            for i in range(n - 2, -1, -1):
                nxt = e[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(s[:, 0] + nxt[0], s[:, 1] + nxt[1])
            total = np.logaddexp(*fwd[-1])
            p = np.exp(fwd[:, 1] + bwd[:, 1] - total)
            grad = np.zeros(len(w))
            np.add.at(grad, flat, (y - p)[of])
            grad -= ridge * w
            gw += grad**2
            w += rate * grad / np.sqrt(gw)
            if n > 1:
                pair = np.exp(fwd[:-1, :, None] + s[None] + (e[1:] + bwd[1:])[:, None, :] - total).sum(0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                gs += (seen - pair) ** 2
                s += rate * (seen - pair) / np.sqrt(gs)
    field = Field()
    field.weights = {f: float(w[i]) for f, i in index.items()}
    field.steps = s
    return field


def labelled(page: str, semantic: bool) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Training chains of a page: by its marks, or by its ``article`` (read twice)."""
    blocks = blocks_of(page)
    each = [(*ancestry(b), *shape(b, blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None)) for i, b in enumerate(blocks)]
    if not semantic:
        return [(each, [int(b.main) for b in blocks])]
    apart = {"nav", "aside", "form", "footer", "header", "button", "select"}
    labels = [int("article" in (tags := {t for t, _ in b.above}) and not tags & apart) for b in blocks]
    plain = [tuple("in div" if f == "in article" else f for f in fs) for fs in each]
    return [(each, labels), (plain, labels)]


def fit(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = 100) -> Field:
    """Train on the hand-labelled pages and at most ``sample`` of the table's
    pages with one ``article``, chosen by a hash of the id."""
    body = F.col(html_col)
    rows = pages.where(body.contains("<article") & (F.length(body) < 50_000)).orderBy(F.xxhash64(id_col), body).select(body.alias("h")).limit(sample).collect()
    chains = [c for page in LABELLED for c in labelled(page, False)] * max(1, len(rows) // 40)
    for r in rows:
        if r["h"].count("<article") == 1:
            chains += labelled(r["h"], True)
    return train(chains)


def extract(pages: DataFrame, field: Field, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points)."""
    shipped = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shipped.value
        for batch in batches:
            texts = [model.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return in_arrow(rows, run, "id long, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


_LONG = "The river rose in the night and by morning the lower fields were under water, as the older farmers had said it would be."
_MORE = "Nobody was surprised, for the winter had been long; still, the bridge held, and the road to the market stayed open."
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/w">Weather</a></li><li><a href="/c">Contact</a></li></ul>'
_SIDE = '<h3>Most read</h3><ul><li><a href="/1">Ten quiet villages by the sea</a></li><li><a href="/2">How the mill was saved</a></li></ul>'
_SAYS = "<p>Anna: I live there, and it was worse than this page tells.</p><p>Tom: Thank you for the report!</p>"
_COOKIE = "<p>We use cookies to give you the best experience on our site. By going on you agree to their use.</p><button>Accept</button>"
_FORM = "<p>Subscribe to our newsletter.</p><label>Your address</label><button>Send</button>"
_AD = "<p>Buy two pairs of boots and get the third one free, only this week in our shop!</p>"


def _article(tag: str, name: str, inner: str = "") -> str:
    m = " data-main"
    return f'<{tag} {name}><h1{m}>High water in the valley</h1><p{m}>{_LONG}</p>{inner}<p{m}>{_MORE}</p><h2{m}>What comes next</h2><ul><li{m}>Pumps will run for a week, the council said.</li><li{m}>The school stays closed.</li></ul><blockquote{m}>We have seen worse.</blockquote><p{m}>{_LONG} {_MORE}</p><p{m}>Rain is expected.</p></{tag}>'


#: Hand-labelled pages: the same few texts in the layouts that pages commonly have.
LABELLED = [
    f"<html><head><title>High water</title></head><body><header><p>Valley News</p>{head}</header>{before}{body}{after}<footer><p>© Valley News. All rights reserved.</p>{_MENU}</footer></body></html>"
    for head, before, body, after in (
        (f"<nav>{_MENU}</nav>", f'<div class="cookie-notice">{_COOKIE}</div>', _article("article", ""), f"<aside>{_SIDE}</aside>"),
        (_MENU, f'<div class="ad">{_AD}</div>', _article("main", 'role="main"', f'<div class="advert">{_AD}</div>'), f'<div class="sidebar">{_SIDE}</div>'),
        (f'<div class="menu">{_MENU}</div>', "", _article("div", 'class="content"', f'<aside class="related">{_SIDE}</aside>'), f'<section class="comments"><h3>Comments</h3>{_SAYS}</section>'),
        (f"<nav>{_MENU}</nav>", f'<div id="banner">{_AD}</div>', _article("div", 'class="post entry"', f'<form class="newsletter">{_FORM}</form>'), f'<div id="comments">{_SAYS}</div>'),
        (f'<div id="navbar">{_MENU}</div>', f'<div class="notice">{_COOKIE}</div>', _article("section", 'class="story"', f'<figure><figcaption class="promo">{_AD}</figcaption></figure>'), f'<form><p>Log in</p>{_FORM}</form>'),
        (f"<nav>{_MENU}</nav>", "", f'<article>{_article("div", "", f"<aside>{_SIDE}</aside>")}<section class="comments">{_SAYS}</section><div class="share">{_MENU}</div></article>', f'<div class="ads sponsored">{_AD}</div>'),
        (f'<div class="topbar">{_MENU}</div>', "", f'<div class="wrapper">{_article("div", "class=maincol")}<div class="widget"><h4>Tags</h4><a href="/t">floods</a> <a href="/u">roads</a></div></div>', f'<div class="cookies">{_COOKIE}</div>'),
        (f"<div>{_MENU}</div>", f"<div>{_AD}</div>", f'<div class="wrapper"><div>{_article("div", "")}</div></div>', f"<div>{_SIDE}</div>"),
        ("", f'<table><tr><td>{_MENU}</td><td>{_article("div", "")}</td></tr></table>', "", f"<form>{_FORM}</form>"),
        (f"<nav>{_MENU}</nav>", f'<aside class="sidebar">{_SIDE}{_AD}</aside>', _article("article", 'class="article"', f'<div class="ad">{_AD}</div><form>{_FORM}</form>') , f'<section id="comments"><h2>Reader comments</h2>{_SAYS}{_SAYS}</section><div class="popup modal">{_COOKIE}</div>'),
    )
]
