"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks, runs of text between block-level tags, each with the
tags above it. Features of the tags and the text give a score per block, neighbouring
labels a score per pair; the field is trained on labelled pages by gradient steps on the
conditional likelihood and decoded by the Viterbi recursion.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, least_by, map_batches, ready

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("script style template noscript textarea iframe object svg select option title noembed".split())
# Text up to the closing tag is not markup.
RAW = frozenset("script style textarea title iframe noembed".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
OUTSIDE = frozenset("nav header footer aside form menu dialog button".split())
INSIDE = frozenset("article main".split())
# Words of a class, id or role that set a part of an article apart.
APART = frozenset("ad ads advert advertisement comment comments promo related reply replies share sponsored".split())

# Nothing is taken back once read, so a broken tag costs one pass.
TOKEN = re.compile(
    r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
TAG_WORD = re.compile(r"[a-z]+")

BUCKETS = 1 << 13
# Labelled pages taken from the table at most (those with the least hash of their id)
# and written from the layouts below.
TABLE_PAGES, LAYOUT_PAGES = 200, 400
EPOCHS, RATE, RIDGE, SEED = 6, 0.3, 1e-4, 5


class Path:
    """A block-level tag with the words of its class, id and role, below its parent.

    Equal paths are one object, also across pages. A path keeps the features of all its
    tags as a bit mask that it shares with its parent where it adds none, so a deep page
    costs as much as a flat one.
    """

    __slots__ = ("parent", "tag", "words", "mask", "near", "main", "score", "children")
    made = 0

    def __init__(self, parent: Path | None = None, tag: str = "", words: tuple[str, ...] = ()):
        self.parent, self.tag, self.words, self.score, self.children = parent, tag, words, None, None
        if parent is None:
            self.mask, self.near, self.score = 0, (), 0.0
            self.main = None
            return
        added = 0
        for name in (f"tag {tag}", *(f"word {w}" for w in words)):
            added |= 1 << bucket(name)
        self.mask = parent.mask if parent.mask | added == parent.mask else parent.mask | added
        near = (f"near {tag}", *(f"near word {w}" for w in (*parent.words, *words)))
        self.near = tuple(sorted({b for b in map(bucket, near) if not self.mask >> b & 1}))
        # Whether a block here is main text by its tags: None until an article begins.
        self.main = parent.main
        if tag in OUTSIDE or APART.intersection(words):
            self.main = False
        elif self.main is None and tag in INSIDE:
            self.main = True

    def child(self, tag: str, words: tuple[str, ...]) -> Path:
        if self.children is None:
            self.children = {}
        found = self.children.get((tag, words))
        if found is None:
            found = self.children[tag, words] = Path(self, tag, words)
            Path.made += 1
        return found

    def tags(self) -> list[tuple[str, tuple[str, ...]]]:
        """Tags outermost first, each with its words."""
        path, out = self, []
        while path.parent is not None:
            out.append((path.tag, path.words))
            path = path.parent
        return out[::-1]

    def features(self) -> list[int]:
        return sorted({*bits_of(self.mask), *self.near})

    def scored(self, weights: np.ndarray) -> float:
        """Sum of the features' weights; sums of the mask are kept along the path."""
        path, todo = self, []
        while path.score is None:
            todo.append(path)
            path = path.parent
        for path in reversed(todo):
            fresh = path.mask & ~path.parent.mask
            path.score = path.parent.score + (float(weights[bits_of(fresh)].sum()) if fresh else 0.0)
        return self.score + float(weights[list(self.near)].sum())


def bits_of(mask: int) -> list[int]:
    raw = np.frombuffer(mask.to_bytes(BUCKETS // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class Block(NamedTuple):
    text: str
    above: Path
    link_chars: int


class Open(NamedTuple):
    """An open tag: the path and place of the innermost block-level tag up to it."""

    name: str
    path: Path
    block: int


def leaf_blocks(page: str, root: Path | None = None) -> list[Block]:
    """Blocks in page order. Missing and stray end tags are mended as browsers do roughly:
    an end tag closes what is open inside its element, one without a start is dropped.
    Time and memory grow with the length of the page, however its tags are nested."""
    blocks: list[Block] = []
    stack = [Open("", root or Path(), 0)]
    count: dict[str, int] = {}
    parts: list[str] = []
    links, hidden = 0, 0
    at, size = 0, len(page)
    last = page.rfind(">")

    def close_block() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, stack[-1].path, links))
        parts.clear()
        links = 0

    def close_from(place: int) -> None:
        nonlocal hidden
        for tag in stack[place:]:
            count[tag.name] -= 1
            hidden -= tag.name in NOT_TEXT
        del stack[place:]

    def add(text: str) -> None:
        nonlocal links
        if text and not hidden:
            plain = html.unescape(text) if "&" in text else text
            parts.append(plain)
            if count.get("a"):
                links += len(plain.strip())

    while at < size:
        found = TOKEN.search(page, at) if at <= last else None
        if not found and (begin := page.find("<!--", at)) >= 0:
            add(page[at:begin])
            break  # a comment that does not end
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, inner = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if name not in INLINE:
            close_block()
        if closing:
            if count.get(name):
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                close_from(place)
            continue
        if name in VOID or inner.endswith("/") and name not in RAW:
            continue
        if name in CLOSES_PARAGRAPH or name in ("li", "tr", "td", "th", "dd", "dt"):
            place = stack[-1].block  # beyond it only inline tags are open
            if place and stack[place].name == ("p" if name in CLOSES_PARAGRAPH else name):
                close_from(place)
        words: tuple[str, ...] = ()
        if inner:
            values = " ".join(a or b or c for a, b, c in NAMED.findall(inner)).lower()
            words = tuple(dict.fromkeys(TAG_WORD.findall(values)))
        if name in RAW:
            end = re.compile(rf"</{name}", re.I).search(page, at)
            at = size if not end else end.start()
        outer = stack[-1]
        if name in INLINE:
            stack.append(Open(name, outer.path, outer.block))
        else:
            stack.append(Open(name, outer.path.child(name, words), len(stack)))
        count[name] = count.get(name, 0) + 1
        hidden += name in NOT_TEXT
    close_block()
    return blocks


KEYWORDS = frozenset(
    "cookie cookies subscribe newsletter sign login comment comments reply replies advertisement sponsored share "
    "copyright rights privacy terms related menu search".split()
)


def bucket(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) % BUCKETS


# A block with more words is prose, in which the words of menus and notices say nothing.
LABEL_WORDS = 30
# Paths kept from page to page.
PATHS_KNOWN = 20_000


def own_features(block: Block) -> list[int]:
    """Buckets of the features of a block's text."""
    text = block.text
    words = text.split()
    names = [
        "always",
        f"chars {min(12, len(text).bit_length())}",
        f"words {min(9, len(words).bit_length())}",
        f"links {int(4 * block.link_chars / max(1, len(text)))}",
        f"end {'stop' if text[-1] in '.!?:;' else 'open'}",
        f"mark {'©' in text}",
    ]
    if len(words) <= LABEL_WORDS:
        names += [f"key {w}" for w in {w.strip('.,:;!?').lower() for w in words} & KEYWORDS]
    return [bucket(n) for n in names]


def features(block: Block) -> list[int]:
    """Buckets of the features that hold for a block."""
    return block.above.features() + own_features(block)


class Field(NamedTuple):
    """Score of label 1 over 0 per feature, and of each pair of neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray


def add_exp(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(scores: Sequence[float], pairs: Sequence[Sequence[float]]) -> tuple[list[float], list[list[float]]]:
    """Probability of label 1 at each place, and expected counts of label pairs."""
    n = len(scores)
    (p00, p01), (p10, p11) = pairs
    ahead = [(0.0, scores[0])]
    for k in range(1, n):
        a0, a1 = ahead[-1]
        ahead.append((add_exp(a0 + p00, a1 + p10), add_exp(a0 + p01, a1 + p11) + scores[k]))
    back = [(0.0, 0.0)] * n
    for k in range(n - 2, -1, -1):
        b0, b1 = back[k + 1]
        s = scores[k + 1]
        back[k] = (add_exp(p00 + b0, p01 + s + b1), add_exp(p10 + b0, p11 + s + b1))
    total = add_exp(*ahead[-1])
    one = [math.exp(min(0.0, a[1] + b[1] - total)) for a, b in zip(ahead, back, strict=True)]
    seen = [[0.0, 0.0], [0.0, 0.0]]
    for k in range(1, n):
        for i in (0, 1):
            for j in (0, 1):
                here = ahead[k - 1][i] + pairs[i][j] + (scores[k] if j else 0.0) + back[k][j]
                seen[i][j] += math.exp(min(0.0, here - total))
    return one, seen


def viterbi(scores: Sequence[float], pairs: Sequence[Sequence[float]]) -> list[int]:
    """The most probable labels; label 0 on ties."""
    if not len(scores):
        return []
    (p00, p01), (p10, p11) = pairs
    best0, best1 = 0.0, scores[0]
    steps = []
    for s in scores[1:]:
        from0, from1 = best1 + p10 > best0 + p00, best1 + p11 > best0 + p01
        steps.append((from0, from1))
        best0, best1 = (
            best1 + p10 if from0 else best0 + p00,
            (best1 + p11 if from1 else best0 + p01) + s,
        )
    labels = [int(best1 > best0)]
    for step in reversed(steps):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def fit(pages: Sequence[tuple[list[list[int]], list[int]]]) -> Field:
    """Adaptive gradient ascent on the conditional likelihood, one page at a time."""
    weights, pairs = np.zeros(BUCKETS), [[0.0, 0.0], [0.0, 0.0]]
    power, pair_power = np.full(BUCKETS, 1e-6), [[1e-6, 1e-6], [1e-6, 1e-6]]
    order = list(range(len(pages)))
    turn = random.Random(SEED)
    for _ in range(EPOCHS):
        turn.shuffle(order)
        for k in order:
            found, labels = pages[k]
            if not found:
                continue
            scores = [float(weights[f].sum()) for f in found]
            one, seen = marginals(scores, pairs)
            for f, p, y in zip(found, one, labels, strict=True):
                step = (y - p) - RIDGE * weights[f]
                power[f] += step * step
                weights[f] += RATE * step / np.sqrt(power[f])
            for a, b in zip(labels, labels[1:]):
                seen[a][b] -= 1
            for i in (0, 1):
                for j in (0, 1):
                    step = -seen[i][j]
                    pair_power[i][j] += step * step
                    pairs[i][j] += RATE * step / math.sqrt(pair_power[i][j])
    return Field(weights, np.array(pairs))


def tag_label(block: Block) -> int:
    """Label of a block by the tags above it: in the article, and in no part set apart."""
    return int(bool(block.above.main))


# Layouts of labelled pages. {m} stands for main text, {x} for other text.
MAIN_FRAMES = (
    "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>",
    '<div id="content" class="post-content">{}</div>', '<div class="entry-content">{}</div>',
    '<div role="main" class="article-body">{}</div>', "<article><section>{}</section></article>",
    '<div class="page"><article class="story">{}</article></div>',
)
MAIN_PARTS = (
    "<h1>{m1}</h1>", "<h2>{m1}</h2>", "<p>{m}</p>", "<p>{m}</p>", "<p>{m}</p>", "<p><b>{m}<br><p>{m}</p>", "<p>{m1}</p>",
    "<blockquote>{m}</blockquote>", "<ul><li>{m1}</li><li>{m1}</li></ul>", "<p>{m} <a href=\"/x\">{m1}</a> {m}</p>",
    "<table><tr><td>{m1}</td><td>{m1}</td></tr></table>", "<pre>{m}</pre>", "<div>{m}</div>",
)
BEFORE = (
    '<nav><ul><li><a href="/a">{x1}</a></li><li><a href="/b">{x1}</a></li></ul></nav>',
    '<div class="menu"><a href="/a">{x1}</a><a href="/b">{x1}</a></div>', "<header><h1>{x1}</h1><p>{x}</p></header>",
    '<div id="header" class="site-header">{x1}</div>', '<div class="ad">{x}</div>', '<div class="advert banner">{x}</div>',
    '<div class="cookie-notice">{x} <button>{x1}</button></div>', '<div id="consent" role="dialog"><p>{x}</p></div>',
    '<div class="breadcrumbs"><a href="/">{x1}</a> {x1}</div>', '<div class="notice alert">{x}</div>',
)
AFTER = (
    "<footer>© {x1} · {x}</footer>", "<footer>{x}</footer>", '<div id="footer" class="site-footer"><p>{x}</p></div>',
    "<aside><h3>{x1}</h3><p>{x}</p></aside>", '<div class="sidebar widget"><h3>{x1}</h3><ul><li><a href="/r">{x1}</a></li></ul></div>',
    '<form action="/s"><label>{x1}</label><input name="q"><p>{x}</p></form>', '<div class="newsletter signup"><p>{x}</p></div>',
    '<section id="comments" class="comments"><h3>{x1}</h3><div class="comment"><p>{x}</p></div><div class="comment"><p>{x}</p></div></section>',
    '<div class="comment-list"><p>{x}</p><p>{x}</p></div>', '<div class="related"><a href="/r">{x1}</a><a href="/q">{x1}</a></div>',
    '<div class="sponsored promo">{x}</div>', '<ol class="commentlist"><li class="comment">{x}</li></ol>', '<div class="share social"><a href="/t">{x1}</a></div>',
)
WITHIN = (
    '<div class="ad">{x}</div>', "<aside>{x}</aside>", '<div class="share social"><a href="/t">{x1}</a></div>',
    '<div class="comments"><div class="comment"><p>{x}</p></div></div>', '<form><p>{x}</p></form>', '<div class="newsletter">{x}</div>', "<footer>{x1}</footer>",
    "<header><a href=\"/c\">{x1}</a></header>", '<nav><a href="/n">{x1}</a></nav>', '<div class="notice">{x}</div>',
)


def written_page(turn: random.Random) -> tuple[list[Block], list[int]]:
    """Blocks of a page written from the layouts, with their labels.

    Words are made of letters at random; the label is a mark put before the text, which
    is taken off again.
    """

    def words(most: int) -> str:
        made = ("".join(turn.choices("abcdefghilmnoprstuv", k=turn.randint(2, 9))) for _ in range(turn.randint(1, most)))
        return " ".join(made).capitalize() + turn.choice((".", ".", "", "!"))

    def filled(part: str) -> str:
        for mark, label, most in (("{m}", "1", 60), ("{m1}", "1", 6), ("{x}", "0", 25), ("{x1}", "0", 4)):
            while mark in part:
                part = part.replace(mark, f"\x01{label}\x02" + words(most), 1)
        return part

    def some(parts: Sequence[str], least: int, most: int) -> list[str]:
        return [filled(turn.choice(parts)) for _ in range(turn.randint(least, most))]

    inside = some(MAIN_PARTS, 1, 8)
    if turn.random() < 0.5:
        inside.insert(turn.randint(0, len(inside)), filled(turn.choice(WITHIN)))
    body = "".join([*some(BEFORE, 0, 3), turn.choice(MAIN_FRAMES).format("".join(inside)), *some(AFTER, 0, 4)])
    blocks, labels = [], []
    for block in leaf_blocks(f"<html><head><title>t</title></head><body>{body}</body></html>"):
        labels.append(int("\x011\x02" in block.text))
        plain = re.sub("\x01.\x02", "", block.text)
        blocks.append(block._replace(text=plain or ".", link_chars=min(block.link_chars, len(plain))))
    return blocks, labels


def train(pages: DataFrame, table_pages: int = TABLE_PAGES, layout_pages: int = LAYOUT_PAGES) -> Field:
    """Fit on labelled pages: at most ``table_pages`` of the table, labelled by their tags
    where they have an article or main element, and pages written from the layouts.

    Only feature numbers and labels come to the driver. Which pages are taken depends on
    the hash of their URL and text only.
    """
    ready(pages.sparkSession)
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    marked = pages.select(source.alias("html"), F.xxhash64("url", "html").alias("turn"))
    # First the hashes alone, so that no text is sorted.
    least = least_by(marked.select("turn").distinct(), "turn", table_pages)
    chosen = marked.join(F.broadcast(least), "turn").dropDuplicates(["turn"])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, page in zip(batch["turn"].to_pylist(), batch["html"].to_pylist(), strict=True):
                blocks = leaf_blocks(page)
                labels = [tag_label(b) for b in blocks]
                if any(labels):
                    yield batch_of(
                        turn=pa.array([turn], pa.int64()),
                        features=pa.array([[features(b) for b in blocks]], pa.list_(pa.list_(pa.int32()))),
                        labels=pa.array([labels], pa.list_(pa.int32())),
                    )

    table = map_batches(
        chosen.select("turn", "html"), labelled, "turn long, features array<array<int>>, labels array<int>"
    ).toArrow().sort_by("turn")
    found = list(zip(table["features"].to_pylist(), table["labels"].to_pylist(), strict=True))
    turn = random.Random(SEED)
    for _ in range(layout_pages):
        blocks, labels = written_page(turn)
        found.append(([features(b) for b in blocks], labels))
    return fit(found)


def main_text(page: str, field: Field, root: Path) -> tuple[str, list[int]]:
    """Text of the main blocks and the labels of all; ``root`` keeps scores of one field."""
    blocks = leaf_blocks(page, root)
    scores = [b.above.scored(field.weights) + float(field.weights[own_features(b)].sum()) for b in blocks]
    labels = viterbi(scores, field.pairs.tolist())
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y), labels


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) for every row, without a shuffle.

    The text is that of the main blocks, in page order, joined by a blank; empty if there
    is none. A null page is empty; broken markup is mended; repeated rows are kept, null
    ids and URLs stay null, no rows give no rows, other columns are not read. Time and
    memory of a very long page grow with its length; of equal scores the block is left out.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Path()
        for batch in batches:
            found = []
            for page in batch["html"].to_pylist():
                if Path.made > PATHS_KNOWN:
                    root, Path.made = Path(), 0
                found.append(main_text(page, field, root))
            yield batch_of(
                page_id=batch["page_id"], url=batch["url"],
                text=pa.array([t for t, _ in found], pa.string()),
                n_chars=pa.array([len(t) for t, _ in found], pa.int64()),
                n_blocks=pa.array([len(y) for _, y in found], pa.int64()),
                n_main=pa.array([sum(y) for _, y in found], pa.int64()),
            )

    return map_batches(rows, extracted, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
