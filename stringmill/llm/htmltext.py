"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between boundaries of block elements.
Each block has features of its ancestors (tags, words of class, id and role) and of
its text (length, share of links, punctuation, place).  The field gives a label to
every block, content or not, and Viterbi decoding finds the best labels of the page as
a whole.  It is trained by maximum likelihood on labelled pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Element kinds of the public HTML standard.  Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("script style template noscript iframe object svg math canvas head title textarea select option button datalist audio video map".split())
HEAD = frozenset("head meta link base title script style noscript template".split())
#: A start tag of the first closes an open element of the second, up to an element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is text, and noscript, which counts as one where it is closed.
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in (*RAW, "noscript")}
_LONG_NUMBER = re.compile(r"&#0*(\d+);?")


def decode(raw: str) -> str:
    """Character references decoded; a number beyond all characters is U+FFFD."""
    if "&" not in raw:
        return raw
    try:
        return unescape(raw)
    except ValueError:  # a number too long to be read as one
        return unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "�", raw))


@dataclass(slots=True)
class Frame:
    """An open element: features of it and its ancestors."""

    tag: str
    block: "Frame | None"
    features: frozenset[str]
    hidden: bool
    link: bool
    children: dict


def _child(parent: Frame, tag: str, attributes: str, known: Container[str] | None) -> Frame:
    names = ()
    if attributes:
        names = tuple(sorted({w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(m[2] or m[3] or m[4] or "")}))
    key = (tag, names)
    got = parent.children.get(key)
    if got is None:
        block = tag in BLOCKS
        own = {f"in:{tag}", *(f"name:{w}" for w in names)} if block or names else set()
        own -= parent.features
        if known is not None:
            own = {f for f in own if f in known}
        # Elements that add nothing share the set of their parent, however deep they lie.
        got = Frame(tag, None, parent.features | own if own else parent.features, parent.hidden or tag in HIDDEN, parent.link or tag == "a", {})
        got.block = got if block else parent.block
        if len(parent.children) < 500:
            parent.children[key] = got
    return got


def _root() -> Frame:
    top = Frame("", None, frozenset(), False, False, {})
    top.block = top
    return top


_top = _root()


@dataclass(slots=True)
class Block:
    tag: str
    features: frozenset[str]
    text: str
    link_share: float


class _Tags:
    """Ends of the tags of a page; the page is passed over once, whatever its quotes."""

    def __init__(self, html: str):
        self.html = html
        self.unclosed: set[int] = set()  # quotes that open a value and lead to no end of a tag

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends here; -1 if none does.

        A quoted value may hold ``>``.  If a quote is never closed, the next ``>`` ends
        the tag, so that no text is lost to it.
        """
        html = self.html
        first = html.find(">", at)
        if first < 0:
            return -1
        twos, ones = html.count('"', at, first), html.count("'", at, first)
        if not (twos or ones) or (twos % 2 == 0 and not ones) or (ones % 2 == 0 and not twos):
            return first
        passed = []
        while True:
            at = _SPACE.match(html, at).end()
            if at >= len(html):
                break
            if html[at] == ">":
                return at
            at = _KEY.match(html, at).end()
            value = _EQUALS.match(html, at)
            if not value:
                continue
            at = value.end()
            if html[at : at + 1] not in ('"', "'"):
                at = _BARE.match(html, at).end()
                continue
            passed.append(at)
            close = -1 if at in self.unclosed else html.find(html[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.unclosed.update(passed)
        return first


class _Stack:
    """The open elements, with the places of each tag's, so that none is searched for one by one."""

    def __init__(self):
        self.frames = [_top]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, frame: Frame) -> None:
        self.at.setdefault(frame.tag, []).append(len(self.frames))
        if frame.tag in BLOCKS:
            self.blocks.append(len(self.frames))
        self.frames.append(frame)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this tag; 0 if there is none."""
        own = self.at.get(tag)
        return own[-1] if own else 0

    def cut(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.frames) > k:
            tag = self.frames.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element closes none outside its block."""
        k = self.last(tag)
        if k and (tag in BLOCKS or not self.blocks or self.blocks[-1] < k):
            self.cut(k)

    def make_way(self, tag: str) -> None:
        """Close what the start tag of a block closes without an end tag."""
        if tag not in HEAD and self.last("head"):
            self.cut(self.last("head"))
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            floor = max(map(self.last, stop))
            while (k := max(map(self.last, names))) > floor:
                self.cut(k)
        while self.blocks and self.frames[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])


def leaf_blocks(html: str | None, known: Container[str] | None = None) -> list[Block]:
    """The visible leaf blocks of a page, in page order.

    Character references are decoded, white space inside a block becomes one space.
    Scripts, styles and other hidden elements, comments and markup fall away, and so
    does a tag that the page's end cuts off.  Missing end tags are supplied as the
    HTML standard has them; elements may lie as deep as they like.  With ``known``,
    blocks carry only those features of their ancestors.  Time is in proportion to
    the page's length.
    """
    global _top
    html = html or ""
    out: list[Block] = []
    stack, tags = _Stack(), _Tags(html)
    pieces: list[str] = []
    linked = total = 0
    owner: Frame | None = None

    def flush() -> None:
        nonlocal linked, total, owner
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(owner.block.tag, owner.features, text, linked / max(total, 1)))
            pieces.clear()
        linked = total = 0
        owner = None

    def add(raw: str) -> None:
        nonlocal linked, total, owner
        top = stack.frames[-1]
        if not top.hidden and raw:
            text = decode(raw)
            n = len(text.strip())
            if n and owner is None:
                owner = top
            pieces.append(text)
            total += n
            linked += n * top.link

    at, endless = 0, set()  # raw elements that have no end tag from here on
    while True:
        m = _OPEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if html.startswith("--", at) and html[at - 1] == "!":
                short = next((x for x in (">", "->") if html.startswith(x, at + 2)), None)
                end = at + 2 + len(short) if short else (c.end() if (c := _COMMENT_END.search(html, at + 2)) else -1)
            else:
                end = html.find(">", at - 1) + 1 or -1
            if end < 0:
                break
            at = end
            continue
        tag, end = m[2].lower(), tags.end(at)
        if end < 0:
            break
        attributes, at = html[at:end], end + 1
        if m[1]:
            if tag in BLOCKS:
                flush()
            stack.close(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            stack.make_way(tag)
        if tag in VOID:
            continue
        if tag in _RAW_END:
            closing = None if tag in endless else _RAW_END[tag].search(html, at)
            if closing:
                at = html.find(">", closing.start()) + 1 or len(html)
                continue
            endless.add(tag)
            if tag in RAW:
                break
        stack.push(_child(stack.frames[-1], tag, attributes, known))
    flush()
    return out


_SIZES = (1, 2, 3, 6, 11, 21, 41)


def describe(blocks: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out = []
    article = any("in:article" in b.features for b in blocks)
    main = any("in:main" in b.features for b in blocks)
    for k, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        size = sum(n >= s for s in _SIZES)
        own = [*b.features, "bias", f"tag:{b.tag}", f"size:{size}", f"size:{size}:{b.tag}"]
        share = 0 if b.link_share == 0 else 1 if b.link_share < 0.3 else 2 if b.link_share < 0.7 else 3
        own += [f"links:{share}", f"links:{share}:{min(size, 4)}", f"end:{b.text[-1] in '.!?…»”。'}", f"end:{b.text[-1] in '.!?…»”。'}:{size}"]
        if article and "in:article" not in b.features:
            own.append("outside-article")
        if main and "in:main" not in b.features:
            own.append("outside-main")
        if "©" in b.text or "·" in b.text or "|" in b.text or "»" in b.text[:-1]:
            own.append("marks")
        if k == 0:
            own.append("first")
        if k == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of the field: by feature for content against not, of neighbouring labels, of the first label."""

    weights: dict[str, float]
    #: step[a][b]: the block before has label a, this one b.
    step: list[list[float]]
    start: list[float]

    @cached_property
    def known(self) -> Container[str]:
        """Features of ancestors that make a difference; a block has no more of them than these."""
        return self.weights.keys() | {"in:article", "in:main"}

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the labels of the best sequence."""
        get = self.weights.get
        back: list[tuple[bool, bool]] = []
        (aa, ab), (ba, bb) = self.step
        no, yes = self.start
        for k, own in enumerate(describe(blocks)):
            s = sum([get(f, 0.0) for f in own])
            if k == 0:
                yes += s
                continue
            from_no, from_yes = yes + ba > no + aa, yes + bb > no + ab
            no, yes = (yes + ba if from_no else no + aa), s + (yes + bb if from_yes else no + ab)
            back.append((from_no, from_yes))
        label = yes > no
        out = [label]
        for before in reversed(back):
            label = before[label]
            out.append(label)
        return out[::-1] if blocks else []

    def extract(self, html: str | None) -> str:
        """Main text: the content blocks, joined by an empty line."""
        blocks = leaf_blocks(html, self.known)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def align(blocks: list[Block], text: str) -> list[bool]:
    """Labels of a page's blocks from its wanted main text: in order, each wanted block once."""
    wanted = Counter(" ".join(x.split()) for x in text.split("\n\n"))
    out = []
    for b in blocks:
        out.append(wanted[b.text] > 0)
        wanted[b.text] -= 1
    return out


def train(pages: Iterable[tuple[str, list[bool]]], *, ridge: float = 0.02, steps: int = 250, min_count: int = 3) -> Field:
    """Maximum likelihood with a ridge penalty, by Adam on the exact gradient (forward-backward)."""
    pages = [(describe(leaf_blocks(h)), np.array(y, int)) for h, y in pages]
    pages = [(x, y) for x, y in pages if len(x)]
    counts = Counter(f for x, _ in pages for own in x for f in set(own))
    names = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= min_count))}
    longest, n = max((len(x) for x, _ in pages), default=0), len(pages)
    if not n:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    cells, features = [], []  # which block has which feature
    for i, (own, labels) in enumerate(pages):
        mask[i, : len(own)] = True
        y[i, : len(own)] = labels
        for t, present in enumerate(own):
            known = {names[f] for f in present if f in names}
            features += known
            cells += [i * longest + t] * len(known)
    cells, features = np.array(cells), np.array(features)
    theta = np.zeros(len(names) + 6)
    m = v = np.zeros_like(theta)
    one = np.eye(2)
    pairs = mask[:, 1:] & mask[:, :-1]
    for k in range(1, steps + 1):
        w, step, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.bincount(cells, w[features], n * longest).reshape(n, longest)
        score[:, 0] += start
        alpha, beta = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            a, b = alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(a, b) + score[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            a = score[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(a[:, :1] + step[:, 0], a[:, 1:] + step[:, 1]), 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + step + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        target = one[y] * mask[:, :, None]
        g = np.concatenate([
            np.bincount(features, (p - target)[:, :, 1].ravel()[cells], len(names)),
            (joint - target[:, :-1, :, None] * target[:, 1:, None, :]).sum((0, 1)).ravel(),
            (p - target)[:, 0].sum(0),
        ]) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in names.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html).

    Null or empty html, or a page without content blocks: empty text.  Null page_id
    or url: carried on.  Repeated rows: each is extracted.  Empty table: no rows.
    Other columns are ignored.  Pages are read whole, a batch at a time; nothing is
    shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _top
        for batch in common.batches(batches):
            texts = [shared.value.extract(h) for h in batch.column(2).to_pylist()]
            _top = _root()  # forget the frames of these pages
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


@cache
def default_field() -> Field:
    """The field trained on ``labelled_pages``; it is the same each time, so it is trained once a process."""
    from .labelled_pages import labelled_pages

    return train(labelled_pages())


def op3_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the field trained on labelled pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_field())
