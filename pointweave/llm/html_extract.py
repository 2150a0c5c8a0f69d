"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks of its DOM, each with the tags, classes and ids
above it. The field labels the sequence of blocks as main text or not, from
features of those ancestors and of the text, and Viterbi finds the best labels.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointweave.llm._frames import append_columns

#: Elements that never contain anything, whose content is no text,
#: that run within a line, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg textarea iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
#: Elements that say by themselves what they are for.
LANDMARKS = frozenset("article aside footer form header main nav".split())
#: Names that pages give to their parts.
OTHER_NAMES = (
    "nav navbar menu breadcrumb header masthead topbar banner footer bottom copyright sidebar aside widget related "
    "recommended popular trending ad ads advert advertisement sponsor sponsored promo cookie consent notice alert "
    "notification popup modal newsletter subscribe signup login search form share social comments comment respond "
    "reply discussion disqus tags pagination toolbar meta byline legal disclaimer"
).split()
MAIN_NAMES = "content article post entry story main body text blog page".split()
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
_SENTENCE = re.compile(r"[.!?…]")


class Block:
    """One leaf block: its text pieces, the features of what is above it, and how much of it is linked."""

    __slots__ = ("above", "linked", "pieces", "size")

    def __init__(self, above: tuple[str, ...]):
        self.above, self.pieces, self.linked, self.size = above, [], 0, 0


class Stack:
    """The open elements, each with the features of all elements from the root down to it.

    What an element adds is computed once, when it opens, from its parent's features, so
    the whole path counts however deep it is, and a block costs nothing for its depth.
    Features that are not ``known`` are left out, so a page of many names is no dearer.
    """

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known
        self.tags: list[str] = []
        self.names: list[frozenset[str]] = []
        self.near: list[frozenset[str]] = []
        self.open: Counter = Counter()

    def push(self, labels: str) -> None:
        tag, *names = labels.split(" ")
        above = self.names[-1] if self.names else frozenset()
        own = {"in " + tag, *("name " + w for w in names)}
        if self.known is not None:
            own &= self.known
        self.names.append(above if own <= above else above | own)
        if names or tag in LANDMARKS:
            said = names or [tag]
            near = {"near " + w for w in said}
            near |= {"near other" for w in said if w in OTHER_NAMES}
            near |= {"near main" for w in said if w in MAIN_NAMES}
            self.near.append(frozenset(near))
        else:
            # the nearest element above that says what it is for
            self.near.append(self.near[-1] if self.near else frozenset())
        self.tags.append(tag)
        self.open[tag] += 1

    def pop(self, n: int) -> None:
        """Close the innermost ``n`` elements."""
        for tag in self.tags[len(self.tags) - n :]:
            self.open[tag] -= 1
        for part in (self.tags, self.names, self.near):
            del part[len(part) - n :]

    def close(self, tag: str, within: int | None = None) -> None:
        """Close the innermost ``tag`` and what is open in it; without one, or with none among the
        ``within`` innermost elements, nothing."""
        if not self.open[tag]:
            return
        for k in range(1, len(self.tags) + 1 if within is None else min(within, len(self.tags)) + 1):
            if self.tags[-k] == tag:
                self.pop(k)
                return

    def features(self) -> tuple[str, ...]:
        if not self.tags:
            return ("tag",)
        out = ["tag " + self.tags[-1], *self.names[-1], *self.near[-1]]
        if len(self.tags) > 1:
            out.append("above " + self.tags[-2])
        return tuple(out)


def _labels(tag: str, attributes: str) -> str:
    """The tag and the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    words = [w for m in _NAMES.findall(attributes) for w in _PART.findall(m.lower())]
    return " ".join([tag, *words])


def leaf_blocks(source: str, known: frozenset[str] | None = None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, features of the ancestors, linked share) of the page's non-empty blocks, in page order."""
    blocks: list[Block] = []
    stack = Stack(known)
    block: Block | None = None
    at, linked, n = 0, False, len(source)
    unclosed: dict[str, int] = {}
    quotes_open = False

    def add(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if piece.isspace():
                return
            block = Block(stack.features())
            blocks.append(block)
        block.pieces.append(piece)
        size = len(piece)
        block.size += size
        if linked:
            block.linked += size

    while at < n:
        low = source.find("<", at)
        if low < 0:
            add(source[at:])
            break
        add(source[at:low])
        m = None if quotes_open else _TAG.match(source, low)
        if m is None:
            m = _LOOSE.match(source, low)
            # a tag whose quotes close nowhere: from here on they are not looked at
            quotes_open = quotes_open or m is not None
        if m is None:
            add("<")
            at = low + 1
            continue
        at = m.end()
        if m.lastindex is None or m.group(2) is None:
            continue  # a comment or a declaration
        tag = m.group(2).lower()
        if m.group(1):
            if tag in INLINE:
                linked = linked and tag != "a"
                continue
            block, linked = None, False
            stack.close(tag)
            continue
        if tag in INLINE:
            linked = linked or tag == "a"
            continue
        if tag in RAW:
            empty = tag == "svg" and m.group(3).endswith("/")
            if not empty:
                end = unclosed.get(tag, 0) <= at and _END[tag].search(source, at)
                if end:
                    at = end.end()
                elif tag in ("svg", "template"):
                    unclosed[tag] = n + 1  # no end anywhere: its start alone is passed over
                else:
                    at = n
            if tag != "svg":
                block = block if tag in ("script", "style") else None
            continue
        if tag == "br":
            add(" ")
            continue
        block, linked = None, False
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            stack.close("p", 2)
        elif tag == "li":
            stack.close("li", 1)
        stack.push(_labels(tag, m.group(3)))
    out = []
    for b in blocks:
        text = "".join(b.pieces)
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((text, b.above, b.linked / b.size))
    return out


def block_features(blocks: list[tuple[str, tuple[str, ...], float]]) -> list[list[str]]:
    """Ancestor and text features of each block."""
    rows = []
    for text, above, linked in blocks:
        size = len(text)
        row = ["bias", f"size {min(9, int(math.log2(size + 1)))}", f"linked {int(4 * linked)}"]
        row.append("sentence" if _SENTENCE.search(text) else "no sentence")
        row.append("ends" if text[-1] in ".!?…\"”»" else "open")
        row += above
        rows.append(row)
    return rows


class Chain:
    """Weights by feature of label 1 (main text) and a 2 x 2 table of transitions."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.known: frozenset[str] = frozenset()

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels, by Viterbi; equal scores go to 0."""
        (aa, ab), (ba, bb) = self.moves
        zero, one, back = 0.0, -math.inf, []
        first = True
        for s in self.scores(rows):
            if first:
                zero, one, first = 0.0, s, False
                back.append((0, 0))
                continue
            from_zero = (zero + aa, one + ba)
            from_one = (zero + ab, one + bb)
            back.append((int(from_zero[1] > from_zero[0]), int(from_one[1] > from_one[0])))
            zero, one = max(from_zero), max(from_one) + s
        out = []
        label = int(one > zero)
        for pair in reversed(back):
            out.append(label)
            label = pair[label]
        return out[::-1]

    def learn(self, rows: list[list[str]], gold: list[int], rate: float) -> None:
        """One step up the slope of the labels' conditional log-likelihood."""
        n = len(rows)
        s, moves = self.scores(rows), np.array(self.moves)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = (0.0, s[0])
        for t in range(1, n):
            forward[t] = np.logaddexp(*(forward[t - 1][:, None] + moves)) + (0.0, s[t])
        for t in range(n - 2, -1, -1):
            backward[t] = np.logaddexp(*(moves + backward[t + 1] + (0.0, s[t + 1])).T)
        total = np.logaddexp(*forward[-1])
        one = np.exp(forward[:, 1] + backward[:, 1] - total)
        for t in range(n):
            step = rate * (gold[t] - one[t])
            if abs(step) > 1e-5:
                for f in rows[t]:
                    self.weights[f] = self.weights.get(f, 0.0) + step
        for t in range(1, n):
            pair = forward[t - 1][:, None] + moves + (backward[t] + (0.0, s[t])) - total
            for a in (0, 1):
                for b in (0, 1):
                    hit = float(gold[t - 1] == a and gold[t] == b)
                    self.moves[a][b] += 0.2 * rate * (hit - math.exp(min(0.0, pair[a, b])))


def labelled_pages(seed: int, n: int, other_names=OTHER_NAMES, main_names=MAIN_NAMES):
    """Generated pages with their blocks' labels: (html, [(text, 0 or 1)]).

    Parts are named from the two lists, by words without meaning, or not at all; some
    main texts stand in the body itself, and some pages are nothing else.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    letters = list("aeioulnrstdm")

    def words(low, high):
        return " ".join("".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(low, high))))

    def name_of(names, ends):
        return pick(names) + pick(ends) if rng.random() < 0.8 else words(1, 2)

    def part(labels, text, label, tag, attributes=""):
        labels.append((text, label))
        return f"<{tag}{attributes}>{text}</{tag}>"

    def other(labels, inside=False):
        kind = int(rng.integers(0, 6))
        tag = pick(["nav", "aside", "footer", "header", "form", "div", "section", "ul"])
        if inside:
            tag = pick(["aside", "form", "div", "section", "nav", "footer"])
        named = tag in ("div", "section", "ul") or rng.random() < 0.5
        name = f' {pick(["class", "id"])}="{name_of(other_names, ["", "-box", " wide", "-list"])}"' if named else ""
        if kind < 2:
            rows = "".join("<li>" + part(labels, words(1, 4), 0, "a", ' href="/x"') + "</li>" for _ in range(int(rng.integers(2, 8))))
            inner = f"<ul>{rows}</ul>"
        elif kind < 4:
            inner = part(labels, words(3, 30) + pick([".", "", "!"]), 0, pick(["p", "div", "span", "h3"]))
        else:
            inner = "".join(part(labels, words(3, 60) + ".", 0, "p") for _ in range(int(rng.integers(1, 4))))
        return f"<{tag}{name}>{inner}</{tag}>"

    for _ in range(n):
        labels: list[tuple[str, int]] = []
        if rng.random() < 0.06:  # bare text
            yield "".join(part(labels, words(2, 60) + ".", 1, "p") for _ in range(int(rng.integers(1, 4)))), labels
            continue
        page = "<!DOCTYPE html><html><head><title>" + words(2, 9) + "</title></head><body>"
        labels.append((page.split("<title>")[1].split("</title>")[0], 0))
        page += "".join(other(labels) for _ in range(int(rng.integers(1, 4))))
        tag = pick(["article", "article", "main", "div", "section", "body"])
        named = tag != "body" and not (tag in ("article", "main") and rng.random() < 0.6)
        name = f' class="{name_of(main_names, ["", "-body", " wide"])}"' if named else ""
        page += f"<{tag}{name}>" if tag != "body" else ""
        if rng.random() < 0.8:
            page += part(labels, words(2, 10), 1, pick(["h1", "h1", "h2"]))
        for _ in range(int(rng.integers(1, 10))):
            if rng.random() < 0.2:
                page += other(labels, True)
            kind = pick(["p"] * 7 + ["h2", "blockquote", "pre", "div"])
            if rng.random() < 0.1:
                rows = "".join(part(labels, words(2, 20), 1, "li") for _ in range(int(rng.integers(2, 5))))
                page += f"<ul>{rows}</ul>"
            page += part(labels, words(2, 8) if kind == "h2" else words(2, 80) + ".", 1, kind)
        page += (f"</{tag}>" if tag != "body" else "") + "".join(other(labels) for _ in range(int(rng.integers(1, 4)))) + "</body></html>"
        yield page, labels


@lru_cache(maxsize=1)
def trained_chain(seed: int = 5, n: int = 500, rounds: int = 4) -> Chain:
    """The field trained on generated labelled pages; the same each time."""
    chain = Chain()
    data = []
    for page, labels in labelled_pages(seed, n):
        blocks = leaf_blocks(page)
        gold = [label for _, label in labels]
        if [b[0] for b in blocks] == [text for text, _ in labels]:
            data.append((block_features(blocks), gold))
    order = np.random.default_rng(seed)
    for turn in range(rounds):
        for k in order.permutation(len(data)):
            chain.learn(*data[k], 0.12 / (1 + turn))
    chain.known = frozenset(chain.weights)
    return chain


def main_text(source: str | None, chain: Chain) -> str:
    """The blocks that the field labels as main text, in page order, with one space between."""
    blocks = leaf_blocks(source or "", chain.known)
    if not blocks:
        return ""
    labels = chain.decode(block_features(blocks))
    return " ".join(b[0] for b, label in zip(blocks, labels, strict=True) if label)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` (string) and ``n_chars`` (long, its code points) to every page.

    The whole source is read; a null or empty one gives the empty text. Character
    references are decoded, white space within a block becomes one space, blocks
    are joined by one. Broken markup is read as it comes: an end tag without a
    start is passed over, an open element ends with the one around it. Input
    columns of those names are replaced; repeated rows are read each. There is no
    shuffle; the model (some hundred weights) is broadcast.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained_chain())

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(x.as_py(), shared.value) for x in part.column(html_col)]
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

        return work

    return append_columns(pages, html_col, "text string, n_chars bigint", make)
