"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans. Around the remaining digits and at-signs the
field scores whole candidate segments (their shape, digits, checksum, context) and
the moves between labels, and a dynamic program over segments of bounded length
picks borders and kinds together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointweave.llm._frames import append_columns

#: The kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most, and segments of a region whose scores are remembered.
MAX_TOKENS, REMEMBERED = 32, 50_000

# -- base spans ---------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each at-sign is looked at once, so long runs stay linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        elif start < at:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers; in a longer chain each next four, whether or not they pass."""
    out = []
    for run in _DOTTED.finditer(text):
        part = run.group().split(".")
        at = run.start()
        for k in range(0, len(part) - 3, 4):
            four = part[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = "".join(_DIGIT.findall(m.group()))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind in order, then by start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] if "." in text else []
        out += [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


# -- the field ----------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_SEED = re.compile(r"[0-9@]|(?i:[(\[{]at[)\]}]|\bat(?=\s+[\w-]+\s+dot\s))")


def regions(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Token spans near digits or at-signs, free of ``taken``; a region is never cut.

    A region reaches MAX_TOKENS whole tokens to both sides of each seed, so any segment
    that holds one lies in it. Tokens are runs, the same read from either end: the way
    back goes over the reversed text.
    """
    out: list[list[tuple[int, int]]] = []
    spans: list[tuple[int, int]] = []
    seeds = [m.span() for m in _SEED.finditer(text)]
    back, n, k, floor = text[::-1], len(text), 0, 0
    while k < len(seeds):
        low, at = seeds[k]
        for _ in range(MAX_TOKENS):
            if low <= floor:
                break
            low = n - _TOKEN.match(back, n - low).end()
        low = max(low, floor)
        left = MAX_TOKENS
        while k < len(seeds) and (seeds[k][0] < at or left):
            if seeds[k][0] < at:  # reached: the region goes on behind it
                at, left, k = max(at, seeds[k][1]), MAX_TOKENS, k + 1
                continue
            if at >= n:
                break
            at, left = _TOKEN.match(text, at).end(), left - 1
        while left and at < n:
            at, left = _TOKEN.match(text, at).end(), left - 1
        if spans and spans[-1][1] >= low:
            spans[-1] = (spans[-1][0], at)
        else:
            spans.append((low, at))
        floor = at
    busy, b = sorted(taken), 0
    for low, high in spans:
        while b < len(busy) and busy[b][1] <= low:
            b += 1
        cuts, at, k = [], low, b
        while k < len(busy) and busy[k][0] < high:
            cuts.append((at, busy[k][0]))
            at = max(at, busy[k][1])
            k += 1
        cuts.append((at, high))
        for s, e in cuts:
            if e - s >= 7 and _SEED.search(text, s, e):
                out.append([m.span() for m in _TOKEN.finditer(text, s, e)])
    return out


#: An at-sign or its words, in a segment that could be an address.
_SPELLED = re.compile(r"@|(?i:[(\[{]at[)\]}]|\sat\s)")


_SPELLED_DOT = re.compile(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+", re.I)


def _shape(piece: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\s+", " ", re.sub(r"[0-9]", "9", piece)))


def segment_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole candidate segment."""
    piece = text[start:end]
    digits = _DIGIT.findall(piece)
    groups = re.findall(r"[0-9]+", piece)
    out = [f"n{min(len(digits), 20)}", f"g{min(len(groups), 6)}", "s" + _shape(piece)[:26]]
    out.append("marks" + "".join(sorted(set(re.sub(r"[\w\s]", "", piece)))))
    out.append("letters" if re.search(r"[^\W\d_]", piece) else "bare")
    out.append("luhn" if len(digits) >= 12 and luhn("".join(digits)) else "sum")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("octets")
    if re.search(r"@|[(\[{ ]at[)\]} ]", piece):
        out.append("at")
    if re.search(r"[(\[{ ]dot[)\]} ]|\.\w", piece):
        out.append("dot")
    sign = _SPELLED.search(piece)
    if sign:
        # the words of either side: an address has one there, its dots spelled or not
        host = _SPELLED_DOT.sub(".", piece[sign.end() :].strip(" )]}"))
        out += [f"before {min(3, len(piece[: sign.start()].split()))}", f"behind {min(3, len(host.split()))}"]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    out.append("tight" if (before + after) and re.search(r"[\w@/=#.\"-]", before + after.replace(".", "")) else "loose")
    if text[end : end + 2].lstrip(".,")[:1].isdigit() or text[max(0, start - 2) : start].strip(" ")[-1:].isdigit():
        out.append("more digits")
    context = re.findall(r"[^\W\d_]+", text[max(0, start - 16) : start].lower())
    out.append("after " + (context[-1] if context else ""))
    return [f"{kind}|{f}" for f in out]


#: The labels of the field: outside, then the kinds.
LABELS = ("", *KINDS)


class SemiMarkov:
    """Weights by feature, of the moves from label to label, and exact decoding.

    A token outside entities is a segment of its own, whose score is 0; an entity is
    one segment, whose score is the sum of its features' weights. From each segment
    to the next a move between their labels is scored; outside to outside is 0.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def scorer(self):
        """The score of a segment, remembered by all that its features depend on."""
        known: dict[tuple, float] = {}

        def of(text: str, start: int, end: int, kind: str) -> float:
            key = (kind, text[start:end], text[max(0, start - 17) : start], text[end : end + 2])
            value = known.get(key)
            if value is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                value = known[key] = self.score(segment_features(text, start, end, kind))
            return value

        return of

    def moves(self) -> list[list[float]]:
        get = self.weights.get
        return [[get(f"{a}>{b}", 0.0) if a or b else 0.0 for b in LABELS] for a in LABELS]

    def candidates(self, text: str, row: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """(first token, token after, kind) of the segments that could be entities: of at most
        MAX_TOKENS tokens, within a line, with the digits or the signs that their kind needs."""
        for i, (s, _) in enumerate(row):
            head = text[s]
            if not (head.isalnum() or head in "+("):
                continue
            digits, letters, groups, dots, at, dot = 0, False, 0, 0, False, False
            for j in range(i, min(len(row), i + MAX_TOKENS)):
                a, e = row[j]
                first = text[a]
                if first.isdigit():
                    digits += e - a
                    groups += 1
                elif first.isalpha():
                    letters = True
                    word = text[a:e].lower()
                    at, dot = at or word == "at", dot or word == "dot"
                else:
                    if first in "\n\"'=<>|;":
                        break
                    dots += first == "."
                    at, dot = at or first == "@", dot or first == "."
                    continue
                kinds = []
                if not letters:
                    if 7 <= digits <= 15 and e - s <= 3 * digits:
                        kinds.append("phone")
                    if 13 <= digits <= 19:
                        kinds.append("card")
                    if dots == 3 or groups == 4:
                        kinds.append("ip")
                elif at and dot and head.isalnum() and _SPELLED.search(text, s, e):
                    kinds.append("email")
                for kind in kinds:
                    yield i, j + 1, kind

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features) + get(features[0].split("|")[0], 0.0)

    def decode(self, text: str, row: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation; of equal ones that with fewer entities."""
        ending: dict[int, list] = {}
        scored = self.scorer()
        for i, j, kind in self.candidates(text, row):
            score = scored(text, row[i][0], row[j - 1][1], kind)
            ending.setdefault(j, []).append((i, LABELS.index(kind), score))
        if not ending:
            return []
        moves, none = self.moves(), -math.inf
        best = [[0.0] + [none] * len(KINDS)]
        back: list[list] = [[None] * len(LABELS)]

        def come(t: int, label: int) -> tuple[float, int]:
            return max(((best[t][x] + moves[x][label], -x) for x in range(len(LABELS))))

        for t in range(1, len(row) + 1):
            value, minus = come(t - 1, 0)
            best.append([value] + [none] * len(KINDS))
            back.append([(t - 1, -minus)] + [None] * len(KINDS))
            for i, label, score in ending.get(t, ()):
                value, minus = come(i, label)
                if value + score > best[t][label]:
                    best[t][label], back[t][label] = value + score, (i, -minus)
        t, out = len(row), []
        label = max(range(len(LABELS)), key=lambda x: (best[t][x], -x))
        while t > 0:
            i, before = back[t][label]
            if label:
                out.append((LABELS[label], row[i][0], row[t - 1][1]))
            t, label = i, before
        return out[::-1]

    def gradient(self, text: str, row, gold: set[tuple[int, int, str]]) -> dict[str, float]:
        """The slope of the gold segmentation's log-likelihood, by forward and backward sums."""
        found = []
        for i, j, kind in self.candidates(text, row):
            f = segment_features(text, row[i][0], row[j - 1][1], kind)
            found.append((i, j, LABELS.index(kind), f, self.score(f)))
        if not found:
            return {}
        n, moves = len(row), np.array(self.moves())
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for x in found:
            by_end.setdefault(x[1], []).append(x)
            by_start.setdefault(x[0], []).append(x)
        total = np.logaddexp.reduce
        # forward[t, a]: all ways to t whose last segment has label a; backward[t, a]: all ways from there on
        forward, backward = np.full((n + 1, len(LABELS)), -np.inf), np.full((n + 1, len(LABELS)), -np.inf)
        forward[0, 0], backward[n] = 0.0, 0.0
        for t in range(1, n + 1):
            forward[t, 0] = total(forward[t - 1] + moves[:, 0])
            for i, _, k, _, score in by_end.get(t, ()):
                forward[t, k] = np.logaddexp(forward[t, k], total(forward[i] + moves[:, k]) + score)
        for t in range(n - 1, -1, -1):
            ways = [moves[:, 0] + backward[t + 1, 0]]
            ways += [moves[:, k] + score + backward[j, k] for _, j, k, _, score in by_start.get(t, ())]
            backward[t] = total(np.array(ways), axis=0)
        whole = total(forward[n])
        slope: dict[str, float] = {}
        spans = {(i, j): LABELS.index(kind) for i, j, kind in gold}
        held = np.zeros((len(LABELS), len(LABELS)))
        t, last = 0, 0
        starts = {i: (j, k) for (i, j), k in spans.items()}
        while t < n:  # the gold way
            t, k = starts.get(t, (t + 1, 0))
            held[last, k] += 1
            last = k
        for t in range(n):
            ways = forward[t][:, None] + moves - whole
            held[:, 0] -= np.exp(ways[:, 0] + backward[t + 1, 0])
            for i, j, k, features, score in by_start.get(t, ()):
                each = np.exp(ways[:, k] + score + backward[j, k])
                held[:, k] -= each
                delta = float(spans.get((i, j)) == k) - each.sum()
                if abs(delta) > 1e-4:
                    for f in [*features, LABELS[k]]:
                        slope[f] = slope.get(f, 0.0) + delta
        for a, first in enumerate(LABELS):
            for b, second in enumerate(LABELS):
                if (a or b) and abs(held[a, b]) > 1e-4:
                    slope[f"{first}>{second}"] = held[a, b]
        return slope


def _sentences(seed: int, n: int):
    """Labelled texts: the kinds in forms that the patterns know and in others, and look-alikes."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 9))))

    def card():
        digits = pick("4", "5") + d(14)
        return digits + next(str(c) for c in range(10) if luhn(digits + str(c)))

    def near_card():
        """Sixteen digits whose checksum fails."""
        digits = card()
        return digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(9))) % 10)

    def cut(x, sign):
        return sign.join(x[k : k + 4] for k in range(0, 16, 4))

    for _ in range(n):
        kind = pick("email", "ip", "card", "phone", *[None] * 5)
        if kind == "email":
            at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "))
            names = pick(word(), word(), f"{word()}.{word()}", f"{word()}.{word()}.{word()}", f"{word()}-{word()}")
            host = pick("", "", word() + dot, f"{word()}-{word()}{dot}") + pick(word(), f"{word()}-{word()}")
            body = f"{names}{pick('', '', '.' + d(2))}{at}{host}{dot}{pick('com', 'org', 'net', 'edu')}"
        elif kind == "ip":
            body = ".".join(str(x) for x in rng.integers(0, 256, 4))
        elif kind == "card":
            body = pick(card(), cut(card(), " "), cut(card(), "-"), cut(card(), "."))
        elif kind == "phone":
            a, b, c = d(3), d(3), d(4)
            body = pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}")
        else:
            body = pick(
                d(int(rng.integers(1, 20))),
                near_card(),
                near_card(),
                f"20{d(2)}-{d(2)}-{d(2)}",
                f"{d(1)}.{d(1)}.{d(2)}",
                f'"{rng.bytes(20).hex()}"',
                f"password={rng.bytes(9).hex()}",
                "AKIA" + word().upper() + d(4) + word().upper(),
                f"{d(2)}:{d(2)}:{d(2)}",
                f"{d(3)},{d(3)},{d(3)}",
                f"{word()}@{word()}",
                f"{d(4)} {d(4)} {d(2)}",
                f"{d(3)} {d(4)}",
                f"{rng.integers(256, 999)}.{d(3)}.{d(3)}.{d(3)}",
            )
        lead = pick(word(), word(), {"phone": "phone", "card": "card", "email": "mail", "ip": "from"}.get(kind, "id"))
        text = f"{word()} {lead} {body}{pick('', '', '.', ',')} {word()} {word()}"
        start = text.index(body)
        yield text, (kind, start, start + len(body)) if kind else None


@lru_cache(maxsize=1)
def trained_field(seed: int = 11, n: int = 1600, rounds: int = 4) -> SemiMarkov:
    """The field trained on generated sentences, whose spans are known; the same each time."""
    field = SemiMarkov({k: -2.0 for k in KINDS})
    data = []
    for text, span in _sentences(seed, n):
        for row in regions(text, []):
            starts = {s: k for k, (s, _) in enumerate(row)}
            ends = {e: k + 1 for k, (_, e) in enumerate(row)}
            gold = set()
            if span and span[1] in starts and span[2] in ends:
                gold.add((starts[span[1]], ends[span[2]], span[0]))
            data.append((text, row, gold))
    order = np.random.default_rng(seed)
    for turn in range(rounds):
        rate = 0.3 / (1 + turn)
        for k in order.permutation(len(data)):
            for f, slope in field.gradient(*data[k]).items():
                field.weights[f] = 0.9997 * field.weights.get(f, 0.0) + rate * slope
    return field


def find_spans(text: str, field: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans: base ones and those that the field adds beside them."""
    base = base_spans(text)
    if not base and not _SEED.search(text):
        return base, base
    extra = []
    for row in regions(text, [(s, e) for _, s, e in base]):
        extra += field.decode(text, row)
    if not extra:
        return base, base
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *extra}, key=lambda x: (order[x[0]], x[1], x[2]))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive.

    Whole texts are searched; a null text is empty. Base spans are the leftmost
    non-overlapping matches of each kind's pattern that pass its test; the field
    only adds spans outside of them. Both lists go by kind (email, ip, card,
    phone), then start. Input columns of those names are replaced; repeated rows
    are searched each. There is no shuffle; the model (some thousand weights) is
    broadcast, and a very long text is searched region by region.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        field = shared.value
        rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            base, every = [], []
            for text in part.column(text_col):
                b, a = find_spans(text.as_py() or "", field)
                base.append(rows(b))
                every.append(rows(a))
            return [pa.array(base, kind), pa.array(every, kind)]

        return work

    return append_columns(docs, text_col, f"base_spans {span}, spans {span}", make)
