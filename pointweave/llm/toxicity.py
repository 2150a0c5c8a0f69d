"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another. Each later model also gets the
earlier categories' log-odds as features; it is trained with out-of-fold
predictions of them, so what it learns to trust is what it will see.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import append_columns, forget, materialize, name
from pointweave.llm._text import borders, hashes, raw, steps

#: Labelled rows a chain is trained on at most, by a hash of their ids, and the
#: features chosen for each category. Together they bound what the driver holds.
MAX_ROWS, MAX_FEATURES = 8000, 2000
FOLDS, ROUNDS, RIDGE = 4, 150, 1e-3
#: Rows added to each share of a log-ratio, and the weight that all ratios start from.
SMOOTH, START = 0.3, 0.12
#: Rows with a feature, at least.
LEAST_ROWS = 3
PREFIXES = (3, 4, 5, 6)
#: A feature also tells whether it occurs twice, and whether it does in so large a share of the words.
DENSE = 1 / 200
LEVELS = ("1", "2", "%")
#: Words whose parts a task remembers (about 150 bytes each).
REMEMBERED = 200_000
#: Words are runs of ASCII letters and of characters beyond ASCII, in lower case.
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def parts_of(word: str) -> tuple[str, ...]:
    """A word and its first letters, which it shares with its other forms."""
    return (word, *(word[:n] + "-" for n in PREFIXES if len(word) > n))


def levels(count: int, total: int) -> tuple[str, ...]:
    """What a part's count says: it occurs, occurs twice, and is dense."""
    if count < 2:
        return LEVELS[:1]
    return LEVELS if count >= DENSE * total else LEVELS[:2]


def features_of(text: str | None) -> set[str]:
    """All features of a whole text: parts of words, with their levels."""
    lowered = pc.utf8_lower(pa.scalar(text or "")).as_py()
    found = Counter(_WORD.findall(lowered.encode()))
    counts: Counter = Counter()
    for word, n in found.items():
        for part in parts_of(word.decode()):
            counts[part] += n
    total = sum(found.values())
    return {part + level for part, n in counts.items() for level in levels(n, total)}


class Vocabulary:
    """The chosen features of whole batches of texts, by array operations over their words."""

    def __init__(self, index: dict[str, int]):
        self.place = {part: k for k, part in enumerate(sorted({f[:-1] for f in index}))}
        self.at = np.full((len(self.place), len(LEVELS)), -1, np.int64)
        for feature, k in index.items():
            self.at[self.place[feature[:-1]], LEVELS.index(feature[-1])] = k
        self.memory: dict[int, tuple[int, ...]] = {}

    def _known(self, key: int, word: bytes) -> tuple[int, ...]:
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        found = [self.place.get(part, -1) for part in parts_of(word.decode())]
        out = self.memory[key] = tuple(k for k in found if k >= 0)
        return out

    def active(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all active features, ascending."""
        data, at = raw(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
        starts, ends = borders(data, at, _BREAKS)
        first = np.searchsorted(starts, at)
        total = np.diff(first)
        doc = np.repeat(np.arange(len(total)), total)
        keys, where, inverse = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        get = self.memory.get
        own = []
        for k, key in enumerate(keys.tolist()):
            parts = get(key)
            if parts is None:
                w = where[k]
                parts = self._known(key, data[starts[w] : ends[w]].tobytes())
            own.append(parts)
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((p for parts in own for p in parts), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        token = np.flatnonzero(size[inverse])  # most words have no chosen part
        word = inverse[token]
        n = size[word]
        spot = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, count = np.unique(np.repeat(doc[token], n) * len(self.place) + flat[spot], return_counts=True)
        row, part = np.divmod(pair, max(1, len(self.place)))
        held = np.stack([count >= 1, count >= 2, (count >= 2) & (count >= DENSE * total[row])], 1)
        feature = np.where(held, self.at[part], -1) if len(part) else np.zeros((0, len(LEVELS)), np.int64)
        row = np.repeat(row, len(LEVELS))[feature.ravel() >= 0]
        feature = feature.ravel()[feature.ravel() >= 0]
        order = np.lexsort((feature, row))
        return row[order], feature[order]


@dataclass
class Chain:
    """Trained categories in order: one weight vector each, over features, a bias and earlier log-odds."""

    categories: list[str]
    index: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, row: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
        """The probability of each category for ``n`` texts with these active features."""
        k = len(self.index)
        odds = np.zeros((n, 0))
        for w in self.weights:
            z = np.bincount(row, w[:k][feature], n) + w[k] + odds @ w[k + 1 :]
            odds = np.column_stack([odds, np.clip(z, -8.0, 8.0)])
        return [1.0 / (1.0 + np.exp(-z)) for z in odds.T]


def _runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of an ascending array begins, and which it is."""
    begin = np.flatnonzero(np.append(len(groups) > 0, groups[1:] != groups[:-1]))[: len(groups)]
    return begin, groups[begin]


def _summed(values: np.ndarray, begin: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    if len(begin):
        out[group] = np.add.reduceat(values, begin)
    return out


def _fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Logistic regression on sparse 0/1 features, dense extras and a bias, by Adam.

    Each feature is scaled by the log-ratio of its smoothed shares among positive
    and negative rows, and weights start, and are drawn back, to a common positive
    value: with few rows the model leans on these ratios, with many on the fit.
    """
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    dense = np.column_stack([np.ones(len(rows)), extra])
    if not len(rows):
        return np.zeros(n + dense.shape[1])
    good, every = np.bincount(at, y[of], n), np.bincount(at, minlength=n)
    ratio = np.log((good + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log(
        (every - good + SMOOTH) / (len(y) - y.sum() + 2 * SMOOTH)
    )
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    home = np.concatenate([np.full(n, START), [math.log(share / (1 - share))], np.zeros(extra.shape[1])])
    w, m, v = home.copy(), 0.0, 0.0
    # the entries by row and, for the slope, by feature, so that both sums run over neighbours
    by_row, by_feature = _runs(of), _runs(np.sort(at))
    of_by_feature = of[np.argsort(at, kind="stable")]
    for step in range(1, ROUNDS + 1):
        z = _summed((w[:n] * ratio)[at], *by_row, len(rows)) + dense @ w[n:]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        slope = np.concatenate([_summed(off[of_by_feature], *by_feature, n) * ratio, dense.T @ off]) + RIDGE * (w - home)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return np.concatenate([w[:n] * ratio, w[n:]])


def _odds(rows: list[np.ndarray], extra: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) + w[n] + extra @ w[n + 1 :]
    return np.clip(z, -8, 8)


def fit_chain(
    categories: list[str],
    index: dict[str, int],
    rows: list[np.ndarray],
    labels: np.ndarray,
    folds: np.ndarray,
    chosen: list[np.ndarray] | None = None,
) -> Chain:
    """``labels`` has a column per category; later models see out-of-fold log-odds of earlier ones.

    ``chosen`` lists for each fold which features were picked without its rows, and
    last those that were picked from all; the models of a fold use only its own.
    """
    n, chain = len(index), Chain(categories, index)
    extra = np.zeros((len(rows), 0))
    masks = chosen if chosen is not None else [np.ones(n, bool)] * (FOLDS + 1)
    seen = [[r[mask[r]] for r in rows] for mask in masks]
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        chain.weights.append(_masked(_fit(seen[FOLDS], extra, y, n), masks[FOLDS]))
        if c == len(categories) - 1:
            break  # nothing comes after it
        unseen = np.zeros(len(rows))
        for fold in range(FOLDS):
            out = np.flatnonzero(folds == fold)
            own = np.flatnonzero(folds != fold)
            if len(out):
                w = _masked(_fit([seen[fold][i] for i in own], extra[own], y[own], n), masks[fold])
                unseen[out] = _odds([seen[fold][i] for i in out], extra[out], w, n)
        extra = np.column_stack([extra, unseen])
    return chain


def _masked(w: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = w.copy()
    out[: len(mask)][~mask] = 0.0
    return out


def train_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Chain:
    """Fit a chain on at most ``max_rows`` labelled documents.

    ``labels`` has the id and a 0/1 column per category, in chain order; rows with
    a null among them are unlabelled. An id counts once, with one of its labels and
    texts (the least by hash), however many rows it has. Features are words and word
    beginnings; per category the ``max_features`` most telling ones by rows are
    chosen, from counts that executors reduce, once from all rows and once without
    each fold. Without labelled rows every probability is one half.
    """
    spark = docs.sparkSession
    n = len(categories)
    wanted = [F.col(name(c)).cast("int").alias(f"y{k}") for k, c in enumerate(categories)]
    asked = labels.select(F.col(name(id_col)).alias("id"), *wanted).dropna()
    ys = [f"y{k}" for k in range(n)]
    asked = asked.groupBy("id").agg(F.min(F.struct(F.xxhash64(*ys), *ys)).alias("y")).select("id", "y.*")
    asked = asked.orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", *ys)
    sample = spark.createDataFrame(asked.collect(), asked.schema)  # max_rows rows of a few integers
    texts = docs.select(F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"))
    met = texts.join(F.broadcast(sample), "id").groupBy("id", *ys)
    rows = met.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    # at most max_rows texts: written once, read for the counts and for the features
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    counted = T.StructType.fromDDL("feature string, fold int, rows bigint, " + ", ".join(f"p{k} bigint" for k in range(n)))

    def count(batches):
        total: Counter = Counter()
        good: list[Counter] = [Counter() for _ in range(n)]
        for batch in batches:
            truth = [batch.column(y).to_pylist() for y in ys]
            folds = batch.column("fold").to_pylist()
            for j, text in enumerate(batch.column("text")):
                found = [(f, folds[j]) for f in features_of(text.as_py())]
                total.update(found)
                for k in range(n):
                    if truth[k][j]:
                        good[k].update(found)
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, _ in keys], pa.string()),
                pa.array([fold for _, fold in keys], pa.int32()),
                pa.array([total[x] for x in keys], pa.int64()),
                *[pa.array([g[x] for x in keys], pa.int64()) for g in good],
            ],
            names=counted.names,
        )

    columns = ["rows", *[f"p{k}" for k in range(n)]]
    sums = rows.mapInArrow(count, counted).groupBy("feature")
    within = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS) for c in columns]
    sums = sums.agg(*[F.sum(c).alias(c) for c in columns], *within)
    sums = materialize(sums.filter(F.col("rows") >= LEAST_ROWS))
    truth = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(y).alias(f"p{k}") for k, y in enumerate(ys)]).collect()
    if not truth:
        return Chain(categories, {}, [np.zeros(1 + k) for k in range(n)])

    def picked(fold: int | None) -> list[str]:
        """The features of the rows outside of a fold, or of all."""
        there = {c: sum(r[c] for r in truth if r["fold"] != fold) for c in columns}
        if not there["rows"]:
            return []
        own = {c: F.col(c) - F.col(f"{c}_{fold}") if fold is not None else F.col(c) for c in columns}
        out: dict[str, None] = {}
        for k in range(n):
            share = there[f"p{k}"] / there["rows"]
            expected = own["rows"] * share
            # how far the count lies from what chance gives, in deviations
            score = F.abs(own[f"p{k}"] - expected) / F.sqrt(expected * (1 - share) + 0.5)
            best = sums.filter(own["rows"] >= LEAST_ROWS).orderBy(score.desc(), "feature").limit(max_features)
            out |= dict.fromkeys(r[0] for r in best.select("feature").collect())
        return list(out)

    by_fold = [picked(f) for f in range(FOLDS)] if n > 1 else [[]] * FOLDS
    by_fold.append(picked(None))
    index = {f: i for i, f in enumerate(sorted({f for own in by_fold for f in own}))}
    masks = [np.zeros(len(index), bool) for _ in by_fold]
    for mask, own in zip(masks, by_fold, strict=True):
        mask[[index[f] for f in own]] = True
    shared = spark.sparkContext.broadcast(index)
    found = T.StructType.fromDDL("id string, at array<int>, fold int, " + ", ".join(f"{y} int" for y in ys))

    def active(batches):
        known = Vocabulary(shared.value)
        for batch in batches:
            for part in steps(batch, "text"):
                row, feature = known.active(part.column("text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), lists, part.column("fold"), *[part.column(y) for y in ys]],
                    names=found.names,
                )

    data = sorted(rows.mapInArrow(active, found).collect(), key=lambda r: (r.id or "", r.at))
    forget(sums)
    forget(rows)
    sparse = [np.asarray(r.at, np.int64) for r in data]
    truth = np.array([[r[y] for y in ys] for r in data]).reshape(len(data), n)
    return fit_chain(categories, index, sparse, truth, np.array([r.fold for r in data], int), masks)


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``p_<category>`` (double) for each category and ``toxic`` (the last one's is at least ``threshold``).

    Whole texts are read; a null or wordless text has the chain's bias alone.
    Input columns of those names are replaced. The model (a few thousand features)
    is broadcast; there is no shuffle, and repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = ", ".join(f"{name('p_' + c)} double" for c in chain.categories) + ", toxic boolean"

    def make():
        model = shared.value
        known = Vocabulary(model.index)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            by = model.predict(*known.active(part.column(text_col)), part.num_rows)
            return [*[pa.array(p, pa.float64()) for p in by], pa.array(by[-1] >= threshold, pa.bool_())]

        return work

    return append_columns(docs, text_col, added, make)


def judged_labels(labels: DataFrame) -> DataFrame:
    """The table ``labels`` with its categories in chain order: poor quality, then toxicity."""
    return labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
