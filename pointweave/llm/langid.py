"""Language identification by Bayesian evidence fusion.

The posterior of a page's language combines the likelihood of its text, that of its
declared markup language, and a prior of its host that is smoothed by the host's
domain, then by the suffix of its address, then by the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import join_counted, materialize, name
from pointweave.llm._text import raw, steps
from pointweave.llm.url_filter import host_of

#: Labelled documents the text model is trained on at most, by a hash of their ids.
MAX_ROWS = 4000
#: Byte trigrams are hashed to so many buckets, and languages are so many at most: the
#: model, which is broadcast, has 4 bytes for each pair of them (50 MB).
BUCKETS, MAX_LANGUAGES = 1 << 16, 200
#: How many page's worth of its parent each level's prior gets; rows added to each
#: cell of the table of declared languages; the weight of one text at most (texts
#: repeat themselves, so their trigrams are no independent draws).
PRIOR_STRENGTH, CELL, TEXT_WEIGHT = 5.0, 1.0, 60.0

_HIDDEN = re.compile(r"<(script|style|head)\b", re.I)
_HIDDEN_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "head")}
_ROOT = re.compile(r"<html\b", re.I)
_META = re.compile(r"<meta\b", re.I)
_LANG = re.compile(r"""(?:^|[\s"'/])(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", re.I)
_CONTENT_LANGUAGE = re.compile(r"""http-equiv\s*=\s*["']?\s*content-language\b""", re.I)
_CONTENT = re.compile(r"""\bcontent\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", re.I)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[: 0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


def visible_text(source: str) -> str:
    """The source without markup, comments, scripts, styles and head, a blank for each; what never
    closes is passed over by its first character's tag alone. One pass."""
    out, at, dead = [], 0, set()
    while True:
        low = source.find("<", at)
        if low < 0:
            break
        out.append(source[at:low])
        if source.startswith("<!--", low) and "!" not in dead:
            end = source.find("-->", low + 4)
            if end >= 0:
                at = end + 3
                continue
            dead.add("!")
        hidden = _HIDDEN.match(source, low)
        tag = hidden.group(1).lower() if hidden else None
        if tag and tag not in dead:
            end = _HIDDEN_END[tag].search(source, hidden.end())
            if end:
                at = end.end()
                continue
            dead.add(tag)
        end = source.find(">", low)
        if end < 0:
            at = low
            break
        at = end + 1
    return " ".join([*out, source[at:]])


def declared_language(source: str) -> str:
    """The primary code that the first html element declares by lang or xml:lang, else the first meta
    element for content-language; in lower case, empty without one."""
    root = _ROOT.search(source)
    if root:
        end = source.find(">", root.end())
        found = _LANG.search(source[root.end() : end if end >= 0 else len(source)])
        if found:
            return found.group(1).lower()
    meta = _META.search(source)
    while meta:
        end = source.find(">", meta.end())
        if end < 0:
            break
        part = source[meta.end() : end]
        if _CONTENT_LANGUAGE.search(part):
            found = _CONTENT.search(part)
            if found:
                return found.group(1).lower()
        meta = _META.search(source, end)
    return ""


def _codes(data: np.ndarray) -> np.ndarray:
    """A bucket for each byte trigram; signs, digits and blanks are one symbol."""
    x = _FOLD[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def trigram_counts(texts: pa.Array) -> np.ndarray:
    data, at = raw(texts)
    total = np.zeros(BUCKETS)
    for low, high in zip(at[:-1], at[1:], strict=True):
        if high - low > 2:
            total += np.bincount(_codes(data[low:high]), minlength=BUCKETS)
    return total


@dataclass
class TextModel:
    """Log-probabilities of trigram buckets by language."""

    languages: list[str]
    table: np.ndarray

    def scores(self, text: str | None) -> list[float]:
        """The log-likelihood of each language, less the best one's, scaled to at most TEXT_WEIGHT draws."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) < 3:
            return [0.0] * len(self.languages)
        count = np.bincount(_codes(data), minlength=BUCKETS)
        used = np.flatnonzero(count)
        sums = self.table[:, used].astype(np.float64) @ count[used]
        n = float(count.sum())
        sums = sums / n * min(n, TEXT_WEIGHT)
        return (sums - sums.max()).tolist()


def train_text_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS
) -> TextModel:
    """Trigram frequencies by language, from at most ``max_rows`` labelled documents.

    Executors count; the driver gets BUCKETS counts per language. Rows without text,
    language or id are not used, and an id counts once, with its least text by hash.
    More than MAX_LANGUAGES languages raise ValueError.
    """
    rows = docs.select(
        F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"), F.col(name(lang_col)).alias("lang")
    ).dropna()
    spark = docs.sparkSession
    keys = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    keys = spark.createDataFrame(keys.collect(), rows.select("id").schema)  # max_rows ids
    schema = T.StructType.fromDDL("lang string, bucket int, n double")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in dict.fromkeys(langs):
                    own = part.column("text").take(pa.array(np.flatnonzero(langs == lang)))
                    sums[lang] = sums.get(lang, 0.0) + trigram_counts(own)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(used), pa.string()),
                    pa.array(used.astype(np.int32), pa.int32()),
                    pa.array(total[used], pa.float64()),
                ],
                names=schema.names,
            )

    one = F.min(F.struct(F.xxhash64("text", "lang"), "lang", "text")).alias("one")
    once = rows.join(F.broadcast(keys), "id").groupBy("id").agg(one).select("one.text", "one.lang")
    found = once.mapInArrow(count, schema)
    sums = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} are told apart")
    table = np.full((max(1, len(languages)), BUCKETS), 0.5)
    for k, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        table[k, own["bucket"]] += own["n"]
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return TextModel(languages or ["und"], table)


def suffix_of(host: Column) -> Column:
    """The last label of a host; empty without one."""
    return F.coalesce(F.element_at(F.split(host, r"\."), -1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    base = pages.select(
        F.col(name(id_col)).alias("id"), F.col(name(url_col)).alias("url"), F.col(name(html_col)).alias("html")
    )
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [base.schema["id"], base.schema["url"]] + T.StructType.fromDDL("declared string, loglik array<double>").fields
    )

    def run(batches):
        for batch in batches:
            for part in steps(batch, "html"):
                declared, scores = [], []
                for x in part.column("html"):
                    source = x.as_py() or ""
                    declared.append(declared_language(source))
                    scores.append(shared.value.scores(visible_text(source)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("url"),
                        pa.array(declared, pa.string()),
                        pa.array(scores, pa.list_(pa.float64())),
                    ],
                    names=schema.names,
                )

    found = base.mapInArrow(run, schema).withColumn("host", host_of(F.col("url")))
    return found.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host")))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def identify_languages(
    pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The language of every page with its posterior probability.

    Returns the id, ``host``, ``declared`` (the markup's language, empty if none),
    ``lang`` (the most probable of the model's languages, the first in their order
    if several are) and ``confidence`` (double).

    * Text alone gives each page a first posterior. Sums of these by grouped
      aggregation give the table P(declared | language) and the priors: global, then
      suffix, domain and host, each smoothed towards the one above by
      PRIOR_STRENGTH pages. A page's own first posterior is taken out of all four.
    * The suffix counts once, as a level of the prior.
    * A null or empty page has no text evidence; without a host its prior is that of
      all pages without one; a missing declaration is a value like any other.
    * Repeated rows are judged each, and each counts; other columns are not read.

    Hosts and declared languages are joined by key, the heaviest by a broadcast of
    bounded size; there is no limit on their number.
    """
    n = len(model.languages)
    seen = materialize(_evidence(pages, model, id_col, url_col, html_col).withColumn("first", _softmax(F.col("loglik"))))
    sums = F.array(*[F.sum(F.col("first")[k]) for k in range(n)])
    rows = F.count(F.lit(1))
    total = seen.agg(*[F.sum(F.col("first")[k]).alias(f"s{k}") for k in range(n)], rows.alias("n")).first()
    count, overall = float(total["n"] or 0), [float(total[k] or 0.0) for k in range(n)]

    declared = seen.groupBy("declared").agg(rows.alias("n"), sums.alias("s_declared"))
    cells = max(1, declared.count())
    logs = [F.log((F.col("s_declared")[k] + CELL) / (overall[k] + CELL * cells)) for k in range(n)]
    declared = materialize(declared.select("declared", "n", F.array(*logs).alias("log_declared")))

    by: DataFrame | None = None
    for k, level in enumerate(LEVELS):
        keys = list(LEVELS[: k + 1])
        own = seen.groupBy(*keys).agg(rows.alias(f"n_{level}"), sums.alias(f"s_{level}"))
        by = own if by is None else own.join(by, keys[:-1])
    hosts = materialize(by)

    joined = join_counted(seen, hosts, list(LEVELS), f"n_{LEVELS[-1]}")
    joined = join_counted(joined, declared, ["declared"], "n")
    own = F.col("first")
    prior = [(F.lit(overall[k]) - own[k] + 1.0) / (count - 1.0 + n) for k in range(n)]
    for level in LEVELS:
        others = F.col(f"n_{level}") - 1 + PRIOR_STRENGTH
        prior = [(F.col(f"s_{level}")[k] - own[k] + PRIOR_STRENGTH * prior[k]) / others for k in range(n)]
    # differences of sums may fall below zero by rounding
    logs = [F.col("loglik")[k] + F.log(F.greatest(prior[k], F.lit(1e-12))) + F.col("log_declared")[k] for k in range(n)]
    judged = joined.select("id", "host", "declared", _softmax(F.array(*logs)).alias("posterior"))
    best = F.array_max("posterior")
    names = F.array(*[F.lit(x) for x in model.languages])
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "declared",
        F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"),
        best.alias("confidence"),
    )


#: The levels of the host prior from the coarsest on; each value belongs to one of the level before.
LEVELS = ("suffix", "domain", "host")
