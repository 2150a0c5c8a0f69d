"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of consecutive words of benchmark items. A block is
two neighbouring words: a shift table says how far no test string can end, a
bucket by the final block holds the test strings that might, and comparing the
words themselves confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm._frames import append_columns, name
from pointweave.llm._text import SYMBOL_BYTES

#: Words of benchmark items that one broadcast table is built from (some 100 MB
#: at most); larger benchmarks are searched for in several tables, one after another.
MAX_TABLE_WORDS = 400_000

_FOLD = bytes(0x20 if SYMBOL_BYTES[b] else b + 32 if 65 <= b < 91 else b for b in range(256))


def _split(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Test strings of one length class each: shift table and suffix buckets."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.codes: dict[bytes, int] = {}
        strings: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, found in items:
            row = [self.codes.setdefault(w, len(self.codes) + 1) for w in found]
            size = min(window, len(row))
            for k in range(len(row) - size + 1) if size else ():
                strings.setdefault(size, {}).setdefault(tuple(row[k : k + size]), set()).add(item)
        self.radix = len(self.codes) + 1
        self.classes = []
        for size, known in sorted(strings.items()):
            shift: dict[int, int] = {}
            buckets: dict[int, dict[tuple[int, ...], set[str]]] = {}
            for string, owners in known.items():
                blocks = [self.block(string, k) for k in range(min(1, size - 1), size)]
                for k, block in enumerate(blocks):
                    far = len(blocks) - 1 - k
                    shift[block] = min(far, shift.get(block, far))
                buckets.setdefault(blocks[-1], {})[string] = owners
            self.classes.append((size, shift, buckets))

    def block(self, string, end: int) -> int:
        return string[end - 1] * self.radix + string[end] if len(string) > 1 else string[end]

    def search(self, found: list[bytes], hits: bytearray, items: set[str]) -> None:
        """Mark the words inside occurrences in ``hits`` and add the owners to ``items``."""
        row = list(map(self.codes.get, found))
        n, radix = len(row), self.radix
        for size, shift, buckets in self.classes:
            i = size - 1
            marks = b"\x01" * size
            pair = size > 1
            longest = max(1, size - 1)
            get = shift.get
            while i < n:
                last = row[i]
                if last is None:
                    i += size
                    continue
                if pair:
                    before = row[i - 1]
                    if before is None:
                        i += longest
                        continue
                    last += before * radix
                step = get(last, longest)
                if step:
                    i += step
                    continue
                owners = buckets[last].get(tuple(row[i - size + 1 : i + 1]))
                if owners:
                    hits[i - size + 1 : i + 1] = marks
                    items |= owners
                i += 1


def _tables(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[WuManber]:
    rows = benchmark.select(F.col(name(item_col)).cast("string").alias("i"), F.col(name(text_col)).alias("t"))
    part, size = [], 0
    for row in rows.dropna().toLocalIterator():
        found = _split(row.t)
        if not found:
            continue
        part.append((row.i, found))
        size += len(found)
        if size >= MAX_TABLE_WORDS:
            yield WuManber(part, window)
            part, size = [], 0
    if part:
        yield WuManber(part, window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: float = 0.05,
) -> DataFrame:
    """Mark the words of documents that lie in benchmark windows.

    A window is ``window`` consecutive words of an item; a shorter item that has
    words is one window. Returns the input rows with ``n_words``, ``n_hit`` (long),
    ``items`` (array<string>: ids of items with an occurring window, sorted as
    strings) and ``contaminated`` (some hit, and at least ``share`` of the words);
    input columns of those names are replaced.

    * Null and wordless texts have no words and no hits.
    * Items without id, text or words take no part; rows of one item id are one
      item; an empty benchmark leaves every document clean.
    * Repeated documents are judged alike, one by one.

    There is no shuffle: a benchmark does not grow with the corpus. It is read
    through the driver in parts of MAX_TABLE_WORDS words, each broadcast on its
    own, and each table is one more pass over the same rows.
    """
    spark = docs.sparkSession
    out = docs
    tables = list(_tables(benchmark, item_col, item_text_col, window)) or [WuManber([], window)]
    for k, table in enumerate(tables):
        shared, first, last = spark.sparkContext.broadcast(table), k == 0, k == len(tables) - 1

        def make(shared=shared, first=first, last=last):
            find = shared.value.search

            def work(part: pa.RecordBatch) -> list[pa.Array]:
                column = part.column(text_col)
                n_words, n_hit, items, bits, bad = [], [], [], [], []
                for j in range(part.num_rows):
                    found = _split(column[j].as_py())
                    if first:
                        hits, owners = bytearray(len(found)), set()
                    else:
                        hits = bytearray(part.column("_pw_hits")[j].as_py())
                        owners = set(part.column("items")[j].as_py())
                    find(found, hits, owners)
                    n = hits.count(1)
                    n_words.append(len(found))
                    n_hit.append(n)
                    items.append(sorted(owners))
                    bits.append(None if last else bytes(hits))
                    bad.append(n > 0 and n >= share * len(found) - 1e-9)
                return [
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(bad, pa.bool_()),
                    pa.array(bits, pa.binary()),
                ]

            return work

        out = _keeping(out, text_col, first, make)
    return out.drop("_pw_hits")


def _keeping(df: DataFrame, text_col: str, first: bool, make) -> DataFrame:
    added = "n_words bigint, n_hit bigint, items array<string>, contaminated boolean, _pw_hits binary"
    if first:
        return append_columns(df, text_col, added, make)
    # the columns of the pass before are read and replaced
    renamed = df.withColumn("_pw_items", F.col("items")).withColumn("_pw_before", F.col("_pw_hits"))

    def again():
        work = make()

        def on(part):
            names = ["_pw_hits" if c == "_pw_before" else "items" if c == "_pw_items" else c for c in part.schema.names]
            return work(pa.RecordBatch.from_arrays(part.columns, names=names))

        return on

    return append_columns(renamed, text_col, added, again).drop("_pw_items", "_pw_before")
