"""Line dedup: lines that many documents share go from all of them.

The lines of each document are normalised and hashed, the distinct documents of
each hash are counted, and the remaining lines are joined again by position.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import append_columns, join_counted, materialize, name
from pointweave.llm._text import steps

#: What a key loses at both ends: ``[\x20\x09-\x0D]``.
_ENDS = b" \t\n\x0b\x0c\r"
#: Frequent keys up to this number (16 bytes each) are broadcast; more are joined.
MAX_BROADCAST_KEYS = 1_000_000


def key_digests(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a UTF-8 text, and the 128-bit hash of each one's key.

    A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased;
    one of fewer than ``min_chars`` code points has no hash. Lines and keys are cut
    and lowered as bytes, which leaves all characters beyond ASCII as they are.
    """
    lines = (text or b"").split(b"\n")
    digest = xxhash.xxh3_128_digest
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(_ENDS).lower()
        long = len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars)
        out.append(digest(key) if long else None)
    return lines, out


def _bytes_of(part: pa.RecordBatch, column: str) -> list[bytes | None]:
    return part.column(column).cast(pa.binary()).to_pylist()


def _text_digest(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(text or b"")


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, of, high, low): the distinct keys of each row; ``of`` is the hash of its whole text."""
    base = docs.select(F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"))
    schema = T.StructType([base.schema["id"]] + T.StructType.fromDDL("of binary, high bigint, low bigint").fields)

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                rows, of, found = [], [], []
                for k, text in enumerate(_bytes_of(part, "text")):
                    own = dict.fromkeys(d for d in key_digests(text, min_chars)[1] if d)
                    rows += [k] * len(own)
                    of += [_text_digest(text)] * len(own)
                    found += own
                ids = part.column("id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.binary()), *_halves(found)], names=schema.names)

    return base.mapInArrow(run, schema)


def _reassembled(lines: list[bytes], gone: list[bool]) -> tuple[bytes, int, int]:
    kept = [line for line, out in zip(lines, gone, strict=True) if not out]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


#: What both ways of dropping add.
_ADDED = "_pw_kept string, n_lines bigint, n_dropped bigint"


def _columns(rows: list[tuple[bytes, int, int]]) -> list[pa.Array]:
    texts, n, dropped = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]


def _drop_broadcast(docs: DataFrame, frequent: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Lines are judged where the text is read: their hashes are looked up in a sorted broadcast array."""
    table = frequent.select("high", "low").toArrow()
    known = np.empty(table.num_rows, "<i8,<i8")
    for field, column in zip(("f0", "f1"), ("high", "low"), strict=True):
        known[field] = table.column(column).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(known.view("S16")))

    def make():
        keys = shared.value

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = [key_digests(text, min_chars) for text in _bytes_of(part, text_col)]
            flat = np.array([d or b"" for _, digests in found for d in digests], "S16")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                hit = (keys[at] == flat).tolist()
            else:
                hit = [False] * len(flat)
            rows, low = [], 0
            for lines, digests in found:
                own = [h and d is not None for h, d in zip(hit[low : low + len(lines)], digests, strict=True)]
                low += len(lines)
                rows.append(_reassembled(lines, own))
            return _columns(rows)

        return work

    return append_columns(docs, text_col, _ADDED, make)


def _drop_joined(docs: DataFrame, keys: DataFrame, frequent: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Each distinct text's frequent hashes are gathered by the text's hash and joined to its rows.

    A group holds at most the lines of one text; a text with many rows is met by a
    broadcast of bounded size (``join_counted``).
    """
    # rows of one text have the same keys: one of them stands for all in the join
    once = keys.groupBy("of", "high", "low").agg(F.count(F.lit(1)).alias("_pw_rows"))
    met = join_counted(once, frequent, ["high", "low"], "_pw_n")
    gone = met.groupBy("of").agg(
        F.collect_list(F.struct("high", "low")).alias("_pw_gone"), F.max("_pw_rows").alias("_pw_rows")
    )
    gone = materialize(gone.withColumnRenamed("of", "_pw_of"))
    hashed = append_columns(
        docs,
        text_col,
        "_pw_of binary",
        lambda: lambda part: [pa.array(map(_text_digest, _bytes_of(part, text_col)), pa.binary())],
    )
    flagged = join_counted(hashed, gone, ["_pw_of"], "_pw_rows", "left").drop("_pw_of", "_pw_rows")

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text, gone in zip(_bytes_of(part, text_col), part.column("_pw_gone").to_pylist(), strict=True):
                lines, digests = key_digests(text, min_chars)
                out = {struct.pack("<qq", g["high"], g["low"]) for g in gone or ()}
                rows.append(_reassembled(lines, [d in out for d in digests]))
            return _columns(rows)

        return work

    return append_columns(flagged, text_col, _ADDED, make).drop("_pw_gone")


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    max_broadcast: int = MAX_BROADCAST_KEYS,
) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents.

    Returns each input row with ``text_col`` holding the remaining lines and
    with ``n_lines`` (before) and ``n_dropped`` (both long); input columns of
    those names are replaced.

    * A null or empty text is one empty line and comes back as the empty text.
    * Keys of fewer than ``min_chars`` code points are never dropped.
    * Rows that share an id count as one document, a null id being one too; each
      row comes back with its own lines judged.
    * A document that loses every line stays, with an empty text.

    Hashes of lines are written once and counted by two shuffles, of pairs and of
    partial counts, so a line in most documents is no hot key. Texts are not
    shuffled: up to ``max_broadcast`` frequent hashes are broadcast and lines are
    judged where they are read. Only beyond that do texts meet their dropped
    hashes by a join.
    """
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be at least 1")
    keys = materialize(_line_keys(docs, id_col, text_col, min_chars))
    # a struct counts a null id as a document too
    counts = keys.groupBy("high", "low").agg(F.count_distinct(F.struct("id")).alias("_pw_n"))
    frequent = materialize(counts.filter(F.col("_pw_n") >= min_docs))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(*[F.col(name(c)) for c in kept])
    if frequent.count() <= max_broadcast:
        out = _drop_broadcast(base, frequent, text_col, min_chars)
    else:
        out = _drop_joined(base, keys, frequent, text_col, min_chars)
    columns = [F.col("_pw_kept").alias(c) if c == text_col else F.col(name(c)) for c in kept]
    return out.select(*columns, "n_lines", "n_dropped")
