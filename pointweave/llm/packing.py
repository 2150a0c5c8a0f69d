"""Packing: first-fit decreasing over token counts, in randomised groups.

Documents become token ids, are cut where a sequence is full, and the pieces of
each randomised group are packed independently: longest first, each into the
first bin with room, found in a tournament tree of the bins' free capacities.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import materialize, name
from pointweave.llm._text import BLANK_BYTES, hashes, raw, steps

#: Pieces that one group holds on average: what one packing task keeps in memory.
GROUP_PIECES = 8192
#: Words whose ids a task remembers, and the bytes of their ids; beyond either, it starts
#: anew. With the dictionary's own entries (some 100 bytes each) a task holds 30 MB at most.
MAX_CACHED_WORDS, MAX_CACHED_BYTES = 200_000, 8 << 20

#: White space besides ASCII blanks, and separators that some engines count as such.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Fixed value: the pre-tokenizer of byte-level BPE files of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The byte for each character by which such a file writes bytes: itself if visible, else from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


#: ASCII letters, digits and other visible characters; 0 for the apostrophe and all else.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 0


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token ids by their bytes, if the file is a byte-level BPE whose ids follow its merges.

    Then a greedy merge of the pair with the smallest id is what the file asks for.
    None for any other file: other models, normalizers, pre-tokenizers or options.
    """
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    off = [spec.get("normalizer"), spec.get("truncation"), spec.get("padding")]
    off += [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
    off += [model.get("byte_fallback"), model.get("ignore_merges"), before.get("add_prefix_space")]
    if any(off) or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        return None
    if (spec.get("post_processor") or {"type": "ByteLevel"}).get("type") != "ByteLevel":
        return None
    signs, added = byte_signs(), {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = {token: rank for token, rank in model["vocab"].items() if token not in added}
    if not set(signs) <= vocab.keys() or any(not set(token) <= signs.keys() for token in vocab):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab.get("".join(pair), -1) for pair in pairs]
    if order != sorted(set(order)) or (order and order[0] < 0) or len(order) + len(signs) != len(vocab):
        return None
    return {bytes(map(signs.__getitem__, token)): rank for token, rank in vocab.items()}


class Tokens:
    """Token ids of texts as the library ``tokenizers`` gives them for a file, without special tokens added.

    For a byte-level BPE (``plain_ranks``) texts are cut into chunks: such a
    tokenizer cuts a text before each run of blanks' last character and, unless
    that is a space, after it, and between ASCII letters, digits and other signs; no
    token crosses such a border. So each distinct chunk is encoded once and
    remembered. Texts with other white space are encoded whole. Texts that hold the
    string of an added token, and all texts for other files, go through the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self._library = path, None
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or () if t["content"]]
        ranks = plain_ranks(spec)
        self.model = None
        if ranks is not None:
            import tiktoken

            self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def by_library(self, texts: list[str]) -> list[list[int]]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return [e.ids for e in self._library.encode_batch(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.model.encode_ordinary, texts))

    def _learn(self, keys: list[int], chunks: list[bytes]) -> None:
        if not keys:
            return
        found = self.encode([c.decode() for c in chunks])
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.place.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.at = np.append(self.at, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their n + 1 offsets."""
        if self.model is None:
            return _joined(self.by_library([t.as_py() or "" for t in texts]))
        data, at = raw(texts)
        n = len(at) - 1
        blank = BLANK_BYTES[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        first = first[:-1] if len(data) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(data) else first
        before = np.append(True, ~blank[:-1])[: len(data)]  # the byte before is no blank
        after = np.append(~blank[1:], True)[: len(data)]
        tail = blank & after & ~last  # the last blank before a word
        cut = first | (blank & before) | tail
        cut[1:] |= tail[:-1] & (data[:-1] != 0x20)
        kind = _KIND[data]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, where, inverse = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.place) > MAX_CACHED_WORDS or self.flat.nbytes > MAX_CACHED_BYTES:
            self.clear()
        keys = keys.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.place]
        self._learn(
            [keys[k] for k in new], [data[starts[where[k]] : ends[where[k]]].tobytes() for k in new]
        )
        slot = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[inverse.reshape(-1)]
        size, origin = self.size[slot], self.at[slot]
        sums = np.append(0, np.cumsum(size))
        flat = self.flat[np.repeat(origin - sums[:-1], size) + np.arange(sums[-1])]
        bounds = sums[np.searchsorted(starts, at)]
        odd = np.unique(np.searchsorted(at, np.flatnonzero(_SUSPECT[data]), "right") - 1).tolist()
        odd = [k for k in odd if _OTHER_SPACE.search(texts[k].as_py() or "")]
        special = self._with_added(data, at) if self.added else []
        if odd or special:
            parts = [flat[bounds[k] : bounds[k + 1]] for k in range(n)]
            for chosen, encode in ((odd, self.encode), (special, self.by_library)):
                for k, ids in zip(chosen, encode([texts[k].as_py() for k in chosen]), strict=True):
                    parts[k] = np.asarray(ids, np.uint32)
            return _joined(parts)
        return flat, bounds

    def _with_added(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """The texts that hold an added token's string."""
        found, source = set(), data.tobytes()
        for content in self.added:
            spot = source.find(content)
            while spot >= 0:
                k = int(np.searchsorted(at, spot, "right")) - 1
                found.add(k)
                spot = source.find(content, max(spot + 1, int(at[k + 1])))
        return sorted(found)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after another, and their offsets."""
    arrays = [np.asarray(p, np.uint32) for p in parts]
    flat = np.concatenate([*arrays, np.zeros(0, np.uint32)])
    return flat, np.append(0, np.cumsum([len(p) for p in arrays], dtype=np.int64)).astype(np.int64)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    digest: bool = False,
) -> DataFrame:
    """Token ids of each document and a final ``end_id``, cut after every ``capacity`` ids.

    Returns per piece the id, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary: little-endian unsigned 32-bit) and
    ``doc_tokens``; with ``digest``, ``ids_crc32`` (long) in place of ``ids``. A
    null text is empty and gives the ``end_id`` alone.
    """
    base = docs.select(F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"))
    kept = "ids_crc32 bigint" if digest else "ids binary"
    schema = T.StructType(
        [base.schema["id"]] + T.StructType.fromDDL(f"start bigint, length bigint, {kept}, doc_tokens bigint").fields
    )

    def run(batches):
        tokens = Tokens(tokenizer)
        for batch in batches:
            for part in steps(batch, "text"):
                flat, at = tokens.ids(part.column("text"))
                rows, start, size, ids, total = [], [], [], [], []
                for k in range(part.num_rows):
                    own = np.append(flat[at[k] : at[k + 1]], end_id).astype("<u4")
                    for low in range(0, len(own), capacity):
                        rows.append(k)
                        start.append(low)
                        piece = own[low : low + capacity].tobytes()
                        size.append(len(piece) // 4)
                        ids.append(zlib.crc32(piece) if digest else piece)
                        total.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(ids, pa.int64() if digest else pa.binary()),
                        pa.array(total, pa.int64()),
                    ],
                    names=schema.names,
                )

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length; bins open in order from 0.

    The tree is a tournament over bins: each inner node holds the larger free
    capacity of its two halves, so the first bin with room is one walk down.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[k])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Put pieces (column ``length``, 1 to ``capacity``) into sequences.

    Returns the rows with ``sequence_id`` (long, unique over all groups) and
    ``offset`` (long, gapless from 0); input columns of those names are replaced.
    ``pieces`` must be stable when read again (materialized). Every piece goes to
    a random one of count / ``group_pieces`` groups, so no group is larger than
    the others whatever the documents' ids or lengths. An empty table stays empty.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    base = pieces.select(*[F.col(name(c)) for c in keep]).withColumn(
        "_pw_group", F.floor(F.rand(seed) * groups).cast("long")
    )
    schema = T.StructType(
        base.drop("_pw_group").schema.fields + T.StructType.fromDDL("sequence_id bigint, offset bigint").fields
    )

    def pack(group: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        label = group.column("_pw_group")[0].as_py() << 32
        return (
            group.drop_columns(["_pw_group"])
            .append_column("sequence_id", pa.array(bins + label, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    return base.groupBy("_pw_group").applyInArrow(pack, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    group_pieces: int = GROUP_PIECES,
    digest: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack: the rows of ``token_pieces`` with their sequences.

    With ``digest`` the column ``ids_crc32`` (long) stands in place of ``ids``, so
    that ids are neither stored nor shuffled. Repeated rows are packed each.
    """
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, digest)
    return pack_pieces(materialize(pieces), capacity, group_pieces)
