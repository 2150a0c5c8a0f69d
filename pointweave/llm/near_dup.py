"""Near-duplicate documents by a MinHash LSH forest.

Each document has several signature orders ("trees"). Sorted by such an order,
documents that share a prefix lie together: a document's neighbours are those of
its longest common prefixes, so dense regions are met at a deep prefix and sparse
ones at a shallow one. What neighbours do not settle is settled by comparing the
components that still share a region. Links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import forget, join_counted, materialize, name
from pointweave.llm._text import BLANK_BYTES, shingles, steps, words
from pointweave.llm.components import connected_components, merged_components

#: Trees, and minhashes that order each. A pair at similarity 0.75 misses the two
#: leading minhashes of all twelve trees with probability (1 - 0.75**2)**12 = 5e-5.
TREES, DEPTH, LEAST_DEPTH = 12, 6, 2
#: Preceding neighbours in a tree that a node is compared with in the first pass, and how many of these
#: it may propose. Both only order the work: the last pass proposes every pair that is left.
NEIGHBOURS, BEST = 16, 4
#: Minhashes in all; the low four bits of each make the sketch that estimates similarity.
#: Its deviation is 0.027 at 0.75, so what is confirmed starts four deviations below.
MINHASHES, LEAST_ESTIMATE = 288, 0.645
#: Nodes of a region that one task compares (300 bytes each); larger ones are cut into pairs of blocks.
BLOCK = 2048
#: Groups of at most so many rows are compared side by side, larger ones in tiles of so many pairs.
SMALL, TILE_PAIRS = 32, 1 << 20
#: Rows that a comparing task gathers before it hands groups on, and candidates it hands on at once.
STEP_ROWS, OUT_ROWS = 20_000, 200_000
#: Documents and shingles of one side of a block of pairs to confirm.
CONFIRM_NODES, CONFIRM_SHINGLES = 512, 1 << 21
#: Rows of a few numbers that are broadcast (16 bytes each); more are shuffled.
MAX_BROADCAST_ROWS = 250_000

_RANDOM = np.random.default_rng(20240229)
_MASKS = _RANDOM.integers(0, 1 << 32, MINHASHES, np.uint64).astype(np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, MINHASHES, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(found: np.ndarray) -> np.ndarray:
    """The minima of the hash functions over one set of 64-bit shingles."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINHASHES, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 1024):
        part = x[low : low + 1024, None] ^ _MASKS
        part *= _ODD
        np.minimum(best, part.min(axis=0), out=best)
    return best


def sketch_of(minima: np.ndarray) -> np.ndarray:
    low = (minima & np.uint32(15)).astype(np.uint8)
    return low[0::2] << 4 | low[1::2]


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities estimated from sketches as rows of 64-bit words, which may be broadcast
    against each other; unequal minima agree in four bits once in 16 times."""
    unlike: np.ndarray | int = 0
    for k in range(MINHASHES // 16):
        x = a[..., k] ^ b[..., k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)  # the lowest bit of each half byte says whether it differs
        x &= np.uint64(0x1111111111111111)
        unlike = unlike + np.bitwise_count(x).astype(np.uint16)
    return (1 - unlike / np.float32(MINHASHES) - 1 / 16) * (16 / 15)


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    base = docs.select(F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"))
    schema = T.StructType(
        [base.schema["id"]]
        + T.StructType.fromDDL("n_shingles bigint, digest binary, mins binary, sketch binary").fields
    )

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                w, at = words(part.column("text"), BLANK_BYTES)
                count, digest, mins, sketch = [], [], [], []
                for k in range(part.num_rows):
                    found = shingles(w[at[k] : at[k + 1]], size)
                    best = minhashes(found)
                    count.append(len(found))
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    mins.append(best[: TREES * DEPTH].astype(">u4").tobytes())
                    sketch.append(sketch_of(best).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(count, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(mins, pa.binary()),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=schema.names,
                )

    return base.mapInArrow(run, schema)


def _spanning(labels: list, a: np.ndarray, b: np.ndarray, like: np.ndarray, holds=None) -> np.ndarray:
    """Of edges between the labels at ``a`` and ``b`` those, best first, that join two groups and for
    which ``holds(a, b)``, asked only of these."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    order = np.argsort(-like, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    for k in order:
        x, y = find(labels[a[k]]), find(labels[b[k]])
        if x != y and (holds is None or holds(a[k], b[k])):
            root[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _alike(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two ascending sets have at least the share in common."""
    percent = round(share * 100)
    least, most = min(len(x), len(y)), max(len(x), len(y))
    if not least or 100 * least < percent * most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (least + most - both)


def _columns(batch: pa.RecordBatch, column: str, kind: str, width: int) -> np.ndarray:
    """A column of binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, width)


def _region(tree: Column) -> Column:
    """A tree's region: all nodes with its LEAST_DEPTH leading minhashes, as a hash."""
    return F.xxhash64(tree, F.substring(F.col("mins"), tree * (4 * DEPTH) + 1, F.lit(4 * LEAST_DEPTH)))


def _semi(rows: DataFrame, keys: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``rows`` whose key is in the materialized ``keys``, with the columns of these."""
    if keys.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key)
    return join_counted(rows, keys, [key], count) if count else rows.join(keys, key)


def _held(nodes: DataFrame) -> DataFrame:
    """The nodes that share a region with another, with ``trees``, those where they do."""
    rows = nodes.select("node", "mins", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("node", "tree", _region(F.col("tree")).alias("region"))
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(shared)
    met = _semi(rows, shared, "region", "n")
    trees = materialize(met.groupBy("node").agg(F.collect_set("tree").alias("trees")))
    out = materialize(_semi(nodes, trees, "node"))
    forget(shared)
    forget(trees)
    return out


def _neighbours(held: DataFrame) -> DataFrame:
    """Candidates (a, b, estimate) of the first pass: in each tree's order a node meets the
    neighbours before it, whose common prefixes with it are its longest, down to LEAST_DEPTH.

    Rows are dealt by ranges of the order itself, so a region of any size is spread over
    tasks and a task holds a window. Of a region's candidates only those are proposed
    that join two groups of it, best estimate first.
    """
    rows = held.select("node", "mins", "sketch", F.explode("trees").alias("tree"))
    width = 4 * DEPTH
    rows = rows.select(
        "tree", F.substring("mins", F.col("tree") * F.lit(width) + 1, F.lit(width)).alias("key"), "node", "sketch"
    )
    order = ["tree", "key", "node"]
    kind = held.schema["node"].dataType
    schema = T.StructType([T.StructField(c, kind) for c in "ab"] + [T.StructField("estimate", T.FloatType())])

    def run(batches):
        before: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            both = pa.concat_tables([before, now]) if before is not None else now
            both = both.combine_chunks().to_batches()[0]
            held_back = both.num_rows - batch.num_rows
            tree = both.column("tree").to_numpy(zero_copy_only=False)
            keys, words_ = _columns(both, "key", ">u4", DEPTH), _columns(both, "sketch", "<u8", MINHASHES // 16)
            n, found = both.num_rows, []
            for o in range(1, min(NEIGHBOURS, n - 1) + 1):
                prefix = np.logical_and.accumulate(keys[o:] == keys[:-o], axis=1).sum(axis=1)
                prefix[tree[o:] != tree[:-o]] = 0
                prefix[: max(0, held_back - o)] = 0  # these met in the batch before
                at = np.flatnonzero(prefix >= LEAST_DEPTH)
                like = estimates(words_[at], words_[at + o])
                good = like >= LEAST_ESTIMATE
                found.append((at[good], at[good] + o, like[good]))
            if found:
                i, j, like = (np.concatenate(x) for x in zip(*found, strict=True))
                i, j, like = _best(i, j, like)
                kept = _spanning(list(range(n)), i, j, like)
                ids = both.column("node")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i[kept])), ids.take(pa.array(j[kept])), pa.array(like[kept], pa.float32())],
                    names=schema.names,
                )
            before = pa.Table.from_batches([both.slice(max(0, n - NEIGHBOURS))])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _best(i: np.ndarray, j: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The BEST of each ``j``."""
    order = np.lexsort((i, -like, j))
    i, j, like = i[order], j[order], like[order]
    first = np.searchsorted(j, j)
    kept = np.arange(len(j)) - first < BEST
    return i[kept], j[kept], like[kept]


def _in_blocks(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """``rows`` with ``cell`` and ``side``: what meets in one task.

    A region of at most BLOCK nodes is one cell. A larger one is cut into pairs of blocks;
    its largest component has blocks of its own, which meet those of all others but not
    each other. A row is in as many cells as its block has partners. Rows of a cell are
    compared if a side is 0 (the one block that meets itself) or their sides differ.
    """
    plain = rows.filter(F.col("n") <= BLOCK).withColumn("cell", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    if regions.filter(F.col("n") > BLOCK).isEmpty():
        return plain
    large = rows.filter(F.col("n") > BLOCK)
    inner = large.groupBy("region", "component").count()
    parts = inner.groupBy("region").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"),
        F.max("count").alias("n_main"),
        (F.sum("count") - F.max("count")).alias("n_rest"),
    )
    parts = materialize(parts)  # at most a row for each BLOCK of the input's
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    own = F.when(F.col("component") == F.col("main"), -1 - part("n_main")).otherwise(part("n_rest"))
    first = F.when(F.col("own") < 0, F.lit(0)).otherwise(-blocks("n_main"))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    cut = (
        large.join(F.broadcast(parts), "region")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(first, blocks("n_rest") - 1)))
        .withColumn("cell", low * (1 << 31) + high)
        .withColumn("side", F.when(low == high, 0).otherwise(F.when(F.col("own") == low, 1).otherwise(2)))
    )
    return plain.unionByName(cut.select(*plain.columns))


def _met(start: np.ndarray, component: np.ndarray, side: np.ndarray, sketch: np.ndarray):
    """(i, j, estimate) of the like rows of different components in each group of rows that begins at ``start``."""
    n, found = len(component), []
    ends = np.append(start[1:], n)
    end_of = np.repeat(ends, ends - start)
    small = np.repeat(ends - start <= SMALL, ends - start)

    def keep(i, j):
        unlike = (component[i] != component[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[unlike], j[unlike]
        like = estimates(sketch[i], sketch[j])
        good = like >= LEAST_ESTIMATE
        found.append((i[good], j[good], like[good]))

    for o in range(1, SMALL):
        at = np.flatnonzero(small[: n - o] & (np.arange(n - o) + o < end_of[: n - o]))
        if not len(at):
            break
        keep(at, at + o)
    for low, high in zip(start.tolist(), ends.tolist(), strict=True):
        if high - low <= SMALL:
            continue
        tile = max(1, TILE_PAIRS // (high - low))
        for at in range(low, high, tile):
            own = np.arange(at, min(at + tile, high))
            rest = np.arange(at, high)
            like = estimates(sketch[own][:, None, :], sketch[rest][None, :, :])
            i, j = np.nonzero(like >= LEAST_ESTIMATE)
            score = like[i, j]
            i, j = i + at, j + at
            good = (i < j) & (component[i] != component[j]) & ((side[i] == 0) | (side[i] != side[j]))
            found.append((i[good], j[good], score[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _open_rows(held: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the regions that hold several components: region, cell, side, node, component and ``columns``."""
    placed = held.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    spread = placed.withColumn("tree", F.explode("trees")).withColumn("region", _region(F.col("tree")))
    ends = spread.groupBy("region").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
    )
    regions = materialize(ends.filter("low <> high").select("region", "n"))
    every = F.array(*[_region(F.lit(t)) for t in range(TREES)]).alias("regions")
    rows = spread.select("region", "node", "component", *[every if c == "regions" else F.col(c) for c in columns])
    return _in_blocks(_semi(rows, regions, "region", "n"), regions)


def _grouped(rows: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work`` gives batches for a batch of whole (region, cell) groups and the groups' first rows."""
    order = ["region", "cell"]

    def whole(tables: list[pa.Table]):
        batch = pa.concat_tables(tables).combine_chunks().to_batches()[0]
        region, cell = (batch.column(c).to_numpy() for c in order)
        return work(batch, np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (cell[1:] != cell[:-1]))))

    def run(batches):
        held_back: list[pa.Table] = []  # whole groups, and the rows of the last one so far
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held_back.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < STEP_ROWS:
                continue
            table = pa.concat_tables(held_back)
            region, cell = (table.column(c).to_numpy() for c in order)
            before = np.flatnonzero((region != region[-1]) | (cell != cell[-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            if last:
                yield from whole([table.slice(0, last)])
            held_back, size = [table.slice(last)], table.num_rows - last
        if size:
            yield from whole(held_back)

    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _group_of(start: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))


def _across(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (a, b, estimate) of the second pass: all rows of a region meet, and of the like pairs
    of different components those are proposed that join two of them, best estimate first."""
    kind = held.schema["node"].dataType
    schema = T.StructType([T.StructField(c, kind) for c in "ab"] + [T.StructField("estimate", T.FloatType())])

    def work(batch: pa.RecordBatch, start: np.ndarray):
        codes = batch.column("component").dictionary_encode().indices.to_numpy()
        sketch = _columns(batch, "sketch", "<u8", MINHASHES // 16)
        i, j, like = _met(start, codes, batch.column("side").to_numpy(), sketch)
        if len(i):
            labels = list(zip(_group_of(start, batch.num_rows).tolist(), codes.tolist(), strict=True))
            kept = _spanning(labels, i, j, like)
            ids = batch.column("node")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i[kept])), ids.take(pa.array(j[kept])), pa.array(like[kept], pa.float32())],
                names=schema.names,
            )

    return _grouped(_open_rows(held, roots, ["sketch"]), work, schema)


def _first_met(regions: np.ndarray, region: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs meet in no earlier tree than in that of their own region."""
    out = np.empty(len(i), bool)
    for low in range(0, len(i), OUT_ROWS):
        part = slice(low, low + OUT_ROWS)
        a, b = regions[i[part]], regions[j[part]]
        first = np.argmax(a == b, axis=1)
        out[part] = a[np.arange(len(a)), first] == region[i[part]]
    return out


def _settled(held: DataFrame, roots: DataFrame, texts: DataFrame, size: int, share: float) -> DataFrame:
    """Links of the last pass: every like pair of different components that shares a region is confirmed.

    Pairs are not handed on. Where rows of a region meet, each row that has a partner is
    put into blocks of at most CONFIRM_NODES rows of the region, and goes, with its text, to the
    pairs of blocks in which it has one: as many copies as the region has blocks, at most.
    There pairs are found once more and confirmed, best estimate first, until all that
    are not linked through others have been looked at. A pair that shares several regions
    is taken in the one of the first tree.
    """
    columns = ["n_shingles", "sketch", "regions"]
    rows = _open_rows(held, roots, columns)
    kept = ["region", "cell", "side", "node", "component", *columns]
    schema = T.StructType(
        [rows.schema[c] for c in kept] + T.StructType.fromDDL("low int, high int, block int").fields
    )

    def regions_of(batch):
        return batch.column("regions").flatten().to_numpy().reshape(batch.num_rows, TREES)

    def spread(batch: pa.RecordBatch, start: np.ndarray):
        codes = batch.column("component").dictionary_encode().indices.to_numpy()
        sketch = _columns(batch, "sketch", "<u8", MINHASHES // 16)
        i, j, _ = _met(start, codes, batch.column("side").to_numpy(), sketch)
        first = _first_met(regions_of(batch), batch.column("region").to_numpy(), i, j)
        i, j = i[first], j[first]
        if not len(i):
            return
        group = _group_of(start, batch.num_rows)
        used = np.unique(np.concatenate([i, j]))
        begins = np.flatnonzero(np.append(True, group[used][1:] != group[used][:-1]))
        runs = np.diff(np.append(begins, len(used)))
        rank = np.arange(len(used)) - np.repeat(begins, runs)
        weight = np.cumsum(batch.column("n_shingles").to_numpy()[used])
        weight -= np.repeat(weight[begins], runs)
        block = np.zeros(batch.num_rows, np.int64)
        block[used] = np.maximum(rank // CONFIRM_NODES, weight // CONFIRM_SHINGLES)
        low, high = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
        goes = np.unique(np.concatenate([np.stack([low, high, k], 1) for k in (i, j)]), axis=0)
        at = pa.array(goes[:, 2])
        extra = [goes[:, 0], goes[:, 1], block[goes[:, 2]]]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(at) for c in kept], *[pa.array(x.astype(np.int32)) for x in extra]], names=schema.names
        )

    kind = held.schema["node"].dataType
    links = T.StructType([T.StructField(c, kind) for c in "ab"])
    placed = materialize(_grouped(rows, spread, schema))
    if placed.isEmpty():
        return held.sparkSession.createDataFrame([], links)
    ids = materialize(placed.select(F.col("node").alias("id")).distinct())
    few = ids.count() <= MAX_BROADCAST_ROWS
    own = texts.join(F.broadcast(ids) if few else ids, "id").join(placed.withColumnRenamed("node", "id"), "id")

    def confirm(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets = []
        for part in steps(batch, "text"):
            w, at = words(part.column("text"), BLANK_BYTES)
            sets += [shingles(w[at[k] : at[k + 1]], size) for k in range(part.num_rows)]
        codes = batch.column("component").dictionary_encode().indices.to_numpy()
        side, block = batch.column("side").to_numpy(), batch.column("block").to_numpy()
        apart = batch.column("low")[0].as_py() != batch.column("high")[0].as_py()
        sketch = _columns(batch, "sketch", "<u8", MINHASHES // 16)
        i, j, like = _met(np.zeros(1, np.int64), codes, side, sketch)
        good = _first_met(regions_of(batch), batch.column("region").to_numpy(), i, j)
        if apart:
            good &= block[i] != block[j]
        i, j, like = i[good], j[good], like[good]
        labels = codes.tolist()
        found = _spanning(labels, i, j, like, lambda a, b: _alike(sets[a], sets[b], share))
        ids = batch.column("id")
        return pa.table({"a": ids.take(pa.array(i[found])), "b": ids.take(pa.array(j[found]))})

    out = materialize(own.groupBy("region", "cell", "low", "high").applyInArrow(confirm, links))
    forget(placed)
    forget(ids)
    return out


def _distinct(found: DataFrame) -> DataFrame:
    ends = found.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "estimate"
    )
    return materialize(ends.groupBy("a", "b").agg(F.max("estimate").alias("estimate")))


def _confirmed(pairs: DataFrame, held: DataFrame, texts: DataFrame, size: int, share: float) -> DataFrame:
    """Links of the groups that ``pairs`` join: full shingle sets with at least the asked share in common.

    Documents are hashed into blocks and pairs go to pairs of blocks, where each text comes
    once, however many pairs it has. Best estimates come first; a pair whose ends are
    already linked there, through others, is not looked at.
    """
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    size_of = held.agg(F.count(F.lit(1)), F.avg("n_shingles")).first()
    most = min(2 * n, size_of[0])  # documents that pairs can have
    blocks = max(1, -(-most // CONFIRM_NODES), math.ceil(most * size_of[1] / CONFIRM_SHINGLES))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    low, high = F.least(spot("a"), spot("b")), F.greatest(spot("a"), spot("b"))
    keyed = pairs.withColumn("block", low * blocks + high)
    ends = keyed.select("block", F.col("a").alias("id")).union(keyed.select("block", "b")).distinct()
    ends = materialize(ends)
    few = ends.count() <= MAX_BROADCAST_ROWS
    own = texts.join(F.broadcast(ends) if few else ends, "id").select("block", "id", "text")

    def confirm(some: pa.Table, own: pa.Table) -> pa.Table:
        found: dict = {}
        for batch in own.combine_chunks().to_batches():
            for part in steps(batch, "text"):
                w, at = words(part.column("text"), BLANK_BYTES)
                for k, node in enumerate(part.column("id").to_pylist()):
                    found.setdefault(node, []).append(shingles(w[at[k] : at[k + 1]], size))
        # by node, each with the sets of its texts
        names = {node: k for k, node in enumerate(found)}
        sets = list(found.values())
        a, b = (np.array([names.get(x, -1) for x in some.column(c).to_pylist()], np.int64) for c in "ab")
        there = np.flatnonzero((a >= 0) & (b >= 0))
        holds = lambda x, y: any(_alike(s, t, share) for s in sets[x] for t in sets[y])
        like = some.column("estimate").to_numpy()[there]
        kept = there[_spanning(list(range(len(sets))), a[there], b[there], like, holds)]
        return some.select(["a", "b"]).take(pa.array(kept))

    schema = pairs.select("a", "b").schema
    links = materialize(keyed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(confirm, schema))
    forget(ends)
    return links


def _texts_of_ids(signed: DataFrame, whole: Column, nodes: DataFrame) -> tuple[bool, DataFrame | None]:
    """Whether ids repeat, and the links between the different texts of one id (None without any)."""
    by = signed.filter(whole).groupBy("id")
    by = by.agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    repeats, differ = by.agg(F.max("n") > 1, F.max(F.col("low") != F.col("high"))).first()
    if not differ:
        return bool(repeats), None
    several = by.filter(F.col("low") != F.col("high")).select("id")
    members = signed.filter(whole).join(several, "id").select("id", "digest").distinct()
    members = members.join(nodes.select("digest", "node"), "digest")
    first = members.groupBy("id").agg(F.min("node").alias("a"))
    links = members.join(first, "id").select("a", F.col("node").alias("b")).filter("a <> b")
    return True, materialize(links.distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: float = 0.75
) -> DataFrame:
    """The near-duplicate component of every document.

    A document's set holds its distinct shingles of ``size`` words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a shorter text is one shingle. Two
    documents are linked when their sets' common share is at least ``share``.
    Returns per input row the id, ``n_shingles`` (long), ``component_id`` (the
    smallest id reachable by links) and ``kept`` (it is its own component's id).

    * A null or wordless text has an empty set and is linked with nothing.
    * A null id is linked with nothing: its component is null and it is kept.
    * Rows of one id are one document: linked if any of their texts are.
    * Documents with equal sets are one node from the start, so copies, however
      many, cost no pairs; other columns are not read.

    Three passes compare sketches and confirm pairs by full sets: neighbours in each
    tree's order; the best pairs between components that share a region; and then
    every like pair of different components that share a region, so that none is
    left untried. What can be missed is a pair that shares no region in any tree or
    whose estimate lies four deviations low. No group is collected: trees are streamed
    in sorted order, large regions are compared by pairs of blocks.
    """
    signed = materialize(_signatures(docs, id_col, text_col, size))
    whole = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    nodes = materialize(
        signed.filter(whole)
        .groupBy("digest")
        .agg(
            F.min("id").alias("node"),
            F.count(F.lit(1)).alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("mins").alias("mins"),
            F.first("sketch").alias("sketch"),
        )
    )
    texts = docs.select(F.col(name(id_col)).alias("id"), F.col(name(text_col)).alias("text"))
    repeats, links = _texts_of_ids(signed, whole, nodes)
    if repeats:
        texts = texts.distinct()
    held = _held(nodes.drop("digest", "n"))
    pairs = _distinct(_neighbours(held))
    fresh = _confirmed(pairs, held, texts, size, share)
    roots = connected_components(fresh if links is None else links.union(fresh))
    forget(pairs)
    pairs = _distinct(_across(held, roots))
    roots = merged_components(roots, _confirmed(pairs, held, texts, size, share))
    forget(pairs)
    roots = merged_components(roots, _settled(held, roots, texts, size, share))
    known = materialize(
        nodes.join(roots, "node", "left").select("digest", "n", F.coalesce("root", "node").alias("component_id"))
    )
    for old in (held, roots, nodes):
        forget(old)  # ``known`` has been written
    placed = join_counted(signed.filter(whole).select("id", "n_shingles", "digest"), known, ["digest"], "n")
    alone = signed.filter(~F.coalesce(whole, F.lit(False)))
    out = placed.select("id", "n_shingles", "component_id").unionByName(
        alone.select("id", "n_shingles", F.col("id").alias("component_id"))
    )
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
