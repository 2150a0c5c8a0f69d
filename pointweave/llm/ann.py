"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are quantised to int8 once; the product of a block of queries and a tile of
candidates gives every inner product with a bound of its error. Pairs that could
still be among the nearest are recomputed in double precision, and heaps merge the
results of all strips of candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm._frames import name

#: Rows on average of a block of queries, which a task holds (40 MB at 64 dimensions), and the least of
#: a strip of candidates, which it streams; rows of the tiles within.
BLOCK_ROWS, STRIP_ROWS = 65536, 16384
TILE_QUERIES, TILE_ROWS = 512, 4096
#: Tasks for each core that queries and strips are cut into.
TASKS_PER_CORE = 4
#: Survivors whose products are recomputed at once.
EXACT_ROWS = 65536


def _usable(vector: Column) -> Column:
    """Not null or zero, and every component finite."""
    largest = float(np.finfo(np.float64).max)
    finite = F.forall(vector, lambda x: F.coalesce((x >= -largest) & (x <= largest), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _vectors(table: pa.RecordBatch, column: str) -> np.ndarray:
    found = table.column(column)
    flat = found.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(found), -1)) if len(found) else np.zeros((0, 0))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the norm of its rounding error."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = top / 127.0
    scale[scale == 0] = 1.0  # a row of denormal numbers: all error, no code
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    # a slack for the rounding of these lines themselves
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) + 1e-12 * np.linalg.norm(x, axis=1)
    return codes, scale, error


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of components."""
    return np.cumsum(q * c, axis=1)[:, -1]


def tile_product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of all rows of two tiles of int8 codes, as exact whole numbers.

    The tiles are widened one at a time; whole numbers below 2**24, as the sums of up to
    1040 products are, are exact in single precision.
    """
    wide = np.float32 if q.shape[1] <= 1040 else np.float64
    return (q.astype(wide) @ c.astype(wide).T).astype(np.float64)


class Search:
    """A block of queries with the ``k`` nearest of the candidates seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scale, self.error = quantised(vectors)
        self.norm = np.linalg.norm(vectors, axis=1)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> None:
        """Look at more candidates. The k-th score so far, or a k-th lower bound of a tile, tells which of
        them can still be among the nearest."""
        norm = np.linalg.norm(vectors, axis=1)
        for at in range(0, len(ids), TILE_ROWS):
            tile = slice(at, at + TILE_ROWS)
            # rows of one id count once, so as many more may stand before the k-th other one
            most = self.k + len(ids[tile]) - len(np.unique(ids[tile]))
            for low in range(0, len(self.ids), TILE_QUERIES):
                part = slice(low, low + TILE_QUERIES)
                product = tile_product(self.codes[part], codes[tile])
                product *= self.scale[part, None] * scale[None, tile]
                bound = self.error[part, None] * norm[None, tile]
                bound += (self.norm[part] + self.error[part])[:, None] * error[None, tile]
                product[self.ids[part, None] == ids[None, tile]] = -np.inf
                least = self.score[part, -1]
                if product.shape[1] > most:
                    lower = product - bound
                    kth = np.partition(lower, lower.shape[1] - most, axis=1)[:, lower.shape[1] - most]
                    least = np.maximum(least, kth)
                product += bound
                a, b = np.nonzero((product >= least[:, None]) & (product > -np.inf))
                a, b = a + low, b + at
                exact = [
                    _exact(self.vectors[a[s : s + EXACT_ROWS]], vectors[b[s : s + EXACT_ROWS]])
                    for s in range(0, len(a), EXACT_ROWS)
                ]
                if exact:
                    self._keep(a, ids[b], np.concatenate(exact))

    def _keep(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge new results of some queries with what these have; ties go to the smaller id."""
        touched = np.unique(query)
        old_q, old_rank = np.nonzero(self.score[touched] > -np.inf)
        query = np.concatenate([touched[old_q], query])
        ids = np.concatenate([self.found[touched[old_q], old_rank], ids])
        score = np.concatenate([self.score[touched[old_q], old_rank], score])
        order = np.lexsort((-score, ids, query))  # the best row of each id
        query, ids, score = query[order], ids[order], score[order]
        first = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))
        query, ids, score = query[first], ids[first], score[first]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        self.score[query[best], rank[best]] = score[best]
        self.found[query[best], rank[best]] = ids[best]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all found."""
        q, rank = np.nonzero(self.score > -np.inf)
        return self.ids[q], self.found[q, rank], self.score[q, rank]


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of every query row by inner product in double precision.

    ``query`` says which rows are queries (default: every row whose id is
    divisible by 20); each searches all other rows. Returns ``query_id``, ``rank``
    (int, from 1), ``vec_id`` and ``score`` (double); ties go to the smaller id.
    The result is exact: a pair is dropped only if the bound proves it is none.

    * Null, zero and non-finite vectors, and rows without an id, take no part.
    * Vectors of different lengths are not comparable and never meet.
    * Rows of one id are one item, whose best score counts; it is not its own
      neighbour. With fewer than ``k`` candidates all are returned.

    Queries are cut into random blocks (by a hash of the id), candidates into strips, as few
    as keep all cores busy. A task holds a block of queries and streams a strip past it,
    with a running k-th score. Candidates are copied once for each block of queries, and
    ``k`` rows of each query and strip are shuffled to the merge, which holds one heap.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = vectors.select(F.col(name(id_col)).cast("long").alias("id"), F.col(name(vector_col)).alias("v"), (
        (F.col(name(id_col)) % 20 == 0) if query is None else query
    ).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asks")).first()
    blocks = max(1, -(-size["asks"] // block_rows))
    tasks = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    strips = max(1, min(-(-size["all"] // min(block_rows, STRIP_ROWS)), -(-tasks // blocks)))

    coded = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("codes binary, scale double, error double").fields])

    def encode(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes, scale, error = [b""] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, scale[at], error[at] = quantised(_vectors(batch.take(pa.array(at)), "v"))
                for j, spot in enumerate(at.tolist()):
                    codes[spot] = own[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], names=coded.names
            )

    rows = rows.mapInArrow(encode, coded)
    spot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = ["id", "v", "codes", "scale", "error"]
    left = rows.filter("asks").select("dim", spot(blocks).alias("block"), every(strips).alias("strip"), F.lit(0).alias("side"), *kept)
    right = rows.select("dim", every(blocks).alias("block"), spot(strips).alias("strip"), F.lit(1).alias("side"), *kept)
    keys = ["dim", "block", "strip"]
    found = T.StructType.fromDDL("query_id bigint, vec_id bigint, score double")

    def table(search: Search):
        q, i, s = search.results()
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=found.names)

    def search(batches):
        here, asked, current = None, [], None  # the group, its queries so far, their search
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in [*keys, "side"]], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part, key = batch.slice(low, high - low), tuple(group[low, :3])
                if key != here:
                    if current is not None:
                        yield table(current)
                    here, asked, current = key, [], None
                if group[low, 3] == 0:
                    asked.append((part.column("id").to_numpy(), _vectors(part, "v")))
                    continue
                if current is None and asked:
                    current = Search(np.concatenate([a for a, _ in asked]), np.concatenate([v for _, v in asked]), k)
                    asked = []
                if current is not None:
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int8)
                    current.add(
                        part.column("id").to_numpy(),
                        _vectors(part, "v"),
                        codes.reshape(part.num_rows, -1),
                        part.column("scale").to_numpy(),
                        part.column("error").to_numpy(),
                    )
        if current is not None:
            yield table(current)

    parts = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(search, found)
    ranked = T.StructType.fromDDL("query_id bigint, rank int, vec_id bigint, score double")

    def merge(batches):
        # of each query a heap of its k best, the worst on top; rows come by query
        query, heap, out = None, [], []

        def put(i, s):
            same = next((t for t, x in enumerate(heap) if -x[1] == i), None)
            if same is not None:
                if s > heap[same][0]:
                    heap[same] = (s, -i)
                    heapq.heapify(heap)
            elif len(heap) < k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))

        def flush():
            for rank, (score, minus) in enumerate(sorted(heap, reverse=True), 1):
                out.append((query, rank, -minus, score))
            heap.clear()

        def batch_of():
            q, r, i, s = zip(*out, strict=True) if out else ((), (), (), ())
            out.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            columns = [pa.array(x, kind) for x, kind in zip((q, r, i, s), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=ranked.names)

        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    flush()
                    query = q
                put(i, s)
            yield batch_of()
        flush()
        yield batch_of()

    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, ranked)
