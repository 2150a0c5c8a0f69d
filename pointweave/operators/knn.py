"""K nearest neighbours: clouds are cut into tiles, and each tile is searched by a tree of its own.

Tiles halve the points again and again (a k-d tree on a sample of them), so that they hold
about as many points each however the cloud is clustered. A query looks in its own tile
first. It is final when no other tile is closer than its k-th neighbour; the others look
into the tiles that are. The sample places the cuts only: every point lies in a tile.
Small clouds are broadcast to all queries instead.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.functions.geometry import AXES, difference
from pointweave.sources.shared import written

#: Points up to this number (some 100 bytes each) are broadcast to all queries.
BROADCAST_POINTS = 4096
#: Points of a tile; queries of a task (those of a tile beyond it are dealt to several).
TILE_POINTS, TASK_QUERIES = 32_768, 131_072
#: Sampled points a tile, and in all, from which the cuts between tiles are taken.
SAMPLE, SAMPLE_MOST = 64, 500_000
#: Points of one place in a batch that make it worth keeping only its first k.
CROWDED = 64
#: Points of a leaf (2 k at least) and queries of a block in a tile's tree; leaves to which a block's queries go one by one.
LEAF, BLOCK, MANY = 16, 16, 48
#: Distances computed at once.
AT_ONCE = 1 << 20
#: Tiles are dealt over so many partitions at most.
PARTITIONS = 4096


def _separation(dim: int, box) -> list[str]:
    return [difference(f"q{a}", f"n{a}", box[k] if box else None) for k, a in enumerate(AXES[:dim])]


def _finite(prefix: str, axes) -> str:
    return " AND ".join(f"coalesce(abs(CAST({prefix}{a} AS DOUBLE)) < double('Infinity'), false)" for a in axes)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rows = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "nid")))
    return rows.filter(F.col("rank") <= k).withColumn("dist", F.sqrt("d2"))


def nearest(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    boxsize: tuple[float, ...] | None = None,
    carry: list[str] | None = None,
    broadcast_points: int | None = None,
) -> DataFrame:
    """Edges (qid, nid, rank, dist, dx, dy, dz) of each query's ``k`` nearest points.

    ``points`` has id and coordinates, ``queries`` qid and coordinates. Distances
    are Euclidean, on a torus if ``boxsize`` is given; d = query - point. Equal
    distances go to the smaller id. ``carry`` names point columns that come along
    as ``n_<name>``, so that no later join is needed. A point that is also a query
    finds itself. More neighbours than points raise IndexError. Clouds of up to
    ``broadcast_points`` (BROADCAST_POINTS) points are compared with every query.
    In larger ones points without finite coordinates are nobody's neighbours, and
    a query without them has the k smallest ids, at a distance that is null.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError(f"k must be a positive integer, not {k!r}")
    carry = carry or []
    axes = AXES[:dim]
    there = {a: F.expr(f"CASE WHEN {_finite('', axes)} THEN {a} END") for a in axes}
    sides = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(x).alias(f"lo{a}") for a, x in there.items()],
        *[F.max(x).alias(f"hi{a}") for a, x in there.items()],
    ).first()
    if k > sides["n"]:
        raise IndexError(f"{k} neighbours asked of {sides['n']} points")
    own = points.select(
        F.col("id").alias("nid"), *[F.col(a).cast("double").alias(f"n{a}") for a in axes], *[F.col(c).alias(f"n_{c}") for c in carry]
    )
    asked = queries.select("qid", *[F.col(a).cast("double").alias(f"q{a}") for a in axes])
    out = ["qid", "nid", "rank", "dist", *[f"d{a}" for a in axes], *[f"n_{c}" for c in carry]]
    if sides["n"] <= (BROADCAST_POINTS if broadcast_points is None else broadcast_points):
        every = asked.withColumn("_one", F.lit(0)).join(F.broadcast(own.withColumn("_one", F.lit(0))), "_one").drop("_one")
        every = every.withColumns({f"d{a}": F.expr(text) for a, text in zip(axes, _separation(dim, boxsize), strict=True)})
        return _ranked(every.withColumn("d2", F.expr(" + ".join(f"d{a} * d{a}" for a in axes))), k).select(*out)
    lost = asked.filter(f"NOT ({_finite('q', axes)})")
    placed = own.filter(_finite("n", axes)), asked.filter(_finite("q", axes))
    found = None if sides[f"lo{axes[0]}"] is None else _tiled(*placed, k, dim, boxsize, sides).select(*out)
    if found is None or not lost.isEmpty():
        least = own.orderBy("nid").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("nid")))
        least = lost.crossJoin(F.broadcast(least)).withColumns({c: F.lit(None).cast("double") for c in ("dist", *[f"d{a}" for a in axes])})
        found = least.select(*out) if found is None else found.unionByName(least.select(*out))
    return found


# -- geometry in numpy: the formulas of functions.geometry, rounded alike ---------


def _inside(x: np.ndarray, box) -> np.ndarray:
    """Coordinates in the box, for bounds only."""
    return x if box is None else x - np.array(box) * np.floor(x / np.array(box))


def _apart(a: np.ndarray, b: np.ndarray, length: float | None) -> np.ndarray:
    if length is None:
        return a - b
    t = a - b + length / 2
    return t - length * np.floor(t / length) - length / 2


def _gap2(low, high, other_low, other_high, box) -> np.ndarray:
    """Squared distance of boxes (rows), never too large; axes are the last dimension."""
    gap = np.maximum(0.0, np.maximum(other_low - high, low - other_high))
    if box is not None:
        length = np.array(box)
        for shift in (-length, length):
            gap = np.minimum(gap, np.maximum(0.0, np.maximum(other_low + shift - high, low - other_high - shift)))
        gap = np.maximum(0.0, gap - 1e-15 * length)
    return (gap * gap).sum(axis=-1)


_WIDER = 1 + 1e-9  # more than what rounding takes from a distance


class _Tiles:
    """A complete binary tree of cuts: inner node i has the children 2 i and 2 i + 1, from 1 on; tiles are its last level."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int):
        dim = len(low)
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
        self.low, self.high = np.full((2 << depth, dim), np.inf), np.full((2 << depth, dim), -np.inf)
        self.low[1], self.high[1] = low, high
        parts = {1: sample}
        for i in range(1, 1 << depth):
            x = parts.pop(i, sample[:0])
            self.low[2 * i], self.high[2 * i] = self.low[i], self.high[i]  # all of it, unless it is cut
            if not len(x) or (x.min(axis=0) == x.max(axis=0)).all():
                parts[2 * i] = x
                continue
            a = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            cut = np.partition(x[:, a], len(x) // 2)[len(x) // 2]
            if cut == x[:, a].min():
                cut = x[:, a][x[:, a] > cut].min()
            self.axis[i], self.cut[i] = a, cut
            self.low[2 * i + 1], self.high[2 * i + 1] = self.low[i], self.high[i]
            self.high[2 * i, a] = self.low[2 * i + 1, a] = cut
            parts[2 * i], parts[2 * i + 1] = x[x[:, a] < cut], x[x[:, a] >= cut]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def within(self, x: np.ndarray, d2: np.ndarray, box) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of ``x`` and a tile that is no farther from it than the root of ``d2``."""
        row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), (2 * node[:, None] + np.arange(2)).ravel()
            keep = _gap2(x[row], x[row], self.low[node], self.high[node], box) <= d2[row] * _WIDER
            row, node = row[keep], node[keep]
        return row, node - (1 << self.depth)


def _halved(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``x`` in groups of one length, ``size`` to twice that, cut at medians; in place of row i some groups have n + i again."""
    n = len(x)
    depth = max(0, math.floor(math.log2(max(1, n / size))))
    each = -(-n // (1 << depth))
    order = np.arange(each << depth)[None]
    for _ in range(depth):
        c = x[order % n]
        axis = np.argmax(c.max(axis=1) - c.min(axis=1), axis=1)
        key = np.take_along_axis(c, axis[:, None, None], axis=2)[:, :, 0]
        half = order.shape[1] // 2
        order = np.take_along_axis(order, np.argpartition(key, half, axis=1), axis=1).reshape(-1, half)
    return order


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of place, stable; the number of each one's place; the first row of each place in that order."""
    order = np.lexsort(x.T)
    y = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (y[1:] != y[:-1]).any(axis=1)
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _first_of_places(x: np.ndarray, k: int) -> np.ndarray:
    """Rows, ascending, that are among the first k of their place."""
    order, place, first = _places(x)
    return np.sort(order[np.arange(len(x)) - first[place] < k])


def _search(p: np.ndarray, q: np.ndarray, k: int, box, most: np.ndarray, sift=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2) of each query's k nearest points no farther than the root of ``most``; ties to the smaller row.

    ``sift`` gets rows of queries with bounds of their k-th d2 and says which are wanted; blocks without any are left out.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(p) or not len(q):
        return none, none, np.zeros(0)
    m, dim = p.shape
    leaves = _halved(_inside(p, box), max(LEAF, 2 * k))
    each = leaves.shape[1]
    there = p[leaves % m]
    spare = np.where(leaves >= m, np.inf, 0.0)
    bounds = _inside(there, box)
    lows, highs = [bounds.min(axis=1)], [bounds.max(axis=1)]
    while len(lows[0]) > 1:
        lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
        highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
    found: list[tuple] = []

    def distances(asked: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of blocks of queries (g, b) from the points of their leaves (g, l): (g, b, l * each)."""
        g = len(leaf)
        d2 = np.zeros(())
        for a in range(dim):
            d = _apart(q[asked, a][:, :, None], there[leaf, :, a].reshape(g, 1, -1), box[a] if box else None)
            d2 = d * d if a == 0 else d2 + d * d
        return d2 + spare[leaf].reshape(g, 1, -1)

    def look(blocks: np.ndarray, limit: np.ndarray | None) -> None:
        """Blocks of queries; those beyond the last are repeated ones."""
        asked = blocks % len(q)
        around = _inside(q[asked], box)
        low, high = around.min(axis=1), around.max(axis=1)
        if limit is None:
            middle, node = (low + high) / 2, np.zeros(len(asked), dtype=np.int64)
            for lo, hi in zip(lows[1:], highs[1:], strict=True):
                left, right = (_gap2(middle, middle, lo[2 * node + i], hi[2 * node + i], box) for i in (0, 1))
                node = 2 * node + (right < left)
            limit = most[asked]
            step = max(1, AT_ONCE // (asked.shape[1] * each))
            if each >= k:
                for at in range(0, len(asked), step):
                    d2 = distances(asked[at : at + step], node[at : at + step, None])
                    limit[at : at + step] = np.minimum(limit[at : at + step], np.partition(d2, k - 1, axis=2)[:, :, k - 1])
            if sift is not None:
                keep = sift(asked.ravel(), limit.ravel()).reshape(asked.shape).any(axis=1)
                blocks, asked, limit, low, high = blocks[keep], asked[keep], limit[keep], low[keep], high[keep]
        top = limit.max(axis=1) * _WIDER
        block, node = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        for lo, hi in zip(lows[1:], highs[1:], strict=True):
            block, node = np.repeat(block, 2), (2 * node[:, None] + np.arange(2)).ravel()
            keep = _gap2(low[block], high[block], lo[node], hi[node], box) <= top[block]
            block, node = block[keep], node[keep]
        count = np.bincount(block, minlength=len(asked))
        start = np.cumsum(count) - count
        if asked.shape[1] > 1 and (count > MANY).any():
            wide = count > MANY
            look(blocks[wide].reshape(-1, 1), limit[wide].reshape(-1, 1))
            count[wide] = 0
        for n in np.unique(count[count > 0]):
            rows = np.flatnonzero(count == n)
            step = max(1, AT_ONCE // (asked.shape[1] * each * int(n)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                leaf = node[start[some][:, None] + np.arange(n)]
                d2 = distances(asked[some], leaf)
                kth = min(k, d2.shape[2]) - 1
                enough = np.minimum(np.partition(d2, kth, axis=2)[:, :, kth], most[asked[some]])
                real = (blocks[some] < len(q))[:, :, None]
                g, b, c = np.nonzero((d2 <= enough[:, :, None]) & (d2 < np.inf) & real)
                found.append((asked[some][g, b], leaves[leaf].reshape(len(some), -1)[g, c], d2[g, b, c]))

    look(_halved(_inside(q, box), BLOCK), None)
    if not found:
        return none, none, np.zeros(0)
    query, point, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((point, d2, query))
    query, point, d2 = query[order], point[order], d2[order]
    count = np.bincount(query, minlength=len(q))
    keep = np.arange(len(query)) - (np.cumsum(count) - count)[query] < k
    return query[keep], point[keep], d2[keep]


# -- tables -------------------------------------------------------------------


def _matrix(table, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(table.column(c).to_numpy(), dtype=np.float64) for c in names], axis=1)


def _assigned(df: DataFrame, prefix: str, tiles: _Tiles, axes, box, k: int | None) -> DataFrame:
    """``df`` with its tile; of a place that crowds a batch only the k rows with the smallest ids, if k is given."""
    import pyarrow as pa

    names, crowded = [f"{prefix}{a}" for a in axes], CROWDED
    first = df.columns[0]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = _matrix(table, names)
            if k is not None and len(x):
                _, place, _ = _places(x)
                if np.bincount(place).max() > max(crowded, k):
                    table = table.sort_by(first)
                    table = table.take(_first_of_places(_matrix(table, names), k))
                    x = _matrix(table, names)
            tile = pa.array(tiles.of(_inside(x, box)).astype(np.int32))
            yield from table.append_column("tile", tile).to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("tile", T.IntegerType())]))


def _tiled(own: DataFrame, asked: DataFrame, k: int, dim: int, box, sides) -> DataFrame:
    import pyarrow as pa

    axes = AXES[:dim]
    at, to = [f"n{a}" for a in axes], [f"q{a}" for a in axes]
    n = sides["n"]
    depth = max(0, math.ceil(math.log2(n / TILE_POINTS)))
    sample = own.select(*at)
    if depth:
        sample = _inside(_matrix(sample.sample(min(1.0, min(SAMPLE << depth, SAMPLE_MOST) / n), seed=1).toArrow(), at), box)
        sample = np.unique(sample, axis=0)  # places, so that copies do not draw the cuts
    else:
        sample = np.zeros((0, dim))
    low = np.array([0.0 if box else float(sides[f"lo{a}"]) for a in axes])
    high = np.array([float(box[j]) if box else float(sides[f"hi{a}"]) for j, a in enumerate(axes)])
    tiles = _Tiles(sample, low, high, depth)

    homes = written(_assigned(own, "n", tiles, axes, box, k))
    placed = written(_assigned(asked.withColumn("salt", F.expr("pmod(xxhash64(qid), 1048576)").cast("int")), "q", tiles, axes, box, None))
    crowds = placed.groupBy("tile").count().filter(F.col("count") > TASK_QUERIES).collect()  # a row a tile at most
    parts = np.ones(1 << depth, dtype=np.int32)
    for r in crowds:
        parts[r["tile"]] = -(-r["count"] // TASK_QUERIES)
    many = F.lit(1)
    if crowds:
        of = F.create_map(*[F.lit(int(x)) for r in crowds for x in (r["tile"], parts[r["tile"]])])
        many = F.coalesce(F.try_element_at(of, F.col("tile")), F.lit(1))
        homes = homes.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    else:
        homes = homes.withColumn("part", F.lit(0))
    placed = placed.withColumn("part", F.pmod(F.col("salt"), many).cast("int"))

    partitions = min(PARTITIONS, int(parts.sum()))
    key = ["tile", "part"]
    home = homes.repartition(partitions, *key).groupBy(*key)
    result = [f for f in homes.schema.fields if f.name not in (*at, *key)]  # nid and what comes along
    edge = [asked.schema["qid"], *result, T.StructField("rank", T.IntegerType())]
    edge += [T.StructField(c, T.DoubleType()) for c in ("d2", *[f"d{a}" for a in axes])]
    wanted = [T.StructField("tile", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("most", T.DoubleType())]
    wanted += [T.StructField("salt", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in to]]
    of_point = [f.name for f in result]

    def answer(points, queries, mode: str):
        """Edges of queries that no other tile can better (final), of the others with the tiles they look into (open), or within ``most`` (asked)."""
        points = points.sort_by("nid")
        p = _matrix(points, at)
        first = _first_of_places(p, k)
        p = p[first]
        x = _matrix(queries, to)
        order, number, new = _places(x)
        place = np.empty(len(x), dtype=np.int64)
        place[order] = number
        u = x[order[new]]  # queries of one place have one answer
        most = np.full(len(u), np.inf)
        if mode == "asked":
            most[place] = queries.column("most").to_numpy()
        here = queries.column("tile")[0].as_py() if len(x) else -1
        sure = np.zeros(len(u), dtype=bool)

        def open_ones(rows, bound):
            row, tile = tiles.within(_inside(u[rows], box), bound, box)
            sure[rows] = np.bincount(row[tile != here], minlength=len(rows)) == 0
            return ~sure[rows]

        query, point, d2 = _search(p, u, k, box, most, open_ones if mode == "open" else None)
        count = np.bincount(query, minlength=len(u))
        start = np.cumsum(count) - count
        chosen = np.arange(len(x))
        if mode != "asked":
            reach = np.full(len(u), np.inf)
            full = count == k
            reach[full] = d2[start[full] + k - 1]
            reach[sure] = -1.0
            row, tile = tiles.within(_inside(u, box), reach, box)
            row, tile = row[tile != here], tile[tile != here]
            beyond = np.bincount(row, minlength=len(u)) > 0
            chosen = np.flatnonzero(beyond[place] == (mode == "open"))
        each = count[place[chosen]]
        rank = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        line = np.repeat(start[place[chosen]], each) + rank
        who = np.repeat(chosen, each)
        columns = {"qid": queries.column("qid").take(who)}
        taken = points.select(of_point).take(first[point[line]])
        columns |= {c: taken.column(c) for c in of_point}
        columns |= {"rank": pa.array((rank + 1).astype(np.int32)), "d2": pa.array(d2[line])}
        for j, a in enumerate(axes):
            columns[f"d{a}"] = pa.array(_apart(x[who, j], p[point[line], j], box[j] if box else None))
        edges = pa.table(columns)
        if mode != "open":
            return edges
        count = np.bincount(row, minlength=len(u))
        start = np.cumsum(count) - count
        each = count[place[chosen]]
        line = np.repeat(start[place[chosen]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        who = np.repeat(chosen, each)
        salt = queries.column("salt").to_numpy()[who]
        asks = {"qid": queries.column("qid").take(who), "tile": pa.array(tile[line].astype(np.int32))}
        asks |= {"part": pa.array((salt % parts[tile[line]]).astype(np.int32)), "most": pa.array(reach[place[who]] * _WIDER)}
        asks |= {"salt": pa.array(salt.astype(np.int32))} | {c: pa.array(x[who, j]) for j, c in enumerate(to)}
        names = [*edges.column_names, *[f.name for f in wanted]]
        kinds = {f.name: f.type for f in [*edges.schema, *pa.table(asks).schema]}
        both = [pa.table({c: t[c] if c in t else pa.nulls(size, kinds[c]) for c in names}) for t, size in ((columns, len(edges)), (asks, len(who)))]
        return pa.concat_tables(both)

    def run(mode: str):
        return lambda points, queries: answer(points, queries, mode)

    group = placed.repartition(partitions, *key).groupBy(*key)
    final = home.cogroup(group).applyInArrow(run("final"), T.StructType(edge))
    out = final.withColumn("dist", F.sqrt("d2"))
    if depth:
        opened = written(home.cogroup(group).applyInArrow(run("open"), T.StructType([*edge, *wanted])))
        asks = opened.filter("tile IS NOT NULL").select("qid", *[f.name for f in wanted])
        group = asks.repartition(partitions, *key).groupBy(*key)
        more = home.cogroup(group).applyInArrow(run("asked"), T.StructType(edge))
        near = opened.filter("tile IS NULL").select(*[f.name for f in edge]).unionByName(more)
        out = out.unionByName(_ranked(near, k))
    return out
