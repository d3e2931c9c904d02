"""Nearest-neighbour joins: exact in blocks, these scored and ranked by SQL, and approximate by cells.

The exact kernel keeps one side in bounded broadcast blocks and streams the other through Arrow batches:
matrix products in small tiles find who can be among the k best, and these few are ranked by the score
computed in element order, ties by the smaller id. A pass over the streamed side keeps k rows a query, so
passes add up without a shuffle of vectors; the last ranking shuffles ids and scores only. A block is
broadcast in small parts, which a task reads one after the other and does not keep: it holds a part, a tile
and a batch, whatever the sizes of both sides, and no more for a full block than for a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as vx
from vecloom.session import local_table, materialize, read_once

#: Whether a larger value is nearer.
METRICS = {"l2": False, "dot": True, "cosine": True, "exp_neg_dot": False}
#: Bytes of vectors in one block, which is one job.
BLOCK_BYTES = 32 << 20
#: Bytes of vectors of a block that a task holds at once: one broadcast.
PART_BYTES = 4 << 20
#: Bytes of vectors in one row on the way to a block.
PACK_BYTES = 4 << 20
#: Queries and rows of a block in one matrix product, and pairs that are scored at once.
CHUNK = 512
TILE = 4096
PAIRS = 1 << 15
#: Queries that meet a part each time that it is read.
QUERIES = 8 * CHUNK


def scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All scores of two row blocks, by a matrix product; l2 comes squared. Good to a few ulps only."""
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
    return -(q @ x.T) if metric == "exp_neg_dot" else q @ x.T


def exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of one query and some rows, each summed alone, so that equal vectors have equal scores."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    s = (x * q).sum(axis=1)
    return np.exp(-s) if metric == "exp_neg_dot" else s


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n == 0, 1.0, n)[:, None]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(rows, -1)


def _read(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v) with doubles; rows without a vector take no part."""
    return vectors.select(F.col(key).cast("long").alias("id"), vx.doubles(vec).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")


def _blocks(index: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index in pieces of at most ``rows`` vectors, one held at a time; rows travel packed as bytes."""

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = np.asarray(b.column(0)), _matrix(b.column(1), b.num_rows)
            step = max(1, PACK_BYTES // (8 * x.shape[1]))
            for at in range(0, len(ids), step):
                yield pa.RecordBatch.from_arrays([pa.array([c[at : at + step].tobytes()], pa.binary()) for c in (ids, x)], ["ids", "x"])

    ids, vecs, held = [], [], 0
    for r in index.mapInArrow(pack, "ids binary, x binary").toLocalIterator(prefetchPartitions=False):
        new = np.frombuffer(bytes(r["ids"]), np.int64)
        ids.append(new)
        vecs.append(np.frombuffer(bytes(r["x"]), float).reshape(len(new), -1))
        held += len(new)
        if held >= rows:
            i, x = np.concatenate(ids), np.concatenate(vecs)
            full = held - held % rows
            for at in range(0, full, rows):
                yield i[at : at + rows], x[at : at + rows]
            ids, vecs, held = [i[full:]], [x[full:]], held - full
    if held:
        yield np.concatenate(ids), np.concatenate(vecs)


def _copies(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many rows of smaller id (of equal ids, earlier ones) have the very same vector."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (bits * np.random.default_rng(1).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) ^ (bits >> np.uint64(29))).sum(axis=1)
    order = np.lexsort((ids, h))
    new = np.ones(len(ids), bool)
    new[1:] = (bits[order[1:]] != bits[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(new)
    out = np.empty(len(ids), int)
    out[order] = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return out


def _mean(x: np.ndarray) -> np.ndarray:
    """Of the rows that are finite."""
    whole = np.isfinite(x).all(axis=1)
    return x[whole].mean(axis=0) if whole.any() else np.zeros(x.shape[1])


class _Near:
    """Pairs of a chunk of queries and a block that can be near enough, from matrix products in small tiles.

    Values are smaller for nearer rows: -q.x, or for l2 (|x|^2 / 2 - q.x), of rows around the block's mean. They are
    taken in single precision with a bound of its error, and anew in double precision where that bound lets
    too much through. ``sign`` -1 looks for the furthest.
    """

    def __init__(self, metric: str, x: np.ndarray, sign: int = 1, mean: np.ndarray | None = None):
        """``mean`` stands for the rows' own, so that values of several parts compare."""
        self.metric, self.x, self.sign, self.d = metric, x, sign, x.shape[1]
        whole = np.isfinite(x).all(axis=1)
        self.mean = _mean(x) if mean is None else mean
        with np.errstate(over="ignore", invalid="ignore"):
            self.centred = (x - self.mean).astype(np.float32)
            n2 = ((x - self.mean) ** 2).sum(axis=1)
            self.half = n2 / 2
            self.reach, self.norm = float(np.sqrt(n2[whole].max(initial=0.0))), float(np.sqrt((x[whole] ** 2).sum(axis=1).max(initial=0.0)))

    def chunk(self, q: np.ndarray) -> None:
        """Take these queries."""
        self.q = q - self.mean if self.metric == "l2" else q
        n, full = np.sqrt((self.q**2).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        with np.errstate(over="ignore", invalid="ignore"):
            scale = (n + self.reach) * self.reach if self.metric == "l2" else n * self.reach
            self.e64 = 1e-9 * ((full + self.norm) ** 2 if self.metric == "l2" else full * self.norm) + (1e-14 if self.metric == "exp_neg_dot" else 0.0)
            if self.metric == "l2":  # of centred rows, so that a common offset widens nothing
                self.e64 = 1e-9 * (n + self.reach) ** 2
            self.e32 = (self.d + 8) * 2.0**-23 * scale + self.d * 1e-44 + self.e64
            self.single = bool((scale[np.isfinite(scale)] < 1e30).all()) and self.reach < 1e18
            self.q32 = self.q.astype(np.float32)

    def _tile(self, rows, at: slice, single: bool) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            if single:
                v = self.q32[rows] @ self.centred[at].T
                half = self.half[at].astype(np.float32)
            else:
                v = self.q[rows] @ (self.x[at] - self.mean).T
                half = self.half[at]
            if self.metric == "l2":
                np.subtract(half, v, out=v)
            else:
                np.negative(v, out=v)
            return np.negative(v, out=v) if self.sign < 0 else v

    def under(self, rows, at: slice, bound: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) whose value may be at most ``bound``, one a query; with ``k``, the bounds are lowered first to the tile's k-th best."""
        n, width = len(bound), at.stop - at.start
        found = None
        for single in (True, False) if self.single else (False,):
            e = (self.e32 if single else self.e64)[rows]
            v = self._tile(rows, at, single)
            limit = bound + e
            open_ = ~(v > (limit.astype(np.float32) + np.abs(limit).astype(np.float32) * np.float32(2.0**-22) if single else limit)[:, None])
            if k is not None and width > k and np.count_nonzero(open_) > 4 * k * n:
                kth = np.partition(v, k - 1, axis=1)[:, k - 1].astype(float)
                np.copyto(bound, np.minimum(bound, kth + e), where=~np.isnan(kth))
                limit = bound + e
                open_ = ~(v > (limit.astype(np.float32) + np.abs(limit).astype(np.float32) * np.float32(2.0**-22) if single else limit)[:, None])
            found = open_
            if not single or np.count_nonzero(open_) <= 16 * (k or width) * n:
                break
        i, j = np.divmod(np.flatnonzero(found.ravel()), width)
        return i, j + at.start


def _scored(metric: str, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, as ``exact`` gives them."""
    return np.concatenate([np.empty(0)] + [exact(metric, q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])


def _first_k(i: np.ndarray, s: np.ndarray, k: int, down: bool, other: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k best pairs of each query i; the self first among equals, then smaller ids; NaN above all numbers."""
    key = np.where(np.isnan(s), -np.inf if down else np.inf, -s if down else s)
    order = np.lexsort((ids, other, key, i))
    starts = np.flatnonzero(np.diff(i[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _rows_out(i: list, qid: np.ndarray, n: list, s: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid[np.concatenate(i)], pa.int64()), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(s), pa.float64())], ["q", "n", "score"])


class _Best:
    """The k best so far of a chunk of queries: positions of queries, ids of neighbours, scores."""

    def __init__(self, metric: str, k: int, sign: int, include_self: bool, q: np.ndarray, qid: np.ndarray, asks: np.ndarray | None):
        self.metric, self.k, self.include_self, self.q, self.qid, self.asks = metric, k, include_self, q, qid, asks
        self.down = METRICS[metric] != (sign < 0)
        self.bound = np.full(len(q), np.inf)
        self.kept = np.empty(0, int), np.empty(0, int), np.empty(0)

    def _settle(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        i, n, s = (np.concatenate(c) for c in zip(self.kept, (i, ids[j], _scored(self.metric, self.q, x, i, j)), strict=True))
        best = _first_k(i, s, self.k, self.down, n != self.qid[i], n)
        self.kept = i[best], n[best], s[best]

    def meet(self, near: _Near, tiles: list[slice], ids: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        """All rows of a part, or with ``asks`` those in the cells that a query asks for."""
        near.chunk(self.q)
        new, waiting = [], 0
        for tile in tiles:
            rows = slice(None) if self.asks is None else np.flatnonzero(self.asks[:, cells[tile.start]])
            held = self.bound[rows].copy()
            # Without the self, whose row may be among the tile's k best, one more is needed.
            i, j = near.under(rows, tile, held, self.k if self.include_self else self.k + 1)
            self.bound[rows] = held
            i = i if self.asks is None else rows[i]
            if not self.include_self:
                i, j = i[ids[j] != self.qid[i]], j[ids[j] != self.qid[i]]
            new.append((i, j))
            waiting += len(i)
            if waiting > PAIRS or tile is tiles[-1]:
                self._settle(*(np.concatenate(c) for c in zip(*new, strict=True)), ids, x)
                new, waiting = [], 0

    def own(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        """Spare copies, by id, each for the query of its own id."""
        if not self.include_self or not len(ids):
            return
        lo = np.searchsorted(ids, self.qid)
        count = np.searchsorted(ids, self.qid, "right") - lo
        i = np.repeat(np.arange(len(self.q)), count)
        row = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + lo[i]
        if self.asks is not None:
            i, row = i[self.asks[i, cells[row]]], row[self.asks[i, cells[row]]]
        self._settle(i, row, ids, x)


def _best_rows(metric: str, k: int, sign: int, include_self: bool, block: tuple, centres: tuple | None, batches) -> Iterator[pa.RecordBatch]:
    """``_best_in_parts`` of a block in one part."""
    yield from _best_in_parts(metric, k, sign, include_self, [block], _mean(block[1]), centres, lambda part: part, batches)


def _best_in_parts(metric: str, k: int, sign: int, include_self: bool, parts: list, mean: np.ndarray, centres: tuple | None, read: Callable, batches) -> Iterator[pa.RecordBatch]:
    """q, n, score: the k best of a block for each query of the batches. With centres, only in the cells a query asks for.

    ``read`` gives a part: (ids, vectors, cells, and these three of spare copies): of equal vectors k + 1 are
    enough, and a spare one counts only for the query of its own id. One part is held at a time.
    """
    for b in batches:
        for at in range(0, b.num_rows, QUERIES):
            some = b.slice(at, QUERIES)
            every, every_id = _matrix(some.column(1), some.num_rows), np.asarray(some.column(0))
            if metric == "cosine":
                every = _unit(every)
            chunks = []
            for c in range(0, len(every), CHUNK):
                q, qid, asks = every[c : c + CHUNK], every_id[c : c + CHUNK], None
                if centres is not None:
                    asks = np.zeros((len(q), len(centres[0])), bool)
                    np.put_along_axis(asks, np.argsort(scores("l2", q, centres[0]), axis=1, kind="stable")[:, : centres[1]], True, axis=1)
                chunks.append(_Best(metric, k, sign, include_self, q, qid, asks))
            for part in parts:
                ids, x, cells, *spare = read(part)
                near = _Near(metric, x, sign, mean)
                edges = [0, len(ids)] if centres is None or not len(ids) else [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(ids)]
                tiles = [slice(t, min(t + TILE, z)) for a, z in zip(edges, edges[1:], strict=False) for t in range(a, z, TILE)]
                for best in chunks:
                    best.meet(near, tiles, ids, x, cells)
                    best.own(*spare)
                del ids, x, cells, spare, near  # before the next is read
            for best in chunks:
                i, n, s = best.kept
                yield _rows_out([i], best.qid, [n], [s])


def _part_rows(x: np.ndarray) -> int:
    return max(1, PART_BYTES // (8 * x.shape[1]))


def _searched(side: DataFrame, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, metric: str, sign: int, include_self: bool, centres: np.ndarray | None = None, beam: int = 0) -> DataFrame | None:
    """The k best of each block for each query, ranked together; None without blocks."""
    spark, found = side.sparkSession, []
    for ids, x in blocks:
        if len(found) == 1:
            side = materialize(side, "queries")  # read again for each block
        if metric == "cosine":
            x = _unit(x)
        cells = np.zeros(len(ids), np.int32) if centres is None else scores("l2", x, centres).argmin(axis=1).astype(np.int32)
        spare = _copies(ids, x) > k
        order, rest = np.flatnonzero(~spare), np.flatnonzero(spare)
        order, rest = order[np.argsort(cells[order], kind="stable")], rest[np.argsort(ids[rest], kind="stable")]
        step = _part_rows(x)
        parts = [spark.sparkContext.broadcast((ids[o], x[o], cells[o], ids[r], x[r], cells[r])) for o, r in ((order[a : a + step], rest[a : a + step]) for a in range(0, max(len(order), len(rest)), step))]

        def work(batches, parts=parts, mean=_mean(x)):
            yield from _best_in_parts(metric, k, sign, include_self, parts, mean, None if centres is None else (centres, beam), read_once, batches)

        found.append(materialize(side.mapInArrow(work, "q long, n long, score double"), "knn"))
        for held in parts:
            held.destroy()
    if not found:
        return None
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return top_k(out, k, METRICS[metric] != (sign < 0))


def _spread(queries: DataFrame) -> DataFrame:
    """One file is one task; deal the queries to all cores."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return queries.repartition(cores, "id") if queries.rdd.getNumPartitions() < cores else queries


def knn(
    queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "l2", key: str = "vec_id", vec: str = "embedding", index_vec: str | None = None,
    include_self: bool = True, furthest: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """q, n, score, rank: the k nearest of ``index`` for each query; min(k, N) rows, ties by smaller n.

    ``include_self`` keeps pairs of equal ids. A self at the same score comes before its duplicates.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    if k < 1:
        raise ValueError("k is at least 1")
    d, dq = vx.check_dimensions(index, index_vec or vec), vx.check_dimensions(queries, vec)
    if d and dq and dq != d:
        raise ValueError(f"queries have {dq} components, the index has {d}")
    side = _spread(_read(queries, key, vec))

    found = _searched(side, _blocks(_read(index, key, index_vec or vec), max(1, block_bytes // (8 * max(d, 1)))), k, metric, -1 if furthest else 1, include_self)
    return local_table(queries.sparkSession, "q long, n long, score double, rank int") if found is None else found


def top_k(found: DataFrame, k: int, down: bool) -> DataFrame:
    """Rank (q, n, score) within q, the self first among equals, and keep k."""
    order = [F.col("score").desc() if down else F.col("score"), F.col("q") != F.col("n"), F.col("n")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: DataFrame, metric: str = "l2", **kw) -> DataFrame:
    return knn(queries, index, 1, metric, **kw)


def furthest(queries: DataFrame, index: DataFrame, metric: str = "l2", **kw) -> DataFrame:
    return knn(queries, index, 1, metric, furthest=True, **kw)


def range_join(queries: DataFrame, index: DataFrame, r: float, metric: str = "l2", key: str = "vec_id", vec: str = "embedding", index_vec: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """q, n, score for all pairs with distance strictly under r (similarity strictly over r)."""
    d = max(vx.check_dimensions(index, index_vec or vec), 1)
    out = local_table(queries.sparkSession, "q long, n long, score double")
    if metric in ("l2", "exp_neg_dot") and r <= 0:
        return out
    side = _spread(_read(queries, key, vec))
    for n, (ids, x) in enumerate(_blocks(_read(index, key, index_vec or vec), max(1, block_bytes // (8 * d)))):
        if n == 1:
            side = materialize(side, "queries")  # read again for each block
        x, step = _unit(x) if metric == "cosine" else x, _part_rows(x)
        parts = [queries.sparkSession.sparkContext.broadcast((ids[a : a + step], x[a : a + step])) for a in range(0, len(ids), step)]

        def work(batches, parts=parts):
            yield from _range_rows(metric, r, parts, batches)

        out = out.unionByName(side.mapInArrow(work, "q long, n long, score double"))
    return out


def _range_rows(metric: str, r: float, parts: list, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, QUERIES):
            some = b.slice(at, QUERIES)
            every, every_id = _matrix(some.column(1), some.num_rows), np.asarray(some.column(0))
            if metric == "cosine":
                every = _unit(every)
            for part in parts:
                ids, x = read_once(part)
                near = _Near(metric, x)
                for c in range(0, len(every), CHUNK):
                    q, qid = every[c : c + CHUNK], every_id[c : c + CHUNK]
                    near.chunk(q)
                    if metric == "l2":
                        limit = (r * r - (near.q**2).sum(axis=1)) / 2
                    else:
                        limit = (np.log(r) if metric == "exp_neg_dot" else -r) + q @ near.mean
                    for tile in range(0, len(ids), TILE):
                        i, j = near.under(slice(None), slice(tile, min(tile + TILE, len(ids))), limit)
                        s = _scored(metric, q, x, i, j)
                        keep = s > r if METRICS[metric] else s < r
                        if keep.any():
                            yield _rows_out([i[keep]], qid, [ids[j[keep]]], [s[keep]])
                del ids, x, near  # before the next is read


SCORE = {"l2": vx.l2, "dot": vx.dot, "cosine": vx.cosine, "exp_neg_dot": vx.exp_neg_dot}


def knn_sql(queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "l2", key: str = "vec_id", vec: str = "embedding", include_self: bool = True, limit: int = 20_000) -> DataFrame:
    """The same as ``knn``, scored and ranked by SQL expressions: one declarative plan over the pairs that matrix
    products in blocks of about ``limit`` index rows let through, k a query and block."""
    d = max(vx.check_dimensions(index, vec), 1)
    near = knn(queries, index, k, metric, key, vec, include_self=include_self, block_bytes=limit * 8 * d).select("q", "n").distinct()
    left = queries.select(F.col(key).cast("long").alias("q"), F.col(vec).alias("_y"))
    right = index.select(F.col(key).cast("long").alias("n"), F.col(vec).alias("_x"))
    return top_k(near.join(left, "q").join(right, "n").select("q", "n", SCORE[metric]("_y", "_x").alias("score")), k, METRICS[metric])


def sample_centres(index: DataFrame, cells: int, key: str, vec: str, rounds: int = 4, sample: int = 20_000, metric: str = "l2") -> np.ndarray:
    """Cell centres by Lloyd rounds on a bounded sample (the smallest id hashes)."""
    rows = _read(index, key, vec).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r["v"] for r in rows], float)
    if metric == "cosine" and len(x):
        x = _unit(x)
    centres = x[:cells].copy()
    for _ in range(rounds if len(x) > cells else 0):
        at = scores("l2", x, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def knn_cells(queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "l2", cells: int = 64, beam: int = 8, key: str = "vec_id", vec: str = "embedding", include_self: bool = True, index_vec: str | None = None) -> DataFrame:
    """Approximate kNN: the index (its ``index_vec``, if that differs) is dealt to cells, a query looks into its
    ``beam`` nearest cells.

    Blocks of the index are sorted by cell, and a query meets those rows of a block that lie in its cells, by
    matrix products as in ``knn``; scores are exact for what is seen.
    For inner products, and dissimilarities that fall with them, vectors are first lengthened to one norm.
    """
    left, right = _read(queries, key, vec), _read(index, key, index_vec or vec)
    if metric in ("dot", "exp_neg_dot"):
        phi2 = right.agg(F.max(vx.squared_norm("v"))).first()[0] or 0.0
        right = right.withColumn("v", vx.lengthened("v", phi2))
        left = left.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    centres = sample_centres(right, cells, "id", "v", metric=metric)
    if not len(centres):
        return local_table(queries.sparkSession, "q long, n long, score double, rank int")
    blocks = _blocks(right, max(1, BLOCK_BYTES // (8 * centres.shape[1])))
    return _searched(_spread(left), blocks, k, metric, 1, include_self, centres, beam)


def coarse_cells(queries: DataFrame, tree: DataFrame, level: int, k: int, beam: int, metric: str = "exp_neg_dot", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest tree nodes at or above ``level`` for each query: a search that stops at that level."""
    heads = tree.where(F.col("level") >= level).select(F.col("uid").alias(key), F.col("embedding").alias(vec)).dropDuplicates([key])
    return knn(queries, heads, min(k, beam), metric, key=key, vec=vec)


def with_points(found: DataFrame, index: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Add the neighbour's vector as ``point``."""
    return found.join(index.select(F.col(key).alias("n"), F.col(vec).alias("point")), "n", "left")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


def score_column(metric: str, a: Column | str, b: Column | str) -> Column:
    return SCORE[metric](a, b)
