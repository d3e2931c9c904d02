"""Sampling of neighbours by similarity, seeded: equal seeds give equal samples.

Uniform numbers are hashes of (seed, query, what may be drawn, draw), so no sample depends on how rows are
partitioned or on which task runs again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators import knn, tree as trees


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in (0, 1) from the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def _hash01(seed: int, q: np.ndarray, n: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers in (0, 1) of a seed, ids of queries, ids of what is drawn (as arrays broadcast) and a draw."""
    with np.errstate(over="ignore"):
        rng = np.asarray(q).astype(np.uint64) * np.uint64(7_919) + np.uint64((seed * 1_000_003 + draw * 104_729) & (2**64 - 1))
        x = np.asarray(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rng * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


#: Rows of the index, in order of ids, among which one draw is decided by one number.
STRATUM = 1024


def _drawn(draws: int, seed: int, first: int, ids: np.ndarray, x: np.ndarray, batches):
    """q, draw, n, g, s, total: of a block, each draw's stratum of the largest perturbed log-sum and the row drawn from it."""
    starts = np.arange(0, len(ids), STRATUM)
    for b in batches:
        if not b.num_rows:
            continue
        every, every_id = knn._matrix(b.column(1), b.num_rows), np.asarray(b.column(0))
        for at in range(0, len(every), 128):
            q, qid = every[at : at + 128], every_id[at : at + 128]
            logs = np.empty((len(q), len(starts)))
            for tile in range(0, len(starts), 8):
                s = q @ x[tile * STRATUM : (tile + 8) * STRATUM].T
                top = s.max(axis=1, keepdims=True)
                np.exp(np.subtract(s, top, out=s), out=s)
                with np.errstate(divide="ignore"):
                    logs[:, tile : tile + 8] = np.log(np.add.reduceat(s, np.arange(0, s.shape[1], STRATUM), axis=1)) + top
            peak = logs.max(axis=1)
            total = peak + np.log(np.exp(logs - peak[:, None]).sum(axis=1))
            g = np.stack([logs - np.log(-np.log(_hash01(seed, qid[:, None], first + np.arange(len(starts)), draw))) for draw in range(draws)], axis=1)
            won = g.argmax(axis=2)
            row, sim = np.empty(won.shape, int), np.empty(won.shape)
            u = np.stack([_hash01(seed + 0x5851F42D, qid, first + won[:, draw], draw) for draw in range(draws)], axis=1)
            for stratum in np.unique(won):
                i, draw = np.nonzero(won == stratum)
                part = x[starts[stratum] : starts[stratum] + STRATUM]
                s = q[i] @ part.T
                heap = np.exp(s - s.max(axis=1, keepdims=True)).cumsum(axis=1)
                j = np.minimum((heap <= (u[i, draw] * heap[:, -1])[:, None]).sum(axis=1), len(part) - 1)
                row[i, draw], sim[i, draw] = starts[stratum] + j, s[np.arange(len(i)), j]
            best = np.take_along_axis(g, won[:, :, None], axis=2)[:, :, 0]
            cols = np.repeat(qid, draws), np.tile(np.arange(draws, dtype=np.int32), len(q)), ids[row].ravel(), best.ravel(), sim.ravel(), np.repeat(total, draws)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "draw", "n", "g", "s", "total"])


def similarity_sample(queries: DataFrame, index: DataFrame, draws: int, seed: int = 0, key: str = "vec_id", vec: str = "embedding", index_vec: str = "embedding", block_bytes: int = knn.BLOCK_BYTES) -> DataFrame:
    """q, draw, n, prob: ``draws`` independent samples with probability proportional to exp(dot).

    Gumbel-max over strata of ``STRATUM`` rows in order of ids: a stratum's log-sum-exp is perturbed once a draw,
    the largest wins, and one more number picks a row in it by its share of the sum. Only the winner of each
    block is kept, and log-sum-exp of the blocks gives the probability of what was drawn.
    """
    side = knn._spread(knn._read(queries, key, vec))
    d = knn.vx.check_dimensions(index, index_vec) or 1
    rows = max(1, block_bytes // (8 * d))
    rows -= rows % STRATUM if rows > STRATUM else 0
    found, first = None, 0
    for ids, x in knn._blocks(knn._read(index, key, index_vec).orderBy("id"), rows):
        if first and found is not None and not hasattr(side, "_stored_at"):
            side = knn.materialize(side, "queries")  # read again for each block
        held = queries.sparkSession.sparkContext.broadcast((first, ids, x))

        def work(batches, held=held):
            yield from _drawn(draws, seed, *held.value, batches)

        part = knn.materialize(side.mapInArrow(work, "q long, draw int, n long, g double, s double, total double"), "sample")
        held.destroy()
        first += -(-len(ids) // STRATUM)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], "q long, draw int, n long, prob double")
    peak = found.groupBy("q", "draw").agg(F.max(F.struct("g", "n", "s")).alias("m"), F.max("total").alias("t"), F.collect_list("total").alias("ts"))  # one number a block
    log_sum = F.col("t") + F.log(F.aggregate("ts", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("t"))))
    return peak.select("q", "draw", F.col("m.n").alias("n"), F.exp(F.col("m.s") - log_sum).alias("prob"))


def random_descendants(tree: DataFrame, seeds: list[int]) -> DataFrame:
    """uid, draw, descendant: for each seed, in order from draw 0, one of each node's descendants (itself among them), uniformly.

    All draws share one closure of the tree and one pass over it.
    """
    pairs = trees.closure(tree)
    drawn = [F.min_by("uid", F.struct(uniform(seed, "ancestor", "uid"), "uid")) for seed in seeds]
    one = pairs.groupBy(F.col("ancestor").alias("uid")).agg(F.array(*drawn).alias("_drawn"))
    return one.select("uid", F.posexplode("_drawn").alias("draw", "descendant"))


def random_descendant(tree: DataFrame, seed: int = 0) -> DataFrame:
    """uid, descendant: one of each node's descendants (itself among them), uniformly."""
    return random_descendants(tree, [seed]).select("uid", "descendant")


def coarse_heads(queries: DataFrame, tree: DataFrame, k: int, level: int, beam: int) -> DataFrame:
    """q, n, score, rank: the k nearest heads at or above ``level``."""
    return knn.coarse_cells(queries, tree, level, k, max(k, beam))


def cluster_sample(queries: DataFrame, tree: DataFrame, k: int, level: int, beam: int = 100, seed: int = 0) -> DataFrame:
    """q, n, dist, rank: heads of the k nearest coarse cells with random descendants of them, distinct, the k nearest."""
    return repeated_cluster_sample(queries, tree, k, level, beam, 1, seed).drop("repeat")


def repeated_cluster_sample(queries: DataFrame, tree: DataFrame, k: int, level: int, beam: int = 100, repeats: int = 2, seed: int = 0) -> DataFrame:
    """q, repeat, n, dist, rank: ``cluster_sample`` with seeds seed, seed + 1, ... side by side.

    Neither the nearest heads nor the closure of the tree depend on the seed: each is found once for all repeats.
    """
    if repeats < 1:
        raise ValueError("repeats is at least 1")
    heads = knn.materialize(coarse_heads(queries, tree, k, level, beam).select("q", "n"), "heads")
    drawn = random_descendants(tree, [seed + r for r in range(repeats)]).select(F.col("uid").alias("n"), F.col("draw").alias("repeat"), "descendant")
    drawn = heads.join(drawn, "n").select("q", "repeat", F.col("descendant").alias("n"))
    both = heads.select("q", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), "n").unionByName(drawn).distinct()
    qv = queries.select(F.col("vec_id").alias("q"), F.col("embedding").alias("_q"))
    nv = tree.select(F.col("uid").alias("n"), F.col("embedding").alias("_n"))
    scored = both.join(qv, "q").join(nv, "n").select("q", "repeat", "n", knn.score_column("exp_neg_dot", "_n", "_q").alias("dist"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q", "repeat").orderBy("dist", "n")))
    return ranked.where(F.col("rank") <= k).select("q", "repeat", "n", "dist", "rank")


def chain_sample(queries: DataFrame, tree: DataFrame, k: int, level: int, beam: int = 100, chains: int = 1, length: int = 10, seed: int = 0) -> DataFrame:
    """q, chain, n: where Metropolis-Hastings chains over random descendants of the k nearest cells end.

    Proposals are uniform over cells and over their descendants; the law sampled is exp(-dist) times the
    proposal's. Each chain runs for ``length`` steps over its query's proposals, which are k * length rows.
    """
    heads = coarse_heads(queries, tree, k, level, beam).select("q", "n")
    qv = queries.select(F.col("vec_id").alias("q"), F.col("embedding").alias("_q"))
    nv = tree.select(F.col("uid").alias("n"), F.col("embedding").alias("_n"))
    drawn = random_descendants(tree, [seed + step for step in range(length + 1)]).select(F.col("uid").alias("n"), F.col("draw").alias("step"), "descendant")
    drawn = heads.join(drawn, "n")
    every = drawn.select("q", "step", F.col("n").alias("head"), F.col("descendant").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
    pick = every.groupBy("q", "chain", "step").agg(F.min_by("n", F.struct(uniform(seed, "q", "chain", "step", "head"), "head")).alias("n"))
    scored = pick.join(qv, "q").join(nv, "n").select("q", "chain", "step", "n", knn.score_column("exp_neg_dot", "_n", "_q").alias("dist"), uniform(seed + 1, "q", "chain", "step").alias("u"))

    steps = F.array_sort(F.collect_list(F.struct("step", "n", "dist", "u")))
    walk = F.aggregate(F.col("steps"), F.struct(F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("dist")), lambda a, s: F.when(a["n"].isNull() | (s["u"] < F.exp(a["dist"] - s["dist"])), F.struct(s["n"].alias("n"), s["dist"].alias("dist"))).otherwise(a))
    return scored.groupBy("q", "chain").agg(steps.alias("steps")).select("q", "chain", walk["n"].alias("n"))
