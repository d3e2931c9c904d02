"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by its nearest pivots in order.
Vectors are dealt to blocks of about BLOCK by a hash, whatever their partitions, and each block carries
inverted files: for each pivot, the vectors that have it among their nearest PLACES pivots, sorted by the
place it has there. A query opens the files of its own ASKED nearest pivots and reads, in each, only the
postings within WINDOW places of the pivot's place in the query. A posting brings a vector nearer by
WINDOW + 1 less the difference of the places, so vectors rank by the footrule distance over the asked
pivots, where a pivot that was not met counts as WINDOW + 1 places. The nearest of each block (SHARE of it
and EXTRA for each neighbour wanted) are reranked by the exact inner product in double precision; a task
merges the k best of all its blocks, so what it returns does not grow with them.

Vectors are lengthened by one component that gives them all the same norm, which makes the nearest
vectors those of largest inner product whatever their norms; queries get a zero there.

Queries go to the blocks in bounded broadcasts, one pass over the blocks for each QUERY_BLOCK queries.

Cases: null and zero vectors, those holding null or non-finite components and those whose length is not
the commonest (the longer on ties) take no part. Repeated rows are candidates of their own; every row
but the query's own vec_id is one, and a query that is repeated is asked once for each of its vectors. A
null vec_id is never a query and comes last on ties. Other columns are ignored, whatever their names. An
empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import small_batches, table
from vecloom.llm.minhash import groups_of
from vecloom.session import materialize

PIVOTS = 512
#: Nearest pivots in whose inverted files a vector is posted, and those whose files a query opens.
PLACES, ASKED = 128, 48
#: Places by which a posting may differ from the query's.
WINDOW = 64
#: Reranked of each block: a share, and so many more for each neighbour wanted.
SHARE, EXTRA = 0.2, 4
BLOCK = 4096
QUERY_BLOCK = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vec = F.col("vec")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(vec.isNotNull() & (F.size(vec) > 0))
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine.where(whole & F.exists(vec, lambda x: x != 0))
    lengths = fine.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return fine.where(F.size("vec") == (lengths["d"] if lengths else 0))


def permutations(lengthened: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; all rows and pivots have one norm, so by inner product."""
    near = lengthened @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :places].astype(np.int16)


def inverted(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a block: where the file of (pivot, place) begins, and the rows posted, in that order."""
    n, places = perm.shape
    cell = (perm.astype(np.int64) * places + np.arange(places)).ravel()
    order = np.argsort(cell, kind="stable")
    begins = np.searchsorted(cell[order], np.arange(pivots * places + 1))
    return begins.astype(np.int32), (order // places).astype(np.int32)


def build(fine: DataFrame, pivots: np.ndarray, radius: float, places: int, blocks: int) -> DataFrame:
    """Blocks of vectors with their inverted files: n, ids, vecs, begins, posted."""
    small_batches(fine.sparkSession)
    held = fine.sparkSession.sparkContext.broadcast(pivots)
    names = ["n", "ids", "vecs", "begins", "posted"]

    def work(batches):
        for group in groups_of(batches, ["block"]):
            for at in range(0, len(group["vec"]), 2 * BLOCK):  # a block is longer only where rows repeat
                x = np.array(group["vec"][at : at + 2 * BLOCK], float)
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in group["vec_id"][at : at + 2 * BLOCK]], np.int64)
                extra = np.sqrt(np.maximum(radius**2 - (x * x).sum(axis=1), 0.0))
                begins, posted = inverted(permutations(np.column_stack((x, extra)), held.value, places), len(held.value))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, begins, posted))], names)

    dealt = fine.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)))
    sorted_ = dealt.repartition(blocks, "block").sortWithinPartitions("block", F.col("vec_id").asc_nulls_last(), "vec").select("block", "vec_id", "vec")
    return materialize(sorted_.mapInArrow(work, "n long, ids binary, vecs binary, begins binary, posted binary"), "pivots")


def block_search(queries: np.ndarray, query_ids: np.ndarray, perms: np.ndarray, part: dict, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, score) of the block's best k for each query, a row a query; scores are -inf where there are fewer."""
    n, places = part["n"], perms.shape[1]
    ids, vecs = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["vecs"]).reshape(n, -1)
    begins, posted = np.frombuffer(part["begins"], np.int32), np.frombuffer(part["posted"], np.int32)
    wanted = min(n, int(np.ceil(share * n)) + EXTRA * k + 1)
    asked = np.arange(min(ASKED, places))
    low, high = np.maximum(asked - WINDOW, 0), np.minimum(asked + WINDOW + 1, places)
    gain_at = WINDOW + 1.0 - np.abs(np.arange(places)[None, :] - asked[:, None])
    best_ids, best = np.full((len(queries), k), np.iinfo(np.int64).max), np.full((len(queries), k), -np.inf)
    for q in range(len(queries)):
        file = perms[q, : len(asked)].astype(np.int64) * places
        first, last = begins[file + low], begins[file + high]
        rows = np.concatenate([posted[a:b] for a, b in zip(first, last, strict=True)])
        counts = np.concatenate([np.diff(begins[f + a : f + b + 1]) for f, a, b in zip(file, low, high, strict=True)])
        gains = np.repeat(np.concatenate([gain_at[i, a:b] for i, (a, b) in enumerate(zip(low, high, strict=True))]), counts)
        nearer = np.bincount(rows, gains, n)
        near = np.argpartition(-nearer, wanted - 1)[:wanted] if wanted < n else np.arange(n)
        near = near[ids[near] != query_ids[q]]
        close = vecs[near] @ queries[q]
        if len(near) > k:  # the product is good to a few ulps; what could be among the best is summed exactly
            near = near[close >= np.partition(close, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(close).max())]
        exact = (vecs[near] * queries[q]).sum(axis=1)
        top = np.lexsort((ids[near], -exact))[:k]
        best_ids[q, : len(top)], best[q, : len(top)] = ids[near][top], exact[top]
    return best_ids, best


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then the smaller id."""
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def nearest(vectors: DataFrame, step: int, k: int = 20, pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``step``, its k nearest found."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    fine = usable(vectors)
    stats = fine.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("r2"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    radius = float(np.sqrt(stats["r2"]))
    sample = np.array([r["vec"] for r in fine.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(pivots).collect()])
    sample = np.column_stack((sample, np.sqrt(np.maximum(radius**2 - (sample * sample).sum(axis=1), 0.0))))
    places = min(places, len(sample))
    blocks = build(fine, sample, radius, places, max(1, -(-stats["n"] // block)))
    asked = materialize(fine.where(F.col("vec_id") % step == 0).distinct(), "queries")
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(passes)))
    tasks = min(blocks.count(), 4 * spark.sparkContext.defaultParallelism)
    parts = []
    for part in range(passes):
        rows = asked.where(F.col("_part") == part).select("vec_id", "vec").collect()
        if not rows:
            continue
        ids, vecs = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["vec"] for r in rows])
        perms = permutations(np.column_stack((vecs, np.zeros(len(vecs)))), sample, places)
        held = spark.sparkContext.broadcast((ids, vecs, perms))

        def work(batches, held=held):
            ids, vecs, perms = held.value
            found, scores = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
            for b in batches:
                for data in b.to_pylist():
                    more = block_search(vecs, ids, perms, data, k, share)
                    found, scores = best_of(np.hstack((found, more[0])), np.hstack((scores, more[1])), k)
            there = scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(np.repeat(np.arange(len(ids)), there.sum(axis=1))), pa.array(found[there]), pa.array(scores[there])], ["query_id", "q", "vec_id", "score"])

        parts.append(materialize(blocks.repartition(max(1, tasks)).mapInArrow(work, "query_id long, q long, vec_id long, score double"), "found").withColumn("part", F.lit(part)))
        held.unpersist()
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, parts)
    # At most k rows a task and query; a query is its vector, of which an id has one unless rows repeat it.
    ranked = found.selectExpr("query_id", "vec_id", "score", "row_number() OVER (PARTITION BY query_id, part, q ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    none = F.lit(2**63 - 1)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != none, F.col("vec_id")).alias("vec_id"), "score")


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), step=20)
