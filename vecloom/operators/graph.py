"""Similarity graphs: (src, dst, sim) edge lists from vectors, and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.knn import knn


def knn_graph(vectors: DataFrame, k: int = 5, metric: str = "cosine", index: DataFrame | None = None, **kw) -> DataFrame:
    """src, dst, sim: the k nearest of each vector, itself counted among them and then dropped."""
    found = knn(vectors, vectors if index is None else index, k, metric, **kw)
    return found.where("q <> n").select(F.col("q").alias("src"), F.col("n").alias("dst"), F.col("score").alias("sim"))


def upsert(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Both directions of every edge; of repeated ones the last written (largest ``seq``, then sim) wins.

    Decided once on the canonical pair, so both directions hold the same number.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "sim", seq)
    last = pair.groupBy("u", "v").agg(F.max_by("sim", F.struct(seq, "sim")).alias("sim"))
    return both_ways(last)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "sim").union(pairs.select("v", "u", "sim"))


def symmetrize_max(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the larger similarity; self edges go."""
    pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("sim").alias("sim"))
    return both_ways(pair)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.max("sim").alias("best_sim"))


def contract(edges: DataFrame, parents: DataFrame, how: str = "sum") -> DataFrame:
    """Edges between the parents (node, parent) of the endpoints: sum, max or min of sims; inner edges go."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    up = parents.select(F.col("node").alias("src"), F.col("parent").alias("pu"))
    vp = parents.select(F.col("node").alias("dst"), F.col("parent").alias("pv"))
    met = edges.join(up, "src").join(vp, "dst").where("pu <> pv")
    return met.groupBy(F.col("pu").alias("src"), F.col("pv").alias("dst")).agg(agg("sim").alias("sim"))


def best_neighbour(edges: DataFrame, counts: DataFrame | None, threshold: float, lowest: float = -10000.0) -> DataFrame:
    """node, best, score: the neighbour of highest average similarity, strictly over both limits; ties to the smaller id."""
    scored = edges.withColumnRenamed("sim", "score")
    if counts is not None:
        cu = counts.select(F.col("node").alias("src"), F.col("n").alias("cu"))
        cv = counts.select(F.col("node").alias("dst"), F.col("n").alias("cv"))
        scored = edges.join(cu, "src").join(cv, "dst").select("src", "dst", (F.col("sim") / (F.col("cu") * F.col("cv"))).alias("score"))
    open_ = scored.where((F.col("src") != F.col("dst")) & (F.col("score") > threshold) & (F.col("score") > lowest))
    best = open_.groupBy("src").agg(F.max(F.struct("score", (-F.col("dst")).alias("neg"))).alias("m"))
    return best.select(F.col("src").alias("node"), (-F.col("m.neg")).alias("best"), F.col("m.score").alias("score"))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k edges of each src with the largest sim, ties to the smaller dst."""
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), F.col("dst"))
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
