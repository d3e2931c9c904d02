"""Aggregates over vectors: mean, medoid, radii."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as vx


def vector_mean(vectors: DataFrame, vec: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """pos, mean of each component (positions from 0), optionally by group; partial sums before the shuffle."""
    keys = by or []
    return vectors.select(*keys, F.posexplode(vx.doubles(vec)).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("mean"))


def mean_vector(vectors: DataFrame, vec: str = "embedding") -> list[float]:
    """The mean on the driver: one number a component."""
    return [r["mean"] for r in vector_mean(vectors, vec).orderBy("pos").collect()]


def distances_to(vectors: DataFrame, point: list[float], vec: str = "embedding", key: str = "vec_id", metric: str = "l2") -> DataFrame:
    """vec_id, dist of every vector to one point; ``exp_neg_dot`` for projected vectors."""
    at = F.array(*map(F.lit, point))
    return vectors.select(F.col(key).alias("vec_id"), (vx.l2 if metric == "l2" else vx.exp_neg_dot)(vec, at).alias("dist"))


def medoid(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, dist of the vector nearest to the mean, ties to the smaller id: one row."""
    d = distances_to(vectors, mean_vector(vectors, vec), vec, key)
    return d.agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("m.vec_id", "m.dist")


def radius(vectors: DataFrame, point: list[float], vec: str = "embedding") -> DataFrame:
    return distances_to(vectors, point, vec).agg(F.max("dist").alias("radius"))
