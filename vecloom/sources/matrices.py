"""Sources and sinks of vectors and graphs: NumPy matrices, COO triples, Parquet."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_matrix(spark: SparkSession, points: np.ndarray, ids: np.ndarray | None = None, projected: np.ndarray | None = None) -> DataFrame:
    """(vec_id, embedding[, embedding_proj]) of an N x D matrix; ids default to 0 ... N - 1."""
    points = np.asarray(points, np.float32)
    if points.ndim != 2:
        raise ValueError("points are an N x D matrix")
    ids = np.arange(len(points)) if ids is None else np.asarray(ids)
    cols = {"vec_id": ids.astype(np.int64), "embedding": list(points)}
    schema = "vec_id long, embedding array<float>"
    if projected is not None:
        cols["embedding_proj"], schema = list(np.asarray(projected, np.float32)), schema + ", embedding_proj array<float>"
    return spark.createDataFrame(pd.DataFrame({k: [x.tolist() for x in v] if k != "vec_id" else v for k, v in cols.items()}), schema)


def from_coo(spark: SparkSession, row, col, data) -> DataFrame:
    """(src, dst, sim, seq) of a COO matrix; seq is the order of writing."""
    pdf = pd.DataFrame({"src": np.asarray(row, np.int64), "dst": np.asarray(col, np.int64), "sim": np.asarray(data, float), "seq": np.arange(len(row), dtype=np.int64)})
    return spark.createDataFrame(pdf, "src long, dst long, sim double, seq long")


def to_coo(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, data) on the driver; for results that fit there."""
    pdf = edges.select("src", "dst", "sim").toPandas()
    return pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["sim"].to_numpy()


def read_vectors(spark: SparkSession, path: str, key: str = "vec_id", vec: str = "embedding", format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path).withColumnsRenamed({key: "vec_id", vec: "embedding"})


def read_edges(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", sim: str = "sim", format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.col(sim).cast("double").alias("sim"))
