"""A vector index as a table: build, insert, update, delete, search, save and load.

The table is the index; searches are joins. ``method`` picks the access path and accepts the usual
names of such indexes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as vx
from vecloom.operators import graph, knn
from vecloom.session import materialize

#: Exact and approximate access paths by name.
METHODS = {"exact": "exact", "cosine_covertree": "exact", "cosine_sgtree": "exact", "cosine_faissflat": "exact", "cells": "cells", "cosine_sgtreebeam": "cells", "cosine_faisshnsw": "cells"}


class VectorIndex:
    """Rows (vec_id, embedding, [embedding_proj], other columns); ids are the caller's and are honoured.

    ``metric`` is l2, dot, cosine or exp_neg_dot (searched on ``embedding_proj``). Exact duplicates stay
    unless ``dedup`` is set. Searches return min(k, N) rows a query and never an id twice.
    """

    def __init__(self, vectors: DataFrame, metric: str = "l2", method: str = "exact", dedup: bool = False, noise: float = 0.0, seed: int = 0, cells: int = 64):
        if method not in METHODS:
            raise ValueError(f"method is one of {sorted(METHODS)}")
        if metric not in knn.METRICS:
            raise ValueError(f"metric is one of {sorted(knn.METRICS)}")
        self.spark, self.metric, self.method, self.cells = vectors.sparkSession, metric, METHODS[method], cells
        self.dedup, self.noise, self.seed = dedup, noise, seed
        self.vec = "embedding_proj" if metric == "exp_neg_dot" else "embedding"
        self.vectors = self._taken(vectors)
        self.dimension = vx.check_dimensions(self.vectors, self.vec)
        self.properties: DataFrame | None = None

    @classmethod
    def of_table(cls, vectors: DataFrame, metric: str = "l2", method: str = "exact", dedup: bool = False, noise: float = 0.0, seed: int = 0, cells: int = 64) -> VectorIndex:
        """An index over a table that an index wrote, taken as it is."""
        out = cls(vectors.limit(0), metric, method, dedup, noise, seed, cells)
        out.vectors, out.dimension = vectors, vx.check_dimensions(vectors, out.vec)
        return out

    def _taken(self, vectors: DataFrame) -> DataFrame:
        if self.noise:
            vectors = vectors.withColumn("embedding", vx.noisy("embedding", self.noise, self.seed).cast(vectors.schema["embedding"].dataType))
        out = vectors.dropDuplicates(["vec_id"])
        return materialize(out.dropDuplicates(["embedding"]) if self.dedup else out, "index")

    def __len__(self) -> int:
        return self.vectors.count()

    def insert(self, vectors: DataFrame) -> bool:
        """Add rows; those whose vec_id is held already are left out. Whether any row was new."""
        self._check(vectors)
        new = self._taken(vectors.select(*self.vectors.columns)).join(self.vectors.select("vec_id"), "vec_id", "left_anti")
        if self.dedup:
            new = new.join(self.vectors.select("embedding"), "embedding", "left_anti")
        new = materialize(new.select(*self.vectors.columns), "insert")
        if new.isEmpty():
            return False
        self.vectors = materialize(self.vectors.unionByName(new), "index")
        self.dimension = vx.check_dimensions(self.vectors, self.vec)
        return True

    def _check(self, vectors: DataFrame) -> None:
        d = vx.check_dimensions(vectors, self.vec)
        if self.dimension and d and d != self.dimension:
            raise ValueError(f"the index has {self.dimension} components, these vectors {d}")

    def update(self, vectors: DataFrame) -> None:
        """Replace the vectors of held ids; other ids are ignored."""
        self._check(vectors)
        new = vectors.select(*self.vectors.columns).dropDuplicates(["vec_id"]).join(self.vectors.select("vec_id"), "vec_id", "left_semi")
        self.vectors = materialize(self.vectors.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new), "index")

    def remove(self, ids: DataFrame) -> int:
        """Delete rows by vec_id; how many went."""
        before = len(self)
        self.vectors = materialize(self.vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"), "index")
        return before - len(self)

    def knn(self, queries: DataFrame, k: int = 10, beam: int | None = None, return_points: bool = False, include_self: bool = True) -> DataFrame:
        """q, n, score, rank; with ``beam``, or on a cells index, approximate by that many cells."""
        if beam or self.method == "cells":
            found = knn.knn_cells(queries, self.vectors, k, self.metric, self.cells, beam or 8, include_self=include_self, index_vec=self.vec)
        else:
            found = knn.knn(queries, self.vectors, k, self.metric, vec="embedding", index_vec=self.vec, include_self=include_self)
        return knn.with_points(found, self.vectors) if return_points else found

    def nearest(self, queries: DataFrame, **kw) -> DataFrame:
        return self.knn(queries, 1, **kw)

    def furthest(self, queries: DataFrame) -> DataFrame:
        return knn.furthest(queries, self.vectors, self.metric, vec="embedding", index_vec=self.vec)

    def range(self, queries: DataFrame, r: float = 1.0) -> DataFrame:
        """Pairs strictly under distance r. For inner product and cosine there is no such search."""
        if self.metric in ("dot", "cosine"):
            raise NotImplementedError("range search is defined for distances")
        return knn.range_join(queries, self.vectors, r, self.metric, vec="embedding", index_vec=self.vec)

    def insert_and_knn(self, vectors: DataFrame, k: int = 10) -> DataFrame:
        """Insert the batch, then its kNN edges against the whole index, itself counted among the k and dropped."""
        self.insert(vectors)
        return graph.knn_graph(vectors, k, self.metric, index=self.vectors)

    def set_properties(self, rows: DataFrame) -> None:
        """User columns by vec_id, kept beside the vectors."""
        self.properties = materialize(rows, "properties")

    def nodes(self) -> DataFrame:
        return self.vectors if self.properties is None else self.vectors.join(self.properties, "vec_id", "left")

    def save(self, path: str) -> None:
        self.nodes().write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "l2", **kw) -> VectorIndex:
        return cls(spark.read.parquet(path), metric, **kw)


def mips_by_distance(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Maximum inner product by nearest lengthened vectors: what distance-only indexes do. Same pairs as metric dot."""
    phi2 = float(index.agg(F.max(vx.squared_norm("embedding"))).first()[0] or 0.0)
    longer = index.select("vec_id", vx.lengthened("embedding", phi2).alias("embedding"))
    asked = queries.select("vec_id", F.concat(vx.doubles("embedding"), F.array(F.lit(0.0))).alias("embedding"), vx.squared_norm("embedding").alias("q2"))
    found = knn.knn(asked, longer, k, "l2")
    met = found.join(asked.select(F.col("vec_id").alias("q"), "q2"), "q")
    return met.select("q", "n", vx.l2_to_inner(F.col("score"), F.col("q2"), phi2).alias("score"), "rank")


def mcss_by_distance(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Maximum cosine by nearest unit vectors; queries need not be unit. Same pairs as metric cosine."""
    unit = index.select("vec_id", vx.unit_norm("embedding").alias("embedding"))
    asked = queries.select("vec_id", vx.doubles("embedding").alias("embedding"), vx.norm("embedding").alias("qn"))
    found = knn.knn(asked, unit, k, "l2").join(asked.select(F.col("vec_id").alias("q"), "qn"), "q")
    return found.select("q", "n", vx.l2_to_cosine_of(F.col("score"), F.col("qn")).alias("score"), "rank")
