"""Micro-batch clustering of a stream of vectors, on Structured Streaming's foreachBatch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.agglomeration import Agglomerator, Hierarchy
from vecloom.operators.index import VectorIndex
from vecloom.session import materialize


class StreamingClusters:
    """A growing cosine index and the hierarchy of the kNN edges that its batches brought.

    ``partial_fit`` indexes a batch, takes its kNN edges (against all vectors so far, itself counted
    among the k) and refits; ``add_edges`` leaves refitting to ``update_on_edges``. A first batch of a
    single vector waits for the next. The edges depend on how a stream is cut into batches; the
    hierarchy of given edges does not.

    The tables of each batch lie in the shared folder; with a ``state`` folder, a sink notes after each
    batch which ones they are, and a new process goes on from the last note.
    """

    def __init__(self, spark: SparkSession, k: int, thresholds: list[float] | None = None, rounds: int = 50, index_name: str = "exact", dedup: bool = False, noise: float = 0.0, marking_strategy: str = "JUST_SIB"):
        self.spark, self.k, self.index_name, self.dedup, self.noise = spark, k, index_name, dedup, noise
        self.clusters = Agglomerator(spark, thresholds if thresholds is not None else [float("-inf")] * rounds, marking_strategy)
        self.index: VectorIndex | None = None
        self.waiting: DataFrame | None = None
        self.latest_update: DataFrame | None = None
        self.done: set[int] = set()

    def _edges(self, batch: DataFrame) -> DataFrame | None:
        if self.waiting is not None:
            batch = self.waiting.unionByName(batch)
        if self.index is None:
            batch = materialize(batch, "batch")
            if batch.limit(2).count() < 2:
                self.waiting = batch
                return None
            self.index = VectorIndex(batch, "cosine", self.index_name, self.dedup, self.noise)
            self.waiting = None
            from vecloom.operators.graph import knn_graph

            return knn_graph(batch, self.k, "cosine", index=self.index.vectors)
        return self.index.insert_and_knn(batch, self.k)

    def _take(self, batch: DataFrame) -> bool:
        edges = self._edges(batch)
        if edges is None:
            return False
        self.latest_update = materialize(edges, "latest")
        alone = batch.select(F.col("vec_id").cast("long").alias("src"), F.col("vec_id").cast("long").alias("dst"), F.lit(0.0).alias("sim"))
        self.clusters.add_edges(self.latest_update.unionByName(alone))  # self edges only register points
        return True

    def partial_fit(self, batch: DataFrame) -> Hierarchy | None:
        return self.clusters.update() if self._take(batch) else None

    def add_edges(self, batch: DataFrame) -> None:
        self._take(batch)

    def update_on_edges(self) -> Hierarchy:
        return self.clusters.update()

    def note(self, state: str, batch_id: int) -> None:
        """Write where this batch left the tables, as one small file that appears whole or not at all."""
        at = lambda df: None if df is None else df._stored_at
        tables = {"index": at(self.index and self.index.vectors), "waiting": at(self.waiting)}
        if self.index is not None:
            tables |= {"edges": at(self.clusters.edges), "points": at(self.clusters.extra)}
        row = (json.dumps({"tables": tables, "clock": self.clusters.clock}),)
        self.spark.createDataFrame([row], "value string").coalesce(1).write.mode("overwrite").text(f"{state}/batch={batch_id}")

    def restore(self, state: str) -> bool:
        """Go on from the last note in ``state``, refitting its edges once; whether there was one."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(state)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return False
        last = self.spark.read.text(state).orderBy(F.col("batch").cast("long").desc()).first()
        if last is None:
            return False
        noted = json.loads(last["value"])
        tables = {}
        for name, path in noted["tables"].items():
            if path is not None:
                tables[name] = self.spark.read.parquet(path)
                tables[name]._stored_at = path
        self.done = set(range(int(last["batch"]) + 1))
        self.waiting = tables.get("waiting")
        if "index" in tables:
            self.index = VectorIndex.of_table(tables["index"], "cosine", self.index_name, self.dedup, self.noise)
            self.clusters.edges, self.clusters.extra, self.clusters.clock = tables["edges"], tables["points"], noted["clock"]
            self.clusters.hierarchy = None
            self.clusters.update()
        return True

    def sink(self, refit_every: int = 1, state: str | None = None) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function; a batch that is replayed under its number is skipped, also after a restart
        where ``state`` names a folder that outlives the process."""
        if state and self.index is None:
            self.restore(state)

        def each(batch: DataFrame, batch_id: int) -> None:
            if batch_id in self.done or batch.isEmpty():
                return
            self.add_edges(materialize(batch.select("vec_id", "embedding"), "stream"))
            if (batch_id + 1) % refit_every == 0 and self.clusters.pending is not None:
                self.update_on_edges()
            if state:
                self.note(state, batch_id)
            self.done.add(batch_id)

        return each


def cluster_stream(stream: DataFrame, clusters: StreamingClusters, checkpoint: str, refit_every: int = 1):
    """Start the query that feeds ``stream`` (vec_id, embedding) to ``clusters``; what is available is taken, then it ends.

    A later call with the same checkpoint goes on where this one ended, with new ``clusters`` too.
    """
    state = checkpoint.rstrip("/") + "-clusters"
    return stream.writeStream.foreachBatch(clusters.sink(refit_every, state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total: tumbling windows over ``ts`` with a watermark (batch or stream)."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
