"""DAG clustering: rounds in which a cluster may join several parents.

A round takes each node's best neighbour (average similarity strictly over the round's threshold and
over ``lowest``; ties to the smaller id), proposes parents (of a mutual pair the smaller id; else each
node for itself and for its best neighbour), keeps each node's best ``max_parents`` and of these the
parents with exactly two votes, and contracts the graph by the linkage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators import graph
from vecloom.session import materialize

LINKAGES = {"single": 0, "average": 1, "approx_average": 2}


def ingest(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, the last write of a repeated one; no self edges."""
    seq = edges.columns.index("seq") if "seq" in edges.columns else None
    return graph.upsert(edges if seq is not None else edges.withColumn("seq", F.lit(0)))


def prune(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k heaviest edges; where both directions of a pair stay, the weight of its smaller node holds for both."""
    kept = graph.top_neighbours(edges, k)
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("sim").alias("_back"))
    met = kept.join(back, ["src", "dst"], "left")
    return met.select("src", "dst", F.when(F.col("_back").isNotNull() & (F.col("dst") < F.col("src")), F.col("_back")).otherwise(F.col("sim")).alias("sim"))


def propose(nodes: DataFrame, best: DataFrame) -> DataFrame:
    """node, chosen, mate, score, mutual for every node; without a best neighbour a node is its own mate."""
    b = nodes.select("node").join(best, "node", "left").select("node", F.coalesce("best", "node").alias("mate"), F.coalesce("score", F.lit(0.0)).alias("score"))
    back = b.select(F.col("node").alias("mate"), F.col("mate").alias("_back"))
    met = b.join(back, "mate")
    mutual = (F.col("_back") == F.col("node")) & (F.col("mate") != F.col("node"))
    return met.select("node", "mate", "score", mutual.alias("mutual"), F.when(mutual, F.least("node", "mate")).otherwise(F.col("node")).alias("chosen"))


def assign(proposed: DataFrame, max_parents: int) -> DataFrame:
    """(node, parent) after the votes.

    A node's candidates: its own chosen parent, and the chosen parents of the nodes whose best
    neighbour it is (not of mutual pairs). The best ``max_parents`` by (score, smaller id) stay, and of
    these the parents with exactly two votes; a node left with none is its own parent, and so is, beside
    what it has, one whose own choice was lost.
    """
    own = proposed.select("node", F.col("chosen").alias("parent"), "score", F.lit(True).alias("own"))
    given = proposed.where(~F.col("mutual") & (F.col("mate") != F.col("node"))).select(F.col("mate").alias("node"), F.col("chosen").alias("parent"), "score", F.lit(False).alias("own"))
    every = own.unionByName(given).groupBy("node", "parent").agg(F.max("score").alias("score"), F.max("own").alias("own"))
    w = Window.partitionBy("node").orderBy(F.col("score").desc(), F.col("parent"))
    kept = every.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_parents)
    votes = kept.groupBy("parent").agg(F.count("*").alias("votes"))
    pair = kept.join(votes, "parent").where("votes = 2").select("node", "parent")
    chosen = proposed.select("node", F.col("chosen").alias("parent"))
    lost = chosen.join(pair, ["node", "parent"], "left_anti").select("node", F.col("node").alias("parent"))
    return pair.unionByName(lost).distinct()


def contract(edges: DataFrame, parents: DataFrame, linkage: str, members: DataFrame | None = None, leaf_edges: DataFrame | None = None) -> DataFrame:
    """Edges between parents: the largest (single), the mean over all leaf pairs (average), or sums (approx_average)."""
    if linkage == "average":
        mp = members
        a = mp.select(F.col("point").alias("src"), F.col("node").alias("pu"))
        b = mp.select(F.col("point").alias("dst"), F.col("node").alias("pv"))
        total = leaf_edges.join(a, "src").join(b, "dst").where("pu <> pv").groupBy("pu", "pv").agg(F.sum("sim").alias("total"))
        sizes = mp.groupBy("node").agg(F.count("*").alias("n"))
        su, sv = sizes.select(F.col("node").alias("pu"), F.col("n").alias("nu")), sizes.select(F.col("node").alias("pv"), F.col("n").alias("nv"))
        return total.join(su, "pu").join(sv, "pv").select(F.col("pu").alias("src"), F.col("pv").alias("dst"), (F.col("total") / (F.col("nu") * F.col("nv"))).alias("sim"))
    return graph.contract(edges, parents, "max" if linkage == "single" else "sum")


class DagClustering:
    """Rounds over a similarity graph. ``parents[r]`` has (node, parent) of round r + 1."""

    def __init__(self, edges: DataFrame, rounds: int = 10, linkage: str = "average", max_parents: int = 5, max_neighbours: int = 100, thresholds: list[float] | None = None, lowest: float = -10000.0):
        if linkage not in LINKAGES:
            raise ValueError(f"linkage is one of {sorted(LINKAGES)}; complete linkage does not exist")
        if max_parents < 1:
            raise ValueError("max_parents is at least 1")
        self.spark, self.linkage, self.rounds = edges.sparkSession, linkage, rounds
        self.max_parents, self.max_neighbours, self.lowest = max_parents, max_neighbours, lowest
        self.thresholds = list(thresholds or []) or [float("-inf")] * rounds
        self.leaf_edges = materialize(ingest(edges), "dag-edges")
        ends = edges.select(F.col("src").cast("long").alias("node")).union(edges.select(F.col("dst").cast("long"))).distinct()
        self.nodes = materialize(ends, "dag-nodes")
        self.parents: list[DataFrame] = []
        self._members: list[DataFrame] = [self.nodes.select(F.col("node").alias("point"), "node")]
        self.active: list[int] = [self.nodes.count()]

    @property
    def members(self) -> list[DataFrame]:
        """(point, node) after each round, the points first; found when asked for, as only ``average`` needs them to cluster."""
        for p in self.parents[len(self._members) - 1 :]:
            met = self._members[-1].join(p, "node").select("point", F.col("parent").alias("node")).distinct()
            self._members.append(materialize(met, "dag-members"))
        return self._members

    def one_round(self, edges: DataFrame, nodes: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
        best = graph.best_neighbour(edges, counts if self.linkage == "approx_average" else None, threshold, self.lowest)
        return assign(materialize(propose(nodes, best), "proposed"), self.max_parents)

    def cluster(self) -> DagClustering:
        edges, nodes = self.leaf_edges, self.nodes
        counts = nodes.select("node", F.lit(1).cast("long").alias("n"))
        for r in range(self.rounds):
            if self.active[-1] <= 1:
                break
            if r:
                made = contract(edges, parents, self.linkage, self.members[r] if self.linkage == "average" else None, self.leaf_edges)
                edges = materialize(prune(made, self.max_neighbours), "dag-edges")
            parents = materialize(self.one_round(edges, nodes, counts, self.thresholds[min(r, len(self.thresholds) - 1)]), "dag-parents")
            counts = materialize(counts.join(parents, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n")), "dag-counts")
            nodes = counts.select("node")
            self.parents.append(parents)
            self.active.append(counts.count())
        return self

    def structure(self) -> DataFrame:
        """round, child, parent: a child of round r is node ``child`` after round r - 1."""
        rows = [p.select(F.lit(i + 1).alias("round"), F.col("node").alias("child"), "parent") for i, p in enumerate(self.parents)]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "round int, child long, parent long")

    def round(self, r: int) -> DataFrame:
        """node, point after round r; 0 are the points themselves."""
        return self.members[r].select("node", "point").distinct()

    def assignments(self) -> DataFrame:
        """point, node: every (round, node) with its points, nodes that are their parent's only child left out; nodes are numbered without gaps."""
        out = None
        for i, m in enumerate(self.members):
            one = m.select(F.lit(i).alias("round"), F.col("node").alias("cluster"), "point")
            if i + 1 < len(self.members):
                p = self.parents[i]
                lonely = p.join(p.groupBy("parent").agg(F.count("*").alias("kids")).where("kids = 1"), "parent", "left_semi")
                only = p.groupBy("node").agg(F.count("*").alias("all")).join(lonely.groupBy("node").agg(F.count("*").alias("alone")), "node").select(F.col("node").alias("cluster"))
                one = one.join(only, "cluster", "left_anti").select("round", "cluster", "point")
            out = one if out is None else out.unionByName(one)
        out = materialize(out.distinct(), "dag-assigned")
        return out.join(_numbered(out.select("round", "cluster").distinct()), ["round", "cluster"]).select("point", "node")


def _numbered(clusters: DataFrame) -> DataFrame:
    """round, cluster, node: 0, 1, ... in order. Ranges are numbered on their own, after what precedes each."""
    kept = materialize(clusters.repartitionByRange("round", "cluster").withColumn("_part", F.spark_partition_id()), "dag-ranges")
    counts = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}  # one row a range
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = clusters.sparkSession.createDataFrame(before, "_part int, _before long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("round", "cluster")) - 1
    return kept.join(F.broadcast(starts), "_part").select("round", "cluster", (rank + F.col("_before")).cast("long").alias("node"))
