"""Round-based agglomeration of a similarity graph: per threshold, best neighbours, components, contraction.

A round links every cluster to its best neighbour when their average similarity is strictly over the
round's threshold; connected clusters become one, named by its smallest point. There is one level
more than thresholds. Rounds whose threshold no edge exceeds repeat the level before without a job.

Best-neighbour links are at most one a node. While they are at most ``local_links`` they are joined by
union-find on the driver; beyond, by distributed star contraction. A graph of at most ``local_edges``
pairs (the count is checked) runs all its rounds in arrays on the driver, where a round takes
milliseconds and not a dozen jobs; both ways give the same hierarchy.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import graph
from vecloom.operators.components import connected_components
from vecloom.session import local_table, materialize

LOCAL_LINKS = 100_000
LOCAL_EDGES = 200_000
STRATEGIES = ("JUST_SIB", "MY_BEST_NEIGHBOR", "ALL_BEST_NEIGHBORS")


def components_of(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) of best-neighbour links (node, best); by size either on the driver or in Spark."""
    spark = links.sparkSession
    if links.count() > local_links:
        return connected_components(links, "node", "best")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in links.select("node", "best").collect():
        a, b = find(r[0]), find(r[1])
        parent[max(a, b)] = min(a, b)
    return local_table(spark, "node long, component long", (list(parent), [find(n) for n in parent]))


@dataclass
class Hierarchy:
    """Levels 0 (points) to R: ``parents[i]`` maps the changed nodes of level i to level i + 1."""

    points: DataFrame
    thresholds: list[float]
    members: list[DataFrame] = field(default_factory=list)  # (point, node) of each level
    changed: list[bool] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)

    @property
    def top(self) -> int:
        return len(self.members) - 1

    def level(self, i: int) -> DataFrame:
        """node, n_points of level i."""
        return self.members[i].groupBy("node").agg(F.count("*").alias("n_points"))

    def roots(self) -> DataFrame:
        return self.level(self.top)

    def membership(self) -> DataFrame:
        """level, node, point for all levels."""
        out = None
        for i, m in enumerate(self.members):
            one = m.select(F.lit(i).alias("level"), "node", "point")
            out = one if out is None else out.unionByName(one)
        return out

    def nodes(self) -> DataFrame:
        """level, node, parent, n_points: one row for each node of each level; the top has no parents."""
        out = None
        for i, m in enumerate(self.members):
            up = self.members[i + 1].select("point", F.col("node").alias("parent")) if i < self.top else m.select("point", F.lit(None).cast("long").alias("parent"))
            one = m.join(up, "point").groupBy("node").agg(F.min("parent").alias("parent"), F.count("*").alias("n_points")).select(F.lit(i).alias("level"), "node", "parent", "n_points")
            out = one if out is None else out.unionByName(one)
        return out

    def children(self, level: int) -> DataFrame:
        """parent, child: nodes of ``level`` with their nodes one level down."""
        return self.members[level].select("point", F.col("node").alias("parent")).join(self.members[level - 1].select("point", F.col("node").alias("child")), "point").select("parent", "child").distinct()

    def pruned_children(self, level: int) -> DataFrame:
        """parent, level, child: chains of single children are skipped down to where a node divides or is a point.

        Clusters are named by their smallest point, so a chain keeps its name: the child is listed at
        the highest level below ``level`` at which it has at least two children itself, else at 0.
        """
        kids = self.children(level).withColumn("size", F.lit(0))
        sizes = None
        for i in range(1, level):
            one = self.children(i).groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("kids")).where("kids > 1").select("child", F.lit(i).alias("at"))
            sizes = one if sizes is None else sizes.unionByName(one)
        if sizes is None:
            return kids.select("parent", F.lit(0).alias("level"), "child")
        last = sizes.groupBy("child").agg(F.max("at").alias("at"))
        return kids.join(last, "child", "left").select("parent", F.coalesce("at", F.lit(0)).alias("level"), "child")

    def descendants(self, level: int, node: int) -> DataFrame:
        return self.members[level].where(F.col("node") == node).select("point")


def all_points(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Points 0 to n - 1 where n is given, and every endpoint."""
    ends = edges.select(F.col("src").cast("long").alias("point")).union(edges.select(F.col("dst").cast("long")))
    if n is not None:
        ends = ends.union(edges.sparkSession.range(n).toDF("point"))
    return ends.distinct()


def array_rounds(points: np.ndarray, u: np.ndarray, v: np.ndarray, sim: np.ndarray, thresholds: list[float]) -> list[np.ndarray]:
    """The node of every point (sorted ids) at each level; (u, v, sim) are canonical pairs, u < v."""
    u, v = np.searchsorted(points, u), np.searchsorted(points, v)  # positions order like ids
    node = np.arange(len(points))
    size = np.ones(len(points), np.int64)
    levels = [points[node]]
    best = score = None
    for t in thresholds:
        if best is None:
            a, b = np.concatenate((u, v)), np.concatenate((v, u))
            s = np.tile(sim / (size[u] * size[v]), 2)
            order = np.lexsort((b, -s, a))
            first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
            best, score = (a[first], b[first]), s[first]
        link = (score > t) & (score > -10000.0)
        if link.any():
            parent = np.arange(len(points))
            for x, y in zip(best[0][link].tolist(), best[1][link].tolist(), strict=True):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                parent[max(x, y)] = min(x, y)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            node = parent[node]
            size = np.bincount(node, minlength=len(points))
            lo, hi = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
            out = lo != hi
            pair, at = np.unique(lo[out] * len(points) + hi[out], return_inverse=True)
            sim = np.bincount(at, weights=sim[out], minlength=len(pair))
            u, v = np.divmod(pair, len(points))
            best = None
        levels.append(points[node])
    return levels


def _fit_arrays(points: DataFrame, level_edges: DataFrame, thresholds: list[float]) -> Hierarchy:
    spark = points.sparkSession
    ids = np.sort(points.toPandas()["point"].to_numpy(np.int64))
    pairs = level_edges.where("src < dst").orderBy("src", "dst").toPandas()
    began = time.time()
    levels = array_rounds(ids, pairs["src"].to_numpy(np.int64), pairs["dst"].to_numpy(np.int64), pairs["sim"].to_numpy(float), thresholds)
    changed = [i > 0 and bool((levels[i] != levels[i - 1]).any()) for i in range(len(levels))]
    held = [0] + [0] * len(thresholds)
    for i in range(1, len(levels)):
        held[i] = i if changed[i] else held[i - 1]
    own = sorted(set(held))
    columns = np.repeat(np.array(own, np.int32), len(ids)), np.tile(ids, len(own)), np.concatenate([levels[i] for i in own])
    table = materialize(local_table(spark, "held int, point long, node long", columns), "members")
    members = [table.where(F.col("held") == h).select("point", "node") for h in held]
    return Hierarchy(points, thresholds, members, changed, [{"threshold": t, "changed": c, "seconds": time.time() - began} for t, c in zip(thresholds, changed[1:], strict=True)])


def fit(
    edges: DataFrame, thresholds: list[float], n: int | None = None, points: DataFrame | None = None, seq: str | None = None,
    local_links: int = LOCAL_LINKS, local_edges: int = LOCAL_EDGES,
) -> Hierarchy:
    """The whole hierarchy of (src, dst, sim) edges; ``seq`` orders conflicting writes of one edge."""
    began = time.time()
    if seq is None:
        edges, seq = edges.withColumn("seq", F.lit(0)), "seq"
    points = materialize(points if points is not None else all_points(edges, n), "points")
    level_edges = materialize(graph.upsert(edges, seq), "edges")
    if level_edges.count() <= 2 * local_edges and points.count() <= 2 * local_edges:
        return _fit_arrays(points, level_edges, list(map(float, thresholds)))
    member = materialize(points.select("point", F.col("point").alias("node")), "members")
    out = Hierarchy(points, list(map(float, thresholds)), [member], [False])
    counts = materialize(points.select(F.col("point").alias("node"), F.lit(1).cast("long").alias("n")), "counts")
    scored, high = None, None
    for t in out.thresholds:
        if scored is None:
            cu, cv = counts.select(F.col("node").alias("src"), F.col("n").alias("cu")), counts.select(F.col("node").alias("dst"), F.col("n").alias("cv"))
            met = level_edges.join(cu, "src").join(cv, "dst").select("src", "dst", (F.col("sim") / (F.col("cu") * F.col("cv"))).alias("sim"))
            # A round under any threshold uses best neighbours only, and those do not depend on it.
            scored = materialize(graph.best_neighbour(met, None, float("-inf")), "best")  # over the lowest score at any rate
            high = scored.agg(F.max("score")).first()[0]
        if high is None or not high > t:
            out.members.append(member)
            out.changed.append(False)
            out.metrics.append({"threshold": t, "links": 0, "seconds": time.time() - began})
            continue
        links = scored.where(F.col("score") > t)
        comp = components_of(links, local_links)
        parents = materialize(counts.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("parent"), "n"), "parents")
        member = materialize(member.join(parents.select("node", "parent"), "node").select("point", F.col("parent").alias("node")), "members")
        pair = level_edges.where("src < dst")
        inner = graph.contract(graph.both_ways(pair.select(F.col("src").alias("u"), F.col("dst").alias("v"), "sim")), parents)
        # Sum the canonical direction once and mirror it, so that both directions are the same number.
        level_edges = materialize(graph.both_ways(inner.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "sim")), "edges")
        counts = materialize(parents.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n")), "counts")
        scored = None
        out.members.append(member)
        out.changed.append(True)
        out.metrics.append({"threshold": t, "links": links.count(), "seconds": time.time() - began})
    return out


class Agglomerator:
    """The hierarchy of all edges seen so far. Any split into batches gives what one batch gives.

    Updates refit only the components of the edge graph that a new edge touches; levels of the others
    cannot change. ``marking_strategy`` is accepted for compatibility and does not alter the result.
    """

    def __init__(self, spark: SparkSession, thresholds: list[float], marking_strategy: str = "JUST_SIB", local_links: int = LOCAL_LINKS):
        if marking_strategy not in STRATEGIES:
            raise ValueError(f"marking_strategy is one of {STRATEGIES}")
        self.spark, self.thresholds, self.local_links = spark, list(map(float, thresholds)), local_links
        self.edges = local_table(spark, "src long, dst long, sim double, seq long")
        self.extra = local_table(spark, "point long")
        self.pending: DataFrame | None = None
        self.clock = 0
        self.hierarchy: Hierarchy | None = None
        self.timers: dict[str, float] = {}

    def add_edges(self, edges: DataFrame, n: int | None = None) -> None:
        """Take edges in without refitting; ``n`` registers points 0 to n - 1."""
        began = time.time()
        batch = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("sim").cast("double").alias("sim"), F.lit(self.clock).cast("long").alias("seq")), "delta")
        self.clock += 1
        self.edges = materialize(self.edges.unionByName(batch), "all-edges")
        ends = all_points(batch, n)
        self.extra = materialize(self.extra.union(ends).distinct(), "all-points")
        self.pending = ends if self.pending is None else self.pending.union(ends)
        self.timers["add_edges"] = self.timers.get("add_edges", 0.0) + time.time() - began

    def update(self) -> Hierarchy:
        """Refit what pending edges touch."""
        began = time.time()
        if self.hierarchy is None:
            self.hierarchy = fit(self.edges, self.thresholds, points=self.extra, seq="seq", local_links=self.local_links)
        elif self.pending is not None:
            comp = materialize(connected_components(self.edges, "src", "dst"), "touched")
            dirty = comp.join(self.pending.distinct().withColumnRenamed("point", "node"), "node", "left_semi").select("component").distinct()
            inside = materialize(comp.join(dirty, "component", "left_semi").select(F.col("node").alias("point")).union(self.pending).distinct(), "inside")
            part = fit(self.edges.join(inside.withColumnRenamed("point", "src"), "src", "left_semi"), self.thresholds, points=inside, seq="seq", local_links=self.local_links)
            old = self.hierarchy.members
            members = [materialize(o.join(inside, "point", "left_anti").unionByName(p), "members") for o, p in zip(old, part.members, strict=True)]
            self.hierarchy = Hierarchy(self.extra, self.thresholds, members, part.changed, self.hierarchy.metrics + part.metrics)
        self.pending = None
        self.timers["update"] = self.timers.get("update", 0.0) + time.time() - began
        return self.hierarchy

    def insert_batch(self, edges: DataFrame, n: int | None = None) -> Hierarchy:
        self.add_edges(edges, n)
        return self.update()

    def fit_large_batch(self, n: int, edges: DataFrame) -> Hierarchy:
        return self.insert_batch(edges, n)

    @property
    def levels(self) -> list[DataFrame]:
        return [self.hierarchy.level(i) for i in range(self.hierarchy.top + 1)]
