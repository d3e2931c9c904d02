import random

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from tests import models
from vecloom.operators import agglomeration as agg
from vecloom.operators import dag, graph
from vecloom.operators.components import connected_components
from vecloom.sources.matrices import from_matrix


def random_edges(seed, n=30, m=70):
    rng = random.Random(seed)
    pairs = rng.sample([(u, v) for u in range(n) for v in range(u + 1, n)], m)
    return [(u, v, round(rng.random(), 2)) for u, v in pairs]


def frame(spark, edges):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src long, dst long, sim double, seq long")


def members(h, i):
    return {r["point"]: r["node"] for r in h.members[i].collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_upsert_last_write_wins(spark):
    e = frame(spark, [(0, 1, 0.9), (1, 0, 0.2), (2, 2, 0.5)])
    assert sorted(map(tuple, graph.upsert(e).collect())) == [(0, 1, 0.2), (1, 0, 0.2)]


def test_best_neighbour_ties_and_threshold(spark):
    e = graph.symmetrize_max(spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5), (3, 0, 0.5)], "src long, dst long, sim double"))
    assert {r["node"]: r["best"] for r in graph.best_neighbour(e, None, 0.4).collect()} == {0: 1, 1: 0, 2: 1, 3: 0}
    assert graph.best_neighbour(e, None, 0.5).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_agglomeration_equals_model(spark, seed):
    edges, thresholds = random_edges(seed), [0.9, 0.6, 0.3, 0.05, 0.0001]
    want = models.scc(range(33), edges, thresholds)
    local = agg.fit(frame(spark, edges), thresholds, n=33)
    for i, level in enumerate(want):
        assert members(local, i) == level
    if seed == 3:
        far = agg.fit(frame(spark, edges), thresholds[:3], n=33, local_edges=0, local_links=0)
        for i in range(4):
            assert members(far, i) == want[i]


def test_incremental_equals_batch(spark):
    edges, thresholds = random_edges(5), [0.8, 0.4, 0.1]
    want = models.scc(range(30), edges, thresholds)
    a = agg.Agglomerator(spark, thresholds)
    for part in range(3):
        a.add_edges(frame(spark, edges[part::3]), n=30)
        if part != 1:
            h = a.update()
    for i, level in enumerate(want):
        assert members(h, i) == level
    nodes = h.nodes()
    assert nodes.groupBy("level").agg(F.sum("n_points").alias("n")).where("n <> 30").isEmpty()
    assert h.roots().count() == len(set(want[-1].values())) and len(a.levels) == 4
    with pytest.raises(ValueError):
        agg.Agglomerator(spark, thresholds, "OTHER")


def test_agglomeration_sends_no_rows_through_python_workers(spark, monkeypatch):
    """Lists of rows are parallelized and unpickled by workers of executors; Arrow tables are not."""
    edges, sent = frame(spark, random_edges(5)), []
    parallelize = SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda sc, *a, **kw: sent.append(a) or parallelize(sc, *a, **kw))
    a = agg.Agglomerator(spark, [0.5, 0.2])
    for part in range(2):
        h = a.insert_batch(edges.where(F.col("seq") % 2 == part), 30)
    large = agg.fit(edges, [0.5, 0.2], 30, seq="seq", local_edges=0)
    assert members(h, 2) == members(large, 2) and not sent


def test_hierarchy_views(spark):
    edges = [(0, 1, 0.9), (2, 3, 0.9), (1, 2, 0.5)]
    h = agg.fit(frame(spark, edges), [0.8, 0.7, 0.1])
    assert sorted(map(tuple, h.children(3).collect())) == [(0, 0), (0, 2)]
    assert sorted((r["level"], r["child"]) for r in h.pruned_children(3).collect()) == [(1, 0), (1, 2)]
    assert sorted(r["point"] for r in h.descendants(1, 2).collect()) == [2, 3]


@pytest.mark.parametrize("linkage", sorted(dag.LINKAGES))
def test_dag_equals_model(spark, linkage):
    edges = random_edges(7, 24, 60)
    want = models.dag(edges, 3, linkage)
    got = dag.DagClustering(frame(spark, edges), 3, linkage).cluster()
    assert len(got.parents) == len(want)
    for p, level in zip(got.parents, want, strict=True):
        assert {(r["node"], r["parent"]) for r in p.collect()} == {(n, q) for n, qs in level.items() for q in qs}
    assert got.round(0).count() == 24 and got.structure().where("round = 1").count() == got.parents[0].count()
    ids = sorted({r["node"] for r in got.assignments().collect()})
    assert ids == list(range(len(ids)))


def test_dag_takes_no_step_that_nothing_reads(spark, monkeypatch):
    """Edges between parents serve the next round only, and members those who ask for them."""
    steps = []
    monkeypatch.setattr(dag, "materialize", lambda df, name, f=dag.materialize, **kw: steps.append(name) or f(df, name, **kw))
    edges = random_edges(7, 24, 60)
    got = dag.DagClustering(frame(spark, edges), 2, "single").cluster()
    assert got.structure().where("round = 2").count() == got.parents[1].count() > 0
    assert steps.count("dag-edges") == 2 and steps.count("dag-parents") == 2 and "dag-members" not in steps
    top = {(r["point"], r["node"]) for r in got.members[2].collect()}
    first, second = models.dag(edges, 2, "single")
    assert top == {(n, q) for n, ps in first.items() for p in ps for q in second[p]}
    assert len(got.members) == 3 and steps.count("dag-members") == 2


def test_dag_rejects(spark):
    e = frame(spark, [(0, 1, 0.5)])
    for bad in ({"linkage": "complete"}, {"max_parents": 0}):
        with pytest.raises(ValueError):
            dag.DagClustering(e, **bad)


def test_prune_takes_the_smaller_nodes_weight(spark):
    e = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.4), (0, 2, 0.5)], "src long, dst long, sim double")
    assert sorted(map(tuple, dag.prune(e, 1).collect())) == [(0, 1, 0.9), (1, 0, 0.9)]


def test_blobs_are_found(spark):
    rng = np.random.default_rng(123)
    means = rng.uniform(-10, 10, (5, 16))
    x = np.vstack([rng.normal(size=(12, 16)) * 0.3 + m for m in means])
    v = from_matrix(spark, x)
    e = graph.symmetrize_max(graph.knn_graph(v, 5))
    h = agg.fit(e, [0.9, 0.8, 0.7, 0.5, 0.2, 0.1])
    levels = [members(h, i) for i in range(7)]
    assert any(len(set(lv.values())) == 5 and all(len({lv[i] for i in range(12 * b, 12 * b + 12)}) == 1 for b in range(5)) for lv in levels)
