import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.operators import sampling, tree
from vecloom.sources.matrices import from_matrix
from vecloom.streaming.incremental import StreamingClusters, cluster_stream, windowed_counts


@pytest.fixture(scope="module")
def grown(spark):
    x = np.random.default_rng(4).normal(size=(60, 4))
    v = from_matrix(spark, x)
    return x, v, tree.build(v, heads=24).cache()


def test_tree_invariants(spark, grown):
    x, _, t = grown
    assert t.count() == 60 and tree.test_covering(t) and tree.test_nesting(t) and tree.root_of(t).count() == 1
    parent = {r["uid"]: r["parent"] for r in t.collect()}
    want = dict.fromkeys(parent, 0)
    for u in parent:
        p = u
        while p is not None:
            want[p] += 1
            p = parent[p]
    assert {r["uid"]: r["num_desc"] for r in tree.descendant_counts(t).collect()} == want
    stats = tree.level_stats(t).collect()
    assert sum(r["n"] for r in stats) == 60 == sum(r["n"] for r in tree.degree_stats(t).collect())
    assert tree.spread_out(t, 5).count() >= 5 and tree.spread_out(t, 61).count() == 0
    root = tree.root_of(t).first()["uid"]
    far = {r["uid"]: r["maxdist"] for r in tree.exact_radii(t).collect()}
    assert far[root] == pytest.approx(np.sqrt(((x - x[root]) ** 2).sum(1)).max(), rel=1e-5)
    assert tree.children_of(t, root).count() > 0 and tree.display(t, 3).count("\n") == 2
    broken = t.withColumn("embedding", F.when(F.col("parent").isNull(), F.col("embedding")).otherwise(F.transform("embedding", lambda v: v + 100)))
    assert not tree.test_covering(broken)


def test_groups_grow_below_the_heads(spark, monkeypatch):
    """Far more vectors than heads, a third of them near copies and some exact ones: siblings stay apart."""
    monkeypatch.setattr(tree, "SPLIT", 50)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 3)), 5 + 1e-4 * rng.normal(size=(200, 3)), np.full((30, 3), 7.0)])
    t = tree.build(from_matrix(spark, x), heads=16, fan=8)
    assert tree.test_covering(t) and tree.test_nesting(t)
    rows = {r["uid"]: r for r in t.collect()}
    assert sorted(rows) == list(range(len(x))) and sum(r["level"] == tree.COPY for r in rows.values()) == 29
    children = {}
    for r in rows.values():
        children.setdefault(r["parent"], []).append(r)
    for group in children.values():
        group = [r for r in group if r["level"] > tree.COPY]
        for i, a in enumerate(group):
            for b in group[:i]:
                assert np.linalg.norm(x[a["uid"]] - x[b["uid"]]) > 1.3 ** min(a["level"], b["level"]) * (1 - 1e-6)
    # The near copies nest: they do not hang side by side under one head.
    assert max(sum(400 <= r["uid"] < 600 for r in g) for p, g in children.items() if p is not None) < 100


def test_large_groups_grow_in_blocks_as_in_one_task(spark, monkeypatch):
    """Neither the size of a group nor blocks change a node: all are where one pass over the whole group puts them."""
    monkeypatch.setattr(tree, "SPLIT", 70)
    monkeypatch.setattr(tree, "TILE", 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), x[:40] / np.linalg.norm(x[:40], axis=1, keepdims=True) + np.float32(1e-3), x[:9] * 0 + np.float32(0.1)])
    whole = {r["uid"]: (r["parent"], r["level"], r["dist"]) for r in tree.build(from_matrix(spark, x), heads=1000).collect()}
    group, few = ({r["uid"]: (r["parent"], r["level"], r["dist"]) for r in tree.build(from_matrix(spark, x), heads=1, fan=fan).collect()} for fan in (8, 1000))
    assert whole == group == few and len(group) == len(x)
    assert sum(level == tree.COPY for _, level, _ in group.values()) == 8


def test_one_flat_group_takes_no_round_a_fan(spark, monkeypatch):
    """Vectors that only the root covers: the steps do not grow with the group's size over the fan."""
    steps = []
    monkeypatch.setattr(tree, "materialize", lambda df, name, f=tree.materialize, **kw: steps.append(name) or f(df, name, **kw))
    x = np.random.default_rng(5).normal(size=(200, 64))
    for n in (100, 200):
        tree.build(from_matrix(spark, x[:n] / np.linalg.norm(x[:n], axis=1, keepdims=True)), heads=2, fan=8)
    assert steps[: len(steps) // 2] == steps[len(steps) // 2 :] and len(steps) <= 20


def test_rebuild_level(spark, grown):
    _, v, t = grown
    moved = v.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 4).cast("float")))
    level = t.agg(F.max("level")).first()[0]
    new = tree.rebuild_level(t, moved, level)
    assert new.count() == 60 and tree.test_covering(new) and tree.test_nesting(new)
    assert tree.root_of(new).first()["uid"] == tree.root_of(t).first()["uid"]
    with pytest.raises(ValueError):
        tree.rebuild_level(t, moved, -1000, most=5)


def test_tree_of_few(spark):
    assert tree.build(from_matrix(spark, np.zeros((3, 2)))).count() == 3
    assert tree.build(from_matrix(spark, np.zeros((3, 2))).limit(0)).count() == 0


def test_similarity_sample_law(spark):
    x = np.array([[0.0], [1.0], [2.0]])
    q = from_matrix(spark, np.array([[1.0]]))
    rows = sampling.similarity_sample(q, from_matrix(spark, x), 3000, seed=5, block_bytes=16).collect()
    p = np.exp(x.ravel())
    p /= p.sum()
    n = np.bincount([r["n"] for r in rows], minlength=3)
    assert ((n - 3000 * p) ** 2 / (3000 * p)).sum() < 13.8  # 0.001 of chi-square with two degrees
    assert all(r["prob"] == pytest.approx(p[r["n"]]) for r in rows)


def test_similarity_sample_over_strata(spark):
    """The law holds over several strata and blocks, no hash is taken for each row, and the partitioning decides nothing."""
    x = np.random.default_rng(3).normal(size=(2500, 2)).astype(np.float32)
    index, q = from_matrix(spark, x), from_matrix(spark, np.array([[0.5, -1.0]]))
    hashed = []
    keep, sampling._hash01 = sampling._hash01, lambda seed, qid, n, draw: hashed.append(np.size(n)) or keep(seed, qid, n, draw)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([[0.5, -1.0]])], ["id", "v"])
        list(sampling._drawn(4, 5, 0, np.arange(2500), x.astype(float), [batch]))
    finally:
        sampling._hash01 = keep
    assert sum(hashed) < 100
    rows = sampling.similarity_sample(q, index, 4000, seed=5, block_bytes=8 * 2 * 2048).collect()
    again = sampling.similarity_sample(q, index.repartition(7), 4000, seed=5, block_bytes=8 * 2 * 2048).collect()
    assert sorted((r["draw"], r["n"]) for r in rows) == sorted((r["draw"], r["n"]) for r in again)
    p = np.exp(x.astype(float) @ np.array([0.5, -1.0]))
    p /= p.sum()
    assert all(r["prob"] == pytest.approx(p[r["n"]]) for r in rows)
    part = np.argsort(np.argsort(-p)) * 10 // len(p)  # tenths of the rows by probability
    got, want = np.bincount(part[[r["n"] for r in rows]], minlength=10), 4000 * np.bincount(part, p)
    assert ((got - want) ** 2 / want).sum() < 27.9  # 0.001 of chi-square with nine degrees


def test_random_descendant_is_uniform(spark):
    rows = [(0, None, 3, 0.0, [0.0])] + [(i, 0, 2, 1.0, [1.0]) for i in range(1, 5)]
    t = spark.createDataFrame(rows, tree.TREE)
    n = np.bincount([sampling.random_descendant(t, seed).where("uid = 0").first()["descendant"] for seed in range(40)], minlength=5)
    assert (n > 0).all()


def test_cluster_and_chain_samples(spark, grown):
    _, v, t = grown
    level = t.agg(F.max("level")).first()[0] - 2
    q = v.where("vec_id < 5")
    assert sampling.repeated_cluster_sample(q, t, 3, level, repeats=2).groupBy("q", "repeat").count().where("count > 3").isEmpty()
    chain = sampling.chain_sample(q, t, 3, level, chains=2, length=3)
    assert chain.count() == 10 and chain.where("n IS NULL").isEmpty()
    assert sorted(map(tuple, chain.collect())) == sorted(map(tuple, sampling.chain_sample(q, t, 3, level, chains=2, length=3).collect()))


def test_repeats_share_the_search_and_the_closure(spark, grown, monkeypatch):
    """One search of heads and one closure for all repeats or steps; each repeat is what its own seed gives alone."""
    _, v, t = grown
    level = t.agg(F.max("level")).first()[0] - 2
    q = v.where("vec_id < 5")
    alone = [(r["q"], i, r["n"], r["dist"], r["rank"]) for i in range(3) for r in sampling.cluster_sample(q, t, 3, level, seed=4 + i).collect()]
    asked = []
    monkeypatch.setattr(sampling.knn, "knn", lambda *a, f=sampling.knn.knn, **kw: asked.append("search") or f(*a, **kw))
    monkeypatch.setattr(tree, "closure", lambda t, f=tree.closure: asked.append("closure") or f(t))
    rows = sampling.repeated_cluster_sample(q, t, 3, level, repeats=3, seed=4).collect()
    assert sorted(asked) == ["closure", "search"]
    assert sorted(map(tuple, rows)) == sorted(alone)
    sampling.chain_sample(q, t, 3, level, chains=2, length=3).collect()
    assert asked.count("closure") == 2
    with pytest.raises(ValueError):
        sampling.repeated_cluster_sample(q, t, 3, level, repeats=0)


def test_stream_of_vectors(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(24, 6))
    v = from_matrix(spark, x)
    for i in range(3):
        v.where(F.col("vec_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    c = StreamingClusters(spark, 4, [0.9, 0.5, -math.inf])
    cluster_stream(stream, c, str(tmp_path / "state")).awaitTermination()
    h = c.clusters.hierarchy
    assert len(c.index) == 24 and h.members[0].count() == 24
    again = StreamingClusters(spark, 4, [0.9, 0.5, -math.inf])
    again.partial_fit(v.where("vec_id = 0"))  # one vector waits
    assert again.index is None
    again.add_edges(v.where("vec_id > 0"))
    assert again.update_on_edges().roots().count() >= 1
    sink = c.sink()
    c.done.add(77)
    sink(v, 77)
    assert len(c.index) == 24


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(25, 6))
    v = from_matrix(spark, x)
    arrive = lambda i: v.where("vec_id = 0" if i == 0 else f"vec_id > 0 AND vec_id % 3 = {i - 1}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))

    def run(state):
        c = StreamingClusters(spark, 4, [0.9, 0.5, -math.inf])
        stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        cluster_stream(stream, c, str(tmp_path / state)).awaitTermination()
        return c

    members = lambda c: sorted(map(tuple, c.clusters.hierarchy.membership().collect()))
    for i in range(4):
        arrive(i)
        c = run("often")  # a new process each time; the first batch is one vector, which waits
        assert (c.waiting is not None) == (i == 0)
    whole = run("once")
    assert len(c.index) == len(whole.index) == 25 and members(c) == members(whole)
    assert members(run("often")) == members(whole)  # nothing new arrived


def test_windows(spark):
    e = spark.sql("SELECT timestamp '2024-01-01 01:00:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp '2024-01-01 23:00:00', 'a', 3.0D")
    assert [(r["n"], r["total"]) for r in windowed_counts(e).collect()] == [(2, 5.0)]
