import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from vecloom.functions import vectors as vx
from vecloom.operators import index, knn
from vecloom.plans import catalog
from vecloom.session import read_once
from vecloom.sources.matrices import from_coo, from_matrix, to_coo


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(123)
    means = rng.uniform(-10, 10, (5, 16))
    x = np.vstack([rng.normal(size=(20, 16)) + m for m in means])
    rng.shuffle(x)
    return x.astype(np.float32), from_matrix(spark, x).cache()


def brute(x, q, k, metric):
    x, q = x.astype(float), q.astype(float)
    out = []
    for v in q:
        s = np.sqrt(((x - v) ** 2).sum(1)) if metric == "l2" else x @ v
        out.append([int(i) for i in np.lexsort((np.arange(len(x)), s if metric == "l2" else -s))[:k]])
    return out


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 0.0])], "vec_id long, a array<double>, b array<double>")
    r = df.select(vx.norm("a").alias("n"), vx.unit_norm("b").alias("z"), vx.l2("a", "b").alias("d"), vx.dot("a", "a").alias("p"), vx.exp_neg_dot("b", "a").alias("e"), vx.cosine("a", "b").alias("c"), vx.level_of(F.lit(1.69)).alias("level"), vx.noisy("a", 1e-6, 3).alias("noisy"), vx.noisy("a", 1e-6, 3).alias("again")).first()
    assert (r["n"], r["z"], r["d"], r["p"], r["e"], r["c"]) == (5.0, [0.0, 0.0], 5.0, 25.0, 1.0, 0.0)
    assert r["level"] == 2 and r["noisy"] == r["again"] and 0 < abs(r["noisy"][0] - 3) < 1e-4


def test_lengthened_rejects_longer(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert df.select(vx.norm(vx.lengthened("v", 36.0)).alias("n")).first()["n"] == pytest.approx(6.0)
    with pytest.raises(Exception, match="longer"):
        df.select(vx.lengthened("v", 16.0)).collect()


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_knn_is_exact_in_any_blocks(spark, blobs, metric):
    x, df = blobs
    want = brute(x, x, 7, metric)
    for block_bytes in (1 << 25, 16 * 8 * 13):
        got = knn.knn(df, df, 7, metric, block_bytes=block_bytes).orderBy("q", "rank").collect()
        assert [r["n"] for r in got] == [n for row in want for n in row]


def test_knn_edges(spark):
    x = np.array([[0, 0], [1, 0], [1, 0], [0, 2]], np.float32)
    df = from_matrix(spark, x)
    got = {(r["q"], r["rank"]): r["n"] for r in knn.knn(df, df, 9, "l2").collect()}
    assert got[2, 1] == 2 and got[2, 2] == 1 and got[1, 1] == 1 and got[0, 2] == 1 and (0, 4) in got and (0, 5) not in got
    assert knn.knn(df, df.limit(0), 3).count() == 0
    assert knn.knn(df.limit(0), df, 3).count() == 0
    with pytest.raises(ValueError, match="components"):
        knn.knn(df, spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        knn.knn(df, df, 0)
    far = {r["q"]: r["n"] for r in knn.furthest(df, df).collect()}
    assert far == {0: 3, 1: 3, 2: 3, 3: 1}


def test_knn_sql_over_any_index_size(spark, blobs):
    x, df = blobs
    got = knn.knn_sql(df.where("vec_id < 9"), df, 7, "l2", limit=30).orderBy("q", "rank").collect()
    assert [r["n"] for r in got] == [n for row in brute(x, x[:9], 7, "l2") for n in row]


def test_range_is_strict(spark):
    df = from_matrix(spark, np.array([[0.0], [1.0], [3.0]]))
    got = {(r["q"], r["n"]) for r in knn.range_join(df, df, 2.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)}
    assert knn.range_join(df, df, 0.0).count() == 0


def test_distance_reductions_agree(spark, blobs):
    _, df = blobs
    for by_distance, metric in ((index.mips_by_distance, "dot"), (index.mcss_by_distance, "cosine")):
        a = by_distance(df, df, 4).orderBy("q", "rank").collect()
        b = knn.knn(df, df, 4, metric).orderBy("q", "rank").collect()
        assert [(r["q"], r["n"]) for r in a] == [(r["q"], r["n"]) for r in b]
        assert max(abs(x["score"] - y["score"]) for x, y in zip(a, b, strict=True)) < 1e-6


def test_cells_recall(spark, blobs):
    _, df = blobs
    for metric in ("l2", "dot", "exp_neg_dot"):
        exact = {(r["q"], r["n"]) for r in knn.knn(df, df, 5, metric).collect()}
        near = {(r["q"], r["n"]) for r in knn.knn_cells(df, df, 5, metric, cells=10, beam=4).collect()}
        assert len(exact & near) / len(exact) >= 0.9


def test_beam_under_dissimilarity(spark, blobs):
    """A beam over all cells gives the exact answer, on the index's second matrix; a narrow one sees fewer rows."""
    _, df = blobs
    two = index.VectorIndex(df.select("vec_id", "embedding").withColumn("embedding_proj", F.reverse("embedding")), "exp_neg_dot", cells=10)
    rows = lambda found: [(r["q"], r["n"], r["rank"]) for r in found.orderBy("q", "rank").collect()]
    exact = rows(two.knn(df, 4))
    assert rows(two.knn(df, 4, beam=10)) == exact != rows(two.knn(df, 4, beam=1))


def test_registered_cells_recall(spark):
    at = "/root/testdata/sf0.01"
    exact = {(r["q"], r["n"]) for r in catalog.QUERIES["knn_cosine"](spark, at).where("q <> n").collect()}
    near = {(r["q"], r["n"]) for r in catalog.QUERIES["knn_cells"](spark, at).collect()}
    recall = len(exact & near) / len(exact)
    print(f"recall without self {recall:.3f}")
    assert recall >= 0.9


def test_index_lifecycle(spark, blobs, tmp_path):
    x, df = blobs
    i = index.VectorIndex(df.where("vec_id < 50"), "l2")
    assert len(i) == 50 and i.insert(df.where("vec_id >= 40")) and len(i) == 100 and not i.insert(df)
    assert i.remove(df.where("vec_id < 10").select("vec_id")) == 10
    moved = df.where("vec_id = 99").withColumn("embedding", F.transform("embedding", lambda v: v * 0))
    i.update(moved)
    i.set_properties(df.select("vec_id", F.lit("x").alias("tag")))
    i.save(str(tmp_path / "index"))
    back = index.VectorIndex.load(spark, str(tmp_path / "index"))
    assert len(back) == 90 and "tag" in back.vectors.columns
    zero = from_matrix(spark, np.zeros((1, 16)), np.array([500]))
    assert [r["n"] for r in back.nearest(zero).collect()] == [99]
    assert back.knn(zero, 2, return_points=True).where("rank = 1").first()["point"] == [0.0] * 16
    with pytest.raises(NotImplementedError):
        index.VectorIndex(df, "dot").range(df)
    assert len(index.VectorIndex(df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1000)), dedup=True)) == 100


def test_coo_round_trip(spark):
    e = from_coo(spark, [0, 1], [1, 2], [0.5, 0.25])
    assert [a.tolist() for a in to_coo(e.orderBy("seq"))] == [[0, 1], [1, 2], [0.5, 0.25]]


def test_tiles_agree_with_double_precision(spark):
    """Near copies, common offsets, copies beyond k and queries without their own row among the k + 1 first copies."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[300:600] = x[5]
    x[600:700] = x[7] + rng.normal(size=(100, 8)) * 1e-9
    for shift in (0.0, 3000.0):
        y = x + shift
        df = from_matrix(spark, y).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        held = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
        for metric, down in (("l2", False), ("dot", True)):
            for self_too in (True, False):
                got = {}
                for r in knn.knn(df, df, 4, metric, include_self=self_too, block_bytes=8 * 8 * 400).collect():
                    got[r["q"], r["rank"]] = r["n"]
                for q in (0, 5, 7, 305, 450, 599, 650, 899):
                    s = knn.exact(metric, held[q], held)
                    n = np.arange(900)
                    order = np.lexsort((n, n != q, -s if down else s))
                    want = order[:4] if self_too else order[order != q][:4]
                    assert [got[q, k] for k in range(1, 5)] == want.tolist()


def test_search_memory_is_of_a_tile():
    """A task's arrays do not grow with the block times a batch of queries."""
    x = np.random.default_rng(2).normal(size=(30_000, 8))
    ids, none = np.arange(len(x)), np.empty(0, int)
    batch = pa.RecordBatch.from_arrays([pa.array(ids[:600]), pa.array(list(x[:600]))], ["id", "v"])
    tracemalloc.start()
    found = list(knn._best_rows("l2", 5, 1, True, (ids, x, np.zeros(len(x), np.int32), none, x[:0], none), None, [batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 3000 and peak < 60e6  # 256 x 30,000 doubles, three times, were 184 MB


def test_a_block_reaches_tasks_in_small_parts(spark, monkeypatch):
    """No broadcast of a full block, which each worker of an executor would hold."""
    x = np.random.default_rng(3).normal(size=(20_000, 64)).astype(np.float32)
    df, sizes, send = from_matrix(spark, x), [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sizes.append(sum(a.nbytes for a in value)) or send(sc, value))
    few = df.where("vec_id % 2500 = 0")
    got = {r["q"]: r["n"] for r in knn.knn(few, df, 1, "l2", include_self=False).collect()}
    assert sum(sizes) > 10e6 and max(sizes) < 5e6
    d2 = ((x[::2500, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    d2[np.arange(8), np.arange(0, 20_000, 2500)] = np.inf
    assert got == dict(zip(range(0, 20_000, 2500), d2.argmin(axis=1).tolist(), strict=True))
    sizes.clear()
    assert knn.range_join(few, df, 1e-6).count() == 8 and max(sizes) < 5e6


def test_parts_are_not_kept_by_workers(spark):
    held = spark.sparkContext.broadcast(np.arange(1000))

    def work(batches):
        for b in batches:
            total = read_once(held).sum() + read_once(held).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total] * b.num_rows), pa.array([hasattr(held, "_value")] * b.num_rows)], ["total", "kept"])

    assert set(map(tuple, spark.range(4).mapInArrow(work, "total long, kept boolean").collect())) == {(999_000, False)}


def test_searches_agree_in_any_parts(spark, monkeypatch):
    """Copies beyond k in parts of their own, cells over the edges of parts, ranges."""
    x = np.random.default_rng(6).normal(size=(700, 8)).astype(np.float32)
    x[200:500] = x[3]
    df, got = from_matrix(spark, x), {}
    for part_bytes in (knn.PART_BYTES, 8 * 8 * 37):
        monkeypatch.setattr(knn, "PART_BYTES", part_bytes)
        for metric in ("l2", "cosine", "exp_neg_dot"):
            for self_too in (True, False):
                got.setdefault((metric, self_too), []).append(sorted(map(tuple, knn.knn(df, df, 4, metric, include_self=self_too).collect())))
        got.setdefault("furthest", []).append(sorted(map(tuple, knn.furthest(df, df).collect())))
        got.setdefault("cells", []).append(sorted(map(tuple, knn.knn_cells(df, df, 4, cells=9, beam=3).collect())))
        got.setdefault("range", []).append(sorted(map(tuple, knn.range_join(df, df, 2.0).collect())))
    for one, other in got.values():
        assert one == other and len(one) >= 700


@pytest.mark.parametrize("search", [lambda df: knn.knn_sql(df, df, 3, "l2"), lambda df: knn.knn_cells(df, df, 3, "l2", cells=5, beam=3)])
def test_no_plan_joins_all_pairs(spark, blobs, search):
    plan = search(blobs[1])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "cell#" not in plan


def test_range_leaves_no_copy_of_its_pairs(spark, blobs):
    """Pairs of a range, as many as the square of a dense group, go straight to the reader, and only once."""
    _, df = blobs
    written = []
    knn_materialize, knn.materialize = knn.materialize, lambda table, name: written.append(name) or knn_materialize(table, name)
    try:
        found = knn.range_join(df, df, 7.0, block_bytes=16 * 8 * 30)
    finally:
        knn.materialize = knn_materialize
    assert set(written) <= {"queries"} and found.count() == found.distinct().count() > 100
