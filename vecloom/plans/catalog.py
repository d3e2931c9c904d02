"""Every query of the library with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as vx
from vecloom.operators import aggregates, dag, graph, index, knn, sampling, tree
from vecloom.operators import agglomeration as agg
from vecloom.operators.components import connected_components
from vecloom.session import fresh_path, materialize
from vecloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The first round thresholds of the agglomeration queries.
THRESHOLDS = [0.4, 0.35, 0.3]
MANY = [1.0 * (0.001 ** (i / 49)) for i in range(50)]
RANGE = 1.2

# CTEs that the oracles share.
DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = f"({DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


def _ranked(score: str, order: str, k: int, extra: str = "") -> str:
    return f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS n, {score} AS s FROM embeddings a, embeddings b {extra}),
r AS (SELECT q, n, s, row_number() OVER (PARTITION BY q ORDER BY s {order}, (q <> n), n) AS rank FROM p)
SELECT q, n, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= {k}"""


GRAPH = f"""p AS (SELECT a.vec_id AS q, b.vec_id AS n, {COS} AS s FROM embeddings a, embeddings b),
r AS (SELECT q, n, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, (q <> n), n) AS rk FROM p),
g AS (SELECT q AS src, n AS dst, s AS sim FROM r WHERE rk <= 6 AND q <> n),
c AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(sim) AS sim FROM g GROUP BY ALL),
e AS (SELECT u AS src, v AS dst, sim FROM c UNION ALL SELECT v, u, sim FROM c)"""


def _scc(rounds: list[float]) -> str:
    """CTEs: lvl0 (point, node), then for each round best links, their closure and the contracted edges."""
    parts = ["m0 AS (SELECT vec_id AS point, vec_id AS node FROM embeddings)", "e0 AS (SELECT src, dst, sim FROM e)"]
    for i, t in enumerate(rounds):
        parts.append(f"n{i} AS (SELECT node, count(*) AS n FROM m{i} GROUP BY node)")
        parts.append(f"s{i} AS (SELECT src, dst, sim / (a.n * b.n) AS sc FROM e{i} JOIN n{i} a ON a.node = src JOIN n{i} b ON b.node = dst)")
        parts.append(f"b{i} AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sc DESC, dst) AS k FROM s{i} WHERE sc > {t}) WHERE k = 1)")
        parts.append(f"l{i} AS (SELECT src, dst FROM b{i} UNION SELECT dst, src FROM b{i})")
        parts.append(f"t{i}(x, y) AS (SELECT node, node FROM n{i} UNION SELECT t{i}.x, l{i}.dst FROM t{i} JOIN l{i} ON l{i}.src = t{i}.y)")
        parts.append(f"p{i} AS (SELECT x AS node, min(y) AS parent FROM t{i} GROUP BY x)")
        parts.append(f"m{i + 1} AS (SELECT point, parent AS node FROM m{i} JOIN p{i} USING (node))")
        parts.append(f"e{i + 1} AS (SELECT a.parent AS src, b.parent AS dst, sum(sim) AS sim FROM e{i} JOIN p{i} a ON a.node = src JOIN p{i} b ON b.node = dst WHERE a.parent <> b.parent GROUP BY ALL)")
    return "WITH RECURSIVE " + GRAPH + ",\n" + ",\n".join(parts)


# Best neighbours and proposed parents of the first DAG round.
DAG1 = f"""WITH {GRAPH},
b AS (SELECT src AS node, dst AS mate, sim AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM e) WHERE k = 1),
m AS (SELECT a.node, a.mate, a.score, (b.mate = a.node) AS mutual, CASE WHEN b.mate = a.node THEN least(a.node, a.mate) ELSE a.node END AS chosen FROM b a JOIN b ON b.node = a.mate)"""
VOTES = """, every AS (SELECT node, parent, max(score) AS score FROM (SELECT node, chosen AS parent, score FROM m UNION ALL SELECT mate, chosen, score FROM m WHERE NOT mutual) GROUP BY ALL),
kept AS (SELECT node, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, parent) AS k FROM every) WHERE k <= 5),
two AS (SELECT node, k.parent FROM kept k JOIN (SELECT parent FROM kept GROUP BY parent HAVING count(*) = 2) v ON v.parent = k.parent),
par AS (SELECT node, parent FROM two UNION SELECT node, node FROM m WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.node = m.node AND two.parent = m.chosen))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetrised graph of five cosine neighbours."""
    return materialize(graph.symmetrize_max(graph.knn_graph(_vectors(spark, sf_dir), 6)), "graph")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return knn.rounded(df, *cols)


# Scalar functions


@query("vector_norms", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(vx.squared_norm("embedding"), 6).alias("norm2"), F.round(vx.norm("embedding"), 6).alias("norm"))


@query("unit_vectors", "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id, round(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first, round(e[64] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS last FROM u")
def unit_vectors(spark, sf_dir):
    u = _vectors(spark, sf_dir).select("vec_id", vx.unit_norm("embedding").alias("u"))
    return u.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


@query("pair_scores", f"SELECT a.vec_id AS q, b.vec_id AS n, round({DOT}, 6) AS dot, round({L2}, 6) AS l2, round({COS}, 6) AS cosine, round(exp(-{DOT}), 6) AS dissimilarity, round((2 - {L2} * {L2}) / 2, 6) AS from_l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a, b = v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("n"), F.col("embedding").alias("y"))
    met = a.join(b, F.col("n") == F.col("q") + 1).select("q", "n", vx.dot("x", "y").alias("dot"), vx.l2("x", "y").alias("l2"), vx.cosine("x", "y").alias("cosine"), vx.exp_neg_dot("x", "y").alias("dissimilarity"), vx.l2_to_cosine(vx.l2("x", "y")).alias("from_l2"))
    return _round(met, "dot", "l2", "cosine", "dissimilarity", "from_l2")


@query("sql_functions", f"SELECT a.vec_id AS q, round({DOT}, 6) AS dot, round({L2}, 6) AS l2, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sql_functions(spark, sf_dir):
    vx.register(spark)
    _vectors(spark, sf_dir).createOrReplaceTempView("vecloom_embeddings")
    return spark.sql("SELECT a.vec_id AS q, round(vec_dot(a.embedding, b.embedding), 6) AS dot, round(vec_l2(a.embedding, b.embedding), 6) AS l2, round(vec_cosine(a.embedding, b.embedding), 6) AS cosine FROM vecloom_embeddings a JOIN vecloom_embeddings b ON b.vec_id = a.vec_id + 1")


@query("lengthened_vectors", "WITH n AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2 FROM embeddings), m AS (SELECT max(n2) AS phi2 FROM n) SELECT vec_id, 65 AS components, round(phi2, 6) AS norm2 FROM n, m")
def lengthened_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    phi2 = float(v.agg(F.max(vx.squared_norm("embedding"))).first()[0])
    longer = v.select("vec_id", vx.lengthened("embedding", phi2).alias("w"))
    return longer.select("vec_id", F.size("w").alias("components"), F.round(vx.squared_norm("w"), 6).alias("norm2"))


# Nearest-neighbour joins


@query("knn_cosine", _ranked(COS, "DESC", 5))
def knn_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.knn(v, v, 5, "cosine"), "score")


@query("knn_l2", _ranked(L2, "ASC", 10, "WHERE a.vec_id <> b.vec_id"))
def knn_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.knn(v, v, 10, "l2", include_self=False), "score")


@query("knn_sql_plan", _ranked(COS, "DESC", 5))
def knn_sql_plan(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.knn_sql(v.repartition(spark.sparkContext.defaultParallelism, "vec_id"), v, 5, "cosine"), "score")


@query("nearest_l2", _ranked(L2, "ASC", 1, "WHERE a.vec_id <> b.vec_id"))
def nearest_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.nearest(v, v, "l2", include_self=False), "score")


@query("furthest_l2", _ranked(L2, "DESC", 1))
def furthest_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.furthest(v, v, "l2"), "score")


@query("mips_knn", _ranked(DOT, "DESC", 10))
def mips_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.knn(v, v, 10, "dot"), "score")


@query("mips_by_distance", _ranked(DOT, "DESC", 5))
def mips_by_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(index.mips_by_distance(v, v, 5), "score")


@query("mcss_by_distance", _ranked(COS, "DESC", 5))
def mcss_by_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(index.mcss_by_distance(v, v, 5), "score")


@query("knn_dissimilarity", _ranked(f"exp(-{DOT})", "ASC", 5))
def knn_dissimilarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.knn(v, v, 5, "exp_neg_dot"), "score")


@query("range_l2", f"SELECT a.vec_id AS q, b.vec_id AS n, round({L2}, 6) AS score FROM embeddings a, embeddings b WHERE {L2} < {RANGE}")
def range_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.range_join(v, v, RANGE), "score")


@query("range_dissimilarity", f"SELECT a.vec_id AS q, b.vec_id AS n, round(exp(-{DOT}), 6) AS score FROM embeddings a, embeddings b WHERE exp(-{DOT}) < 0.75")
def range_dissimilarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(knn.range_join(v, v, 0.75, "exp_neg_dot"), "score")


@query("knn_with_points", f"WITH k AS ({_ranked(L2, 'ASC', 2)}) SELECT q, n, score, rank, round(b.embedding[1]::DOUBLE, 6) AS first FROM k JOIN embeddings b ON b.vec_id = n")
def knn_with_points(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = index.VectorIndex(v, "l2").knn(v, 2, return_points=True)
    return _round(found.select("q", "n", "score", "rank", F.element_at("point", 1).cast("double").alias("first")), "score", "first")


@query("knn_cells")
def knn_cells(spark, sf_dir):
    """Approximate: the 22 nearest of 32 cells, for a recall of 0.9 and more on the tables; recall is tested, not compared."""
    v = _vectors(spark, sf_dir)
    return _round(knn.knn_cells(v, v, 5, "cosine", cells=32, beam=22), "score")


@query("index_maintenance", f"""WITH x AS (SELECT * FROM embeddings WHERE vec_id % 7 <> 0), p AS (SELECT a.vec_id AS q, b.vec_id AS n, {L2} AS s FROM embeddings a, x b),
r AS (SELECT q, n, s, row_number() OVER (PARTITION BY q ORDER BY s, (q <> n), n) AS rank FROM p) SELECT q, n, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def index_maintenance(spark, sf_dir):
    """Build from even ids, insert the odd ones twice, delete every seventh, save, load, search."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    built = index.VectorIndex(v.where("vec_id % 2 = 0"), "l2")
    built.insert(v.where("vec_id % 2 = 1"))
    built.insert(v.where("vec_id % 2 = 1"))
    built.remove(v.where("vec_id % 7 = 0").select("vec_id"))

    built.save(path := fresh_path(spark, "saved"))
    return _round(index.VectorIndex.load(spark, path, "l2").knn(v, 3), "score")


DOT_REVERSED = "list_inner_product(a.embedding::DOUBLE[], list_reverse(b.embedding)::DOUBLE[])"


@query("knn_projected", _ranked(f"exp(-{DOT_REVERSED})", "ASC", 5))
def knn_projected(spark, sf_dir):
    """Dissimilarity between queries and a second matrix of the index, here its vectors reversed."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    two = index.VectorIndex(v.withColumn("embedding_proj", F.reverse("embedding")), "exp_neg_dot")
    return _round(two.knn(v, 5), "score")


@query("index_update", f"""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS n, {L2} AS s FROM embeddings a, x b),
r AS (SELECT q, n, s, row_number() OVER (PARTITION BY q ORDER BY s, (q <> n), n) AS rank FROM p) SELECT q, n, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def index_update(spark, sf_dir):
    """Every third vector is replaced by its reverse; ids that the index does not hold are ignored."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    built = index.VectorIndex(v, "l2")
    moved = v.where("vec_id % 3 = 0").withColumn("embedding", F.reverse("embedding"))
    built.update(moved.unionByName(moved.withColumn("vec_id", -1 - F.col("vec_id"))))
    return _round(built.knn(v, 3), "score")


@query("index_dedup", "SELECT count(DISTINCT embedding) AS built, count(DISTINCT embedding) AS inserted FROM embeddings")
def index_dedup(spark, sf_dir):
    """Exact duplicates stay out of an index with ``dedup``, of one batch and of later ones."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    again = v.withColumn("vec_id", -1 - F.col("vec_id"))
    built = index.VectorIndex(v.unionByName(again), "l2", dedup=True)
    n = len(built)
    built.insert(again.withColumn("vec_id", F.col("vec_id") * 2 - 1_000_000_000))
    return spark.createDataFrame([(n, len(built))], "built long, inserted long")


@query("covering_levels", f"SELECT vec_id, ceil(ln(s) / ln({vx.BASE}))::INT AS level, round(pow({vx.BASE}, ceil(ln(s) / ln({vx.BASE}))), 6) AS radius FROM (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 0.001 AS s FROM embeddings)")
def covering_levels(spark, sf_dir):
    """The lowest level that reaches a distance, here a norm and a little, and its radius."""
    v = _vectors(spark, sf_dir).select("vec_id", vx.level_of(vx.norm("embedding") + 0.001).alias("level"))
    return _round(v.withColumn("radius", vx.covering_radius("level")), "radius")


# Aggregates


@query("vector_mean", "SELECT (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i")
def vector_mean(spark, sf_dir):
    return _round(aggregates.vector_mean(_vectors(spark, sf_dir)), "mean")


@query("label_means", "SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def label_means(spark, sf_dir):
    return _round(aggregates.vector_mean(_vectors(spark, sf_dir), by=["label"]), "mean")


@query("medoid", """WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(mean ORDER BY i) AS c FROM m),
d AS (SELECT vec_id, list_distance(embedding::DOUBLE[], c) AS dist FROM embeddings, c) SELECT vec_id, round(dist, 6) AS dist FROM d ORDER BY d.dist, vec_id LIMIT 1""")
def medoid(spark, sf_dir):
    return _round(aggregates.medoid(_vectors(spark, sf_dir)), "dist")


@query("mean_radius", """WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(mean ORDER BY i) AS c FROM m)
SELECT round(max(list_distance(embedding::DOUBLE[], c)), 6) AS radius FROM embeddings, c""")
def mean_radius(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(aggregates.radius(v, aggregates.mean_vector(v)), "radius")


# Graphs


@query("knn_graph", f"WITH {GRAPH} SELECT src, dst, round(sim, 6) AS sim FROM g")
def knn_graph(spark, sf_dir):
    return _round(graph.knn_graph(_vectors(spark, sf_dir), 6), "sim")


@query("symmetric_graph", f"WITH {GRAPH} SELECT src, dst, round(sim, 6) AS sim FROM e")
def symmetric_graph(spark, sf_dir):
    return _round(_graph(spark, sf_dir), "sim")


@query("graph_degrees", f"WITH {GRAPH} SELECT src, count(*) AS degree, round(max(sim), 6) AS best_sim FROM e GROUP BY src")
def graph_degrees(spark, sf_dir):
    return _round(graph.degrees(_graph(spark, sf_dir)), "best_sim")


@query("last_write_edges", """WITH w AS (SELECT user_id AS src, (event_id * 7) % 50 AS dst, value AS sim, event_id AS seq FROM events), c AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, arg_max(sim, seq) AS sim FROM w WHERE src <> dst GROUP BY ALL)
SELECT u AS src, v AS dst, sim FROM c UNION ALL SELECT v, u, sim FROM c""")
def last_write_edges(spark, sf_dir):
    w = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("src"), (F.col("event_id") * 7 % 50).alias("dst"), F.col("value").alias("sim"), F.col("event_id").alias("seq"))
    return graph.upsert(w)


@query("contract_by_label", f"WITH {GRAPH} SELECT a.label::BIGINT AS src, b.label::BIGINT AS dst, round(sum(sim), 6) AS sim FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label GROUP BY ALL")
def contract_by_label(spark, sf_dir):
    parents = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("parent"))
    return _round(graph.contract(_graph(spark, sf_dir), parents), "sim")


@query("max_contract_by_label", f"WITH {GRAPH} SELECT a.label::BIGINT AS src, b.label::BIGINT AS dst, round(max(sim), 6) AS sim FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label GROUP BY ALL")
def max_contract_by_label(spark, sf_dir):
    parents = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("parent"))
    return _round(graph.contract(_graph(spark, sf_dir), parents, "max"), "sim")


@query("best_neighbours", f"WITH {GRAPH} SELECT src AS node, dst AS best, round(sim, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM e WHERE sim > 0.35) WHERE k = 1")
def best_neighbours(spark, sf_dir):
    return _round(graph.best_neighbour(_graph(spark, sf_dir), None, 0.35), "score")


@query("linkage_by_label", f"""WITH {GRAPH}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT a.label AS u, b.label AS v, sum(sim) AS sim FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label GROUP BY ALL)
SELECT u::BIGINT AS src, v::BIGINT AS dst, round(sim / (x.n * y.n), 6) AS score FROM s JOIN n x ON x.label = u JOIN n y ON y.label = v""")
def linkage_by_label(spark, sf_dir):
    parents = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("parent"))
    sizes = parents.groupBy("parent").agg(F.count("*").alias("n"))
    met = graph.contract(_graph(spark, sf_dir), parents).join(sizes.select(F.col("parent").alias("src"), F.col("n").alias("cu")), "src").join(sizes.select(F.col("parent").alias("dst"), F.col("n").alias("cv")), "dst")
    return _round(met.select("src", "dst", vx.linkage("sim", "cu", "cv").alias("score")), "score")


@query("top_neighbours", f"WITH {GRAPH} SELECT src, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM e) WHERE k <= 3")
def top_neighbours(spark, sf_dir):
    return _round(graph.top_neighbours(_graph(spark, sf_dir), 3), "sim")


@query("components", f"""WITH RECURSIVE {GRAPH}, b AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM e) WHERE k = 1), l AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b),
t(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.x, l.dst FROM t JOIN l ON l.src = t.y) SELECT x AS node, min(y) AS component FROM t GROUP BY x""")
def components(spark, sf_dir):
    best = graph.best_neighbour(_graph(spark, sf_dir), None, float("-inf"))
    return connected_components(best, "node", "best")


# Agglomeration


def _fit(spark, sf_dir, thresholds):
    v = _vectors(spark, sf_dir)
    return agg.fit(_graph(spark, sf_dir), thresholds, points=v.select(F.col("vec_id").alias("point")))


@query("scc_round", _scc(THRESHOLDS[:1]) + " SELECT point, node FROM m1")
def scc_round(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS[:1]).members[1].select("point", "node")


@query("scc_membership", _scc(THRESHOLDS) + " SELECT 0 AS level, node, point FROM m0 UNION ALL SELECT 1, node, point FROM m1 UNION ALL SELECT 2, node, point FROM m2 UNION ALL SELECT 3, node, point FROM m3")
def scc_membership(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS).membership()


@query("scc_nodes", _scc(THRESHOLDS) + """, a AS (SELECT 0 AS level, x.node, y.node AS parent FROM m0 x JOIN m1 y USING (point) UNION ALL SELECT 1, x.node, y.node FROM m1 x JOIN m2 y USING (point)
UNION ALL SELECT 2, x.node, y.node FROM m2 x JOIN m3 y USING (point) UNION ALL SELECT 3, node, NULL FROM m3) SELECT level, node, min(parent) AS parent, count(*) AS n_points FROM a GROUP BY level, node""")
def scc_nodes(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS).nodes()


@query("scc_roots", _scc(THRESHOLDS) + " SELECT node, count(*) AS n_points FROM m3 GROUP BY node")
def scc_roots(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS).roots()


@query("scc_children", _scc(THRESHOLDS[:2]) + " SELECT DISTINCT y.node AS parent, x.node AS child FROM m1 x JOIN m2 y USING (point)")
def scc_children(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS[:2]).children(2)


@query("scc_pruned_children", _scc(THRESHOLDS) + """, kids AS (SELECT DISTINCT y.node AS parent, x.node AS child FROM m2 x JOIN m3 y USING (point)),
wide AS (SELECT 1 AS lvl, y.node FROM m0 x JOIN m1 y USING (point) GROUP BY y.node HAVING count(DISTINCT x.node) > 1 UNION ALL SELECT 2, y.node FROM m1 x JOIN m2 y USING (point) GROUP BY y.node HAVING count(DISTINCT x.node) > 1)
SELECT parent, coalesce(max(lvl), 0)::INT AS level, child FROM kids LEFT JOIN wide ON node = child GROUP BY parent, child""")
def scc_pruned_children(spark, sf_dir):
    return _fit(spark, sf_dir, THRESHOLDS).pruned_children(3)


@query("scc_descendants", _scc(THRESHOLDS) + " SELECT point FROM m3 WHERE node = (SELECT min(node) FROM m3)")
def scc_descendants(spark, sf_dir):
    """The points under the first root."""
    h = _fit(spark, sf_dir, THRESHOLDS)
    return h.descendants(3, h.roots().agg(F.min("node")).first()[0])


@query("scc_many_rounds")
def scc_many_rounds(spark, sf_dir):
    """Fifty rounds; clusters a level. Held against a pure-Python model in the tests."""
    h = _fit(spark, sf_dir, MANY)
    return h.membership().groupBy("level").agg(F.countDistinct("node").alias("clusters"))


@query("scc_incremental", _scc(THRESHOLDS) + " SELECT 3 AS level, node, point FROM m3")
def scc_incremental(spark, sf_dir):
    """The same edges in three batches: the hierarchy is that of one batch."""
    edges = _graph(spark, sf_dir)
    points = _vectors(spark, sf_dir).select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"), F.lit(0.0).alias("sim"))
    a = agg.Agglomerator(spark, THRESHOLDS)
    a.add_edges(points)
    for part in range(3):
        h = a.insert_batch(edges.where(F.pmod(F.least("src", "dst"), F.lit(3)) == part))
    return h.membership().where("level = 3")


@query("scc_streaming")
def scc_streaming(spark, sf_dir):
    """partial_fit over a stream of files of vectors; rows-only, since edges depend on the batches."""

    c = incremental.StreamingClusters(spark, 5, THRESHOLDS)
    parts = fresh_path(spark, "arriving")
    _vectors(spark, sf_dir).select("vec_id", "embedding").repartitionByRange(3, "vec_id").write.parquet(parts)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(parts)
    incremental.cluster_stream(stream, c, fresh_path(spark, "stream-state")).awaitTermination()
    return c.clusters.hierarchy.membership()


# DAG clustering


@query("dag_proposals", DAG1 + " SELECT node, mate, round(score, 6) AS score, mutual, chosen FROM m")
def dag_proposals(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"))
    best = graph.best_neighbour(_graph(spark, sf_dir), None, float("-inf"))
    return _round(dag.propose(v, best).select("node", "mate", "score", "mutual", "chosen"), "score")


@query("dag_parents", DAG1 + VOTES + " SELECT node, parent FROM par")
def dag_parents(spark, sf_dir):
    return dag.DagClustering(_graph(spark, sf_dir), 1).cluster().parents[0].select("node", "parent")


@query("dag_contract_single", DAG1 + VOTES + " SELECT a.parent AS src, b.parent AS dst, round(max(sim), 6) AS sim FROM e JOIN par a ON a.node = src JOIN par b ON b.node = dst WHERE a.parent <> b.parent GROUP BY ALL")
def dag_contract_single(spark, sf_dir):
    d = dag.DagClustering(_graph(spark, sf_dir), 1, "single").cluster()
    return _round(dag.contract(d.leaf_edges, d.parents[0], "single"), "sim")


@query("dag_contract_bag", DAG1 + VOTES + " SELECT a.parent AS src, b.parent AS dst, round(sum(sim), 6) AS sim FROM e JOIN par a ON a.node = src JOIN par b ON b.node = dst WHERE a.parent <> b.parent GROUP BY ALL")
def dag_contract_bag(spark, sf_dir):
    d = dag.DagClustering(_graph(spark, sf_dir), 1, "approx_average").cluster()
    return _round(dag.contract(d.leaf_edges, d.parents[0], "approx_average"), "sim")


@query("dag_contract_set", DAG1 + VOTES + """, n AS (SELECT parent, count(DISTINCT node) AS n FROM par GROUP BY parent), s AS (SELECT a.parent AS u, b.parent AS v, sum(sim) AS sim FROM e JOIN par a ON a.node = src JOIN par b ON b.node = dst WHERE a.parent <> b.parent GROUP BY ALL)
SELECT u AS src, v AS dst, round(sim / (x.n * y.n), 6) AS sim FROM s JOIN n x ON x.parent = u JOIN n y ON y.parent = v""")
def dag_contract_set(spark, sf_dir):
    d = dag.DagClustering(_graph(spark, sf_dir), 1, "average").cluster()
    return _round(dag.contract(d.leaf_edges, d.parents[0], "average", d.members[1], d.leaf_edges), "sim")


@query("dag_structure")
def dag_structure(spark, sf_dir):
    """round, child, parent of ten rounds; held against a pure-Python model in the tests."""
    return dag.DagClustering(_graph(spark, sf_dir), 10, "approx_average").cluster().structure()


@query("dag_assignments")
def dag_assignments(spark, sf_dir):
    return dag.DagClustering(_graph(spark, sf_dir), 3, "single").cluster().assignments()


@query("dag_round", DAG1 + VOTES + " SELECT DISTINCT parent AS node, node AS point FROM par")
def dag_round(spark, sf_dir):
    return dag.DagClustering(_graph(spark, sf_dir), 1, "single").cluster().round(1)


# Trees


@query("tree_checks", "SELECT count(*) AS nodes, true AS covering, true AS nesting FROM embeddings")
def tree_checks(spark, sf_dir):
    t = tree.build(_vectors(spark, sf_dir))
    return t.agg(F.count("*").alias("nodes")).select("nodes", F.lit(tree.test_covering(t)).alias("covering"), F.lit(tree.test_nesting(t)).alias("nesting"))


@query("tree_level_stats")
def tree_level_stats(spark, sf_dir):
    return _round(tree.level_stats(tree.build(_vectors(spark, sf_dir))), "avg_radius", "max_radius")


@query("tree_degree_stats")
def tree_degree_stats(spark, sf_dir):
    return tree.degree_stats(tree.build(_vectors(spark, sf_dir)))


@query("tree_descendants", "SELECT max(n) AS most, count(*) AS nodes FROM (SELECT count(*) OVER () AS n FROM embeddings)")
def tree_descendants(spark, sf_dir):
    """The root has every node under it."""
    return tree.descendant_counts(tree.build(_vectors(spark, sf_dir))).agg(F.max("num_desc").alias("most"), F.count("*").alias("nodes"))


@query("tree_spread_out")
def tree_spread_out(spark, sf_dir):
    return tree.spread_out(tree.build(_vectors(spark, sf_dir)), 20)


@query("tree_root", ORACLES["medoid"].replace("SELECT vec_id, round(dist, 6) AS dist FROM d", "SELECT vec_id AS uid FROM d"))
def tree_root(spark, sf_dir):
    return tree.root_of(tree.build(_vectors(spark, sf_dir))).select("uid")


@query("coarse_search")
def coarse_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    t = tree.build(v)
    top = t.agg(F.max("level")).first()[0]
    return _round(knn.coarse_cells(v, t, top - 2, 3, 10), "score")


# Sampling


@query("similarity_sample")
def similarity_sample(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _round(sampling.similarity_sample(v, v, 4, seed=7), "prob")


@query("cluster_sample")
def cluster_sample(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    t = tree.build(v)
    return _round(sampling.repeated_cluster_sample(v, t, 3, t.agg(F.max("level")).first()[0] - 3, seed=7), "dist")


@query("chain_sample")
def chain_sample(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    t = tree.build(v)
    return sampling.chain_sample(v, t, 3, t.agg(F.max("level")).first()[0] - 3, chains=2, length=4, seed=7)


# Windows over the event stream


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return incremental.windowed_counts(e).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
