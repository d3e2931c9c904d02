"""Connected components and pointer jumping as DataFrame iterations.

Nothing is collected but one row of counters a round; every round is written to the shared folder,
so a lost executor repeats a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import Scratch, materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A fingerprint of an edge set: its size and the sum of its hashes."""
    seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
    return seen["n"], seen["h"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node reachable.

    Alternates large-star and small-star contraction (O(log^2 n) rounds on paths, two on stars).
    Self loops only name their node; nulls are dropped. Nodes may be of any ordered type.
    """
    with Scratch(edges.sparkSession) as scratch:
        pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
        pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now, mark = pairs.where("u <> v"), None
        written = None
        for _ in range(max_rounds):
            both = now.union(now.select("v", "u"))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            lower = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            now = materialize(small, "cc")
            if written is not None:
                scratch.drop(written)
            written = now
            found = _mark(now)
            if found == mark:
                break
            mark = found
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = now.groupBy("u").agg(F.min("v").alias("root"))
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        return scratch.keep(materialize(nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("component")), "components"))
