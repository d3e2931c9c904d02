"""Column expressions over ARRAY<FLOAT> vectors. All arithmetic is in double precision, in element order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Growth of covering radii from one tree level to the next.
BASE = 1.3


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def unit_norm(v: Column | str) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Zero vectors count as having norm one."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def exp_neg_dot(a: Column | str, b: Column | str) -> Column:
    """The asymmetric dissimilarity of projected vectors."""
    return F.exp(-dot(a, b))


def l2_to_cosine(d: Column | str) -> Column:
    """Cosine of unit vectors from their distance."""
    d = F.col(d) if isinstance(d, str) else d
    return (2 - d * d) / 2


def l2_to_inner(d: Column, query_norm2: Column, phi2: Column | float) -> Column:
    """Inner product from the distance between a lengthened vector and a query lengthened by zero."""
    return (F.lit(phi2) + query_norm2 - d * d) / 2 if isinstance(phi2, float) else (phi2 + query_norm2 - d * d) / 2


def l2_to_cosine_of(d: Column, query_norm: Column) -> Column:
    """Cosine of a unit vector and a query of any norm, from their distance."""
    return (1 / query_norm + query_norm - d * d / query_norm) / 2


def lengthened(v: Column | str, phi2: float) -> Column:
    """v with one component more, so that its squared norm is phi2; an error where it is larger already."""
    rest = F.lit(phi2) - squared_norm(v)
    safe = F.when(rest >= -1e-9 * max(phi2, 1.0), F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(F.raise_error(F.lit("a vector is longer than the index's largest norm")).cast("double"))
    return F.concat(doubles(v), F.array(safe))


def noisy(v: Column | str, amount: float, seed: int, key: Column | str = "vec_id") -> Column:
    """Additive Gaussian noise that depends on the key, the position and the seed alone (Box-Muller on hashes)."""
    if not amount:
        return doubles(v)
    k = F.col(key) if isinstance(key, str) else key
    uniform = lambda i, part: (F.pmod(F.xxhash64(k, i, F.lit(seed), F.lit(part)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return F.transform(doubles(v), lambda x, i: x + amount * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)))


def linkage(sum_sim: Column | str, count_u: Column | str, count_v: Column | str) -> Column:
    """Average similarity between two clusters; absent pairs count as zero."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(sum_sim) / (c(count_u) * c(count_v))


def level_of(d: Column | str, base: float = BASE) -> Column:
    """The lowest level whose covering radius base**level reaches d."""
    d = F.col(d) if isinstance(d, str) else d
    return F.ceil(F.log(d) / F.lit(math.log(base))).cast("int")


def covering_radius(level: Column | str, base: float = BASE) -> Column:
    return F.pow(F.lit(base), F.col(level) if isinstance(level, str) else level)


def check_dimensions(vectors: DataFrame, vec: str = "embedding") -> int:
    """The one length of all vectors; an error when there are several. An empty table has length 0."""
    found = vectors.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if found["lo"] != found["hi"]:
        raise ValueError(f"vectors have {found['lo']} to {found['hi']} components")
    return found["lo"] or 0


def register(spark: SparkSession) -> None:
    """vec_dot, vec_l2 and vec_cosine as SQL functions; Catalyst inlines their bodies."""
    both = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    dot_ = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    n = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_dot({both}) RETURNS DOUBLE RETURN {dot_}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_l2({both}) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine({both}) RETURNS DOUBLE RETURN {dot_} / ({n.format('a')} * {n.format('b')})")
