"""Vector functions on array<float> columns. Elements are cast to double inside the arithmetic; what is stored is float."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; no element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is; vectors of different length are cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    bottom = norm(a) * norm(b)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(dot(a, b) / bottom)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda an expression is computed for every element."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return _let(a, lambda v: _let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compose(body: Column, description: Column, alpha: float = 0.5) -> Column:
    """A note's ranking vector: both made unit, blended, made unit. The body alone where the description is missing or of
    another length, or alpha is not above 0."""
    alone = l2_normalize(body)
    if not alpha > 0:
        return alone
    share = min(alpha, 1.0)
    d = l2_normalize(description)
    mixed = F.zip_with(alone, d, lambda x, y: ((1 - share) * x.cast("double") + share * y.cast("double")).cast("float"))
    return F.when(description.isNull() | (F.size(description) != F.size(body)) | (F.size(description) == 0), alone).otherwise(l2_normalize(mixed))


def mean_pool(df: DataFrame, key: str, vec: str, weight_unit: bool = False) -> DataFrame:
    """(key, vec): the mean of each key's vectors; with weight_unit, made unit. Aggregated before the shuffle by position."""
    out = df.filter(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = out.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"].cast("float")).alias(vec))
    return out.withColumn(vec, l2_normalize(F.col(vec))) if weight_unit else out


def centroid(df: DataFrame, vec: str) -> DataFrame:
    """One row with the unit sum of all finite vectors of the commonest length, or none if there is none."""
    dim = majority_dim(df, vec)
    rows = df.filter(F.col(vec).isNotNull() & is_finite(F.col(vec))).join(F.broadcast(dim), F.size(vec) == F.col("dim"))
    total = rows.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    one = total.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec)).filter(F.size(vec) > 0)
    return one.filter(norm(F.col(vec)) > 0).select(l2_normalize(F.col(vec)).alias(vec))


def majority_dim(df: DataFrame, vec: str) -> DataFrame:
    """One row: the commonest length of a vector (of equally common ones the smallest)."""
    counts = df.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "dim").limit(1)
