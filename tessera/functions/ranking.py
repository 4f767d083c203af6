"""Ranks over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows are ranked in one task.
SINGLE = 100_000
BUCKET_ROWS = 500_000


def global_rank(rows: DataFrame, value: str, tie: str, out: str = "rank", single: int = SINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with their exact rank from 1 by descending value, ties by another column.

    Larger tables are cut into ranges of the value at approximate quantiles; each range is ranked by itself and shifted by the number of
    rows above it. The driver holds one number for each range.
    """
    n = rows.count()
    if n <= single:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(F.desc(value), tie)))
    ranges = max(2, -(-n // bucket_rows))
    found = rows.agg(F.percentile_approx(F.col(value), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    edges = sorted(set(found), reverse=True)
    # The range of a row: how many edges lie above its value; rows of one value are never parted.
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col(value)))
    cut = rows.withColumn("_range", at)
    sizes = {r["_range"]: r["n"] for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    above, shift = 0, {}
    for k in sorted(sizes):
        shift[k], above = above, above + sizes[k]
    offset = F.create_map(*[F.lit(x) for k, v in shift.items() for x in (k, v)])[F.col("_range")]
    ranked = cut.withColumn(out, (F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(value), tie)) + offset).cast("int"))
    return ranked.drop("_range")
