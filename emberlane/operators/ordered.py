"""Running sums over a whole order without a window in one task.

The order is cut into ranges, as many as the session shuffles into, so a task's share does not grow with the table or with a group. Sums of the
ranges before come from a small table, those within a range from a window over that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.sources.tables import written


def in_ranges(df: DataFrame, order: list[Column], name: str = "ranges") -> DataFrame:
    """Adds ``_b``, the range of each row in the given order; the table is written, so that ranges stay as they are."""
    return written(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), name)


def by_quantile(df: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """Ranges of a column's values, of which equal ones are together; nulls come first (last, if descending)."""
    return in_ranges(df, [F.desc_nulls_last(order) if descending else F.asc_nulls_first(order)])


def by_hash(df: DataFrame, hexed: Column) -> DataFrame:
    """Ranges of a text of digits that orders rows as drawn."""
    return in_ranges(df, [hexed])


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds running sums in the given order (which ``_b`` follows) within each group; drops ``_b``."""
    df = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    totals = df.groupBy(*by, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    base = totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k_b"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    on = F.col("_b") == F.col("_k_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(base, on).withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.drop("_b", "_k_b", *[f"_k_{c}" for c in by], *[f"{p}{n}" for n in sums for p in ("_v_", "_o_")])


def row_numbers(df: DataFrame, by: list[str], order: list[Column], into: str) -> DataFrame:
    return running(df, by, order, {into: F.lit(1)})
