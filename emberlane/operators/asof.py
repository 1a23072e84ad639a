"""As-of join: to each row the last row of another table, by time, with the same key.

Both tables are laid one after the other in one order of (key, time), cut into ranges. Within a range the last right row is
carried along by a window; a key that goes on from an earlier range gets what that range ended with, a row a range. So there is no join
of ranges, and a hot key is spread over as many ranges as its rows take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.ordered import in_ranges


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], strict: bool = False) -> DataFrame:
    """The rows of ``left`` with ``take`` of the last row of ``right`` that has the same key and is not later (with ``strict``: is earlier).

    Of right rows at one time the greatest by ``take`` counts. Where there is none, the columns are null, as where key or time are.
    """
    row, found = (F.struct(*[F.col(f"`{c}`") for c in names]) for names in (left.columns, take))
    keys = [F.col(f"`{c}`").alias(f"_k{n}") for n, c in enumerate(on)]
    names = [f"_k{n}" for n in range(len(on))]
    known = right.where(F.col(right_time).isNotNull())
    lefts = left.select(*keys, F.col(f"`{left_time}`").alias("_t"), F.lit(0 if strict else 1).alias("_side"), row.alias("_row"), F.lit(None).cast(known.select(found).schema[0].dataType).alias("_found"))
    rights = known.select(*keys, F.col(f"`{right_time}`").alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(row).schema[0].dataType).alias("_row"), found.alias("_found"))
    order = ["_t", "_side", "_found"]
    both = in_ranges(lefts.unionByName(rights), [*map(F.col, names), *map(F.col, order)], "asof")
    inside = Window.partitionBy("_b", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_in", F.last("_found", ignorenulls=True).over(inside)).where("_row IS NOT NULL")
    at = F.when(F.col("_found").isNotNull(), F.struct(*order))
    ends = both.groupBy(*names, "_b").agg(F.max(at)["_found"].alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # of one key a row a range
    carried = ends.withColumn("_before", before).where("_before IS NOT NULL").select(F.col("_b").alias("_cb"), *[F.col(k).alias(f"_c{k}") for k in names], "_before")
    here = F.col("_b") == F.col("_cb")
    for k in names:
        here = here & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    out = filled.join(F.broadcast(carried), here, "left")  # a row for each range that a key goes on into
    usable = F.col("_t").isNotNull()
    for k in names:
        usable = usable & F.col(k).isNotNull()
    value = F.when(usable, F.coalesce("_in", "_before"))
    return out.select("_row.*", *[value[c].alias(c) for c in take])
