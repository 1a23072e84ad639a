"""Entity tables: reads are filters over a view, changes give a new snapshot."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, rows: list[dict], id_col: str = "id") -> DataFrame:
    """New rows numbered on from the largest id; columns that are not given are null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new = df.sparkSession.createDataFrame([tuple(r.get(c) for c in kinds if c != id_col) + (k,) for k, r in enumerate(rows)], df.select(*[c for c in kinds if c != id_col]).withColumn("_k", F.lit(0)).schema)
    top = df.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("_top"))
    numbered = new.crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("_top") + 1 + F.col("_k")).cast(kinds[id_col]))
    return df.unionByName(numbered.select(*df.columns))


def update(df: DataFrame, which: Column, **values: Column) -> DataFrame:
    """``values`` where ``which`` holds; a null value keeps the old one."""
    return df.withColumns({c: F.when(which, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, which: Column) -> DataFrame:
    return df.where(~F.coalesce(which, F.lit(False)))


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows that hold the text in one of the columns, whatever its case."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(needle.lower()) for c in columns]))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``key, change``: added, removed or changed rows, by a full join on the key and a hash of the rest."""
    rest = [c for c in before.columns if c != key and c not in ignore]
    side = lambda d, n: d.select(F.col(key), F.xxhash64(*rest).alias(n))
    both = side(before, "a").join(side(after, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def overlapping(events: DataFrame, start: str, end: str, partition: str) -> DataFrame:
    """Events that start before an earlier event of the same partition has ended, by a running maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(start, "id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_until", F.max(end).over(w)).where(F.col(start) < F.col("_until")).drop("_until")


class Registry:
    """Named functions over views, with checked parameters; errors come back as text."""

    def __init__(self) -> None:
        self.functions: dict[str, tuple[Callable, dict[str, type]]] = {}

    def register(self, **types: type) -> Callable:
        def add(f: Callable) -> Callable:
            self.functions[f.__name__] = (f, types)
            return f

        return add

    def run(self, name: str, env: dict[str, DataFrame], args: dict) -> tuple[DataFrame | None, str | None]:
        """Arguments may be calls themselves, as ``(name, args)``; their first value is used."""
        if name not in self.functions:
            return None, f"ToolNotFoundError: Tool {name} not found." if name else "ValueError: empty function name provided."
        f, types = self.functions[name]
        ready = {}
        for k, v in args.items():
            if isinstance(v, tuple):
                out, error = self.run(v[0], env, v[1])
                if error:
                    return None, error
                row = out.first()
                v = row[0] if row else None
            ready[k] = v
        for k, kind in types.items():
            if k not in ready or not isinstance(ready[k], kind):
                return None, f"ValidationError: {k}"
        try:
            return f(env, **ready), None
        except (KeyError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    def loop(self, calls: Callable[[int, list], list[tuple[str, dict]]], env: dict[str, DataFrame], limit: int = 15) -> list:
        """Runs what ``calls`` asks for, until it asks for nothing or the limit is reached."""
        trace: list = []
        for step in range(limit):
            asked = calls(step, trace)
            if not asked:
                break
            trace += [(n, a, *self.run(n, env, a)) for n, a in asked]
        return trace


def render(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by the value of that name, in the order given."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def tag_positions(df: DataFrame, column: str, pattern: str = r"(?s)<INFORMATION>.*?</INFORMATION>") -> DataFrame:
    """A row for each match in a text: ``n``, where it starts and ends, and the text's ``length``; texts without one have none."""
    found = F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))
    df = df.withColumn("_found", found).where(F.size("_found") > 0).withColumn("_between", F.split(column, pattern)).withColumn("length", F.length(column))
    total = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    each = df.select("*", F.posexplode("_found").alias("n", "_match")).withColumn("start", total("_between", F.col("n") + 1) + total("_found", F.col("n")))
    return each.withColumn("end", F.col("start") + F.length("_match")).drop("_found", "_between", "_match")
