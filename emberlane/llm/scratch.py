"""Lineage cuts: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder. A cluster must name one: neither a
    temporary folder nor the default warehouse need be shared by its executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        app = spark.sparkContext.applicationId
        return _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="emberlane-"))
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    A lost executor costs only tasks of the step that runs, never the steps before.
    """
    path = f"{shared_dir(df.sparkSession)}/emberlane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._emberlane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`materialize` that no later step reads."""
    for table in tables:
        path = getattr(table, "_emberlane_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Ids are broadcast up to this many (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def side_of(table: DataFrame) -> DataFrame:
    """A written table as a join's side: broadcast only if its rows have been counted and are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def text_key(text_col: str) -> Column:
    """What stands for a whole text beside a row's id: rows with equal ids need not be equal."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id (null included) and text are not in ``gone`` (``doc_id, text_key``)."""
    gone = materialize(gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct(), "gone")
    side = side_of(gone)
    return docs.join(side, docs[id_col].cast("long").eqNullSafe(side["_gone"]) & (text_key(f"`{text_col}`") == side["_key"]), "left_anti")


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each group of ``rows`` (``doc_id, text_key, grp``, one row per row of ``docs``).

    The row with the smallest id stays (a null id is the largest), of equal ids that with the smallest text key, and of
    rows that are equal in both any one. Only rows that are repeated themselves are shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nothing"), "doc_id", "text_key")
    known = materialize(rows.groupBy("doc_id", "text_key").agg(F.any_value("grp").alias("grp"), F.count(F.lit(1)).alias("n")), "known")
    first = known.groupBy(F.col("grp").alias("_grp")).agg(F.min(order).alias("_first"))
    judged = known.join(first, F.col("grp") == F.col("_grp")).withColumn("_stays", order.eqNullSafe(F.col("_first")))
    judged = materialize(judged.where("not _stays or n > 1").select("doc_id", "text_key", "_stays"), "judged")
    out = without_rows(docs, judged, id_col, text_col)
    again = judged.where("_stays").select("doc_id", "text_key")
    if again.isEmpty():
        return out
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("one_id"), text_key(f"`{text_col}`").alias("one_key"))
    found = packed.join(side_of(again), F.col("one_id").eqNullSafe(F.col("doc_id")) & (F.col("one_key") == F.col("text_key")))
    return out.unionByName(found.dropDuplicates(["one_id", "one_key"]).select("row.*"))


def where_once(df: DataFrame, condition) -> DataFrame:
    """``df.where(condition)`` that is evaluated on computed columns.

    A plain filter would be pushed below the projections and have their expressions copied into it, which
    for arrays used inside lambda functions means once per element. A row number keeps it above them.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")
