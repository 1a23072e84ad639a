"""From raw documents to packed training windows in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before has kept. All but the
last return the columns of ``documents``. What each stage drops or changes:

1. quality rules: documents that a fixed rule or the likelihood ratio rejects go;
2. line dedup: later copies of repeated line runs are deleted from the texts (``n_chars`` follows), and
   documents that have no word left go;
3. near-dedup: of each group of texts whose 5-word shingles are similar by 0.8 or more one document stays, the one with the smallest id;
4. benchmark decontamination: documents that overlap a benchmark item go;
5. packing: the rest becomes windows of tokens.

Edge cases, alike in all stages. Null text is empty: the fixed rules reject it, and so it goes in the first stage; a stage that
is called by itself keeps it (line dedup drops it, as it has no word). Null ids are ids of their own kind: no label is theirs, their
first lines count as the earliest, and of near copies a document with an id stays rather than one without. Repeated rows get the same
verdict; near-dedup leaves one of them. Ties are broken by id, then by a hash of the text. Texts of any length are read whole. Empty
tables, of documents, labels or benchmark, give empty or unchanged results. Other columns of the documents come through
unchanged, whatever their names, except that line dedup sets ``n_chars`` to the new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import decontaminate, linededup, neardup, packing, quality
from emberlane.llm.queries import tokenizer_json
from emberlane.llm.scratch import materialize, where_once


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = where_once(linededup.dedup_lines(docs).select("row", "kept_text"), F.coalesce(F.col("kept_text").rlike(linededup.HAS_WORD), F.lit(False)))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(kinds.get("n_chars", "bigint"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_json())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no way to express components, likelihood sums and placement; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
