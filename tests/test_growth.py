import os

from pyspark.sql import functions as F

from emberlane.operators import vectors
from emberlane.plans import curate
from emberlane.sources import tables


def test_traces_have_few_folders(spark, tmp_path):
    """F13 to F16: a folder for each session was a file for each."""
    keys = [F.lit("p").alias("pipeline_name"), F.lit("s").alias("suite_name"), F.concat(F.lit("user_task_"), "id").alias("user_task_id"), F.when(F.col("id") % 2 == 0, "direct").alias("attack_type"), F.lit(None).cast("string").alias("injection_task_id")]
    messages = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("content"))).alias("content"))).alias("messages")
    tables.sink_traces(spark.range(0, 300, 1, 2).select(*keys, messages), f"{tmp_path}/t")
    assert sum(f.endswith(".json") for _, _, names in os.walk(f"{tmp_path}/t") for f in names) <= 4
    got = tables.scan_traces(spark, f"{tmp_path}/t").select("user_task_id", "attack_type", "injection_task_id").collect()
    assert {tuple(x) for x in got} == {(f"user_task_{k}", "none" if k % 2 else "direct", "none") for k in range(300)}


def test_feedback_arrives_in_so_many_batches(spark, monkeypatch):
    """twenty times the sessions were twenty times the restarts."""
    seen = []
    real = curate.sinks.replay
    monkeypatch.setattr(curate.sinks, "replay", lambda rows, *a: (seen.append(rows.select("arrival").distinct().count()), real(rows, *a)))
    d = spark.range(40).select(F.col("id").alias("session_id"), F.lit(1).alias("step"), F.lit("x").alias("action"), (F.col("id") * 4_000_000).alias("ts"))
    assert curate._feedback(d).count() == 40 and seen == [curate._ARRIVALS]


def test_exact_search_makes_no_copy_for_each_list(spark, monkeypatch):
    """with all lists visited, every query was held once for each."""
    made = []
    real = vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, name: made.append((name, out := real(df, name))) or out)
    d = spark.range(400).select(F.col("id").alias("q"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("v"))
    got = {x.q: (x.a, x.similarity) for x in vectors.nearest(d, d.where("q % 4 = 0").withColumnRenamed("q", "a"), "q", "a", "v", probes=1 << 30).collect()}
    assert dict(made)["asked"].count() == 400
    import numpy as np

    rows = np.array([x.v for x in d.orderBy("q").collect()])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    near = rows @ rows[::4].T
    assert all(abs(got[k][1] - near[k].max()) < 1e-9 and abs(near[k][got[k][0] // 4] - near[k].max()) < 1e-9 for k in range(400))


def test_subsets_make_only_pairs_of_the_result(spark):
    """users were joined on each channel; classes of more than a block, an only null channel and null users, by brute force."""
    from emberlane.plans import tools

    has = {k: {c for i, c in enumerate("abc") if k >> i & 1} for k in range(300)}
    rows = [(k, c) for k, cs in has.items() for c in cs] + [(k, None) for k, cs in has.items() if not cs] + [(None, "a")]
    got = [tuple(x) for x in tools._subsets(spark.createDataFrame(rows, "user_id long, channel string"), block=8).collect()]
    assert sorted(got) == sorted((a, b) for a in has if a % 50 == 0 for b in has if a != b and has[a] <= has[b])


def test_candidates_explode_the_words_once(spark):
    """the words of all sets were exploded, joined and ranked once for each use."""
    from emberlane.operators import folds

    d = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (i + F.col("id") % 4).cast("long")).alias("w"))
    plan = folds._candidates(d, 0.85)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
