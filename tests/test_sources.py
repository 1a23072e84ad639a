import json

from pyspark.sql import functions as F

from emberlane.sources import tables


def test_jsonl_skips_blank_and_broken_lines(spark, tmp_path):
    good = {"action": "é", "label": "benign", "session_id": "s", "attack_type": "benign", "step_index": 0, "source_dataset": "d", "augmented": False}
    (tmp_path / "a.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n{broken\n" + json.dumps(good | {"step_index": 1}) + "\n")
    df = tables.scan_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert [r.step_index for r in df.orderBy("step_index").collect()] == [0, 1] and df.first().action == "é"
    tables.jsonl_to_parquet(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    tables.sink_jsonl(df, str(tmp_path / "out"))
    assert tables.scan_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_csv_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Prompt,x\n one ,1\n,2\n  ,3\ntwo,4\n")
    assert {r[0] for r in tables.scan_csv_column(spark, str(tmp_path / "a.csv"), "Prompt").collect()} == {"one", "two"}
    tables.sink_csv(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().v == "a"


def test_infer_column(spark):
    df = spark.createDataFrame([(1, "t")], "id int, Prompt string")
    assert df.select(tables.infer_column(df, ("text", "prompt"))).columns == ["Prompt"] and tables.infer_column(df, ("z",)) is None


def test_traces_round_trip_and_upgrade(spark, tmp_path):
    rows = [("p", "s", "u1", None, None, [("user", "hi")], True, False)]
    df = spark.createDataFrame(rows, "pipeline_name string, suite_name string, user_task_id string, attack_type string, injection_task_id string, messages array<struct<role:string,content:string>>, utility boolean, security boolean")
    tables.sink_traces(df, str(tmp_path / "t"))
    got = tables.scan_traces(spark, str(tmp_path / "t"))
    assert got.select(F.col("messages")[0]["content"][0]["content"]).first()[0] == "hi" and got.first().attack_type == "none"


def test_config_and_templates(tmp_path):
    from emberlane.sources import config

    assert config.flat_yaml("# c\nmode: 'x'  # why\nthreshold: 0.7\n") == {"mode": "x", "threshold": "0.7"}
    try:
        config.flat_yaml("a:\n  b: 1\n")
        raise AssertionError
    except ValueError:
        pass
    assert config.load_settings("mode: file\nshadow: 1", {"mode": "d", "log_path": "l"}, {"SHADOW_MODE": "env"})["shadow"] == "env"
    (tmp_path / "a.yaml").write_text("x: !include b.json\ny: !include c.txt\n")
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.txt").write_text("hi")
    assert config.load_yaml(str(tmp_path / "a.yaml")) == {"x": [1, 2], "y": "hi"}
    assert config.inject("m: {a} {b}", {"a": "1", "b": "2"}, {"b": "3"}) == "m: 1 3"
