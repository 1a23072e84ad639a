import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from emberlane.sources import hub
from emberlane.sources.dataset import Dataset, read_dataset

DATA = "/root/testdata/sf0.001"


def source(**options):
    return Dataset({k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()})


def test_first_copy_and_pruning(spark):
    paths = [f"{DATA}/no_such_table.parquet", f"{DATA}/documents.parquet", f"{DATA}/benchmark.parquet"]
    df = read_dataset(spark, paths)
    want = spark.read.parquet(f"{DATA}/documents.parquet")
    assert df.dtypes == want.dtypes and sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    few = read_dataset(spark, paths, ["lang", "doc_id"])
    assert few.columns == ["doc_id", "lang"] and few.count() == want.count()
    pruned = source(paths=paths, columns=["lang"])
    reader = pruned.reader(pruned.schema())
    assert {tuple(b.schema.names) for p in reader.partitions() for b in reader.read(p)} == {("lang",)}


@pytest.fixture
def many_groups(tmp_path):
    for k in range(3):
        table = pa.table({"id": pa.array(range(k * 1000, k * 1000 + 1000), pa.int64()), "text": [f"row {i}" for i in range(1000)]})
        pq.write_table(table, tmp_path / f"part-{k}.parquet", row_group_size=100)
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_partitions_and_filters(spark, many_groups):
    whole = source(paths=[many_groups], split="2000", skip="true")
    reader = whole.reader(whole.schema())
    parts = reader.partitions()
    assert len(parts) > 10 and sum(len(p.groups) for p in parts) == 30
    assert sorted(i for p in parts for b in reader.read(p) for i in b["id"].to_pylist()) == list(range(3000))
    asked = [GreaterThan(("id",), 2850), EqualTo(("text",), "row 900")]
    assert list(reader.pushFilters(asked)) == asked
    assert [(p.path[-14:], p.groups) for p in reader.partitions()] == [("part-2.parquet", (9,))]
    reader.pushFilters([GreaterThan(("id",), 9999)])
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert read_dataset(spark, [many_groups]).where("id > 2950 AND text <> 'row 999'").agg(F.count("id"), F.min("id")).first()[:] == (48, 2951)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_lines_and_csv(spark, tmp_path, split):
    rows = [{"text": f"é {k}", "n": str(k)} for k in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    (tmp_path / "a.csv").write_text('text,n\n' + "\n".join(f'"é {k}",{k}' for k in range(50)))
    for name in ("a.jsonl", "a.csv"):
        src = source(paths=[str(tmp_path / name)], split=str(split))
        reader = src.reader(src.schema())
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == rows
    assert read_dataset(spark, [str(tmp_path / "a.csv")]).count() == 50


def test_fallback(spark):
    assert [tuple(r) for r in read_dataset(spark, ["/no/such"], fallback=[{"text": "a", "label": "1"}, {"text": "b"}]).collect()] == [("a", "1"), ("b", None)]
    empty = read_dataset(spark, ["/no/such"])
    assert empty.columns == ["text", "label"] and empty.collect() == []


def test_bipia(spark):
    df = spark.createDataFrame([(k, f"attack {k}" if k % 2 else " ", "mail", f"body {k}" if k % 3 else None) for k in range(20)], "id int, Attack_str string, task_name string, document string")
    got = [r.asDict() for r in hub.load_bipia(df, "id").collect()]
    bad = [r for r in got if r["label"] == "malicious"]
    assert {r["session_id"] for r in bad} == {f"bipia-mail-{k}" for k in range(1, 20, 2)}
    good = [r for r in got if r["label"] == "benign"]
    assert len(good) == 5 and all(r["action"].startswith("body") for r in good)
    plain = hub.load_bipia(df.select("id", F.col("document").alias("Prompt")), "id").collect()
    assert len(plain) == 13 and {r["session_id"] for r in plain} >= {"bipia-1"}
