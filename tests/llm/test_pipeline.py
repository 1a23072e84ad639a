import random

from tokenizers import Tokenizer

import corpus_pipeline
from emberlane.llm import decontaminate
from emberlane.llm.queries import tokenizer_json
from emberlane.llm.scratch import materialize
from tests.llm import reference as ref
from tests.llm.test_operators import prose


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(1)
    base = [prose(k, 150) + "\n" + prose(1000 + k, 40) for k in range(40)]
    item = prose(77, 40)
    texts = [*base, *base[:5], *[b + " end" for b in base[5:8]], base[9] + "\n" + item, "# | # " * 40, "short", None, "\n".join(["same line of text"] * 30)]
    r.shuffle(texts)
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(t in base), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns
    one = materialize(stages["quality rules"](spark, df, folder), "t1")
    assert one.columns == columns
    kept = {x.doc_id: x.text for x in one.collect()}
    assert set(kept) <= {k for k, t in enumerate(texts) if not ref.quality(t)[5]} and {k for k, t in enumerate(texts) if t in base} <= set(kept)

    two = materialize(stages["line dedup"](spark, one, folder), "t2")
    assert two.columns == columns
    rows = sorted(kept.items())
    want = {i: t for (i, _), (t, _, _) in zip(rows, ref.dedup_lines(rows)) if ref.WORD.search(t)}
    assert {x.doc_id: x.text for x in two.collect()} == want and all(x.n_chars == len(x.text) for x in two.collect())

    three = materialize(stages["near dedup"](spark, two, folder), "t3")
    rows = sorted(want.items())
    comp = ref.components([i for i, _ in rows], [ref.fingerprint(t) for _, t in rows])
    want = {i: t for (i, t), c in zip(rows, comp) if c == i}
    assert {x.doc_id: x.text for x in three.collect()} == want

    four = materialize(stages["decontamination"](spark, three, folder), "t4")
    tokens = item.lower().split()[: decontaminate.WINDOW]
    assert {x.doc_id for x in four.collect()} == {i for i, t in want.items() if " ".join(tokens) not in t.lower()}

    packed = stages["packing"](spark, four, folder).collect()
    assert {x.doc_id for x in packed} == {x.doc_id for x in four.collect()}
    whole = corpus_pipeline.run(spark, folder).collect()
    tokens_of = lambda rows: sorted({(x.doc_id, x.doc_tokens) for x in rows})
    assert tokens_of(whole) == tokens_of(packed) and sum(x.length for x in whole) == sum(x.length for x in packed)


EXTRA = ("row", "kept", "items", "text_key", "grp", "fp", "_id", "_key", "_gone", "_row", "d", "t", "at", "raw", "_text", "score", "kept_text")


def edge_tables(spark, folder, rows, labels, items):
    docs = spark.createDataFrame([(*x, *["z"] * len(EXTRA)) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_each_stage_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    long_text, other = prose(1, 60_000), prose(2, 90)
    item = prose(77, 40)
    rows = [(1, long_text), (1, long_text), (2, other), (2, other), (2, prose(3, 70)), (None, other), (None, prose(4, 80)), (None, None), (3, None), (4, ""), (5, " \n "), (None, prose(5, 60) + " " + item), (6, prose(6, 50) + "\n" + prose(6, 50)), (7, "word")]
    rows = [(i, t, None, None, None) for i, t in rows]
    labels = [(1, 1, 0), (2, 1, 0), (None, 0, 1), (9, None, None)]
    docs = edge_tables(spark, str(tmp_path), rows, labels, [(1, item), (None, None), (None, "")])
    stages = dict(corpus_pipeline.STAGES)
    key = lambda x: (x[0] is not None, str(x))
    pairs = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=key)
    good = stages["quality rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and set(pairs(good)) <= {(i, t) for i, t, *_ in rows if not ref.quality(t)[5]}
    lines = stages["line dedup"](spark, docs, str(tmp_path))
    mine = [(i, t) for i, t, *_ in rows]
    want = [(i, t) for (i, _), (t, _, _) in zip(mine, ref.dedup_lines(mine)) if t and ref.WORD.search(t)]
    assert lines.columns == docs.columns and pairs(lines) == sorted(want, key=key) and all(x.n_chars == len(x.text) and x.row == "z" for x in lines.collect())
    near = stages["near dedup"](spark, docs, str(tmp_path))
    got = pairs(near)
    assert near.columns == docs.columns and got.count((1, long_text)) == 1 and got.count((2, other)) == 1 and (None, other) not in got and (2, prose(3, 70)) in got
    assert [x for x in got if not (x[1] or "").strip()] == [(3, None)]
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and pairs(clean) == sorted(((i, t) for i, t in mine if item not in (t or "")), key=key)  # a null id does not drag others along
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    encoder = Tokenizer.from_str(tokenizer_json())
    assert {x.doc_id for x in packed} == {i for i, _ in mine} and sum(x.length for x in packed) == sum(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in mine)
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 2, None, 6}


def test_empty_tables_in_every_stage(spark, tmp_path):
    docs = edge_tables(spark, str(tmp_path), [], [], [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
