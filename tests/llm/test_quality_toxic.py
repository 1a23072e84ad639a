import random

from emberlane.llm import quality


def test_a_few_insults_in_a_long_text_reject_it(spark):
    r = random.Random(5)
    insults = ["Idiot", "moron,", "SCUM!", "loser", "clown."]

    def text(bad):
        words = [f"w{r.randint(0, 2000)}" for _ in range(300)]
        for w in r.sample(insults, 4 if bad else 0):
            words[r.randrange(300)] = w
        return " ".join(words)

    rows = [(k, text(k % 8 == 0)) for k in range(320)]
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels).select("row.doc_id", "n_toxic_words", "base_failed", "kept").collect()
    unlabelled = [x for x in out if 240 <= x.doc_id < 320]
    assert not any(x.kept for x in unlabelled if x.doc_id % 8 == 0)
    assert all(x.n_toxic_words == 0 for x in out if x.doc_id % 8)
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.toxic_words(docs, none) == [] and quality.toxic_words(docs, none.limit(0)) == []
