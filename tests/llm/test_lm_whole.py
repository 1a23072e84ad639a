import time

import numpy as np
from pyspark.sql import functions as F

from emberlane.llm import gru, lm


def test_training_reads_every_segment(spark, monkeypatch):
    """F8: by default the network was fitted to one segment in 32."""
    seen = []
    real = lm._segments
    monkeypatch.setattr(lm, "_segments", lambda docs, v, share, segment: (seen.append(share), real(docs, v, share, segment))[1])
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c w"), F.col("id").cast("string")).alias("text"))
    assert lm.score_documents(docs, F.col("doc_id") % 5 == 1, least_tokens=1).count() == 60
    assert seen == [1.0]


def test_training_takes_a_few_times_as_long_as_scoring():
    """Training on all tokens took five to eight times as long as scoring them; what does not wait for a step is now taken by windows."""
    r = np.random.default_rng(5)
    first = np.arange(0, 100_001, 400)
    ids = np.minimum(r.zipf(1.2, first[-1]), 4127).astype(np.uint16)
    net = gru.start_weights(np.bincount(ids, minlength=4128)[:4096] + 0.5, np.full(32, 9.5), 64, 16)

    def least(f):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            f(net, ids, first, 4096)
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(gru.train) < 4.3 * least(gru.score)
