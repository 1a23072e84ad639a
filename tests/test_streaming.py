import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from emberlane.streaming import caches, sinks


def brute(rows, size, lifetime):
    """The bounded cache of each session, by its definition: insertion time decides a text's life, last use its place."""
    out, state = {}, {}
    for event, at, session, text in sorted(rows, key=lambda r: (r[1], r[0])):
        last, held = state.get(session, (None, OrderedDict()))
        fresh = last is None or at - last > lifetime
        if fresh:
            held = OrderedDict()
        hit = text in held and at - held[text] < lifetime
        if hit:
            held.move_to_end(text)
        else:
            held.pop(text, None)
            held[text] = at
            if len(held) > size:
                held.popitem(last=False)
        state[session] = (at, held)
        out[event] = (hit, len(held), fresh)
    return out


@pytest.mark.parametrize("size,lifetime", [(3, 3600), (50, 900)])
def test_caches_match_a_bounded_cache(spark, tmp_path, size, lifetime):
    r = random.Random(size)
    rows, at = [], {s: 1_704_067_200 for s in "abcde"}
    for event in range(600):
        s = r.choice("aaabcde")
        at[s] += r.choice((0, 1, 30, 400, 1200, 4000 if r.random() < 0.1 else 5))
        rows.append((event, at[s], s, r.choice("tuvwxyz")))
    # sessions' own time goes on in every batch
    df = spark.createDataFrame(rows, "event long, at long, s string, text string").select("event", F.timestamp_seconds("at").alias("time"), "s", "text", F.expr("event div 200").alias("arrival"))

    def run(stream):
        used = caches.session_caches(stream, "s", "event", "text", "time", size, lifetime, late="30 days")
        return used.writeStream.foreachBatch(sinks.batch_writer(f"{tmp_path}/used")).option("checkpointLocation", f"{tmp_path}/checkpoint")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with caches.state_with_timers(spark):
        total = sinks.replay(df, "arrival", run, str(tmp_path))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {x.event: (x.hit, x.held, x.fresh) for x in sinks.written_batches(spark, f"{tmp_path}/used", caches.OUTPUT).collect()}
    want = brute(rows, size, lifetime)
    assert got == want and total["input"] == 600
    assert {h for h, _, _ in want.values()} == {True, False} and max(n for _, n, _ in want.values()) >= min(size, 5)


def test_idle_sessions_are_cleared(spark, tmp_path):
    rows = [(0, 0, "a", "x"), (1, 10, "b", "x"), (2, 100_000, "b", "y"), (3, 100_001, "a", "x")]
    df = spark.createDataFrame(rows, "event long, at long, s string, text string").select("event", F.timestamp_seconds(F.col("at") + 1_704_067_200).alias("time"), "s", "text", F.col("event").alias("arrival"))

    def run(stream):
        return caches.session_caches(stream, "s", "event", "text", "time", late="1 minute").writeStream.foreachBatch(sinks.batch_writer(f"{tmp_path}/used")).option("checkpointLocation", f"{tmp_path}/checkpoint")

    with caches.state_with_timers(spark):
        sinks.replay(df, "arrival", run, str(tmp_path))
    got = {x.event: (x.hit, x.held, x.fresh) for x in sinks.written_batches(spark, f"{tmp_path}/used", caches.OUTPUT).collect()}
    assert got == {0: (False, 1, True), 1: (False, 1, True), 2: (False, 1, True), 3: (False, 1, True)}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    write = sinks.batch_writer(f"{tmp_path}/out")
    df = spark.createDataFrame([(1,), (2,)], "id long")
    for number in (0, 1, 1, 0):
        write(df.where(f"id = {number + 1}"), number)
    assert sorted(r.id for r in sinks.written_batches(spark, f"{tmp_path}/out", "id long").collect()) == [1, 2]


def test_feedback_is_redacted_and_counts_what_it_leaves_out(spark, tmp_path):
    rows = [(0, "mail joe@x.org", "bob@y.org said", 0), (1, None, "nothing", 0), (2, "password = hunter2", None, 1), (3, None, None, 1), (4, "plain", "x", 1)]
    df = spark.createDataFrame(rows, "id long, action string, reason string, arrival int")
    sinks.replay(df, "arrival", lambda s: sinks.feedback_sink(s, f"{tmp_path}/out", f"{tmp_path}/checkpoint"), str(tmp_path))
    kept = sinks.written_batches(spark, f"{tmp_path}/out/kept", "id long, action string, reason string", "json").collect()
    assert sorted(map(tuple, kept)) == [(0, "mail [REDACTED_EMAIL]", "[REDACTED_EMAIL] said"), (2, "password = [REDACTED_GENERIC_SECRET]", None), (4, "plain", "x")]
    assert sinks.dropped(spark, f"{tmp_path}/out") == 2


def test_late_rows_are_counted(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, 1000 * b - r.choice((0, 100, 2500)), b) for b in range(4) for k in range(b * 50, b * 50 + 50)]
    df = spark.createDataFrame(rows, "id long, at long, arrival int").select("id", F.timestamp_seconds(F.col("at") + 1_704_067_200).alias("time"), "arrival")
    total = sinks.replay(df, "arrival", lambda s: sinks.within_watermark(s, "time", ["id"], "20 minutes").writeStream.foreachBatch(sinks.batch_writer(f"{tmp_path}/kept")).option("checkpointLocation", f"{tmp_path}/checkpoint"), str(tmp_path))
    kept = {x.id for x in sinks.written_batches(spark, f"{tmp_path}/kept", "id long, time timestamp").collect()}
    tops = {b: max((at for _, at, x in rows if x < b), default=None) for b in range(4)}
    want = {k for k, at, b in rows if tops[b] is None or at > tops[b] - 1200}
    assert kept == want and total == {"input": 200, "late": 200 - len(want)} and total["late"] > 0


def test_late_data_with_repeated_ids_and_split_seconds(spark, tmp_path):
    """ids that repeat, a time that rounds into the next arrival and rows without a time, against the SQL."""
    import duckdb

    from emberlane.plans import all_oracles, all_queries

    rows = [(1, "2024-01-02 23:00:00", "a", 0), (1, "2024-01-02 22:00:00", "a", 0), (2, "2024-01-01 17:59:59.7", "a", 30), (2, "2024-01-02 12:00:00", "b", 90), (3, None, "b", 1)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, k int")
    df.selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "event_type", "concat('{\"k\": ', k, '}') AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [(x.event_type, x.late, x.in_time) for x in all_queries()["ts_late_data"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(all_oracles()["ts_late_data"]).fetchall()) == [("a", 1, 2), ("b", 0, 1)]
