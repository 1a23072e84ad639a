import random

from emberlane.operators import memory


def test_taint_moves_texts_once_and_no_trigrams(spark):
    """each text's trigrams were shuffled, the outputs' ones three times over."""
    r = random.Random(4)
    rows = [(s, k, r.choice(["tool_call", "prompt"]), "".join(r.choice("abç ") for _ in range(r.choice([5, 11, 30, 60])))) for s in (1, 2, 3, None) for k in range(1, 25)]
    rows += [(5, 1, "tool_call", "the same words"), (5, None, "prompt", "the same words"), (5, 2, "tool_call", None), (5, 3, "prompt", "THE SAME WORDS")]
    df = memory.semantic_taint(spark.createDataFrame(rows, "session_id long, step long, action_type string, action string"))
    # texts to their session, and ids with their similarity
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "regexp_extract_all" not in plan
    got = {(x.session_id, x.step): x.similarity for x in df.collect()}
    grams = lambda t: {t.lower()[k : k + 3] for k in range(len(t) - 2)}
    for s, k, _, text in rows:
        said = [grams(t) for i, j, kind, t in rows if None not in (s, k, i, j, t) and i == s and j < k and kind == "tool_call" and len(t) > 10][-3:]
        own = grams(text or "")
        want = max([len(own & g) / len(own | g) for g in said], default=0.0)
        assert abs(got[s, k] - want) < 1e-8
