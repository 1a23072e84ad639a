import random

import numpy as np

from emberlane.operators import folds, similar


def _by_brute_force(sets, t):
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) >= t * len(x | y):
                out[a, b] = len(x & y) / len(x | y)
    return out


def _random_sets(r):
    """Sets of 1 to 120 words from few and from many words, with near copies, and a chain of 40 sets that follow each other."""
    word = lambda: r.choice([r.randint(0, 30), r.randint(0, 3000)]) * 0x9E3779B97F4A7C15 % (1 << 63)
    sets = [{word() for _ in range(r.choice([1, 2, 5, 7, 12, 30, 60, 120]))} for _ in range(150)]
    for s in r.sample(sets, 60):
        sets.append(set(r.sample(sorted(s), max(1, len(s) - r.randint(0, 1 + len(s) // 8)))) | {word() for _ in range(r.randint(0, 1 + len(s) // 12))})
    chain = [word() for _ in range(100)]
    sets += [set(chain[k : k + 60]) for k in range(40)]
    r.shuffle(sets)
    return dict(enumerate(sets))


def test_similar_pairs_are_those_of_brute_force(spark, monkeypatch):
    """no pair is left out by parts, parities, clusters or blocks."""
    monkeypatch.setattr(similar, "AT_ONCE", 500)
    for seed, t, most in ((1, 0.85, 512), (2, 0.85, 3), (3, 0.6, 5)):
        sets = _random_sets(random.Random(seed))
        df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()] + [(None, [1, 2]), (1000, [])], "id long, w array<long>")
        got = {(x["first"], x["id"]): x["similarity"] for x in similar.similar(df.repartition(3), t, most=most).collect()}
        want = _by_brute_force(sets, t)
        assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_similar_sets_share_a_part_by_which_one_looks():
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 100, 333]:
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for gone in range(int(0.15 * n) + 1):  # b is less than a by so many words
            b = a[gone:]
            at, sig, role = similar.part_keys(np.concatenate([a, b]), np.array([0, n, 2 * n - gone]), 0.85)
            assert set(sig[(at == 0) & (role > 1)]) & set(sig[(at == 1) & (role % 2 == 1)])


def test_word_sets_stay_where_their_rows_are(spark, monkeypatch):
    """every row's whole set was shuffled to be told apart, and its words again to be counted and ranked."""
    seen, real = {}, folds.written
    monkeypatch.setattr(folds, "written", lambda df, name, *a: (seen.setdefault(name, df), real(df, name, *a))[1])
    d = spark.createDataFrame([(k, " ".join(f"w{k % 7 * 3 + j}" for j in range(20))) for k in range(50)], "k long, t string")
    assert folds.nearest_duplicates(d, "k", "t").count() == 43
    assert "Exchange" not in seen["sets"]._jdf.queryExecution().executedPlan().toString()


def test_rounds_do_not_grow_with_a_group(spark, monkeypatch):
    """of rows that are all alike, each round settled one, with three tables a round."""
    names, real = [], folds.written
    monkeypatch.setattr(folds, "written", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])
    d = spark.createDataFrame([(k, " ".join([*(f"w{j}" for j in range(60)), f"x{k}"])) for k in range(12)], "k long, t string")
    assert [x.id for x in folds.minhash_dedup(d, "k", "t").collect()] == [0]
    assert len(names) <= 8


def test_parities_tell_long_sets_apart(spark):
    """512 bits ruled out no pair of sets of some 2,000 words."""
    r = np.random.default_rng(6)
    a = r.integers(-(1 << 62), 1 << 62, 2600)
    sets = {1: a[:2100], 2: a[:2000], 3: r.integers(-(1 << 62), 1 << 62, 2050), 4: a[300:2340]}  # 2,048 words take twice the bits
    df = spark.createDataFrame([(k, w.tolist()) for k, w in sets.items()], "id long, w array<long>")
    pairs = spark.createDataFrame([(x, y) for x in sets for y in sets if x < y], "first long, id long")
    got = {tuple(x) for x in similar._may_be(pairs, similar._sketched(df), 0.85).collect()}
    assert (1, 2) in got and not got & {(1, 3), (2, 3), (3, 4)}
