import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from emberlane.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=10, top=10):
    """By the definitions, of (text, lang, source) rows."""
    docs = [((lang or "", source or ""), TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = set()
    for lang in {g[0] for g, _ in docs}:
        held = Counter(t for g, terms in docs if g[0] == lang for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        count = {}
        for g, terms in docs:
            if g[0] == lang:
                count.setdefault(g[1], Counter()).update(t for t in terms if t in set(kept))
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in count:
            pairs = [(sum(f(p(count[s], t), p(count[u], t)) for t in kept), u) for u in count if u != s]
            terms = [(f(p(count[s], t), p(whole, t)), t) for t in kept if count[s][t] > 0 and p(count[s], t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    names = ["alpha", "Beta", "gamma", "ÉTÉ", "straße", "née", "été", "数据", "a", "B", "zeta", "eta", "theta", "iota", "kappa", "x1y", "don't"]
    out = []
    for k in range(400):
        source = r.choice(["hot"] * 5 + [f"s{j}" for j in range(9)])
        weight = [1 + (hash_of(source) * (j + 3)) % 7 for j in range(len(names))]
        out.append((" ".join(r.choices(names, weight, k=r.randint(1, 30))), r.choice(["en", "en", "de", "fr"]), source))
    rare = [(" ".join(["rare%s" % "abcdefgh"[k % 8]] * (k % 3 + 1)), "en", f"s{k % 3}") for k in range(120)]
    return [*out, *rare, *out[:3], (None, "en", "nothing"), ("", "en", "nothing"), ("12 34", "es", "one"), ("12 34", "es", None), ("solo", "xx", "only"), (None, None, None), ("word " * 60_000, "en", "hot")]


def hash_of(s):
    return sum(s.encode())


SCHEMA = "text string, lang string, source string, item string, value long, rank int, part string, n long, term string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "p", 3, "t") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [{}, {"block": 3, "tile_rows": 40, "pool_tokens": 300}, {"heavy_share": 0.0}, {"heavy_share": 2.0, "block": 2}, {"heavy_share": 0.8, "tile_rows": 64}])
def test_brute_force(spark, rows, options):
    got = [tuple(r) for r in divergence.audit_sources(frame(spark, rows), **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_ties_and_empty(spark):
    rows = [("aa bb", "en", s) for s in "abc" for _ in range(10)]
    got = {tuple(r) for r in divergence.audit_sources(frame(spark, rows)).collect()}
    assert got == brute(rows) and {r[4] for r in got} == {0}
    assert [r[5] for r in sorted(got) if r[1] == "b"] == [1, 2]
    assert divergence.audit_sources(frame(spark, rows).limit(0)).collect() == []


def test_shares_beyond_64_bits(spark):
    big = 9 * 10**14
    df = spark.createDataFrame([(big, 10 * big, 10**6)], "n long, total long, vocab long")
    assert df.select(divergence.share("n", "total", "vocab").alias("p")).first()["p"] == 1 + 10**9 * (big + 2) // (10 * big + 2 * 10**6)


def test_pair_sums_of_one_tile():
    r = np.random.default_rng(1)
    n, terms = 9, 60
    p0 = r.integers(1, 1000, n)
    p = np.where(r.random((terms, n)) < r.random((terms, 1)), r.integers(1, 10**9, (terms, n)), 0)
    t, row = np.nonzero(p)
    many = (p > 0).sum(axis=1)
    for share in (0.0, 0.5, 2.0):
        out = divergence.pair_sums(row, t, p[t, row], (many >= share * n)[t], p0, np.ones(n, bool), np.ones(n, bool))
        whole = np.where(p > 0, p, p0)
        for i, j in itertools.permutations(range(n), 2):
            want = sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) - (int(p0[i]) - int(p0[j])) ** 2 // int(p0[i] + p0[j]) for a, b in zip(whole[:, i], whole[:, j]))
            assert out[i, j] == want
