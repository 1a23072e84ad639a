import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from emberlane.llm import trie
from emberlane.llm.queries import QUERIES
from emberlane.llm.running import running_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(c, by):
    return c - by * int(c / by)


def rebuild(rows):
    """Conversations by the definition, of (conv_id, turn, role, text) rows."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - remainder(c, 20), [])[:h] + v[h:])
    return out


def brute(convs):
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = set()
    for v, members in nodes.items():
        below = [w for w in nodes if w[: len(v)] == v]
        saved = sum((len(nodes[w]) - 1) * len(WORD.findall(w[-1][1])) for w in below if w)
        ends = ",".join(str(c) for c in sorted(members) if convs[c] == v)
        leaves = sum(1 for w in below if not any(x[:-1] == w for x in below if x))
        children = sum(1 for w in below if len(w) == len(v) + 1)
        out.add((min(members), len(v), min(nodes[v[:-1]]) if v else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-45, 130), 10**12, 10**12 + 1]:
        for t in range(r.choice((1, 1, 2, 3, 5, 12))):
            rows.append((c, t, r.choice(("user", "assistant", None)), r.choice(("hello", "hello there", "a b  c\td", "", None, "été né"))))
    rows += [(200 + k, t, "user", f"turn {t}") for k in range(90) for t in range(4)]  # a hot conversation
    rows += [(300, t, "user", f"long {t % 3}") for t in range(70)] + [(301, t, "user", f"long {t % 3}") for t in range(70)] + [(302, t, "user", f"long {t % 3}") for t in range(64)]
    rows += [(5, None, "system", "first"), (5, 2, "user", "tied"), (5, 2, "user", "tied"), (5, 2, "user", "other"), (None, 1, "user", "nobody"), (7, 99, "user", "x " * 50_000)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, pos long, sym string, depth int, id string, rank long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "i", 3) for r in rows], SCHEMA).repartition(4)


def nodes(df, **options):
    return trie.prefix_trie(trie.rebuilt(trie.ordered_turns(df)), **options)


@pytest.mark.parametrize("width", [256, 8, 4, 2])
def test_brute_force(spark, width):
    rows = conversations(1)
    got = nodes(frame(spark, rows), width=width).collect()
    plain = [tuple(r)[:8] for r in got]
    assert len(plain) == len(set(plain)) and set(plain) == brute(rebuild(rows))
    assert sorted(r["preorder"] for r in got) == list(range(1, len(got) + 1))
    by_name = {(r["conv_id"], r["depth"]): r for r in got}
    for r in got:  # a subtree is an interval inside its parent's
        if r["depth"]:
            up = by_name[r["parent_conv_id"], r["depth"] - 1]
            assert up["preorder"] < r["preorder"] <= r["subtree_end"] <= up["subtree_end"]


def test_preorder_is_lexicographic(spark):
    rows = conversations(2)
    order = {}
    for c, v in rebuild(rows).items():
        key = tuple(hashlib.md5(f"{len(a)}:{a}{b}".encode()).digest() for a, b in v)
        for d in range(len(key) + 1):
            order.setdefault(key[:d], []).append(c)
    want = [(min(order[k]), len(k)) for k in sorted(order)]
    for width in (256, 3):
        assert [(r["conv_id"], r["depth"]) for r in nodes(frame(spark, rows), width=width).orderBy("preorder").collect()] == want


def test_small_tables(spark):
    assert nodes(frame(spark, conversations(1)).limit(0)).collect() == []
    only = [r for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20 for r in [(c, 0, "user", "x")]]
    got = [tuple(r)[:8] for r in nodes(frame(spark, only)).collect()]  # no first of a family: all are left without turns
    assert got == [(min(r[0] for r in only), 0, None, len(only), 0, 1, 0, hashlib.sha256(",".join(str(r[0]) for r in only).encode()).hexdigest())]


def test_large_ends(spark):
    many = spark.range(20_000).select((F.col("id") * 20 + 10**6).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = {r["depth"]: r for r in nodes(many.repartition(7)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(k * 20 + 10**6) for k in range(20_000)).encode()).hexdigest()
    assert got[1]["n_convs"] == 20_000 and got[0]["saved_tokens"] == 19_999


def test_running_sums(spark):
    r = random.Random(5)
    rows = sorted((r.choice((1, 1, 1, 2, 3, 9)), k, r.randint(-3, 9)) for k in range(500))
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(3)
    whole = {x["k"]: x["s"] for x in running_sums(df, [F.col("g"), F.col("k")], {"s": "v"}, "t").collect()}
    inner = {x["k"]: x["s"] for x in running_sums(df, [F.col("g"), F.col("k")], {"s": "v"}, "t", "g").collect()}
    total, part, last = 0, 0, None
    for g, k, v in rows:
        total, part, last = total + v, (part if g == last else 0) + v, g
        assert whole[k] == total and inner[k] == part


def test_query_has_the_columns(spark):
    df = QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
