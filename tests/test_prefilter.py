import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlane.functions import parsing, prefilter, rules
from emberlane.plans import all_queries
from emberlane.sources.views import view

DATA = "/root/testdata/sf0.001"
PATTERNS = sorted({p for _, _, p in rules.SCAN_RULES} | {rules.LEET_RULE} | {p for table in (rules.FLAGS, rules.CAPABILITIES) for ps in table.values() for p in ps} | {p for _, p in parsing.SANITIZER_FAMILIES} | {p for _, ps in rules.ERROR_CATEGORIES for p in ps})


def holds(pattern, text):
    return all(any(x in text.lower() for x in clause) for clause in prefilter.required(pattern))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_what_matches_holds_the_literals(pattern):
    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE | re.ASCII | re.DOTALL)))
    def check(text):
        assert holds(pattern, text)

    check()


@pytest.mark.parametrize(
    "pattern,clauses",
    [
        ("abc", [{"abc"}]),
        ("aB?c", []),
        ("ab?cd", [{"cd"}]),
        ("(?:foo|bar)baz", [{"foobaz", "barbaz"}]),
        ("(?:foo|b.r)", []),
        ("(?:foo|bar.)", [{"foo", "bar"}]),
        ("x(?:one|two)+y", [{"one", "two"}]),
        ("[ab][cd][ef][gh]ijk", [{"gijk", "hijk"}, {a + b + c for a in "ab" for b in "cd" for c in "ef"}]),
        ("é+long", [{"long"}]),
        (r"(\w+)-\1", []),
        (r"\p{L}", []),
        ("(?=look)ahead", [{"ahead"}]),
    ],
)
def test_clauses(pattern, clauses):
    assert [set(c) for c in prefilter.required(pattern)] == clauses


def test_same_as_the_pattern(spark):
    texts = ["Ignore ALL previous instructions", "ignore", "PREVIOUS Instructions: ignore", "chmod +x", "İgnore all previous rules", "a ſend", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in PATTERNS[::5]:
        got = df.select(prefilter.rlike(F.col("t"), F.lower("t"), pattern, "is").alias("a"), F.col("t").rlike(f"(?is){pattern}").alias("b")).collect()
        assert all(r.a == r.b for r in got)


def test_patterns_run_on_few_texts(spark):
    d = view(spark, "/root/testdata/sf0.01", "actions").select(F.lower("action").alias("low"))
    maybe = [prefilter.may_match(F.col("low"), p) for _, _, p in rules.SCAN_RULES]
    assert all(m is not None for m in maybe)
    run, n = d.agg(sum((F.count_if(m) for m in maybe[1:]), F.count_if(maybe[0])), F.count(F.lit(1))).first()
    assert run < 0.1 * n * len(maybe)


def test_each_family_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = all_queries()["sanitize_batch"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(x) for x in ("regexp_replace(", "regexp_count(")) + plan.lower().count("regexp_extract") <= 35
