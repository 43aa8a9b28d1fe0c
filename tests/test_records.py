"""Metrics, buckets and gates of records on small fixtures; every reason code and bucket occurs."""

import pytest
from pyspark.sql import functions as F

from speechloom.operators import augmented_gate as G
from speechloom.operators import entities as E
from speechloom.operators import record_metrics as M
from speechloom.plans import metric_queries as Q

SCHEMA = (
    "name string, output string, actual string, category string, combo string, transformations array<string>, corrections array<struct<abandoned:string,kept:string>>, "
    "reformulations array<struct<mode:string,abandoned:string>>, formatting struct<type:string>, preserved array<string>, preservation_case boolean"
)
SAID = "Meet Hana on Friday at 5 pm."
CASES = [
    # name, output, actual, category, transformations, corrections, reformulations, formatting, preserved, preservation_case, metrics, bucket
    ("perfect", SAID, SAID, "mixed", ["filler", "self_correction"], [("Ada", "Hana")], None, None, ["Hana"], False, dict(exact_match=True, compositional_pass=True, entity_preservation=1.0, hallucination_flag=False), None),
    ("abandoned kept", SAID, "Meet Ada on Friday at 5 pm.", "mixed", ["self_correction"], [("Ada", "Hana")], None, None, None, False, dict(correction_resolution=False, hallucination_flag=False, compositional_pass=False), "correction_resolution"),
    ("invented", SAID, "Meet Hana on Friday and Monday at 5 pm.", "basic", [], None, None, None, None, False, dict(hallucination_flag=True), "hallucination"),
    ("filler left", SAID, "Um, meet Hana on Friday at 5 pm.", "filler", ["filler"], None, None, None, None, False, dict(compositional_pass=False, normalized_match=False), "partial_rewrite"),
    ("verbose", SAID, SAID + " I will see all of you there then, so long.", "basic", [], None, None, None, None, False, dict(verbosity_flag=True), "verbosity"),
    ("case only", SAID, SAID.lower().replace("hana", "Hana"), "basic", [], None, None, None, None, False, dict(exact_match=False, normalized_match=True, compositional_pass=True), None),
    ("chained", "Call Jun.", "Call Hana and Jun.", "correction", ["self_correction"], [("Ada", "Hana"), ("Hana", "Jun")], None, None, None, False, dict(correction_resolution=False), "correction_resolution"),
    ("deletion", "Buy tea.", "Buy tea.", "correction", ["self_correction"], [("bread", "")], None, None, None, False, dict(correction_resolution=True), None),
    ("repeated", "Go home now.", "Go go home now.", "repetition", ["repetition"], None, None, None, None, False, dict(compositional_pass=False), "repetition_removal"),
    ("lost list", "- tea\n- milk", "tea, milk", "formatting", ["formatting"], None, None, ("bullet_list",), None, False, dict(formatting_ok=False), "formatting_failure"),
    ("near entity", "Deploy Kafka now.", "Deploy now on 10:30.", "basic", [], None, None, None, None, False, dict(hallucination_flag=True), "hallucination"),
    ("corrupt", "Ask 1234 and 1235 today.", "Ask 1235 and today.", "basic", [], None, None, None, None, False, dict(hallucination_flag=False), "entity_corruption"),
    ("deleted", "We left the old house early in spring.", "We left.", "basic", [], None, None, None, None, False, {}, "information_deletion"),
    ("long", "Ada and Hana went there. " * 9, "Ada went there. " * 9, "long", ["repetition"], None, None, None, None, False, dict(compositional_pass=False, entity_preservation=0.5), "entity_corruption"),
    ("signs", "Well, we go.", "Well we go", "basic", [], None, None, None, None, False, dict(normalized_match=False), "punctuation_only"),
    ("kept words", "It was very very good.", "It was good.", "basic", [], None, None, None, ["very very"], True, dict(preservation_ok=False), "repetition_removal"),
    ("restart", "We go home.", "We go, we go home.", "reformulation", ["reformulation"], None, [("restart", "We go")], None, None, False, dict(compositional_pass=False), None),
]


@pytest.fixture(scope="module")
def scored(spark):
    d = spark.createDataFrame([(n, o, a, c, None, t, k, r, f, p, flag) for n, o, a, c, t, k, r, f, p, flag, _, _ in CASES], SCHEMA)
    canon = lambda c: E.canonical(E.resolve(E.candidates(c)))
    d = d.withColumn("expected_canon", canon("output")).withColumn("actual_canon", canon("actual"))
    return {r.name: r for r in M.bucket(M.scored(d)).collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_metrics_and_bucket(scored, case):
    got = scored[case[0]]
    assert {k: got[k] for k in case[-2]} == case[-2]
    if case[0] != "restart":
        assert got.bucket == case[-1]


def test_every_reason_occurs(spark):
    got = {r.made: set(r.reasons) for r in G.report(Q.pairs(spark, "/root/testdata/sf0.01")).groupBy("made").agg(F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons")).collect()}
    codes = set().union(*got.values())
    assert codes >= {
        "MISSING_FIELDS", "EMPTY_OUTPUT", "TARGET_MODIFIED", "ENTITY_LOST", "UNEXPECTED_CHANGE", "TRANSFORMATION_NOT_REALIZED", "UNEXPECTED_ENTITIES", "INCOMPLETE_CORRECTION",
        "IDENTICAL_CORRECTION", "ABANDONED_MISSING", "EXCESSIVE_LENGTH", "OUTPUT_EXPANDED", "INVALID_LIST", "INVALID_LIST_FORMAT", "INVALID_HEADING",
    }
    assert got["good"] == set()


def test_gate_order_and_strictness(spark):
    rows = [("a", "hi", "Hello there.", None), ("b", "um, Hello there.", "Hello there.", "Hello there."), ("c", "um, Hello there.", "Hello there.", "Hello you."), ("d", "", "x", None)]
    none = F.expr("cast(array() as array<string>)")
    d = spark.createDataFrame(rows, "id string, input string, output string, original_clean string").withColumn("recipe", F.array(F.struct(F.lit("filler").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("abandoned", "retained", "format_type")])))
    r = G.report(d.withColumn("input_canon", none).withColumn("output_canon", none).withColumn("clean_canon", none))
    assert {x.id: x.reasons for x in r.collect()} == {"a": ["EMPTY_INPUT"], "b": [], "c": ["TARGET_MODIFIED"], "d": ["MISSING_FIELDS"]}
    assert {x.id for x in G.keep(r).collect()} == {"b"} and {x.id for x in G.keep(r, strict=False).collect()} == {"b", "c"}


def test_correction_and_entity_issues(spark):
    d = spark.createDataFrame([(1, [("Ada", "Hana")], ["ada", "hana"], ["hana"], ["hana"]), (2, [("Ada", "Ada")], ["hana"], ["ada", "jun"], ["hana", "jun"])], "id int, c array<struct<abandoned:string,kept:string>>, i array<string>, o array<string>, m array<string>")
    got = {r.id: (r.v4, r.v5) for r in d.select("id", G.correction_issues(F.col("c"), F.col("i"), F.col("o")).alias("v4"), G.entity_issues(F.col("m"), F.col("o")).alias("v5")).collect()}
    assert got == {1: ([], []), 2: (["same:ada", "not-in-input:ada", "leaked:ada"], ["only-declared:hana", "only-extracted:ada"])}


def test_failure_report_buckets_each_row_once(spark):
    """The counts of all rows and those by bucket come from one pass: the metrics of a row are not computed again for the join with the names."""
    seen = spark.sparkContext.accumulator(0)

    def named(i: int) -> str | None:
        seen.add(1)
        return M.BUCKETS[i % 3] if i % 4 else None

    rows = spark.range(0, 40, 1, 4).select(F.udf(named, "string")("id").alias("bucket"))
    got = M.failure_report(rows).collect()
    assert {r.bucket: r.n for r in got if r.n} == {M.BUCKETS[k]: sum(1 for i in range(40) if i % 4 and i % 3 == k) for k in range(3)}
    assert len(got) == 10 and {(r.records, r.failures) for r in got} == {(40, 30)}
    assert seen.value == 40
    none = M.failure_report(rows.where("false")).collect()
    assert [r.n for r in none] == [0] * 10 and {(r.records, r.share, r.failure_rate, r.advice) for r in none} == {(0, 0.0, 0.0, None)}
