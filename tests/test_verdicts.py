"""Verdict texts, batch answers, responses and failure categories."""

import json

import pytest

from tidemark.plans import failures, verdicts

FULL = {"passed": False, "confidence": "high", "reasoning": "a {b}", "differences": ["x", "y"], "semantic_equivalence": "no"}


def parse(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return verdicts.parse_verdicts(df, "t").first()


@pytest.mark.parametrize(
    "text",
    [
        json.dumps(FULL),
        "```json\n" + json.dumps(FULL, indent=2) + "\n```",
        "```\n" + json.dumps(FULL) + "\n```",
        "Here is the comparison: " + json.dumps(FULL) + " and } more {",
        "Result:\n" + json.dumps(FULL),
        "```sql\nselect 1\n``` then " + json.dumps(FULL),
    ],
)
def test_every_wrapping_gives_the_same_verdict(spark, text):
    got = parse(spark, text)
    assert (got.passed, got.confidence, got.reasoning, got.differences, got.semantic_equivalence, got.parse_error) == (
        False, "high", "a {b}", ["x", "y"], "no", False,
    )


def test_missing_fields_get_defaults(spark):
    got = parse(spark, '{"passed": true}')
    assert (got.passed, got.confidence, got.reasoning, got.differences, got.semantic_equivalence) == (True, "medium", "", [], "")


@pytest.mark.parametrize(
    "text, passed",
    [
        ('{"passed": true, "reason', True),
        ('{"passed":false, ', False),
        ("This should pass.", True),
        ("pass or fail? unclear", False),
        ("The result is wrong", False),
        ("no idea", False),
        ("", False),
        ('{"verdict": "ok"} pass', True),
    ],
)
def test_inferred_verdicts(spark, text, passed):
    got = parse(spark, text)
    assert (got.passed, got.confidence, got.parse_error) == (passed, "low", True)


def test_batch_verdicts_attach_by_id(spark):
    answers = spark.createDataFrame(
        [
            (1, '```json\n[{"benchmark_id": "b", "passed": true}, {"benchmark_id": "a", "passed": false, "failure_reason": "r", "failure_category": "c"}]\n```'),
            (2, "sorry"),
            (3, '[{"benchmark_id": "e", "passed": true}, {"benchmark_id": "e", "passed": true}]'),
        ],
        "chunk int, t string",
    )
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e"), (4, "f")], "chunk int, benchmark_id string")
    got = {r.benchmark_id: (r.passed, r.failure_category) for r in verdicts.parse_batch_verdicts(answers, "t", asked).collect()}
    assert got == {
        "a": (False, "c"), "b": (True, None), "c": (False, "eval_parse_error"), "d": (False, "eval_missing"),
        "e": (True, None), "f": (False, "eval_parse_error"),
    }


@pytest.mark.parametrize(
    "document, sql, result, error",
    [
        ({"status": "COMPLETED", "attachments": [{"query": {"query": ["SELECT ", "1"]}}]}, "SELECT 1", None, None),
        ({"status": "COMPLETED", "attachments": [{"x": 1}, {"query": {"body": "S2"}}, {"sql": "S3"}]}, "S2", None, None),
        ({"status": "COMPLETED", "attachments": [{"query": {"description": "d"}}, {"sql": ["S", "4"]}]}, "S4", None, None),
        ({"status": "COMPLETED", "query": "S5", "attachments": []}, "S5", None, None),
        ({"status": "COMPLETED", "sql": "S6", "query_result": {"row_count": 0}}, "S6", '{"row_count":0}', None),
        ({"status": "COMPLETED", "query_result": {"statement_response": {"statement": {"sql": "S7"}}}}, "S7", None, None),
        ({"status": "COMPLETED", "attachments": [{"type": "QUERY_RESULT", "data": {"a": 1}}]}, None, '{"a":1}', None),
        ({"status": "FAILED", "error": "text"}, None, None, "text"),
        ({"status": "FAILED", "error": {"error": "e"}}, None, None, "e"),
        ({"status": "FAILED", "error": {"code": 3}}, None, None, '{"code":3}'),
        ({"status": "FAILED"}, None, None, "Unknown error"),
    ],
)
def test_extract_responses(spark, document, sql, result, error):
    df = spark.createDataFrame([(json.dumps(document),)], "d string")
    got = verdicts.extract_responses(df, "d").first()
    assert (got.status, got.sql, got.result, got.error) == (document["status"], sql, result, error)


def test_first_category_wins_and_patterns_are_literal(spark):
    rows = [("where clause and order by", "wrong_filter"), ("included x should be excluded", None), ("use sum(x)", "wrong_aggregation"), ("", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = df.select(failures.categorize_text(df.t).alias("c")).collect()
    assert [r.c for r in got] == [c for _, c in rows]


def test_parse_errors_count_once(spark):
    df = spark.createDataFrame(
        [("r", 1, False, "llm_parse_error", True), ("r", 2, False, "wrong_join", True), ("r", 3, True, None, None)],
        "run string, benchmark_id int, passed boolean, failure_category string, parse_error boolean",
    )
    got = {r.failure_category: (r.failures, r.parse_errors, r.share) for r in failures.failure_breakdown(df, ["run"]).collect()}
    assert got == {"llm_parse_error": (1, 1, 50.0), "wrong_join": (1, 1, 50.0)}


def test_reliability_percentiles(spark):
    df = spark.createDataFrame([("p", True, 1, "COMPLETED", float(i)) for i in range(1, 101)], "phase string, success boolean, attempts int, status string, duration double")
    got = failures.reliability_stats(df, ["phase"]).first()
    assert (got.median_duration, got.p95_duration, got.avg_duration, got.success_rate) == (50.0, 95.0, 50.5, 100.0)
