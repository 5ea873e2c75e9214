"""Benchmark files, tracking tables and query suites on disk."""

import json

from pyspark.sql import functions as F

from tidemark.plans import compare
from tidemark.sources import benchmarks, schemas, suite, tables

ITEM = {"id": "k1", "question": "q", "korean_question": "질문", "expected_sql": "SELECT 1", "category": "kpi", "difficulty": "easy"}


def test_bare_and_wrapped_benchmark_files(spark, tmp_path):
    (tmp_path / "bare.json").write_text(json.dumps([ITEM, {**ITEM, "id": "k2"}], ensure_ascii=False, indent=2))
    (tmp_path / "wrapped.json").write_text(json.dumps({"benchmarks": [{**ITEM, "id": "k3"}], "metadata": {"total_count": 1}}))
    got = benchmarks.read_benchmarks(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == ["k1", "k2", "k3"]
    assert {r.difficulty for r in got} == {"easy"}


def test_markdown_directory(spark, tmp_path):
    full = "## 1. 제목 하나 ✅\n\n**Question:** What?\n\n```sql\nSELECT 1\nFROM t\n```\n"
    (tmp_path / "a.md").write_text("# Top\n\n" + full + "\n### 2. no question\n```sql\nSELECT 2\n```\n")
    (tmp_path / "b.md").write_text(full)
    (tmp_path / "sub folder").mkdir()
    (tmp_path / "sub folder" / "a.md").write_text(full)
    strict = benchmarks.ingest_dir(spark, str(tmp_path))
    found = {r.source_file.split(f"{tmp_path}/")[1]: r.row_count for r in benchmarks.rows_per_file(strict).collect()}
    assert found == {"a.md": 1, "b.md": 1, "sub folder/a.md": 1}
    row = strict.filter("source_file like '%/a.md' and source_file not like '%sub folder%'").first()
    assert (row.question, row.korean_question, row.expected_sql, row.question_number) == ("What?", "제목 하나", "SELECT 1\nFROM t", 1)
    loose = benchmarks.ingest_dir(spark, str(tmp_path), require_question=False)
    assert loose.filter("question = 'no question'").count() == 1


def test_declared_tables(spark):
    spark.sql("create database if not exists tracking")
    assert len(schemas.ensure_tables(spark, "tracking")) == len(schemas.TABLES)
    assert schemas.ensure_tables(spark, "tracking") == []
    lessons = spark.createDataFrame([("l1", "p", None)], "lesson_id string, pattern string, status string")
    tables.append_rows(lessons, "tracking.enhancement_lessons_learned", table="enhancement_lessons_learned")
    row = tables.read_table(spark, "tracking.enhancement_lessons_learned").first()
    assert (row.status, row.times_encountered, row.run_id) == ("active", 1, None)
    run = spark.createDataFrame([("r1",)], "run_id string").withColumn("started_date", F.to_date(F.lit("2024-01-01")))
    tables.append_rows(run, "tracking.enhancement_runs", table="enhancement_runs")
    assert str(tables.read_table(spark, "tracking.enhancement_runs").first().started_date) == "2024-01-01"


def test_suite_results_feed_the_comparison(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("numbers")
    good = [("q1", "select id, id * 2 as d from numbers"), ("q2", "select max(id) as m from numbers"), ("q3", "select nope from numbers")]
    other = [("q1", "select id as a, id + id as b from numbers order by 1 desc"), ("q2", "select min(id) from numbers"), ("q3", "select 1")]
    report = {r.query_id: (r.status, r.row_count) for r in suite.run_sql_suite(spark, good, into=str(tmp_path / "e")).collect()}
    assert report == {"q1": ("SUCCEEDED", 10), "q2": ("SUCCEEDED", 1), "q3": ("FAILED", None)}
    suite.run_sql_suite(spark, other, into=str(tmp_path / "a"))
    expected, actual = (spark.read.parquet(str(tmp_path / s)) for s in ("e", "a"))
    got = {r.pair_id: r.passed for r in compare.compare_results(expected, actual).collect()}
    assert got == {"q1": True, "q2": False, "q3": False}
