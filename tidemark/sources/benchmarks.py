"""Question and query sets from JSON, markdown and model documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import joined_lines, stable_id
from tidemark.sources.schemas import BENCHMARK


def read_benchmarks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Benchmark rows from JSON files: a bare array, a wrapped array, or JSON lines."""
    fields = [f.strip().split(" ")[0] for f in BENCHMARK.split(",")]
    schema = f"{BENCHMARK}, benchmarks array<struct<{BENCHMARK.replace(' ', ': ').replace(',: ', ', ')}>>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    bare = raw.filter(F.col("benchmarks").isNull()).select(*fields)
    wrapped = raw.filter(F.col("benchmarks").isNotNull()).select(F.explode("benchmarks").alias("b")).select("b.*")
    return bare.unionByName(wrapped).filter(F.col("expected_sql").isNotNull() | F.col("question").isNotNull())


def extract_qa_sections(df: DataFrame, text: str, source: str, require_question: bool = True) -> DataFrame:
    """Question, title and query of every numbered section of markdown texts.

    Sections that lack a part are dropped. With ``require_question=False`` the
    title stands in for a missing question line.
    """
    sections = df.select(source, F.explode(F.split(text, r"(?=##\s+\d+\.\s)")).alias("s"))
    numbered = sections.filter(F.col("s").rlike(r"^##\s+\d+\.\s+\S"))
    body = F.regexp_replace("s", r"^##\s+\d+\.\s+", "")
    title = F.trim(F.regexp_extract(body, r"^(.+?)\s*✅?[ \t]*(?:\r?\n|$)", 1))
    asked = F.trim(F.regexp_extract("s", r"\*\*Question:\*\*\s*(.+?)(?=\n|$)", 1))
    sql = F.trim(F.regexp_extract("s", r"(?s)```sql\s*\n(.*?)\n```", 1))
    question = asked if require_question else F.when(asked != "", asked).otherwise(title)
    rows = numbered.select(
        question.alias("question"),
        sql.alias("expected_sql"),
        title.alias("korean_question"),
        F.col(source).alias("source_file"),
        F.regexp_extract("s", r"^##\s+(\d+)\.", 1).cast("int").alias("question_number"),
    ).filter((F.col("question") != "") & (F.col("expected_sql") != ""))
    return rows.select(stable_id("source_file", "question_number", "question").alias("id"), *rows.columns)


def ingest_dir(spark: SparkSession, path: str, require_question: bool = True) -> DataFrame:
    """All sections of all markdown files below a path, tagged with their file's path.

    Files of one name in several folders stay apart.
    """
    path_of = F.url_decode(F.col("_metadata.file_path"))
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", path_of.alias("file"))
    return extract_qa_sections(texts, "value", "file", require_question)


def rows_per_file(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))


def write_benchmarks(df: DataFrame, path: str) -> None:
    """Write a set as JSON lines with its total and source files beside it."""
    df.write.mode("errorifexists").json(f"{path}/benchmarks")
    rows_per_file(df).write.mode("errorifexists").json(f"{path}/metadata")


def model_benchmarks(models: DataFrame, model_id: str = "model_id") -> DataFrame:
    """Question and query pairs embedded in model documents.

    ``questions`` is array<struct<id, question array<string>, answer
    array<struct<format, content array<string>>>>>; only SQL answers count.
    """
    asked = models.select(model_id, F.explode("questions").alias("q"))
    answered = asked.select(
        model_id,
        F.col("q.id").alias("id"),
        F.array_join("q.question", " ").alias("question"),
        F.explode("q.answer").alias("a"),
    )
    return answered.filter(F.col("a.format") == "SQL").select(
        model_id, "id", "question", joined_lines("a.content").alias("expected_sql")
    )
