"""Logged judge verdicts and logged responses, parsed with Spark's JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import joined_lines

VERDICT = (
    "passed string, confidence string, reasoning string, differences array<string>, semantic_equivalence string"
)
BATCH_VERDICT = "array<struct<benchmark_id string, passed string, failure_reason string, failure_category string>>"


def _object_from(text: Column) -> Column:
    """Text from the first brace on; the JSON reader stops at the matching one."""
    start = F.locate("{", text)
    return F.when(start > 0, F.substring(text, start, F.length(text)))


def _fenced_json(text: Column) -> Column:
    """Body of a ```json block, else of a plain block that holds an object."""
    tagged = F.regexp_extract(text, r"```json\s*([\s\S]*?)\s*```", 1)
    plain = F.trim(F.regexp_extract(text, r"```\s*([\s\S]*?)\s*```", 1))
    has_tag = text.rlike(r"```json\s*[\s\S]*?\s*```")
    return F.when(has_tag, tagged).when(plain.startswith("{"), plain)


def _is_true(c: Column) -> Column:
    """A JSON value taken as a flag: empty, zero and false are false."""
    return ~F.lower(c).isin("false", "0", "0.0", "", "null", "[]", "{}")


def inferred_pass(text: Column) -> Column:
    """Pass or fail guessed from the words of a text that is no JSON."""
    low = F.lower(text)

    def has(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        return found

    return (
        F.when(has('"passed": true', '"passed":true'), True)
        .when(has('"passed": false', '"passed":false'), False)
        .when(has("pass") & ~has("fail"), True)
        .otherwise(False)
    )


def parse_verdicts(df: DataFrame, c: str) -> DataFrame:
    """Verdict fields from free text.

    Tried in turn: a fenced block, the first object anywhere in the text, words.
    Missing fields get defaults; ``parse_error`` marks verdicts that were guessed.
    """
    text = F.col(c)
    held = df.withColumn("__fenced", F.from_json(_fenced_json(text), VERDICT)).withColumn(
        "__found", F.from_json(_object_from(text), VERDICT)
    )
    chosen = F.when(F.col("__fenced.passed").isNotNull(), F.col("__fenced")).otherwise(F.col("__found"))
    parsed = held.withColumn("__v", chosen).withColumn("parse_error", F.col("__v.passed").isNull())
    bad = F.col("parse_error")
    none = F.array().cast("array<string>")
    return parsed.withColumns(
        {
            "passed": F.when(bad, inferred_pass(text)).otherwise(_is_true(F.col("__v.passed"))),
            "confidence": F.when(bad, "low").otherwise(F.coalesce("__v.confidence", F.lit("medium"))),
            "reasoning": F.when(bad, "Failed to parse the verdict - inferred from text").otherwise(
                F.coalesce("__v.reasoning", F.lit(""))
            ),
            "differences": F.when(bad, F.array(F.lit("verdict parsing error"))).otherwise(
                F.coalesce("__v.differences", none)
            ),
            "semantic_equivalence": F.when(bad, "Unknown").otherwise(
                F.coalesce("__v.semantic_equivalence", F.lit(""))
            ),
        }
    ).drop("__fenced", "__found", "__v")


def _fenced_array(text: Column) -> Column:
    after_tag = F.split(F.get(F.split(text, "```json"), F.lit(1)), "```")
    after_mark = F.split(text, "```")
    body = F.when(text.contains("```json"), F.get(after_tag, F.lit(0))).when(
        text.contains("```"), F.get(after_mark, F.lit(1))
    )
    return F.trim(F.coalesce(body, text), F.lit(" \n\t\r"))


def parse_batch_verdicts(
    responses: DataFrame, c: str, questions: DataFrame, chunk: str = "chunk", key: str = "benchmark_id"
) -> DataFrame:
    """Verdicts of a chunk attached to its questions by id, not by position.

    A chunk whose text does not parse fails all its questions; a question the
    array leaves out fails on its own.
    """
    verdicts = responses.select(chunk, F.from_json(_fenced_array(F.col(c)), BATCH_VERDICT).alias("v"))
    readable = verdicts.select(chunk, F.col("v").isNotNull().alias("readable"))
    opened = verdicts.select(chunk, F.explode("v").alias("x")).select(
        chunk,
        F.col(f"x.{key}").alias(key),
        F.col("x.passed").alias("p"),
        F.col("x.failure_reason").alias("r"),
        F.col("x.failure_category").alias("k"),
    )
    # the same id twice in one answer: keep one, so a question is never multiplied
    single = opened.groupBy(chunk, key).agg(F.min(F.struct("p", "r", "k")).alias("x")).select(chunk, key, "x.*")
    typed = questions.withColumn(key, F.col(key).cast("string"))
    joined = typed.join(single.withColumn("__given", F.lit(True)), [chunk, key], "left").join(readable, chunk, "left")
    given, ok = F.col("__given").isNotNull(), F.coalesce("readable", F.lit(False))
    return joined.withColumns(
        {
            "passed": F.when(given, F.coalesce(_is_true(F.col("p")), F.lit(False))).otherwise(False),
            "failure_reason": F.when(given, F.col("r"))
            .when(ok, "No verdict for this question")
            .otherwise("Failed to parse evaluation"),
            "failure_category": F.when(given, F.col("k")).when(ok, "eval_missing").otherwise("eval_parse_error"),
        }
    ).drop("p", "r", "k", "__given", "readable")


RESPONSE = (
    "status string, sql string, query string, error string, query_result string, "
    "attachments array<struct<type:string,query:string,sql:string,data:string>>"
)
QUERY = "query string, body string, sql string, statement string, query_result_metadata string"
RESULT = (
    "rows string, data string, row_count string, "
    "statement_response struct<manifest:struct<sql:string>,statement:struct<sql:string>>"
)
ERROR = "message string, error string"


def _as_line(value: Column) -> Column:
    """A text, or an array of lines joined to one text; empty text counts as none."""
    lines = joined_lines(F.from_json(value, "array<string>"))
    return F.when(value.startswith("["), lines).when(value != "", value)


def _if_object(value: Column) -> Column:
    return F.when(value.startswith("{"), value)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def extract_responses(df: DataFrame, c: str) -> DataFrame:
    """Status, query text, result and error of a logged response document.

    The document is read once; nested objects stay JSON text until one of their
    fields is needed.
    """
    held = df.withColumn("__d", F.from_json(c, RESPONSE)).withColumns(
        {
            "__q": F.transform("__d.attachments", lambda a: F.from_json(_if_object(a["query"]), QUERY)),
            "__r": F.from_json("__d.query_result", RESULT),
            "__root": F.from_json(_if_object(F.col("__d.query")), QUERY),
        }
    )

    def attached_sql(a: Column, i: Column) -> Column:
        q = F.get(F.col("__q"), i)
        nested = F.coalesce(*[_as_line(q[name]) for name in ("query", "body", "sql", "statement")])
        plain = F.when((a["query"] != "") & ~a["query"].startswith("{"), a["query"])
        return F.coalesce(nested, plain, _as_line(a["sql"]))

    def attached_result(a: Column, i: Column) -> Column:
        return F.when(a["type"] == "QUERY_RESULT", a["data"]).otherwise(F.get(F.col("__q"), i)["query_result_metadata"])

    root_query = F.col("__d.query")
    sql = F.coalesce(
        _first(F.transform("__d.attachments", attached_sql)),
        _as_line(F.col("__r.statement_response.manifest.sql")),
        _as_line(F.col("__r.statement_response.statement.sql")),
        _as_line(F.col("__d.sql")),
        *[_as_line(F.col(f"__root.{name}")) for name in ("body", "sql", "statement")],
        F.when((root_query != "") & ~root_query.startswith("{"), root_query),
    )

    def holds(name: str) -> Column:
        return F.coalesce(~F.col(f"__r.{name}").isin("[]", "{}", ""), F.lit(False))

    status, error = F.col("__d.status"), F.col("__d.error")
    parsed_error = F.from_json(_if_object(error), ERROR)
    message = F.coalesce(parsed_error["message"], parsed_error["error"], F.when(error != "", error), F.lit("Unknown error"))
    has_result = holds("rows") | holds("data") | F.col("__r.row_count").isNotNull()
    return held.withColumns(
        {
            "status": status,
            "sql": sql,
            "result": F.when(has_result, F.col("__d.query_result")).otherwise(
                _first(F.transform("__d.attachments", attached_result))
            ),
            "error": F.when(status == "FAILED", message),
        }
    ).drop("__d", "__q", "__r", "__root")
