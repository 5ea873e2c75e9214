"""Result comparison, verdict parsing and failure analysis over the stand-in views.

Logged texts (verdicts, responses, errors) are built by Spark from the given
tables, one per row; the check queries state what each of them must yield.
"""

from pyspark.sql import functions as F

from tidemark.plans import compare, failures, verdicts
from tidemark.registry import query

COUNTS = """e as (select pair_id, count(*) as n from pair_expected group by 1), a as (select pair_id, count(*) as n from pair_actual group by 1),
  t as (select coalesce(e.pair_id, a.pair_id) as pair_id, coalesce(e.n, 0) as expected_rows, coalesce(a.n, 0) as actual_rows,
          coalesce(m.n, 0) as matched_rows from e full join a on e.pair_id = a.pair_id left join m on m.pair_id = coalesce(e.pair_id, a.pair_id))
  select *, expected_rows - matched_rows as missing_rows, actual_rows - matched_rows as extra_rows,
    matched_rows::double / greatest(expected_rows, actual_rows)::double as match_ratio,
    matched_rows = least(expected_rows, actual_rows) and 1 - matched_rows::double / greatest(expected_rows, actual_rows) <= {share} + 1e-12 as passed from t"""

CLOSE = "lower(x.c1) = y.c1 and abs(x.c2 - y.c2) <= 0.01"
MATCHED = f"""m as (select x.pair_id, count(*) as n from pair_expected x join pair_actual y
  on x.pair_id = y.pair_id and x.row_key = y.row_key and {CLOSE} group by 1)"""


@query(
    "k01_comparison_mode",
    """select d.doc_id, case when n_chars > 500 and l.doc_id is not null then 'results' else 'sql' end as comparison_type
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def k01(v):
    pairs = v.documents.join(v.labels.select("doc_id", "quality"), "doc_id", "left").withColumn(
        "expected", F.when(F.col("n_chars") > 500, F.col("lang"))
    )
    return compare.comparison_mode(pairs, "expected", "quality").select("doc_id", "comparison_type")


def _pair_cells(v, actual_columns=("row_key", "c1", "c2")):
    return (
        compare.as_cells(v.pair_expected, "pair_id", ["row_key", "c1", "c2"]),
        compare.as_cells(v.pair_actual, "pair_id", list(actual_columns)),
    )


@query("k02_compare_results", f"with {MATCHED}, {COUNTS.format(share=0)}")
def k02(v):
    return compare.compare_results(*_pair_cells(v))


@query("k02_compare_lenient", f"with {MATCHED}, {COUNTS.format(share=0.2)}")
def k02_lenient(v):
    return compare.compare_results(*_pair_cells(v), rules=compare.Leniency(max_missing_share=0.2))


@query("k02_compare_other_columns", f"with {MATCHED}, {COUNTS.format(share=0)}")
def k02_columns(v):
    return compare.compare_any_columns(*_pair_cells(v, ("c2", "row_key", "c1")))


@query(
    "k02_compare_ordered",
    f"""with x as (select *, row_number() over (partition by pair_id order by row_key) as i from pair_expected),
        y as (select *, row_number() over (partition by pair_id order by row_key) as i from pair_actual),
        m as (select x.pair_id, count(*) as n from x join y on x.pair_id = y.pair_id and x.i = y.i and x.row_key = y.row_key and {CLOSE} group by 1),
        {COUNTS.format(share=0)}""",
)
def k02_ordered(v):
    from tidemark.operators.sliced import running_number

    expected = running_number(v.pair_expected, ["pair_id"], ["row_key"], "i")
    actual = running_number(v.pair_actual, ["pair_id"], ["row_key"], "i")
    columns = ["row_key", "c1", "c2"]
    return compare.compare_results(
        compare.as_cells(expected, "pair_id", columns, "i"),
        compare.as_cells(actual, "pair_id", columns, "i"),
        rules=compare.Leniency(ordered=True),
    )


@query(
    "k02_compare_noisy_cells",
    """with e as (select o_custkey as pair_id, count(*) as n from orders group by 1),
         m as (select o_custkey as pair_id, count(*) as n from orders where o_orderkey % 50 <> 0 group by 1)
       select e.pair_id, e.n as expected_rows, e.n as actual_rows, coalesce(m.n, 0) as matched_rows, e.n - coalesce(m.n, 0) as missing_rows,
         e.n - coalesce(m.n, 0) as extra_rows, coalesce(m.n, 0)::double / e.n::double as match_ratio, coalesce(m.n, 0) = e.n as passed
       from e left join m on m.pair_id = e.pair_id""",
)
def k02_noisy(v):
    """Three numeric cells beside the key, on units, half-units and eighths, each with float noise."""
    key, far = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)
    noise = F.lit(1e-9)
    held = v.orders.select(
        F.col("o_custkey").alias("pair_id"), "o_orderkey",
        F.round(F.col("o_totalprice"), 2).alias("c1"), (key % 1000 + F.lit(0.005)).alias("c2"), (key % 77 / F.lit(8.0)).alias("c3"),
    )
    moved = held.withColumns({"c1": F.col("c1") + noise, "c2": F.col("c2") - noise + far, "c3": F.col("c3") + noise})
    columns = ["o_orderkey", "c1", "c2", "c3"]
    return compare.compare_results(*(compare.as_cells(df, "pair_id", columns) for df in (held, moved)))


@query(
    "k02_compare_rounded_cells",
    """with e as (select o_custkey as pair_id, count(*) as n from orders group by 1),
         m as (select o_custkey as pair_id, count(*) as n from orders where o_orderkey % 50 <> 0 group by 1)
       select e.pair_id, e.n as expected_rows, e.n as actual_rows, coalesce(m.n, 0) as matched_rows, e.n - coalesce(m.n, 0) as missing_rows,
         e.n - coalesce(m.n, 0) as extra_rows, coalesce(m.n, 0)::double / e.n::double as match_ratio, coalesce(m.n, 0) = e.n as passed
       from e left join m on m.pair_id = e.pair_id""",
)
def k02_rounded(v):
    """Three numeric cells beside the key that differ by up to the whole tolerance, or in one cell by a little more."""
    key = F.col("o_orderkey")
    held = v.orders.select(
        F.col("o_custkey").alias("pair_id"), "o_orderkey",
        F.round(F.col("o_totalprice"), 2).alias("c1"), (key % 1000 / F.lit(7.0)).alias("c2"), (key % 77 / F.lit(8.0)).alias("c3"),
    )
    moved = held.withColumns(
        {
            "c1": F.col("c1") + (key % 3 - 1) * F.lit(0.0099),
            "c2": F.when(key % 50 == 0, F.col("c2") + 0.0102).otherwise(F.round("c2", 2)),
            "c3": F.col("c3") + (key % 5 - 2) * F.lit(0.00495),
        }
    )
    columns = ["o_orderkey", "c1", "c2", "c3"]
    return compare.compare_results(*(compare.as_cells(df, "pair_id", columns) for df in (held, moved)))


@query(
    "k02_compare_empty_results",
    """with c as (select c_custkey as pair_id, count(o_orderkey) as n, count(case when o_orderstatus <> 'P' then 1 end) as k
         from customer left join orders on o_custkey = c_custkey group by 1)
       select pair_id, n as expected_rows, case when o.pair_only then 0 else n end as actual_rows,
         case when o.pair_only then 0 else n end as matched_rows, case when o.pair_only then n else 0 end as missing_rows, cast(0 as bigint) as extra_rows,
         case when n = 0 or not o.pair_only then 1.0::double else 0.0::double end as match_ratio, n = 0 or not o.pair_only as passed
       from c, lateral (select pair_id % 5 = 0 as pair_only) o""",
)
def k02_empty(v):
    """Customers without orders have two empty results; every fifth customer's actual result is empty."""
    pairs = v.customer.select(F.col("c_custkey").alias("pair_id"))
    expected = compare.as_cells(v.orders.withColumn("pair_id", F.col("o_custkey")), "pair_id", ["o_orderkey", "o_orderstatus"])
    return compare.compare_results(expected, expected.filter(F.col("pair_id") % 5 != 0), pairs=pairs)


@query(
    "k02_canonical_cells",
    """select o_orderkey, cast(cast(o_orderdate as date) as varchar) as iso, cast(cast(o_orderdate as date) as varchar) as slash,
         cast(cast(o_orderdate as date) as varchar) as stamped, lower(o_orderpriority) as folded, cast(null as varchar) as missing,
         cast(o_orderkey::double as varchar) as number from orders""",
)
def k02_cells(v):
    date = F.col("o_orderdate")
    texts = {
        "iso": F.date_format(date, "yyyy-MM-dd"),
        "slash": F.date_format(date, "MM/dd/yyyy"),
        "stamped": F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" 00:00:00Z")),
        "folded": F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")),
        "missing": F.when(F.col("o_orderstatus") == "F", "None").otherwise("<NULL>"),
        "number": F.concat(F.lit("+"), F.col("o_orderkey").cast("string"), F.lit(".0e0")),
    }
    return v.orders.select("o_orderkey", *[compare.canonical(c).alias(n) for n, c in texts.items()]).withColumn(
        "number", F.col("number").cast("double").cast("bigint").cast("string")
    ).withColumn("number", F.concat("number", F.lit(".0")))


_SQL_PAIRS = r"""s as (select p.query_id, case when p_size % 4 = 3 then null else sql end as expected,
     case p_size % 4 when 0 then lower(replace(replace(sql, ' ', '   '), ';', '')) when 1 then replace(sql, 'SUM', 'AVG') when 2 then '' else sql end as actual
   from sql_text p join part on p_partkey = query_id),
 n as (select *, trim(regexp_replace(regexp_replace(upper(expected), '\s+', ' ', 'g'), ';+$', '')) as ne,
              trim(regexp_replace(regexp_replace(upper(actual), '\s+', ' ', 'g'), ';+$', '')) as na from s)"""


@query(
    "k03_compare_sql",
    f"""with {_SQL_PAIRS} select query_id, coalesce(actual <> '' and ne = na, false) as passed,
          case when actual = '' then 'high' when expected is null then 'low' when ne = na then 'medium' else 'low' end as confidence,
          case when actual = '' then 'There is no query to judge' when expected is null then 'There is no expected query' else 'Query texts compared after normalization' end as reasoning,
          case when actual = '' then ['query absent'] when expected is null then ['expected query absent'] when ne = na then cast([] as varchar[]) else ['normalized texts differ'] end as differences,
          case when actual = '' then 'none' when expected is null then 'unknown' when ne = na then 'same text' else 'other text' end as semantic_equivalence from n""",
)
def k03(v):
    shape = F.col("p_size") % 4
    sql = F.col("sql")
    pairs = v.sql_text.join(v.part.select(F.col("p_partkey").alias("query_id"), "p_size"), "query_id").select(
        "query_id",
        F.when(shape != 3, sql).alias("expected"),
        F.when(shape == 0, F.lower(F.replace(F.replace(sql, F.lit(" "), F.lit("   ")), F.lit(";"), F.lit(""))))
        .when(shape == 1, F.replace(sql, F.lit("SUM"), F.lit("AVG")))
        .when(shape == 2, "")
        .otherwise(sql)
        .alias("actual"),
    )
    return compare.compare_sql(pairs, "expected", "actual").drop("expected", "actual")


def verdict_texts(v):
    """One logged verdict per result in seven shapes: fenced, bare, prefixed, minimal, words, cut, broken."""
    shape = F.col("result_id") % 7
    flag = F.when(F.col("passed"), "true").otherwise("false")
    listed = F.when(F.col("passed"), "").otherwise(F.concat(F.lit('"'), "failure_category", F.lit('"')))
    full = F.concat(
        F.lit('{"passed": '), flag, F.lit(', "confidence": "high", "reasoning": "'), F.col("question"),
        F.lit(' {checked}", "differences": ['), listed, F.lit("]}"),
    )
    words = F.when(F.col("passed"), "Looks like a pass to me").otherwise("The answer is incorrect")
    text = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("```\n"), full, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here is the comparison: "), full, F.lit(" trailing } text")))
        .when(shape == 3, F.concat(F.lit('{"passed":'), flag, F.lit("}")))
        .when(shape == 4, words)
        .when(shape == 5, F.concat(F.lit('{"passed": '), flag, F.lit(', "reasoning": "cut')))
        .otherwise(F.concat(F.lit("```json\n{broken\n``` then "), full))
    )
    return v.bench_result.select("result_id", text.alias("text"))


@query(
    "k04_parse_verdicts",
    """with b as (select *, result_id % 7 as s from bench_result)
       select result_id, passed, case when s in (0, 1, 2) then 'high' when s = 3 then 'medium' else 'low' end as confidence,
         case when s in (0, 1, 2) then question || ' {checked}' when s = 3 then '' else 'Failed to parse the verdict - inferred from text' end as reasoning,
         case when s > 3 then ['verdict parsing error'] when s = 3 or passed then cast([] as varchar[]) else [failure_category] end as differences,
         case when s > 3 then 'Unknown' else '' end as semantic_equivalence, s > 3 as parse_error from b""",
)
def k04(v):
    return verdicts.parse_verdicts(verdict_texts(v), "text").drop("text")


@query(
    "k05_parse_batch_verdicts",
    """with b as (select *, result_id // 10 as chunk from bench_result)
       select chunk, cast(result_id as varchar) as benchmark_id, chunk % 4 <> 2 and passed as passed,
         case when chunk % 4 = 2 then 'Failed to parse evaluation' when chunk % 4 = 3 and not passed then 'No verdict for this question'
              when not passed then 'because ' || question end as failure_reason,
         case when chunk % 4 = 2 then 'eval_parse_error' when chunk % 4 = 3 and not passed then 'eval_missing' else failure_category end as failure_category from b""",
)
def k05(v):
    results = v.bench_result.withColumn("chunk", F.floor(F.col("result_id") / 10).cast("bigint"))
    shape = F.col("chunk") % 4
    verdict = F.struct(
        F.col("result_id").cast("string").alias("benchmark_id"),
        "passed",
        F.when(~F.col("passed"), F.concat(F.lit("because "), "question")).alias("failure_reason"),
        "failure_category",
    )
    kept = F.when((shape != 3) | F.col("passed"), verdict)
    answers = results.groupBy("chunk").agg(F.to_json(F.collect_list(kept)).alias("j")).select(
        "chunk",
        F.when(shape == 0, F.concat(F.lit("Result:\n```json\n"), "j", F.lit("\n```\n")))
        .when(shape == 2, F.concat(F.lit("[{"), "j"))
        .otherwise(F.col("j"))
        .alias("answer"),
    )
    asked = results.select("chunk", F.col("result_id").alias("benchmark_id"))
    return verdicts.parse_batch_verdicts(answers, "answer", asked)


# one error text per shape, and the category the text stands for
ERRORS = [
    ("FAILED", "Table main.x.y NOT FOUND", "missing_table_or_column"),
    ("FAILED", "column z does not exist", "missing_table_or_column"),
    ("FAILED", "Syntax error near FROM", "sql_syntax_error"),
    ("FAILED", "PERMISSION denied on x", "permission_denied"),
    ("FAILED", "statement timed out", "query_timeout"),
    ("FAILED", "ambiguous reference k", "ambiguous_reference"),
    ("FAILED", "boom", "execution_failed"),
    ("FAILED", None, "execution_failed"),
    ("TIMEOUT", "syntax", "timeout"),
    ("COMPLETED", "syntax", None),
]


def _lit_sql(x):
    return "null" if x is None else f"'{x}'"


def _error_of(i: int):
    key, found = F.col("result_id") % len(ERRORS), F
    for k, row in enumerate(ERRORS):
        found = found.when(key == k, F.lit(row[i]))
    return found


@query(
    "k06_categorize_status",
    "select result_id, case result_id % {n} {cases} end as category from bench_result".format(
        n=len(ERRORS), cases=" ".join(f"when {k} then {_lit_sql(c)}" for k, (_, _, c) in enumerate(ERRORS))
    ),
)
def k06(v):
    logged = v.bench_result.select("result_id", _error_of(0).alias("status"), _error_of(1).alias("error"))
    return logged.select("result_id", failures.categorize_status("status", "error").alias("category"))


_WORD_CASES = " ".join(
    "when " + " or ".join("contains(t, '{}')".format(w.replace("'", "''")) for w in words) + f" then '{name}'"
    for name, words in failures.CATEGORY_WORDS
)

# whole document texts with one phrase appended, so that every category occurs
_PHRASES = ["a cross join", "wrong date used", "wrong field", "querying wrong rows", "grouping", "top n", "row count", "logic error", "sum vs count", "fine"]
_PHRASE_SQL = "case doc_id % {n} {cases} end".format(
    n=len(_PHRASES), cases=" ".join(f"when {i} then '{p}'" for i, p in enumerate(_PHRASES))
)


def _phrase():
    chosen = F
    for i, p in enumerate(_PHRASES):
        chosen = chosen.when(F.col("doc_id") % len(_PHRASES) == i, p)
    return chosen


@query(
    "k07_categorize_text",
    f"""with d as (select doc_id, lower(text || ' ' || {_PHRASE_SQL}) as t from documents)
        select doc_id, case {_WORD_CASES} end as category from d""",
)
def k07(v):
    text = F.lower(F.concat("text", F.lit(" "), _phrase()))
    return v.documents.select("doc_id", failures.categorize_text(text).alias("category"))


_DIFFS = [
    (["Expected SQL: x", "Actual SQL: y"], "sql_mismatch"),
    (["Expected: 1", "actual: 2"], "result_mismatch"),
    (["3 rows lost"], "row_count_mismatch"),
    (["something else"], "semantic_difference"),
    ([], "semantic_difference"),
]


def _diffs_of():
    chosen = F
    for i, (texts, _) in enumerate(_DIFFS):
        listed = F.array(*[F.lit(t) for t in texts]).cast("array<string>")
        chosen = chosen.when(F.col("result_id") % len(_DIFFS) == i, listed)
    return chosen


@query(
    "k08_categorize_diffs",
    "select result_id, case result_id % {n} {cases} end as category from bench_result".format(
        n=len(_DIFFS), cases=" ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(_DIFFS))
    ),
)
def k08(v):
    return v.bench_result.select("result_id", failures.categorize_diffs(_diffs_of()).alias("category"))


def judged(v):
    """Answers with status, query, verdict fields and a parse flag, in a cycle of shapes."""
    i = F.col("result_id")
    return v.bench_result.select(
        "run_id", "result_id", "benchmark_id", "passed",
        _error_of(0).alias("base"), _error_of(1).alias("error"), F.col("failure_category").alias("known"),
        F.when(i % 10 == 9, F.lit("COMPLETED")).otherwise(_error_of(0)).alias("status"),
        F.when(i % 3 != 0, "SELECT 1").alias("sql"),
        (i % 7 == 1).alias("parse_error"),
        F.when(i % 11 > 3, F.concat(F.lit("Found a "), F.replace(F.coalesce("failure_category", F.lit("nothing")), F.lit("_"), F.lit(" ")))).alias("reasoning"),
        F.lit(None).cast("string").alias("semantic_equivalence"),
        F.when(i % 13 > 1, _diffs_of()).alias("differences"),
    ).drop("base", "known")


@query(
    "k09_categorize_failures",
    """with b as (select *, result_id as i from bench_result),
       c as (select *, case i % 10 {errors} end as by_status,
               case when i % 11 > 3 then 'found a ' || replace(coalesce(failure_category, 'nothing'), '_', ' ') else '' end || '  ' ||
                 coalesce(case i % 5 when 0 then 'expected sql: x actual sql: y' when 1 then 'expected: 1 actual: 2' when 2 then '3 rows lost' when 3 then 'something else' else '' end, '') as t,
               case when i % 13 > 1 then true else false end as compared from b),
       d as (select *, case when i % 13 > 1 then t else case when i % 11 > 3 then 'found a ' || replace(coalesce(failure_category, 'nothing'), '_', ' ') else '' end end as tt from c)
       select result_id, case when by_status is not null then by_status when i % 3 = 0 then 'no_sql_generated' when i % 7 = 1 then 'llm_parse_error'
           when compared then coalesce(case {words} end, case i % 5 {diffs} end) else 'unknown_failure' end as failure_category from d""".format(
        errors=" ".join(f"when {k} then {_lit_sql(c)}" for k, (_, _, c) in enumerate(ERRORS)),
        words=_WORD_CASES.replace("contains(t,", "contains(tt,"),
        diffs=" ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(_DIFFS)),
    ),
)
def k09(v):
    return failures.categorize_failures(judged(v)).select("result_id", "failure_category")


def flagged_results(v):
    return v.bench_result.withColumn("parse_error", F.col("result_id") % 7 == 1)


_BREAKDOWN = """f as (select run_id, coalesce(failure_category, 'unknown_failure') as failure_category, count(*) as failures,
    count(*) filter (result_id % 7 = 1) as parse_errors from bench_result where not passed group by 1, 2)"""


@query(
    "k10_failure_breakdown",
    f"""with {_BREAKDOWN} select *, round(failures::double * 100.0::double / (sum(failures) over (partition by run_id))::double, 1) as share from f""",
)
def k10(v):
    return failures.failure_breakdown(flagged_results(v), ["run_id"])


@query(
    "k10_failed_ids",
    "select run_id, failure_category, benchmark_id, count(*) as occurrences from bench_result where not passed group by 1, 2, 3",
)
def k10_ids(v):
    return failures.failed_ids(v.bench_result, ["run_id"])


@query(
    "k11_suggestions",
    f"""with {_BREAKDOWN}, advice(failure_category, advice) as (values ('wrong_aggregation', 'Aggregates go wrong: show more worked queries that group and sum'),
          ('wrong_join', 'Joins go wrong: state how the tables relate'), ('wrong_filter', 'Filters go wrong: describe the columns and how dates are written')),
        p as (select run_id, sum(parse_errors) as n from f group by 1 having sum(parse_errors) > 0)
        select run_id, f.failure_category, advice as suggestion from f join advice on f.failure_category = advice.failure_category
        union all select run_id, 'llm_parse_error', n::varchar || ' answers could not be read: look at what the endpoint returns' from p""",
)
def k11(v):
    return failures.suggestions(failures.failure_breakdown(flagged_results(v), ["run_id"]), ["run_id"])


@query(
    "k12_validate_runs",
    """with s as (select run_id, iteration_number as i, count(*) filter (passed)::double / count(*) as score from bench_result group by 1, 2)
       select a.run_id, a.score as initial_score, b.score as final_score, b.score - a.score as improvement, b.score >= 0.9 as target_reached,
         case when b.score >= 0.9 then 'TARGET_REACHED' else 'NEEDS_ANOTHER_LOOP' end as status
       from s a join s b on a.run_id = b.run_id where a.i = 1 and b.i = 5""",
)
def k12(v):
    scores = failures.overall_score(v.bench_result, ["run_id", "iteration_number"])
    initial, final = (scores.filter(F.col("iteration_number") == i) for i in (1, 5))
    return failures.validate_runs(initial, final, 0.9)


def response_documents(v):
    """One logged response document per event, in eight shapes."""
    s = F.col("event_id") % 8
    sql = F.concat(F.lit("SELECT "), "event_type", F.lit(" FROM u"), F.col("user_id").cast("string"))
    n = F.col("user_id").cast("string")
    done = F.lit('"status": "COMPLETED"')
    doc = (
        F.when(s == 0, F.concat(F.lit('{"attachments": [{"type": "t"}, {"query": {"query": "'), sql, F.lit('", "query_result_metadata": {"row_count": '), n, F.lit("}}}], "), done, F.lit("}")))
        .when(s == 1, F.concat(F.lit('{"attachments": [{"query": {"query": "", "body": ["'), sql, F.lit('", " LIMIT 5"]}}], '), done, F.lit("}")))
        .when(s == 2, F.concat(F.lit('{"attachments": [{"query": "'), sql, F.lit('"}], '), done, F.lit("}")))
        .when(s == 3, F.concat(F.lit('{"attachments": [{"sql": "'), sql, F.lit('"}], "query_result": {"rows": [['), n, F.lit("]]}, "), done, F.lit("}")))
        .when(s == 4, F.concat(F.lit('{"query_result": {"statement_response": {"manifest": {"sql": "'), sql, F.lit('"}}}, '), done, F.lit("}")))
        .when(s == 5, F.concat(F.lit('{"query": {"statement": "'), sql, F.lit('"}, "query_result": {"row_count": '), n, F.lit("}, "), done, F.lit("}")))
        .when(s == 6, F.lit('{"status": "FAILED", "error": {"message": "boom"}}'))
        .otherwise(F.lit('{"status": "FAILED"}'))
    )
    return v.events.select("event_id", doc.alias("document"))


@query(
    "k13_extract_responses",
    """with b as (select event_id, event_id % 8 as s, 'SELECT ' || event_type || ' FROM u' || user_id::varchar as q, user_id::varchar as n from events)
       select event_id, case when s < 6 then 'COMPLETED' else 'FAILED' end as status,
         case when s = 1 then q || ' LIMIT 5' when s < 6 then q end as sql,
         case s when 0 then '{"row_count":' || n || '}' when 3 then '{"rows":[[' || n || ']]}' when 5 then '{"row_count":' || n || '}' end as result,
         case s when 6 then 'boom' when 7 then 'Unknown error' end as error from b""",
)
def k13(v):
    return verdicts.extract_responses(response_documents(v), "document").drop("document")


@query(
    "k14_reliability_stats",
    """select event_type as phase, count(*) as calls, count(*) filter (value < 150) as succeeded, count(*) filter (value >= 150) as failed,
         round(count(*) filter (value < 150)::double * 100.0::double / count(*), 2) as success_rate, cast(sum(user_id % 3 + 1) as bigint) as attempts,
         count(*) filter (user_id % 3 > 0) as retried, count(*) filter (value >= 200) as timeouts,
         ((2 * cast(sum(cast(value as decimal(18,2))) * 100 as hugeint) + count(*)) // (2 * count(*)))::double / 100 as avg_duration, max(value) as max_duration,
         quantile_disc(value, 0.5) as median_duration, quantile_disc(value, 0.95) as p95_duration
       from events group by 1""",
)
def k14(v):
    calls = v.events.select(
        F.col("event_type").alias("phase"),
        (F.col("value") < 150).alias("success"),
        (F.col("user_id") % 3 + 1).alias("attempts"),
        F.when(F.col("value") >= 200, "TIMEOUT").otherwise("COMPLETED").alias("status"),
        F.col("value").alias("duration"),
    )
    return failures.reliability_stats(calls, ["phase"])


@query(
    "k15_assign_chunks",
    """select event_id, user_id, (row_number() over (partition by user_id order by event_time, event_id) - 1) // 10 as chunk from activity""",
)
def k15(v):
    chunked = failures.assign_chunks(
        v.activity.select("event_id", "user_id", "event_time"), ["user_id"], ["event_time", "event_id"], 10
    )
    return chunked.select("event_id", "user_id", "chunk")


@query(
    "k16_assemble_context",
    """with f as (select run_id, result_id, question, failure_category, row_number() over (partition by run_id order by result_id) - 1 as n from bench_result where not passed)
       select run_id, n // 10 as chunk, string_agg('### Failure ' || result_id::varchar || E'\n**Question:** ' || question || E'\n**Failure Category:** ' || failure_category, E'\n' order by result_id) as context
       from f group by 1, 2""",
)
def k16(v):
    chunked = failures.assign_chunks(failures.failed(v.bench_result), ["run_id"], ["result_id"], 10)
    template = F.format_string(
        "### Failure %s\n**Question:** %s\n**Failure Category:** %s",
        F.col("result_id").cast("string"), F.col("question"), F.col("failure_category"),
    )
    return failures.assemble_context(chunked, ["run_id", "chunk"], "result_id", template)


@query("k17_failed_results", "select run_id, result_id, question, failure_category from bench_result where not passed")
def k17(v):
    return failures.failed(v.bench_result).select("run_id", "result_id", "question", "failure_category")
