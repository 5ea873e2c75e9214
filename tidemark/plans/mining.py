"""Patterns mined from a table of question and query texts.

Everything is a count over texts: extraction is row-local, and counts combine
on the map side before the shuffle, so frequent items stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import to_col
from tidemark.functions.labels import first_match
from tidemark.functions.text import once
from tidemark.session import materialize

# Text patterns of SQL pieces.
NAME = r"[A-Za-z_][A-Za-z_0-9.]*"
LITERAL = r"'[^']*'|\d+(?:\.\d+)?"
FILTER = rf"({NAME}\s*(?:>=|<=|<>|!=|=|<|>)\s*(?:{LITERAL}))"
DATE_IDIOM = r"(?i)(CURRENT_DATE(?:\(\))?\s*-\s*INTERVAL\s+'?\d+'?\s+[A-Z]+|DATE_TRUNC\('[a-z]+'[^)]*\)|last_day\([^)]*\))"
DEDUPLICATION = r"(?i)(ROW_NUMBER\(\)\s*OVER\s*\(PARTITION BY [^)]*\))"
DEFAULTED = r"(?i)(COALESCE\(SUM\([^)]*\),\s*0\))"
AGGREGATE = r"(?i)\b((?:SUM|COUNT|AVG|MIN|MAX)\((?:DISTINCT\s+)?[^()]*\))"
CASE = r"(?i)(CASE\s+WHEN[\s\S]*?END)"
TABLE = rf"(?i)\b(?:FROM|JOIN)\s+({NAME})"
_NO_ALIAS = "ON|USING|WHERE|JOIN|LEFT|RIGHT|INNER|OUTER|FULL|CROSS|NATURAL|GROUP|ORDER|LIMIT|HAVING|UNION|INTERSECT|EXCEPT|SET"
_ALIAS = rf"(?:\s+(?:AS\s+)?(?!(?:{_NO_ALIAS})\b)([A-Za-z_]\w*))?"
# words that end the condition of a join outside brackets
_CLAUSE_END = r"(?:(?:LEFT|RIGHT|FULL|INNER|CROSS|NATURAL)\s+(?:OUTER\s+)?)?JOIN\b|(?:SELECT|FROM|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|QUALIFY|WINDOW)\b"
EQUALITY = rf"({NAME}\.\w+)\s*=\s*({NAME}\.\w+)"
QUALIFIED = rf"({NAME}\.\w+)"
USING = rf"(?i)\bJOIN\s+({NAME})(?:\s+(?:AS\s+)?(?!USING\b)\w+)?\s+USING\s*\(([^)]*)\)"
# words of a query that are no columns
KEYWORDS = (
    "select from where group order by having limit join on using inner left right full outer cross and or not in is null "
    "as distinct case when then else end between like asc desc union all interval date timestamp true false over partition with exists"
).split()


def _clause(depth: int = 6) -> str:
    """Pattern of a join's condition: up to the next clause, comma or closing bracket outside brackets."""
    inner = r"[^()]*+"
    for _ in range(depth):
        inner = rf"(?:[^()]++|\({inner}\))*+"
    return rf"(?:[^\w(),;]++|(?!{_CLAUSE_END})\b\w++|\({inner}\))*+"


#: a table of a query: keyword, name, alias, condition after ON; the condition is looked at, not passed over,
#: so tables within its brackets are found too
SOURCE = rf"(?i)\b(FROM|JOIN)\s+({NAME}){_ALIAS}(?=(?:\s+ON\b\s*({_clause()}))?)"
#: tables listed with commas, each after the one before
LISTED = rf"(?i)(\b(?:FROM|JOIN)\s+|\G(?!\A))({NAME}(?:\s+(?:AS\s+)?(?!(?:{_NO_ALIAS})\b)[A-Za-z_]\w*)?)\s*,\s*(?=[A-Za-z_])"


def _all(c: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(to_col(c), F.lit(pattern), group)


def shape_of(sql: str | Column) -> Column:
    """Query text with literals and list lengths taken out."""
    text = F.regexp_replace(to_col(sql), r"'[^']*'", "?")
    text = F.regexp_replace(text, r"\b\d+(\.\d+)?\b", "?")
    text = F.regexp_replace(text, r"\(\s*\?(\s*,\s*\?)+\s*\)", "(?)")
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r"\s+", " "), r"\s*;+\s*$", ""))


def fingerprint_queries(df: DataFrame, sql: str) -> DataFrame:
    """Groups of queries of one shape with their size and an example."""
    shaped = df.withColumn("shape", shape_of(sql))
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("queries"), F.min(sql).alias("example")).select(
        F.md5("shape").alias("fingerprint"), "shape", "queries", "example"
    )


def pattern_flags(sql: str | Column) -> dict[str, Column]:
    """Which structural patterns a query shows."""
    text = F.upper(to_col(sql))
    return {
        "latest_record": text.rlike(r"ROW_NUMBER\(\)\s*OVER") & text.rlike(r"\bRN\s*=\s*1\b"),
        "top_n": text.rlike(r"ORDER BY[\s\S]*LIMIT\s+(\d+|:)"),
        "trend": text.rlike(r"GROUP BY\s+(DATE|DATE_TRUNC|TO_DATE|YEAR|MONTH)\("),
        "join_aggregate": text.rlike(r"\bJOIN\b") & text.rlike(r"\bGROUP BY\b"),
        "date_range": text.rlike(r"INTERVAL|BETWEEN\s+(DATE|:)|>=\s*(DATE|CURRENT_DATE)"),
        "comparison": text.rlike(r"\bGROUP BY\b"),
    }


def classify_patterns(df: DataFrame, sql: str) -> DataFrame:
    """Queries with their pattern family, the most specific first."""
    flags = pattern_flags(sql)
    return df.withColumn("pattern", first_match([(c, name) for name, c in flags.items()], "other"))


def pattern_counts(df: DataFrame, sql: str) -> DataFrame:
    return classify_patterns(df, sql).groupBy("pattern").agg(F.count(F.lit(1)).alias("queries"))


def _frequency(df: DataFrame, found: dict[str, Column], min_count: int) -> DataFrame:
    """Queries that hold each extracted text, per kind; one query counts once."""

    def tagged(kind: str, texts: Column) -> Column:
        return F.transform(F.array_distinct(texts), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    items = df.select(F.explode(F.concat(*[tagged(k, c) for k, c in found.items()])).alias("i")).select("i.*")
    return items.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("queries")).filter(F.col("queries") >= min_count)


def mine_rules(df: DataFrame, sql: str, min_count: int = 5) -> DataFrame:
    """Repeated filters, date idioms, de-duplication idioms and NULL-safe sums."""
    return _frequency(
        df,
        {
            "default_filter": _all(sql, FILTER),
            "date_convention": _all(sql, DATE_IDIOM),
            "deduplication": _all(sql, DEDUPLICATION),
            "aggregation": _all(sql, DEFAULTED),
        },
        min_count,
    )


def mine_snippets(df: DataFrame, sql: str, min_count: int = 1) -> DataFrame:
    """Frequency of measures, row expressions and filters."""
    return _frequency(
        df,
        {"measure": _all(sql, AGGREGATE), "expression": _all(sql, CASE), "filter": _all(sql, FILTER)},
        min_count,
    )


def mine_tables(df: DataFrame, sql: str) -> DataFrame:
    """How many queries read each table."""
    named = df.select(F.explode(F.array_distinct(F.transform(_all(sql, TABLE), F.lower))).alias("table_name"))
    return named.groupBy("table_name").agg(F.count(F.lit(1)).alias("queries"))


def _sources(sql: str | Column) -> Column:
    """Tables of a query in order: (name, alias, joined, clause).

    The alias is the last part of the name where none is given; ``joined`` says
    whether the table is joined to what came before, by JOIN or a comma;
    ``clause`` is the text after ON, empty without one.
    """
    found = once(
        F.regexp_replace(to_col(sql), LISTED, "$1$2 JOIN "),
        lambda text: F.arrays_zip(*[_all(text, SOURCE, i).alias(c) for i, c in enumerate(("word", "name", "given", "clause"), 1)]),
    )
    last = lambda t: F.regexp_extract(t["name"], r"([^.]*)$", 1)
    return F.transform(
        found,
        lambda t: F.struct(
            F.lower(t["name"]).alias("name"),
            F.lower(F.when(F.coalesce(t["given"], F.lit("")) != "", t["given"]).otherwise(last(t))).alias("alias"),
            (F.upper(t["word"]) == "JOIN").alias("joined"),
            F.trim(F.regexp_replace(F.lower(F.coalesce(t["clause"], F.lit(""))), r"\s+", " ")).alias("clause"),
        ),
    )


def mine_joins(df: DataFrame, sql: str) -> DataFrame:
    """Frequency of joined table pairs with their condition.

    Both tables of a pair come from the names in an equality, aliases resolved;
    the table named first in the query is the left one. All equalities of a pair
    make one condition. ``USING`` joins a table to the one named before it. A
    joined table that no such equality ties to an earlier one - its condition has
    plain or wrapped names or compares otherwise, or it has none - is paired with
    the first other table that its condition names, else with the one before it
    (not counting those that a condition reads in brackets); the condition is then the text after ON, aliases resolved, or ``cross``.
    """
    text = F.regexp_replace(to_col(sql), r"'[^']*'", "''")
    held = df.select(text.alias("q")).withColumn("t", _sources("q"))
    equal = F.arrays_zip(_all("q", EQUALITY, 1).alias("l"), _all("q", EQUALITY, 2).alias("r"))

    def place(name: Column) -> Column:
        owner = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
        return once(
            owner, lambda o: F.array_position(F.transform("t", lambda t: (t["alias"] == o) | (t["name"] == o)), True).cast("int")
        )

    def shown(at: Column, name: Column) -> Column:
        return F.concat(F.get("t", at - 1)["name"], F.lit("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))

    def side(x: Column) -> Column:
        return F.struct(place(x["l"]).alias("i"), place(x["r"]).alias("j"), x["l"].alias("l"), x["r"].alias("r"))

    def oriented(x: Column) -> Column:
        first, second = shown(x["i"], x["l"]), shown(x["j"], x["r"])
        swap = x["i"] > x["j"]
        text = F.when(swap, F.concat(second, F.lit("="), first)).otherwise(F.concat(first, F.lit("="), second))
        return F.struct(F.least(x["i"], x["j"]).alias("i"), F.greatest(x["i"], x["j"]).alias("j"), text.alias("c"))

    known = F.filter(F.transform(equal, side), lambda x: (x["i"] > 0) & (x["j"] > 0) & (x["i"] != x["j"]))
    using = F.arrays_zip(_all("q", USING, 1).alias("l"), _all("q", USING, 2).alias("r"))

    def shared(x: Column) -> Column:
        at = F.array_position(F.transform("t", lambda t: t["name"] == F.lower(x["l"])), True).cast("int")
        columns = F.lower(F.regexp_replace(x["r"], r"\s+", ""))
        return F.struct((at - 1).alias("i"), at.alias("j"), F.concat(F.lit("using("), columns, F.lit(")")).alias("c"))

    tied = held.withColumn("tied", F.concat(F.transform(known, oriented), F.transform(using, shared)))

    def resolved(clause: Column) -> Column:
        # a name with its alias in front, not one that ends like it
        return F.aggregate(
            "t", clause,
            lambda text, t: F.regexp_replace(text, F.concat(F.lit(r"(?<![\w.])"), t["alias"], F.lit(r"\.(?=\w)")), F.concat(t["name"], F.lit("."))),
        )

    def before(at: Column) -> Column:
        """The last table before a place that is not read within another's condition."""
        inner = lambda i: F.exists("t", lambda t: t["clause"].contains(F.concat(F.lit("from "), F.get("t", i - 1)["name"])))
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), at), lambda i: ~inner(i))), at)

    def untied(t: Column, at: Column) -> Column:
        j = at + 1
        named = F.filter(F.transform(_all(t["clause"], QUALIFIED), place), lambda i: (i > 0) & (i != j))
        condition = F.when(t["clause"] == "", "cross").otherwise(resolved(t["clause"]))
        return once(
            F.coalesce(F.get(named, F.lit(0)), before(at)),
            lambda other: F.struct(F.least(other, j).alias("i"), F.greatest(other, j).alias("j"), condition.alias("c")),
        )

    # joined tables in place: those without a tie to an earlier table have j = their number
    loose = F.filter(
        F.transform("t", lambda t, at: F.struct(t.alias("t"), at.alias("at"))),
        lambda x: x["t"]["joined"] & (x["at"] > 0) & ~F.exists("tied", lambda e: e["j"] == x["at"] + 1),
    )
    parts = tied.withColumn("e", F.concat("tied", F.transform(loose, lambda x: untied(x["t"], x["at"]))))
    pairs = F.array_distinct(F.transform("e", lambda x: F.struct("t", x["i"].alias("i"), x["j"].alias("j"))))
    opened = parts.select("e", F.explode(pairs).alias("p"))
    mine = F.filter("e", lambda x: (x["i"] == F.col("p.i")) & (x["j"] == F.col("p.j")))
    named = opened.filter("p.i > 0").select(
        F.get("p.t", F.col("p.i") - 1)["name"].alias("left_table"),
        F.get("p.t", F.col("p.j") - 1)["name"].alias("right_table"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["c"]))), " and ").alias("condition"),
    )
    return named.groupBy("left_table", "right_table", "condition").agg(F.count(F.lit(1)).alias("queries"))


def measured_columns(sql: str | Column) -> Column:
    """Columns within aggregates."""
    return _all(sql, r"(?i)(?:SUM|AVG|MIN|MAX|COUNT)\(\s*(?:DISTINCT\s+)?([A-Za-z_][\w.]*)\s*\)")


def used_columns(sql: str | Column) -> Column:
    """Columns anywhere in a query: names that are no keyword, function, table or alias; qualifiers are dropped."""
    text = F.regexp_replace(to_col(sql), r"'[^']*'", "''")
    names = F.transform(_all(text, r"([A-Za-z_][\w.]*+)(?!\s*\()"), F.lower)
    tables = F.flatten(F.transform(_sources(sql), lambda t: F.array(t["name"], t["alias"])))
    # one look at the tables of a query, not one for each of its names
    wanted = once(tables, lambda known: F.filter(names, lambda n: ~n.isin(*KEYWORDS) & ~F.array_contains(known, n)))
    return F.transform(wanted, lambda n: F.regexp_extract(n, r"([^.]*)$", 1))


def mine_synonyms(df: DataFrame, question: str, sql: str, min_count: int = 2, columns=used_columns) -> DataFrame:
    """Term and column co-occurrence with its lift over chance.

    Terms and columns are paired within one query only, each distinct per query.
    ``columns`` says which columns of a query count: all it uses, or
    ``measured_columns``.
    """
    terms = F.array_distinct(F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))
    named = F.array_distinct(F.transform(columns(sql), F.lower))
    none = F.lit(None).cast("string")

    def item(term: Column, column: Column) -> Column:
        return F.struct(term.alias("term"), column.alias("column_ref"))

    empty = F.array().cast("array<string>")
    held = df.select(F.coalesce(terms, empty).alias("terms"), F.coalesce(named, empty).alias("columns"))
    paired = F.flatten(F.transform("terms", lambda t: F.transform("columns", lambda c: item(t, c))))
    alone = F.concat(F.transform("terms", lambda t: item(t, none)), F.transform("columns", lambda c: item(none, c)))
    # texts are read once for pairs, terms and columns; an outer explode, as a plain one would have Spark
    # work out the lists once more beforehand, to leave out empty ones
    opened = held.select(F.explode_outer(F.concat(paired, alone)).alias("i")).select("i.*")
    counted = materialize(opened.groupBy("term", "column_ref").agg(F.count(F.lit(1)).alias("both")), "terms")
    queries = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    term, column = F.col("term"), F.col("column_ref")
    together = counted.filter(term.isNotNull() & column.isNotNull() & (F.col("both") >= min_count))
    by_term = counted.filter(term.isNotNull() & column.isNull()).select("term", F.col("both").alias("t"))
    by_column = counted.filter(term.isNull() & column.isNotNull()).select("column_ref", F.col("both").alias("c"))
    joined = together.join(by_term, "term").join(by_column, "column_ref")
    lift = F.col("both").cast("double") * queries / (F.col("t").cast("double") * F.col("c"))
    return joined.select("term", "column_ref", F.col("both").alias("queries"), F.round(lift, 4).alias("lift"))


def relationship_type(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Relationship of two tables measured on their join keys (one row)."""

    def most(df: DataFrame) -> DataFrame:
        counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.max("n").alias("n"))

    held = most(left).select(F.col("n").alias("left_rows")).withColumn("right_rows", most(right).scalar())

    def side(c: str) -> Column:
        return F.when(F.col(c) > 1, "MANY").otherwise("ONE")

    return held.withColumn("relationship", F.concat(side("left_rows"), F.lit("_TO_"), side("right_rows")))


def ambiguous_synonyms(synonyms: DataFrame) -> DataFrame:
    """Synonyms a model gives to several columns."""
    target = F.struct("table_pos", "column_name")
    return synonyms.groupBy("model_id", F.lower("synonym").alias("synonym")).agg(
        F.countDistinct(target).alias("columns")
    ).filter(F.col("columns") > 1)


def duplicate_examples(examples: DataFrame) -> DataFrame:
    """Example queries of a model that share a shape."""
    shaped = examples.withColumn("shape", shape_of(F.array_join("sql", "")))
    return shaped.groupBy("model_id", "shape").agg(
        F.count(F.lit(1)).alias("examples"), F.min("id").alias("first_id")
    ).filter(F.col("examples") > 1)
