"""Set-based comparison of many expected and actual query results.

A result set is rows of (pair, cells), cells being the row's values as text.
Every pair is compared in one job as a multiset of rows: no pair is collected,
and no row of one side is matched against many rows of the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import to_col
from tidemark.functions.text import normalize_sql

# Spellings of a missing value.
NULL_SPELLINGS = ["null", "none", "<null>"]

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
_YEAR_FIRST = r"^\d{4}/\d{1,2}/\d{1,2}$"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(z|utc|[+-]\d{2}:?\d{2}))?$"


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _moment(text: Column) -> Column:
    """One spelling for every date or time spelling; midnight equals the plain date."""
    day = (
        F.when(text.rlike(_ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))
        .when(text.rlike(_SLASH_DATE), F.try_to_date(text, "M/d/yyyy"))
        .when(text.rlike(_YEAR_FIRST), F.try_to_date(text, "yyyy/M/d"))
    )
    instant = F.when(text.rlike(_TIMESTAMP), F.upper(text).try_cast("timestamp"))
    shown = F.regexp_replace(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"( 00:00:00)?\.0+$", "")
    return F.coalesce(day.cast("string"), shown)


def _text_of(text: Column) -> Column:
    """Canonical text of a cell that is no number; only digits can start a date."""
    dated = F.when(text.rlike(r"^\d"), F.coalesce(_moment(text), text)).otherwise(text)
    return F.when(~text.isin(NULL_SPELLINGS), dated)


def canonical(c: str | Column) -> Column:
    """Canonical text of a cell: missing, date, number or folded text."""
    text = _plain(to_col(c))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce((number + 0.0).cast("string"), _text_of(text))


def _with_values(df: DataFrame, cells: str) -> DataFrame:
    """Add ``__values``: (number or NULL, canonical text or NULL) of every cell.

    Each step is a column of its own, so a cell is folded and matched once
    however many keys are made from it.
    """
    folded = df.withColumn("__folded", F.transform(cells, _plain))
    matched = folded.withColumn(
        "__matched",
        F.transform(
            "__folded",
            lambda t: F.struct(F.when(t.rlike(_NUMBER), t.try_cast("double")).alias("number"), t.alias("raw")),
        ),
    )
    values = F.transform(
        "__matched",
        lambda m: F.struct(
            m["number"].alias("number"), F.when(m["number"].isNull(), _text_of(m["raw"])).alias("text")
        ),
    )
    return matched.withColumn("__values", values).drop("__folded", "__matched")


def _bent(number: Column, rules: Leniency) -> Column:
    """The number on the scale on which ``tolerance`` holds.

    With a relative tolerance numbers are bent: near zero as they are, far from it
    as their logarithm, so that one bucket spans the same share of each.
    """
    if rules.tolerance == 0 or rules.relative == 0:
        return number
    bend = rules.tolerance / rules.relative
    return F.signum(number) * F.log1p(F.abs(number) / bend) * bend


def _shown(value: Column, rules: Leniency, shift: float) -> Column:
    """Key text of a value; a number shows its bucket of width ``tolerance``."""
    number, tolerance = _bent(value["number"], rules), rules.tolerance
    bucket = number if tolerance == 0 else F.rint(number / tolerance + shift)
    # + 0.0 turns minus zero into zero
    return F.coalesce(
        F.concat(F.lit("#"), (bucket + 0.0).cast("string")), F.concat(F.lit("v"), value["text"]), F.lit("n")
    )


def _row_key(rules: Leniency, shift: float, *lead: Column) -> Column:
    """128-bit digest of a row, so wide rows travel as 16 bytes."""
    shown = F.transform("__values", lambda v: _shown(v, rules, shift))
    parts = F.concat(F.array(*[x.cast("string") for x in lead]).cast("array<string>"), shown) if lead else shown
    return F.unhex(F.md5(F.array_join(parts, "\x1f")))


def _text_key(*lead: Column) -> Column:
    """Digest of a row without its numbers, which only keep their places."""
    shown = F.transform("__values", lambda v: F.when(v["number"].isNotNull(), "#").otherwise(F.coalesce(F.concat(F.lit("v"), v["text"]), F.lit("n"))))
    parts = F.concat(F.array(*[x.cast("string") for x in lead]).cast("array<string>"), shown) if lead else shown
    return F.unhex(F.md5(F.array_join(parts, "\x1f")))


# left-over rows that lie close in every number are matched in blocks of so many, in order
CLUSTER_ROWS = 512
_SLACK = 1e-9  # for sums of floats
# grids start here, so that values of a few decimals do not lie on their borders
_GRID_START = (5**0.5 - 1) / 10


@dataclass(frozen=True)
class Leniency:
    """How far two results may differ and still pass.

    ``tolerance``           rows meet if no numeric cell is more than it apart
                            and all other cells are equal; rows within
                            tolerance / (d + 1) in each of d numeric cells count
                            as one when they are many
    ``relative``            share by which large numbers may differ besides,
                            0 for none
    ``ordered``             rows must also agree by position
    ``max_missing_share``   share of the larger side that may be missing, if all
                            rows of the smaller side are found
    """

    tolerance: float = 0.01
    relative: float = 0.0
    ordered: bool = False
    max_missing_share: float = 0.0


#: rounding of large numbers and small differences in the number of rows pass
LENIENT = Leniency(relative=1e-6, max_missing_share=0.05)


def numeric_cells(df: DataFrame, cells: str = "cells") -> DataFrame:
    """The most numeric cells in a row (one row)."""
    numbers = F.size(F.filter(cells, lambda c: _plain(c).rlike(_NUMBER)))
    return df.agg(F.coalesce(F.max(numbers), F.lit(0)).alias("n"))


def compare_results(
    expected: DataFrame,
    actual: DataFrame,
    pair: str = "pair_id",
    cells: str = "cells",
    position: str = "row_no",
    rules: Leniency = Leniency(),
    pairs: DataFrame | None = None,
    grids: int | None = None,
) -> DataFrame:
    """One verdict row per pair: counts of matched, missing and extra rows.

    Numbers are put in buckets of the tolerance's width on d + 1 grids, moved
    against each other by equal steps, d being the most numeric cells of a row.
    A difference smaller than a step crosses a border of one grid at most, so d
    such cells leave a grid on which the rows agree. Rows meet by counts: those
    that agree on all grids first, then what is left grid by grid. Rows left over
    then meet by the whole tolerance, see ``_met_near``.

    ``pairs`` names all pairs: one whose results are both empty passes. ``grids``
    sets the number of grids where it is known; else one pass counts cells.
    """
    lead = [F.col(position)] if rules.ordered else []
    if rules.tolerance == 0:
        grids = 1
    elif grids is None:
        held = numeric_cells(expected, cells).unionAll(numeric_cells(actual, cells))
        grids = held.agg(F.max("n")).first()[0] + 1
    shifts = [_GRID_START + g / grids for g in range(grids)]
    keys = [f"k{g}" for g in range(grids)]

    numbers = [f"v{i}" for i in range(grids - 1)]
    texts = ["text_key"] if numbers else []

    def side(df: DataFrame, is_expected: int) -> DataFrame:
        found = F.filter(F.transform("__values", lambda v: _bent(v["number"], rules)), lambda x: x.isNotNull())
        return _with_values(df, cells).select(
            F.col(pair),
            *[_row_key(rules, shift, *lead).alias(k) for k, shift in zip(keys, shifts)],
            *[_text_key(*lead).alias(t) for t in texts],
            *[F.get(found, F.lit(i)).alias(v) for i, v in enumerate(numbers)],
            F.lit(is_expected).alias("e"),
            F.lit(1 - is_expected).alias("a"),
        )

    # one grouping serves as the join of both sides and combines copies on the map side
    grouped = side(expected, 1).unionAll(side(actual, 0)).groupBy(pair, *keys, *texts).agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), *[F.min(v).alias(v) for v in numbers]
    )
    met = F.least("e", "a")
    nothing = F.lit(0).cast("bigint")
    # with several grids all expected rows count as met here, and those left at the end are taken off again
    counted = F.col("e") if grids > 1 else met
    # cells hold no NaN; the totals name the numbers so that, with the same columns, both readers share one shuffle
    for v in numbers:
        counted = F.when(F.isnan(v), nothing).otherwise(counted)
    parts = [
        grouped.groupBy(pair).agg(
            F.sum("e").alias("expected_rows"), F.sum("a").alias("actual_rows"), F.sum(counted).alias("matched_rows")
        )
    ]
    if grids > 1:
        rest = grouped.filter(F.col("e") != F.col("a")).select(
            pair, *keys, *texts, *numbers, (F.col("e") - met).alias("e"), (F.col("a") - met).alias("a")
        )
        for k in keys:
            rest = _met_on(rest, pair, k, keys, [*texts, *numbers])
        near = _met_near(rest, pair, numbers, rules)
        parts.append(
            near.groupBy(pair).agg(nothing.alias("expected_rows"), nothing.alias("actual_rows"), F.sum(-F.col("unmet")).alias("matched_rows"))
        )
    if pairs is not None:
        parts.append(pairs.select(pair, *[nothing.alias(c) for c in ("expected_rows", "actual_rows", "matched_rows")]).distinct())
    totals = parts[0]
    for extra in parts[1:]:
        totals = totals.unionByName(extra)
    return _verdicts(totals, pair, rules)


def _met_on(rest: DataFrame, pair: str, key: str, keys: list[str], carried: list[str]) -> DataFrame:
    """Let rows that agree on one grid meet; returns the rows of which some are left.

    A bucket of one grid holds few buckets of the others, so its window is short.
    """
    bucket = Window.partitionBy(pair, key)
    before = bucket.orderBy(*[k for k in keys if k != key]).rowsBetween(Window.unboundedPreceding, -1)
    within = F.least(F.sum("e").over(bucket), F.sum("a").over(bucket))
    nothing = F.lit(0).cast("bigint")

    def taken(s: str) -> Column:
        left = F.col("__within") - F.coalesce(F.col(f"__{s}_before"), nothing)
        return F.greatest(nothing, F.least(F.col(s), left))

    seen = rest.withColumns(
        {"__within": within, "__e_before": F.sum("e").over(before), "__a_before": F.sum("a").over(before)}
    )
    return seen.select(
        pair, *keys, *carried, (F.col("e") - taken("e")).alias("e"), (F.col("a") - taken("a")).alias("a")
    ).filter(F.col("e") + F.col("a") > 0)


def _met_near(rest: DataFrame, pair: str, numbers: list[str], rules: Leniency) -> DataFrame:
    """(pair, unmet): expected rows that meet none by the whole tolerance in every number.

    Rows of equal texts are cut into clusters where a number leaves a gap wider
    than the tolerance, number after number; no rows of different clusters meet.
    All windows share one shuffle. In a cluster, expected rows in order take the
    first rows left that are near in all numbers, which for one number meets as
    many as can be.
    """
    group = [pair, "text_key"]
    rows = rest
    for i, v in enumerate(numbers):
        ordered = Window.partitionBy(*group).orderBy(F.col(v).asc_nulls_first())
        gap = F.coalesce((F.col(v) - F.lag(v).over(ordered) > rules.tolerance + _SLACK).cast("int"), F.lit(0))
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(f"gap{i}", gap).withColumn(f"c{i}", F.sum(f"gap{i}").over(so_far))
        group.append(f"c{i}")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(v).asc_nulls_first() for v in numbers]))
    rows = rows.withColumn("block", F.floor((place - 1) / CLUSTER_ROWS))
    row = F.struct(F.array(*numbers).alias("n"), "e", "a")
    clusters = rows.groupBy(*group, "block").agg(
        F.sum("e").alias("e"), F.array_sort(F.collect_list(row)).alias("rows")
    )
    es = F.filter("rows", lambda r: r["e"] > 0)
    cs = F.filter("rows", lambda r: r["a"] > 0)

    def near(x: Column, y: Column) -> Column:
        return F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(F.abs(p - q) <= rules.tolerance + _SLACK, F.lit(True))), lambda ok: ok)

    def give(x: Column, left: Column) -> Column:
        """What is left of the actual rows after an expected row took its part."""
        start = F.struct(x["e"].alias("want"), left.alias("left"))

        def offer(s: Column, j: Column) -> Column:
            there = F.get(s["left"], j)
            taken = F.when(near(x["n"], there["n"]), F.least(s["want"], there["a"])).otherwise(F.lit(0).cast("bigint"))
            after = F.transform(
                s["left"],
                lambda r, i: F.struct(r["n"].alias("n"), r["e"].alias("e"), (r["a"] - F.when(i == j, taken).otherwise(F.lit(0).cast("bigint"))).alias("a")),
            )
            return F.when(taken > 0, F.struct((s["want"] - taken).alias("want"), after.alias("left"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, offer, lambda s: s["left"])

    def total(listed: Column) -> Column:
        return F.aggregate(listed, F.lit(0).cast("bigint"), lambda n, r: n + r["a"])

    both = (F.size("es") > 0) & (F.size("cs") > 0)
    told = clusters.withColumns({"es": es, "cs": cs})
    after = F.aggregate("es", F.col("cs"), lambda left, x: give(x, left))
    return told.select(pair, (F.col("e") - F.when(both, total(F.col("cs")) - total(after)).otherwise(0)).alias("unmet"))


def _verdicts(totals: DataFrame, pair: str, rules: Leniency) -> DataFrame:
    rows = totals.groupBy(pair).agg(
        F.sum("expected_rows").alias("expected_rows"),
        F.sum("actual_rows").alias("actual_rows"),
        F.sum("matched_rows").alias("matched_rows"),
    )
    larger = F.greatest("expected_rows", "actual_rows").cast("double")
    found = F.col("matched_rows") == F.least("expected_rows", "actual_rows")
    ratio = F.coalesce(F.try_divide(F.col("matched_rows").cast("double"), larger), F.lit(1.0))
    return rows.withColumns(
        {
            "missing_rows": F.col("expected_rows") - F.col("matched_rows"),
            "extra_rows": F.col("actual_rows") - F.col("matched_rows"),
            "match_ratio": ratio,
            "passed": found & ((1.0 - ratio) <= rules.max_missing_share + 1e-12),
        }
    )


def as_cells(df: DataFrame, pair: str, columns: list[str], position: str | None = None) -> DataFrame:
    """Rows of a typed result in the (pair, cells) shape."""
    kept = [F.col(pair)] + ([F.col(position).alias("row_no")] if position else [])
    return df.select(*kept, F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))


def column_order(expected: DataFrame, actual: DataFrame, pair: str = "pair_id", cells: str = "cells") -> DataFrame:
    """For each pair, which actual column answers each expected column.

    Column names are ignored: columns are matched by how much of their value
    multisets they share. Columns that share nothing keep their order. Copies of
    a value are counted on the map side, so one value in a third of all cells
    reaches the join as one row per column.
    """

    def profile(df: DataFrame, name: str) -> DataFrame:
        shown = F.transform("__values", lambda v: _shown(v, Leniency(tolerance=0), 0))
        opened = _with_values(df, cells).select(pair, F.posexplode(shown).alias(name, "value"))
        return opened.groupBy(pair, name, "value").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    shared = (
        profile(expected, "e")
        .join(profile(actual, "a"), [pair, "value"])
        .groupBy(pair, "e", "a")
        .agg(F.sum(F.least("n_e", "n_a")).alias("overlap"))
    )
    found = shared.groupBy(pair).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(":", "e", "a").alias("key"), F.col("overlap").alias("value")))
        ).alias("overlaps")
    )
    widths = expected.groupBy(pair).agg(F.max(F.size(cells)).alias("we")).join(
        actual.groupBy(pair).agg(F.max(F.size(cells)).alias("wa")), pair
    )
    both = widths.join(found, pair, "left")

    def candidate(e: Column, a: Column) -> Column:
        overlap = F.coalesce(F.try_element_at("overlaps", F.concat_ws(":", e, a)), F.lit(0))
        return F.struct((-overlap).alias("o"), F.abs(e - a).alias("d"), e.alias("e"), a.alias("a"))

    def positions(width: str) -> Column:
        return F.sequence(F.lit(0), F.col(width) - 1)

    pairs = F.array_sort(
        F.flatten(F.transform(positions("we"), lambda e: F.transform(positions("wa"), lambda a: candidate(e, a))))
    )
    start = F.array().cast("array<struct<e:int,a:int>>")

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["e"] == c["e"]) | (k["a"] == c["a"]))
        one = F.array(F.struct(c["e"].cast("int").alias("e"), c["a"].cast("int").alias("a")))
        return F.when(clash, kept).otherwise(F.concat(kept, one))

    chosen = F.aggregate(pairs, start, take)
    return both.select(pair, F.transform(F.array_sort(chosen), lambda c: c["a"]).alias("column_order"))


def reorder_cells(actual: DataFrame, order: DataFrame, pair: str = "pair_id", cells: str = "cells") -> DataFrame:
    """Actual rows with their cells in the order of the expected columns.

    Columns beyond the expected ones follow in their own order.
    """
    joined = actual.join(order, pair, "left")
    indexes = F.sequence(F.lit(0), F.size(cells) - 1)
    full = F.coalesce(F.array_union("column_order", indexes), indexes)
    picked = F.transform(full, lambda i: F.get(F.col(cells), i))
    return joined.withColumn(cells, F.when(F.size(cells) > 0, picked).otherwise(F.col(cells))).drop("column_order")


def compare_any_columns(
    expected: DataFrame, actual: DataFrame, pair: str = "pair_id", rules: Leniency = Leniency()
) -> DataFrame:
    """Compare results whose columns may come in another order or under other names."""
    order = column_order(expected, actual, pair)
    return compare_results(expected, reorder_cells(actual, order, pair), pair, rules=rules)


def comparison_mode(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    """``results`` when both sides have a result, else ``sql``."""
    both = F.col(expected).isNotNull() & F.col(actual).isNotNull()
    return pairs.withColumn("comparison_type", F.when(both, "results").otherwise("sql"))


def compare_sql(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    """Verdict from the normalized query texts; a missing side fails with its reason."""
    no_actual = F.coalesce(F.col(actual), F.lit("")) == ""
    no_expected = F.coalesce(F.col(expected), F.lit("")) == ""
    same = normalize_sql(expected) == normalize_sql(actual)

    def pick(no_sql, nothing_expected, equal, different) -> Column:
        return (
            F.when(no_actual, no_sql).when(no_expected, nothing_expected).when(same, equal).otherwise(different)
        )

    def listed(text: str) -> Column:
        return F.array(F.lit(text))

    plain = "Query texts compared after normalization"
    return pairs.withColumns(
        {
            "passed": pick(F.lit(False), F.lit(False), F.lit(True), F.lit(False)),
            "confidence": pick("high", "low", "medium", "low"),
            "reasoning": pick("There is no query to judge", "There is no expected query", plain, plain),
            "differences": pick(
                listed("query absent"),
                listed("expected query absent"),
                F.array().cast("array<string>"),
                listed("normalized texts differ"),
            ),
            "semantic_equivalence": pick("none", "unknown", "same text", "other text"),
        }
    )
