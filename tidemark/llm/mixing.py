"""Mixing sources to target weights.

Words are summed per source (map-side combined), repetition rates derived from
the source totals, and each document is emitted floor(rate) times plus once more
where its seeded hash lies below the fraction of the rate. DataFrame functions
only.

Defined results: a NULL text has size 0; a NULL source is a source of its own,
last in order; a source without words has target 0 and rate 0; repeated rows of
one doc_id are drawn alike; an empty table gives an empty mix; further columns,
also those named like a result column, pass through ``emit`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import rows_held, unit_hash, word_count

CAP = 3  # no source is repeated more often
WEIGHTS = 3  # sources weigh 1, 2, 3, 1, 2, ...
SALTS = 64  # a source's documents meet its rate in so many join keys
SEED = "mix"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Filling by weight under caps: with the sources in order of cap / weight, the
    common level is the largest of (what is left after the first k caps) / (the
    weights from k on). Works on one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.pmod(F.row_number().over(named) - 1, F.lit(WEIGHTS)) + 1)
    by_cap = Window.orderBy(F.col("source_size") * CAP / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    later = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * CAP
    levelled = weighed.withColumn("level", left / F.sum("weight").over(later))
    share = F.max("level").over(everything) * F.col("weight")
    return levelled.withColumn("share", share).select(
        "source", "source_size",
        F.least(F.col("share"), (F.col("source_size") * CAP).cast("double")).alias("target"),
    )


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: row (its columns), size, source_size, target, copies."""
    held = rows_held(docs).withColumns({"source": F.col("row.source"), "size": word_count(F.col("row.text"))})
    targets = source_targets(held.select("source", "size")).withColumns(
        {"known": F.lit(True), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))}
    )
    salted = held.withColumn("salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
    left, right = salted.alias("d"), targets.alias("t")
    met = left.join(right, F.expr("d.salt = t.salt and d.source <=> t.source"), "left")
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    whole = F.floor(rate)
    once_more = (unit_hash(seed, F.col("d.row.doc_id")) < rate - whole).cast("long")
    return met.select("d.row", "d.size", "t.source_size", "t.target", (whole + once_more).alias("copies"))


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    taken = mixed(docs, seed).where("copies > 0")
    return taken.select(F.explode(F.expr("array_repeat(row, cast(copies as int))")).alias("row")).select("row.*")


ORACLE_SQL = """
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(source_size) over (
               order by source_size * 3 / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) * 3)
            / sum(weight) over (order by source_size * 3 / weight, source nulls last
                                rows between current row and unbounded following) as level
  from w),
t as (select source, source_size, least(max(level) over () * weight, cast(source_size * 3 as double)) as target from l),
r as (
  select doc_id, size, source_size, target,
         case when source_size > 0 then target / source_size else 0.0 end as rate,
         cast(('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint)
           / 4503599627370496.0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, cast(target as double) as target,
       size * cast(floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as bigint) as taken
from r
"""
