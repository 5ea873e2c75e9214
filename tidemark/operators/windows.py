"""Ordered comparisons: change rates, ranks, shares, spikes and trial decisions.

Windows without a slice run on rows already reduced to one per day, week or
label, whose number does not grow with the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import SpikeRule
from tidemark.functions.numbers import percent_change
from tidemark.operators import sliced


def _window(partition: list[str] | None, order: list):
    return Window.partitionBy(*(partition or [])).orderBy(*order)


def pct_change(
    df: DataFrame,
    c: str,
    order: str,
    name: str,
    partition: list[str] | None = None,
    guard: str = "positive",
    previous: str | None = None,
) -> DataFrame:
    """Change in percent against the previous row; ``previous`` keeps that value."""
    kept = previous or "__previous"
    moved = df.withColumn(kept, F.lag(c).over(_window(partition, [order])))
    rated = moved.withColumn(name, percent_change(c, kept, guard))
    return rated if previous else rated.drop(kept)


def lagged_effect(df: DataFrame, driver: str, effect: str, order: str, lags: list[int], labels, otherwise, strong=20):
    """Label of the first lag at which the earlier effect was strong while the driver is."""
    label = F
    for k, text in zip(lags, labels):
        hit = (F.col(driver) > strong) & (F.lag(effect, k).over(_window(None, [order])) > strong)
        label = label.when(hit, text)
    return df.withColumn("response_timing", label.otherwise(otherwise))


def top1_per_group(df: DataFrame, keys: list[str], best: list[Column], carry: list[str]) -> DataFrame:
    """The row with the smallest ``best`` tuple per key (negate a column for descending)."""
    smallest = F.min(F.struct(F.struct(*best).alias("o"), F.struct(*carry).alias("v")))["v"]
    return df.groupBy(*keys).agg(smallest.alias("v")).select(*keys, "v.*")


def latest_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest record per entity of a snapshot table.

    A struct maximum instead of a row number: it combines on the map side, so an
    entity with a third of all snapshots reaches the shuffle as one row per task.
    Remaining columns break ties, which keeps the result independent of row order.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    top = F.max(F.struct(*lead)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, "__top.*").select(*df.columns)


def snapshot_view(df: DataFrame, keys: list[str], order: list[str], snapshot: str = "raw") -> DataFrame:
    """``raw`` keeps every collected snapshot row, ``latest`` one row per entity."""
    if snapshot not in ("raw", "latest"):
        raise ValueError(snapshot)
    return df if snapshot == "raw" else latest_record(df, keys, order)


def rank_by(df: DataFrame, name: str, order: Column, partition: list[str] | None = None) -> DataFrame:
    """Competition rank (ties share a rank, the next one is skipped).

    For partitions of bounded size, such as countries; ``sliced.competition_ranks``
    ranks rows whose number grows with the data.
    """
    return df.withColumn(name, F.rank().over(_window(partition, [order])))


def share(
    df: DataFrame, c: str, name: str, partition: list[str] | None = None, digits: int = 2, few: bool = False
) -> DataFrame:
    """Percent of the grand total or of the partition total.

    The grand total is a scalar subquery. Where ``df`` is already one row per
    label, ``few`` sums it in place instead of reading its facts a second time.
    """
    value = F.col(c).cast("double")
    if partition or few:
        total = F.sum(c).over(Window.partitionBy(*(partition or []))).cast("double")
    else:
        total = df.agg(F.sum(c).cast("double").alias("total")).scalar()
    return df.withColumn(name, F.round(F.try_divide(value * 100.0, total), digits))


def with_total(df: DataFrame, partition: list[str], totals: dict[str, str]) -> DataFrame:
    """Partition totals repeated on each row; {output name: column}."""
    over = Window.partitionBy(*partition)
    return df.withColumns({name: F.sum(c).over(over) for name, c in totals.items()})


def delta_prev(df: DataFrame, c: str, order: str, name: str, previous: str, partition: list[str] | None = None):
    moved = df.withColumn(previous, F.lag(c).over(_window(partition, [order])))
    return moved.withColumn(name, F.col(c) - F.col(previous))


def jump_rows(df: DataFrame, c: str, order: str, name: str, previous: str, over: float) -> DataFrame:
    """Rows whose value rose by more than ``over`` against the previous row."""
    return delta_prev(df, c, order, name, previous).filter(F.col(name) > over)


def detect_spikes(series: DataFrame, order: str, count: str, ratio: str, growth: str, rule: SpikeRule) -> DataFrame:
    """Series with its growth rate and a flag ``is_spike``."""
    rated = pct_change(series, count, order, growth)
    return rated.withColumn("is_spike", rule.holds(growth, count, ratio))


def decide_trials(
    trials: DataFrame,
    keys: list[str],
    order: list[str],
    score: str,
    initial: str,
    target: float,
    failed: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Replay keep / reject decisions over a trial log.

    The score to beat only ever rises, so it is the larger of the initial score
    and the best earlier score. A trial below it is rejected; an equal or better
    one is kept. Trials after the first kept trial that reaches the target never
    ran, and the first trial always runs. A trial with an error is rejected and
    leaves the best score as it is; the target is not checked after it.
    """
    ok = F.lit(True) if failed is None else ~F.coalesce(F.col(failed), F.lit(False))
    valid = trials.withColumn("__valid", F.when(ok, F.col(score)))
    seen = sliced.best_before(valid, keys, order, "__valid", "__best_before", slices)
    to_beat = F.greatest(F.col(initial), F.col("__best_before"))
    # an earlier valid trial exists, and the score after it had reached the target
    stopped = F.col("__best_before").isNotNull() & (to_beat >= target)
    decision = (
        F.when(F.col("__valid").isNull(), "error")
        .when(F.col("__valid") > F.col("score_to_beat"), "improved")
        .when(F.col("__valid") < F.col("score_to_beat"), "regressed")
        .otherwise("unchanged")
    )
    return (
        seen.withColumn("score_to_beat", to_beat)
        .filter(~stopped)
        .withColumn("decision", decision)
        .withColumn("kept", F.col("decision").isin("improved", "unchanged"))
        .drop("__valid", "__best_before")
    )


def stop_signals(
    iterations: DataFrame,
    key: str,
    order: str,
    score: str,
    target: float,
    cap: int,
    min_gain: float = 0.05,
    stale: int = 3,
    drops: int = 2,
) -> DataFrame:
    """Stop conditions per iteration of a run.

    Runs on one row per (run, iteration); the iteration cap bounds a run.
    """
    w = _window([key], [order])
    gain = F.col(score) - F.lag(score).over(w)

    def streak(flag: str, length: int) -> Column:
        recent = w.rowsBetween(-(length - 1), 0)
        return F.coalesce(F.sum(flag).over(recent), F.lit(0)) == length

    return (
        iterations.withColumn("score_gain", gain)
        .withColumn("__flat", F.when(F.col("score_gain") < min_gain, 1).otherwise(0))
        .withColumn("__drop", F.when(F.col("score_gain") < 0, 1).otherwise(0))
        .withColumn("target_reached", F.col(score) >= target)
        .withColumn("cap_reached", F.col(order) >= cap)
        .withColumn("no_gain", streak("__flat", stale))
        .withColumn("degrading", streak("__drop", drops))
        .withColumn("stop", F.col("target_reached") | F.col("cap_reached") | F.col("no_gain") | F.col("degrading"))
        .drop("__flat", "__drop")
    )
