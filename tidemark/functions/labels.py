"""Labels derived from dates, change rates, scores, flags and keywords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import day, to_col

# The label texts of the recorded results.
MAGNITUDE_LABELS = ("큰 변화", "중간 변화", "작은 변화")
DIRECTION_LABELS = ("급증", "증가", "급감", "감소", "안정")
TRAFFIC_LABELS = (
    "강한 양의 상관관계",
    "강한 음의 상관관계",
    "역상관관계",
    "약한 상관관계",
    "중간 상관관계",
)
TIMING_LABELS = ("1일 지연 효과", "2일 지연 효과", "즉시 반응")
WISHLIST_LABELS = (
    "위시리스트 증가 → 소셜 반응 증가",
    "위시리스트 감소 → 소셜 반응 증가 (역상관)",
    "위시리스트 증가 → 소셜 반응 감소 (역상관)",
    "약한 상관관계",
)
PROGRESS_LABELS = ("Target Reached ✅", "Max Iterations", "In Progress...")


def first_match(rules: list[tuple[Column, str]], otherwise) -> Column:
    """Label of the first rule that holds; NULL conditions do not hold."""
    label = None
    for condition, text in rules:
        label = F.when(condition, text) if label is None else label.when(condition, text)
    return label.otherwise(otherwise)


def period_label(c: str | Column, start, end=None, names=("before", "during", "after")) -> Column:
    """before / during / after a closed date range."""
    c = to_col(c)
    return first_match([(c < day(start), names[0]), (c <= day(end), names[1])], names[2])


def inside_label(c: str | Column, start, end, inside: str, outside: str) -> Column:
    return F.when(to_col(c).between(day(start), day(end)), inside).otherwise(outside)


def change_magnitude(c: str | Column, bands=(30, 10), labels=MAGNITUDE_LABELS) -> Column:
    size = F.abs(to_col(c))
    return first_match([(size > bands[0], labels[0]), (size > bands[1], labels[1])], labels[2])


def change_direction(c: str | Column, small: float = 5, large: float = 20, labels=DIRECTION_LABELS) -> Column:
    c = to_col(c)
    return first_match(
        [(c > large, labels[0]), (c > small, labels[1]), (c < -large, labels[2]), (c < -small, labels[3])],
        labels[4],
    )


def traffic_comovement(traffic: str | Column, social: str | Column, strong: float = 20, weak: float = 10) -> Column:
    """How two change rates move together: same, opposite, inverse, weak, medium."""
    t, s = to_col(traffic), to_col(social)
    up_t, down_t, up_s, down_s = t > strong, t < -strong, s > strong, s < -strong
    calm = (F.abs(t) < weak) & (F.abs(s) < weak)
    same, opposite, inverse, faint, medium = TRAFFIC_LABELS
    return first_match(
        [(up_t & up_s, same), (up_t & down_s, opposite), (down_t & up_s, inverse), (calm, faint)], medium
    )


def wishlist_comovement(wishlist: str | Column, social: str | Column, strong: float = 20) -> Column:
    w, s = to_col(wishlist), to_col(social)
    both_up, down_up, up_down, faint = WISHLIST_LABELS
    return first_match(
        [
            ((w > strong) & (s > strong), both_up),
            ((w < -strong) & (s > strong), down_up),
            ((w > strong) & (s < -strong), up_down),
        ],
        faint,
    )


def progress_label(score, target, iteration, cap, status) -> Column:
    done, capped, running = PROGRESS_LABELS
    return first_match(
        [
            (to_col(score) >= to_col(target), done),
            (to_col(iteration) >= to_col(cap), capped),
            (to_col(status) == "RUNNING", running),
        ],
        to_col(status),
    )


def sentiment_flag(flag: str | Column) -> Column:
    flag = to_col(flag)
    return first_match([(flag, "positive"), (~flag, "negative")], "unknown")


def sentiment_keywords(c: str | Column, positive: list[str], negative: list[str]) -> Column:
    from tidemark.functions.text import mentions_any

    return first_match([(mentions_any(c, positive), "positive"), (mentions_any(c, negative), "negative")], "neutral")


@dataclass(frozen=True)
class SpikeRule:
    """Growth alone, or a high count together with a high ratio."""

    growth: float = 50
    count: float = 20
    ratio: float = 40

    def holds(self, growth, count, ratio) -> Column:
        by_growth = to_col(growth) >= self.growth
        by_level = (to_col(count) >= self.count) & (to_col(ratio) >= self.ratio)
        return F.coalesce(by_growth, F.lit(False)) | F.coalesce(by_level, F.lit(False))


def position_in(c: str | Column, ordered: list[str]) -> Column:
    """Sort key that puts labels in the given order, anything else last."""
    found = F.array_position(F.array(*[F.lit(x) for x in ordered]), to_col(c))
    return F.when(found > 0, found).otherwise(len(ordered) + 1)
