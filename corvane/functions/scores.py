"""Engagement, pulse, novelty, direction and confidence scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def engagement(liked: Column, discussed: Column) -> Column:
    """ln(1 + likes) + half of ln(1 + comments); missing or negative counts are 0."""
    zero = F.lit(0)
    return F.log1p(F.greatest(F.coalesce(liked, zero), zero)) + 0.5 * F.log1p(F.greatest(F.coalesce(discussed, zero), zero))


def with_percentile(rows: DataFrame, group: str, value: str, out: str, average: bool = False) -> DataFrame:
    """Adds the percentile of a value within its group.

    Plain: the share, in percent, of the group's rows with at most this value. Average: the
    rank from 0 to 100, ties at their average rank; 50 if all are equal. Null groups and values
    are groups and (lowest) values of their own. Only the distinct values of a group are
    ordered, with their counts, so a group that holds a third of all rows needs no large sort.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_g")
    upto, total = F.sum("_n").over(own.orderBy("_v")), F.sum("_n").over(own)
    if average:
        rank = (upto - F.col("_n") + (F.col("_n") - 1) / 2) / F.greatest(total - 1, F.lit(1))
        share = F.when(F.count("*").over(own) == 1, F.lit(50.0)).otherwise(100 * rank)
    else:
        share = 100 * upto / total
    ranked = counts.select("_g", "_v", share.alias(out))
    return rows.join(ranked, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def discussion_depth(comments: Column, ratio: Column) -> Column:
    """ln(1 + comments) damped by the upvote ratio; 0 for controversial posts."""
    ratio = F.coalesce(ratio, F.lit(0.0))
    return F.when(ratio < 0.5, F.lit(0.0)).otherwise(F.log1p(F.coalesce(comments, F.lit(0))) * F.least(ratio, F.lit(1.0)))


def velocity(comments: Column, hours: Column) -> Column:
    return F.coalesce(comments, F.lit(0)) / F.greatest(hours, F.lit(1.0))


def pulse_score(percentile: Column, speed: Column, depth: Column, repetition: Column, novelty: Column) -> Column:
    """Weighted pulse: percentile .30, velocity .25, depth .20, repetition .15, novelty .10, each on 0 to 100."""
    capped = lambda c: F.least(c, F.lit(100.0))
    return F.least(F.lit(100.0), 0.30 * percentile + 0.25 * capped(speed * 10) + 0.20 * capped(depth * 10) + 0.15 * repetition * 100 + 0.10 * novelty * 100)


def age_hours(published: Column, observed_day: Column, form: str) -> Column:
    """Hours from a time of this form to the end of a day, at least one; 24 for a time of another form."""
    end = F.unix_timestamp(F.to_timestamp(F.concat(observed_day, F.lit("T23:59:59Z"))))
    hours = (end - F.when(published.rlike(form), published).try_cast("timestamp").cast("double")) / 3600
    return F.when(hours.isNull(), 24.0).otherwise(F.greatest(F.lit(1.0), hours))


def gap_available(voices: int, mainstream: int, least: int = 100, share: float = 0.2) -> bool:
    """Whether a collection has enough mainstream items beside its voices to measure a gap."""
    return voices > 0 and mainstream >= max(least, share * voices)


def perspective_gap(pulse: Column, coverage: Column) -> Column:
    """How much a loud topic lacks coverage: pulse share times the share of five outlets that don't cover it."""
    return pulse / 100 * (1 - F.least(coverage, F.lit(5)) / 5)


def novelty_by_age(days: Column) -> Column:
    """100 on the first day, then 80, 55, 30 and 10."""
    return F.when(days <= 0, 100).when(days <= 1, 80).when(days <= 3, 55).when(days <= 7, 30).otherwise(10)


def coverage_score(clusters: Column) -> Column:
    return F.when(clusters <= 0, 0).when(clusters == 1, 25).when(clusters == 2, 55).when(clusters == 3, 75).when(clusters == 4, 90).otherwise(100)


def direction(first_seen: Column, today: Column, items: Column, sources: Column, items_before: Column, sources_before: Column, gap_days: Column) -> Column:
    """resurfacing after two weeks, new on the first day, growing by 30 % in items or sources, fading by 30 % in both, else stable."""
    growth = lambda now, before: F.when(before > 0, (now - before) / before).otherwise(F.when(now > 0, 1.0).otherwise(0.0))
    known = items_before.isNotNull() & sources_before.isNotNull()
    more, wider = growth(items, items_before), growth(sources, sources_before)
    return (
        F.when(gap_days >= 14, "resurfacing")
        .when(first_seen == today, "new")
        .when(known & ((more >= 0.3) | (wider >= 0.3)), "growing")
        .when(known & (more <= -0.3) & (wider <= -0.3), "fading")
        .otherwise("stable")
    )


def theme_direction(count: Column, before: Column) -> Column:
    """new, growing, fading or stable against the count before, by 30 %."""
    return F.when(before.isNull(), "new").when(count > before * 1.3, "growing").when(count < before * 0.7, "fading").otherwise("stable")


def lifecycle(ready: Column, count: Column, before: Column, gap_days: Column) -> Column:
    """Of a trend against its last release: insufficient_history, new, resurfacing, growing, fading or stable."""
    ratio = F.greatest(count, F.lit(1)) / F.greatest(F.coalesce(before, F.lit(0)), F.lit(1))
    return (
        F.when(~ready, "insufficient_history")
        .when(before.isNull(), "new")
        .when((gap_days >= 7) & (count >= 2), "resurfacing")
        .when(ratio >= 1.5, "growing")
        .when((ratio < 0.75) & (gap_days >= 2), "fading")
        .otherwise("stable")
    )


def confidence(providers: Column, evidence: Column) -> Column:
    return F.when((providers >= 3) & (evidence >= 70), "high").when((providers >= 2) | (evidence >= 60), "medium").otherwise("low")


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """Sum of parts by weight; a missing part counts as 50."""
    total = F.lit(0.0)
    for part, weight in parts:
        total = total + F.coalesce(part.cast("double"), F.lit(50.0)) * weight
    return total


def upper_median(values: Column) -> Column:
    """The upper of two middle values of an array; null for an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
