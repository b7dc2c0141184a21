"""Problem 7: no contributor keeps more than a share of a snapshot.

Method: parallel bisection. For every contributor over the cap the bounds of the cutoff
are held, the records above all midpoints of all contributors are counted in one pass,
and the bounds close in on the last record kept; ties at the boundary are resolved by
the same search over the identifier. No contributor is ever sorted or gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.runtime import Scratch

#: Midpoints per contributor and pass: the interval shrinks 64-fold each time.
FAN = 64
#: Bytes of an identifier searched at a level, so that they fit a positive bigint.
CHUNK = 7
#: Infinite qualities count as this; a missing one lies below every number.
LARGEST, MISSING = 1e300, -1e301


@dataclass
class _Search:
    """The state of one contributor: cutoffs of finished levels, bounds of the present one."""

    slots: int
    done: list = field(default_factory=list)
    low: float | int | None = None
    high: float | int | None = None


def _rank_key(quality: Column) -> Column:
    """Smaller is better: the negated quality, missing last."""
    number = quality.cast("double")
    number = F.when(quality.isNull() | F.isnan(number), F.lit(MISSING)).otherwise(
        F.greatest(F.least(number, F.lit(LARGEST)), F.lit(-LARGEST))
    )
    return -number + F.lit(0.0)


def _id_chunk(text: Column, level: int) -> Column:
    """The level-th seven UTF-8 bytes as a number; code-point order is kept, an ended text comes first."""
    part = F.substring(F.encode(text, "utf-8"), level * CHUNK + 1, CHUNK)
    return F.conv(F.rpad(F.hex(part), CHUNK * 2, "0"), 16, 10).cast("bigint")


def _key(level: int) -> Column:
    return F.col("rank_key") if level == 0 else _id_chunk(F.col("record_id"), level - 1)


def _pass(records: DataFrame, level: int, states: dict[int, _Search]) -> dict[int, list]:
    """Counts, smallest and largest key of every slice between midpoints, for all contributors at once."""
    kind = "double" if level == 0 else "bigint"
    names = [f"v{i}" for i in range(level)]
    schema = ", ".join(["code int", *(f"{n} {'double' if n == 'v0' else 'bigint'}" for n in names), f"low {kind}", f"high {kind}"])
    rows = [(code, *s.done, s.low, s.high) for code, s in states.items()]
    # At most 1/share contributors can exceed the share, so the bounds are a few rows at any size of the data.
    bounds = F.broadcast(records.sparkSession.createDataFrame(rows, schema))
    at = records.join(bounds, "code")
    for i, n in enumerate(names):
        at = at.where(_key(i) == F.col(n))
    at = at.withColumn("key", _key(level)).where("low is null or key between low and high")
    if level == 0:
        part = F.floor(F.least((F.col("key") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * FAN, F.lit(FAN - 1.0)))
    else:
        part = F.expr(f"(key - low) div ((high - low) div {FAN} + 1)")
    at = at.withColumn("slice", F.coalesce(part.cast("int"), F.lit(0)))
    counted = at.groupBy("code", "slice").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    out: dict[int, list] = {code: [] for code in states}
    for row in counted.collect():  # at most FAN rows per contributor over the share
        out[row["code"]].append((row["slice"], row["n"], row["least"], row["most"]))
    return {code: sorted(found) for code, found in out.items()}


def _cutoffs(records: DataFrame, cap: int, codes: list[int]) -> dict[int, list]:
    """Per contributor the keys of its last kept record, as far as needed to tell it from the next."""
    active, result, level = {code: _Search(cap) for code in codes}, {}, 0
    while active:
        searching = dict(active)
        while searching:
            for code, slices in _pass(records, level, searching).items():
                state = searching[code]
                for _, n, least, most in slices:
                    if state.slots > n:
                        state.slots -= n
                        continue
                    state.low, state.high = least, most
                    if state.slots == n:  # the slice is kept whole: its largest key is the cutoff
                        result[code] = [*state.done, most]
                        del searching[code], active[code]
                    elif least == most:
                        state.done.append(least)
                        state.low = state.high = None
                        del searching[code]
                    break
        level += 1
    return result


def over_share(records: DataFrame, share: float = 0.02, least: int = 1) -> DataFrame:
    """The record_ids to drop, given distinct records (contributor, record_id, quality).

    A contributor keeps at most floor(share * all records), at least `least`: highest
    quality first, a null or NaN quality last, ties by the smaller record_id. A null
    contributor is nobody and keeps all, a null record_id is no record. Records must be
    distinct by record_id. Returns (record_id); empty for an empty input.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "capping")
    records = records.where("record_id is not null").select("contributor", "record_id", _rank_key(F.col("quality")).alias("rank_key"))
    records = scratch.save(records, "records")
    total = records.count()
    cap = max(least, math.floor(round(share * total, 6)))
    sizes = records.where("contributor is not null").groupBy("contributor").count().where(F.col("count") > cap)
    large = [row["contributor"] for row in sizes.orderBy("contributor").collect()]  # fewer than 1/share rows
    if not large:
        return records.select("record_id").limit(0)
    codes = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(large)], "contributor string, code int"))
    records = scratch.save(records.join(codes, "contributor").select("code", "record_id", "rank_key"), "large")
    cutoffs = _cutoffs(records, cap, list(range(len(large))))
    depth = max(map(len, cutoffs.values()))
    schema = ", ".join(["code int", *(f"v{i} {'double' if i == 0 else 'bigint'}" for i in range(depth))])
    rows = [(code, *found, *[None] * (depth - len(found))) for code, found in cutoffs.items()]
    beyond = F.lit(False)
    for i in reversed(range(depth)):
        last = F.col(f"v{i}")
        beyond = F.coalesce((_key(i) > last) | ((_key(i) == last) & beyond), F.lit(False))
    joined = records.join(F.broadcast(spark.createDataFrame(rows, schema)), "code")
    return joined.where(beyond).select("record_id")
