"""Problem 9: texts are put into containers of fixed token capacity.

Method: cost-balanced packing. The cost of a text is its attention cost, linear plus
quadratic in its tokens; the texts go in descending order to the sequence of lowest cost
that still has room. Random shards of fixed size are packed independently: a shard of some
thousands of containers wastes at most its last one, and no task sees more than a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import ship_package

#: Size of a shard: whichever bound is reached first. Fixed, so the number of shards grows with the data.
SHARD_TOKENS, SHARD_ITEMS = 4_000_000, 20_000
#: A text's cost is tokens + tokens^2 / QUADRATIC_AT: both parts are equal at this length.
QUADRATIC_AT = 4096


def assign(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; items must be in descending order and fit a container.

    Starts with the fewest containers that could hold all and opens another one only when
    no container has room. Equal costs go to the smaller number.
    """
    opened = -(-int(tokens.sum()) // capacity)
    room = np.zeros(opened + len(tokens), dtype=np.int64)
    room[:opened] = capacity
    cost = np.zeros(len(room))
    added = tokens + tokens.astype(float) ** 2 / QUADRATIC_AT
    out = np.empty(len(tokens), dtype=np.int64)
    for i, size in enumerate(tokens):
        open_cost = np.where(room[:opened] >= size, cost[:opened], np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            at, opened = opened, opened + 1
            room[at] = capacity
        room[at] -= size
        cost[at] += added[i]
        out[i] = at
    return out


def pack(sizes: DataFrame, key: str, capacity: int, target_id: int) -> DataFrame:
    """(target_id, key, part, first_token, tokens, container_id) for sizes (key, tokens), keys distinct.

    A text longer than the capacity is split into full parts, each a container of its own,
    and a rest; no other text is split. Parts count from 0. Texts without tokens, and null
    sizes, need no container: one row with 0 tokens and a null container_id. An empty input
    gives an empty result.
    """
    ship_package(sizes.sparkSession)
    kind = sizes.schema[key].dataType.simpleString()
    whole, rest = F.floor(F.col("tokens") / capacity).cast("int"), F.col("tokens") % capacity
    sizes = sizes.select(key, F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    full = sizes.where(F.col("tokens") >= capacity).withColumn("part", F.explode(F.sequence(F.lit(0), whole - 1)))
    full = full.select(
        key, "part", (F.col("part") * F.lit(capacity).cast("bigint")).alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"),
        F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("part").cast("string")).alias("container_id"),
    )
    nothing = sizes.where("tokens = 0").select(
        key, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("first_token"), "tokens", F.lit(None).cast("string").alias("container_id")
    )
    rests = sizes.where(rest > 0).select(key, whole.alias("part"), (F.col("tokens") - rest).alias("first_token"), rest.alias("tokens"))
    total, count = rests.agg(F.sum("tokens"), F.count("*")).first()
    shards = max(1, math.ceil((total or 0) / SHARD_TOKENS), math.ceil(count / SHARD_ITEMS))
    rests = rests.withColumn("shard", F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["tokens", key], ascending=[False, True])
        number = assign(shard["tokens"].to_numpy(), capacity)
        name = f"{shard['shard'].iat[0]}-"
        return shard.drop(columns="shard").assign(container_id=[name + str(n) for n in number])

    packed = rests.groupBy("shard").applyInPandas(run, f"{key} {kind}, part int, first_token bigint, tokens bigint, container_id string")
    columns = [key, "part", "first_token", "tokens", "container_id"]
    out = packed.select(columns).union(full.select(columns)).union(nothing.select(columns))
    return out.select(F.lit(target_id).alias("target_id"), *columns)
