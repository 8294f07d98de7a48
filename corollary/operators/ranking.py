"""Distributed ranks: top-n per group, exact order statistics, running sums, hash cuts.

A global or per-key window puts a whole group into one task. The helpers here never do
that for a group whose size grows with the data: they rank inside bounded pieces and add
up bounded tables of piece totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corollary.session import collect_dimension

#: Random positions are 52-bit integers: exact in a double and in a bigint.
HASH_RANGE = 1 << 52
#: Bits by which the levels of running totals differ.
LEVEL_BITS = 16


def hash_position(purpose: str, seed, *parts: Column) -> Column:
    """Deterministic pseudo-random position in [0, 2**52) of ``purpose:seed:part:part``.

    md5 rather than ``rand()``: the value depends on the row alone, so a recomputed
    partition or another plan gives the same choice. The purpose keeps a split, a sample and
    the steps of a training apart that have the same seed.
    """
    text = F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank", salt_on: str | None = None
) -> DataFrame:
    """First ``n`` rows of every group, ranked from 1.

    Spark cuts each input partition to ``n`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends at most ``n`` rows per partition. Above the
    threshold of that rule the same is done with an explicit salted first round.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salt = F.pmod(F.xxhash64(salt_on or F.struct(*df.columns)), F.lit(256))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_first", F.row_number().over(salted))
            .filter(F.col("_first") <= n)
            .drop("_salt", "_first")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def nth_position(df: DataFrame, position: str, tie: str, n: int, leaf: int = 100_000) -> tuple | None:
    """The ``n``-th smallest ``(position, tie)`` of uniformly spread 52-bit positions.

    Narrows by counting 4,096 equal slices at a time, so the driver sees at most 4,096
    counts per round and one slice of at most ``leaf`` rows. NULL result: fewer rows.
    """
    low, width, before = 0, HASH_RANGE, 0
    while True:
        inside = df.filter((F.col(position) >= low) & (F.col(position) < low + width))
        step = max(width // 4096, 1)
        slices = sorted(
            inside.groupBy(((F.col(position) - low) / step).cast("long").alias("slice"))
            .count()
            .collect()
        )
        for index, count in slices:
            if before + count >= n:
                break
            before += count
        else:
            return None
        low, width = low + index * step, step
        if count <= leaf or width == 1:
            break
    rows = (
        df.filter((F.col(position) >= low) & (F.col(position) < low + width))
        .select(position, tie)
        .orderBy(position, tie)
        .limit(n - before)
        .agg(F.max(F.struct(position, tie)).alias("cut"))
        .first()
    )
    return rows.cut[0], rows.cut[1]


def at_or_before(position: Column, tie: Column, cut: tuple) -> Column:
    return (position < cut[0]) | ((position == cut[0]) & (tie <= cut[1]))


def hash_sample(df: DataFrame, n: int, seed, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` seeded random rows without replacement (all rows if fewer)."""
    marked = df.withColumn("_pos", hash_position("sample", seed, F.col(row_id)))
    cut = nth_position(marked, "_pos", row_id, n)
    if cut is None:
        return df
    return marked.filter(at_or_before(F.col("_pos"), F.col(row_id), cut)).drop("_pos")


@arrow_udf(T.LongType())
def _in_order(column: pa.Array) -> pa.Array:
    """Whole numbers in the order of doubles: the bits of a number, turned round below zero."""
    bits = (column.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> np.int64(63)) & np.int64((1 << 63) - 1)))


def running_totals(df: DataFrame, value: str, sums: list[str], leaf: int = 200_000, by: Sequence[str] = ()) -> DataFrame:
    """Add ``above_<s>``: the sum of ``s`` over rows with a larger ``value``, within the columns ``by``.

    ``df`` must hold one row per distinct ``value`` (and ``by``); NULL counts as the smallest. Groups of at most ``leaf`` rows are ranked by
    themselves. As long as there are larger ones, values are grouped by 16 further bits of a 64-bit number in the same order, and a
    group gets what is above it from the level before, where it is one of at most 65,536.
    """
    by = list(by)
    sizes = df.groupBy(*by).count() if by else df.agg(F.count("*").alias("count"))
    depth, largest = 0, sizes.agg(F.max("count")).first()[0] or 0
    if largest > leaf:
        missing = F.when(F.col(value).isNull(), F.lit(-(1 << 63))).when(F.isnan(value), F.lit((1 << 63) - 1))
        df_rows = df.withColumn("_at", F.coalesce(missing, _in_order(F.coalesce(F.col(value), F.lit(0.0)))))
        while largest > leaf and depth < 64 // LEVEL_BITS - 1:
            depth += 1
            largest = df_rows.groupBy(*by, _upper("_at", depth)).count().agg(F.max("count")).first()[0]
    upwards = lambda order, *keys: Window.partitionBy(*by, *keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    above = lambda s, over: F.coalesce(F.sum(s).over(over), F.lit(0))
    if not depth:
        return df.select("*", *(above(s, upwards(value)).alias(f"above_{s}") for s in sums))
    levels = [df_rows.withColumn("_level", _upper("_at", depth)).drop("_at")]
    for level in range(depth, 0, -1):
        totals = levels[0].groupBy(*by, "_level").agg(*(F.sum(s).alias(s) for s in sums))
        up = F.shiftright("_level", LEVEL_BITS) if level > 1 else F.lit(0).cast("long")
        levels.insert(0, totals.select(*by, up.alias("_level"), F.col("_level").alias("_own"), *sums))
    base = None
    for own in levels:
        order = "_own" if "_own" in own.columns else value
        ranked = own.withColumns({f"_above_{s}": above(s, upwards(order, "_level")) for s in sums})
        if base is not None:
            ranked = ranked.join(base, [*by, "_level"]).withColumns({f"_above_{s}": F.col(f"_above_{s}") + F.col(f"_base_{s}") for s in sums})
        if order == "_own":
            base = ranked.select(*by, F.col("_own").alias("_level"), *(F.col(f"_above_{s}").alias(f"_base_{s}") for s in sums))
    return ranked.select(*df.columns, *(F.col(f"_above_{s}").alias(f"above_{s}") for s in sums))


def _upper(column: str, levels: int) -> Column:
    return F.shiftright(column, 64 - LEVEL_BITS * levels)


def order_statistics(
    df: DataFrame, key: str, value: str, wanted: DataFrame, leaf: int = 1_000_000
) -> DataFrame:
    """Exact values at given ranks inside each group.

    ``wanted(key, slot, rank)`` asks for the value at 0-based ``rank`` of the group
    sorted ascending; one row per key and slot, so bounded by the number of groups. The
    interval holding each rank is narrowed with mergeable quantile sketches until it has
    at most ``leaf`` distinct values, and only then sorted.
    """
    spark = df.sparkSession
    distinct = df.groupBy(key, value).agg(F.count("*").alias("_w"))
    schema = f"{key} int, slot string, rank long, low double, high double"
    rows = [
        (r[key], r["slot"], r["rank"], None, None)
        for r in collect_dimension(wanted.select(key, "slot", "rank"))
    ]
    biggest = distinct.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    opened = F.broadcast(spark.createDataFrame(rows, schema))
    within = (F.col("low").isNull() | (F.col(value) > F.col("low"))) & (
        F.col("high").isNull() | (F.col(value) <= F.col("high"))
    )
    while biggest > leaf:
        inside = distinct.join(opened, key).filter(within)
        probs = F.lit([i / 64 for i in range(1, 64)])
        sketches = inside.groupBy(key, "slot", "rank", "low", "high").agg(
            F.percentile_approx(value, probs, 1000).alias("cuts")
        )
        pieces = (
            inside.join(F.broadcast(sketches.select(key, "slot", "cuts")), [key, "slot"])
            .withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col(value))))
            .groupBy(key, "slot", "rank", "low", "high", "cuts", "piece")
            .agg(F.sum("_w").alias("weight"), F.count("*").alias("values"))
        )
        over = Window.partitionBy(key, "slot").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        picked = collect_dimension(
            pieces.withColumn("before", F.coalesce(F.sum("weight").over(over), F.lit(0))).filter(
                (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("weight"))
            )
        )
        rows = []
        for r in picked:
            low = r["cuts"][r["piece"] - 1] if r["piece"] > 0 else r["low"]
            high = r["cuts"][r["piece"]] if r["piece"] < len(r["cuts"]) else r["high"]
            rows.append((r[key], r["slot"], r["rank"] - r["before"], low, high))
        shrunk = max(r["values"] for r in picked)
        opened = F.broadcast(spark.createDataFrame(rows, schema))
        if shrunk >= biggest:
            break
        biggest = shrunk
    over = (
        Window.partitionBy(key, "slot").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        distinct.join(opened, key)
        .filter(within)
        .withColumn("_upto", F.sum("_w").over(over))
        .filter(F.col("_upto") > F.col("rank"))
        .groupBy(key, "slot")
        .agg(F.min(value).alias(value))
    )


def grouped_percentiles(df: DataFrame, key: str, value: str, percents: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per group, one column per entry of ``percents``."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    slots = []
    for name, percent in percents.items():
        place = F.lit(percent / 100.0) * (F.col("_n") - 1)
        slots += [
            F.struct(F.lit(f"{name}_lo").alias("slot"), F.floor(place).alias("rank")),
            F.struct(F.lit(f"{name}_hi").alias("slot"), F.ceil(place).alias("rank")),
        ]
    wanted = counts.select(key, F.explode(F.array(*slots)).alias("s")).select(key, "s.slot", "s.rank")
    found = order_statistics(df, key, value, wanted)
    names = [f"{name}_{side}" for name in percents for side in ("lo", "hi")]
    wide = found.groupBy(key).pivot("slot", names).agg(F.first(value)).join(counts, key)
    out = []
    for name, percent in percents.items():
        place = F.lit(percent / 100.0) * (F.col("_n") - 1)
        share = place - F.floor(place)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * share).alias(name))
    return wide.select(key, *out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
