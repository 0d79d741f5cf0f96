"""Repeated deliveries of one key count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key: that of the latest ``order``, equal times broken by the greatest values.

    Rows with a null key are dropped, a null ``order`` sorts first.  The aggregate
    combines on the map side, so a key delivered very often does not gather its
    rows in one task.  The columns are those named (all where none are), so a
    caller that needs few columns shuffles few.
    """
    names = list(columns) or [c for c in df.columns if c != key]
    value = F.struct(*[F.col(c) for c in names])
    rank = F.struct(F.col(order).alias("_o"), F.xxhash64(*[F.col(c) for c in names]).alias("_h"))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, rank).alias("_v"))
    return kept.select(key, *[F.col("_v")[c].alias(c) for c in names])


def latest_value(df: DataFrame, key: str, order: str, value: Column, *columns: str) -> DataFrame:
    """(key, value): a value of the row that ``latest`` keeps of these columns, made before the shuffle, which has no wide columns then."""
    rank = F.struct(F.col(order).alias("_o"), F.xxhash64(*[F.col(c) for c in columns]).alias("_h"))
    named = df.where(F.col(key).isNotNull()).select(key, rank.alias("_r"), value.alias("_v"))
    return named.groupBy(key).agg(F.max_by("_v", "_r").alias("value"))


def latest_wide(df: DataFrame, key: str, order: str, keep: Column, *columns: str) -> DataFrame:
    """As ``latest``, then ``keep`` as a filter, for a filter that few wide rows pass.

    Only keys and times of all rows are shuffled for the latest delivery; wide
    values only of the rows that pass the filter.
    """
    named = df.where(F.col(key).isNotNull())
    last = named.groupBy(key).agg(F.max(order).alias("_last"))
    wide = latest(named.where(keep), key, order, *dict.fromkeys([*columns, order]))
    return wide.join(last, key).where(F.col(order).eqNullSafe(F.col("_last"))).select(key, *columns)


#: Rows of one or two short columns that may be broadcast.
BROADCAST_KEYS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The frame, broadcast where it has few rows, which are counted first; else left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def latest_sparse(df: DataFrame, key: str, order: str) -> DataFrame:
    """As ``latest`` with all columns, for tables where few keys are delivered more than once.

    Rows of other keys pass without a shuffle where the repeated keys are few
    enough to broadcast (their number is counted first); else both joins shuffle.
    """
    named = df.where(F.col(key).isNotNull())
    repeated = small(named.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    once = named.join(repeated, key, "left_anti")
    again = latest(named.join(repeated, key, "left_semi"), key, order)
    return once.unionByName(again.select(*once.columns))
