"""Grouped work that stays balanced when one key holds a large share of the rows.

Groups are pre-aggregated and joined back with the hot keys salted; global orders are cut into
ranges whose offsets are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import hot_rows, save_rows, shuffle_partitions

# A hot key holds at least this share of all rows, so the broadcast list of hot keys has at most as many entries as the share allows.
HOT_SHARE = 1 / 100_000
# Rows of one range; the sort inside a range spills, so this bounds the number of ranges, not memory.
RANGE_ROWS = 2_000_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str],
                how: str = "left", rows_in: str | None = None) -> DataFrame:
    """Join rows to a table with one row per key, salting the keys that are hot in ``rows``.

    Keys must not be null. ``spread`` identifies a row, so that salts survive task retries.
    ``rows_in`` names a column of ``groups`` that already counts the rows of each key, which
    saves counting them here. A key gets one salt for every ``hot_rows`` of its rows, and every
    key above that is salted; on very large tables the bound is ``HOT_SHARE`` of the rows.
    """
    limit = hot_rows(rows.sparkSession)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if rows_in is None else groups.select(*keys, F.col(rows_in).alias("_n"))
    # The bound is a value of the same plan, not a job of its own.
    bound = F.greatest(F.lit(limit).cast("double"), F.coalesce(counted.agg(F.sum("_n")).scalar(), F.lit(0)) * F.lit(HOT_SHARE))
    hot = counted.where(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).alias("_salts"))
    salted = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0).cast("long"))).drop("_salts"))
    copies = (groups.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition by ``order``. The rows are saved first: counting them, sampling the bounds
    and moving them would otherwise compute the input three times."""
    df = save_rows(df)
    return df.repartitionByRange(max(shuffle_partitions(df.sparkSession), df.count() // RANGE_ROWS + 1), *order)


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition by ``order`` and keep the range number in ``_chunk``.

    Saved again, the range numbers cannot change between the uses of the result, whatever tasks are retried.
    """
    return save_rows(_ranged(df, order).withColumn("_chunk", F.spark_partition_id()))


def positions(df: DataFrame, order: list[str], name: str = "pos", start: int = 1) -> DataFrame:
    """Number all rows in a total order without passing them through one task."""
    # Sorted where they lie, the rows get their range in the upper and their place in the lower bits of one number, before they
    # are saved: no second shuffle brings the ranges together.
    df = save_rows(_ranged(df, order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    df = df.withColumn("_chunk", F.shiftright("_id", 33)).withColumn("_rank", F.col("_id").bitwiseAND((1 << 33) - 1))
    # One row per range, so the running total is over a few thousand rows at most.
    sizes = df.groupBy("_chunk").count()
    offsets = sizes.select("_chunk", (F.sum("count").over(Window.orderBy("_chunk")) - F.col("count")).alias("_offset"))
    return (df.join(F.broadcast(offsets), "_chunk")
            .withColumn(name, F.col("_offset") + F.col("_rank") + start)
            .drop("_id", "_chunk", "_offset", "_rank"))
