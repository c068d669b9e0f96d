"""Ordered work inside groups of any size: a group is one segment, or as many ranges of its order as its rows need.

What a step has to know from outside a segment is one edge row for each segment, combined along the group; what it has to know
of the whole group is a partial aggregate. Both are joined back by (group, segment), so no task ever holds a whole large group,
and groups that fit are not moved for the sake of those that don't.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.skew import RANGE_ROWS, join_groups
from foliant.session import hot_rows, save, shuffle_partitions

SEGMENT = "_seg"


@dataclass(frozen=True)
class Segments:
    """``rows`` with their segment in ``_seg``; ``cut`` tells whether any group has more than one."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    cut: bool

    @property
    def keys(self) -> list[str]:
        return [self.key, SEGMENT] if self.cut else [self.key]

    def having(self, rows: DataFrame) -> "Segments":
        return replace(self, rows=rows)

    def saved(self) -> "Segments":
        return self.having(save(self.rows))

    def attach(self, table: DataFrame) -> "Segments":
        """Add the columns of ``table``, which has at most one row for each group."""
        if self.cut:
            table = self.rows.select(*self.keys).distinct().join(table, self.key)
        return self.having(self.rows.join(table, self.keys, "left"))

    def nearest(self, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> "Segments":
        """Add the nearest value that is not null strictly before, or after, each row of its group."""
        before, after = before or {}, after or {}
        rows = self.rows.select("*", *[c.alias(f"_v_{n}") for n, c in {**before, **after}.items()])
        # Looking ahead is looking back in the reverse order: a frame that ends at the last row would be read anew for each row.
        forward = Window.partitionBy(*self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        backward = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, -1)
        local = rows.select("*", *[F.last(f"_v_{n}", True).over(w).alias(n) for part, w in ((before, forward), (after, backward)) for n in part])
        if self.cut:
            place = F.struct(*self.order)

            def known(n: str) -> Column:
                return F.when(F.col(f"_v_{n}").isNotNull(), place)

            edges = rows.where(F.col(SEGMENT) > 0).groupBy(*self.keys).agg(
                *[F.max_by(f"_v_{n}", known(n)).alias(f"_e_{n}") for n in before], *[F.min_by(f"_v_{n}", known(n)).alias(f"_e_{n}") for n in after])
            along, against = (Window.partitionBy(self.key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(SEGMENT), F.desc(SEGMENT)))
            edges = edges.select(*self.keys, *[F.last(f"_e_{n}", True).over(w).alias(f"_o_{n}") for part, w in ((before, along), (after, against)) for n in part])
            local = local.join(edges, self.keys, "left").withColumns({n: F.coalesce(n, f"_o_{n}") for n in (*before, *after)}).drop(*[f"_o_{n}" for n in (*before, *after)])
        return self.having(local.drop(*[f"_v_{n}" for n in (*before, *after)]))


def segmented(rows: DataFrame, key: str, order: list[str]) -> Segments:
    """Cut ``rows`` into segments of about ``foliant.hotRows`` rows or fewer; the rows should be narrow, as they are saved."""
    limit = hot_rows(rows.sparkSession)
    rows = save(rows.repartition(key))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    total = sizes.agg(F.sum("_n")).first()[0]
    whole = rows.withColumn(SEGMENT, F.lit(0))
    if not total:
        return Segments(whole, key, tuple(order), False)
    sizes = save(sizes)
    large = join_groups(rows, sizes, [key], order, how="inner", rows_in="_n").drop("_n")
    # A range of the order takes one task, and as many segments as it needs: their number is no number of tasks.
    pieces = int(-(-total // limit)) + 1
    tasks = min(pieces, max(shuffle_partitions(rows.sparkSession), int(total // RANGE_ROWS) + 1))
    ranges = save(large).repartitionByRange(tasks, key, *order).withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) - 1
    ranges = ranges.withColumn(SEGMENT, (F.col("_range") * pieces + F.floor(place / limit) + 1).cast("int")).drop("_range")
    small = whole.join(sizes.select(key), key, "left_anti")
    return Segments(save(small.select(*ranges.columns).unionByName(ranges).repartition(key, SEGMENT)), key, tuple(order), True)
