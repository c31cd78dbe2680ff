"""Ranks and running sums in order within groups of any size: a hot group is spread over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import parts, written

_ROW = (1 << 33) - 1


def ranked(df: DataFrame, group: list[str], order: list[str], sums: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """`df` with `rank` (from 1) in `order` within `group`, nulls first, and the running sums of `sums` in its place.

    `df` should be written, since the range partitioning samples it. `order` should tell rows apart: rows that are equal
    in it fall to one partition, in any order. Only one row for each group and partition is put in order at once."""
    n = partitions or parts(df)
    sorted_ = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    d = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    d = d.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    if sums:
        running = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = written(d.withColumns({f"_run_{c}": F.sum(c).over(running) for c in sums}), "running")
    runs = d.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", *(F.col(g).alias(f"_of_{g}") for g in group), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))
    runs = written(runs, "runs")
    on = d["_part"] == runs["_part"]
    for g in group:
        on = on & d[g].eqNullSafe(runs[f"_of_{g}"])
    kept = [d[c] for c in df.columns if c not in sums]
    total = [(F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(c) for c in sums]
    return d.join(runs, on).select(*kept, *total, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("rank"))
