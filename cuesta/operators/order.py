"""Exact order statistics of groups of any size.

Rows are range-partitioned by group and value and written once with their
partition; a running count within a partition, and the number of rows of the
group in the partitions before it, give the place.  No task holds a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesta.operators.fixpoint import settled


def placed(rows: DataFrame, group: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, among the rows of their group in ascending order; rows that tie are in any order.

    rows needs columns _o0, _o1, ... free.
    """
    keys = rows.select("*", *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    by = [F.col(f"_o{i}") for i in range(len(order))]
    dealt = settled(keys.repartitionByRange(F.col(group), *by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(group, "_part", before.alias("_before"))
    run = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*by))
    return dealt.withColumn("_run", run).join(F.broadcast(firsts), [group, "_part"]).withColumn(name, F.col("_run") + F.col("_before")).drop("_part", "_run", "_before", *(f"_o{i}" for i in range(len(order))))


def quantiles(rows: DataFrame, shares: Mapping[str, float], group: str = "grid_id", value: str = "v") -> DataFrame:
    """(group, a column for each share): quantiles of the values that are not NULL, between neighbours by linear interpolation.

    Equal values are one row with their count, so a value that most rows share is no burden.  A group without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = settled(counts.repartitionByRange(group, "_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(group, "_part").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(group)
    offsets = parts.select(group, "_part", F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_all"))
    run = F.sum("_n").over(Window.partitionBy(group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = dealt.withColumn("_end", run).join(F.broadcast(offsets), [group, "_part"]).withColumn("_end", F.col("_end") + F.col("_before"))
    picks = []
    for i, share in enumerate(shares.values()):
        at = F.lit(float(share)) * (F.col("_all") - 1)
        for k, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_end") > place) & (F.col("_end") - F.col("_n") <= place)
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{k}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
    out = ends.groupBy(group).agg(*picks)
    return out.select(group, *((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(n) for i, n in enumerate(shares)))
