"""Scores for detections whose truth is known only in part: budgets, recall, thresholds and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesta.functions.numeric import finite
from cuesta.operators.fixpoint import settled
from cuesta.operators.order import placed
from cuesta.operators.regions import dilate

SUMMARY = (0.25, 0.5, 0.75, 0.9)


def _budget(share: float) -> float:
    if not 0 < share <= 1:
        raise ValueError("a budget lies in (0, 1]")
    return float(share)


def _ranked(response: DataFrame) -> DataFrame:
    """Finite cells with their rank within the grid, highest first, ties by row and column, and the grid's number of them."""
    cells = response.where(finite("z"))
    sizes = cells.groupBy("grid_id").agg(F.count("*").alias("n"))
    return placed(cells, "grid_id", [-F.col("z"), F.col("r"), F.col("c")], "rank").join(sizes, "grid_id")


def _wanted(budget: Column | float) -> Column:
    share = F.lit(float(budget)) if isinstance(budget, (int, float)) else budget
    return F.least(F.col("n"), F.greatest(F.lit(1), F.rint(share * F.col("n")).cast("long")))


def top_cells(response: DataFrame, budget: float) -> DataFrame:
    """(grid_id, r, c): exactly the budgeted share of the finite cells, highest first, ties by row and column."""
    return _ranked(response).where(F.col("rank") <= _wanted(_budget(budget))).select("grid_id", "r", "c")


def edge_mask(response: DataFrame, budget: float = 0.07) -> DataFrame:
    """(grid_id, r, c): cells at or above the value of the last budgeted one, so that all ties stay."""
    ranked = _ranked(response)
    last = ranked.where(F.col("rank") == _wanted(_budget(budget))).select("grid_id", F.col("z").alias("_least"))
    return ranked.join(last, "grid_id").where(F.col("z") >= F.col("_least")).select("grid_id", "r", "c")


def recall_curve(response: DataFrame, truth: DataFrame, budgets: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2), tolerance: float = 1) -> DataFrame:
    """(grid_id, budget, truth, hit, recall): the share of valid truth cells within the tolerance of a detection.

    A truth cell is hit from the best rank in its disk on, so one join serves all budgets.
    """
    ranked = _ranked(response)
    reach = dilate(ranked.select("grid_id", "r", "c", "rank"), tolerance, keep=["rank"])
    best = reach.groupBy("grid_id", "r", "c").agg(F.min("rank").alias("rank"))
    cells = truth.select("grid_id", "r", "c").distinct().join(ranked.select("grid_id", "r", "c", "n"), ["grid_id", "r", "c"])
    told = cells.join(best, ["grid_id", "r", "c"], "left").withColumn("budget", F.explode(F.array(*(F.lit(_budget(b)) for b in budgets))))
    hit = F.count_if(F.col("rank") <= _wanted(F.col("budget")))
    out = told.groupBy("grid_id", "budget").agg(F.count("*").alias("truth"), hit.alias("hit"))
    return out.withColumn("recall", F.col("hit") / F.col("truth"))


def _counts(scores: DataFrame) -> DataFrame:
    """(v, p, q): numbers of positives and negatives for each finite value."""
    values = scores.where(finite("v"))
    return values.groupBy("v").agg(F.count_if(F.col("pos") == 1).alias("p"), F.count_if(F.col("pos") == 0).alias("q"))


def _cumulated(counts: DataFrame) -> DataFrame:
    """(_part, v, p, q, below_p, below_q, above): sums up to and including v, and the next higher value.

    The values are range-partitioned, so that no task holds all of them, and written once with
    their partition: each use of an unwritten range partition would draw its own bounds.
    """
    parts = settled(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part").orderBy("v")
    totals = parts.groupBy("_part").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.min("v").alias("head"))
    walk = Window.orderBy("_part")  # one row a partition
    offsets = totals.select(
        "_part",
        *(F.coalesce(F.sum(f"t{c}").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}0") for c in "pq"),
        F.lead("head").over(walk).alias("next"),
    )
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select("*", F.sum("p").over(run).alias("rp"), F.sum("q").over(run).alias("rq"), F.lead("v").over(order).alias("after")).join(offsets, "_part")
    return out.select("v", "p", "q", (F.col("rp") + F.col("p0")).alias("below_p"), (F.col("rq") + F.col("q0")).alias("below_q"), F.coalesce("after", "next").alias("above"))


def auc(scores: DataFrame) -> DataFrame:
    """One row (positives, negatives, auc) of scores(pos, v): how often a positive is no lower than a negative; ties count fully.

    auc is NULL if a class is empty.
    """
    c = _cumulated(_counts(scores))
    out = c.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"), F.sum(F.col("p") * F.col("below_q")).alias("won"))
    both = F.col("positives").cast("double") * F.col("negatives")
    return out.select("positives", "negatives", (F.col("won") / F.when(both > 0, both)).alias("auc"))


def youden(scores: DataFrame) -> DataFrame:
    """One row (threshold, j, tpr, fpr): the lowest cut between neighbouring values with the largest TPR - FPR; NaN if a class is empty."""
    c = settled(_cumulated(_counts(scores)))
    sizes = c.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("np"), F.coalesce(F.sum("q"), F.lit(0)).alias("nq"))
    cuts = c.join(F.broadcast(sizes))
    single = F.col("below_p") + F.col("below_q") == F.col("p") + F.col("q")
    alone = F.col("above").isNull()
    cuts = cuts.where(~alone | single)
    # a lone value is its own cut, and everything reaches it
    cut = F.when(alone, F.col("v")).otherwise((F.col("v") + F.col("above")) / 2)
    tpr = F.when(alone & (F.col("np") > 0), F.lit(1.0)).otherwise((F.col("np") - F.col("below_p")) / F.when(F.col("np") > 0, F.col("np")))
    fpr = F.when(alone & (F.col("nq") > 0), F.lit(1.0)).otherwise((F.col("nq") - F.col("below_q")) / F.when(F.col("nq") > 0, F.col("nq")))
    best = cuts.select(cut.alias("threshold"), (tpr - fpr).alias("j"), tpr.alias("tpr"), fpr.alias("fpr")).where("j is not null").orderBy(F.desc("j"), "threshold").limit(1)
    names = ["threshold", "j", "tpr", "fpr"]
    none = sizes.where("np = 0 OR nq = 0").select(*(F.lit(float("nan")).alias(n) for n in names))
    return best.union(none)


def summary(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, p25, p50, p75, p90) of the finite values."""
    p = F.percentile(value, F.array(*(F.lit(q) for q in SUMMARY)))
    out = values.where(finite(value)).groupBy(*keys).agg(F.count("*").alias("n"), p.alias("_p"))
    return out.select(*keys, "n", *(F.col("_p")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(SUMMARY)))


def gate_sweep(fits: DataFrame, value: str = "map_conditioning", thresholds: Sequence[float] = (0.0, 1e-4, 1e-3, 1e-2), vertical: float = 80.0) -> DataFrame:
    """(threshold, kept, vertical_share, median_dip): each fit goes to all thresholds that it reaches."""
    reached = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(value) >= t)
    out = fits.withColumn("threshold", F.explode(reached)).groupBy("threshold")
    return out.agg(F.count("*").alias("kept"), F.avg((F.col("dip") >= vertical).cast("double")).alias("vertical_share"), F.median("dip").alias("median_dip"))
