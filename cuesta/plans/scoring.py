"""Detection scores over the derived grid, scores and attitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.operators import polyline, scoring
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables

BUDGETS = (0.01, 0.02, 0.05, 0.1, 0.2)
_RANKED = "f AS (SELECT r, c, z FROM fx_dem WHERE isfinite(z)), k AS (SELECT *, row_number() OVER (ORDER BY z DESC, r, c) AS rn, rank() OVER (ORDER BY z DESC) AS rk, count(*) OVER () AS n FROM f)"


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_dem"]


def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_cells(_dem(spark, sf_dir), 0.05).select("r", "c")


TOP = f"WITH {_RANKED} SELECT r, c FROM k WHERE rn <= greatest(1, round_even(0.05*n, 0))"


def edge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.edge_mask(_dem(spark, sf_dir)).select("r", "c")


EDGES = f"WITH {_RANKED} SELECT r, c FROM k WHERE rk <= greatest(1, round_even(0.07*n, 0))"


def _truth(dem: DataFrame) -> DataFrame:
    return dem.where("(r * 5 + c) % 11 = 0")


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(scoring.recall_curve(dem, _truth(dem), BUDGETS).drop("grid_id"))


RECALL = f"""WITH {_RANKED}, b(budget) AS (VALUES {", ".join(f"({b}::DOUBLE)" for b in BUDGETS)}), t AS (SELECT k.r, k.c, min(q.rn) AS rn, any_value(k.n) AS n FROM k JOIN k q ON abs(k.r-q.r) + abs(k.c-q.c) <= 1 WHERE (k.r*5+k.c) % 11 = 0 GROUP BY k.r, k.c)
 SELECT budget, count(*) AS truth, count(*) FILTER (rn <= greatest(1, round_even(budget*n, 0))) AS hit, {r('count(*) FILTER (rn <= greatest(1, round_even(budget*n, 0)))/count(*)', 'recall')} FROM t, b GROUP BY budget"""


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scoring.auc(tables(spark, sf_dir)["fx_score"]))


AUC = f"WITH p AS (SELECT v FROM fx_score WHERE pos = 1), q AS (SELECT v FROM fx_score WHERE pos = 0) SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM q) AS negatives, {r('(SELECT count(*) FROM p JOIN q ON q.v <= p.v)/((SELECT count(*) FROM p)*(SELECT count(*) FROM q))', 'auc')}"


def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scoring.youden(tables(spark, sf_dir)["fx_score"]))


YOUDEN = f"""WITH u AS (SELECT v, sum(pos) AS p, count(*) - sum(pos) AS q FROM fx_score GROUP BY v), k AS (SELECT v, lead(v) OVER w AS nv, sum(p) OVER w AS p, sum(q) OVER w AS q, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM u WINDOW w AS (ORDER BY v)),
 j AS (SELECT (v+nv)/2 AS t, (np-p)/np AS tpr, (np-p)/np-(nq-q)/nq AS j, (nq-q)/nq AS fpr FROM k WHERE nv IS NOT NULL) SELECT {r('t', 'threshold')}, {r('j', 'j')}, {r('tpr', 'tpr')}, {r('fpr', 'fpr')} FROM j ORDER BY j.j DESC, t LIMIT 1"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scoring.summary(tables(spark, sf_dir)["fx_att"], "dip", "region"))


SUMMARIES = "SELECT region, count(*) AS n, " + ", ".join(r(f"quantile_cont(dip, {q})", f"p{int(q * 100)}") for q in scoring.SUMMARY) + " FROM fx_att GROUP BY region"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = tables(spark, sf_dir)["fx_att"].select("dip", (F.col("strike") / 20000).alias("map_conditioning"))
    return comparable(scoring.gate_sweep(fits))


GATES = f"WITH t(threshold) AS (VALUES (0.0::DOUBLE), (0.0001), (0.001), (0.01)) SELECT threshold, count(*) AS kept, {r('avg(CAST(dip >= 80 AS INTEGER))', 'vertical_share')}, {r('quantile_cont(dip, 0.5)', 'median_dip')} FROM fx_att JOIN t ON strike/20000 >= threshold GROUP BY threshold"


def burned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables(spark, sf_dir)["fx_vert"].select("trace_id", "seq", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    return polyline.burn(v, 48, 48)


BURNED = """WITH s AS (SELECT trace_id, seq, x/10 AS x, y/10 AS y, lead(x/10) OVER w AS x2, lead(y/10) OVER w AS y2 FROM fx_vert WINDOW w AS (PARTITION BY trace_id ORDER BY seq)), n AS (SELECT *, greatest(1, CAST(ceil(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))) AS INTEGER)) AS n FROM s WHERE x2 IS NOT NULL)
 SELECT DISTINCT CAST(round_even(y+(y2-y)*(k/n), 0) AS INTEGER) AS r, CAST(round_even(x+(x2-x)*(k/n), 0) AS INTEGER) AS c FROM n, range(0, 100) g(k) WHERE k <= n AND (k > 0 OR seq = 1) AND round_even(y+(y2-y)*(k/n), 0) BETWEEN 0 AND 47 AND round_even(x+(x2-x)*(k/n), 0) BETWEEN 0 AND 47"""

QUERIES = {
    "q2_top_cells": (top_cells, TOP),
    "q4_recall": (recall, RECALL),
    "q8_gates": (gates, GATES),
    "q13_auc": (auc, AUC),
    "q14_youden": (youden, YOUDEN),
    "q16_summaries": (summaries, SUMMARIES),
    "l7_edge_mask": (edge_mask, EDGES),
    "a11_burned": (burned, BURNED),
}
