"""Edges, lines, drainage flags, tracing, the detector and its evaluation over the derived grid and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions.numeric import finite
from cuesta.operators import attitude, detection, directional, edges, evaluation, hydrology, kernels, normalise, regions, stencils, tracing
from cuesta.operators.fixpoint import settled
from cuesta.plans import oracles
from cuesta.plans.attitudes import GT
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables
from cuesta.plans.rasters import HEIGHT, MASK, TILE, WIDTH, _mask
from cuesta.plans.scoring import BUDGETS

KEYS = ["grid_id", "r", "c"]


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_dem"]


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_flag"]


# Edges


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horn gradients at unit pixels, thinned along themselves."""
    p = stencils.nine(_dem(spark, sf_dir))
    fx, fy = stencils.gradients(1.0)
    size = F.hypot(fx, fy)
    g = settled(p.select(*KEYS, F.when(finite(size), size).otherwise(0.0).alias("magnitude"), fx.alias("gx"), (-fy).alias("gy")))
    return comparable(edges.suppressed(g).select("r", "c", "nms"))


def held_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hysteresis of the masked cells' heights between 230 and 260."""
    dem = _dem(spark, sf_dir)
    cells = dem.join(_mask(dem), KEYS, "left_semi").withColumnRenamed("z", "nms")
    return edges.hysteresis(cells, F.lit(230.0), F.lit(260.0)).select("r", "c")


HELD = """WITH RECURSIVE n AS (SELECT r*48+c AS v, r, c, z FROM fx_dem WHERE isfinite(z) AND (CAST(z*4 AS BIGINT)*7 + r*3 + c) % 5 = 0 AND z >= 230),
 w(v) AS (SELECT v FROM n WHERE z >= 260 UNION SELECT b.v FROM w JOIN n a ON a.v = w.v JOIN n b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1)
 SELECT CAST(v//48 AS INTEGER) AS r, CAST(v%48 AS INTEGER) AS c FROM w"""


def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.canny(_dem(spark, sf_dir), size=TILE).select("r", "c")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kernels.structure_tensor(_dem(spark, sf_dir), ["z"], size=TILE)
    return comparable(t.select("r", "c", *(edges.tensor_response(t, k).alias(k) for k in ("anisotropy", "coherence", "lambda1"))))


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of heights and a second band, the first weighted double."""
    p = _dem(spark, sf_dir).withColumn("other", F.expr("cast((r * 7 + c * 3) % 50 as double)"))
    return comparable(edges.linear_response(p, ["z", "other"], weights=[2.0, 1.0]).select("r", "c", "response"))


def classical(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = stencils.terrain_stack(_dem(spark, sf_dir), 10.0, ["curvature", "slope"])
    return comparable(edges.detected("classical", stack, ["curvature", "slope"]).drop("grid_id"))


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dem(spark, sf_dir).select(*KEYS, F.col("z").alias("red"), F.expr("cast((r * 7 + c * 3) % 50 as double)").alias("green"), F.expr("cast(r + c as double)").alias("blue"))
    return edges.composite(p).select("r", "c", *(F.col(b).cast("int").alias(b) for b in ("red", "green", "blue")))


_BYTE = "CASE WHEN isfinite({b}) THEN CAST(floor(least(greatest(({b}-l{k})/(h{k}-l{k}), 0), 1)*255 + 1e-9) AS INTEGER) ELSE 0 END AS {b}"
COMPOSITE = "WITH p AS (SELECT r, c, z AS red, CAST((r*7+c*3)%50 AS DOUBLE) AS green, CAST(r+c AS DOUBLE) AS blue FROM fx_dem), q AS (SELECT " + ", ".join(f"quantile_cont({b}, {x}) FILTER (isfinite({b})) AS {n}{k}" for k, b in enumerate(("red", "green", "blue")) for n, x in (("l", 0.02), ("h", 0.98))) + " FROM p) SELECT r, c, " + ", ".join(_BYTE.format(b=b, k=k) for k, b in enumerate(("red", "green", "blue"))) + " FROM p, q"

# Lines


def skeleton_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracing.trace_skeleton(regions.thin(_mask(_dem(spark, sf_dir))), overlap=False).drop("grid_id")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.polylines_from_mask(_mask(_dem(spark, sf_dir)), 3, 0.5, GT).drop("grid_id"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.extract_polylines(_dem(spark, sf_dir), 0.2).drop("grid_id"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polylines of the top cells, rejoined."""
    return comparable(tracing.link_polylines(tracing.extract_polylines(_dem(spark, sf_dir), 0.3, 3).drop("grid_id"), 6.0, 40.0))


# Drainage


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(hydrology.flow_network(_dem(spark, sf_dir), downsample=3).select("r", "c", "accumulation", "azimuth"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(hydrology.channel_network(_dem(spark, sf_dir), 20).select("r", "c", "accumulation", "azimuth"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = hydrology.flow_accumulation(hydrology.flow_directions(_dem(spark, sf_dir)))
    return comparable(hydrology.density_threshold(net).drop("grid_id"))


def _pixel_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_vert"].select("trace_id", "seq", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces against masked cells as channels that flow east."""
    dem = _dem(spark, sf_dir)
    mask = _mask(dem).withColumn("azimuth", F.lit(90.0))
    near = settled(hydrology.channel_proximity(dem, mask, 1))
    return comparable(hydrology.drainage_fractions(_pixel_traces(spark, sf_dir), near, HEIGHT, WIDTH))


FRACTIONS = f"""WITH {MASK}, near AS (SELECT DISTINCT d.r, d.c FROM fx_dem d JOIN m ON abs(d.r-m.r) + abs(d.c-m.c) <= 1),
 s AS (SELECT trace_id, seq, x/10 AS x, y/10 AS y, lead(x/10) OVER w AS x2, lead(y/10) OVER w AS y2 FROM fx_vert WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
 n AS (SELECT *, greatest(1, CAST(ceil(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))) AS INTEGER)) AS n FROM s WHERE x2 IS NOT NULL),
 d AS (SELECT trace_id, seq, k, x+(x2-x)*(k/n) AS x, y+(y2-y)*(k/n) AS y FROM n, range(0, 100) g(k) WHERE k <= n AND (k > 0 OR seq = 1)),
 t AS (SELECT *, coalesce(lead(x) OVER v, x) - coalesce(lag(x) OVER v, x) AS dx, coalesce(lead(y) OVER v, y) - coalesce(lag(y) OVER v, y) AS dy FROM d WINDOW v AS (PARTITION BY trace_id ORDER BY seq, k)),
 a AS (SELECT t.trace_id, near.r IS NOT NULL AS on_it, abs((((degrees(atan2(dx, -dy)) - 90 + 90) % 180) + 180) % 180 - 90) < 30 AS along FROM t LEFT JOIN near ON near.r = least(greatest(CAST(round_even(y, 0) AS INTEGER), 0), 47) AND near.c = least(greatest(CAST(round_even(x, 0) AS INTEGER), 0), 47))
 SELECT trace_id, {r('avg(CAST(on_it AS INTEGER))', 'overlap')}, {r('avg(CAST(on_it AND along AS INTEGER))', 'aligned')} FROM a GROUP BY trace_id"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(hydrology.flag_drainage(_pixel_traces(spark, sf_dir), _dem(spark, sf_dir), HEIGHT, WIDTH))


# Costs and paths


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dem(spark, sf_dir).withColumn("det", F.expr("cast((r * 7 + c * 3) % 50 as double)")).withColumn("drain", F.expr("cast((r + c) % 13 as double) / 10"))
    return tracing.cost_surface(p, "z", finite("z"), detector="det", drainage="drain", w_det=0.5, w_drain=2.0)


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_cost(spark, sf_dir).select("r", "c", "cost"))


COST = f"""WITH p AS (SELECT r, c, isfinite(z) AS ok, CASE WHEN isfinite(z) THEN z ELSE 0 END AS z, CAST((r*7+c*3)%50 AS DOUBLE) AS det, CAST((r+c)%13 AS DOUBLE)/10 AS drain FROM fx_dem),
 q AS (SELECT quantile_cont(z, 0.02) AS l1, quantile_cont(z, 0.98) AS h1, quantile_cont(det, 0.02) AS l2, quantile_cont(det, 0.98) AS h2 FROM p WHERE ok)
 SELECT r, c, {r('CASE WHEN ok THEN 0.1 + (1 - least(greatest((z-l1)/greatest(h1-l1, 1e-6), 0), 1)) + 0.5*(1 - least(greatest((det-l2)/greatest(h2-l2, 1e-6), 0), 1)) + 2*least(drain, 1) ELSE 1000.1 END', 'cost')} FROM p, q"""


def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.contact_strength(_dem(spark, sf_dir), 10.0).drop("grid_id"))


def trace_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    penalty = hydrology.drainage_penalty(dem, settled(hydrology.channel_network(dem, 15, 3)))
    return comparable(tracing.trace_cost(dem, 10.0, drainage=penalty).drop("grid_id"))


def incoherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.orientation_incoherence(_dem(spark, sf_dir), ["z"]).select("r", "c", "incoherence"))


_EDGE = "f AS (SELECT r, c, z FROM fx_dem WHERE isfinite(z)), k AS (SELECT *, rank() OVER (ORDER BY z DESC) AS rk, count(*) OVER () AS n FROM f), e AS (SELECT r, c FROM k WHERE rk <= greatest(1, round_even(0.07*n, 0)))"
_FIELD = f"{_EDGE}, j AS (SELECT d.r, d.c, min({{'d': (d.r-e.r)*(d.r-e.r)+(d.c-e.c)*(d.c-e.c), 'r': e.r, 'c': e.c}}) AS b FROM fx_dem d, e GROUP BY d.r, d.c)"


def snap_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.snap_field(_dem(spark, sf_dir)).drop("grid_id"))


SNAP_FIELD = f"WITH {_FIELD} SELECT r, c, {r('sqrt(b.d)', 'distance')}, b.r AS near_r, b.c AS near_c FROM j"


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = tables(spark, sf_dir)["fx_att"].select("id", F.lit("g0").alias("grid_id"), (F.expr("(id * 7) % 480") / 10).alias("r"), (F.expr("(id * 3) % 480") / 10).alias("c"))
    return tracing.snapped(clicks, tracing.snap_field(_dem(spark, sf_dir)), 5.0).select("id", "snap_r", "snap_c")


SNAPPED = f"WITH {_FIELD} SELECT a.id, CASE WHEN sqrt(b.d) <= 5 THEN b.r END AS snap_r, CASE WHEN sqrt(b.d) <= 5 THEN b.c END AS snap_c FROM fx_att a LEFT JOIN j ON j.r = CAST(round_even(((a.id*7)%480)/10.0, 0) AS INTEGER) AND j.c = CAST(round_even(((a.id*3)%480)/10.0, 0) AS INTEGER)"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(tracing.graph(_dem(spark, sf_dir).where(finite("z")), "z").drop("grid_id"))


GRAPH = f"SELECT a.r, a.c, b.r AS to_r, b.c AS to_c, {r('(a.z+b.z)/2*(CASE WHEN a.r<>b.r AND a.c<>b.c THEN sqrt(2) ELSE 1 END)', 'weight')} FROM fx_dem a JOIN fx_dem b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) WHERE isfinite(a.z) AND isfinite(b.z)"


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracing.least_cost_path(_cost(spark, sf_dir), (5, 5), (40, 42), 8).drop("grid_id")


def windowed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost within two cells of (24, 24): few enough paths to list in SQL."""
    return comparable(kernels.cost_to_all(settled(_cost(spark, sf_dir)), (24, 24), margin=2, size=TILE).select("r", "c", "distance"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as the clicks of a session."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = "CASE WHEN o_orderkey % 11 = 0 THEN 'cancel' WHEN o_orderkey % 5 = 0 THEN 'finish' WHEN o_orderkey % 3 = 0 THEN 'free' ELSE 'click' END"
    log = orders.selectExpr("o_custkey AS session", "o_orderkey AS seq", f"{kind} AS kind", "cast((o_orderkey * 7) % 48 AS int) AS r", "cast((o_orderkey * 13) % 48 AS int) AS c")
    return tracing.session_legs(log)


REPLAYED = """WITH e0 AS (SELECT o_custkey AS session, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'cancel' WHEN o_orderkey % 5 = 0 THEN 'finish' WHEN o_orderkey % 3 = 0 THEN 'free' ELSE 'click' END AS kind, CAST((o_orderkey*7)%48 AS INTEGER) AS r, CAST((o_orderkey*13)%48 AS INTEGER) AS c FROM orders),
 e1 AS (SELECT *, coalesce(sum(CAST(kind IN ('finish', 'cancel') AS INTEGER)) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shape FROM e0),
 e2 AS (SELECT *, max(CAST(kind = 'finish' AS INTEGER)) OVER (PARTITION BY session, shape) AS done FROM e1),
 e3 AS (SELECT session, shape, kind, lag(r) OVER w AS r1, lag(c) OVER w AS c1, r AS r2, c AS c2, row_number() OVER w - 1 AS leg FROM e2 WHERE done = 1 AND kind NOT IN ('finish', 'cancel') WINDOW w AS (PARTITION BY session, shape ORDER BY seq))
 SELECT session, shape, leg, kind, r1, c1, r2, c2 FROM e3 WHERE leg > 0"""


def wired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the legs of three clicks a session, sessions being trace ids, over the cost surface."""
    t = tables(spark, sf_dir)["fx_vert"].where("seq <= 3").selectExpr("trace_id AS session", "seq", "'click' AS kind", "cast(floor(y / 10) AS int) AS r", "cast(floor(x / 10) AS int) AS c")
    ends = t.groupBy("session").agg((F.max("seq") + 1).alias("seq")).selectExpr("session", "seq", "'finish' AS kind", "0 AS r", "0 AS c")
    return tracing.replayed(t.union(ends), settled(_cost(spark, sf_dir)), 3)


# The detector


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = detection.detect_traces(_dem(spark, sf_dir), GT, HEIGHT, WIDTH, res=10.0, min_points=5)
    return comparable(found)


def detected_attitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fits = detection.detect_attitudes(_dem(spark, sf_dir), GT, HEIGHT, WIDTH, res=10.0, min_points=5)
    return comparable(fits, 4)


# Evaluation


def _truth(dem: DataFrame) -> DataFrame:
    return dem.where("(r * 5 + c) % 11 = 0")


def budget_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.linearity_at_budget(_dem(spark, sf_dir), 0.05))


BUDGET_LINEARITY = f"""WITH RECURSIVE f AS (SELECT r, c, row_number() OVER (ORDER BY z DESC, r, c) AS rn, count(*) OVER () AS n FROM fx_dem WHERE isfinite(z)), n AS (SELECT r*48+c AS v, r, c FROM f WHERE rn <= greatest(1, round_even(0.05*n, 0))),
 w(v, u) AS (SELECT v, v FROM n UNION SELECT w.v, b.v FROM w JOIN n a ON a.v = w.u JOIN n b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1),
 l AS (SELECT v, v//48 AS r, v%48 AS c, min(u) AS label FROM w GROUP BY v), k AS (SELECT label, count(*) AS n, var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS x FROM l GROUP BY label),
 e AS (SELECT n, CASE WHEN n >= 5 AND a+b > 0 THEN sqrt((a-b)*(a-b)+4*x*x)/(a+b) ELSE 0 END AS e FROM k)
 SELECT 'g0' AS grid_id, count(*) AS n_components, {r('avg(n)', 'mean_size')}, max(n) AS largest_size, {r('sum(e*n)/sum(n)', 'linearity')} FROM e"""


def mask_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(evaluation.mask_recall(_mask(dem), _truth(dem), dem.where(finite("z"))).drop("grid_id"))


MASK_RECALL = f"""WITH {MASK}, v AS (SELECT r, c FROM fx_dem WHERE isfinite(z)), t AS (SELECT v.r, v.c, EXISTS (SELECT 1 FROM m WHERE abs(m.r-v.r) + abs(m.c-v.c) <= 1) AS hit FROM v WHERE (v.r*5+v.c) % 11 = 0)
 SELECT count(*) AS truth, count(*) FILTER (hit) AS hit, {r('count(*) FILTER (hit)/greatest(count(*), 1)', 'recall')}, (SELECT count(*) FROM m) AS edges, {r('(SELECT count(*) FROM m)/(SELECT count(*) FROM v)', 'budget')} FROM t"""


def _responses(dem: DataFrame) -> dict[str, DataFrame]:
    return {"height": dem, "depth": dem.withColumn("z", -F.col("z")), "stripes": dem.withColumn("z", F.when(finite("z"), F.expr("cast((r * 7 + c * 3) % 50 as double)")).otherwise(F.col("z")))}


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(evaluation.leaderboard(_responses(dem), _truth(dem)))


def _recalls(n: int, name: str, value: str) -> str:
    hits = ", ".join(f"count(*) FILTER (rn <= greatest(1, round_even({b}*n, 0)))/count(*) AS recall_at_{round(b * 100)}pct" for b in BUDGETS)
    return f"(WITH k AS (SELECT r, c, row_number() OVER (ORDER BY {value} DESC, r, c) AS rn, count(*) OVER () AS n FROM fx_dem WHERE isfinite(z)), t AS (SELECT k.r, k.c, min(q.rn) AS rn, any_value(k.n) AS n FROM k JOIN k q ON abs(k.r-q.r) + abs(k.c-q.c) <= 1 WHERE (k.r*5+k.c) % 11 = 0 GROUP BY k.r, k.c) SELECT {n} AS i, '{name}' AS band, {hits} FROM t)"


_ALL = " UNION ALL ".join(_recalls(n, name, v) for n, (name, v) in enumerate((("height", "z"), ("depth", "-z"), ("stripes", "(r*7+c*3)%50"))))
LEADERS = f"WITH u AS ({_ALL}) SELECT row_number() OVER (ORDER BY recall_at_5pct DESC, i) AS place, band, " + ", ".join(r(f"recall_at_{round(b * 100)}pct", f"recall_at_{round(b * 100)}pct") for b in BUDGETS) + " FROM u"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(evaluation.compared(_responses(dem), _truth(dem)).drop("grid_id"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    sparse = dem.where(finite("z")).where("(r * 7 + c * 5) % 53 = 0")
    found = evaluation.offsets(dem, sparse, _truth(dem))
    wide = evaluation.registration(found)
    fair = evaluation.fairer_registration(found).select("grid_id", F.col("concealed").alias("concealed_3"))
    return comparable(wide.join(fair, "grid_id").drop("grid_id"))


OFFSETS = f"""WITH e AS (SELECT r, c FROM fx_dem WHERE isfinite(z) AND (r*7+c*5) % 53 = 0), o AS (SELECT d.r, d.c, sqrt(min((d.r-e.r)*(d.r-e.r)+(d.c-e.c)*(d.c-e.c))) AS d FROM fx_dem d, e WHERE (d.r*5+d.c) % 11 = 0 GROUP BY d.r, d.c)
 SELECT count(*) AS n, {r('quantile_cont(d, 0.5)', 'median')}, {r('quantile_cont(d, 0.75)', 'p75')}, {r('quantile_cont(d, 0.9)', 'p90')}, {", ".join(r(f'avg(CAST(d <= {k} AS INTEGER))', f'within_{k}') for k in (0, 1, 2, 3, 5))}, {r('avg(CAST(d > 5 AS INTEGER))', 'concealed')}, {r('avg(CAST(d > 3 AS INTEGER))', 'concealed_3')} FROM o"""


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.conditioned_misses(_flags(spark, sf_dir), 0.5, 0.5, "region"))


MISSES = f"SELECT region, count(*) FILTER (overlap >= 0.5) AS n_at_risk, count(*) FILTER (overlap >= 0.5 AND aligned >= 0.5) AS n_flagged, {r('coalesce(count(*) FILTER (overlap >= 0.5 AND aligned >= 0.5)/nullif(count(*) FILTER (overlap >= 0.5), 0), 0)', 'share')} FROM fx_flag GROUP BY region"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _flags(spark, sf_dir).withColumn("angle", F.expr("20 + 10 * (trace_id % 3)"))
    return comparable(evaluation.alignment_sweep(t, t))


SWEEP = f"""WITH c(min_aligned) AS (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6)) SELECT 20 + 10*(trace_id % 3) AS angle, min_aligned, {r('sum(CASE WHEN aligned >= min_aligned THEN length ELSE 0 END)/sum(length)', 'removed_share')}, count(*) FILTER (overlap >= 0.5) AS n_at_risk,
 count(*) FILTER (overlap >= 0.5 AND aligned >= min_aligned) AS n_flagged, {r('coalesce(count(*) FILTER (overlap >= 0.5 AND aligned >= min_aligned)/nullif(count(*) FILTER (overlap >= 0.5), 0), 0)', 'missed_share')} FROM fx_flag, c GROUP BY 1, 2"""


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = hydrology.flow_accumulation(hydrology.flow_directions(_dem(spark, sf_dir)))
    return comparable(evaluation.accumulation_sweep(net).drop("grid_id"))


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.scorecard(_flags(spark, sf_dir)))


CARD = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ({e}) AS flagged, {r(f'sum(CASE WHEN {e} THEN length ELSE 0 END)/sum(length)', 'length_share')}, count(*) FILTER (overlap >= 0.5 AND aligned < 0.5) AS band, count(*) FILTER (overlap >= 0.5 AND aligned < 0.5 AND ({e})) AS band_caught FROM fx_flag" for n, e in evaluation.RULES.items()
)


def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.residual(_flags(spark, sf_dir)))


RESIDUAL = f"SELECT count(*) FILTER (NOT is_drainage AND overlap >= 0.5) AS on_channel, {r('sum(CASE WHEN NOT is_drainage AND overlap >= 0.5 THEN length ELSE 0 END)/sum(length)', 'on_channel_share')}, count(*) FILTER (NOT is_drainage AND aligned >= 0.3) AS border, {r('sum(CASE WHEN NOT is_drainage AND aligned >= 0.3 THEN length ELSE 0 END)/sum(length)', 'border_share')} FROM fx_flag"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.audit(_flags(spark, sf_dir)).select("trace_id", "overlap", "aligned"))


AUDIT = f"SELECT trace_id, {r('overlap', 'overlap')}, {r('aligned', 'aligned')} FROM (SELECT * FROM fx_flag WHERE NOT is_drainage ORDER BY overlap DESC, aligned DESC, trace_id LIMIT 24)"


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subsample(_flags(spark, sf_dir), "trace_id", 50).select("trace_id")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(spark.createDataFrame(evaluation.densest_windows(_mask(dem), dem, 8), "r int, c int, density double"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluation.morphology_mix(tables(spark, sf_dir)["fx_att"].withColumn("reliable", F.col("strike") > 100)))


MIX = f"SELECT CASE WHEN dip >= 75 THEN 'straight' WHEN dip <= 20 THEN 'contour-parallel' ELSE 'V' END AS morphology, count(*) AS n, {r('count(*)/sum(count(*)) OVER ()', 'share')} FROM fx_att WHERE strike > 100 GROUP BY 1"


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strike of the selected attitudes."""
    rows = evaluation.active(tables(spark, sf_dir)["fx_att"].withColumn("selected", F.col("id") % 7 == 0))
    return comparable(attitude.mean_strikes(rows))


SELECTION = f"WITH a AS (SELECT avg(sin(radians(2*strike))) AS s, avg(cos(radians(2*strike))) AS c, count(*) AS n FROM fx_att WHERE id % 7 = 0) SELECT n, {r('((degrees(atan2(s, c))/2 % 180) + 180) % 180', 'mean_strike')}, {r('sqrt(s*s+c*c)', 'resultant')} FROM a"


def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.fold_axis(evaluation.active(tables(spark, sf_dir)["fx_att"].withColumn("selected", F.col("id") % 7 == 0)), "region"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)["fx_att"].withColumn("dip_direction", (F.col("strike") + 90) % 360)
    return comparable(attitude.mean_dip_direction(t, "region"))


DIRECTIONS = f"SELECT region, {r('((degrees(atan2(avg(sin(radians((strike+90)%360))), avg(cos(radians((strike+90)%360))))) % 360) + 360) % 360', 'mean_dip_direction')} FROM fx_att GROUP BY region"


def averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dem(spark, sf_dir).withColumn("other", F.expr("cast(r + c as double)"))
    return comparable(p.select("r", "c", normalise.nan_mean(["z", "other"]).alias("mean")))


AVERAGED = f"SELECT r, c, {r('CASE WHEN isfinite(z) THEN (z+r+c)/2 ELSE r+c END', 'mean')} FROM fx_dem"

QUERIES = {
    "e2_suppressed": (suppressed, oracles.E2_SUPPRESSED),
    "e3_hysteresis": (held_edges, HELD),
    "e4_canny": (canny_edges, oracles.E4_CANNY),
    "e8_responses": (responses, oracles.E8_RESPONSES),
    "e9_linear_response": (linear, oracles.E9_LINEAR),
    "e13_classical": (classical, None),
    "b14_composite": (composite, COMPOSITE),
    "b12_averaged": (averaged, AVERAGED),
    "c6_chains": (skeleton_chains, oracles.C6_CHAINS),
    "a6_polylines": (polylines, None),
    "a7_extracted": (extracted, None),
    "a9_linked": (linked, None),
    "h5_network": (network, oracles.H5_NETWORK),
    "h6_channels": (channels, oracles.H6_CHANNELS),
    "h8_fractions": (fractions, FRACTIONS),
    "h12_flags": (flagged, None),
    "h13_density": (density, oracles.H13_DENSITY),
    "l2_cost": (cost, COST),
    "l3_strength": (strength, None),
    "l4_trace_cost": (trace_cost, None),
    "l6_incoherence": (incoherence, oracles.L6_INCOHERENCE),
    "l8_snap_field": (snap_field, SNAP_FIELD),
    "l9_snapped": (snapped, SNAPPED),
    "l10_graph": (graph, GRAPH),
    "l11_windowed_cost": (windowed_cost, oracles.windowed(COST)),
    "l13_path": (path, oracles.path(COST)),
    "l14_legs": (replayed, REPLAYED),
    "l14_replayed": (wired, None),
    "m7_candidates": (candidates, None),
    "m8_detected_attitudes": (detected_attitudes, None),
    "m11_dip_directions": (directions, DIRECTIONS),
    "q6_budget_linearity": (budget_linearity, BUDGET_LINEARITY),
    "q7_mask_recall": (mask_recall, MASK_RECALL),
    "q9_leaderboard": (leaders, LEADERS),
    "q10_methods": (methods, None),
    "q11_offsets": (offsets, OFFSETS),
    "q15_subsample": (picked, None),
    "q17_misses": (misses, MISSES),
    "q18_alignment_sweep": (sweep, SWEEP),
    "q18_densities": (densities, oracles.Q18_DENSITIES),
    "q19_scorecard": (card, CARD),
    "q20_residual": (residual, RESIDUAL),
    "q21_audit": (audit, AUDIT),
    "q22_windows": (windows, None),
    "v8_morphology_mix": (mix, MIX),
    "x16_selection": (selection, SELECTION),
    "x13_fold_axes": (fold, None),
}
