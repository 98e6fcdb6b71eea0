"""Regions, distance and drainage over the derived elevation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions.numeric import finite
from cuesta.operators import hydrology, kernels, normalise, regions
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables

HEIGHT = WIDTH = 48
#: Tiles of these queries: 4 x 4 of them.
TILE = 12
#: The mask of these queries: scattered cells.
MASK = "m AS (SELECT grid_id, r, c FROM fx_dem WHERE isfinite(z) AND (CAST(z*4 AS BIGINT)*7 + r*3 + c) % 5 = 0)"


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_dem"]


def _mask(dem: DataFrame) -> DataFrame:
    return dem.where(finite("z")).where("(cast(z * 4 as bigint) * 7 + r * 3 + c) % 5 = 0").select("grid_id", "r", "c")


def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.within(regions.dilate(_mask(_dem(spark, sf_dir)), 2), HEIGHT, WIDTH).select("r", "c")


DILATION = f"WITH {MASK} SELECT DISTINCT d.r, d.c FROM fx_dem d JOIN m ON (d.r-m.r)*(d.r-m.r)+(d.c-m.c)*(d.c-m.c) <= 4"


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.close_gaps(_mask(_dem(spark, sf_dir)), HEIGHT, WIDTH).select("r", "c")


CLOSING = f"WITH {MASK}, d AS (SELECT DISTINCT p.r, p.c FROM fx_dem p JOIN m ON abs(p.r-m.r) <= 1 AND abs(p.c-m.c) <= 1) SELECT p.r, p.c FROM fx_dem p JOIN d ON abs(p.r-d.r) <= 1 AND abs(p.c-d.c) <= 1 GROUP BY p.r, p.c HAVING count(*) = 9"


def ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.ring_counts(_mask(_dem(spark, sf_dir))).select("r", "c", "neighbours", "transitions")


RING_COUNTS = f"WITH {MASK}, p AS (SELECT m.r, m.c, " + ", ".join(f"CAST(EXISTS (SELECT 1 FROM m x WHERE x.r = m.r + ({i}) AND x.c = m.c + ({j})) AS INTEGER) AS q{k}" for k, (i, j) in enumerate(regions.RING)) + " FROM m) SELECT r, c, " + "+".join(f"q{k}" for k in range(8)) + " AS neighbours, " + "+".join(f"CAST(q{k}=0 AND q{(k + 1) % 8}=1 AS INTEGER)" for k in range(8)) + " AS transitions FROM p"


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.thin(_mask(_dem(spark, sf_dir)), size=TILE, reach=3).select("r", "c")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.components(_mask(_dem(spark, sf_dir)), size=TILE).select("r", "c", "label")


COMPONENTS = f"""WITH RECURSIVE {MASK}, n AS (SELECT r*48+c AS v, r, c FROM m), w(v, u) AS (SELECT v, v FROM n UNION SELECT w.v, b.v FROM w JOIN n a ON a.v = w.u JOIN n b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1)
 SELECT CAST(v//48 AS INTEGER) AS r, CAST(v%48 AS INTEGER) AS c, 'g0:' || CAST(min(u)//48 AS VARCHAR) || ':' || CAST(min(u)%48 AS VARCHAR) AS label FROM w GROUP BY v"""


def linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(regions.linearity(regions.components(_mask(_dem(spark, sf_dir)))))


LINEARITY = COMPONENTS.replace(" SELECT CAST(v//48", ", l AS (SELECT CAST(v//48") + f"""), k AS (SELECT label, count(*) AS n, var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS x FROM l GROUP BY label),
 e AS (SELECT n, CASE WHEN n >= 5 AND a+b > 0 THEN sqrt((a-b)*(a-b)+4*x*x)/(a+b) ELSE 0 END AS e FROM k)
 SELECT 'g0' AS grid_id, count(*) AS n_components, {r('avg(n)', 'mean_size')}, max(n) AS largest_size, {r('sum(e*n)/sum(n)', 'linearity')} FROM e"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(regions.distance(dem, _mask(dem)).select("r", "c", "distance", "near_r", "near_c"))


NEAREST = f"""WITH {MASK}, j AS (SELECT d.r, d.c, min({{'d': (d.r-m.r)*(d.r-m.r)+(d.c-m.c)*(d.c-m.c), 'r': m.r, 'c': m.c}}) AS b FROM fx_dem d, m GROUP BY d.r, d.c)
 SELECT r, c, {r('sqrt(b.d)', 'distance')}, b.r AS near_r, b.c AS near_c FROM j"""

_DROPS = " UNION ALL ".join(f"SELECT p.r, p.c, {i} AS dr, {j} AS dc, {n} AS o, (p.z-q.z)/{'sqrt(2)' if i and j else '1.0'} AS drop FROM fx_dem p JOIN fx_dem q ON q.r = p.r + ({i}) AND q.c = p.c + ({j}) WHERE isfinite(p.z) AND isfinite(q.z) AND p.z > q.z" for n, (i, j, _) in enumerate(hydrology.STEPS))
D8 = f"drops AS ({_DROPS}), d8 AS (SELECT r, c, dr, dc FROM drops QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY drop DESC, o) = 1)"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hydrology.flow_azimuth(hydrology.flow_directions(_dem(spark, sf_dir)))
    return comparable(d.select("r", "c", "dr", "dc", "azimuth"))


FLOW = f"WITH {D8} SELECT p.r, p.c, d8.dr, d8.dc, {r('((degrees(atan2(d8.dc, -d8.dr)) % 360) + 360) % 360', 'azimuth')} FROM fx_dem p LEFT JOIN d8 USING (r, c)"


def accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.flow_accumulation(hydrology.flow_directions(_dem(spark, sf_dir)), size=TILE).select("r", "c", "accumulation")


ACCUMULATION = f"""WITH RECURSIVE {D8}, w(r, c) AS (SELECT r, c FROM fx_dem WHERE isfinite(z) UNION ALL SELECT w.r + d8.dr, w.c + d8.dc FROM w JOIN d8 ON d8.r = w.r AND d8.c = w.c),
 n AS (SELECT r, c, count(*) AS n FROM w GROUP BY r, c) SELECT p.r, p.c, coalesce(n.n, 0) AS accumulation FROM fx_dem p LEFT JOIN n USING (r, c)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return comparable(hydrology.upsample(hydrology.block_mean(dem, 5), dem, 5).select("r", "c", "z"))


BLOCKS = f"WITH b AS (SELECT r//5 AS br, c//5 AS bc, avg(z) FILTER (isfinite(z)) AS z FROM fx_dem WHERE r < 45 AND c < 45 GROUP BY 1, 2) SELECT p.r, p.c, {r('b.z', 'z')} FROM fx_dem p JOIN b ON br = least(p.r//5, 8) AND bc = least(p.c//5, 8)"


def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of 20 cells and more: buffer, azimuth of the nearest, and the penalty that decays with distance."""
    dem = _dem(spark, sf_dir)
    mask = hydrology.settled(hydrology.channels(dem, 20))
    near = hydrology.channel_proximity(dem, mask)
    return comparable(near.join(hydrology.drainage_penalty(dem, mask), ["grid_id", "r", "c"]).select("r", "c", "near", "azimuth", "penalty"))


PROXIMITY = f"""WITH RECURSIVE {D8}, w(r, c) AS (SELECT r, c FROM fx_dem WHERE isfinite(z) UNION ALL SELECT w.r + d8.dr, w.c + d8.dc FROM w JOIN d8 ON d8.r = w.r AND d8.c = w.c),
 ch AS (SELECT w.r, w.c, any_value(d8.dr) AS dr, any_value(d8.dc) AS dc FROM w LEFT JOIN d8 ON d8.r = w.r AND d8.c = w.c GROUP BY w.r, w.c HAVING count(*) >= 20),
 j AS (SELECT p.r, p.c, min({{'d': (p.r-ch.r)*(p.r-ch.r)+(p.c-ch.c)*(p.c-ch.c), 'r': ch.r, 'c': ch.c}}) AS b FROM fx_dem p, ch GROUP BY p.r, p.c)
 SELECT j.r, j.c, b.d <= 4 AS near, {r('((degrees(atan2(ch.dc, -ch.dr)) % 360) + 360) % 360', 'azimuth')}, {r('exp(-sqrt(b.d)/3)', 'penalty')} FROM j JOIN ch ON ch.r = b.r AND ch.c = b.c"""



def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(kernels.fill_depressions(_dem(spark, sf_dir), size=TILE).select("r", "c", "z"))


def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(kernels.gaussian_gradient(_dem(spark, sf_dir), size=TILE).select("r", "c", "gx", "gy"))


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(kernels.structure_tensor(_dem(spark, sf_dir), ["z"], size=TILE).drop("grid_id"))


def simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(kernels.simplify(tables(spark, sf_dir)["fx_vert"], 50.0))


def least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from the grid's centre over stretched heights."""
    p = normalise.cost_norm(_dem(spark, sf_dir), "z", finite("z"), "cost").withColumn("cost", F.col("cost") + 0.1)
    return comparable(kernels.cost_to_all(p, (24, 24), size=TILE).select("r", "c", "distance"))


QUERIES = {
    "a5_simplified": (simplified, None),
    "e1_gradient": (gradient, None),
    "e5_tensor": (tensor, None),
    "h4_filled": (filled, None),
    "l11_least_cost": (least_cost, None),
    "c1_components": (components, COMPONENTS),
    "c2_dilation": (dilation, DILATION),
    "c3_closing": (closing, CLOSING),
    "c4_thinning": (thinned, None),
    "c5_ring_counts": (ring_counts, RING_COUNTS),
    "c7_blocks": (blocks, BLOCKS),
    "n1_nearest": (nearest, NEAREST),
    "q5_linearity": (linearity, LINEARITY),
    "h1_flow": (flow, FLOW),
    "h2_accumulation": (accumulation, ACCUMULATION),
    "h7_proximity": (proximity, PROXIMITY),
}
