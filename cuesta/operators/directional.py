"""Statistics of unit vectors and planes: Fisher means, orientation tensors, fabrics, roses, great circles and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesta.functions.angles import equal_area_vector, line_vector, pole, vector_line
from cuesta.functions.numeric import nan, finite, held, modulo
from cuesta.functions.symmetric import eigenvalues3, eigenvector3


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(x, y, z, ...) normalised; non-finite and (nearly) zero ones go."""
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    kept = vectors.where(finite("x") & finite("y") & finite("z")).withColumn("_n", n).where("_n > 1e-12")
    return kept.withColumns({c: F.col(c) / F.col("_n") for c in ("x", "y", "z")}).drop("_n")


def fisher_mean(vectors: DataFrame, *keys: str, confidence: float = 0.95) -> DataFrame:
    """(keys, n, resultant, trend, plunge, kappa, alpha, csd): mean direction, precision, confidence cone and angular deviation."""
    m = unit_vectors(vectors).groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("x", "y", "z")))
    m = m.withColumn("resultant", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    n, length = F.col("n"), F.col("resultant")
    some = length > 1e-12
    gap = n - length
    kappa = F.when(~some | (n < 2), nan()).when(gap <= 1e-12, F.lit(float("inf"))).otherwise((n - 1) / F.when(gap > 1e-12, gap))
    power = F.pow(F.lit(1 / (1 - confidence)), 1 / F.when(n > 1, n - 1)) - 1
    cosine = 1 - gap / F.when(some, length) * power
    alpha = F.when(~some | (n < 2), nan()).otherwise(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))
    trend, plunge = vector_line("x", "y", "z", lower=False)
    csd = F.when(F.col("kappa") > 0, 81 / F.sqrt("kappa")).otherwise(nan())
    m = m.withColumn("kappa", kappa)
    return m.select(*keys, "n", "resultant", trend.alias("trend"), plunge.alias("plunge"), "kappa", alpha.alias("alpha"), csd.alias("csd"))


def orientation_tensor(vectors: DataFrame, *keys: str, normalize: bool = True) -> DataFrame:
    """(keys, n, xx, yy, zz, xy, xz, yz): sums of products of the unit vectors, over n if normalised."""
    f = F.avg if normalize else F.sum
    return unit_vectors(vectors).groupBy(*keys).agg(F.count("*").alias("n"), *(f(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")))


def woodcock(s1: Column, s2: Column, s3: Column) -> tuple[Column, Column]:
    """(K, C): shape and strength of a fabric; K is infinite for a pure cluster and NaN without any fabric."""
    a, b, c = (F.ln(F.greatest(s, F.lit(1e-12))) for s in (s1, s2, s3))
    k = F.when(F.abs(b - c) >= 1e-12, (a - b) / F.when(F.abs(b - c) >= 1e-12, b - c)).when(a - b > 1e-12, F.lit(float("inf"))).otherwise(nan())
    return k, a - c


def principal(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, s1..s3, k, c, trend1, plunge1, trend3, plunge3): eigenvalues, fabric, and the lines of the largest and least."""
    t = orientation_tensor(vectors, *keys)
    names = [F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")]
    s = eigenvalues3(*names)
    t = held(t, {f"s{i + 1}": F.greatest(v, F.lit(0.0)) for i, v in enumerate(s)})
    k, c = woodcock(F.col("s1"), F.col("s2"), F.col("s3"))
    lines = {}
    for i in (1, 3):
        t = held(t, {f"_{n}{i}": v for n, v in zip("xyz", eigenvector3(F.col(f"s{i}"), *names), strict=True)})
        lines[i] = vector_line(f"_x{i}", f"_y{i}", f"_z{i}")
    return t.select(*keys, "n", "s1", "s2", "s3", k.alias("k"), c.alias("c"), *(v.alias(f"{what}{i}") for i, pair in lines.items() for what, v in zip(("trend", "plunge"), pair, strict=True)))


def axial_mean(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, trend, plunge, concentration) of undirected lines."""
    return principal(vectors, *keys).select(*keys, F.col("trend1").alias("trend"), F.col("plunge1").alias("plunge"), F.col("s1").alias("concentration"))


def poles(planes: DataFrame) -> DataFrame:
    """planes(strike, dip, ...) with the downward normal x, y, z."""
    x, y, z = line_vector(*pole("strike", "dip"))
    return planes.withColumns({"x": x, "y": y, "z": z})


def fold_axis(planes: DataFrame, *keys: str, weak: float = 0.3) -> DataFrame:
    """(keys, n, trend, plunge, k, c, fabric): the least eigenvector of the poles; fabric is undefined, weak, girdle or cluster."""
    p = principal(poles(planes.where(finite("strike") & finite("dip"))), *keys)
    fabric = F.when(F.col("n") < 3, "undefined").when(F.col("c") < weak, "weak").when(F.col("k") < 1, "girdle").otherwise("cluster")
    few = F.col("n") < 3
    return p.select(*keys, "n", *(F.when(few, nan()).otherwise(F.col(f"{w}3")).alias(w) for w in ("trend", "plunge")), "k", "c", fabric.alias("fabric"))


def rose_bins(strikes: DataFrame, width: int = 10) -> DataFrame:
    """(start, n): undirected strikes in bins over the full circle, both halves alike, empty bins kept."""
    if width <= 0 or 360 % width:
        raise ValueError("the width must divide 360")
    turned = F.explode(F.array(*(modulo(F.col("strike"), 180) + half for half in (0.0, 180.0)))).alias("_s")
    found = strikes.where(finite("strike")).select(turned).groupBy(F.floor(F.col("_s") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = strikes.sparkSession.range(360 // width).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select((F.col("bin") * width).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def great_circles(planes: DataFrame, n: int = 181) -> DataFrame:
    """(id, k, u, v): n projected points along each plane's lower half circle.

    Rows come by strike, dip and id: equal circles lie together, and a table written from
    them holds their points by reference, where those of mixed planes are all kept in full.
    Only planes are shuffled, not points; those of one strike and dip may share out over tasks.
    """
    if n < 2:
        raise ValueError("a great circle needs two points")
    parts = int(planes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes of planes make many points
    order = ["strike", "dip", "id"]
    p = planes.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    p = p.select("id", "strike", "dip", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    a, s, d = F.col("k") * F.lit(180.0 / (n - 1)), F.radians("strike"), F.radians("dip")
    t = F.radians(a)
    x = F.cos(t) * F.sin(s) + F.sin(t) * F.cos(d) * F.cos(s)
    y = F.cos(t) * F.cos(s) - F.sin(t) * F.cos(d) * F.sin(s)
    u, v = equal_area_vector(x, y, -F.sin(t) * F.sin(d))
    return p.select("id", "k", u.alias("u"), v.alias("v"))


def inside(u: Column, v: Column, outline: Sequence[tuple[float, float]]) -> Column:
    """Whether (u, v) lies in the outline by the even-odd rule; never in one of fewer than three points."""
    if len(outline) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(outline, [*outline[1:], outline[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(float(y1)) > v) != (F.lit(float(y2)) > v)
            crossings = crossings + (spans & (u < F.lit(float(x1)) + (v - y1) * ((x2 - x1) / (y2 - y1)))).cast("int")
    return crossings % 2 == 1


def linked(table: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the table whose key is selected."""
    return table.join(selected.select(key).distinct(), key, "left_semi")
