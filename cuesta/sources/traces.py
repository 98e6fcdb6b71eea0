"""Traces from files and layers, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_interlis(spark: SparkSession, path: str) -> DataFrame:
    """(file, trace_id, seq, x, y) of INTERLIS 1 text: OBJE starts a line, STPT and LIPT are its points.

    A file is split in one task; objects are told apart by a running count of OBJE within the file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    order = Window.partitionBy("file").orderBy("n")
    tagged = lines.where(F.substring("line", 1, 4).isin("OBJE", "STPT", "LIPT")).withColumn("obj", F.sum((F.substring("line", 1, 4) == "OBJE").cast("long")).over(order))
    words = F.split(F.trim("line"), r"\s+")
    points = tagged.where(F.substring("line", 1, 4) != "OBJE").select("file", (F.col("obj") - 1).alias("trace_id"), "n", words[1].cast("double").alias("x"), words[2].cast("double").alias("y"))
    return points.select("file", "trace_id", (F.row_number().over(Window.partitionBy("file", "trace_id").orderBy("n")) - 1).alias("seq"), "x", "y")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, part, trace_id, seq, x, y, class): one trace for each part with two vertices or more of lines and multi-lines."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", FEATURES).alias("d"))
    f = raw.select("file", F.posexplode("d.features").alias("feature", "f")).select("file", "feature", F.col("f.properties").alias("p"), "f.geometry.*")
    return traces(f.withColumn("class", F.try_element_at("p", F.lit("class"))).drop("p"))


def traces(features: DataFrame) -> DataFrame:
    """The same from features(file, feature, type, coordinates as JSON text, class); a third coordinate is left out."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    parts = F.when(F.col("type") == "LineString", one).when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    kept = features.select("file", "feature", "class", F.posexplode(parts).alias("part", "line")).where(F.size("line") >= 2)
    named = kept.withColumn("trace_id", F.concat_ws("/", "file", F.col("feature").cast("string"), F.col("part").cast("string")))
    return named.select("file", "feature", "part", "trace_id", "class", F.posexplode("line").alias("seq", "v")).select("file", "feature", "part", "trace_id", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "class")


def accepted() -> Column:
    """Traces that take part in fitting: not marked as drainage, nor rejected."""
    return ~F.coalesce(F.col("class"), F.lit("")).isin("drainage", "reject")


def layer_scan(features: DataFrame, where: Column | None = None) -> DataFrame:
    """The selected features of a layer(..., selected), or all if none is, that the predicate accepts."""
    from cuesta.operators.evaluation import active

    out = active(features)
    return out if where is None else out.where(where)


def trace_layer(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates with their vertices as an array, in the order of review; class starts as drainage or contact."""
    line = points.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    return candidates.join(line, "trace_id").withColumn("class", F.when(F.col("is_drainage"), "drainage").otherwise("contact"))


#: Decimals of each column in written tables; conditioning is written with an exponent.
DECIMALS = {"x": 1, "y": 1, "strike": 2, "dip": 2, "dip_direction": 2, "dip_uncertainty": 2, "relief": 1, "length": 1}


def formatted(fits: DataFrame) -> DataFrame:
    """Attitudes as text of fixed precision."""
    def text(c: str) -> Column:
        if c in DECIMALS:
            return F.format_string(f"%.{DECIMALS[c]}f", F.col(c))
        if c in ("conditioning", "map_conditioning"):
            return F.format_string("%.3e", F.col(c))
        return F.col(c).cast("int").cast("string") if c == "reliable" else F.col(c).cast("string")

    return fits.select(*(text(c).alias(c) for c in fits.columns))


def write_csv(table: DataFrame, path: str, mode: str = "error") -> None:
    """A table with a header, a file a partition."""
    table.write.mode(mode).option("header", True).csv(path)
