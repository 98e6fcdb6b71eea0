"""Repeats a DataFrame step until nothing changes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuesta-"))
        folder = sc.getCheckpointDir()
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table written in the shared folder and read again.

    A table also ends the plan's size estimates; a checkpoint would carry them on, and
    with a join in every round they double their digits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuesta/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(*frames: DataFrame) -> None:
    """Delete the tables of frames made by ``settled`` that nothing will read again."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Column) -> DataFrame:
    """Apply step until no row of its result has ``changed`` true; every round is written, and the one before let go."""
    state = settled(state)
    while True:
        after = settled(step(state))
        forgotten(state)
        if after.where(changed).limit(1).count() == 0:
            return after
        state = after


def component_labels(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): least node of each component, by minimum labels with pointer jumping.  cells(node), edges(a, b) both ways."""
    labels = cells.select("node", F.col("node").alias("label"), F.lit(True).alias("moved"))
    edges = settled(edges.select("a", "b"))

    def step(now: DataFrame) -> DataFrame:
        heard = edges.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = now.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        far = now.select(F.col("node").alias("near"), F.col("label").alias("far"))
        return near.join(far, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))

    return fixpoint(labels, step, F.col("moved")).select("node", "label")
