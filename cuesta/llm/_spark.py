"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of the queries that ``stored`` runs: shuffle files go as they end, and Arrow batches hold fewer rows
#: than by default, since a row may be a long text.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuesta-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold inside; the session's own come back."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: For rows of megabytes.  By default the writer looks at its size, and closes a page or a row group, after a hundred rows
#: only, and the reader holds all rows of a group, up to 4,096, at once: a task would hold its whole share of the table.
WIDE = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; wide: rows are large, so row groups hold few of them.

    This cuts the lineage: a lost executor costs no earlier work, and what
    follows reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuesta/{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.options(compression="zstd", **(WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def id_bucket(column: str, n: int):
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def held_out(column: str, n: int, rest: int):
    """True for ids kept out of learning; a row without id is kept out as well."""
    return F.coalesce(id_bucket(column, n) == F.lit(rest), F.lit(True))
