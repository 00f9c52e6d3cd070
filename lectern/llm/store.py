"""Intermediate tables that survive lost executors.

``cut`` writes a DataFrame as Parquet in the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back, so later jobs neither recompute it nor depend
on executors that made it.  Files lie in one folder per application; ``clear`` removes it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.session import ship

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a private one only for a local master without the setting."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="lectern-llm-"))
    return f"{shared.rstrip('/')}/lectern-llm-{app}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove everything ``cut`` wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows per Arrow batch for Python tasks: texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that Python tasks hold small; smaller settings of the session stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, to be processed in small batches by workers that know this package."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
