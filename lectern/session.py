"""Session helpers: defaults for local runs and a checkpoint folder all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()
_PRIVATE: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the application, once.

    Workers on other machines, or started from another folder, cannot import it otherwise.
    The driver's private folder only holds the archive that Spark's file server sends out.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    archive = os.path.join(tempfile.mkdtemp(prefix="lectern-package-"), "lectern.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(archive)


def local_session(cpus: int | str = 8, partitions: int = 8, name: str = "lectern") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a private one only for a local master."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _PRIVATE.setdefault(context.applicationId, tempfile.mkdtemp(prefix="lectern-shared-"))
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent and no folder is set yet,
    which is the case in local tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
