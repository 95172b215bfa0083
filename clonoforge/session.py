"""Session builder and the few run-time services that operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings a fresh session starts from. On a cluster the submitter's values win:
#: nothing here is written over a session that already exists.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "clonoforge", **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC on; conf adds to or overrides DEFAULTS."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; a private one only where none is named and the master is local (tests).

    On a cluster executors do not share a machine's own folder, so there none may be missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix=f"clonoforge-{os.getpid()}-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether the files of an execution's shuffles go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to a table in the shared folder, its lineage cut.

    The files are kept by the folder's own file system, so a lost executor costs nothing
    but the task it ran; unlike a checkpointed plan a table tells its true size, which the
    planner needs in loops of joins. The table is deleted when the application ends; the
    shuffles that made it go as soon as it is stored, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4()}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEANUP, before)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df in as many partitions as shuffles have, by `columns` or evenly.

    For rows that cost much time and few bytes: adaptive execution joins small partitions by
    their bytes, which would leave all of that time to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def ship(spark: SparkSession) -> None:
    """This package's source to the workers, once per application: they need not find it on their own path."""
    if getattr(spark.sparkContext, "_clonoforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="clonoforge-source-"), "clonoforge_source.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("clonoforge", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._clonoforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
