"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lodeline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; a running session is reused as it is.

    On a cluster leave ``master`` and ``partitions`` unset: both then come from spark-submit, and adaptive
    execution sizes the shuffles. ``partitions`` is for tests.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # files of checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of every executor, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodeline-ship-")) / "lodeline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._lodeline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used as given. Only a local session
    without one gets a temporary folder: executors of a cluster could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodeline-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The data survives the loss of any executor. Iterative operators call it once a round.
    """
    checkpoint_folder(df.sparkSession)
    ship(df.sparkSession)
    done = df.checkpoint(eager=True)
    # A checkpoint keeps the size its plan was estimated at. Over many rounds of joins that estimate squares again and again, until
    # the number alone fills the driver's memory; then the rows are taken without it.
    if done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 62:
        return done
    spark = df.sparkSession
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A file of one row group is one task however many cores wait. Inputs of enough splits, all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def default_sf(sf: str = "sf0.001") -> str:
    return os.path.join(os.environ.get("LODELINE_DATA", "/root/testdata"), sf)
