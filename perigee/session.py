"""Session settings shared by the queries, the tests and the bench."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ANSI and UTC are what the expressions assume; the rest lets the optimizer re-plan at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("perigee").config("spark.driver.memory", "6g")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan's rows by hash of the key where it has fewer splits than the session has cores; as they are where it
    has enough."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def materialize(df: DataFrame) -> DataFrame:
    """Cuts a lineage that others read several times, with a reliable checkpoint in the folder that the session
    names in spark.checkpoint.dir (one of our own only where it names none)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(where or f"{tempfile.gettempdir()}/perigee-checkpoints")
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A materialized relation of a few short columns, to be broadcast where it has no more rows than `most`."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Puts the package on the executors' path, once per application: Python workers import what they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp()) / root.name
        archive = shutil.make_archive(str(base), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)  # the driver serves it; executors need no common folder
        _shipped.add(app)
