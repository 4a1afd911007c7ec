"""Session construction and table loading shared by the whole package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "folium", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. On a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """The session of tests and benchmarks: one JVM, few shuffle partitions."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.ui.enabled": "false", **conf}
    return build_session(f"local[{n}]", **conf)


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers.

    Nothing is to be done where workers inherit its folder through PYTHONPATH or it was submitted with --py-files;
    else it is zipped and handed to Spark, once per context.
    """
    root, sc = Path(__file__).resolve().parent, spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if not root.is_dir() or root.parent in on_path or getattr(sc, "_folium_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="folium-")) / "folium.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._folium_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader touches the path."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        set_dir = "file://" + tempfile.mkdtemp(prefix="folium-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
