"""Session helpers: shared stage folder, lineage cuts and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master, where that is
    unset (tests on one machine), a temporary folder is made and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("hopweave.stage.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hopweave-")
        spark.conf.set("hopweave.stage.dir", root)
    return root


def stage_folder(spark: SparkSession) -> str:
    """This application's folder of stage tables, with its file system; removed when the application ends."""
    name = f"{stage_root(spark).rstrip('/')}/hopweave/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return system.makeQualified(path).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running, because the
    stage lives in the shared folder.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, condition: str = "true") -> tuple[DataFrame, int]:
    """:func:`materialize`, and how many of its rows fulfil ``condition``, counted while they are written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    out = materialize(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
    return out, int(seen.get["n"])


def clear_stages(spark: SparkSession) -> None:
    """Deletes this application's stage tables at once; call it when no DataFrame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
