"""Session defaults and shared scratch tables.

Scratch tables cut lineage where a result is read more than once. They live
below ``spark.checkpoint.dir``, which every executor and the driver can reach,
so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def build_session(app: str = "quillet", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables of this application.

    The session's ``spark.checkpoint.dir`` decides. Only where it is unset (a
    local session, as in tests) a temporary folder of this machine serves.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own_root:
            _own_root[app] = "file://" + tempfile.mkdtemp(prefix="quillet-")
        shared = _own_root[app]
    return f"{shared.rstrip('/')}/quillet-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application, once results are stored."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
