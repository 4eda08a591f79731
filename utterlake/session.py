"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "utterlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where the session names none (local tests) a folder of this machine is set;
    on a cluster without the setting that is refused.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = "file://" + tempfile.mkdtemp(prefix="utterlake-")
    sc.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def store(df: DataFrame, name: str = "step", keep: bool = True) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again: (table, path).

    Unlike a cached plan the table outlives the executors that made it, and unlike
    ``checkpoint()`` it is columnar and compressed. Tables go when the process ends;
    iterations drop theirs earlier with :func:`drop_path`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/utterlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep:
        atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path), path
