"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Tables written here cut lineage, so a lost executor
costs a re-read of finished files and not a recomputation; they are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where that is unset, local sessions get a temporary one once, others an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(_FALLBACK["dir"])
    return "file://" + _FALLBACK["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed at the end of the driver."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
        pass


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove finished intermediate tables early."""
    for path in paths:
        _remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_rows(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and 4 MB where the session has Spark's defaults: whole texts are long rows, and
    a batch is held by the JVM and by the Python worker at once."""
    for name, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(2**31 - 1), str(1 << 22))):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) in (default, "2147483647b", f"{2**63 - 1}", f"{2**63 - 1}b"):
            spark.conf.set(name, value)
