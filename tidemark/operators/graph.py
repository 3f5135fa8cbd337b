"""Connected components of same-event edges."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_FOLDERS: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where that is unset, local sessions get a temporary one once, others an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _FOLDERS:
        _FOLDERS["dir"] = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    return "file://" + _FOLDERS["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, partition by partition: rounds don't pile up lineage and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed at the end of the driver."""
    path = f"{_shared(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: a scan of its own, which brings no constraints of the
    plan before into the next one, as a checkpoint does (they double with every join of a loop)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
        pass


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by rounds of contraction over (src, dst).

    In each round a node joins the neighbour of least priority, a hash that every round draws anew, and the one that this
    neighbour joins.  The order of the nodes themselves would let a chain that is sorted shrink by two nodes a round; by
    priorities a constant share of the nodes goes in each, whatever the shape.
    """
    edges = stored(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    labels, turn = None, 0
    while True:
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min(ranked("dst")).alias("least")).withColumn("own", ranked("src"))
        parents = least.select(F.col("src").alias("node"), F.when(F.col("least") < F.col("own"), F.col("least.node")).otherwise(F.col("src")).alias("parent"))
        above = parents.select(F.col("node").alias("an"), F.col("parent").alias("ap"))
        parents = stored(parents.join(above, F.col("parent") == F.col("an"), "left").select("node", F.coalesce("ap", "parent").alias("parent")), "parents")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            up = parents.select(F.col("node").alias("pn"), "parent")
            labels = stored(labels.join(up, F.col("root") == F.col("pn"), "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        a = parents.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        b = parents.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        edges = stored(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
        turn += 1
        if edges.isEmpty():
            names = labels.groupBy("root").agg(F.min("node").alias("component"))
            return labels.join(names, "root").select("node", "component")
