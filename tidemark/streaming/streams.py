"""Structured Streaming operators: cursor upserts, de-duplication, daily counts, poll state.

Each ``run_*`` drives a stream over what its source holds now.  Checkpoints and sinks live in the
folder that the cluster shares (``spark.checkpoint.dir``); a restart with the same folder goes on
from the source's offsets, and sinks are idempotent by batch id.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rank import first_per_key


def shared_path(spark: SparkSession, name: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = named or tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet stream with bounded batches; zone-less times become instants in UTC."""
    schema = spark.read.parquet(path).schema
    # a single file is read through its folder with a name filter; a folder as it is
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    single = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    for field in schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def upsert_sink(target: str, key: Sequence[str], order: str, partitions: int = 16):
    """foreachBatch sink: newest row per key in a Parquet table of hash buckets; only touched buckets are rewritten.

    Buckets are written under the batch id and a pointer per bucket is the newest batch, so a batch
    that runs again writes the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(partitions)).cast("int")
        fresh = first_per_key(batch.withColumn("bucket", bucket), list(key), [F.col(order).desc()])
        held = read_upserted(spark, target, before=batch_id)
        if held is not None:
            touched = fresh.select("bucket").distinct()
            old = held.join(F.broadcast(touched), "bucket", "left_semi")  # at most `partitions` rows
            fresh = first_per_key(fresh.unionByName(old.select(fresh.columns)), list(key), [F.col(order).desc()])
        fresh.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id:09d}")

    return write


def _newest(spark: SparkSession, target: str, before: int | None = None) -> tuple[object, dict[str, object], list]:
    """The store, of each bucket the newest folder, and the folders that it replaces; as many entries as buckets and batches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[str, object] = {}
    replaced = []
    folders = sorted((s.getPath() for s in store.listStatus(path)), key=lambda f: f.getName()) if store.exists(path) else []
    for batch in folders:
        if before is not None and int(batch.getName().rpartition("=")[2]) >= before:
            continue
        for status in store.listStatus(batch):
            bucket = status.getPath()
            if bucket.getName().startswith("bucket="):
                if bucket.getName() in newest:
                    replaced.append(newest[bucket.getName()])
                newest[bucket.getName()] = bucket
    return store, newest, replaced


def read_upserted(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table of an upsert sink: of each bucket the folder that its newest batch wrote, however many batches there were."""
    _, newest, _ = _newest(spark, target, before)
    if not newest:
        return None
    rows = spark.read.option("basePath", target).parquet(*[f.toString() for f in newest.values()])
    return rows.drop("batch")


def compacted(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Remove bucket folders that newer batches replaced; those of the last ``keep`` batches stay, for batches that run again."""
    store, newest, replaced = _newest(spark, target)
    numbers = sorted({int(f.getParent().getName().rpartition("=")[2]) for f in [*newest.values(), *replaced]})
    old = [f for f in replaced if int(f.getParent().getName().rpartition("=")[2]) not in numbers[-keep:]]
    for folder in old:
        store.delete(folder, True)
    return len(old)


def quarantine_sink(target: str, good: Column):
    """foreachBatch sink with a side output: rows go to ``good`` or to ``quarantine`` below the target, by batch, so a batch
    that runs again writes the same folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = F.coalesce(good, F.lit(False))
        for name, rows in (("good", batch.where(kept)), ("quarantine", batch.where(~kept))):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id:09d}")

    return write


def fresh_rows(stream: DataFrame, key: Sequence[str], time: str, *, overlap: str = "3 hours", reach: str = "16 hours", now: Column | None = None) -> DataFrame:
    """Rows of windows that overlap, each key once: rows later than the overlap are dropped with their state, and with ``now``
    those further back than the reach."""
    rows = stream if now is None else stream.where(F.col(time) >= now - F.expr(f"interval {reach}"))
    return rows.withWatermark(time, overlap).dropDuplicatesWithinWatermark(list(key))


def run_upsert(spark: SparkSession, path: str, key: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    target = shared_path(spark, "upsert")
    rows = source(spark, path).select(*key, order, *values)
    query = rows.writeStream.foreachBatch(upsert_sink(f"{target}/table", key, order)).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = read_upserted(spark, f"{target}/table")
    return held.select(*key, order, *values) if held is not None else spark.read.parquet(path).select(*key, order, *values).where("false")


def distinct_sink(target: str, key: Sequence[str]):
    """foreachBatch sink: keys that no earlier batch has brought, by batch, so a batch that runs again writes the same folder.

    What was seen is the table itself, so the stream holds no state, however many keys there are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(list(key))
        held = read_batches(batch.sparkSession, target, before=batch_id)
        if held is not None:
            seen = held.select(*[F.col(k).alias(f"seen_{k}") for k in key])
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"seen_{k}"))
            fresh = fresh.join(seen, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

    return write


def read_batches(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batch folders, or of those before a batch; null where there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in store.listStatus(path)] if store.exists(path) else []
    wanted = [f.toString() for f in folders if before is None or int(f.getName().rpartition("=")[2]) < before]
    return spark.read.parquet(*wanted) if wanted else None


def run_distinct(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    target = shared_path(spark, "distinct")
    rows = source(spark, path).selectExpr(*columns)
    query = rows.writeStream.foreachBatch(distinct_sink(f"{target}/table", rows.columns)).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = read_batches(spark, f"{target}/table")
    return found if found is not None else spark.createDataFrame([], rows.schema)


def run_fresh(spark: SparkSession, fetches: Iterator[DataFrame], key: Sequence[str], time: str, *, overlap: str = "3 hours") -> DataFrame:
    """Fetches of overlapping windows, one run of the stream for each, on one checkpoint: every key once.

    State is kept for the overlap and leaves with the watermark; what comes later than that is dropped, seen before or not.
    """
    target = shared_path(spark, "fresh")
    schema = None
    for number, fetch in enumerate(fetches):
        fetch.write.parquet(f"{target}/fetches/fetch={number:06d}")
        schema = fetch.schema
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{target}/fetches/fetch=*")
        query = fresh_rows(rows, key, time, overlap=overlap).writeStream.format("parquet").option("path", f"{target}/table").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{target}/table")


def run_daily(spark: SparkSession, path: str, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by Seoul day and kind; each batch's totals replace the sink's, which is keyed by day and kind."""
    target = shared_path(spark, "daily")
    day = F.window(time, "1 day", "1 day", "15 hours")  # midnight at UTC+9
    counts = source(spark, path).groupBy(day.alias("w"), kind).agg(F.count("*").alias("calls"))
    flat = counts.select((F.col("w.start") + F.make_dt_interval(F.lit(0), F.lit(9))).cast("date").alias("usage_day"), kind, "calls")
    query = flat.writeStream.outputMode("update").foreachBatch(upsert_sink(f"{target}/table", ["usage_day", kind], "calls")).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = read_upserted(spark, f"{target}/table")
    return held.select("usage_day", kind, "calls") if held is not None else spark.createDataFrame([], flat.schema)


def poll_states(outcomes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keyed cursor state over a stream of run outcomes (ok boolean, run_at timestamp, error string).

    Success moves the cursor and clears failures; failure keeps it and counts up.  State leaves
    when event time is 90 days past the last outcome.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outcomes.schema if f.name in key)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, failures, error = state.get if state.exists else (None, 0, None)
        times = []
        for pdf in batches:
            times += list(pdf["run_at"])
            for row in pdf.sort_values("run_at").itertuples():
                if row.ok:
                    last, failures, error = row.run_at.isoformat(), 0, None
                else:
                    failures, error = failures + 1, row.error
        state.update((last, failures, error))
        newest = max(int(row_time.timestamp() * 1000) for row_time in times)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 90 * 86_400_000)
        yield pd.DataFrame([[*group, last, failures, error]], columns=[*key, "last_successful_run", "consecutive_failures", "last_error"])

    out = f"{schema}, last_successful_run string, consecutive_failures int, last_error string"
    return outcomes.withWatermark("run_at", "1 day").groupBy(*key).applyInPandasWithState(step, out, "last string, failures int, error string", "update", GroupStateTimeout.EventTimeTimeout)
