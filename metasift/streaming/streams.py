"""Structured Streaming operators over event and payload streams.

Sinks are written per micro-batch under their batch number and overwritten on a retry,
so a restarted query gives each batch exactly once.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasift.operators import detect as dt
from metasift.operators import ingest as ig
from metasift.operators import quality as dq
from metasift.sources.files import with_time_parts


def event_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving in a folder; the schema is given, never inferred."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_events(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Stream to a bronze table partitioned by event day."""
    parts = ["year", "month", "day"]
    out = with_time_parts(stream, "ts").drop("hour")
    run_available(out.writeStream.format("parquet").partitionBy(*parts).option("path", sink).outputMode("append"), checkpoint)


def dedup_events(stream: DataFrame, sink: str, checkpoint: str, key: str = "event_id", late: str = "2 hours") -> None:
    """Each event once within the late bound (T02); state is dropped as the watermark passes."""
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    run_available(once.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def batch_sink(path: str, fn, **writer):
    """foreachBatch body that writes ``fn(batch)`` under the batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def tumbling_counts(stream: DataFrame, sink: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours") -> None:
    """Tumbling-window counts and sums, updated windows per batch."""
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
    run_available(flat.writeStream.outputMode("update").foreachBatch(batch_sink(sink, lambda b: b)), checkpoint)


def latest_windows(rows: DataFrame) -> DataFrame:
    """Last update of every window in the sink of :func:`tumbling_counts`."""
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.*")


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of every version written so far; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: The engine's state store: on disk, each batch adding a change file to the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession):
    """Queries started in the block keep their state in :data:`STATE_STORE`."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def incremental_state(stream: DataFrame, checkpoint: str, source: str = "event_type", column: str = "ts") -> None:
    """High-water mark per source, kept across batches and restarts.

    The marks are the state of a streaming aggregate; :func:`current_state` reads them from the checkpoint."""
    marks = stream.groupBy(F.col(source).alias("source")).agg(F.max(column).alias("watermark"))
    with state_store(stream.sparkSession):
        run_available(marks.writeStream.format("noop").outputMode("update"), checkpoint)


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Newest mark per source, from the state data source."""
    with state_store(spark):
        state = spark.read.format("statestore").load(checkpoint)
    key, value = (F.col(c)[state.schema[c].dataType[0].name] for c in ("key", "value"))
    return state.select(key.alias("source"), value.alias("watermark"))


def late_split(stream: DataFrame, sink: str, late_sink: str, checkpoint: str, lateness_minutes: int) -> None:
    """Rows older than the watermark of the batches before go to the dead letter.

    The mark is the engine's own event-time watermark, the highest ``ts`` so far less the lateness, in milliseconds.  It is part of what the
    engine logs for each batch before it runs, so a retried or restarted batch splits alike; one small file is read a batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        floor = F.timestamp_millis(F.lit(logged_watermark(batch.sparkSession, checkpoint, batch_id)))
        rows = batch.withColumn("_late", F.coalesce(F.col("_at") < floor, F.lit(False))).drop("_at")
        rows.where("not _late").drop("_late").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{late_sink}/batch={batch_id}")

    marked = stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", f"{lateness_minutes} minutes")
    run_available(marked.writeStream.foreachBatch(step), checkpoint)


def logged_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """Event-time watermark of a batch, in milliseconds, from the query's offset log."""
    mark = F.get_json_object("value", "$.batchWatermarkMs").cast("long")
    return spark.read.text(f"{checkpoint}/offsets/{batch_id}").select(F.max(mark)).first()[0] or 0


BUCKETS = 64


def cdc_upsert(stream: DataFrame, table: str, checkpoint: str, keys: list[str], lsn: str, delete: str, buckets: int = BUCKETS) -> None:
    """Micro-batch upsert: the newest change by ``lsn`` per key stays, whenever it arrives.

    The table lies in hash buckets of the key.  A batch rewrites only the buckets it touches,
    each as a new version made from the one before, so a retry gives the same files.  Beside
    the table lies, per batch, which version of each bucket counts; a batch reads just those
    folders.  Deletes stay as tombstones, which keeps a late change from reviving a key.
    """
    cols = [f.name for f in stream.schema.fields]
    ddl = table_schema(stream)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = versions(spark, table, batch_id - 1)
        changes = batch.withColumns({"_op": F.when(F.expr(delete), "D").otherwise("U"), "bucket": bucket})
        touched = [r[0] for r in changes.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = read_buckets(spark, table, ddl, {k: v for k, v in counts.items() if k in touched})
            both = old.select(*cols, "_op", "bucket", F.lit(0).alias("_new")).unionByName(changes.select(*cols, "_op", "bucket", F.lit(1).alias("_new")))
            now = ig.latest_per_key(both, [*keys, "bucket"], F.struct(lsn, "_new")).drop("_new")
            now.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{table}/data")
        counts |= dict.fromkeys(touched, batch_id)
        rows = spark.createDataFrame(sorted(counts.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{table}/versions/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(step), checkpoint)


def table_schema(rows: DataFrame) -> str:
    """Schema of the files of :func:`cdc_upsert`."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _op string, bucket int, batch int"


def versions(spark: SparkSession, table: str, batch_id: int | None = None) -> dict[int, int]:
    """The batch that wrote the current version of each bucket, after ``batch_id`` or the last batch."""
    rows = read_versions(spark, f"{table}/versions", "bucket int, version int, batch int")
    last = rows.agg(F.max("batch")).first()[0] if batch_id is None else batch_id
    return {r["bucket"]: r["version"] for r in rows.where(F.col("batch") == last).collect()}  # at most ``buckets`` numbers


def read_buckets(spark: SparkSession, table: str, schema: str, counts: dict[int, int]) -> DataFrame:
    """Rows of the given version of each bucket; no other folder is read."""
    which = F.lit(False)
    for bucket, batch in counts.items():
        which = which | ((F.col("bucket") == bucket) & (F.col("batch") == batch))
    return read_versions(spark, f"{table}/data", schema).where(which)


def current_table(spark: SparkSession, table: str) -> DataFrame:
    """Live rows of a table written by :func:`cdc_upsert`."""
    rows = spark.read.parquet(f"{table}/data")
    which = F.lit(False)
    for bucket, batch in versions(spark, table).items():
        which = which | ((F.col("bucket") == bucket) & (F.col("batch") == batch))
    return rows.where(which & (F.col("_op") != "D")).drop("_op", "bucket", "batch")


def quarantine(stream: DataFrame, clean: str, held: str, checkpoint: str, checks: list[dq.Check]) -> None:
    """Clean and quarantined rows of every batch from one pass of checks."""
    def step(batch: DataFrame, batch_id: int) -> None:
        good, bad = dq.actions_split(batch, checks)
        good.write.mode("overwrite").parquet(f"{clean}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(step), checkpoint)


def detect_payloads(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str) -> None:
    """Detection over arriving payload files, stateless."""
    stream = spark.readStream.schema(schema).json(path)
    hits = [dt.tagged(c, dt.category_hits(c)) for c in dt.CATEGORIES]
    out = dt.with_text(stream).select("payload_id", F.explode(F.concat(*hits)).alias("h")).select("payload_id", "h.*")
    run_available(out.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def monitor(stream: DataFrame, table: str, sink: str, checkpoint: str, checks: list[dq.Check], types: list[str], column: str = "event_type") -> None:
    """Write the stream to ``table``; rows and breaches per batch and event type, taken while writing, go to ``sink``.

    ``types`` are the event types told apart; all others, and missing ones, count as ``other``.  Nothing is aggregated apart from the write."""
    known = [*types, None]

    def of(kind: str | None) -> Column:
        return F.col(column) == kind if kind is not None else ~F.coalesce(F.col(column).isin(types), F.lit(False))

    counts = {}
    for i, kind in enumerate(known):
        counts[f"rows_{i}"] = F.count_if(of(kind))
        for j, c in enumerate(checks):
            counts[f"breach_{i}_{j}"] = F.count_if(of(kind) & F.coalesce(c.fails, F.lit(False)))
    ddl = f"{column} string, rows long" + "".join(f", {c.key}_{c.column} long" for c in checks)

    def step(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        m = seen.get
        rows = [(kind or "other", m[f"rows_{i}"], *[m[f"breach_{i}_{j}"] for j in range(len(checks))]) for i, kind in enumerate(known) if m[f"rows_{i}"]]
        batch.sparkSession.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_available(stream.writeStream.foreachBatch(step), checkpoint)
