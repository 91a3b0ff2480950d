"""File sinks and sources: formats, partitioned layouts, write modes."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasift.operators.ingest import upsert
from metasift.session import cut_lineage

FORMATS = ("parquet", "csv", "json", "orc", "delta")
COMPRESSIONS = ("snappy", "gzip", "zstd", "none")
# Rough bytes per value, to turn a file size into a row count.
WIDTHS = {"string": 24, "int": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "date": 4, "boolean": 1}


def check_output(fmt: str, compression: str) -> None:
    if fmt not in FORMATS or compression not in COMPRESSIONS:
        raise ValueError(f"unknown format or compression: {fmt}, {compression}")
    if fmt == "csv" and compression == "snappy":
        raise ValueError("csv does not support snappy; use gzip or none")
    if fmt == "delta":
        raise NotImplementedError("the delta format needs its connector on the classpath")


def rows_per_file(schema: T.StructType, max_file_size_mb: int) -> int:
    """Row cap that keeps a file near the given size."""
    if not 16 <= max_file_size_mb <= 2048:
        raise ValueError("max_file_size_mb must be within 16-2048")
    width = sum(WIDTHS.get(f.dataType.simpleString(), 64) for f in schema.fields)
    return max(1, max_file_size_mb * 1024 * 1024 // max(width, 1))


def write(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", mode: str = "append",
          partition_by: list[str] | None = None, max_file_size_mb: int = 256) -> None:
    """Write with the declared format, compression, layout and mode.

    With partition columns the rows are rebalanced on them first; adaptive execution splits
    a partition that holds a large share of the rows, so no task writes it alone.
    """
    check_output(fmt, compression)
    out = df.hint("rebalance", *partition_by) if partition_by else df
    w = out.write.format(fmt).mode(mode).option("compression", compression).option(
        "maxRecordsPerFile", rows_per_file(df.schema, max_file_size_mb))
    if mode == "overwrite" and partition_by:
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read with an explicit schema; nothing is inferred from the data."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_if_there(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """What a path holds, or no rows where there is nothing yet."""
    try:
        return read(spark, path, fmt, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def merge(incoming: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", *, keys: list[str], order: str | None = None,
          partition_by: list[str] | None = None, max_file_size_mb: int = 256) -> None:
    """Fold rows into what ``path`` holds by their keys.

    With partition columns among the keys only the partitions that the incoming rows name are read and replaced: the names reach the scan
    as a pruning filter, and the files of a partition are exchanged when the write commits, so a failed write leaves the old
    rows.  Otherwise the whole table is merged and written to the shared folder first, then over the old one.
    """
    spark = incoming.sparkSession
    incoming = cut_lineage(incoming)
    old = read_if_there(spark, path, fmt, incoming.schema)
    parts = partition_by if partition_by and set(partition_by) <= set(keys) else None
    if parts:
        old = old.join(incoming.select(*parts).distinct(), parts, "left_semi").select(*incoming.columns)
    merged = cut_lineage(upsert(old, incoming, keys, order).select(*incoming.columns))
    try:
        write(merged, path, fmt, compression, "overwrite", partition_by, max_file_size_mb)
    except Exception as e:
        if parts:
            raise
        raise RuntimeError(f"the merged table was not put in place; its rows are whole in {merged.inputFiles()[:1]}") from e


# Widenings that keep every value and that a reader does on the fly: a type and what it may become.
WIDER = {"tinyint": ["smallint", "int", "bigint"], "smallint": ["int", "bigint"], "int": ["bigint", "double"], "float": ["double"], "date": ["timestamp_ntz"]}


def evolved(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both, the old ones first; of two types the wider.  Types that do not widen into each other fail."""
    out, by_name = [], {f.name: f for f in new.fields}
    for f in old.fields:
        g = by_name.pop(f.name, f)
        a, b = f.dataType.simpleString(), g.dataType.simpleString()
        if a != b and b not in WIDER.get(a, []) and a not in WIDER.get(b, []):
            raise ValueError(f"column {f.name} cannot hold {a} and {b}")
        out.append(T.StructField(f.name, g.dataType if b in WIDER.get(a, []) else f.dataType))
    return T.StructType(out + [T.StructField(f.name, f.dataType) for f in new.fields if f.name in by_name])


def sink_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Schema of a table written by :func:`append_drifting`: all schemas it was given, folded together."""
    rows = read_if_there(spark, f"{path}/_schemas", "json", T.StructType.fromDDL("seq long, schema string")).orderBy("seq").collect()  # one per change
    out = None
    for r in rows:
        given = T.StructType.fromJson(json.loads(r["schema"]))
        out = given if out is None else evolved(out, given)
    return out


def append_drifting(df: DataFrame, path: str, action: str = "warn") -> None:
    """Append rows whose columns may differ from the sink's.

    ``fail`` raises.  ``ignore`` keeps the sink's columns and types; what does not fit is null, what is new is left out.  ``warn`` does so too
    and adds the differences to :func:`drift_notes`.  ``evolve`` lets the sink gain columns and wider types: the schema is noted before the
    rows, so a reader never meets a file wider than what it knows, and old files read with nulls.
    """
    if action not in ("warn", "fail", "ignore", "evolve"):
        raise ValueError(f"unknown drift action {action!r}")
    spark, have = df.sparkSession, sink_schema(df.sparkSession, path)

    def note(schema: T.StructType) -> None:
        seq = spark.read.schema("seq long").json(f"{path}/_schemas").count() if have is not None else 0
        spark.createDataFrame([(seq, schema.json())], "seq long, schema string").coalesce(1).write.mode("append").json(f"{path}/_schemas")

    if have is None:
        note(df.schema)
        have = df.schema
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (have, df.schema))
    notes = [(c, "added", None, t) for c, t in new.items() if c not in old] + [
        (c, "removed" if c not in new else "type_changed", t, new.get(c)) for c, t in old.items() if new.get(c) != t]
    if notes and action == "fail":
        raise ValueError(f"columns differ: {notes}")
    if notes and action == "evolve":
        target = evolved(have, df.schema)
        if target != T.StructType([T.StructField(f.name, f.dataType) for f in have.fields]):
            note(target)
        have = target
    if notes and action == "warn":
        spark.createDataFrame(notes, "column string, status string, had string, got string").coalesce(1).write.mode("append").json(f"{path}/_drift")
    write(df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in new else F.lit(None).cast(f.dataType)).alias(f.name) for f in have.fields]), path)


def read_drifting(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table written by :func:`append_drifting`, in its newest schema."""
    return spark.read.schema(sink_schema(spark, path)).parquet(path)


def drift_notes(spark: SparkSession, path: str) -> DataFrame:
    """(column, status, had, got) of every append that differed under ``warn``."""
    return read_if_there(spark, f"{path}/_drift", "json", T.StructType.fromDDL("column string, status string, had string, got string"))


def with_time_parts(df: DataFrame, ts: str) -> DataFrame:
    """year / month / day / hour columns for a time-partitioned layout."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)})
