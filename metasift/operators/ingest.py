"""Declarative ingestion: filters, projections, watermarks, change capture, schema drift."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META_TIME = "2024-01-01 00:00:00"


@dataclass(frozen=True)
class ExtractSpec:
    """Filter block of an ingestion spec."""

    where: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    row_limit: int | None = None
    order_by: list[str] = field(default_factory=list)
    sample_percent: float | None = None
    sample_key: str | None = None
    source_type: str = "unknown"
    job_id: str = ""
    add_metadata: bool = True
    ingested_at: str | None = None

    def __post_init__(self):
        overlap = set(self.include) & set(self.exclude)
        if overlap:
            raise ValueError(f"columns both included and excluded: {sorted(overlap)}")
        if self.row_limit and self.sample_percent:
            raise ValueError("use row_limit or sample_percent, not both")


def where(df: DataFrame, clause: str | None) -> DataFrame:
    """Row predicate given as SQL text; an unresolvable clause fails analysis."""
    return df.where(F.expr(clause)) if clause else df


def project(df: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Whitelist (empty means all) minus blacklist."""
    if set(include) & set(exclude):
        raise ValueError("a column cannot be both included and excluded")
    keep = [c for c in (include or df.columns) if c not in exclude]
    return df.select(*keep)


def limit_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """Hard cap in a fixed order; plans as a top-k, not a full sort."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def sample(df: DataFrame, percent: float, key: str | None = None, seed: int | None = None) -> DataFrame:
    """Percentage sample; by the MD5 of a key, as text, it is repeatable in any engine (P19).  A null key is not drawn."""
    if key is None:
        return df.sample(fraction=percent / 100, seed=seed)
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10000 < F.lit(percent * 100))


def add_metadata(df: DataFrame, source_type: str, job_id: str, ingested_at: str | None = None) -> DataFrame:
    """Bookkeeping columns (P20)."""
    at = F.lit(ingested_at).cast("timestamp_ntz") if ingested_at else F.current_timestamp()
    return df.withColumns({"_ingested_at": at, "_source_type": F.lit(source_type), "_job_id": F.lit(job_id)})


def full_load(df: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Filter, project, cap or sample, then metadata."""
    out = project(where(df, spec.where), spec.include, spec.exclude)
    if spec.row_limit:
        out = limit_rows(out, spec.row_limit, spec.order_by)
    if spec.sample_percent:
        out = sample(out, spec.sample_percent, spec.sample_key)
    return add_metadata(out, spec.source_type, spec.job_id, spec.ingested_at) if spec.add_metadata else out


def watermark_literal(value: str, kind: str) -> Column:
    """Stored watermark text as a typed literal; timestamp, date or integer."""
    types = {"timestamp": "timestamp_ntz", "date": "date", "integer": "bigint"}
    if kind not in types:
        raise ValueError(f"unknown watermark type {kind!r}")
    return F.lit(value).cast(types[kind])


def incremental(df: DataFrame, column: str, last: str | None, kind: str = "timestamp", lookback_minutes: int = 0,
                upper: str | None = None) -> DataFrame:
    """Rows past the watermark, less the lookback, up to an optional bound.

    Bounds are literals of the column's type, so the filter reaches the scan.
    """
    out = df
    if last is not None:
        low = watermark_literal(last, kind)
        if lookback_minutes and kind == "timestamp":
            low = low - F.make_interval(mins=F.lit(lookback_minutes))
        out = out.where(F.col(column) > low)
    if upper is not None:
        out = out.where(F.col(column) <= watermark_literal(upper, kind))
    return out


def next_watermark(state: DataFrame, batch: DataFrame, source: str, column: str) -> DataFrame:
    """State table ``(source, watermark)`` after a batch; sources without rows keep theirs."""
    new = batch.groupBy(F.col(source).alias("source")).agg(F.max(column).alias("watermark"))
    return state.select("source", "watermark").unionByName(new).groupBy("source").agg(
        F.max("watermark").alias("watermark"))


def hybrid_incremental(df: DataFrame, modified: str, after: str, event: str, after_event: str) -> DataFrame:
    """Rows changed by either clock."""
    return df.where((F.col(modified) > watermark_literal(after, "timestamp"))
                    | (F.col(event) > watermark_literal(after_event, "timestamp")))


def cdc_query_based(df: DataFrame, created: str, updated: str, last: str) -> DataFrame:
    """Rows touched since the last run, tagged insert or update."""
    w = watermark_literal(last, "timestamp")
    return df.where((F.col(created) > w) | (F.col(updated) > w)).withColumn(
        "_op", F.when(F.col(created) > w, "I").otherwise("U"))


def cdc_soft_delete(df: DataFrame, deleted: str, include_deletes: bool = True) -> DataFrame:
    """Tag soft-deleted rows, or drop them."""
    tagged = df.withColumn("_op", F.when(F.col(deleted).isNotNull(), "D").otherwise("U"))
    return tagged if include_deletes else tagged.where("_op <> 'D'")


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Newest row per key; ``max_by`` combines before the shuffle, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    known = F.struct(order.isNotNull(), order)  # a row without an order loses, but stands if it is alone
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), known).alias("r")).select(*keys, "r.*")


def cdc_log_based(df: DataFrame, keys: list[str], lsn: str, last: int) -> DataFrame:
    """Newest change per key past the last sequence number."""
    return latest_per_key(df.where(F.col(lsn) > F.lit(last)), keys, F.col(lsn))


def cdc_apply(current: DataFrame, changes: DataFrame, keys: list[str], lsn: str, op: str = "_op") -> DataFrame:
    """Fold changes into current state: the newest sequence wins, a change before the state at a tie; deletes vanish.

    State and changes meet in one grouping, a single shuffle without a join.
    """
    both = current.withColumn(op, F.lit("K")).unionByName(changes.select(*current.columns, op))
    rank = F.struct(F.col(lsn), F.col(op) != "K")
    return latest_per_key(both, keys, rank).where(F.col(op) != "D").drop(op)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows replace existing ones with their key, others stay.

    Of several incoming rows of one key the last by ``order`` counts, or the greatest row without one.
    """
    rest = [c for c in incoming.columns if c not in keys]
    incoming = latest_per_key(incoming, keys, F.col(order) if order else F.struct(*rest)).select(*incoming.columns) if rest else incoming.distinct()
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def split_points(df: DataFrame, parts: int, key: str, accuracy: int = 10_000) -> list:
    """At most ``parts - 1`` rising values that part the keys evenly, from a quantile sketch."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(key, shares, accuracy)).first()[0]
    return sorted(set(found or []))


def key_ranges(points: list, key: str) -> list[Column]:
    """Disjoint predicates that together hold for every row: below the first point, between points, from the last on; nulls go first."""
    c = F.col(key)
    if not points:
        return [F.lit(True)]
    cuts = [F.lit(p) for p in points]
    return [(c < cuts[0]) | c.isNull(), *[(c >= a) & (c < b) for a, b in zip(cuts, cuts[1:])], c >= cuts[-1]]


def partitioned_extract(df: DataFrame, parallelism: int, key: str) -> list[DataFrame]:
    """The rows in parts of about equal size by ranges of a numeric or time key.

    Split points come from one sketch over the key; each part is a range predicate that reaches the scan, so parts are read on their own,
    retried on their own, and nothing is shuffled.  A key that holds more than a part's share is one part.
    """
    return [df.where(p) for p in key_ranges(split_points(df, parallelism, key), key)]


def jdbc_partition_options(column: str, low: int, high: int, parallelism: int, batch_size: int) -> dict[str, str]:
    """Reader options of a partitioned JDBC extract."""
    if not 1 <= parallelism <= 32 or not 100 <= batch_size <= 5_000_000:
        raise ValueError("parallelism must be 1-32 and batch_size 100-5000000")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(parallelism), "fetchsize": str(batch_size)}


def observed_schema(records: DataFrame, doc: str) -> DataFrame:
    """Fields and value types seen in JSON records, with their counts.

    Counted per (field, type) with map-side combining; the result is as small as the schema.
    """
    members = F.try_variant_get(F.try_parse_json(F.col(doc)), "$", "map<string,variant>")
    typed = F.transform(F.map_entries(members), lambda e: F.struct(
        e["key"].alias("field"), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0).alias("dtype")))
    return records.select(F.explode(typed).alias("f")).where("f.dtype <> 'VOID'").groupBy("f.field", "f.dtype").agg(
        F.count("*").alias("n"))


def schema_drift(records: DataFrame, doc: str, expected: dict[str, str], action: str = "warn") -> DataFrame:
    """added / removed / type_changed fields of delivered records against a schema."""
    if action not in ("warn", "fail", "ignore", "evolve"):
        raise ValueError(f"unknown drift action {action!r}")
    spark = records.sparkSession
    want = spark.createDataFrame(list(expected.items()), "field string, expected string")
    j = observed_schema(records, doc).join(want, "field", "full_outer")
    status = (F.when(F.col("expected").isNull(), "added").when(F.col("dtype").isNull(), "removed")
              .when(F.col("dtype") != F.col("expected"), "type_changed").otherwise("same"))
    return j.select("field", "expected", "dtype", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"),
                    F.lit(action).alias("action"))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union that lets columns come and go."""
    return old.unionByName(new, allowMissingColumns=True)


def map_schema(df: DataFrame, renames: dict[str, str], types: dict[str, str]) -> DataFrame:
    """Rename, then cast; values that do not fit become null."""
    out = df.withColumnsRenamed(renames)
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def dead_letter_split(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows for the error sink."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)
