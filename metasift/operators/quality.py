"""Data-quality checks as expressions: one scan answers any number of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A row check: ``fails`` is true for a failing row (null counts as passing)."""

    key: str
    column: str
    fails: Column
    severity: str = "reject"


def not_null(c: str, **kw) -> Check:
    return Check("not_null", c, F.col(c).isNull(), **kw)


def between(c: str, low, high, **kw) -> Check:
    return Check("between", c, ~F.col(c).between(low, high), **kw)


def matches(c: str, pattern: str, **kw) -> Check:
    return Check("regex", c, ~F.col(c).rlike(pattern), **kw)


def in_set(c: str, values: list, **kw) -> Check:
    return Check("in_set", c, ~F.col(c).isin(*values), **kw)


def not_in_set(c: str, values: list, **kw) -> Check:
    return Check("not_in_set", c, F.col(c).isin(*values), **kw)


def pair_equal(a: str, b: str, **kw) -> Check:
    return Check("pair_equal", f"{a},{b}", ~F.col(a).eqNullSafe(F.col(b)), **kw)


def sum_equals(cols: list[str], target: Column, tolerance: float = 1e-6, **kw) -> Check:
    total = reduce(lambda x, y: x + y, [F.col(c) for c in cols])
    return Check("multicolumn_sum", ",".join(cols), F.abs(total - target) > tolerance, **kw)


def of_type(c: str, dtype: str, **kw) -> Check:
    return Check("type", c, F.col(c).try_cast(dtype).isNull() & F.col(c).isNotNull(), **kw)


def date_range(c: str, low: str, high: str, **kw) -> Check:
    return Check("date_range", c, ~F.col(c).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")), **kw)


def custom_sql(name: str, expr: str, **kw) -> Check:
    """An expression that is true for bad rows."""
    return Check("custom_sql", name, F.expr(expr), **kw)


def scorecard(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_key, column, total, failing, pass) for all checks from one aggregation (Q22)."""
    totals = df.agg(F.count("*").alias("total"), *[F.count_if(c.fails).alias(f"f{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.key).alias("check_key"), F.lit(c.column).alias("column"),
                              F.col(f"f{i}").alias("failing")) for i, c in enumerate(checks)])
    return totals.select("total", F.explode(rows).alias("r")).select(
        "r.check_key", "r.column", "total", "r.failing", (F.col("r.failing") == 0).alias("pass"))


def result(df: DataFrame, key: str, column: str, total: Column, failing: Column) -> DataFrame:
    """One-row check result from aggregate expressions."""
    return df.agg(total.cast("bigint").alias("total"), failing.cast("bigint").alias("failing")).select(
        F.lit(key).alias("check_key"), F.lit(column).alias("column"), "total", "failing", (F.col("failing") == 0).alias("pass"))


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    return df.where(check.fails)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys; counts combine before the shuffle (Q02)."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return result(n, "unique", ",".join(keys), F.sum("n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row copies beyond the first (Q16)."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return result(n, "duplicate_rows", "*", F.sum("n"), F.sum(F.col("n") - 1))


def row_count_between(df: DataFrame, low: int, high: int) -> DataFrame:
    """Q06"""
    n = F.count("*")
    return result(df, "row_count_between", "*", n, F.when(n.between(low, high), 0).otherwise(1))


def statistic_between(df: DataFrame, column: str, stat: str, low: float, high: float) -> DataFrame:
    """Mean or standard deviation within bounds (Q07)."""
    fn = F.avg if stat == "mean" else F.stddev_samp
    return df.agg(F.round(fn(column), 4).alias("value")).select(
        F.lit(f"{stat}_between").alias("check_key"), F.lit(column).alias("column"), "value",
        F.col("value").between(low, high).alias("pass"))


def sum_assertion(df: DataFrame, column: str, at_least: float) -> DataFrame:
    """Sum compared with a constant (Q12)."""
    return df.agg(F.round(F.sum(column), 2).alias("value")).select(
        F.lit("sum_assertion").alias("check_key"), F.lit(column).alias("column"), "value",
        (F.col("value") >= at_least).alias("pass"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False, error: float = 0.02) -> DataFrame:
    """Distinct values, exact or by sketch (Q13)."""
    n = F.approx_count_distinct(column, error) if approximate else F.countDistinct(column)
    return df.agg(F.count("*").alias("total"), n.alias("distinct_values")).select(
        F.lit("distinct_count").alias("check_key"), F.lit(column).alias("column"), "total", "distinct_values")


def distinct_sketches(df: DataFrame, column: str, by: list[str], log2_registers: int = 14) -> DataFrame:
    """One mergeable sketch of a column's distinct values per batch or partition ``by``, with its row count (Q13).

    A sketch is a few KB whatever the rows; sketches of new batches are stored beside the old ones."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.hll_sketch_agg(column, log2_registers).alias("sketch"))


def merged_distinct(sketches: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values over all stored sketches, or per ``by``, without the rows; null counts as no value."""
    return sketches.groupBy(*(by or [])).agg(F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values")).select(
        *(by or []), F.lit("distinct_count").alias("check_key"), F.lit(column).alias("column"), "total", "distinct_values")


def referential(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows without a parent (Q14).

    Child keys are counted first, so a key with very many rows joins as one row.
    """
    n = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias(key), F.lit(1).alias("known")).distinct()
    j = n.join(p, key, "left")
    return result(j, "referential", key, F.coalesce(F.sum("n"), F.lit(0)),
                  F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)))


def freshness(df: DataFrame, column: str, now: str, max_hours: int) -> DataFrame:
    """Age of the newest row against a limit (Q15)."""
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 3600)
    return df.agg(F.max(column).alias("newest")).select(
        F.lit("freshness").alias("check_key"), F.lit(column).alias("column"), age.cast("bigint").alias("age_hours"),
        (age <= max_hours).alias("pass"))


def not_empty(df: DataFrame, column: str) -> DataFrame:
    """At least one value (Q17)."""
    return result(df, "not_empty", column, F.count("*"), F.when(F.count(column) > 0, 0).otherwise(1))


def completeness(df: DataFrame, column: str, threshold: float = 0.98) -> DataFrame:
    """Share of non-null values (Q19)."""
    return df.agg(F.round(F.avg(F.when(F.col(column).isNotNull(), 1.0).otherwise(0.0)), 6).alias("ratio")).select(
        F.lit("completeness").alias("check_key"), F.lit(column).alias("column"), "ratio",
        (F.col("ratio") > threshold).alias("pass"))


def columns_match(records: DataFrame, doc: str, expected: list[str]) -> DataFrame:
    """Records whose ordered field list differs from the expected one (Q11)."""
    got = F.json_object_keys(F.col(doc))
    want = F.array(*[F.lit(c) for c in expected])
    return result(records, "columns_match", ",".join(expected), F.count("*"), F.count_if(~got.eqNullSafe(want)))


def violations(checks: list[Check]) -> Column:
    """Codes ``severity:key:column`` of the checks a row fails, all in one expression."""
    return F.array_compact(F.array(*[F.when(c.fails, F.lit(f"{c.severity}:{c.key}:{c.column}")) for c in checks]))


def actions_split(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """Clean rows (warnings kept beside them) and quarantined rows with their codes (Q21).

    ``drop`` rows appear in neither; ``quarantine`` and ``reject`` rows go to quarantine.
    """
    tagged = df.withColumn("codes", violations(checks))
    dropped = F.exists("codes", lambda c: c.startswith("drop:"))
    held = F.exists("codes", lambda c: c.startswith("quarantine:") | c.startswith("reject:"))
    return tagged.where(~dropped & ~held), tagged.where(held & ~dropped)
