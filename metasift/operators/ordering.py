"""Dense positions within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metasift.session import cut_lineage


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """1-based positions by range partitioning: a group may span any number of tasks; null keys are a group.

    Rows are range-partitioned and sorted on (keys, order); a row's place is its offset
    in its partition plus the group's counts in earlier partitions, of which there is one
    per partition.  ``partitions`` sizes the sort; the session's shuffle width by default.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(
        df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_rid", F.monotonically_increasing_id()))
    rows = rows.withColumn("_pid", F.shiftright("_rid", 33))
    per = rows.groupBy(*keys, "_pid").agg(F.min("_rid").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    per = per.select(*[F.col(k).alias(c) for k, c in named.items()], F.col("_pid").alias("_part"), "_first", "_off")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(c)) for k, c in named.items()], F.col("_pid") == F.col("_part"))
    return rows.join(per, same).withColumn(
        out, (F.col("_rid") - F.col("_first") + F.col("_off") + 1).cast("int")).drop("_rid", "_pid", "_part", "_first", "_off", *named.values())


#: Rows of a group that one task sorts; with larger groups all are ranked by :func:`positions`.
GROUP_ROWS = 100_000


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """:func:`positions` by a window where every group is small, without sampling and sorting the whole table."""
    rows = cut_lineage(df)
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if most is not None and most > GROUP_ROWS:
        return positions(rows, keys, order, out)
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def fragments(tokens: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One text ``(key, text)`` from the ordered tokens of every key in ``tokens(key, token, *order)``.

    A text is one value of one report, so its tokens meet in one row by definition; they
    arrive combined per task.
    """
    rest = [c for c in order if c != "token"]
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest, "token"))).alias("l")).select(
        key, F.array_join(F.col("l.token"), "").alias("text"))
