"""Helpers every operator shares: scope keys, bounded top-n, attaching totals, literals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = ("repo", "snapshot")


def scope_of(*frames: DataFrame) -> list[str]:
    """The corpus keys (repo, snapshot) that all frames carry; every grouping starts with them."""
    return [key for key in SCOPE if all(key in frame.columns for frame in frames)]


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank.

    The rank filter sits directly on the window, so Spark keeps n rows per key and
    task before the shuffle: a hot key never reaches one task whole. Without keys
    the cut is a distributed top-k, and only those n rows are numbered.
    """
    if keys:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(rank, number).where(F.col(rank) <= n)
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def global_rank(df: DataFrame, scope: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows with their place in ``order`` within the scope, without sorting any scope in one task.

    Rows are split into ranges of the order and stored, every range is numbered by itself, and starts
    where the counts of the ranges before it end. Rows that tie in all of ``order`` are numbered in no
    fixed order.
    """
    from .session import materialise

    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *[F.asc(c) for c in scope], *order).withColumn("_range", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    keys = [*scope, "_range"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # At most ``ranges`` entries per scope.
    listed = counts.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("_range", "_n"))).alias("_all"))
    before = F.transform(
        "_all", lambda x: F.struct(x["_range"].alias("_range"), F.aggregate(F.filter("_all", lambda y: y["_range"] < x["_range"]), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("_before"))
    )
    offsets = listed.select(*scope, F.inline(before))
    numbered = placed.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.join(offsets, keys).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as a shuffle has, for narrow rows that cost much time each.

    Files of few bytes come in one task, and AQE joins small partitions; neither looks at the work per row.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: values in the order of ``order``. Only for groups already cut to a few rows."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def attach(df: DataFrame, few: DataFrame, scope: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a frame of a few rows per repo and snapshot: a total, or a top-n with a fixed n.

    Without scope keys the few rows are broadcast; their number is fixed by how they were made.
    """
    if scope:
        return df.join(few, list(scope), how)
    return df.join(F.broadcast(few), F.lit(True), how)


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(key: Column, table: Mapping, default) -> Column:
    """A fixed table as a CASE expression."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rounded(value: Column, digits: int) -> Column:
    """Half up on the decimal value: the first rounding removes the binary tail of sums and products."""
    return F.round(F.round(value, 8), digits)


def r2(value: Column) -> Column:
    return rounded(value, 2)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Add absent optional columns; ``defaults`` maps a name to (type, value)."""
    for name, (kind, value) in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(kind))
    return df
