"""Review events: compact rows, month-partitioned ledger, reader of line files; and the result sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..common import scope_of
from ..operators.ledger import last_events


def build_events(reviews: DataFrame, now: Column) -> DataFrame:
    """One compact event per review: time, mode, type, scores, counts, and concerns with five fields.

    ``reviews``: mode, review_type, scores, summary (concern_total, top_concern_total,
    concern_limit), concerns, artifacts.
    """
    concern = F.transform(
        "concerns",
        lambda c: F.struct(*[c[k].alias(k) for k in ("concern_id", "kind", "level", "confidence", "location")]),
    )
    shown = F.size("concerns").cast("long")

    def total(name: str) -> Column:
        return F.coalesce(F.col(f"summary.{name}").cast("long"), shown)

    counts = F.struct(
        total("concern_total").alias("total"), total("top_concern_total").alias("top"), total("concern_limit").alias("limit")
    )
    blank = F.lit("")
    return reviews.select(
        *scope_of(reviews),
        now.cast("timestamp").alias("generated_at"),
        F.coalesce("mode", blank).alias("mode"),
        F.coalesce("review_type", blank).alias("review_type"),
        "scores",
        counts.alias("concern_counts"),
        concern.alias("top_concerns"),
        "artifacts",
    )


def month_key(generated_at: Column) -> Column:
    return F.date_format(generated_at, "yyyyMM")


def append_events(events: DataFrame, directory: str) -> None:
    """Append events to a ledger partitioned by month."""
    events.withColumn("yyyymm", month_key(F.col("generated_at"))).write.mode("append").partitionBy("yyyymm").parquet(directory)


def read_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """The ledger with an ordinal: time, then mode and type, then a hash of what happened, so that no two differ in nothing but it."""
    rows = spark.read.parquet(directory)
    rest = F.xxhash64(F.to_json(F.struct("scores", "concern_counts", "top_concerns", "artifacts")))
    return rows.withColumn("ord", F.struct(F.unix_micros("generated_at").alias("at"), "mode", "review_type", rest.alias("rest")))


def append_event_lines(events: DataFrame, line: Column, directory: str) -> None:
    """Append events as JSON lines (``line``) in a folder per month, in the order of their time.

    Tasks take ranges of time, so a month with very many events is written by several, and the names
    of a month's files follow its time.
    """
    rows = events.select("generated_at", month_key(F.col("generated_at")).alias("yyyymm"), line.alias("value"))
    ordered = rows.repartitionByRange(F.col("generated_at"), F.col("value")).sortWithinPartitions("yyyymm", "generated_at", "value")
    ordered.select("yyyymm", "value").write.mode("append").partitionBy("yyyymm").text(directory)


def _month_folders(spark: SparkSession, directory: str) -> list[str]:
    """Month folders of a directory, the newest first; their names only, no data."""
    target = spark._jvm.org.apache.hadoop.fs.Path(directory)
    status = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted((f"{directory}/{s.getPath().getName()}" for s in status if s.isDirectory() and s.getPath().getName().startswith("yyyymm=")), reverse=True)


def _event_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("folder"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    # Rows of a block keep their order, so block start and row id order the lines of a file.
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    text = F.trim("value")
    # A shard named with its month sorts before the active file, which has none.
    named = F.coalesce(F.nullif(F.regexp_extract("folder", r"/yyyymm=(\d{6})/[^/]*$", 1), F.lit("")), F.nullif(F.regexp_extract("file", r"-(\d{6})\.", 1), F.lit("")))
    shard = F.coalesce(named, F.lit("999999"))
    parsed = F.from_json(text, schemas.EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(text.startswith("{") & text.endswith("}")).withColumn("e", parsed)
    rows = rows.where(F.col("e.mode").isNotNull() | F.col("e.generated_at").isNotNull())
    in_month = F.when(F.col("folder").contains("/yyyymm="), F.col("file")).otherwise("")
    return rows.select(F.struct(shard.alias("shard"), in_month.alias("file"), F.col("block"), F.col("line")).alias("ord"), "e.*")


def read_review_events(spark: SparkSession, directory: str, limit: int = 100) -> DataFrame:
    """Events of line files in a directory: month shards in order, then the active file, last ``limit``.

    Shards are month folders (``append_event_lines``) or files named with their month. Of month folders
    only the newest are read, as many as hold ``limit`` events; with 0 all are. Blank and malformed lines
    and lines that hold no object are skipped. The ordinal is (shard, file, byte position), so order holds
    however the files are split.
    """
    folders = _month_folders(spark, directory)
    if not folders:
        return last_events(_event_rows(spark, [directory]), limit)
    chosen, held = folders, 0
    if limit > 0:
        for n, folder in enumerate(folders, 1):
            held += _event_rows(spark, [folder]).count()
            if held >= limit:
                chosen = folders[:n]
                break
    return last_events(_event_rows(spark, chosen), limit)


def write_tables(tables: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each result table to its own folder; returns the folders."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{directory.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(out[name])
    return out
