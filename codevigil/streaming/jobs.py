"""Structured Streaming jobs over append-only inputs: ledger, trend, registry, extraction, duplicates.

Tables that a job keeps are folders with one part per batch id. A batch that runs
again after a failure overwrites its own part, so every job is idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..common import scope_of, top_per, with_defaults
from ..operators.duplicates import near_duplicates
from ..sources.events import month_key
from ..sources.extract import incremental_extract
from .index import BUCKETS, FAN, LevelIndex, newest


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stream_ledger(events: DataFrame, directory: str, checkpoint: str, id_col: str | None = None) -> StreamingQuery:
    """Append review events to a month-partitioned ledger.

    With ``id_col`` an event whose id the ledger's month already holds is not written again;
    of repeats in one batch the first by time stays. Late events are kept however late they
    are, and so are events without id. Only the months of the batch are read.
    """
    if id_col:
        keys = [*scope_of(events), "yyyymm", id_col]

        def step(batch: DataFrame, batch_id: int) -> None:
            rows = batch.withColumns({"yyyymm": month_key(F.col("generated_at")), "part_id": F.lit(batch_id)})
            known = batch.sparkSession.read.schema(rows.schema)
            named = rows.where(F.col(id_col).isNotNull())
            fresh = top_per(named, keys, [F.asc("generated_at"), F.xxhash64(*events.columns)], 1).drop("rank")
            if _exists(batch.sparkSession, directory):
                months = rows.select("yyyymm").distinct()
                earlier = known.parquet(directory).where(F.col("part_id") < batch_id).join(months, "yyyymm", "left_semi")
                fresh = fresh.join(earlier.select(*keys), keys, "left_anti")
            fresh = fresh.select(rows.columns).unionByName(rows.where(F.col(id_col).isNull()))
            writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("yyyymm", "part_id").parquet(directory)

        return (
            events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
        )
    rows = events
    return (
        rows.withColumn("yyyymm", month_key(F.col("generated_at")))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("yyyymm")
        .trigger(availableNow=True)
        .start(directory)
    )


def _write_part(directory: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{directory}/part_id={batch_id}")

    return write


def latest_rows(spark: SparkSession, directory: str, keys: list[str]) -> DataFrame:
    """Current row per key of a table whose parts hold changed rows only."""
    rows = spark.read.parquet(directory)
    fields = [c for c in rows.columns if c not in (*keys, "part_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "part_id").alias("r")).select(*keys, "r.*")


def stream_trend(events: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """Running counts by mode, review type and path, and the latest full review; read with ``latest_rows``.

    State is one row per (facet, key). ``events``: ord, generated_at, mode, review_type, path, kind, overall.
    """
    scope = scope_of(events)
    full = (F.col("mode") == "code_review") & (F.col("review_type") == "full")

    def entry(facet: str, key: Column, when: Column | None = None) -> Column:
        value = F.struct(F.lit(facet).alias("facet"), F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown")).alias("key"))
        return value if when is None else F.when(when, value)

    facets = F.array_compact(
        F.array(
            entry("mode", F.col("mode")),
            entry("review_type", F.col("review_type")),
            entry("path", F.col("path"), F.coalesce("path", F.lit("")) != ""),
            entry("latest_full", F.lit("all"), full),
            entry("latest", F.lit("all")),
        )
    )
    rows = events.select(*scope, "ord", "generated_at", "review_type", "kind", "overall", F.inline(facets))
    state = rows.groupBy(*scope, "facet", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("generated_at", "review_type", "overall"), "ord").alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("facet") == "path", F.col("kind")))).alias("kinds"),
    )
    return (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_write_part(directory))
        .trigger(availableNow=True)
        .start()
    )


# --- registry -----------------------------------------------------------------------

#: Points of a component that are kept and shown.
KEEP = 20
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Registry(StatefulProcessor):
    """The last points of a component as list state in run order; a late run takes its place among them."""

    def __init__(self, names: list[str], ttl_ms: int | None):
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "run timestamp, score double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = [(pd.Timestamp(run), score) for run, score in self.points.get()]
        for frame in rows:
            points += [(pd.Timestamp(run), float(score)) for run, score in zip(frame["run"], frame["score"])]
            points = sorted(dict(sorted(points)).items())[-KEEP:]  # of several scores of a run the highest stays
        self.points.put([(run.to_pydatetime(), score) for run, score in points])
        score = points[-1][1]
        before = points[-2][1] if len(points) > 1 else score
        trend = "up" if score > before + 1.0 else "down" if score < before - 1.0 else "flat"
        place = {name: [value] for name, value in zip(self.names, key)}
        yield pd.DataFrame({**place, "last_score": [score], "trend": [trend], "history": [json.dumps([(str(run), s) for run, s in points])]})

    def close(self) -> None:
        pass


def stream_registry(scores: DataFrame, directory: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Last score, trend and last ``KEEP`` points per component of a repo and snapshot, carried from batch to batch.

    ``scores``: component, run, score. Points stand in the order of their runs whenever they come: a run
    that comes late takes its place, and is forgotten only if ``KEEP`` later ones are known. Of scores
    for one run the highest counts. Scores without run or value are no points. With ``ttl_ms`` points
    are dropped that long after the component's last update; a run of the stream is then one batch, since with
    state that expires Spark would go on looking for expired rows.
    """
    keys = [*scope_of(scores), "component"]
    rows = scores.select(*keys, F.col("run").cast("timestamp").alias("run"), F.col("score").cast("double").alias("score")).where("run is not null and score is not null")
    place = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{place}, last_score double, trend string, history string"
    state = rows.groupBy(*keys).transformWithStateInPandas(_Registry(keys, ttl_ms), out, "update", "ProcessingTime" if ttl_ms else "None")
    conf = scores.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # list state needs this store; a query keeps the one that it started with
    try:
        return (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(_write_part(directory))
            .trigger(**({"once": True} if ttl_ms else {"availableNow": True}))
            .start()
        )
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


# --- extraction and duplicates ----------------------------------------------------------


def stream_extract(
    files: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    directory: str,
    checkpoint: str,
    version: int = 1,
    buckets: int = BUCKETS,
    fan: int = FAN,
) -> StreamingQuery:
    """Extract files (path, text, bytes, mtime) once; a file that comes again is extracted only if it changed.

    Parts hold the rows of the files a batch extracted; the marks of files lie in an index by path,
    of which a batch reads the buckets of its own paths. The current rows of a path are those of its
    last part (``current_rows``). A path belongs to its repo and snapshot. Of versions with one time
    in one batch the longer stays, then the one of larger hash.
    """
    key = [*scope_of(files), "path"]
    mark = files.select(*key, "bytes", "mtime").withColumn("version", F.lit(version)).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        index = LevelIndex(batch.sparkSession, f"{directory}/manifest", mark, key, buckets, fan)
        latest = F.max_by(F.struct("text", "bytes", "mtime"), F.struct("mtime", "bytes", F.xxhash64("text")))
        last = batch.groupBy(*key).agg(latest.alias("f")).select(*key, "f.*")
        seen = newest(key)(index.lookup(last, batch_id)).where(F.col("version") == version)
        fresh = last.join(seen, [*key, "bytes", "mtime"], "left_anti")
        rows, manifest, _ = incremental_extract(fresh, extract, None, None, version)
        rows.select("*", F.lit(batch_id).cast("long").alias("part_no")).write.mode("overwrite").parquet(f"{directory}/rows/part_id={batch_id}")
        index.add(manifest, batch_id, newest(key))

    return (
        files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    )


def current_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of the last extraction of every path."""
    index = LevelIndex.stored(spark, f"{directory}/manifest")
    last = index.rows().groupBy(*index.keys).agg(F.max("part_no").alias("part_no"))
    return spark.read.parquet(f"{directory}/rows").join(last, [*index.keys, "part_no"], "left_semi").drop("part_no", "part_id")


FUNCTION_FIELDS = ["path", "line", "symbol", "fingerprint", "node_count", "thin_wrapper_call"]


def stream_duplicates(functions: DataFrame, directory: str, checkpoint: str, buckets: int = BUCKETS, fan: int = FAN) -> StreamingQuery:
    """Match each batch of functions with the stored index, write its concerns, then add it to the index.

    The batch is the change scope. The index lies in buckets by fingerprint, with a second one by
    path that knows the last batch of every path: of a path only the functions of that batch count.
    A batch reads the buckets of its fingerprints, and those of the paths it finds there.
    """
    scope = scope_of(functions)
    shaped = with_defaults(functions, thin_wrapper_call=("string", "")).select(*scope, *FUNCTION_FIELDS)
    path = [*scope, "path"]
    schema, path_schema = shaped.schema, shaped.select(*path).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = LevelIndex(spark, f"{directory}/index", schema, [*scope, "fingerprint"], buckets, fan)
        paths = LevelIndex(spark, f"{directory}/paths", path_schema, path, buckets, fan)
        fresh = batch.select(*path).distinct()
        # A path that comes again replaces its earlier functions.
        known = index.lookup(batch, batch_id).join(fresh, path, "left_anti")
        last = paths.lookup(known.select(*path), batch_id).groupBy(*path).agg(F.max("part_no").alias("part_no"))
        known = known.join(last, [*path, "part_no"], "left_semi").drop("part_no")
        concerns = near_duplicates(batch.unionByName(known), fresh)
        concerns.write.mode("overwrite").parquet(f"{directory}/concerns/part_id={batch_id}")
        paths.add(fresh, batch_id, lambda rows: rows.groupBy(*path).agg(F.max("part_no").alias("part_no")))

        def current(rows: DataFrame) -> DataFrame:
            last = paths.rows(batch_id + 1).groupBy(*path).agg(F.max("part_no").alias("part_no"))
            return rows.join(last, [*path, "part_no"], "left_semi").select(rows.columns)

        index.add(batch, batch_id, current)

    return (
        shaped.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    )
