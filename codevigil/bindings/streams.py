"""Streaming jobs over files that Spark writes from the driver tables; each table arrives in drops."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import extract as B
from ..streaming import jobs as J
from . import register
from .duplicates import NORM
from .extraction import sources
from .ranking import _RUNS, runs


def _workspace(t, name):
    return f"{shared_dir(t.spark)}/codevigil/{name}-{uuid.uuid4().hex}"


def in_drops(t, df, drop, work, start):
    """Write ``df`` drop by drop (column expression 0..2) and run the stream to its end after each."""
    for i in range(3):
        df.where(drop == i).write.mode("append").parquet(f"{work}/input")
        stream = t.spark.readStream.schema(df.schema).parquet(f"{work}/input")
        start(stream).awaitTermination()


@register(
    "stream_ledger",
    "SELECT strftime(generated_at, '%Y%m') AS yyyymm, mode, count(*) AS n FROM v_events GROUP BY ALL",
)
def stream_ledger(t):
    work = _workspace(t, "ledger")
    events = t.v_events
    in_drops(t, events, F.col("ord") % 3, work, lambda s: J.stream_ledger(s, f"{work}/ledger", f"{work}/checkpoint"))
    ledger = t.spark.read.parquet(f"{work}/ledger")
    return ledger.groupBy(F.col("yyyymm").cast("string").alias("yyyymm"), "mode").agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_trend",
    """SELECT 'mode' AS facet, mode AS key, count(*) AS n FROM v_events GROUP BY mode UNION ALL SELECT 'review_type', review_type, count(*) FROM v_events GROUP BY review_type
    UNION ALL SELECT 'path', path, count(*) FROM v_events GROUP BY path UNION ALL SELECT 'latest', 'all', count(*) FROM v_events
    UNION ALL SELECT 'latest_full', 'all', count(*) FROM v_events WHERE mode = 'code_review' AND review_type = 'full'""",
)
def stream_trend(t):
    work = _workspace(t, "trend")
    in_drops(t, t.v_events, F.col("ord") % 3, work, lambda s: J.stream_trend(s, f"{work}/state", f"{work}/checkpoint"))
    return J.latest_rows(t.spark, f"{work}/state", ["facet", "key"]).select("facet", "key", "n")


@register(
    "stream_registry",
    f"""WITH {_RUNS}, l AS (SELECT *, lag(score) OVER (PARTITION BY component ORDER BY run) AS p, row_number() OVER (PARTITION BY component ORDER BY run DESC) AS i FROM sc)
    SELECT component, max(CAST(score AS DOUBLE)) FILTER (i = 1) AS last_score, max(CASE WHEN score > coalesce(p, score) + 1 THEN 'up' WHEN score < coalesce(p, score) - 1 THEN 'down'
      ELSE 'flat' END) FILTER (i = 1) AS trend, CAST(count(*) FILTER (i <= 20) AS INT) AS points FROM l GROUP BY component""",
)
def stream_registry(t):
    work = _workspace(t, "registry")
    rows = runs(t).select("component", "run", "score")
    late = F.month("run") % 3  # every drop brings runs that lie before those of earlier drops
    in_drops(t, rows, late, work, lambda s: J.stream_registry(s, f"{work}/state", f"{work}/checkpoint"))
    state = J.latest_rows(t.spark, f"{work}/state", ["component"])
    points = F.size(F.from_json("history", "array<array<string>>"))
    return state.select("component", "last_score", "trend", points.alias("points"))


@register(
    "stream_extraction",
    "SELECT count(*) AS files, count(*) FILTER (regexp_matches(lower(text), '[a-z]')) AS with_words FROM conversations WHERE conv_id % 11 = 10 OR conv_id % 13 <> 12",
)
def stream_extraction(t):
    """Every conversation turn is a source file; the second drop repeats the first, unchanged."""
    work = _workspace(t, "extract")
    files = sources(t).select("path", "text", F.length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("mtime"), "drop", "words")
    again = files.unionByName(files.where("drop = 0").withColumn("drop", F.lit(1)))
    in_drops(t, again, F.col("drop"), work, lambda s: J.stream_extract(s, B.raw_imports, f"{work}/out", f"{work}/checkpoint", buckets=8, fan=2))
    rows = J.current_rows(t.spark, f"{work}/out")
    seen = rows.select("path").distinct().join(files.select("path", "words"), "path")
    return seen.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("words") > 0).alias("with_words"))


@register(
    "stream_duplicates",
    f"""WITH fn AS (SELECT path, doc_id % 3 AS d, sha256({NORM.replace("'0')", "'0', 'g')").replace("' ')", "' ', 'g')")}) AS fp FROM v_files),
    o AS (SELECT a.path, a.d, min(b.path) AS reference FROM fn a JOIN fn b ON a.fp = b.fp AND a.path <> b.path AND b.d <= a.d GROUP BY ALL)
    SELECT path, reference FROM o""",
)
def stream_duplicates(t):
    work = _workspace(t, "duplicates")
    low = F.expr(NORM)
    rows = t.v_files.select(
        "path", F.lit(1).alias("line"), F.concat(F.lit("doc_"), "doc_id").alias("symbol"), F.sha2(low, 256).alias("fingerprint"), F.col("bytes").cast("int").alias("node_count"), "doc_id"
    )
    in_drops(t, rows, F.col("doc_id") % 3, work, lambda s: J.stream_duplicates(s, f"{work}/out", f"{work}/checkpoint", buckets=8, fan=2))
    found = t.spark.read.parquet(f"{work}/out/concerns")
    return found.select("path", F.col("references")[0]["path"].alias("reference"))


