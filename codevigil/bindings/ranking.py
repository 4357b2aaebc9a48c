"""Concern ranking, display, caps, signals; score trends."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import ranking as W
from . import register
from .views import CRITICAL

LEVEL = "CASE level WHEN 'high-concern' THEN 3 WHEN 'caution' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


@register(
    "concern_ranking",
    f"""WITH b AS (SELECT *, {LEVEL} AS lv FROM v_conc),
    k AS (SELECT *, row_number() OVER (PARTITION BY lv, kind ORDER BY confidence DESC, path, concern_id) AS ik FROM b)
    SELECT concern_id, kind, level, confidence, path,
      CAST(row_number() OVER (ORDER BY lv DESC, ik > 2, confidence DESC, path, concern_id) AS INT) AS rank
    FROM k ORDER BY rank LIMIT 5""",
)
def concern_ranking(t):
    return W.rank_concerns(t.v_conc).select("concern_id", "kind", "level", "confidence", "path", "rank")


@register(
    "concern_ranking_by_repo",
    f"""WITH b AS (SELECT *, {LEVEL} AS lv, concat('r', user_id % 40) AS repo FROM v_conc),
    k AS (SELECT *, row_number() OVER (PARTITION BY repo, lv, kind ORDER BY confidence DESC, path, concern_id) AS ik FROM b),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY lv DESC, ik > 2, confidence DESC, path, concern_id) AS INT) AS rank FROM k)
    SELECT repo, concern_id, rank FROM r WHERE rank <= 20""",
)
def concern_ranking_by_repo(t):
    per_repo = t.v_conc.withColumn("repo", F.concat(F.lit("r"), F.col("user_id") % 40))
    return W.rank_concerns(per_repo, limit=20).select("repo", "concern_id", "rank")


_EVIDENCE = """list_concat(CASE kind WHEN 'cleanup' THEN [concat('cleanup.category=', event_type)]
    WHEN 'boundary' THEN ['topology.needs_folder_management=false', concat('topology.flat_file_total=', event_id % 20)] ELSE [] END, [concat('source=', kind)])"""


def with_evidence(t):
    """Concerns with evidence: cleanup ones carry their category, boundary ones the topology facts."""
    own = F.when(F.col("kind") == "cleanup", F.array(F.concat(F.lit("cleanup.category="), "event_type"))).when(
        F.col("kind") == "boundary",
        F.array(
            F.lit("topology.needs_folder_management=false"),
            F.concat(F.lit("topology.flat_file_total="), F.col("event_id") % 20),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return t.v_conc.withColumn("evidence", F.concat(own, F.array(F.concat(F.lit("source="), "kind"))))


@register(
    "display_dedupe",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY path, event_type ORDER BY confidence DESC, concern_id DESC) AS i FROM v_conc)
    SELECT concern_id, kind, path, confidence FROM c WHERE kind <> 'cleanup' OR i = 1""",
)
def display_dedupe(t):
    return W.dedupe_display(with_evidence(t)).select("concern_id", "kind", "path", "confidence")


@register(
    "display_scope",
    """SELECT kind, CASE WHEN c.path IN (SELECT concat('src/u', c_custkey, '.py') FROM customer WHERE c_mktsegment = 'BUILDING')
      OR kind = 'duplication' THEN true ELSE false END AS shown, count(*) AS n FROM v_conc c GROUP BY ALL""",
)
def display_scope(t):
    changed = t.v_risk.where("public_api").select("path")
    return W.scope_display(with_evidence(t), changed, ["duplication"]).groupBy("kind", "shown").agg(F.count(F.lit(1)).alias("n"))


@register(
    "display_calibration",
    """WITH c AS (SELECT * FROM v_conc WHERE NOT (kind = 'boundary' AND event_id % 20 <= 10)
      AND NOT (kind = 'cleanup' AND event_type = 'stale_doc')),
    i AS (SELECT *, row_number() OVER (PARTITION BY path, event_type ORDER BY confidence DESC, concern_id DESC) AS i FROM c)
    SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM i WHERE kind <> 'cleanup' OR i = 1 GROUP BY kind""",
)
def display_calibration(t):
    files = t.v_files.select("path", "text")
    judged = t.v_risk.where("public_api").select("path", F.lit("keep_active").alias("decision"))
    shown = W.calibrate_full(with_evidence(t), files, judged)
    return shown.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register(
    "display_keep_active",
    """WITH k AS (SELECT concat('src/u', c_custkey, '.py') AS path FROM customer WHERE c_mktsegment = 'BUILDING'),
    c AS (SELECT * FROM v_conc WHERE NOT (kind = 'boundary' AND event_id % 20 <= 10)
      AND NOT (kind = 'cleanup' AND event_type = 'error' AND path IN (SELECT path FROM k))),
    i AS (SELECT *, row_number() OVER (PARTITION BY path, event_type ORDER BY confidence DESC, concern_id DESC) AS i FROM c)
    SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM i WHERE kind <> 'cleanup' OR i = 1 GROUP BY kind""",
)
def display_keep_active(t):
    """Cleanup concerns from error events play the stale docs."""
    stale = F.transform("evidence", lambda e: F.regexp_replace(e, "^cleanup.category=error$", "cleanup.category=stale_doc"))
    judged = t.v_risk.where("public_api").select("path", F.lit("keep_active").alias("decision"))
    shown = W.calibrate_full(with_evidence(t).withColumn("evidence", stale), t.v_files.select("path", "text"), judged)
    return shown.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _with_lists(t):
    numbers = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("e"), i))
    return t.v_conc.withColumns(
        {
            "evidence": numbers(F.col("event_id") % 12 + 1),
            "blast_radius": numbers(F.col("user_id") % 10 + 1),
            "references": numbers(F.col("event_id") % 5 + 1),
        }
    )


@register(
    "payload_caps",
    """SELECT concern_id, CAST(least(event_id % 12 + 1, 8) AS INT) AS evidence, CAST(least(user_id % 10 + 1, 8) AS INT) AS blast_radius,
      CAST(least(event_id % 5 + 1, 3) AS INT) AS references_kept FROM v_conc""",
)
def payload_caps(t):
    capped, _ = W.cap_payload(_with_lists(t))
    return capped.select(
        "concern_id",
        F.size("evidence").alias("evidence"),
        F.size("blast_radius").alias("blast_radius"),
        F.size("references").alias("references_kept"),
    )


@register(
    "payload_cap_report",
    """SELECT concern_id, 'evidence' AS field, CAST(event_id % 12 + 1 AS INT) AS original_total, 8 AS kept FROM v_conc WHERE event_id % 12 + 1 > 8
    UNION ALL SELECT concern_id, 'blast_radius', CAST(user_id % 10 + 1 AS INT), 8 FROM v_conc WHERE user_id % 10 + 1 > 8
    UNION ALL SELECT concern_id, 'references', CAST(event_id % 5 + 1 AS INT), 3 FROM v_conc WHERE event_id % 5 + 1 > 3""",
)
def payload_cap_report(t):
    return W.cap_payload(_with_lists(t))[1]


@register(
    "metric_caps",
    """WITH c AS (SELECT kind, path, count(*) AS n FROM v_conc WHERE confidence > 0.9 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS i, count(*) OVER (PARTITION BY kind) AS t FROM c)
    SELECT kind, string_agg(concat(path, '=', n), ',' ORDER BY i) FILTER (i <= 12) AS counts, max(t) > 12 AS cut FROM r GROUP BY kind""",
)
def metric_caps(t):
    from ..common import top_per

    counts = t.v_conc.where("confidence > 0.9").groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))
    # Only the keys a cap can keep are collected: one more than the cap tells that a cut was made.
    kept = top_per(counts, ["kind"], [F.asc("path")], W.METRIC_KEY_LIMIT + 1)
    entries = F.map_from_entries(F.collect_list(F.struct("path", "n")))
    maps = kept.groupBy("kind").agg(entries.alias("counts")).withColumn("metric", F.lit("paths"))
    capped, cuts = W.cap_metrics(maps)
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    done = cuts.select("kind", F.lit(True).alias("cut"))
    return capped.join(done, "kind", "left").select("kind", text.alias("counts"), F.coalesce("cut", F.lit(False)).alias("cut"))


@register(
    "review_signals",
    """SELECT kind, 'total' AS metric, 'all' AS key, count(*) AS n FROM v_conc GROUP BY kind
    UNION ALL SELECT kind, 'high_confidence', 'all', count(*) FROM v_conc WHERE confidence >= 0.78 GROUP BY kind
    UNION ALL SELECT kind, 'by_level', level, count(*) FROM v_conc GROUP BY kind, level
    UNION ALL SELECT kind, 'by_role', event_type, count(*) FROM v_conc GROUP BY kind, event_type
    UNION ALL SELECT kind, 'by_symbol_kind', 'function', count(*) FROM v_conc GROUP BY kind
    UNION ALL SELECT 'discovery', 'by_source', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'discovery', 'by_reason', concat('n', c_nationkey), count(*) FROM customer GROUP BY c_nationkey""",
)
def review_signals(t):
    rows = t.v_conc.withColumn("symbol_kind", F.lit("function")).withColumn("role", F.col("event_type"))
    found = t.customer.select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("reason"))
    return W.signals(rows, found)


_RUNS = f"""rn AS (SELECT component, date_trunc('month', ts) AS run, {CRITICAL} AS critical, count(*) AS n FROM v_find GROUP BY ALL),
    sc AS (SELECT component, run, greatest(0.0, 100.0 - critical * 18.0 - (n - critical) * 0.5) AS score, critical FROM rn)"""


def runs(t):
    """One score per component and month."""
    df = t.v_find.groupBy("component", F.date_trunc("month", "ts").alias("run")).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count(F.lit(1)).alias("n")
    )
    lost = F.col("critical") * 18.0 + (F.col("n") - F.col("critical")) * 0.5
    return df.select("component", "run", F.greatest(F.lit(0.0), F.lit(100.0) - lost).alias("score"), "critical")


@register(
    "score_trend",
    f"""WITH {_RUNS}, l AS (SELECT *, lag(score) OVER (PARTITION BY component ORDER BY run) AS p,
      row_number() OVER (PARTITION BY component ORDER BY run DESC) AS i FROM sc)
    SELECT component, max(CAST(score AS DOUBLE)) FILTER (i = 1) AS last_score, max(CASE WHEN score > coalesce(p, score) + 1 THEN 'up'
      WHEN score < coalesce(p, score) - 1 THEN 'down' ELSE 'flat' END) FILTER (i = 1) AS trend,
      string_agg(CAST(CAST(score * 10 AS BIGINT) AS VARCHAR), ',' ORDER BY run) FILTER (i <= 20) AS history FROM l GROUP BY component""",
)
def score_trend(t):
    df = L.score_trend(runs(t))
    tenths = F.transform("history", lambda h: F.round(h["score"] * 10).cast("long").cast("string"))
    return df.select("component", "last_score", "trend", F.array_join(tenths, ",").alias("history"))


@register(
    "score_trend_rows",
    f"""WITH {_RUNS}, l AS (SELECT *, lag(score) OVER (PARTITION BY component ORDER BY run) AS p FROM sc)
    SELECT component, run, CAST(score AS DOUBLE) AS score, CASE WHEN score > coalesce(p, score) + 1 THEN 'up' WHEN score < coalesce(p, score) - 1 THEN 'down'
      ELSE 'flat' END AS trend FROM l""",
)
def score_trend_rows(t):
    return L.trend_rows(runs(t)).select("component", "run", "score", "trend")
