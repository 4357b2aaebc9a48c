"""Ledgers, gate, staleness, refresh, review trend and set operations."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from . import register
from .views import r2

CUT = "TIMESTAMP '1998-07-01'"
_KEY = "concat_ws('|', path, metric, symbol, severity, value, threshold)"
_SIDES = f"""cu AS (SELECT DISTINCT {_KEY} AS issue FROM v_find WHERE ts >= {CUT}),
    pr AS (SELECT DISTINCT {_KEY} AS issue FROM v_find WHERE ts < {CUT}),
    nw AS (SELECT issue FROM cu EXCEPT SELECT issue FROM pr), rs AS (SELECT issue FROM pr EXCEPT SELECT issue FROM cu)"""


def _sides(t):
    cut = F.expr(CUT)
    return t.v_find.where(F.col("ts") >= cut), t.v_find.where(F.col("ts") < cut)


@register(
    "ledger_counts",
    f"""WITH {_SIDES} SELECT (SELECT count(*) FROM cu) AS current_open, (SELECT count(*) FROM nw) AS new_since_last,
      (SELECT count(*) FROM rs) AS resolved_since_last""",
)
def ledger_counts(t):
    return L.ledger_diff(*_sides(t))[0]


@register(
    "ledger_keys",
    f"""WITH {_SIDES} SELECT * FROM (SELECT 'new' AS status, issue, CAST(row_number() OVER (ORDER BY issue) AS INT) AS rank FROM nw ORDER BY issue LIMIT 200)
    UNION ALL SELECT * FROM (SELECT 'resolved', issue, CAST(row_number() OVER (ORDER BY issue) AS INT) FROM rs ORDER BY issue LIMIT 200)""",
)
def ledger_keys(t):
    return L.ledger_diff(*_sides(t))[1].select("status", "issue", "rank")


_GATE = f"""mo AS (SELECT component AS repo, CAST(year(ts) AS INT) AS yr, metric AS category, severity FROM v_find),
    bl AS (SELECT repo, CAST(100 - count(*) FILTER (severity = 'critical') AS DOUBLE) AS overall, count(*) AS n, count(*) FILTER (severity = 'critical') AS rv FROM mo WHERE yr < 1998 GROUP BY repo),
    cr AS (SELECT repo, CAST(100 - count(*) FILTER (severity = 'critical') AS DOUBLE) AS overall, count(*) AS n, count(*) FILTER (severity = 'critical') AS rv FROM mo WHERE yr >= 1998 GROUP BY repo),
    bc AS (SELECT repo, category, count(*) AS n FROM mo WHERE yr < 1998 GROUP BY ALL),
    cc AS (SELECT repo, category, count(*) AS n FROM mo WHERE yr >= 1998 GROUP BY ALL),
    ck AS (SELECT c.repo, 'score' AS kind, 'overall' AS metric, 'overall score' AS name, 'block' AS severity, c.overall AS current, b.overall AS baseline,
        c.overall >= b.overall AS passed FROM cr c JOIN bl b USING (repo)
      UNION ALL SELECT coalesce(c.repo, b.repo), 'cleanup_total', 'candidate_total', 'cleanup candidate total', 'warn', CAST(coalesce(c.n, 0) AS DOUBLE), CAST(coalesce(b.n, 0) AS DOUBLE),
        coalesce(c.n, 0) <= coalesce(b.n, 0) FROM cr c FULL JOIN bl b USING (repo)
      UNION ALL SELECT coalesce(c.repo, b.repo), 'cleanup_total', 'review_required_total', 'cleanup review-required total', 'warn', CAST(coalesce(c.rv, 0) AS DOUBLE),
        CAST(coalesce(b.rv, 0) AS DOUBLE), coalesce(c.rv, 0) <= coalesce(b.rv, 0) FROM cr c FULL JOIN bl b USING (repo)
      UNION ALL SELECT coalesce(c.repo, b.repo), 'cleanup_category', coalesce(c.category, b.category), concat('cleanup category ', coalesce(c.category, b.category)), 'block',
        CAST(coalesce(c.n, 0) AS DOUBLE), CAST(coalesce(b.n, 0) AS DOUBLE), coalesce(c.n, 0) <= coalesce(b.n, 0)
        FROM cc c FULL JOIN bc b ON c.repo = b.repo AND c.category = b.category)"""


def _gate(t):
    rows = t.v_find.select(F.col("component").alias("repo"), F.year("ts").alias("yr"), F.col("metric").alias("category"), "severity")

    def totals(df):
        critical = F.count_if(F.col("severity") == "critical")
        return df.groupBy("repo").agg(
            (F.lit(100) - critical).cast("double").alias("overall"),
            F.count(F.lit(1)).alias("candidate_total"),
            critical.alias("review_required_total"),
            F.lit(None).cast("double").alias("structure"),
            F.lit(None).cast("double").alias("full"),
        )

    def groups(df):
        return df.groupBy("repo", "category").agg(F.count(F.lit(1)).alias("n"))

    old, new = rows.where("yr < 1998"), rows.where("yr >= 1998")
    return L.gate_checks(totals(new), totals(old), groups(new), groups(old))


@register("gate_checks", f"WITH {_GATE} SELECT * FROM ck")
def gate_checks(t):
    return _gate(t)


@register(
    "gate_status",
    f"""WITH {_GATE}, s AS (SELECT repo, count(*) AS check_total, count(*) FILTER (NOT passed AND severity = 'block') AS failure_total,
      count(*) FILTER (NOT passed AND severity = 'warn') AS warning_total FROM ck GROUP BY repo)
    SELECT *, CASE WHEN failure_total > 0 THEN 'fail' WHEN warning_total > 0 THEN 'warn' ELSE 'pass' END AS status FROM s""",
)
def gate_status(t):
    return L.gate_status(_gate(t))


@register(
    "baseline_rows",
    f"""WITH {_GATE} SELECT c.repo, overall, n AS candidate_total, rv AS review_required_total, {r2('overall / 2.0')} AS structure, overall AS full_score,
      'full' AS source_mode FROM cr c""",
)
def baseline_rows(t):
    rows = t.v_find.where(F.year("ts") >= 1998).groupBy(F.col("component").alias("repo")).agg(
        (F.lit(100) - F.count_if(F.col("severity") == "critical")).cast("double").alias("overall"),
        F.count(F.lit(1)).alias("candidate_total"),
        F.count_if(F.col("severity") == "critical").alias("review_required_total"),
    )
    scores = rows.select("repo", "overall", F.round(F.col("overall") / 2, 2).alias("structure"), F.col("overall").alias("full"))
    out = L.baseline_row(scores, rows, F.lit("2024-01-01").cast("timestamp"), F.lit("full"))
    return out.withColumnRenamed("full", "full_score").drop("generated_at")


@register(
    "snapshot_staleness",
    """WITH tr AS (SELECT concat('u', user_id) AS path, max(ts) AS mtime FROM events GROUP BY user_id),
    mf AS (SELECT concat('u', c_custkey) AS path FROM customer),
    j AS (SELECT tr.path AS tp, mf.path AS mp, mtime FROM tr FULL JOIN mf ON tr.path = mf.path)
    SELECT count(*) FILTER (mp IS NULL) AS added_total, count(*) FILTER (tp IS NULL) AS removed_total,
      count(*) FILTER (mtime > TIMESTAMP '2024-01-15') AS changed_total, count(*) AS path_total, false AS freshness_unknown,
      count(*) FILTER (mp IS NULL OR tp IS NULL OR mtime > TIMESTAMP '2024-01-15') > 0 AS stale FROM j""",
)
def snapshot_staleness(t):
    tree = t.events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").alias("mtime"))
    manifest = t.customer.select(F.concat(F.lit("u"), "c_custkey").alias("path"))
    return L.staleness(manifest, tree, F.expr("TIMESTAMP '2024-01-15'"))


@register(
    "scoped_staleness",
    """WITH tr AS (SELECT concat('u', user_id) AS path, max(ts) AS mtime FROM events GROUP BY user_id)
    SELECT count(*) AS selected_total, count(*) FILTER (mtime > TIMESTAMP '2024-01-15') AS changed_after_total,
      false AS freshness_unknown, count(*) FILTER (mtime > TIMESTAMP '2024-01-15') > 0 AS stale
    FROM orders LEFT JOIN tr ON concat('u', o_custkey) = path""",
)
def scoped_staleness(t):
    tree = t.events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").alias("mtime"))
    changes = t.orders.select(F.concat(F.lit("./u"), "o_custkey").alias("path"))
    return L.scoped_staleness(changes, tree, F.expr("TIMESTAMP '2024-01-15'"))


_REFRESH = """rf AS (SELECT CAST(ts AS DATE) AS day, count(*) AS changed_total, count(*) FILTER (structural) AS structural_total FROM v_changes GROUP BY 1),
    rg AS (SELECT *, structural_total >= 8 OR (changed_total >= 30 AND structural_total / CAST(changed_total AS DOUBLE) >= 0.35) AS "trigger" FROM rf)"""


@register(
    "refresh_signal",
    f"""WITH {_REFRESH} SELECT CAST(day AS TIMESTAMP) AS day, changed_total, structural_total,
      CAST(round(structural_total / CAST(changed_total AS DOUBLE), 4) AS DOUBLE) AS structural_ratio, "trigger" FROM rg""",
)
def refresh_signal(t):
    changes = t.v_changes.withColumn("day", F.date_trunc("day", "ts"))
    return L.refresh_signal(changes, ["day"])


@register(
    "refresh_decision",
    """WITH rf AS (SELECT component AS repo, count(*) AS n, count(*) FILTER (structural) AS s, max(ord) % 7 AS runs, min(ord) % 3 AS old, max(ord) % 3 AS cur
      FROM v_changes GROUP BY component),
    d AS (SELECT repo, concat_ws(',', CASE WHEN old <> 0 AND old <> cur THEN 'refresh-contract changed' END,
      CASE WHEN s >= 8 OR (n >= 30 AND s / CAST(n AS DOUBLE) >= 0.35) THEN 'large structural change detected' END,
      CASE WHEN runs + 1 >= 5 THEN 'periodic full refresh' END) AS reasons FROM rf)
    SELECT repo, reasons, reasons <> '' AS force_full FROM d""",
)
def refresh_decision(t):
    rows = t.v_changes.withColumnRenamed("component", "repo")
    old = F.min("ord") % 3
    state = rows.groupBy("repo").agg(
        F.when(old == 0, "").otherwise(old.cast("string")).alias("previous_fingerprint"),
        (F.max("ord") % 3).cast("string").alias("fingerprint"),
        (F.max("ord") % 7).alias("runs_since_full"),
    )
    out = L.refresh_decision(L.refresh_signal(rows), state)
    return out.select("repo", F.array_join("reasons", ",").alias("reasons"), "force_full")


_TREND = """SELECT {total} AS event_total,
      (SELECT string_agg(concat(mode, '=', n), ',' ORDER BY mode) FROM (SELECT mode, count(*) AS n FROM w GROUP BY mode)) AS mode_counts,
      (SELECT string_agg(concat(review_type, '=', n), ',' ORDER BY review_type) FROM (SELECT review_type, count(*) AS n FROM w GROUP BY review_type)) AS review_type_counts,
      max(generated_at) FILTER (ord = (SELECT max(ord) FROM w)) AS latest_generated_at,
      max(review_type) FILTER (ord = (SELECT max(ord) FROM w)) AS latest_review_type, 'latest_full' AS score_source,
      max(overall) FILTER (ord = (SELECT max(ord) FROM w WHERE mode = 'code_review' AND review_type = 'full')) AS overall FROM w"""


def trend_columns(df):
    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")

    return df.withColumns({"mode_counts": text("mode_counts"), "review_type_counts": text("review_type_counts")}).drop(
        "score_generated_at"
    )


@register(
    "review_trend",
    "WITH w AS (SELECT * FROM v_events ORDER BY ord DESC LIMIT 100) " + _TREND.format(total="count(*)"),
)
def review_trend(t):
    return trend_columns(L.review_trend(t.v_events, limit=100))


@register("review_trend_all", "WITH w AS (SELECT * FROM v_events) " + _TREND.format(total="count(*)"))
def review_trend_all(t):
    return trend_columns(L.review_trend(t.v_events, limit=0))


@register(
    "weakening_paths",
    """WITH w AS (SELECT path, count(*) AS event_mentions, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v_events GROUP BY path)
    SELECT *, CAST(row_number() OVER (ORDER BY event_mentions DESC, path) AS INT) AS rank FROM w ORDER BY rank LIMIT 5""",
)
def weakening_paths(t):
    return L.weakening_paths(t.v_events).withColumn("kinds", F.array_join("kinds", ","))


@register(
    "union_first_wins",
    """WITH u AS (SELECT path, 0 AS source, l_orderkey AS ord FROM v_find UNION ALL SELECT path, 1, ord FROM v_changes)
    SELECT path, min(source) AS source, (min(ord) FILTER (source = 0)) IS NULL AS only_second FROM u GROUP BY path""",
)
def union_first_wins(t):
    first = t.v_find.select("path", F.col("l_orderkey").alias("ord"))
    out = L.union_first(first, t.v_changes.select("path", "ord"))
    return out.select("path", "source", (F.col("source") == 1).alias("only_second"))


@register(
    "key_difference",
    "SELECT path FROM v_changes EXCEPT SELECT path FROM v_find",
)
def key_difference(t):
    return L.only_in_first(t.v_changes, t.v_find, ["path"])


@register(
    "key_changes",
    """WITH a AS (SELECT DISTINCT path FROM v_changes), b AS (SELECT DISTINCT path FROM v_find)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'resolved' ELSE 'open' END AS status
    FROM a FULL JOIN b ON a.path = b.path""",
)
def key_changes(t):
    return L.key_changes(t.v_changes, t.v_find, ["path"])


@register("shared_keys", "SELECT path FROM v_changes INTERSECT SELECT path FROM v_find")
def shared_keys(t):
    return L.shared_keys(t.v_changes, t.v_find, ["path"])
