"""Scoring models over the findings and changes."""

from pyspark.sql import functions as F

from ..common import attach
from ..common import r2 as r2c
from ..common import top_per
from ..operators import components as C
from ..operators import findings as E
from ..operators import hotspots as H
from ..operators import scoring as S
from . import register
from .findings import _GRAPH, _STATS, RANKED, stats
from .views import CRITICAL, INFO, POINTS, WARNING, grade, r2, verdict


def _context(t):
    """Layer role and neighbour count per component, taken from the dependency graph."""
    graph = C.component_graph(t.v_edge)
    near = graph.groupBy(F.col("src_component").alias("component")).agg(F.count(F.lit(1)).alias("neighbour_count"))
    role = F.when(F.col("neighbour_count") % 2 == 0, "orchestration").otherwise("application_domain")
    return near.withColumn("layer_role", role)


_SCORED = f"""{_STATS}, {_GRAPH},
    nb AS (SELECT src_component AS component, count(*) AS k FROM gr GROUP BY 1),
    cs AS (SELECT st.*, coalesce(k, 0) AS k, CASE WHEN k % 2 = 0 THEN 'orchestration' ELSE 'application_domain' END AS layer_role,
      {r2('''greatest(0.0, least(100.0, 100.0 - (least(6000, critical * 1800) + least(2400, warning * 400) + least(1000, info * 100)
        + least(2000, (added + deleted) * 4)
        + CASE WHEN critical > 0 AND coalesce(k, 1) % 2 = 0 THEN 400 ELSE 0 END
        + CASE WHEN critical > 0 AND coalesce(k, 0) >= 3 THEN 200 WHEN warning > 0 AND coalesce(k, 0) >= 5 THEN 100 ELSE 0 END) / 100.0))''')} AS score
      FROM st LEFT JOIN nb USING (component)),
    cv AS (SELECT *, CASE WHEN critical >= 3 OR score < 40 THEN 'block' WHEN critical > 0 OR score < 70 THEN 'needs_changes'
      ELSE 'approve' END AS recommendation FROM cs)"""


def scored(t):
    return C.component_score(stats(t), _context(t))


@register(
    "component_score",
    f"""WITH {_SCORED} SELECT component, added + deleted AS churn, critical, warning, info, score,
    {grade('score')} AS grade, recommendation FROM cv""",
)
def component_score(t):
    return scored(t).select("component", "churn", "critical", "warning", "info", "score", "grade", "recommendation")


def _full_sql(source: str, keys: str) -> str:
    """Full score of ``source`` (keys, critical, warning, info) with the default policy."""
    return f"""fp AS (SELECT *, least(45.0, greatest(0, critical - 5) * 0.5) AS pc, least(18.0, greatest(0, warning - 20) * 0.06) AS pw,
      least(6.0, greatest(0, info - 25) * 0.005) AS pi FROM {source}),
    ft AS (SELECT *, CAST(pc + pw + pi AS DOUBLE) AS total FROM fp),
    fm AS (SELECT *, greatest(65.0, 75.0 - least(20.0, total * 0.35)) AS pass_min,
      greatest(50.0, 60.0 - least(15.0, total * 0.25)) AS w0, greatest(0.0, least(100.0, 100.0 - total)) AS s FROM ft),
    fw AS (SELECT *, greatest(0.0, least(w0, pass_min - 5.0)) AS warn_min FROM fm),
    fs AS (SELECT {keys} critical, warning, info, {r2('s')} AS score, {grade('s')} AS grade,
      CASE WHEN critical >= 400 THEN 'block' ELSE {verdict('s', 'pass_min', 'warn_min')} END AS recommendation,
      {r2('total')} AS penalty_total, {r2('pass_min')} AS pass_min, {r2('warn_min')} AS warn_min FROM fw)"""


def _counts(t, *keys):
    rows = E.normalise_findings(t.v_find)
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


_FULL_COLUMNS = ["critical", "warning", "info", "score", "grade", "recommendation", "penalty_total"]


@register(
    "full_score",
    f"""WITH c0 AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY component),
    {_full_sql('c0', 'component,')} SELECT * FROM fs""",
)
def full_score(t):
    df = S.full_score(_counts(t, "component"))
    return df.select("component", *_FULL_COLUMNS, r2c(F.col("pass_min")).alias("pass_min"), r2c(F.col("warn_min")).alias("warn_min"))


@register(
    "full_score_baseline",
    f"""WITH c0 AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY component),
    b AS (SELECT *, 100.0 - least(45.0, greatest(0, critical - 5) * 0.5) - least(18.0, greatest(0, warning - 20) * 0.06)
      - least(6.0, greatest(0, info - 25) * 0.005) - 20.0 AS s FROM c0)
    SELECT component, {r2('greatest(0.0, s)')} AS score FROM b""",
)
def full_score_baseline(t):
    counts = _counts(t, "component").withColumn("baseline_overall", F.lit(8.0))
    return S.full_score(counts, {"full.base.from_baseline": 1.0}).select("component", "score")


_INC = f"""{_SCORED},
    tr AS (SELECT *, CASE WHEN added > deleted * 3 THEN 'up' ELSE 'flat' END AS trend,
      least(greatest(1, added + deleted + 1), 24) AS w,
      recommendation = 'block' OR score < 40 OR critical >= 3 AS blocked FROM cv),
    ia AS (SELECT count(*) AS component_total, CAST(sum(changed_files) AS BIGINT) AS changed_file_total,
      sum(CAST(round(score * 100) AS BIGINT) * w) / CAST(sum(w) AS DOUBLE) / 100.0 AS raw, CAST(sum(critical) AS BIGINT) AS critical_total,
      count(*) FILTER (trend = 'up') AS ups, count(*) FILTER (blocked) AS blocked, count(*) FILTER (NOT blocked AND score < 60) AS weak FROM tr),
    iv AS (SELECT *, least(12.0, critical_total * 2.0) AS lost, least(7.0, ups * 1.5) AS bonus FROM ia),
    ib AS (SELECT *, greatest(0.0, least(100.0, raw - lost + bonus)) AS v FROM iv),
    inc AS (SELECT 'incremental' AS mode, {r2('v')} AS score, {grade('v')} AS grade,
      CASE WHEN critical_total >= 6 OR blocked > 2 THEN 'block' ELSE {verdict('v', '80', '60')} END AS recommendation,
      changed_file_total, component_total, blocked AS blocked_components, weak AS weak_components, critical_total,
      ups AS trend_up_components, {r2('raw')} AS raw_weighted_score, CAST(lost AS DOUBLE) AS critical_penalty,
      CAST(bonus AS DOUBLE) AS macro_progress_bonus FROM ib)"""


def _incremental(t):
    trend = F.when(F.col("added") > F.col("deleted") * 3, "up").otherwise("flat")
    return S.incremental_score(scored(t).withColumn("trend", trend))


@register("incremental_score", f"WITH {_INC} SELECT * FROM inc")
def incremental_score(t):
    return _incremental(t)


@register(
    "overall_score",
    f"""WITH {_INC}, c0 AS (SELECT {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find),
    {_full_sql('c0', '')}, ov AS (SELECT fs.score * 0.62 + inc.score * 0.38 AS v, inc.recommendation AS ir, blocked_components AS b,
      critical_total AS c FROM fs, inc)
    SELECT {r2('v')} AS score, {grade('v')} AS grade,
      CASE WHEN ir = 'block' AND (b >= 2 OR c >= 3) THEN 'block' ELSE {verdict('v', '75', '60')} END AS recommendation,
      CAST(0.62 AS DOUBLE) AS weight_full, CAST(0.38 AS DOUBLE) AS weight_incremental, false AS low_scope FROM ov""",
)
def overall_score(t):
    return S.overall_score(S.full_score(_counts(t)), _incremental(t))


def _excess_sql(count: str, grace: float, factor: float, cap: float) -> str:
    return f"least({cap}, greatest({count} - {grace}, 0) * {factor})"


@register(
    "structure_dimensions",
    f"""WITH m AS (SELECT component, count(*) FILTER (metric = 'module_lines') AS ml, count(*) FILTER (metric = 'class_public_methods') AS cp,
      count(*) FILTER (metric = 'cyclomatic_complexity') AS cc, count(*) FILTER (metric = 'line_length_soft_hits') AS ls,
      count(*) FILTER (metric = 'line_length_hard_hits') AS lh, {CRITICAL} AS cr FROM v_find GROUP BY component)
    SELECT component, {r2(f"100.0 - least(36.0, {_excess_sql('ml', 10, 1.4, 24)} + {_excess_sql('cp', 4, 1.2, 8)})")} AS file_modularity,
      CAST(100 AS DOUBLE) AS boundary_clarity, CAST(100 AS DOUBLE) AS coupling_control,
      {r2(f"100.0 - least(36.0, {_excess_sql('cc', 32, 0.45, 18)} + {_excess_sql('ls', 55, 0.06, 6)} + {_excess_sql('lh', 16, 0.22, 8)} + {_excess_sql('cr', 6, 0.55, 10)})")} AS maintainability
    FROM m""",
)
def structure_dimensions(t):
    # One corpus scope per component: every component is a repository of its own here.
    per_repo = E.summarize(t.v_find.withColumnRenamed("component", "repo"))
    return S.structure_dimensions(per_repo).withColumnRenamed("repo", "component")


_TOPOLOGY = """tp AS (SELECT component, count(*) AS n, count(DISTINCT lang) AS langs, count(*) FILTER (bytes > 2000) AS big,
      count(*) FILTER (bytes < 300) AS small FROM v_files GROUP BY component)"""


@register(
    "topology_dimension",
    f"""WITH {_TOPOLOGY} SELECT component, {r2('''greatest(0.0, least(100.0, 100.0 - least(34.0, greatest(n - 8, 0) * 1.25) - least(26.0, big * 1.15)
      - least(12.0, small * 1.4) - least(8.0, greatest(n - 8, 0) * 1.6) + CASE WHEN n % 8 >= 6 THEN 8 WHEN n % 8 >= 3 THEN 5 WHEN n % 8 > 0 THEN 2.5 ELSE 0 END
      + CASE WHEN n < 12 AND big <= 18 THEN 4 ELSE 0 END + CASE WHEN big = 0 THEN least(4.0, langs * 0.8) ELSE 0 END))''')} AS package_topology FROM tp""",
)
def topology_dimension(t):
    counts = t.v_files.groupBy("component").agg(
        F.count(F.lit(1)).alias("flat_files"),
        F.countDistinct("lang").alias("wrappers"),
        F.count_if(F.col("bytes") > 2000).alias("misplaced"),
        F.count_if(F.col("bytes") < 300).alias("review"),
    )
    shaped = counts.withColumns(
        {
            "retained": F.col("flat_files"),
            "subpackages": F.col("flat_files") % 8,
            "needs_folders": F.col("flat_files") >= 12,
        }
    )
    return shaped.select("component", S.topology_dimension().alias("package_topology"))


def _weighted_sql(table: str, weights: list[int], cap: float, factor: float) -> str:
    whens = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights, 1))
    return f"""(SELECT {r2(f"greatest(0.0, 100.0 - least({cap}, sum(CAST(round(p * 1000000) AS BIGINT) * w) / CAST(sum(w) AS DOUBLE) / 1000000.0 * {factor}))")}
      FROM (SELECT p, CASE rank {whens} END AS w FROM {table} WHERE rank <= {len(weights)}))"""


@register(
    "governance_dimensions",
    RANKED
    + f""", hr AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, path) AS rank FROM rk),
    hp AS (SELECT rank, CAST(least(20.0, critical * 5.5 + warning * 1.35 + score * 0.75) AS DOUBLE) AS p FROM hr WHERE rank <= 8),
    cr AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, sum({POINTS}) / 100.0 AS risk, count(DISTINCT path) AS files
      FROM v_find GROUP BY component),
    ck AS (SELECT *, row_number() OVER (ORDER BY risk DESC, component) AS rank FROM cr),
    cp AS (SELECT rank, CAST(least(18.0, risk * 1.35 + critical * 5.0 + warning * 1.1 + greatest(files - 6, 0) * 0.5) AS DOUBLE) AS p FROM ck WHERE rank <= 6)
    SELECT {_weighted_sql('hp', [100, 72, 54, 40, 30, 22, 16, 12], 46.0, 2.2)} AS hotspot_hygiene,
      {_weighted_sql('cp', [100, 74, 56, 42, 30, 20], 42.0, 2.0)} AS component_balance""",
)
def governance_dimensions(t):
    ranked = H.rank_hotspots(E.hotspots(t.v_find, top_n=None), 20).withColumn("score", F.col("hotspot_score"))
    risk = E.component_risk(t.v_find)
    top = top_per(risk, [], [F.desc("risk_score"), F.asc("component")], 10)
    # Two one-row frames side by side.
    return attach(S.hotspot_hygiene(ranked), S.component_balance(top), [])


_LEDGER = """lg AS (SELECT component, count(*) AS n, count(*) FILTER (severity = 'critical') AS review, count(*) FILTER (value < 3) AS expired,
      count(*) FILTER (value < 25) AS owned, count(*) FILTER (value < 10) AS ttl, count(*) FILTER (value < 5) AS expires,
      sum(CASE metric WHEN 'module_lines' THEN 45 WHEN 'cyclomatic_complexity' THEN 40 ELSE 16 END) AS tenths FROM v_find GROUP BY component)"""


@register(
    "cleanup_and_archive_scores",
    f"""WITH {_LEDGER} SELECT component, {r2('''greatest(0.0, least(100.0, 100.0 - least(22.0, greatest(n - 1, 0) * 1.8) - least(20.0, review * 2.8)
      - least(22.0, expired * 6.0) - least(20.0, CAST(tenths AS DOUBLE) * 0.15)
      + (CAST(owned AS DOUBLE) / n + CAST(ttl AS DOUBLE) / n + CAST(expires AS DOUBLE) / n) / 3.0 * 8.0))''')} AS cleanup_hygiene,
      {r2('greatest(0.0, least(100.0, 68.0 + CAST(owned AS DOUBLE) / n * 28.0 + least(12.0, owned * 2.0) - least(18.0, review * 3.0)))')} AS archive_readiness,
      {r2('''greatest(0.0, least(100.0, 72.0 + CAST(owned AS DOUBLE) / n * 14.0 + CAST(ttl AS DOUBLE) / greatest(owned, 1) * 12.0
        - least(1.0, CAST(review AS DOUBLE) / greatest(owned, 1)) * 8.0 - CAST(expired AS DOUBLE) / greatest(owned, 1) * 4.0))''')} AS semantic_alignment FROM lg""",
)
def cleanup_and_archive_scores(t):
    v = F.col("value")
    tenths = F.when(F.col("metric") == "module_lines", "fallback_branch").when(
        F.col("metric") == "cyclomatic_complexity", "legacy_impl"
    ).otherwise("other")
    df = t.v_find.groupBy("component").agg(
        F.count(F.lit(1)).alias("candidate_total"),
        F.count_if(F.col("severity") == "critical").alias("review_required_total"),
        F.count_if(v < 3).alias("expired_total"),
        F.count_if(v < 25).alias("owner_total"),
        F.count_if(v < 10).alias("ttl_total"),
        F.count_if(v < 5).alias("expires_total"),
        F.sum(S.category_points(tenths)).alias("category_tenths"),
    )
    df = df.withColumns(
        {
            "ready_total": F.col("owner_total"),
            "review_total": F.col("review_required_total"),
            "pool_total": F.col("candidate_total"),
            "status": F.lit("ok"),
            "reviewed_total": F.col("owner_total"),
            "retire_now": F.col("ttl_total"),
            "archive_first": F.lit(0),
            "review": F.col("review_required_total"),
            "keep_active": F.col("expired_total"),
        }
    )
    return df.select(
        "component",
        S.cleanup_hygiene().alias("cleanup_hygiene"),
        S.archive_readiness().alias("archive_readiness"),
        S.semantic_alignment().alias("semantic_alignment"),
    )


@register(
    "structure_score",
    f"""WITH c0 AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY component),
    {_full_sql('c0', 'component,')}, m AS (SELECT component, count(*) FILTER (metric = 'module_lines') AS ml, count(*) FILTER (metric = 'class_public_methods') AS cp FROM v_find GROUP BY component),
    d AS (SELECT component, {r2(f"100.0 - least(36.0, {_excess_sql('ml', 10, 1.4, 24)} + {_excess_sql('cp', 4, 1.2, 8)})")} AS fm FROM m)
    SELECT component, {r2('fs.score * 0.3 + (fm + 100.0) / 2.0 * 0.7')} AS structure FROM fs JOIN d USING (component)""",
)
def structure_score(t):
    per_repo = t.v_find.withColumnRenamed("component", "repo")
    dims = S.structure_dimensions(E.summarize(per_repo)).withColumnRenamed("repo", "component")
    full = S.full_score(_counts(t, "component")).select("component", F.col("score").alias("full"))
    both = full.join(dims, "component")
    value = S.structure_score(F.col("full"), [F.col("file_modularity"), F.col("boundary_clarity")])
    return both.select("component", value.alias("structure"))


@register(
    "action_recommendations",
    RANKED
    + f""", hr AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, path) AS rank FROM rk),
    cr AS (SELECT component, {CRITICAL} AS critical, {r2(f"sum({POINTS}) / 100.0")} AS risk, count(DISTINCT path) AS files FROM v_find GROUP BY component),
    ck AS (SELECT *, row_number() OVER (ORDER BY risk DESC, component) AS rank FROM cr)
    SELECT 'P' || CAST(least(2, rank - 1) AS VARCHAR) AS priority, path AS title, '' AS target, 1 AS block, CAST(rank AS INT) AS pos FROM hr WHERE rank <= 3
    UNION ALL SELECT 'P1', 'Settle ' || component, component, 2, CAST(rank AS INT) FROM ck WHERE rank <= 1
    UNION ALL SELECT 'P0', 'Reach the goal within the components that own its files', 'goal', 0, 1""",
)
def action_recommendations(t):
    ranked = H.rank_hotspots(E.hotspots(t.v_find, top_n=None), 8)
    top = top_per(E.component_risk(t.v_find), [], [F.desc("risk_score"), F.asc("component")], 10)
    group = "array<struct<rank:int,group_id:string,name:string,reason:string,files:array<string>>>"
    sizes = t.v_files.agg(F.count(F.lit(1)).alias("flat_files"))
    topology = sizes.select(
        "flat_files", F.lit("src").alias("source_root"), (F.col("flat_files") < 12).alias("needs_folders"), F.array().cast(group).alias("groups")
    )
    goals = t.region.agg(F.min("r_name").alias("goal"))
    return H.recommend_actions(ranked, top, topology, goals).drop("why")
