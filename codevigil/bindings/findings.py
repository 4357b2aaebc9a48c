"""Finding aggregates, hotspots, components and the dependency graph."""

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import findings as E
from ..operators import hotspots as H
from . import register
from .views import CRITICAL, INFO, POINTS, WARNING, r2

SPOTS = f"""SELECT path, {r2(f"sum({POINTS}) / 100.0")} AS score,
  {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY path"""


@register(
    "finding_summary",
    """WITH m AS (SELECT metric, count(*) AS n FROM v_find GROUP BY metric)
    SELECT 'severity' AS facet, severity AS key, count(*) AS n FROM v_find GROUP BY severity
    UNION ALL SELECT 'dimension', dimension, count(*) FROM v_find GROUP BY dimension
    UNION ALL SELECT 'metric', metric, n FROM m
    UNION ALL SELECT 'total', 'all', count(*) FROM v_find""",
)
def finding_summary(t):
    return E.summarize(t.v_find)


@register("hotspot_aggregation", SPOTS)
def hotspot_aggregation(t):
    return E.hotspots(t.v_find, top_n=None, details=False)


def _flat_details(df):
    return df.select(
        "path",
        "score",
        "critical",
        "warning",
        "info",
        F.array_join(F.transform(F.map_entries("top_metrics"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("top_metrics"),
        F.array_join(
            F.transform(F.map_entries("top_dimensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("top_dimensions"),
        F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s["severity"], s["metric"], s["symbol"], s["value"])), ",").alias("samples"),
    )


@register(
    "hotspot_details",
    f"""WITH spots AS ({SPOTS}),
    mc AS (SELECT path, metric AS k, count(*) AS n FROM v_find GROUP BY ALL),
    mr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, k) AS r FROM mc),
    dc AS (SELECT path, dimension AS k, count(*) AS n FROM v_find GROUP BY ALL),
    dr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, k) AS r FROM dc),
    sr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, severity, metric, symbol) AS r FROM v_find)
    SELECT s.path, score, critical, warning, info,
      (SELECT string_agg(concat(k, '=', n), ',' ORDER BY r) FROM mr WHERE mr.path = s.path AND r <= 5) AS top_metrics,
      (SELECT string_agg(concat(k, '=', n), ',' ORDER BY r) FROM dr WHERE dr.path = s.path AND r <= 5) AS top_dimensions,
      (SELECT string_agg(concat_ws(':', severity, metric, symbol, value), ',' ORDER BY r) FROM sr
        WHERE sr.path = s.path AND r <= 4) AS samples
    FROM spots s ORDER BY score DESC, critical DESC, path LIMIT 200""",
)
def hotspot_details(t):
    return _flat_details(E.hotspots(t.v_find, top_n=200))


@register(
    "component_risk",
    f"""WITH f AS (SELECT DISTINCT component, path FROM v_find),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY path) AS i FROM f),
    a AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info,
      {r2(f"sum({POINTS}) / 100.0")} AS risk_score, count(DISTINCT path) AS file_count FROM v_find GROUP BY component)
    SELECT a.*, (SELECT string_agg(path, ',' ORDER BY i) FROM r WHERE r.component = a.component AND i <= 20) AS files,
      CASE WHEN critical = 0 AND risk_score < 8 AND file_count < 8 THEN 'watch' ELSE
      concat_ws(',', CASE WHEN critical > 0 THEN 'critical_findings' END,
        CASE WHEN risk_score >= 8 THEN 'hotspot_concentration' END,
        CASE WHEN file_count >= 8 THEN 'wide_component' END) END AS labels FROM a""",
)
def component_risk(t):
    df = E.component_risk(t.v_find)
    return df.withColumns({"files": F.array_join("files", ","), "labels": F.array_join("labels", ",")})


_QUARTERS = "CASE severity WHEN 'critical' THEN 12 WHEN 'warning' THEN 4 ELSE 1 END"


@register(
    "rubric_score",
    f"""WITH d AS (SELECT * FROM (VALUES ('file_structure', 32), ('file_size', 22), ('code_style', 8),
      ('encapsulation', 20), ('complexity', 18)) AS x(dimension, w)),
    q AS (SELECT dimension, sum({_QUARTERS}) AS q FROM v_find GROUP BY dimension),
    n AS (SELECT count(*) AS files FROM v_files),
    s AS (SELECT d.dimension, d.w, {r2("greatest(1.0, 10.0 - least(9.0, log2(1.0 + coalesce(q.q, 0) / 4.0 / greatest(1.0, sqrt(n.files)))))")} AS score
      FROM d LEFT JOIN q USING (dimension), n)
    SELECT dimension, score FROM s UNION ALL
    SELECT 'overall', {r2("sum(CAST(round(score * 100) AS BIGINT) * w) / 10000.0")} FROM s""",
)
def rubric_score(t):
    return E.rubric_score(t.v_find, t.v_files.select("path"))


_STATS = f"""pc AS (SELECT component, path, sum(added) AS added, sum(deleted) AS deleted, count(*) AS times
      FROM v_changes GROUP BY ALL),
    ff AS (SELECT path, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY path),
    st AS (SELECT component, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted,
      CAST(sum(times) AS BIGINT) AS changed_rows, count(*) AS changed_files,
      CAST(sum(times * coalesce(critical, 0)) AS BIGINT) AS critical,
      CAST(sum(times * coalesce(warning, 0)) AS BIGINT) AS warning,
      CAST(sum(times * coalesce(info, 0)) AS BIGINT) AS info
      FROM pc LEFT JOIN ff USING (path) GROUP BY component)"""


def stats(t):
    return C.component_stats(t.v_changes, t.v_find, E.hotspots(t.v_find, None, details=False))


@register(
    "component_change_stats",
    f"""WITH {_STATS}, spots AS ({SPOTS}),
    rr AS (SELECT c.component, c.path, s.score, row_number() OVER (PARTITION BY c.component ORDER BY c.ord, c.path) AS i
      FROM v_changes c JOIN spots s USING (path))
    SELECT st.*, (SELECT string_agg(concat(path, '=', CAST(score * 100 AS BIGINT)), ',' ORDER BY i) FROM rr
      WHERE rr.component = st.component AND i <= 8) AS hotspot_refs FROM st""",
)
def component_change_stats(t):
    cents = lambda r: F.concat(r["path"], F.lit("="), F.round(r["score"] * 100).cast("long"))
    return stats(t).withColumn("hotspot_refs", F.array_join(F.transform("hotspot_refs", cents), ","))


_GRAPH = """pe AS (SELECT src_component, dst_component, dst_path, CAST(sum(greatest(1, weight)) AS BIGINT) AS weight FROM v_edge
      WHERE src_component <> dst_component AND dst_component NOT LIKE '%:tests' GROUP BY ALL),
    gr AS (SELECT src_component, dst_component, CAST(sum(weight) AS BIGINT) AS weight FROM pe GROUP BY ALL)"""


@register(
    "component_graph",
    f"""WITH {_GRAPH}, rk AS (SELECT *, row_number() OVER (PARTITION BY src_component, dst_component
      ORDER BY weight DESC, dst_path) AS i FROM pe)
    SELECT gr.*, (SELECT string_agg(dst_path, ',' ORDER BY i) FROM rk WHERE rk.src_component = gr.src_component
      AND rk.dst_component = gr.dst_component AND i <= 6) AS target_paths FROM gr""",
)
def component_graph(t):
    return C.component_graph(t.v_edge).withColumn("target_paths", F.array_join("target_paths", ","))


@register(
    "component_neighbors",
    f"""WITH {_GRAPH}, nb AS (SELECT *, row_number() OVER (PARTITION BY src_component ORDER BY weight DESC, dst_component) AS rank FROM gr)
    SELECT src_component, dst_component, weight, CAST(rank AS INT) AS rank FROM nb WHERE rank <= 8""",
)
def component_neighbors(t):
    return C.component_neighbors(C.component_graph(t.v_edge)).drop("target_paths")


def _signatures(t):
    """A signature per finding: a symbol name derived from the part type and line of the finding."""
    return t.v_find.join(
        t.v_parts.select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("file"), "p_name"),
        F.substring_index("path", "/", -1) == F.col("file"),
    ).select(
        "path",
        "component",
        F.concat(F.initcap(F.substring_index("p_name", " ", 1)), F.lit("."), F.substring_index("p_name", " ", -1), F.lit("_"), "symbol").alias("name"),
    )


@register(
    "component_descriptors",
    f"""WITH sg AS (SELECT f.component, concat(upper(left(p_name, 1)), lower(substr(split_part(p_name, ' ', 1), 2)), '.',
        split_part(p_name, ' ', 2), '_', symbol) AS name
      FROM v_find f JOIN part ON f.path LIKE '%/p' || p_partkey || '.py'),
    sc AS (SELECT component, name, count(*) AS n FROM sg GROUP BY ALL),
    sr AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY
        (1 + 4 + 2 + 1 + CASE WHEN length(name) >= 12 THEN 1 ELSE 0 END) DESC, n DESC, length(name) DESC, name) AS i FROM sc),
    f0 AS (SELECT DISTINCT component, path FROM v_find),
    fr AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY path) AS i FROM f0),
    spots AS ({SPOTS}),
    sp AS (SELECT f0.component, s.path, row_number() OVER (PARTITION BY component ORDER BY score DESC, critical DESC, s.path) AS i
      FROM spots s JOIN f0 USING (path)),
    {_GRAPH}, nb AS (SELECT *, row_number() OVER (PARTITION BY src_component ORDER BY weight DESC, dst_component) AS i FROM gr),
    b AS (SELECT component, count(*) AS file_count FROM f0 GROUP BY component),
    sv AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, {INFO} AS info FROM v_find GROUP BY component),
    l AS (SELECT b.*, critical, warning, info,
      coalesce((SELECT string_agg(path, ',' ORDER BY i) FROM fr WHERE fr.component = b.component), '') AS files,
      coalesce((SELECT string_agg(name, ',' ORDER BY i) FROM sr WHERE sr.component = b.component AND i <= 12), '') AS primary_symbols,
      coalesce((SELECT string_agg(path, ',' ORDER BY i) FROM sp WHERE sp.component = b.component AND i <= 6), '') AS hotspot_paths,
      coalesce((SELECT string_agg(dst_component, ',' ORDER BY i) FROM nb WHERE src_component = b.component AND i <= 8), '') AS neighbours
      FROM b JOIN sv USING (component))
    SELECT component, file_count, critical, warning, info, files, primary_symbols, hotspot_paths, neighbours,
      'application_domain' AS layer_role,
      least(95, 35 + CASE WHEN file_count >= 1 THEN 15 ELSE 0 END + CASE WHEN file_count >= 3 THEN 10 ELSE 0 END
        + CASE WHEN primary_symbols LIKE '%,%' THEN 15 ELSE 0 END + CASE WHEN hotspot_paths <> '' THEN 10 ELSE 0 END
        + CASE WHEN neighbours <> '' THEN 5 ELSE 0 END) / CAST(100 AS DOUBLE) AS confidence,
      concat(component, ' is an application domain component spanning ', file_count, ' files. Primary surfaces: ',
        CASE WHEN primary_symbols = '' THEN 'no clear dominant public surface'
          ELSE array_to_string(string_split(primary_symbols, ',')[1:3], ', ') END, '.',
        CASE WHEN hotspot_paths = '' THEN '' ELSE concat(' Current pressure points: ',
          array_to_string(list_transform(string_split(hotspot_paths, ',')[1:2], lambda x: regexp_extract(x, '[^/]+$')), ', '), '.') END,
        CASE WHEN neighbours = '' THEN '' ELSE concat(' Primary adjacent components: ',
          array_to_string(string_split(neighbours, ',')[1:3], ', '), '.') END) AS responsibility_summary
    FROM l""",
)
def component_descriptors(t):
    files = t.v_find.select("path", "component")
    df = C.descriptors(files, _signatures(t), t.v_find, t.v_edge)
    lists = {n: F.array_join(n, ",") for n in ("files", "primary_symbols", "hotspot_paths", "neighbours")}
    return df.drop("test_anchors", "descriptor_terms", "neighbour_count").withColumns(lists)


@register("descriptor_terms")
def descriptor_terms(t):
    files = t.v_files.select("path", "component")
    signatures = t.v_files.select("component", F.concat(F.lit("Doc."), "lang", F.lit("_"), "doc_id").alias("name"))
    df = C.descriptors(files, signatures, t.v_find, t.v_edge)
    return df.select("component", F.array_join("descriptor_terms", ",").alias("descriptor_terms"), "confidence")


_RANK_PARTS = """CAST(CASE WHEN metric = 'cyclomatic_complexity' AND severity = 'critical' THEN 60
    WHEN metric = 'cyclomatic_complexity' AND severity = 'warning' THEN 20
    WHEN metric = 'module_lines' AND severity = 'critical' THEN 30
    WHEN metric = 'module_lines' AND severity = 'warning' THEN 15 ELSE 0 END AS BIGINT)"""

RANKED = f"""WITH spots AS ({SPOTS}),
    sr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, severity, metric, symbol) AS r FROM v_find),
    sb AS (SELECT path, sum({_RANK_PARTS}) / 10.0 AS bonus FROM sr WHERE r <= 4 GROUP BY path),
    mc AS (SELECT path, metric, count(*) AS n FROM v_find GROUP BY ALL),
    dm AS (SELECT path, first(metric ORDER BY n DESC, metric) AS dominant_metric FROM mc GROUP BY path),
    rk AS (SELECT path, score, critical, warning, bonus, dominant_metric,
        (CAST(round(score * 100) AS BIGINT) + critical * 800 + warning * 200 + CAST(round(bonus * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS rank_score
      FROM spots JOIN sb USING (path) JOIN dm USING (path))"""


@register(
    "hotspot_ranking",
    RANKED
    + """ SELECT path, critical, warning, score AS hotspot_score, CAST(bonus AS DOUBLE) AS metric_bonus, rank_score, dominant_metric,
      CASE dominant_metric WHEN 'module_lines' THEN 'Too long: cut the file along its topics, one module each.'
        WHEN 'cyclomatic_complexity' THEN 'Too many branches: name the cases and give each a function.'
        WHEN 'class_public_methods' THEN 'Too wide a class: let parts of it become classes.'
        ELSE 'Long lines: give the pieces of the statement names.' END AS fix_hint,
      CAST(row_number() OVER (ORDER BY rank_score DESC, path) AS INT) AS rank
    FROM rk ORDER BY rank_score DESC, path LIMIT 20""",
)
def hotspot_ranking(t):
    spots = E.hotspots(t.v_find, top_n=None, keep=lambda scores: H.contenders(scores, 20))
    ranked = H.rank_hotspots(spots, 20)
    return ranked.select(
        "path", "critical", "warning", "hotspot_score", "metric_bonus", "rank_score", "dominant_metric", "fix_hint", "rank"
    )


_MERGE = f"""spots AS ({SPOTS} ORDER BY score DESC, critical DESC, path LIMIT 200),
    base AS (SELECT path, score, critical, warning FROM spots WHERE critical > 0),
    refs AS (SELECT c.ord, c.path, c.component, CAST(c.added + c.deleted AS DOUBLE) AS component_score, s.score, s.critical, s.warning
      FROM v_changes c JOIN spots s USING (path)),
    focus AS (SELECT ord, path, component, CASE WHEN structural THEN 'high' ELSE 'medium' END AS priority FROM v_changes)"""


def _merged(t):
    spots = E.hotspots(t.v_find, 200, details=False).drop("rank")
    refs = t.v_changes.join(spots, "path").select(
        "ord", "path", "component", (F.col("added") + F.col("deleted")).cast("double").alias("component_score"), "score", "critical", "warning"
    )
    focus = t.v_changes.select(
        "ord", "path", "component", F.when(F.col("structural"), "high").otherwise("medium").alias("priority")
    )
    return H.merge_hotspots(spots.where(F.col("critical") > 0), refs, focus)


@register(
    "hotspot_merge",
    f"""WITH {_MERGE},
    r AS (SELECT path, first(component ORDER BY ord) AS rc, min(component_score) AS component_score, max(score) AS s,
      max(critical) AS c, max(warning) AS w FROM refs GROUP BY path),
    f AS (SELECT path, first(component ORDER BY ord) AS fc, first(priority ORDER BY ord) AS priority FROM focus GROUP BY path)
    SELECT coalesce(b.path, r.path, f.path) AS path, coalesce(rc, fc, '') AS component,
      greatest(coalesce(b.critical, 0), coalesce(r.c, 0)) AS critical, greatest(coalesce(b.warning, 0), coalesce(r.w, 0)) AS warning,
      greatest(coalesce(b.score, 0), coalesce(r.s, 0)) AS score, component_score, coalesce(priority, '') AS priority
    FROM base b FULL JOIN r ON b.path = r.path FULL JOIN f ON coalesce(b.path, r.path) = f.path""",
)
def hotspot_merge(t):
    return _merged(t)


@register(
    "iteration_tiers",
    f"""WITH top AS (SELECT *, row_number() OVER (ORDER BY score DESC, critical DESC, path) AS rank FROM ({SPOTS})),
    t AS (SELECT *, sum(CASE WHEN critical > 0 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS rc FROM top WHERE rank <= 24),
    p AS (SELECT *, critical > 0 AND rc <= 8 AS p0 FROM t),
    q AS (SELECT *, sum(CASE WHEN p0 THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS ro FROM p)
    SELECT CASE WHEN p0 THEN 'P0' WHEN ro <= 10 THEN 'P1' ELSE 'P2' END AS tier, CAST(rank AS INT) AS rank, path, critical, warning, score FROM q""",
)
def iteration_tiers(t):
    return H.tiers(E.hotspots(t.v_find, 24, details=False))


@register(
    "component_debt",
    f"""WITH a AS (SELECT component, {CRITICAL} AS critical, {WARNING} AS warning, count(DISTINCT path) AS n FROM v_find GROUP BY component),
    r AS (SELECT component, critical, warning, least(95, 35 + n) / CAST(100 AS DOUBLE) AS confidence FROM a WHERE critical > 0 OR warning > 0)
    SELECT *, CAST(row_number() OVER (ORDER BY critical DESC, warning DESC, confidence DESC, component) AS INT) AS rank FROM r
    ORDER BY rank LIMIT 12""",
)
def component_debt(t):
    risk = E.component_risk(t.v_find)
    confidence = F.least(F.lit(35) + F.col("file_count"), F.lit(95)) / 100.0
    return H.debt_view(risk.select("component", "critical", "warning", confidence.alias("confidence")))


@register(
    "related_hotspots",
    f"""WITH spots AS ({SPOTS})
    SELECT c.path, c.ord, critical, warning, score, CAST(row_number() OVER (ORDER BY c.ord, c.path) AS INT) AS rank
    FROM (SELECT path, min(ord) AS ord FROM v_changes GROUP BY path) c JOIN spots USING (path) ORDER BY c.ord, c.path LIMIT 10""",
)
def related_hotspots(t):
    candidates = t.v_changes.groupBy("path").agg(F.min("ord").alias("ord"))
    return H.related_hotspots(candidates, E.hotspots(t.v_find, None, details=False))
