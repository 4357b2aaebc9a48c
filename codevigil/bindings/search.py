"""Goal search over parts, documents and conversations."""

from pyspark.sql import functions as F

from ..common import spread
from ..functions.text import GOAL_STOPWORDS
from ..operators import components as C
from ..operators import findings as E
from ..operators import search as Q
from ..session import materialise
from . import register
from .findings import SPOTS
from .views import r2, rounded

WORD = "[A-Za-z_][A-Za-z0-9_./-]+"
STOP = ", ".join(f"'{w}'" for w in GOAL_STOPWORDS)


def turn_goals(t):
    """Every user turn is a goal; the whole text counts."""
    c = t.conversations.where("role = 'user'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("goal_id"), "text")


@register(
    "token_weights",
    f"""WITH g AS (SELECT concat(conv_id, '-', turn) AS goal_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)),
        lambda x: length(x) >= 3 AND x NOT IN ({STOP}))) AS ws FROM conversations WHERE role = 'user'),
    w AS (SELECT goal_id, unnest(ws) AS token FROM g),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(lower(text), '/-.', '   '), '{WORD}'))) AS token FROM documents WHERE trim(text) <> ''),
    n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''),
    c AS (SELECT token, count(*) AS df FROM d WHERE token IN (SELECT token FROM w) GROUP BY token),
    j AS (SELECT goal_id, token, coalesce(df, 0) AS df, n FROM w LEFT JOIN c USING (token), n)
    SELECT goal_id, token, {rounded('CASE WHEN df / CAST(n AS DOUBLE) <= 0.05 THEN 1.0 ELSE least(1.0, greatest(0.2, ln((n + 1.0) / (df + 1.0)))) END', 6)} AS weight FROM j WHERE df / CAST(n AS DOUBLE) < 0.6""",
)
def token_weights(t):
    return Q.token_weights(turn_goals(t), t.documents.select("text")).withColumn("weight", F.round("weight", 6))


# --- goals over parts: a goal per nation names a part, components are brands ---------------


def part_files(t):
    return t.v_parts.select("path", F.concat(F.lit("pkg:"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("component"), "p_partkey", "p_name", "p_size")


def part_goals(t):
    parts = spread(t.part.select((F.col("p_partkey") % 25).alias("k"), "p_partkey", "p_name")).groupBy("k").agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    text = F.concat(F.lit("Improve "), "p_name", F.lit(" and Brand"), F.col("n_nationkey") % 7, F.when(F.col("n_nationkey") % 2 == 0, " gateway").otherwise(" tests"))
    goals = t.nation.join(parts, F.col("n_nationkey") == F.col("k")).select(F.col("n_nationkey").alias("goal_id"), text.alias("text"))
    # A row per nation, which every step below asks for.
    return materialise(goals, "goals")


def part_descriptors(t):
    # The least and greatest names make the aggregate sort, so its rows are spread; a row per brand is stored.
    agg = spread(part_files(t).select("component", "p_name", "p_size")).groupBy("component").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    none = F.array().cast("array<string>")
    rows = agg.select(
        "component",
        F.when(F.col("size") % 3 == 0, "interface_adapter").otherwise("application_domain").alias("layer_role"),
        F.concat(F.lit("holds "), "lo").alias("responsibility_summary"),
        F.array("hi").alias("primary_symbols"),
        none.alias("descriptor_terms"),
        none.alias("test_anchors"),
        none.alias("neighbours"),
        (F.col("n") % 10 / 10.0).alias("confidence"),
    )
    return materialise(rows, "descriptors")


def part_signatures(t):
    return t.v_parts.select("path", F.concat(F.lit("Make_"), F.regexp_replace("p_name", " ", "_")).alias("name"))


def part_weights(t):
    goals = part_goals(t)
    return goals, materialise(Q.token_weights(goals, spread(t.v_parts.select(F.col("path").alias("text")))), "weights")


def scored(t):
    goals, weights = part_weights(t)
    hot = part_files(t).select("path", F.lit(0).alias("critical"), F.col("p_size").alias("warning")).where("warning > 40")
    rows = Q.score_files(part_files(t), part_signatures(t), part_descriptors(t), goals, weights, hot)
    # The score table feeds the cut, the component scores, the targets and the batches.
    return materialise(rows, "scores")


_GOALS = f"""fi AS (SELECT path, concat('pkg:', lower(replace(p_brand, '#', ''))) AS component, p_partkey, p_name, p_size FROM v_parts),
    pk AS (SELECT p_partkey % 25 AS k, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1),
    go AS (SELECT n_nationkey AS goal_id, concat('Improve ', p_name, ' and Brand', n_nationkey % 7, CASE WHEN n_nationkey % 2 = 0 THEN ' gateway' ELSE ' tests' END) AS text FROM nation JOIN pk ON k = n_nationkey),
    gt AS (SELECT goal_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({STOP})))) AS token FROM go),
    dt AS (SELECT path, unnest(list_distinct(regexp_extract_all(translate(lower(path), '/-.', '   '), '{WORD}'))) AS token FROM fi),
    df AS (SELECT token, count(*) AS df FROM dt GROUP BY token), nn AS (SELECT count(*) AS n FROM fi),
    tw AS (SELECT goal_id, token, CASE WHEN coalesce(df, 0) / CAST(n AS DOUBLE) <= 0.05 THEN 1.0 ELSE least(1.0, greatest(0.2, ln((n + 1.0) / (coalesce(df, 0) + 1.0)))) END AS w
      FROM gt LEFT JOIN df USING (token), nn WHERE coalesce(df, 0) / CAST(n AS DOUBLE) < 0.6),
    ph AS (SELECT goal_id, path, greatest(1, CAST(round_even(CAST(w AS DOUBLE) * 5, 0) AS INT)) AS p, 'path:' || token AS e FROM tw JOIN fi ON contains(lower(path), token)),
    sh AS (SELECT goal_id, path, greatest(1, CAST(round_even(CAST(w AS DOUBLE) * 3, 0) AS INT)) AS p, 'symbol:' || token AS e FROM tw JOIN fi ON contains('make_' || replace(p_name, ' ', '_'), token)),
    ds AS (SELECT component, CASE WHEN sum(p_size) % 3 = 0 THEN 'interface_adapter' ELSE 'application_domain' END AS layer_role, min(p_name) AS lo, max(p_name) AS hi, count(*) % 10 / 10.0 AS conf FROM fi GROUP BY component),
    dm AS (SELECT goal_id, component, conf, count(*) AS m FROM tw JOIN ds ON contains(lower(concat_ws(chr(10), component, layer_role, 'holds ' || lo, hi)), token) GROUP BY ALL),
    db AS (SELECT goal_id, component, least(8, 2 + m + CAST(round_even(CAST(conf AS DOUBLE) * 2, 0) AS INT)) AS p FROM dm WHERE m >= 2 OR conf >= 0.7),
    ff AS (SELECT component, path FROM fi),
    dh AS (SELECT goal_id, path, p, 'descriptor:' || component AS e FROM db JOIN ff USING (component)),
    ea AS (SELECT goal_id, path, sum(p) AS p, list(DISTINCT e) AS es FROM (SELECT * FROM ph UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM dh) GROUP BY ALL),
    pn AS (SELECT goal_id, path, CASE WHEN goal_id % 2 = 1 AND layer_role = 'interface_adapter' THEN greatest(0, p - 9) ELSE p END AS p,
      CASE WHEN goal_id % 2 = 1 AND layer_role = 'interface_adapter' THEN list_append(es, 'infra_penalty') ELSE es END AS es FROM ea JOIN fi USING (path) JOIN ds USING (component)),
    cm AS (SELECT goal_id, component, CASE WHEN contains(lower(text), 'pkg') AND contains(lower(text), split_part(component, ':', 2)) THEN 4
        WHEN contains(lower(text), 'pkg') OR contains(lower(text), split_part(component, ':', 2)) THEN 2 END AS p FROM go, ds),
    ch AS (SELECT goal_id, path, p, ['component:' || component] AS es FROM cm JOIN ff USING (component) WHERE p IS NOT NULL),
    la AS (SELECT goal_id, path, sum(p) AS p, flatten(list(es)) AS es FROM (SELECT * FROM pn UNION ALL SELECT * FROM ch) GROUP BY ALL),
    sc AS (SELECT goal_id, path, component, CAST(p + CASE WHEN p_size > 40 THEN least(6, p_size // 3) ELSE 0 END AS BIGINT) AS score,
      list_sort(list_distinct(CASE WHEN p_size > 40 THEN list_append(es, 'hotspot') ELSE es END)) AS es FROM la JOIN fi USING (path))"""


@register("file_scores", f"WITH {_GOALS} SELECT goal_id, path, component, score, array_to_string(es, ';') AS evidence FROM sc")
def file_scores(t):
    return scored(t).withColumn("evidence", F.array_join("evidence", ";"))


_CUT = f"""{_GOALS}, kp AS (SELECT * FROM sc WHERE (len(list_filter(es, lambda x: regexp_matches(x, '^(hint|component|descriptor):'))) > 0
      OR (score >= 4 AND len(list_filter(es, lambda x: regexp_matches(x, '^(path|symbol):'))) > 0))),
    cu AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, path) AS rank FROM kp)"""


@register("candidate_cut", f"WITH {_CUT} SELECT goal_id, path, score, CAST(rank AS INT) AS rank FROM cu WHERE rank <= 20")
def candidate_cut(t):
    return Q.cut_candidates(scored(t)).select("goal_id", "path", "score", "rank")


_TOP3 = """r3 AS (SELECT component, path, score, row_number() OVER (PARTITION BY component ORDER BY score DESC, path) AS i FROM {src} WHERE score > 0)"""


@register(
    "component_goal",
    f"""WITH sp AS (SELECT DISTINCT component, path FROM v_find), sv AS (SELECT component, s.path, CAST(round(score) AS BIGINT) AS score FROM ({SPOTS}) s JOIN sp USING (path)),
    {_TOP3.format(src='sv')}, a AS (SELECT component, sum(score * CASE i WHEN 1 THEN 100 WHEN 2 THEN 65 ELSE 35 END) / 100.0 AS s FROM r3 WHERE i <= 3 GROUP BY component),
    n AS (SELECT component, count(DISTINCT path) AS paths FROM sv WHERE score > 0 GROUP BY component)
    SELECT component, {r2('s + least(3.0, greatest(0.0, paths - 1.0))')} AS score, paths FROM a JOIN n USING (component)""",
)
def component_goal(t):
    spots = E.hotspots(t.v_find, top_n=None, details=False).select("path", F.round("score").cast("long").alias("score"))
    return Q.component_goal(t.v_find.select("component", "path").distinct().join(spots, "path"))


_TARGETS = f"""{_CUT}, cc AS (SELECT goal_id, component, path, score, row_number() OVER (PARTITION BY goal_id, component ORDER BY score DESC, path) AS i FROM cu WHERE rank <= 20 AND score > 0),
    cg AS (SELECT goal_id, component, {r2('sum(score * CASE i WHEN 1 THEN 100 WHEN 2 THEN 65 ELSE 35 END) FILTER (i <= 3) / 100.0 + least(3.0, count(*) - 1.0)')} AS score FROM cc GROUP BY ALL),
    ct AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, component) AS pos FROM cg),
    ca AS (SELECT ct.*, CASE WHEN score >= 8 THEN 1 WHEN score >= 4 THEN 2 ELSE 3 END AS tr FROM ct JOIN ds USING (component) WHERE pos <= 10 AND (goal_id % 2 = 0 OR layer_role <> 'interface_adapter')),
    bt AS (SELECT goal_id, min(tr) AS tier FROM ca GROUP BY goal_id),
    ch2 AS (SELECT ca.*, tier, row_number() OVER (PARTITION BY goal_id ORDER BY pos) AS rank FROM ca JOIN bt USING (goal_id) WHERE tr <= tier OR tier = 3)"""


def targets(t, cut=None):
    goals = part_goals(t)
    ranked = Q.component_goal(Q.cut_candidates(scored(t)) if cut is None else cut)
    d = part_descriptors(t)
    roles = d.select("component", (F.col("layer_role") == "interface_adapter").alias("infra"))
    spots = E.hotspots(t.v_find, 30, details=False).withColumn("component", F.concat(F.substring_index("path", "/", 1), F.lit(":core")))
    return materialise(Q.target_components(ranked, goals, roles, spots), "targets")


@register(
    "target_components",
    f"""WITH {_TARGETS}, hs AS (SELECT concat(split_part(path, '/', 1), ':core') AS component, score, row_number() OVER (ORDER BY score DESC, critical DESC, path) AS r FROM ({SPOTS})),
    hc AS (SELECT component, arg_min(score, r) AS score, min(r) AS f FROM hs WHERE r <= 30 GROUP BY component),
    fb AS (SELECT goal_id, component, score, row_number() OVER (PARTITION BY goal_id ORDER BY f) AS rank FROM go, hc WHERE goal_id NOT IN (SELECT goal_id FROM bt))
    SELECT goal_id, component, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank, CAST(tier AS INT) AS tier FROM ch2 WHERE rank <= CASE tier WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 1 END
    UNION ALL SELECT goal_id, component, score, CAST(rank AS INT), 4 FROM fb WHERE rank <= 3""",
)
def target_components(t):
    return targets(t)


def _batches(t):
    cut = Q.cut_candidates(scored(t))
    evidence = cut.select("goal_id", "component", "path", F.col("rank").alias("ord"))
    files = part_files(t).select("component", "path", F.col("p_partkey").alias("ord"))
    spots = part_files(t).where("p_size > 45").orderBy(F.desc("p_size"), "path").limit(24).select("path", F.lit(1).alias("rank"))
    d = part_descriptors(t)
    scores = d.select("component", F.when(F.col("confidence") < 0.3, "block").otherwise("approve").alias("recommendation"), F.lit(0).alias("critical"), "layer_role")
    goals, roles = part_goals(t), d.select("component", (F.col("layer_role") == "interface_adapter").alias("infra"))
    wanted = Q.fallback_targets(targets(t, cut), goals, d.select("component", (F.col("confidence") * 100).alias("score")), roles)
    return Q.change_batches(wanted, evidence, files, spots, scores)


@register("change_batches")
def change_batches(t):
    return _batches(t)[0]


@register("batch_focus_files")
def batch_focus_files(t):
    return _batches(t)[1]


@register(
    "match_tests",
    """WITH te AS (SELECT concat('tests/test_', replace(p_name, ' ', '_'), '_', p_partkey, '.py') AS path FROM part),
    hl AS (SELECT p_type AS "group", p_size AS ord, list_distinct(flatten(list([split_part(p_name, ' ', 1), concat('_', p_partkey % 97, '.')]))) AS hs FROM part GROUP BY p_type, p_size),
    hi AS (SELECT "group", ord, unnest(hs) AS hint FROM hl),
    hh AS (SELECT "group", path, min(ord) AS ord FROM hi JOIN te ON contains(lower(path), hint) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY ord, path) AS rank FROM hh)
    SELECT "group", path, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""",
)
def match_tests(t):
    tests = t.part.select(F.concat(F.lit("tests/test_"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), "p_partkey", F.lit(".py")).alias("path"))
    own = F.array(F.substring_index("p_name", " ", 1), F.concat(F.lit("_"), F.col("p_partkey") % 97, F.lit(".")))
    # The words of a batch are few: part names use a small vocabulary and the numbers are below 97.
    batches = t.part.groupBy(F.col("p_type").alias("group"), F.col("p_size").alias("ord")).agg(F.array_distinct(F.flatten(F.collect_set(own))).alias("hints"))
    return Q.match_tests(tests, batches)


@register(
    "test_anchors",
    """WITH c AS (SELECT DISTINCT concat(split_part(p_name, ' ', 1), ':', split_part(p_name, ' ', 2)) AS component FROM part),
    te AS (SELECT concat('tests/test_', replace(p_name, ' ', '_'), '_', p_partkey, '.py') AS path FROM part),
    h AS (SELECT DISTINCT component, path FROM c JOIN te ON (length(split_part(component, ':', 1)) >= 4 AND contains(path, split_part(component, ':', 1)))
      OR (length(split_part(component, ':', 2)) >= 4 AND contains(path, split_part(component, ':', 2)))),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY path) AS i FROM h)
    SELECT component, string_agg(path, ',' ORDER BY i) AS test_anchors FROM r WHERE i <= 8 GROUP BY component""",
)
def test_anchors(t):
    tests = t.part.select(F.concat(F.lit("tests/test_"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), "p_partkey", F.lit(".py")).alias("path"))
    comps = t.part.select(F.concat(F.substring_index("p_name", " ", 1), F.lit(":"), F.substring_index("p_name", " ", -1)).alias("component")).distinct()
    return Q.test_anchors(comps, tests).withColumn("test_anchors", F.array_join("test_anchors", ","))


def questions(t):
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text")


@register("question_routing")
def question_routing(t):
    """Every conversation turn asks; the components are source and language of the documents."""
    files = t.v_files.select("path", "component")
    agg = t.v_files.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"))
    none = F.array().cast("array<string>")
    d = agg.select(
        "component",
        F.when(F.col("lang") == "es", "interface_adapter").otherwise("application_domain").alias("layer_role"),
        F.concat(F.lit("documents in "), "lang").alias("responsibility_summary"),
        none.alias("primary_symbols"),
        none.alias("descriptor_terms"),
        none.alias("test_anchors"),
        none.alias("neighbours"),
        (F.col("n") % 10 / 10.0).alias("confidence"),
    )
    return Q.route_questions(questions(t), files, d).withColumn("score", F.coalesce("score", F.lit(-1)))


@register("component_evidence")
def component_evidence(t):
    files = t.v_find.select("path", "component").distinct()
    signatures = t.v_find.select("component", F.col("symbol").alias("name"))
    out = Q.component_evidence(files, signatures, t.v_find, C.component_graph(t.v_edge))
    return out.select(
        "component", "file_count", "signature_count", "critical", "warning", "info",
        F.array_join("hotspots", ",").alias("hotspots"),
        F.array_join(F.transform("edges", lambda e: F.concat_ws("=", e["dst_component"], e["weight"].cast("string"))), ",").alias("edges"),
    )
