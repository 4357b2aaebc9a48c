"""Package topology over documents and parts."""

from pyspark.sql import functions as F

from ..operators import topology as Y
from . import register
from .views import rounded


@register(
    "source_root_vote",
    """WITH r AS (SELECT source AS root, count(*) AS n FROM v_files GROUP BY source)
    SELECT root AS source_root FROM r ORDER BY n DESC, root LIMIT 1""",
)
def source_root_vote(t):
    return Y.source_roots(t.v_files)


@register(
    "topology",
    """WITH r AS (SELECT p_type AS repo, count(*) AS n, count(DISTINCT CASE WHEN p_size % 10 = 0 THEN p_brand END) AS sub, count(*) FILTER (p_size % 10 <> 0) AS flat FROM part GROUP BY p_type)
    SELECT repo, 'src/pkg' AS source_root, flat AS flat_files, sub AS subpackages,
      CAST(round(CAST(greatest(0.0, 100.0 - least(45.0, greatest(flat - 10, 0) * 1.2) - CASE WHEN sub = 0 AND flat >= 12 THEN 18 ELSE 0 END - CASE WHEN flat >= 18 THEN 12 ELSE 0 END) AS DECIMAL(18,8)), 2) AS DOUBLE) AS flatness,
      flat >= 12 AND sub = 0 AS needs_folders FROM r""",
)
def topology(t):
    sub = F.when(F.col("p_size") % 10 == 0, F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"))).otherwise("")
    files = t.v_parts.select(F.col("p_type").alias("repo"), F.concat(F.lit("src/pkg/"), sub, F.substring_index("path", "/", -1)).alias("path"))
    return Y.topology(files).drop("group_total")


#: A project's own knowledge: folders of two name prefixes, and of modules that speak of reports.
RULES = Y.FolderRules(hints={"red": "red", "blue": "colour"}, terms=[(["report"], "reporting", 0.7)])


def direct(t):
    """Parts as direct modules of one package per part type: first word = group, second = secondary word."""
    return t.v_parts.select(F.col("p_type").alias("repo"), "path", F.array(F.lower("p_brand")).alias("descriptor_terms"))


_GROUPS = f"""pw AS (SELECT p_type AS repo, path, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s, p_partkey FROM v_parts),
    gb AS (SELECT repo, g AS group_id, count(*) AS file_count FROM pw GROUP BY ALL HAVING count(*) >= 2),
    sc AS (SELECT repo, g AS group_id, s, count(*) AS n FROM pw GROUP BY ALL),
    sh AS (SELECT repo, group_id, {rounded('max(n) / CAST(sum(n) AS DOUBLE)', 2)} AS cohesion, max(n) / CAST(sum(n) AS DOUBLE) AS co FROM sc GROUP BY ALL),
    gs AS (SELECT gb.*, cohesion, CASE WHEN file_count >= 5 AND co < 0.45 THEN 'mixed' ELSE 'cohesive' END AS status FROM gb JOIN sh USING (repo, group_id))"""


@register(
    "domain_groups",
    f"""WITH {_GROUPS}, fr AS (SELECT repo, g AS group_id, path, row_number() OVER (PARTITION BY repo, g ORDER BY path) AS i FROM pw)
    SELECT gs.*, group_id AS folder, CAST(1 AS BIGINT) AS folder_total, CAST(1 AS DOUBLE) AS folder_share,
      (SELECT string_agg(path, ',' ORDER BY i) FROM fr WHERE fr.repo = gs.repo AND fr.group_id = gs.group_id AND i <= 12) AS candidate_files FROM gs""",
)
def domain_groups(t):
    return Y.domain_groups(direct(t)).drop("evidence_terms").withColumn("candidate_files", F.array_join("candidate_files", ","))


@register("group_terms")
def group_terms(t):
    signatures = t.v_parts.select(F.col("p_type").alias("repo"), "path", F.concat(F.initcap("p_name"), F.lit("Widget")).alias("name"), F.col("p_size").alias("line"))
    return Y.domain_groups(direct(t), signatures).select("repo", "group_id", F.array_join("evidence_terms", ",").alias("evidence_terms"))


def placed(t):
    imports = t.v_parts.select(F.col("p_type").alias("repo"), "path", (F.col("p_size") % 12).alias("n"))
    vote_words = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("report"))).otherwise(F.array(F.lower("p_brand")))
    rows = t.v_parts.select(F.col("p_type").alias("repo"), "path", vote_words.alias("descriptor_terms"))
    return Y.placement(rows, imports, RULES)


_PLACED = """pl AS (SELECT p_type AS repo, path, split_part(p_name, ' ', 1) AS group_id,
      CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'colour' ELSE CASE WHEN p_size % 4 = 0 THEN 'reporting' ELSE split_part(p_name, ' ', 1) END END AS folder,
      CAST(CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 0.9 WHEN 'blue' THEN 0.84 ELSE CASE WHEN p_size % 4 = 0 THEN 0.7 ELSE 0.72 END END AS DOUBLE) AS confidence,
      p_size % 12 AS internal_imports FROM v_parts),
    pd AS (SELECT *, 'implementation' AS root_role, CASE WHEN confidence >= CASE WHEN internal_imports >= 6 THEN 0.84 ELSE 0.76 END THEN 'move' ELSE 'review' END AS decision FROM pl)"""


@register("root_placement", f"WITH {_PLACED} SELECT * FROM pd")
def root_placement(t):
    return placed(t)


@register(
    "membership_issues",
    f"WITH {_GROUPS} SELECT repo, group_id, 'info' AS severity, status, CAST(1 AS BIGINT) AS folder_total FROM gs WHERE status = 'mixed'",
)
def membership_issues(t):
    return Y.membership_issues(Y.domain_groups(direct(t)))


@register(
    "move_plan",
    f"""WITH {_GROUPS}, {_PLACED}, fr AS (SELECT repo, g, path FROM pw),
    mp AS (SELECT pd.repo, pd.path, CASE WHEN fr.path IS NOT NULL OR decision = 'move' THEN 'move' ELSE 'review' END AS action, folder FROM pd
      LEFT JOIN fr ON fr.repo = pd.repo AND fr.path = pd.path AND EXISTS (SELECT 1 FROM gb WHERE gb.repo = fr.repo AND gb.group_id = fr.g))
    SELECT repo, path, action, CASE WHEN action = 'move' THEN folder ELSE '' END AS folder,
      CASE WHEN action = 'move' THEN concat('src/pkg/', folder, '/', regexp_extract(path, '[^/]+$')) ELSE '' END AS target FROM mp""",
)
def move_plan(t):
    plan = Y.move_plan(placed(t), Y.domain_groups(direct(t)))
    return plan.withColumns({c: F.coalesce(c, F.lit("")) for c in ("folder", "target")})


@register("move_phases")
def move_phases(t):
    groups = Y.domain_groups(direct(t))
    return Y.move_phases(groups, Y.move_plan(placed(t), groups)).withColumn("folders", F.array_join("folders", ","))
