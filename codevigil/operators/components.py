"""Components: change statistics, dependency graph, scores and descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import clamp, count_if, ordered_list, r2, scope_of, top_per, with_defaults
from ..functions.paths import file_name, is_hidden, is_noise_path, layer_marker_flags, norm_path, path_kind
from ..functions.scores import component_recommendation, grade
from ..functions.text import descriptor_tokens, symbol_rank
from ..session import materialise
from .findings import hotspot_order, hotspot_scores, normalise_findings


def component_stats(changes: DataFrame, findings: DataFrame, hotspots: DataFrame, ref_limit: int = 8) -> DataFrame:
    """Per component: churn, severity counts of findings on changed paths, and its first hotspot references.

    ``hotspots`` may be all of them, or a top-n table (200 in an interactive review). A path listed twice counts twice.
    """
    scope = scope_of(changes, findings, hotspots)
    changes = with_defaults(changes, ord=("long", 0)).withColumn("path", norm_path(F.col("path")))
    changes = changes.where(F.col("path") != "")
    keys = [*scope, "component"]
    # Both sides shrink to one row per path before they meet, so no path is hot in the join.
    per_path = changes.groupBy(*keys, "path").agg(
        F.sum(F.coalesce("added", F.lit(0))).alias("added"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted"),
        F.count(F.lit(1)).alias("times"),
    )
    found = hotspot_scores(findings).drop("score")
    joined = per_path.join(found, [*scope, "path"], "left")
    stats = joined.groupBy(*keys).agg(
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.sum("times").alias("changed_rows"),
        F.count(F.lit(1)).alias("changed_files"),
        *[F.sum(F.col("times") * F.coalesce(s, F.lit(0))).alias(s) for s in ("critical", "warning", "info")],
    )
    spots = hotspots.select(*scope, "path", "score", "critical", "warning")
    refs = top_per(
        changes.select(*keys, "path", "ord").join(spots, [*scope, "path"]), keys, [F.asc("ord"), F.asc("path")], ref_limit
    )
    ref = F.struct("path", "score", "critical", "warning")
    listed = refs.groupBy(*keys).agg(ordered_list(ref, F.col("rank")).alias("hotspot_refs"))
    return stats.join(listed, keys, "left")


def component_graph(
    edges: DataFrame, path_limit: int = 6, excluded_prefixes: Sequence[str] = ()
) -> DataFrame:
    """Weight between components, with the heaviest target paths.

    Drops self edges, tests, temporary components, excluded prefixes and target
    paths that are noise (tests, docs, fixtures, generated, hidden, infra).
    """
    scope = scope_of(edges)
    pair = [*scope, "src_component", "dst_component"]
    rows = edges.where(
        (F.coalesce("src_component", F.lit("")) != "")
        & (F.coalesce("dst_component", F.lit("")) != "")
        & (F.col("src_component") != F.col("dst_component"))
        & ~F.col("dst_component").endswith(":tests")
        & ~F.col("dst_component").startswith("tmp_")
    )
    weight = F.greatest(F.lit(1), F.coalesce(F.col("weight"), F.lit(1)))
    # What a path is is asked once per distinct path, not once per edge. The paths are stored before and after, since
    # the optimizer moves the question below a distinct and to the other side of a join. Few stored paths are known
    # to be few: then the edges meet them where they are read, and are shuffled as sums only.
    known = materialise(rows.select(F.col("dst_path").alias("raw")).distinct(), "paths")
    known = known.withColumn("dst_path", norm_path(F.col("raw"))).where((F.col("dst_path") != "") & ~is_noise_path(F.col("dst_path")))
    for prefix in excluded_prefixes:
        known = known.where(~F.col("dst_path").startswith(prefix))
    known = materialise(known, "paths")
    weighed = rows.select(*pair, F.col("dst_path").alias("raw"), weight.alias("weight"))
    per_path = weighed.join(known, "raw").groupBy(*pair, "dst_path").agg(F.sum("weight").alias("weight"))
    # The sum per path is sorted once per pair, for the total and the heaviest paths alike; a long pair spills.
    own = W.partitionBy(*pair)
    ranked = per_path.dropna(subset=scope) if scope else per_path
    ranked = ranked.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("weight"), F.asc("dst_path"))), "total": F.sum("weight").over(own)})
    return ranked.where(F.col("rank") <= path_limit).groupBy(*pair).agg(
        F.max("total").alias("weight"), ordered_list(F.col("dst_path"), F.col("rank")).alias("target_paths")
    )


def component_neighbors(graph: DataFrame, limit: int = 8) -> DataFrame:
    """Heaviest neighbours of each component, ranked."""
    keys = [*scope_of(graph), "src_component"]
    return top_per(graph, keys, [F.desc("weight"), F.asc("dst_component")], max(1, limit))


def structural_penalty(critical: Column, warning: Column, role: Column, neighbours: Column) -> Column:
    """4 for criticals in an orchestration or interface component; 2 or 1 for pressure on a connected one."""
    exposed = F.when((critical > 0) & role.isin("orchestration", "interface_adapter"), 4.0).otherwise(0.0)
    connected = (
        F.when((critical > 0) & (neighbours >= 3), 2.0).when((warning > 0) & (neighbours >= 5), 1.0).otherwise(0.0)
    )
    return exposed + connected


def component_score(stats: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Score, grade and recommendation of each changed component.

    ``descriptors`` gives ``layer_role`` and ``neighbour_count`` per component.
    """
    scope = scope_of(stats, descriptors)
    keys = [*scope, "component"]
    context = descriptors.select(*keys, "layer_role", "neighbour_count")
    c, w, i = F.col("critical"), F.col("warning"), F.col("info")
    churn = F.col("added") + F.col("deleted")
    # Hundredths throughout: every term is a whole number of hundredths.
    lost = (
        F.least(F.lit(6000), c * 1800)
        + F.least(F.lit(2400), w * 400)
        + F.least(F.lit(1000), i * 100)
        + F.least(F.lit(2000), churn * 4)
        + structural_penalty(
            c, w, F.coalesce("layer_role", F.lit("")), F.coalesce("neighbour_count", F.lit(0))
        )
        * 100
    )
    scored = stats.join(context, keys, "left").withColumn("churn", churn)
    scored = scored.withColumn("score", r2(clamp(F.lit(100.0) - lost / 100.0, 0.0, 100.0)))
    return scored.withColumns(
        {"grade": grade(F.col("score")), "recommendation": component_recommendation(F.col("score"), c)}
    )


# --- descriptors ---------------------------------------------------------------


def primary_symbols(signatures: DataFrame, limit: int = 12) -> DataFrame:
    """Best symbols per component: rank, then how often they occur, then length, then name."""
    keys = [*scope_of(signatures), "component"]
    named = signatures.withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
    named = named.withColumn("sym_rank", symbol_rank(F.col("name"))).where(F.col("sym_rank") > 0)
    counted = named.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.max("sym_rank").alias("sym_rank"))
    order = [F.desc("sym_rank"), F.desc("n"), F.desc(F.length("name")), F.asc("name")]
    kept = top_per(counted, keys, order, limit)
    return kept.groupBy(*keys).agg(ordered_list(F.col("name"), F.col("rank")).alias("primary_symbols"))


def component_roles(files: DataFrame) -> DataFrame:
    """Layer role per component from its name and all its paths, without collecting the paths."""
    keys = [*scope_of(files), "component"]
    text = F.lower(F.concat_ws(" ", "component", "path"))
    flags = layer_marker_flags(text)
    seen = files.groupBy(*keys).agg(
        F.max(F.contains(text, F.lit("/tests/"))).alias("_tests"), *[F.max(flag).alias(role) for role, flag in flags]
    )
    role = F.when(F.col("component").endswith(":tests") | F.col("_tests"), "tests")
    for name, _ in flags:
        role = role.when(F.col(name), name)
    return seen.select(*keys, role.otherwise("application_domain").alias("layer_role"))


def responsibility_summary() -> Column:
    """One sentence per known fact of the component."""
    role = F.regexp_replace("layer_role", "_", " ")
    article = F.when(role.rlike("^[aeiou]"), "an").otherwise("a")
    symbols = F.concat_ws(", ", F.slice("primary_symbols", 1, 3))
    spots = F.concat_ws(", ", F.transform(F.slice("hotspot_paths", 1, 2), file_name))
    near = F.concat_ws(", ", F.slice("neighbours", 1, 3))
    return F.concat_ws(
        " ",
        F.format_string("%s is %s %s component spanning %d files.", "component", article, role, "file_count"),
        F.concat(
            F.lit("Primary surfaces: "),
            F.when(symbols == "", "no clear dominant public surface").otherwise(symbols),
            F.lit("."),
        ),
        F.when(spots != "", F.concat(F.lit("Current pressure points: "), spots, F.lit("."))),
        F.when(near != "", F.concat(F.lit("Primary adjacent components: "), near, F.lit("."))),
    )


def descriptor_confidence() -> Column:
    """0.35 plus steps for files, symbols, hotspots and neighbours; at most 0.95."""

    def step(flag: Column, value: int) -> Column:
        return F.when(flag, value).otherwise(0)

    points = (
        F.lit(35)
        + step(F.col("file_count") >= 1, 15)
        + step(F.col("file_count") >= 3, 10)
        + step(F.size("primary_symbols") >= 2, 15)
        + step(F.size("hotspot_paths") > 0, 10)
        + step(F.size("neighbours") > 0, 5)
    )
    return F.least(points, F.lit(95)) / 100.0


def _file_and_symbol_terms(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """Distinct words of all symbols and of all paths of each component, sorted."""
    keys = [*scope_of(files, signatures), "component"]
    named = signatures.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).where(symbol_rank(F.col("name")) > 0)

    def words(df: DataFrame, text: str) -> DataFrame:
        return df.select(*keys, F.explode(descriptor_tokens(F.col(text))).alias("term")).distinct()

    both = words(named, "name").withColumn("symbol", F.lit(True)).unionByName(words(files, "path").withColumn("symbol", F.lit(False)))
    lists = {"_symbol_terms": F.col("symbol"), "_file_terms": ~F.col("symbol")}
    return both.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(own, F.col("term")))).alias(n) for n, own in lists.items()])


def descriptors(
    files: DataFrame,
    signatures: DataFrame,
    findings: DataFrame,
    edges: DataFrame,
    test_anchors: DataFrame | None = None,
    hotspot_limit: int | None = None,
    file_limit: int | None = None,
    term_limit: int | None = None,
) -> DataFrame:
    """One descriptor per component. ``files`` has path and component.

    Hotspots are the first six of the component itself. Terms are all distinct words of the component, its role and
    summary, then of its symbols and files. ``hotspot_limit`` keeps the first hotspots of the whole scope,
    ``file_limit`` the first files of a component and ``term_limit`` the first terms only.
    """
    scope = scope_of(files, signatures, findings, edges)
    keys = [*scope, "component"]
    files = files.select(*keys, "path").distinct()
    base = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"))
    first = files if file_limit is None else top_per(files, keys, [F.asc("path")], file_limit)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("files"))
    rows = normalise_findings(findings)
    severities = rows.groupBy(*keys).agg(*[count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    per_path = rows.select(*keys, "path").distinct()
    spots = hotspot_scores(findings)
    if hotspot_limit is not None:
        spots = top_per(spots, scope, hotspot_order(), hotspot_limit).drop("rank")
    spots = top_per(spots.join(per_path, [*scope, "path"]), keys, hotspot_order(), 6)
    hot = spots.groupBy(*keys).agg(ordered_list(F.col("path"), F.col("rank")).alias("hotspot_paths"))
    near = component_neighbors(component_graph(edges), 8).groupBy(*scope, F.col("src_component").alias("component"))
    near = near.agg(ordered_list(F.col("dst_component"), F.col("rank")).alias("neighbours"))
    out = base
    words = _file_and_symbol_terms(files, signatures)
    for part in (listed, severities, hot, near, primary_symbols(signatures), component_roles(files), words):
        out = out.join(part, keys, "left")
    if test_anchors is not None:
        out = out.join(test_anchors, keys, "left")
    else:
        out = out.withColumn("test_anchors", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    for name in ("files", "hotspot_paths", "neighbours", "primary_symbols", "test_anchors", "_symbol_terms", "_file_terms"):
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    out = out.withColumn("responsibility_summary", responsibility_summary())
    texts = F.concat_ws("\n", "component", "layer_role", "responsibility_summary", "primary_symbols")
    terms = F.array_distinct(F.concat(descriptor_tokens(texts), "_symbol_terms", "_file_terms"))
    return out.withColumns(
        {
            "descriptor_terms": terms if term_limit is None else F.slice(terms, 1, term_limit),
            "confidence": descriptor_confidence(),
            "neighbour_count": F.size("neighbours"),
            **{s: F.coalesce(F.col(s), F.lit(0)) for s in ("critical", "warning", "info")},
        }
    ).drop("_symbol_terms", "_file_terms")


def descriptor_search_text() -> Column:
    """Lower-case text that goals and questions are matched against."""
    return F.lower(
        F.concat_ws(
            "\n",
            "component",
            "layer_role",
            "responsibility_summary",
            "primary_symbols",
            "descriptor_terms",
            "test_anchors",
            "neighbours",
        )
    )


def first_party(files: DataFrame, excluded_prefixes: Sequence[str] = (), test_support: bool = False) -> DataFrame:
    """Files in the architecture (or test-support) scope: the manifest flag wins over the path kind."""
    flag = "include_in_test_support" if test_support else "include_in_architecture"
    files = with_defaults(files, **{flag: ("boolean", None), "kind": ("string", None)})
    path = norm_path(F.col("path"))
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), path_kind(path))
    by_kind = (kind == "test") if test_support else (path_kind(path) == "source")
    kept = files.where((path != "") & ~is_hidden(path) & F.coalesce(F.col(flag), by_kind))
    for prefix in excluded_prefixes:
        kept = kept.where(~path.startswith(prefix))
    return kept
