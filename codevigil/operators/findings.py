"""Finding aggregates: summary, hotspots per path, risk per component, rubric score."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..common import attach, count_if, lookup, ordered_list, r2, scope_of, top_per, with_defaults
from ..functions.paths import norm_path
from ..session import materialise

#: Findings of a path that are shown as its samples.
SAMPLES = 4


def normalise_findings(findings: DataFrame) -> DataFrame:
    """Apply the reader defaults: lower-case facets, info/other/empty when missing, clean paths."""
    findings = with_defaults(
        findings,
        severity=("string", None),
        dimension=("string", None),
        metric=("string", None),
        symbol=("string", ""),
        message=("string", ""),
        value=("string", None),
        threshold=("string", None),
        ord=("long", 0),
    )
    return findings.withColumns(
        {
            "path": norm_path(F.col("path")),
            "severity": F.lower(F.coalesce("severity", F.lit("info"))),
            "dimension": F.lower(F.coalesce("dimension", F.lit("other"))),
            "symbol": F.trim(F.coalesce("symbol", F.lit(""))),
            "message": F.trim(F.coalesce("message", F.lit(""))),
        }
    )


def severity_points(severity: Column) -> Column:
    """Weight of a finding in hundredths, so that sums are exact."""
    return lookup(severity, fixed.SEVERITY_POINTS, fixed.OTHER_SEVERITY_POINTS)


def _severity_counts() -> list[Column]:
    return [count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")]


def summarize(findings: DataFrame, metric_limit: int | None = None) -> DataFrame:
    """Counts by severity, dimension and metric plus the total, as (facet, key, n).

    ``metric_limit`` keeps the most frequent metrics only (20 in a displayed summary); scores need all.

    One pass: the grouping sets share a single partial aggregate.
    """
    scope = scope_of(findings)
    rows = normalise_findings(findings).withColumn("metric", F.lower(F.coalesce("metric", F.lit("unknown"))))
    facets = ["severity", "dimension", "metric"]
    sets = [[F.col(c) for c in (*scope, f)] for f in facets] + [[F.col(c) for c in scope]]
    counted = rows.groupingSets(sets, *scope, *facets).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(f).alias("_" + f) for f in facets]
    )
    facet = F.lit("total")
    key = F.lit("all")
    for name in facets:
        facet = F.when(F.col("_" + name) == 0, name).otherwise(facet)
        key = F.when(F.col("_" + name) == 0, F.col(name)).otherwise(key)
    long = counted.select(*scope, facet.alias("facet"), key.alias("key"), "n")
    if metric_limit is None:
        return long
    ranked = top_per(
        long.where(F.col("facet") == "metric"), [*scope, "facet"], [F.desc("n"), F.asc("key")], metric_limit
    )
    return long.where(F.col("facet") != "metric").unionByName(ranked.drop("rank"))


def hotspot_scores(findings: DataFrame) -> DataFrame:
    """Per path: weighted score and severity counts."""
    scope = scope_of(findings)
    rows = normalise_findings(findings).where(F.col("path") != "")
    return (
        rows.groupBy(*scope, "path")
        .agg(F.sum(severity_points(F.col("severity"))).alias("points"), *_severity_counts())
        .withColumn("score", r2(F.col("points") / 100.0))
        .drop("points")
    )


def hotspot_order() -> list[Column]:
    return [F.desc("score"), F.desc("critical"), F.asc("path")]


def top_facets(findings: DataFrame, facet: str, n: int = 5) -> DataFrame:
    """The ``n`` commonest values of a facet per path, as a map, ties by name."""
    scope = scope_of(findings)
    counts = findings.groupBy(*scope, "path", facet).agg(F.count(F.lit(1)).alias("n"))
    kept = top_per(counts, [*scope, "path"], [F.desc("n"), F.asc(facet)], n)
    pair = ordered_list(F.struct(F.col(facet), F.col("n")), F.col("rank"))
    return kept.groupBy(*scope, "path").agg(F.map_from_entries(pair).alias(f"top_{facet}s"))


def first_samples(findings: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` findings of each path in input order (column ``ord``)."""
    scope = scope_of(findings)
    fields = ["severity", "dimension", "metric", "symbol", "message", "value", "threshold"]
    sample = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    order = [F.asc("ord"), *[F.asc(c) for c in ("severity", "metric", "symbol")]]
    kept = top_per(findings, [*scope, "path"], order, n)
    return kept.groupBy(*scope, "path").agg(ordered_list(sample, F.col("rank")).alias("samples"))


def hotspots(
    findings: DataFrame,
    top_n: int | None = 20,
    details: bool = True,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Paths ranked by weighted findings, with their commonest metrics and dimensions and first samples.

    With ``top_n`` the details are computed for the kept paths only: the cut paths
    (top_n per repo and snapshot) reduce the findings by a semi join first. ``keep`` does the same
    for the paths it selects from the scores; they are stored, since every detail reads them.
    """
    scope = scope_of(findings)
    scores = hotspot_scores(findings)
    if top_n is not None:
        scores = top_per(scores, scope, hotspot_order(), max(1, top_n))
    if keep is not None:
        scores = materialise(keep(scores), "kept-paths")
    if not details:
        return scores
    rows = normalise_findings(findings).withColumn("metric", F.lower(F.coalesce("metric", F.lit(""))))
    if top_n is not None or keep is not None:
        rows = rows.join(scores.select(*scope, "path"), [*scope, "path"], "left_semi")
    keys = [*scope, "path"]
    return (
        scores.join(top_facets(rows, "metric"), keys, "left")
        .join(top_facets(rows, "dimension"), keys, "left")
        .join(first_samples(rows), keys, "left")
    )


def component_risk(findings: DataFrame, file_limit: int = 20) -> DataFrame:
    """Per component: severity counts, weighted risk, distinct files, first files, labels."""
    scope = scope_of(findings)
    keys = [*scope, "component"]
    rows = normalise_findings(findings).where(F.col("path") != "")
    # Pre-aggregated per path first, so that a hot component is spread over its paths.
    per_path = rows.groupBy(*keys, "path").agg(
        F.sum(severity_points(F.col("severity"))).alias("points"), *_severity_counts()
    )
    totals = per_path.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in ("critical", "warning", "info")],
        r2(F.sum("points") / 100.0).alias("risk_score"),
        F.count(F.lit(1)).alias("file_count"),
    )
    first = top_per(per_path.select(*keys, "path"), keys, [F.asc("path")], file_limit)
    files = first.groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("files"))
    return totals.join(files, keys, "left").withColumn("labels", component_labels())


def component_labels() -> Column:
    found = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, "critical_findings"),
            F.when(F.col("risk_score") >= 8.0, "hotspot_concentration"),
            F.when(F.col("file_count") >= 8, "wide_component"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("watch")))


# Rubric dimensions with their weights in the overall score
RUBRIC_WEIGHTS = {
    "file_structure": 0.32,
    "file_size": 0.22,
    "code_style": 0.08,
    "encapsulation": 0.2,
    "complexity": 0.18,
}


def rubric_score(findings: DataFrame, files: DataFrame, weights: Mapping[str, float] = RUBRIC_WEIGHTS) -> DataFrame:
    """Score 1..10 per rubric dimension, and ``overall``, from log-damped finding density."""
    scope = scope_of(findings, files)
    dims = list(weights)
    # Weighted counts in quarters: critical 12, warning 4, everything else 1.
    quarters = F.when(F.col("severity") == "critical", 12).when(F.col("severity") == "warning", 4).otherwise(1)
    rows = normalise_findings(findings)
    sums = rows.groupBy(*scope).agg(
        *[F.sum(F.when(F.col("dimension") == d, quarters).otherwise(0)).alias(d) for d in dims]
    )
    sizes = files.groupBy(*scope).agg(F.count(F.lit(1)).alias("files"))
    both = attach(sizes, sums, scope, "left")
    spread = F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.col("files"), F.lit(1)).cast("double")))

    def dimension_score(d: str) -> Column:
        density = F.coalesce(F.col(d), F.lit(0)) / 4.0 / spread
        return F.greatest(F.lit(1.0), r2(F.lit(10.0) - F.least(F.lit(9.0), F.log2(F.lit(1.0) + density))))

    scored = both.select(*scope, *[dimension_score(d).alias(d) for d in dims])
    # Scores have two decimals and weights two: the sum is taken in whole ten-thousandths.
    total = sum(
        (F.round(F.col(d) * 100).cast("long") * int(round(w * 100)) for d, w in weights.items()), F.lit(0)
    )
    pairs = [*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dims]]
    pairs.append(F.struct(F.lit("overall").alias("dimension"), r2(total / 10000.0).alias("score")))
    return scored.select(*scope, F.inline(F.array(*pairs)))
