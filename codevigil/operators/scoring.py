"""Scoring models: full, incremental and overall score, structure and governance dimensions.

A policy is a row of doubles named by dotted keys (``fixed.POLICY``). Pass a dict
for one policy, or a frame from ``resolve_policy`` to use one policy per repo.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..common import attach, clamp, count_if, lookup, r2, scope_of
from ..functions.scores import grade, recommend

Policy = Mapping[str, float] | DataFrame


def with_policy(df: DataFrame, policy: Policy | None) -> tuple[DataFrame, Callable[[str], Column]]:
    """Attach the policy; returns the frame and a function from a dotted key to its column."""
    if isinstance(policy, DataFrame):
        return df.join(policy, scope_of(df, policy), "left"), lambda key: F.coalesce(
            F.col(f"`{key}`"), F.lit(float(fixed.POLICY[key]))
        )
    values = {**fixed.POLICY, **(policy or {})}
    return df, lambda key: F.lit(float(values[key]))


def _drop_policy(df: DataFrame) -> DataFrame:
    return df.drop(*[f"{key}" for key in df.columns if key in fixed.POLICY])


def full_score(counts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Score of a set of findings (columns critical, warning, info; optional baseline_overall).

    Capped penalties after grace counts are taken from the base; thresholds relax
    with the penalty; many criticals block outright.
    """
    df, p = with_policy(counts, policy)
    if "baseline_overall" not in df.columns:
        df = df.withColumn("baseline_overall", F.lit(None).cast("double"))

    def penalty(name: str) -> Column:
        over = F.greatest(F.col(name) - p(f"full.grace.{name}"), F.lit(0.0))
        return F.least(p(f"full.max.{name}"), over * p(f"full.per.{name}"))

    from_baseline = clamp(F.coalesce(F.col("baseline_overall") * 10.0, F.lit(100.0)), 0.0, 100.0)
    base = F.when(p("full.base.from_baseline") > 0, from_baseline).otherwise(clamp(p("full.base.fixed"), 0.0, 100.0))
    df = df.withColumns({"_pc": penalty("critical"), "_pw": penalty("warning"), "_pi": penalty("info"), "base_score": base})
    df = df.withColumn("penalty_total", F.col("_pc") + F.col("_pw") + F.col("_pi"))
    total = F.col("penalty_total")
    adaptive = p("full.adaptive.enabled") > 0
    pass_relief = F.least(p("full.adaptive.max_pass_relief"), total * p("full.adaptive.pass_relief"))
    warn_relief = F.least(p("full.adaptive.max_warn_relief"), total * p("full.adaptive.warn_relief"))
    pass_min = F.when(
        adaptive, F.greatest(p("full.adaptive.pass_floor"), p("full.pass_min") - pass_relief)
    ).otherwise(p("full.pass_min"))
    relaxed = F.greatest(p("full.adaptive.warn_floor"), p("full.warn_min") - warn_relief)
    df = df.withColumn("pass_min", pass_min)
    gap_top = F.col("pass_min") - p("full.adaptive.min_gap")
    warn_min = F.when(adaptive, F.greatest(F.lit(0.0), F.least(relaxed, gap_top))).otherwise(p("full.warn_min"))
    df = df.withColumns({"warn_min": warn_min, "_score": clamp(F.col("base_score") - total, 0.0, 100.0)})
    limit = p("full.critical_hard_limit")
    blocked = (limit > 0) & (F.col("critical") >= limit)
    df = df.withColumns(
        {
            "score": r2(F.col("_score")),
            "grade": grade(F.col("_score")),
            "recommendation": F.when(blocked, "block").otherwise(
                recommend(F.col("_score"), F.col("pass_min"), F.col("warn_min"))
            ),
            "penalty_critical": r2(F.col("_pc")),
            "penalty_warning": r2(F.col("_pw")),
            "penalty_info": r2(F.col("_pi")),
            "penalty_total": r2(total),
        }
    )
    return _drop_policy(df.drop("_pc", "_pw", "_pi", "_score", "baseline_overall"))


def incremental_score(components: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Score of a change set from its component scores, one row per repo and snapshot.

    ``components`` has score, churn, critical, recommendation, changed_files and
    optionally trend. No component at all scores 100 and approves.
    """
    scope = scope_of(components)
    df, p = with_policy(components, policy)
    if "trend" not in df.columns:
        df = df.withColumn("trend", F.lit("flat"))
    score = clamp(F.coalesce(F.col("score"), F.lit(0.0)), 0.0, 100.0)
    cap = p("incremental.churn_cap")
    weight = F.least(
        F.greatest(F.lit(1.0), F.coalesce(F.col("churn"), F.lit(0)) + F.lit(1.0)),
        F.when(cap > 0, F.greatest(F.lit(1.0), cap)).otherwise(F.lit(24.0)),
    )
    limit = p("incremental.critical_per_component")
    is_blocked = (
        (F.col("recommendation") == "block")
        | (score < p("incremental.score_floor"))
        | ((limit > 0) & (F.col("critical") >= limit))
    )
    keep = {k: F.first(p(k)).alias(k) for k in fixed.POLICY if k.startswith("incremental.")}
    rows = df.withColumns({"_w": weight, "_blocked": is_blocked, "_s": score})
    agg = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("component_total"),
        F.sum("changed_files").alias("changed_file_total"),
        # Scores have two decimals and weights are whole unless the cap is not: the sum is exact.
        F.sum(F.round(F.col("_s") * 100).cast("long") * F.col("_w")).alias("_ws"),
        F.sum("_w").alias("_wt"),
        F.sum("critical").alias("critical_total"),
        count_if(F.lower(F.trim("trend")) == "up").alias("trend_up_components"),
        count_if(F.col("_blocked")).alias("blocked_components"),
        count_if(~F.col("_blocked") & (F.col("_s") < p("incremental.warn_min"))).alias("weak_components"),
        *keep.values(),
    )

    def q(key: str) -> Column:
        return F.coalesce(F.col(f"`{key}`"), F.lit(float(fixed.POLICY[key])))

    raw = F.when(F.col("_wt") > 0, F.col("_ws") / F.col("_wt") / 100.0).otherwise(0.0)
    critical_total = F.coalesce("critical_total", F.lit(0))
    lost = F.least(q("incremental.max_critical"), critical_total * q("incremental.per_critical"))
    bonus = F.least(q("incremental.max_bonus"), F.col("trend_up_components") * q("incremental.trend_up"))
    empty = F.col("component_total") == 0
    value = F.when(empty, 100.0).otherwise(clamp(raw - lost + bonus, 0.0, 100.0))
    total_limit = q("incremental.critical_total")
    forced = ((total_limit > 0) & (critical_total >= total_limit)) | (
        F.col("blocked_components") > q("incremental.blocked_limit")
    )
    out = agg.withColumn("_value", value)
    verdict = recommend(F.col("_value"), q("incremental.pass_min"), q("incremental.warn_min"))
    return out.select(
        *scope,
        F.when(empty, "no_change").otherwise("incremental").alias("mode"),
        r2(F.col("_value")).alias("score"),
        grade(F.col("_value")).alias("grade"),
        F.when(empty, "approve").when(forced, "block").otherwise(verdict).alias("recommendation"),
        F.coalesce("changed_file_total", F.lit(0)).alias("changed_file_total"),
        "component_total",
        "blocked_components",
        "weak_components",
        critical_total.alias("critical_total"),
        "trend_up_components",
        r2(raw).alias("raw_weighted_score"),
        r2(lost).alias("critical_penalty"),
        r2(bonus).alias("macro_progress_bonus"),
    )


def overall_score(full: DataFrame, incremental: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Weighted mix of the full and the incremental score, one row per repo and snapshot."""
    scope = scope_of(full, incremental)
    left = full.select(*scope, F.col("score").alias("full_score"), F.col("recommendation").alias("full_verdict"))
    right = incremental.withColumnsRenamed({"score": "incremental_score", "recommendation": "incremental_verdict"})
    # Without scope keys both sides are one-row aggregates.
    joined = attach(left, right, scope)
    df, p = with_policy(joined, policy)
    idle = F.col("mode").isin("no_change", "not_applicable")
    low = (
        (p("overall.low_scope.enabled") > 0)
        & (F.col("changed_file_total") <= p("overall.low_scope.files"))
        & (F.col("component_total") <= p("overall.low_scope.components"))
        & (p("overall.low_scope.weight") < p("overall.weight.incremental"))
    )
    low_inc = clamp(p("overall.low_scope.weight"), 0.0, 1.0)
    inc = F.when(idle, 0.0).when(low, low_inc).otherwise(F.greatest(p("overall.weight.incremental"), F.lit(0.0)))
    ful = F.when(idle, 1.0).when(low, 1.0 - low_inc).otherwise(F.greatest(p("overall.weight.full"), F.lit(0.0)))
    df = df.withColumns({"_i": inc, "_f": ful})
    norm = F.col("_i") + F.col("_f")
    df = df.withColumns(
        {
            "weight_full": F.when(norm <= 0, 1.0).otherwise(F.col("_f") / norm),
            "weight_incremental": F.when(norm <= 0, 0.0).otherwise(F.col("_i") / norm),
        }
    )
    value = F.col("full_score") * F.col("weight_full") + F.col("incremental_score") * F.col("weight_incremental")
    df = df.withColumn("_value", value)
    by_increment = (
        (p("overall.escalate.incremental") > 0)
        & (F.col("incremental_verdict") == "block")
        & (
            (F.col("blocked_components") >= p("overall.escalate.min_blocked"))
            | (F.col("critical_total") >= p("overall.escalate.min_critical"))
        )
    )
    by_full = (p("overall.escalate.full") > 0) & (F.col("full_verdict") == "block")
    verdict = recommend(F.col("_value"), p("overall.pass_min"), p("overall.warn_min"))
    return df.select(
        *scope,
        r2(F.col("_value")).alias("score"),
        grade(F.col("_value")).alias("grade"),
        F.when(by_increment | by_full, "block").otherwise(verdict).alias("recommendation"),
        F.round("weight_full", 3).alias("weight_full"),
        F.round("weight_incremental", 3).alias("weight_incremental"),
        low.alias("low_scope"),
    )


# --- structure dimensions --------------------------------------------------------


def _excess(count: Column, grace: float, factor: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.greatest(count - F.lit(grace), F.lit(0.0)) * factor)


# Fixed values: (count, grace, factor, cap) of the penalties on counts by metric
MODULARITY_PENALTIES = [
    ("module_lines", 10.0, 1.4, 24.0),
    ("class_public_methods", 4.0, 1.2, 8.0),
    ("class_instance_attributes", 4.0, 1.0, 6.0),
]
MAINTAINABILITY_PENALTIES = [
    ("cyclomatic_complexity", 32.0, 0.45, 18.0),
    ("line_length_soft_hits", 55.0, 0.06, 6.0),
    ("line_length_hard_hits", 16.0, 0.22, 8.0),
    ("critical", 6.0, 0.55, 10.0),
]
BOUNDARY_WORDS = ["boundary", "layer", "ownership", "component"]
COUPLING_WORDS = ["coupling", "dependency"]


def structure_dimensions(summary: DataFrame) -> DataFrame:
    """Four finding-based dimensions from a ``summarize`` table (facet, key, n)."""
    scope = scope_of(summary)
    facet, key, n = F.col("facet"), F.col("key"), F.col("n")

    def counted(name: str) -> Column:
        kind = "severity" if name == "critical" else "metric"
        return F.coalesce(F.sum(F.when((facet == kind) & (key == name), n)), F.lit(0))

    def worded(words: list[str]) -> Column:
        return F.coalesce(F.sum(F.when((facet == "dimension") & key.rlike("|".join(words)), n)), F.lit(0))

    names = [r[0] for r in MODULARITY_PENALTIES + MAINTAINABILITY_PENALTIES]
    sums = summary.groupBy(*scope).agg(
        *[counted(name).alias(name) for name in names],
        worded(BOUNDARY_WORDS).alias("_boundary"),
        worded(COUPLING_WORDS).alias("_coupling"),
    )

    def penalties(rows: list[tuple[str, float, float, float]]) -> Column:
        return sum((_excess(F.col(name), grace, factor, cap) for name, grace, factor, cap in rows), F.lit(0.0))

    def score(cap: float, lost: Column) -> Column:
        return r2(F.greatest(F.lit(0.0), F.lit(100.0) - F.least(F.lit(cap), lost)))

    return sums.select(
        *scope,
        score(36.0, penalties(MODULARITY_PENALTIES)).alias("file_modularity"),
        score(40.0, F.col("_boundary") * 2.0).alias("boundary_clarity"),
        score(35.0, F.col("_coupling") * 2.4).alias("coupling_control"),
        score(36.0, penalties(MAINTAINABILITY_PENALTIES)).alias("maintainability"),
    )


def topology_dimension() -> Column:
    """Package topology score from flat_files, subpackages, misplaced, review, retained, wrappers, needs_folders."""
    flat, sub = F.col("flat_files"), F.col("subpackages")
    misplaced, review, retained = F.col("misplaced"), F.col("review"), F.col("retained")
    bonus = F.when(sub >= 6, 8.0).when(sub >= 3, 5.0).when(sub > 0, 2.5).otherwise(0.0)
    tidy = F.when(~F.col("needs_folders") & (flat <= 28) & (misplaced <= 18), 4.0).otherwise(0.0)
    wrapped = F.when(misplaced == 0, F.least(F.lit(4.0), F.col("wrappers") * 0.8)).otherwise(0.0)
    lost = (
        _excess(flat, 8.0, 1.25, 34.0)
        + F.least(F.lit(26.0), misplaced * 1.15)
        + F.least(F.lit(12.0), review * 1.4)
        + _excess(retained, 8.0, 1.6, 8.0)
    )
    return r2(clamp(F.lit(100.0) - lost + bonus + tidy + wrapped, 0.0, 100.0))


def structure_score(full_score_value: Column, dimensions: list[Column]) -> Column:
    """0.3 of the full score plus 0.7 of the mean dimension."""
    if not dimensions:
        return r2(full_score_value)
    mean = sum(dimensions, F.lit(0.0)) / F.lit(float(len(dimensions)))
    return r2(full_score_value * 0.3 + mean * 0.7)


# --- governance dimensions --------------------------------------------------------


def _rank_weighted(ranked: DataFrame, pressure: Column, weights: list[float], cap: float, factor: float, name: str) -> DataFrame:
    scope = scope_of(ranked)
    table = F.array(*[F.lit(int(round(w * 100))) for w in weights])
    weight = F.get(table, F.col("rank") - 1)
    top = ranked.where(F.col("rank") <= len(weights)).select(*scope, "rank", pressure.alias("_p"), weight.alias("_w"))
    # At most len(weights) rows per scope; pressures are rounded to 1e-6 so the sum does not depend on row order.
    micro = F.round(F.col("_p") * 1_000_000).cast("long")
    avg = F.sum(micro * F.col("_w")) / F.sum("_w") / 1_000_000.0
    value = F.coalesce(r2(clamp(F.lit(100.0) - F.least(F.lit(cap), avg * factor), 0.0, 100.0)), F.lit(100.0))
    return top.groupBy(*scope).agg(value.alias(name))


def hotspot_hygiene(ranked: DataFrame) -> DataFrame:
    """Rank-weighted pressure of the first 8 hotspots (rank, critical, warning, score, component_score)."""
    worn = F.greatest((F.lit(68.0) - F.col("component_score")) * 0.22, F.lit(0.0))
    pressure = F.least(
        F.lit(20.0),
        F.col("critical") * 5.5 + F.col("warning") * 1.35 + F.col("score") * 0.75 + F.coalesce(worn, F.lit(0.0)),
    )
    return _rank_weighted(ranked, pressure, fixed.HOTSPOT_RANK_WEIGHTS, 46.0, 2.2, "hotspot_hygiene")


def component_balance(ranked: DataFrame) -> DataFrame:
    """Rank-weighted pressure of the first 6 components (rank, risk_score, critical, warning, file_count)."""
    pressure = F.least(
        F.lit(18.0),
        F.col("risk_score") * 1.35
        + F.col("critical") * 5.0
        + F.col("warning") * 1.1
        + F.greatest(F.col("file_count") - 6, F.lit(0)) * 0.5,
    )
    return _rank_weighted(ranked, pressure, fixed.COMPONENT_RANK_WEIGHTS, 42.0, 2.0, "component_balance")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, 1.0).otherwise(clamp(part / whole, 0.0, 1.0))


def category_points(category: Column) -> Column:
    """Cleanup weight of a category in tenths."""
    tenths = {k: int(round(v * 10)) for k, v in fixed.CLEANUP_CATEGORY_WEIGHTS.items()}
    return lookup(category, tenths, int(round(fixed.OTHER_CATEGORY_WEIGHT * 10)))


def cleanup_hygiene() -> Column:
    """From candidate_total, review_required_total, expired_total, owner_total, ttl_total, expires_total, category_tenths."""
    n = F.col("candidate_total")
    coverage = (
        _ratio(F.col("owner_total"), n) + _ratio(F.col("ttl_total"), n) + _ratio(F.col("expires_total"), n)
    ) / 3.0
    lost = (
        F.least(F.lit(22.0), F.greatest(n - 1, F.lit(0)) * 1.8)
        + F.least(F.lit(20.0), F.col("review_required_total") * 2.8)
        + F.least(F.lit(22.0), F.col("expired_total") * 6.0)
        + F.least(F.lit(20.0), F.col("category_tenths") * 0.15)
    )
    return F.when(n <= 0, 100.0).otherwise(r2(clamp(F.lit(100.0) - lost + coverage * 8.0, 0.0, 100.0)))


def archive_readiness() -> Column:
    """From candidate_total, ready_total and review_total of the archive candidates."""
    n = F.col("candidate_total")
    value = (
        F.lit(68.0)
        + _ratio(F.col("ready_total"), n) * 28.0
        + F.least(F.lit(12.0), F.col("ready_total") * 2.0)
        - F.least(F.lit(18.0), F.col("review_total") * 3.0)
    )
    return F.when(n <= 0, 100.0).otherwise(r2(clamp(value, 0.0, 100.0)))


def semantic_alignment() -> Column:
    """From pool_total, status, reviewed_total, retire_now, archive_first, review and keep_active counts."""
    pool, reviewed = F.col("pool_total"), F.col("reviewed_total")
    base = F.greatest(reviewed, F.lit(1))
    value = (
        F.lit(72.0)
        + _ratio(reviewed, pool) * 14.0
        + _ratio(F.col("retire_now") + F.col("archive_first"), base) * 12.0
        - _ratio(F.col("review"), base) * 8.0
        - _ratio(F.col("keep_active"), base) * 4.0
    )
    return (
        F.when(pool <= 0, 100.0)
        .when(F.lower(F.trim(F.col("status"))) != "ok", 72.0)
        .otherwise(r2(clamp(value, 0.0, 100.0)))
    )
