"""State across runs: debt ledger, regression gate, staleness, refresh signal, score and review trends, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import attach, count_if, lookup, ordered_list, scope_of, top_per, with_defaults
from ..functions.paths import norm_path, norm_scope_path
from .findings import normalise_findings


# --- set operations -----------------------------------------------------------


def union_first(*frames: DataFrame, key: str = "path") -> DataFrame:
    """Ordered union: the first source that holds a key supplies it; columns key, source, ord.

    ``min`` combines before the shuffle, so repeated keys travel once per task.
    """
    scope = scope_of(*frames)
    parts = [
        with_defaults(f, ord=("long", 0)).select(*scope, F.col(key), F.lit(i).alias("source"), F.col("ord").cast("long"))
        for i, f in enumerate(frames)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    place = F.min(F.struct("source", "ord")).alias("place")
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(*scope, key).agg(place).select(*scope, key, "place.*")


def key_changes(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both sides with ``status`` new, resolved or open: one aggregate instead of two anti joins."""
    scope = scope_of(current, previous)
    cols = [*scope, *keys]
    sides = current.select(*cols, F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        previous.select(*cols, F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    seen = sides.groupBy(*cols).agg(F.max("c").alias("c"), F.max("p").alias("p"))
    status = F.when(F.col("p") == 0, "new").when(F.col("c") == 0, "resolved").otherwise("open")
    return seen.select(*cols, status.alias("status"))


def only_in_first(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    cols = [*scope_of(left, right), *keys]
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), cols, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys held by both sides."""
    cols = [*scope_of(left, right), *keys]
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), cols, "left_semi")


# --- debt ledger ----------------------------------------------------------------


def issue_key() -> Column:
    """Identity of a finding: path, metric, symbol, severity, value, threshold."""

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))

    return F.concat_ws(
        "|", norm_path(F.col("path")), F.lower(text("metric")), text("symbol"), F.lower(text("severity")),
        text("value"), text("threshold"),
    )


def ledger_diff(current: DataFrame, previous: DataFrame, key_limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(counts, first new and resolved keys): open, new and resolved issues between two finding sets."""
    scope = scope_of(current, previous)
    left = normalise_findings(current).select(*scope, issue_key().alias("issue"))
    right = normalise_findings(previous).select(*scope, issue_key().alias("issue"))
    changes = key_changes(left, right, ["issue"])
    counts = changes.groupBy(*scope).agg(
        count_if(F.col("status") != "resolved").alias("current_open"),
        count_if(F.col("status") == "new").alias("new_since_last"),
        count_if(F.col("status") == "resolved").alias("resolved_since_last"),
    )
    moved = changes.where(F.col("status") != "open")
    return counts, top_per(moved, [*scope, "status"], [F.asc("issue")], key_limit)


# --- regression gate ----------------------------------------------------------------

# Severity of a grown cleanup category
CATEGORY_SEVERITY = {
    "fallback_branch": "block",
    "legacy_impl": "block",
    "compat_layer": "block",
    "obsolete_script": "warn",
    "stale_doc": "warn",
    "stale_config": "warn",
    "stale_prompt": "warn",
}
SCORE_LABELS = {"overall": "overall score", "structure": "structure score", "full": "full score"}
TOTAL_LABELS = {
    "candidate_total": "cleanup candidate total",
    "review_required_total": "cleanup review-required total",
}


def gate_checks(
    current: DataFrame, baseline: DataFrame, current_categories: DataFrame, baseline_categories: DataFrame
) -> DataFrame:
    """One row per check: scores must not drop, cleanup totals and category counts must not grow.

    ``current``/``baseline``: one row per scope with overall, structure, full,
    candidate_total, review_required_total; the category frames have category, n.
    """
    scope = scope_of(current, baseline)

    def unpivot(df: DataFrame, side: str) -> DataFrame:
        entries = [
            F.struct(F.lit("score").alias("kind"), F.lit(k).alias("metric"), F.col(k).cast("double").alias(side))
            for k in SCORE_LABELS
        ] + [
            F.struct(
                F.lit("cleanup_total").alias("kind"),
                F.lit(k).alias("metric"),
                F.coalesce(F.col(k), F.lit(0)).cast("double").alias(side),
            )
            for k in TOTAL_LABELS
        ]
        return df.select(*scope, F.inline(F.array(*entries)))

    def categories(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*scope, F.lit("cleanup_category").alias("kind"), F.col("category").alias("metric")).agg(
            F.sum("n").cast("double").alias(side)
        )

    keys = [*scope, "kind", "metric"]
    left = unpivot(current, "current").unionByName(categories(current_categories, "current"))
    right = unpivot(baseline, "baseline").unionByName(categories(baseline_categories, "baseline"))
    both = left.join(right, keys, "full")
    is_score = F.col("kind") == "score"
    rows = both.where(~is_score | (F.col("current").isNotNull() & F.col("baseline").isNotNull()))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("current", "baseline")})
    severity = F.when(is_score, "block").when(F.col("kind") == "cleanup_total", "warn").otherwise(
        lookup(F.trim("metric"), CATEGORY_SEVERITY, "block")
    )
    name = lookup(
        F.col("metric"), {**SCORE_LABELS, **TOTAL_LABELS}, F.concat(F.lit("cleanup category "), F.col("metric"))
    )
    passed = F.when(is_score, F.col("current") >= F.col("baseline")).otherwise(F.col("current") <= F.col("baseline"))
    return rows.withColumns({"name": name, "severity": severity, "passed": passed})


def gate_status(checks: DataFrame) -> DataFrame:
    """pass, warn or fail with the check totals, per repo and snapshot."""
    scope = scope_of(checks)
    failed = ~F.col("passed")
    out = checks.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("check_total"),
        count_if(failed & (F.col("severity") != "warn")).alias("failure_total"),
        count_if(failed & (F.col("severity") == "warn")).alias("warning_total"),
    )
    status = F.when(F.col("failure_total") > 0, "fail").when(F.col("warning_total") > 0, "warn").otherwise("pass")
    return out.withColumn("status", status)


def baseline_row(
    scores: DataFrame, ledger: DataFrame, generated_at: Column, source_mode: Column
) -> DataFrame:
    """The row a later gate compares with: scores and cleanup totals of one review per scope."""
    scope = scope_of(scores, ledger)
    left = scores.select(*scope, "overall", "structure", "full")
    right = ledger.select(*scope, "candidate_total", "review_required_total")
    joined = attach(left, right, scope, "left")
    return joined.withColumns({"generated_at": generated_at, "source_mode": source_mode})


# --- staleness and refresh ----------------------------------------------------------


def staleness(manifest: DataFrame, tree: DataFrame, generated_at: Column) -> DataFrame:
    """Added, removed and later-modified paths of a tree against its manifest.

    ``tree`` has path and mtime (timestamp). A null time makes freshness unknown.
    """
    scope = scope_of(manifest, tree)
    sides = manifest.select(*scope, "path", F.lit(1).alias("m"), F.lit(None).cast("timestamp").alias("mtime")).unionByName(
        tree.select(*scope, "path", F.lit(0).alias("m"), F.col("mtime").cast("timestamp").alias("mtime"))
    )
    merged = sides.groupBy(*scope, "path").agg(
        F.max("m").alias("in_manifest"), F.max(1 - F.col("m")).alias("in_tree"), F.max("mtime").alias("mtime")
    )
    out = merged.groupBy(*scope).agg(
        count_if(F.col("in_manifest") == 0).alias("added_total"),
        count_if(F.col("in_tree") == 0).alias("removed_total"),
        count_if(F.col("mtime") > generated_at).alias("changed_total"),
        F.count(F.lit(1)).alias("path_total"),
    )
    unknown = generated_at.isNull()
    stale = (F.col("added_total") + F.col("removed_total") > 0) | (F.col("changed_total") > 0)
    return out.withColumns({"freshness_unknown": unknown, "stale": stale})


def scoped_staleness(changes: DataFrame, tree: DataFrame, generated_at: Column) -> DataFrame:
    """How many of the selected files changed after the snapshot."""
    scope = scope_of(changes, tree)
    selected = changes.select(*scope, norm_scope_path(F.col("path")).alias("path")).where(F.col("path") != "")
    # Pre-aggregated: one row per path on both sides of the join.
    counted = selected.groupBy(*scope, "path").agg(F.count(F.lit(1)).alias("n"))
    times = tree.groupBy(*scope, "path").agg(F.max(F.col("mtime").cast("timestamp")).alias("mtime"))
    joined = counted.join(times, [*scope, "path"], "left")
    out = joined.groupBy(*scope).agg(
        F.sum("n").alias("selected_total"),
        F.coalesce(F.sum(F.when(F.col("mtime") > generated_at, F.col("n"))), F.lit(0)).alias("changed_after_total"),
    )
    return out.withColumns({"freshness_unknown": generated_at.isNull(), "stale": F.col("changed_after_total") > 0})


def refresh_signal(
    changes: DataFrame,
    keys: Sequence[str] = (),
    min_structural: int = 8,
    min_changed: int = 30,
    min_ratio: float = 0.35,
) -> DataFrame:
    """Changed and structural totals and whether they call for a full refresh."""
    groups = [*scope_of(changes), *keys]
    out = changes.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("changed_total"), count_if(F.col("structural")).alias("structural_total")
    )
    changed, structural = F.col("changed_total"), F.col("structural_total")
    ratio = F.when(changed > 0, structural / changed).otherwise(0.0)
    trigger = (structural >= min_structural) | ((changed >= min_changed) & (ratio >= min_ratio))
    return out.withColumns({"structural_ratio": F.round(ratio, 4), "trigger": trigger})


def refresh_decision(signal: DataFrame, state: DataFrame, interval: int = 5) -> DataFrame:
    """Full refresh when the rules changed, the change is structural, or every ``interval`` runs.

    ``state``: previous_fingerprint, fingerprint, runs_since_full per scope.
    """
    scope = scope_of(signal, state)
    joined = attach(state, signal, scope, "left")
    old = F.coalesce("previous_fingerprint", F.lit(""))
    reasons = F.array_compact(
        F.array(
            F.when((old != "") & (old != F.col("fingerprint")), "refresh-contract changed"),
            F.when(F.coalesce("trigger", F.lit(False)), "large structural change detected"),
            F.when(F.col("runs_since_full") + 1 >= interval, "periodic full refresh"),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn("force_full", F.size("reasons") > 0)


# --- trends ----------------------------------------------------------------------


def trend_of(score: Column, previous: Column) -> Column:
    return F.when(score > previous + 1.0, "up").when(score < previous - 1.0, "down").otherwise("flat")


def trend_rows(scores: DataFrame) -> DataFrame:
    """Every run with its trend against the run before (columns component, run, score)."""
    keys = [*scope_of(scores), "component"]
    before = F.lag("score").over(W.partitionBy(*keys).orderBy("run"))
    return scores.withColumn("trend", trend_of(F.col("score"), F.coalesce(before, F.col("score"))))


def score_trend(scores: DataFrame, keep: int = 20) -> DataFrame:
    """Last score, trend and the last ``keep`` points per component.

    Only the last keep + 1 runs of a component leave their tasks, however long its history is.
    """
    keys = [*scope_of(scores), "component"]
    recent = top_per(scores, keys, [F.desc("run")], keep + 1)
    before = F.max(F.when(F.col("rank") == 2, F.col("score")))
    last = F.max(F.when(F.col("rank") == 1, F.col("score")))
    point = F.struct(F.col("run"), F.col("score"))
    out = recent.groupBy(*keys).agg(
        last.alias("last_score"),
        before.alias("_before"),
        ordered_list(F.when(F.col("rank") <= keep, point), F.col("run")).alias("history"),
    )
    trend = trend_of(F.col("last_score"), F.coalesce("_before", "last_score"))
    kept = F.filter("history", lambda h: h.isNotNull())
    return out.withColumn("trend", trend).withColumn("history", kept).drop("_before")


def last_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last ``limit`` events per scope by ordinal; 0 or less keeps all."""
    if limit <= 0:
        return events
    return top_per(events, scope_of(events), [F.desc("ord")], limit).drop("rank")


def review_trend(events: DataFrame, limit: int = 0) -> DataFrame:
    """Counts by mode and review type, the latest event, and the scores of the latest full code review.

    ``limit`` restricts them to the last so many events (100 in a status display); 0 takes all.
    """
    scope = scope_of(events)
    rows = last_events(events, limit)
    none = F.lit("unknown")
    latest = F.struct("generated_at", "review_type")
    full = (F.col("mode") == "code_review") & (F.col("review_type") == "full")
    when_full = F.when(full, F.col("ord"))
    base = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("event_total"),
        F.max_by(latest, "ord").alias("latest"),
        F.max_by(F.struct("generated_at", "overall"), when_full).alias("scored"),
    )

    def counts(facet: str) -> DataFrame:
        value = F.coalesce(F.nullif(F.col(facet), F.lit("")), none)
        n = rows.groupBy(*scope, value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))
        return n.groupBy(*scope).agg(entries.alias(facet + "_counts"))

    out = base
    for part in (counts("mode"), counts("review_type")):
        out = attach(out, part, scope, "left")
    return out.select(
        *scope,
        "event_total",
        "mode_counts",
        "review_type_counts",
        F.col("latest.generated_at").alias("latest_generated_at"),
        F.col("latest.review_type").alias("latest_review_type"),
        F.when(F.col("scored").isNull(), "none").otherwise("latest_full").alias("score_source"),
        F.col("scored.generated_at").alias("score_generated_at"),
        F.col("scored.overall").alias("overall"),
    )


def weakening_paths(mentions: DataFrame, limit: int = 5) -> DataFrame:
    """Paths that the events mention most, with the kinds of concern (columns path, kind)."""
    scope = scope_of(mentions)
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("unknown"))
    found = mentions.where(F.trim(F.coalesce("path", F.lit(""))) != "").groupBy(*scope, "path").agg(
        F.count(F.lit(1)).alias("event_mentions"), F.array_sort(F.collect_set(kind)).alias("kinds")
    )
    return top_per(found, scope, [F.desc("event_mentions"), F.asc("path")], limit)
