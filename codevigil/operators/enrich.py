"""Enrichment joins: risk facts, feedback demotion, rule metadata, judgements, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import count_if, lookup, r2, scope_of
from ..functions.paths import norm_scope_path
from ..functions.scores import is_expired
from .ranking import is_display_concern, safe_confidence

# Risk thresholds
LOW_COVERAGE = 0.6
HIGH_CHURN = 10
HIGH_COMPLEXITY = 15.0
RECURRING = 2
FACTORS = ["low_coverage", "high_churn", "high_complexity", "public_api", "recurring_history", "missing_related_tests"]


def _factor_flags() -> list[Column]:
    return [
        F.col("coverage") < LOW_COVERAGE,
        F.col("churn") >= HIGH_CHURN,
        F.col("complexity") >= HIGH_COMPLEXITY,
        F.col("public_api"),
        F.col("recurrence") >= RECURRING,
        F.col("related_tests") == 0,
    ]


def risk_factors() -> Column:
    """Names of the risk factors of a row of risk facts."""
    return F.array_compact(F.array(*[F.when(flag, name) for name, flag in zip(FACTORS, _factor_flags())]))


def _number(value: Column) -> Column:
    """Whole numbers without decimals, others with up to two."""
    short = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(short)


def risk_evidence() -> Column:
    """Evidence entries for the known facts of a path, each level right after its value."""

    def text(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(f"risk_context.{prefix}="), value)

    low, churned, tangled, public, recurring, untested = _factor_flags()
    entries = [
        text("coverage", F.format_string("%.2f", F.col("coverage"))),
        F.when(low, "risk_context.coverage_level=low"),
        text("churn", F.col("churn").cast("string")),
        F.when(churned, "risk_context.churn_level=high"),
        text("complexity", _number(F.col("complexity"))),
        F.when(tangled, "risk_context.complexity_level=high"),
        F.when(public, "risk_context.public_api=true"),
        text("recurrence", F.col("recurrence").cast("string")),
        F.when(recurring, "risk_context.recurrence_level=recurring"),
        text("related_test_total", F.col("related_tests").cast("string")),
        F.when(untested, "risk_context.related_tests=none"),
    ]
    # format_string prints null as text, so a missing coverage is blanked by its own null check.
    entries[0] = F.when(F.col("coverage").isNotNull(), entries[0])
    return F.array_compact(F.array(*entries))


def enrich_risk(concerns: DataFrame, risk: DataFrame) -> DataFrame:
    """Concerns with the risk facts of their path appended as evidence, and the ``factors`` found.

    Facts are one row per path, so a path with very many concerns is split by AQE on
    the concern side only.
    """
    scope = scope_of(concerns, risk)
    facts = risk.withColumn("_p", norm_scope_path(F.col("path"))).select(
        *scope, "_p", risk_evidence().alias("_facts"), risk_factors().alias("_factors")
    )
    joined = concerns.withColumn("_p", norm_scope_path(F.col("path"))).join(facts, [*scope, "_p"], "left")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "evidence": F.concat("evidence", F.coalesce("_facts", none)),
            "factors": F.coalesce("_factors", none),
            "enriched": F.size(F.coalesce("_facts", none)) > 0,
        }
    ).drop("_p", "_facts", "_factors")


def risk_scan(enriched: DataFrame) -> DataFrame:
    """Enriched concerns and concerns per factor, per repo and snapshot."""
    scope = scope_of(enriched)
    return enriched.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("concern_total"),
        count_if(F.col("enriched")).alias("enriched_total"),
        *[count_if(F.array_contains("factors", f)).alias(f) for f in FACTORS],
    )


# --- feedback -------------------------------------------------------------------

DEMOTING = ["rejected", "not_applicable", "superseded"]


def demote(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """Items with the first demoting feedback row that matches, if any (``feedback_ord``, null when kept).

    ``items``: advice_id, concern_id, kind, path, text. ``feedback``: output of
    ``normalise_feedback``. Exact ids and equal paths are equi-joins. Paths and patterns
    that only need to occur in the text join on the rarest piece of the needle, then are
    checked, so no side is paired with all of the other. Feedback that asks the same is one row, its first.
    """
    from ..session import materialise
    from .matching import substring_pairs

    scope = scope_of(items, feedback)
    active = feedback.where(F.col("status").isin(DEMOTING))
    rows = items.withColumn("item_key", F.sha2(F.concat_ws("\x01", "advice_id", "concern_id", "kind", "path", "text"), 256))
    low = rows.select(*scope, "item_key", "advice_id", "concern_id", "kind", F.lower("text").alias("text"), F.lower("path").alias("path"))
    exact = active.where("scope = 'exact_advice'")

    def by_id(name: str) -> DataFrame:
        ids = exact.where(F.col(name) != "").groupBy(*scope, name).agg(F.min("ord").alias("ord"))
        return low.join(ids, [*scope, name]).select(*scope, "item_key", "ord")

    # A needle is found when it occurs in the path or the text; the kind must match when given.
    loose = active.where(F.col("scope").isin("same_path_kind", "pattern")).select(
        *scope,
        "ord",
        F.when(F.col("scope") == "pattern", F.lower("pattern")).otherwise(F.lower("path")).alias("needle"),
        F.col("scope").alias("how"),
        F.col("kind").alias("want_kind"),
    )
    loose = loose.where("needle <> ''").groupBy(*scope, "needle", "how", "want_kind").agg(F.min("ord").alias("ord"))
    haystack = low.select(*scope, "item_key", "kind", "text", F.concat_ws("\n", "path", "text").alias("hay"))
    found = substring_pairs(haystack, "hay", loose, "needle", keys=scope, store=True, long=True)
    kind_ok = (F.col("want_kind") == "") | (F.col("kind") == F.col("want_kind")) | F.contains("text", F.col("want_kind"))
    in_text = F.when(F.col("how") == "pattern", F.contains("text", F.col("needle"))).otherwise(F.lit(True))
    by_text = found.where(kind_ok & in_text).select(*scope, "item_key", "ord")
    hits = by_id("advice_id").unionByName(by_id("concern_id")).unionByName(by_text)
    # Stored, so that the texts that were shuffled for the search go before the items meet their hits.
    first = materialise(hits.groupBy(*scope, "item_key").agg(F.min("ord").alias("feedback_ord")), "demoted")
    return rows.join(first, [*scope, "item_key"], "left").drop("item_key")


# --- cleanup metadata --------------------------------------------------------------


def overlay_metadata(candidates: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Owner, ttl_days and expiry of cleanup candidates: per field, the last matching rule that sets it.

    ``rules``: ord, path, glob, kind, category, owner, ttl_days, expires_at (empty = not set).
    """
    from .matching import pattern_pairs

    scope = scope_of(candidates, rules)
    shaped = rules.withColumns(
        {
            "pattern": F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(F.coalesce("glob", F.lit("")))
        }
    ).withColumnsRenamed({"path": "rule_path", "glob": "rule_glob", "kind": "rule_kind", "category": "rule_category"})
    paths = candidates.select(*scope, "path").distinct()
    pairs = pattern_pairs(paths, shaped, mode="overlay")
    keys = [*scope, "path"]
    joined = candidates.select(*keys, "kind", "category").join(pairs, keys)
    fits = ((F.coalesce("rule_kind", F.lit("")) == "") | (F.col("rule_kind") == F.col("kind"))) & (
        (F.coalesce("rule_category", F.lit("")) == "") | (F.col("rule_category") == F.col("category"))
    )
    owner = F.when(F.coalesce("owner", F.lit("")) != "", F.col("owner"))
    expiry = F.when(F.coalesce("expires_at", F.lit("")) != "", F.col("expires_at"))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("ord")))

    ident = [*keys, "kind", "category"]
    merged = joined.where(fits).groupBy(*ident).agg(
        last(owner).alias("owner"), last(F.col("ttl_days")).alias("ttl_days"), last(expiry).alias("expires_at")
    )
    out = candidates.drop("owner", "ttl_days", "expires_at", "expired").join(merged, ident, "left")
    return out.withColumn("expired", F.coalesce(is_expired(F.col("expires_at"), now), F.lit(False)))


# --- judgements -----------------------------------------------------------------

# Confidence floors of judged concerns
JUDGEMENT_FLOORS = {"review": 0.76, "archive_first": 0.80, "retire_now": 0.86}
DECISIONS = ["keep_active", "review", "archive_first", "retire_now"]


def normalise_judgements(judgements: DataFrame) -> DataFrame:
    """Known decisions only (others mean review, archive_first on source too); the first row per path wins."""
    scope = scope_of(judgements)
    text = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    known = F.when(text.isin(DECISIONS), text).otherwise("review")
    decision = F.when((known == "archive_first") & (F.coalesce("kind", F.lit("")) == "source"), "review").otherwise(known)
    rows = judgements.select(
        *scope,
        norm_scope_path(F.col("path")).alias("path"),
        decision.alias("decision"),
        r2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).alias("judged"),
        "ord",
    ).where("path <> ''")
    return rows.groupBy(*scope, "path").agg(F.min_by(F.struct("decision", "judged"), "ord").alias("j")).select(*scope, "path", "j.*")


def apply_judgements(concerns: DataFrame, judgements: DataFrame) -> DataFrame:
    """Cleanup and archive concerns take the decision as evidence and its confidence floor."""
    scope = scope_of(concerns, judgements)
    known = judgements.select(*scope, F.col("path").alias("_p"), F.col("decision").alias("_d"))
    joined = concerns.withColumn("_p", norm_scope_path(F.col("path"))).join(known, [*scope, "_p"], "left")
    hit = is_display_concern(F.col("kind"), F.col("evidence")) & F.col("_d").isin(list(JUDGEMENT_FLOORS))
    hit = F.coalesce(hit, F.lit(False))
    fact = F.concat(F.lit("semantic_judge.decision="), F.col("_d"))
    grown = F.array_union("evidence", F.array(fact))
    floor = lookup(F.col("_d"), JUDGEMENT_FLOORS, 0.0)
    return joined.withColumns(
        {
            "evidence": F.when(hit, grown).otherwise(F.col("evidence")),
            "confidence": F.when(hit, F.greatest(safe_confidence(F.col("confidence")), floor)).otherwise(F.col("confidence")),
        }
    ).drop("_p", "_d")

