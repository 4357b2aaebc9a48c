"""Goal-driven search: token weights, file and component scores, targets, batches, question routing, test matching.

Goals and questions are tables. Whether a goal word occurs in a path or symbol is found
with the piece join of ``matching``: distinct words meet distinct texts, and only matches fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import attach, count_if, ordered_list, r2, scope_of, spread, top_per
from ..functions.paths import is_test_path, stem_of
from ..functions.text import component_tokens, document_tokens, goal_tokens, is_infra, wants_infra, wants_tests
from .components import descriptor_search_text
from .matching import substring_pairs


def token_weights(goals: DataFrame, docs: DataFrame, goal_limit: int | None = None) -> DataFrame:
    """(goal_id, token, weight): common words of the documents are dropped, rare ones weigh 1.

    ``goals``: goal_id, text; ``docs``: text. Empty documents do not count. The document
    words are reduced to the goal words before they are counted. Whole goals are read;
    ``goal_limit`` cuts them to their first words (``GOAL_TOKEN_LIMIT``).
    """
    scope = scope_of(goals, docs)
    wanted = goals.select(*scope, "goal_id", F.explode(goal_tokens(F.col("text"), goal_limit)).alias("token"))
    filled = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    total = filled.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    terms = filled.select(*scope, F.explode(document_tokens(F.col("text"))).alias("token"))
    counts = terms.join(wanted.select(*scope, "token").distinct(), [*scope, "token"], "left_semi")
    counts = counts.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("df"))
    joined = wanted.join(counts, [*scope, "token"], "left")
    # ``total`` is one row per repo and snapshot.
    joined = attach(joined, total, scope, "left")
    n = F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))
    df = F.coalesce("df", F.lit(0))
    share = df / n
    graded = F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.log((n + 1.0) / (df + 1.0))))
    weight = F.when(share <= 0.05, 1.0).otherwise(graded)
    return joined.where(share < 0.6).select(*scope, "goal_id", "token", weight.alias("weight"))


def _points(weight: Column, factor: int) -> Column:
    """max(1, round(factor * weight)), halves to even."""
    return F.greatest(F.lit(1), F.bround(F.round(weight * factor, 8), 0).cast("int"))


def score_files(
    files: DataFrame,
    signatures: DataFrame,
    descriptors: DataFrame,
    goals: DataFrame,
    weights: DataFrame,
    hotspots: DataFrame,
    hints: DataFrame | None = None,
    files_per_component: int | None = None,
) -> DataFrame:
    """(goal_id, path, component, score, evidence) for every file a goal touches.

    ``files``: path, component (architecture scope). ``descriptors``: output of
    ``components.descriptors``. ``hotspots``: top-n table. ``hints``: goal_id,
    component, points. Points form a long table that is summed in two stages, because
    penalties with a floor come after words and descriptors and before hints. Points of a
    component go to all its files, or to the first ``files_per_component`` by path.
    """
    scope = scope_of(files, goals)
    key = [*scope, "goal_id", "path"]
    distinct = weights.select(*scope, "token").distinct()
    paths = spread(files.select(*scope, "path", F.lower("path").alias("low")))
    path_hits = substring_pairs(paths, "low", distinct, "token", keys=scope, store=True).select(*scope, "path", "token")
    path_rows = path_hits.join(weights, [*scope, "token"]).select(
        *key, _points(F.col("weight"), 5).alias("points"), F.concat(F.lit("path:"), F.col("token")).alias("evidence")
    )
    # Equal symbols of a file are counted, matched once, and multiplied back.
    named = signatures.select(
        *scope, "path", F.concat_ws("\n", F.lower("name"), F.lower(F.coalesce("parent", F.lit("")))).alias("low")
    ) if "parent" in signatures.columns else signatures.select(*scope, "path", F.lower("name").alias("low"))
    texts = spread(named.select(*scope, "low").distinct())
    sym_hits = substring_pairs(texts, "low", distinct, "token", keys=scope, store=True).select(*scope, "low", "token")
    per_file = named.groupBy(*scope, "path", "low").agg(F.count(F.lit(1)).alias("times"))
    per_file = per_file.join(files.select(*scope, "path"), [*scope, "path"], "left_semi")
    sym_rows = per_file.join(sym_hits, [*scope, "low"]).join(weights, [*scope, "token"]).select(
        *key, (_points(F.col("weight"), 3) * F.col("times")).cast("int").alias("points"),
        F.concat(F.lit("symbol:"), F.col("token")).alias("evidence"),
    )
    first_files = files.select(*scope, "component", "path")
    if files_per_component is not None:
        first_files = top_per(first_files, [*scope, "component"], [F.asc("path")], files_per_component).drop("rank")
    described = descriptors.select(*scope, "component", "confidence", descriptor_search_text().alias("low"))
    matched = substring_pairs(described, "low", distinct, "token", keys=scope).select(*scope, "component", "confidence", "token")
    boost = matched.join(weights, [*scope, "token"]).groupBy(*scope, "goal_id", "component", "confidence").agg(
        F.count(F.lit(1)).alias("terms")
    )
    boost = boost.where((F.col("terms") >= 2) | (F.col("confidence") >= 0.7))
    sure = F.bround(F.round(F.col("confidence") * 2, 8), 0).cast("int")
    boost = boost.withColumn("points", F.least(F.lit(8), F.lit(2) + F.col("terms").cast("int") + sure))
    desc_rows = boost.join(first_files, [*scope, "component"]).select(
        *key, "points", F.concat(F.lit("descriptor:"), F.col("component")).alias("evidence")
    )
    early = path_rows.unionByName(sym_rows).unionByName(desc_rows)
    base = early.groupBy(*key).agg(F.sum("points").alias("base"), F.collect_set("evidence").alias("evidence"))
    base = base.join(files.select(*scope, "path", "component"), [*scope, "path"])
    role = descriptors.select(*scope, "component", is_infra(F.col("component"), F.col("layer_role"), F.col("responsibility_summary")).alias("infra"))
    asks = goals.select(*scope, "goal_id", wants_infra(F.col("text")).alias("infra_ok"), wants_tests(F.col("text")).alias("tests_ok"))
    base = base.join(role, [*scope, "component"], "left").join(asks, [*scope, "goal_id"])
    infra = ~F.col("infra_ok") & F.coalesce("infra", F.lit(False))
    tests = ~F.col("tests_ok") & (is_test_path(F.col("path")) | F.col("component").endswith(":tests"))
    after = F.when(infra, F.greatest(F.lit(0), F.col("base") - 9)).otherwise(F.col("base"))
    base = base.withColumn("base", after)
    after = F.when(tests, F.greatest(F.lit(0), F.col("base") - 8)).otherwise(F.col("base"))
    marks = F.array_compact(F.array(F.when(infra, "infra_penalty"), F.when(tests, "tests_penalty")))
    base = base.select(*key, after.alias("points"), F.concat("evidence", marks).alias("marks"))
    # Later steps: hints for a whole component, the component's name in the goal, hotspots.
    low_goals = goals.select(*scope, "goal_id", F.lower("text").alias("low"))
    names = files.select(*scope, "component").distinct()
    words = names.select(*scope, "component", F.explode(F.array_distinct(component_tokens(F.col("component")))).alias("token"))
    in_goal = substring_pairs(low_goals, "low", words.select(*scope, "token").distinct(), "token", keys=scope)
    in_goal = in_goal.select(*scope, "goal_id", "token").join(words, [*scope, "token"])
    named_by = in_goal.groupBy(*scope, "goal_id", "component").agg(F.count(F.lit(1)).alias("m"))
    comp_rows = named_by.join(first_files, [*scope, "component"]).select(
        *key, F.when(F.col("m") >= 2, 4).otherwise(2).alias("points"), F.array(F.concat(F.lit("component:"), F.col("component"))).alias("marks")
    )
    late = base.select(*key, F.col("points").cast("long").alias("points"), "marks").unionByName(comp_rows.withColumn("points", F.col("points").cast("long")))
    if hints is not None:
        hinted = hints.where("points > 0").join(files.select(*scope, "component", "path"), [*scope, "component"]).select(
            *key, F.col("points").cast("long").alias("points"), F.array(F.concat(F.lit("hint:"), F.col("component"))).alias("marks")
        )
        late = late.unionByName(hinted)
    scored = late.groupBy(*key).agg(F.sum("points").alias("points"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("evidence"))
    hot = hotspots.where((F.col("critical") > 0) | (F.col("warning") > 0)).select(
        *scope, "path", F.least(F.lit(6), F.col("critical") * 2 + F.floor(F.col("warning") / 3)).alias("heat")
    )
    scored = scored.join(hot, [*scope, "path"], "left").join(files.select(*scope, "path", "component"), [*scope, "path"])
    mark = F.when(F.col("heat").isNotNull(), F.array(F.lit("hotspot"))).otherwise(F.array().cast("array<string>"))
    return scored.select(
        *key, "component", (F.col("points") + F.coalesce("heat", F.lit(0))).alias("score"), F.array_sort(F.concat("evidence", mark)).alias("evidence")
    )


def cut_candidates(scored: DataFrame, k: int = 20, pool: int | None = None, evidence_limit: int | None = None) -> DataFrame:
    """First k files per goal by score among those with a component and real evidence.

    ``pool`` looks among the first files by score only (2k in an interactive search), ``evidence_limit``
    keeps the first entries of a file's evidence.
    """
    keys = [*scope_of(scored), "goal_id"]
    order = [F.desc("score"), F.asc("path")]
    first = scored if pool is None else top_per(scored, keys, order, max(1, pool)).drop("rank")
    signal = F.exists("evidence", lambda e: e.rlike("^(hint|component|descriptor):"))
    lexical = F.exists("evidence", lambda e: e.rlike("^(path|symbol):"))
    kept = first.where((F.coalesce("component", F.lit("")) != "") & (signal | (lexical & (F.col("score") >= 4))))
    out = top_per(kept, keys, order, max(1, k))
    return out if evidence_limit is None else out.withColumn("evidence", F.slice("evidence", 1, evidence_limit))


def component_goal(candidates: DataFrame) -> DataFrame:
    """Component score: its three best files at 1.0, 0.65 and 0.35, plus up to 3 for distinct paths."""
    scope = scope_of(candidates)
    extra = [c for c in ("goal_id",) if c in candidates.columns]
    keys = [*scope, *extra, "component"]
    rows = candidates.where((F.coalesce("component", F.lit("")) != "") & (F.col("score") > 0))
    counts = rows.groupBy(*keys).agg(F.countDistinct("path").alias("paths"))
    best = top_per(rows.select(*keys, "path", "score"), keys, [F.desc("score"), F.asc("path")], 3)
    hundredths = F.when(F.col("rank") == 1, 100).when(F.col("rank") == 2, 65).otherwise(35)
    sums = best.groupBy(*keys).agg(F.sum(F.col("score") * hundredths).alias("s"))
    bonus = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.col("paths") - F.lit(1.0)))
    return sums.join(counts, keys).select(*keys, r2(F.col("s") / 100.0 + bonus).alias("score"), "paths")


def _allowed(infra_ok: Column, tests_ok: Column, infra: Column, component: Column) -> Column:
    return (tests_ok | ~component.endswith(":tests")) & (infra_ok | ~F.coalesce(infra, F.lit(False)))


def target_components(ranked: DataFrame, goals: DataFrame, roles: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Target components per goal: the first non-empty tier of the best 10, else components of hotspots.

    ``ranked``: goal_id, component, score. ``roles``: component, infra. ``hotspots``: top 30 with
    component and rank. Tiers: score >= 8 (6 rows), >= 4 (3 rows), any (1 row).
    """
    scope = scope_of(ranked, goals)
    keys = [*scope, "goal_id"]
    asks = goals.select(*keys, wants_infra(F.col("text")).alias("infra_ok"), wants_tests(F.col("text")).alias("tests_ok"))
    ok = _allowed(F.col("infra_ok"), F.col("tests_ok"), F.col("infra"), F.col("component"))
    top = top_per(ranked.select(*keys, "component", "score"), keys, [F.desc("score"), F.asc("component")], 10, "pos")
    top = top.join(asks, keys).join(roles, [*scope, "component"], "left").where(ok)
    tier = F.when(F.col("score") >= 8, 1).when(F.col("score") >= 4, 2).otherwise(3)
    # At most ten rows per goal from here on.
    best = top.groupBy(*keys).agg(F.min(tier).alias("tier"))
    chosen = top.join(best, keys).where((F.col("tier") != 1) | (F.col("score") >= 8)).where((F.col("tier") != 2) | (F.col("score") >= 4))
    size = F.when(F.col("tier") == 1, 6).when(F.col("tier") == 2, 3).otherwise(1)
    chosen = top_per(chosen, keys, [F.asc("pos")], 6).where(F.col("rank") <= size)
    chosen = chosen.select(*keys, "component", "score", "rank", F.col("tier").cast("int").alias("tier"))
    spots = hotspots.where(F.coalesce("component", F.lit("")) != "").groupBy(*scope, "component").agg(
        F.min("rank").alias("first"), F.max_by("score", -F.col("rank")).alias("score")
    )
    bare = asks.join(best.select(*keys), keys, "left_anti")
    # At most 30 hotspots per repo and snapshot.
    spare = attach(bare, spots, scope)
    spare = top_per(spare.join(roles, [*scope, "component"], "left").where(ok), keys, [F.asc("first")], 3)
    return chosen.unionByName(spare.select(*keys, "component", "score", "rank", F.lit(4).alias("tier")))


#: Component of a batch for a goal that no component answers: its files are the first hotspots.
GLOBAL = "global"


def fallback_targets(targets: DataFrame, goals: DataFrame, scores: DataFrame, roles: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Targets (goal_id, component, rank, source) with one row for every goal that has none.

    In turn: the component that was asked for (``asked``: goal_id, component), the component of the lowest
    score (``scores``: component, score), and ``GLOBAL``. Tests and infrastructure (``roles``: component,
    infra) count only where the goal is about them.
    """
    scope = scope_of(targets, goals)
    keys = [*scope, "goal_id"]
    bare = goals.select(*keys, wants_infra(F.col("text")).alias("infra_ok"), wants_tests(F.col("text")).alias("tests_ok"))
    bare = bare.join(targets.select(*keys).distinct(), keys, "left_anti")
    ok = _allowed(F.col("infra_ok"), F.col("tests_ok"), F.col("infra"), F.col("component"))
    flags = [F.struct(F.lit(i).alias("infra_ok"), F.lit(q).alias("tests_ok")) for i in (True, False) for q in (True, False)]
    rated = scores.where((F.coalesce("component", F.lit("")) != "") & F.col("score").isNotNull()).select(*scope, "component", "score", F.inline(F.array(*flags)))
    rated = rated.join(roles.select(*scope, "component", "infra"), [*scope, "component"], "left").where(ok)
    worst = top_per(rated, [*scope, "infra_ok", "tests_ok"], [F.asc("score"), F.asc("component")], 1)
    worst = worst.select(*scope, "infra_ok", "tests_ok", F.col("component").alias("worst"))
    out = bare.join(worst, [*scope, "infra_ok", "tests_ok"], "left")
    if asked is None:
        out = out.withColumn("asked", F.lit(None).cast("string"))
    else:
        named = asked.where(F.coalesce("component", F.lit("")) != "").groupBy(*keys).agg(F.min("component").alias("component"))
        named = named.join(roles.select(*scope, "component", "infra"), [*scope, "component"], "left").join(bare, keys).where(ok)
        out = out.join(named.select(*keys, F.col("component").alias("asked")), keys, "left")
    source = F.when(F.col("asked").isNotNull(), "asked").when(F.col("worst").isNotNull(), "worst_score").otherwise(GLOBAL)
    spare = out.select(*keys, F.coalesce("asked", "worst", F.lit(GLOBAL)).alias("component"), F.lit(1).alias("rank"), source.alias("source"))
    return targets.select(*keys, "component", "rank", F.lit("target").alias("source")).unionByName(spare)


def change_batches(
    targets: DataFrame,
    evidence: DataFrame,
    files: DataFrame,
    hotspots: DataFrame,
    scores: DataFrame,
    evidence_limit: int | None = None,
    file_limit: int | None = None,
    hot_limit: int | None = None,
    focus_limit: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """(batches, focus files) for the first three targets per goal.

    ``targets``: goal_id, component, rank. ``evidence``: goal_id, component, path, ord.
    ``files``: component, path, ord. ``hotspots``: path, rank. ``scores``: component,
    recommendation, critical, layer_role. Focus files come from four sources in turn:
    evidence that is hot, evidence, component files that are hot, component files; a batch shows the first
    ``focus_limit``. The files of ``GLOBAL`` are the hotspots. ``evidence_limit``, ``file_limit`` and ``hot_limit`` look at the first rows of a source only.
    """
    scope = scope_of(targets, files)
    keys = [*scope, "goal_id", "component"]
    first = targets.where(F.col("rank") <= 3).select(*keys, "rank")
    facts = first.join(scores.select(*scope, "component", "recommendation", "critical", "layer_role"), [*scope, "component"], "left")
    urgent = (F.col("rank") == 1) | (F.col("recommendation") == "block") | (F.coalesce("critical", F.lit(0)) > 0)
    exposed = F.coalesce("layer_role", F.lit("")).isin("orchestration", "interface_adapter")
    priority = F.when(F.col("component") == GLOBAL, "medium").when(urgent, "high").when(exposed | (F.col("rank") <= 3), "medium").otherwise("low")
    batches = facts.select(*keys, F.concat(F.lit("B"), F.col("rank")).alias("batch"), priority.alias("priority"))
    hot_files = hotspots if hot_limit is None else hotspots.where(F.col("rank") <= hot_limit)
    hot = hot_files.select(*scope, "path").distinct().withColumn("hot", F.lit(True))
    own = evidence.join(first.select(*keys), keys, "left_semi").select(*keys, "path", F.col("ord").cast("long").alias("ord"))
    if evidence_limit is not None:
        own = top_per(own, keys, [F.asc("ord"), F.asc("path")], evidence_limit).drop("rank")
    files = files.select(*scope, "component", "path", F.col("ord").cast("long").alias("ord"))
    files = files.unionByName(hot_files.select(*scope, F.lit(GLOBAL).alias("component"), "path", F.col("rank").cast("long").alias("ord")))
    listed = files.join(first.select(*scope, "component").distinct(), [*scope, "component"], "left_semi")
    if file_limit is not None:
        listed = top_per(listed, [*scope, "component"], [F.asc("ord"), F.asc("path")], file_limit).drop("rank")
    listed = first.select(*keys).join(listed, [*scope, "component"])

    def source(df: DataFrame, hot_rank: int, cold_rank: int) -> DataFrame:
        marked = df.join(hot, [*scope, "path"], "left")
        entries = F.array_compact(F.array(F.when(F.col("hot"), F.lit(hot_rank)), F.lit(cold_rank)))
        ranked = marked.select(*keys, "path", "ord", F.explode(entries).alias("src"))
        # Earlier sources hold less than ``focus_limit`` paths where this one counts, so twice as many are enough.
        return top_per(ranked, [*keys, "src"], [F.asc("ord"), F.asc("path")], 2 * focus_limit).drop("rank")

    both = source(own, 0, 1).unionByName(source(listed, 2, 3))
    best = both.groupBy(*keys, "path").agg(F.min(F.struct("src", "ord")).alias("place"))
    focus = top_per(best, keys, [F.asc("place"), F.asc("path")], focus_limit)
    return batches, focus.select(*keys, "path", "rank")


def match_tests(tests: DataFrame, batches: DataFrame, hint_limit: int | None = None, limit: int = 20, fallback: int = 10) -> DataFrame:
    """Test paths that contain a hint of a batch, ``limit`` per batch group; else the first tests.

    ``batches``: group (one plan), ord, hints (array). All hints count, or the first
    ``hint_limit`` in sorted order.
    """
    scope = scope_of(tests, batches)
    keys = [*scope, "group"]
    own = F.array_sort(F.array_distinct(F.filter("hints", lambda h: h != "")))
    hints = batches.select(*keys, "ord", F.explode(own if hint_limit is None else F.slice(own, 1, hint_limit)).alias("hint"))
    low = tests.select(*scope, "path", F.lower("path").alias("low")).distinct()
    found = substring_pairs(low, "low", hints.select(*scope, "hint").distinct(), "hint", keys=scope).select(*scope, "path", "hint")
    hits = hints.join(found, [*scope, "hint"]).groupBy(*keys, "path").agg(F.min("ord").alias("ord"))
    chosen = top_per(hits, keys, [F.asc("ord"), F.asc("path")], limit).select(*keys, "path", "rank")
    head = top_per(tests.select(*scope, "path").distinct(), scope, [F.asc("path")], fallback)
    bare = batches.select(*keys).distinct().join(hits.select(*keys).distinct(), keys, "left_anti")
    spare = attach(bare, head, scope)
    return chosen.unionByName(spare.select(*keys, "path", "rank"))


def batch_hints(component: Column, focus_files: Column, component_files: Column) -> Column:
    """Stems of component files and the words of the component and its focus files."""

    def words(text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))
        return F.filter(found, lambda w: ~w.isin("tests", "test", "src", "core", "spec"))

    stems = F.transform(component_files, stem_of)
    return F.array_distinct(F.concat(stems, words(component), F.flatten(F.transform(focus_files, lambda p: words(stem_of(p))))))


def test_anchors(components: DataFrame, tests: DataFrame, limit: int = 8) -> DataFrame:
    """First test paths per component that contain one of its name parts of 4 or more letters."""
    scope = scope_of(components, tests)
    parts = F.filter(F.split(F.translate(F.lower("component"), ":", "/"), "/"), lambda p: F.length(p) >= 4)
    words = components.select(*scope, "component", F.explode(F.array_distinct(parts)).alias("word"))
    low = tests.select(*scope, "path", F.lower("path").alias("low")).distinct()
    found = substring_pairs(low, "low", words.select(*scope, "word").distinct(), "word", keys=scope).select(*scope, "path", "word")
    hits = words.join(found, [*scope, "word"]).select(*scope, "component", "path").distinct()
    kept = top_per(hits, [*scope, "component"], [F.asc("path")], limit)
    return kept.groupBy(*scope, "component").agg(ordered_list(F.col("path"), F.col("rank")).alias("test_anchors"))


# --- questions --------------------------------------------------------------------------


def route_questions(questions: DataFrame, files: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Component that answers each question, with its score (null score = fallback).

    Points: 10 for the component name, 4 per name part, 3 per descriptor word plus
    confidence, 15 for a full path, 1 for a path that holds a question word; minus 6 for
    tests and 7 for infra unless asked for. The best allowed component wins, then the
    best, then the allowed component with most files.
    """
    scope = scope_of(questions, files, descriptors)
    key = [*scope, "question_id", "component"]
    low = questions.select(*scope, "question_id", F.lower("text").alias("low"))
    comps = files.groupBy(*scope, "component").agg(F.count(F.lit(1)).alias("files"))
    name = comps.select(*scope, "component", F.lower("component").alias("needle"), F.lit(10).alias("points"))
    pieces = F.split(F.translate(F.lower("component"), ":", "/"), "/")
    parts = comps.select(*scope, "component", F.explode(F.filter(pieces, lambda p: F.length(p) >= 3)).alias("needle"), F.lit(4).alias("points"))
    named = name.unionByName(parts)
    by_name = substring_pairs(low, "low", named, "needle", keys=scope).select(*key, F.col("points").cast("long").alias("points"))
    words = F.filter(F.split(F.translate(F.col("low"), ":/", "  "), r"\s+"), lambda w: F.length(w) >= 4)
    asked = low.select(*scope, "question_id", F.explode(F.array_distinct(words)).alias("word"))
    described = descriptors.select(*scope, "component", "confidence", descriptor_search_text().alias("hay"))
    in_text = substring_pairs(described, "hay", asked.select(*scope, "word").distinct(), "word", keys=scope)
    in_text = in_text.select(*scope, "component", "confidence", "word").join(asked, [*scope, "word"])
    sure = F.bround(F.round(F.col("confidence") * 3, 8), 0)
    by_text = in_text.groupBy(*key, "confidence").agg(F.count(F.lit(1)).alias("n")).select(*key, (F.col("n") * 3 + sure).cast("long").alias("points"))
    paths = files.select(*scope, "component", F.lower("path").alias("path"))
    full = substring_pairs(low, "low", paths.select(*scope, F.col("path").alias("needle")).distinct(), "needle", keys=scope)
    full = full.select(*scope, "question_id", F.col("needle").alias("path")).distinct()
    short = F.filter(F.split(F.col("low"), r"\s+"), lambda w: F.length(w) >= 3)
    tokens = low.select(*scope, "question_id", F.explode(F.array_distinct(short)).alias("word"))
    distinct_paths = paths.select(*scope, "path").distinct()
    partial = substring_pairs(distinct_paths, "path", tokens.select(*scope, "word").distinct(), "word", keys=scope)
    partial = partial.join(tokens, [*scope, "word"]).select(*scope, "question_id", "path").distinct()
    partial = partial.join(full, [*scope, "question_id", "path"], "left_anti")
    per_path = full.withColumn("points", F.lit(15)).unionByName(partial.withColumn("points", F.lit(1)))
    counts = paths.groupBy(*scope, "path", "component").agg(F.count(F.lit(1)).alias("n"))
    by_path = per_path.join(counts, [*scope, "path"]).select(*key, (F.col("points") * F.col("n")).alias("points"))
    total = by_name.unionByName(by_text).unionByName(by_path).groupBy(*key).agg(F.sum("points").alias("points"))
    infra = descriptors.select(*scope, "component", is_infra(F.col("component"), F.col("layer_role"), F.col("responsibility_summary")).alias("infra"))
    asks = questions.select(*scope, "question_id", wants_infra(F.col("text")).alias("infra_ok"), wants_tests(F.col("text")).alias("tests_ok"))
    scored = total.join(infra, [*scope, "component"], "left").join(asks, [*scope, "question_id"])
    is_tests = F.col("component").endswith(":tests")
    lost = F.when(~F.col("tests_ok") & is_tests, 6).otherwise(0) + F.when(
        ~F.col("infra_ok") & F.coalesce("infra", F.lit(False)), 7
    ).otherwise(0)
    ok = _allowed(F.col("infra_ok"), F.col("tests_ok"), F.col("infra"), F.col("component"))
    scored = scored.select(*key, (F.col("points") - lost).alias("score"), ok.alias("ok"))
    best = top_per(scored, [*scope, "question_id"], [F.desc("ok"), F.desc("score"), F.asc("component")], 1)
    # Fallback: the largest component, allowed first; one row per combination of what was asked.
    sized = comps.join(infra, [*scope, "component"], "left")
    flags = [F.struct(F.lit(i).alias("infra_ok"), F.lit(q).alias("tests_ok")) for i in (True, False) for q in (True, False)]
    per_combo = sized.select("*", F.inline(F.array(*flags)))
    largest = per_combo.withColumn("ok", ok)
    largest = top_per(largest, [*scope, "infra_ok", "tests_ok"], [F.desc("ok"), F.desc("files"), F.asc("component")], 1)
    bare = asks.join(best.select(*scope, "question_id"), [*scope, "question_id"], "left_anti")
    spare = bare.join(largest.select(*scope, "infra_ok", "tests_ok", "component"), [*scope, "infra_ok", "tests_ok"])
    return best.select(*key, "score").unionByName(spare.select(*key, F.lit(None).cast("long").alias("score")))


def component_evidence(files: DataFrame, signatures: DataFrame, findings: DataFrame, graph: DataFrame) -> DataFrame:
    """Evidence pack per component: files, signatures, severities, first hotspots and dependencies."""
    from .components import component_neighbors
    from .findings import hotspot_order, hotspot_scores, normalise_findings

    scope = scope_of(files, signatures, findings, graph)
    keys = [*scope, "component"]
    base = files.groupBy(*keys).agg(F.countDistinct("path").alias("file_count"))
    signed = signatures.groupBy(*keys).agg(F.count(F.lit(1)).alias("signature_count"))
    rows = normalise_findings(findings)
    severity = rows.groupBy(*keys).agg(*[count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    spots = hotspot_scores(findings).drop("critical", "warning", "info").join(rows.groupBy(*keys, "path").agg(count_if(F.col("severity") == "critical").alias("critical")), [*scope, "path"])
    spots = top_per(spots, keys, hotspot_order(), 8).groupBy(*keys).agg(ordered_list(F.col("path"), F.col("rank")).alias("hotspots"))
    near = component_neighbors(graph, 12).groupBy(*scope, F.col("src_component").alias("component"))
    near = near.agg(ordered_list(F.struct("dst_component", "weight", F.get("target_paths", F.lit(0)).alias("target_path")), F.col("rank")).alias("edges"))
    out = base
    for part in (signed, severity, spots, near):
        out = out.join(part, keys, "left")
    return out

