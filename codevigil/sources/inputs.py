"""Readers of external documents: snapshots, change sets, rules, policies, risk facts, plans, feedback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..common import scope_of
from ..functions.paths import norm_path, norm_scope_path
from ..functions.scores import valid_expiry

STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _json(column: Column, kind: T.DataType | str) -> Column:
    return F.from_json(column, kind)


# --- snapshot bundle -----------------------------------------------------------------


def read_snapshot(documents: DataFrame) -> dict[str, DataFrame]:
    """Row tables of snapshot documents (columns name, text; optionally repo, snapshot).

    Names: manifest, index, signatures, metrics. Signatures come from the signatures
    document, or from the index for paths it gives none for.
    """
    scope = scope_of(documents)

    def doc(name: str) -> DataFrame:
        return documents.where(F.col("name") == name)

    listed = schemas.table(signatures=T.ArrayType(schemas.SIGNATURE))

    def mapped(name: str, value: T.DataType) -> DataFrame:
        kind = schemas.table(files=T.MapType(T.StringType(), value))
        parsed = doc(name).select(*scope, _json(F.col("text"), kind).alias("d"))
        return parsed.select(*scope, F.explode("d.files").alias("path", "v")).withColumn("path", norm_path(F.col("path"))).where("path <> ''")

    manifest = mapped("manifest", schemas.MANIFEST_FILE).select(*scope, "path", "v.*")
    from_sigs = mapped("signatures", listed).select(*scope, "path", F.col("v.signatures").alias("s"))
    from_index = mapped("index", listed).select(*scope, "path", F.col("v.signatures").alias("i"))
    key = [*scope, "path"]
    filled = F.when(F.coalesce(F.size("s"), F.lit(0)) > 0, F.col("s")).otherwise(F.col("i"))
    chosen = from_sigs.join(from_index, key, "full").select(*key, filled.alias("list"))
    signatures = chosen.select(*key, F.inline("list")).withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
    files = manifest.select(*key).unionByName(from_sigs.select(*key)).unionByName(from_index.select(*key)).distinct()
    files = files.join(manifest, key, "left")
    deps = schemas.table(function_dependencies=T.MapType(T.StringType(), T.ArrayType(schemas.DEPENDENCY)))
    edges = doc("index").select(*scope, _json(F.col("text"), deps).alias("d"))
    edges = edges.select(*scope, F.explode("d.function_dependencies").alias("source", "targets")).select(*scope, "source", F.inline("targets"))

    def path_of(ref: str) -> Column:
        return norm_path(F.regexp_replace(norm_path(F.col(ref)), ":[^:]*$", ""))

    def symbol_of(ref: str) -> Column:
        return F.trim(F.regexp_extract(norm_path(F.col(ref)), ":([^:]*)$", 1))

    dependencies = edges.select(
        *scope,
        path_of("source").alias("src_path"),
        symbol_of("source").alias("src_symbol"),
        path_of("target").alias("dst_path"),
        symbol_of("target").alias("dst_symbol"),
        F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))).alias("weight"),
    )
    found = schemas.table(findings=T.ArrayType(schemas.FINDING))
    metrics = doc("metrics").select(*scope, _json(F.col("text"), found).alias("d"))
    findings = metrics.select(*scope, F.posexplode("d.findings").alias("ord", "f")).select(*scope, "ord", "f.*")
    return {"files": files, "signatures": signatures, "dependencies": dependencies, "findings": findings}


# --- change sets -----------------------------------------------------------------------


def read_numstat(lines: DataFrame) -> DataFrame:
    """Change rows of tab-separated added/deleted/path lines (column value); ``-`` counts as 0.

    ``{old => new}`` and ``old => new`` keep what follows the last arrow.
    """
    parts = F.split("value", "\t")
    raw = norm_path(F.get(parts, F.lit(2)))
    moved = norm_path(F.translate(F.substring_index(raw, " => ", -1), "{}", ""))

    def count(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))

    path = F.when(raw.contains(" => "), moved).otherwise(raw)
    extra = [c for c in lines.columns if c != "value"]
    return lines.where(F.size(parts) >= 3).select(*extra, path.alias("path"), count(0).alias("added"), count(1).alias("deleted"))


def read_porcelain(lines: DataFrame) -> DataFrame:
    """Change rows of porcelain status lines; renames, deletes and copies are structural."""
    code, rest = F.substring("value", 1, 2), F.expr("substring(value, 4)")
    path = norm_path(F.when(rest.contains(" -> "), F.substring_index(rest, " -> ", -1)).otherwise(rest))
    structural = code.rlike("[RDC]") | F.col("value").contains(" -> ")
    extra = [c for c in lines.columns if c != "value"]
    return lines.where(F.length("value") >= 4).select(
        *extra, path.alias("path"), F.lit(0).alias("added"), F.lit(0).alias("deleted"), structural.alias("structural")
    ).where("path <> ''")


def read_path_list(lists: DataFrame) -> DataFrame:
    """Changed paths of explicit lists (column value): JSON list, {"paths": []}, or newline or comma separated."""
    value = F.trim("value")
    plain = _json(value, "array<string>")
    objects = _json(value, "array<struct<path:string>>")
    wrapped = _json(value, "struct<paths:array<string>>")["paths"]
    # A JSON list may mix texts and objects: an object parses to its path, a text to itself.
    from_list = F.when(
        value.startswith("["),
        F.zip_with(
            plain,
            F.coalesce(objects, F.array().cast("array<struct<path:string>>")),
            lambda p, o: F.when(p.startswith("{"), F.get_json_object(p, "$.path")).otherwise(F.coalesce(p, o["path"])),
        ),
    ).when(value.startswith("{"), wrapped)
    separator = F.when(value.contains("\n"), "\n").otherwise(",")
    split = F.transform(F.split(value, separator), lambda v: F.trim(v))
    paths = F.when(F.size(F.coalesce(from_list, F.array().cast("array<string>"))) > 0, from_list).otherwise(split)
    extra = [c for c in lists.columns if c != "value"]
    rows = lists.select(*extra, F.posexplode(paths).alias("ord", "raw"))
    rows = rows.select(*extra, norm_path(F.col("raw")).alias("path"), "ord").where("path <> ''")
    first = rows.groupBy(*extra, "path").agg(F.min("ord").alias("ord"))
    return first.select(*extra, "path", F.lit(0).alias("added"), F.lit(0).alias("deleted"), "ord")


# --- rules and policy --------------------------------------------------------------------


def resolve_rules(rows: DataFrame) -> DataFrame:
    """Rules of all layers (section, layer, ord, value): shared before specific, the first of equal values kept."""
    scope = scope_of(rows)
    return rows.where(F.trim("value") != "").groupBy(*scope, "section", F.trim("value").alias("value")).agg(
        F.min(F.struct("layer", "ord")).alias("place")
    ).select(*scope, "section", "value", "place.layer", "place.ord")


def resolve_policy(rows: DataFrame) -> DataFrame:
    """One policy row per scope from (key, value, layer): the highest layer that sets a key wins, else the default."""
    scope = scope_of(rows)
    value = F.col("value")

    def chosen(key: str):
        # max_by skips rows whose order is null: only layers that set this key count.
        return F.max_by(value, F.when((F.col("key") == key) & value.isNotNull(), F.col("layer")))

    return rows.groupBy(*scope).agg(*[F.coalesce(chosen(k), F.lit(v)).alias(k) for k, v in fixed.POLICY.items()])


# --- risk facts ----------------------------------------------------------------------------

# Names a fact may have in its object
COVERAGE_KEYS = "percent_covered line_rate coverage percent rate".split()
CHURN_KEYS = "changes commit_count count churn".split()
COMPLEXITY_KEYS = "complexity cyclomatic average_complexity max_complexity score".split()
RECURRENCE_KEYS = "count occurrences recurrence recent_count".split()


def _number(value: Column, keys: list[str]) -> Column:
    """Number of a JSON value: itself, or the first present key of an object."""
    inner = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in keys])
    number = F.when(F.trim(value).startswith("{"), inner).otherwise(value).try_cast("double")
    return F.when(number >= 0, number)


def coverage_of(value: Column) -> Column:
    number = _number(value, COVERAGE_KEYS)
    return F.round(F.least(F.lit(1.0), F.when(number > 1, number / 100.0).otherwise(number)), 4)


def complexity_of(value: Column) -> Column:
    """Complexity of a value, or the largest of a list."""
    items = F.from_json(value, "array<string>")
    largest = F.array_max(F.transform(items, lambda v: _number(v, COMPLEXITY_KEYS)))
    return F.round(F.when(F.trim(value).startswith("["), largest).otherwise(_number(value, COMPLEXITY_KEYS)), 4)


def normalise_risk(documents: DataFrame) -> DataFrame:
    """Risk facts per path from JSON documents (column text): coverage, churn, complexity, public API, recurrence, tests.

    Later blocks of a document override earlier ones, path by path and fact by fact.
    """
    scope = scope_of(documents)

    def block(pointer: str, fact: str, prio: int, value: Callable = lambda v: v) -> DataFrame:
        entries = F.from_json(F.get_json_object("text", pointer), STRING_MAP)
        rows = documents.select(*scope, F.explode(entries).alias("raw", "v"))
        return rows.select(
            *scope, norm_scope_path(F.col("raw")).alias("path"), F.lit(fact).alias("fact"), F.lit(prio).alias("prio"),
            value(F.col("v")).cast("double").alias("value"),
        )

    def summary(v: Column) -> Column:
        return coverage_of(F.get_json_object(v, "$.summary"))

    def whole(keys: list[str]) -> Callable:
        return lambda v: F.floor(_number(v, keys))

    def test_count(v: Column) -> Column:
        items = F.filter(F.from_json(v, "array<string>"), lambda x: norm_scope_path(x) != "")
        return F.coalesce(F.size(items), F.lit(0))

    def truthy(v: Column) -> Column:
        return F.when(F.trim(v).startswith("{") | ~F.lower(F.trim(v)).isin("", "false", "0", "null", "[]"), 1)

    def listed() -> DataFrame:
        items = F.from_json(F.get_json_object("text", "$.public_api_files"), "array<string>")
        is_list = F.get_json_object("text", "$.public_api_files").startswith("[")
        rows = documents.where(is_list).select(*scope, F.explode(items).alias("raw"))
        return rows.select(
            *scope, norm_scope_path(F.col("raw")).alias("path"), F.lit("public_api").alias("fact"), F.lit(1).alias("prio"), F.lit(1.0).alias("value")
        )

    parts = [
        block("$.files", "coverage", 1, summary),
        block("$.coverage_py.files", "coverage", 2, summary),
        block("$.coverage_report.files", "coverage", 3, summary),
        block("$.coverage_by_file", "coverage", 4, coverage_of),
        block("$.git_churn_by_file", "churn", 1, whole(CHURN_KEYS)),
        block("$.churn_report", "churn", 2, whole(CHURN_KEYS)),
        block("$.churn_by_file", "churn", 3, whole(CHURN_KEYS)),
        block("$.radon_cc", "complexity", 1, complexity_of),
        block("$.complexity_report", "complexity", 2, complexity_of),
        block("$.radon", "complexity", 3, complexity_of),
        block("$.complexity_by_file", "complexity", 4, lambda v: F.round(_number(v, COMPLEXITY_KEYS), 4)),
        block("$.public_api_files", "public_api", 2, truthy),
        listed(),
        block("$.historical_recurrence_by_file", "recurrence", 1, whole(RECURRENCE_KEYS)),
        block("$.test_files_by_source", "related_tests", 1, test_count),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    known = rows.where((F.col("path") != "") & F.col("value").isNotNull())

    def latest(fact: str) -> Column:
        return F.max_by("value", F.when(F.col("fact") == fact, F.col("prio")))

    merged = known.groupBy(*scope, "path").agg(
        latest("coverage").alias("coverage"),
        latest("churn").cast("int").alias("churn"),
        latest("complexity").alias("complexity"),
        (F.max(F.when(F.col("fact") == "public_api", F.col("value"))) == 1).alias("public_api"),
        latest("recurrence").cast("int").alias("recurrence"),
        latest("related_tests").cast("int").alias("related_tests"),
    )
    return merged


# --- plans -----------------------------------------------------------------------------------


def _first_path(item: Column, keys: list[str]) -> Column:
    return F.coalesce(
        *[F.nullif(norm_scope_path(F.get_json_object(item, f"$.{k}")), F.lit("")) for k in keys], F.lit("")
    )


def _texts(item: Column, key: str) -> Column:
    """Trimmed texts of a field that is a text or a list."""
    raw = F.get_json_object(item, f"$.{key}")
    values = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(values, none), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")


# Names a plan field may have
SOURCE_KEYS = "source_glob source path from_path".split()
IMPORT_KEYS = "imports modules module import target dependency".split()
ALTERNATIVE_KEYS = "any_of alternatives alternative_imports".split()
TEST_PATH_KEYS = "test_path test_glob path glob test".split()
TEST_SOURCE_KEYS = "source_glob source source_path source_path_glob for_path from_path".split()
MIGRATION_PATH_KEYS = "path api_path public_api_path glob api_glob".split()
MIGRATION_SOURCE_KEYS = "source_glob source from_path".split()
INTENT_SOURCE_KEYS = "source_glob source path path_glob for_path from_path".split()
ALL_TERM_KEYS = "required_terms requires_terms all_of must_include".split()
ANY_TERM_KEYS = "any_of_terms requires_any any_of".split()
FORBIDDEN_TERM_KEYS = "forbidden_terms must_not_include disallowed_terms".split()


def flatten_plan(plans: DataFrame) -> dict[str, DataFrame]:
    """Expectation tables of reviewed plans (columns plan_id, text): paths, imports, tests, migrations, intents.

    Each is deduplicated on its natural key; the first entry wins.
    """
    keys = [*scope_of(plans), "plan_id"]

    def items(*fields: str) -> DataFrame:
        rows = None
        for i, field in enumerate(fields):
            raw = F.from_json(F.get_json_object("text", f"$.understood_plan.{field}"), "array<string>")
            part = plans.select(*keys, F.lit(i).alias("block"), F.posexplode(raw).alias("pos", "item"))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def once(df: DataFrame, natural: list[str]) -> DataFrame:
        return df.groupBy(*keys, *natural).agg(F.min(F.struct("block", "pos", "sub")).alias("place"))

    item = F.col("item")
    zero = F.lit(0).alias("sub")
    is_object = item.startswith("{")
    path = F.when(is_object, norm_scope_path(F.get_json_object("item", "$.path"))).otherwise(norm_scope_path(item))
    paths = items("changes").select(*keys, "block", "pos", zero, path.alias("path")).where("path <> ''")

    deps = items("dependencies").where(is_object).withColumn("source", _first_path(item, SOURCE_KEYS))
    single = F.concat(*[_texts(item, k) for k in IMPORT_KEYS])
    options = F.array_sort(F.array_distinct(F.concat(*[_texts(item, k) for k in ALTERNATIVE_KEYS])))
    lists = F.concat(
        F.transform(F.array_distinct(single), lambda m: F.struct(F.array(m).alias("modules"), F.lit(False).alias("any_of"))),
        F.when(F.size(options) > 0, F.array(F.struct(options.alias("modules"), (F.size(options) > 1).alias("any_of")))).otherwise(
            F.array().cast("array<struct<modules:array<string>,any_of:boolean>>")
        ),
    )
    imports = deps.select(*keys, "block", "pos", "source", F.posexplode(lists).alias("sub", "e")).select(*keys, "block", "pos", "sub", "source", "e.*")

    tests = items("expected_tests", "tests").where(is_object).select(
        *keys, "block", "pos", zero, _first_path(item, TEST_SOURCE_KEYS).alias("source"), _first_path(item, TEST_PATH_KEYS).alias("test_path")
    ).where("test_path <> ''")

    def text(key: str) -> Column:
        return F.trim(F.coalesce(F.get_json_object("item", f"$.{key}"), F.lit(""))).alias(key)

    migrations = items("public_api_migrations", "api_migrations").where(is_object).select(
        *keys, "block", "pos", zero, _first_path(item, MIGRATION_SOURCE_KEYS).alias("source"),
        _first_path(item, MIGRATION_PATH_KEYS).alias("path"), text("symbol"), text("old_symbol"), text("new_symbol"),
    ).where("path <> ''")

    def terms(names: list[str]) -> Column:
        return F.array_sort(F.array_distinct(F.concat(*[_texts(item, k) for k in names])))

    intents = items("intent_checks", "semantic_intents").where(is_object).select(
        *keys, "block", "pos", zero, _first_path(item, INTENT_SOURCE_KEYS).alias("source"), terms(ALL_TERM_KEYS).alias("all_terms"),
        terms(ANY_TERM_KEYS).alias("any_terms"), terms(FORBIDDEN_TERM_KEYS).alias("forbidden_terms"), text("label"), text("intent"), text("reason"),
    ).where("size(all_terms) + size(any_terms) + size(forbidden_terms) > 0")
    return {
        "paths": once(paths, ["path"]),
        "imports": once(imports, ["source", "modules", "any_of"]),
        "tests": once(tests, ["source", "test_path"]),
        "migrations": once(migrations, ["source", "path", "symbol", "old_symbol", "new_symbol"]),
        "intents": once(intents, ["source", "all_terms", "any_terms", "forbidden_terms", "label", "intent", "reason"]),
    }


# --- feedback ----------------------------------------------------------------------------------

KNOWN_STATUSES = "rejected not_applicable superseded accepted deferred".split()
KNOWN_SCOPES = "exact_advice same_path_kind pattern".split()


def read_feedback(documents: DataFrame) -> DataFrame:
    """Feedback rows of JSON documents ({"items": [...]}, column text) in their order."""
    scope = scope_of(documents)
    kind = schemas.table(items=T.ArrayType(schemas.FEEDBACK))
    parsed = documents.select(*scope, _json(F.col("text"), kind).alias("d"))
    return parsed.select(*scope, F.posexplode("d.items").alias("ord", "i")).select(*scope, "ord", "i.*")


def normalise_feedback(items: DataFrame) -> DataFrame:
    """Rows with a known status; a missing scope follows from the key that is present."""

    def clean(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    def snake(c: str) -> Column:
        return F.translate(F.lower(clean(c)), "- ", "__")

    implied = (
        F.when((clean("advice_id") != "") | (clean("concern_id") != ""), "exact_advice")
        .when(clean("path") != "", "same_path_kind")
        .when(clean("pattern") != "", "pattern")
    )
    chosen = F.when(snake("scope").isin(KNOWN_SCOPES), snake("scope")).otherwise(implied)
    rows = items.withColumns({"status": snake("status"), "scope": chosen})
    return rows.where(F.col("status").isin(KNOWN_STATUSES) & F.col("scope").isNotNull()).withColumns(
        {
            "advice_id": clean("advice_id"),
            "concern_id": clean("concern_id"),
            "kind": snake("kind"),
            "path": norm_scope_path(F.col("path")),
            "symbol": clean("symbol"),
            "pattern": F.lower(clean("pattern")),
            "reason": clean("reason"),
        }
    )


def normalise_metadata_rules(rules: DataFrame) -> DataFrame:
    """Cleanup-metadata rules with clean texts; a bad ttl or expiry is dropped."""
    ttl = F.col("ttl_days").try_cast("int")
    return rules.withColumns(
        {
            "path": norm_scope_path(F.col("path")),
            "kind": F.lower(F.trim(F.coalesce("kind", F.lit("")))),
            "category": F.lower(F.trim(F.coalesce("category", F.lit("")))),
            "owner": F.trim(F.coalesce("owner", F.lit(""))),
            "ttl_days": F.when(ttl > 0, ttl),
            "expires_at": valid_expiry(F.col("expires_at")),
        }
    )
