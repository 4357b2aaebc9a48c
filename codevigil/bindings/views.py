"""Views that give the driver tables the shapes of code-health tables.

A view is a table and a select list that both engines read the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_files": (
        "documents",
        [
            "doc_id",
            "concat(source, '/src/', lang, '/d', doc_id, '.txt') AS path",
            "concat(source, ':', lang) AS component",
            "lang",
            "source",
            "text",
            "n_chars AS bytes",
            "doc_id AS mtime",
        ],
    ),
    "v_find": (
        "lineitem",
        [
            "concat('s', l_suppkey, '/src/core/p', l_partkey, '.py') AS path",
            "concat('s', l_suppkey, ':core') AS component",
            "CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity",
            "CASE l_linestatus WHEN 'O' THEN 'complexity' ELSE 'file_size' END AS dimension",
            "CASE l_linenumber % 5 WHEN 0 THEN 'cyclomatic_complexity' WHEN 1 THEN 'module_lines' "
            "WHEN 2 THEN 'class_public_methods' WHEN 3 THEN 'line_length_hard_hits' "
            "ELSE 'line_length_soft_hits' END AS metric",
            "concat('f', l_linenumber) AS symbol",
            "CAST(l_quantity AS INT) AS value",
            "12 AS threshold",
            "l_shipdate AS ts",
            "l_orderkey",
            "l_linenumber",
            "l_orderkey * 10 + l_linenumber AS ord",
        ],
    ),
    "v_changes": (
        "orders",
        [
            "concat('s', o_custkey % 20, '/src/core/p', o_custkey, '.py') AS path",
            "concat('s', o_custkey % 20, ':core') AS component",
            "CAST(o_orderkey % 50 AS INT) AS added",
            "CAST(o_orderkey % 20 AS INT) AS deleted",
            "o_orderstatus = 'P' AS structural",
            "o_orderdate AS ts",
            "o_orderkey AS ord",
        ],
    ),
    "v_edge": (
        "lineitem",
        [
            "concat('s', l_suppkey, ':core') AS src_component",
            "concat('s', l_suppkey, '/src/core/p', l_partkey, '.py') AS src_path",
            "concat('s', (l_suppkey + l_orderkey) % 20, '/src/core/p', l_orderkey % 50, '.py') AS dst_path",
            "concat('s', (l_suppkey + l_orderkey) % 20, ':core') AS dst_component",
            "greatest(1, CAST(l_quantity AS INT) % 5) AS weight",
        ],
    ),
    "v_imports": (
        "lineitem",
        [
            "concat('s', l_suppkey % 20, '/src/core/p', l_partkey, '.py') AS path",
            "concat('s', l_orderkey % 20, '.core.p', l_partkey % 50) AS module",
            "l_linenumber AS line",
        ],
    ),
    "v_events": (
        "events",
        [
            "event_id AS ord",
            "ts AS generated_at",
            "CASE event_type WHEN 'error' THEN 'fix_advice' ELSE 'code_review' END AS mode",
            "CASE WHEN event_type IN ('purchase', 'signup') THEN 'full' ELSE 'diff' END AS review_type",
            "value AS overall",
            "concat('src/u', user_id, '.py') AS path",
            "event_type AS kind",
        ],
    ),
    "v_conc": (
        "events",
        [
            "concat('c', event_id) AS concern_id",
            "CASE user_id % 5 WHEN 0 THEN 'cleanup' WHEN 1 THEN 'hotspot' WHEN 2 THEN 'boundary' "
            "WHEN 3 THEN 'duplication' ELSE 'shadow-implementation' END AS kind",
            "CASE event_type WHEN 'error' THEN 'high-concern' WHEN 'click' THEN 'caution' "
            "WHEN 'view' THEN 'caution' ELSE 'info' END AS level",
            "(event_id % 97) / CAST(100 AS DOUBLE) AS confidence",
            "concat('src/u', user_id, '.py') AS path",
            "event_id",
            "user_id",
            "event_type",
        ],
    ),
    "v_risk": (
        "customer",
        [
            "concat('src/u', c_custkey, '.py') AS path",
            "(c_custkey % 100) / CAST(100 AS DOUBLE) AS coverage",
            "CAST(c_custkey % 20 AS INT) AS churn",
            "CAST(c_nationkey AS DOUBLE) AS complexity",
            "c_mktsegment = 'BUILDING' AS public_api",
            "CAST(c_custkey % 4 AS INT) AS recurrence",
            "CAST(c_custkey % 3 AS INT) AS related_tests",
        ],
    ),
    "v_parts": (
        "part",
        [
            "p_partkey",
            "concat('src/pkg/', replace(p_name, ' ', '_'), '_', p_partkey, '.py') AS path",
            "p_name",
            "p_brand",
            "p_type",
            "p_size",
        ],
    ),
}

_DUCK = {
    "v_tok": "SELECT doc_id, concat(source, '/src/', lang, '/d', doc_id, '.txt') AS path, lang AS kind, source AS role, "
    "list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM documents",
}


class Tables:
    """Driver tables and binding views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table, select = VIEWS[name]
        return self.table(table).selectExpr(*select)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name) if name in VIEWS else self.table(name)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the views it names."""
    named = [v for v in (*VIEWS, *_DUCK) if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql.strip()
    bodies = []
    for name in named:
        if name in VIEWS:
            table, select = VIEWS[name]
            bodies.append(f"{name} AS (SELECT {', '.join(select)} FROM {table})")
        else:
            bodies.append(f"{name} AS ({_DUCK[name]})")
    text = sql.strip()
    joiner = ",\n" if text.upper().startswith("WITH ") else "\n"
    rest = text[5:] if text.upper().startswith("WITH ") else text
    return "WITH " + ",\n".join(bodies) + joiner + rest


def r2(expr: str) -> str:
    """SQL: round half up to two decimals on the decimal text, as Spark does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(18,8)), 2) AS DOUBLE)"


def rounded(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


# Severity points and grades in SQL.
POINTS = "CASE severity WHEN 'critical' THEN 400 WHEN 'warning' THEN 120 WHEN 'info' THEN 15 ELSE 20 END"
CRITICAL = "CAST(count(*) FILTER (severity = 'critical') AS BIGINT)"
WARNING = "CAST(count(*) FILTER (severity = 'warning') AS BIGINT)"
INFO = "CAST(count(*) FILTER (severity = 'info') AS BIGINT)"


def grade(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 85 THEN 'A' WHEN {score} >= 70 THEN 'B' WHEN {score} >= 55 THEN 'C' "
        f"WHEN {score} >= 40 THEN 'D' ELSE 'E' END"
    )


def verdict(score: str, pass_min: str, warn_min: str) -> str:
    return f"CASE WHEN {score} >= {pass_min} THEN 'approve' WHEN {score} >= {warn_min} THEN 'needs_changes' ELSE 'block' END"
