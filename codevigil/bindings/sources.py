"""Readers and sinks over documents that Spark derives from the driver tables."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import events as V
from ..sources import files as Z
from ..sources import inputs as N
from . import register


def _workspace(t, name):
    return f"{shared_dir(t.spark)}/codevigil/{name}-{uuid.uuid4().hex}"


@register(
    "corpus_scan",
    """SELECT path FROM v_files WHERE source NOT IN ('src1', 'src2') AND NOT (lang = 'de' AND doc_id % 10 = 3)""",
)
def corpus_scan(t):
    ignore = t.region.select(F.lit("*/de/*3.txt").alias("pattern")).distinct()
    return Z.scan_files(t.v_files, ["src1", "src2", "d3.txt"], [".png"], ignore, parents_only=True).select("path")


@register(
    "binary_filter",
    """SELECT page_id, length(regexp_replace(html, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) >= 0.7 * octet_length(encode(html)) AS is_text FROM pages
    UNION ALL SELECT -1 - doc_id, length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) >= 0.7 * octet_length(encode(text)) FROM documents""",
)
def binary_filter(t):
    rows = t.pages.select("page_id", F.encode("html", "UTF-8").alias("content")).unionByName(
        t.documents.select((F.lit(-1) - F.col("doc_id")).alias("page_id"), F.encode("text", "UTF-8").alias("content"))
    )
    return rows.select("page_id", Z.is_text(F.col("content")).alias("is_text"))


@register("tree_reader", "SELECT count(*) AS files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM benchmark")
def tree_reader(t):
    """Benchmark items written as one folder per item and read back as a file tree."""
    root = _workspace(t, "tree")
    t.benchmark.select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(root)
    tree = Z.read_tree(t.spark, root, "*.txt")
    return tree.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def bundle(t):
    """Four documents per part: a one-file repository each."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/p"), k, F.lit(".py"))
    name = F.regexp_replace("p_name", " ", "_")
    signature = F.array(F.struct(name.alias("name"), F.col("p_size").alias("line"), F.lit("").alias("parent")))
    none = F.array().cast("array<struct<name:string,line:int,parent:string>>")
    has = k % 3 == 0
    one = lambda v: F.struct(F.create_map(path, v).alias("files"))
    target = F.array(F.struct(F.concat(F.lit("lib/q"), k % 10, F.lit(".py:f")).alias("target"), (k % 4).alias("weight")))
    finding = F.array(F.struct(path.alias("path"), F.lit("warning").alias("severity"), F.lit("module_lines").alias("metric")))
    docs = {
        "manifest": one(F.struct(F.lit("source").alias("kind"), (k % 2 == 0).alias("include_in_architecture"))),
        "signatures": one(F.struct(F.when(has, signature).otherwise(none).alias("signatures"))),
        "index": F.struct(
            F.create_map(path, F.struct(F.when(k % 3 == 1, signature).otherwise(none).alias("signatures"))).alias("files"),
            F.create_map(F.concat(path, F.lit(":main")), target).alias("function_dependencies"),
        ),
        "metrics": F.struct(finding.alias("findings")),
    }
    rows = [F.struct(F.lit(n).alias("name"), F.to_json(d).alias("text")) for n, d in docs.items()]
    return t.part.select(F.concat(F.lit("r"), k).alias("repo"), F.inline(F.array(*rows)))


@register(
    "snapshot_tables",
    """SELECT 'files' AS what, concat('src/p', p_partkey, '.py') AS a, CAST(p_partkey % 2 = 0 AS VARCHAR) AS b FROM part
    UNION ALL SELECT 'signatures', concat('src/p', p_partkey, '.py'), concat(replace(p_name, ' ', '_'), ':', p_size) FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT 'dependencies', concat('src/p', p_partkey, '.py'), concat('lib/q', p_partkey % 10, '.py:f:', greatest(1, p_partkey % 4)) FROM part
    UNION ALL SELECT 'findings', concat('src/p', p_partkey, '.py'), 'warning' FROM part""",
)
def snapshot_tables(t):
    s = N.read_snapshot(bundle(t))
    return (
        s["files"].select(F.lit("files").alias("what"), F.col("path").alias("a"), F.col("include_in_architecture").cast("string").alias("b"))
        .unionByName(s["signatures"].select(F.lit("signatures").alias("what"), F.col("path").alias("a"), F.concat_ws(":", "name", F.col("line").cast("string")).alias("b")))
        .unionByName(
            s["dependencies"].select(
                F.lit("dependencies").alias("what"), F.col("src_path").alias("a"), F.concat_ws(":", "dst_path", "dst_symbol", F.col("weight").cast("string")).alias("b")
            )
        )
        .unionByName(s["findings"].select(F.lit("findings").alias("what"), F.col("path").alias("a"), F.col("severity").alias("b")))
    )


@register(
    "numstat_changes",
    """SELECT concat('src/', CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'core' ELSE 'b' END, '/p', o_custkey, '.py') AS path, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END) AS BIGINT) AS added,
      CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 20 END) AS BIGINT) AS deleted, count(*) AS n FROM orders GROUP BY 1""",
)
def numstat_changes(t):
    k = F.col("o_orderkey")
    file = F.concat(F.lit("/p"), "o_custkey", F.lit(".py"))
    path = F.when(k % 3 == 0, F.concat(F.lit("src/old"), file, F.lit(" => src/new"), file)).when(
        k % 3 == 1, F.concat(F.lit("src/core"), file)
    ).otherwise(F.concat(F.lit("lib/a => src/b}"), file))
    added, deleted = F.when(k % 5 == 0, "-").otherwise((k % 50).cast("string")), F.when(k % 5 == 0, "-").otherwise((k % 20).cast("string"))
    rows = N.read_numstat(t.orders.select(F.concat_ws("\t", added, deleted, path).alias("value")))
    return rows.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count(F.lit(1)).alias("n"))


@register(
    "porcelain_changes",
    """SELECT concat('src/p', o_custkey, '.py') AS path, count(*) FILTER (o_orderkey % 4 IN (0, 1, 2)) AS structural, count(*) AS n FROM orders GROUP BY 1""",
)
def porcelain_changes(t):
    k = F.col("o_orderkey") % 4
    path = F.concat(F.lit("src/p"), "o_custkey", F.lit(".py"))
    line = (
        F.when(k == 0, F.concat(F.lit("R  old.py -> "), path)).when(k == 1, F.concat(F.lit(" D "), path)).when(k == 2, F.concat(F.lit("C  a.py -> "), path)).otherwise(F.concat(F.lit("?? "), path))
    )
    rows = N.read_porcelain(t.orders.select(line.alias("value")))
    return rows.groupBy("path").agg(F.count_if("structural").alias("structural"), F.count(F.lit(1)).alias("n"))


@register(
    "path_lists",
    """SELECT c_custkey AS list_id, concat('a', c_custkey % 5, '.py') AS path FROM customer UNION SELECT c_custkey, concat('b', c_custkey % 3, '.py') FROM customer""",
)
def path_lists(t):
    k = F.col("c_custkey")
    a, b = F.concat(F.lit("a"), k % 5, F.lit(".py")), F.concat(F.lit("b"), k % 3, F.lit(".py"))
    value = (
        F.when(k % 4 == 0, F.to_json(F.array(a, b, a)))
        .when(k % 4 == 1, F.to_json(F.struct(F.array(a, b).alias("paths"))))
        .when(k % 4 == 2, F.concat(a, F.lit("\n"), b, F.lit("\n")))
        .otherwise(F.concat(a, F.lit(" , "), b))
    )
    return N.read_path_list(t.customer.select(k.alias("list_id"), value.alias("value"))).select("list_id", "path")


def event_rows(t):
    """Review results shaped from the driver events."""
    concern = F.struct(
        F.concat(F.lit("c"), "ord").alias("concern_id"), F.col("kind"), F.lit("info").alias("level"), F.lit(0.5).alias("confidence"),
        F.struct("path", F.lit(0).alias("line"), F.lit("").alias("symbol"), F.lit("module").alias("symbol_kind")).alias("location"), F.lit("x").alias("extra"),
    )
    e = t.v_events
    nothing = F.lit(None).cast("struct<concern_total:bigint,top_concern_total:bigint,concern_limit:bigint>")
    return e.select(
        "generated_at", "ord", "mode", "review_type", F.create_map(F.lit("overall"), F.col("overall")).alias("scores"), nothing.alias("summary"), F.array(concern).alias("concerns"),
        F.create_map(F.lit("a"), F.lit("b")).alias("artifacts"),
    )


@register(
    "event_ledger",
    "SELECT strftime(generated_at, '%Y%m') AS yyyymm, review_type, count(*) AS n, count(*) AS shown FROM v_events GROUP BY ALL",
)
def event_ledger(t):
    folder = _workspace(t, "events")
    V.append_events(V.build_events(event_rows(t), F.col("generated_at")), folder)
    rows = V.read_ledger(t.spark, folder)
    return rows.groupBy(F.col("yyyymm").cast("string").alias("yyyymm"), "review_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("concern_counts.total").alias("shown")
    )


def _event_lines(t):
    """Events as JSON lines in month folders, some of them blank or broken."""
    folder = _workspace(t, "lines")
    rows = V.build_events(event_rows(t), F.col("generated_at"))
    at = F.unix_micros("generated_at")
    line = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    V.append_event_lines(rows, F.when(at % 97 == 0, "{broken").when(at % 89 == 0, "").otherwise(line), folder)
    return folder


@register(
    "event_reader",
    """WITH e AS (SELECT *, epoch_us(generated_at) AS u FROM v_events), k AS (SELECT *, row_number() OVER (ORDER BY u DESC, ord DESC) AS i FROM e WHERE u % 97 <> 0 AND u % 89 <> 0)
    SELECT mode, review_type, count(*) AS n, max(generated_at) AS last FROM k GROUP BY ALL""",
)
def event_reader(t):
    rows = V.read_review_events(t.spark, _event_lines(t), limit=0)
    return rows.groupBy("mode", "review_type").agg(F.count(F.lit(1)).alias("n"), F.max("generated_at").alias("last"))


@register(
    "event_reader_recent",
    """WITH e AS (SELECT *, epoch_us(generated_at) AS u FROM v_events), k AS (SELECT generated_at FROM e WHERE u % 97 <> 0 AND u % 89 <> 0 ORDER BY u DESC LIMIT 300)
    SELECT strftime(generated_at, '%Y%m') AS yyyymm, count(*) AS n, min(generated_at) AS first, max(generated_at) AS last FROM k GROUP BY ALL""",
)
def event_reader_recent(t):
    """The last 300 events: the newest month folders only, as many as hold so many."""
    rows = V.read_review_events(t.spark, _event_lines(t), limit=300)
    return rows.groupBy(V.month_key(F.col("generated_at")).alias("yyyymm")).agg(F.count(F.lit(1)).alias("n"), F.min("generated_at").alias("first"), F.max("generated_at").alias("last"))


@register(
    "rule_layers",
    """WITH r AS (SELECT c_custkey % 50 AS repo, concat('rule', c_nationkey) AS value, c_custkey % 2 AS layer, c_custkey AS ord FROM customer)
    SELECT concat('r', repo) AS repo, 'ignore_paths' AS section, value, CAST(min(layer) AS INT) AS layer, arg_min(ord, layer * 1000000000 + ord) AS ord FROM r GROUP BY ALL""",
)
def rule_layers(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        F.concat(F.lit("r"), k % 50).alias("repo"), F.lit("ignore_paths").alias("section"), F.concat(F.lit(" rule"), "c_nationkey").alias("value"),
        (k % 2).cast("int").alias("layer"), k.alias("ord"),
    )
    return N.resolve_rules(rows)


@register(
    "policy_layers",
    """WITH p AS (SELECT c_custkey % 50 AS repo, c_nationkey % 3 AS k, c_custkey % 4 AS layer, c_custkey % 7 + 50 AS v, c_custkey FROM customer),
    m AS (SELECT repo, k, max(layer) AS layer FROM p GROUP BY ALL), w AS (SELECT p.repo, p.k, max(v) AS v FROM p JOIN m ON p.repo = m.repo AND p.k = m.k AND p.layer = m.layer GROUP BY ALL)
    SELECT concat('r', repo) AS repo, CAST(coalesce(max(v) FILTER (k = 0), 75) AS DOUBLE) AS pass_min, CAST(coalesce(max(v) FILTER (k = 1), 60) AS DOUBLE) AS warn_min, CAST(0.62 AS DOUBLE) AS weight_full FROM w GROUP BY repo""",
)
def policy_layers(t):
    k = F.col("c_custkey")
    key = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'full.pass_min' WHEN 1 THEN 'full.warn_min' ELSE 'unknown' END")
    # The layer carries the value as a tie-break, so equal layers are decided.
    rows = t.customer.select(
        F.concat(F.lit("r"), k % 50).alias("repo"), key.alias("key"), (k % 7 + 50).cast("double").alias("value"), ((k % 4) * 1000 + k % 7).alias("layer")
    )
    p = N.resolve_policy(rows)
    return p.select("repo", F.col("`full.pass_min`").alias("pass_min"), F.col("`full.warn_min`").alias("warn_min"), F.col("`overall.weight.full`").alias("weight_full"))


def risk_documents(t):
    """One risk document per customer, with facts under different names and an override."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("./src/u"), k, F.lit(".py"))
    cover = F.when(k % 3 == 0, F.to_json(F.struct((k % 100).alias("percent_covered")))).otherwise(F.to_json(F.struct(((k % 100) / 100.0).alias("line_rate"))))
    doc = F.concat(
        F.lit('{"files":{"'), path, F.lit('":{"summary":{"coverage":0.99}}},"coverage_by_file":{"'), path, F.lit('":'), cover,
        F.lit('},"git_churn_by_file":{"'), path, F.lit('":{"commit_count":'), k % 20, F.lit('}},"radon_cc":{"'), path,
        F.lit('":[{"complexity":1},{"complexity":'), F.col("c_nationkey"), F.lit('}]},"public_api_files":'),
        F.when(k % 2 == 0, F.concat(F.lit('["'), path, F.lit('"]'))).otherwise(F.concat(F.lit('{"'), path, F.lit('":false}'))),
        F.lit(',"historical_recurrence_by_file":{"'), path, F.lit('":'), k % 4, F.lit('},"test_files_by_source":{"'), path, F.lit('":'),
        F.when(k % 3 == 0, "[]").otherwise('["tests/a.py"]'), F.lit("}}"),
    )
    return t.customer.select(doc.alias("text"))


@register(
    "risk_facts",
    """SELECT concat('src/u', c_custkey, '.py') AS path, CAST(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 100 <= 1 THEN c_custkey % 100 ELSE (c_custkey % 100) / 100.0 END AS DOUBLE) AS coverage, CAST(c_custkey % 20 AS INT) AS churn,
      CAST(greatest(1, c_nationkey) AS DOUBLE) AS complexity, c_custkey % 2 = 0 AS public_api, CAST(c_custkey % 4 AS INT) AS recurrence, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS related_tests FROM customer""",
)
def risk_facts(t):
    return N.normalise_risk(risk_documents(t)).withColumn("public_api", F.coalesce("public_api", F.lit(False)))


def plan_documents(t):
    """One plan per supplier, with repeated and aliased entries."""
    k = F.col("s_suppkey")
    doc = F.concat(
        F.lit('{"understood_plan":{"changes":["src/a'), k, F.lit('.py",{"path":"./src/a'), k, F.lit('.py"},{"path":"src/b.py"}],"dependencies":[{"source":"src/","imports":["m1","m'), k % 3,
        F.lit('"]},{"source_glob":"src","any_of":["z","y"]},{"path":"lib","alternatives":["only"]}],"expected_tests":[{"test_path":"tests/t'), k,
        F.lit('.py"}],"tests":[{"glob":"tests/t'), k, F.lit('.py"},{"test":"tests/x.py","source":"src"}],"api_migrations":[{"api_path":"src/api.py","old_symbol":"f'), k,
        F.lit('"}],"intent_checks":[{"source":"src","must_include":["b","a","b"],"any_of":"one","label":"L'), k, F.lit('"},{"source":"src"}]}}'),
    )
    return t.supplier.select(k.alias("plan_id"), doc.alias("text"))


@register(
    "plan_tables",
    """SELECT s_suppkey AS plan_id, 'paths' AS what, unnest([concat('src/a', s_suppkey, '.py'), 'src/b.py']) AS entry FROM supplier
    UNION ALL SELECT s_suppkey, 'imports', unnest(list_distinct(['src=m1', concat('src=m', s_suppkey % 3), 'src=y|z', 'lib=only'])) FROM supplier
    UNION ALL SELECT s_suppkey, 'tests', unnest([concat('=tests/t', s_suppkey, '.py'), 'src=tests/x.py']) FROM supplier
    UNION ALL SELECT s_suppkey, 'migrations', concat('src/api.py:f', s_suppkey) FROM supplier UNION ALL SELECT s_suppkey, 'intents', concat('src=a|b/one/L', s_suppkey) FROM supplier""",
)
def plan_tables(t):
    p = N.flatten_plan(plan_documents(t))

    def rows(name, entry):
        return p[name].select("plan_id", F.lit(name).alias("what"), entry.alias("entry"))

    return (
        rows("paths", F.col("path"))
        .unionByName(rows("imports", F.concat_ws("=", "source", F.array_join("modules", "|"))))
        .unionByName(rows("tests", F.concat_ws("=", "source", "test_path")))
        .unionByName(rows("migrations", F.concat_ws(":", "path", "old_symbol")))
        .unionByName(rows("intents", F.concat(F.col("source"), F.lit("="), F.array_join("all_terms", "|"), F.lit("/"), F.array_join("any_terms", "|"), F.lit("/"), F.col("label"))))
    )


@register(
    "feedback_rows",
    """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'exact_advice' WHEN 1 THEN 'same_path_kind' ELSE 'pattern' END AS scope, 'not_applicable' AS status, 'shadow_implementation' AS kind FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def feedback_rows(t):
    k = F.col("s_suppkey")
    key = F.when(k % 3 == 0, F.concat(F.lit('"concern_id":"c'), k, F.lit('"'))).when(k % 3 == 1, '"path":"./a.py"').otherwise('"pattern":"X"')
    status = F.when(k % 5 == 0, "ignored").otherwise("Not-Applicable")
    doc = F.concat(F.lit('{"items":[{"status":"'), status, F.lit('","kind":"Shadow Implementation",'), key, F.lit(',"reason":"'), k, F.lit('"}]}'))
    rows = N.normalise_feedback(N.read_feedback(t.supplier.select(doc.alias("text"))))
    return rows.select(F.col("reason").cast("long").alias("id"), "scope", "status", "kind")


@register("result_sink", "SELECT 'conc' AS name, count(*) AS n FROM v_conc UNION ALL SELECT 'risk', count(*) FROM v_risk")
def result_sink(t):
    folders = V.write_tables({"conc": t.v_conc, "risk": t.v_risk}, _workspace(t, "sink"))
    out = None
    for name, folder in folders.items():
        one = t.spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


