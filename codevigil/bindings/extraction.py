"""Extraction jobs over Python sources that Spark writes from the conversations.

Every turn becomes one file. Each word of the whole text becomes one statement, chosen by
the length of the word, so the expected tree sizes, branches and groups follow in SQL.
"""

from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import similarity as M
from ..session import materialise
from ..sources import extract as B
from ..sources import files as Z
from . import register

def words():
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))


def _statements(words):
    """One statement a word, as lines that are indented by four blanks."""

    def one(w):
        k = F.length(w) % 4
        return (
            F.when(k == 0, "    x = x + 1\n")
            .when(k == 1, "    if x > 1:\n        x = 2\n")
            .when(k == 2, "    y = max(x, 3)\n")
            .otherwise("    x = y or x\n")
        )

    return F.array_join(F.transform(words, one), "")


def _deeper(lines):
    """Lines that end in a line feed, four blanks further in."""
    moved = F.concat(F.lit("    "), F.replace(lines, F.lit("\n"), F.lit("\n    ")))
    return F.when(lines == "", lines).otherwise(F.substring(moved, F.lit(1), F.length(moved) - 4))


def sources(t):
    """path, text (Python source), and the words it was made from; a few files are broken or re-exports."""
    c = t.conversations
    turn, conv = F.col("turn"), F.col("conv_id")
    path = F.concat(F.lit("src/talk/sub/report_c"), conv, F.lit("_t"), turn, F.lit(".py"))
    rows = c.select("conv_id", "turn", "role", "text", path.alias("path"))
    # Writing and parsing are the costly part: spread the turns over all cores, however few blocks they came from, in many short tasks.
    rows = rows.repartition(16 * t.spark.sparkContext.defaultParallelism, "path")
    rows = rows.select("conv_id", "turn", "role", "path", words().alias("w"))
    rows = rows.withColumn("body", _statements(F.col("w")))
    head = F.concat(
        F.lit("import os.path as p\nfrom pkg"), conv % 5, F.lit(".core import alpha, beta\nfrom . import sib"), turn,
        F.lit("\nfrom ..up import z\n\n\n"),
    )
    tail = F.when(turn % 3 == 0, F.concat(F.lit("    return helper_"), conv % 2, F.lit("(x)\n"))).otherwise("    return x\n")
    function = F.concat(F.lit("def "), "role", F.lit("_step"), turn, F.lit("(x, y=1):\n"), F.col("body"), tail)
    klass = F.concat(
        F.lit("\n\nclass "), F.initcap("role"), F.lit("Parser:\n    def __init__(self, x):\n        self.x = x\n\n    def parse(self, x, y):\n"),
        _deeper(F.col("body")), F.lit("        return x\n"),
    )
    text = (
        F.when(conv % 11 == 10, "from ._compat_reexport import reexport\nreexport(__name__)\n")
        .when(conv % 13 == 12, "def broken(:\n    pass\n")
        .otherwise(F.concat(head, function, klass))
    )
    drop = F.when(conv % 3 == 0, 0).when(conv % 3 == 1, 1).otherwise(2)
    return rows.select("path", text.alias("text"), "conv_id", "turn", "role", F.size("w").alias("words"), drop.alias("drop"))


_SRC = """sw AS (SELECT *, concat('src/talk/sub/report_c', conv_id, '_t', turn, '.py') AS path, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) % 4) AS ks FROM conversations),
    sr AS (SELECT conv_id, turn, role, path, ks, len(list_filter(ks, lambda k: k = 0)) AS k0, len(list_filter(ks, lambda k: k = 1)) AS k1,
      len(list_filter(ks, lambda k: k = 2)) AS k2, len(list_filter(ks, lambda k: k = 3)) AS k3 FROM sw),
    ok AS (SELECT *, 8 * k0 + 10 * k1 + 9 * k2 + 9 * k3 AS body, CASE WHEN turn % 3 = 0 THEN 6 ELSE 3 END AS tail FROM sr WHERE conv_id % 11 <> 10 AND conv_id % 13 <> 12),
    fn AS (SELECT path, 7 AS line, concat(role, '_step', turn) AS symbol, 5 + body + tail AS node_count, concat_ws(',', 'f', turn % 3 = 0, array_to_string(ks, '')) AS shape,
        CASE WHEN turn % 3 = 0 AND k1 = 0 AND len(ks) <= 3 THEN concat('helper_', conv_id % 2) ELSE '' END AS thin_wrapper_call FROM ok
      UNION ALL SELECT path, 15 + len(ks) + k1, concat(upper(left(role, 1)), substr(role, 2), 'Parser.parse'), 5 + body + 3, concat_ws(',', 'm', array_to_string(ks, '')), '' FROM ok),
    fs AS (SELECT * FROM fn WHERE node_count >= 25)"""


@register(
    "function_fingerprints",
    f"WITH {_SRC} SELECT path, CAST(line AS INT) AS line, symbol, CAST(node_count AS INT) AS node_count, thin_wrapper_call, count(*) OVER (PARTITION BY shape) AS group_size FROM fs",
)
def function_fingerprints(t):
    rows = materialise(B.extract_functions(sources(t)), "functions")
    sizes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "fingerprint").drop("fingerprint")


@register(
    "ast_near_duplicates",
    f"""WITH {_SRC}, tw AS (SELECT * FROM fs UNION ALL SELECT replace(path, 'src/talk/', 'src/tree/') AS path, line, symbol, node_count, shape, thin_wrapper_call FROM fs
      WHERE CAST(regexp_extract(path, '_c([0-9]+)_t', 1) AS BIGINT) % 7 = 0),
    g AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY path, line, symbol) AS i, first_value(path) OVER (PARTITION BY shape ORDER BY path, line, symbol) AS reference,
      first_value(thin_wrapper_call) OVER (PARTITION BY shape ORDER BY path, line, symbol) AS rc FROM tw)
    SELECT path, symbol, reference FROM g WHERE i > 1 AND NOT (thin_wrapper_call <> '' AND rc <> '' AND thin_wrapper_call <> rc)""",
)
def ast_near_duplicates(t):
    """Every seventh conversation lies in a second tree as well."""
    files = sources(t)
    files = files.unionByName(files.where("conv_id % 7 = 0").withColumn("path", F.regexp_replace("path", "src/talk/", "src/tree/")))
    rows = D.near_duplicates(materialise(B.extract_functions(files), "functions")).where("confidence = 0.9")
    return rows.select("path", "location.symbol", F.col("references")[0]["path"].alias("reference"))


@register(
    "symbol_features",
    f"""WITH {_SRC}, sy AS (SELECT path, concat(role, '_step', turn) AS symbol, 'function' AS symbol_kind, 5 + body + tail AS node_count, k1, k3, 2 AS parameter_count, 0 AS member_count FROM ok
      UNION ALL SELECT path, concat(upper(left(role, 1)), substr(role, 2), 'Parser.parse'), 'function', 8 + body, k1, k3, 2, 0 FROM ok
      UNION ALL SELECT path, concat(upper(left(role, 1)), substr(role, 2), 'Parser'), 'class', 20 + body, k1, k3, 1, 2 FROM ok)
    SELECT path, symbol, symbol_kind, CAST(node_count AS INT) AS node_count, CAST(k1 AS DOUBLE) AS ifs, CAST(k3 AS DOUBLE) AS ors, parameter_count, member_count FROM sy
    WHERE node_count >= CASE symbol_kind WHEN 'class' THEN 90 ELSE 45 END""",
)
def symbol_features(t):
    rows = B.extract_symbols(sources(t))

    def count(key):
        return F.coalesce(F.try_element_at("features", F.lit(key)), F.lit(0.0))

    return rows.select(
        "path", "symbol", "symbol_kind", "node_count", count("node:If").alias("ifs"), count("bool:Or").alias("ors"), "parameter_count", "member_count"
    )


@register("ast_shadow_pairs")
def ast_shadow_pairs(t):
    """Twenty conversations make a repository; pairs lie within one."""
    files = sources(t).withColumn("repo", F.concat(F.lit("r"), F.floor(F.col("conv_id") / 20)))
    rows = M.shadow_pairs(materialise(B.extract_symbols(files), "symbols"))
    return rows.select("repo", "rank", F.col("primary.path").alias("path"), F.col("existing.path").alias("existing"), "symbol_kind", "confidence")


@register("ast_module_pairs")
def ast_module_pairs(t):
    files = sources(t).withColumn("repo", F.concat(F.lit("r"), F.floor(F.col("conv_id") / 20)))
    modules = materialise(B.extract_modules(files).where("reason IS NULL"), "modules")
    return M.module_totals(modules)


@register(
    "module_exclusions",
    f"""WITH {_SRC} SELECT 'too_small' AS reason, (SELECT count(*) FROM sr WHERE conv_id % 11 = 10) + (SELECT count(*) FROM ok WHERE 35 + 2 * body + tail < 220) AS n
    UNION ALL SELECT 'parse_error', count(*) FROM sr WHERE conv_id % 11 <> 10 AND conv_id % 13 = 12""",
)
def module_exclusions(t):
    return B.module_exclusions(B.extract_modules(sources(t)))


@register(
    "reexport_wrappers",
    f"WITH {_SRC} SELECT path FROM sr WHERE conv_id % 11 = 10",
)
def reexport_wrappers(t):
    return B.extract_modules(sources(t)).where("reexport").select("path")


@register(
    "import_edges",
    f"""WITH {_SRC}, e AS (SELECT path, 'os.path' AS module, 1 AS line FROM ok UNION ALL SELECT path, unnest([concat('pkg', conv_id % 5, '.core'), concat('pkg', conv_id % 5, '.core.alpha'), concat('pkg', conv_id % 5, '.core.beta')]), 2 FROM ok
      UNION ALL SELECT path, unnest(['talk.sub', concat('talk.sub.sib', turn)]), 3 FROM ok UNION ALL SELECT path, unnest(['talk.up', 'talk.up.z']), 4 FROM ok
      UNION ALL SELECT path, unnest(['talk.sub._compat_reexport', 'talk.sub._compat_reexport.reexport']), 1 FROM sr WHERE conv_id % 11 = 10)
    SELECT path, module, CAST(line AS INT) AS line FROM e""",
)
def import_edges(t):
    return B.extract_imports(sources(t))


@register(
    "internal_imports",
    f"""WITH {_SRC} SELECT path, CAST(2 + CASE WHEN conv_id % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n, concat(CASE WHEN conv_id % 5 = 3 THEN 'core,' ELSE '' END, 'sib', turn, ',up') AS targets FROM ok
    UNION ALL SELECT path, 1, '_compat_reexport' FROM sr WHERE conv_id % 11 = 10""",
)
def internal_imports(t):
    return B.internal_imports(sources(t), F.lit("pkg3")).withColumn("targets", F.array_join("targets", ","))


@register(
    "code_findings",
    f"""WITH {_SRC}, c AS (SELECT path, concat(role, '_step', turn) AS symbol, 1 + k1 + k3 AS cc FROM ok UNION ALL SELECT path, 'parse', 1 + k1 + k3 FROM ok)
    SELECT path, symbol, CASE WHEN cc > 12 THEN 'critical' ELSE 'warning' END AS severity, CAST(cc AS INT) AS value FROM c WHERE cc > 8
    UNION ALL SELECT path, '', 'warning', 0 FROM sr WHERE conv_id % 11 <> 10 AND conv_id % 13 = 12""",
)
def code_findings(t):
    return B.code_findings(sources(t)).select("path", "symbol", "severity", "value")


@register(
    "size_findings",
    """WITH l AS (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM v_files),
    n AS (SELECT path, len(ls) AS n, len(list_filter(ls, lambda x: length(x) > 90)) AS s, len(list_filter(ls, lambda x: length(x) > 110)) AS h FROM l)
    SELECT path, 'module_lines' AS metric, CASE WHEN n > 450 THEN 'critical' ELSE 'warning' END AS severity, CAST(n AS INT) AS value FROM n WHERE n > 200
    UNION ALL SELECT path, 'line_length_hard_hits', 'warning', CAST(h AS INT) FROM n WHERE h > 0 UNION ALL SELECT path, 'line_length_soft_hits', 'info', CAST(s AS INT) FROM n WHERE h = 0 AND s > 0""",
)
def size_findings(t):
    return Z.size_findings(t.v_files).select("path", "metric", "severity", "value")


@register(
    "corpus_metrics",
    """WITH l AS (SELECT lang, bytes, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM v_files),
    n AS (SELECT lang, bytes, len(ls) AS n, len(list_filter(ls, lambda x: length(x) > 90)) AS s, len(list_filter(ls, lambda x: length(x) > 110)) AS h FROM l)
    SELECT 'total_files' AS metric, 'all' AS key, count(*) AS value FROM n UNION ALL SELECT 'total_lines', 'all', CAST(sum(n) AS BIGINT) FROM n
    UNION ALL SELECT 'total_bytes', 'all', CAST(sum(bytes) AS BIGINT) FROM n UNION ALL SELECT 'line_over_soft', 'all', CAST(sum(s) AS BIGINT) FROM n
    UNION ALL SELECT 'line_over_hard', 'all', CAST(sum(h) AS BIGINT) FROM n UNION ALL SELECT 'language', lang, count(*) FROM n GROUP BY lang UNION ALL SELECT 'extension', '.txt', count(*) FROM n""",
)
def corpus_metrics(t):
    return Z.corpus_metrics(t.v_files)


@register(
    "largest_files",
    """WITH l AS (SELECT path, bytes, CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS INT) AS lines FROM v_files)
    SELECT *, CAST(row_number() OVER (ORDER BY lines DESC, bytes DESC, path) AS INT) AS rank FROM l ORDER BY rank LIMIT 20""",
)
def largest_files(t):
    return Z.largest_files(t.v_files)


@register(
    "incremental_extraction",
    """WITH f AS (SELECT doc_id, path, bytes, doc_id IN (SELECT doc_id FROM labels) AS seen FROM v_files)
    SELECT count(*) AS file_total, count(*) FILTER (seen AND doc_id % 2 = 0) AS hit_total, count(*) FILTER (NOT (seen AND doc_id % 2 = 0)) AS miss_total FROM f""",
)
def incremental_extraction(t):
    """Labelled documents were extracted before; the odd ones changed since."""
    files = t.v_files.select("path", "text", "bytes", "mtime", "doc_id")
    old = files.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    old = old.withColumn("mtime", F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(-1))

    def lengths(df):
        return df.select("path", F.length("text").alias("n"))

    rows, manifest, _ = B.incremental_extract(old, lengths, None, None, 1)
    return B.incremental_extract(files, lengths, rows, manifest, 1)[2]


@register(
    "incremental_rows",
    "SELECT path, CAST(length(text) AS INT) AS n FROM v_files",
)
def incremental_rows(t):
    files = t.v_files.select("path", "text", "bytes", "mtime", "doc_id")
    old = files.join(t.labels.select("doc_id"), "doc_id", "left_semi")

    def lengths(df):
        return df.select("path", F.length("text").alias("n"))

    rows, manifest, _ = B.incremental_extract(old, lengths, None, None, 1)
    return B.incremental_extract(files, lengths, rows, manifest, 1)[0]
