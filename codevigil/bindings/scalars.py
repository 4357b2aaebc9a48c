"""Column functions, each applied to a whole driver table."""

from pyspark.sql import functions as F

from ..functions import ids, paths, scores, similarity, text
from . import register
from .views import rounded

STOP = ", ".join(f"'{w}'" for w in text.GOAL_STOPWORDS)


@register(
    "path_normalisation",
    """SELECT doc_id, concat(source, '/x/', lang) AS norm, concat(source, '/x/', lang) AS scoped, concat('./', source, '/x/', lang, '/') AS plain FROM documents""",
)
def path_normalisation(t):
    raw = F.concat(F.lit(" ./"), "source", F.lit("\\x\\"), "lang", F.lit("/ "))
    d = t.documents.select("doc_id", raw.alias("raw"))
    plain = paths.norm_path(F.col("raw"))
    scoped = paths.norm_scope_path(F.col("raw"))
    return d.select("doc_id", F.regexp_replace(plain, r"^\./|/$", "").alias("norm"), scoped.alias("scoped"), plain.alias("plain"))


# Suffixes and folders cycled over the parts so that every kind of path occurs.
_PATH = """concat(CASE p_size % 10 WHEN 0 THEN 'docs/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'a/fixtures/' WHEN 3 THEN 'infra/' WHEN 4 THEN 'build/' WHEN 5 THEN '.cache/' WHEN 6 THEN 'prompts/' WHEN 7 THEN 'scripts/' ELSE 'src/app/' END,
    replace(p_name, ' ', '_'), '_', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '_test.py' WHEN 3 THEN '.yaml' WHEN 4 THEN '_pb2.py' WHEN 5 THEN '.sh' ELSE '.tf' END)"""
_KIND = """CASE WHEN f = 5 THEN 'hidden' WHEN f = 4 THEN 'excluded' WHEN f = 0 OR s = 1 THEN 'doc' WHEN f = 2 THEN 'fixture' WHEN f = 3 OR s = 6 THEN 'infra'
    WHEN s = 4 THEN 'generated' WHEN f = 1 OR s = 2 THEN 'test' WHEN s IN (3, 5) THEN 'unsupported' ELSE 'source' END"""


def part_paths(t):
    return t.part.select("p_partkey", F.expr(_PATH).alias("path"))


@register("path_kind", f"WITH p AS (SELECT p_partkey, p_size % 10 AS f, p_partkey % 7 AS s FROM part) SELECT p_partkey, {_KIND} AS kind FROM p")
def path_kind(t):
    return part_paths(t).select("p_partkey", paths.path_kind(F.col("path")).alias("kind"))


@register(
    "cleanup_kind",
    f"""WITH p AS (SELECT p_partkey, p_size % 10 AS f, p_partkey % 7 AS s FROM part), k AS (SELECT *, {_KIND} AS kind FROM p)
    SELECT p_partkey, coalesce(CASE WHEN kind IN ('hidden', 'excluded', 'fixture', 'generated', 'infra', 'test') THEN NULL WHEN f = 6 THEN 'prompt' WHEN s = 3 THEN 'config'
      WHEN s = 5 OR (f = 7 AND s IN (0, 2, 4)) THEN 'script' WHEN kind IN ('doc', 'source') THEN kind END, '') AS kind FROM k""",
)
def cleanup_kind(t):
    return part_paths(t).select("p_partkey", F.coalesce(paths.cleanup_kind(F.col("path")), F.lit("")).alias("kind"))


@register("noise_paths", f"WITH p AS (SELECT p_partkey, p_size % 10 AS f, p_partkey % 7 AS s FROM part) SELECT p_partkey, {_KIND} NOT IN ('source', 'unsupported') AS noise FROM p")
def noise_paths(t):
    return part_paths(t).select("p_partkey", paths.is_noise_path(F.col("path")).alias("noise"))


@register(
    "first_party",
    f"""WITH p AS (SELECT p_partkey, p_size % 10 AS f, p_partkey % 7 AS s, p_partkey % 11 AS m FROM part), k AS (SELECT *, {_KIND} AS kind FROM p)
    SELECT p_partkey FROM k WHERE f <> 5 AND CASE m WHEN 0 THEN true WHEN 1 THEN false ELSE kind = 'source' END""",
)
def first_party(t):
    from ..operators.components import first_party as fp

    m = F.col("p_partkey") % 11
    files = part_paths(t).withColumn("include_in_architecture", F.when(m == 0, True).when(m == 1, False))
    return fp(files).select("p_partkey")


@register(
    "extensionless_kind",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source' WHEN doc_id % 3 = 1 THEN 'source' ELSE 'unsupported' END AS kind FROM documents""",
)
def extensionless_kind(t):
    """Texts behind a shebang, behind code lines, and plain."""
    k = F.col("doc_id") % 3
    body = F.regexp_replace("text", "(?m)^", "z ")
    full = F.when(k == 0, F.concat(F.lit("#!/usr/bin/env -S python3\n"), body)).when(
        k == 1, F.concat(F.lit("import os\nfrom a import b\n"), body)
    ).otherwise(F.concat(F.lit("plain\n"), F.regexp_replace(body, "=>|__main__", "")))
    return t.documents.select("doc_id", paths.path_kind(F.concat(F.lit("bin2/tool_"), "doc_id"), full).alias("kind"))


@register("component_of", "SELECT doc_id, component FROM v_files")
def component_of(t):
    # d12.txt sits below src: the component is source:lang.
    return t.v_files.select("doc_id", paths.component_of(F.col("path")).alias("component"))


@register(
    "component_rules",
    "SELECT doc_id, CASE WHEN source = 'src1' THEN concat('one:', lang) WHEN source = 'src2' THEN 'two' ELSE component END AS component FROM v_files",
)
def component_rules(t):
    rules = [("src1/", "one:{2}"), ("src2/", "two")]
    return t.v_files.select("doc_id", paths.component_of(F.col("path"), rules).alias("component"))


@register(
    "layer_role",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'tests' WHEN p_size % 5 = 1 THEN 'interface_adapter' WHEN p_size % 5 = 2 THEN 'orchestration' WHEN p_size % 5 = 3 THEN 'state_storage'
      WHEN p_size % 2 = 0 THEN 'routing_navigation' ELSE 'application_domain' END AS role FROM part""",
)
def layer_role(t):
    k = F.col("p_size") % 5
    component = F.when(k == 0, "x:tests").when(k == 1, "x:Gateway").when(k == 2, "x:workflow").when(k == 3, "x:cache").when(
        F.col("p_size") % 2 == 0, "x:route"
    ).otherwise("x:y")
    return t.part.select("p_partkey", paths.layer_role(component, F.array(F.lit("x/y.py"))).alias("role"))


@register(
    "name_tokens",
    """SELECT p_partkey, concat_ws(',', CASE WHEN split_part(p_name, ' ', 1) NOT IN ('old', 'new') THEN split_part(p_name, ' ', 1) END, split_part(p_name, ' ', 2), lower(split_part(p_brand, '#', 1)), split_part(p_brand, '#', 2)) AS tokens FROM part""",
)
def name_tokens(t):
    symbol = F.concat(F.lit("get_"), F.substring_index("p_name", " ", 1), F.initcap(F.substring_index("p_name", " ", -1)), F.lit("The"), "p_brand")
    return t.part.select("p_partkey", F.array_join(text.name_tokens(symbol), ",").alias("tokens"))


@register("path_tokens", "SELECT doc_id, concat_ws(',', source, 'src', lang, concat('d', doc_id), 'txt') AS tokens FROM v_files")
def path_tokens(t):
    return t.v_files.select("doc_id", F.array_join(text.path_tokens(F.col("path")), ",").alias("tokens"))


@register(
    "goal_tokens",
    f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./-]+'), lambda x: lower(x)),
      lambda x: length(x) >= 3 AND x NOT IN ({STOP})))) AS ws FROM documents)
    SELECT doc_id, CAST(len(ws) AS INT) AS n, sha256(array_to_string(ws, ',')) AS digest FROM w""",
)
def goal_tokens(t):
    words = F.array_sort(text.goal_tokens(F.col("text")))
    return t.documents.select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(words, ","), 256).alias("digest"))


@register(
    "document_tokens",
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(translate(lower(text), '/-.', '   '), '[A-Za-z_][A-Za-z0-9_./-]+')) AS ws FROM documents)
    SELECT doc_id, CAST(len(ws) AS INT) AS n, sha256(array_to_string(list_sort(ws), ',')) AS digest FROM w""",
)
def document_tokens(t):
    words = text.document_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(F.array_sort(words), ","), 256).alias("digest"))


@register(
    "role_tokens",
    """WITH r AS (SELECT event_id, list_sort(list_distinct(list_filter([CASE event_type WHEN 'click' THEN 'parser' WHEN 'view' THEN 'scoring' WHEN 'purchase' THEN 'selection' WHEN 'signup' THEN 'component' ELSE 'wrapper' END,
      CASE user_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'component' ELSE 'zebra' END], lambda x: x NOT IN ('wrapper', 'zebra')))) AS rs, event_type FROM events)
    SELECT event_id, array_to_string(rs, ',') AS roles, coalesce(list_min(list_filter(rs, lambda x: x <> 'component')), 'component') AS main, event_type = 'error' AS adapter FROM r""",
)
def role_tokens(t):
    first = F.expr("CASE event_type WHEN 'click' THEN 'parse' WHEN 'view' THEN 'score' WHEN 'purchase' THEN 'selector' WHEN 'signup' THEN 'component' ELSE 'wrapper' END")
    second = F.expr("CASE user_id % 3 WHEN 0 THEN 'reporting' WHEN 1 THEN 'component' ELSE 'zebra' END")
    tokens = F.array(first, second)
    roles = text.role_tokens(tokens)
    return t.events.select(
        "event_id", F.array_join(F.array_sort(roles), ",").alias("roles"), text.primary_role(roles).alias("main"), text.is_adapter_like(tokens).alias("adapter")
    )


@register(
    "path_matches",
    """SELECT doc_id, source = 'src1' AS under, lang = 'de' AS glob, doc_id % 10 = 7 AS tail, concat('d', doc_id, '.txt') LIKE 'd1%.txt' AS anchored FROM v_files""",
)
def path_matches(t):
    p = F.col("path")
    return t.v_files.select(
        "doc_id",
        paths.path_matches(p, F.lit("src1/")).alias("under"),
        paths.path_matches(p, F.lit("src*/src/de/*")).alias("glob"),
        paths.path_matches(p, F.lit("*7.txt")).alias("tail"),
        paths.path_matches(p, F.lit("d1*.txt")).alias("anchored"),
    )


@register(
    "module_matches",
    """SELECT path, module, module = 's1' OR starts_with(module, 's1.') AS prefix, regexp_matches(module, '^s.*\\.core\\.p.$') AS glob, count(*) AS n FROM v_imports GROUP BY ALL""",
)
def module_matches(t):
    m = F.col("module")
    return t.v_imports.groupBy("path", "module").agg(F.count(F.lit(1)).alias("n")).select(
        "path", "module", paths.module_matches(m, F.lit("s1")).alias("prefix"), paths.module_matches(m, F.lit("s*.core.p?")).alias("glob"), "n"
    )


@register(
    "grades",
    """WITH s AS (SELECT o_orderkey, o_totalprice / 5000.0 AS s, o_orderkey % 5 AS c FROM orders)
    SELECT o_orderkey, CASE WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'E' END AS grade,
      CASE WHEN s >= 75 THEN 'approve' WHEN s >= 60 THEN 'needs_changes' ELSE 'block' END AS verdict,
      CASE WHEN c >= 3 OR s < 40 THEN 'block' WHEN c > 0 OR s < 70 THEN 'needs_changes' ELSE 'approve' END AS component_verdict FROM s""",
)
def grades(t):
    s = F.col("o_totalprice") / 5000.0
    return t.orders.select(
        "o_orderkey",
        scores.grade(s).alias("grade"),
        scores.recommend(s, F.lit(75), F.lit(60)).alias("verdict"),
        scores.component_recommendation(s, F.col("o_orderkey") % 5).alias("component_verdict"),
    )


@register(
    "stable_ids",
    """SELECT o_orderkey, concat('code-review:cleanup:', substr(sha256(concat_ws('|', 'cleanup', o_orderkey, o_orderpriority)), 1, 12)) AS id,
      concat('code-review:hotspot:', substr(sha256(concat('{"evidence":["a=1","b=', o_orderkey, '"],"kind":"hotspot","location":{"line":', o_orderkey % 9, ',"path":"p', o_custkey, '.py","symbol":"","symbol_kind":"module"},"source":"hotspot"}')), 1, 12)) AS review_id FROM orders""",
)
def stable_ids(t):
    k = F.col("o_orderkey")
    place = F.struct(
        F.concat(F.lit("p"), "o_custkey", F.lit(".py")).alias("path"), (k % 9).cast("int").alias("line"), F.lit("").alias("symbol"), F.lit("module").alias("symbol_kind")
    )
    rows = t.orders.withColumn("place", place)
    evidence = F.array(F.concat(F.lit("b="), k), F.lit("a=1"))
    return rows.select(
        "o_orderkey",
        ids.stable_id("cleanup", k, F.col("o_orderpriority")).alias("id"),
        ids.review_concern_id(F.lit("hotspot"), F.lit("hotspot"), F.col("place"), evidence).alias("review_id"),
    )


@register(
    "intent_predicates",
    """SELECT conv_id, turn, regexp_matches(lower(text), 'gateway|proxy|provider|model|api|transport|protocol|session|llm call|网关|模型|接口|协议|会话同步') AS infra,
      regexp_matches(lower(text), 'test|用例|测试') AS tests FROM conversations""",
)
def intent_predicates(t):
    return t.conversations.select("conv_id", "turn", text.wants_infra(F.col("text")).alias("infra"), text.wants_tests(F.col("text")).alias("tests"))


@register(
    "infra_components",
    """SELECT component, component LIKE '%src1:%' OR lang = 'es' OR source = 'src3' AS infra FROM (SELECT DISTINCT component, lang, source FROM v_files)""",
)
def infra_components(t):
    rows = t.v_files.select("component", "lang", "source").distinct()
    name = F.regexp_replace("component", "^src1:", "gateway:")
    role = F.when(F.col("lang") == "es", "interface_adapter").otherwise("application_domain")
    summary = F.when(F.col("source") == "src3", "the transport layer").otherwise("core")
    return rows.select("component", text.is_infra(name, role, summary).alias("infra"))


@register(
    "expiry",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts < TIMESTAMP '2024-01-15' WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) < TIMESTAMP '2024-01-15' WHEN 2 THEN date_trunc('second', ts) < TIMESTAMP '2024-01-15' ELSE false END AS expired FROM events""",
)
def expiry(t):
    ts = F.col("ts")
    k = F.col("event_id") % 4
    shown = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("soon")
    )
    return t.events.select("event_id", scores.is_expired(shown, F.expr("TIMESTAMP '2024-01-15'")).alias("expired"))


@register("evidence_lookup", "SELECT concern_id, kind AS source, CASE kind WHEN 'cleanup' THEN event_type ELSE '' END AS category FROM v_conc")
def evidence_lookup(t):
    from .ranking import with_evidence

    e = F.col("evidence")
    return with_evidence(t).select("concern_id", ids.evidence_value(e, "source").alias("source"), ids.evidence_value(e, "cleanup.category").alias("category"))


@register(
    "variant_family_keys",
    """SELECT conv_id, turn, concat(role, ' step') AS labelled, concat('load ', role) AS glued, CASE turn % 2 WHEN 0 THEN 'parser run' ELSE 'parser version segment' END AS member, '' AS none FROM conversations""",
)
def variant_family_keys(t):
    turn = F.col("turn")
    key = text.variant_family_key
    member = F.when(turn % 2 == 0, F.concat(F.lit("UpperParser.run"), F.lit(""))).otherwise("BaseParser.minor")
    return t.conversations.select(
        "conv_id",
        "turn",
        key(F.concat("role", F.lit("_step_"), turn)).alias("labelled"),
        key(F.concat(F.lit("load_"), "role", turn)).alias("glued"),
        key(member).alias("member"),
        key(F.col("role")).alias("none"),
    )


@register(
    "symbol_ranks",
    """WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN concat('test_', p_partkey) WHEN 1 THEN 'run' WHEN 2 THEN concat('Part.', replace(p_name, ' ', '_')) WHEN 3 THEN 'Part.load' WHEN 4 THEN replace(p_name, ' ', '_') ELSE '_ab' END AS s, p_size % 6 AS k FROM part)
    SELECT p_partkey, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 5 THEN 0 WHEN 2 THEN 8 + CASE WHEN length(s) >= 12 THEN 1 ELSE 0 END WHEN 3 THEN 6 ELSE 2 + CASE WHEN length(s) >= 12 THEN 1 ELSE 0 END END AS INT) AS rank FROM s""",
)
def symbol_ranks(t):
    k = F.col("p_size") % 6
    word = F.regexp_replace("p_name", " ", "_")
    name = (
        F.when(k == 0, F.concat(F.lit("test_"), "p_partkey")).when(k == 1, "run").when(k == 2, F.concat(F.lit("Part."), word))
        .when(k == 3, "Part.load").when(k == 4, word).otherwise("_ab")
    )
    return t.part.select("p_partkey", text.symbol_rank(name).alias("rank"))


@register(
    "sparse_cosine",
    f"""WITH f AS (SELECT doc_id, length(w) AS l, CAST(count(*) AS DOUBLE) AS v FROM (SELECT doc_id, unnest(tok) AS w FROM v_tok) GROUP BY ALL),
    b AS (SELECT l, CAST(l AS DOUBLE) AS v FROM range(1, 11) r(l)), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM f GROUP BY doc_id), bn AS (SELECT sqrt(sum(v * v)) AS n FROM b),
    d AS (SELECT doc_id, sum(f.v * b.v) AS d FROM f JOIN b USING (l) GROUP BY doc_id)
    SELECT t.doc_id, coalesce({rounded('d / (n.n * bn.n)', 6)}, 0) AS cosine FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN d USING (doc_id), bn""",
)
def sparse_cosine(t):
    from .similarity import tokens, with_length_features

    base = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("double")))
    rows = with_length_features(tokens(t)).withColumnRenamed("features", "f")
    return rows.select("doc_id", F.round(F.round(similarity.cosine(F.col("f"), base), 12), 6).alias("cosine"))


@register(
    "set_similarities",
    f"""WITH a AS (SELECT doc_id, tok, list_distinct(regexp_extract_all('the of and to in die der und el la le que', '[a-z]+')) AS b FROM v_tok)
    SELECT doc_id, {rounded('CAST(len(list_intersect(tok, b)) AS DOUBLE) / (len(tok) + len(b) - len(list_intersect(tok, b)))', 6)} AS jaccard,
      {rounded('0.6 * (1.0 - abs(len(tok) % 7 - 3) / CAST(greatest(len(tok) % 7, 3, 1) AS DOUBLE)) + 0.4 * 0.5', 6)} AS signature FROM a""",
)
def set_similarities(t):
    from .similarity import tokens

    base = F.split(F.lit("the of and to in die der und el la le que"), " ")
    rows = tokens(t)
    n = F.size("tok") % 7
    return rows.select(
        "doc_id",
        F.round(F.round(similarity.jaccard(F.col("tok"), base), 12), 6).alias("jaccard"),
        F.round(F.round(similarity.signature_similarity(n, F.lit(3), F.lit(0.5)), 12), 6).alias("signature"),
    )


@register(
    "confidences",
    f"""WITH x AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0 AS n, (o_orderkey % 89) / 88.0 AS s, (o_custkey % 53) / 52.0 AS a FROM orders)
    SELECT o_orderkey, {rounded('least(0.97, 0.78 + greatest(a - 0.82, 0) * 0.45 + greatest(s - 0.6, 0) * 0.2 + greatest(n - 0.45, 0) * 0.2)', 2)} AS fn,
      {rounded('least(0.97, 0.78 + greatest(a - 0.82, 0) * 0.4 + greatest(s - 0.6, 0) * 0.25 + greatest(n - 0.45, 0) * 0.2)', 2)} AS cls,
      least(95, 55 + 12 * (o_orderkey % 3) + 18 * (o_custkey % 3)) / CAST(100 AS DOUBLE) AS cleanup FROM x JOIN orders USING (o_orderkey)""",
)
def confidences(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n, s, a = (k % 101) / 100.0, (k % 89) / 88.0, (c % 53) / 52.0
    return t.orders.select(
        "o_orderkey",
        similarity.function_confidence(n, s, a).alias("fn"),
        similarity.class_confidence(n, s, a).alias("cls"),
        similarity.cleanup_confidence(k % 3, c % 3).alias("cleanup"),
    )


@register(
    "active_changelogs",
    """SELECT doc_id, doc_id % 4 < 2 AND doc_id % 3 <> 2 AS active FROM documents""",
)
def active_changelogs(t):
    k = F.col("doc_id")
    body = F.regexp_replace("text", "#", "")
    heading = F.when(k % 3 == 0, "## [Unreleased]\n").when(k % 3 == 1, "# Notes 2024-05-06\n").otherwise("plain\n")
    path = F.when(k % 4 == 0, "docs/CHANGELOG.md").when(k % 4 == 1, "release_notes/a.txt").otherwise("docs/guide.md")
    return t.documents.select("doc_id", text.is_active_changelog(path, F.concat(body, F.lit("\n"), heading)).alias("active"))
