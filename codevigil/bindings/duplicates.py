"""Near-duplicate groups over document texts and conversation turns."""

from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..session import materialise
from . import register

NORM = "regexp_replace(regexp_replace(lower(text), '[0-9]', '0'), '[ \\t\\r\\n]+', ' ')"


def text_functions(t):
    """Text extractor: one unit per document, fingerprint of the folded whole text."""
    low = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]", "0"), "[ \\t\\r\\n]+", " ")
    rows = t.v_files.select(
        "path",
        F.lit(1).alias("line"),
        F.concat(F.lit("doc_"), "doc_id").alias("symbol"),
        F.substring(F.sha2(low, 256), 1, 16).alias("fingerprint"),
        F.col("bytes").cast("int").alias("node_count"),
    )
    # The extraction table is stored once; the texts are read a single time.
    return materialise(rows, "functions")


_FN = (
    "fn AS (SELECT path, 1 AS line, concat('doc_', doc_id) AS symbol, substr(sha256(regexp_replace(regexp_replace(lower(text), "
    "'[0-9]', '0', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 1, 16) AS fingerprint, doc_id FROM v_files),\n"
    "    gr AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, line, symbol) AS i,\n"
    "      first_value(path) OVER (PARTITION BY fingerprint ORDER BY path, line, symbol) AS p1,\n"
    "      nth_value(path, 2) OVER (PARTITION BY fingerprint ORDER BY path, line, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p2,\n"
    "      count(*) OVER (PARTITION BY fingerprint) AS n FROM fn)"
)


def _flat(df):
    return df.select("concern_id", "path", "confidence", F.col("references")[0]["path"].alias("reference"), F.array_join("evidence", ";").alias("evidence"))


_ID = (
    "concat('code-review:duplication:', substr(sha256(concat_ws('|', 'duplication', {p}, 1, concat('doc_', regexp_extract({p}, 'd([0-9]+).txt$', 1)), "
    "{r}, 1, concat('doc_', regexp_extract({r}, 'd([0-9]+).txt$', 1)), fingerprint)), 1, 12))"
)


@register(
    "near_duplicates",
    f"""WITH {_FN} SELECT {_ID.format(p='path', r='p1')} AS concern_id, path, CAST(0.9 AS DOUBLE) AS confidence, p1 AS reference,
      concat('near_duplicate.fingerprint=', fingerprint, ';near_duplicate.reference=', p1, ':1:doc_', regexp_extract(p1, 'd([0-9]+).txt$', 1),
        ';near_duplicate.node_count=', (SELECT bytes FROM v_files f WHERE f.path = gr.path)) AS evidence
    FROM gr WHERE n > 1 AND i > 1""",
)
def near_duplicates(t):
    return _flat(D.near_duplicates(text_functions(t)))


@register(
    "near_duplicate_totals",
    f"WITH {_FN}, s AS (SELECT fingerprint, count(*) AS n FROM fn GROUP BY fingerprint) SELECT CAST(sum(n - 1) AS BIGINT) AS candidate_total, count(*) FILTER (n > 1) AS group_total FROM s",
)
def near_duplicate_totals(t):
    return D.duplicate_totals(text_functions(t))


@register(
    "near_duplicates_scoped",
    f"""WITH {_FN} SELECT {_ID.format(p='path', r='CASE WHEN i = 1 THEN p2 ELSE p1 END')} AS concern_id, path, CASE WHEN i = 1 THEN p2 ELSE p1 END AS reference
    FROM gr WHERE n > 1 AND doc_id IN (SELECT doc_id FROM labels)""",
)
def near_duplicates_scoped(t):
    """The labelled documents play the change set."""
    changed = t.v_files.select("path", "doc_id").join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return _flat(D.near_duplicates(text_functions(t), changed)).select("concern_id", "path", "reference")


def turn_functions(t):
    """One unit per conversation turn; every turn of a role has one fingerprint, so the groups are huge."""
    c = t.conversations
    turn = F.col("turn")
    call = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("a"), turn % 4)).when(
        F.col("conv_id") % 3 == 1, F.concat(F.lit("b"), turn)
    ).otherwise("")
    return c.select(
        F.concat(F.lit("conv/c"), "conv_id", F.lit(".py")).alias("path"),
        turn.cast("int").alias("line"),
        F.concat("role", F.lit("_step"), turn).alias("symbol"),
        F.substring(F.sha2("role", 256), 1, 16).alias("fingerprint"),
        F.length("text").alias("node_count"),
        call.alias("thin_wrapper_call"),
    )


_TURNS = """fn AS (SELECT concat('conv/c', conv_id, '.py') AS path, CAST(turn AS INT) AS line, concat(role, '_step', turn) AS symbol,
      substr(sha256(role), 1, 16) AS fingerprint, concat(role, ' step') AS family,
      CASE conv_id % 3 WHEN 0 THEN concat('a', turn % 4) WHEN 1 THEN concat('b', turn) ELSE '' END AS call FROM conversations),
    fm AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, path, family ORDER BY line, symbol) AS i,
      count(*) OVER (PARTITION BY fingerprint, path, family) AS members FROM fn),
    fp AS (SELECT a.fingerprint, a.path, a.family, a.members, a.line AS ref_line, b.line AS dup_line,
      row_number() OVER (PARTITION BY a.fingerprint, a.path ORDER BY a.i, b.i) AS o
      FROM fm a JOIN fm b ON a.fingerprint = b.fingerprint AND a.path = b.path AND a.family = b.family AND a.i <> b.i
      WHERE a.members >= 2 AND NOT (a.call <> '' AND b.call <> '' AND a.call <> b.call)),
    fams AS (SELECT DISTINCT f.fingerprint, f.path, f.family, f.members, fp.ref_line, fp.dup_line FROM fm f
      LEFT JOIN fp ON f.fingerprint = fp.fingerprint AND f.path = fp.path AND fp.o = 1 WHERE f.members >= 2)"""


@register(
    "variant_families",
    f"WITH {_TURNS} SELECT fingerprint, path, family, members, coalesce(ref_line, -1) AS ref_line, coalesce(dup_line, -1) AS dup_line FROM fams",
)
def variant_families(t):
    fam = D.variant_families(turn_functions(t))
    return fam.select(
        "fingerprint", "path", "family", "members", F.coalesce("reference.line", F.lit(-1)).alias("ref_line"), F.coalesce("duplicate.line", F.lit(-1)).alias("dup_line")
    )


_PAIRS = f"""{_TURNS},
    hd AS (SELECT fingerprint, first(path ORDER BY path, line, symbol) AS rp, first(line ORDER BY path, line, symbol) AS rl,
      first(call ORDER BY path, line, symbol) AS rc FROM fn GROUP BY fingerprint HAVING count(*) > 1),
    pr AS (SELECT f.fingerprint, f.path, f.line, CASE
        WHEN fams.path IS NOT NULL AND (fams.ref_line IS NOT NULL OR f.path = hd.rp) THEN 'absorbed'
        WHEN f.call <> '' AND rc <> '' AND f.call <> rc THEN 'thin_wrapper_different_target' ELSE 'concern' END AS outcome
      FROM fn f JOIN hd USING (fingerprint) LEFT JOIN fams ON fams.fingerprint = f.fingerprint AND fams.path = f.path
      WHERE NOT (f.path = hd.rp AND f.line = hd.rl))"""


@register("duplicate_outcomes", f"WITH {_PAIRS} SELECT fingerprint, path, line, outcome FROM pr")
def duplicate_outcomes(t):
    return D.duplicate_pairs(turn_functions(t)).select("fingerprint", "dup.path", "dup.line", "outcome")


@register(
    "duplicate_discovery",
    f"""WITH {_PAIRS} SELECT outcome AS reason, count(*) AS n FROM pr WHERE outcome = 'thin_wrapper_different_target' GROUP BY outcome
    UNION ALL SELECT 'variant_family_thin_wrapper_different_target', count(*) FROM fams WHERE ref_line IS NULL""",
)
def duplicate_discovery(t):
    return D.discovery_report(D.discovery(turn_functions(t)))[0]


@register(
    "discovery_first_rows",
    f"""WITH {_PAIRS}, d AS (SELECT fingerprint, path, line, outcome AS reason FROM pr WHERE outcome = 'thin_wrapper_different_target'
      UNION ALL SELECT fingerprint, path, (SELECT min(line) FROM fn WHERE fn.path = fams.path AND fn.fingerprint = fams.fingerprint),
        'variant_family_thin_wrapper_different_target' FROM fams WHERE ref_line IS NULL)
    SELECT path, line, reason FROM d ORDER BY fingerprint, path, line, reason LIMIT 20""",
)
def discovery_first_rows(t):
    return D.discovery_report(D.discovery(turn_functions(t)))[1].select("location.path", "location.line", "reason")


_RISKY = """rk AS (SELECT concat('conv/c', c_custkey, '.py') AS path, c_custkey % 100 < 60 AS low, c_custkey % 20 >= 10 AS churned, c_nationkey >= 15 AS tangled,
      c_mktsegment = 'BUILDING' AS pub, c_custkey % 4 >= 2 AS again, c_custkey % 3 = 0 AS untested FROM customer),
    rf AS (SELECT path, low::INT + churned::INT + tangled::INT + pub::INT + again::INT + untested::INT AS n FROM rk)"""


@register(
    "discovery_promotion",
    f"""WITH {_PAIRS}, {_RISKY}, d AS (SELECT path, line FROM pr WHERE outcome = 'thin_wrapper_different_target'
      UNION ALL SELECT path, (SELECT min(line) FROM fn WHERE fn.path = fams.path AND fn.fingerprint = fams.fingerprint) FROM fams WHERE ref_line IS NULL)
    SELECT path, line, CAST(n + 4 AS INT) AS evidence_total, CAST(0.68 AS DOUBLE) AS confidence FROM d JOIN rf USING (path) WHERE n > 0""",
)
def discovery_promotion(t):
    risk = t.v_risk.withColumn("path", F.regexp_replace("path", "^src/u", "conv/c"))
    rows = D.promote(D.discovery(turn_functions(t)), risk)
    return rows.select("path", "location.line", F.size("evidence").alias("evidence_total"), "confidence")
