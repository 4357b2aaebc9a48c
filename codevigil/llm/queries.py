"""Registered queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, chat, contain, hnsw, licenses, parity_join, periodic, pii, quality, repeats, token_file, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bytes and rows of an Arrow batch: what a Python worker holds at once follows them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prepared(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def query(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@query("op1_token_file")
def _token_file(table):
    docs = table("documents")
    folder = token_file.new_folder(docs.sparkSession)
    token_file.write_token_file(docs, folder, public_tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_file.token_digests(docs.sparkSession, folder)


@query("op2_bpe")
def _bpe(table):
    return bpe.bpe_digests(table("documents"), public_tokenizer("word_bpe_49k.json"))


@query(
    "op3_embedding_links",
    """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) l FROM v
       WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0),
link AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.l > 0 AND b.l > 0
         WHERE list_dot_product(a.e, b.e) >= 0.9 * a.l * b.l),
reach AS (SELECT vec_id node, vec_id top FROM v UNION SELECT l.b, r.top FROM reach r JOIN link l ON l.a = r.node),
top AS (SELECT node, min(top) component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN top ON node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
)
def _embedding_links(table):
    return hnsw.linked_vectors(table("embeddings"), 0.9)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(key: str, table: str, k: int) -> str:
    """SQL for the distinct word shingles (key, s) of a table."""
    return f"""SELECT DISTINCT {key}, s FROM (
      SELECT {key}, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: list_aggregate(w[i:i + {k} - 1], 'string_agg', ' '))
                                WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) s
      FROM (SELECT {key}, {_WORDS} w FROM {table}))"""


@query(
    "op4_contained_items",
    f"""
WITH d AS ({_shingles("doc_id", "documents", 5)}), q AS ({_shingles("item_id", "benchmark", 5)}),
n AS (SELECT item_id, count(*) n_item FROM q GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) n_shared FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
""",
)
def _contained_items(table):
    return contain.contained_items(table("documents"), table("benchmark"))


@query(
    "op5_chat_format",
    """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, role, text, row_number() OVER w AS position,
             list({'turn': turn, 'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
n AS (SELECT conv_id, max(position) AS n_turns FROM p GROUP BY conv_id),
whole AS (SELECT p.conv_id, n_turns, prefix FROM p JOIN n ON p.conv_id = n.conv_id AND position = n_turns),
first AS (SELECT n_turns, prefix, min(conv_id) conv_id FROM whole GROUP BY n_turns, prefix),
shorter AS (SELECT DISTINCT position, prefix FROM p JOIN n ON p.conv_id = n.conv_id AND position < n_turns),
kept AS (SELECT conv_id, n_turns FROM first f WHERE NOT EXISTS (SELECT 1 FROM shorter s WHERE s.position = f.n_turns AND s.prefix = f.prefix))
SELECT conv_id, (position - 1) // 512 AS part, n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY conv_id, part, n_turns
""",
)
def _chat_format(table):
    return chat.formatted_chats(table("conversations"))


@query(
    "op6_jaccard_join",
    f"""
WITH RECURSIVE d AS ({_shingles("doc_id", "documents", 4)}),
n AS (SELECT doc_id, count(*) n_shingles FROM d GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)),
reach AS (SELECT doc_id node, doc_id top FROM documents UNION SELECT l.b, r.top FROM reach r JOIN link l ON l.a = r.node),
top AS (SELECT node, min(top) component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n_shingles, 0)::BIGINT n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN top ON node = doc_id
""",
)
def _jaccard_join(table):
    return parity_join.jaccard_components(table("documents"), 4, 85, 100)


@query("op7_repeats")
def _repeats(table):
    return repeats.without_repeats(table("documents"), 200).drop("kept")


_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in urls.SUFFIXES) + "]"


@query(
    "op8_url_filter",
    rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
t AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM cut),
marked AS (SELECT doc_id page_id, (avg(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1.0 ELSE 0.0 END) >= 0.5)::INT good
           FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
b AS (SELECT host, regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') bare, count(good) n, coalesce(sum(good), 0) good FROM t LEFT JOIN marked USING (page_id) GROUP BY host),
l AS (SELECT *, string_split(bare, '.') ps, regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') addr, list_contains({_SUFFIXES}, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.')) long FROM b),
h AS (SELECT host, CASE WHEN addr THEN 'address' WHEN long THEN array_to_string(list_slice(ps, -2, -1), '.') ELSE ps[-1] END suffix,
             CASE WHEN addr THEN bare WHEN long THEN array_to_string(list_slice(ps, -3, -1), '.') ELSE array_to_string(list_slice(ps, -2, -1), '.') END domain, n, good FROM l),
d AS (SELECT suffix, domain, sum(n) n, sum(good) good FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) n, sum(good) good FROM d GROUP BY 1),
g AS (SELECT sum(n)::DOUBLE pages, (sum(good) + 1.0) / (sum(n) + 2.0) p FROM s),
w AS (SELECT l, CASE WHEN pages > 0 AND between_ > 0 THEN greatest(1.0, least(1000.0, p * (1 - p) / between_ - 1)) ELSE 1000.0 END weight FROM (
  SELECT l, max(p) p, max(pages) pages, sum(n * (good / n - p) * (good / n - p)) / max(pages) - max(p) * (1 - max(p)) * count(*) / max(pages) between_ FROM (
    SELECT 's' l, n::DOUBLE n, good::DOUBLE good FROM s UNION ALL SELECT 'd', n, good FROM d UNION ALL SELECT 'h', n, good FROM h), g WHERE n > 0 GROUP BY l)),
k AS (SELECT coalesce((SELECT weight FROM w WHERE l = 's'), 1000.0) ws, coalesce((SELECT weight FROM w WHERE l = 'd'), 1000.0) wd, coalesce((SELECT weight FROM w WHERE l = 'h'), 1000.0) wh),
ms AS (SELECT suffix, (good + ws * p) / (n + ws) m FROM s, g, k),
md AS (SELECT d.suffix, domain, (good + wd * m) / (n + wd) m FROM d JOIN ms ON ms.suffix = d.suffix, k),
mh AS (SELECT host, good + wh * m a, n - good + wh * (1 - m) b FROM h JOIN md USING (suffix, domain), k),
r AS (SELECT host, a / (a + b) mean, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) upper_ FROM mh),
x AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END "rule" FROM t)
SELECT page_id, host, path, "rule", CASE WHEN "rule" IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN "rule" IS NOT NULL THEN 'block'
       WHEN upper_ < 0.5 THEN 'block' ELSE 'allow' END verdict, round(mean, 6) reputation
FROM x JOIN r USING (host)
""",
)
def _url_filter(table):
    return urls.judged_pages(table("pages"), table("labels"))


@query("op9_quality")
def _quality(table):
    return quality.quality_scores(table("documents"), table("labels"), 0.3)


@query("op10_personal_data")
def _personal_data(table):
    return pii.find_personal_data(table("documents"))


@query("op11_token_alignment")
def _token_alignment(table):
    return align.alignment_statistics(table("documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


@query("op12_periodic_runs")
def _periodic_runs(table):
    return periodic.run_digests(table("documents"), periodic.planted_order)


@query("op13_license_scan", licenses.oracle())
def _license_scan(table):
    return licenses.scanned_licenses(table("documents"))
