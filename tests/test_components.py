"""Descriptors of components beyond the old caps: 200 hot files of a scope, 24 and 8 files, 8 symbols, 24 terms."""

from pyspark.sql import functions as F

from codevigil.functions.text import component_tokens
from codevigil.operators import components as C


def test_descriptors_of_all_rows(spark):
    hot = [("hot", f"hot/f{i:03}.py", "critical", 20) for i in range(210)] + [("cool", "cool/only.py", "info", 1)]
    rows = [(c, p, "m", "complexity", s, "sym", j) for c, p, s, n in hot for j in range(n)]
    schema = "component string, path string, metric string, dimension string, severity string, symbol string, ord int"
    findings = spark.createDataFrame(rows, schema)
    files = findings.select("component", "path").distinct().unionByName(
        spark.createDataFrame([("cool", f"cool/zebra{i:02}word.py") for i in range(30)], "component string, path string")
    )
    names = spark.createDataFrame([("cool", f"Widget.quokka{i:02}") for i in range(30)], "component string, name string")
    edges = spark.createDataFrame([], "src_component string, dst_component string, dst_path string, weight int")
    out = {r.component: r for r in C.descriptors(files, names, findings, edges).collect()}
    assert out["cool"].hotspot_paths == ["cool/only.py"] and len(out["hot"].hotspot_paths) == 6
    assert out["cool"].confidence >= 0.7
    terms = out["cool"].descriptor_terms
    assert {f"zebra{i:02}word" for i in range(30)} | {f"quokka{i:02}" for i in range(30)} <= set(terms) and len(terms) == len(set(terms))
    assert len(out["cool"].files) == 31
    cut = {r.component: r for r in C.descriptors(files, names, findings, edges, hotspot_limit=200, file_limit=24, term_limit=24).collect()}
    assert cut["cool"].hotspot_paths == [] and len(cut["cool"].files) == len(cut["cool"].descriptor_terms) == 24


def test_component_words(spark):
    name = "/".join(f"word{i}" for i in range(12))
    (row,) = spark.createDataFrame([(name,)], "c string").select(component_tokens(F.col("c")).alias("w")).collect()
    assert row.w == name.split("/")
