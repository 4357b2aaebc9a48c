"""The literal check before the patterns rules out paths that cannot match, and no path that does."""

from pyspark.sql import functions as F

from codevigil.functions import paths as P
from codevigil.operators import matching as M


def test_literals_rule_out_only_what_no_pattern_matches(spark):
    paths = ["src/hot_bolt.py", "src/cold/bolt.py", "a.b/x+y.py", "a*b", "axb", "lib/h1t.py", "src/hot", "./x", "src/hot/deep/file.txt"]
    patterns = ["*/hot*.py", "src/*", "**/bolt.py", "a*b", "a.b/?+y.py", "lib/h[0-9]t.py", "[!a]*", "src/hot", "*", "?xb", "hot/*/file.txt"]
    rows = spark.createDataFrame([(p, q) for p in paths for q in patterns], "path string, pattern string")
    path, pattern = F.col("path"), F.col("pattern")
    rows = rows.select("path", "pattern", M.holds_literals(path, pattern).alias("may"), (P.path_matches(path, pattern) | P.plan_path_matches(path, pattern)).alias("does")).collect()
    assert sum(r.does for r in rows) > 15 and all(r.may for r in rows if r.does)
    assert not any(r.may for r in rows if r.pattern == "*/hot*.py" and "/hot" not in r.path)
