"""The component graph asks what a path is once per distinct path, and keeps its rows."""

from codevigil.operators import components as C

EDGE = "repo string, src_component string, dst_component string, dst_path string, weight int"


def test_graph_judges_paths_outside_the_edges(spark):
    edges = [("r", "a:x", "b:y", f"b\\y\\f{i % 3}.py ", 1 + i % 2) for i in range(12)]
    edges += [("r", "a:x", "b:y", "b/tests/test_f.py", 9), ("r", "a:x", "a:x", "a/f.py", 1), ("r", "a:x", "b:y", None, 4), ("r", "a:x", "tmp_z", "z.py", 2)]
    graph = C.component_graph(spark.createDataFrame(edges, EDGE), path_limit=2)
    # Not even a filter that the optimizer derives may ask the patterns of every edge.
    assert "RLIKE" not in graph._jdf.queryExecution().optimizedPlan().toString().upper()
    (row,) = graph.collect()
    assert (row.src_component, row.dst_component, row.weight, row.target_paths) == ("a:x", "b:y", 18, ["b/y/f0.py", "b/y/f1.py"])
