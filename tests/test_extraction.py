"""Python sources: duplicates, families, wrappers, shadows, contracts, findings, incremental runs, streams."""

import ast
import datetime

import pytest
from pyspark.sql import functions as F

from codevigil.functions import paths as P
from codevigil.functions import text as X
from codevigil.operators import contracts as K
from codevigil.operators import duplicates as D
from codevigil.operators import similarity as S
from codevigil.operators import topology as Y
from codevigil.sources import extract as B
from codevigil.sources import files as Z
from codevigil.streaming import jobs as J
from codevigil.streaming.index import LevelIndex

LOOP = "def {name}(items, limit):\n    total = {n}\n    for item in items:\n        if item > limit:\n            total = total + item * {n}\n    return total\n"
WRAP = "def {name}(first, second, third):\n    value = first + second * third - first\n    other = value * 2 + third * 3\n    return {call}(value, other)\n"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, text string")


def duplicates(spark, files, changed=None):
    scope = spark.createDataFrame([(c,) for c in changed], "path string") if changed else None
    return D.near_duplicates(B.extract_functions(frame(spark, files)), scope).collect()


def test_renamed_loops_are_duplicates(spark):
    files = {"a.py": LOOP.format(name="one", n=1), "b.py": LOOP.format(name="two", n=22)}
    (row,) = duplicates(spark, files)
    assert (row.path, row.references[0].path, row.confidence) == ("b.py", "a.py", 0.9)
    assert duplicates(spark, files)[0].concern_id == row.concern_id
    (scoped,) = duplicates(spark, files, ["./a.py"])
    assert (scoped.path, scoped.references[0].path) == ("a.py", "b.py")


def test_small_and_broken_files_give_nothing(spark):
    files = {"a.py": "def f(x):\n    return x\n", "b.py": "def f(x):\n    return x\n", "c.py": "def broken(:\n"}
    assert duplicates(spark, files) == []


def test_wrappers_of_different_targets_are_discovery(spark):
    files = {"a.py": WRAP.format(name="f", call="left.run"), "b.py": WRAP.format(name="g", call="right.run")}
    functions = B.extract_functions(frame(spark, files))
    assert {r.thin_wrapper_call for r in functions.collect()} == {"left.run", "right.run"}
    assert D.near_duplicates(functions).count() == 0
    (row,) = D.discovery(functions).collect()
    assert (row.reason, row.location.path) == ("thin_wrapper_different_target", "b.py")
    same = {"a.py": WRAP.format(name="f", call="run"), "b.py": WRAP.format(name="g", call="run")}
    assert len(duplicates(spark, same)) == 1


def test_variant_family_is_one_concern(spark):
    text = "\n".join(LOOP.format(name=f"run_phase{i}", n=i) for i in range(1, 4))
    (row,) = duplicates(spark, {"a.py": text})
    assert row.confidence == 0.82 and "near_duplicate.variant_member_total=3" in row.evidence


def test_paired_operators_are_discovery(spark):
    body = "    def {n}(self, other):\n        value = self.a + other.a * 3\n        rest = [x for x in value if x > 2]\n        return type(self)(rest, {n2})\n"
    text = "class Set:\n" + body.format(n="__and__", n2=1) + body.format(n="__or__", n2=2)
    functions = B.extract_functions(frame(spark, {"a.py": text}))
    assert [r.reason for r in D.discovery(functions).collect()] == ["paired_api_variant"]


POLICY = (
    "def {name}(items, limit, flag=None):\n    kept = []\n    for item in items:\n        if item.score > limit and flag:\n            kept.append(item.{field})\n"
    "        elif item.score == {n}:\n            kept.append(item)\n{extra}    return sorted(kept, key=lambda k: k.rank)\n"
)


def test_shadow_functions_across_files(spark):
    files = {
        "one/policy_select.py": POLICY.format(name="select_policy_items", field="a", n=1, extra=""),
        "two/policy_pick.py": POLICY.format(name="select_policy_items_again", field="b", n=2, extra="    kept.reverse()\n"),
        "three/wrapper.py": POLICY.format(name="select_policy_items", field="a", n=1, extra="    kept.pop()\n"),
    }
    symbols = B.extract_symbols(frame(spark, files))
    assert {r.path for r in symbols.collect()} == {"one/policy_select.py", "two/policy_pick.py"}
    (row,) = S.shadow_pairs(symbols).collect()
    assert (row.primary.path, row.existing.path, row.role) == ("two/policy_pick.py", "one/policy_select.py", "policy")
    (concern,) = S.shadow_concerns(S.shadow_pairs(symbols)).collect()
    assert "shadow_implementation.reuse_edge=false" in concern.evidence


@pytest.mark.parametrize(
    "left,right",
    [
        (("render_report", "x"), ("assemble_report_context", "y")),
        (("map_color_theme", "x"), ("map_legacy_rename", "y")),
        (("parse_platform_glibc", "x"), ("parse_local", "y")),
    ],
)
def test_different_subdomains_are_suppressed(spark, left, right):
    rows = [(f"{d}/f.py", name) for name, d in (left, right)]
    df = spark.createDataFrame(rows, "path string, symbol string")
    tokens = F.array_union(X.name_tokens(F.col("symbol")), X.name_tokens(F.col("path")))
    roles = X.role_tokens(tokens)
    raw = F.concat(X.all_name_tokens(F.col("symbol")), X.all_name_tokens(F.col("path")))
    a, b = df.select(X.split_role(tokens), X.mapper_subdomain(roles, raw), X.parser_subdomain(roles, raw)).collect()
    assert any(x and y and x != y for x, y in zip(a, b))


def test_classes_and_modules(spark):
    method = "    def {n}(self, x, *rest):\n        self.{n}_value = x\n        for item in rest:\n            if item and x:\n                x = x + item\n        return [x, rest, {n!r}]\n"
    klass = "class ReportStatus:\n    kind = 1\n    def __init__(self, path):\n        self.path = path\n" + "".join(method.format(n=n) for n in ("load", "keep", "drop"))
    files = {"a/report.py": klass, "b/plain.py": "x = 1\n", "c/bad.py": "def (:\n", "d/helpers.py": klass * 2}
    symbols = {(r.path, r.symbol_kind): r for r in B.extract_symbols(frame(spark, files)).collect()}
    row = symbols[("a/report.py", "class")]
    assert row.member_count == 4 and row.parameter_count == 1 and "vararg" in row.member_tokens and "kind" in row.member_tokens
    modules = {r.path: r for r in B.extract_modules(frame(spark, files)).collect()}
    assert modules["c/bad.py"].reason == "parse_error" and modules["b/plain.py"].reason == "too_small"
    assert modules["d/helpers.py"].reason == "split_module_name"


def test_imports_and_contract(spark):
    files = {
        "src/app/ui/view.py": "from ..core import db, cache as c\nfrom . import parts\nimport app.core.db.pool as pool\n",
        "src/app/ui/__init__.py": "from . import view\n",
        "src/other.py": "import app.core.db\n",
    }
    imports = B.extract_imports(frame(spark, files))
    got = {(r.path, r.module, r.line) for r in imports.collect()}
    assert {m for p, m, _ in got if p.endswith("view.py")} == {
        "app.core", "app.core.db", "app.core.cache", "app.ui", "app.ui.parts", "app.core.db.pool"
    }
    assert ("src/app/ui/__init__.py", "app.ui.view", 1) in got
    rules = spark.createDataFrame(
        [("no-db", "src/app/ui/*", ["app.core.db"], "team", "")], "rule_id string, source_glob string, restricted_imports array<string>, owner string, note string"
    )
    changes = spark.createDataFrame([("./src/app/ui/view.py",), ("src/other.py",)], "path string")
    rows = K.contract_violations(imports, rules, changes).collect()
    assert {(r.path, r.line) for r in rows} == {("src/app/ui/view.py", 1), ("src/app/ui/view.py", 3)}


def test_complexity_and_size(spark):
    body = "".join(f"    if x > {i} and y:\n        y = {i}\n" for i in range(7))
    files = {"a.py": f"def branchy(x, y):\n{body}    return y\n", "b.py": "def (:\n"}
    rows = {(r.path, r.id): r for r in B.code_findings(frame(spark, files)).collect()}
    assert rows[("a.py", "cyclomatic_hard")].value == 15 and ("b.py", "python_parse_error") in rows
    tries = "def f():\n    try:\n        a()\n    except E:\n        b()\n    else:\n        c()\n    finally:\n        d()\n"
    import ast

    assert B.branches(ast.parse(tries).body[0]) == 1 + 1 + 1 + 1 + 1
    text = "x\n" * 460 + "y" * 120 + "\n"
    found = {r.metric: r for r in Z.size_findings(frame(spark, {"big.py": text})).collect()}
    assert found["module_lines"].value == 461 and found["line_length_hard_hits"].sample_lines == [461]


def test_reexport_wrapper(spark):
    files = {
        "a.py": "from ._compat_reexport import reexport\nreexport(__name__)\n",
        "b.py": "from ._compat_reexport import reexport\nreexport(__name__)\nx = 1\n",
        "c.py": "import os\n",
    }
    assert [r.path for r in B.extract_modules(frame(spark, files)).where("reexport").collect()] == ["a.py"]


def test_incremental_extraction(spark):
    schema = "path string, text string, bytes long, mtime long"
    files = [("a.py", LOOP.format(name="a", n=1), 1, 1), ("b.py", "x = 1\n", 1, 1), ("c.py", LOOP.format(name="c", n=1), 1, 1)]
    first = spark.createDataFrame(files, schema)
    rows, manifest, totals = B.incremental_extract(first, B.extract_functions, None, None, 1)
    assert totals.first()["miss_total"] == 3
    second = spark.createDataFrame([files[0], files[1], ("d.py", LOOP.format(name="d", n=1), 1, 1)], schema)
    now, _, totals = B.incremental_extract(second, B.extract_functions, rows, manifest, 1)
    t = totals.first()
    assert (t.file_total, t.hit_total, t.miss_total) == (3, 2, 1)
    assert {r.path for r in now.collect()} == {"a.py", "d.py"}
    assert B.incremental_extract(second, B.extract_functions, rows, manifest, 2)[2].first()["hit_total"] == 0


def test_symbols_and_families(spark):
    names = ["load_v1", "load_v2b", "step_3a_run", "UpperCase.convert", "Version.minor", "plain", "a1", "abc12_x", "phase1"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    keys = {r.s: r.k for r in df.select("s", X.variant_family_key(F.col("s")).alias("k")).collect()}
    assert keys == {
        "load_v1": "load v", "load_v2b": "load v", "step_3a_run": "step run", "UpperCase.convert": "case convert",
        "Version.minor": "version version segment", "plain": "", "a1": "", "abc12_x": "abc x", "phase1": "",
    }


def test_path_kinds(spark):
    want = {
        "": "unknown", ".git/x.py": "hidden", "a/build/x.py": "excluded", "a.egg-info/x": "excluded", "docs/x.py": "doc", "README": "doc",
        "a/mocks/x.py": "fixture", "helm/x.py": "infra", "x.tf": "infra", "x_pb2.py": "generated", "a/tests/x.py": "test", "my_specs/x.py": "test",
        "x_test.go": "test", "x.json": "unsupported", "a/x.py": "source", "Makefile": "source", "tool": "unsupported", "a.min.js": "generated",
    }
    df = spark.createDataFrame([(p,) for p in want], "p string")
    got = {r.p: (r.k, r.n) for r in df.select("p", P.path_kind(F.col("p")).alias("k"), P.is_noise_path(F.col("p")).alias("n")).collect()}
    assert {p: k for p, (k, _) in got.items()} == want
    noise = {"hidden", "excluded", "doc", "fixture", "infra", "generated", "test"}
    assert all(n == (k in noise) for k, n in got.values())


def test_stream_registry_equals_batch(spark, tmp_path):
    rows = [("c", f"2024-{m:02d}-01", float(m * (3 if m % 2 else 1))) for m in range(1, 13)]
    schema = "component string, run string, score double"
    for i in range(3):
        spark.createDataFrame(rows[i * 4 : i * 4 + 4], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        J.stream_registry(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    r = J.latest_rows(spark, f"{tmp_path}/out", ["component"]).first()
    assert (r.last_score, r.trend) == (12.0, "down") and r.history.count("2024") == 12


def test_stream_extract_skips_known_files(spark, tmp_path):
    schema = "path string, text string, bytes long, mtime long"
    drops = [[("a.py", LOOP.format(name="a", n=1), 1, 1)], [("a.py", LOOP.format(name="a", n=1), 1, 1), ("b.py", LOOP.format(name="b", n=1), 1, 1)],
             [("a.py", LOOP.format(name="renamed", n=1), 2, 2)]]
    for drop in drops:
        spark.createDataFrame(drop, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        J.stream_extract(stream, B.extract_functions, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.path, r.symbol) for r in J.current_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {("a.py", "renamed"), ("b.py", "b")}
    assert LevelIndex.stored(spark, f"{tmp_path}/out/manifest").rows().count() == 3


def in_turn(spark, tmp_path, schema, batches, start):
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
        start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).awaitTermination()


def test_streams_keep_repos_apart(spark, tmp_path):
    schema = "repo string, component string, run string, score double"
    scores = [[("a", "x", "2024-01-01", 50.0), ("b", "x", "2024-01-01", 90.0)], [("a", "x", "2024-01-02", 40.0)]]
    in_turn(spark, tmp_path / "s", schema, scores, lambda s: J.stream_registry(s, f"{tmp_path}/s/out", f"{tmp_path}/s/cp"))
    got = J.latest_rows(spark, f"{tmp_path}/s/out", ["repo", "component"]).collect()
    assert {(r.repo, r.last_score, r.trend) for r in got} == {("a", 40.0, "down"), ("b", 90.0, "flat")}

    schema = "repo string, path string, line int, symbol string, fingerprint string, node_count int, thin_wrapper_call string"
    batches = [
        [("a", "m.py", 1, "one", "f", 9, ""), ("b", "n.py", 1, "two", "f", 9, ""), ("a", "w.py", 1, "wrap", "w", 9, "left")],
        [("a", "o.py", 1, "three", "f", 9, ""), ("a", "v.py", 1, "wrap2", "w", 9, "right")],
        [("a", "m.py", 1, "one", "other", 9, "")],  # m.py comes again without its old function
        [("a", "p.py", 1, "four", "f", 9, "")],
    ]
    in_turn(spark, tmp_path / "d", schema, batches, lambda s: J.stream_duplicates(s, f"{tmp_path}/d/out", f"{tmp_path}/d/cp"))
    found = spark.read.parquet(f"{tmp_path}/d/out/concerns").selectExpr("repo", "path", "references[0].path as other").collect()
    assert {(r.repo, r.path, r.other) for r in found} == {("a", "o.py", "m.py"), ("a", "p.py", "o.py")}


def test_stream_ledger_keeps_late_rows(spark, tmp_path):
    schema = "event_id string, generated_at timestamp, mode string"

    def at(day):
        return datetime.datetime(2024, 1, day)

    batches = [[("a", at(10), "m"), ("b", at(11), "m"), ("a", at(10), "m")], [("c", at(2), "m"), ("b", at(11), "m"), ("d", at(12), "m"), (None, at(3), "m")]]
    in_turn(spark, tmp_path, schema, batches, lambda s: J.stream_ledger(s, f"{tmp_path}/out", f"{tmp_path}/cp", id_col="event_id"))
    got = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(x or "" for x in got) == ["", "a", "b", "c", "d"]


def test_all_files_of_a_group_move(spark):
    paths = [(f"src/pkg/alpha_{chr(97 + i)}.py",) for i in range(15)] + [("src/pkg/__init__.py",)]
    direct = spark.createDataFrame(paths, "path string")
    groups = Y.domain_groups(direct)
    imports = spark.createDataFrame([("src/pkg/alpha_a.py", 1)], "path string, n long")
    plan = Y.move_plan(Y.placement(direct, imports), groups)
    assert {r.action: r["count"] for r in plan.groupBy("action").count().collect()} == {"move": 15, "retain": 1}


def test_reader_takes_newest_months(spark, tmp_path):
    """Only the month folders that hold the wanted events are read; order holds within a month of several files."""
    from codevigil.sources import events as V

    rows = [(f"2024-{m:02}-{d:02} 10:00:00", f"m{m}-{d}") for m in range(1, 7) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "at string, mode string").select(F.to_timestamp("at").alias("generated_at"), "mode")
    line = F.to_json(F.struct("generated_at", "mode"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    V.append_event_lines(df.repartition(5), line, f"{tmp_path}/lines")
    recent = V.read_review_events(spark, f"{tmp_path}/lines", 13)
    assert sorted(r.mode for r in recent.collect()) == sorted([f"m6-{d}" for d in range(1, 11)] + ["m5-8", "m5-9", "m5-10"])
    assert {p.split("yyyymm=")[1][:6] for p in recent.inputFiles()} == {"202405", "202406"}
    assert V.read_review_events(spark, f"{tmp_path}/lines", 0).count() == 60 and V.read_review_events(spark, f"{tmp_path}/lines", 500).count() == 60
    last = V.read_review_events(spark, f"{tmp_path}/lines", 1).collect()
    assert [r.mode for r in last] == ["m6-10"]


def test_walk_and_dump_equal_the_library():
    """The short walk and dump give what ``ast.walk`` and ``ast.dump`` give, here on the code of the library itself."""
    text = "\n".join(open(m.__file__).read() for m in (ast, B)).replace("from __future__ import annotations", "")
    tree = ast.parse(text + "\nmatch x:\n    case None | {**k}:\n        f = lambda a, *b, c, d=1: {**a, 1: 2, 's': b'b'}\n")
    assert B.walk(tree) == list(ast.walk(tree))
    assert B.dumped(tree) == ast.dump(tree)
