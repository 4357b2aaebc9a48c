"""A whole incremental review on a small tree."""

import random

from pyspark.sql import functions as F

from codevigil.common import global_rank
from codevigil.functions import paths as P
from codevigil.operators import cleanup, contracts
from codevigil.operators import hotspots as H
from codevigil.operators import review as R
from codevigil.operators import search as Q
from codevigil.operators import topology as topology_of
from codevigil.plans.review import incremental_review
from codevigil.sources import extract as B
from tests.test_extraction import LOOP


def test_incremental_review(spark):
    files = {
        "src/app/a.py": LOOP.format(name="one", n=1),
        "src/app/b.py": "import app.db\n" + LOOP.format(name="two", n=2),
    }
    df = spark.createDataFrame(sorted(files.items()), "path string, text string")
    rules = spark.createDataFrame(
        [("no-db", "src/app/*", ["app.db"], "", "")], "rule_id string, source_glob string, restricted_imports array<string>, owner string, note string"
    )
    changes = spark.createDataFrame([("src/app/b.py",)], "path string")
    risk = spark.createDataFrame(
        [("src/app/b.py", 0.2, 3, 1.0, False, 0, 1)],
        "path string, coverage double, churn int, complexity double, public_api boolean, recurrence int, related_tests int",
    )
    out = incremental_review(B.extract_functions(df), B.extract_symbols(df), B.extract_imports(df), rules, changes, risk)
    shown = out["display"].orderBy("rank").collect()
    assert {r.kind for r in shown} == {"duplication", "architecture-contract"}
    assert all("risk_context.coverage_level=low" in r.evidence for r in shown)
    assert out["signals"].where("metric = 'total'").count() == 2


def test_concerns_of_all_items(spark):
    """More items than the old caps (5, 8, 4, 3, 10 and 20) all become concerns."""
    paths = [f"src/p{i:02}.py" for i in range(30)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    seen = lambda df: sorted({r.path for r in df.collect()})
    inventory = frame([(p, "temp", "file", 0.5, ["x"]) for p in paths], "path string, category string, kind string, confidence double, evidence array<string>")
    assert seen(R.cleanup_concerns(inventory)) == paths and len(seen(R.cleanup_concerns(inventory, 5))) == 5
    archive = inventory.selectExpr("*", "'ready' AS archive_tier", "false AS review_required", "'' AS archive_path_hint")
    assert seen(R.archive_concerns(archive)) == paths
    ranked = frame([(p, i + 1, "m") for i, p in enumerate(paths)], "path string, rank int, dominant_metric string")
    assert seen(R.hotspot_concerns(ranked)) == paths and len(seen(R.hotspot_concerns(ranked, 8))) == 8
    topology = frame([("src", True, 30)], "source_root string, needs_folders boolean, flat_files int")
    plan = frame([(p, "move" if i < 10 else "review", "f", p + "x") for i, p in enumerate(paths[:20])], "path string, action string, folder string, target string")
    names = [f"src/pkg/big_{i:02}.py" for i in range(20)] + [f"src/pkg/g{i}_{x}.py" for i in range(10) for x in "ab"] + ["src/pkg/alone.py"]
    direct = frame([(p,) for p in names], "path string")
    groups, members = topology_of.domain_groups(direct), topology_of.group_members(direct)
    assert groups.count() == 11 and max(len(r.candidate_files) for r in groups.collect()) == 12
    assert seen(R.topology_concerns(topology, plan, groups, members)) == sorted(paths[:20] + names[:-1])
    assert len(seen(R.topology_concerns(topology, plan.limit(0), groups, members, limit=1, group_files=3))) == 3
    long = frame([("src/x.py", "temp", "file", 0.5, list("abcdefg"))], "path string, category string, kind string, confidence double, evidence array<string>")
    assert len(R.cleanup_concerns(long).first().evidence) == 9 and len(R.cleanup_concerns(long, evidence_limit=4).first().evidence) == 6
    changed = frame([(i, f"c{i}", [f"src/core/{i}.py"] + ["legacy/a.py"] * (i > 10)) for i in range(30)], "ord int, component string, changed_files array<string>")
    assert {r.ord for r in cleanup.transient_changes(changed).collect()} == set(range(11, 30))
    one = frame([("src/none.py",)], "path string")
    planned = frame([(p,) for p in paths], "path string")
    rows = contracts.plan_paths(one, planned, planned.selectExpr("path AS test_path").limit(0), planned.limit(0))
    assert set(seen(rows)) >= set(paths)


def test_hotspots_all_ranked(spark):
    """Every hotspot has its rank; 25 asked for are 25; no window without keys."""
    rows = [(f"src/f{i:03}.py", float(i * 7 % 90), i % 4, i % 5, 0) for i in range(60)]
    spots = spark.createDataFrame(rows, "path string, score double, critical long, warning long, info long")
    every = {r.path: r.rank for r in H.rank_hotspots(spots, None).collect()}
    assert sorted(every.values()) == list(range(1, 61))
    first = {r.path: r.rank for r in H.rank_hotspots(spots, 25).collect()}
    assert len(first) == 25 and all(every[p] == n for p, n in first.items())


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(20), i) for i in range(700)]
    df = spark.createDataFrame(rows, "repo string, v int, id int").repartition(7)
    for scope in ([], ["repo"]):
        got = {r.id: r.rank for r in global_rank(df, scope, [F.desc("v"), F.asc("id")]).collect()}
        want = {}
        for key in {r[0] for r in rows} if scope else [None]:
            own = sorted((r for r in rows if not scope or r[0] == key), key=lambda r: (-r[1], r[2]))
            want.update({r[2]: n for n, r in enumerate(own, 1)})
        assert got == {i: n for i, n in want.items() if not scope or rows[i][0] is not None}
    plan = global_rank(df, [], [F.asc("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and "Window [row_number() windowspecdefinition(id" not in plan
    assert global_rank(df.limit(0), ["repo"], [F.asc("id")]).count() == 0


def test_candidates_and_batches_uncut(spark):
    """Weak files that score high do not keep others out; hot files are preferred wherever they stand in a list."""
    rows = [("g", f"a{i:03}.py", "c", 100 - i % 3, ["weak"]) for i in range(60)] + [("g", f"z{i:02}.py", "c", 5, ["path:x"]) for i in range(25)]
    scored = spark.createDataFrame(rows, "goal_id string, path string, component string, score int, evidence array<string>")
    assert Q.cut_candidates(scored).count() == 20 and Q.cut_candidates(scored, pool=40).count() == 0
    targets = spark.createDataFrame([("g", "c", 1)], "goal_id string, component string, rank int")
    listed = [(f"f{i:03}.py", i) for i in range(40)]
    evidence = spark.createDataFrame([("g", "c", p, i) for p, i in listed[:10]], "goal_id string, component string, path string, ord int")
    files = spark.createDataFrame([("c", p, i) for p, i in listed], "component string, path string, ord int")
    hot = spark.createDataFrame([(p, i + 1) for i, p in enumerate([f"x{i}.py" for i in range(30)] + ["f009.py", "f039.py"])], "path string, rank int")
    scores = spark.createDataFrame([("c", "approve", 0, "")], "component string, recommendation string, critical int, layer_role string")
    focus = [r.path for r in Q.change_batches(targets, evidence, files, hot, scores)[1].orderBy("rank").collect()]
    assert focus == ["f009.py", "f000.py", "f001.py", "f002.py", "f003.py", "f004.py"]
    focus = [r.path for r in Q.change_batches(targets, evidence.limit(0), files, hot, scores)[1].orderBy("rank").collect()]
    assert focus[:2] == ["f009.py", "f039.py"] and len(focus) == 6


def test_php_tag_anywhere(spark):
    text = "\n".join(f"line {i}" for i in range(20)) + "\n<?php echo 1;"
    row = spark.createDataFrame([(text,)], "t string").select(P.code_likeness(F.col("t")), P.code_likeness(F.col("t"), php_lines=8)).first()
    assert row[0] and not row[1]


def test_advice_by_counterpart_rule_and_compatibility(spark):
    """Class and function, known and unknown counterpart, the rule's note, compatibility words, no evidence."""
    schema = (
        "concern_id string, kind string, path string, location struct<path:string,line:int,symbol:string,symbol_kind:string>, "
        "evidence array<string>, references array<struct<role:string,path:string,line:int,symbol:string,symbol_kind:string>>"
    )
    there = [("existing_implementation", "src/old.py", 4, "Old", "class")]
    place = lambda p, kind: (p, 3, "New", kind)
    rows = [
        ("class", "shadow-implementation", "src/new.py", place("src/new.py", "class"), ["a=b"], there),
        ("compat", "shadow-implementation", "src/legacy/new.py", place("src/legacy/new.py", "function"), ["a=b"], there),
        ("alone", "duplication", "src/new.py", place("src/new.py", "function"), [], None),
        ("named", "duplication", "src/new.py", place("src/new.py", "function"), ["near_duplicate.reference=src/x.py:1"], None),
        ("rule", "architecture-contract", "src/a.py", place("src/a.py", "module"), ["architecture_contract.rule_id=r1", "architecture_contract.import=app.db", "architecture_contract.note=use the store"], None),
        ("bare", "hotspot", "src/a.py", place("src/a.py", "module"), [], None),
        ("other", "unheard-of", "", place("", "module"), ["a=b"], None),
    ]
    got = {r.concern: r for r in R.fix_advice(spark.createDataFrame(rows, schema)).collect()}
    assert "class src/new.py:3:New next to src/old.py:4:Old" in got["class"].options[0] and len(got["class"].options) == 3 and got["class"].tradeoffs
    assert R.COMPAT_RISK in got["compat"].risks and len(got["compat"].options) == 4 and "function" in got["compat"].options[0]
    assert "Find its counterpart" in got["alone"].options[1] and "src/x.py:1" in got["named"].options[0]
    assert "app.db" in got["rule"].options[0] and "rule r1" in got["rule"].options[0] and got["rule"].options[-1] == "The rule says: use the store"
    assert got["bare"].options == [R.NO_EVIDENCE] and got["bare"].risks == [] and "this concern" in got["other"].options[0]


def test_contract_concerns_carry_rule(spark):
    rules = spark.createDataFrame([("r1", "src/app/*", ["app.db"], "core", "use the store"), ("r2", "src/app/*", ["app.net"], "", None)], "rule_id string, source_glob string, restricted_imports array<string>, owner string, note string")
    imports = spark.createDataFrame([("src/app/a.py", "app.db", 3), ("src/app/a.py", "app.net.x", 4)], "path string, module string, line int")
    changes = spark.createDataFrame([("src/app/a.py",)], "path string")
    got = {r.location.line: r for r in contracts.contract_concerns(contracts.contract_violations(imports, rules, changes)).collect()}
    fact = lambda k, v: f"architecture_contract.{k}={v}"
    assert got[3].evidence == [fact("rule_id", "r1"), fact("import", "app.db"), fact("restricted_import", "app.db"), fact("source_glob", "src/app/*"), fact("owner", "core"), fact("note", "use the store")]
    assert got[3].next_steps_hint == "use the store" and got[4].evidence[-1] == fact("source_glob", "src/app/*") and "may import" in got[4].next_steps_hint


def test_batches_for_goals_without_targets(spark):
    """The asked component, the worst score, then the first hotspots; tests and infrastructure only where asked for."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    goals = frame([("g1", "make it fast"), ("g2", "make it fast"), ("g3", "make it fast"), ("g4", "mend the tests")], "goal_id string, text string")
    targets = frame([("g1", "c", 1)], "goal_id string, component string, rank int")
    scores = frame([("a:tests", 5.0), ("bad", 20.0), ("good", 90.0), ("", 1.0)], "component string, score double")
    roles = frame([("bad", False), ("infra", True)], "component string, infra boolean")
    asked = frame([("g2", "good"), ("g3", "infra"), ("g1", "good"), ("g3", "")], "goal_id string, component string")
    got = {r.goal_id: (r.component, r.source) for r in Q.fallback_targets(targets, goals, scores, roles, asked).collect()}
    assert got == {"g1": ("c", "target"), "g2": ("good", "asked"), "g3": ("bad", "worst_score"), "g4": ("a:tests", "worst_score")}
    none = Q.fallback_targets(targets.limit(0), goals.limit(1), scores.limit(0), roles)
    assert [(r.component, r.source) for r in none.collect()] == [(Q.GLOBAL, Q.GLOBAL)]
    hot = frame([(f"x{i}.py", i + 1) for i in range(9)], "path string, rank int")
    empty = frame([], "goal_id string, component string, path string, ord int")
    facts = frame([], "component string, recommendation string, critical int, layer_role string")
    batches, focus = Q.change_batches(none, empty, empty.drop("goal_id"), hot, facts)
    assert [(r.batch, r.component, r.priority) for r in batches.collect()] == [("B1", Q.GLOBAL, "medium")]
    assert [r.path for r in focus.orderBy("rank").collect()] == [f"x{i}.py" for i in range(6)]
