"""Fixed numbers: scores, thresholds, trend, bundle, readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codevigil.operators import components as C
from codevigil.operators import hotspots as H
from codevigil.operators import ledger as L
from codevigil.operators import ranking as W
from codevigil.operators import scoring as S
from codevigil.sources import events as V
from codevigil.sources import inputs as N

COUNTS = "critical long, warning long, info long, baseline_overall double"


def full(spark, row, policy=None):
    return S.full_score(spark.createDataFrame([row], COUNTS), policy).first()


def test_full_score_fixed_base(spark):
    r = full(spark, (20, 40, 10, None))
    assert (r.score, r.recommendation, r.grade) == (91.3, "approve", "A")


def test_full_score_from_baseline(spark):
    assert full(spark, (20, 40, 10, 8.0), {"full.base.from_baseline": 1.0}).score == 71.3


def test_full_score_thresholds_and_block(spark):
    r = full(spark, (500, 500, 500, None))
    assert r.recommendation == "block"
    assert full(spark, (5, 20, 25, None)).score == 100.0
    relaxed = full(spark, (22, 20, 25, None))
    assert (round(relaxed.pass_min, 3), round(relaxed.warn_min, 3)) == (72.025, 57.875)


COMPONENT = "component string, score double, churn long, critical long, recommendation string, changed_files long, trend string"


def test_incremental_score(spark):
    rows = [("a", 90.0, 9, 0, "approve", 2, "up"), ("b", 50.0, 200, 1, "needs_changes", 1, "flat")]
    r = S.incremental_score(spark.createDataFrame(rows, COMPONENT)).first()
    raw = (90 * 10 + 50 * 24) / 34
    assert r.score == round(raw - 2 + 1.5, 2)
    assert (r.blocked_components, r.weak_components, r.critical_total) == (0, 1, 1)


def test_no_change_scores_full(spark):
    r = S.incremental_score(spark.createDataFrame([], COMPONENT)).first()
    assert (r.mode, r.score, r.recommendation) == ("no_change", 100.0, "approve")


def test_overall_low_scope_and_policy_table(spark):
    parts = spark.createDataFrame([("a", 40.0, 5, 0, "needs_changes", 1, "flat")], COMPONENT)
    whole = S.full_score(spark.createDataFrame([(5, 20, 25, None)], COUNTS))
    r = S.overall_score(whole, S.incremental_score(parts)).first()
    assert r.low_scope and r.score == round(100 * 0.88 + 40 * 0.12, 2)
    rows = spark.createDataFrame(
        [("r1", "full.pass_min", 10.0, 0), ("r1", "full.pass_min", 20.0, 1), ("r2", "x", 1.0, 0), ("r2", "full.warn_min", 5.0, 0)],
        "repo string, key string, value double, layer int",
    )
    got = {r.repo: r for r in N.resolve_policy(rows).collect()}
    assert got["r1"]["full.pass_min"] == 20.0 and got["r2"]["full.pass_min"] == 75.0 and got["r2"]["full.warn_min"] == 5.0


def test_weakening_paths(spark):
    rows = [(1, "src/a.py", "hotspot"), (2, "src/b.py", "cleanup"), (3, "src/a.py", "boundary"), (3, "", "x")]
    got = L.weakening_paths(spark.createDataFrame(rows, "ord long, path string, kind string")).collect()
    assert [(r.path, r.event_mentions, r.kinds) for r in got] == [("src/a.py", 2, ["boundary", "hotspot"]), ("src/b.py", 1, ["cleanup"])]


def test_ranking_equals_two_passes(spark):
    """The one total order against the two passes per level, on many random level mixes."""
    import random

    rng = random.Random(7)
    levels, kinds = ["high-concern", "caution", "info"], ["a", "b", "c"]
    weight = {"high-concern": 3, "caution": 2, "info": 1}
    rows, want = [], {}
    for repo in range(40):
        items = [
            (f"r{repo}", f"c{i}", rng.choice(kinds), rng.choice(levels), rng.randint(0, 4) / 4, rng.choice(["", "p", "q"]))
            for i in range(rng.randint(0, 12))
        ]
        rows += items
        order = sorted(items, key=lambda x: (-weight[x[3]], -x[4], x[5] == "", x[5], x[1]))
        picked = []
        for level in levels:
            group, seen, first = [x for x in order if x[3] == level], {}, []
            for x in group:
                if seen.get(x[2], 0) < 2:
                    seen[x[2]] = seen.get(x[2], 0) + 1
                    first.append(x)
            picked += first + [x for x in group if x not in first]
        want[f"r{repo}"] = [x[1] for x in picked[:5]]
    df = spark.createDataFrame(rows, "repo string, concern_id string, kind string, level string, confidence double, path string")
    got = {}
    for r in W.rank_concerns(df).orderBy("repo", "rank").collect():
        got.setdefault(r.repo, []).append(r.concern_id)
    assert got == {k: v for k, v in want.items() if v}


def test_tiers_default_row(spark):
    rows = [(f"p{i:02d}", 100.0 - i, 1 if i < 10 else 0, 0) for i in range(12)]
    got = H.tiers(spark.createDataFrame(rows, "path string, score double, critical long, warning long")).collect()
    tiers = {r.path: r.tier for r in got}
    assert sum(t == "P0" for t in tiers.values()) == 8 and tiers["p08"] == "P1" and tiers["governance"] == "P2"


def test_gate_statuses(spark):
    base = "overall double, structure double, full double, candidate_total long, review_required_total long"
    cats = "category string, n long"

    def status(now, old, now_c, old_c):
        frames = [spark.createDataFrame([x], base) for x in (now, old)]
        counts = [spark.createDataFrame(x, cats) for x in (now_c, old_c)]
        return L.gate_status(L.gate_checks(*frames, *counts)).first()

    same = (80.0, None, 80.0, 3, 1)
    assert status(same, same, [("stale_doc", 1)], [("stale_doc", 1)]).status == "pass"
    assert status(same, same, [("stale_doc", 2)], [("stale_doc", 1)]).status == "warn"
    assert status((79.0, None, 80.0, 3, 1), same, [], []).status == "fail"
    assert status(same, same, [("legacy_impl", 1)], []).status == "fail"
    assert status(same, same, [], []).check_total == 4


def test_snapshot_bundle_graph(spark):
    docs = [
        ("metrics", '{"findings":[{"path":"payments/core.py","severity":"Critical"}]}'),
        ("index", '{"files":{"orders/a.py":{"signatures":[{"name":"place","line":3}]}},"function_dependencies":'
                  '{"payments/core.py:pay":[{"target":"orders/a.py:place","weight":3},{"target":"tmp_x/b.py:f","weight":9}]}}'),
        ("signatures", '{"files":{"payments/core.py":{"signatures":[{"name":"pay","line":1}]},"orders/a.py":{"signatures":[]}}}'),
        ("manifest", '{"files":{"payments/core.py":{"kind":"source","include_in_architecture":true}}}'),
    ]
    s = N.read_snapshot(spark.createDataFrame(docs, "name string, text string"))
    assert {(r.path, r.name) for r in s["signatures"].collect()} == {("payments/core.py", "pay"), ("orders/a.py", "place")}
    assert s["files"].count() == 2
    top = F.substring_index
    edges = s["dependencies"].withColumns({"src_component": top("src_path", "/", 1), "dst_component": top("dst_path", "/", 1)})
    graph = C.component_graph(edges).collect()
    assert [(r.src_component, r.dst_component, r.weight) for r in graph] == [("payments", "orders", 3)]


def test_numstat_lines(spark):
    lines = ["3\t4\tsrc/a.py", "-\t-\timg.bin", "1\t2\tsrc/{a => b}/x.py", "bad line"]
    got = {(r.path, r.added, r.deleted) for r in N.read_numstat(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("src/a.py", 3, 4), ("img.bin", 0, 0), ("b/x.py", 1, 2)}


def test_event_files_skip_broken_lines(spark, tmp_path):
    (tmp_path / "review-events-202401.jsonl").write_text('{"generated_at":"2024-01-02T00:00:00Z","mode":"m1"}\nnot json\n\n')
    (tmp_path / "review-events.jsonl").write_text('{"generated_at":"2024-01-01T00:00:00Z","mode":"m2"}\n{"mode":"m3"}\n[1]\n')
    everything = V.read_review_events(spark, str(tmp_path), limit=0).orderBy("ord").collect()
    assert [r.mode for r in everything] == ["m1", "m2", "m3"]
    last = V.read_review_events(spark, str(tmp_path), limit=2).orderBy("ord").collect()
    assert [r.mode for r in last] == ["m2", "m3"]
    assert everything[0].generated_at == dt.datetime(2024, 1, 2)


@pytest.mark.parametrize("runs,trend", [([50, 52], "up"), ([50, 49.5], "flat"), ([50, 40], "down"), ([7], "flat")])
def test_score_trend(spark, runs, trend):
    df = spark.createDataFrame([("c", i, float(s)) for i, s in enumerate(runs)], "component string, run int, score double")
    r = L.score_trend(df).first()
    assert (r.trend, r.last_score, len(r.history)) == (trend, float(runs[-1]), len(runs))


def test_trend_keeps_twenty_points(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(50)], "component string, run int, score double")
    r = L.score_trend(df).first()
    assert [h.run for h in r.history] == list(range(30, 50)) and r.trend == "flat"
