"""Joins that avoid pairing everything, against brute force that does; with hot keys and groups of copies."""

import itertools
import random
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from codevigil.common import spread
from codevigil.operators import matching as M
from codevigil.operators import similarity as S


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("seed,threshold", [(1, 0.45), (2, 0.55), (3, 0.8)])
def test_set_pairs(spark, monkeypatch, seed, threshold):
    monkeypatch.setattr(S, "TILE", 5)  # hot tokens split into many tiles
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    sets = {frozenset(rng.choices(words[: rng.choice([6, 25])], k=rng.randint(0, 9))) for _ in range(120)}
    # A third of the sets are near copies around one hot core.
    core = set(words[:6])
    sets |= {frozenset(core | {f"x{i}"}) for i in range(60)}
    rows = [("k", sorted(s)) for s in sets]
    df = spark.createDataFrame(rows, "block string, tokens array<string>").withColumn("set_id", S.set_id(F.col("tokens")))
    ids = {r.set_id: frozenset(r.tokens) for r in df.collect()}
    got = {frozenset((r.a, r.b)): r.overlap for r in S.set_pairs(df, threshold, ["block"]).collect()}
    want = {}
    for a, b in itertools.combinations_with_replacement(ids, 2):
        if a == b or jaccard(ids[a], ids[b]) >= threshold:
            want[frozenset((a, b))] = 1.0 if a == b else jaccard(ids[a], ids[b])
    assert got == pytest.approx(want)


def shadow_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        base = rng.choice(["alpha", "beta"])
        names = sorted({base, "parser", rng.choice(["x", "y", "z"])})
        feats = {"node:If": float(rng.randint(1, 3)), "node:Name": float(rng.randint(4, 6))}
        rows.append((f"d{rng.randint(0, 19)}/f{i}.py", i, f"load{i}", "function", f"fp{i}", names, ["parser"], ["a"], 2, feats, []))
    # Copies: one body in forty files, several times in some of them.
    for i in range(55):
        rows.append((f"copy/c{i % 40:02d}.py", 900 + i, "load_copy", "function", "same", ["alpha", "parser", "x"], ["parser"], ["a"], 2,
                     {"node:If": 2.0, "node:Name": 5.0}, []))
    # One symbol that calls the copies is no shadow of them.
    rows.append(("caller/z.py", 1, "load_caller", "function", "caller", ["alpha", "parser", "x"], ["parser"], ["a"], 2,
                 {"node:If": 2.0, "node:Name": 5.0}, ["load_copy"]))
    return rows


SYMBOL = (
    "path string, line int, symbol string, symbol_kind string, fingerprint string, name_tokens array<string>, role_tokens array<string>, "
    "signature_tokens array<string>, parameter_count int, features map<string,double>, calls array<string>"
)


def brute_shadow(rows, changed=None):
    out = []
    for l, r in itertools.combinations(sorted(rows, key=lambda x: x[:3]), 2):
        if l[0] == r[0] or l[4] == r[4]:
            continue
        name = jaccard(set(l[5]), set(r[5]))
        dot = sum(l[9][k] * r[9][k] for k in l[9])
        cos = dot / (sum(v * v for v in l[9].values()) ** 0.5 * sum(v * v for v in r[9].values()) ** 0.5)
        if name < 0.45 or cos < 0.82:
            continue

        def reuse(a, b):
            stem = PurePosixPath(b[0]).stem
            return bool(set(a[10]) & {b[2].lower(), stem})

        if reuse(l, r) or reuse(r, l):
            continue
        conf = round(min(0.97, 0.78 + max(cos - 0.82, 0) * 0.45 + 0.4 * 0.2 + max(name - 0.45, 0) * 0.2) + 1e-9, 2)
        first, second = l, r
        if changed is not None:
            lc, rc = l[0] in changed, r[0] in changed
            if not lc and not rc:
                continue
            if lc and not rc:
                first, second = r, l
        out.append((-conf, second[:3], first[:3]))
    return sorted(out)


@pytest.mark.parametrize("scoped", [False, True])
def test_shadow_pairs_with_copies(spark, monkeypatch, scoped):
    monkeypatch.setattr(S, "TILE", 4)
    rows = shadow_rows(5)
    df = spark.createDataFrame(rows, SYMBOL)
    changed = sorted({r[0] for r in rows})[::3] if scoped else None
    scope = spark.createDataFrame([(p,) for p in changed], "path string") if scoped else None
    want = brute_shadow(rows, set(changed) if scoped else None)
    got = S.shadow_pairs(df, scope).orderBy("rank").collect()
    assert [(-r.confidence, tuple(r.primary)[:3], tuple(r.existing)[:3]) for r in got] == want[:20]
    assert S.shadow_totals(df, scope).first().candidate_total == len(want)
    ids = [r.concern_id for r in S.shadow_concerns(S.shadow_pairs(df, scope)).collect()]
    again = [r.concern_id for r in S.shadow_concerns(S.shadow_pairs(df, scope)).collect()]
    assert len(set(ids)) == 20 and sorted(ids) == sorted(again)


def test_module_pairs_with_copies(spark):
    rows = [
        (f"m{i:02d}/{'store' if i % 2 else 'other'}.py", 300, 3, ["report"], ["build", "report", "x" if i % 3 else "y"], ["function:build", "function"],
         {"node:If": 1.0 + i % 3, "node:Name": 4.0}, ["os"])
        for i in range(30)
    ]
    schema = (
        "path string, node_count int, public_symbol_count int, role_tokens array<string>, public_api_tokens array<string>, "
        "symbol_shape_tokens array<string>, features map<string,double>, imports array<string>"
    )
    df = spark.createDataFrame(rows, schema)
    want = []
    for l, r in itertools.combinations(rows, 2):
        api = jaccard(set(l[4]), set(r[4]))
        cos = sum(l[6][k] * r[6][k] for k in l[6]) / (sum(v * v for v in l[6].values()) ** 0.5 * sum(v * v for v in r[6].values()) ** 0.5)
        if api >= 0.55 and cos >= 0.88:
            want.append((-round(cos + 1e-12, 3), l[0], r[0]))
    want.sort()
    got = S.module_pairs(df).orderBy("rank").collect()
    assert [(-r.cosine, r.left, r.right) for r in got] == want[:20]
    assert S.module_totals(df).first().pair_total == len(want)


PATHS = ["src/a.py", "src/core/a.py", "src/core/b.txt", "core/a.py", "docs/x.md", "a.py", "lib/core/deep/a.py", "src/core_x/a.py"]
PATTERNS = ["src", "src/core/", "*.py", "core/*.py", "src/*", "a.py", "core/a.py", "s?c/a.py", "[cd]o*/*", "*", "src/core/a.py", "deep/a.py", "x[.]md"]


@pytest.mark.parametrize("mode", ["any", "plan"])
def test_pattern_pairs(spark, mode):
    def matches(path, pattern):
        bare = pattern.strip("/")
        wild = any(ch in bare for ch in "*?[")
        glob = fnmatchcase(path, bare) or PurePosixPath(path).match(bare)
        literal = path == bare or path.startswith(bare + "/")
        if mode == "plan":
            return glob if wild else literal
        return glob or literal

    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    patterns = spark.createDataFrame([(p, p) for p in PATTERNS], "pattern string, name string")
    got = {(r.path, r.name) for r in M.pattern_pairs(paths, patterns, mode).collect()}
    assert got == {(p, q) for p in PATHS for q in PATTERNS if matches(p, q)}


def test_substring_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    needles = sorted({"".join(rng.choice("abc é") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    hay = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    need = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r.id, r.needle) for r in M.substring_pairs(hay, "text", need, "needle").collect()}
    assert got == {(i, n) for i, x in enumerate(texts) for n in needles if n in x}


def test_substring_pairs_repeats_nulls_and_scopes(spark):
    texts = [("r1", 1, "read src/app.txt"), ("r1", 1, "read src/app.txt"), ("r2", 2, "read src/app.txt"), ("r1", 3, None), ("r1", 4, "")]
    hay = spark.createDataFrame(texts, "repo string, id long, text string")
    need = spark.createDataFrame([("r1", "app.txt", 1), ("r1", "app.txt", 2), ("r1", "", 3), ("r1", None, 4), ("r2", "p", 5)], "repo string, needle string, n int")
    got = sorted((r.repo, r.id, r.needle, r.n) for r in M.substring_pairs(hay, "text", need, "needle", keys=["repo"]).collect())
    assert got == sorted([("r1", 1, "app.txt", 1), ("r1", 1, "app.txt", 2)] * 2 + [("r2", 2, "p", 5)])
    assert M.substring_pairs(hay.limit(0), "text", need, "needle", keys=["repo"]).count() == 0
    assert M.substring_pairs(hay, "text", need.limit(0), "needle", keys=["repo"]).count() == 0


def test_path_needles_spread_over_keys(spark):
    paths = [(f"src/part{i:03d}/report.txt",) for i in range(200)]
    hay = spark.createDataFrame([(i, f"see {p}") for i, (p,) in enumerate(paths)], "id long, text string")
    need = spark.createDataFrame(paths, "needle string")
    best = M.rarest_pieces(M.hay_pieces(hay, "text", []), need, "needle", [])
    assert best.groupBy("_key").count().agg(F.max("count")).first()[0] <= 20
    assert M.substring_pairs(hay, "text", need, "needle").count() == 200


def test_pieces_follow_needles(spark):
    """Of texts that hold next to nothing of the needles next to nothing becomes a row; short and long needles are found all the same."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=800)) for _ in range(40)] + ["xx ÄÖ-needle yy", "Q"]
    hay = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    need = spark.createDataFrame([("ÄÖ-n",), ("Q",), ("ÄÖ-needle",), ("",), (None,)], "needle string")
    offered = M.offered_pieces(need, "needle", [])
    held = M.hay_pieces(hay, "text", [], M.piece_filter(offered))
    # Every text has about 800 runs of each length; of the lengths 2 and 3 no needle piece is.
    assert held.count() <= 2 * offered.select("_key").distinct().count()
    got = {(r.id, r.needle) for r in M.substring_pairs(hay, "text", need, "needle").collect()}
    assert got == {(40, "ÄÖ-n"), (40, "ÄÖ-needle"), (41, "Q")}


def test_few_bytes_are_cut_in_many_tasks(spark, monkeypatch):
    """Paths that come in one task are spread before their pieces are cut, and the pieces are cut once."""
    tasks, plain = [], M.materialise

    def seen(df, name):
        tasks.append(df.rdd.getNumPartitions())
        return plain(df, name)

    monkeypatch.setattr(M, "materialise", seen)
    hay = spark.createDataFrame([(i, f"src/part{i % 7}/report{i}.txt") for i in range(60)], "id long, text string").coalesce(1)
    need = spark.createDataFrame([("part3",), ("t1",), ("zz",), ("report11.txt",)], "needle string")
    got = sorted((r.id, r.needle) for r in M.substring_pairs(spread(hay), "text", need, "needle", store=True).collect())
    assert got == sorted((r.id, r.needle) for r in M.substring_pairs(hay, "text", need, "needle").collect()) and got
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
