"""Feedback that many rows of which ask the same, and needles that share all their runs of four characters with many texts."""

import random

from pyspark.sql import functions as F

from codevigil.operators import enrich as N
from codevigil.operators import matching as M

FEEDBACK = "ord long, advice_id string, concern_id string, path string, kind string, pattern string, scope string, status string"


def test_long_needles_meet_few_texts(spark):
    paths = [f"src/{i:08b}.py" for i in range(256)]
    hay = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id int, text string")
    need = spark.createDataFrame([(p,) for p in paths], "needle string")

    def likely(long):
        offered = M.offered_pieces(need, "needle", [], long)
        held = M.hay_pieces(hay, "text", [], M.piece_filter(offered))
        return held.join(M.rarest_pieces(held, offered, "needle", []), "_key").select("_hay", "needle").distinct().count()

    assert likely(True) <= 2 * len(paths) < likely(False)


def test_long_pieces_find_the_same(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    needles = {t[i : i + rng.randint(1, 25)] for t in texts for i in (0, 7)} | {"abababababababababababab", ""}
    hay = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    need = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r.id, r.needle) for r in M.substring_pairs(hay, "text", need, "needle", long=True).collect())
    assert got == sorted((i, n) for i, x in enumerate(texts) for n in needles if n and n in x)


def test_repeated_feedback_and_items(spark):
    rows = [(i, "", "", "src/u1.py" if i % 2 else "", "hotspot" if i % 2 else "", "" if i % 2 else "U2.p", "same_path_kind" if i % 2 else "pattern", "rejected") for i in range(9, 2, -1)]
    feedback = spark.createDataFrame([*rows, (1, "", "c3", "", "", "", "exact_advice", "rejected"), (0, "", "c3", "", "", "", "exact_advice", "accepted")], FEEDBACK)
    items = [("", "c1", "hotspot", "src/u1.py"), ("", "c1", "hotspot", "src/u1.py"), ("", "c2", "boundary", "src/u2.py"), ("", "c3", "boundary", "src/u2.py"), ("", "c4", "boundary", "src/u1.py"), ("", None, "hotspot", None)]
    items = spark.createDataFrame(items, "advice_id string, concern_id string, kind string, path string")
    items = items.withColumn("text", F.lower(F.concat_ws(" ", "concern_id", "kind", "path")))
    got = sorted((r.concern_id or "", r.path or "", r.feedback_ord) for r in N.demote(items, feedback).collect())
    assert got == [("", "", None), ("c1", "src/u1.py", 3), ("c1", "src/u1.py", 3), ("c2", "src/u2.py", 4), ("c3", "src/u2.py", 1), ("c4", "src/u1.py", None)]


def test_feedback_rows_are_not_multiplied(spark, monkeypatch):
    seen, plain = [], M.substring_pairs
    monkeypatch.setattr(M, "substring_pairs", lambda hay, col, needles, *a, **k: (seen.append(needles.count()), plain(hay, col, needles, *a, **k))[1])
    feedback = spark.createDataFrame([(i, "", "", "", "", "u2.p", "pattern", "rejected") for i in range(50)], FEEDBACK)
    items = spark.createDataFrame([("", "c1", "hotspot", "src/u2.py", "c1 hotspot src/u2.py")], "advice_id string, concern_id string, kind string, path string, text string")
    assert [r.feedback_ord for r in N.demote(items, feedback).collect()] == [0] and seen == [1]
