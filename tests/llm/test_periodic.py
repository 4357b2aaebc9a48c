"""Runs against a scan of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codevigil.llm import periodic
from codevigil.llm.queries import prepared
from tests.llm.test_operators import DOC, texts


@pytest.fixture(autouse=True)
def shared(spark):
    prepared(spark)


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    letters, out = [str(x) for x in range(rng.randint(1, 4))], []
    for _ in range(rng.randint(0, 8)):
        out += rng.choices(letters, k=rng.randint(1, 5)) * rng.randint(1, 7)
    return out


def test_runs_of():
    rng = random.Random(1)
    for _ in range(1500):
        words = repetitive(rng)
        assert periodic.runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("mixed", [False, True])
def test_windows(mixed):
    """The stretches that are walked hold every run, in texts that lie next to one another."""
    rng = random.Random(2)
    for _ in range(400):
        many = [repetitive(rng) + [str(rng.random()) for _ in range(rng.randint(0, 6 * mixed))] + repetitive(rng) for _ in range(4)]
        hashes = np.array([zlib.crc32(w.encode()) for words in many for w in words], np.uint64)
        first = np.cumsum([0, *map(len, many)])
        got = [[] for _ in many]
        for low, high in periodic.windows(hashes, first):
            t = int(np.searchsorted(first, low, side="right")) - 1
            low, high = low - int(first[t]), high - int(first[t])
            got[t] += [(low + s, n, q) for s, n, q in periodic.runs_of(many[t][low:high])]
        assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [plain_runs(words) for words in many]


def plain(rows):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        runs, gone = plain_runs(words), set()
        for start, length, period in runs:
            gone.update(range(start + period, start + length))
        best = [None] * 4
        if runs:
            s, n, q = runs[0]
            for s2, n2, q2 in runs[1:]:
                if n2 * q > n * q2:
                    s, n, q = s2, n2, q2
            best = [s, n, q, 1000 * n // q]
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_run_digests(spark):
    rng = random.Random(3)
    said = [rng.choice([" ", "\n ", "\t"]).join(repetitive(rng) + repetitive(rng)) for _ in range(400)]
    said += [t and t[:1500] for t in texts(5, 60)] + ["a b " * 9, " x" * 3000, "\x1f " * 7, "A a " * 4, "é é é é é é"]
    rows = [*enumerate(said), (None, "b " * 8), (7, "b " * 8), (7, "b " * 8)]
    df = spark.createDataFrame(rows, DOC).withColumn("start", F.lit("x")).withColumn("runs", F.lit(1)).repartition(5)
    got = [tuple(r) for r in periodic.run_digests(df, periodic.planted_order).collect()]
    want = plain(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] for r in want) > 100
    assert periodic.run_digests(df.limit(0)).count() == 0


def test_outputs(spark):
    rows = [(0, "so it it it it it it goes on and on and on and on and on ."), (1, None), (2, " \n"), (3, "x y z")]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, DOC)).collect()}
    assert [tuple(r) for r in got[0].runs] == [(1, 6, 1), (8, 9, 2)] and tuple(got[0].highest) == (1, 6, 1)
    assert got[0].collapsed == "so it goes on and ." and got[3].collapsed == "x y z"
    assert all(got[i].runs == [] and got[i].highest is None and got[i].collapsed == "" for i in (1, 2))


def test_long_stretch():
    base = [str(i) for i in range(700)]
    words = (base * 40)[:27000]
    assert periodic.runs_of(words) == [(0, 27000, 700)]
