"""The streams' index in levels, many batches against the batch operators, runs that come late."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codevigil.operators.duplicates import near_duplicates
from codevigil.streaming import jobs as J
from codevigil.streaming.index import LevelIndex, newest

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("mark", T.LongType())])


def filled(spark, root, batches, buckets=16, fan=3):
    index = None
    for number, rows in enumerate(batches):
        index = LevelIndex(spark, root, SCHEMA, ["path"], buckets, fan)
        index.add(spark.createDataFrame(rows, SCHEMA).coalesce(1), number, newest(["path"]))
    return index


def test_index_finds_last_rows(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(f"p{rng.randrange(12)}", 100 * b + i) for i in range(4)] for b in range(11)]
    batches = [list(dict(rows).items()) for rows in batches]
    index = filled(spark, f"{tmp_path}/index", batches)
    want = {}
    for number, rows in enumerate(batches):
        want.update({p: (m, number) for p, m in rows})
    got = {r.path: (r.mark, r.part_no) for r in newest(["path"])(index.rows()).collect()}
    assert got == want
    asked = spark.createDataFrame([("p1",), ("p1",), ("p7",), ("none",), (None,)], "path string")
    found = {r.path: (r.mark, r.part_no) for r in newest(["path"])(index.lookup(asked, 11)).collect()}
    assert found == {p: want[p] for p in ("p1", "p7") if p in want}
    # As batch 5 finds it, were it to run again.
    early = {}
    for number, rows in enumerate(batches[:10]):
        early.update({p: (m, number) for p, m in rows})
    assert {r.path: (r.mark, r.part_no) for r in newest(["path"])(index.rows(10)).collect()} == early


def test_batch_again_changes_nothing(spark, tmp_path):
    batches = [[(f"p{b}", b), ("shared", b)] for b in range(6)]
    index = filled(spark, f"{tmp_path}/index", batches)
    before = sorted(map(tuple, newest(["path"])(index.rows()).collect()))
    index.add(spark.createDataFrame(batches[5], SCHEMA), 5, newest(["path"]))
    assert sorted(map(tuple, newest(["path"])(index.rows()).collect())) == before
    again = LevelIndex.stored(spark, f"{tmp_path}/index")
    assert again.keys == ["path"] and again.buckets == 16 and again.schema == index.schema


def test_lookup_reads_its_buckets_only(spark, tmp_path):
    """Files read by a lookup do not grow with the batches, and parts not in use are removed."""
    counts = {}
    for many in (3, 27):
        index = filled(spark, f"{tmp_path}/{many}", [[(f"p{b}-{i}", b) for i in range(40)] for b in range(many)], buckets=8)
        one = spark.createDataFrame([("p1-7",)], "path string")
        read = index.lookup(one, many)
        assert read.collect()[0].mark == 1
        counts[many] = (len(read.inputFiles()) - len(one.inputFiles()), len(index.rows().inputFiles()), len(index.parts()))
    assert counts[3] == (1, 8, 1) and counts[27] == (1, 8, 1)
    index = filled(spark, f"{tmp_path}/odd", [[(f"p{b}", b)] for b in range(26)], buckets=8)
    assert len(index.parts()) == 6 and len(index._names("parts")) <= 12 and len(index._manifests()) <= 2


FN = "path string, line int, symbol string, fingerprint string, node_count int, thin_wrapper_call string"


def in_batches(spark, folder, schema, batches, start):
    """One file a batch, all taken by one run of the stream."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        start(stream).awaitTermination()


def test_duplicates_equal_batch_operator(spark, tmp_path):
    """After every batch its concerns are those of the batch operator over all current functions, in scope of the batch."""
    rng = random.Random(4)
    batches = [[(f"m{rng.randrange(9)}.py", i, f"load{i}", f"fp{rng.randrange(6)}", 30, "") for i in range(5)] for _ in range(3)]
    in_batches(spark, tmp_path, FN, batches, lambda s: J.stream_duplicates(s, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=4, fan=2))
    current = {}
    for number, rows in enumerate(batches):
        for path in {r[0] for r in rows}:
            current[path] = [r for r in rows if r[0] == path]
        every = [r for own in current.values() for r in own]
        scope = spark.createDataFrame([(p,) for p in {r[0] for r in rows}], "path string")
        want = near_duplicates(spark.createDataFrame(every, FN), scope)
        got = spark.read.schema(want.schema).parquet(f"{tmp_path}/out/concerns/part_id={number}")
        key = lambda d: sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in d.collect())
        assert key(got) == key(want)


def test_extraction_over_many_batches(spark, tmp_path):
    """Files that come again unchanged are not extracted; of changed ones the last version counts."""
    schema = "path string, text string, bytes long, mtime long"
    rng = random.Random(5)
    batches = [[(f"f{rng.randrange(8)}.py", f"x{b % 4}", 2, b % 4) for _ in range(3)] for b in range(5)]
    batches = [list({r[0]: r for r in rows}.values()) for rows in batches]
    words = lambda files: files.select("path", F.col("text").alias("word"))
    in_batches(spark, tmp_path, schema, batches, lambda s: J.stream_extract(s, words, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=4, fan=3))
    want, written = {}, 0
    for rows in batches:
        written += sum(want.get(p) != (t, m) for p, t, _, m in rows)
        want.update({p: (t, m) for p, t, _, m in rows})
    got = {r.path: r.word for r in J.current_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {p: t for p, (t, _) in want.items()}
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == written


def test_registry_takes_late_runs(spark, tmp_path):
    """Runs in any order and in any batch give what all of them in order give."""
    rng = random.Random(6)
    rows = [(c, f"2024-{m:02d}-{d:02d}", float(rng.randrange(40))) for c in "ab" for m in range(1, 13) for d in (3, 17)]
    order = rows[:]
    rng.shuffle(order)
    batches = [order[i::2] for i in range(2)] + [[("a", None, 1.0), ("b", "2024-01-03", None), ("late", "2024-03-01", 50.0)], [("late", "2024-04-01", 90.0)], [("late", "2024-01-01", 10.0)]]
    in_batches(spark, tmp_path, "component string, run string, score double", batches, lambda s: J.stream_registry(s, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = {r.component: r for r in J.latest_rows(spark, f"{tmp_path}/out", ["component"]).collect()}
    assert (got["late"].last_score, got["late"].trend) == (90.0, "up")
    for c in "ab":
        points = sorted((run, score) for x, run, score in rows if x == c)
        step = points[-1][1] - points[-2][1]
        assert got[c].last_score == points[-1][1] and got[c].trend == ("up" if step > 1 else "down" if step < -1 else "flat")
        assert [(run[:10], score) for run, score in json.loads(got[c].history)] == points[-20:]


def test_registry_forgets(spark, tmp_path):
    """With a time to live points go after it; within it they stay."""
    for name, ttl in (("short", 1), ("long", 3_600_000)):
        batches = [[("c", "2024-01-01", 10.0)], [("c", "2024-02-01", 20.0)]]
        in_batches(spark, tmp_path / name, "component string, run string, score double", batches, lambda s: J.stream_registry(s, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/cp", ttl))
        r = J.latest_rows(spark, f"{tmp_path}/{name}/out", ["component"]).first()
        assert (r.last_score, r.trend) == (20.0, "flat" if name == "short" else "up") and len(json.loads(r.history)) == (1 if name == "short" else 2)
