"""Licence scan against a version that tries every place of every template."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codevigil.llm import licenses
from codevigil.llm.licenses import RARE, SHARE, TEMPLATES
from codevigil.llm.queries import prepared
from tests.llm.test_operators import DOC


@pytest.fixture(autouse=True)
def shared(spark):
    prepared(spark)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows):
    said = [words(t) for _, t in rows]
    idf = {w: math.log((len(rows) + 1) / (sum(w in s for s in said) + 0.5)) for t in TEMPLATES for w in t.text.split()}
    out = []
    for (i, _), own in zip(rows, said):
        found = []
        for t in TEMPLATES:
            text, key = t.text.split(), t.key.split()
            order = sorted(set(text), key=lambda w: (-idf[w], w))
            whole = sum(idf[w] for w in order[:RARE])
            look = [w for w in order if w in own][:RARE]
            at = t.text.split().index(key[0]) if text[text.index(key[0]) :][: len(key)] == key else next(j for j in range(len(text)) if text[j : j + len(key)] == key)
            for start in range(-len(text), len(own) + 1):
                hit = [j for j, w in enumerate(text) if 0 <= start + j < len(own) and own[start + j] == w]
                if all(j in hit for j in range(at, at + len(key))):
                    share = sum(round(1e6 * idf[text[j]] / text.count(text[j]) / whole) for j in hit if text[j] in look) / 1e6
                    share = 1.0 if t.base else min(1.0, share)
                    if share >= SHARE:
                        found.append((t.label, t.base, start, share))
        base = [f for f in found if f[1]]
        ends = (min(f[2] for f in base), max(f[2] for f in base)) if base else (None, None)
        labels = [",".join(sorted({f[0] for f in part})) for part in (base, found)]
        out.append((i, len(own), len(base), *ends, *labels, max((f[3] for f in found), default=0.0), len(found) - len(base)))
    return out


def test_licenses(spark):
    rng = random.Random(7)
    filler = ["the", "of", "é", "x1", "license", "software", "you", "0", "mit", "cc", "by", "gnu", "LICENSE", "ß", "terms"]
    said = []
    for _ in range(250):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += rng.choices(filler, k=rng.randint(0, 8))
            text = rng.choice(TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(filler)
            out += text[rng.choice([0, 0, 2]) :]
        said.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in out))
    said += [None, "", " .,- ", "MIT-License", "aKapache license", "Apache\x00License apache license license", "GNU General Public License " * 50, "word " * 20000]
    rows = [*enumerate(said), (None, "MIT License"), (7, "MIT License"), (7, "MIT License"), (7, "other")]
    df = spark.createDataFrame(rows, DOC).withColumn("words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("label", F.lit(1)).repartition(5)
    got = [tuple(r) for r in licenses.scanned_licenses(df).collect()]
    want = plain(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[6] != r[5] for r in want) and max(r[2] for r in want) == 50
    assert licenses.scanned_licenses(df.limit(0)).count() == 0


def test_only_dataframe_functions(spark):
    """No Python worker on the way."""
    df = spark.createDataFrame([(1, "MIT License")], DOC)
    plan = licenses.scanned_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|MapInArrow|MapInPandas", plan)


def test_places(spark):
    df = spark.createDataFrame([(1, "x This is free and unencumbered software released into the public domain.")], DOC)
    texts = df.select("doc_id", licenses.words_of(F.col("text")).alias("words"))
    postings, rarest = licenses._index(TEMPLATES, licenses.weights(texts, TEMPLATES))
    found = licenses.license_places(licenses._scanned(texts, TEMPLATES, rarest), postings, TEMPLATES).collect()
    assert [(r.label, r.base, r.start, r.share) for r in found] == [("unlicense", False, 1, pytest.approx(1, abs=1e-5))]
