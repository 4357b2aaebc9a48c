"""Alignment of two tokenizers against a version that walks over bytes."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codevigil.llm import align
from codevigil.llm.queries import prepared, public_tokenizer
from tests.llm.test_operators import DOC, texts

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(autouse=True)
def shared(spark):
    prepared(spark)


def plain_tokens(text):
    """(id, start, end) of both sides by the libraries; None where one does not spell the text."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel
    from tokenizers.pre_tokenizers import ByteLevel as Cut

    if not hasattr(plain_tokens, "a"):
        plain_tokens.a = Tokenizer.from_file(public_tokenizer(A))
        plain_tokens.a.encode_special_tokens = True
        plain_tokens.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizer(B))
        symbols = {Cut(add_prefix_space=False).pre_tokenize_str(bytes([i]).decode("latin-1"))[0][0]: i for i in range(128)}
        assert ByteLevel() and len(symbols) == 128
    if not text:
        return None
    want = (" " + text).encode()
    one = []
    enc = plain_tokens.a.encode(" " + text, add_special_tokens=False)
    names = [plain_tokens.a.id_to_token(i) for i in enc.ids]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    spelled = [bytes(back[c] for c in n) for n in names]
    at = 0
    for i, x in zip(enc.ids, spelled):
        one.append((i, at, at + len(x)))
        at += len(x)
    two, at, said = [], 0, b""
    for i in plain_tokens.b.encode(text):
        piece = plain_tokens.b.id_to_piece(i)
        x = bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()
        two.append((i, at, at + len(x)))
        at += len(x)
        said += x
    return (one, two) if b"".join(spelled) == want == said else None


def plain(rows):
    found, holders = [], collections.Counter()
    for i, text in rows:
        both = plain_tokens(text)
        if both is None:
            found.append((i, None))
            continue
        one, two = both
        links = [(a, b, x, y) for x, (a, s, e) in enumerate(one) for y, (b, t, f) in enumerate(two) if s < f and t < e]
        cuts = sorted({e for _, _, e in one} & {f for _, _, f in two})
        groups, low = [], 0
        for cut in cuts:
            groups.append(tuple([x for x, s, e in side if low < e <= cut] for side in both))
            low = cut
        holders.update({(a, b) for a, b, _, _ in links})
        found.append((i, (one, two, links, groups)))
    most = collections.Counter()
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        one, two, links, groups = x
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(holders[a, b] == most[a] for a, b, _, _ in links)
        total = sum(holders[a, b] for a, b, _, _ in links)
        shared = sum(len(a) * len(b) for a, b in groups)
        out.append((i, len(one), len(two), len(groups), len(links), best, total, hashlib.sha256(text.encode()).hexdigest(), shared))
    return out


def samples(seed):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "𝒳", "<|endoftext|>", "<s>", "▁", "\x00", "1234", "don't", " ß", "\t", "ﬁ", "Würde", "🙂", "   x", "'s"]
    said = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(300)]
    return said + [(t or None) and t[:3000] for t in texts(seed, 60)] + [None, "", " ", "  ", "a ", "x" * 3000, "🙂é" * 500]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_alignment(spark, monkeypatch, block):
    if block < 100:
        monkeypatch.setattr(align, "SLICE", block)
    rows = [*enumerate(samples(3))]
    rows += [(None, "the same"), (7, "the same"), (7, "the same")]
    df = spark.createDataFrame(rows, DOC).withColumn("chunk", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(5)
    got = [tuple(r) for r in align.alignment_statistics(df, public_tokenizer(A), public_tokenizer(B)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert align.alignment_statistics(df.limit(0), public_tokenizer(A), public_tokenizer(B)).count() == 0


def test_long_text_in_blocks(monkeypatch):
    """Links and pairs within groups do not depend on the size of a block."""
    import pyarrow as pa

    rng = random.Random(4)
    said = pa.array([None, "".join(rng.choices(["word ", "日", "é\n", " ", "<0x41>"], k=4000)), "", "end"])
    whole = align.Aligned(said, *align.models(public_tokenizer(A), public_tokenizer(B)))
    links, pairs = set(zip(*(np.concatenate(x).tolist() for x in zip(*whole.links())))), set(zip(*(np.concatenate(x).tolist() for x in zip(*whole.group_links()))))
    assert whole.rows.tolist() == [1, 3]
    monkeypatch.setattr(align, "SLICE", 37)
    assert set(zip(*(np.concatenate(x).tolist() for x in zip(*whole.links())))) == links
    assert set(zip(*(np.concatenate(x).tolist() for x in zip(*whole.group_links())))) == pairs
    assert {(a, b) for a, b, _ in links} <= pairs
    groups = [whole.groups(s) for s in (0, 1)]
    assert len(pairs) == sum(int((groups[0] == g).sum() * (groups[1] == g).sum()) for g in range(len(whole.cuts)))


def test_products():
    rng = np.random.default_rng(1)
    for _ in range(30):
        dense = [(rng.random((rng.integers(1, 9), 7)) < 0.4).astype(int), (rng.random((7, rng.integers(1, 9))) < 0.4).astype(int)]
        a, b = (align.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1]) for m in dense)
        row, column, value = align.product(a, b)
        want = dense[0] @ dense[1]
        got = np.zeros_like(want)
        got[row, column] = value
        assert (got == want).all() and len(row) == (want > 0).sum()
        flipped = align.transposed(b)
        assert (flipped.columns == np.nonzero(dense[1].T)[1]).all() and flipped.width == 7


def test_outputs(spark):
    rows = [(1, "plain words here"), (2, None), (3, "日本語"), (4, "▁")]
    got = {r.doc_id: r for r in align.token_alignments(spark.createDataFrame(rows, DOC).withColumn("links", F.lit(1)), public_tokenizer(A), public_tokenizer(B)).collect()}
    for i, text in rows:
        both = plain_tokens(text)
        if both is None:
            assert not got[i].a_ids and not got[i].links and got[i].groups == ""
            continue
        one, two = both
        assert got[i].a_ids == [x for x, _, _ in one] and got[i].b_ids == [x for x, _, _ in two]
        want = [(x, y, min(e, f) - max(s, t)) for x, (_, s, e) in enumerate(one) for y, (_, t, f) in enumerate(two) if s < f and t < e]
        assert [tuple(x) for x in got[i].links] == want
        assert hashlib.sha256(got[i].groups.encode()).hexdigest() == plain([(i, text)])[0][7]
