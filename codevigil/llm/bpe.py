"""Exact BPE ids by dynamic programming over the prefixes of each pretoken, and decoding.

The BPE encoding of a prefix ends in exactly one token, and a token t can end a longer prefix
just when the encoding of what precedes it ends in a token that BPE would leave apart from t.
An automaton over the vocabulary gives all tokens that end at a position; a pair test finds the
one that fits; back-pointers from the end of the pretoken give its ids. The time is linear in
the length of the pretoken, however long it is.

Pair test: while BPE runs, the parts that touch the border are the right spine of the first
token and the left spine of the second. A pair of parts lasts until either grows; if their own
merge comes first, BPE joins over the border and the pair does not fit. Of equal merges the
left one comes first.

Handles tokenizer files of BPE over byte-level pretokens, with or without a suffix at the end
of words. Texts of Latin letters, ASCII and white space are normalised and cut here; for other
texts the library's own normalizer and pre-tokenizer do that. Null text is empty.
"""

from __future__ import annotations

import array
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_batches

#: Pretokens, and pairs of tokens, that one worker remembers at most.
KNOWN_WORDS, KNOWN_PAIRS = 250_000, 250_000

_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_LETTERS = re.compile("[" + _LATIN + "]+")
# Some capitals in that range have small letters outside it; texts with them go to the library.
_KEPT = "".join(c for c in map(chr, range(0x250)) if _LETTERS.fullmatch(c) and _LETTERS.fullmatch(c.lower()))
_OTHER = re.compile("[^\\t-\\r -~" + _KEPT + "]")
# The pre-tokenizer's pattern, over the characters that are handled here.
_WORD = re.compile("[" + _LATIN + "]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\\[-`{-~]+")
_NEVER = 1 << 60
_MARK = 0x1000


class Bpe:
    """Words to ids, for one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are handled")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.suffix = model.get("end_of_word_suffix") or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            whole = vocabulary[a + b]
            left, right = vocabulary[a], vocabulary[b]
            if whole in self.rank or max(self.rank.get(left, -1), self.rank.get(right, -1)) >= rank:
                raise ValueError("merges must make each token once, from earlier ones")
            self.joined[left, right] = rank
            self.rank[whole] = rank
            self.parts[whole] = (left, right)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            if i not in self.parts or self._made(i):
                spelled = self._marked(token[: -len(self.suffix)]) if self.suffix and token.endswith(self.suffix) else token
                if spelled:
                    self.automaton.add_word(spelled, (i, len(spelled)))
        self.automaton.make_automaton()
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}
        self.plain = self._is_plain(spec)
        self.joins_names = not spec.get("decoder")
        self.known = _Words(self)
        spelled = [self.names.get(i, "").encode() + b" " for i in range(max(self.names, default=0) + 1)]
        self.name_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.name_at = np.cumsum([0, *map(len, spelled)])

    def _is_plain(self, spec: dict) -> bool:
        """Whether ``_WORD`` over lower-cased text is what the file's normalizer and pre-tokenizer do."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": pattern}
            and pre[0]["behavior"] == "Removed"
            and not pre[1]["use_regex"]
            and not pre[1]["add_prefix_space"]
        )

    def _marked(self, spelled: str) -> str:
        return spelled[:-1] + chr(ord(spelled[-1]) + _MARK) if spelled else ""

    def _spine(self, token: int, side: int) -> list[int]:
        """From the smallest part at that edge of the token up to the token."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def _apart(self, first: int, second: int, whole: bool) -> bool:
        """Whether BPE keeps the border between the two; ``whole``: until both are complete."""
        left, right = self._spine(first, 1), self._spine(second, 0)
        i = j = 0
        while True:
            grow_left = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            grow_right = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            if whole and grow_left == grow_right == _NEVER:
                return True
            own = self.joined.get((left[i], right[j]), _NEVER)
            if own < grow_left and own <= grow_right and own != _NEVER:
                return False
            if grow_left == grow_right == _NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _made(self, token: int) -> bool:
        """Whether BPE turns the token's own spelling into the token."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                left, right = self.parts[t]
                if not self._apart(left, right, True):
                    return False
                todo += [left, right]
        return True

    def fits(self, first: int, second: int) -> bool:
        pair = (first, second)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(first, second, False)
        return known

    def ids(self, spelled: str) -> list[int]:
        """Ids of a pretoken in the byte-level alphabet."""
        if self.suffix:
            spelled = self._marked(spelled)
        last, back = [-1] * (len(spelled) + 1), [0] * (len(spelled) + 1)
        for end, (token, size) in self.automaton.iter(spelled):
            stop = end + 1
            if last[stop] < 0:
                start = stop - size
                if start == 0 or (last[start] >= 0 and self.fits(last[start], token)):
                    last[stop], back[stop] = token, start
        out, at = [], len(spelled)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _segment(self, text: str) -> bytes:
        if self.plain and not _OTHER.search(text):
            return b"".join(map(self.known.__getitem__, _WORD.findall(text.lower())))
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        spelled = [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer is not None else [text]
        return b"".join([array.array("I", self.ids(s)).tobytes() for s in spelled if s])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._segment(text)
        parts = self.split_special.split(text)
        return b"".join([array.array("I", [self.special[p]]).tobytes() if p in self.special else self._segment(p) for p in parts if p])

    def decode(self, rows: list[bytes]) -> pa.Array:
        """Texts of rows of ids. Without a decoder in the file, the tokens' names with spaces between."""
        if not self.joins_names:
            return pa.array([self.tokenizer.decode(array.array("I", r).tolist(), skip_special_tokens=False) for r in rows], pa.large_string())
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        begin, end = self.name_at[ids], self.name_at[ids + 1]
        sizes = end - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        content = self.name_bytes[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        # Each name carries a space behind it; the last of a row goes.
        bounds = np.cumsum([0, *[len(r) // 4 for r in rows]])
        ends = total[bounds[1:]]
        full = ends > total[bounds[:-1]]
        keep = np.ones(len(content), bool)
        keep[ends[full] - 1] = False
        offsets = np.concatenate([[0], np.cumsum(ends - total[bounds[:-1]] - full)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(content[keep])])


class _Words(dict):
    """Ids of words; up to ``KNOWN_WORDS`` of them are kept."""

    def __init__(self, model: Bpe):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.model.alphabet)
        ids = array.array("I", self.model.ids(spelled)).tobytes()
        if len(self) < KNOWN_WORDS:
            self[word] = ids
        return ids


_coders: dict[str, Bpe] = {}


def coder(path: str) -> Bpe:
    if path not in _coders:
        _coders[path] = Bpe(path)
    return _coders[path]


def bpe_texts(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers.

    One row per input row; a null text is empty and has no ids; an id may be null or repeated;
    extra columns are ignored.
    """

    def step(batch: pa.RecordBatch):
        model = coder(path)
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = [model.encode(t or "") for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), model.decode(ids).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(texts, step, "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    out = bpe_texts(docs, path)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))
