"""Runs of repeated word sequences, and texts with the repetitions taken out.

A run is a maximal stretch of words with smallest period q and at least ``LEAST`` words and
``TIMES`` periods. A suffix automaton holds all subwords of a stretch; its link tree is walked with
link-cut access: appending word i gives the path from the root to the state of the prefix the colour
i, so before that the path falls into segments, each coloured with the last end p of its subwords.
A segment's deepest state is the longest common suffix of the prefixes that end at p and i. Where it
is no shorter than i - p, the words up to i end in a square of period i - p; with the length of the
common suffix it reaches as far to the left as it can, and it is a run where the next word breaks
the period. Walking a path takes amortised logarithmic time.

Only stretches that can hold a run are walked: within a run of period q and length n, the three-word
sequences from its word q on occur q words before, so n - q - 2 of them in a row have an earlier
occurrence within a third of their number. Other words are in no run.

Defined results: null and empty texts, and texts without words, have no runs and collapse to the
empty text; words are compared exactly; a row is judged by itself, repeated rows and ids included;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, byte_table, mix, on_batches, prefix_sums, span_hash, text_slices

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
_RUN = ("start", "length", "period")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = byte_table(12)
_ODD = np.uint64(0xD1342543DE82EF95)


class SuffixAutomaton:
    """All subwords of a sequence: for each state its longest length and suffix link; ``prefix``: states of the prefixes."""

    def __init__(self, words: list[int]):
        length, link, steps = [0], [-1], [{}]
        self.prefix, last = [], 0
        for word in words:
            own = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and word not in steps[at]:
                steps[at][word] = own
                at = link[at]
            if at >= 0:
                after = steps[at][word]
                if length[after] > length[at] + 1:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[after])
                    steps.append(steps[after].copy())
                    link[after] = twin
                    while at >= 0 and steps[at].get(word) == after:
                        steps[at][word] = twin
                        at = link[at]
                    after = twin
                link[own] = after
            self.prefix.append(own)
            last = own
        self.length, self.link = length, link


class Paths:
    """Coloured root paths of a fixed tree: a link-cut forest of splay trees by depth.

    A splay tree is a path whose nodes have one colour, held at its root; ``up`` of that root is the
    parent of the path's top node in the tree.
    """

    def __init__(self, parent: list[int]):
        self.up = list(parent)
        self.upper, self.lower = [-1] * len(parent), [-1] * len(parent)
        self.colour = [-1] * len(parent)

    def _splay(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        p = up[x]
        while p >= 0 and (upper[p] == x or lower[p] == x):
            g = up[p]
            nested = g >= 0 and (upper[g] == p or lower[g] == p)
            if nested and (upper[g] == p) == (upper[p] == x):
                self._rotate(p)
                self._rotate(x)
            elif nested:
                self._rotate(x)
                self._rotate(x)
            else:
                self._rotate(x)
            p = up[x]

    def _rotate(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        p = up[x]
        g = up[p]
        if upper[p] == x:
            inner = upper[p] = lower[x]
            lower[x] = p
        else:
            inner = lower[p] = upper[x]
            upper[x] = p
        if inner >= 0:
            up[inner] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if upper[g] == p:
                upper[g] = x
            elif lower[g] == p:
                lower[g] = x
        self.colour[x] = self.colour[p]

    def recolour(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from the root to ``node``; its segments before: (deepest node, colour), upwards."""
        segments, below, x = [], -1, node
        while x >= 0:
            self._splay(x)
            segments.append((x, self.colour[x]))
            cut = self.lower[x]
            if cut >= 0:
                self.colour[cut] = self.colour[x]  # the rest of the path, with its own colour
            self.lower[x] = below
            below, x = x, self.up[x]
        self._splay(node)
        self.colour[node] = colour
        return segments


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, in order."""
    names: dict = {}
    ids = [names.setdefault(w, len(names)) for w in words]
    automaton = SuffixAutomaton(ids)
    paths, length, found = Paths(automaton.link), automaton.length, []
    for i, state in enumerate(automaton.prefix):
        for node, last in paths.recolour(state, i):
            period, common = i - last, length[node]
            if last >= 0 and common >= period and common + period >= max(LEAST, TIMES * period):
                if i + 1 == len(ids) or ids[i + 1] != ids[i + 1 - period]:
                    found.append((i - common - period + 1, common + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def windows(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [low, high) of words, each within one text, that hold all runs with a word to either side.

    ``first``: each text's first word, one more at the end.
    """
    count = len(hashes) - 2
    if count < 3:
        return []
    text = np.searchsorted(first, np.arange(len(hashes)), side="right") - 1
    with np.errstate(over="ignore"):
        three = mix(mix(mix(hashes[:-2]) * _ODD + hashes[1:-1]) * _ODD + hashes[2:] + text[:-2].astype(np.uint64))
    order = np.argsort(three, kind="stable")
    same = (three[order[1:]] == three[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    back = np.full(count, len(hashes), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    back[text[:-2] != text[2:]] = len(hashes)
    marked = back < len(hashes)
    for _ in range(8):  # marks that are too few in a row go; leaving some in would only cost time
        edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.zeros(count, np.int64)
        size[marked] = np.repeat(high - low, high - low)
        fits = marked & (size >= LEAST - 3) & ((TIMES - 1) * back <= size + 2)
        done = fits.sum() == marked.sum()
        marked = fits
        if done:
            break
    edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    out: list[tuple[int, int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        t = int(text[a])  # marks in a row belong to one text
        low, high = max(int(first[t]), a - (b - a + 2) // (TIMES - 1) - 1), min(int(first[t + 1]), b + 3)
        while out and low < out[-1][1]:
            x, y = out.pop()
            low, high = min(low, x), max(high, y)
        out.append((low, high))
    return out


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and each text's first word, one more at the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    begin, finish = ~space, ~space
    begin[1:] &= space[:-1]
    finish[:-1] &= space[1:]
    heads, tails = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    begin[heads] = ~space[heads]
    finish[tails] = ~space[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return span_hash(prefix_sums(_TABLE[data]), start, end), np.searchsorted(start, bounds)


def planted_order(doc_id: int | None, count: int) -> tuple[int, int] | None:
    """(a, p) for the texts, one of ten, whose word i >= a becomes word a + (i - a) % p; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not count:
        return None
    g = h // 10
    a = g % count
    return a, 1 + (count - a) // (3 + g % 8)


Order = Callable[[int | None, int], tuple[int, int] | None]


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return " ".join(words)


def _results(batch: pa.RecordBatch, order: Order | None):
    """(row, runs, collapsed text) of a batch of (doc_id, text)."""
    ids = batch.column(0).to_pylist()
    for first, end, data, bounds in text_slices(batch.column(1)):
        texts = batch.column(1).slice(first, end - first).to_pylist()
        with np.errstate(over="ignore"):
            hashes, at = _hashes(data, bounds)
            changed = {}
            if order is not None:
                place = np.arange(len(hashes))
                for t in range(end - first):
                    count = int(at[t + 1] - at[t])
                    turn = order(ids[first + t], count)
                    if turn is not None:
                        a, p = turn
                        changed[t] = np.where(np.arange(count) < a, np.arange(count), a + (np.arange(count) - a) % p)
                        place[at[t] : at[t + 1]] = at[t] + changed[t]
                hashes = hashes[place]
            by_text: dict[int, list[tuple[int, int]]] = {}
            for low, high in windows(hashes, at):
                by_text.setdefault(int(np.searchsorted(at, low, side="right")) - 1, []).append((low, high))
        for t, text in enumerate(texts):
            words = _WORD.findall(text) if text else []
            if t in changed:
                words = [words[i] for i in changed[t].tolist()]
            runs = []
            for low, high in by_text.get(t, ()):
                low, high = low - int(at[t]), high - int(at[t])
                runs += [(low + s, n, q) for s, n, q in runs_of(words[low:high])]
            runs.sort(key=lambda r: (r[0], r[2]))
            yield first + t, runs, _collapsed(words, runs)


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; of equal ones the first, then the one with the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """Rows (doc_id, runs, highest, collapsed): runs as (start, length, period), the one with the highest
    exponent, and the text without the words that a run repeats, its words joined by one space.

    ``order`` may give a text's words another order first.
    """
    kind = pa.struct([(name, pa.int64()) for name in _RUN])

    def give(batch, held):
        rows, runs, best, texts = zip(*held)
        columns = [batch.column(0).take(pa.array(rows)), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "highest", "collapsed"])

    def step(batch: pa.RecordBatch):
        held, size = [], 0
        for row, runs, text in _results(batch, order):
            best = highest(runs)
            held.append((row, [dict(zip(_RUN, r)) for r in runs], best and dict(zip(_RUN, best)), text))
            size += len(text)
            if size > SLICE:
                yield give(batch, held)
                held, size = [], 0
        if held:
            yield give(batch, held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run = "struct<start: long, length: long, period: long>"
    return on_batches(texts, step, f"doc_id long, runs array<{run}>, highest {run}, collapsed string")


def run_digests(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """doc_id, n_runs, the run with the highest exponent, and digests of all runs and of the collapsed text."""
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))))
    return periodic_runs(docs, order).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "highest.start",
        "highest.length",
        "highest.period",
        F.expr("1000 * highest.length DIV highest.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
