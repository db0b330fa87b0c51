"""Words of text without spaces: a lattice of known words, and its cheapest path.

Every run of ideographs is a lattice whose edges are known words and single characters. A word
costs the negative logarithm of its share of all characters, counted over all texts of a corpus, in
whole millionths; a path costs the sum. Viterbi decoding takes the cheapest path, and of equally
cheap ones that with the longer word where they differ first. Letters and digits of other
scripts are words as they stand, in small letters, as ``functions.text.terms`` has them.

Many runs are decoded at once, place by place from their ends: a string of LONGEST ideographs fits 64
bits, so counts and costs are looked up among sorted whole numbers. Runs of more than ALONG go one by one.

A string of 2 to LONGEST ideographs is known if it stands there twice at least and its share is at
least 1 / TABLE, so no more than TABLE of a length are: what every task gets is bounded. A character
that was never counted costs as much as half an occurrence.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut, workers_import

#: Characters of a word at most, and the least share of known ones.
LONGEST, TABLE = 4, 1 << 18
#: Strings that a task counts before it passes them on, and runs whose words a worker keeps.
COUNTED, KEPT = 500_000, 200_000
#: Characters of a run up to which it is decoded with others, and of runs that are decoded at once.
ALONG, AT_ONCE = 128, 1 << 18
_TERM = regex.compile(r"([一-龥]+)|[\p{L}\p{N}--[一-龥]]+", regex.V1)


_RUN = re.compile("[一-龥]+")


@functools.cache
def _plain() -> re.Pattern:
    """What _TERM matches, as ranges of characters, which are matched many times as fast as properties."""
    every = ("".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000))))
    others = regex.compile(r"[\p{L}\p{N}--[一-龥]]+", regex.V1)
    ranges = [f"\\U{ord(m[0]):08x}-\\U{ord(m[-1]):08x}" for some in every for m in others.findall(some)]
    return re.compile(f"[一-龥]+|[{''.join(ranges)}]+")


def micro(x: float) -> int:
    return math.floor(1_000_000 * math.log(x))


@dataclass
class Lexicon:
    """Counts of known words by length, and of all characters."""

    counts: dict[str, int]
    total: int
    seen: dict[str, list[str]] = field(default_factory=dict)

    def __getstate__(self):
        return {"counts": self.counts, "total": self.total, "seen": {}}

    def cost(self, word: str) -> int | None:
        """Of a word that is known, or one character long; else None."""
        n = self.counts.get(word)
        if n is None and len(word) > 1:
            return None
        return -micro((n or 0.5) / max(1, self.total))

    def best(self, run: str) -> list[str]:
        """The words of the cheapest path, found from the end: best[k] is the cost of what follows k."""
        if run in self.seen:
            return self.seen[run]
        costs, size = [0] * (len(run) + 1), [0] * len(run)
        for k in range(len(run) - 1, -1, -1):
            least = None
            for n in range(min(LONGEST, len(run) - k), 0, -1):  # of equals the longer
                own = self.cost(run[k : k + n])
                if own is not None and (least is None or own + costs[k + n] < least):
                    least, size[k] = own + costs[k + n], n
            costs[k] = least
        out, k = [], 0
        while k < len(run):
            out.append(run[k : k + size[k]])
            k += size[k]
        if len(self.seen) >= KEPT:
            self.seen.clear()
        if len(run) <= 64:
            self.seen[run] = out
        return out

    def terms(self, text: str | None) -> list[str]:
        out: list[str] = []
        for m in _TERM.finditer((text or "").lower()):
            out += self.best(m[0]) if m[1] else [m[0]]
        return out


def _coded(run: str) -> list[np.ndarray]:
    """Of runs with a blank after each: for n up to LONGEST, the number that stands for the n characters at each place, or 0."""
    at = np.frombuffer(run.encode("utf-32-le"), "<u4").astype(np.int64)
    at = np.where(at == 32, 0, at - 0x4DFF)
    out = [at]
    for n in range(2, LONGEST + 1):
        grown = np.zeros(len(at), np.int64)
        here, last = out[-1][: len(at) - n + 1], at[n - 1 :]
        grown[: len(last)] = np.where((here > 0) & (last > 0), here << 15 | last, 0)
        out.append(grown)
    return out


def _word(code: int) -> str:
    out = ""
    while code:
        out, code = chr((code & 0x7FFF) + 0x4DFF) + out, code >> 15
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(_word, words.tolist())), pa.string()), pa.array(counts)], ["word", "n"])

    for b in batches:
        runs: Counter = Counter()
        for t in b.column(0).to_pylist():
            runs.update(_RUN.findall(t or ""))
        own, times = list(runs), np.array(list(runs.values()), np.int64)
        for some in _lots(own):
            each = np.repeat(times[some], [len(own[k]) + 1 for k in some])
            for codes in _coded(" ".join(own[k] for k in some) + " "):
                there = codes > 0
                words, at = np.unique(np.concatenate([words, codes[there]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, each[there]]), len(words)).astype(np.int64)
            if len(words) > COUNTED:
                yield rows()
                words, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words):
        yield rows()


def _lots(runs: list[str]) -> Iterator[range]:
    """Places of runs that have AT_ONCE characters together, or one run of more."""
    first, held = 0, 0
    for k, run in enumerate(runs):
        if held and held + len(run) > AT_ONCE:
            yield range(first, k)
            first, held = k, 0
        held += len(run)
    if runs:
        yield range(first, len(runs))


class Decoder:
    """``Lexicon.best`` of many runs at once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        known = {n: sorted((self.code(w), lexicon.cost(w)) for w in lexicon.counts if len(w) == n) for n in range(1, LONGEST + 1)}
        self.codes = [np.array([c for c, _ in known[n]], np.int64) for n in known]
        self.costs = [np.array([c for _, c in known[n]], np.int64) for n in known]
        self.rare = lexicon.cost("")  # of a character that was never counted

    @staticmethod
    def code(word: str) -> int:
        out = 0
        for c in word:
            out = out << 15 | ord(c) - 0x4DFF
        return out

    def best(self, runs: list[str]) -> list[list[str]]:
        none = np.iinfo(np.int64).max >> 2
        joined = " ".join(runs) + " "
        own = []
        for n, codes in enumerate(_coded(joined)):
            known, costs = self.codes[n], self.costs[n]
            cost = np.full(len(codes), none if n else self.rare, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                cost = np.where(known[at] == codes, costs[at], cost)
            own.append(np.where(codes > 0, cost, none))
        size = np.array(list(map(len, runs)))
        ends = np.cumsum(size + 1) - 1
        order = np.argsort(-size, kind="stable")
        ends, size = ends[order], size[order]
        total, step = np.zeros(len(joined) + LONGEST, np.int64), np.ones(len(joined), np.int8)
        for k in range(1, size[0] + 1):
            at = ends[: np.searchsorted(-size, -k, "right")] - k
            least, taken = None, None
            for n in range(min(LONGEST, k), 0, -1):  # of equals the longer
                c = own[n - 1][at] + total[at + n]
                if least is None:
                    least, taken = c, np.full(len(at), n, np.int8)
                else:
                    taken = np.where(c < least, n, taken)
                    least = np.minimum(c, least)
            total[at], step[at] = least, taken
        step, at, out = step.tolist(), 0, []
        for run in runs:
            words, end = [], at + len(run)
            while at < end:
                words.append(joined[at : at + step[at]])
                at += step[at]
            out.append(words)
            at += 1
        return out

    def terms(self, texts: list[str | None]) -> list[list[str]]:
        found = [_plain().findall((t or "").lower()) for t in texts]
        seen: dict[str, list[str]] = {}
        few = [t for t in dict.fromkeys(t for own in found for t in own) if "一" <= t[0] <= "龥" and len(t) <= ALONG]
        for some in _lots(few):
            own = [few[k] for k in some]
            seen.update(zip(own, self.best(own)))
        out = []
        for own in found:
            words: list[str] = []
            for term in own:
                known = seen.get(term)
                if known is not None:
                    words += known
                elif "一" <= term[0] <= "龥":
                    words += self.lexicon.best(term)
                else:
                    words.append(term)
            out.append(words)
        return out


def learn(texts: DataFrame, text: str = "text", table: int = TABLE) -> Lexicon:
    """Counted over all texts; the driver holds table words of each length at most, and the characters."""
    workers_import(texts.sparkSession)
    counts = cut(texts.select(text).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.where((F.length("word") == 1) | (F.col("n") >= 2) & (F.col("n") * table >= total))
    return Lexicon({r["word"]: r["n"] for r in known.toLocalIterator()}, total)


def cutter(texts: DataFrame, lexicon: Lexicon) -> Callable[[Column], Column]:
    """What cuts a column of text into terms, for ``retrieval.bm25_topk(cut_by=)`` and the like."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<string>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for c in columns:
            yield pd.Series(decoder.terms(c.tolist()), dtype=object)

    return run
