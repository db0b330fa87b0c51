"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language. A word that is in no table backs
off to its letters, each in the longest known n-gram: with both neighbours, else with the one
before, else alone; the word counts as the mean of its letters. A text's score is the sum over
all its words and the log share of the language's documents; the prediction is the best language,
and its score the posterior probability.

Words are runs of letters and marks that begin with a letter, in small letters. They are counted
over all learned documents: each task adds up the different words of some megabytes of text, the
rest is one aggregation. N-grams are counted from these words, weighted by their counts. A word or
n-gram is known for a language if its share of the language's words (n-grams of that order) is at
least LANGUAGES / TABLE. That holds at every size of the corpus, and no more than TABLE words and
TABLE n-grams of each order can be known; they go to every task, and scoring shuffles nothing.
Logarithms are whole millionths, so that sums do not depend on their order.

Frequencies that are missing count as half an occurrence. Letters of which no n-gram is known say
nothing. Texts that are null or without a letter are ``und`` with score 0, and so is everything
where nothing could be learned; ties go to the first language by code point. Null lang teaches
nothing. Rows that repeat a doc_id are judged each by its own text; a null doc_id is held out.
Texts are scored whole, a very long one by itself. An empty table gives an empty result. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

UNKNOWN = "und"
#: Known words at most, and known n-grams of each order; also the least share by which one is known.
TABLE = 1 << 20
#: Bytes of texts that are cut into words together.
BLOCK = 8 << 20
#: Letters and neighbours in an n-gram.
ORDERS = (3, 2, 1)
MICRO = 1_000_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the words of all texts in order, and the bounds of each text's."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.replace_substring_regex(pc.binary_join_element_wise("", texts, " "), r"[^\pL\pM]+", " ")
    texts = pc.replace_substring_regex(texts, r" \pM+", " ")
    parts = pc.split_pattern(texts, " ")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    real = pc.not_equal(flat, "")
    bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])[offsets - offsets[0]]
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), bounds


def letters(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The word of each letter (or mark), and its n-gram of each of ORDERS as a number of 21 bits a
    character; a space stands before and behind a word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
    at = np.flatnonzero(points != 32)
    word = np.cumsum(points == 32)[at] - 1
    two = points[at - 1] << 21 | points[at]
    return word, [two << 21 | points[at + 1], two, points[at]]


def _gathered(batches, size: int):
    """Batches joined until their last column has so many bytes, but at least one row."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(b.num_columns - 1).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, k: int) -> pa.Array:
    column = table.column(k)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


_COUNT = "lang string, size int, word string, gram long, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) → counts of words (size 0) and n-grams in some megabytes of text."""
    for t in _gathered(batches, BLOCK):
        langs = _column(t, 0).dictionary_encode()
        known, at, bounds = words(_column(t, 1))
        lang_of = np.repeat(langs.indices.to_numpy(), np.diff(bounds)).astype(np.int64)
        pairs, n = np.unique(lang_of * max(1, len(known)) + at, return_counts=True)
        lang, word = np.divmod(pairs, max(1, len(known)))
        names = langs.dictionary

        def rows(lang, size, word, gram, n):
            k = len(n)
            cells = [names.take(pa.array(lang)), pa.array(np.full(k, size, np.int32)), word if word is not None else pa.nulls(k, pa.string()), pa.array(gram) if gram is not None else pa.nulls(k, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(cells, ["lang", "size", "word", "gram", "n"])

        yield rows(lang, 0, known.take(pa.array(word)), None, n)
        own, keys = letters(known.to_pylist())
        first = np.searchsorted(own, np.arange(len(known) + 1))
        for k in range(len(names)):  # n-grams of the language's words, each as often as the word stands there
            times = np.zeros(len(known), np.int64)
            times[word[lang == k]] = n[lang == k]
            weight = np.repeat(times, np.diff(first))
            some = weight > 0
            for size, key in zip(ORDERS, keys):
                grams, at_ = np.unique(key[some], return_inverse=True)
                yield rows(np.full(len(grams), k), size, None, grams, np.bincount(at_, weight[some], len(grams)).astype(np.int64))


def micro(x) -> np.ndarray:
    """Logarithms in whole millionths."""
    return np.floor(MICRO * np.log(np.asarray(x, np.float64))).astype(np.int64)


@dataclass
class Model:
    """Languages by code point, priors by language, floors by size and language, and known words
    and n-grams with, by language, (row, gain over the floor)."""

    langs: list[str]
    prior: np.ndarray
    floor: dict[int, np.ndarray]
    words: pa.Array
    word_gains: list[tuple[np.ndarray, np.ndarray]]
    grams: np.ndarray
    gram_gains: list[tuple[np.ndarray, np.ndarray]]

    def _letters(self, unseen: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each letter its word, the row of its longest known n-gram (-1: none) and its size."""
        word, keys = letters(unseen)
        row, size = np.full(len(word), -1), np.zeros(len(word), np.int64)
        for n, key in zip(ORDERS, keys):
            at = np.minimum(np.searchsorted(self.grams, key), max(0, len(self.grams) - 1))
            hit = (row < 0) & (self.grams[at] == key) if len(self.grams) else np.zeros(len(word), bool)
            row[hit], size[hit] = at[hit], n
        return word, row, size

    def scores(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """By language the score of each text, and its number of words."""
        different, at, bounds = words(texts)
        row = pc.fill_null(pc.index_in(different, value_set=self.words), -1).to_numpy()
        lost = np.flatnonzero(row < 0)
        word, gram, size = self._letters(different.take(pa.array(lost)).to_pylist()) if len(lost) else (np.zeros(0, np.int64),) * 3
        first = np.searchsorted(word, np.arange(len(lost) + 1))
        out = []
        for k in range(len(self.langs)):
            gain = np.zeros(len(self.words) + 1, np.int64)
            gain[self.word_gains[k][0]] = self.word_gains[k][1]
            own = self.floor[0][k] + gain[row]
            if len(lost):
                gain = np.zeros(len(self.grams) + 1, np.int64)
                gain[self.gram_gains[k][0]] = self.gram_gains[k][1]
                floors = np.array([0] + [self.floor[n][k] for n in (1, 2, 3)])
                sums = np.concatenate([[0], np.cumsum(floors[size] + gain[gram])])
                own[lost] = (sums[first[1:]] - sums[first[:-1]]) // np.diff(first)
            sums = np.concatenate([[0], np.cumsum(own[at])])
            out.append(self.prior[k] + sums[bounds[1:]] - sums[bounds[:-1]])
        return out, np.diff(bounds)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        by, n = self.scores(texts)
        by = np.stack(by)
        best = by.argmax(axis=0)
        score = 1 / np.exp((by - by.max(axis=0)) / MICRO).sum(axis=0)
        return [self.langs[b] if some else UNKNOWN for b, some in zip(best.tolist(), n)], np.where(n > 0, np.round(score, 6), 0.0)


def fit(docs: DataFrame, table: int = TABLE) -> Model:
    """Learned from all documents with a lang that are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.where("lang is not null").where(~held_out(F.col("doc_id"))).select("lang", "text")
    share = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(share)
    counts = cut(own.mapInArrow(_counted, _COUNT).groupBy("lang", "size", "word", "gram").agg(F.sum("n").alias("n")))
    totals = cut(counts.groupBy("lang", "size").agg(F.sum("n").alias("total")))
    all_ = {(r["lang"], r["size"]): r["total"] for r in totals.collect()}
    known = counts.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") * table >= F.col("total") * len(langs))
    found = known.select("lang", "size", "word", "gram", "n").toArrow()  # table rows of each size at most
    found = found.append_column("k", pc.index_in(found["lang"], value_set=pa.array(langs, pa.string())))
    is_word = pc.equal(found["size"], 0)
    kinds = []
    for rows, name in ((found.filter(is_word), "word"), (found.filter(pc.invert(is_word)), "gram")):
        keys = pc.unique(rows[name])
        keys = keys.take(pc.sort_indices(keys))
        at = pc.index_in(rows[name], value_set=keys).to_numpy()
        lang, gain = rows["k"].to_numpy(), micro(2 * rows["n"].to_numpy())
        kinds += [keys, [(at[lang == k], gain[lang == k]) for k in range(len(langs))]]
    floor = {size: micro([0.5 / max(1, all_.get((x, size), 0)) for x in langs]) for size in (0, *ORDERS)}
    prior = micro([share[x] / sum(share.values()) for x in langs])
    return Model(langs, prior, floor, kinds[0].cast(pa.string()), kinds[1], kinds[2].to_numpy(), kinds[3])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, BLOCK):
            langs, score = shared.value.predict(_column(t, 1))
            yield pa.RecordBatch.from_arrays([_column(t, 0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, table))  # bounded by table
    rows = docs.select("doc_id", "text").mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
