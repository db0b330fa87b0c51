"""Toxicity: a convolutional text classifier, trained in numpy.

Words are lower-cased, stripped of marks and hashed to 32 bits. Hashes that MIN_DOCS training
texts have own a row of the embedding table, all others share row 0. The first component of a
row starts as how far the word leans to toxic texts, the others at random. Filters of widths 1,
2 and 3 run over the word vectors; each filter's maximum over the whole text feeds a logistic
output. Trained by Adam on batches of equally many toxic and clean texts. In scoring, the
embedding and filters are folded into one table per place in a filter, so that a text costs a
few table rows a word, at any length.

Labelled rows whose crc32(doc_id as text) mod 5 is 0 are held out. Of the others a fifth (that
number, divided by 5, mod 5 is 0) sets thresholds and never trains. Training takes a bounded
sample of the rest: SAMPLE of each class by hash order of their ids, of texts of TRAIN_BYTES at
most; scores are of whole texts of any length. A score depends on the text alone.

Thresholds are calibrated by language, guessed from the text's short words, on all rows that set
them, by counts of scores that executors make; the threshold is that of the best F1. A language
with fewer than FEWEST toxic or clean rows takes the common one. A score is the network's moved
so that its language's threshold is at 0.5: ``predicted`` is score >= 0.5, in any language.

Null and empty texts have the score of a text without words. A sample without one of the
classes gives every text the share of toxic rows in it (0.0 for no rows). Null labels and ids do
not train. Repeated rows score alike; repeated labels count once, by their largest value; of
rows that repeat a doc_id the smallest text trains. Other columns play no part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, prepare

SIZE, WIDTHS, FILTERS, MIN_DOCS = 12, (1, 2, 3), 8, 2
#: Labelled rows of each class that may train.
SAMPLE = 1500
#: Bytes of the longest text that may train, so that a sample's size is bounded at the driver.
TRAIN_BYTES = 1 << 16
#: Rows of either class that a language needs for a threshold of its own.
FEWEST = 50
#: Network outputs are counted in steps so wide, from -LIMIT to LIMIT.
LIMIT, WIDE = 40.0, 0.05
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Words a worker remembers the rows of.
REMEMBERED = 400_000
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_"
LANGUAGES = {"de": {"der", "die", "und", "das", "ist", "nicht"}, "es": {"el", "los", "que", "por", "una", "del"}, "fr": {"le", "les", "et", "est", "une", "des"}, "en": {"the", "of", "and", "to", "that", "is"}}


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Vocabulary:
    """Rows of words, by the hash of the word without marks; 0 for one that is not known."""

    def __init__(self, hashes: np.ndarray):
        self.rows = {int(h): k for k, h in enumerate(hashes, 1)}
        self.seen: dict[str, int] = {}

    @staticmethod
    def hashed(word: str) -> int:
        return zlib.crc32((word.strip(MARKS) or word).encode("utf-8", "surrogatepass"))

    def __getstate__(self):
        return {"rows": self.rows, "seen": {}}

    def of(self, text: str | None) -> np.ndarray:
        """The row of each word of the whole text."""
        own, seen = words(text), self.seen
        found = list(map(seen.get, own))
        if None in found:
            if len(seen) > REMEMBERED:
                seen.clear()
            for k, r in enumerate(found):
                if r is None:
                    w = own[k]
                    found[k] = seen[w] = self.rows.get(self.hashed(w), 0)
        return np.array(found, np.int64)


def language(text: str | None) -> str:
    """Guessed from a text's short words alone; xx if it has none."""
    own = set(words(text))
    score, name = max((len(ws & own), k) for k, ws in LANGUAGES.items())
    return name if score else "xx"


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, lean: np.ndarray, seed: int) -> "Network":
        """lean: the first component of each row."""
        rng = np.random.default_rng(seed)
        near_zero = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        net = cls(near_zero(len(lean), SIZE), [near_zero(w, SIZE, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], near_zero(len(WIDTHS) * FILTERS), 0.0)
        net.embed[:, 0] = lean
        for f in net.filters:  # half of the filters look for leaning words
            f[:, 0, : FILTERS // 2] += 1 / len(f)
        net.out.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] += 0.3
        return net

    def folded(self, vocabulary: Vocabulary) -> "Scorer":
        return Scorer(vocabulary, [[self.embed @ f[k] for k in range(len(f))] for f in self.filters], self.bias, self.out, self.out_bias)


@dataclass
class Scorer:
    vocabulary: Vocabulary | None
    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over the text, and where it is; zero and -1 if the text is too short."""
        values, places = [], []
        for tables, bias in zip(self.tables, self.bias):
            n = len(rows) - len(tables) + 1
            if n < 1:
                values.append(np.zeros(FILTERS, np.float32))
                places.append(np.full(FILTERS, -1))
                continue
            act = tables[0][rows[:n]]
            for k in range(1, len(tables)):
                act = act + tables[k][rows[k : k + n]]
            at = act.argmax(axis=0)
            values.append(np.maximum(act[at, np.arange(FILTERS)] + bias, 0))
            places.append(at)
        return np.concatenate(values), places

    def logit(self, text: str | None) -> float:
        z = float(self.pooled(self.vocabulary.of(text))[0] @ self.out) + self.out_bias
        return min(max(z, -LIMIT), LIMIT)


@dataclass
class Constant:
    value: float


def gradients(net: Network, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray, float]:
    """(loss, (rows, gradients of these rows), of filters, of bias, of out, of out_bias) of a batch:
    texts as rows of the embedding, laid end to end, and the mean logistic loss."""
    full = [x if len(x) else np.zeros(1, np.int64) for x in texts]
    sizes = np.array([len(x) for x in full])
    x, text_of = np.concatenate(full), np.repeat(np.arange(len(full)), sizes)
    starts = np.cumsum(sizes) - sizes
    left = starts[text_of] + np.array([len(t) for t in texts])[text_of] - np.arange(len(x))  # words from here on
    own = net.embed[x]
    pooled, places = [], []
    for f, bias in zip(net.filters, net.bias):
        act = own @ f[0]
        for k in range(1, len(f)):
            act[:-k] += own[k:] @ f[k]
        act[left < len(f)] = -np.inf  # the filter would reach beyond the text
        most = np.maximum.reduceat(act, starts, axis=0)
        at = np.where(act == most[text_of], np.arange(len(x))[:, None], len(x))
        places.append(np.where(np.isfinite(most), np.minimum.reduceat(at, starts, axis=0), -1))
        pooled.append(np.maximum(most + bias, 0))
    value = np.concatenate(pooled, axis=1)
    z = np.clip(value @ net.out + net.out_bias, -LIMIT, LIMIT)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    err = ((p - y) / len(y)).astype(value.dtype)
    back = np.where(value > 0, err[:, None] * net.out[None, :], 0)
    of_filters, of_bias, rows, changes = [], [], [], []
    for i, f in enumerate(net.filters):
        own_back = np.where(places[i] >= 0, back[:, i * FILTERS : (i + 1) * FILTERS], 0)
        at = np.maximum(places[i], 0)
        of_bias.append(own_back.sum(axis=0))
        parts = []
        for k in range(len(f)):
            hit = np.minimum(at + k, len(x) - 1)
            parts.append(np.einsum("bfs,bf->sf", own[hit], own_back))
            rows.append(x[hit].ravel())
            changes.append((own_back[:, :, None] * f[k].T[None]).reshape(-1, f.shape[1]))
        of_filters.append(np.stack(parts))
    touched, place = np.unique(np.concatenate(rows), return_inverse=True)
    of_rows = np.zeros((len(touched), net.embed.shape[1]), value.dtype)
    np.add.at(of_rows, place, np.concatenate(changes))
    return loss, (touched, of_rows), of_filters, of_bias, err @ value, float(err.sum())


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 3) -> Scorer | Constant:
    """Gradients of the logistic loss reach each filter at its maximum, and the words there."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.0)
    sets = [np.unique(np.fromiter((Vocabulary.hashed(w) for w in set(words(t))), np.int64)) for t in texts]
    hashes, times = np.unique(np.concatenate(sets), return_counts=True)
    known = hashes[times >= MIN_DOCS]
    toxic_times = np.bincount(np.searchsorted(hashes, np.concatenate([s for s, v in zip(sets, y) if v])), minlength=len(hashes))[times >= MIN_DOCS]
    expected = times[times >= MIN_DOCS] * y.mean()
    lean = (toxic_times - expected) / np.sqrt(expected)
    lean = np.concatenate([[0], np.sign(lean) * np.sqrt(np.abs(lean))])  # rarer words count, too
    vocabulary = Vocabulary(known)
    net, rng = Network.fresh((lean / max(1.0, np.abs(lean).max()) * 3).astype(np.float32), seed), np.random.default_rng(seed)
    ids = [vocabulary.of(t) for t in texts]
    groups = [np.flatnonzero(y == v) for v in (0, 1)]
    params = [*net.filters, *net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    own_first, own_second = np.zeros_like(net.embed), np.zeros_like(net.embed)
    steps = epochs * max(1, 2 * max(map(len, groups)) // BATCH)
    for step in range(1, steps + 1):
        batch = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        _, (used, at_words), of_filters, of_bias, of_out, drift = gradients(net, [ids[k] for k in batch], y[batch])
        rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(params, [*of_filters, *of_bias, of_out], first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (np.sqrt(v) + 1e-7)
        own_first[used] += 0.1 * (at_words - own_first[used])
        own_second[used] += 0.001 * (at_words**2 - own_second[used])
        net.embed[used] -= rate * own_first[used] / (np.sqrt(own_second[used]) + 1e-7)
        net.out_bias -= RATE * drift
    return net.folded(vocabulary)


def cutoff(steps: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The output of the best F1 as threshold, in the middle of the gap below it. steps: rising
    numbers of steps of WIDE, with rows of either class."""
    hits, all_ = np.cumsum(toxic[::-1]), np.cumsum((clean + toxic)[::-1])
    k = len(steps) - 1 - int((2 * hits / (all_ + toxic.sum())).argmax())
    below = steps[k - 1] + 1 if k else steps[k] - 1
    return float((steps[k] + below) / 2 * WIDE)


@dataclass
class Model:
    scorer: Scorer | Constant
    common: float = 0.0
    by_language: dict[str, float] | None = None

    def score(self, text: str | None) -> float:
        if isinstance(self.scorer, Constant):
            return self.scorer.value
        z = self.scorer.logit(text) - (self.by_language or {}).get(language(text), self.common)
        return float(1 / (1 + np.exp(-z)))


def _outputs(shared):
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            steps = [int(np.floor(shared.value.logit(t) / WIDE)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([language(t) for t in texts]), pa.array(steps, pa.int32())], ["toxic", "lang", "step"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trained at the driver on 2 * sample labelled texts of train_bytes at most; thresholds by
    counts of the outputs of all rows that set them, of which the driver gets a few thousand sums."""
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "_id")
    sets = F.floor(F.crc32(F.col("_id").cast("string").cast("binary")) / 5) % 5 == 0
    texts = docs.select("doc_id", "text")
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes)
    # The same number of either class, the first by hash: a bounded pick that reruns repeat.
    able = own.where(~sets).join(short.select("doc_id"), F.col("doc_id") == F.col("_id"), "left_semi")
    pick = [able.where(F.col("toxic").isin(v)).orderBy(F.xxhash64("_id"), "_id").limit(sample) for v in (0, 1)]
    ids = cut(pick[0].unionByName(pick[1]))
    rows = short.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))  # 2 * sample ids at most
    rows = rows.groupBy("_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("_id"), "_id").collect()
    scorer = train([r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows])
    if isinstance(scorer, Constant):
        return Model(scorer)
    judges = own.where(sets & F.col("toxic").isin(0, 1))
    judges = F.broadcast(judges) if judges.count() <= SMALL else judges
    rated = texts.join(judges, F.col("doc_id") == F.col("_id")).select("toxic", "text")
    rated = rated.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(_outputs(spark.sparkContext.broadcast(scorer)), "toxic int, lang string, step int")
    counts = rated.groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("lang", "step").toPandas()
    by, enough = {}, lambda c, n: min(c["clean"].sum(), c["toxic"].sum()) >= n
    for lang, c in counts.groupby("lang"):
        if enough(c, FEWEST):
            by[lang] = cutoff(c["step"].to_numpy(), c["clean"].to_numpy(), c["toxic"].to_numpy())
    common = counts.groupby("step", as_index=False)[["clean", "toxic"]].sum()
    if not enough(common, 1):
        return Model(scorer, 0.0, by)
    return Model(scorer, cutoff(common["step"].to_numpy(), common["clean"].to_numpy(), common["toxic"].to_numpy()), by)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _score(shared):
    def run(batches):
        for b in batches:
            scores = [shared.value.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: score >= 0.5, which is its language's threshold."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, sample))  # tables of fixed size
    rows = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
