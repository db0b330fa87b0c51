"""Language identification against a plain loop over words and letters, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from tickloom.llm import language
from tickloom.llm.queries import queries


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def words(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def grams(word, i):
    s = " " + word + " "
    return {3: s[i : i + 3], 2: s[i : i + 2], 1: s[i + 1]}


def micro(x):
    return math.floor(1_000_000 * math.log(x))


def plain(rows, table):
    """rows of (doc_id, lang, text) → (lang, score) of each."""
    learned = [(lang, words(t)) for i, lang, t in rows if lang is not None and not held(i)]
    langs = sorted({lang for lang, _ in learned})
    if not langs:
        return [("und", 0.0)] * len(rows)
    counts = {n: defaultdict(Counter) for n in (0, 1, 2, 3)}
    for lang, ws in learned:
        for w in ws:
            counts[0][lang][w] += 1
            for i in range(len(w)):
                for n, g in grams(w, i).items():
                    counts[n][lang][g] += 1
    known = {n: {(lang, x): c for lang in langs for x, c in counts[n][lang].items() if c * table >= counts[n][lang].total() * len(langs)} for n in counts}
    every = {n: {x for _, x in known[n]} for n in known}
    value = lambda n, lang, x: micro(0.5 / max(1, counts[n][lang].total())) + (micro(2 * known[n][lang, x]) if (lang, x) in known[n] else 0)
    out = []
    for _, _, t in rows:
        ws, best = words(t), []
        for lang in langs:
            total = micro(sum(x == lang for x, _ in learned) / len(learned))
            for w in ws:
                if w in every[0]:
                    total += value(0, lang, w)
                    continue
                tries = [next(((n, g) for n, g in grams(w, i).items() if g in every[n]), None) for i in range(len(w))]
                total += sum(value(n, lang, g) for n, g in filter(None, tries)) // len(w)
            best.append(total)
        top = max(best)
        out.append((langs[best.index(top)], round(1 / sum(math.exp((x - top) / 1e6) for x in best), 6)) if ws else ("und", 0.0))
    return out


ODD = [None, "", " \n", "123 456 !", "́ ̈", "x", "ÀÉ é é", "中文 文本", "zzz qqq xxyyzz", "Straße STRASSE", "one," * 3000, "w" * 5000, "\x00a\x00"]


def test_backoff(spark):
    rng = random.Random(6)
    pools = {"aa": ["the", "and", "then", "there", "Them"], "bb": ["der", "und", "die", "dann", "Über"], "cc": ["el", "y", "niño", "entonces"]}
    rows = [(k, lang, " ".join(rng.choice(pools[lang]) + rng.choice(["", "", "e", "s,", "1"]) for _ in range(rng.randrange(1, 30)))) for k, lang in enumerate(rng.choice(sorted(pools)) for _ in range(120))]
    rows += [(200 + k, rng.choice(["aa", None]), t) for k, t in enumerate(ODD)] + [(None, "dd", "a language of a row without an id"), (7, "bb", "und und"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).withColumns({c: F.lit("own") for c in ("size", "n", "word", "held_out", "score")})
    for table in (language.TABLE, 60):
        got = language.identify(df, table).collect()
        want = [(i, held(i), *p) for (i, _, _), p in zip(rows, plain(rows, table))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert language.identify(df.limit(0)).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_blocks_do_not_matter():
    texts = pa.array([*ODD, *ODD[::-1]], pa.string())
    different, at, bounds = language.words(texts)
    assert [different.take(pa.array(at[a:b])).to_pylist() for a, b in zip(bounds, bounds[1:])] == [words(t) for t in texts.to_pylist()]
    assert [different.take(pa.array(at[a:b])).to_pylist() for a, b in zip(bounds, bounds[1:])][7] == re.findall(r"\w+", ODD[7])
    different, at, bounds = language.words(texts.slice(5, 4))
    assert bounds[0] == 0 and [different[int(k)].as_py() for k in at[bounds[1] : bounds[2]]] == words(texts[6].as_py())


def test_held_out_accuracy(spark):
    """On documents of sf0.1 that taught nothing; and neither lang nor doc_id is an input of a prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    own = queries()["op12_language"](spark, "/root/testdata/sf0.1")
    right = own.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.98
    some = docs.where("doc_id % 5 < 2")
    model = language.fit(some)
    texts = pa.array([r["text"] for r in some.select("text").limit(50).collect()])
    assert model.predict(texts)[0] == [x for k in range(50) for x in model.predict(texts.slice(k, 1))[0]]
