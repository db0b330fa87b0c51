"""Segmentation by a word lattice against all paths, and BM25 over its terms."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import retrieval as R
from tickloom.operators import segment as S
from tickloom.plans import indexes


def paths(run):
    """All ways to cut run into words of LONGEST characters at most."""
    if not run:
        yield []
    for n in range(1, min(S.LONGEST, len(run)) + 1):
        for rest in paths(run[n:]):
            yield [run[:n], *rest]


def plain(run, lexicon):
    able = [p for p in paths(run) if all(lexicon.cost(w) is not None for w in p)]
    return min(able, key=lambda p: (sum(map(lexicon.cost, p)), [-len(w) for w in p]))


def counted(texts):
    out = Counter()
    for t in texts:
        for m in S._TERM.finditer(t or ""):
            for n in range(1, S.LONGEST + 1) if m[1] else ():
                out.update(m[1][k : k + n] for k in range(len(m[1]) - n + 1))
    return out


def made(rng, n=80):
    words = ["数据", "处理", "引擎", "数据处理", "市场", "分析", "的", "在", "价"]
    return ["".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "。", " MACD 指标", ", 2024年"]) for _ in range(n)]


def test_best_path_is_the_cheapest_of_all(spark):
    rng = random.Random(1)
    texts = [*made(rng), None, "", "plain words", "价"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lexicon = S.learn(df)
    want = counted(texts)
    total = sum(n for w, n in want.items() if len(w) == 1)
    assert lexicon.total == total and lexicon.counts == {w: n for w, n in want.items() if len(w) == 1 or n >= 2}
    small = S.learn(df, table=40)
    assert all(n * 40 >= total for w, n in small.counts.items() if len(w) > 1) and len(small.counts) < len(lexicon.counts)
    for own in (lexicon, small):
        for t in [*made(rng, 40), "未见字", "数" * 9]:
            for m in S._TERM.finditer(t):
                if m[1] and len(m[1]) <= 12:
                    assert own.best(m[1]) == plain(m[1], own)
    assert "".join(lexicon.best("数据处理引擎" * 50)) == "数据处理引擎" * 50
    assert lexicon.terms("Ab1 数据,x") == ["ab1", *lexicon.best("数据"), "x"] and lexicon.terms(None) == []


def test_many_runs_at_once_are_as_one_by_one(monkeypatch):
    """Counts and cheapest paths of runs that are decoded together, in lots of any size, and of longer ones."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [*made(rng, 200), *("".join(rng.choice("数据处一龥") for _ in range(rng.randrange(40))) + "Éa1" for _ in range(100)), None, "", "数" * 500]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert S._plain().findall(every) == [m[0] for m in S._TERM.finditer(every)]
    want = counted(texts)
    lexicon = S.Lexicon({w: n for w, n in want.items() if len(w) == 1 and w != "龥" or n >= 3}, sum(n for w, n in want.items() if len(w) == 1))
    for at_once in (7, 1 << 18):
        monkeypatch.setattr(S, "AT_ONCE", at_once)
        got = Counter()
        for b in S._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])):
            got.update({r["word"]: r["n"] for r in b.to_pylist()})
        assert got == want
        for own in (lexicon, S.Lexicon({}, 0)):
            assert S.Decoder(own).terms(texts) == [own.terms(t) for t in texts]


def test_terms_of_spaced_texts_are_as_ever(spark):
    texts = ["It's 12,5 Éa", "ßx_y", "áb", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [r["t"] for r in df.select(X.terms(F.col("text")).alias("t")).collect()]
    assert [S.Lexicon({}, 0).terms(t) for t in texts] == want


def test_bm25_over_words(spark):
    rng = random.Random(2)
    rows = [(k, t) for k, t in enumerate(made(rng, 60))]
    corpus = spark.createDataFrame(rows, "chunk_id long, content string")
    lexicon = S.learn(corpus, "content")
    asked = spark.createDataFrame([(1, "数据处理"), (2, "市场分析 macd")], "query_id long, text string")
    # The same words under other names, parted by blanks, give the same scores.
    names = {}
    coded = lambda t: " ".join(names.setdefault(w, f"word{len(names)}") for w in lexicon.terms(t))
    got = R.bm25_topk(asked, corpus, cut_by=S.cutter(corpus, lexicon)).collect()
    want = R.bm25_topk(spark.createDataFrame([(1, coded("数据处理")), (2, coded("市场分析 macd"))], asked.schema), spark.createDataFrame([(k, coded(t)) for k, t in rows], corpus.schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_query_over_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", indexes._ideographs(F.col("text")).alias("text"))
    rows = docs.collect()
    want = counted([r["text"] for r in rows])
    total = sum(n for w, n in want.items() if len(w) == 1)
    lexicon = S.Lexicon({w: n for w, n in want.items() if len(w) == 1 or n >= 2 and n * S.TABLE >= total}, total)
    got = {r["doc_id"]: (r["n_terms"], r["digest"]) for r in indexes.segmented_terms(spark, sf_dir).collect()}
    for r in rows:
        own = lexicon.terms(r["text"])
        assert got[r["doc_id"]] == (len(own), hashlib.md5(" ".join(own).encode()).hexdigest())


def test_tokens_by_a_file(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["tokens"] for r in indexes.token_count_model(spark, sf_dir).collect()}
    assert got == {k: len(own.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "t string")
    assert [r["n"] for r in df.select(X.tokens_by(indexes.file_tokens("word_bpe_49k.json"))("t").alias("n")).collect()] == [0, 0, 2]
