"""Stored indexes: recall and completeness of vector lists; pruning, segments, deletes and merges of words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import retrieval as R
from tickloom.operators import vector_index, word_index
from tickloom.plans import indexes
from tickloom.session import scratch


def rows(df):
    return sorted(map(str, map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect())))


def test_recall_on_all_rows(spark):
    """Every row is filed; the usual probes find at least 0.9 of what brute force finds."""
    sf = "/root/testdata/sf0.1"
    asked, corpus = indexes._vectors(spark, sf)
    folder = scratch(spark)
    vector_index.write(corpus, folder, sample=1000)  # rows that the sample lacks are filed, too
    filed = spark.read.parquet(folder)
    assert filed.count() == corpus.count() == filed.select("chunk_id").distinct().count() and filed.select("list").distinct().count() > 20
    found = vector_index.search(asked, folder)
    exact = R.vector_topk(asked, corpus)
    assert vector_index.recall(found, exact) >= 0.9
    centres = spark.read.parquet(f"{folder}-lists")
    assert centres.first()["probes"] < centres.count()  # fewer than all
    assert vector_index.recall(exact, exact) == 1.0
    assert rows(vector_index.search(asked, folder, probes=vector_index.LISTS)) == rows(exact)


def test_vector_lists_odd_rows(spark):
    """String ids, several lengths, null and zero vectors, a crowded list, rows added again."""
    rng = np.random.default_rng(1)
    cells = [(f"c{k:04d}", rng.normal(size=8).tolist()) for k in range(300)] + [(f"same{k:05d}", [1.0] * 8) for k in range(5000)]
    cells += [("null", None), (None, [0.5] * 8), ("zero", [0.0] * 8), ("short", [1.0, 2.0, 3.0])]
    corpus = spark.createDataFrame(cells, "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([("q1", cells[0][1]), ("q2", [1.0] * 8), ("q3", [1.0, 2.0, 3.0]), ("q4", [1.0]), ("q5", None), ("q6", [0.0] * 8)], "query_id string, vector array<double>")
    folder = scratch(spark)
    vector_index.write(corpus, folder, lists=16, sample=200)
    every = vector_index.search(asked, folder, 25, vector_index.LISTS)
    assert rows(every) == rows(R.vector_topk(asked, corpus.where("chunk_id is not null"), 25))
    vector_index.write(spark.createDataFrame([("c0000", [-1.0] * 8), ("new", cells[0][1])], corpus.schema), folder, add=True)
    best = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vector_index.search(asked, folder, 3, vector_index.LISTS).collect()}
    assert best["q1", 1] == "new" and "c0000" not in {v for (q, _), v in best.items() if q == "q1"}


WORDS = [f"w{k}" for k in range(400)]


def made(rng, n, rare=True):
    texts = []
    for _ in range(n):
        own = rng.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(1, 80))
        texts.append(" ".join(["the", "the", *own]))
    return texts


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    return spark.createDataFrame([(f"d{k:05d}", t) for k, t in enumerate(made(rng, 6000))], "chunk_id string, content string").cache()


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_pruned_rows_and_skipped_postings(spark, corpus):
    queries = asked(spark, "the w390 w7", "the the w399", "w1 w2 w3 w380", "the", "nowhere", "", "W350 w350 the w0")
    folder = scratch(spark)
    word_index.add(corpus, folder)
    assert rows(word_index.search(queries, folder, 10)) == rows(R.bm25_topk(queries, corpus, 10))
    fine = scratch(spark)
    word_index.add(corpus, fine, bucket=16)
    some = asked(spark, "the w390 w7", "the the w399", "W350 w350 the w0")
    assert rows(word_index.search(some, fine, 5)) == rows(R.bm25_topk(some, corpus, 5))
    all_, read = word_index.plan(some, fine, 5).postings()
    assert 0 < read < 0.5 * all_
    for k in (1, 3, 200):
        assert rows(word_index.search(queries, folder, k)) == rows(R.bm25_topk(queries, corpus, k))


def test_segments_deletes_and_merges(spark, corpus):
    queries = asked(spark, "the w300 w7", "w1 w2", "w5 w310")
    folder = scratch(spark)
    for k in range(3):
        word_index.add(corpus.where(F.crc32(F.col("chunk_id").cast("binary")) % 3 == k), folder)
    assert rows(word_index.search(queries, folder, 10)) == rows(R.bm25_topk(queries, corpus, 10))
    hits = word_index.search(queries, folder, 10).select("chunk_id").limit(4)
    gone = spark.createDataFrame(hits.collect(), hits.schema)
    word_index.delete(gone, folder)
    word_index.delete(spark.createDataFrame([("nowhere",)], "chunk_id string"), folder)
    again = spark.createDataFrame([("d00007", "w310 w310 the"), ("d00007", "w310 zz"), (None, "x"), ("none", None)], corpus.schema)
    word_index.add(again, folder)
    left = corpus.where("chunk_id <> 'd00007'").join(gone, "chunk_id", "left_anti").unionByName(again.limit(1))
    want = rows(R.bm25_topk(queries, left, 10))
    assert rows(word_index.search(queries, folder, 10)) == want
    names = {s[0] for s in word_index.manifest(spark, folder).segments}
    word_index.merge(spark, folder)
    now = word_index.manifest(spark, folder)
    assert len(now.segments) == 1 and not now.deleted and now.segments[0][2] == left.count()
    assert rows(word_index.search(queries, folder, 10)) == want
    kept = spark.read.parquet(f"{folder}/{now.segments[0][0]}/blocks").select(F.explode("postings.chunk_id").alias("chunk_id"))
    assert kept.join(gone, "chunk_id", "left_semi").isEmpty()
    assert not any(word_index.exists(spark, f"{folder}/{n}") for n in names)
    word_index.clear(spark, folder)
    assert word_index.manifest(spark, folder).version == -1


def test_deletes_of_one_segment_are_merged_away_without_a_shuffle_of_postings(spark, corpus, monkeypatch):
    """Blocks keep their buckets; what is left and how it is bounded is as if it had been written at once."""
    folder, fresh = scratch(spark), scratch(spark)
    gone = F.crc32(F.col("chunk_id").cast("binary")) % 7 == 0
    word_index.add(corpus, folder)
    word_index.delete(corpus.where(gone), folder)
    shuffled = []
    monkeypatch.setattr(word_index, "_together", lambda rows, n: shuffled.append(n) or rows)
    word_index.merge(spark, folder)
    monkeypatch.undo()
    word_index.add(corpus.where(~gone), fresh)
    one, other = word_index.manifest(spark, folder).segments[0], word_index.manifest(spark, fresh).segments[0]
    assert not shuffled and one[2:4] == other[2:4] and one[2] == corpus.where(~gone).count()
    told = lambda at, name: sorted((r["term"] or "", r["p"]) for r in spark.read.parquet(f"{at}/{name}/blocks").select("term", F.explode("postings").alias("p")).collect())
    assert told(folder, one[0]) == told(fresh, other[0])
    blocks = spark.read.parquet(f"{folder}/{one[0]}/blocks")
    assert blocks.where(F.size("postings") != F.col("size")).isEmpty() and blocks.groupBy("term", "bucket").count().where("count > 1").isEmpty()
    queries = asked(spark, "the w390 w7", "w1 w2 w3 w380")
    assert rows(word_index.search(queries, folder, 10)) == rows(R.bm25_topk(queries, corpus.where(~gone), 10))


def test_merges_shuffle_blocks_and_searches_give_k_hits_a_task(spark, corpus, monkeypatch):
    """Blocks of like segments go whole, those of a small one are split; ids that are gone stay out; scores are summed
    where a bucket's blocks meet, with the rows of a search whose terms are too many for that."""
    number = F.crc32(F.col("chunk_id").cast("binary"))
    again = corpus.where(number % 10 == 0).withColumn("content", F.concat("content", F.lit(" w310 w7")))
    left = corpus.where(number % 10 != 0).unionByName(again)
    queries = asked(spark, "the w390 w7", "the the w399", "w1 w2 w3 w380", "the", "nowhere", "W350 w350 the w0")
    folder, passed = scratch(spark), []
    for part in (corpus.where(number % 2 == 0), corpus.where(number % 2 == 1), again):
        word_index.add(part, folder, bucket=64)
    before = word_index.manifest(spark, folder)
    assert before.deleted and len({s[4] for s in before.segments}) > 1
    blocks = [spark.read.parquet(f"{folder}/{s[0]}/blocks").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first() for s in before.segments]
    together = word_index._together
    monkeypatch.setattr(word_index, "_together", lambda rows, n: passed.append(rows.count()) or together(rows, n))
    word_index.merge(spark, folder, bucket=64)
    split = blocks[2]["size"] + again.count()  # a block of the list of chunks has as size their number
    assert passed == [blocks[0]["n"] + blocks[1]["n"] + split] and passed[0] < 0.7 * sum(b["size"] for b in blocks)
    now = word_index.manifest(spark, folder).segments
    assert len(now) == 1 and now[0][2] == left.count()
    held = spark.read.parquet(f"{folder}/{now[0][0]}/blocks")
    assert held.groupBy("term", "bucket").count().where("count > 1").isEmpty() and held.where(F.size("postings") != F.col("size")).isEmpty()
    for k in (1, 10):
        want = rows(R.bm25_topk(queries, left, k))
        monkeypatch.setattr(word_index, "ASKED", R.ASKED)
        given = word_index.plan(queries, folder, k).scores
        assert given.count() <= k * queries.count() * given.rdd.getNumPartitions() and rows(word_index.search(queries, folder, k)) == want
        monkeypatch.setattr(word_index, "SCORES", 700)  # few queries at once
        assert rows(word_index.search(queries, folder, k)) == want
        monkeypatch.setattr(word_index, "SCORES", R.SCORES)
        monkeypatch.setattr(word_index, "ASKED", 0)
        assert rows(word_index.search(queries, folder, k)) == want


def test_impacts_bound_every_posting(spark):
    rng = random.Random(8)
    cells = [(k, [(rng.randrange(1, 9), rng.randrange(1, 50)) for _ in range(rng.randrange(1, 40))]) for k in range(50)]
    df = spark.createDataFrame([(k, [{"tf": t, "dl": d} for t, d in ps]) for k, ps in cells], "k int, p array<struct<tf: int, dl: int>>")
    for r, (_, ps) in zip(df.select("k", word_index.impacts(F.col("p")).alias("i")).orderBy("k").collect(), cells):
        kept = [(x["tf"], x["dl"]) for x in r["i"]]
        assert set(kept) <= set(ps) and all(any(t >= a and d <= b for t, d in kept) for a, b in ps)
        assert not any(t >= a and d <= b for a, b in kept for t, d in kept if (a, b) != (t, d))


def test_sampled_bits_recall_on_all_rows(spark):
    """Of all pairs within 22 bits at least 0.9, each once and none wrong; crowded buckets give the same."""
    from tickloom.operators import text_prep as P
    from tickloom.plans import texts

    own = texts.simhash(spark, "/root/testdata/sf0.1").where("doc_id < 1000").select(F.col("doc_id").alias("id"), "fp").cache()
    exact = {(min(r["id_a"], r["id_b"]), max(r["id_a"], r["id_b"])): r["distance"] for r in P.near_pairs(own).collect()}
    classes = own.groupBy("fp").agg(F.min("id").alias("id")).where("fp <> 0")
    fps = {r["id"]: r["fp"] for r in classes.collect()}
    want = {tuple(sorted((fps[a], fps[b]))): d for (a, b), d in exact.items() if a in fps and b in fps}
    found = [tuple(r) for r in P.near_candidates(classes).collect()]
    assert len(found) == len({f[:2] for f in found})
    assert all(want[a, b] == d for a, b, d in found)
    assert len(found) >= 0.9 * len(want) and len(want) > 100
    assert sorted(found) == sorted(tuple(r) for r in P.near_candidates(classes, chunk=40).collect())
    links = {r["id"]: r["links"] for r in P.sampled_links(own).collect()}
    assert len(links) == own.count() and sum(links[k] for k in fps) == 2 * len(found)


def test_chance_of_a_shared_table():
    from tickloom.operators import text_prep as P

    rng, sampled = random.Random(5), P.sampled_bits(P.TABLES, P.SAMPLED)
    for distance in (10, 22):
        hits = 0
        for _ in range(2000):
            apart = set(rng.sample(range(64), distance))
            hits += any(not apart & set(bits) for bits in sampled)
        assert abs(hits / 2000 - P.chance(distance)) < 0.05
    assert P.chance(22) > 0.7 and P.chance(16) > 0.95 and P.chance(0) == 1.0


def test_chunk_ids_of_any_type(spark):
    """Chunks' string ids through retrieval, fusion, penalty and near pairs."""
    texts = [("c-a", "alpha beta gamma"), ("c-b", "alpha beta gamma"), ("c-c", "delta")]
    entries = spark.createDataFrame([(i, "s", "n", t, None) for i, t in texts], "chunk_id string, stock_code string, stock_name string, content string, created_at timestamp")
    vectors = R.embedded(entries.select("chunk_id", "content"), indexes.letter_shares)
    q = R.embedded(spark.createDataFrame([("q", "alpha beta")], "query_id string, content string"), indexes.letter_shares)
    found = R.retrieve(R.vector_topk(q, vectors), R.bm25_topk(q.withColumnRenamed("content", "text"), entries.select("chunk_id", "content")), entries, F.current_timestamp())
    got = found.collect()
    assert [r["chunk_id"] for r in got][0] in ("c-a", "c-b") and {r["chunk_id"] for r in got} == {"c-a", "c-b", "c-c"}
    from tickloom.operators import text_prep

    pairs = text_prep.near_pairs(entries.select(F.col("chunk_id").alias("id"), text_prep.simhash("content").alias("fp")))
    assert ("c-a", "c-b", 0) in {tuple(r) for r in pairs.collect()}


class Gone(Exception):
    status = 404


def test_a_service_that_is_gone_is_not_asked_again(spark, tmp_path):
    """After 404 the fused order stands without another call; other errors are tried anew for each query."""
    asked, kind = str(tmp_path / "asked"), "query_id long, query string, chunk_id string, content string, final_score double"
    rows = [(q, "q", f"c{k}", f"text {k}", float(k)) for q in range(6) for k in range(4)]
    hits = spark.createDataFrame(rows, kind).coalesce(1)

    def scorer_of(error, name):
        def scorer(query, texts, n):
            with open(f"{asked}-{name}", "a") as f:
                f.write("x")
            raise error

        return scorer

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for error, name, calls in ((Gone(), "gone", 1), (OSError(), "other", 6)):
            got = R.rerank_with(hits, scorer_of(error, name), 2).collect()
            assert sorted((r["query_id"], r["chunk_id"], r["final_rank"]) for r in got) == sorted((q, c, k) for q in range(6) for c, k in (("c3", 1), ("c2", 2)))
            assert len(open(f"{asked}-{name}").read()) == calls
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
