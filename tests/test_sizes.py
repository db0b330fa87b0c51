"""What a step holds and does as tables grow: fails with the steps as they were before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import retrieval as R
from tickloom.operators import text_prep as P
from tickloom.operators import vector_boxes
from tickloom.session import BATCH_BYTES, workers_import
from tickloom.sources import files


def _rows(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "chunk_id", "score", "rank").collect())


def test_boxes_give_the_exact_hits_of_few_tiles(spark, monkeypatch):
    """The rows of brute force, from a small part of all pairs; copies, a zero and a null vector too."""
    monkeypatch.setattr(vector_boxes, "WANTED", 16)
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(1500, 4))).round(2)
    v[100:200] = v[7]
    v[300] = 0
    df = spark.createDataFrame([(f"c{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "chunk_id string, vector array<float>")
    asked = df.where("chunk_id like '%0' or chunk_id = 'c0007'").select(F.col("chunk_id").alias("query_id"), "vector")
    pairs = spark.sparkContext.accumulator(0)
    whole = vector_boxes.best_of_tiles

    def counted(blocks, tiles, key, *rest):
        met = blocks.join(tiles, key).select((F.size("asked") * F.size("corpus")).alias("n")).agg(F.sum("n")).first()[0]
        pairs.add(met or 0)
        return whole(blocks, tiles, key, *rest)

    monkeypatch.setattr(vector_boxes, "best_of_tiles", counted)
    assert _rows(vector_boxes.topk(asked, df, 5)) == _rows(R.vector_topk(asked, df, 5))
    assert 0 < pairs.value < 0.5 * asked.count() * 1500


def test_batches_are_bounded_by_bytes(spark):
    workers_import(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    own = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert max(r["n"] for r in own.mapInArrow(sizes, "n long").collect()) < 2 * BATCH_BYTES


def _prints(n):
    rng = np.random.default_rng(11)
    return (rng.integers(0, 2**12, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def test_links_come_without_an_object_for_each_print(spark):
    """Workers that compare tiles get arrays; each pair of tiles is one pass over whole rows."""
    fps = np.unique(_prints(700))
    far = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
    n, m = P._links(fps.view(np.uint64), fps[:333].view(np.uint64), 22)
    assert n.tolist() == (far[:, :333] <= 22).sum(axis=1).tolist() and m.tolist() == (far[:, :333] <= 22).sum(axis=0).tolist()
    got = {r["id"]: r["links"] for r in P.near_links(spark.createDataFrame(list(enumerate(fps.tolist())), "id long, fp long")).collect()}
    assert [got[k] for k in range(len(fps))] == [int((row <= 22).sum() - 1) if f else 0 for f, row in zip(fps, np.where(fps == 0, 64, far))]


def test_sampled_links_do_not_compare_a_pair_in_every_table(spark, monkeypatch):
    """Where buckets hold more pairs than there are, tiles of all are compared instead, with the same links."""
    fps = np.unique(_prints(300))
    own = spark.createDataFrame(list(enumerate(fps.tolist())), "id long, fp long")
    pairs, calls, whole = P.near_candidates(own.select("fp")).collect(), [], P._tile_pairs
    monkeypatch.setattr(P, "_tile_pairs", lambda *a: calls.append(a) or whole(*a))
    got = {r["fp"]: r["links"] for r in P.sampled_links(own, bits=2, tables=40).collect()}
    want = P.near_candidates(own.select("fp"), bits=2, tables=40).collect()
    assert len(calls) == 1 and all(got[f] == sum(f in (r["fp_a"], r["fp_b"]) for r in want) for f in got)
    got = {r["fp"]: r["links"] for r in P.sampled_links(own).collect()}
    assert all(got[f] == sum(f in (r["fp_a"], r["fp_b"]) for r in pairs) for f in got)


def test_bm25_shuffles_hits_of_tasks_not_of_chunks(spark, monkeypatch):
    """Each task hands on k hits of a query at most, however many chunks it scores; ids that repeat are one chunk."""
    rng = np.random.default_rng(5)
    words = np.array("a b c d e f g h i j k l m n o p".split())
    docs = [(f"d{i:03d}", " ".join(words[rng.integers(0, 16, rng.integers(0, 12))])) for i in range(600)]
    corpus = spark.createDataFrame([*docs, ("none", None)], "chunk_id string, content string").repartition(3)
    asked = spark.createDataFrame([(1, "a b b z"), (2, "C d"), (3, "zz"), (4, None)], "query_id long, text string")
    passed, whole = [], R.top

    def counted(rows, *rest, **more):
        passed.append(rows.count())
        return whole(rows, *rest, **more)

    monkeypatch.setattr(R, "top", counted)
    monkeypatch.setattr(R, "SCORES", 20)
    monkeypatch.setattr(R, "HITS", 30)
    got = _rows(R.bm25_topk(asked, corpus, 7))
    assert passed[-1] <= 3 * 2 * 7
    monkeypatch.setattr(R, "ASKED", 0)
    assert got == _rows(R.bm25_topk(asked, corpus, 7)) and passed[-1] > 500
    monkeypatch.undo()
    twice = corpus.unionByName(corpus.where("chunk_id < 'd300'"))
    again = _rows(R.bm25_topk(asked, twice, 7))
    monkeypatch.setattr(R, "ASKED", 0)
    assert again == _rows(R.bm25_topk(asked, twice, 7))


def test_chunks_of_a_stream_are_those_of_whole_texts(spark):
    """Sentences pass a worker in small batches, whatever the text's length; chunks are those of chunks()."""
    rng = np.random.default_rng(9)
    texts = ["", " . ", None, *("".join("ab c"[rng.integers(0, 4)] * rng.integers(0, 40) + ".!? 。x"[rng.integers(0, 6)] for _ in range(rng.integers(1, 60))) for _ in range(40)), "long one. " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size, overlap in ((40, 0.2), (10, 0.0), (30, 0.9), (1, 1.5), (400, 0.2)):
        got = {}
        for r in P.chunk_documents(docs, size, overlap).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r["doc_id"], []).append((r["content"], r["tokens"]))
            assert r["chunk_no"] == len(got[r["doc_id"]])
        assert got == {k: c for k, t in enumerate(texts) if (c := P.chunks(t, size, overlap))}
    plan = P.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_text_files_pass_no_worker(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes("﻿é\r\n\U0001f600".encode())
    (tmp_path / "b.TXT").write_bytes(b"x")
    assert sorted(r["text"] for r in files.documents(spark, str(tmp_path)).collect()) == ["x", "﻿é\r\n\U0001f600"]
    seen, whole = [], files._texts
    monkeypatch.setattr(files, "_texts", lambda path, raw: seen.append(raw) or whole(path, raw))
    own = spark.createDataFrame([("x.txt", b"ab"), ("z.docx", b"cd")], "path string, raw binary")
    own.select(files.texts("path", "raw"))
    assert [r[0] for r in own.select(seen[0]).collect()] == [None, b"cd"]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception):
        files.documents(spark, str(tmp_path)).collect()
