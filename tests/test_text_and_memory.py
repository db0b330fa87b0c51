"""Text preparation, retrieval and memory against small cases and plain loops."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import codes
from tickloom.functions import text as X
from tickloom.operators import memory as M
from tickloom.operators import ops, relational
from tickloom.operators import retrieval as R
from tickloom.operators import text_prep as P


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_codes(spark):
    want = {"SH600519": "1.600519", "sz000001": "0.000001", "600519": "1.600519", "000858.SZ": "0.000858", "1.600519": "1.600519", "abc": "ABC", None: ""}
    for raw, code in want.items():
        assert one(spark, raw, codes.normalize_code) == code
    assert one(spark, None, lambda c: codes.secid(c, None)) is None
    assert one(spark, "贵州茅台", codes.keyword_secid) == "1.600519"
    periods = spark.createDataFrame([(240,), (1200,), (7200,), (9999,)], "m int").select(codes.period_code(F.col("m")).alias("c"))
    assert [r["c"] for r in periods.collect()] == [101, 102, 103, 101]


def test_clean(spark):
    assert one(spark, "ﬁ  x\r\n\r\n\r\n y\x07\tz ", X.clean) == "fi x\n\ny z"
    assert one(spark, None, X.clean) == "" and one(spark, "  \n ", X.clean) == ""


def test_sentences_and_json(spark):
    assert one(spark, "甲。乙！ c. d", X.sentences) == ["甲。", "乙！", "c.", "d"]
    assert one(spark, 'a {"x": {"y": 1}} b', X.extract_json) == '{"x": {"y": 1}}'
    assert one(spark, "none", X.extract_json) == "{}"
    assert one(spark, '{"passed": "true"}', lambda c: X.strict_true(c, "passed")) is False
    assert one(spark, '{"passed": true}', lambda c: X.strict_true(c, "passed")) is True


def slow_fingerprint(text):
    if not text or not text.strip():
        return 0
    m64 = (1 << 64) - 1
    votes = [0] * 64
    units = text.encode("utf-16-le")
    units = [units[i] | units[i + 1] << 8 for i in range(0, len(units), 2)]
    for a, b in zip(units, units[1:]):
        h = 0xCBF29CE484222325
        for u in (a, b):
            h = (h ^ u) * 0x100000001B3 & m64
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m64
        h ^= h >> 31
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    x = sum(1 << k for k in range(64) if votes[k] > 0)
    return x - (1 << 64) if x >> 63 else x


def test_simhash_is_the_slow_one():
    random.seed(1)
    for t in [None, "", "  ", "a", "ab", "贵州茅台业绩稳健，建议关注", "x" * 500, "".join(chr(random.randrange(32, 40000)) for _ in range(300)).replace("\ud800", ""), "a😀b😀"]:
        assert P.fingerprint(t) == slow_fingerprint(t)


def test_near_pairs_are_all(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(-(2**62), 2**62, 60).tolist()
    fps += [f ^ 1 << int(k) for f, k in zip(fps[:20], rng.integers(0, 60, 20))] + [0]
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = {tuple(r) for r in P.near_pairs(df, 5).collect()}
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(i, j, dist(fps[i], fps[j])) for i in range(len(fps)) for j in range(i + 1, len(fps)) if fps[i] and fps[j] and dist(fps[i], fps[j]) <= 5}
    assert got == want and len(want) >= 20


def test_chunks():
    text = "".join(f"Sentence number {i}. " for i in range(120))
    got = P.chunks(text, 100, 0.2)
    assert len(got) > 1 and all(n >= 100 for _, n in got[:-1])
    assert got[0][0].endswith(".") and got[1][0].split(".")[0] in got[0][0]  # overlap
    assert P.chunks(None) == [] and P.chunks("  ") == []
    assert len(P.chunks("a" * 5000 + ".", 10)) == 1


def test_fit_window():
    r = [("r1", "USER_QUERY", 7, 10), ("r2", "ASSISTANT_ANSWER", 9, 15), ("r3", "ASSISTANT_ANSWER", 5, 10)]
    assert M.fit_window([("a", "USER_QUERY", 7, 500), *r[1:]], 10, 20)[0] == [0]
    assert M.fit_window(r, 25, 20) == ([0, 1], 25, 0)
    many = [(str(k), "ASSISTANT_ANSWER", 5, 1) for k in range(10)] + [("q", "USER_QUERY", 7, 1)]
    kept, used, dropped = M.fit_window(many, 100, 3)
    assert kept == [8, 9, 10] and used == 11 and dropped == 8
    assert M.fit_window([], 10, 3) == ([], 0, 0)


def test_profile():
    p = M.Profile({})
    assert p.apply("风险", "稳健", 0) == ("set", "risk_preference", "稳健")
    assert p.apply("risk", "非常激进", 1) == ("conflict", "risk_preference", "激进")
    assert p.hear("确认", [], 2) == [("confirmed", "risk_preference", "激进")] and p.values["risk_preference"] == "激进"
    assert p.apply("风险偏好", "随便买买", 3)[0] == "refused"
    p.apply("风险", "保守", 4)
    assert p.hear("确认", [], 4 + 7201) == [] and p.values["risk_preference"] == "激进"


def test_importance(spark):
    rows = [("user", "分析一下贵州茅台", 9, "USER_QUERY"), ("user", "好", 0, "NOISE"), ("assistant", "加载中", 0, "NOISE"), ("assistant", "无法分析", 3, "ASSISTANT_ANSWER"), ("assistant", "【综合】得分：78", 9, "ASSISTANT_ANSWER"), ("TOOL", "x y", 5, "TOOL_OBSERVATION"), (None, None, 0, "NOISE")]
    df = spark.createDataFrame(rows, "role string, text string, want int, kind string").select(M.importance(F.col("role"), F.col("text")).alias("s"), "want", "kind")
    assert all(r["s"]["importance"] == r["want"] and r["s"]["kind"] == r["kind"] for r in df.collect())


def test_admission_and_facts(spark):
    answer = "【综合】得分：78，看多，信心：中。" + "技术面良好。" * 12 + "建议持有"
    df = spark.createDataFrame([(answer, 1), (answer, 0), ("短", 1), ("分析已停止" + "x" * 80, 1), ("x" * 80, 1), (None, 1)], "a string, n int")
    got = [r["a"]["reason"] for r in df.select(M.admission(F.col("a"), F.col("n")).alias("a")).collect()]
    assert got == ["accepted", "no observations", "short", "aborted", "no conclusion", "empty"]
    facts = df.limit(1).select(*M.conclusion_facts(F.col("a"))).first()
    assert (facts["score"], facts["direction"], facts["confidence"], facts["summary"]) == ("78", "看多", "中", "建议持有")
    assert df.limit(1).select(M.ttl_hours(F.col("a")).alias("t")).first()["t"] == 24


def test_vector_topk_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERIES", 5)
    monkeypatch.setattr(R, "TILE", 16)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8)).round(3)
    v[5] = v[9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    q = df.where("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "vector").unionByName(spark.createDataFrame([(99, None), (98, [1.0])], "query_id long, vector array<double>"))
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in R.vector_topk(q, df, 7).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(12):
        score = np.floor((unit @ unit[i] + 1) / 2 * 1e6 + 0.5) / 1e6
        want = sorted(range(200), key=lambda k: (-score[k], k))[:7]
        assert [got[i, r] for r in range(1, 8)] == want
    assert not any(k in (98, 99) for k, _ in got)


def test_vector_ties_go_to_the_smaller_id(spark):
    """Two scores that are equal to six decimals only: k = 1 takes the smaller id."""
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 1e-5]), (3, [0.0, 1.0])], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["chunk_id"], r["score"]) for r in R.vector_topk(q, df, 1).collect()] == [(1, 1.0)]
    many = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)], "chunk_id long, vector array<double>")
    assert [r["chunk_id"] for r in R.vector_topk(q, many, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert R.vector_topk(q, many.limit(0), 3).count() == 0 and R.vector_topk(q.limit(0), many, 3).count() == 0


def test_index_is_searched_as_the_corpus(spark, tmp_path):
    from tickloom.sources import sinks

    docs = [(0, "the cat sat"), (1, "a dog sat sat"), (2, None), (3, "cat of the old house")]
    corpus = spark.createDataFrame(docs, "chunk_id long, content string")
    q = spark.createDataFrame([(0, "cat cat sat"), (1, " "), (2, None), (3, "new dog")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    path = str(tmp_path / "index")
    sinks.write_index(corpus, path)
    assert rows(R.index_search(q, path)) == rows(R.bm25_topk(q, corpus))
    more = spark.createDataFrame([(4, "new cat"), (1, "a new dog")], "chunk_id long, content string")
    sinks.write_index(more, path, add=True)
    assert rows(R.index_search(q, path)) == rows(R.bm25_topk(q, corpus.where("chunk_id <> 1").unionByName(more)))
    sinks.clear_index(spark, path)
    assert not sinks.exists(spark, path) and not sinks.exists(spark, path + "-chunks")


def test_hits_without_an_entry_stay(spark):
    from datetime import datetime

    v = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    entries = spark.createDataFrame([(1, "c", "n", "text of one", datetime(2024, 1, 1))], "chunk_id long, stock_code string, stock_name string, content string, created_at timestamp")
    got = {r["chunk_id"]: r["score"] for r in R.retrieve(v, v.limit(0), entries, F.lit(datetime(2024, 1, 2))).collect()}
    assert got == {1: 1.05, 2: 0.35}


def test_context_rows_and_rules(spark):
    kinds = "chunk_id long, stock_code string, stock_name string, content string, category string, source string, token_count int"
    entries = spark.createDataFrame([(1, "GENERAL", "g", "rule one", "k", "s", 3), (2, "c", "n", "fact", "k", None, 4), (3, "GENERAL", "g", "rule two", "k", "s", 5)], kinds)
    hits = lambda *ids: spark.createDataFrame([(0, c, k + 1) for k, c in enumerate(ids)], "query_id long, chunk_id long, rank int")
    both = R.knowledge_context(hits(3, 1), hits(2), entries).first()["context"]
    assert both == "【通用规则】\n[通用1] rule two\n[通用2] rule one\n\n【参考知识】\n[引用1] n(c) | 类别:k | 来源: | fact\n"
    assert R.knowledge_context(hits(1), hits(2).limit(0), entries).first()["context"] == "【通用规则】\n[通用1] rule one\n\n"
    fused = spark.createDataFrame([(0, 2, 0.5, 1), (0, 9, 0.4, 2)], "query_id long, chunk_id long, final_score double, final_rank int")
    rows = R.retriever_rows(fused, entries).orderBy("ref_id").collect()
    assert [(r["ref_id"], r["source"], r["token_count"]) for r in rows] == [("REF-1", "", 4), ("REF-2", "", 0)]
    assert rows[0]["text"] == "[REF-1]\nchunk_id: 2\nsource: \ntext: fact"
    assert {r["chunk_id"] for r in R.general_rules(entries).collect()} == {1, 3}
    assert {r["chunk_id"] for r in R.delete_entries(entries, spark.createDataFrame([(2,), (3,)], "chunk_id long")).collect()} == {1}


def _backwards(query, texts, n):
    if query == "fail":
        raise OSError("down")
    return [(k, float(k)) for k in range(len(texts))] + [(99, 5.0)] if query != "none" else []


def test_reranker_and_embedder(spark):
    rows = [(q, t, c, f"text {c}", 1.0 / c) for q, t in ((0, "ok"), (1, "fail"), (2, "none"), (3, " ")) for c in (1, 2, 3)]
    hits = spark.createDataFrame(rows, "query_id long, query string, chunk_id long, content string, final_score double")
    got = {q: [r["chunk_id"] for r in R.rerank_with(hits, _backwards, 2).where(F.col("query_id") == q).orderBy("final_rank").collect()] for q in range(4)}
    assert got == {0: [3, 2], 1: [1, 2], 2: [1, 2], 3: [1, 2]}
    docs = spark.createDataFrame([("ab",), (None,), ("c",)], "content string")
    assert [r["vector"] for r in R.embedded(docs, lambda ts: [[float(len(t))] for t in ts]).collect()] == [[2.0], None, [1.0]]


def test_near_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 7)
    rng = np.random.default_rng(4)
    fps = rng.integers(-(2**62), 2**62, 30).tolist()
    fps += [f ^ 1 << int(k) for f, k in zip(fps[:20], rng.integers(0, 60, 20))] + fps[:5] + [0, 0]
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in P.near_links(spark.createDataFrame(list(enumerate(fps)), "id long, fp long"), 5).collect()}
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for k, f in enumerate(fps):
        assert got[k] == (fps.index(f), fps.count(f), sum(0 < far(f, g) <= 5 for g in set(fps) - {0}) if f else 0)


def test_bm25(spark):
    docs = ["the cat sat", "a dog sat sat", None, "猫 cat"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, content string")
    q = spark.createDataFrame([(0, "cat cat sat"), (1, " "), (2, None)], "query_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in R.bm25_topk(q, corpus).where("query_id = 0").collect()}
    toks = [["the", "cat", "sat"], ["a", "dog", "sat", "sat"], None, ["猫", "cat"]]
    own = [t for t in toks if t]
    mean = sum(map(len, own)) / 3
    for i, t in enumerate(toks):
        if t:
            s = 0
            for term, n in (("cat", 2), ("sat", 1)):
                df = sum(term in x for x in own)
                tf = t.count(term)
                s += n * math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            assert abs(got.get(i, 0) - s) < 2e-6
    assert R.bm25_topk(q.where("query_id > 0"), corpus).count() == 0


def test_cache_replay_runs(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = [0, 10, 29, 30, 45, 200]
    df = spark.createDataFrame([("k", t0 + timedelta(seconds=s), i) for i, s in enumerate(at)], "key string, ts timestamp, id long")
    got = [r["hit"] for r in ops.cache_replay(df, F.lit(30)).orderBy("id").collect()]
    assert got == [False, True, True, False, True, False]


def test_round_guard_and_duplicates(spark):
    from datetime import datetime

    df = spark.createDataFrame([(1, k, "t", "p", datetime(2024, 1, 1)) for k in range(9)], "request_id long, call_id long, tool string, param string, ts timestamp")
    assert [r["call_id"] for r in ops.round_guard(df).where("stopped").orderBy("call_id").collect()] == [7, 8]
    assert ops.duplicate_calls(df).where("duplicate").count() == 8


def test_suggestions(spark):
    text = "建议1: 买\n【规范依据】规则A\n【原文片段】片段\n【引用ID】REF-1\n建议2: 卖\n【规范依据】规则B"
    rows = relational.suggestions(spark.createDataFrame([(1, text), (2, None), (3, "x")], "id long, text string")).orderBy("no").collect()
    assert [(r["no"], r["basis"], r["evidence"], r["ref_id"]) for r in rows] == [(1, "规则A", "片段", "REF-1"), (2, "规则B", "", "")]


def test_names_inside_words_at_every_registry_size(spark, monkeypatch):
    from tickloom.operators import search

    texts = spark.createDataFrame([(1, "At last Haanth. It"), (2, "preHaanthic, (Big Corp)"), (3, "corp"), (4, None), (5, "")], "id long, text string")
    names = spark.createDataFrame([("Haanth", "c1"), ("Big Corp", "c2"), ("g C", "c3"), ("absent", "c4"), (None, "c5"), ("", "c6"), ("Haanth", "c7")], "name string, code string")
    for block, characters in ((10, 10**6), (2, 10**6), (10, 5)):  # an automaton, and twice the join
        monkeypatch.setattr(search, "BLOCK", block)
        monkeypatch.setattr(search, "CHARACTERS", characters)
        found = relational.names_in_texts(texts, names)
        assert sorted(map(tuple, found.collect())) == [(1, "Haanth", "c1"), (1, "Haanth", "c7"), (2, "Big Corp", "c2"), (2, "Haanth", "c1"), (2, "Haanth", "c7"), (2, "g C", "c3")]


def test_automaton_and_plain_search_agree(monkeypatch):
    import sys

    from tickloom.operators import search

    needles, text = ["ab", "abc", "bc", "c d", "x"], "abc abd bc d"
    fast = {n for _, n in search._automaton(needles).iter(text)}
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert {n for _, n in search._automaton(needles).iter(text)} == fast == {"ab", "abc", "bc", "c d"}


def test_search_by_rarest_grams(spark, monkeypatch):
    """The join against str.find: short and long strings, other alphabets, common grams that are spread,
    repeated ids, texts cut into pieces, and a bitmap that is full."""
    from tickloom.operators import search

    rng = random.Random(10)
    needles = ["a", "ab", "the", "the cat", "the cat sat on the mat and slept", "数据", "数据处理引擎", "\U0001f600", "zzzzz", " ", "nowhere at all", "", None]
    needles += ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [(k, "".join(rng.choice("abc the\n") for _ in range(rng.randrange(80)))) for k in range(150)]
    texts += [(500, "xx the cat sat on the mat and slept"), (500, "大数据处理引擎 \U0001f600\U0001f600"), (501, None), (None, "the cat"), (502, ""), (503, "the cat" * 50)]
    want = {(i, n) for i, t in texts for n in needles if n and t and n in t and i is not None}
    df, own = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    for common, at_once in ((10**6, 1 << 22), (5, 16)):
        monkeypatch.setattr(search, "COMMON", common)
        monkeypatch.setattr(search, "AT_ONCE", at_once)
        assert {tuple(r) for r in search.joined(df, own).collect()} == want
    monkeypatch.setattr(search, "_bitmap", lambda grams: np.full(search.BITS // 8, 255, np.uint8))
    assert {tuple(r) for r in search.joined(df, own).collect()} == want


def test_search_makes_no_candidates_of_common_grams(spark, monkeypatch):
    """Texts that hold all runs of 5 characters of the strings, and no string but one: nothing else is shuffled."""
    from tickloom.operators import search

    seen = []
    monkeypatch.setattr(search, "_short", lambda rows, needles, sizes, own=search._short: seen.append(own(rows, needles, sizes)) or seen[-1])
    needles = ["".join("abcdefghij"[(k + j) % 10] for j in range(6 + k)) for k in range(10)]
    grams = {n[k : k + 5] for n in needles for k in range(len(n) - 4)}
    df = spark.createDataFrame([(k, " ".join(sorted(grams)) + (needles[0] if k == 7 else "")) for k in range(50)], "id long, text string")
    got = search.joined(df, spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert [tuple(r) for r in got.collect()] == [(7, needles[0])]
    whole, begun = (search._bitmap(spark.createDataFrame([(n,) for n in needles], "needle string").mapInArrow(search._marks, "whole boolean, gram long").where(c)) for c in ("whole", "not whole"))
    text = " ".join(sorted(grams))
    assert seen and not any(len(at) for at, _ in search._candidates(search._points(text), len(text), sorted(set(map(len, needles))), whole, begun))


def test_search_for_300_000_names(spark):
    """No name is collected: the join alone, each text against the names that were put into it."""
    from tickloom.operators import search

    names = spark.range(300_000).select(F.concat(F.lit("name"), F.sha1(F.col("id").cast("string"))).alias("needle"), "id")
    put = lambda k: F.concat(F.lit("name"), F.sha1(k.cast("string")))
    texts = spark.range(400).select("id", F.concat(F.lit("before "), put(F.col("id") * 700), F.lit(" between "), put(F.col("id") * 749), F.lit("x")).alias("text"))
    found = search.contained(texts, names.select("needle")).join(names.withColumnRenamed("id", "of"), "needle").select("id", "of").collect()
    assert sorted(map(tuple, found)) == sorted({(k, of) for k in range(400) for of in (700 * k, 749 * k)})


def test_a_registry_of_many_names(spark):
    """Over 10,000 names, many of them inside others and inside words, against str.find."""
    rng = random.Random(9)
    names = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 10))) for _ in range(16_000)})
    texts = [(k, " ".join("".join(rng.choice("abcd") for _ in range(12)) for _ in range(6))) for k in range(40)]
    found = relational.names_in_texts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n, n) for n in names], "name string, code string"))
    want = {(k, n) for k, t in texts for n in names if n in t}
    assert len(names) > 10_000 and {(r["id"], r["name"]) for r in found.collect()} == want and len(want) > 1000


def test_near_dup_pairs_reach_the_whole_radius(spark, sf_dir):
    from tickloom.plans import texts as plans

    fps = Counter(r["fp"] for r in plans.simhash(spark, sf_dir).collect())
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    got = plans.near_dup_pairs(spark, sf_dir).collect()
    assert len(got) == sum(fps.values())
    for r in got:
        assert r["copies"] == fps[r["fp"]] and r["links"] == (sum(0 < far(r["fp"], f) <= 22 for f in fps if f) if r["fp"] else 0)
    assert max(r["links"] for r in got) > 10
