"""Mixing, exact dedup, URL filters, quality rules and components against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, mixing, quality, url_filter
from tickloom.llm.common import prefix_sums
from tickloom.llm.components import components
from tickloom.llm.oracles import oracle_sql
from tickloom.llm.queries import queries
from tests.conftest import rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fixture(seed=0, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 6)))
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "ü", None, ""]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n", "en", "a", 3), (n + 3, "x " * 60_000, "en", "b", 1), (n + 4, rows[3][1], "en", "b", 1), (n + 5, rows[3][1].replace(" ", "  "), "en", "c", 1), (n + 6, "é\x1cü\x85 z", "fr", "c", 1)]
    return rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    found, want = queries()[name](spark, sf_dir).toPandas(), duck.sql(oracle_sql()[name]).df()
    want = want.astype({c: found[c].dtype for c in found.columns})
    assert rows_of(found) == rows_of(want)


def level(sizes, weights, total, most):
    """Deal total by weight; what is over a cap goes to the others, again and again."""
    target, capped = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **share}
        capped |= over


@pytest.mark.parametrize("share,most", [(1.5, 2.0), (0.4, 2.0), (1.9, 2.0), (3.5, 4.0)])
def test_mixing(spark, share, most):
    rows = fixture()
    got = mixing.plan(spark.createDataFrame(rows, DOCS), share=share, most=most).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = level(sizes, weights, share * sum(sizes.values()), most)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= r["size"] * -(-most // 1)
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.5001 for s in sizes)
    again = mixing.plan(spark.createDataFrame(rows[::-1], DOCS).repartition(5), share=share, most=most)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mix_rows(spark):
    rows = fixture() + [(3, "r s t", "en", "a", 5)] * 2 + [(None, "p q", "en", None, 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("own")).withColumn("_w", F.lit(1))
    plan = mixing.plan(df)
    out = mixing.mix(df)
    assert out.columns == df.columns
    words, texts = Counter(), defaultdict(list)
    for i, t, _, s, _ in rows:
        texts[i, s].append(t)
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"], r["source"]] if t)  # a cut text ends after a word
    want = Counter()
    for r in plan.collect():
        if r["taken"]:
            want[r["doc_id"], r["source"]] += r["taken"]
    assert words == want


def test_exact_dedup(spark):
    rows = fixture()
    rows = [(i, t) for i, t, *_ in rows] + [(3, rows[3][1]), (None, rows[3][1]), (None, "only"), (None, "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(7)).withColumn("h", F.lit("x"))
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.classes(df).collect()
    assert Counter(map(tuple, exact_dedup.classes(df, small=0).collect())) == Counter(map(tuple, got))  # copies dealt by hash
    want = Counter()
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, first, len(ids), i == first, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    assert sorted(norm(r["text"]) for r in out.collect()) == sorted(groups)
    assert sorted(norm(r["text"]) for r in exact_dedup.dedup(df, small=0).collect()) == sorted(groups)


def test_dedup_survives_hash_collisions(spark, monkeypatch):
    """With a hash of one value for all, bytes still tell the texts apart."""
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("0"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(df).collect()}
    assert got == {1: (1, 2, True), 2: (2, 2, True), 3: (1, 2, False), 4: (4, 1, True), 5: (2, 2, False)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert set(got) == set(parent)
    pair = {}
    for n in parent:
        assert pair.setdefault(root(n), got[n]) == got[n]
    assert len(set(pair.values())) == len(pair)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGES = "page_id long, url string, html string"


def test_url_filter(spark):
    link = lambda u: f'<HTML><head><LINK href="{u}" rel="canonical"></head>'
    pages = [
        (1, "http://a.example.net/x", None),  # blocked by net/
        (2, "https://blog.org/p?q#f", link("http://a.example.net/x")),  # alias of a blocked page
        (3, "https://blog.org/fr/p", link("http://a.example.net/x")),  # explicitly allowed alias
        (4, "https://c.org/z", '<meta http-equiv="refresh" content="0; url=https://blog.org/p?q">'),  # alias of the alias
        (5, "https://EXAMPLE.net/en/a", ""),
        (6, "HTTP://example.COM/de/", ""),
        (7, "https://notexample.com/de/", link("/other")),
        (8, None, link("http://a.example.net/x")),
        (9, "no scheme", None),
        (10, "x://badnet/", link("https://clean.org/")),
        (11, "https://d.org/", link("https://evil.example.net/q")),  # target is no page of its own
        (12, "https://d.org/", None),
        (12, "https://d.org/", None),
        (13, "ftp://u.net?x://y/z", None),
        (14, "https://e.org/1", None),
        (15, "https://f.org", link("HTTPS://Evil.Example.NET/q#top")),  # the same address as 11's target
        (16, "HTTPS://F.org/", None),
        (17, "https://f.org/?a", None),
    ]
    df = spark.createDataFrame(pages, PAGES).withColumn("host", F.lit("own")).withColumn("verdict", F.lit(1))
    got = defaultdict(list)
    for r in url_filter.judge(df, redirects=spark.createDataFrame([("https://e.org/1#x", "https://c.org/z"), (None, "q")], "src string, dst string")).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.example.net", "/x", "net/", "block")]
    assert got[2] == [("blog.org", "/p", None, "block")]
    assert got[3] == [("blog.org", "/fr/p", "org/fr/", "allow")]
    assert got[4] == [("c.org", "/z", None, "block")]
    assert got[5] == [("example.net", "/en/a", "example.net/en/", "allow")]
    assert got[6] == [("example.com", "/de/", "example.com/de/", "block")]
    assert got[7][0][2:] == (None, "allow") and got[8] == [("", "", None, "allow")] and got[9] == [("", "", None, "allow")]
    assert got[10] == [("badnet", "/", None, "allow")]
    assert got[11][0][3] == "block" and got[12] == [("d.org", "/", None, "block")] * 2
    assert got[13] == [("u.net", "", None, "allow")] and got[14][0][3] == "block"
    assert got[15][0][3] == "block" and got[16][0][3] == "block" and got[17][0][3] == "allow"
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_url_filter_hubs_and_chains(spark):
    """A blocked hub of many aliases, long chains of redirects, and islands, by a redirect table."""
    hub = [("https://bad.net/", f"https://a{k}.org/x") for k in range(20_000)]
    chain = [(f"https://c.org/{k}", f"https://c.org/{k + 1}") for k in range(500)] + [("https://c.org/500", "https://x.net/")]
    free = [(f"https://d.org/{k}", f"https://d.org/{k + 1}") for k in range(500)]
    urls = [u for _, u in hub] + [u for u, _ in chain] + [u for u, _ in free] + ["https://a7.org/fr/x"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    redirects = spark.createDataFrame(hub + chain + free + [("https://bad.net/", "https://a7.org/fr/x")], "src string, dst string")
    found = url_filter.judge(pages, redirects=redirects).groupBy("rule", "verdict").count().collect()
    assert {(r["rule"], r["verdict"]): r["count"] for r in found} == {(None, "block"): 20_501, (None, "allow"): 500, ("org/fr/", "allow"): 1}


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for k in range(3)}
    full = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_url_filter_compiles(spark, sf_dir):
    """No plan is too long to be compiled, and equal answers come with nodes sent and with nodes copied."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    moved = spark.createDataFrame([(r["url"], f"https://x.net/{k % 3}") for k, r in enumerate(pages.where("url is not null").limit(40).collect())], "src string, dst string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        first = sorted(map(str, url_filter.judge(pages, redirects=moved).collect()))
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    old, url_filter.FEW = url_filter.FEW, 0
    try:
        assert sorted(map(str, url_filter.judge(pages, redirects=moved).collect())) == first
    finally:
        url_filter.FEW = old


def test_hub_of_a_million_edges(spark):
    """Edges of a hub are not sent to one task; the last ones may be joined by one, with the same classes."""
    hub = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    more = spark.range(2_000_000, 2_000_500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    for finish in (0, 10_000):
        found = components(hub.unionByName(more), finish).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
        assert sorted((r["least"], r["n"]) for r in found.collect()) == [(0, 1_000_001), (2_000_000, 501)]


def test_quality(spark):
    rng = random.Random(7)
    rows = [(i, t) for i, t, *_ in fixture(2)] + [(500, "a b c a b c <tag> #&|"), (501, "x\ny\nx\nx\n \n"), (502, "𝒳 é\u2003ü " * 30)]
    rows = [(i, t, "h1") for i, t in rows]
    common = "Click here   to SHARE this page with all of your very good friends now please"
    for k in range(40):
        own = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
        rows.append((1000 + k, common + "\n" + own, "h2"))
        rows.append((2000 + k, "\n".join([common] * 5 + [" ".join(own.split()[:20] + [str(k)])]), "h2"))
    rows += [(3000 + k, "copied text " + " ".join(f"c{j}" for j in range(70)), "h3") for k in range(50)] + [(3000, "copied text " + " ".join(f"c{j}" for j in range(70)), "h3")]
    rows += [(None, None, None), (4000, common.lower() + "\n" + " ".join(f"z{j}" for j in range(60)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rule", F.lit("own")).withColumn("kept", F.lit("own"))
    limits = quality.Limits(line_docs=20, line_share=0.1)
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    docs_of, all_docs = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        all_docs[s].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                docs_of[s, norm(x)].add(t)
    bad = {k for k, d in docs_of.items() if len(d) > 20 and len(d) > 0.1 * len(all_docs[k[0]])}
    assert bad == {("h2", norm(common))}
    want, clean = Counter(), Counter()
    for i, t, s in rows:
        b = plain_base(t)
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (s, norm(x)) in bad)
        kept = not b[5] and lost <= 0.5 * b[0]
        want[(i, *b, lost, kept)] += 1
        if kept:
            clean[i, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in bad)] += 1
    facts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept"]
    got = quality.judge(df, limits).select(*facts).collect()
    assert Counter(map(tuple, got)) == want
    out = quality.clean(df, limits)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == clean
    assert {r["rule"] for r in out.select("rule").collect()} == {"own"}
    # Hosts with more frequent lines than every task may get go the other way, with the same result.
    assert Counter(map(tuple, quality.judge(df, limits, small=0).select(*facts).collect())) == want
    assert Counter((r["doc_id"], r["text"]) for r in quality.clean(df, limits, small=0).collect()) == clean


def test_a_share_of_a_host_is_judged_alike_at_every_size(spark):
    """By the default limits: a line in 13 % of 60 or 800 texts goes, as does one in all of 20; one in 5 stays."""
    own = lambda h, k: " ".join(f"{h}{k}w{j}" for j in range(60))
    rows = []
    for host, n, have in (("small", 60, 8), ("large", 800, 104), ("all", 20, 20), ("few", 20, 5), ("rare", 800, 16)):
        rows += [(len(rows) + k, ("share this page\n" if k < have else "") + own(host, k), host) for k in range(n)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("n_removed > 0")
    assert {r["source"]: r["count"] for r in found.groupBy("source").count().collect()} == {"small": 8, "large": 104, "all": 20}


def test_prefix_sums(spark):
    rows = [(k % 7, k, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, c double").repartition(6)
    got = prefix_sums(df, [F.col("a"), F.col("b")], {"n": "1", "s": "c"}).collect()
    run = 0.0
    for k, (a, b, c) in enumerate(sorted(rows)):
        r = next(x for x in got if (x["a"], x["b"]) == (a, b))
        assert r["n"] == k and r["s"] == run
        run += c


@pytest.mark.parametrize("run", [mixing.plan, mixing.mix, exact_dedup.classes, exact_dedup.dedup, quality.judge, quality.clean])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0
