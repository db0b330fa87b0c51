"""The pipeline's stages against plain Python over the smallest documents."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_native import WORD, plain_base
from tests.llm.test_python import classes, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:5])


def test_quality_exact_and_near(stages):
    first, kept, exact, near = stages[:4]
    want = {r.doc_id for r in first.itertuples() if not plain_base(r.text)[5]}
    assert set(kept.doc_id) == want  # no host has a line above the limit here
    groups = defaultdict(list)
    for r in kept.itertuples():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text)].append(r.doc_id)
    assert set(exact.doc_id) == {min(g) for g in groups.values()}
    rows = exact.sort_values("doc_id")
    label = classes([plain_fingerprint(t) for t in rows.text], 2)
    assert set(near.doc_id) == {rows.doc_id.iloc[k] for k in set(label)}


def test_mix_and_packing(stages):
    near, mixed, packed = stages[3:]
    words = Counter()
    for r in mixed.itertuples():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    total = sum(len(WORD.findall(t)) for t in near.text)
    assert abs(sum(words.values()) - 1.5 * total) <= len(words) and set(mixed.doc_id) <= set(near.doc_id)
    assert max(Counter(mixed.doc_id).values()) <= 2
    assert packed.groupby(["doc_id", "copy"]).ngroups == len(mixed)
    assert (packed.groupby(["doc_id", "copy"]).length.sum() == packed.groupby(["doc_id", "copy"]).doc_tokens.first()).all()


def test_run_is_the_stages(spark, sf_dir, stages):
    cols = list(stages[-1].columns)
    got = corpus_pipeline.run(spark, sf_dir).toPandas()[cols]
    key = ["doc_id", "copy", "start"]
    assert got.sort_values(key).reset_index(drop=True).equals(stages[-1].sort_values(key).reset_index(drop=True))


def test_odd_rows(spark):
    """Nulls, empty texts, repeats, repeated ids and clashing columns through all stages; and no rows."""
    from tests.llm.test_native import DOCS, fixture

    rows = [(i, t, l, s, n) for i, t, l, s, n in fixture(3, 40)]
    own = " ".join(f"w{k}" for k in range(80))
    rows += [(900, own, "en", "a", 1), (900, own, "en", "a", 1), (900, own.replace("w", "v"), "en", "a", 1), (None, own.replace("w", "u"), None, None, None), (901, own + "\n", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("h", "kept", "fp", "copy", "rule", "taken", "_row")})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, None)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "simhash near-dedup":
            assert Counter(r["doc_id"] for r in kept.collect())[900] == 2 and 901 not in {r["doc_id"] for r in kept.collect()}
            assert any(r["doc_id"] is None for r in kept.collect())
    assert corpus_pipeline.STAGES[4][1](spark, kept, None).count() >= kept.count() > 3
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, None).count() == 0
