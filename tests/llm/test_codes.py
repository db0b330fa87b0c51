"""Vector codes against plain Lloyd in whole Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import vector_codes
from tickloom.llm.queries import queries


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows of (id, vector, label) → ({row: (code, error)}, codebooks)."""
    kept = [(k, v) for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = {k: [math.floor(scale * x) for x in v] for k, v in kept}
    width = -(-max(map(len, whole.values()), default=0) // parts) * parts
    whole = {k: v + [0] * (width - len(v)) for k, v in whole.items()}
    per = width // parts
    first = sorted(whole, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, np.array(whole[k], "<i4").tobytes().hex()))[:entries]
    books = [[whole[k][p * per : (p + 1) * per] for k in first] for p in range(parts)]

    def assign():
        out = {}
        for k, v in whole.items():
            own = [v[p * per : (p + 1) * per] for p in range(parts)]
            out[k] = [min((sum((a - b) ** 2 for a, b in zip(own[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [whole[k][p * per : (p + 1) * per] for k in whole if at[k][p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return {k: ("".join(f"{e:02x}" for _, e in x), sum(d for d, _ in x)) for k, x in assign().items()}, books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def check(spark, rows, **kw):
    want, books = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows], **kw)
    found = vector_codes.compress(table(spark, rows).withColumns({c: F.lit("own") for c in ("id", "code", "part", "_key", "n")}), **kw)
    assert [b.tolist() for b in found.codebooks] == books
    got = vector_codes.with_label_error(found.rows).collect()
    sums = {}
    for k, (_, e) in want.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + e
    assert sorted(map(str, ((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got))) == sorted(str((rows[k][0], rows[k][2], c, e, sums[rows[k][2]])) for k, (c, e) in want.items())
    return found


def test_plain_lloyd_with_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(k % 7, 0.3) for _ in range(8)], k % 5 if k % 4 else None) for k in range(300)]
    rows += [(5, rows[5][1], 5), (5, rows[6][1], 1), (None, rows[7][1], 2), (400, None, 1), (401, [1.0] * 7 + [None], 1), (402, [float("nan")] * 8, 1), (403, [float("-inf")] * 8, 1), (404, [0.5, -0.5], None), (405, [], 3)]
    found = check(spark, rows)
    again = vector_codes.compress(table(spark, rows[::-1]))
    assert again.digest() == found.digest() == hashlib.sha256(",".join(str(x) for b in found.codebooks for c in b for x in c).encode()).hexdigest()
    check(spark, rows, entries=9, rounds=6)
    check(spark, rows[:3])
    check(spark, [(k, [1.5, -2.5, 0.0, 3.0], 1) for k in range(40)], entries=4)  # ties: equal entries, the first is nearest


def test_large_components(spark):
    """Where doubles are not exact whole numbers are compared; and beyond what those hold, an error."""
    rng = random.Random(3)
    check(spark, [(k, [rng.uniform(-60000, 60000) for _ in range(8)], 0) for k in range(60)], entries=5)
    with pytest.raises(Exception, match="not exact"):
        vector_codes.compress(table(spark, [(1, [1e30] * 4, 0)])).rows.collect()


def test_empty_and_decoded(spark):
    none = vector_codes.compress(table(spark, [(1, None, 1)]))
    assert vector_codes.with_label_error(none.rows).count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    rows = [(k, [k / 4, 1.0, 2.0, 3.0], 0) for k in range(8)]
    found = vector_codes.compress(table(spark, rows))
    for r in found.rows.collect():
        assert r["error"] == 0 and vector_codes.decoded(r["code"], found.codebooks).tolist() == rows[r["id"]][1]


def test_later_rounds_move_less(spark, sf_dir, monkeypatch):
    """What a round shuffles is contributions of parts whose entry changed, a few rows a task."""
    seen = []
    inner = vector_codes.cut

    def watched(df):
        out = inner(df)
        if df.columns == ["part", "entry", "at", "x"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(vector_codes, "cut", watched)
    queries()["op13_vector_codes"](spark, sf_dir).collect()
    assert len(seen) <= 4 and all(n <= 4 * 256 * 17 for n in seen)
