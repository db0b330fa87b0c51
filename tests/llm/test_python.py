"""Line dedup, packing, licenses, token ids, SimHash and toxicity against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import binary_output, idcoder, licenses, line_dedup, packing, simhash, tokens, toxicity
from tickloom.llm.queries import queries

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n", " \n\n  x ", "don't  it's \x1c\x1d y", "a\u00a0b c", "\u0301 a", "e \u0301x", "<|endoftext|> a <|endoftext|>.", "1 2  33.", "ΑΣ. ΑΣ,", "x.y z.. q.,", "é́. ́.", "a\x85 b", "it's. 's.", "a\nb", "a.\nb, c", "\ta", "a\tb", "Iİ İ.", "café, ÉTÉ.", "ǅ Ǆx", "— dash… “q”", "\U0001f600 a", "Straße STRASSE.", "x\n\ny", "a \nb", "a\n b", "don't. we'll, I'm", "ªº ʰ", "5a a5 5.", "e\u0301. x", "한국어 텍스트, 中文。"]


def reference(path, end):
    t = Tokenizer.from_file(path)  # as it comes: added tokens' spellings give their ids
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [end]


CHARS = "abcABC  ..,,'\n\t\u00e9\u0301\u03a3 1\u00df\u0130-#"


SPELT = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y <|endoftext|><|endoftext|>", "<|startoftext|> a", "a<|startoftext|>", "<|ENDOFTEXT|> a", "<|endoftext|", "É <|endoftext|> é", "<|endoftext|>  \n b", "a." * 500 + "<|endoftext|>"]


def test_added_tokens_spelt_in_texts():
    """In words, at ends and repeated, as the library's call gives them; here and there in a batch."""
    for path, encode in ((BYTES, lambda ts: [np.frombuffer(tokens.Ranks(BYTES).encode(t), "<u4") for t in ts]), (WORDS, lambda ts: tokens.Words(WORDS).encode_all(pa.array(ts, pa.string())))):
        want = reference(path, 0)
        texts = [t for pair in zip(SPELT, ["plain words"] * len(SPELT)) for t in pair]
        assert [x.tolist() for x in encode(texts)] == [want(t)[:-1] for t in texts]
    assert reference(BYTES, 0)("a <|endoftext|> b") == [64, 220, 50256, 275, 0] and reference(WORDS, 0)("a <|endoftext|> b") == [320, 49407, 321, 0]


def test_word_cache_equals_the_tokenizer():
    want, rng = reference(WORDS, 0), random.Random(0)
    texts = ODD + ["".join(rng.choice(CHARS) for _ in range(rng.randrange(60))) for _ in range(1500)] + [None]
    for most in (10**6, 3):
        own = tokens.Words(WORDS, most)
        for k in range(0, len(texts), 100):  # batch after batch, with a cache that lasts or not
            some = texts[k : k + 100]
            for t, ids in zip(some, own.encode_all(pa.array(some, pa.string()))):
                assert ids.tolist() == want(t)[:-1], repr(t)
    assert own.encode_all(pa.array([], pa.string())) == []


def test_ranks_equal_the_tokenizer():
    """Odd and random texts, runs of one kind, and every code point between others."""
    own, want, rng = tokens.Ranks(BYTES), reference(BYTES, 0), random.Random(1)
    texts = ODD + ["".join(rng.choice(CHARS) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 50_000, " " * 50_000 + "x", "\n" * 5000, "!" * 5000]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}1 {c}{c}. {c}\n" for c in points[k : k + 1000]) for k in range(0, len(points), 1000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want(t)[:-1], repr(t[:60])
    assert own.encode(None) == b""
    with pytest.raises(ValueError):
        tokens.Ranks(WORDS)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def made(n=200, seed=1, most=400):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "Épsilon", "zeta\neta"]) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_packing(spark):
    texts = ODD + made() + ["word " * 9000, None, None]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(3, texts[3]), (None, "null id"), (None, "null id")], "doc_id long, text string"))
    df = df.withColumn("copy", F.lit("own")).withColumn("group", F.lit(1))
    rows = packing.pack(df, BYTES, group=64).collect()
    ids = reference(BYTES, 1)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["copy"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts) + 3
    text_of = dict(enumerate(texts)) | {None: "null id"}
    for (doc, _), ps in by_doc.items():
        own, at = ids(text_of[doc]), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(np.array(own[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(own)
    padding = 0
    for ps in by_bin.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.1 * 2048 * len(by_bin)
    assert packing.pack(docs(spark, []), BYTES).count() == 0


def test_first_fit_is_the_slow_one():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(0, 80))), reverse=True)
        free, want = [], []
        for s in sizes:
            k = next((k for k, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(100)
            want.append((k, 100 - free[k]))
            free[k] -= s
        assert packing.first_fit(sizes, 100) == want


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for ids, v in ((np.zeros(0, int), 5), (np.array([4]), 5), (rng.integers(0, 49408, 3000), 49408), (np.full(70_000, 49407), 49408), (rng.zipf(1.3, 50_000) % 1000, 1000), (np.arange(5000) % 7, 7)):
        block = idcoder.encode(ids, v)
        assert idcoder.decode(block).tolist() == ids.tolist()
    wide = np.empty(30_000, int)  # an id that more others follow than a scale has room for
    wide[0::2], wide[1::2] = 7, np.arange(15_000) + 10
    for ids, v in ((rng.integers(0, 200_000, 60_000), 200_000), (rng.zipf(1.2, 60_000) % 200_000, 200_000), (rng.integers(0, 1 << 22, 2000), 1 << 22), (np.tile(wide, 2), 50_000), (np.zeros(9, int), 1)):
        assert idcoder.decode(idcoder.encode(ids, v)).tolist() == ids.tolist()
    for ids, v in (([5], 5), ([-1], 5), ([0], (1 << 22) + 1)):
        with pytest.raises(ValueError):
            idcoder.encode(np.array(ids), v)
    small = idcoder.encode(np.arange(50_000) % 7, 7)
    assert len(small) < 4000
    for at in (0, 5, 12, 18, len(small) // 2, len(small) - 1):
        bad = bytearray(small)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode(bytes(bad))
    with pytest.raises(ValueError):
        idcoder.decode(small[:-1])


def test_coder_beats_order_0():
    """On ids of real documents, 6.5 bits an id or less where their entropy alone is over 8."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].slice(0, 3000).combine_chunks()
    ids = np.concatenate(tokens.Words(WORDS).encode_all(texts))
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    bits = 8 * len(idcoder.encode(ids, 49408)) / len(ids)
    assert bits < 0.85 * entropy


def test_binary_output(spark, tmp_path):
    texts = ODD + made(60) + [None, "long " * 30_000]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "n"), (2, "again")], "doc_id long, text string")).withColumn("part", F.lit(1)).repartition(7)
    folder = str(tmp_path / "ids")
    binary_output.write(df, WORDS, folder, block=5000)
    assert binary_output.read(spark, folder).count() > 3
    ids, at = reference(WORDS, 2), 0
    want = []
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for doc, t in sorted([(i, t) for i, t in enumerate(texts)] + [(-1, "n"), (2, "again")], key=lambda x: (x[0], hashed[x[1]])):
        own = ids(t)
        want.append((None if doc < 0 else doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, binary_output.documents(spark, folder).collect()), key=lambda r: r[1]) == want
    stream = np.concatenate([idcoder.decode(r["payload"]) for r in binary_output.read(spark, folder).orderBy("part", "block").collect()])
    assert len(stream) == at
    assert binary_output.write_and_read(docs(spark, []), WORDS).count() == 0


def test_binary_output_of_a_crowded_id(spark, tmp_path, monkeypatch):
    """Half of all rows without an id, and many with one: several ranges, in the same order as in one."""
    monkeypatch.setattr(binary_output, "CROWDED", 20)
    df = docs(spark, [f"own {k}" for k in range(100)], 5).unionByName(spark.createDataFrame([(None if k % 3 else 7, f"text {k}") for k in range(300)], "doc_id long, text string"))
    folder, merged = str(tmp_path / "ids"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # so small ranges would be read as one
    try:
        binary_output.write(df, WORDS, folder, block=100)
    finally:
        spark.conf.unset(merged)
    assert binary_output.read(spark, folder).where(F.array_contains(F.transform("doc_ids", lambda x: x.isNull()), True)).select("part").distinct().count() > 1
    ids, at = reference(WORDS, 2), 0
    got = binary_output.documents(spark, folder).orderBy("start").collect()
    for (doc, t), r in zip(df.orderBy("doc_id", F.xxhash64("text"), "text").collect(), got, strict=True):
        own = ids(t)
        assert (r["doc_id"], r["start"], r["ids_crc32"]) == (doc, at, zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_packing_numbers_a_crowded_id(spark):
    rows = [(7, f"text {k % 90}") for k in range(300)] + [(None, "n")] * 40 + [(1, "one")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTES).collect()
    copies = defaultdict(list)
    for r in found:
        copies[r["doc_id"]].append(r["copy"])
    assert {k: sorted(v) for k, v in copies.items()} == {7: list(range(300)), None: list(range(40)), 1: [0]}


# Line dedup -------------------------------------------------------------------------------


def plain_runs(rows, least):
    """The definition, pair by pair: (doc, line) of every run of least words or more that stands at an
    earlier place that it does not overlap."""
    lines = [(d, k, tuple(x.lower().split())) for d, t in sorted(rows) for k, x in enumerate(t.split("\n")) if x.split()]
    gone = set()
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            k = held = 0
            while j + k < len(lines) and lines[i + k][0] == lines[i][0] and lines[j + k][0] == lines[j][0] and lines[i + k][2] == lines[j + k][2]:
                if lines[i][0] == lines[j][0] and i + k >= j:
                    break
                held += len(lines[j + k][2])
                k += 1
            if held >= least:
                gone |= {x[:2] for x in lines[j : j + k]}
    return gone


def lines_of(runs, rows):
    full = {(d, k) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.split()}
    return {(r["doc_id"], k) for r in runs for k in range(r["first_line"], r["last_line"] + 1)} & full


def repeating(seed):
    """Texts of lines from a pool, in part one after the other, with copies, odd spacing and blank lines."""
    rng = random.Random(seed)
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    pool = [words(f"l{k}_", rng.choice([1, 2, 3, 9, 14])) for k in range(6)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else words(f"o{rng.random()}", 3) for _ in range(rng.randrange(22))) + rng.choice(["", "\n", "\n\n"])) for i in range(60)]
    return rows + [(100, rows[3][1]), (101, " " + rows[3][1].upper()), (102, "one " * 50), (103, "one " * 50), (104, "short"), (105, "\n\n".join([pool[3]] * 30))]


@pytest.mark.parametrize("seed", [5, 8])
def test_line_dedup(spark, seed):
    rows = repeating(seed)
    df = spark.createDataFrame(rows + [(205, None), (206, "")], "doc_id long, text string").withColumn("own", F.lit(1)).withColumn("_spans", F.lit(2))
    for least in (6, 12, 20, 50):
        found = line_dedup.runs(df, least).collect()
        want = plain_runs(rows, least)
        assert lines_of(found, rows) == want and len(want) > 10
        ends = sorted((r["doc_id"], r["first_line"], r["last_line"]) for r in found)
        assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(ends, ends[1:]))
        text = dict(rows)
        for r in found:  # the run's first line stands at the source, too, and earlier
            line = lambda d, k: text[d].split("\n")[k].lower().split()
            assert line(r["doc_id"], r["first_line"]) == line(r["source_doc_id"], r["source_line"])
            assert (r["source_doc_id"], r["source_line"]) < (r["doc_id"], r["first_line"])
    out = line_dedup.dedup(df, 6)
    assert out.columns == df.columns
    gone = plain_runs(rows, 6)
    left = lambda d, t: [x for k, x in enumerate(t.split("\n")) if x.split() and (d, k) not in gone]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert {d: [x for x in got[d].split("\n") if x.split()] for d, _ in rows} == {d: left(d, t) for d, t in rows}
    assert got[205] is None and got[206] == ""
    assert line_dedup.runs(docs(spark, [])).count() == 0


def test_line_dedup_ends_and_origins(spark):
    """The end of a run goes behind a long line, too; a text that repeats itself keeps its first run."""
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    shared = words("p", 80) + "\n\n" + words("q", 30)
    short = "\n".join([words("r", 45), words("s", 5), words("t", 10)])
    rows = [(1, f"{words('a', 9)}\n{shared}\n{words('b', 9)}"), (2, f"{words('c', 9)}\n{shared}\n{words('d', 9)}"), (3, words("q", 30))]
    rows += [(4, f"{short}\n{words('e', 90)}"), (5, f"{short}\n{words('f', 90)}"), (6, "\n".join([words("g", 10)] * 20))]
    got = sorted(tuple(r) for r in line_dedup.runs(spark.createDataFrame(rows, "doc_id long, text string")).drop("own").collect())
    assert got == [(2, 1, 3, 1, 1), (5, 0, 2, 4, 0), (6, 5, 19, 6, 0)]


def test_winnowing_selects_few_lines():
    rng = random.Random(3)
    text = "\n".join(" ".join(str(rng.random()) for _ in range(5)) for _ in range(2000))  # windows of 10 lines
    found = line_dedup.selected(text)
    assert len(found) < 1.2 * 2 / 11 * 2000
    at = {k for k, _, _ in found}
    assert all(at & set(range(k, k + 10)) for k in range(1990))


# Licenses ---------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
    words = [f"w{k}" for k in range(60)]
    assert len(licenses.align(["x"] * 5 + words + ["y"] * 5, words)) == 60
    cut = words[:20] + words[25:]
    assert len(licenses.align(["the"] * 9 + cut + ["the"], words)) == 55


def test_licenses_stated_twice_in_mid_text():
    """Two statements close together, whole, with words between and with some of their own words lost."""
    all_ = licenses.prepared()
    filler = " ".join(f"f{k}" for k in range(60))
    for name, variants in licenses.TEMPLATES.items():
        for t in variants:
            for times in (2, 3, 5):
                for between in (" ", " Acme. ", " x y z "):
                    found = {x[0]: x for x in licenses.scan(f"{filler} {between.join([t] * times)} {filler}", all_)}
                    assert name in found, (t, times, between)
                    assert found[name][1] == 1.0 and 60 <= found[name][2] <= found[name][3]
    long = licenses.TEMPLATES["GPL-3.0"][1].split()
    worn = " ".join(w for k, w in enumerate(long) if k % 10)
    assert "GPL-3.0" in {x[0] for x in licenses.scan(f"{filler} {worn} {worn} {filler}", all_)}


def test_one_word_templates_and_licenses_that_share_words():
    assert list(licenses.scan("Foo bar", licenses.prepared({"F": ["Foo"]}))) == [("F", 1.0, 0, 0)]
    assert list(licenses.scan("bar", licenses.prepared({"F": ["Foo"]}))) == []
    pack = licenses.prepared()
    for name, variants in licenses.TEMPLATES.items():
        for t in variants:
            assert [x[:2] for x in licenses.scan(f"one two {t} three", pack)] == [(name, 1.0)], t
    assert [x[0] for x in licenses.scan("Released under the Foo License.", pack)] == []


def test_windows_find_what_aligning_every_window_finds():
    """Worn, stretched and repeated statements among other words, some of them the templates' own."""
    rng = random.Random(11)
    own = {"A": ["a b c d e f g h i j"], "B": ["k l a m n"], "C": ["o p q r s t u v w x y z o1 p1 q1 r1 s1 t1 u1 v1 w1 x1"]}
    pack = licenses.prepared(own)
    found = 0
    for _ in range(400):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += [f"f{rng.randrange(99)}" if rng.random() < 0.8 else rng.choice("abcdklmo") for _ in range(rng.randrange(12))]
            for w in rng.choice(pack.templates).words:
                if rng.random() > 0.1:
                    text.append(w)
                if rng.random() < 0.08:
                    text.append(f"g{rng.randrange(9)}")
        places = defaultdict(list)
        for k, w in enumerate(text):
            places[w].append(k)
        for t in pack.templates:
            n, most = len(t.words), 0
            for lo in range(len(text)):
                for hi in {lo + n - n // 5, lo + n, lo + n + n // 4, lo + n + n // 2}:
                    got = licenses.align(text[lo:hi], t.words)
                    if any(t.words[y] in t.own for _, y in got):
                        most = max(most, len(got))
            x = licenses.best(text, places, t)
            if most >= t.need:
                assert x and x[0] >= t.need, (t.license, text)
                found += 1
            if x:
                assert lcs(text, t.words) >= x[0]
    assert found > 300


def test_licenses(spark):
    filler = " ".join(f"f{k}" for k in range(400))
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    texts = [None, "", "the license of the under", f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler}", "Released under the MIT License. " * 3, f"{filler} {apache.upper()} {filler}", "All rights reserved", filler, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", " ".join(w for k, w in enumerate(apache.split()) if k % 10)]
    got = defaultdict(set)
    for r in licenses.licenses(docs(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])
        assert 0.8 <= r["coverage"] <= 1 and r["first_word"] <= r["last_word"]
    assert licenses.licenses(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "All rights reserved", 1), (1, "All rights reserved", 2), (1, "All rights reserved", 2)], "doc_id long, text string, license int")
    assert sorted(map(str, (r["doc_id"] for r in licenses.licenses(odd).collect()))) == ["1", "1", "None"]
    assert got == {3: {"Apache-2.0"}, 4: {"MIT"}, 5: {"Apache-2.0"}, 6: {"All-Rights-Reserved"}, 8: {"GPL-3.0", "CC-BY-NC-4.0"}, 9: {"Apache-2.0"}}


# SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    table = {65 + k: 97 + k for k in range(26)}
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(table)) if x]
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in [None, "", " \n", "One", "one TWO", "a b c", "É É é É", "a\x85b c\x1cd e", *made(20), "x " * 70_000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def classes(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("radius,parts,tile", [(2, 4, 1024), (2, 4, 8), (3, 2, 16), (0, 4, 64)])
def test_links_lose_none(spark, radius, parts, tile):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, 1, 2**64 - 1]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(3)]
    chain = [7]
    for k in range(40):
        chain.append(chain[-1] ^ (3 << k))
    fps = list(dict.fromkeys(fps + chain))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from tickloom.llm.components import components

    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, parts, tile)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    pair = {}
    for x, label in zip(signed, classes(fps, radius)):
        assert pair.setdefault(label, got.get(x, x)) == got.get(x, x)
    assert len(set(pair.values())) == len(pair)


def test_near_duplicates(spark):
    texts = made(40, most=120) + [None, "", " ", "same text here"] + ["same text here"] * 20
    df = docs(spark, texts, first=100).withColumn("fp", F.lit("own")).withColumn("_n", F.lit(1))
    fps = [plain_fingerprint(t) for t in texts]
    label = classes(fps, 2)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    for i, f in enumerate(fps):
        assert rows[100 + i]["fp"] % 2**64 == f and rows[100 + i]["component_id"] == 100 + label[i]
    both = df.unionByName(df.where("doc_id = 100")).unionByName(spark.createDataFrame([(None, "n", "own", 1)], df.schema))
    out = simhash.dedup(both)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([None, *(100 + k for k in set(label))])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.dedup(docs(spark, [])).count() == 0


# Toxicity ---------------------------------------------------------------------------------


def auc(scores, truth):
    order = np.argsort(np.argsort(scores))
    pos = truth.sum()
    return (order[truth == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(truth) - pos))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries()["op10_toxicity"](spark, d).toPandas()
    label = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(got) == 10_000 and ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    both = got[got.held_out].merge(label, on="doc_id")
    assert auc(both.score.to_numpy(), both.toxic.to_numpy()) > 0.97
    assert (both.predicted == both.toxic).mean() > 0.97


def net_and_texts(seed=0, dtype=np.float64):
    """A network with outputs of either sign, and texts of 0 to 9 words as rows."""
    rng = np.random.default_rng(seed)
    net = toxicity.Network.fresh(np.zeros(30), seed)
    net.embed = rng.normal(0, 1, (30, toxicity.SIZE)).astype(dtype)
    net.filters = [rng.normal(0, 1, f.shape).astype(dtype) for f in net.filters]
    net.bias = [rng.normal(0, 1, b.shape).astype(dtype) for b in net.bias]
    net.out = rng.normal(0, 0.3, net.out.shape).astype(dtype)
    return net, [rng.integers(0, 30, n) for n in (*range(10), 1, 2, 3)], rng


def test_folded_scores_are_those_of_the_convolution():
    """Tables against every filter at every place of the text, as it is written."""
    net, texts, _ = net_and_texts()
    scorer = net.folded(toxicity.Vocabulary(np.arange(1, 30)))
    for rows in texts:
        z = net.out_bias
        for i, (f, bias) in enumerate(zip(net.filters, net.bias)):
            for k in range(toxicity.FILTERS):
                acts = [sum(net.embed[rows[at + j]] @ f[j][:, k] for j in range(len(f))) for at in range(len(rows) - len(f) + 1)]
                z += max(0.0, max(acts) + bias[k]) * net.out[i * toxicity.FILTERS + k] if acts else 0.0
        assert abs(scorer.pooled(rows)[0] @ net.out + net.out_bias - z) < 1e-9


def test_gradients_are_finite_differences():
    net, texts, rng = net_and_texts(1)
    y = rng.integers(0, 2, len(texts)).astype(float)
    _, (rows, of_rows), of_filters, of_bias, of_out, of_out_bias = toxicity.gradients(net, texts, y)
    full = np.zeros_like(net.embed)
    full[rows] = of_rows
    step = 1e-6
    for p, g in zip([net.embed, *net.filters, *net.bias, net.out], [full, *of_filters, *of_bias, of_out]):
        for at in {tuple(int(rng.integers(n)) for n in p.shape) for _ in range(60)}:
            was, loss = p[at], []
            for way in (step, -step):
                p[at] = was + way
                loss.append(toxicity.gradients(net, texts, y)[0])
            p[at] = was
            assert abs((loss[0] - loss[1]) / (2 * step) - g[at]) < 1e-5
    loss = []
    for way in (step, -step):
        net.out_bias = way
        loss.append(toxicity.gradients(net, texts, y)[0])
    assert abs((loss[0] - loss[1]) / (2 * step) - of_out_bias) < 1e-5


def test_predictions_follow_the_language():
    """The same output counts as toxic in one language and not in the other."""
    net, _, _ = net_and_texts(2)
    scorer = net.folded(toxicity.Vocabulary(np.zeros(0, np.int64)))
    de, en = "der hund und die katze", "the dog and the cat"
    z = scorer.logit(de)
    assert toxicity.language(de) == "de" and toxicity.language(en) == "en"
    model = toxicity.Model(scorer, z, {"de": z - 1, "en": z + 1})
    assert model.score(de) > 0.5 > model.score(en)
    steps = np.array([-40, -20, 10, 30])
    assert toxicity.cutoff(steps, np.array([90, 5, 0, 0]), np.array([0, 0, 4, 6])) == pytest.approx((-19 + 10) / 2 * toxicity.WIDE)


def test_toxicity_edges(spark):
    kinds = "doc_id long, quality int, toxic int"
    texts = docs(spark, ["fine day", "idiot scum", None, "", "idiot " * 20_000])
    none = toxicity.toxicity(texts, spark.createDataFrame([], kinds)).collect()
    assert len(none) == 5 and all(r["score"] == 0.0 for r in none)
    texts = texts.withColumns({c: F.lit("own") for c in ("score", "held_out", "toxic", "_id", "lang", "step")})
    odd = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (99, 1, 1)], kinds)
    rows = toxicity.toxicity(texts.unionByName(texts), odd).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(docs(spark, []), odd).count() == 0


def plain_every(text, lo, hi, t):
    n, found = len(t.words), []
    for a in range(lo, hi):
        if text[a] in t.counts:
            for size in sorted({t.need, n, n + n // 4, n + n // 2}):
                inside = Counter(w for w in text[a : min(hi, a + size)] if w in t.counts)
                if sum(min(c, inside[w]) for w, c in t.counts.items()) >= t.need:
                    found.append((a, min(hi, a + size)))
    return found


def test_sliding_windows_of_licenses():
    rng = random.Random(12)
    for _ in range(40):
        template = [rng.choice("abcdefg") for _ in range(rng.randrange(2, 12))]
        t = licenses.prepared({"L": [" ".join(template)]}).templates[0]
        text = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 60))]
        lo = rng.randrange(0, max(1, len(text) // 3))
        assert licenses.every(text, lo, len(text), t) == plain_every(text, lo, len(text), t)


def test_altered_full_texts_of_licenses(spark, tmp_path):
    """Whole licenses of hundreds and of thousands of words, a tenth of their words changed, amid prose that
    shares their common words, and twice in one text; half of one is not enough."""
    rng = random.Random(13)
    common = "the of and to in that for any or this software license is not by you may with a be as".split()
    full = {}
    for k, n in enumerate((450, 1500, 5000)):
        own = [f"term{k}x{j}" for j in range(n // 3)]
        full[f"L{k}"] = [rng.choice(own) if rng.random() < 0.4 else rng.choice(common) for _ in range(n)]
        (tmp_path / f"L{k}.txt").write_text(" ".join(full[f"L{k}"]))
    altered = lambda ws: [w if rng.random() > 0.1 else f"changed{rng.randrange(99)}" for w in ws]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"prose{rng.randrange(500)}" for _ in range(n)]
    texts = [prose(300) + altered(full["L0"]) + prose(200), prose(50) + altered(full["L1"]), altered(full["L2"]) + prose(3000), altered(full["L0"]) + prose(900) + altered(full["L1"]) + altered(full["L0"]), prose(100) + full["L1"][:750] + prose(100), prose(2000)]
    found = licenses.licenses(docs(spark, [" ".join(t) for t in texts]), licenses.full_texts(str(tmp_path))).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(0, "L0"), (1, "L1"), (2, "L2"), (3, "L0"), (3, "L1")]
    assert all(r["coverage"] >= 0.85 for r in found)
    first = next(r for r in found if r["doc_id"] == 0)
    assert abs(first["first_word"] - 300) < 30 and abs(first["last_word"] - 750) < 30


@pytest.mark.parametrize("run", ["line_dedup", "licenses", "binary_output"])
def test_clashing_columns(spark, tmp_path, run):
    """Helper columns' names in the input change no row."""
    plain = docs(spark, [*ODD, *made(30, seed=4), None, "MIT License\n" * 60])
    names = ("own", "at", "print", "extents", "first", "last", "key", "new", "run", "spans", "license", "coverage", "part", "block", "n_ids", "payload", "doc_ids", "start", "n_tokens")
    clashing = plain.withColumns({c: F.lit("own") for c in names})

    def rows(df, name):
        if run == "binary_output":
            binary_output.write(df, WORDS, f"{tmp_path}/{name}")
            return sorted(map(str, binary_output.documents(spark, f"{tmp_path}/{name}").collect()))
        if run == "licenses":
            return sorted(map(str, licenses.licenses(df).collect()))
        return sorted(map(str, line_dedup.dedup(df).select("doc_id", "text").collect()))

    assert rows(clashing, "a") == rows(plain, "b")
    if run == "line_dedup":
        assert line_dedup.dedup(clashing).columns == clashing.columns
