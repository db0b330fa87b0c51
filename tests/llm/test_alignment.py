"""Cross-tokenizer alignment against plain Python over whole texts, and segments against whole calls."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import alignment
from tickloom.llm.queries import queries

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "a ", "a  ", " a", "  a  b ", "a \n b", "a\n  b", "\n", "x\t y", "a  b", "a　 b", "a 　 b", "x▁y z", "x ▁ y", "\x00 a \x00", "a\x1c b\x85 c", "<s> a </s> <unk> <0x0A>", "<|endoftext|> a <|endoftext|>", "é é ﬁ", "中文 文本，测试", "\U0001f600\U0001f600 ok", "it's don't 's", "a" * 3000, " " * 3000 + "x", "\r\n \r\n", "한국어 텍스트", "1234567 89"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        spelt = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.a_bytes = {k: bytes(spelt[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def encode(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ab, bb = [self.a_bytes[k] for k in a], [self.b_bytes(k) for k in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return None
        return list(zip(a, ab)), list(zip(b, bb))

    def groups(self, text):
        found = self.encode(text) if text else None
        if found is None:
            return []
        ends = []
        for side in found:
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts, out = sorted(set(ends[0]) & set(ends[1])), []
        for lo, hi in zip([0, *cuts], cuts):
            out.append(tuple([k for (k, _), e in zip(side, own) if lo < e <= hi] for side, own in zip(found, ends)))
        return out

    def rows(self, texts):
        groups = [self.groups(t) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        docs = Counter(p for c in links for p in c)
        most = {}
        for (x, _), n in docs.items():
            most[x] = max(most.get(x, 0), n)
        for g, c in zip(groups, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total(), sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
CHARS = "abc ABC  ..,,'\n\té́Σ 1ß　▁-# 中"


def test_segments_are_whole_texts():
    """Cutting at edges of words gives the ids of whole calls, for odd and for random texts."""
    plain, both, rng = Plain(), alignment.Both(A_FILE, B_FILE), random.Random(4)
    texts = ODD + ["".join(rng.choice(CHARS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    words, at, bounds = alignment.cut_texts(pa.array([*texts, None], pa.string()))
    words = [" " + w for w in words.to_pylist()]
    found, good = both.segments(pa.array(words))
    ids = {n: [found[n][0][i:j].tolist() for i, j in zip(found[n][1], found[n][1][1:])] for n in found}
    assert bounds[-1] == bounds[-2]  # null
    for t, lo, hi in zip(texts, bounds, bounds[1:]):
        own = at[lo:hi].tolist()
        assert "".join(words[k] for k in own) == (" " + t if t else "")
        want = plain.encode(t) if t else None
        assert (want is not None) == (bool(t) and all(good[k] for k in own)), repr(t)
        if want:
            assert [x for k in own for x in ids["a"][k]] == [k for k, _ in want[0]]
            assert [x for k in own for x in ids["b"][k]] == [k for k, _ in want[1]]
            for name, side in zip(("ae", "be"), want):
                assert [e for k in own for e in ids[name][k][-1:]] == [len(words[k].encode()) for k in own]


def test_places_of_cuts():
    """Of each segment, as many as there are cuts and one; against sets of ends."""
    both = alignment.Both(A_FILE, B_FILE)
    words = pa.array([" alpha", " zwölfmalzwölf", " 😀", " ", " überall", " x" * 50])
    found, _ = both.segments(words)
    upto = alignment.cut_places(found)
    lists = lambda x: [x[0][i:j].tolist() for i, j in zip(x[1], x[1][1:])]
    for ae, be, ua, ub in zip(*map(lists, (found["ae"], found["be"], upto["a"], upto["b"])), strict=True):
        cuts = sorted(set(ae) & set(be))
        assert ua == [0, *(ae.index(c) + 1 for c in cuts)] and ub == [0, *(be.index(c) + 1 for c in cuts)]


def test_alignment(spark):
    rng = random.Random(5)
    texts = ODD + [None, None] + [" ".join(rng.choice(["alpha", "beta,", "Gammas", "überall", "naïve\nx", "\U0001f600", "Ωmega"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["zwölfmalzwölf" * 400, texts[40], texts[40]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[41]), (40, "another text")]
    want = list(Plain().rows([t for _, t in rows]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("own") for c in ("block", "at", "docs", "links", "n_a", "best")})
    for size in (1000, alignment.BLOCK):
        got = alignment.align(df, A_FILE, B_FILE, size).collect()
        assert sorted(map(str, ((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    assert alignment.align(df.limit(0), A_FILE, B_FILE).count() == 0
    assert alignment.align(df.where("text is null"), A_FILE, B_FILE).collect()[0]["n_links"] == 0


def test_pairs(spark):
    texts = ["one two", "one two two", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Plain()
    docs = Counter(p for t in texts for p in {(x, y) for a, b in plain.groups(t) for x in a for y in b})
    found = alignment.aligned(df, A_FILE, B_FILE)[1].collect()
    assert {(r["a"], r["b"]): r["docs"] for r in found} == docs
    assert all(r["best"] == (r["docs"] == max(n for (a, _), n in docs.items() if a == r["a"])) for r in found)


def test_blocks(spark):
    """A block has each different stretch between cuts once, however many segments and documents hold it."""
    plain, texts = Plain(), [*ODD, None, "one two one two one", "one, two; one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for size in (1, 100, alignment.BLOCK):
        rows, seen = alignment.blocks(df, A_FILE, B_FILE, size).collect(), 0
        assert len({r["block"] for r in rows}) == len(rows)
        for r in rows:
            ids = lambda n: [tuple(r[n][i:j]) for i, j in zip(r["u" + n], r["u" + n][1:])]  # noqa: E731, B023
            own = list(zip(ids("a"), ids("b"), strict=True))
            want = [[(tuple(a), tuple(b)) for a, b in plain.groups(texts[d["doc_id"]] or "")] for d in r["docs"]]
            assert len(own) == len(set(own)) and set(own) == {g for w in want for g in w}
            assert [[own[k] for k in d["at"]] for d in r["docs"]] == want
            assert [{own[k]: n for k, n in zip(d["different"], d["times"], strict=True)} for d in r["docs"]] == list(map(Counter, want))
            seen += len(want)
        assert seen == len(texts)


def test_query(spark, sf_dir):
    """All documents of the smallest tables."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, Plain().rows([r["text"] for r in rows]))}
    got = queries()["op11_alignment"](spark, sf_dir).collect()
    assert len(got) == len(rows) and {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
