"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which of another.

Texts, each with a space before it, are encoded by a byte-level BPE file (A) and a SentencePiece
model (B). Byte offsets where tokens of both end cut a text into groups; every A token of a group
is linked to each of its B tokens. A pair of ids counts how many documents hold it linked.

Python encodes. Neither tokenizer joins characters across the edge between something that is not
white space and a space, so a text's tokens are those of its segments (a run of spaces, then
whatever comes up to the next such edge). Texts come in blocks of some megabytes. A block is one
row with the ids between two cuts, each different such stretch once and one after the other, with
the places of the cuts among them; a document is a list of numbers of stretches, and has those that
differ with how often each is there. Stretches repeat far more often than segments. Everything
after that is Spark's higher-order functions: sequence, slice and transform make groups and links of
a block's different stretches, aggregate sums them by document.

Counts: different pairs of each document are added up over all documents. Pairs that hold more
than a hundred-thousandth of these are sent to all tasks, where documents' links meet them without
a shuffle; links of rarer pairs are shuffled. Both ways meet in sums by document.

Texts that are null or empty, or whose tokens' bytes are not those of the text (U+2581, which B
reads as a space), have no tokens: zeros and an empty digest. Special tokens' spellings are
plain text. Rows without or with a repeated doc_id are documents of their own. A long text is a
block of its own; one without spaces is one segment, whose groups take n log n steps. An empty
table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import SMALL, cut, prepare, remove, shared_dir

#: Bytes of texts in a block; segments that are encoded together.
BLOCK, TOGETHER = 2 << 20, 256
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: White space as any of the tokenizers may see it.
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]"
#: A space that is first or follows white space does not begin a segment.
_PLAIN_NOT = rf"^ |{_WHITE} "
_EDGE = regex.compile("(?<=[^\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581])(?= )")

DOC = "struct<doc_id: long, at: array<int>, different: array<int>, times: array<int>>"
ROW = f"block long, a array<int>, ua array<int>, b array<int>, ub array<int>, docs array<{DOC}>"
_INTS = pa.list_(pa.int32())
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), *((n, _INTS) for n in ("at", "different", "times"))]))


class Pieces:
    """Ids and bytes of a SentencePiece model, which puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("▁")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))]

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments, each with its leading space."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        return [ids or [self.space] for ids in found]


class Both:
    def __init__(self, byte_file: str, piece_file: str):
        self.ranks, self.pieces = tokens.ranks(byte_file), Pieces(piece_file)
        coder = self.ranks.coder
        spelt = [[coder.decode_single_token_bytes(k) for k in range(coder.n_vocab)], self.pieces.bytes]
        self.sizes = [np.array(list(map(len, b)), np.int64) for b in spelt]

    def _ids(self, texts: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of A and of B of segments that do not end in white space, one after the other."""
        at, data = [0, *ends[TOGETHER - 1 : -1 : TOGETHER].tolist(), *ends[-1:].tolist()], memoryview(texts.buffers()[2] or b"")
        lots = [str(data[i:j], "utf-8") for i, j in zip(at, at[1:])]
        found = [map(self.ranks.coder.encode_ordinary, lots), self.pieces.encode(lots)]
        return [np.fromiter(chain.from_iterable(x), np.int64) for x in found]

    def segments(self, texts: pa.Array) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Ids and ends of segments, flat and with bounds, and which of them both tokenizers spell, which
        is all without U+2581. Those that end in white space or are not spelt are encoded alone, the
        others many at a time."""
        bad = pc.match_substring(texts, "\u2581")
        alone = pc.or_(bad, pc.match_substring_regex(texts, _WHITE + "$")).to_numpy(zero_copy_only=False)
        own, others = texts.filter(pa.array(alone)).to_pylist(), texts.filter(pa.array(~alone))
        bytes_ = np.cumsum(pc.binary_length(others).to_numpy(), dtype=np.int64)
        singles = [list(map(self.ranks.coder.encode_ordinary, own)), self.pieces.encode(own) if own else []]
        out = {}
        for name, flat, some, sizes in zip("ab", self._ids(others, bytes_), singles, self.sizes):
            covered = np.cumsum(sizes[flat])
            stops = np.searchsorted(covered, bytes_) + 1
            if len(others) and (stops[-1] != len(flat) or (covered[stops - 1] != bytes_).any()):
                raise AssertionError("tokens do not spell the segments")
            lengths = np.zeros(len(texts), np.int64)
            lengths[~alone] = np.diff(stops, prepend=0)
            lengths[alone] = list(map(len, some))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            ids = np.zeros(bounds[-1], np.int32)
            of = np.repeat(alone, lengths)
            ids[~of], ids[of] = flat, np.fromiter(chain.from_iterable(some), np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            out[name] = (ids, bounds)
            out[name + "e"] = ((ends[1:] - np.repeat(ends[bounds[:-1]], lengths)).astype(np.int32), bounds)
        return out, ~bad.to_numpy(zero_copy_only=False)


_loaded: dict[tuple[str, str], Both] = {}


def _both(byte_file: str, piece_file: str) -> Both:
    if (byte_file, piece_file) not in _loaded:
        _loaded[byte_file, piece_file] = Both(byte_file, piece_file)
    return _loaded[byte_file, piece_file]


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different segments of texts without their leading space, and the segments of all texts in order,
    with the bounds of each text's. Null and empty texts have none."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _PLAIN_NOT)
    empty = pc.equal(texts, "")
    parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    by_text = np.diff(parts.offsets.to_numpy())
    by_text[pc.or_(odd, empty).to_numpy(zero_copy_only=False)] = 0
    # What stands for odd and empty texts is one empty part; those are taken out.
    keep = np.repeat(pc.invert(pc.or_(odd, empty)).to_numpy(zero_copy_only=False), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten().filter(pa.array(keep))
    whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(whole):
        lists, at = [], np.concatenate([[0], np.cumsum(by_text)])
        pieces, last = [], 0
        for k in whole:
            own = [s[1:] for s in _EDGE.split(" " + texts[int(k)].as_py())]
            pieces += [flat.slice(last, at[k] - last), pa.array(own, pa.string())]
            last = at[k]
            lists.append(len(own))
        flat = pa.concat_arrays([*pieces, flat.slice(last)])
        by_text[whole] = lists
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(by_text)])


def cut_places(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For A and B 0, and how many of a segment's ends are not beyond each cut, flat and with bounds."""
    flat, bounds = found["ae"]
    stops = np.cumsum(flat[bounds[1:] - 1], dtype=np.int64)  # a segment's bytes end with its last token
    ends = {}
    for n in "ab":
        own, at = found[n + "e"]
        ends[n] = own + np.repeat(stops - own[at[1:] - 1], np.diff(at))
    ended = np.zeros((2, stops[-1] + 1 if len(stops) else 1), bool)
    ended[0, ends["a"]] = ended[1, ends["b"]] = True
    last = {n: ended[k, ends[n]] for n, k in (("a", 1), ("b", 0))}  # where the other side ends as well
    cuts = ends["a"][last["a"]]
    of = np.searchsorted(stops, cuts)
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(stops)))])
    out = {}
    for n in "ab":
        places = np.flatnonzero(last[n]) + 1 - found[n][1][of]
        out[n] = (np.insert(places, first[:-1], 0), first + np.arange(len(first)))
    return out


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, as many as sizes says, for each one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def stretches(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Different stretches between cuts, as ids of A and B one after the other and the places of the
    cuts among them; and the numbers of the stretches of each segment, flat and with bounds."""
    upto, sizes, ends = cut_places(found), {}, {}
    bounds = upto["a"][1] - np.arange(len(upto["a"][1]))  # a segment has a place more than stretches
    begins = np.zeros(len(upto["a"][0]), bool)
    begins[upto["a"][1][:-1]] = True
    for n in "ab":
        sizes[n] = np.diff(upto[n][0])[~begins[1:]]
        ends[n] = np.cumsum(sizes[n])
    # What tells stretches apart: A's ids, -1 and B's ids.
    number = np.arange(bounds[-1])
    told = np.full(ends["a"][-1] + ends["b"][-1] + len(number) if len(number) else 0, -1, np.int32)
    for n, before in (("a", ends["b"] - sizes["b"] + number), ("b", ends["a"] + number + 1)):
        told[np.arange(len(found[n][0])) + np.repeat(before, sizes[n])] = found[n][0]
    told_ends = 4 * np.concatenate([[0], ends["a"] + ends["b"] + number + 1])
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(told_ends), pa.py_buffer(told)])
    codes = told.dictionary_encode().indices.to_numpy()
    _, first = np.unique(codes, return_index=True)
    out = {}
    for n in "ab":
        own = sizes[n][first]
        out[n], out["u" + n] = found[n][0][_runs((ends[n] - sizes[n])[first], own)], np.concatenate([[0], np.cumsum(own)])
    return out, codes, bounds


def _blocks(byte_file: str, piece_file: str, size: int):
    def block(number: int, docs: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
        coder, ids = _both(byte_file, piece_file), pa.concat_arrays(docs)
        words, at, bounds = cut_texts(pa.concat_arrays(texts))
        words = pc.binary_join_element_wise("", words, " ")
        found, good = coder.segments(words)
        if not good.all():  # their documents have no tokens, and what only those hold no place
            spoilt = np.concatenate([[0], np.cumsum(~good[at])])
            gone = spoilt[bounds[1:]] > spoilt[bounds[:-1]]
            used, at = np.unique(at[np.repeat(~gone, np.diff(bounds))], return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(bounds)))])
            found, _ = coder.segments(words.take(pa.array(used)))
        different, codes, lists = stretches(found)
        many = np.diff(lists)[at]
        at, bounds = codes[_runs(lists[at], many)], np.concatenate([[0], np.cumsum(many)])[bounds]
        span = len(different["ua"])
        keys, times = np.unique(np.repeat(np.arange(len(ids)), np.diff(bounds)) * span + at, return_counts=True)
        own = np.searchsorted(keys, np.arange(len(ids) + 1) * span)
        rows = pa.StructArray.from_arrays([ids, _lists(at, bounds), _lists(keys % span, own), _lists(times, own)], names=["doc_id", "at", "different", "times"])
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(kind)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(one(pa.array(different[n], pa.int32()), _INTS) for n in ("a", "ua", "b", "ub")), one(rows, _DOCS)], ["block", "a", "ua", "b", "ub", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, docs, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for k in range(b.num_rows):
                n = len(b.column(1)[k].as_buffer()) if b.column(1)[k].is_valid else 0
                if held and held + n > size:
                    yield block(number, docs, texts)
                    number, docs, texts, held = number + 1, [], [], 0
                docs.append(b.column(0).slice(k, 1))
                texts.append(b.column(1).slice(k, 1))
                held += n
        if docs:
            yield block(number, docs, texts)

    return run


def blocks(docs: DataFrame, byte_file: str, piece_file: str, size: int = BLOCK) -> DataFrame:
    """One row a block: its different stretches with ids and cuts, and its documents as lists of them."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_blocks(byte_file, piece_file, size), ROW)


def let(value: Column, body) -> Column:
    """body(value) with value computed once and, unlike ``common.let``, neither it nor the result copied:
    an aggregate of nothing that begins with value and finishes with body."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def _spelt(x: Column, y: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("|"), y.cast("string"))


def _many(g: Column) -> Column:
    """A group of several ids: its text, and the links of each A id to each B id."""
    side = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    links = F.flatten(F.transform(g["a"], lambda x: F.transform(g["b"], lambda y: pair(x, y))))
    return F.struct(F.concat(side(g["a"]), F.lit("|"), side(g["b"])).alias("text"), links.alias("links"))


def groups(s: dict[str, Column]) -> Column:
    """array<struct<text, links>> of groups, which lie between places of A and B."""

    def between(k: Column) -> Column:
        first, end = (lambda side: F.get(s["u" + side], k - 1)), (lambda side: F.get(s["u" + side], k))
        single = (end("a") - first("a") == 1) & (end("b") - first("b") == 1)
        ids = lambda side: F.slice(s[side], first(side) + 1, end(side) - first(side)).alias(side)
        x, y = F.get(s["a"], first("a")), F.get(s["b"], first("b"))
        return F.when(single, F.struct(_spelt(x, y).alias("text"), F.array(pair(x, y)).alias("links"))).otherwise(let(F.struct(ids("a"), ids("b")), _many))

    # Of no groups the sequence would run from 1 down to 0.
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(s["ua"]) - 1), 2, F.size(s["ua"])), between)


def facts(s: dict[str, Column]) -> Column:
    """Struct of arrays over groups: how many ids, links as text and as pairs."""
    many = lambda side: F.transform(F.slice(s["u" + side], 2, F.size(s["u" + side])), lambda end, k: end - F.get(s["u" + side], k))
    return let(groups(s), lambda g: F.struct(many("a").alias("n_a"), many("b").alias("n_b"), F.transform(g, lambda x: F.size(x["links"])).alias("n_links"), g["text"].alias("texts"), g["links"].alias("links")))


def _document(f: Column, d: Column) -> Column:
    sums = lambda c: F.aggregate(F.zip_with(d["different"], d["times"], lambda k, n: F.get(f[c], k).cast("long") * n), F.lit(0).cast("long"), lambda total, n: total + n)
    return F.struct(
        *[d[c].alias(c) for c in ("doc_id", "different", "times")],
        *[sums(c).alias(c) for c in ("n_a", "n_b", "n_links")],
        F.size(d["at"]).cast("long").alias("n_groups"),
        F.when(F.size(d["at"]) == 0, "").otherwise(F.sha2(F.array_join(F.transform(d["at"], lambda k: F.get(f["texts"], k)), ";"), 256)).alias("groups_sha256"),
    )


def aligned(docs: DataFrame, byte_file: str, piece_file: str, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): documents as align has them; pairs(a, b, docs, best) with the number of
    documents that hold them linked, and whether no pair of that A id has more."""
    spark = docs.sparkSession
    # A row is a block of some megabytes: Spark's reader would hold thousands of them at once.
    before = spark.conf.get(_READ, None)
    spark.conf.set(_READ, "4")
    try:
        return _aligned(docs, byte_file, piece_file, size)
    finally:
        spark.conf.unset(_READ) if before is None else spark.conf.set(_READ, before)


def _aligned(docs: DataFrame, byte_file: str, piece_file: str, size: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    made = blocks(docs, byte_file, piece_file, size)
    # One value holds the groups' facts while documents are made of them.
    row = let(facts({n: F.col(n) for n in ("a", "ua", "b", "ub")}), lambda f: F.struct(f["links"].alias("links"), F.transform("docs", lambda d: _document(f, d)).alias("docs")))
    folder = f"{shared_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    made.select("block", row.alias("r")).select("block", "r.links", "r.docs").write.parquet(folder)
    held = spark.read.parquet(folder)

    all_of = lambda at: F.flatten(F.transform(at, lambda k: F.get("links", k)))
    each = held.select(F.explode(F.transform("docs", lambda d: F.array_distinct(all_of(d["different"])))).alias("pairs"))
    counts = each.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    a = F.shiftright("pair", 32).cast("int")
    # An A id has no more partners than B has ids.
    counts = cut(counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(a))))

    # A document is told by its block and its place there.
    own = held.select("block", "links", F.posexplode("docs").alias("place", "d"))
    own = own.select("block", "links", "place", "d.times", F.posexplode("d.different").alias("k", "group"))
    links = own.select("block", "place", F.get("times", F.col("k")).cast("long").alias("n"), F.explode(F.get("links", F.col("group"))).alias("pair"))
    sums, zero = _met(links, counts), F.lit(0).cast("long")
    facts_ = ("n_a", "n_b", "n_groups", "n_links")
    told = held.select("block", F.posexplode("docs").alias("place", "d")).select("block", "place", *[F.col("d")[c].alias(c) for c in ("doc_id", *facts_, "groups_sha256")])
    out = cut(told.join(sums, ["block", "place"], "left").select("doc_id", *facts_, *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"))
    remove(spark, folder)
    return out, counts.select(a.alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "docs", "best")


def _met(links: DataFrame, counts: DataFrame, most: int = SMALL) -> DataFrame:
    """(block, place, n_best, count_sum) of links(block, place, pair, n), n times that pair.

    Pairs with more than a share of 1 in ``most`` of all documents' pairs, so ``most`` at most, are
    sent to every task, where their links are summed. Those of rarer pairs, a small part of all,
    meet the pairs by a shuffle.
    """
    total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    often = counts.where(F.col("docs") > total // most)
    told = links.join(F.broadcast(often), "pair", "left")
    told = told.groupBy("block", "place", F.when(F.col("docs").isNull(), F.col("pair")).alias("rare"))
    told = cut(told.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)).alias("s")))
    late = told.where("rare is not null").join(counts.withColumnRenamed("pair", "rare"), "rare")
    late = late.select("block", "place", (F.col("n") * F.col("best").cast("long")).alias("b"), (F.col("n") * F.col("docs")).alias("s"))
    both = told.where("rare is null").select("block", "place", "b", "s").unionByName(late)
    return both.groupBy("block", "place").agg(F.sum("b").alias("n_best"), F.sum("s").alias("count_sum"))


def align(docs: DataFrame, byte_file: str, piece_file: str, size: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row a document."""
    return aligned(docs, byte_file, piece_file, size)[0]
