"""Token ids of whole texts by public tokenizer files.

``ranks`` is for byte-level files whose ids are ranks of merges: whole texts go through tiktoken
with the file's own vocabulary, which gives the ids of the tokenizers library at a fraction of the
time and keeps nothing between texts.

``words`` is for files that drop white space and case and cut texts at white space before they
merge anything, so that ids of a text are the ids of its words in order. Words repeat; a worker
encodes each once while its cache lasts. Texts of a batch are split and numbered by word in
Arrow, and only different words reach Python. Texts with unusual white space or with characters
whose case or composition depends on their neighbours go through the tokenizer whole.

Texts that hold the spelling of an added token (a special token of the file, say) are left to the
library as a whole, whose default is to give that token's id for it.

Vocabularies' places are parameters. Nulls are empty texts and have no ids.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")

#: Words that a cache may hold, of some 40 bytes each; more, and it starts anew.
WORDS = 1_500_000
#: Bytes of texts that are best looked up together.
TOGETHER = 1 << 24
_END = "</w>"
#: Characters whose case or composition may depend on others, and white space that bytes do not split at.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{130}\x{250}-\x{10ffff}]"
#: Letters, and what is neither letter nor number, of texts without such characters.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_MARKS = "".join(c for c in map(chr, range(0x250)) if not c.isalnum())
#: Fixed value: how byte-level files cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's  a \n probe of 12,345 cafés… <|end|> 中文\U0001f600.  "
_loaded: dict[tuple[type, str], object] = {}


def _spelling() -> dict[int, str]:
    """How byte-level files spell the byte values: printing Latin-1 as itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def _added(library) -> list[str]:
    """Spellings of added tokens, which the library finds in texts, as they are, before anything else."""
    found = [t for t in library.get_added_tokens_decoder().values() if t.content]
    if any(t.normalized for t in found):
        raise ValueError("an added token is sought in normalised text")
    return [t.content for t in found]


class Ranks:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in _spelling().items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        own = [*byte_of, *merged]
        at = [model["vocab"][t] for t in own]
        if model.get("end_of_word_suffix") or sorted(at) != list(range(len(at))) or at[256:] != sorted(at[256:]):
            raise ValueError(f"{path}: not a byte-level file whose ids are ranks of merges")
        ranks = {bytes(byte_of[c] for c in t): k for t, k in zip(own, at)}
        self.coder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        library = _library(path)
        self.path, self.library = path, None  # loaded again for the first text that spells an added token
        self.added = _added(library)
        if self.coder.encode_ordinary(_PROBE) != library.encode(_PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path}: texts are cut in another way")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(t in text for t in self.added):
            return array("I", self.coder.encode_ordinary(text)).tobytes()
        self.library = self.library or _library(self.path)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def ranks(path: str) -> Ranks:
    """One per worker process and file; it keeps no more than the vocabulary."""
    if (Ranks, path) not in _loaded:
        _loaded[Ranks, path] = Ranks(path)
    return _loaded[Ranks, path]


class Words:
    """Ids of texts, by a cache of words.

    A word of letters needs no normaliser or pre-tokenizer of the file: many at a time go
    straight to its merges. Tokens spell the words' bytes, so that their lengths tell where each
    word's ids end. The cache is a column of words, and the ids of all of them one after the other.
    """

    def __init__(self, path: str, most: int = WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = _library(path)
        self.added = _added(self.tokenizer)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token.removesuffix(_END))
        # A word's byte-level spelling differs from its letters outside ASCII only.
        self.table = {b: c for b, c in _spelling().items() if b != 32}
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([""], pa.string())
        self.ends = np.zeros(2, np.int32)  # the k-th word's ids are self.flat[self.ends[k] : self.ends[k + 1]]
        self.flat = np.zeros(0, np.uint32)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, uint32. Best for texts of some million characters together."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        odd, low = pc.match_substring_regex(texts, _ODD), pc.utf8_lower(texts)
        for t in self.added:  # words are learned in small letters, where any case would spell it
            odd = pc.or_(odd, pc.match_substring(low, t.lower()))
        pieces = pc.ascii_split_whitespace(pc.if_else(odd, "", low))
        coded = pieces.flatten().dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids, ends = self._gather(at)
        bounds = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            for k, e in zip(whole, self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
        return out

    def _places(self, different: pa.Array) -> np.ndarray:
        """Where different words stand in the cache, which learns those that it lacks.

        Letters and the marks at their end come apart in any case, so such a word's ids are those
        of its two parts, which may be known. Looking up is dear for the cache's size: it is done once.
        """
        letters, marks = pc.utf8_rtrim(different, _MARKS), pc.utf8_ltrim(different, _LETTERS)
        whole = pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(different))
        marked = pc.and_(pc.and_(whole, pc.utf8_is_alpha(letters)), pc.not_equal(marks, ""))
        parts = [letters.filter(marked), marks.filter(marked)]
        both = pa.concat_arrays([different, *parts])
        found = pc.index_in(both, value_set=self.words)
        lacking = found.slice(0, len(different)).null_count
        if lacking and len(self.words) + 2 * lacking > self.most:
            self.clear()
            found = pc.index_in(both, value_set=self.words)
        at = pc.fill_null(found, -1).to_numpy().copy()
        at, first, second = np.split(at, [len(different), len(different) + len(parts[0])])
        if not lacking:
            return at
        marked = marked.to_numpy(zero_copy_only=False)
        plain, late = (at < 0) & ~marked, at[marked] < 0
        known = len(self.words)
        wanted = [(at, plain, different)] + [(own, own < 0, some) for own, some in ((first, parts[0]), (second, parts[1]))]
        wanted[1:] = [(own, lost & late, some) for own, lost, some in wanted[1:]]
        fresh = self._learn(pc.unique(pa.concat_arrays([some.filter(pa.array(lost)) for _, lost, some in wanted])))
        for own, lost, some in wanted:
            if lost.any():
                own[lost] = known + pc.index_in(some.filter(pa.array(lost)), value_set=fresh).to_numpy()
        if late.any():
            pairs = np.stack([first[late], second[late]], axis=1).ravel()
            ids, ends = self._gather(pairs)
            at[np.flatnonzero(marked)[late]] = len(self.words) + np.arange(len(pairs) // 2)
            self._add(different.filter(pa.array(marked)).filter(pa.array(late)), ids, ends[1::2])
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and where each word's end."""
        first = self.ends[at]
        sizes = self.ends[at + 1] - first
        ends = np.cumsum(sizes, dtype=np.int32)
        from_ = np.repeat(first - (ends - sizes), sizes)
        from_ += np.arange(len(from_), dtype=np.int32)
        return self.flat[from_], ends

    def _learn(self, fresh: pa.Array) -> pa.Array:
        """Put words and their ids at the end of the cache; the words as they stand there."""
        plain = pc.utf8_is_alpha(fresh)
        parts = [fresh.filter(plain), fresh.filter(pc.invert(plain))]
        for some, ids in zip(parts, (self._letters, self._others)):
            if len(some):
                self._add(some, *ids(some.to_pylist()))
        return pa.concat_arrays(parts)

    def _add(self, words: pa.Array, flat: np.ndarray, ends: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.concatenate([self.ends, (ends + len(self.flat)).astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat])

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the whole tokenizer, which never joins what white space parts."""
        found = self.tokenizer.encode_batch_fast([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)], add_special_tokens=False)
        return self._parted(np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32), [len(w.encode("utf-8")) for w in words])

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lots = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
        spelt = [s if s.isascii() else s.encode("utf-8").decode("latin-1").translate(self.table) for s in lots]
        found = self.merges.encode_batch_fast(spelt, add_special_tokens=False)
        sizes = [len(w) for s in spelt for w in s.split(" ")]
        return self._parted(np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32), sizes)

    def _parted(self, ids: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """ids, and where those of each word end, by the words' bytes."""
        covered, bounds = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        ends = np.searchsorted(covered, bounds) + 1
        if (covered[ends - 1] != bounds).any() or ends[-1] != len(ids):
            raise AssertionError("tokens do not spell the words")
        return ids, ends


def words(path: str) -> Words:
    """One per worker process and file; an executor has few workers, and its cache is bounded."""
    if (Words, path) not in _loaded:
        _loaded[Words, path] = Words(path)
    return _loaded[Words, path]
