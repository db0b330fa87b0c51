"""Adaptive context-mixing range coder for token ids, in independent, checksummed blocks.

Model. Three predictors share one range. Order 2: the id that last followed the two ids before,
and how often in turn it was right. Order 1: counts of what followed the id before. Order 0:
counts of all ids. How much of the range each gets is learned, for each pair of order 2's
confidence and order 1's number of observations, from which predictor the ids so far were found
by: order 2 if it guesses the id, else order 1 if it has seen it there, else order 0. An id that
is new to the block is an escape in order 0, followed by the id in equal parts of the range.

Speed. A block's ids are cut into ``lanes`` of equal length, each with a range coder of its own;
all lanes take one step at a time with numpy and share the model. Order 2 learns after each step,
the others after steps whose numbers grow in proportion, so that a block counts its ids few times
over. Counts are scaled to powers of two, and the decoder finds ids by tables over parts of that
scale. The decoder repeats the encoder's steps; a block starts from nothing and can be read alone.

Coder. Ranges are 2**32 to 2**48 wide before each id, of which the model divides 2**SCALE parts.
Lanes give out 16 bits at a time; carries are added when a block is finished.

Block: magic, vocabulary size, ids, lanes, CRC-32 of the ids, all words, bytes of sizes; words of
each lane (zlib), the lanes' words; CRC-32 of all before it. A wrong checksum or a short block
raises ValueError. No ids make a block without lanes' words. ids are below the vocabulary's size,
which is LARGEST at most.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np

MAGIC = b"TLC2"
HEAD = struct.Struct("<4sIIIIII")
SUM = struct.Struct("<I")
LARGEST = 1 << 22
SCALE = 24
WHOLE = 1 << SCALE
#: Powers of two that counts of order 1 and order 0 are scaled to, which are their least shares, too.
ONE, ZERO = 14, 16
#: Parts of an order-1 scale that a table says the first id of.
PARTS = 8
TRUST, SEEN = 8, 16
TABLE = 18
LANE_IDS, MOST_LANES = 256, 16384
_LOW, _TOP = np.uint64((1 << 32) - 1), 1 << 48


if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit numbers")


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of contiguous 32-bit ids, as they stand."""
    return zlib.crc32(memoryview(ids).cast("B")) if len(ids) else 0


def lanes_for(n: int) -> int:
    return int(min(MOST_LANES, max(1, n // LANE_IDS)))


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(63 - bits)) & np.int64((1 << bits) - 1)


class Model:
    """What encoder and decoder know alike before each step of all lanes."""

    def __init__(self, vocabulary: int, lanes: int, decoding: bool = False):
        self.vocabulary, self.decoding = vocabulary, decoding
        self.guess = np.zeros(1 << TABLE, np.int32)  # id * TRUST + confidence
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        # Found by order 0, 1, 2, for each pair of confidences; at first as if they were to be believed.
        sure, seen = np.divmod(np.arange(TRUST * SEEN), SEEN)
        two, one = sure / (sure + 2), seen / (seen + 2)
        self.routes = np.stack([(1 - two) * (1 - one), (1 - two) * one, two], axis=1)
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.single = np.zeros(vocabulary, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.step, self.due = 0, 1
        self._count()

    def _count(self) -> None:
        """Let orders 0 and 1 and the shares learn from the steps since the last time."""
        v = self.vocabulary
        if self.fresh:
            last, now, kind, route = (np.concatenate(x) for x in zip(*self.fresh))
            self.fresh = []
            self.routes += np.bincount(kind * np.int16(3) + route, minlength=self.routes.size).reshape(-1, 3)
            self.single += np.bincount(now, minlength=v)
            new, times = np.unique(last * np.int64(v) + now, return_counts=True)
            place = np.searchsorted(self.keys, new)
            known = np.append(self.keys, -1)[place] == new
            self.counts[place[known]] += times[known]
            late = place[~known] + np.arange(np.count_nonzero(~known))  # where what is new comes to stand
            old = np.ones(len(self.keys) + len(late), bool)
            old[late] = False
            keys, counts = np.empty(len(old), np.int64), np.empty(len(old), np.int64)
            keys[old], keys[late], counts[old], counts[late] = self.keys, new[~known], self.counts, times[~known]
            self.keys, self.counts = keys, counts
        self._scale_one()
        self._scale_zero()
        parts = self.routes / self.routes.sum(axis=1, keepdims=True) * (WHOLE - (1 << ZERO) - (1 << ONE))
        self.share2 = parts[:, 2].astype(np.int64)
        self.share1 = parts[:, 1].astype(np.int64) + (1 << ONE)
        self.share2[:SEEN] = 0  # no guess
        self.share1[::SEEN] = 0  # nothing seen after this id

    def _scale_one(self) -> None:
        """Lists of what followed each id, scaled to 2**ONE."""
        v, n, keys, counts = self.vocabulary, len(self.keys), self.keys, self.counts
        before = keys // v
        self.ids = (keys - before * v).astype(np.int32)
        starts = np.flatnonzero(np.diff(before, prepend=-1))
        sizes = np.diff(np.append(starts, n))
        totals = np.add.reduceat(counts, starts) if n else np.zeros(0, np.int64)
        most = 1 << (ONE - 1)
        if n and sizes.max() > most:  # more than the scale has room for: the most frequent only
            order = np.lexsort((-counts, before))
            stay = np.sort(order[np.arange(n) - np.repeat(starts, sizes) < most])
            keys, before, counts, self.ids = keys[stay], before[stay], counts[stay], self.ids[stay]
            n, sizes = len(before), np.minimum(sizes, most)
            starts = np.cumsum(sizes) - sizes
            totals = np.add.reduceat(counts, starts)
        place = np.arange(n) - np.repeat(starts, sizes)
        under = np.cumsum(counts) - counts
        under -= np.repeat(under[starts], sizes)
        start = under * np.repeat((1 << ONE) - sizes, sizes) // np.repeat(totals, sizes) + place
        stop = np.append(start[1:], 1 << ONE)
        stop[starts[1:] - 1] = 1 << ONE
        self.both = (start << (ONE + 1) | (stop - start)).astype(np.int32)  # where an entry starts, and its width
        self.seen = np.zeros(v, np.int16)
        self.seen[before[starts]] = np.minimum(SEEN - 1, 1 + np.log2(totals).astype(np.int16))
        if self.decoding:  # for each part of each list, the entry that holds its first place
            width = 1 << (ONE - PARTS)
            last = np.repeat(starts, sizes) + np.repeat(sizes, sizes) == np.arange(n) + 1
            covers = -(-stop // width) - -(-start // width)
            covers[last] = (1 << PARTS) - -(-start[last] // width)
            self.stop = stop.astype(np.int32)
            self.part = np.repeat(np.arange(n, dtype=np.int32), covers)
            self.list = np.zeros(v, np.int64)
            self.list[before[starts]] = np.arange(len(starts)) << PARTS
        else:
            self._index(keys)

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressed table of the lists' entries by pair, half full at most."""
        self.bits = max(4, int(2 * len(keys)).bit_length())
        place = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), _hashed(keys, self.bits)
        while len(todo):
            free = place[at] < 0
            place[at[free]] = todo[free]
            lost = place[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.pair, self.held_both = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        used = np.flatnonzero(place >= 0)
        self.pair[used], self.held_both[used] = keys[place[used]], self.both[place[used]]

    def entry(self, keys: np.ndarray) -> np.ndarray:
        """Start and width of each pair; -1 if not seen."""
        at = _hashed(keys, self.bits)
        found, held = self.held_both[at], self.pair[at]
        other = np.flatnonzero(held != keys)
        while len(other):
            other = other[held[other] >= 0]
            step = (at[other] + 1) & ((1 << self.bits) - 1)
            at[other], held[other], found[other] = step, self.pair[step], self.held_both[step]
            other = other[held[other] != keys[other]]
        return found

    def _scale_zero(self) -> None:
        """Ids of the block so far, and an escape, scaled to 2**ZERO."""
        ids = np.flatnonzero(self.single)
        if len(ids) > 1 << (ZERO - 1):
            ids = np.sort(ids[np.argsort(-self.single[ids], kind="stable")[: 1 << (ZERO - 1)]])
        counts = np.append(self.single[ids], 1 + np.count_nonzero(self.single == 1))  # an id is as likely new as it was lately
        cum = np.concatenate([[0], np.cumsum(counts)])
        cum = cum * ((1 << ZERO) - len(counts)) // cum[-1] + np.arange(len(cum))
        cum[-1] = 1 << ZERO
        self.escape = self.vocabulary
        self.start0, self.stop0 = np.zeros(self.vocabulary + 1, np.int64), np.zeros(self.vocabulary + 1, np.int64)
        all_ids = np.append(ids, self.escape)
        self.start0[all_ids], self.stop0[all_ids] = cum[:-1], cum[1:]
        if self.decoding:
            self.place0 = np.repeat(all_ids.astype(np.int32), np.diff(cum))

    def predict(self) -> None:
        # Products wrap around 32 bits; the high ones are well mixed.
        self.slot = ((self.last * np.int32(0x1E3779B1) + self.before * np.int32(0x05EBCA6B)) >> (31 - TABLE)) & np.int32((1 << TABLE) - 1)
        self.held = self.guess[self.slot]
        self.guessed, self.sure = self.held >> 3, (self.held & (TRUST - 1)).astype(np.int16)
        self.kind = self.sure * np.int16(SEEN) + self.seen[self.last]
        self.two, self.one = self.share2[self.kind], self.share1[self.kind]

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, width, route) of each lane's id; in order 0 an id that is new has the escape's."""
        entry = self.entry(self.last * np.int64(self.vocabulary) + ids)
        return self._spans(ids, entry, (ids == self.guessed) & (self.two > 0))

    def _spans(self, ids, entry, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = entry >> (ONE + 1)
        start = self.one * at >> ONE
        width = (self.one * (at + (entry & ((1 << (ONE + 1)) - 1))) >> ONE) - start
        start += self.two
        route = np.ones(len(ids), np.int8)
        rest = np.flatnonzero(entry < 0)
        known, ahead = ids[rest], self.two[rest] + self.one[rest]
        known[self.stop0[known] == 0] = self.escape
        zero = WHOLE - ahead
        lo = zero * self.start0[known] >> ZERO
        start[rest], width[rest] = ahead + lo, (zero * self.stop0[known] >> ZERO) - lo
        route[rest] = 0
        two = np.flatnonzero(right)
        start[two], width[two], route[two] = 0, self.two[two], 2
        return start, width, route

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id, start, width, route) of the spans that hold each lane's place; an id that is new is the escape."""
        v = at - self.two
        if len(self.both):  # as if order 1 had found every id; the others follow
            t = np.minimum(np.maximum(((v << ONE) + ((1 << ONE) - 1)) / np.maximum(self.one, 1), 0), (1 << ONE) - 1).astype(np.int32)
            j = self.part[self.list[self.last] + (t >> (ONE - PARTS))]
            ahead = np.flatnonzero(self.stop[j] <= t)
            while len(ahead):
                j[ahead] += 1
                ahead = ahead[self.stop[j[ahead]] <= t[ahead]]
            entry, ids = self.both[j], self.ids[j]
        else:
            entry, ids = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        zero = np.flatnonzero(v >= self.one)
        one = self.one[zero]
        t = ((((v[zero] - one + 1) << ZERO) - 1) / (WHOLE - self.two[zero] - one)).astype(np.int64)
        entry[zero], ids[zero] = -1, self.place0[t]
        right = v < 0
        two = np.flatnonzero(right)
        ids[two], entry[two] = self.guessed[two], 0
        start, width, route = self._spans(ids, entry, right)
        return ids, start, width, route

    def learn(self, ids: np.ndarray, route: np.ndarray) -> None:
        hit = self.guessed == ids
        held = self.held - 1 + hit * (np.int32(1) + (self.sure < TRUST - 1))
        anew = np.flatnonzero(~hit & (self.sure <= 1))
        held[anew] = ids[anew] * TRUST + 1
        self.guess[self.slot] = held
        self.fresh.append((self.last, ids, self.kind, route))
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step >= self.due:
            self.due = 4 * self.step
            self._count()


class _Out:
    """Range coders of all lanes, and what they have given out."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP, np.uint64)
        self.sent: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, lanes, start: np.ndarray, width: np.ndarray) -> None:
        """lanes: all (slice) or some (places)."""
        unit = self.span[lanes] >> np.uint64(SCALE)
        self.low[lanes] += start.view(np.uint64) * unit
        self.span[lanes] = width.view(np.uint64) * unit
        k = np.flatnonzero(self.span <= _LOW)
        while len(k):
            self.sent.append((k.astype(np.uint16), (self.low[k] >> np.uint64(32)).astype(np.int32)))
            self.low[k] = (self.low[k] & _LOW) << np.uint64(16)
            self.span[k] <<= np.uint64(16)
            k = k[self.span[k] <= _LOW]

    def words(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of 16-bit words of each lane, all words)."""
        # One more word tells a value inside the last range; the decoder goes on with zeros.
        self.sent.append((np.arange(lanes, dtype=np.uint16), ((self.low + _LOW) >> np.uint64(32)).astype(np.int32)))
        lane, word = (np.concatenate(x) for x in zip(*self.sent))
        self.sent = []
        order = np.argsort(lane, kind="stable")  # of 16 bits: a radix sort
        word = word[order]
        over = np.flatnonzero(word >> 16)
        while len(over):  # carries go to the word before, of the same lane, as a value is below its lane's first range
            word[over] &= 0xFFFF
            np.add.at(word, over - 1, 1)
            over = np.flatnonzero(word >> 16)
        return np.bincount(lane, minlength=lanes), word.astype("<u2")


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block. ids: integers below vocabulary, any number of them."""
    if not 0 < vocabulary <= LARGEST:
        raise ValueError(f"a vocabulary of {vocabulary} ids; at most {LARGEST}")
    ids = np.asarray(ids)
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocabulary:
        raise ValueError("an id is outside the vocabulary")
    ids = np.ascontiguousarray(ids, np.int32)
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    table = np.zeros((steps, lanes), np.int32)  # a lane is a column; the last ones may be filled in part or not
    if n:
        full = n // steps
        table[:, :full] = ids[: full * steps].reshape(full, steps).T
        table[: n - full * steps, full : full + 1] = ids[full * steps :, None]
    crc = checksum(ids)
    sizes, words = np.zeros(0, np.int64), np.zeros(0, "<u2")
    if n:
        model, out, equal = Model(vocabulary, lanes), _Out(lanes), WHOLE // vocabulary
        for now in table:
            model.predict()
            start, width, route = model.spans(now)
            out.put(slice(None), start, width)
            new = np.flatnonzero((route == 0) & (model.stop0[now] == 0))
            if len(new):
                out.put(new, now[new] * np.int64(equal), np.full(len(new), equal))
            model.learn(now, route)
        sizes, words = out.words(lanes)
    packed = zlib.compress(sizes.astype("<u4").tobytes())
    head = HEAD.pack(MAGIC, vocabulary, n, lanes, crc, len(words), len(packed))
    block = head + packed + words.tobytes()
    return block + SUM.pack(zlib.crc32(block))


def decode(block: bytes) -> np.ndarray:
    """The ids of one block, checked."""
    if len(block) < HEAD.size + SUM.size:
        raise ValueError("block is too short")
    magic, vocabulary, n, lanes, crc, total, packed = HEAD.unpack_from(block)
    if magic != MAGIC or len(block) != HEAD.size + packed + 2 * total + SUM.size:
        raise ValueError("not a block of token ids, or cut short")
    if SUM.unpack_from(block, len(block) - SUM.size)[0] != zlib.crc32(memoryview(block)[: -SUM.size]):
        raise ValueError("checksum of a block differs")
    if not n:
        return np.zeros(0, np.int32)
    sizes = np.frombuffer(zlib.decompress(block[HEAD.size : HEAD.size + packed]), "<u4").astype(np.int64)
    # Zeros after each lane's words, for a lane may look two words ahead.
    place = np.arange(total) + np.repeat(3 * np.arange(lanes), sizes)
    words = np.zeros(total + 3 * lanes, np.uint64)
    words[place] = np.frombuffer(block, "<u2", total, HEAD.size + packed)
    at = np.cumsum(sizes + 3) - (sizes + 3)
    steps, equal = -(-n // lanes), WHOLE // vocabulary
    model = Model(vocabulary, lanes, decoding=True)
    span, code = np.full(lanes, _TOP, np.uint64), np.zeros(lanes, np.uint64)
    for k in range(3):
        code = (code << np.uint64(16)) | words[at + k]
    at += 3

    def place_of(k) -> tuple[np.ndarray, np.ndarray]:
        unit = span[k] >> np.uint64(SCALE)
        return np.minimum((code[k].astype(np.float64) / unit.astype(np.float64)).astype(np.int64), WHOLE - 1), unit

    def take(k, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        code[k] -= start.view(np.uint64) * unit
        span[k] = width.view(np.uint64) * unit
        more = np.flatnonzero(span <= _LOW)
        while len(more):
            code[more] = (code[more] << np.uint64(16)) | words[np.minimum(at[more], len(words) - 1)]
            at[more] += 1
            span[more] <<= np.uint64(16)
            more = more[span[more] <= _LOW]

    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        model.predict()
        found, unit = place_of(slice(None))
        now, start, width, route = model.find(found)
        take(slice(None), start, width, unit)
        new = np.flatnonzero(now == model.escape)
        if len(new):
            found, unit = place_of(new)
            now[new] = np.minimum(found // equal, vocabulary - 1)
            take(new, now[new] * np.int64(equal), np.full(len(new), equal), unit)
        model.learn(now, route)
        out[t] = now
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n]
    if checksum(ids) != crc:
        raise ValueError("checksum of a block of token ids differs")
    return ids
