"""Token-id files: an adaptive context-mixing range coder over independently reset blocks.

Block format (numbers of the head big endian, arrays little endian)
-------------------------------------------------------------------
magic ``LMTB`` | version u8 | vocabulary u32 | documents u32 | ids u64 | lanes u32 | words u32 |
crc32 of everything after this field u32 | document ids i64[documents] | 1 where that id is null
u8[documents] | ids per document u32[documents] | lane word counts u16[lanes] | coded words
u32[words].

A block's ids are cut into equally long lanes that are coded side by side: step t codes the t-th id
of every lane.  The model is shared by the lanes, starts empty in each block and learns after every
few steps (every 65,536 ids in a long block's second half, more often before), so the decoder holds exactly the
encoder's state.  An id's probability mixes

* order 2: the id last seen after the two ids before it.  Its weight is the rate at which guesses of
  the same confidence have held in this block;
* order 1: the counts of the FOLLOWERS commonest ids after the id before it, weighted by how often
  this context's table has held the next id;
* order 0: the counts of the block so far;
* a floor that gives every id of the vocabulary a share,

laid out as sub-intervals of a range of 2**24.  The coder is a range coder with 64-bit low and range
that emits 32-bit words and carries into words already written.  A damaged block fails its checksum
and nothing else: blocks share no state.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD_SPACE, small_batches, stored

MAGIC, VERSION = b"LMTB", 3
HEAD = struct.Struct(">4sBIIQIII")
IDS_AT, IDS_BYTES = 14, 8  # place of the head's number of ids, counted from 1
RANGE_BITS = 24
RANGE = 1 << RANGE_BITS
MAX_LANES = 8192
BLOCK_IDS = 1 << 21
SLOT_BITS = 18
LOOK_BITS = 16
SHARE_BITS = 12  # resolution of an order-1 table
FOLLOWERS = 8  # one byte each in a 64-bit word, or 16 bits each in two
_SURE = 7  # guesses carry a confidence of 0 to 7
_AFTER = np.array([min(c + 1, _SURE) - c if right else -1 for c in range(8) for right in (False, True)], np.int32)
_GROWTH = 1.25  # order-0 tables are laid out anew when the ids seen have grown by this factor
_LOW, _WORD, _SHIFT = np.uint64(1 << 32), np.uint64(32), np.uint64(RANGE_BITS)
_PLACE = np.uint64(sum(j << (8 * (7 - j)) for j in range(8)))  # (1 << 8 j) * _PLACE >> 56 == j
_TOP_BYTE = np.uint64(56)
_FOURS, _HIGHS = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)  # four numbers of 16 bits side by side
_LAST_OF_FOUR, _SIGN_OF_FOUR = np.uint64(48), np.uint64(15)


class _Model:
    """The mixed predictions after what has been learnt; encoder and decoder keep one each."""

    def __init__(self, vocabulary: int):
        if vocabulary > RANGE // 2:
            raise ValueError("the vocabulary does not fit the coder's range")
        self.vocabulary = vocabulary
        self.top = RANGE - vocabulary  # above it lies the floor: one unit an id
        self.counts, self.seen, self.laid = np.zeros(vocabulary, np.int64), 0, 0
        self.cum, self.share, self.look = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64), None
        self.order2 = np.zeros(1 << SLOT_BITS, np.int32)  # guess << 3 | confidence
        self.held, self.tried = np.full(8, 0.5), np.full(8, 1.0)
        self.weight2 = np.zeros(8, np.int32)
        self.follower = np.full((vocabulary, FOLLOWERS), -1, np.int32)
        self.often = np.zeros((vocabulary, FOLLOWERS), np.int32)
        self.visits, self.row = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        self.edge = np.zeros((vocabulary, FOLLOWERS + 1), np.int32)  # of the followers' shares, from 0 on
        self.upto = [np.zeros(vocabulary, np.uint64) for _ in range(2)]  # the same from 1 on, four in a word

    def slot(self, before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
        h = before2.view(np.uint32) * np.uint32(0x9E3779B1)
        h += before1.view(np.uint32) * np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - SLOT_BITS)
        return h.astype(np.int64)

    def place(self, before1: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each id is among its context's followers, and its cell in the flat table."""
        hit = (self.follower.take(before1, 0) == ids[:, None]).view(np.uint64).ravel()
        cell = before1 * FOLLOWERS
        cell += ((hit * _PLACE) >> _TOP_BYTE).view(np.int64)
        return hit != 0, cell

    def intervals(self, ids: np.ndarray, held: np.ndarray, right: np.ndarray, before1: np.ndarray, hit1: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's sub-interval."""
        w2 = self.weight2.take(held & 7)
        unit, edge, cell = (self.top - w2) >> SHARE_BITS, self.edge.ravel(), cell + before1
        start = edge.take(cell)
        cell += 1
        width = (edge.take(cell) - start) * unit
        width *= hit1
        start *= unit
        start += w2
        far = np.flatnonzero(width == 0)
        if len(far):
            x, base = ids[far].astype(np.int64), w2[far] + edge.take(before1[far] * (FOLLOWERS + 1) + FOLLOWERS) * unit[far]
            s, w = self.top + x, 1
            if self.look is not None:
                left, c = self.top - base.astype(np.int64), self.cum.take(x)
                a = (c * left) >> LOOK_BITS
                c += self.share.take(x)
                w = ((c * left) >> LOOK_BITS) - a
                s = np.where(w, base + a, s)
                w = np.maximum(w, 1)
            start[far], width[far] = s, w
        guess = np.flatnonzero(right & (w2 > width))
        start[guess], width[guess] = 0, w2[guess]
        return start, width

    def find(self, v: np.ndarray, held: np.ndarray, before1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose sub-interval holds v, with its start and width."""
        w2 = self.weight2.take(held & 7)
        unit, t = (self.top - w2) >> SHARE_BITS, v - w2
        # quotients of numbers this small have the right integer part in doubles
        share = t / unit
        share = np.minimum(np.maximum(share, 0, out=share), 0x7FFF, out=share).astype(np.uint64)
        share *= _FOURS
        share |= _HIGHS  # less an edge that is not above it, a share keeps its highest bit
        below = ((share - self.upto[0].take(before1)) & _HIGHS) >> _SIGN_OF_FOUR
        share -= self.upto[1].take(before1)
        share &= _HIGHS
        share >>= _SIGN_OF_FOUR
        below += share
        below *= _FOURS
        below >>= _LAST_OF_FOUR
        j = below.view(np.int64)
        escape = j == FOLLOWERS
        cell = before1 * FOLLOWERS
        cell += np.minimum(j, FOLLOWERS - 1, out=j)
        x, edge = self.follower.ravel().take(cell), self.edge.ravel()
        cell += before1
        start = edge.take(cell)
        cell += 1
        width = (edge.take(cell) - start) * unit
        start *= unit
        start += w2
        escape &= t >= 0
        far = np.flatnonzero(escape)
        if len(far):
            s, base = v[far], start[far] + width[far]
            xf, w = s - self.top, np.ones(len(far), np.int64)
            if self.look is not None:
                low = np.flatnonzero(xf < 0)
                base = base[low]
                left = self.top - base.astype(np.int64)
                # and so have those of numbers below 2**40
                y = self.look.take((((s[low] - base + 1) * float(1 << LOOK_BITS) - 1) / left).astype(np.int64))
                c = self.cum.take(y)
                a = (c * left) >> LOOK_BITS
                c += self.share.take(y)
                xf[low], s[low], w[low] = y, base + a, (c * left >> LOOK_BITS) - a
            x[far], start[far], width[far] = xf, s, w
        guess = np.flatnonzero(t < 0)
        x[guess], start[guess], width[guess] = held[guess] >> 3, 0, w2[guess]
        return x, start, width

    def learn(self, ids: np.ndarray, lanes: int, slot: np.ndarray, held: np.ndarray, right: np.ndarray, before1: np.ndarray, hit1: np.ndarray, cell: np.ndarray) -> None:
        # order 0: all ids but the last step's have been contexts since; the first contexts are none
        times = np.bincount(before1, minlength=self.vocabulary)
        met = np.flatnonzero(times != 0)
        times = times.take(met)
        if self.seen:
            self.counts[met] += times
        self.seen += len(ids)
        if self.seen >= self.laid * _GROWTH:
            self._lay_out(self.counts + np.bincount(ids[-lanes:], minlength=self.vocabulary))
        # order 1, one row for each context met: count the followers found; one not found takes the
        # place of the rarest, which first loses what it has
        visits = self.visits.take(met) + times
        self.visits[met] = visits
        self.row[met] = np.arange(0, len(met) * FOLLOWERS, FOLLOWERS)
        found = self.row.take(before1)
        found += cell & (FOLLOWERS - 1)
        often = np.bincount(found, weights=hit1, minlength=len(met) * FOLLOWERS).astype(np.int32).reshape(-1, FOLLOWERS)
        often += self.often.take(met, 0)
        new, miss = np.full(len(met), -1, np.int32), np.flatnonzero(~hit1)
        new[found.take(miss) // FOLLOWERS] = ids.take(miss)
        lack = np.flatnonzero(new >= 0)
        rarest = often[lack].argmin(1)
        least = often[lack, rarest]
        free = least <= 1
        self.follower[met[lack[free]], rarest[free]] = new[lack[free]]
        often[lack, rarest] = np.where(free, 1, least - 1)
        self.often[met] = often
        # the table's share of the context: how many of its visits it explains.  A follower counts once
        # a visit at most, so the shares' sums fit 16 bits and can be made four at a time
        share = (often * (float(1 << SHARE_BITS) / (visits + 1))[:, None]).astype(np.uint16).view(np.uint64)
        share *= _FOURS
        share[:, 1] += (share[:, 0] >> _LAST_OF_FOUR) * _FOURS
        self.upto[0][met], self.upto[1][met] = share[:, 0], share[:, 1]
        self.edge[met, 1:] = share.view(np.uint16)
        # order 2
        kind = (held & 7) << 1
        kind += right
        rates = np.bincount(kind, minlength=16)
        self.held += rates[1::2]
        self.tried += rates[::2] + rates[1::2]
        self.weight2 = (self.held / self.tried * 0.96 * self.top).astype(np.int32)
        self.weight2[0] = 0
        after = _AFTER.take(kind)
        after += held
        new = np.flatnonzero(kind == 0)
        after[new] = (ids.take(new) << 3) | 1
        self.order2[slot] = after

    def _lay_out(self, counts: np.ndarray) -> None:
        seen = np.flatnonzero(counts != 0)  # what was seen stays seen
        edge = np.cumsum(counts[seen])
        edge = edge * (1 << LOOK_BITS) // edge[-1]
        width = np.diff(edge, prepend=0)
        self.share[seen], self.cum[seen] = width, edge - width
        self.look = np.repeat(seen.astype(np.int32), width)
        self.laid = self.seen


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, max(n // 256, min(MAX_LANES // 2, n // 128))), -(-n // 65_000))
    return lanes, -(-n // lanes)


def _epochs(steps: int) -> Iterator[tuple[int, int]]:
    """The steps between which the model learns."""
    at = k = 0
    while at < steps:
        stop = min(steps, at + (1 if k < 10 else 2 if k < 30 else 4 if k < 50 else 8))
        yield at, stop
        at, k = stop, k + 1


def encode_block(ids: np.ndarray, lengths: np.ndarray, vocabulary: int, doc_ids: list | None = None) -> bytes:
    """One self-contained block of the documents' ids, in order."""
    n = len(ids)
    lanes, steps = _shape(n) if n else (0, 0)
    doc_ids = [None] * len(lengths) if doc_ids is None else doc_ids
    body = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.asarray(lengths, "<u4").tobytes()]
    n_words = 0
    if n:
        grid = np.zeros(lanes * steps, np.int32)
        grid[:n] = ids
        grid, before = grid.reshape(lanes, steps), np.zeros((steps + 2, lanes), np.int32)
        for k in range(0, lanes, 64):  # a few lanes at once stay in the cache
            before[2:, k : k + 64] = grid[k : k + 64].T
        model = _Model(vocabulary)
        low, size = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        room = steps * RANGE_BITS // 32 + 4
        words, first = np.zeros(lanes * room, np.uint32), np.arange(0, lanes * room, room)
        place = first.copy()

        def carry(at: np.ndarray) -> None:
            while len(at):
                more = words.take(at) + np.uint32(1)
                words[at] = more
                at = at[more == 0] - 1

        for begin, stop in _epochs(steps):
            x, b1, b2 = (before[begin + i : stop + i].ravel() for i in (2, 1, 0))
            slot = model.slot(b2, b1)
            b1 = b1.astype(np.int64)
            hit1, cell = model.place(b1, x)
            held = model.order2.take(slot)
            right = (held >> 3) == x
            start, width = (y.astype(np.uint64).reshape(-1, lanes) for y in model.intervals(x, held, right, b1, hit1, cell))
            for s, w in zip(start, width, strict=True):
                size >>= _SHIFT
                add = size * s
                low += add
                over = np.flatnonzero(low < add)
                if len(over):
                    carry(place[over] - 1)
                size *= w
                full = np.flatnonzero(size < _LOW)
                if len(full):
                    out, at = low.take(full), place.take(full)
                    words[at] = out >> _WORD
                    at += 1
                    place[full] = at
                    low[full] = out << _WORD
                    size[full] = size.take(full) << _WORD
            model.learn(x, lanes, slot, held, right, b1, hit1, cell)
        # the first multiple of 2**32 from low on lies in the range; its lower word need not be written
        end = low + (_LOW - np.uint64(1))
        carry(place[end < low] - 1)
        words[place] = end >> _WORD
        count = place + 1 - first
        n_words = int(count.sum())
        body += [count.astype("<u2").tobytes(), words.reshape(lanes, room)[np.arange(room)[None, :] < count[:, None]].astype("<u4").tobytes()]
    payload = b"".join(body)
    return HEAD.pack(MAGIC, VERSION, vocabulary, len(lengths), n, lanes, n_words, zlib.crc32(payload)) + payload


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, ids per document, document ids); ValueError if the block is damaged."""
    if len(block) < HEAD.size:
        raise ValueError("token block is cut short")
    magic, version, vocabulary, n_docs, n, lanes, n_words, crc = HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token block of this version")
    payload = memoryview(block)[HEAD.size :]
    if zlib.crc32(payload) != crc:
        raise ValueError("token block fails its checksum")
    doc_ids = [None if null else d for d, null in zip(np.frombuffer(payload, "<i8", n_docs).tolist(), bytes(payload[8 * n_docs : 9 * n_docs]), strict=True)]
    at = 9 * n_docs
    lengths = np.frombuffer(payload[at : at + 4 * n_docs], "<u4")
    if not n:
        return np.zeros(0, np.int64), lengths, doc_ids
    at += 4 * n_docs
    count = np.frombuffer(payload, "<u2", lanes, at).astype(np.int64)
    at += 2 * lanes
    words = np.zeros(n_words + 3, np.uint64)  # beyond its words a lane may read anything
    words[:n_words] = np.frombuffer(payload, "<u4", n_words, at)
    place = np.cumsum(count) - count
    steps = -(-n // lanes)
    grid = np.zeros((steps + 2, lanes), np.int32)  # two rows of zeros, then the ids
    model = _Model(vocabulary)
    stop_at = place + count
    code = words.take(place) << _WORD | np.where(count > 1, words.take(place + 1), np.uint64(0))
    place += 2
    size, most = np.full(lanes, np.iinfo(np.uint64).max, np.uint64), np.uint64(RANGE - 1)
    for begin, stop in _epochs(steps):
        # slots and contexts of the steps are as they were coded: only what is learnt changes them
        slots, b1s = (np.empty((stop - begin, lanes), np.int64) for _ in range(2))
        helds = np.empty((stop - begin, lanes), np.int32)
        for t in range(begin, stop):
            slots[t - begin] = slot = model.slot(grid[t], grid[t + 1])
            b1s[t - begin] = grid[t + 1]
            helds[t - begin] = held = model.order2.take(slot)
            size >>= _SHIFT
            v = np.minimum(code // size, most).astype(np.int32)
            x, start, width = model.find(v, held, b1s[t - begin])
            code -= size * start.astype(np.uint64)
            size *= width.astype(np.uint64)
            full = np.flatnonzero(size < _LOW)
            if len(full):
                at = place.take(full)
                new = words.take(np.minimum(at, n_words))
                new[at >= stop_at.take(full)] = 0
                code[full] = code.take(full) << _WORD | new
                size[full] = size.take(full) << _WORD
                at += 1
                place[full] = at
            grid[t + 2] = x
        x, b1, held = grid[begin + 2 : stop + 2].ravel(), b1s.ravel(), helds.ravel()
        model.learn(x, lanes, slots.ravel(), held, (held >> 3) == x, b1, *model.place(b1, x))
    return np.ascontiguousarray(grid[2:].T).ravel()[:n], lengths, doc_ids


# ----------------------------------------------------------------------------- tokenizing

_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def byte_units(text: str) -> list[str]:
    """Pieces across which a byte-level tokenizer with optional leading space never merges."""
    return [text] if ODD_SPACE.search(text) else _UNITS.findall(text)


#: What rules out words cut at single spaces and line ends: white space of another kind, control
#: characters, and breaks that stand together or at a text's edge.
_UNEVEN = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|[ \n][ \n]|\A | \z"
#: Latin letters, one pre-token of every tokenizer used here; at a line's start after the line end.
_LETTERS = "A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}"


def _byte_signs() -> dict[int, int]:
    """The sign by which byte-level vocabularies write each byte: printable Latin-1 stands for
    itself, the other bytes are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_SIGNS = _byte_signs()


# a byte as such vocabularies write it; a line end parts words
_WRITTEN = np.arange(256, dtype="<u4")
_WRITTEN[list(_BYTE_SIGNS)] = list(_BYTE_SIGNS.values())
_WRITTEN[10] = 32


def _ends(words: pa.StringArray, cores: pa.StringArray) -> pa.StringArray:
    """What follows its core in each word."""
    size, core = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, cores))
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
    size -= core
    end = np.cumsum(size)
    place = np.repeat(start + core - (end - size), size)
    place += np.arange(len(place))
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8).take(place)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(raw))


class _Table:
    """Words, which Arrow looks up, and their ids."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    def places(self, names: pa.StringArray, learn, bound: int) -> pa.Array:
        """Places of distinct words.  Those that lack are learnt: learn() gives their ids.  Over the
        bound, words that are not asked for here are forgotten, which changes the speed only."""
        at = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy().astype(np.int64)
        lack = np.flatnonzero(at < 0)
        if len(lack):
            if len(self) + len(lack) > bound:
                kept = pa.array(at[at >= 0])
                self.words, self.ids = self.words.take(kept), self.ids.take(kept)
                at[at >= 0] = np.arange(len(kept))
            new = names.take(pa.array(lack))
            ids = learn(new)
            at[lack] = np.arange(len(self), len(self) + len(lack))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
        return pa.array(at)


class CachedEncoder:
    """Ids as little-endian u32 bytes; the library encodes each distinct unit once per worker.

    A unit made of letters and closing punctuation is two pre-tokens for every tokenizer used here,
    so its parts are looked up on their own.  What is kept is bounded, which changes the speed only."""

    def __init__(self, path: str, split=byte_units, bound: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library, self.split, self.bound = Tokenizer.from_file(path), split, bound
        written = json.loads(self.library.to_str())
        self.special = [t["content"] for t in written["added_tokens"] if t["content"]]
        self.lower = '"Lowercase"' in json.dumps(written["normalizer"])
        self.cache: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}  # units that open with a space, without it
        self.line_end = np.array(self.library.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.tails: dict[str, bytes] = {}  # closing punctuation
        self.known, self.cores = _Table(), _Table()  # words as batch() marks them; the same without closing punctuation
        self.letters = None  # the library's model on words that are one pre-token and written as its vocabulary writes them
        if written["normalizer"] is None and written["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.letters = Tokenizer(self.library.model)
            self.letters.pre_tokenizer = CharDelimiterSplit(" ")
        names = self.library.get_vocab()
        self.opens_with_space, self.is_line_end = (np.zeros(self.vocabulary, bool) for _ in range(2))
        self.opens_with_space[[i for t, i in names.items() if t[:1] == chr(_BYTE_SIGNS[32])]] = True
        self.is_line_end[np.frombuffer(self.line_end, "<u4")] = True

    def has_special(self, text: str) -> bool:
        """Does the text hold the string of an added token?  The library takes such strings out before
        it looks at anything else, so these texts go to it whole."""
        return any(t in text for t in self.special)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.has_special(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        units = self.split(text)
        if self.split is byte_units:
            found = [self.spaced.get(u[1:]) if u[:1] == " " else self.cache.get(u) for u in units]
        else:
            found = list(map(self.cache.get, units))
        try:
            return b"".join(found)
        except TypeError:  # some are not cached yet
            new = self._learn({u for u, v in zip(units, found, strict=True) if v is None})
            return b"".join([new[u] if v is None else v for u, v in zip(units, found, strict=True)])

    def batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of many texts under byte_units.  Texts with even breaks are split and their words made
        distinct by Arrow, so that a word is looked up once a batch."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, _UNEVEN))
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, "".join(f"\\x{{{ord(c):x}}}" for c in t)))
        plain = pc.invert(pc.fill_null(odd, True))
        out: list = [None] * len(texts)
        even = texts.filter(plain)
        if len(even):
            # a line's first word stands after the line end, the others follow a space; the line end
            # put before each text is left out again
            split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(even, "\n", " \n"), ""), " ")
            words = split.flatten().dictionary_encode()
            at = self._places(words.dictionary)
            of_word = self.known.ids.take(at).take(words.indices)
            ids = np.frombuffer(of_word.buffers()[2], "<u4")
            edge = (np.frombuffer(of_word.buffers()[1], np.int64)[split.offsets.to_numpy()] >> 2).tolist()
            skip = len(self.line_end) >> 2
            for i, a, b in zip(np.flatnonzero(plain.to_numpy(zero_copy_only=False)).tolist(), edge[:-1], edge[1:], strict=True):
                out[i] = ids[a + skip : b]
        return [np.frombuffer(self(texts[i].as_py()), "<u4") if x is None else x for i, x in enumerate(out)]

    def _places(self, names: pa.StringArray) -> pa.Array:
        """Places of distinct words among the known ones; new words join them."""
        return self.known.places(names, lambda new: self._words(new, pc.utf8_rtrim(new, string.punctuation)), self.bound)

    def _words(self, names: pa.StringArray, cores: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words as batch() marks them; cores are the same without closing punctuation.
        Letters and what follows them are two pre-tokens, so they are looked up apart."""
        parted = pc.match_substring_regex(cores, rf"\A\n?[{_LETTERS}]+\z")
        keys = pc.if_else(parted, cores, names)
        distinct, tails = keys.dictionary_encode(), _ends(names, keys).dictionary_encode()
        at = self.cores.places(distinct.dictionary, self._learn_cores, self.bound).take(distinct.indices)
        ends = pa.array([self._tail(t) for t in tails.dictionary.to_pylist()], pa.large_binary())
        return pc.binary_join_element_wise(self.cores.ids.take(at), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def _tail(self, tail: str) -> bytes:
        """Ids of closing punctuation."""
        ids = self.tails.get(tail)
        if ids is None:
            if len(self.tails) > 100_000:
                self.tails.clear()
            ids = self.tails[tail] = np.array(self.library.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def _learn_cores(self, keys: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words.  They are encoded in long texts - Latin letters after a space as the
        vocabulary writes them, other words that follow a space, words that stand after a line
        end - and cut where the space or the line end shows."""
        plain = np.zeros(len(keys), bool)
        if self.letters is not None:
            plain = pc.match_substring_regex(keys, rf"\A[{_LETTERS}]+\z").to_numpy(zero_copy_only=False)
        order, n_plain, parts = np.argsort(~plain, kind="stable"), int(plain.sum()), []
        for k in range(0, n_plain, 50_000):
            some = keys.take(pa.array(order[k : min(n_plain, k + 50_000)]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n ")[0].as_py()
            written = _WRITTEN.take(np.frombuffer(b" " + joined.encode(), np.uint8)).tobytes().decode("utf-32-le")
            ids = np.array(self.letters.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            edge = np.append(np.flatnonzero(self.opens_with_space[ids]), len(ids))
            if len(edge) != len(some) + 1:
                raise ValueError("the tokenizer merges across word breaks")
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * edge), pa.py_buffer(ids)]))
        names = keys.take(pa.array(order[n_plain:])).to_pylist()
        bare = {"": b""} | dict(self._cut([n[1:] for n in names if n[:1] == "\n" and n != "\n"], "\n", self.is_line_end, len(self.line_end)))
        spaced = dict(self._cut([n for n in names if n[:1] != "\n"], " ", self.opens_with_space))
        parts.append(pa.array([self.line_end + bare[n[1:]] if n[:1] == "\n" else spaced[n] for n in names], pa.large_binary()))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))

    def _cut(self, words: list[str], sign: str, opens: np.ndarray, skip: int = 0) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words that follow a sign, without the first `skip` bytes."""
        for k in range(0, len(words), 50_000):
            some = words[k : k + 50_000]
            ids = np.array(self.library.encode_batch_fast([sign + sign.join(some)], add_special_tokens=False)[0].ids, "<u4")
            edge = np.append(np.flatnonzero(opens[ids]), len(ids))
            if len(edge) != len(some) + 1:
                raise ValueError("the tokenizer merges across word breaks")
            raw, edge = ids.tobytes(), (4 * edge).tolist()
            yield from zip(some, [raw[a + skip : b] for a, b in zip(edge[:-1], edge[1:], strict=True)], strict=True)

    def _letters(self, word: str) -> list[int]:
        """Ids of Latin letters, one pre-token, by the library's model alone."""
        word = (word.lower() if self.lower else word).encode().decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.library.model.tokenize(word)]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of units the cache lacks.  Letters with closing punctuation are cached as a whole only
        if the letters were known before, so that what occurs once takes one entry."""
        if len(self.cache) + len(self.spaced) + len(missing) > self.bound:
            self.cache, self.spaced = {"": b""}, {}
        bare, spaced = self.cache, self.spaced
        out, rest = {}, []
        for u in missing:
            held, name = (spaced, u[1:]) if u[:1] == " " else (bare, u)
            core = name.rstrip(string.punctuation)
            if core.isalpha() and max(core) <= "\xff":
                ids, known = held.get(core), core in held
                if ids is None:
                    found = self._letters(u[: len(u) - len(name) + len(core)])
                    ids = held[core] = struct.pack(f"<{len(found)}I", *found)
                if core != name:
                    tail = name[len(core) :]
                    end = bare.get(tail)
                    if end is None:
                        end = bare[tail] = np.array(self.library.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
                    ids += end
                    if known:
                        held[name] = ids
                out[u] = ids
            else:
                rest.append(u)
        for u, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            out[u] = np.array(e.ids, "<u4").tobytes()
            if u[:1] == " ":
                spaced[u[1:]] = out[u]
            else:
                bare[u] = out[u]
        return out


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, split=byte_units) -> CachedEncoder:
    """This worker process's encoder; its cache outlives the task."""
    key = (path, split.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path, split)
    return _ENCODERS[key]


# ----------------------------------------------------------------------------- Spark side


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token files in ascending doc_id order: rows (part, block, data), stored in the shared folder.
    Each part covers a doc_id range; blocks within it are in order.  Everything about the documents
    stands in the blocks."""
    small_batches(docs.sparkSession, 8000, "24m")  # more texts a batch share more words
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = np.array([end_id], "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        encode = None
        held, doc_ids, lengths, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            data = encode_block(np.concatenate(held), np.array(lengths, np.int64), max(encode.vocabulary, end_id + 1), doc_ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["part", "block", "data"])

        for batch in batches:
            encode = encode or encoder(tokenizer_path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                n += len(ids) + 1
                if n >= block_ids:
                    yield out()
                    block += 1
                    held, doc_ids, lengths, n = [], [], [], 0
        if held:
            yield out()

    return stored(ordered.mapInArrow(pack, "part int, block int, data binary"), "token-blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document, from the blocks: doc_id, start, n_tokens, ids_crc32."""
    ids = F.conv(F.hex(F.substring("data", IDS_AT, IDS_BYTES)), 16, 10).cast("bigint")
    heads = blocks.select("part", "block", ids.alias("ids"))
    parts = heads.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row per file part
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block")
    sizes = heads.select("part", "block", (F.sum("ids").over(within) - F.col("ids")).alias("in_part"))
    starts = sizes.join(before, "part").select("part", "block", (F.col("in_part") + F.col("part_start")).alias("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, first = (batch.column(c)[i].as_py() for c in ("data", "first"))
                ids, lengths, doc_ids = decode_block(data)
                raw, edge = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(edge.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + edge - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(2, blocks.sparkSession.sparkContext.defaultParallelism * 4)
    return blocks.join(starts, ["part", "block"]).select("data", "first").repartition(n).mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the token files of docs(doc_id, text) and describe each document as read back.

    Null and empty texts hold the end id only; texts of any length are coded whole, a block ending
    with the text that fills it; repeated rows and ids are written row by row; ties of doc_id are
    ordered by text; columns besides doc_id and text, whatever their names, are not looked at; an
    empty table gives no block and an empty result."""
    return read_blocks(write_blocks(docs, tokenizer_path, end_id, block_ids))
