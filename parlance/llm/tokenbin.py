"""Token ids in compact files: an adaptive context-mixing range coder over blocks.

The probability of an id is a mixture: an order-0 distribution of the ids of the block so far,
and two point predictions, the id that last followed the id before (order 1) and the one that
last followed the two ids before (order 2).  The weight of a prediction is the learnt rate at
which predictions of its confidence have come true; the order-0 distribution keeps a
share for ids not seen yet.  Each id is one step of a range coder with carry.

A block of up to ``BLOCK`` ids starts from a fresh model and carries a crc32 of its ids, so any
block can be decoded alone.  It is cut into lanes of consecutive ids, which advance side by side
in numpy arrays, share the block's model and have a byte stream each.  Up to ``SIDE`` blocks with as many lanes and steps
are coded, and decoded, side by side as well, each with its own model and to the same bytes as alone; the last blocks of a file are of about one size for that.  The predictions of orders 1 and 2 learn after
every step from the ids of all lanes; the order-0 table and the weights are renewed after every ``RENEW`` steps.  All results are integers, so files do
not depend on the machine (the one division in floating point is exact: both sides are under 2^48).

A file holds the documents of one range of doc_id, in ascending order::

    magic "PTIDBIN4" | blocks | index | u64 index position | u32 crc32 of the index | magic
    block: u32 ids, u32 bytes, u32 crc32 of the ids (little-endian u32 each), bytes
    bytes: u16 lanes, u32 length in words of each lane, u16 words of the lanes
    index (zlib): u64 documents, u64 ids, then i64 doc_id, u8 null flag, u64 ids of each document

The tokenizers library encodes the words of the texts, and a worker remembers up to ``CACHE`` of
them.  A word starts with the blank or line feed before it, or with a sign that comes after an ASCII letter or digit: the
library's own splitting starts a new unit at these places, so the words' ids in a row are the ids of the whole text.  Texts in which that is
not sure (other white space, runs of it, words of over ``PIECE`` characters, special tokens) are
given to the library whole.  Arrow numbers the words of many texts at once.  New words go to the library in rows of ``ROW``, those
of a blank and Latin letters, which are one unit each, without its search for units; the bytes of the ids tell where a word ends.

Defined results: null counts as empty; every document ends with the end id, so an empty text has
one id; null doc_ids come first and are read back as null; of repeated rows each is stored,
their order among themselves is not defined.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..shipping import map_arrow
from .common import checkpoint, shared_dir, table

MAGIC = b"PTIDBIN4"
BLOCK, LANES, RENEW = 1 << 20, 1024, 8
SIDE = 4  # blocks of equal size that are coded side by side, at most 7
CONTEXTS = 18  # bits of an order-2 context's hash
IDS = 1 << 16  # ids lie below
END_ID = 0
READ_TASKS = 20_000  # at most, for the files to be read
CACHE = 1_000_000  # words that a worker remembers
PIECE = 64
ROW = 64  # new words that the library gets as one text
CALL = 32  # rows of words in one call
TOGETHER = 1 << 22  # characters of the texts whose words are told apart in one pass
_BITS = 28  # of the mixture's total
_TOTAL = 1 << _BITS
_LEVELS = 16  # of a prediction's confidence
_MISS, _HIT = 4, 3  # confidence of a new prediction, and what it gains when it comes true
_NEXT = np.array([min(k + _HIT, _LEVELS - 1) for k in range(_LEVELS)] + [_MISS if k < _MISS else k >> 1 for k in range(_LEVELS)], np.int32)  # confidence after a hit, after a miss


class _Models:
    """The statistics of blocks of equal size that advance side by side, each with its own: ``look`` gives the entries of a step,
    ``learn`` takes the ids that came, ``freeze`` makes the order-0 tables and the weights of the next steps.

    A row of a step holds the lanes of the blocks one after the other; rows of entries hold those of order 1 and then those of order 2.
    Tables of all blocks are one array, and a block's order-0 table starts where that of the block before ends, so that one search finds ids in all of them.
    """

    def __init__(self, blocks: int, lanes: int):
        self.counts = np.zeros((blocks, IDS), np.int32)
        self.seen, self.waiting = 0, []
        size = IDS + (1 << CONTEXTS)
        self.entries = np.zeros(blocks * size, np.int32)  # predicted id * _LEVELS + confidence, by context
        self.hits, self.tries = np.ones((2, blocks, _LEVELS), np.int64), np.full((2, blocks, _LEVELS), 4, np.int64)
        self.table = np.zeros(blocks * (IDS + 1), np.int32)
        number = np.repeat(np.arange(blocks, dtype=np.int64), lanes)
        self.of_counts, self.of_table, self.of_weights, self.of_total = (number * x for x in (IDS, IDS + 1, _LEVELS * _LEVELS, _TOTAL))
        self.of_one, self.of_two = number * size, number * size + IDS
        self.of_levels, self.of_came = (np.concatenate([number, number + blocks]) * x for x in (_LEVELS, _LEVELS + 1))

    def freeze(self) -> None:
        """The order-0 tables, in which every id has a floor that is larger while many ids are new, and the weights by confidence."""
        if self.waiting:
            blocks = len(self.counts)
            ids, level, came = map(np.concatenate, zip(*self.waiting))
            np.add.at(self.counts.reshape(-1), ids, np.int32(1))
            self.seen += ids.size // blocks
            self.tries += np.bincount(level, minlength=self.tries.size).reshape(self.tries.shape)
            self.hits += np.bincount(came, minlength=2 * blocks * (_LEVELS + 1)).reshape(2, blocks, _LEVELS + 1)[..., :_LEVELS]
        self.waiting = []
        distinct = np.array([np.count_nonzero(x) for x in self.counts])
        floor = np.maximum(_TOTAL >> 21, _TOTAL * (distinct + 64) // (self.seen + 128) // 2 // IDS)
        scale = (_TOTAL - floor * IDS) // max(1, self.seen)
        table = self.table.reshape(len(floor), -1)
        table[:, 0] = np.arange(len(floor)) * _TOTAL
        np.multiply(self.counts, scale.astype(np.int32)[:, None], out=table[:, 1:])
        table[:, 1:] += floor.astype(np.int32)[:, None]
        np.cumsum(table, axis=1, out=table)
        table[:, -1] = np.arange(1, len(floor) + 1) * _TOTAL
        one, two = np.minimum(self.hits * 4096 // self.tries, 3700)  # so that every id keeps a width in the rest
        two = np.repeat(_TOTAL * two.ravel() >> 12, _LEVELS)  # by block, order-2 confidence and order-1 confidence
        one = (_TOTAL - two) * np.tile(one, _LEVELS).ravel() >> 12
        self.weights = [one, two, _TOTAL - two - one]  # the last is the share of order 0

    def look(self, one: np.ndarray, two: np.ndarray) -> None:
        """The entries after the ids ``one`` (the last) and ``two`` (the one before), with their weights."""
        two = ((one * 40503 + two * 10007) * 2654435761 >> 8) & ((1 << CONTEXTS) - 1)
        self.at = np.concatenate([one + self.of_one, two + self.of_two])
        self.entry = self.entries.take(self.at)
        self.level = self.entry & _LEVELS - 1
        half = len(one)
        pair = self.of_weights + (self.level[half:] << 4 | self.level[:half])
        self.one, self.two, self.rest = (w.take(pair) for w in self.weights)
        self.guess = (self.entry >> 4).astype(np.int64)

    def learn(self, ids: np.ndarray) -> None:
        """Takes a step's ids; of a context's several ids the last one counts."""
        new = np.concatenate([ids, ids]).astype(np.int32) << 4
        came = np.minimum((self.entry ^ new).view(np.uint32), _LEVELS).view(np.int32)  # the confidence of what came true, else _LEVELS
        miss = came >> 4
        stays = -(miss & (self.level >= _MISS))  # all bits where the prediction is kept though it failed
        self.entries[self.at] = (new ^ (new ^ self.entry - self.level) & stays) | _NEXT.take(self.level | miss << 4)
        self.waiting.append((ids + self.of_counts, self.level + self.of_levels, came + self.of_came))

    def order0(self, ids: np.ndarray, share: np.ndarray, of_table: np.ndarray, of_total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper end) of ids in a share of their block's order-0 table."""
        at = ids + of_table
        return (self.table.take(at) - of_total) * share >> _BITS, (self.table.take(at + 1) - of_total) * share >> _BITS

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower end, width) of ids in the mixture."""
        half = len(ids)
        low, width = self.order0(ids, self.rest, self.of_table, self.of_total)
        width -= low
        for g, w in zip((self.guess[:half], self.guess[half:]), (self.one, self.two)):
            low += w & g - ids >> 63
            width += w * (ids == g)
        return low, width

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the values, and the intervals."""
        half = len(value)
        g1, g2, w1, w2 = self.guess[:half], self.guess[half:], self.one, self.two
        low1, high1 = self.order0(g1, self.rest, self.of_table, self.of_total)
        low2, high2 = self.order0(g2, self.rest, self.of_table, self.of_total)
        less, more = g1 - g2 >> 63, g2 - g1 >> 63  # all bits where the first guess lies before the second, after it
        high1 += w1 + (w2 & ~less)
        high2 += w2 + (w1 & ~more)
        low1 += w2 & more
        low2 += w1 & less
        below1, below2 = value - high1 >> 63, value - high2 >> 63
        is1, is2 = below1 & (low1 + ~value >> 63), below2 & (low2 + ~value >> 63)
        ids, start, high = g1 ^ (g1 ^ g2) & is2, low1 ^ (low1 ^ low2) & is2, high1 ^ (high1 ^ high2) & is2
        width = high - start
        other = np.flatnonzero((is1 | is2) == 0)
        shift = (w1 & ~below1) + (w2 & ~below2)
        wanted = ((value - shift + 1).take(other) << _BITS) - 1
        wanted //= self.rest.take(other)
        wanted += self.of_total.take(other)
        wanted = wanted << 16 | other  # a sorted search is kinder to the caches; a row is shorter than 1 << 16
        wanted.sort()
        other = wanted & 0xFFFF
        shift, share, of_table, of_total = (x.take(other) for x in (shift, self.rest, self.of_table, self.of_total))
        found = self.table.searchsorted((wanted >> 16).astype(np.int32), "right") - 1 - of_table
        low, high = self.order0(found, share, of_table, of_total)
        ids[other], start[other], width[other] = found, low + shift, high - low
        return ids, start, width


_RANGE = (1 << 48) - 1


def _shape(count: int) -> tuple[int, int]:
    """(lanes, steps) of a block."""
    lanes = max(1, min(LANES, count // 64))
    return lanes, -(-count // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """The coded bytes of at least one id."""
    return encode_blocks([ids])[0]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of blocks of one shape, each as if it were alone."""
    (lanes, steps), sides = _shape(len(blocks[0])), len(blocks)
    wide = lanes * sides
    columns = np.zeros((steps, wide), np.uint16)
    for k, ids in enumerate(blocks):
        padded = np.zeros(lanes * steps, np.uint16)
        padded[: len(ids)] = ids
        columns[:, k * lanes : (k + 1) * lanes] = padded.reshape(lanes, steps).T
    models = _Models(sides, lanes)
    low, span = np.zeros(wide, np.int64), np.full(wide, _RANGE, np.int64)
    room = 2 * steps + 8
    out, start_at = np.zeros(wide * room, np.uint16), np.arange(wide, dtype=np.int64) * room
    at = start_at.copy()
    one = two = np.zeros(wide, np.int64)  # two empty contexts before each lane
    for i in range(steps):
        if i % RENEW == 0:
            models.freeze()
        models.look(one, two)
        now = columns[i].astype(np.int64)
        start, width = models.interval(now)
        models.learn(now)
        one, two = now, one
        unit = span >> _BITS
        low += unit * start
        span = unit * width
        over = np.flatnonzero(low > _RANGE)
        if len(over):
            low[over] -= _RANGE + 1
            _carry(out, at[over] - 1)
        small = np.flatnonzero(span < 1 << 32)
        while len(small):
            some, place = low[small], at[small]
            out[place] = some >> 32
            at[small] = place + 1
            low[small] = (some << 16) & _RANGE
            left = span[small] << 16
            span[small] = left
            small = small[left < 1 << 32]
    for _ in range(3):
        out[at] = low >> 32
        at += 1
        low = (low << 16) & _RANGE
    used = at - start_at
    rows = out.reshape(sides, lanes, room)
    coded = []
    for row, n in zip(rows, used.reshape(sides, lanes)):
        coded.append(struct.pack("<H", lanes) + n.astype("<u4").tobytes() + np.concatenate([x[:m] for x, m in zip(row, n.tolist())]).astype("<u2").tobytes())
    return coded


def _carry(out: np.ndarray, at: np.ndarray) -> None:
    """Adds one at the places of different lanes; a word that wraps carries on to the word before."""
    while len(at):
        out[at] += 1
        at = at[out[at] == 0] - 1


def decode_block(coded: bytes, count: int) -> np.ndarray:
    """The ``count`` ids of a coded block."""
    return decode_blocks([coded], [count])[0]


def decode_blocks(blocks: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of coded blocks of one shape, which hold ``counts`` ids."""
    (lanes, steps), sides = _shape(counts[0]), len(blocks)
    if any(struct.unpack("<H", x[:2]) != (lanes,) for x in blocks):
        raise ValueError("a block has other lanes than its ids need")
    used = np.concatenate([np.frombuffer(x, "<u4", lanes, 2) for x in blocks]).astype(np.int64)
    words = np.concatenate([*(np.frombuffer(x, "<u2", -1, 2 + 4 * lanes) for x in blocks), np.zeros(4, "<u2")])
    at = np.concatenate([[0], np.cumsum(used)[:-1]])
    wide = lanes * sides
    models = _Models(sides, lanes)
    code, span = words.take(at).astype(np.int64) << 32 | words.take(at + 1).astype(np.int64) << 16 | words.take(at + 2), np.full(wide, _RANGE, np.int64)
    at += 3
    columns = np.zeros((steps, wide), np.uint16)
    one = two = np.zeros(wide, np.int64)
    for i in range(steps):
        if i % RENEW == 0:
            models.freeze()
        models.look(one, two)
        unit = span >> _BITS
        ids, start, width = models.find(np.minimum((code / unit).astype(np.int64), _TOTAL - 1))
        models.learn(ids)
        code -= unit * start
        span = unit * width
        small = np.flatnonzero(span < 1 << 32)
        while len(small):
            place = at[small]
            code[small] = code[small] << 16 | words.take(place, mode="clip")
            at[small] = place + 1
            left = span[small] << 16
            span[small] = left
            small = small[left < 1 << 32]
        columns[i] = ids
        one, two = ids, one
    return [columns[:, k * lanes : (k + 1) * lanes].T.ravel()[:count] for k, count in enumerate(counts)]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


# of ASCII, 1: blank and line feed, 2: letters and digits, 4: signs
_KINDS = bytes(1 if b in b" \n" else 2 if bytes([b]).isalnum() else 4 if b in b".,;:!?" else 0 for b in range(256))


# bytes that are no part of UTF-8's letters from U+00C0 to U+023F and of ASCII's; lead bytes of others are enough
_NO_LETTER = bytes(not (bytes([b]).isalpha() or 0x80 <= b < 0xC0 or 0xC3 <= b < 0xC9) for b in range(256))
_OTHER_SPACE = re.compile(r"[^\S \n]").search


def _plain(coder):
    """The library's tokenizer for words that are one match each, in the letters of byte-level vocabularies with line feeds between; None if it may work otherwise."""
    from tokenizers import Tokenizer, pre_tokenizers

    text = coder.to_str()
    spec = json.loads(text)
    splits = spec["pre_tokenizer"] or {}
    if any(spec[x] is not None for x in ("normalizer", "truncation", "padding")) or (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex")) != ("ByteLevel", False, True):
        return None
    if any(t["content"].isalpha() for t in spec["added_tokens"]):
        return None
    plain = Tokenizer.from_str(text)
    plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    return plain


_LETTERS = np.array([b if b in b"\r\n" else ord(letter) for b, letter in sorted(_byte_letters().items())], np.uint32)


class _Places(dict):
    """Numbers of words; a word that is not known gets the next one and waits in ``new``."""

    def __init__(self):
        self.new, self.last = [], -1

    def __missing__(self, word: str) -> int:
        self.last += 1
        self[word] = self.last
        self.new.append(word)
        return self.last


class Words:
    """Ids of whole texts by the tokenizers library, which sees every different word of the texts once.

    A word starts with the blank or line feed before it, or with a sign that comes after an ASCII letter or digit: no match of the pattern goes over these places.
    """

    def __init__(self, coder, pattern: str, cache: int | None = None):
        import regex

        if regex.findall(pattern, "a b\nc d") != ["a", " b", "\n", "c", " d"] or regex.findall(pattern, "a.b1,A;0:z!Z?9.") != list("a.b1,A;0:z!Z?9."):
            raise ValueError("the pattern does not cut before a blank, a line feed and a sign after a letter")
        self.cache = CACHE if cache is None else cache
        self.coder = coder
        self.specials = [t.content for t in coder.get_added_tokens_decoder().values()]
        self.plain = _plain(coder)
        self.widths = np.array([len(coder.id_to_token(i) or "") for i in range(coder.get_vocab_size())], np.int64)  # a byte is one character
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.total = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.odd, self.fed = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, bool, bool))
        self.count = 0
        self._numbers([b"\n"])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.coder.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _sizes(self, ids: np.ndarray, words: list[bytes]) -> np.ndarray | None:
        """How many of the ids each word has, told by where the words' bytes end; None if some end inside an id."""
        stops = np.concatenate([[0], np.cumsum(self.widths[ids])])
        want = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        at = np.searchsorted(stops, want)
        return np.diff(at) if at[-1] == len(ids) and (stops[at] == want).all() else None

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of sound words, how many each has): the words go to the library in rows of ``ROW``."""
        rows = ["".join(words[k : k + ROW]) for k in range(0, len(words), ROW)]
        ids = np.fromiter(chain.from_iterable(self._whole(rows)), np.uint32)
        sizes = self._sizes(ids, list(map(str.encode, words)))
        if sizes is None or any(t in row for row in rows for t in self.specials):
            found = self._whole(words)
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        return ids, sizes

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are a blank and letters: each is one match, so the library need not look for the matches."""
        if self.plain is not None:
            rows = b"\r".join(b"\n".join(words[k : k + ROW]) for k in range(0, len(words), ROW))
            rows = _LETTERS.take(np.frombuffer(rows, np.uint8)).tobytes().decode("utf-32-le").split("\r")
            found = (x.ids for k in range(0, len(rows), CALL) for x in self.plain.encode_batch_fast(rows[k : k + CALL], add_special_tokens=False))
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            sizes = self._sizes(ids, words)
            if sizes is not None:
                return ids, sizes
        return self._rows([w.decode() for w in words])

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of different words; those that are not known are encoded."""
        numbers = list(map(self.place.get, words))
        coded = [w for w, n in zip(words, numbers) if n is None]
        if not coded:
            return np.array(numbers, np.int64)
        first = self.count
        self.count += len(coded)
        numbers = np.array([-1 if n is None else n for n in numbers], np.int64)
        numbers[numbers < 0] = np.arange(first, self.count)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        start = np.cumsum(size) - size
        head = data.take(start)
        after = (head != 0x20) & (head != 0x0A)  # starts with a sign
        no_letter = np.frombuffer(data.tobytes().translate(_NO_LETTER), bool).copy()
        no_letter[1:] |= (data[:-1] == 0xC3) & (data[1:] | 0x20 == 0xB7)  # the signs of multiplication and division
        no_letter[start] = head != 0x20
        letters = ~np.logical_or.reduceat(no_letter, start) & (size > 1) & (size <= PIECE)
        long, odd = np.zeros(len(coded), bool), np.zeros(len(coded), bool)
        new: dict[int, str] = {}
        for k in np.flatnonzero(~letters).tolist():
            word = coded[k].decode()
            long[k] = len(word) > PIECE
            if long[k] or word == " " or _OTHER_SPACE(word):
                odd[k] = True
            else:  # in a row, a word that starts with a sign comes after a line feed, which is not taken
                new[k] = "\n" + word if after[k] else word
        after &= ~odd
        starts, sizes, parts = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64), []
        for chosen, encode, words in ((np.flatnonzero(letters), self._letters, list(compress(coded, letters.tolist()))), (np.array(list(new), np.int64), self._rows, list(new.values()))):
            if words:
                found, each = encode(words)
                starts[chosen] = self.total + sum(map(len, parts)) + np.cumsum(each) - each
                sizes[chosen] = each
                parts.append(found)
        found = np.concatenate([np.zeros(0, np.uint32), *parts])
        for name, need in (("starts", self.count), ("sizes", self.count), ("odd", self.count), ("fed", self.count), ("flat", self.total + len(found))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(need, have.dtype)]))
        where = slice(first, self.count)
        self.sizes[where], self.starts[where], self.odd[where] = sizes - after, starts + after, odd
        self.fed[where] = (head == 0x0A) & (size > 1)
        self.flat[self.total : self.total + len(found)] = found
        self.total += len(found)
        self.place.update(zip(coded, range(first, self.count)))
        for k in np.flatnonzero(long):  # not remembered
            del self.place[coded[k]]
        return numbers

    def encode(self, texts: list[str], after_blank: bool = False) -> list[np.ndarray]:
        """The ids of each text, or of a blank and the text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, text in enumerate(texts) if not any(t in text for t in self.specials)]
        done = 0
        while done < len(plain):
            size, first = 0, done
            while done < len(plain) and (size < TOGETHER or done == first):
                size += len(texts[plain[done]])
                done += 1
            for k, ids in zip(plain[first:done], self._together([texts[k] for k in plain[first:done]], after_blank)):
                out[k] = ids
            if self.count > self.cache:
                self.clear()
        whole = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(whole, self._whole([" " * after_blank + texts[k] for k in whole])):
            out[k] = np.array(ids, np.uint32)
        return out

    def _together(self, texts: list[str], after_blank: bool) -> Iterator[np.ndarray | None]:
        """The ids of each text, None where its words are not sure to have them; Arrow numbers the different words."""
        # without a blank before it, a line feed is put there, so that the first word is like one after a line feed
        before = b" " if after_blank else b"\n"
        coded = [before + text.encode() for text in texts]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        data = b"".join(coded)
        kind = np.frombuffer(data.translate(_KINDS), np.uint8)
        starts_word = kind == 1
        starts_word[1:] |= (kind[1:] == 4) & (kind[:-1] == 2)
        at = np.flatnonzero(starts_word)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        _, edges, letters = words.dictionary.buffers()
        letters, edges = letters.to_pybytes(), np.frombuffer(edges, np.int64, len(words.dictionary) + 1).tolist()
        codes = self._numbers([letters[a:b] for a, b in pairwise(edges)]).take(words.indices.to_numpy())
        stop = np.searchsorted(at, ends)  # of each text's words
        first = np.append(0, stop[:-1])
        alone = codes == 0  # a line feed by itself is sound before one that has a word, and as all of a text
        followed = np.append(self.fed.take(codes[1:]), False)
        followed[stop - 1] = False
        followed[first] = stop - first == 1
        odd = np.logical_or.reduceat(self.odd.take(codes) | alone & ~followed, first)
        each = self.sizes.take(codes)
        place = np.cumsum(each)
        ids = self.flat.take(np.repeat(self.starts.take(codes) - place + each, each) + np.arange(place[-1]))
        place = np.append(0, place)
        for wrong, a, b in zip(odd.tolist(), (place.take(first) + (not after_blank)).tolist(), place.take(stop).tolist()):
            yield None if wrong else ids[a:b]


@functools.lru_cache(maxsize=1)
def _words_of(vocabulary: str, pattern: str) -> Words:
    """The tokenizer of a worker, which keeps the words it knows from task to task."""
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_str(vocabulary), pattern)


class Writer:
    """Collects ids of documents and writes coded blocks as they fill."""

    def __init__(self, stream):
        self.stream, self.parts, self.waiting, self.index, self.total = stream, [], 0, [], 0
        stream.write(MAGIC)
        self.size = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, len(ids)))
        self.parts.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCK * SIDE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        sizes = [BLOCK] * (len(ids) // (BLOCK * SIDE) * SIDE)
        rest = len(ids) - sum(sizes)
        if last and rest:  # in blocks of about one size, so that they have one shape
            n = -(-rest // BLOCK)
            sizes += [(rest + k) // n for k in range(n)]
        stops = np.cumsum([0, *sizes]).tolist()
        cut, groups = stops[-1], []
        for first, stop in pairwise(stops):
            if groups and len(groups[-1]) < SIDE and _shape(len(groups[-1][0])) == _shape(stop - first):
                groups[-1].append(ids[first:stop])
            else:
                groups.append([ids[first:stop]])
        for blocks in groups:
            for block, coded in zip(blocks, encode_blocks(blocks)):
                self.stream.write(struct.pack("<III", len(block), len(coded), zlib.crc32(block.astype("<u4").tobytes())) + coded)
                self.size += 12 + len(coded)
        self.parts, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        docs = np.array([d if d is not None else 0 for d, _ in self.index], "<i8").tobytes()
        flags = np.array([d is None for d, _ in self.index], np.uint8).tobytes()
        sizes = np.array([n for _, n in self.index], "<u8").tobytes()
        index = zlib.compress(struct.pack("<QQ", len(self.index), self.total) + docs + flags + sizes)
        self.stream.write(index + struct.pack("<QI", self.size, zlib.crc32(index)) + MAGIC)
        self.stream.close()


def read_file(source) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start in the file, ids, crc32) of a file's documents; checks all sums."""
    size = source.size()
    source.seek(size - 20)
    tail = source.read(20)
    at, crc = struct.unpack("<QI", tail[:12])
    source.seek(at)
    packed = source.read(size - 20 - at)
    if tail[12:] != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError("bad index")
    index = zlib.decompress(packed)
    count, total = struct.unpack("<QQ", index[:16])
    docs = np.frombuffer(index, "<i8", count, 16)
    flags = np.frombuffer(index, np.uint8, count, 16 + 8 * count)
    sizes = np.frombuffer(index, "<u8", count, 16 + 9 * count).astype(np.int64)
    source.seek(0)
    if source.read(8) != MAGIC:
        raise ValueError("bad magic")

    def batches() -> Iterator[np.ndarray]:
        left, group = total, []
        while left or group:
            n, length, crc = struct.unpack("<III", source.read(12)) if left else (0, 0, 0)
            if group and (len(group) == SIDE or not left or _shape(n) != _shape(group[0][0])):
                for (_, want, _), raw in zip(group, decode_blocks([x for _, _, x in group], [n for n, _, _ in group])):
                    raw = raw.astype("<u4")
                    if zlib.crc32(raw.tobytes()) != want:
                        raise ValueError("a block's ids differ from its checksum")
                    yield raw
                group = []
            if left:
                if not 0 < n <= left:
                    raise ValueError("bad block")
                group.append((n, crc, source.read(length)))
                left -= n

    blocks, have, start = batches(), np.zeros(0, "<u4"), 0
    for k in range(count):
        need, crc = int(sizes[k]), 0
        while need:
            if not len(have):
                have = next(blocks)
            part = have[:need]
            crc = zlib.crc32(part.tobytes(), crc)
            have, need = have[len(part) :], need - len(part)
        yield (None if flags[k] else int(docs[k])), start, int(sizes[k]), crc
        start += int(sizes[k])


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes; returns the manifest (part, path, n_docs, n_ids), written down.  ``pattern`` is what the byte-level tokenizer splits texts by."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a bounded vocabulary
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder = _words_of(shared.value, pattern)
        end = np.array([end_id], np.uint32)
        files, root = _files(folder)
        writer, path = None, ""
        for batch in batches:
            ids, column, done = batch.column(0).to_pylist(), batch.column(1), 0
            while done < len(ids):
                texts, size = [], 0
                while done + len(texts) < len(ids) and size < TOGETHER:
                    texts.append(column[done + len(texts)].as_py())
                    size += len(texts[-1])
                for doc, found in zip(ids[done : done + len(texts)], coder.encode(texts)):
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        path = f"{root}/{uuid.uuid4().hex}.ids"
                        writer = Writer(files.open_output_stream(path))
                    writer.add(doc, np.concatenate([found, end]))
                done += len(texts)
        if writer is not None:
            writer.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.index)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    return checkpoint(map_arrow(ordered, run, "part int, path string, n_docs long, n_ids long"))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files, in the order of the parts."""
    # the manifest has one row for each file, so this one-partition window is small
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before")).repartition(max(1, min(manifest.count(), READ_TASKS)))  # a number, so that small rows are not put together into one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(path) as source:
                    rows = []
                    for doc, start, n, crc in read_file(source):
                        rows.append((doc, offset + start, n, crc))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_ids(manifest, folder)


QUERIES = {"op10_token_ids": op10_token_ids}
ORACLES: dict[str, str] = {}
