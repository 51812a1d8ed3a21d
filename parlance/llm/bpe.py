"""Byte-level BPE: every merge is found and made in a segment tree over byte positions.

The leaves of a tree hold, for each live byte position, the rank of the pair that starts
there with its right neighbour; inner nodes hold the leftmost minimum, so the root is the
next merge.  A merge updates three leaves (the merged pair, its left neighbour, the
swallowed position) and their paths.  Short matches of a batch are grouped by length and
their trees advance together in numpy arrays, where a step renews all inner nodes by one
minimum a level; long ones use one tree in Python lists.  Distinct matches are numbered, and
Arrow joins the decimal ids and the decoded bytes of the texts.

The rank file is a bounded vocabulary (about 1 MB): the driver reads it, the path is a
parameter, and Spark's broadcast carries its bytes to the workers.

Defined results: null counts as empty, an empty text has no ids; repeated rows are encoded
each; a null doc_id passes.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, small_batches
from .common import table
from .tokenbin import _Places

NONE = 1 << 30
LONG = 64  # bytes of the longest match whose tree is kept in numpy
CACHE = 200_000  # distinct matches that a worker remembers
TOGETHER = 4096  # short matches whose trees advance together


class Ranks:
    """Ids of byte strings, and the ranks of all pairs of ids that merge, in a hash table of numpy arrays."""

    def __init__(self, lines: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        left, right, rank = [], [], []
        for token, merged in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(merged)
        keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        rank = np.array(rank, np.int32)
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)  # no key is negative
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            first = free[first]
            self.keys[slot], self.ranks[slot] = keys[first], rank[first]
            keys, rank, at = (np.delete(x, first) for x in (keys, rank, at))
            at = at + 1 & len(self.keys) - 1
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.of_pairs(np.repeat(self.single, 256), np.tile(self.single, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; an id of -1 merges with none."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        found = self.keys.take(at)
        out = np.where(found == key, self.ranks.take(at), np.int32(NONE))
        left = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        at = at[left]
        while len(left):
            at = at + 1 & len(self.keys) - 1
            found = self.keys.take(at)
            hit = found == key[left]
            out[left[hit]] = self.ranks[at[hit]]
            more = ~hit & (found >= 0)
            left, at = left[more], at[more]
        return out

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The same as a dict, made when the first long match comes."""
        full = self.keys >= 0
        return dict(zip(self.keys[full].tolist(), self.ranks[full].tolist()))


def encode_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece of any length by one segment tree."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.pairs.get
    none = NONE * size
    tree = [none] * (2 * size)
    for p in range(n - 1):
        r = get(ids[p] << 20 | ids[p + 1])
        if r is not None:
            tree[size + p] = r * size + p
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(p: int, value: int) -> None:
        k = size + p
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < none:
        rank, p = divmod(tree[1], size)
        q = after[p]
        ids[p] = rank
        after[p] = nxt = after[q]
        put(q, none)
        if nxt < n:
            before[nxt] = p
        r = get(rank << 20 | ids[nxt]) if nxt < n else None
        put(p, none if r is None else r * size + p)
        left = before[p]
        if left >= 0:
            r = get(ids[left] << 20 | rank)
            put(left, none if r is None else r * size + left)
    out, p = [], 0
    while p < n:
        out.append(ids[p])
        p = after[p]
    return out


def encode_short(pieces: list[bytes], size: int, ranks: Ranks) -> list[list[int]]:
    """Ids of pieces of 2 to ``size`` bytes (a power of two); their trees advance together.

    Arrays are laid out position by position, so that a level of all trees is renewed by one minimum of
    contiguous rows.  Position ``size`` stands for the places outside a piece: its id is -1, which merges with none.
    """
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(n, size).T
    place = np.arange(size + 1, dtype=np.int64)[:, None]
    ids = np.full((size + 1, n), -1, np.int32)
    ids[:-1] = np.where(place[:-1] < lengths, ranks.single[raw], np.int32(-1))
    after, before = np.repeat(np.minimum(place + 1, size), n, 1), np.repeat(np.where(place, place - 1, size), n, 1)
    shift = size.bit_length() - 1
    leaves = np.full((size + 1, n), NONE, np.int32)
    rank = ranks.byte_pairs.take(raw[:-1].astype(np.int64) << 8 | raw[1:])
    leaves[: size - 1] = np.where((place[1:-1] < lengths) & (rank < NONE), rank << shift | place[:-2], NONE)
    row, done = np.arange(n), np.full((n, size), -1, np.int32)
    while True:
        level = leaves[:-1]
        while len(level) > 1:
            level = np.minimum(level[0::2], level[1::2])
        live = np.flatnonzero(level[0] < NONE)
        if 4 * len(live) < 3 * len(row):  # finished pieces go out
            over = level[0] >= NONE
            done[row[over]] = ids[:-1, over].T
            ids, after, before, leaves, level = (np.ascontiguousarray(x[:, live]) for x in (ids, after, before, leaves, level))
            row, live = row[live], np.arange(len(live))
        if not len(live):
            break
        width = len(row)
        flat_ids, flat_after, flat_before, flat_leaves = (x.reshape(-1) for x in (ids, after, before, leaves))
        top = level[0].take(live)
        r = top >> shift
        p = (top & (size - 1)).astype(np.int64)
        at_p = p * width + live
        at_q = flat_after.take(at_p) * width + live
        nxt, left = flat_after.take(at_q), flat_before.take(at_p)
        at_next, at_left = nxt * width + live, left * width + live
        flat_ids[at_p], flat_ids[at_q] = r, -1
        flat_after[at_p], flat_before[at_next] = nxt, p
        new = ranks.of_pairs(np.concatenate([r, flat_ids.take(at_left)]), np.concatenate([flat_ids.take(at_next), r]))
        new = np.where(new < NONE, new << shift | np.concatenate([p, left]), NONE)
        flat_leaves[at_q], flat_leaves[at_p], flat_leaves[at_left] = NONE, new[: len(p)], new[len(p) :]
    counts = np.cumsum((done >= 0).sum(1)).tolist()
    flat = done[done >= 0].tolist()
    return [flat[a:b] for a, b in zip([0, *counts], counts)]


class Encoder:
    """Encodes texts match by match; distinct matches meet the trees once and are numbers from then on."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.ranks = Ranks(lines)
        # fixed values: the pattern's \s and \S mean Unicode's White_Space
        self.matches = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        size = max(self.ranks.ids.values()) + 1
        entries = [b""] * size
        for token, i in self.ranks.ids.items():
            entries[i] = token
        self.bytes = pa.array(entries, pa.large_binary())
        self.decimals = pa.array(map(str, range(size)), pa.large_string())
        self._clear()

    def _clear(self) -> None:
        self.place = _Places()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encodes the matches that wait."""
        new = [w.encode("utf-8", "surrogatepass") for w in self.place.new]
        found = [[i] if i is not None else None for i in map(self.ranks.ids.get, new)]
        short: dict[int, list[int]] = {}
        for k, ids in enumerate(found):
            if ids is None and len(new[k]) > LONG:
                found[k] = encode_long(new[k], self.ranks)
            elif ids is None:
                short.setdefault(max(2, 1 << (len(new[k]) - 1).bit_length()), []).append(k)
        for size, group in short.items():
            for first in range(0, len(group), TOGETHER):
                part = group[first : first + TOGETHER]
                for k, ids in zip(part, encode_short([new[k] for k in part], size, self.ranks)):
                    found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.place.new = []

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        if len(self.place) > CACHE:
            self._clear()
        split = [self.matches(t) for t in texts]
        words = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64)
        if self.place.new:
            self._learn()
        each = self.sizes[words]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[words] - ends + each, each) + np.arange(total)]
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], last])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    def joined(self, ids: pa.ListArray, entries: pa.Array, between: str | bytes) -> Iterator[str]:
        """SHA-256 of the entries of each text's ids, joined."""
        for x in pc.binary_join(pa.ListArray.from_arrays(ids.offsets, entries.take(ids.values)), pa.scalar(between, entries.type)):
            yield hashlib.sha256(x.as_buffer()).hexdigest()


_made: dict[tuple, Encoder] = {}


def encoder_of(lines: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = (hashlib.sha256(lines).digest(), pattern)
    if key not in _made:
        _made[key] = Encoder(lines, pattern)
    return _made[key]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids]) of documents (doc_id, text)."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(shared.value, pattern)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                texts, size, k = [], 0, done
                while k < batch.num_rows and (size < 1 << 19 or not texts):
                    texts.append(batch.column(1)[k].as_py())
                    size += len(texts[-1])
                    k += 1
                ids = coder.encode(texts)
                digests, decoded = coder.joined(ids, coder.decimals, ","), coder.joined(ids, coder.bytes, b"")
                columns = [batch.column(0).slice(done, k - done), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(ids)
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done = k
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs, run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the kept documents."""
    import public_tokenizers

    small_batches(spark)
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLES: dict[str, str] = {}
