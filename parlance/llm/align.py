"""Cross-tokenizer alignment: which ids of two vocabularies end at the same bytes, and how often.

Every text is encoded by a byte-level vocabulary (A, a blank put before the text) and by a piece
vocabulary (B, whose library puts the blank).  The work on tokens is Arrow's: ids are lists by
document, which are flattened with their parent indices; cumulative sums of the tokens' bytes,
restarted at each document, are their ends; an Acero hash join on (document, end) finds the ends
that both sides share.  A shared end closes a group and is a link of one A and one B token, as
no token is empty (a vocabulary with empty tokens is refused).

The linked id pairs of each document are written once.  Tasks count them with
``Table.group_by`` and Spark adds the counts.  Of two tokens that end together one is a suffix of
the other, so there are never more different pairs than the entries of both vocabularies have
bytes, whatever the corpus (``pair_bound``, about 1.4 million for the two public ones); the
counts are broadcast under that proven bound, and a hash join in each task brings them to the links.

Each library sees a word once: a blank with what follows up to the next blank is encoded alone, as
no piece of B holds a blank after another character and A's pattern cuts before a blank
(``tokenbin.Words``).  Texts where that is not sure go to the libraries whole.

Defined results: texts that are null, empty or not given back by both vocabularies (for example
with U+2581, which B writes for a blank) have no tokens: zeros and an empty digest.  Repeated rows
count each; a null doc_id passes; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, small_batches
from .common import checkpoint, table
from .tokenbin import Words, _byte_letters, _Places

PART = 1 << 18  # bytes of texts that are aligned together, and links that meet the counts together; a longer text is alone
CACHE = 200_000  # words of each library that a worker remembers
_SHIFT = 20  # a pair is a << _SHIFT | b
_END = 32  # bits of an end in a join key; Arrow's lists are shorter


def piece_bytes(piece: str) -> bytes:
    """The bytes that a piece stands for."""
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Pieces:
    """Ids of texts by the sentencepiece library, which sees every different word once."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.alone = not any(re.search("[^▁]▁", p) for p in self.pieces)
        self._clear()

    def _clear(self) -> None:
        self.place = _Places()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _take_in(self) -> None:
        """Encodes the words that wait."""
        found = self.coder.encode(self.place.new, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.place.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > CACHE:
            self._clear()
        sure = [self.alone and bool(t) and "  " not in t and t[0] != " " and t[-1] != " " and "▁" not in t for t in texts]
        codes = [np.fromiter(map(self.place.__getitem__, t.split(" ")), np.int64) if ok else None for t, ok in zip(texts, sure)]
        if self.place.new:
            self._take_in()
        out = []
        for text, words in zip(texts, codes):
            if words is None:
                out.append(np.array(self.coder.encode(text, num_threads=1), np.int32))
            else:
                each = self.sizes[words]
                ends = np.cumsum(each)
                out.append(self.flat[np.repeat(self.starts[words] - ends + each, each) + np.arange(ends[-1])])
        return out


def lists_of(found: list[np.ndarray]) -> pa.ListArray:
    """The arrays as one Arrow list column."""
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0)]).astype(np.int32)))


class Aligner:
    """Both vocabularies of a worker: ids, the bytes of each entry, and its decimal number with every separator."""

    def __init__(self, byte_vocabulary: str, piece_model: bytes, pattern: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = Tokenizer.from_str(byte_vocabulary)
        coder.encode_special_tokens = True
        self.a, self.b = Words(coder, pattern, CACHE), Pieces(piece_model)
        letters = {c: b for b, c in _byte_letters().items()}
        size = coder.get_vocab_size()
        bytes_a = [bytes(letters[c] for c in coder.id_to_token(i)) if all(c in letters for c in coder.id_to_token(i)) else coder.id_to_token(i).encode() for i in range(size)]
        bytes_b = [piece_bytes(p) for p in self.b.pieces]
        if not all(bytes_a) or not all(bytes_b):
            raise ValueError("a vocabulary has an empty token")
        self.bytes = [pa.array(x, pa.binary()) for x in (bytes_a, bytes_b)]
        self.lengths = [pc.cast(pc.binary_length(x), pa.int64()) for x in self.bytes]
        self.marks = pa.array([f"{i}{end}" for n, ends in ((len(bytes_a), ",|"), (len(bytes_b), (",", ";", ""))) for end in ends for i in range(n)], pa.string())
        self.sizes = len(bytes_a), len(bytes_b)

    def pair_bound(self) -> int:
        return sum(int(pc.sum(x).as_py()) for x in self.lengths)

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], pa.Array]:
        """(A tokens, B tokens, links, digest, list of linked pairs) of each text."""
        ids = [lists_of([x if t else x[:0] for t, x in zip(texts, found)]) for found in (self.a.encode(texts, after_blank=True), self.b.encode(texts))]
        spaced = pa.array([b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], pa.binary())
        given = pa.array(np.ones(len(texts), bool))
        for lists, entry in zip(ids, self.bytes):
            joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, entry.take(lists.values)), b"")
            given = pc.and_(given, pc.equal(joined, spaced))
        none = pa.scalar([], pa.list_(pa.int32()))
        ids = [pc.if_else(given, lists, none) for lists in ids]
        flat, parent, ends = [], [], []
        for lists, length in zip(ids, self.lengths):
            flat.append(pc.list_flatten(lists))
            parent.append(pc.list_parent_indices(lists))
            total = pc.cumulative_sum(length.take(flat[-1]))
            whole = pa.array(np.concatenate([[0], total.to_numpy()]))
            first = pc.subtract(lists.offsets, lists.offsets[0]).slice(0, len(lists))
            ends.append(pc.subtract(total, whole.take(first).take(parent[-1])))
        key = [pc.add(pc.shift_left(pc.cast(p, pa.int64()), pa.scalar(_END, pa.int64())), e) for p, e in zip(parent, ends)]  # (document, end)
        sides = [pa.table({"key": k, name: pa.array(np.arange(len(k)))}) for k, name in zip(key, "ab")]
        links = sides[0].join(sides[1], keys="key", join_type="inner", use_threads=False).sort_by("a")
        at = [links[name].to_numpy() for name in "ab"]
        n = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ids]
        n_links = np.bincount(links["key"].to_numpy() >> _END, minlength=len(texts)).astype(np.int64)
        codes = [x.to_numpy() for x in flat]
        pairs = codes[0][at[0]].astype(np.int64) << _SHIFT | codes[1][at[1]]
        pairs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), pa.array(pairs))
        return n[0], n[1], n_links, self._digests(codes, at, n, n_links), pairs

    def _digests(self, codes, at, n, n_links) -> list[str]:
        """Digests of the groups, written in the order: A ids of a group, its B ids, the next group."""
        shared = [np.zeros(len(c), np.int64) for c in codes]
        for s, x in zip(shared, at):
            s[x] = 1
        group = [np.cumsum(s) - s for s in shared]
        place_a = np.arange(len(codes[0])) + np.concatenate([[0], at[1] + 1])[group[0]]
        place_b = np.arange(len(codes[1])) + (at[0] + 1)[group[1]] if len(codes[1]) else np.zeros(0, np.int64)
        last = np.zeros(len(codes[1]), np.int64)
        last[(np.cumsum(n[1]) - 1)[n[1] > 0]] = 1
        mark = np.zeros(len(codes[0]) + len(codes[1]), np.int64)
        size_a, size_b = self.sizes
        mark[place_a] = codes[0] + size_a * shared[0]
        mark[place_b] = 2 * size_a + codes[1] + size_b * (shared[1] + last)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n[0] + n[1])]), pa.int32())
        written = pc.binary_join(pa.ListArray.from_arrays(offsets, self.marks.take(pa.array(mark))), "")
        return [hashlib.sha256(x.as_py().encode()).hexdigest() if k else "" for x, k in zip(written, n_links)]


@functools.lru_cache(maxsize=1)
def aligner_of(byte_vocabulary: str, piece_model: bytes, pattern: str) -> Aligner:
    """The vocabularies of a worker, which keeps the words it knows from task to task."""
    return Aligner(byte_vocabulary, piece_model, pattern)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of about ``PART`` in all."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > PART:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of documents (doc_id, text), written down."""
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:  # two bounded vocabularies
        shared = spark.sparkContext.broadcast((f.read(), g.read(), pattern))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*shared.value)
        for batch in batches:
            texts = batch.column(1)
            for first, last in _parts(pc.binary_length(texts).to_pylist()):
                n_a, n_b, n_links, digests, pairs = aligner.align(texts.slice(first, last - first).to_pylist())
                columns = [batch.column(0).slice(first, last - first), *map(pa.array, (n_a, n_b, n_links, n_links, digests)), pairs]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
            pa.default_memory_pool().release_unused()

    return checkpoint(map_arrow(docs, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of the links of ``aligned`` rows: n over the corpus, best if no pair of the same B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            part = pa.table({"pair": batch.column(0).flatten()})
            part = part.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
            found = part if found is None else pa.concat_tables([found, part]).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
        if found is not None:
            yield from found.to_batches(1 << 16)

    counts = map_arrow(rows.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    counts = checkpoint(counts.withColumn("b", b))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id, text)."""
    rows = aligned(docs, byte_path, piece_path, pattern)
    known = rows.sparkSession.sparkContext.broadcast(pair_counts(rows).toArrow().combine_chunks())  # at most pair_bound() rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
        slices = (batch.slice(a, b - a) for batch in batches for a, b in _parts(pc.list_value_length(batch.column(6)).to_pylist()))
        for batch in slices:
            rest, lists = batch.select(names[:6]), batch.column(6)
            links = pa.table({"row": pc.list_parent_indices(lists), "pair": pc.list_flatten(lists)})
            seen = links.group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["row", "pair", "k"])
            seen = seen.join(counts, "pair", join_type="inner", use_threads=False)
            k = seen["k"]
            seen = pa.table({"row": seen["row"], "best": pc.multiply(k, pc.cast(seen["best"], pa.int64())), "sum": pc.multiply(k, seen["n"])})
            sums = seen.group_by("row", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            best[sums["row"].to_numpy()], total[sums["row"].to_numpy()] = sums["best_sum"].to_numpy(), sums["sum_sum"].to_numpy()
            columns = [*rest.columns[:5], pa.array(best), pa.array(total), rest.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:5], "n_best", "count_sum", "groups_sha256"])
        pa.default_memory_pool().release_unused()

    small_batches(rows.sparkSession)
    return map_arrow(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
