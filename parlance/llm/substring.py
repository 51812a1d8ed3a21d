"""Substring dedup: repeated runs of consecutive sentences.

A text is cut after each line feed and after white space that follows ``.``, ``!`` or ``?``;
pieces without words belong to the piece before.  A run is ``SENTENCES`` or more sentences in a row
with at least ``WORDS`` words; every sentence that lies in a run which occurs earlier, by
(doc_id, hash of the text, position), is removed.

Hashed are the shortest run that starts at each sentence and the shortest that ends there: a
repeated run is covered by the shortest runs inside it, as a sentence which the one from its
start leaves out has words enough before it.  Runs are hashed by their words, A-Z lower-cased.
They are written once, meet in one global aggregate, and hashes with many places are joined
with a broadcast of bounded size instead of a shuffle.

Defined results: null texts stay null and empty texts empty, without sentences; a null
doc_id takes no part and its text stays; rows of one id and one text count as one
occurrence, rows of one id and different texts as several; a text whose sentences all repeat becomes
empty, its row stays.  Extra columns pass through, whatever their names; columns that have the names of
the figures (``n_sentences``, ``n_removed``) are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, small_batches
from .common import _LOWER, checkpoint, free_name, join_hot, mix, span_hashes, table, text_bytes, word_bounds

SENTENCES, WORDS = 2, 16

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93 | 5)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def sentences(data: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each sentence and the end of the last, words before each of them, word hashes if wanted)."""
    low = _LOWER[data]
    starts, ends = word_bounds(low)
    if len(starts) == 0:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    cut = np.flatnonzero((data == 10) | (_BLANK[data] & np.concatenate([[False], _BREAK[data[:-1]]]))) + 1
    edges = np.unique(np.concatenate([[0], cut, [len(data)]]))
    before = np.searchsorted(starts, edges)
    keep = np.concatenate([before[1:] > before[:-1], [True]])  # pieces without words join the piece before
    keep[0] = True
    edges, before = edges[keep], before[keep]
    if len(edges) > 2 and before[1] == 0:  # leading blanks join the first sentence
        edges, before = np.delete(edges, 1), np.delete(before, 1)
    return edges, before, span_hashes(low, starts, ends) if hashed else starts[:0]


def runs(before: np.ndarray, words: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, hash) of the shortest runs that start or end at each sentence."""
    count = len(before) - 1
    at = np.arange(count)
    if count == 0 or len(words) == 0:
        return at[:0], at[:0], words[:0]
    after = np.maximum(at + least_sentences, np.searchsorted(before, before[:-1] + least_words))
    first = np.minimum(at + 1 - least_sentences, np.searchsorted(before, before[1:] - least_words, side="right") - 1)
    first, after = np.concatenate([at, first]), np.concatenate([after, at + 1])
    fits = (first >= 0) & (after <= count)
    first, after = np.divmod(np.unique(first[fits] * (count + 1) + after[fits]), count + 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _STEP, np.uint64)]))
        inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BACK, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1])])
        a, b = before[first], before[after]
        value = mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))
    return first, after, value


def _place(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a run starts and ends, in one number that sorts by its start."""
    return first.astype(np.int64) << 32 | after


def dedup_spans(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, figures: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """The documents with repeated sentences removed from ``text``, and how many sentences there were and were removed."""
    docs = docs.drop(*figures)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    plain = docs.select(doc_id.alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sizes, places, hashes = [], [], []
                for value in part.column(2):
                    _, before, words = sentences(text_bytes(value.as_py()))
                    first, after, value = runs(before, words, least_sentences, least_words)
                    once = np.unique(value, return_index=True)[1]
                    own = np.ones(len(value), bool)  # later places of runs that the text itself repeats
                    own[once] = False
                    sizes.append(len(value))
                    places.append(_place(first, after))
                    hashes.append(pa.array(value.view(np.int64), mask=own))
                each = np.repeat(np.arange(part.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(hashes), part.column(0).take(each), part.column(1).take(each), pa.array(np.concatenate(places))], names=["h", "doc", "t", "at"])

    found = checkpoint(map_arrow(plain.where("doc is not null and text is not null"), spans, "h long, doc long, t long, at long"))
    place = F.struct("doc", "t", "at")
    counts = found.where("h is not null").groupBy("h").agg(F.min(place).alias("origin"), F.max(place).alias("last"), F.count("*").alias("n"))
    repeated = checkpoint(counts.where("origin <> last").select("h", "origin", "n"))
    later = join_hot(found, repeated, "h", found.count()).where(place != F.col("origin")).select("doc", "t", "at")
    later = later.unionByName(found.where("h is null").select("doc", "t", "at"))
    names = docs.columns
    text_at = names.index("text")
    key_doc, key_text, marks = (free_name(docs, n) for n in ("mark_doc", "mark_text", "mark_places"))
    marked = later.groupBy(F.col("doc").alias(key_doc), F.col("t").alias(key_text)).agg(F.collect_set("at").alias(marks))
    joined = docs.join(marked, (doc_id == F.col(key_doc)) & (F.xxhash64(text) == F.col(key_text)), "left").drop(key_doc, key_text)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, places in zip(batch.column(text_at), batch.column(len(names))):
                text, places = text.as_py(), places.as_py()
                data = text_bytes(text)
                edges, gone = sentences(data, hashed=False)[0], 0
                if places:
                    first, after = np.divmod(np.asarray(places, np.int64), 1 << 32)
                    covered = np.zeros(len(edges), np.int64)
                    np.add.at(covered, first, 1)
                    np.add.at(covered, after, -1)
                    stays = np.cumsum(covered)[:-1] == 0
                    gone = int((~stays).sum())
                    raw = data.tobytes()
                    text = b"".join(raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(stays)).decode("utf-8", "surrogatepass")
                texts.append(text)
                totals.append(len(edges) - 1)
                removed.append(gone)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*names, *figures])

    kinds = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema]
    return map_arrow(joined, prune, ", ".join([*kinds, *[f"`{f}` long" for f in figures]]))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text without repeated sentences, n_sentences, n_removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_spans(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; ``n_chars`` follows the text where it is not null.

    Null and empty texts and rows with a null id stay as they are, as do texts that repeat nothing; of
    ties and repeated rows the text stays in each row that has the smallest (id, text hash); extra columns pass
    through, also those that are named like the operator's figures.
    """
    small_batches(spark)
    out = dedup_spans(docs, figures=(free_name(docs, "mark_total"), free_name(docs, "mark_removed")))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op7_substring": op7_substring}
ORACLES: dict[str, str] = {}
