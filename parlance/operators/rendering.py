"""Clips rendered end to end: routed stereo, fades, recovered stems, figures, sidecar, verdict, manifest row.

All masks are interval algebra in Spark; only samples are Python's: sorted rows bring each chunk's
audio and the intervals that touch it, and many chunks are rendered at once.  A clip is as many chunks
as its length takes, so no task holds a whole clip.

Defined results: audio that is missing is silence; intervals outside a clip and empty ones do nothing; a clip
without length has no row; of repeated audio rows the last by position wins, repeated intervals
count once; null bounds are ignored; sources without a chosen assistant have no assistant's runs, so all speech is the user's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import CLOCK, DEFAULT, Settings
from ..shipping import map_arrow
from .audio import FULL, _db, places
from .export import sidecar_json, sidecar_rows
from .intervals import E, S, complement, merge_intervals, proper, range_join, speaker_overlaps
from .qc import SPEAKER, clip_verdicts, reject_empty, sidecar_problems

CHUNK = 8 * CLOCK  # samples of a chunk
PACK = 1 << 18  # samples of chunks that are rendered together
CLIP = ["source_id", "clip_id"]
_RUNS = ("assistant", "user")
_KINDS = ("frame", "audio", *_RUNS, "stem", "mute")  # of rows of a chunk, in order
_FIGURES = ["n", *(f"{side}_{x}" for side in ("left", "right") for x in ("sum", "sq", "peak", "full", "quiet")), *(f"{who}_{x}" for who in _RUNS for x in ("n", "left_sq", "right_sq"))]


def _cut(intervals: DataFrame, clips: DataFrame) -> DataFrame:
    """Intervals of sources as parts of their clips, with the clip's id."""
    other = [c for c in intervals.columns if c not in ("source_id", S, E)]
    met = range_join(clips.select(*CLIP, S, E), intervals, ["source_id"])
    return met.select(*CLIP, *other, F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))


def _without(intervals: DataFrame, cuts: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals less the cuts: what the gaps of the intervals and the cuts leave of the frames."""
    gaps = complement(intervals, frames, keys)
    return complement(gaps.unionByName(cuts.select(*keys, S, E)), frames, keys)


def channel_runs(clips: DataFrame, activities: DataFrame, assistants: DataFrame, recovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source_id, clip_id, role, start_sample, end_sample) of each channel's runs, (source_id, clip_id, bounds) of the overlap left out).

    A role is heard where it alone speaks and where stems were recovered (source_id, start_sample, end_sample).
    """
    keys = [*CLIP, "role"]
    frames = clips.select(*CLIP, F.explode(F.array(*map(F.lit, _RUNS))).alias("role"), S, E)
    role = F.when(F.col("speaker") == F.col("assistant"), "assistant").otherwise("user")
    spoken = activities.join(assistants.select("source_id", "assistant"), "source_id", "left").select("source_id", role.alias("role"), S, E)
    both = _cut(speaker_overlaps(activities), clips)
    back = _cut(merge_intervals(recovered, ["source_id"]), clips)
    in_roles = lambda df: df.select(*CLIP, F.explode(F.array(*map(F.lit, _RUNS))).alias("role"), S, E)
    alone = _without(_cut(merge_intervals(spoken, ["source_id", "role"]), clips), in_roles(both), frames, keys)
    return merge_intervals(alone.unionByName(in_roles(back)), keys), _without(both, back, clips.select(*CLIP, S, E), CLIP)


def _inside(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in an interval lo to hi."""
    step = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _render(pack: pa.Table, at: np.ndarray, fade: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """((n, 2) PCM of the pack's chunks one after the other, where each begins, where each role sounds); ``at`` has the row of each chunk's frame."""
    kind, a, b = (pack[c].to_numpy() for c in ("kind", "a", "b"))
    chunk = np.searchsorted(at, np.arange(len(kind)), "right") - 1
    c0, c1 = a[at], b[at]
    edges = np.concatenate([[0], np.cumsum(c1 - c0)])
    n, base = int(edges[-1]), edges[:-1] - c0  # a sample's place is its position and the chunk's base

    def put(target: np.ndarray, rows: pa.Table, side: str, first: np.ndarray) -> None:
        lists = rows[side].combine_chunks()
        target[places(first, lists.value_lengths().fill_null(0).to_numpy())] = lists.flatten().to_numpy(zero_copy_only=False)

    def of(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct intervals, each with its chunk."""
        rows = np.flatnonzero(kind == _KINDS.index(name))
        x = np.unique(np.stack([chunk[rows], a[rows], b[rows]]), axis=1)
        return x[0], x[1], x[2]

    def cut(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of intervals inside their chunks."""
        lo = np.minimum(np.maximum(lo, c0[k]), c1[k])
        return base[k] + lo, base[k] + np.maximum(lo, np.minimum(hi, c1[k]))

    mono = np.zeros(n, np.float32)
    rows = np.flatnonzero(kind == _KINDS.index("audio"))
    put(mono, pack.take(rows), "left", base[chunk[rows]] + a[rows])
    runs = {who: of(who) for who in _RUNS}
    sounds = {who: _inside(n, *cut(*runs[who])) for who in _RUNS}
    sides = {who: np.where(sounds[who], mono, np.float32(0)) for who in _RUNS}
    rows = np.flatnonzero(kind == _KINDS.index("stem"))
    if len(rows):
        pieces = pack.take(rows)
        for who, side in zip(_RUNS, ("left", "right")):
            put(sides[who], pieces, side, base[chunk[rows]] + a[rows])
    mute = _inside(n, *cut(*of("mute")))
    pcm = np.empty((n, 2), "<i2")
    for column, who in enumerate(_RUNS):
        k, lo, hi = runs[who]
        width = np.minimum(fade, (hi - lo) // 2)  # linear fades: up over the first samples, down over the last, at most half of a run each
        for zone, up in ((cut(k, lo, lo + width), True), (cut(k, hi - width, hi), False)):
            count = zone[1] - zone[0]
            where = places(zone[0], count)
            place = where - np.repeat(base[k] + (lo if up else hi - width), count)
            gain = place / np.repeat(np.maximum(1, width - 1), count)
            sides[who][where] = (sides[who][where] * (gain if up else 1 - gain)).astype(np.float32)
        sides[who][mute] = 0
        sounds[who] &= ~mute
        pcm[:, column] = np.rint(np.clip(sides[who], -1, FULL) * 32768)
    return pcm, edges, sounds


def _figures(pcm: np.ndarray, edges: np.ndarray, sounds: dict[str, np.ndarray], silence: float) -> list[np.ndarray]:
    """The chunks' figures; sums of whole numbers, so they are exact."""
    first = edges[:-1]
    total = lambda x: np.add.reduceat(x, first, dtype=np.int64)
    out, squares = [np.diff(edges)], []
    for k in (0, 1):
        level = np.abs(pcm[:, k].astype(np.int32))
        squares.append(level * level)
        out += [total(level) / 32768, total(squares[k]) / 2**30, np.maximum.reduceat(level, first) / 32768, total(level >= FULL * 32768), total(level <= silence * 32768)]
    for who in _RUNS:
        out += [total(sounds[who]), *(total(x * sounds[who]) / 2**30 for x in squares)]
    return out


def rendered_chunks(
    mono: DataFrame, clips: DataFrame, runs: DataFrame, stems: DataFrame, exclusions: DataFrame, fade: int = 240, chunk: int = CHUNK, silence_db: float = -50.0
) -> DataFrame:
    """(source_id, clip_id, chunk, start_sample, pcm, digest, figures): chunks of clips as interleaved PCM of 16 bits, start relative to the clip.

    ``mono`` has blocks (source_id, start_sample, samples), ``stems`` pieces (source_id, start_sample,
    left, right) with the assistant on the left, ``runs`` is what ``channel_runs`` returns.

    What touches a chunk is sorted behind the chunk's frame; a task renders as many whole chunks at once as ``PACK`` samples hold.
    """
    keys = [*CLIP, "chunk"]
    clips = clips.where(F.col(E) > F.col(S)).select(*CLIP, S, E)
    no = F.lit(None).cast("array<float>")
    span = lambda df, size: df.select("source_id", S, (F.col(S) + F.size(size)).alias(E), *[c for c in df.columns if c not in ("source_id", S, E)])
    meet = lambda df: range_join(clips, df, ["source_id"], width=4 * chunk)

    def cut(met: DataFrame, kind: Column, whole: bool = False, sides: tuple[str, ...] = ()) -> DataFrame:
        """A row for each chunk that an interval r_start to r_end of a clip touches, with the samples that lie in it; ``whole`` keeps the interval's own bounds."""
        lo, hi = F.greatest(S, "r_start") - F.col(S), F.least(E, "r_end") - F.col(S)
        in_chunks = met.where(hi > lo).withColumn("chunk", F.explode(F.sequence(F.floor(lo / chunk), F.floor((hi - 1) / chunk))))
        c0 = F.col(S) + F.col("chunk") * chunk
        a, b = F.greatest(c0, "r_start"), F.least(E, c0 + chunk, "r_end")
        piece = lambda c: F.when((a == F.col("r_start")) & (b == F.col("r_end")), F.col(c)).otherwise(F.slice(c, (a - F.col("r_start") + 1).cast("int"), (b - a).cast("int")))
        left, right = [*map(piece, sides), no, no][:2]
        if whole:
            a, b = F.col("r_start"), F.col("r_end")
        return in_chunks.select(*keys, kind.cast("int").alias("kind"), F.col("r_start").cast("long").alias("first"), a.cast("long").alias("a"), b.cast("long").alias("b"), left.alias("left"), right.alias("right"))

    number = lambda name: F.lit(_KINDS.index(name))
    parts = [
        cut(clips.withColumns({"r_start": F.col(S), "r_end": F.col(E)}), number("frame")),
        cut(meet(span(mono, "samples")), number("audio"), sides=("samples",)),
        cut(clips.join(proper(runs).select(*CLIP, "role", F.col(S).alias("r_start"), F.col(E).alias("r_end")), CLIP), F.when(F.col("role") == "assistant", number("assistant")).otherwise(number("user")), whole=True),
        cut(meet(span(stems, "left")), number("stem"), sides=("left", "right")),
        cut(meet(merge_intervals(exclusions, ["source_id"])), number("mute"), whole=True),
    ]
    # pieces in the order of the blocks they are cut from, so that of repeated audio the last by position wins
    rows = reduce(DataFrame.unionByName, parts).repartition(*keys).sortWithinPartitions(*keys, "kind", "first", "a")
    quiet = 10 ** (silence_db / 20)
    schema = f"source_id {clips.schema['source_id'].dataType.simpleString()}, clip_id {clips.schema['clip_id'].dataType.simpleString()}, chunk long, {S} long, pcm binary, digest string, " + ", ".join(f"{n} double" for n in _FIGURES)

    def new_chunks(table: pa.Table) -> np.ndarray:
        """The rows of frames that begin a chunk; a clip that is there twice has a second one."""
        at = np.flatnonzero(table["kind"].to_numpy() == _KINDS.index("frame"))
        if len(at) < 2:
            return at
        new = np.zeros(len(at) - 1, bool)
        frames = table.select(keys).take(at)
        for c in keys:
            x, y = frames[c].slice(1), frames[c].slice(0, len(at) - 1)
            same = pc.fill_null(pc.equal(x, y), False).to_numpy() | (x.is_null().to_numpy() & y.is_null().to_numpy())
            new |= ~same
        return at[np.concatenate([[True], new])]

    def rendered(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Packs of the chunks that begin at these rows."""
        a, b, clip = (table[c].to_numpy()[at] for c in ("a", "b", "first"))
        ends, begin = np.append(at[1:], table.num_rows), 0
        filled = np.cumsum(b - a)
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(filled, (filled[begin - 1] if begin else 0) + PACK, "right")))
            part = at[begin:end]
            pack = table.slice(part[0], ends[end - 1] - part[0])
            pcm, edges, sounds = _render(pack, part - part[0], fade)
            digests = [hashlib.sha256(pcm[x:y]).hexdigest() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
            content = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(pcm)])
            frames = pack.select(keys).take(part - part[0]).combine_chunks()
            columns = [*(frames[c].combine_chunks() for c in keys), pa.array(a[begin:end] - clip[begin:end]), content, pa.array(digests)]
            columns += [pa.array(x.astype(np.float64)) for x in _figures(pcm, edges, sounds, quiet)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, S, "pcm", "digest", *_FIGURES])
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # from the last chunk's frame on, as more rows of it may follow
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch], held.schema)])
            at = new_chunks(table)
            if len(at) > 1:
                yield from rendered(table.slice(0, at[-1]), at[:-1])
            held = table.slice(at[-1])
        if held is not None:
            yield from rendered(held, new_chunks(held))

    return map_arrow(rows, run, schema)


def clip_totals(chunks: DataFrame, overlap_left: DataFrame) -> DataFrame:
    """(source_id, clip_id, samples, digest, omitted, level and leakage figures) of rendered chunks.

    The digest is the SHA-256 of the chunks' digests in order.
    """
    total = {c: (F.max if c.endswith("_peak") else F.sum)(c).alias(c) for c in _FIGURES}
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda c: c["digest"]), "")
    df = chunks.groupBy(*CLIP).agg(F.sha2(order, 256).alias("digest"), *total.values())
    omitted = overlap_left.groupBy(*CLIP).agg(F.sum(F.col(E) - F.col(S)).alias("omitted"))
    df = df.join(omitted, CLIP, "left").withColumn("omitted", F.coalesce("omitted", F.lit(0)).cast("long"))
    n, per = F.col("n"), lambda c: F.col(c) / F.col("n")
    energy = lambda who, side: F.when(F.col(f"{who}_n") > 0, F.col(f"{who}_{side}_sq") / F.col(f"{who}_n")).otherwise(0.0)
    al, ar, ul, ur, eps = energy("assistant", "left"), energy("assistant", "right"), energy("user", "left"), energy("user", "right"), 1e-12
    levels = [x for s in ("left", "right") for x in (F.sqrt(per(f"{s}_sq")).alias(f"{s}_rms"), _db(F.sqrt(per(f"{s}_sq"))).alias(f"{s}_dbfs"), F.col(f"{s}_peak"), per(f"{s}_full").alias(f"{s}_clipping"), per(f"{s}_quiet").alias(f"{s}_silence"), per(f"{s}_sq").alias(f"{s}_energy"), (F.col(f"{s}_sum") * 32768).cast("long").alias(f"{s}_sum"))]
    return df.select(
        *CLIP, n.cast("long").alias("samples"), "digest", "omitted", *levels, F.col("assistant_n").cast("long").alias("assistant_samples"), F.col("user_n").cast("long").alias("user_samples"),
        (ar / (al + eps)).alias("right_leakage"), (ul / (ur + eps)).alias("left_leakage"), ((ar > al + eps) & (ul > ur + eps)).alias("swapped"),
    )


def clip_artifacts(totals: DataFrame, clips: DataFrame, words: DataFrame, stems: DataFrame, overlap_left: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a clip: totals, sidecar text, status, reasons, and (path, duration) of the manifest for clips that pass.

    ``words`` (source_id, word, start_sample, end_sample) are the assistant's; ``clips`` have their planned ``overlap_ratio``.
    """
    rows = sidecar_rows(words, clips.select(*CLIP, S, E))
    kept = rows.where("reason is null").select("clip_id", "word", "start_s", "end_s", F.lit(SPEAKER).alias("speaker"))
    # words are written by (start, end); that order is the row's place
    placed = kept.withColumn("pos", F.struct("start_s", "end_s", "word"))
    text = sidecar_json(rows)
    counted = rows.groupBy("clip_id").agg(F.count_if(F.col("reason").isNull()).alias("n_alignments"), F.count_if(F.col("reason") == "unaligned").alias("unaligned"))
    seconds = clips.select("clip_id", ((F.col(E) - F.col(S)) / CLOCK).alias("expected_duration"))
    problems = sidecar_problems(placed, seconds.withColumnRenamed("expected_duration", "duration").join(kept.select("clip_id").distinct(), "clip_id", "left_semi"))
    back = _cut(merge_intervals(stems.select("source_id", S, (F.col(S) + F.size("left")).alias(E)), ["source_id"]), clips).groupBy(*CLIP).agg(F.sum(F.col(E) - F.col(S)).alias("recovered"))
    df = totals.join(clips.select(*CLIP, "overlap_ratio"), CLIP).join(seconds, "clip_id").join(back, CLIP, "left").join(counted, "clip_id", "left")
    df = df.join(problems.withColumnRenamed("reasons", "sidecar_reasons"), "clip_id", "left").join(text.withColumnRenamed("value", "sidecar"), "clip_id", "left")
    planned = F.rint(F.col("overlap_ratio") * F.col("samples"))
    none = F.lit(0)
    wide = df.withColumns({
        "channels": F.lit(2), "sample_rate": F.lit(CLOCK), "duration": F.col("samples") / CLOCK, "total_words": F.coalesce("n_alignments", none), "separation_used": F.coalesce("recovered", none) > 0,
        "separation_coverage": F.when((planned > 0) & (F.coalesce("recovered", none) > 0), F.least(F.lit(1.0), F.col("recovered") / planned)).otherwise(0.0),
        "sidecar": F.coalesce("sidecar", F.lit('{"alignments":[]}')), "problem": F.lit(None).cast("string"),
        # the studio's rendering passes no counts of doubtful words; the gates read them from the transcript
        **{c: none for c in ("low_confidence_words", "uncertain_words", "unaligned_words", "suspect_segments", "unresolved")},
    })
    judged = reject_empty(clip_verdicts(wide, s))
    passed = F.col("status") == "PASS"
    path = F.concat(F.lit("data_stereo/"), F.col("clip_id").cast("string"), F.lit(".wav"))
    return judged.select(*totals.columns, "sidecar", "total_words", "status", "reasons", F.when(passed, path).alias("path"), F.when(passed, F.col("duration")).alias("duration"))
