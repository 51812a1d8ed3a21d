"""Rendered clips against whole-clip masks in numpy."""

import hashlib
import json
import random

import numpy as np
import pytest

from parlance.operators import rendering as R
from parlance.plans import registry, render_queries

LOADS = {"mono": "source_id long, start_sample long, samples array<float>", "clips": "source_id long, clip_id string, start_sample long, end_sample long, overlap_ratio double",
         "activities": "source_id long, speaker string, start_sample long, end_sample long", "assistants": "source_id long, assistant string",
         "stems": "source_id long, start_sample long, left array<float>, right array<float>", "exclusions": "source_id long, start_sample long, end_sample long"}


def _whole(clip, mono, activities, assistant, stems, exclusions, fade):
    """(PCM, assistant mask, user mask, samples of overlap left out), each clip as whole arrays."""
    c0, c1 = clip
    n = c1 - c0
    sound, a, b = np.zeros(n, np.float32), np.zeros(n, bool), np.zeros(n, bool)
    first, second = np.zeros(n, bool), np.zeros(n, bool)
    for at, x in mono:
        for k, v in enumerate(x):
            if c0 <= at + k < c1:
                sound[at + k - c0] = v
    for speaker, s, e in activities:
        s, e = max(s, c0) - c0, min(e, c1) - c0
        if e > s:
            (a if speaker == assistant else b)[s:e] = True
            (first if speaker == "A" else second)[s:e] = True
    both = first & second
    a, b = a & ~both, b & ~both
    left, right, back = np.where(a, sound, np.float32(0)), np.where(b, sound, np.float32(0)), np.zeros(n, bool)
    for at, x, y in stems:
        for k in range(len(x)):
            if c0 <= at + k < c1:
                left[at + k - c0], right[at + k - c0], back[at + k - c0] = x[k], y[k], True
    a, b = a | back, b | back
    for signal, mask in ((left, a), (right, b)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        for s, e in zip(edges[::2], edges[1::2]):
            w = min(fade, (e - s) // 2)
            if w:
                signal[s : s + w] *= np.arange(w) / max(1, w - 1)
                signal[e - w : e] *= 1 - np.arange(w) / max(1, w - 1)
    for s, e in exclusions:
        s, e = max(0, s - c0), max(0, e - c0)
        for x in (left, right, a, b):
            x[s:e] = 0
    pcm = np.rint(np.clip(np.stack([left, right], 1), -1, 32767 / 32768) * 32768).astype("<i2")
    return pcm, a, b, int((both & ~back).sum())


@pytest.mark.parametrize("chunk, fade", [(37, 5), (1000, 24), (64, 0)])
def test_rendered_clips(spark, chunk, fade):
    rng = random.Random(chunk)
    wave = lambda n: [float(np.float32(rng.uniform(-1.2, 1.2))) for _ in range(n)]
    data = {k: [] for k in LOADS}
    for source in range(4):
        data["mono"] += [(source, at, wave(50)) for at in range(0, 400, 50) if rng.random() < 0.9]
        data["clips"] += [(source, f"{source}-{k}", s, e, 0.1) for k, (s, e) in enumerate([(0, 130), (130, 131), (131, 400), (390, 460), (20, 20)])]
        data["activities"] += [(source, rng.choice("AB"), s := rng.randrange(0, 420), s + rng.randrange(0, 60)) for _ in range(14)]
        data["stems"] += [(source, s, wave(9), wave(9)) for s in rng.sample(range(0, 430, 10), 4)]
        data["exclusions"] += [(source, s := rng.randrange(0, 420), s + rng.randrange(0, 30)) for _ in range(3)]
        data["assistants"] += [(source, "A")] if source else []
    t = {k: spark.createDataFrame(rows, LOADS[k]) for k, rows in data.items()}
    recovered = t["stems"].selectExpr("source_id", "start_sample", "start_sample + size(left) AS end_sample")
    runs, left_out = R.channel_runs(t["clips"], t["activities"], t["assistants"], recovered)
    chunks = R.rendered_chunks(t["mono"], t["clips"], runs, t["stems"], t["exclusions"], fade, chunk)
    got = {r.clip_id: r for r in R.clip_totals(chunks, left_out).collect()}
    pcm = {}
    for r in chunks.orderBy("clip_id", "chunk").collect():
        pcm.setdefault(r.clip_id, []).append(r.pcm)
    assert set(got) == {c for _, c, s, e, _ in data["clips"] if e > s}
    of = lambda name, source: [r[1:] for r in data[name] if r[0] == source]
    for source, clip, s, e, _ in data["clips"]:
        if e > s:
            want, a, b, omitted = _whole((s, e), of("mono", source), of("activities", source), "A" if source else None, of("stems", source), of("exclusions", source), fade)
            assert b"".join(pcm[clip]) == want.tobytes(), clip
            parts = "".join(hashlib.sha256(want[k : k + chunk].tobytes()).hexdigest() for k in range(0, e - s, chunk))
            r, x = got[clip], want.astype(float) / 32768
            assert (r.samples, r.omitted, r.assistant_samples, r.user_samples, r.digest) == (e - s, omitted, a.sum(), b.sum(), hashlib.sha256(parts.encode()).hexdigest())
            assert [r.left_sum, r.right_sum] == np.abs(want.astype(int)).sum(0).tolist() and r.left_rms == pytest.approx(np.sqrt((x[:, 0] ** 2).mean()))
            energy = lambda m, k: (x[m, k] ** 2).mean() if m.any() else 0.0
            assert r.right_leakage == pytest.approx(energy(a, 1) / (energy(a, 0) + 1e-12)) and r.left_leakage == pytest.approx(energy(b, 0) / (energy(b, 1) + 1e-12))


def test_artifacts(spark):
    """Sidecar, verdict and manifest row: one clip passes, one has no words, one has a wrong length of overlap."""
    n = 24_000
    tone = [0.5 if k % 2 else -0.5 for k in range(n)]
    mono = spark.createDataFrame([(s, k * n, tone) for s in (1, 2) for k in range(4)], LOADS["mono"])
    clips = spark.createDataFrame([(1, "good", 0, 2 * n, 0.0), (1, "mute", 2 * n, 4 * n, 0.0), (2, "loud", 0, 2 * n, 0.5)], LOADS["clips"])
    activities = spark.createDataFrame([(s, p, k * n, (k + 1) * n) for s in (1, 2) for k, p in enumerate("ABAB")], LOADS["activities"])
    who = spark.createDataFrame([(1, "A"), (2, "A")], LOADS["assistants"])
    stems, exclusions = spark.createDataFrame([], LOADS["stems"]), spark.createDataFrame([], LOADS["exclusions"])
    words = spark.createDataFrame([(1, "hi", 2400, 4800), (1, "there", 4800, 7200), (2, "x", 0, 240)], "source_id long, word string, start_sample long, end_sample long")
    runs, left_out = R.channel_runs(clips, activities, who, stems.selectExpr("source_id", "start_sample", "start_sample AS end_sample"))
    totals = R.clip_totals(R.rendered_chunks(mono, clips, runs, stems, exclusions), left_out)
    got = {r.clip_id: r for r in R.clip_artifacts(totals, clips, words, stems, left_out).collect()}
    assert (got["good"].status, got["good"].reasons, got["good"].path, got["good"].duration) == ("PASS", [], "data_stereo/good.wav", 2.0)
    assert json.loads(got["good"].sidecar) == {"alignments": [["hi", [0.1, 0.2], "SPEAKER_MAIN"], ["there", [0.2, 0.3], "SPEAKER_MAIN"]]}
    assert (got["mute"].status, got["mute"].reasons, got["mute"].path) == ("REJECT", ["missing_assistant_alignment"], None)
    assert got["loud"].status == "REJECT" and "overlap_separation_incomplete" in got["loud"].reasons
    assert R.clip_totals(R.rendered_chunks(mono.limit(0), clips.limit(0), runs.limit(0), stems, exclusions), left_out.limit(0)).count() == 0


def test_repeated_audio_at_a_chunks_start(spark):
    """Two blocks reach into the second chunk and are cut at its start there; the later block's samples count in both chunks."""
    mono = spark.createDataFrame([(1, 2, [0.5] * 6), (1, 1, [0.25] * 8)], LOADS["mono"])
    clips = spark.createDataFrame([(1, "c", 0, 10, 0.0), (1, "c", 0, 10, 0.0)], LOADS["clips"])  # the clip is there twice
    runs = spark.createDataFrame([(1, "c", "assistant", 0, 10)], "source_id long, clip_id string, role string, start_sample long, end_sample long")
    none = spark.createDataFrame([], LOADS["exclusions"])
    rows = R.rendered_chunks(mono, clips, runs, spark.createDataFrame([], LOADS["stems"]), none, 0, 4).orderBy("chunk").collect()
    left = np.concatenate([np.frombuffer(r.pcm, "<i2").reshape(-1, 2)[:, 0] for r in rows]) / 32768
    assert left.tolist() == [0, 0.25, *[0.5] * 6, 0.25, 0] and [r.start_sample for r in rows] == [0, 4, 8]


def test_many_chunks_in_packs(spark, monkeypatch):
    """Batches and packs end inside and between chunks; a chunk's rows may lie in several batches."""
    monkeypatch.setattr(R, "PACK", 100)
    rng = random.Random(4)
    mono = [(s, at, [float(np.float32(rng.uniform(-1, 1))) for _ in range(10)]) for s in range(3) for at in range(0, 900, 10)]
    clips = [(s, f"{s}-{k}", k * 300, (k + 1) * 300, 0.0) for s in range(3) for k in range(3)]
    t = {"mono": spark.createDataFrame(mono, LOADS["mono"]), "clips": spark.createDataFrame(clips, LOADS["clips"])}
    runs = spark.createDataFrame([(s, c, "user", a, b) for s, c, a, b, _ in clips], "source_id long, clip_id string, role string, start_sample long, end_sample long")
    none = spark.createDataFrame([], LOADS["exclusions"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = R.rendered_chunks(t["mono"], t["clips"], runs, spark.createDataFrame([], LOADS["stems"]), none, 0, 64).orderBy("source_id", "clip_id", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    right = np.concatenate([np.frombuffer(r.pcm, "<i2").reshape(-1, 2)[:, 1] for r in rows])
    assert right.tolist() == np.rint(np.array([x for *_, samples in mono for x in samples], np.float32) * 32768).astype("<i2").tolist()


def _kept(spark, monkeypatch, name):
    """The schemas of the tables that a query writes down."""
    seen, make = [], render_queries.keeper
    monkeypatch.setattr(render_queries, "keeper", lambda s: lambda df, keep=make(s): seen.append(df.schema.simpleString()) or keep(df))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    return seen


def test_rendered_clips_write_no_samples_down(spark, monkeypatch):
    kept = _kept(spark, monkeypatch, "R6_rendered_clips")
    assert kept and not [x for x in kept if "array<float>" in x or "binary" in x]


def test_clip_artifacts_write_no_samples_down(spark, monkeypatch):
    kept = _kept(spark, monkeypatch, "R6_clip_artifacts")
    assert kept and not [x for x in kept if "array<float>" in x or "binary" in x]
