"""Single rules against literal versions: smoothing of long runs, chains of revisions, headers, signatures, labels, folding, running sums, greedy ways over silences."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import assign as A
from parlance.operators import planning as G
from parlance.operators import qc as C
from parlance.operators import records as R
from parlance.operators import state as M
from parlance.settings import CLOCK, DEFAULT


def _smooth(rows, short):
    labels, ambiguous = [r[0] for r in rows], [False] * len(rows)
    for k in range(1, len(rows) - 1):
        if rows[k][2] - rows[k][1] < short:
            if labels[k - 1] == labels[k + 1] != labels[k]:
                labels[k] = labels[k - 1]
            else:
                ambiguous[k] = True
    return [(r[1], label, a) for r, label, a in zip(rows, labels, ambiguous)]


@pytest.mark.parametrize("width", [2, 3, 256])
def test_smoothing_of_long_runs(spark, width):
    rng, rows, want = random.Random(width), [], {}
    for source in range(6):
        labels = ["AB"[k % 2] for k in range(120)] if source == 0 else rng.choices("ABC"[: 2 + source % 2], k=rng.choice([1, 2, 3, 90]))
        turns = [(p, 10 * k, 10 * k + (rng.choice([2, 2, 2, 9]) if source else 2)) for k, p in enumerate(labels)]
        rows += [(source, *t) for t in turns]
        want[source] = _smooth(turns, 5)
    df = spark.createDataFrame(rows, "source_id long, speaker string, start_sample long, end_sample long")
    got = {}
    for r in A.smooth_turns(df, 5, ["source_id"], width).orderBy("source_id", "start_sample").collect():
        got.setdefault(r.source_id, []).append((r.start_sample, r.speaker, r.ambiguous))
    assert got == want and any(a for w in want.values() for _, _, a in w)
    assert A.smooth_turns(df.limit(0), 5, ["source_id"], width).count() == 0


def test_chains_of_revisions(spark):
    rng = random.Random(1)
    current, asks = {1: 3, 2: 1, 4: 2}, []
    for source in (1, 2, 3, 4):
        asks += [(source, no, rng.choice([None, 0, 1, 2, 3, 4, 5, 6])) for no in rng.sample(range(100), 30)]
    asks += [(5, k, k) for k in range(40)]
    rows = [(s, v) for s, top in current.items() for v in range(1, top + 1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ok, no = M.append_revisions(frame(rows, "source_id long, version long"), frame(asks, "source_id long, change_no long, expected_version long"))
    want_ok, want_no = set(), set()
    for s, n, v in sorted(asks, key=lambda x: (x[0], x[1])):
        now = current.get(s, 0)
        if v == now:
            current[s] = now + 1
            want_ok.add((s, n, now + 1))
        else:
            want_no.add((s, n, now))
    assert {(r.source_id, r.change_no, r.version) for r in ok.collect()} == want_ok and len(want_ok) > 45
    assert {(r.source_id, r.change_no, r.current) for r in no.collect()} == want_no


def test_headers(spark):
    now = spark.createDataFrame([(1, "one", "ready", 5, "p"), (2, "two", "ready", None, None)], "id long, name string, status string, size long, path string")
    changes = [
        (1, "update", 3, {"status": "early"}), (2, "insert", 3, {"name": "  three "}), (3, "insert", 3, {"name": "again"}), (4, "insert", 4, {"name": " "}), (5, "insert", 5, {}), (6, "update", 3, {"size": "7", "path": "q"}),
        (7, "update", 3, {"path": None, "size": None}), (8, "update", 1, {"owner": "x", "name": "y"}), (9, "update", 1, {"name": ""}), (10, "update", 1, {"name": " uno", "size": None}), (11, "delete", 1, {}), (12, "update", 2, None), (13, "insert", 1, {"name": "x"}),
    ]
    rows, said = M.merge_headers(now, spark.createDataFrame(changes, "change_no long, op string, id long, values map<string,string>"), "id", ["name", "status", "size", "path"], {"status": "uploaded"}, "name", ("path",))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "uno", "ready", None, "p"), (2, "two", "ready", None, None), (3, "three", "uploaded", None, "q")]
    assert {r.change_no: r.refused for r in said.collect() if r.refused} == {1: "unknown_key", 3: "exists", 4: "blank_name", 5: "blank_name", 8: "unknown_fields:owner", 9: "blank_name", 11: "unknown_operation", 13: "exists"}


def test_signatures_keep_fields_and_rows_apart(spark):
    schema = "source_id long, id string, speaker string, start_sample long, end_sample long, text string"
    two = [("1", "A", 0, 5, "x"), ("2", "B", 5, 9, "y")]
    cases = [two, [("1", "A", 0, 5, "x\n2|B|5|9|y")], [("1", "A|0", 0, 5, "x")], [("1", "A", 0, 0, "5|x")], [("1", "A", 0, 5, None)], [("1", "A", 0, 5, "")], [("1", None, 0, 5, "x")], [("1", "-", 0, 5, "x")], list(reversed(two))]
    rows = [(k, *r) for k, case in enumerate(cases) for r in case]
    got = {r.source_id: r.signature for r in R.signature(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == got[len(cases) - 1] and len(set(got.values())) == len(cases) - 1


def test_label_mappings(spark):
    gold = [(1, "X", 0), (1, "Y", 100), (2, "A", 0), (2, "B", 100), (2, "C", 200), (3, "X", 0), (3, "Y", 100)]
    segments = spark.createDataFrame([(k, p, s, s + 100, n) for n, (k, p, s) in enumerate(gold)], "k long, speaker string, start_sample long, end_sample long, no long")
    words = [(1, 0, 10, 30, "s1"), (1, 1, 90, 120, "s0"), (1, 2, 150, 160, "s0"), (1, 3, 150, 160, "s1"), (1, 4, 500, 501, "s0"), (1, 5, None, 5, "s0"), (1, 6, 1, 5, None), (2, 0, 0, 9, "A"), (2, 1, 0, 9, "B"), (3, 0, 0, 9, "X"), (3, 1, 110, 120, "X"), (4, 0, 0, 9, "X")]
    df = R.gold_labels(spark.createDataFrame(words, "k long, i long, start_sample long, end_sample long, detected string"), segments, ["k"], ["i"], "no")
    got = {(r.k, r.mapping, r.errors, r.evaluated) for r in R.best_permutation(df, segments, ["k"]).collect()}
    assert got == {(1, "crossed", 1, 4), (2, "identity", 1, 2), (3, "identity", 1, 2)}


def test_full_case_folding(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 997])) for k in range(0, len(points), 997)] + ["ΣΑΣ", "ǰoŉ ﬁne STRASSE ß", "İI", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", T.casefold(F.col("t")).alias("f"), T.normalized_tokens(F.col("t")).alias("n")).collect()
    assert [r.f for r in sorted(rows)] == [t.casefold() for t in texts]
    assert {r.k - len(texts): r.n for r in rows if r.k >= len(texts) - 4} == {-4: ["σασ"], -3: ["ǰoŉ".casefold(), "fine", "strasse", "ss"], -2: ["i̇i"], -1: []}


def test_running_totals(spark):
    rows = [(k * 7 % 1009, k % 5) for k in range(1009)]
    got = {r.k: r.before for r in R.running_totals(spark.createDataFrame(rows, "k long, n long").repartition(5), "k", "n").collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n


def test_overlaid_figures(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}, {"b": None, "c": 3.0}), (2, None, {"a": 1.0}), (3, {"a": 1.0}, None), (4, None, None)], "k long, x map<string,double>, y map<string,double>")
    got = {r.k: r.m for r in rows.select("k", C.overlay(F.col("x"), F.col("y")).alias("m")).collect()}
    assert got == {1: {"a": 1.0, "b": None, "c": 3.0}, 2: {"a": 1.0}, 3: {"a": 1.0}, 4: {}}


def test_greedy_ways_over_long_silences(spark):
    """Talk, an hour without any, talk again: the clips of the silence have the greatest length."""
    s = CLOCK
    turns = [("AB"[k % 2], 4 * k * s, (4 * k + 3) * s) for k in range(20)] + [("AB"[k % 2], (3700 + 5 * k) * s, (3704 + 5 * k) * s) for k in range(30)]
    acts = spark.createDataFrame([(1, *t) for t in turns] + [(2, "A", 0, s)], "source_id long, speaker string, start_sample long, end_sample long")
    durations = spark.createDataFrame([(1, 4000 * s), (2, 5 * s)], "source_id long, duration long")
    clips = sorted((r.source_id, r.clip_no, r.start_sample, r.end_sample) for r in G.greedy_segments(acts, durations, "A").collect())
    one = [c[1:] for c in clips if c[0] == 1]
    assert [c[0] for c in one] == list(range(1, len(one) + 1)) and all(a[2] == b[1] for a, b in zip(one, one[1:]))
    longest = int(DEFAULT.max_clip_s * s)
    assert one[0][1] == 0 and one[-1][2] == (3704 + 145) * s + int(DEFAULT.context_s * s) and sum(c[2] - c[1] == longest for c in one) > 65
    assert [c[1:] for c in clips if c[0] == 2] == [(1, 0, s + int(DEFAULT.context_s * s))]


def test_follow(spark):
    steps = spark.createDataFrame([(1, k, k + 1) for k in range(37)] + [(2, 5, 9)], "source_id long, c long, e long")
    got = sorted((r.source_id, r.c, r.place) for r in G.follow(steps, spark.createDataFrame([(1, 3), (2, 5), (3, 0)], "source_id long, c long")).collect())
    assert got == [(1, k, k - 3) for k in range(3, 38)] + [(2, 5, 0), (2, 9, 1), (3, 0, 0)]
