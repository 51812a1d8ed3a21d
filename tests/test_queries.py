"""Every registered query of the conversation engine against its SQL on the smallest tables."""

import math
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

from parlance.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(_cell(r[k]) for k in order) for r in res.fetchall())


def test_every_other_query_has_a_test_of_its_own():
    plans = {"G6_greedy_segments", "G8_feasible_counts", "G8_count_plans", "G9_target_plan", "G10_plan_verdicts", "G11_manual_plan"}  # tests/test_planning.py
    assert set(registry.QUERIES) - set(registry.ORACLES) == plans | {"T7_select_decode", "A11_error_rates", "R2_stereo_routing", "R6_clip_artifacts"}  # the last: tests/test_rendering.py


def _tokens(text):
    return re.findall(r"\w+", text.casefold())


def test_select_decode(spark, duck):
    got = {(r.conv_id, r.turn): (r.selected, r.disagreement, r.flags) for r in registry.QUERIES["T7_select_decode"](spark, SF).collect()}
    rows = duck.execute("select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as after from conversations qualify after is not null").fetchall()
    for conv, turn, text, after in rows:
        a, b = " ".join(_tokens(text)), " ".join(_tokens(after))
        gap = 1 - SequenceMatcher(None, a, b).ratio() if a or b else 0.0
        assert got[conv, turn] == ("retry" if turn % 10 / 10 < 0.6 else "initial", gap, "decode_disagreement" if gap > 0.25 else "")
    assert len(got) == len(rows) > 10


def _distance(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b], int))
        row = np.concatenate([[i], best])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def test_error_rates(spark, duck):
    got = {r.item_id: (r.wer, r.cer) for r in registry.QUERIES["A11_error_rates"](spark, SF).collect()}
    texts = dict(duck.execute("select item_id, text from benchmark").fetchall())
    pairs = [k for k in texts if k + 1 in texts]
    for k in pairs:
        gold, said = _tokens(texts[k]), _tokens(texts[k + 1])
        assert got[k] == (_distance(said, gold) / max(1, len(gold)), _distance("".join(said), "".join(gold)) / max(1, len("".join(gold))))
    assert len(got) == len(pairs) > 3


def test_stereo_routing(spark, duck):
    got = {int(r.clip_id): (r.blocks, r.left_sum, r.right_sum) for r in registry.QUERIES["R2_stereo_routing"](spark, SF).collect()}
    values = duck.execute("select user_id, list(value / 200 order by event_id) from events group by 1").fetchall()
    tone = np.arange(240) * 7 % 21 - 10
    for user, vs in values:
        x = np.abs(np.clip(np.array(vs)[:, None] * tone / 10, -1, 1).astype(np.float32).ravel().astype(float))
        n = len(x)
        sums = []
        for lo, hi in ((0, n * 5 // 10), (n * 6 // 10, n)):  # the stretch between is muted
            at, width = np.arange(hi - lo), min(24, (hi - lo) // 2)
            sums.append((x[lo:hi] * np.clip(np.minimum(at, hi - lo - 1 - at) / max(1, width - 1), 0, 1)).sum())
        assert got[user][0] == len(vs) and got[user][1:] == pytest.approx(sums, abs=2e-3)
    assert len(got) == len(values)
