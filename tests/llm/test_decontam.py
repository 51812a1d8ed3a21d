"""Decontamination: items at every offset, in parts, beside decoys, against a brute-force search."""

import random

from parlance.llm import decontam

PAD = "zu va we xi yo za bu ce di fo gu ha ji ka lo mu".split()
ITEM = "a crate holds 12 red apples and weighs 30 kg in total".split()


def _found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.matches(d, b).collect()}


def test_part_of_an_item_at_every_offset(spark):
    parts = [ITEM[:10], ITEM[2:], ITEM]
    docs = [" ".join([*PAD[:k], *part, *PAD]) for part in parts for k in range(9)]  # 3, 3 and all 5 of the windows
    assert {d for d, _ in _found(spark, docs, [" ".join(ITEM)])} == set(range(len(docs)))


def test_decoys_before_and_after(spark):
    item = "a crate holds 12 red apples and 12 green apples and weighs 30 kg in total on a scale"
    decoy = "a crate holds 5 red apples and 7 green apples and weighs 9 kg in total on a scale"
    changed = item.replace("12", "44").replace("30", "31")
    pad = " " + " ".join(PAD) + " "
    docs = [item, decoy, decoy + pad + item, item + pad + decoy, decoy + pad + decoy + pad + item + pad + decoy, changed, decoy + pad + changed, pad + pad]
    assert {d for d, _ in _found(spark, docs, [item])} == {0, 2, 3, 4, 5, 6}


def test_against_brute_force(spark):
    """Words without names or numbers: an item is found if half of its eight-word windows stand in the document."""
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(30)] + ["the same words again and again and the same words again and again and", items_tail := "one two three four five six seven"]
    docs = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        cut = rng.choice(items).split()
        a = rng.randrange(len(cut))
        at = rng.randrange(len(base) + 1)
        docs.append(" ".join([*base[:at], *cut[a // 2 : len(cut) - rng.randrange(3)], *base[at:]]))
    docs += ["", None, items_tail, "x " + items_tail + " y", " ".join(items_tail.split()[:6])]

    def windows(text):
        w = (text or "").split()
        return [tuple(w[k : k + 8]) for k in range(len(w) - 7)]

    want = set()
    for d, doc in enumerate(docs):
        have = set(windows(doc))
        for i, item in enumerate(items):
            need = windows(item)
            if need and sum(w in have for w in need) >= 0.5 * len(need) or not need and f" {item} " in f" {doc or ''} ":
                want.add((d, i))
    assert _found(spark, docs, items) == want and len(want) > 40


def test_stage_with_odd_rows(spark):
    item = "what is the height of the tall tower near the old river in metres"
    rows = [(1, item, "a", 1), (2, None, "b", 2), (3, "", "c", 3), (None, item, "d", 4), (4, "clean text", "e", 5), (4, "clean text", "e", 5), (5, "x " * 60_000 + item, "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, kinds int")
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    found = decontam.matches(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (5, 1)}
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.matches(df.limit(0), bench).count() == 0
    out = decontam.decontaminate(df, bench).collect()
    assert len(out) == len(rows) and sorted(r.doc_id for r in out if r.contaminated) == [1, 5]
