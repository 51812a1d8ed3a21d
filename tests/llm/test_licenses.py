"""Licences however their lines are broken, whatever their notice looks like; texts from a folder; odd rows."""

import os
import textwrap

import pytest

from parlance.llm import licenses

SCHEMA = "doc_id long, text string, digest string, t long, license_id string"
FULL = {k: v for k, v in licenses.KNOWN.items() if not k.endswith("-notice")}
COMMON = "/usr/share/common-licenses"


def _rows(spark, texts):
    return spark.createDataFrame([(k, t, "d", 1, "l") for k, t in enumerate(texts)], SCHEMA)


def _wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def test_every_width(spark):
    cases = [(name, _wrapped(t, width)) for name, text in FULL.items() for t in (text, text.partition("\n")[2].strip()) for width in range(40, 121)]
    got = {r.doc_id: r.whole_license for r in licenses.scan(_rows(spark, [t for _, t in cases])).collect()}
    assert [got[k] for k in range(len(cases))] == [name for name, _ in cases]


@pytest.mark.parametrize(
    "notice",
    ["Copyright (c) 2020 A. Body", "# Copyright 1999-2004, A. Body", "© A. Body and others", "(C) 2012 A. Body", "Copyright © 2001 A. Body\nAll rights reserved.", "Copyright (c) 2020 A. Body and very\nmany others who have long names", ""],
)
def test_notices(spark, notice):
    texts = [_wrapped(FULL[k].replace("Copyright (c) <year> <copyright holders>", notice).replace("Copyright (c) <year>, <owner>", notice), 70) if "\n" not in notice else FULL[k].replace("Copyright (c) <year> <copyright holders>", notice).replace("Copyright (c) <year>, <owner>", notice) for k in ("MIT", "BSD-3-Clause")]
    assert [r.whole_license for r in sorted(licenses.scan(_rows(spark, texts)).collect())] == ["MIT", "BSD-3-Clause"]


def test_changed_texts_do_not_match(spark):
    text = FULL["MIT"]
    changed = [text.replace("without limitation", "with limitation"), text + "\nand more words", text.replace("COPYRIGHT HOLDERS BE", "BE"), "Copyright holders be liable", "copyright 2020 x"]
    assert [r.whole_license for r in licenses.scan(_rows(spark, changed)).collect()] == [None] * 5


def test_spellings_across_lines(spark):
    text = _wrapped(FULL["BSD-3-Clause"], 60).replace("copyright holder", "copyright\nowner").replace("COPYRIGHT HOLDERS", "COPYRIGHT\n  OWNERS")
    assert licenses.scan(_rows(spark, [text])).first().whole_license == "BSD-3-Clause"


def test_null_ids_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, FULL["MIT"], "d", 1, "l"), (1, FULL["ISC"], "d", 1, "l"), (1, FULL["ISC"], "d", 1, "l"), (1, None, "d", 1, "l"), (2, "", "d", 1, "l")], SCHEMA)
    got = [(str(r.doc_id), r.whole_license, r.n_notices) for r in licenses.scan(rows).collect()]
    assert sorted(got, key=str) == sorted([("None", "MIT", 0), ("1", "ISC", 0), ("1", "ISC", 0), ("1", None, 0), ("2", None, 0)], key=str)
    assert licenses.scan(rows.limit(0)).count() == 0


def test_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "Long-1.0.txt").write_text("Long License\n\nCopyright (c) 2000 X\n\nYou are permitted to do (c) this\nand that.\n")
    known = licenses.known_texts(spark, str(tmp_path))
    got = licenses.scan(_rows(spark, ["Long Licence\nCopyright 2024 Y\n\nYou are permitted to do\n(c) this and that"]), known).first()
    assert (list(known), got.whole_license) == (["Long-1.0"], "Long-1.0")


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no folder of common licences")
def test_common_licenses_at_many_widths(spark):
    known = licenses.known_texts(spark, f"file://{COMMON}")
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "MPL-2.0") if n in known]
    fold = lambda text, w: "\n".join(textwrap.fill(line, w, break_long_words=False, break_on_hyphens=False) for line in text.split("\n"))
    cases = [(n, fold(known[n], w)) for n in names for w in (40, 50, 60, 72, 100)]
    got = {r.doc_id: r.whole_license for r in licenses.scan(_rows(spark, [t for _, t in cases]), {n: known[n] for n in names}).collect()}
    assert names and [got[k] for k in range(len(cases))] == [n for n, _ in cases]
