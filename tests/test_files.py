"""Report files of all kinds on disk, and versions that are published once."""

import json

import pytest

from parlance.operators import files as W


def _texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_scan_of_plain_files(spark, tmp_path):
    clip = lambda path, status, clip_id="c": {"path": path, "status": status, "clip_id": clip_id, "other": 1}
    files = {
        "a_qc.json": json.dumps({"source": "s", "clips": [clip("x\\y.wav", "PASS"), clip("x/y.wav", "REVIEW", "d"), clip("z", "REJECT", ""), clip("", "PASS", "e")]}, indent=2),
        "b_qc.json": json.dumps({"clips": [clip("z", "PASS"), clip("n", None, "n"), {"path": "only"}, None]}),
        "c_qc.json": '{"source": "s", "clips": [{"path": "x/y.wav", "sta',
        "d_qc.json": "",
        "e_qc.json": json.dumps({"source": "s"}),
        "f_qc.json": json.dumps({"source": "s", "clips": []}),
        "g_qc.json": json.dumps({"clips": "none"}),
        "h.json": json.dumps({"clips": [clip("z", "REJECT")]}),
        "0_qc.json": json.dumps({"source": "t", "clips": [clip("z", "REJECT", "d"), clip("q", "REJECT", "q")]}),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    clips = W.scan_reports(spark, str(tmp_path))
    assert {(r.path, r.status) for r in W.status_index(clips).collect()} == {("x/y.wav", "REVIEW"), ("z", "PASS"), ("q", "REJECT")}
    assert {(r.clip_id, r.key) for r in W.source_index(clips).collect()} == {("c", "b"), ("d", "a"), ("e", "a"), ("n", "b"), ("q", "0")}
    assert [json.loads(r.value)["source"] for r in W.rejected(clips).collect()] == ["s", "t", "t"]


def test_scan_of_written_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a_qc.json", '{"source":"a","clips":[{"path":"p","clip_id":"1","status":"PASS"}]}'), ("b_qc.json", "no JSON")], "file string, value string")
    W.write_reports(rows, str(tmp_path / "r"))
    assert [(r.file, r.source, r.pos, r.clip.path) for r in W.scan_reports(spark, str(tmp_path / "r")).collect()] == [("a_qc.json", "a", 0, "p")]
    (tmp_path / "none").mkdir()
    assert W.scan_reports(spark, str(tmp_path / "none")).count() == 0


def test_a_version_is_published_once(spark, tmp_path):
    folder = str(tmp_path)
    out = W.publish({"train": _texts(spark, ["b", "a", "a"]), "empty": _texts(spark, [])}, folder, "set", 3)
    assert {(r.file, r.rows) for r in out.collect()} == {("train", 3), ("empty", 0)}
    before = {str(p) for p in tmp_path.rglob("*")}
    with pytest.raises(W.VersionExists):
        W.publish({"train": _texts(spark, ["other"])}, folder, "set", 3)
    assert {str(p) for p in tmp_path.rglob("*")} == before
    assert sorted(r.value for r in W.read_export(spark, folder, "set", 3, "train").collect()) == ["a", "a", "b"]
    assert all(r.intact for r in W.verify_export(spark, folder, "set", 3).collect())
    with pytest.raises(KeyError):
        W.read_export(spark, folder, "set", 3, "eval")


def test_a_failed_attempt_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    bad = _texts(spark, ["x"]).selectExpr("CAST(raise_error('broken') AS STRING) AS value")
    with pytest.raises(Exception, match="broken"):
        W.publish({"train": _texts(spark, ["a"]), "zzz": bad}, folder, "set", 1)
    assert W.published(spark, folder, "set", 1) is None
    with pytest.raises(FileNotFoundError):
        W.read_export(spark, folder, "set", 1, "train")
    W.publish({"train": _texts(spark, ["b"])}, folder, "set", 1)
    assert [r.value for r in W.read_export(spark, folder, "set", 1, "train").collect()] == ["b"]


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path)
    W.publish({"train": _texts(spark, ["a", "b"])}, folder, "set", 1)
    part = next(p for p in (tmp_path / "set_v001").rglob("part-*") if p.read_text())
    part.write_text("c\n")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert [r.intact for r in W.verify_export(spark, folder, "set", 1).collect()] == [False]
