"""Readers and writers."""

from __future__ import annotations

import math

import pytest

from kilnworks.sources import files


def test_encodings(spark, tmp_path):
    for encoding in ("utf-8-sig", "gb18030", "utf-16"):
        path = tmp_path / f"{encoding}.csv"
        path.write_text("时间,温度\n1,2\n", encoding=encoding)
        assert files.read_csv(spark, str(path)).columns == ["时间", "温度"]


def test_encoding_is_that_of_all_lines(spark, tmp_path):
    plain = "a,b\n" + "1,2\n" * 3000
    (tmp_path / "late.csv").write_bytes(plain.encode() + "温,度\n".encode("gb18030"))
    (tmp_path / "utf.csv").write_bytes(plain.encode() + "温,度\n".encode())
    for name, encoding in (("late", "GB18030"), ("utf", "UTF-8")):
        path = str(tmp_path / f"{name}.csv")
        assert files.encoding_of(spark, path) == encoding
        got = files.read_csv(spark, path)
        assert got.count() == 3001 and got.filter("a = '温' and b = '度'").count() == 1
    (tmp_path / "none.csv").write_bytes(b"a,b\n\xff\xfe\xff,1\n\x81")
    with pytest.raises(ValueError):
        files.encoding_of(spark, str(tmp_path / "none.csv"), ["UTF-8", "GB18030"])


def test_header_is_the_first_line_of_each_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"名,值\n{i},x\n名,值\n", encoding="gb18030")
    got = sorted(tuple(r) for r in files.read_csv(spark, str(folder)).collect())
    assert got == [("0", "x"), ("1", "x"), ("2", "x"), *[("名", "值")] * 3]
    (tmp_path / "quoted.csv").write_text('a,b\n"two\nlines",1\n', encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "quoted.csv")).first()["a"] == "two\nlines"


def test_lines_are_skipped_in_each_file(spark, tmp_path):
    folder = tmp_path / "numbers"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"9 9\n8 8\n{i} {i}\n")
    assert sorted(r["a"] for r in files.read_whitespace(spark, str(folder), ["a", "b"], skip=2).collect()) == [0, 1, 2]


def test_json_within_lists_and_records(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, math.nan], (math.inf, "x"))], "k int, l array<double>, s struct<v: double, t: string>")
    for _ in range(2):  # the second takes the first one's place
        files.write_jsonl(df, str(tmp_path / "deep"))
    row = files.read_jsonl(spark, str(tmp_path / "deep"), "k int, l array<double>, s struct<v: double, t: string>").collect()
    assert len(row) == 1 and row[0]["l"] == [1.0, None] and row[0]["s"]["v"] is None and row[0]["s"]["t"] == "x"


def test_whitespace(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("  1.0  2.0\n3 x\n1 2 3\n")
    rows = files.read_whitespace(spark, str(path), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0), (3.0, None)]


def test_jsonl_drops_what_is_no_json(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]


def test_json_has_no_nan(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, math.nan), (2, 1.5)], "k int, x double"), str(tmp_path / "out"))
    got = {r["k"]: r["x"] for r in files.read_jsonl(spark, str(tmp_path / "out"), "k int, x double").collect()}
    assert got == {1: None, 2: 1.5}


def test_size_guard(spark):
    with pytest.raises(ValueError):
        files.check_size(spark.range(11), max_rows=10)
    files.check_size(spark.range(10), max_rows=10)


def test_hashes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.file_hashes(spark, str(tmp_path / "x.bin")).first()["sha256"].startswith("ba7816bf")
