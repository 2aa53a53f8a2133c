"""CSV files held against Python's csv module, whatever the splits."""

from __future__ import annotations

import csv
import random

import pytest

from graphloom.sources import csv_import, csv_profile, text_files

CELLS = ["a", "", 'say "hi", you', "x\ny", '"', '""', "a,b", " lead", "trail ", "ü", "l1\n\nl3", 'p"q', "\n", 'end"', "\r\nz", "\\"]


@pytest.mark.parametrize("size", ["300", "64m"])
def test_rows_equal_the_csv_module(spark, tmp_path, size):
    r, want = random.Random(3), []
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator=["\n", "\r\n"][f])
            w.writerow(["id", "b c", "c"])
            w.writerows([[f * 1_000 + i, r.choice(CELLS), r.choice(CELLS)] for i in range(150)])
            out.write('7,ab"c,d"e\n\n8,only\n9,"x"y"z,1,beyond\n')
        with open(tmp_path / f"f{f}.csv", newline="", encoding="utf-8") as file:
            want += [(row + [""] * 3)[:3] for row in list(csv.reader(file))[1:] if row]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(csv_profile.read_rows(spark, str(tmp_path)).collect(), key=lambda x: x._row)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert [x._row for x in got] == list(range(1, len(want) + 1))
    assert [[x or "" for x in g[:3]] for g in got] == want


def test_import_of_quoted_fields(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,name,note\n1,"Lee, Ann","first\nsecond"\n2,Bo,"say ""x"""\n')
    s = csv_import.Structure("notes", ("name", "note"), id="id")
    made = csv_import.run(csv_profile.read_rows(spark, str(tmp_path / "notes.csv")), "notes", s)
    assert {(r.vid, r.label, r.props["note"]) for r in made.vertices.collect()} == {("1", "Lee, Ann", "first\nsecond"), ("2", "Bo", 'say "x"')}
    assert made.report() == {"rows": 2, "errors": 0, "created": 2, "duplicates": 0}


def test_numbers_of_rows_from_files(spark, tmp_path):
    spark.range(50).repartition(5).write.parquet(str(tmp_path / "t"))
    got = csv_profile.numbered(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r._row for r in got.collect()) == list(range(1, 51)) and got.columns == ["id", "_row"]


def test_all_rows_and_whole_texts(spark, tmp_path):
    (tmp_path / "long.txt").write_text("x" * 130_000)
    assert len(text_files.read_texts(spark, str(tmp_path)).first().text) == 130_000
    assert len(text_files.read_files(spark, str(tmp_path / "long.txt")).first().text) == 130_000
    assert len(text_files.read_files(spark, str(tmp_path / "long.txt"), 10).first().text) == 10
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(1, 1_202)], "_row long, a string")
    parts = text_files.table_texts(rows).orderBy("part").collect()
    assert "\n".join(p.text for p in parts) == "\n".join(f"[row {i}] a=v{i}" for i in range(1, 1_202)) and len(parts) == 3
