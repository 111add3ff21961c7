"""Broken files beside good ones: the good ones' records, and a dead letter for each of the others."""

import zipfile

from quillstone.sources import files, tolerant
from quillstone.sources.sinks import append_log


def workbook(path, rows):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')


def test_broken_files_are_dead_letters(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "good.csv").write_text('a,b\n1,"x, y"\n2,\n')
    (d / "latin.csv").write_bytes("a,b\né,ß\n".encode("latin-1"))
    (d / "mark.tsv").write_bytes("a\tb\n1\t2\n".encode("utf-8-sig"))
    (d / "long.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(12)))
    (d / "empty.csv").write_text("")
    (d / "broken.csv").write_text('a,b\n1,2\n1,2,3,4\n"never closed')
    (d / "nul.csv").write_bytes(b"a,b\n\x00,2\n")
    workbook(d / "good.xlsx", [["name", "value"], ["iron", "5"], ["zinc", "7"]])
    (d / "broken.xlsx").write_bytes(b"PK\x03\x04 cut short")
    with zipfile.ZipFile(d / "good.zip", "w") as z:
        z.writestr("in/t.csv", "a,b\n9,8\n")
        z.writestr("readme.txt", "hello")
        z.writestr("bad.csv", 'a\n"open')
    (d / "broken.zip").write_bytes((d / "good.zip").read_bytes()[:60])
    (d / "note.txt").write_text("no table")
    good, dead = tolerant.dead_letters(tolerant.read_records(spark, str(d), cap=10))
    got = {}
    for r in good.orderBy("path", "part", "n").collect():
        got.setdefault((r.path.split("/")[-1], r.part), []).append((dict(r.record), r.encoding, r.truncated))
    assert got["good.csv", None] == [({"a": "1", "b": "x, y"}, "utf-8", False), ({"a": "2", "b": ""}, "utf-8", False)]
    assert got["latin.csv", None] == [({"a": "é", "b": "ß"}, "latin-1", False)]
    assert got["mark.tsv", None] == [({"a": "1", "b": "2"}, "utf-8-sig", False)]
    assert len(got["long.csv", None]) == 10 and got["long.csv", None][0][2] is True
    assert [r for r, *_ in got["good.xlsx", "sheet1"]] == [{"name": "iron", "value": "5"}, {"name": "zinc", "value": "7"}]
    assert got["good.zip", "in/t.csv"][0][0] == {"a": "9", "b": "8"} and got["good.zip", "readme.txt"][0][0] == {"name": "readme.txt", "size": "5"}
    letters = {(r.path.split("/")[-1], r.part): r.error for r in dead.collect()}
    assert set(letters) == {("broken.csv", None), ("nul.csv", None), ("broken.xlsx", None), ("broken.zip", None), ("good.zip", "bad.csv")}
    assert letters["broken.zip", None].startswith("ZIP parse error") and letters["nul.csv", None].startswith("CSV parse error")
    log = str(tmp_path / "log")
    append_log(dead, log)
    append_log(dead, log)
    assert spark.read.parquet(log).where("stage = 'parse' and logged_at is not null").count() == 10
    assert [(r.sheet, r.error is None) for r in files.read_xlsx(spark, str(d / "*.xlsx")).select("sheet", "error").distinct().collect()].count((None, False)) == 1
    assert files.read_archive_listing(spark, str(d / "*.zip")).where("error is not null").count() == 1


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert tolerant.read_records(spark, str(tmp_path)).count() == 0
