"""Members of ZIP files and rows of workbooks."""

import io
import zipfile

import pytest

from shapewright.sources import archives


def frame(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_workbook_round_trip(spark, tmp_path):
    rows = [["id", "a & b <c>", None, "x"], [1, "é\"日", 2.5, None], [None, None, None, "last"], [-3, "", 1e-7, "y"]]
    (tmp_path / "b.xlsx").write_bytes(archives.workbook(rows, "S & T"))
    got = {r["row"]: r["cells"] for r in archives.workbook_rows(archives.whole_files(spark, str(tmp_path), "*.xlsx"), "S & T").collect()}
    assert got == {1: ["id", "a & b <c>", None, "x"], 2: ["1", "é\"日", "2.5"], 3: [None, None, None, "last"], 4: ["-3", "", "1e-07", "y"]}
    wide = [[f"c{i}" for i in range(60)], list(range(60))]
    assert list(archives.sheet_rows(archives.workbook(wide)))[1][1] == [str(i) for i in range(60)]
    with pytest.raises(Exception, match="no sheet"):
        archives.workbook_rows(frame(spark, {"x": archives.workbook(rows)}), "Other").collect()


def test_inline_and_absent_cells():
    main = archives.MAIN.strip("{}")
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="inlineStr"><is><r><t>two </t></r><r><t>runs</t></r></is></c><c r="AA3"><v>7</v></c></row><row r="9"><c r="A9" t="str"><v>f</v></c><c r="B9" t="b"/></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(archives.workbook([["x"]]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if name != archives.STRINGS:
                new.writestr(name, sheet if name.endswith("sheet1.xml") else old.read(name))
    assert list(archives.sheet_rows(out.getvalue())) == [(3, [None, "two runs", *[None] * 24, "7"]), (9, ["f", None])]


def test_headers_must_agree(spark):
    books = {"a": archives.workbook([["k", "v"], ["x", 1]]), "b": archives.workbook([["k", "v"], ["y", 2]])}
    got = sorted((r["path"], r["k"], r["v"]) for r in archives.tabled(archives.workbook_rows(frame(spark, books))).collect())
    assert got == [("a", "x", "1"), ("b", "y", "2")]
    with pytest.raises(ValueError, match="headers"):
        archives.tabled(archives.workbook_rows(frame(spark, books | {"c": archives.workbook([["k", "w"]])})))


def test_zip_members(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        held.writestr("a/1.csv", "x")
        held.writestr("a/2.csv", "")
        held.writestr("b.txt", "y")
        held.mkdir("d")
    got = sorted((r["member"], bytes(r["content"])) for r in archives.zip_members(frame(spark, {"z": out.getvalue()}), r".*\.csv").collect())
    assert got == [("a/1.csv", b"x"), ("a/2.csv", b"")]
    with pytest.raises(Exception, match="zip"):
        archives.zip_members(frame(spark, {"z": b"no zip"})).collect()
