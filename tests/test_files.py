import io
import sys
import zipfile

import pytest

from clonoforge.operators import similarity
from clonoforge.sources import files

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets):
    """A spreadsheet file of text and number cells; the second sheet's strings stand in line."""
    shared = []
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {SPACE} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            out = []
            for r, cells in rows.items():
                parts = []
                for at, value in cells.items():
                    if isinstance(value, str) and k == 1:
                        shared.append(value)
                        parts.append(f'<c r="{at}{r}" t="s"><v>{len(shared) - 1}</v></c>')
                    elif isinstance(value, str):
                        parts.append(f'<c r="{at}{r}" t="inlineStr"><is><t>{value}</t></is></c>')
                    else:
                        parts.append(f'<c r="{at}{r}"><v>{value}</v></c>')
                out.append(f'<row r="{r}">{"".join(parts)}</row>')
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {SPACE}><sheetData>{''.join(out)}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {SPACE}>{''.join(f'<si><t>{x}</t></si>' for x in shared)}</sst>")


def test_excel(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    workbook(path, {"one": {1: {"A": "name", "C": "value"}, 2: {"A": "x", "C": 1.5}, 4: {"B": "late"}}, "two": {1: {"A": "k"}, 2: {"A": "inline"}}})
    assert [tuple(r) for r in files.read_table(spark, path).toDF("a", "b", "c").collect()] == [("x", "", "1.5"), ("", "", ""), ("", "late", "")]
    assert [r.k for r in files.read_excel(spark, path, "two").collect()] == ["inline"]
    with pytest.raises(ValueError, match="no sheet three"):
        files.read_excel(spark, path, "three")
    with pytest.raises(ValueError, match="old Excel"):
        files.read_table(spark, str(tmp_path / "t.xls"))


def test_text_inputs(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", io.StringIO("a|b\n1|x\n2|y\n"))
    assert [tuple(r) for r in files.read_table(spark, "-").orderBy("a").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "a.tsv").write_text("sequence_id\tcdr3_aa\n1\tASSF\n2\t\n")
    (tmp_path / "b.tsv").write_text("sequence_id\n1\n")
    assert [r.sequence for r in files.read_airr(spark, str(tmp_path / "a.tsv")).collect()] == ["ASSF", None]
    assert files.read_airr(spark, str(tmp_path / "b.tsv")).count() == 0
    (tmp_path / "l.txt").write_text(" ASSF \n\nASSW\n")
    assert [r.sequence for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["ASSF", "ASSW"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").coalesce(1)
    for name, separator in (("o.csv", ","), ("o.tsv", "\t"), ("o", "\t")):
        files.write_table(df, str(tmp_path / name))
        assert [tuple(r) for r in files.read_table(spark, str(tmp_path / name), separator).collect()] == [(1, "x"), (2, None)]
    capsys.readouterr()
    files.write_table(df, "-", ",")
    assert capsys.readouterr().out == "a,b\n1,x\n2,\n"
    with pytest.raises(ValueError):
        files.write_table(df, "-", ";")


def test_strict_residues(spark):
    df = spark.createDataFrame([("CASSF",), ("CA1F",)], "s string")
    assert similarity.usable(df, "s", trimmed=False).count() == 1
    with pytest.raises(Exception, match="no residue sequence: CA1F"):
        similarity.usable(df, "s", trimmed=False, strict=True).collect()
