import tracemalloc
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.sources import workbooks as W

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
MAIN = W.MAIN[1:-1]


def book(path, sheets, texts=(), styles=""):
    """A workbook from the XML of its rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{W.RELATION[1:W.RELATION.index("}")]}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            with z.open(f"xl/worksheets/s{i}.xml", "w") as out:
                out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for r in [rows] if isinstance(rows, str) else rows:
                    out.write(r.encode())
                out.write(b"</sheetData></worksheet>")
        if texts:
            z.writestr("xl/sharedStrings.xml", f'{HEAD}<sst xmlns="{MAIN}">' + "".join(f"<si>{t}</si>" for t in texts) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_cells_of_all_kinds(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy/mm"/><numFmt numFmtId="171" formatCode="0.0&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="C1" t="str"><v>c</v></c><c r="D1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" s="2"><v>45292.75</v></c></row><row r="4"><c r="B4" t="e"><v>#N/A</v></c><c r="D4" s="3"><v>7</v></c></row>'
    book(tmp_path / "a.xlsx", {"one": rows, "two": '<row><c t="s"><v>0</v></c><c/><c><v>2</v></c></row>'}, ["<t>a</t>", "<r><t>a</t></r><r><t> d</t></r>"], styles)
    got = [tuple(r) for r in W.read_workbook(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()]
    assert W.read_workbook(spark, str(tmp_path / "a.xlsx")).columns == ["row", "a", "b", "c", "a d"]
    assert got == [(2, "1.5", "true", "2024-01-01", "2024-01-01T18:00:00"), (4, None, None, None, "7")]
    every = spark.read.format("workbook").option("sheet", "*").load(str(tmp_path))
    assert sorted((r.sheet, r.row) for r in every.collect()) == [("one", 1), ("one", 2), ("one", 4), ("two", 1)] and every.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in W.read_workbook(spark, str(tmp_path / "a.xlsx"), "two", header=False).collect()] == [(1, "a", "2")]
    with pytest.raises(Exception, match="no sheet three"):
        W.read_workbook(spark, str(tmp_path / "a.xlsx"), "three").collect()


def line(n, *values):
    return f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="str"><v>{v}</v></c>' for c, v in zip("ABCDEF", values, strict=False) if v is not None) + "</row>"


def test_margins_headers_and_empty_sheets(spark, tmp_path):
    book(tmp_path / "b.xlsx", {"margin": line(1) + line(3, None, "x", None, "x", "id") + line(4, None, "1", None, None, "2") + line(5) + line(6, None, None, None, "3", None), "plain": line(1, "a", "b") + line(2) + line(3, "1", None), "none": ""})
    margin = W.read_workbook(spark, str(tmp_path / "b.xlsx"), "margin")
    assert margin.columns == ["row", "x", "x_2", "id_original"] and sorted(map(tuple, margin.collect())) == [(4, "1", None, "2"), (6, None, "3", None)]
    plain = W.read_workbook(spark, str(tmp_path / "b.xlsx"), 1)
    assert sorted(map(tuple, plain.collect())) == [(2, None, None), (3, "1", None)]  # no margin: nothing is left out
    assert W.read_workbook(spark, str(tmp_path / "b.xlsx"), "none").collect() == []


def test_memory_stays_flat(tmp_path):
    """Ten times the rows take no more memory."""
    peaks = []
    for many in (4_000, 40_000):
        book(tmp_path / f"{many}.xlsx", {"s": (line(n, f"value {n}", "x" * 50, str(n)) for n in range(1, many + 1))})
        with zipfile.ZipFile(tmp_path / f"{many}.xlsx") as z:
            tracemalloc.start()
            assert sum(1 for _ in W.sheet_rows(z, "xl/worksheets/s0.xml", [], set())) == many
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_rows_to_nested_documents(spark):
    rows = spark.createDataFrame([("r1", 2, None, "5", "B", "b2"), ("r1", 1, "T", None, "A", "b1"), ("r1", 3, "U", "6", None, None), ("r2", 1, None, None, None, None), (None, 1, "x", "x", "x", "x")], "id string, n int, title string, amount string, who string, bid string")
    out = W.documents_from_rows(rows, "id", {"tender.title": "title", "tender.value.amount": "amount", "name": "who"}, {"bids.details": {"who": "who", "no": "bid"}}, "n")
    got = {r.id: r.asDict(True) for r in out.collect()}
    assert got["r1"] == {"id": "r1", "tender": {"title": "T", "value": {"amount": "5"}}, "name": "A", "bids": {"details": [{"who": "A", "no": "b1"}, {"who": "B", "no": "b2"}]}}
    assert got["r2"] == {"id": "r2", "tender": {"title": None, "value": {"amount": None}}, "name": None, "bids": {"details": []}} and len(got) == 2


def test_a_written_page_reads_back(spark, tmp_path):
    rows = spark.range(25).select("id", F.concat(F.lit("<&> "), "id").alias("text"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") != 11, F.lit(date(2024, 1, 1))).alias("day"))
    assert W.write_workbook(rows, str(tmp_path / "p.xlsx"), "id", page=1, size=10) == 10
    back = W.read_workbook(spark, str(tmp_path / "p.xlsx")).orderBy("row").collect()
    assert [(r.id_original, r.text, r.even, r.day) for r in back] == [(str(i), f"<&> {i}", str(i % 2 == 0).lower(), None if i == 11 else "2024-01-01") for i in range(10, 20)]
