import io
import json
import zipfile

import pytest

from quillstone.sources import files, html, pdf, sinks
from quillstone.streaming import incremental

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


DOCX = zipped({
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Some</w:t><w:tab/><w:t>text</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
})
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></R>'.replace("<R>", '<R xmlns="x">'),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>when</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="B3"><f>A3*2</f><v>14</v></c><c r="C3" s="1"><v>45292</v></c></row><row r="4"><c r="A4"/></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": f"<worksheet {S}><sheetData/></worksheet>",
})


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.xlsx").write_bytes(XLSX)
    (tmp_path / "c.csv").write_text("﻿x,y\n1,\"a,b\"\n2\n", encoding="utf-8")
    (tmp_path / "d.tsv").write_bytes("名\t值\n".encode("gb18030"))
    (tmp_path / "e.html").write_text("<h1>Head</h1><p>Body text</p>")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = {}
    for r in files.read_documents(spark, str(tmp_path)).orderBy("seq").collect():
        got.setdefault(r.source_file.rsplit("/", 1)[-1], []).append((json.loads(r.record) if r.record else None, r.error))
    docx = [x for x, _ in got["a.docx"]]
    assert [(x["record_type"], x["sequence"]) for x in docx] == [("paragraph", 0), ("paragraph", 1), ("table", 2)]
    assert docx[0]["style"] == "heading 1" and docx[1]["text"] == "Some\ttext" and docx[2]["rows"] == [["a", "b"]]
    (sheet, _), = got["b.xlsx"]
    assert sheet["location"] == {"sheet": "One", "range": "A1:C3"} and sheet["raw_content"] == {"headers": ["name", None, "when"], "rows": [[None] * 3, [7, "=A3*2", "2024-01-01T00:00:00"]]}
    assert got["c.csv"][0][0]["raw_content"] == {"headers": ["x", "y"], "rows": [["1", "a,b"], ["2", None]]} and got["d.tsv"][0][0]["raw_content"]["headers"] == ["名", "值"]
    assert got["d.tsv"][0][0]["warnings"] and [x["raw_text"] for x, _ in got["e.html"]] == ["Head", "Body text"]
    assert got["bad.xlsx"][0][0] is None and "BadZipFile" in got["bad.xlsx"][0][1]
    with pytest.raises(ValueError, match="supported"):
        files.check_suffix("x/y.pptx")


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_type":"document_meta"}\n\n{"record_type":"text","x":"é"}\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.chunks.jsonl").write_text('{"chunk_id":"a"}\n{"chunk_id":"a"}\n')
    with pytest.raises(ValueError, match="not unique"):
        files.read_chunks(spark, str(tmp_path / "c"), "chunk_id string")


def test_html_blocks():
    got = html.parse_page("<div>Leaf</div><div><p>In <b>p</b><span>no</span></p></div><p>In pno</p><ul><li>a1<li>b2</ul><script>x</script><table><tr><td><p>cell</p><td>2<tr><td>3<td>4</table><h2>H</h2><h3>Head</h3>", "d")
    assert [(r["record_type"], r.get("raw_text")) for r in got] == [("text", "Leaf"), ("text", "In pno"), ("text", "a1"), ("text", "b2"), ("table", None), ("text", "Head")]
    assert got[4]["raw_matrix"] == [["cell", "2"], ["3", "4"]]


def test_headings_are_all_kept(spark):
    page = "<div>Same</div><h1>Same</h1><p>x</p><h2>R &amp; D &lt; &ampx; &amp</h2><h2>Same</h2>"
    df = spark.createDataFrame([("u", page)], "url string, html string")
    told = lambda **k: [r.text for r in html.parse_pages(df, **k).where("content_role = 'heading'").orderBy("html_order").collect()]
    assert told(once=False, whole_references=True) == ["Same", "R & D < &ampx; &amp", "Same"]
    assert told() == ["R & D < &x; &"]  # a page's records tell a text once


def test_pdf_geometry():
    words = [{"text": t, "x0": x, "x1": x + 20, "top": y, "bottom": y + 8} for t, x, y in (("Consolidated", 0, 10), ("statement", 40, 11), ("Item", 0, 50), ("2023", 110, 50), ("2024", 160, 50), ("Sales", 0, 70), ("10", 110, 70), ("20", 160, 71), ("Cost", 0, 90), ("1", 110, 90), ("2", 160, 90), ("Net", 0, 110), ("9", 110, 110), ("18", 160, 110))]
    rules = [{"x0": a, "x1": b, "top": y} for a, b in ((105, 135), (155, 190), (105, 190)) for y in (60, 80)]
    t = pdf.heuristic_table(words, rules, (0, 45, 200, 120), "page")
    assert t["matrix"] == [["Item", "2023", "2024"], ["Sales", "10", "20"], ["Cost", "1", "2"], ["Net", "9", "18"]] and t["header_row_count"] == 1
    assert t["table_title"] == "Consolidated statement" and t["statement_scope"] == "consolidated"


def test_point_store(spark, tmp_path):
    store = sinks.PointStore(spark, f"file://{tmp_path}/points")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, vector array<double>")
    assert store.missing(rows).count() == 2 and store.upsert(rows, "m")["points"] == 2
    more = spark.createDataFrame([("b", [9.0, 9.0]), ("c", [5.0, 6.0])], "chunk_id string, vector array<double>")
    assert [x.chunk_id for x in store.missing(more).collect()] == ["c"] and store.upsert(more, "m")["points"] == 3
    assert {x.chunk_id: x.vector for x in store.points().collect()}["b"] == [9.0, 9.0] and store.foreign(rows).count() == 1
    with pytest.raises(ValueError, match="vectors of m"):
        store.upsert(rows, "other")
    assert store.upsert(rows, "other", recreate=True)["points"] == 2
    with pytest.raises(ValueError, match="unique"):
        store.upsert(rows.union(rows), "other")


def test_stream(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.chunks.jsonl").write_text('{"chunk_id":"a","chunk_text":"x"}\n{"chunk_id":"b","chunk_text":"y"}\n')
    store = sinks.PointStore(spark, f"file://{tmp_path}/points")
    from pyspark.sql import functions as F

    encode = lambda df: df.withColumn("vector", F.array(F.length("chunk_text").cast("double")))

    def once():
        incremental.upsert_stream(incremental.chunk_stream(spark, str(d), "chunk_id string, chunk_text string"), store, "m", encode, f"{tmp_path}/cp").awaitTermination()

    once()
    (d / "b.chunks.jsonl").write_text('{"chunk_id":"b","chunk_text":"again"}\n{"chunk_id":"c","chunk_text":"z"}\n')
    once()
    assert sorted((x.chunk_id, x.chunk_text) for x in store.points().collect()) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_payload(spark):
    c = spark.createDataFrame([("a", "table", "s", "t", "g", [["1"]]), ("b", "text", "s", "t", "", [])], "chunk_id string, chunk_type string, search_text string, chunk_text string, table_group_id string, raw_matrix array<array<string>>")
    assert sinks.payload(c).columns == list(sinks.PAYLOAD)
    assert [x[0] for x in c.select(sinks.embed_text(c)).collect()] == ["s", "t"] and sinks.matrices(c).count() == 1
    with pytest.raises(Exception, match="different matrices"):
        sinks.matrices(c.union(spark.createDataFrame([("z", "table", "s", "t", "g", [["2"]])], c.schema))).collect()


def test_tables_of_many_pages(spark):
    import json

    def page(shift):
        words = [{"text": t, "x0": x, "x1": x + 20, "top": y + shift, "bottom": y + shift + 8} for t, x, y in (("Item", 0, 50), ("2023", 110, 50), ("2024", 160, 50), ("Sales", 0, 70), ("10", 110, 70), ("20", 160, 71), ("Cost", 0, 90), ("1", 110, 90), ("2", 160, 90), ("Net", 0, 110), ("9", 110, 110), ("18", 160, 110))]
        return words, [{"x0": a + d, "x1": b + d, "top": y + shift} for a, b, d in ((105, 135, 0), (105, 135, 1), (155, 190, 0), (105, 190, 0)) for y in (60, 80)]

    rows = [("f.pdf", n, "text", *map(json.dumps, page(s))) for n, s in ((1, 0), (2, 30))] + [("f.pdf", 3, "no table", "[]", "[]"), ("g.pdf", 1, None, None, None)]
    pages = spark.createDataFrame(rows, "source_file string, page int, text string, words string, rules string")
    boxes = spark.createDataFrame([("f.pdf", 1, 0.0, 45.0, 200.0, 120.0), ("f.pdf", 2, 0.0, 75.0, 200.0, 150.0), ("f.pdf", 3, 0.0, 0.0, 9.0, 9.0), ("g.pdf", 1, 0.0, 0.0, 9.0, 9.0)], "source_file string, page int, x0 double, top double, x1 double, bottom double")
    got = pdf.heuristic_tables(pages, boxes).orderBy("page").collect()
    want = [["Item", "2023", "2024"], ["Sales", "10", "20"], ["Cost", "1", "2"], ["Net", "9", "18"]]
    assert [(r.source_file, r.page, r.table_number, r.matrix, r.header_row_count) for r in got] == [("f.pdf", 1, 1, want, 1), ("f.pdf", 2, 1, want, 1)]
