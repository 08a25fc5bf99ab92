from pyspark.sql import functions as F

from quillstone.operators import bm25
from quillstone.plans.ingest import back_fill, ingest
from tests.test_sources import DOCX, XLSX


def test_files_to_answers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(DOCX)
    (src / "b.xlsx").write_bytes(XLSX)
    (src / "c.html").write_text("<h1>Cash flow</h1><p>Cash used in financing in fiscal 2024 was high. Cash from operating grew.</p><table><tr><th>Item<th>2024<tr><td>Cash<td>7</table>")
    (src / "bad.xlsx").write_bytes(b"x")
    got = ingest(spark, f"file://{src}", f"file://{tmp_path}/out")
    chunks = got["chunks"].collect()
    kinds = {(c.document.rsplit("/", 1)[-1], c.chunk_type) for c in chunks}
    assert kinds == {("a.docx", "text"), ("a.docx", "table"), ("b.xlsx", "table"), ("c.html", "text"), ("c.html", "table")}
    page = next(c for c in chunks if c.document.endswith("c.html") and c.chunk_type == "text")
    assert page.statement_family == "cash_flow" and page.statement_scope == "consolidated" and page.period_end == "FY2024" and page.section_path == "Cash flow"
    assert {r.grade for r in got["report"].collect()} <= {"A", "B"} and got["points"].count() == len(chunks)
    q = spark.createDataFrame([(0, "cash used in financing")], "query_id int, query string")
    assert bm25.search(got["index"], q, 1).first().id == page.chunk_id
    assert got["parsed"].where("error is not null").count() == 1


def test_back_fill(spark):
    c = spark.createDataFrame([("r1", "old"), ("r2", "old")], "rid string, x string")
    s = spark.createDataFrame([("r1", "new")], "rid string, x string")
    done, missing = back_fill(c, s, "rid", ["x"])
    assert {tuple(r) for r in done.select("rid", "x").collect()} == {("r1", "new"), ("r2", "old")} and [r.rid for r in missing.collect()] == ["r2"]
    assert done.where(F.col("x") == "new").count() == 1
