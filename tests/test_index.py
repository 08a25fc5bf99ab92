import json

import pytest

from quillstone.functions import semantic
from quillstone.operators import bm25, cleaning, evaluation
from quillstone.plans.engine import Engine
from quillstone.plans.requests import Request
from quillstone.sources import files, sinks

CHUNK = "chunk_id string, source_record_ids array<string>, chunk_text string, table_title string, raw_matrix array<array<string>>"


def test_nested_values_are_flattened(spark):
    d = spark.createDataFrame([(["a", None], {"k": ["x", "y"]}, [["1", None], ["2"]], ("p", 3), None)], "a array<string>, m map<string,array<string>>, t array<array<string>>, s struct<x:string,y:int>, n string")
    got = d.select(*(semantic.flat(d[c], d.schema[c].dataType).alias(c) for c in d.columns)).first()
    assert tuple(got) == ("a ", "k x y", "1  2", "x p y 3", "")


def test_metadata_is_read_from_title_and_matrix(spark):
    d = spark.createDataFrame([("a", ["r"], "numbers", "Consolidated balance sheet", [["Total assets", "1"]]), ("b", ["r"], "numbers", None, None)], CHUNK)
    got = {r.chunk_id: r for r in semantic.enrich(d).collect()}
    assert (got["a"].statement_family, got["a"].statement_scope) == ("balance_sheet", "consolidated") and got["b"].statement_family == "other"


def test_chunk_files_join_their_sources(spark, tmp_path):
    rows = [{"chunk_id": "a", "source_record_ids": ["none", "r2", "r1"], "chunk_text": "x"}, {"chunk_id": "b", "source_record_ids": ["r3"], "chunk_text": "cash flow"}]
    (tmp_path / "one.chunks.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cleaned = spark.createDataFrame([("r1", "one.pdf"), ("r2", "two.pdf"), ("r3", "")], "record_id string, source_file string")
    got = {r.chunk_id: r for r in files.read_chunks(spark, f"file://{tmp_path}", CHUNK, cleaned).collect()}
    assert got["a"]._source_file == "two.pdf" and got["b"]._source_file == "" and got["a"]._chunk_file == "one.chunks.jsonl" and got["b"].statement_family == "cash_flow"
    (tmp_path / "two.chunks.jsonl").write_text(json.dumps(rows[0]))
    with pytest.raises(ValueError, match="unique"):
        files.read_chunks(spark, f"file://{tmp_path}", CHUNK)


def test_engine_knows_what_its_index_holds(spark):
    d = spark.createDataFrame([("1", "net sales rose", "ACME", "Acme Works", 2024, "pdf", "annual_report"), ("2", "employees", "TCS", "Tata", 2023, "xlsx", "annual_report"), ("3", "x", None, None, None, "", None)],
                              "id string, chunk_text string, company_id string, company_name string, fiscal_year int, source_format string, report_type string")
    d = d.selectExpr("*", "'text' as chunk_type", "'' as search_text")
    e = Engine.of_index(spark, bm25.build(d), {"tcs": ["Consultancy"]})
    assert e.years == (2023, 2024) and e.formats == ("pdf", "xlsx") and e.report_types == ("annual_report",)
    assert e.resolve(Request("sales of acme works in fiscal 2024")).explicit == {"company_id": "ACME", "fiscal_year": 2024}
    assert e.resolve(Request("consultancy xlsx")).explicit == {"company_id": "TCS", "source_format": "xlsx"}


def test_matrices_of_a_group_must_agree(spark):
    d = spark.createDataFrame([("g", [["1"]]), ("g", [["2"]])], "table_group_id string, raw_matrix array<array<string>>")
    with pytest.raises(Exception, match="different matrices"):
        sinks.with_matrices(d, sinks.matrices(d)).collect()


def test_alias_cases_name_no_filters(spark):
    ok = spark.createDataFrame([("1", "q", "c")], "case_id string, query string, expected_company_id string")
    assert evaluation.check_alias_cases(ok) is ok
    for bad in (ok.withColumnRenamed("query", "fiscal_year"), ok.union(ok), spark.createDataFrame([("1", " ", "c")], ok.schema), ok.limit(0)):
        with pytest.raises(ValueError):
            evaluation.check_alias_cases(bad)


def test_records_on_one_side_fail(spark):
    kind = "doc string, seq int, text string, rows array<array<string>>"
    s = spark.createDataFrame([("a", 0, "see [1] and 5%", None), ("a", 1, None, [["x", "7"], ["", None]]), ("b", 0, "5 kg", None), ("c", 0, "t", None)], kind)
    c = spark.createDataFrame([("a", 0, "see [1] and 5%", None, None), ("a", 1, None, [["x", "7"], ["", None]], "row: X=7"), ("b", 0, "6 kg", None, None)], "doc string, seq int, cleaned_text string, raw_matrix array<array<string>>, table_text string")
    got = {r.doc: r for r in cleaning.validate_records(s, c).collect()}
    assert got["a"].passed and (got["a"].texts, got["a"].tables) == (1, 1) and not got["b"].protected_preserved and got["b"].projection_complete and not got["c"].passed


def test_many_aliases_meet_by_their_first_letters(spark):
    names = [("a", "A"), ("ab", "AB"), ("abc", "ABC"), ("pple", "P"), ("apple inc", "AI"), ("微软", "MS"), ("zz", "Z")]
    a = spark.createDataFrame(names, "alias string, company_id string")
    q = spark.createDataFrame([("The APPLE Inc of fy 2023",), ("pineapple",), ("微软",), ("xyz",), ("",), ("cab",)], "query string")
    few, many = ({r.query: r.company_id for r in semantic.infer_filters(q, a, most=n).collect()} for n in (100, 2))
    assert few == many == {"The APPLE Inc of fy 2023": "AI", "pineapple": "P", "微软": "MS", "xyz": None, "": None, "cab": "AB"}
