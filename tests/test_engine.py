import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import semantic, text
from quillstone.operators import bm25, cleaning, evaluation, retrieval, tables
from quillstone.plans import requests
from quillstone.plans.engine import NO_EVIDENCE, Engine
from quillstone.plans.requests import Request

CHUNKS = [
    ("c1", "text", "Net sales of Apple rose in fiscal 2024 while costs fell", None, "apple", 2024, [["Metric", "2024"], ["Net sales", "10"]], "g1"),
    ("c2", "table", "", "table_id=t；location=p；headers=Metric | 2024\nrow_number=2；Metric=Net sales；2024=10", "apple", 2024, [["Metric", "2024"], ["Net sales", "10"]], "g1"),
    ("c3", "text", "Employees and attrition of the workforce", None, "tcs", 2023, None, None),
    ("c4", "text", "Total assets on the consolidated balance sheet were $ million 5", None, "tcs", 2023, None, None),
    ("c5", "text", "the of and", None, "tcs", 2023, None, None),
]
SCHEMA = "id string, chunk_type string, chunk_text string, search_text string, company_id string, fiscal_year int, raw_matrix array<array<string>>, table_group_id string"
VECTORS = {"c1": [1.0, 0.0, 0.0], "c2": [0.9, 0.1, 0.0], "c3": [0.0, 1.0, 0.0], "c4": [0.0, 0.0, 1.0], "c5": [0.1, 0.1, 0.1]}


@pytest.fixture(scope="module")
def index(spark):
    d = spark.createDataFrame(CHUNKS, SCHEMA).withColumns({c: F.lit("x") for c in ("source_file", "source_format", "document_id")}).withColumn("source_file", F.lit("f.pdf"))
    return bm25.build(d)


def engine(spark, index, **k):
    v = spark.createDataFrame([(a, b, *next((c[4], c[5]) for c in CHUNKS if c[0] == a)) for a, b in VECTORS.items()], "id string, vector array<double>, company_id string, fiscal_year int")
    aliases = spark.createDataFrame([("apple", "apple"), ("tata", "tcs")], "alias string, company_id string")
    encode = lambda qs: [[1.0, 0.05, 0.0] if "sales" in q else [0.0, 1.0, 0.1] if "employ" in q.lower() else [-1.0, -1.0, -1.0] for q in qs]
    return Engine(spark, index, v, encode, aliases=aliases, years=(2023, 2024), **k)


def test_scores_follow_the_formula(spark, index):
    q = spark.createDataFrame([(0, "net sales of apple")], "query_id int, query string")
    got = {r.id: r.score for r in bm25.scores(index, q).collect()}
    docs = {c[0]: [w for w in __import__("re").findall("[a-z0-9]+|[^\\W_]", ((c[3] if c[1] == "table" else c[2]) or "").lower()) if w not in text.STOPWORDS] for c in CHUNKS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    for d, terms in docs.items():
        want = 0.0
        for t in ("net", "sales", "apple"):
            df, tf = sum(t in x for x in docs.values()), terms.count(t)
            want += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / avg))
        assert got.get(d, 0) == pytest.approx(want)


def test_boosts_and_filters(spark, index):
    q = spark.createDataFrame([(0, "net sales apple")], "query_id int, query string")
    base = {r.id: r.score for r in bm25.scores(index, q).collect()}
    more = {r.id: r.score for r in bm25.boosted(index, bm25.scores(index, q), "net sales apple").collect()}
    assert more["c1"] == pytest.approx(base["c1"] + 80 * 3 + 24 * 2 + 16 * 2)
    assert more["c2"] == pytest.approx(base["c2"] * (2 + 0.75 * 2 / 3) + 80 * 2 + 24 * 2 + 16 * 2)
    assert [r.id for r in bm25.search(index, q, 5, {"company_id": "tcs"}).collect()] == []
    assert [r.id for r in bm25.search(index, q, 5, {"fiscal_year": "2024"}).collect()] == [] and bm25.search(index, q, 5, {"fiscal_year": 2024}).count() == 2
    assert bm25.search(index, q, 0).count() == 0


def test_index_round_trip(spark, index, tmp_path):
    q = spark.createDataFrame([(0, "net sales")], "query_id int, query string")
    again = index.write(f"file://{tmp_path}/i")
    assert [tuple(r) for r in bm25.search(again, q).orderBy("rank").collect()] == [tuple(r) for r in bm25.search(index, q).orderBy("rank").collect()]


def test_modes(spark, index):
    e = engine(spark, index)
    for mode in ("bm25", "dense", "hybrid"):
        got = e.query(Request("net sales in fiscal 2024 of Apple", 2), mode, generate=False)
        assert got["status"] == "retrieval_only" and got["hits"][0]["id"] in ("c1", "c2") and got["meta"]["filters"] == {"company_id": "apple", "fiscal_year": 2024}
        assert got["citations"][0]["evidence_id"] == "S1" and got["context"].startswith("[S1]")
    with pytest.raises(ValueError, match="mode"):
        e.query(Request("x"), "magic")
    assert e.query(Request("unrelated words", 2), "dense", generate=False)["status"] == "no_evidence"


def test_answers(spark, index):
    ask = Request("net sales of apple", 2)
    said = iter(["Sales are 10 [S1].", "Sales are 10 [S1], final."])
    got = engine(spark, index, generate=lambda m: next(said)).query(ask)
    assert got["status"] == "generated" and got["answer"].endswith("final.") and got["citation_ids"] == ["S1"]
    said = iter(["Sales [S1].", "Sales [S9]."])
    assert engine(spark, index, generate=lambda m: next(said)).query(ask)["status"] == "generated_from_draft_review_invalid"
    said = iter(["Sales.", "Sales [S9]."])
    got = engine(spark, index, generate=lambda m: next(said)).query(ask)
    assert got["status"] == "citation_validation_failed" and got["answer"] == NO_EVIDENCE and not got["answerable"]

    def breaks(m):
        if len(m) > 2:
            raise RuntimeError("down")
        return "Sales [S1]."

    assert engine(spark, index, generate=breaks).query(ask)["status"] == "generated_from_draft_review_failed"
    with pytest.raises(RuntimeError):
        engine(spark, index, generate=lambda m: (_ for _ in ()).throw(RuntimeError("down"))).query(ask)


def test_planned(spark, index):
    plan = {"retrieval_tasks": [{"requirement": {"topic": "net sales", "metrics": ["net sales"]}, "queries": ["net sales", "sales of apple"]}, {"requirement": {"topic": "员工"}, "queries": ["employees"]}]}
    got = engine(spark, index, plan=lambda m: plan).retrieve(Request("sales and employees", 4))
    assert got["meta"]["status"] == "used" and {"c1", "c2", "c3"} & {h["id"] for h in got["hits"]} and all(h["task_ids"] for h in got["hits"])
    assert got["meta"]["tasks"][1]["queries"][0].startswith("sales and employees employees total employees")
    assert got["hits"][0]["id"] == "c2"  # the row label holds the metric
    bad = engine(spark, index, plan=lambda m: {"retrieval_tasks": [], "sql": 1}).retrieve(Request("净销售额 和 员工", 4))
    assert bad["meta"]["status"] == "fallback" and bad["hits"]


def test_requests():
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 21}, {"query": "x", "other": 1}, {"query": "x" * 4001}, {"query": "x", "fiscal_year": "2024"}):
        with pytest.raises(ValueError):
            Request.of(bad)
    r = Request("q", 5, {"company_id": "a", "fiscal_year": None})
    assert r.resolved({"company_id": "b", "fiscal_year": 2024}).explicit == {"company_id": "a", "fiscal_year": 2024}
    assert requests.candidates(r) == 15 and requests.candidates(Request("q", 3, {"document_id": "d"})) == 10
    assert requests.expand("利润?", {"queries": ["a", "b", "c", "d"], "requirement": {}})[1:] == ["a", "b", "c"]
    assert "operating margin" in requests.expand_fallback("整体表现如何") and requests.wants_families("收入和风险")


def test_interleave_merges_what_it_saw():
    h = lambda i, t, **k: {"id": i, "text": t} | k
    got = retrieval.interleave([("T1", [h("a", "x"), h("b", "y", table_group_id="g", matrix=[["1"]])]), ("T2", [h("a2", "x"), h("c", "z", table_group_id="g", matrix=[["1"]]), h("d", "w")])], 12)
    assert [(r["id"], r["task_ids"], r["rank"]) for r in got] == [("a", ["T1", "T2"], 1), ("b", ["T1", "T2"], 2), ("d", ["T2"], 3)]
    assert len(retrieval.interleave([("T1", [h(str(i), str(i)) for i in range(9)])], 3)) == 3


def test_context_budget():
    m = [["Metric", "2024"]] + [[f"row {i}", str(i)] for i in range(40)]
    hits = [{"id": "a", "text": "short", "table_group_id": "g", "matrix": m}, {"id": "b", "text": "x" * 400}, {"id": "c", "text": "tail"}, {"id": "d", "text": "other", "table_group_id": "g", "matrix": m}, {"id": "e", "text": "tail"}]
    got = retrieval.assemble(hits, 500)
    assert [c["id"] for c in got["citations"]] == ["a", "c"] and len(got["context"]) <= 500 and "截断" in got["context"]
    assert [c["evidence_id"] for c in got["citations"]] == ["S1", "S2"] and got["coverage"]["table_groups"] == 2


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(0, "x", 1, 0.9), (0, "y", 2, 0.8)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(0, "y", 1, 5.0), (0, "z", 2, 4.0)], "query_id int, id string, rank int, score double")
    one, two = ({r.id: (r.rank, r.score) for r in retrieval.fuse(*p, 10).collect()} for p in ((a, b), (b, a)))
    assert one == two and one["y"] == (1, pytest.approx(1 / 61 + 1 / 62))


def test_clean_text_follows_the_rules(spark):
    cases = ["a\r\nb\n\nc", "pre-\nfix -\nx --\ny", "end-\nUpper", "ﬁ x  y\t z", " \n\n ", "x-\n\ny", "é-\nà", None]

    def brute(t):
        out, cur = [], []
        for line in [" ".join(x for x in s.replace(" ", " ").replace("ﬁ", "fi").replace("\t", " ").split(" ") if x) for s in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")] + [""]:
            if not line:
                if cur:
                    out.append(" ".join(cur))
                cur = []
            elif cur and cur[-1].endswith("-") and not cur[-1].endswith("--") and line[0].islower():
                cur[-1] = cur[-1][:-1] + line
            else:
                cur.append(line)
        return "\n\n".join(out)

    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r for r in d.select("i", text.clean_text("t").alias("c"), text.clean_actions("t").alias("a")).collect()}
    for i, t in enumerate(cases):
        assert got[i].c == brute(t), t
    assert got[0].a == ["normalize_line_endings"] and got[1].a.count("join_hyphenated_line") == 2 and set(got[3].a) == {"normalize_ligatures", "normalize_whitespace"}


def test_pages(spark):
    rows = [(1, "Cover"), (2, "ACME Report\n2\nBody one state-of-\nthe-art fine-\ntuning of knowl-\nedge\nfooter line"), (3, "ACME Report\nBody two\nNet sales 10 20\nCost 1 2\nAfter\n3\nfooter line")]
    d = spark.createDataFrame([("d", p, t, [[["Item", "A", "B"], ["Net sales", "10", "20"], ["Cost", "1", "2"]]] if p == 3 else None, ["figure only"] if p == 1 else []) for p, t in rows], "doc string, page int, text string, matrices array<array<array<string>>>, reasons array<string>")
    got = {r.page: r for r in cleaning.clean_pages(d).collect()}
    assert got[2].cleaned_text == "Body one state-ofthe-art fine-tuning of knowledge"  # only pairs are kept
    assert got[3].cleaned_text == "Body two After" and "page_number: 3" in got[3].removed
    kinds = sorted((r.page, r.record_type) for r in cleaning.page_records(cleaning.clean_pages(d)).collect())
    assert kinds == [(1, "image_pending"), (1, "text"), (2, "text"), (3, "table"), (3, "text")]


def test_figures_and_joins(spark):
    d = spark.createDataFrame([("box box Figure 2: shows", ["A diagram"]), ("Figure 2: x", ["figure"]), ("box Figure 2: y", []), ("Farewellto nonparametric", [])], "t string, r array<string>")
    got = [r[0] for r in d.select(cleaning.repair_joins(cleaning.drop_figure_labels(F.col("t"), F.col("r")))).collect()]
    assert got == ["Figure 2: shows", "Figure 2: x", "box Figure 2: y", "Farewell to non-parametric"]


def test_blocks_sheets_html(spark):
    b = spark.createDataFrame([("f", 0, "paragraph", "Heading 1", "T", None), ("f", 1, "table", None, None, [["a"]])], "source_file string, sequence int, record_type string, style string, text string, rows array<array<string>>")
    got = cleaning.clean_blocks(b).orderBy("sequence").collect()
    assert got[0].content_role == "section_title" and got[1].header_row_count == 0 and got[1].raw_matrix == [["a"]]
    s = spark.createDataFrame([("f", "S", 0, ["h"], [["1"], [None]])], "source string, sheet string, sheet_index int, headers array<string>, rows array<array<string>>")
    assert cleaning.clean_sheets(s).first().asDict() == {"source": "f", "sheet": "S", "table_id": "excel_t01", "raw_matrix": [["h"], ["1"], [None]], "header_row_count": 1}
    h = spark.createDataFrame([("d", 1, "table", None, [["a  b"]], "t1"), ("d", 2, "table", None, [["x"]], "t1")], "doc string, html_order int, record_type string, raw_text string, matrix array<array<string>>, table_id string")
    with pytest.raises(Exception, match="not unique"):
        cleaning.clean_html(h).collect()
    assert cleaning.clean_html(h.where("html_order = 1")).first().raw_matrix == [["a b"]]


def test_labels(spark):
    d = spark.createDataFrame([([["", "A", "A"], ["", "x", ""], ["1", "2", "3"]],), ([],)], "m array<array<string>>")
    got = d.select(tables.column_labels(F.col("m"), 2).alias("a"), tables.page_labels(F.col("m"), 2).alias("b"), tables.page_labels(F.col("m"), 1, True).alias("c")).collect()
    assert got[0].a == ["column_1", "A / x", "A"] and got[0].b == ["row_label", "A / x", "A"] and got[0].c[:2] == ["row_label group", "row_label"] and got[1].a == []
    r = d.select(tables.rectangular(F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")))).alias("r")).first().r
    assert r == [["a", None], ["b", "c"]]


def test_overlay_and_layers(spark):
    a = spark.createDataFrame([("1", "q"), ("2", "q")], "case_id string, query string")
    b = spark.createDataFrame([("1", ["10"]), ("2", ["Net Sales"])], "case_id string, facts array<string>")
    both = evaluation.overlay(a, b, "case_id")
    with pytest.raises(ValueError):
        evaluation.overlay(a, b.where("case_id = '1'"), "case_id")
    cases = both.withColumns({"evidence": F.lit("net  sales were 10.0"), "answer": F.lit("10"), "families": F.array(F.lit("ratio")), "needed": F.array().cast("array<string>"), "error": F.lit(None).cast("string")})
    got = {r.case_id: r for r in evaluation.layers(cases).collect()}
    assert got["1"].grounded_answer and got["2"].retrieval_coverage and not got["2"].answer_completeness
    rates = {r.layer: r.rate for r in evaluation.acceptance(evaluation.layers(cases), ["retrieval_coverage", "answer_completeness"]).collect()}
    assert rates == {"retrieval_coverage": 1.0, "answer_completeness": 0.5}


def test_families_tie_to_the_first(spark):
    d = spark.createDataFrame([("operating margin and employees",)], "t string")
    assert d.select(semantic.statement_family("t")).first()[0] in ("ratio",)


def test_table_copies_of_any_length(spark):
    table = [["Item", "A"], ["Net sales", "10"], ["Tax", "3"], ["Cost", "(2)"]]
    long = "Net sales 10 " + "Line 12 " * 3000 + "Cost (2)"
    rows = [
        (0, f"Before {long} after Cost (2)", [table]), (1, "Before NET SALES 10 tax 3 cost (2) after", [table]), (2, "Before item a b c after", [[["Item", "A"], ["B", "C"]]]),
        (3, "Net sales 100 Cost (2)", [table]), (4, "Net sales 10 " * 3000, [table]), (5, "Só $1 a \\ b", [[["$1"], ["a", "\\"]]]), (6, None, None),
    ]
    d = spark.createDataFrame(rows, "i int, t string, m array<array<array<string>>>")
    got = {r.i: r.kept for r in d.select("i", cleaning.drop_table_copies(F.col("t"), F.col("m")).alias("kept")).collect()}
    assert got == {0: "Before after Cost (2)", 1: "Before after", 2: "Before after", 3: rows[3][1], 4: rows[4][1].strip(), 5: "Só b", 6: None}
