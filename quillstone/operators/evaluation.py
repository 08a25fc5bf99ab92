"""Evaluation of retrieval and answers: cases are a DataFrame and every case is searched in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_present, squeezed, term_supported

ALIGNED = ("page_start", "table_id", "document_id", "company_id", "fiscal_year", "source_format", "paragraph_index", "sheet_name", "cell_range")


def first_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first_rank) of every query in expected (query_id, id); null where none of its ids was found."""
    found = hits.join(expected, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left")


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: cases, recall at each k, mean reciprocal rank."""
    recall = [F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("cases"), *recall, F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def aligned(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, aligned): some hit has an expected id, ends in the expected source and equals every expected_ field given."""
    have = set(cases.columns)
    both = hits.join(cases, "query_id")
    ok = F.array_contains("expected_ids", F.col("id"))
    if "expected_source_suffix" in have:
        path = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))
        ok = ok & F.endswith(path(F.col("source_file")), path(F.col("expected_source_suffix")))
    for f in ALIGNED:
        if f"expected_{f}" in have:
            ok = ok & (F.col(f"expected_{f}").isNull() | F.col(f).eqNullSafe(F.col(f"expected_{f}")))
    got = both.groupBy("query_id").agg(F.max(ok).alias("aligned"))
    return cases.select("query_id").join(got, "query_id", "left").na.fill(False, ["aligned"])


def fact_present(fact: Column | str, text: Column | str) -> Column:
    """The fact's number, or its text but for white space and case."""
    return number_present(fact, text) | squeezed(text).contains(squeezed(fact))


def concepts(cases: DataFrame) -> DataFrame:
    """(case_id, concept, supported) of cases (case_id, concept, terms, evidence): all of its terms in the evidence."""
    each = cases.select("case_id", "concept", "evidence", F.explode("terms").alias("term"))
    return each.groupBy("case_id", "concept").agg(F.min(term_supported("term", "evidence")).alias("supported"))


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base with extra's columns, each case once on either side or an error."""
    joined = base.join(extra, key, "full_outer")
    n = F.count("*").alias("__n")
    bad = joined.groupBy(key).agg(n).where("__n > 1").count() + base.join(extra, key, "left_anti").count() + extra.join(base, key, "left_anti").count()
    if bad:
        raise ValueError(f"{bad} cases are not covered exactly once")
    return joined


def acceptance(cases: DataFrame, layers: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, layer, passed, cases, rate) of boolean layers, unpivoted."""
    long = cases.unpivot(by or [], layers, "layer", "ok")
    return long.groupBy(*(by or []), "layer").agg(
        F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("passed"), F.count("*").alias("cases"), F.round(F.avg(F.coalesce(F.col("ok"), F.lit(False)).cast("double")), 6).alias("rate")
    )


def layers(cases: DataFrame) -> DataFrame:
    """Layers of cases (facts array, evidence, answer, families array, needed array, error): evidence coverage, grounded answer, completeness, status."""
    in_evidence = F.forall("facts", lambda f: fact_present(f, F.col("evidence")))
    in_answer = F.forall("facts", lambda f: fact_present(f, F.col("answer")))
    families = F.size(F.array_except("needed", "families")) == 0
    return cases.withColumns({
        "retrieval_coverage": in_evidence & families, "grounded_answer": in_answer & in_evidence, "answer_completeness": in_answer, "evaluator_contract_status": F.col("error").isNull(),
    })


def collection_checks(points: DataFrame, companies: list[str]) -> DataFrame:
    """One row: points, distinct ids, missing ids, whether the companies are exactly those named."""
    return points.agg(
        F.count("*").alias("points"), F.count_distinct("chunk_id").alias("distinct_ids"), F.sum((F.coalesce("chunk_id", F.lit("")) == "").cast("int")).alias("missing_ids"),
        (F.sort_array(F.collect_set("company_id")) == F.array(*map(F.lit, sorted(companies)))).alias("companies_ok"),
    )


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Calls, prompt tokens and the share of them served from a cache, of calls (by, prompt_tokens, cached_tokens)."""
    share = F.round(F.sum("cached_tokens").cast("double") / F.nullif(F.sum("prompt_tokens"), F.lit(0)), 6)
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), share.alias("cache_hit_ratio"))


FORBIDDEN_IN_CASES = ("company_id", "fiscal_year", "document_id", "source_format", "report_type")


def check_alias_cases(cases: DataFrame) -> DataFrame:
    """cases (case_id, query, expected_company_id, ...), or an error: explicit filters, repeated ids, empty questions or companies aren't allowed."""
    if given := sorted(set(FORBIDDEN_IN_CASES) & set(cases.columns)):
        raise ValueError(f"cases carry filters: {', '.join(given)}")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    n, ids, empty = cases.agg(F.count("*"), F.count_distinct("case_id"), F.sum((blank("query") | blank("expected_company_id")).cast("int"))).first()
    if not n or ids != n or empty:
        raise ValueError(f"{n} cases, {ids} ids, {empty or 0} without question or company")
    return cases


def _seen(evidence: DataFrame) -> DataFrame:
    """(case_id, companies, families, pages, evidence, n, n_paged) of evidence (case_id, company_id, statement_family, text, page)."""
    page = F.col("page") if "page" in evidence.columns else F.lit(None).cast("int")
    return evidence.groupBy("case_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("company_id") != "", F.col("company_id")))).alias("companies"), F.collect_set(F.coalesce("statement_family", F.lit(""))).alias("families"),
        F.array_sort(F.collect_set(page)).alias("pages"), F.concat_ws("\n", F.collect_list("text")).alias("evidence"), F.count("*").alias("n"), F.count(page).alias("n_paged"),
    )


def _alone(company: str) -> Column:
    return F.coalesce(F.col("companies") == F.array(company), F.lit(False))


def _covered(needed: str) -> Column:
    return F.size(F.array_except(needed, F.coalesce("families", F.array().cast("array<string>")))) == 0


def _held(values: str, text: str) -> Column:
    return F.forall(values, lambda v: F.coalesce(number_present(v, F.col(text)), F.lit(False)))


def _cited() -> Column:
    return F.coalesce("citation_valid", F.lit(False)) & (F.coalesce(F.size("citation_ids"), F.lit(0)) > 0)


def alias_layers(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The five layers of cases that name a company by an alias only.

    cases: case_id, expected_company_id, resolved_company_id, expected_values, required_families, answer, answerable,
    citation_valid, citation_ids. evidence: case_id, company_id, statement_family, text; its companies must be the
    expected one alone, and a case without evidence fails.
    """
    got = cases.join(_seen(evidence), "case_id", "left")
    resolved = F.coalesce(F.col("resolved_company_id") == F.col("expected_company_id"), F.lit(False))
    alone, said = _alone("expected_company_id"), F.coalesce("answerable", F.lit(False)) & _held("expected_values", "answer")
    return got.select(
        "case_id", resolved.alias("company_filter_resolution"), alone.alias("company_isolation"),
        (resolved & alone & F.col("n").isNotNull() & _held("expected_values", "evidence") & _covered("required_families")).alias("retrieval_coverage"),
        (said & _cited()).alias("grounded_answer"), said.alias("answer_completeness"),
    )


CONTRACT = ("expected_values", "acceptable_values", "expected_concepts", "required_families")


def case_layers(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The four layers of cases under a contract, all false where a case failed with an error.

    cases: case_id, company_id, expected_values, acceptable_values (one of each group must do), expected_concepts (a name and
    terms that must all be supported), required_families, answer, answerable, citation_valid, citation_ids, task_evidence
    (pieces of evidence of each planned task, null without a plan), error. A case that lacks a list of CONTRACT breaks it.
    """
    got = cases.join(_seen(evidence), "case_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    some = lambda text: F.coalesce(F.forall("acceptable_values", lambda g: F.exists(g, lambda v: number_present(v, F.col(text)))), F.lit(True))
    values = lambda text: F.coalesce(_held("expected_values", text), F.lit(True))
    concepts_held = F.coalesce(F.forall("expected_concepts", lambda c: F.forall(c["terms"], lambda t: term_supported(t, F.col("evidence")))), F.lit(True))
    tasks = F.coalesce(F.forall("task_evidence", lambda n: n > 0), F.lit(True))
    families = F.coalesce(_covered("required_families"), F.lit(True))
    said = F.coalesce("answerable", F.lit(False)) & values("answer") & some("answer")
    contract = F.lit(True)
    for c in CONTRACT:
        contract = contract & F.col(c).isNotNull()
    fine = F.col("error").isNull()
    return got.select(
        "case_id", (fine & _alone("company_id") & values("evidence") & some("evidence") & concepts_held & families & tasks).alias("retrieval_coverage"),
        (fine & said & _cited()).alias("grounded_answer"), (fine & said & tasks).alias("answer_completeness"), (fine & contract).alias("evaluator_contract_status"),
    )


def page_checks(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, page_overlap, reference_page_supported, company_isolated, passed) of cases with reference pages.

    cases: case_id, company_id, facts, reference_pages, answer, answerable, citation_valid, citation_ids. Pages are hints: a
    case whose evidence holds every fact, each piece with its page, is supported without an overlap too.
    """
    got = cases.join(_seen(evidence), "case_id", "left")
    overlap = F.coalesce(F.array_sort(F.array_intersect("reference_pages", "pages")), F.array().cast("array<int>"))
    present = lambda text: F.forall("facts", lambda f: F.coalesce(fact_present(f, F.col(text)), F.lit(False)))
    paged = F.coalesce((F.col("n") > 0) & (F.col("n") == F.col("n_paged")), F.lit(False))
    supported = (F.size(overlap) > 0) | (present("evidence") & paged)
    alone = _alone("company_id")
    passed = F.coalesce("answerable", F.lit(False)) & alone & _cited() & present("evidence") & present("answer") & supported
    return got.select("case_id", overlap.alias("page_overlap"), supported.alias("reference_page_supported"), alone.alias("company_isolated"), passed.alias("passed"))


def report_kind(cases: DataFrame) -> str:
    """failed where every one of some cases (error) has an error, else complete."""
    n, bad = cases.agg(F.count("*"), F.count("error")).first()
    return "failed" if n and n == bad else "complete"
