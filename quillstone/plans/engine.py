"""Answers to questions: one batched search for all queries of a request, then small ordered steps on the driver.

The encoder, the planner and the text generator are injected callables. Nothing here grows with the corpus: every list
that reaches the driver was cut to its top-k in Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantic import SEARCHED, enrich, infer_filters
from ..operators import bm25, retrieval
from .requests import MODES, Request, candidates, check_plan, expand, expand_fallback, priority_phrases, topic_of, wants_families

NO_EVIDENCE = "根据当前召回内容无法确定。"
Generator = Callable[[list[dict[str, str]]], str]


def normal(value: Any) -> str:
    return re.sub(r"[^\w%]+", " ", unicodedata.normalize("NFKC", str(value or "")).casefold()).strip()


@dataclass
class Engine:
    """index: BM25; vectors: (id, vector, ...) or None; encode: texts -> vectors; plan and generate: messages -> answer."""

    spark: SparkSession
    index: bm25.Index
    vectors: DataFrame | None = None
    encode: Callable[[list[str]], list[list[float]]] | None = None
    plan: Callable[[list[dict[str, str]]], dict] | None = None
    generate: Generator | None = None
    aliases: DataFrame | None = None
    years: tuple[int, ...] = ()
    formats: tuple[str, ...] = ()
    report_types: tuple[str, ...] = ()
    threshold: float = 0.5
    budget: int = 12_000

    @classmethod
    def of_index(cls, spark: SparkSession, index: bm25.Index, extra: dict[str, list[str]] | None = None, **k) -> Engine:
        """An engine whose names of companies, years, formats and report types are those of the index's chunks."""
        aliases = bm25.company_aliases(index.chunks, extra)
        known: dict[str, list[str]] = {}
        for kind, value in bm25.known_values(index.chunks).collect():  # a few per column
            known.setdefault(kind, []).append(value)
        years = tuple(sorted(int(y) for y in known.get("fiscal_year", [])))
        return cls(spark, index, aliases=aliases, years=years, formats=tuple(sorted(known.get("source_format", []))), report_types=tuple(sorted(known.get("report_type", []))), **k)

    def resolve(self, request: Request) -> Request:
        """The request with what its text says about company, year, format and report type."""
        if self.aliases is None:
            return request
        q = self.spark.createDataFrame([(request.query,)], "query string")
        row = infer_filters(q, self.aliases, self.years, self.formats, self.report_types).first()
        return request.resolved({k: row[k] for k in ("company_id", "fiscal_year", "source_format", "report_type")})

    def search_all(self, queries: list[str], k: int, filters: dict, mode: str) -> DataFrame:
        """(query_id, id, rank, score, dense_score) of all queries in one plan; query_id is the place in the list."""
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
        q = self.spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
        deep = retrieval.depth(k) if mode == "hybrid" else k
        if mode != "dense":
            lists = []
            for i, text in enumerate(queries):  # boosts follow each query's own phrases; the plan stays one union
                one = q.where(F.col("query_id") == i)
                lists.append(bm25.boosted(self.index, bm25.scores(self.index, one, filters), text, filters))
            sparse = lists[0]
            for x in lists[1:]:
                sparse = sparse.unionByName(x)
            sparse = bm25.top(sparse, deep)
        if mode != "bm25":
            if self.vectors is None or self.encode is None:
                raise ValueError(f"mode {mode!r} needs vectors and an encoder")
            v = self.spark.createDataFrame([(i, [float(x) for x in vec]) for i, vec in enumerate(self.encode(queries))], "query_id int, vector array<double>")
            near = retrieval.dense(self.vectors, v, deep, filters)
        if mode == "bm25":
            return sparse.withColumn("dense_score", F.lit(None).cast("double"))
        if mode == "dense":
            return near.withColumn("dense_score", F.col("score"))
        return retrieval.fuse(near, sparse, k)

    def described(self, hits: DataFrame) -> DataFrame:
        """Hits with their chunk's columns and metadata; what the chunk says of itself stays unless it is empty."""
        chunks = self.index.chunks
        have = set(chunks.columns)
        body = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("chunk_text", "search_text", "text") if c in have), F.lit(""))
        c = chunks.drop("vector").withColumn("text", body)
        got = hits.join(c, "id")
        own = [x for x in ("statement_family", "period_end", "unit") if x in have]
        got = got.withColumnsRenamed({x: f"__{x}" for x in own})
        got = enrich(got, None if have.intersection(SEARCHED) else "text", "fiscal_year" if "fiscal_year" in have else None)
        full = lambda x: F.when(F.col(f"__{x}").cast("string") != "", F.col(f"__{x}"))
        for x in own:
            said = F.when(F.col(x) != "other", F.col(x)) if x == "statement_family" else None
            got = got.withColumn(x, F.coalesce(said, full(x), F.lit("other")) if said is not None else F.coalesce(full(x), F.col(x)))
        if "table_group_id" not in have:
            first = lambda x: F.col(x) if x in have else F.lit(None).cast("string")
            from ..functions.semantic import table_group

            got = got.withColumn("table_group_id", table_group(first("table_id"), first("document_id"), first("page_start"), F.col("id").cast("string")))
        return got.drop(*(f"__{x}" for x in own))

    def _rows(self, hits: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) | {"matrix": r.asDict().get("raw_matrix")} for r in self.described(hits).orderBy("rank", "id").collect()]  # a top-k

    def retrieve(self, request: Request, mode: str = "hybrid", answer: bool = True) -> dict:
        """Hits, evidence and how they were found: direct, planned, or the fallback of a plan that failed."""
        resolved = self.resolve(request)
        filters, meta = resolved.explicit, {"route": "direct", "status": "not_needed"}
        if answer and self.plan is not None:
            meta = {"route": "planner", "status": "used"}
            try:
                plan = check_plan(self.plan([{"role": "user", "content": f"{request.query.strip()}\n{filters}"}]))
                hits, meta["tasks"], found = self._planned(resolved, plan, mode)
            except (ValueError, TypeError, KeyError, RuntimeError) as e:
                meta = {"route": "planner", "status": "fallback", "reason": type(e).__name__}
        if meta["status"] != "used":
            fallback = meta["status"] == "fallback"
            query, k = (expand_fallback(request.query), max(request.top_k, 40)) if fallback else (request.query, request.top_k)
            found_df = self.search_all([query], k, filters, mode)
            if fallback and wants_families(request.query):
                described = self.described(found_df)
                order = retrieval.diversify(described).select("query_id", "id", F.col("rank").alias("new"))
                found_df = found_df.join(order, ["query_id", "id"]).withColumn("rank", F.col("new")).drop("new")
            hits = self._rows(found_df)
            found = len(hits)
        assembled = retrieval.assemble(hits, self.budget)
        return {"hits": hits, **assembled, "meta": meta | {"candidate_count": found, "effective_top_k": len(hits), "coverage_truncated": found > len(hits), "filters": filters, "mode": mode}}

    def _planned(self, request: Request, plan: dict, mode: str) -> tuple[list[dict], list[dict], int]:
        tasks = plan["retrieval_tasks"]
        queries = [(t, v, q) for t, task in enumerate(tasks) for v, q in enumerate(expand(request.query, task))]
        hits = self.search_all([q for *_, q in queries], candidates(request), request.explicit, mode).cache()
        place = self.spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(queries)], "query_id int, task int, variant int")
        found = hits.count()
        per = hits.join(F.broadcast(place), "query_id").drop("query_id").withColumnRenamed("task", "query_id")  # a row a query
        groups, told = [], []
        for t, task in enumerate(tasks):
            mine = per.where(F.col("query_id") == t)
            need = task.get("requirement") or {}
            fused = retrieval.fuse_queries(mine, first_weight=4.0 if sum(x == t for x, *_ in queries) > 1 else 1.0)
            dense = mine.groupBy("query_id", "id").agg(F.min_by("dense_score", "variant").alias("dense_score"))
            full = retrieval.scoped(self.described(fused.join(dense, ["query_id", "id"])), task.get("statement_scope"), topic_of(need))
            rows = [r.asDict(recursive=True) for r in full.orderBy("rank").collect()]  # four lists of twenty at most
            rows = self._by_phrases(rows, priority_phrases(need, normal), bool(need.get("group_by")))
            groups.append((f"T{t + 1}", [r | {"matrix": r.get("raw_matrix")} for r in rows]))
            told.append({"task_id": f"T{t + 1}", "requirement": need, "queries": [q for x, _, q in queries if x == t], "candidates": [r["id"] for r in rows]})
        hits.unpersist()
        return retrieval.interleave(groups, min(max(request.top_k, 3 * len(groups)), 12)), told, found

    @staticmethod
    def _by_phrases(rows: list[dict], phrases: list[str], grouped: bool) -> list[dict]:
        def key(r: dict) -> tuple[int, int, int]:
            line = next((x for x in (r.get("text") or "").splitlines() if "row_number=" in x.lower()), "")
            fields = [p.split("=", 1) for x in re.split("[；;]", line) if "=" in (p := x.strip())]
            label = normal(fields[1][1]) if len(fields) > 1 else ""
            number = any(re.search(r"\d", v) and v.strip().lower() not in ("空值", "none", "null") for _, v in fields[2:])
            in_row, in_text = sum(p in label for p in phrases) if label else 0, sum(p in normal(r.get("text")) for p in phrases)
            valued = int(in_row > 0 and number)
            return (-in_text, -in_row, -valued) if grouped else (-in_row, -valued, -in_text)

        return sorted(rows, key=key)

    def query(self, request: Request, mode: str = "hybrid", generate: bool = True) -> dict:
        """The answer with its evidence: no_evidence, retrieval_only, generated, or how drafting, review or citations failed."""
        got = self.retrieve(request, mode, generate)
        hits = got["hits"]
        top = hits[0].get("dense_score") if hits else None
        enough = bool(got["citations"]) and not (top is not None and mode != "bm25" and top < self.threshold)
        out = got | {"answer": NO_EVIDENCE, "answerable": enough, "citation_ids": [], "citation_valid": False, "status": "no_evidence"}
        if not enough:
            return out
        if not generate:
            return out | {"answer": "", "status": "retrieval_only"}
        if self.generate is None:
            raise ValueError("no text generator")
        ask = [{"role": "system", "content": "Answer from the evidence only; cite it as [S1], [S2]."}, {"role": "user", "content": f"{request.query.strip()}\n\n{got['context']}"}]
        draft = self.generate(ask)  # a draft that fails is the caller's error
        valid = self.cited(draft, got["citations"])
        try:
            final = self.generate([*ask, {"role": "assistant", "content": draft}, {"role": "user", "content": "Check the draft against the evidence; return the final answer only."}])
            checked = self.cited(final, got["citations"])
            status = "generated" if checked["valid"] else "generated_from_draft_review_invalid" if valid["valid"] else "citation_validation_failed"
        except Exception:
            final, checked = draft, valid
            status = "generated_from_draft_review_failed" if valid["valid"] else "review_generation_failed"
        if status == "generated_from_draft_review_invalid":
            final, checked = draft, valid
        good = status.startswith("generated")
        return out | {"answer": final if good else NO_EVIDENCE, "answerable": good, "citation_ids": checked["ids"], "citation_valid": checked["valid"], "status": status, "citation_check": checked}

    @staticmethod
    def cited(answer: str, citations: list[dict]) -> dict:
        """Ids in an answer, those unknown, fields missing, mixed scopes, periods and units; valid when cited, known and complete."""
        ids = list(dict.fromkeys(re.findall(r"\[(S\d+)\]", answer or "")))
        by = {c["evidence_id"]: c for c in citations}
        known = [by[i] for i in ids if i in by]
        missing = {c["evidence_id"]: m for c in known if (m := [f for f in retrieval.REQUIRED if c.get(f) in (None, "")])}
        mixed = {f"mixed_{n}": len({str(c.get(f)) for c in known}) > 1 for n, f in (("scopes", "statement_scope"), ("periods", "period_end"), ("units", "unit"))}
        unknown = [i for i in ids if i not in by]
        return {"ids": ids, "unknown": unknown, "missing": missing, **mixed, "valid": bool(ids) and not unknown and not missing}
