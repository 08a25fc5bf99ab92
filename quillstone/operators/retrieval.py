"""Ranked retrieval: dense, fused, diversified, de-duplicated lists, and evidence within a budget.

Lists are DataFrames (query_id, id, rank, score, ...). What depends on order across the few dozen hits of a request, which a
top-k has already bounded, is a fold: on the driver for one request, a group each for many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nearest
from .bm25 import matches, top

RRF_K = 60
FINANCIAL = ("balance_sheet", "cash_flow", "income_statement", "equity", "ratio")
# Topics that have no statement scope; names of scopes.
UNSCOPED = ("地区", "地域", "分部", "segment", "业务板块", "员工", "流失", "workforce", "attrition", "风险", "risk", "云业务", "cloud", "产品类别", "业务收入来源", "收入来源", "product category", "products and services")
SCOPES = {"合并": "consolidated", "consolidated": "consolidated", "合并口径": "consolidated", "单体": "standalone", "独立": "standalone", "standalone": "standalone"}


def dense(vectors: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, block: int = 1 << 25, digits: int | None = None) -> DataFrame:
    """Exact cosine top-k of queries (query_id, vector) over vectors (id, vector, ...), filters first; ties by id.

    Queries go to every task in blocks of about block bytes with what a task holds for them, equal vectors once, and the
    vectors are scanned once for each block. A task finds by matrix products in single precision which pairs can be among a
    query's k best, scores these in double precision, in the order of a plain sum, and hands on its k best. With digits,
    scores are rounded before they are compared.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    q = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("v"))
    n, dim = q.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-n * (16 * (dim or 0) + 24 * max(k, 1)) // block) or 1
    kept = matches(vectors, filters).select("id", F.col("vector").cast("array<double>").alias("v")).where("id is not null and v is not null")
    kept, out = kept.coalesce(2 * spark.sparkContext.defaultParallelism), None
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else q
        asked = spark.sparkContext.broadcast(nearest.Asked.of(part.toArrow()))
        best = kept.mapInArrow(nearest.best(asked, k, digits), f"query_id int, id {kinds['id']}, score double")
        got = top(best, k).select(F.col("query_id").alias("own"), "id", "rank", "score").mapInArrow(nearest.named(asked), f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")
        out = got if out is None else out.unionByName(got)
    return out


def depth(limit: int) -> int:
    """How deep each list is read before fusion."""
    return max(4 * limit, 20)


def fuse(a: DataFrame, b: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists; each side's score stays beside the sum."""
    left = a.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    right = b.select("query_id", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = left.join(right, ["query_id", "id"], "full_outer").withColumn("score", part("dense_rank") + part("sparse_rank"))
    return top(both, k)


def fuse_queries(hits: DataFrame, k: int = RRF_K, first_weight: float = 1.0) -> DataFrame:
    """Fusion of the lists of one task (query_id, variant, id, rank, score): variants from 0, each list's own first hit of an id.

    Gives query_id, id, rrf, matches, score (of the first variant that has it) and rank.
    """
    first = Window.partitionBy("query_id", "variant", "id").orderBy("rank")
    one = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    weight = F.when(F.col("variant") == 0, F.lit(float(first_weight))).otherwise(F.lit(1.0))
    got = one.groupBy("query_id", "id").agg(
        F.sum(weight / (F.lit(k) + F.col("rank"))).alias("rrf"), F.count("*").alias("matches"), F.min_by("score", "variant").alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("matches"), F.desc(F.coalesce("score", F.lit(0.0))), "id")
    return got.withColumn("rank", F.row_number().over(order))


def dedupe(hits: DataFrame, key: str = "id") -> DataFrame:
    """The best-ranked hit of each key, ranks renumbered."""
    best = Window.partitionBy("query_id", key).orderBy("rank", "id")
    kept = hits.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))


def diversify(hits: DataFrame) -> DataFrame:
    """First one hit of each statement family in the order families appear, then the rest; ranks renumbered.

    A financial family is represented by its best consolidated hit, if it has one.
    """
    family = F.coalesce(F.when(F.col("statement_family") != "", F.col("statement_family")), F.lit("other"))
    prefer = (~(family.isin(*FINANCIAL) & (F.lower(F.coalesce("statement_scope", F.lit(""))) == "consolidated"))).cast("int")
    h = hits.withColumn("__f", family).withColumn("__p", prefer)
    h = h.withColumn("__seen", F.min("rank").over(Window.partitionBy("query_id", "__f")))
    h = h.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__f").orderBy("__p", "rank")))
    head = (F.col("__n") == 1).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc(head), F.when(head == 1, F.col("__seen")).otherwise(F.col("rank")))
    return h.withColumn("rank", F.row_number().over(order)).drop("__f", "__p", "__seen", "__n")


def scoped(hits: DataFrame, scope: str | None, topic: str = "") -> DataFrame:
    """Hits of the requested scope, or all where a query has none of it or the topic has no scope."""
    want = SCOPES.get((scope or "").strip().lower())
    if not want or any(w in topic.lower() for w in UNSCOPED):
        return hits
    fits = F.lower(F.coalesce("statement_scope", F.lit(""))) == want
    some = F.max(fits.cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("__some", some).where(fits | (F.col("__some") == 0)).drop("__some")


def answerable(hits: DataFrame, threshold: float = 0.5, score: str = "dense_score") -> DataFrame:
    """(query_id, answerable): false where the top hit's dense score is below the threshold; a top hit without one passes."""
    best = hits.groupBy("query_id").agg(F.min_by(score, "rank").alias("top_score"))
    return best.select("query_id", F.coalesce(F.col("top_score") >= threshold, F.lit(True)).alias("answerable"))


def prioritise(hits: DataFrame, phrases: list[str], grouped: bool = False) -> DataFrame:
    """A task's hits (norm_text, row_label, row_has_value, rank) by phrases in the row label, a value beside it, phrases in the text.

    Whole-text phrases come first for grouped tasks; the order stays where nothing matches.
    """
    count = lambda c: sum((F.coalesce(F.col(c).contains(p), F.lit(False)).cast("int") for p in phrases), F.lit(0))
    row = F.when(F.coalesce(F.col("row_label"), F.lit("")) != "", count("row_label")).otherwise(0)
    value = ((row > 0) & F.col("row_has_value")).cast("int")
    keys = [count("norm_text"), row, value] if grouped else [row, value, count("norm_text")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*map(F.desc, keys), "rank")))


def row_parts(text: Column) -> tuple[Column, Column]:
    """Label and value test of the first table row in a text: its second field, and a digit in a later one."""
    line = F.regexp_extract(text, r"(?im)^.*row_number=.*$", 0)
    fields = F.filter(F.transform(F.split(line, "[；;]"), F.trim), lambda p: p.contains("="))
    values = F.transform(fields, lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))
    label = F.when(F.size(fields) >= 2, F.try_element_at(values, F.lit(2))).otherwise("")
    rest = F.slice(values, 3, 1000)
    return F.coalesce(label, F.lit("")), F.exists(rest, lambda v: v.rlike(r"\d") & ~F.lower(F.trim(v)).isin("空值", "none", "null"))


def _marks(hit: dict) -> list[tuple[str, str]]:
    """What a hit is known by: its id, its text, and its group where the whole table comes with it."""
    text, group = (hit.get("text") or "").strip(), hit.get("table_group_id") if hit.get("matrix") else None
    return [(kind, str(v)) for kind, v in (("id", hit.get("id")), ("text", text), ("table", group)) if v not in (None, "")]


def interleave(tasks: list[tuple[str, list[dict]]], limit: int) -> list[dict]:
    """The first limit distinct hits of tasks' ranked lists, rank by rank and task by task, each with the tasks that found it by then.

    Two hits are one where they share an id, a text or a whole table; hits without an id are left out.
    """
    turns = sorted((depth, t) for t, (_, hits) in enumerate(tasks) for depth in range(len(hits)))
    place: dict[tuple[str, str], int] = {}
    kept: list[dict] = []
    found: list[dict[str, None]] = []
    for depth, t in turns:
        if len(kept) == limit:
            break
        task, hit = tasks[t][0], tasks[t][1][depth]
        marks = _marks(hit)
        if not marks or marks[0][0] != "id":
            continue
        at = min((place[m] for m in marks if m in place), default=len(kept))
        if at == len(kept):
            place.update(dict.fromkeys(marks, at))
            kept.append(hit)
            found.append({})
        found[at][task] = None
    return [hit | {"task_ids": [*names], "rank": n} for n, (hit, names) in enumerate(zip(kept, found, strict=True), 1)]


def round_robin(hits: DataFrame, limit: int) -> DataFrame:
    """interleave() of every request's tasks: (request, rank, id, task_ids) of hits (request, task, rank, id, text).

    A request is a group of as many rows as its tasks' top-k lists have, and one is folded without the others.
    """

    def run(g):
        import pandas as pd

        names = ["request", "rank", "id", "task_ids"]
        g = g.sort_values(["task", "rank", "id"])
        tasks = [(str(t), part[["id", "text"]].to_dict("records")) for t, part in g.groupby("task", sort=True)]
        rows = [(g["request"].iloc[0], r["rank"], r["id"], ",".join(r["task_ids"])) for r in interleave(tasks, limit)]
        return pd.DataFrame(rows, columns=names)

    kinds = dict(hits.dtypes)
    return hits.select("request", "task", "rank", "id", "text").groupBy("request").applyInPandas(run, f"request {kinds['request']}, rank int, id {kinds['id']}, task_ids string")


# The line that leads a block, the head of a table in it, the mark of a cut one, what absent values are called.
BLOCK_LINE = "semantic_family={}; scope={}; period_end={}; unit={}; table_group_id={}"
BLOCK_FIELDS = ("statement_family", "statement_scope", "period_end", "unit", "table_group_id")
TABLE_HEAD, TABLE_CUT = "完整表格上下文：\n", "\n[表格上下文已截断]"
ABSENT = (("statement_families", "statement_family", "other"), ("statement_scopes", "statement_scope", "unknown"), ("period_ends", "period_end", "unknown"), ("units", "unit", "unknown"))


def _block(n: int, hit: dict, body: str) -> str:
    return f"[S{n}]\n{BLOCK_LINE.format(*(hit.get(f) for f in BLOCK_FIELDS))}\n{body}"


def _table(matrix: list, room: int) -> str:
    """A matrix as text of room characters at most; empty where not even its head and the mark fit."""
    full = TABLE_HEAD + "\n".join(" | ".join(str(c or "").strip() for c in row) for row in matrix)
    if len(full) <= room:
        return full
    return full[: room - len(TABLE_CUT)].rstrip() + TABLE_CUT if room > len(TABLE_HEAD) + len(TABLE_CUT) else ""


def assemble(hits: list[dict], budget: int = 12_000, table_share: int = 6002) -> dict:
    """Evidence blocks of ranked hits within budget characters: one that doesn't fit is passed over; tables then share what is left.

    A text or a whole table is told once. Gives context, citations (with evidence_id S1, S2, ...) and coverage.
    """
    bodies: list[str] = []
    taken: list[dict] = []
    told: set[tuple[str, str]] = set()
    free = budget
    for hit in hits:
        marks = [m for m in _marks(hit) if m[0] != "id"]
        if not marks or marks[0][0] != "text" or told.intersection(marks):
            continue
        body = marks[0][1]
        cost = len(_block(len(taken) + 1, hit, body)) + (2 if taken else 0)
        if cost <= free:
            free -= cost
            told.update(marks)
            taken.append(hit)
            bodies.append(body)
    wide = [i for i, hit in enumerate(taken) if hit.get("matrix")]
    for waiting, i in zip(range(len(wide), 0, -1), wide, strict=True):
        table = _table(taken[i]["matrix"], min(table_share, free // waiting) - 2)
        if table:
            bodies[i] += "\n\n" + table
            free -= len(table) + 2
    cites = [{k: v for k, v in hit.items() if k not in ("text", "matrix")} | {"evidence_id": f"S{n}", "context_text": body} for n, (hit, body) in enumerate(zip(taken, bodies, strict=True), 1)]
    coverage = {name: sorted({str(c.get(f) or none) for c in cites}) for name, f, none in ABSENT}
    coverage["table_groups"] = len({str(c.get("table_group_id") or c.get("id")) for c in cites})
    return {"context": "\n\n".join(_block(n, hit, body) for n, (hit, body) in enumerate(zip(taken, bodies, strict=True), 1)), "citations": cites, "coverage": coverage}


def contexts(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """assemble() of every query's hits (query_id, id, rank, text, statement_family, statement_scope): (query_id, evidence_id, id, n_chars, within)."""

    def run(g):
        import pandas as pd

        rows = g.sort_values(["rank", "id"]).to_dict("records")
        got = assemble(rows, budget)
        out = [(rows[0]["query_id"], c["evidence_id"], c["id"], len(c["context_text"]), len(got["context"]) <= budget) for c in got["citations"]]
        return pd.DataFrame(out, columns=["query_id", "evidence_id", "id", "n_chars", "within"])

    kinds = dict(hits.dtypes)
    one = hits.select("query_id", "id", "rank", "text", "statement_family", "statement_scope")
    return one.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, evidence_id string, id {kinds['id']}, n_chars int, within boolean")


REQUIRED = ("source_file", "company_id", "fiscal_year", "source_format", "statement_family", "statement_scope", "period_end", "unit", "table_group_id")


def validate_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of answers (answer_id, answer) against evidence (answer_id, evidence_id, REQUIRED...): ids cited, unknown, with missing fields, mixed values, valid."""
    from ..functions.text import citation_ids

    said = answers.select("answer_id", F.posexplode_outer(citation_ids("answer")).alias("pos", "evidence_id"))
    blank = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) == ""
    missing = F.concat_ws(",", *(F.when(blank(f), F.lit(f)) for f in REQUIRED))
    known = evidence.select("answer_id", "evidence_id", missing.alias("missing"), *(F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f) for f in ("statement_scope", "period_end", "unit")), F.lit(True).alias("known"))
    each = said.join(known, ["answer_id", "evidence_id"], "left")
    cited, is_known = F.col("evidence_id").isNotNull(), F.coalesce(F.col("known"), F.lit(False))
    got = each.groupBy("answer_id").agg(
        F.sum(cited.cast("int")).alias("n_cited"),
        F.sum((cited & ~is_known).cast("int")).alias("n_unknown"),
        F.sum((is_known & (F.col("missing") != "")).cast("int")).alias("n_incomplete"),
        *((F.count_distinct(F.when(is_known, F.col(f))) > 1).alias(m) for f, m in (("statement_scope", "mixed_scopes"), ("period_end", "mixed_periods"), ("unit", "mixed_units"))),
    )
    return got.withColumn("valid", (F.col("n_cited") > 0) & (F.col("n_unknown") == 0) & (F.col("n_incomplete") == 0))
