"""Deterministic report metadata as Columns: statement family, scope, period, unit. Dictionaries are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_of

# Phrases of each statement family, in order of precedence.
FAMILIES: dict[str, tuple[str, ...]] = {
    "balance_sheet": (
        "balance sheet", "balance sheets", "statement of financial position", "financial position", "total assets", "total current assets", "total non-current assets",
        "total liabilities", "total shareholders", "total stockholders", "资产负债表", "资产总额", "负债总额",
    ),
    "cash_flow": (
        "cash flow", "cash flows", "cash generated by operating", "cash used in financing", "cash from operating", "现金流", "经营活动产生", "投资活动产生", "融资活动产生",
    ),
    "segment": (
        "business segment", "operating segment", "geographic segment", "geographical", "region", "regions", "products", "services", "net sales by", "revenue by",
        "收入结构", "业务分部", "地区分部",
    ),
    "income_statement": (
        "income statement", "income statements", "statements of operations", "statements of income", "revenue from operations", "total net sales", "gross margin",
        "operating income", "net income", "profit before tax", "profit after tax", "净销售额", "营业收入", "净利润", "利润总额",
    ),
    "equity": (
        "shareholders' equity", "shareholders’ equity", "stockholders' equity", "total equity", "retained earnings", "accumulated deficit", "common stock",
        "share repurchases", "股东权益", "留存收益", "股本",
    ),
    "ratio": (
        "ratio analysis", "financial ratios", "gross margin percentage", "operating margin", "ebit margin", "earnings per share", "basic and diluted eps", " eps",
        "return on", "debt to equity", "比率分析", "利润率", "偿债能力",
    ),
    "workforce": ("employees", "employee count", "headcount", "workforce", "attrition", "员工", "雇员", "人员"),
    "risk": (
        "risk factors", "principal risks", "market risk", "forward-looking statements", "risk management", "liquidity risk", "legal proceedings",
        "commitments and contingencies", "风险因素", "主要风险", "诉讼", "承诺和或有事项",
    ),
    "notes": (
        "notes to consolidated", "notes to financial statements", "significant accounting policies", "impairment", "contingencies", "附注", "会计政策", "减值",
    ),
    "management_analysis": (
        "management's discussion", "management’s discussion", "management discussion", "operating review", "management analysis", "管理层讨论", "经营回顾",
    ),
    "business_overview": ("business overview", "our business", "products and services", "主要业务", "业务概览"),
}
# Fixed values: (family, points, one of these, and one of those).
BOOSTS: tuple[tuple[str, int, tuple[str, ...], tuple[str, ...]], ...] = (
    ("balance_sheet", 20, ("total assets", "total liabilities", "资产总额", "负债总额"), ()),
    ("cash_flow", 20, ("cash generated", "cash used", "operating activities", "investing activities"), ()),
    ("ratio", 20, ("ratio analysis", "debt to equity", "gross margin percentage", "ebit margin", "earnings per share", "basic and diluted eps"), ()),
    ("risk", 20, ("risk factors", "principal risks", "risks and uncertainties", "market risk"), ()),
    ("segment", 8, ("geographic", "geographical", "by region", "europe", "greater china", "japan", "asia pacific"), ()),
    ("income_statement", 30, ("total net sales",), ("gross margin", "operating income", "net income", "earnings per share")),
)
# Words of a scope, families with a scope of their own.
STANDALONE = ("standalone", "separate financial", "parent company only", "独立口径", "单体")
CONSOLIDATED = ("consolidated", "合并")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
UNIT = r"(?i)(?:in|₹|rs\.?|rupees?|\$|usd|eur|€|jpy|¥)[ \t\n]*(?:us[ \t\n]*)?(?:million|millions|billion|billions|thousand|thousands|crore|crores|lakh|lakhs|百万|亿元|千元)(?![\p{L}\p{N}_])"
YEAR = r"(?i)(?<![\p{L}\p{N}_])(?:FY\s*)?(?:19|20)\d{2}(?![\p{L}\p{N}_])"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def family_scores(text: Column | str) -> dict[str, Column]:
    low = F.lower(text_of(text))
    points = lambda p: F.when(low.contains(p.lower()), max(1, len(p) // 8)).otherwise(0)
    scores = {f: sum((points(p) for p in ps[1:]), points(ps[0])) for f, ps in FAMILIES.items()}
    for family, n, some, also in BOOSTS:
        hit = _any(low, some) & (_any(low, also) if also else F.lit(True))
        scores[family] = scores[family] + F.when(hit, n).otherwise(0)
    return scores


def statement_family(text: Column | str) -> Column:
    """The family with the most points, the first on ties; other without any."""
    ranked = [F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, (f, s) in enumerate(family_scores(text).items())]
    best = F.array_max(F.array(*ranked))
    return F.when(best["s"] > 0, best["f"]).otherwise("other")


def statement_scope(text: Column | str, family: Column | str) -> Column:
    low, family = F.lower(text_of(text)), F.col(family) if isinstance(family, str) else family
    return (
        F.when(_any(low, STANDALONE), "standalone")
        .when(family == "segment", "segment")
        .when(family.isin("management_analysis", "business_overview", "risk"), "management_analysis")
        .when(_any(low, CONSOLIDATED), "consolidated")
        .when(family.isin("balance_sheet", "income_statement", "cash_flow", "equity", "ratio"), "consolidated")
        .otherwise("unknown")
    )


def period_end(text: Column | str, fiscal_year: Column | str | None = None) -> Column:
    """The first date behind a cue within 60 characters as ISO, else FY and the year given, else the first year of the text."""
    t = text_of(text)
    date = rf"(?is)(?:fiscal year ended|year ended|period ended|as of)(?:(?!(?<![\p{{L}}\p{{N}}_])(?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}}(?!\d)).){{0,54}}?(?<![\p{{L}}\p{{N}}_])({MONTHS})\s+(\d{{1,2}}),\s*(\d{{4}})(?![\p{{L}}\p{{N}}_])"
    parts = [F.regexp_extract(t, date, i) for i in (1, 2, 3)]
    iso = F.try_to_timestamp(F.concat_ws(" ", F.initcap(parts[0]), parts[1], parts[2]), F.lit("MMMM d yyyy")).cast("date").cast("string")
    year = F.regexp_replace(F.upper(F.regexp_extract(t, YEAR, 0)), r"[^0-9]", "")
    given = F.lit(None).cast("string") if fiscal_year is None else F.expr(f"string(try_cast({fiscal_year} as int))") if isinstance(fiscal_year, str) else fiscal_year.try_cast("int").cast("string")
    return F.coalesce(iso, F.concat(F.lit("FY"), given), F.when(year != "", F.concat(F.lit("FY"), year)))


def period_years(text: Column | str) -> Column:
    found = F.regexp_extract_all(text_of(text), F.lit(YEAR), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda y: F.regexp_replace(y, "[^0-9]", "").cast("int"))))


def unit(text: Column | str, currency: Column | None = None, scale: Column | None = None) -> Column:
    """The unit as printed, else from crores, currency and scale; not_disclosed without any."""
    t = text_of(text)
    currency = F.trim(text_of(currency)) if currency is not None else F.lit("")
    scale = F.trim(text_of(scale)) if scale is not None else F.lit("")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    named = F.regexp_extract(t, UNIT, 0)
    dollars = F.regexp_extract(t, r"(?i)(?<![\p{L}\p{N}_])(?:millions?|billions?|thousands?)\s+dollars?(?![\p{L}\p{N}_])", 0)
    crore = t.rlike(r"(?i)(?:₹|`|rs\.?)\s*crores?(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])crores?(?![\p{L}\p{N}_])")
    return (
        F.when(named != "", tidy(named))
        .when(dollars != "", tidy(dollars))
        .when(crore, F.concat(F.when(currency != "", currency).otherwise("INR"), F.lit(" crore")))
        .when((currency != "") & (scale != "") & (F.lower(scale) != "as_reported"), F.concat(currency, F.lit(" "), scale))
        .when(currency != "", F.concat(currency, F.lit(" as_reported")))
        .when(scale != "", scale)
        .otherwise("not_disclosed")
    )


def table_group(table_id: Column, document_id: Column, page: Column, chunk: Column) -> Column:
    full = lambda c: F.when(F.trim(text_of(c)) != "", F.trim(text_of(c)))
    paged = F.when(full(document_id).isNotNull() & page.isNotNull(), F.concat(full(document_id), F.lit(":page:"), page.cast("string"), F.lit(":text")))
    return F.coalesce(full(table_id), paged, full(chunk))


def region(descriptor: Column, row_labels: Column) -> Column:
    """The last row label of a table on geography."""
    labels = F.filter(F.transform(row_labels, F.trim), lambda x: x != "")
    return F.when(F.lower(text_of(descriptor)).contains("geograph") & (F.size(labels) > 0), F.try_element_at(labels, F.lit(-1)))


# The fields that say what a chunk is about, in order.
SEARCHED = ("table_title", "table_context", "table_title_raw", "section_path", "group_key", "chunk_text", "search_text", "table_header", "raw_matrix")


def flat(c: Column, kind) -> Column:
    """A value of any type as text: items and entries by a space, entries behind their key, nulls empty."""
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: flat(x, kind.elementType)), " ")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(" ", e["key"].cast("string"), flat(e["value"], kind.valueType))), " ")
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *(F.concat_ws(" ", F.lit(f.name), flat(c[f.name], f.dataType)) for f in kind.fields))
    return F.coalesce(c.cast("string"), F.lit(""))


def search_text(chunks) -> Column:
    """The text that a chunk's metadata is read from: those of SEARCHED that chunks has, flattened, without empty ones."""
    parts = [flat(F.col(c), chunks.schema[c].dataType) for c in SEARCHED if c in chunks.columns]
    return strip(F.concat_ws(" ", *(F.when(p != "", p) for p in parts))) if parts else F.lit("")


# What a citation tells beside its page and the inferred fields.
CITED = (
    "document_id", "company_id", "company_name", "fiscal_year", "source_file", "source_url", "source_format", "source_kind", "page_start", "page_end", "paragraph_index", "table_id",
    "table_title", "table_context", "region", "period_years", "measure_name", "value_kind", "currency", "unit_scale", "column_headers", "parent_row_labels", "table_title_raw",
    "sheet_name", "cell_range", "source_location",
)


def citation(hits, fiscal_year: str | None = None):
    """hits with citation, a struct: what their chunk says of itself, else what its search text does; a family that is inferred comes first.

    page is told only where the chunk stands on one page.
    """
    have = set(hits.columns)
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    full = lambda c: F.when(own(c).cast("string") != "", own(c))
    got = hits.withColumn("__said", search_text(hits))
    got = got.withColumn("__family", statement_family("__said"))
    scope, end = statement_scope("__said", "__family"), period_end("__said", fiscal_year)
    one_page = own("page_start").eqNullSafe(own("page_end")) | own("page_end").isNull()
    inferred = {
        "page": F.when(one_page, own("page_start")), "statement_family": F.when(F.col("__family") != "other", F.col("__family")).otherwise(F.coalesce(full("statement_family"), F.lit("other"))),
        "statement_scope": F.coalesce(full("statement_scope"), scope), "period_end": F.coalesce(full("period_end"), end), "unit": F.coalesce(full("unit"), unit("__said", own("currency"), own("unit_scale"))),
        "table_group_id": F.coalesce(full("table_group_id"), table_group(own("table_id"), own("document_id"), own("page_start"), own("chunk_id").cast("string"))),
    }
    told = {c: own(c) for c in CITED} | {"period_years": own("period_years") if "period_years" in have else period_years("__said")} | inferred
    return got.withColumn("citation", F.struct(*(c.alias(n) for n, c in told.items()))).drop("__said", "__family")


def enrich(chunks, text=None, fiscal_year=None):
    """chunks with statement_family, statement_scope (an explicit one stays), period_end, period_years and unit, read from text, or from search_text()."""
    if text is None:
        return enrich(chunks.withColumn("__said", search_text(chunks)), "__said", fiscal_year).drop("__said")
    have = set(chunks.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    family = statement_family(text)
    scope = F.trim(text_of(col("statement_scope")))
    out = chunks.withColumn("statement_family", family)
    out = out.withColumn("statement_scope", F.when(~scope.isin("", "unknown"), scope).otherwise(statement_scope(text, "statement_family")))
    return out.withColumns({"period_end": period_end(text, fiscal_year), "period_years": period_years(text), "unit": unit(text, col("currency"), col("unit_scale"))})


def _holding(texts, names, most: int):
    """texts (__q, ...) with each of names (alias, ...) that they hold: up to most names go to every task, more meet texts by their first three letters."""
    holds = F.col("__q").contains(F.col("alias"))
    if names.limit(most + 1).count() <= most:
        return texts.join(F.broadcast(names), holds)
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__q") - n + 1)), lambda i: F.substring("__q", i, F.lit(n)))
    starts = texts.withColumn("__start", F.explode(F.array_distinct(F.concat(places(1), places(2), places(3)))))
    return starts.join(names.withColumn("__start", F.substring("alias", 1, 3)), "__start").where(holds).drop("__start")


def infer_filters(queries, aliases, years=(), formats=(), report_types=(), query="query", most=100_000):
    """queries with company_id, fiscal_year, source_format, report_type inferred from the text; null where it doesn't say.

    aliases is (alias, company_id); the longest alias that the text holds wins, then the first by name. A year counts
    when exactly one is named as a fiscal year and it is known, or no years are.
    """
    low = F.trim(F.regexp_replace(F.lower(text_of(query)), r"\s+", " "))
    q = queries.withColumn("__q", low).withColumn("__id", F.xxhash64(query))
    known = aliases.where("alias <> ''").select(F.lower("alias").alias("alias"), F.col("company_id").alias("__company"))
    said = _holding(q.select("__id", "__q").distinct(), known, most)
    best = said.groupBy("__id").agg(F.min_by("__company", F.struct(-F.length("alias"), "alias", "__company")).alias("company_id"))
    word = "(?:fiscal|fy|财年|财务年度|年度报告|annual report)"
    behind = F.regexp_extract_all("__q", F.lit(rf"{word}[^0-9]{{0,8}}((?:19|20)\d{{2}})|((?:19|20)\d{{2}})[^a-z0-9]{{0,4}}{word}"), F.lit(0))
    said_years = F.array_distinct(F.transform(behind, lambda m: F.regexp_extract(m, r"(?:19|20)\d{2}", 0).cast("int")))
    year = F.when((F.size(said_years) == 1) & (F.lit(not years) | said_years[0].isin(*(years or (0,)))), said_years[0])
    fmt = F.lit(None).cast("string")
    for f in sorted({x.lower() for x in formats}, reverse=True):
        fmt = F.when(F.col("__q").rlike(rf"(?<![a-z])\Q{f}\E(?![a-z])"), f).otherwise(fmt)
    kinds = {x.lower(): x for x in sorted(report_types)}
    kind = kinds.get("annual_report", next(iter(kinds.values()), None))
    q = q.withColumns({"fiscal_year": year, "source_format": fmt, "report_type": F.when(F.col("__q").contains("annual report") | F.col("__q").contains("年报"), F.lit(kind))})
    return q.join(best, "__id", "left").drop("__q", "__id")
