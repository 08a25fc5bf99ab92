"""Cleaning of parsed pages, blocks, sheets and HTML into one wide record schema; sources are kept beside what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_actions, clean_text, join_lines, lines, normalise_line, protected_tokens, strip, text_of

# Compounds that keep their hyphen at a line's end, joins to repair, words of figure notes.
KEEP_HYPHEN = (
    "knowledge-intensive", "open-domain", "non-parametric", "state-of-the-art", "fine-tuning", "pre-trained", "parametric-only", "task-specific",
    "retrieve-and-extract", "end-to-end", "closed-book", "top-k", "two-way", "word-overlap-based", "well-suited",
)
REPAIRS = {
    r"documentszi": "documents zi", r"treatz": "treat z", r"knowledgeintensive": "knowledge-intensive", r"stackaugmented": "stack-augmented", r"nonparametric": "non-parametric",
    r"TheSunAlso\s*R\s*ises": "The Sun Also Rises", r"Farewellto": "Farewell to", r"Answer\s+GenerationRetriever": "Answer Generation Retriever",
}
FIGURE_WORDS = ("image", "figure", "diagram", "architecture", "图", "图片", "图示")
EDGE = 3


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc, page, pos, line, n, at_edge) of the non-empty normalised lines of pages (doc, page, text); pos from 1."""
    full = F.filter(lines(text), lambda x: x != "")
    split = pages.select("doc", "page", full.alias("__lines")).withColumn("n", F.size("__lines"))  # split once a page, not once a line
    rows = split.select("doc", "page", "n", F.posexplode("__lines").alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    return rows.withColumn("at_edge", (F.col("pos") <= EDGE) | (F.col("pos") > F.greatest(F.lit(EDGE), F.col("n") - EDGE)))


def repeated_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc, line, pages): top and bottom lines that stand on two pages or more, the first page aside."""
    rows = page_lines(pages, text).where((F.col("pos") <= EDGE) | (F.col("pos") > F.col("n") - EDGE))
    first = pages.groupBy("doc").agg(F.min("page").alias("first"))
    rows = rows.where(F.length("line") >= 3).where(~F.col("line").rlike(r"^\d{1,4}$"))
    return rows.join(first, "doc").where("page <> first").groupBy("doc", "line").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")


def remove_edges(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc, page, text, removed): pages without repeated edge lines and their own page numbers at an edge; blank lines stay."""
    every = pages.select("doc", "page", F.posexplode(lines(text)).alias("at", "line"))
    before = Window.partitionBy("doc", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = (F.col("line") != "").cast("int")
    every = every.withColumn("pos", F.sum(full).over(before)).withColumn("n", F.sum(full).over(Window.partitionBy("doc", "page")))
    edge = (F.col("line") != "") & ((F.col("pos") <= EDGE) | (F.col("pos") > F.greatest(F.lit(EDGE), F.col("n") - EDGE)))
    known = repeated_lines(pages, text).select("doc", "line", F.lit(True).alias("__again"))
    marked = every.join(known, ["doc", "line"], "left")
    number = (F.col("line") == F.col("page").cast("string")) & F.col("line").rlike(r"^\d{1,4}$")
    why = F.when(edge & F.col("__again"), "repeated_header_footer").when(edge & number, "page_number")
    marked = marked.withColumn("reason", why)
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNull(), F.struct("at", "line")))), lambda x: x["line"])
    gone = F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("at", "reason", "line")))), lambda x: F.concat(x["reason"], F.lit(": "), x["line"]))
    return marked.groupBy("doc", "page").agg(F.concat_ws("\n", kept).alias("text"), gone.alias("removed"))


def repair_joins(c: Column, repairs: dict[str, str] = REPAIRS) -> Column:
    for a, b in repairs.items():
        c = F.regexp_replace(c, rf"(?i)\b{a}\b", b)
    return c


def drop_figure_labels(c: Column, reasons: Column) -> Column:
    """Text from the first Figure n: on, where an excluded candidate speaks of a figure and text stands before it."""
    some = F.exists(reasons, lambda r: F.lower(r).rlike("|".join(FIGURE_WORDS)))
    at = F.regexp_instr(c, F.lit(r"(?i)\bFigure\s+\d+\s*:"))
    return F.when(some & (at > 1) & (strip(c.substr(F.lit(1), at - 1)) != ""), strip(c.substr(at, F.length(c)))).otherwise(c)


def drop_table_copies(c: Column, matrices: Column) -> Column:
    """Text without the first span from a table's first to its last full body row, or of all its cells if it has at most 60.

    Cells are told apart by any white space, in either case; a single body row alone is not removed.
    """
    quote = lambda v: F.regexp_replace(normalise_line(v), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    cells = lambda r: F.filter(F.transform(r, quote), lambda x: x != "")
    whole = lambda r: F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.concat_ws(r"\s*", F.transform(r, lambda x: F.regexp_replace(x, " ", r"\\s*"))), F.lit(r"(?![\p{L}\p{N}_])"))

    def cut(text, m):
        body = F.filter(F.transform(F.slice(m, 2, 100_000), cells), lambda r: F.size(r) >= 2)
        every = F.flatten(F.transform(m, cells))
        # The first row is settled once found, so that a missing last row takes one pass over the rest.
        head, tail = F.lit(r"(?isu)\A(?>(.*?)[ \t]*"), F.lit(r"[ \t]*")
        rows = F.concat(head, whole(F.try_element_at(body, F.lit(1))), F.lit(").*?"), whole(F.try_element_at(body, F.lit(-1))), tail)
        small = F.concat(head, whole(every), F.lit(")"), tail)
        drop = lambda pattern: F.regexp_replace(text, pattern, F.lit("$1 "))
        found = F.when((F.size(body) >= 2) & F.rlike(text, rows), drop(rows)).when(F.size(every).between(1, 60) & F.rlike(text, small), drop(small))
        return strip(F.coalesce(found, text))

    return F.aggregate(F.coalesce(matrices, F.array().cast("array<array<array<string>>>")), c, cut)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Records of pages (doc, page, text, matrices, reasons): edges removed, lines joined, table copies and figure labels dropped, joins repaired."""
    have = set(pages.columns)
    rest = pages.select(
        "doc", "page", (F.col("matrices") if "matrices" in have else F.lit(None).cast("array<array<array<string>>>")).alias("matrices"),
        (F.col("reasons") if "reasons" in have else F.array().cast("array<string>")).alias("reasons"), F.col("text").alias("raw_text"),
    )
    got = remove_edges(pages).join(rest, ["doc", "page"])
    text = join_lines(F.split("text", "\n"), KEEP_HYPHEN)
    text = repair_joins(drop_figure_labels(drop_table_copies(text, F.col("matrices")), F.col("reasons")))
    got = got.select("doc", "page", "raw_text", text.alias("cleaned_text"), "removed", "matrices", "reasons")
    return got.withColumn("protected_kept", F.size(F.array_except(protected_tokens("raw_text"), F.concat(protected_tokens("cleaned_text"), protected_tokens(F.concat_ws(" ", "removed"))))) == 0)


def page_records(cleaned: DataFrame) -> DataFrame:
    """One row a text, a table or a picture still to be read, of cleaned pages."""
    base = cleaned.select("doc", "page", "cleaned_text", "matrices", "reasons")
    null = lambda t: F.lit(None).cast(t)
    text = base.where("cleaned_text <> ''").select("doc", "page", F.lit("text").alias("record_type"), F.lit(0).alias("part"), F.col("cleaned_text").alias("text"), null("array<array<string>>").alias("matrix"), F.lit("included").alias("embedding_status"))
    table = base.select("doc", "page", F.posexplode("matrices").alias("part", "matrix")).select("doc", "page", F.lit("table").alias("record_type"), "part", null("string").alias("text"), "matrix", F.lit("included").alias("embedding_status"))
    figure = F.exists("reasons", lambda r: F.lower(r).rlike("|".join(FIGURE_WORDS))) | ((F.col("cleaned_text") == "") & F.coalesce(F.size("matrices") <= 0, F.lit(True)))
    image = base.where(figure).select("doc", "page", F.lit("image_pending").alias("record_type"), F.lit(0).alias("part"), null("string").alias("text"), null("array<array<string>>").alias("matrix"), F.lit("excluded").alias("embedding_status"))
    return text.unionByName(table).unionByName(image)


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Records of word-processor blocks (source_file, sequence, record_type, style, text, rows): text cleaned, headings named, a one-row table without header."""
    style = F.lower(text_of("style"))
    heading = style.startswith("heading") | style.isin("title", "subtitle")
    return blocks.select(
        "source_file", "sequence", "record_type",
        F.when((F.col("record_type") != "table") & heading, "section_title").when(F.col("record_type") != "table", "body").alias("content_role"),
        F.when(F.col("record_type") != "table", clean_text("text")).alias("cleaned_text"),
        F.when(F.col("record_type") != "table", clean_actions("text")).alias("actions"),
        F.when(F.col("record_type") == "table", F.col("rows")).alias("raw_matrix"),
        F.when(F.col("record_type") == "table", (F.size("rows") != 1).cast("int")).alias("header_row_count"),
    )


def clean_sheets(sheets: DataFrame) -> DataFrame:
    """Records of sheets (source, sheet, headers, rows): ids by place, matrix of headers and rows, content as it was."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("sheet_index"))
    matrix = F.when((F.size("headers") > 0) | (F.size("rows") > 0), F.concat(F.array("headers"), "rows"))
    return sheets.select("source", "sheet", F.format_string("excel_t%02d", at).alias("table_id"), matrix.alias("raw_matrix"), F.lit(1).alias("header_row_count"))


def clean_html(records: DataFrame) -> DataFrame:
    """Records of HTML parts (doc, html_order, record_type, raw_text, matrix, table_id): cleaned text, normalised cells; a table id that is missing or not unique raises."""
    same = F.count("*").over(Window.partitionBy("doc", "table_id"))
    bad = (F.col("record_type") == "table") & (F.col("table_id").isNull() | (F.col("__same") > 1))
    rows = records.withColumn("__same", same)
    ok = F.when(bad, F.raise_error(F.concat(F.lit("table_id is missing or not unique: "), F.coalesce("table_id", F.lit("none"))))).otherwise(F.lit(True).cast("string"))
    cells = F.transform("matrix", lambda r: F.transform(r, normalise_line))
    return rows.where(ok.isNotNull()).select("doc", "html_order", "record_type", clean_text("raw_text").alias("cleaned_text"), cells.alias("raw_matrix"), "table_id")


def copy_down(chunks: DataFrame, sources: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """chunks whose empty columns take the source record's value."""
    s = sources.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    got = chunks.join(s, key, "left")
    full = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return got.withColumns({c: F.coalesce(full(c), full(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def validate_clean(records: DataFrame) -> DataFrame:
    """(doc, pages, empty_pages, lost_tokens, passed) of cleaned pages."""
    return records.groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum((F.col("cleaned_text") == "").cast("int")).alias("empty_pages"), F.sum((~F.col("protected_kept")).cast("int")).alias("lost_tokens")
    ).withColumn("passed", F.col("lost_tokens") == 0)


def validate_records(source: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc, texts, tables, raw_matrix_unchanged, protected_preserved, projection_complete, passed) of cleaned word-processor or sheet records.

    source: doc, seq, text, rows (null for a paragraph); cleaned: doc, seq, cleaned_text, raw_matrix, table_text. A record on
    one side only fails. Every cell that isn't blank must stand in its table's text, in either case; a paragraph keeps its
    protected tokens in order, a table each of them as often.
    """
    s = source.select("doc", "seq", F.col("text").alias("__text"), F.col("rows").alias("__rows"), F.lit(True).alias("__source"))
    c = cleaned.select("doc", "seq", "cleaned_text", "raw_matrix", F.lower(text_of("table_text")).alias("__said"), F.lit(True).alias("__cleaned"))
    both = s.join(c, ["doc", "seq"], "full_outer")
    there = F.col("__source").isNotNull() & F.col("__cleaned").isNotNull()
    table = F.coalesce(F.col("__rows"), F.col("raw_matrix")).isNotNull()
    cells = F.filter(F.transform(F.flatten("raw_matrix"), lambda v: F.lower(normalise_line(text_of(v)))), lambda v: v != "")
    shown = F.coalesce(F.forall(cells, lambda v: F.col("__said").contains(v)), F.lit(True))
    tokens = lambda t: protected_tokens(text_of(t))
    numbers = F.flatten(F.transform(F.flatten("raw_matrix"), lambda v: protected_tokens(text_of(v))))
    often = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    said = protected_tokens("__said")
    kept = F.when(table, F.coalesce(F.forall(F.array_distinct(numbers), lambda x: often(said, x) >= often(numbers, x)), F.lit(True))).otherwise(tokens("__text") == tokens("cleaned_text"))
    same = F.to_json("__rows").eqNullSafe(F.to_json("raw_matrix"))
    count = lambda c: F.sum(c.cast("int")).cast("long")
    got = both.groupBy("doc").agg(
        count(~table).alias("texts"), count(table).alias("tables"), F.min(there & same).alias("raw_matrix_unchanged"), F.min(there & kept).alias("protected_preserved"), F.min(there & shown).alias("projection_complete"),
    )
    return got.withColumn("passed", F.col("raw_matrix_unchanged") & F.col("protected_preserved") & F.col("projection_complete"))
