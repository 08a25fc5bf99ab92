"""Files to an index: read, clean, chunk, score, enrich, store; each stage is a table that can be written and read again.

    python -m quillstone.plans.ingest INPUT OUTPUT
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantic import enrich, table_group
from ..functions.text import clean_text, text_of, word_tokens
from ..operators import bm25, chunking, scoring
from ..sources.files import read_documents
from ..sources.sinks import payload

MATRIX = "array<array<string>>"


def cleaned(docs: DataFrame) -> DataFrame:
    """(document, seq, record) of parsed records: text cleaned, headings named, matrices as they were."""
    j = lambda p: F.get_json_object("record", p)
    style = F.lower(text_of(j("$.style")))
    heading = style.startswith("heading") | style.isin("title", "subtitle") | (text_of(j("$.content_role")) == "heading")
    table = j("$.record_type") == "table"
    sheet = F.concat(F.array(F.from_json(j("$.raw_content.headers"), "array<string>")), F.from_json(j("$.raw_content.rows"), MATRIX))
    matrix = F.coalesce(F.from_json(j("$.rows"), MATRIX), F.from_json(j("$.raw_matrix"), MATRIX), sheet)
    at = F.sum(table.cast("int")).over(Window.partitionBy("source_file").orderBy("seq"))
    kept = docs.where("error is null").withColumn("__n", at)
    one_row = F.when(table & (F.size(matrix) == 1), 0)
    fields = {
        "doc_id": F.concat(F.lit("sha256:"), F.sha2("source_file", 256)), "document_id": F.sha2("source_file", 256).substr(1, 16), "record_type": F.when(table, "table").otherwise("text"),
        "source_file": F.col("source_file"), "source_format": F.col("source_format"), "source_record_index": F.col("seq"),
        "cleaned_text": F.when(~table, clean_text(F.coalesce(j("$.text"), j("$.raw_text")))), "content_role": F.when(~table & heading, "section_title"),
        "raw_matrix": F.when(table, matrix), "table_id": F.when(table, F.coalesce(j("$.table_id"), F.format_string("%s_t%02d", F.col("source_format"), F.col("__n")))),
        "table_title": j("$.table_title"), "header_row_count": one_row, "location": F.from_json(j("$.location"), "struct<sheet:string,range:string>"),
    }
    return chunking.as_records(kept, "source_file", "seq", **fields)


def with_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with what their extra fields and text say."""
    j = lambda k: F.get_json_object("extra", f"$.{k}")
    out = chunks.withColumns({k: j(k) for k in ("document_id", "source_file", "table_title", "table_context", "statement_scope", "measure_name", "value_kind", "company_id", "fiscal_year")})
    out = enrich(out.drop("period_years"), None, "fiscal_year")
    return out.withColumn("table_group_id", table_group(F.col("table_id"), F.col("document_id"), F.col("page_start"), F.col("chunk_id")))


def report(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """(document, content, exact, boundary, size, metadata, score, grade)."""
    src = records.select("document", F.get_json_object("record", "$.cleaned_text").alias("text"), F.col("seq").alias("record_index")).where("text <> ''")
    ids = chunks.select("document", F.explode("source_spans").alias("s")).select("document", F.col("s.source_record_id").alias("record_id"), F.col("s.record_index").alias("record_index")).distinct()
    src = src.join(ids, ["document", "record_index"]).select("document", "record_id", F.length("text").alias("n_chars"), word_tokens("text").alias("toks")).withColumn("n_tokens", F.size("toks"))
    cover = scoring.text_coverage(src.select("record_id", "n_chars", "n_tokens"), scoring.span_rows(chunks)).join(ids.select("document", "record_id").distinct(), "record_id")
    content = cover.groupBy("document").agg(scoring.weighted("token_coverage", "n_tokens").alias("content"))
    parts = scoring.quality(chunks).join(content, "document", "left").join(scoring.exactness(chunks, src.select("record_id", "toks")), "document", "left")
    return scoring.overall(parts.na.fill(1.0, ["content", "exact"]))


def back_fill(chunks: DataFrame, sources: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """chunks with columns overwritten from sources where it has the key, and the keys it lacks."""
    s = sources.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__known"))
    got = chunks.join(s, key, "left")
    done = got.withColumns({c: F.when(F.col("__known"), F.col(f"__{c}")).otherwise(F.col(c) if c in chunks.columns else F.lit(None)) for c in columns})
    return done.drop("__known", *(f"__{c}" for c in columns)), chunks.join(sources, key, "left_anti").select(key).distinct()


def ingest(spark: SparkSession, source: str, out: str, sizes: chunking.Sizes = chunking.Sizes()) -> dict[str, DataFrame]:
    """Writes records, chunks, report, points and the index under out, and gives them back as read."""

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    parsed = stage("parsed", read_documents(spark, source))
    records = stage("records", cleaned(parsed))
    chunks = stage("chunks", with_metadata(chunking.chunk(records, sizes=sizes)))
    scores = stage("report", report(chunks, records))
    points = stage("points", payload(chunks))
    index = bm25.build(chunks.withColumn("id", F.col("chunk_id"))).write(f"{out}/index")
    return {"parsed": parsed, "records": records, "chunks": chunks, "report": scores, "points": points, "index": index}


if __name__ == "__main__":
    got = ingest(SparkSession.builder.appName("ingest").getOrCreate(), sys.argv[1], sys.argv[2])
    got["report"].show(50, False)
