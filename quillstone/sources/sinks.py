"""Writers: JSON lines, previews, reports, and a point table with idempotent, resumable upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import point_id, vector_digest


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_previews(records: DataFrame, path: str, text: str = "text", most: int = 2000) -> None:
    """A readable block a record, in parts a file each."""
    title = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in records.columns if c != text))
    records.select(F.concat(F.lit("== "), title, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


# What a stored point says of its chunk.
PAYLOAD = (
    "chunk_id", "chunk_index", "parent_record_id", "source_record_ids", "source_format", "source_kind", "source_provider", "source_file", "page_start", "page_end",
    "paragraph_index", "sheet_name", "cell_range", "section_path", "chunk_type", "chunk_text", "embedding_text", "search_text", "table_id", "table_header",
    "column_headers", "parent_row_labels", "row_labels", "header_row_count", "row_indices", "row_matrix", "raw_matrix_sha256", "source_location", "group_key",
    "document_id", "company_id", "company_name", "ticker", "cik", "fiscal_year", "report_type", "language", "currency", "unit_scale", "source_url", "source_sha256",
    "table_title", "table_context", "measure_name", "value_kind", "region", "period_years", "statement_family", "statement_scope", "period_end", "unit",
    "table_title_raw", "table_group_id", "content_role",
)


def payload(chunks: DataFrame) -> DataFrame:
    """The columns a point keeps, null where a chunk has none; the whole matrix stays in a table of its own."""
    have = set(chunks.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    full = lambda c: F.when(col(c) != "", col(c))
    special = {"source_file": ("_source_file", "source_file", "_chunk_file"), "source_sha256": ("sha256", "source_sha256")}
    return chunks.select(*((F.coalesce(*map(full, special[c])) if c in special else col(c)).alias(c) for c in PAYLOAD))


def embed_text(chunks: DataFrame):
    """What is encoded: embedding_text, else a table's search_text, else the chunk's text."""
    have = set(chunks.columns)
    full = lambda c: F.when(F.col(c) != "", F.col(c)) if c in have else F.lit(None).cast("string")
    table = F.coalesce(full("chunk_type"), F.lit("")).startswith("table")
    return F.coalesce(full("embedding_text"), F.when(table, full("search_text")), full("chunk_text"), F.lit(""))


def matrices(chunks: DataFrame) -> DataFrame:
    """(table_group_id, raw_matrix), each whole matrix once; two different ones of a group raise."""
    m = chunks.where("table_group_id <> '' and size(raw_matrix) > 0").groupBy("table_group_id").agg(F.min(F.to_json("raw_matrix")).alias("a"), F.max(F.to_json("raw_matrix")).alias("b"))
    clash = F.raise_error(F.concat(F.lit("different matrices of table group "), F.col("table_group_id")))
    return m.select("table_group_id", F.from_json(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(clash.cast("string")), "array<array<string>>").alias("raw_matrix"))


def with_matrices(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """chunks with table_matrix, the whole matrix of their table group in registry (see matrices()); null without one."""
    return chunks.join(registry.select("table_group_id", F.col("raw_matrix").alias("table_matrix")), "table_group_id", "left")


class PointStore:
    """Points (point_id, chunk_id, vector, payload columns) in versioned Parquet folders under a root.

    A version is complete before the pointer row names it, so readers see whole versions only. Missing ids are found by
    an anti-join; models don't mix.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> dict | None:
        try:
            rows = self.spark.read.parquet(f"{self.root}/manifest").orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return rows[0].asDict() if rows else None

    def points(self) -> DataFrame | None:
        m = self._manifest()
        return self.spark.read.parquet(f"{self.root}/{m['folder']}") if m else None

    def missing(self, chunks: DataFrame) -> DataFrame:
        """Chunks whose point is not stored yet."""
        have = self.points()
        keyed = chunks.withColumn("point_id", point_id("chunk_id"))
        return keyed if have is None else keyed.join(have.select("point_id"), "point_id", "left_anti")

    def foreign(self, chunks: DataFrame) -> DataFrame:
        """Stored points that none of chunks has."""
        return self.points().select("point_id", "chunk_id").join(chunks.select(point_id("chunk_id").alias("point_id")), "point_id", "left_anti")

    def upsert(self, rows: DataFrame, model: str, recreate: bool = False) -> dict:
        """Rows (chunk_id, vector, ...) in place of those with their id; another model than the stored one raises."""
        old = None if recreate else self._manifest()
        if old and old["model"] != model:
            raise ValueError(f"the collection holds vectors of {old['model']}, not of {model}")
        rows = rows.withColumn("point_id", point_id("chunk_id"))
        if rows.groupBy("point_id").count().where("count > 1").limit(1).count():
            raise ValueError("chunk_id is not unique")
        if old:
            kept = self.points().join(rows.select("point_id"), "point_id", "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
        version = (self._manifest() or {"version": 0})["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{folder}")
        stored = self.spark.read.parquet(f"{self.root}/{folder}")
        digest = stored.agg(F.hex(F.bit_xor(F.xxhash64("point_id", vector_digest("vector")))).alias("d"))
        manifest = {"version": version, "folder": folder, "model": model, "points": stored.count(), "vector_digest": digest.first()[0]}
        self.spark.createDataFrame([manifest]).write.mode("append").parquet(f"{self.root}/manifest")
        return manifest
