"""Document files as records: one distributed scan of binary files, a parser by suffix, the standard library only.

Every parser is bytes -> list of record dicts. Records leave as (source_file, source_format, seq, record) with the record
as JSON, since sheets hold mixed types; typed views are projections of it. A file that can't be read gives one record
with an error and doesn't stop the others.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes, str], list[dict]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(rows: list[list], name: str, parser: str, warnings: list[str]) -> dict:
    w = max(map(len, rows), default=0)
    rows = [r + [None] * (w - len(r)) for r in rows]
    return {
        "record_type": "table", "content_type": "table", "parser": parser, "warnings": warnings, "location": {"sheet": name, "range": f"A1:{letters(w)}{len(rows)}" if w else None},
        "raw_content": {"headers": rows[0] if rows else [], "rows": rows[1:]},
    }


def parse_delimited(data: bytes, path: str) -> list[dict]:
    warnings = []
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("gb18030")
        warnings.append("UTF-8 decoding failed; read as gb18030.")
    name, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    rows = [list(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t" if suffix.lower() == "tsv" else ",")]
    return [_sheet(rows, name, "csv", warnings)]


def parse_xlsx(data: bytes, path: str) -> list[dict]:
    """Non-empty sheets; formulas stay text, date cells become ISO text, trailing empty rows go."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    root = lambda n: ElementTree.fromstring(z.read(n))
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in root("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    dates = set()
    if "xl/styles.xml" in names:
        styles = root("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
        formats = styles.find(f"{_S}cellXfs")
        for i, x in enumerate(formats if formats is not None else []):
            n = int(x.get("numFmtId", 0))
            if 14 <= n <= 22 or 45 <= n <= 47 or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I):
                dates.add(i)
    targets = {r.get("Id"): r.get("Target") for r in root("xl/_rels/workbook.xml.rels")}

    def value(c):
        f, kind, v = c.find(f"{_S}f"), c.get("t"), c.find(f"{_S}v")
        if f is not None and f.text:
            return "=" + f.text
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e"):
            return v.text
        number = float(v.text)
        if int(c.get("s", 0)) in dates:
            return (datetime(1899, 12, 30) + timedelta(days=number)).isoformat()
        return int(number) if number.is_integer() and "." not in v.text else number

    out = []
    for s in root("xl/workbook.xml").iter(f"{_S}sheet"):
        target = targets[s.get(f"{_R}id")].lstrip("/")
        rows: list[list] = []
        for r in root(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            row: list = []
            for c in r.iter(f"{_S}c"):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                row += [None] * ((at or len(row) + 1) - 1 - len(row))
                row.append(value(c))
            rows += [[] for _ in range(int(r.get("r", len(rows) + 1)) - 1 - len(rows))]
            rows.append(row)
        while rows and all(v in (None, "") for v in rows[-1]):
            rows.pop()
        if rows:
            out.append(_sheet(rows, s.get("name"), "xlsx", []))
    return out


def parse_docx(data: bytes, path: str) -> list[dict]:
    """Paragraphs and tables in body order; blank paragraphs leave no gap in the sequence."""
    z = zipfile.ZipFile(io.BytesIO(data))
    styles = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None

    def text(node) -> str:
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        return "".join(parts[e.tag](e) for e in node.iter() if e.tag in parts)

    out, tables = [], 0
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for node in body if body is not None else []:
        seq = {"record_index": len(out), "sequence": len(out), "parse_branch": "word"}
        if node.tag == f"{_W}p" and (t := text(node)).strip():
            style = node.find(f"{_W}pPr/{_W}pStyle")
            sid = style.get(f"{_W}val") if style is not None else None
            out.append(seq | {"record_type": "paragraph", "style": (styles.get(sid) or sid) if sid else "Normal", "text": t})
        elif node.tag == f"{_W}tbl":
            tables += 1
            rows = [["\n".join(text(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out.append(seq | {"record_type": "table", "table_number": tables, "row_count": len(rows), "column_count": max(map(len, rows), default=0), "rows": rows, "text": "\n".join("\t".join(r) for r in rows)})
    return out


def parse_html(data: bytes, path: str) -> list[dict]:
    from .html import parse_page

    return parse_page(data.decode("utf-8", "replace"), path.rsplit("/", 1)[-1].rpartition(".")[0])


PARSERS: dict[str, Parser] = {"csv": parse_delimited, "tsv": parse_delimited, "xlsx": parse_xlsx, "docx": parse_docx, "html": parse_html, "htm": parse_html}


def register(suffix: str, parser: Parser) -> None:
    """Adds a parser, such as one for PDF on clusters that have a library for it."""
    PARSERS[suffix.lower().lstrip(".")] = parser


def suffix_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def check_suffix(path: str) -> str:
    if suffix_of(path) not in PARSERS:
        raise ValueError(f"{path}: not one of the supported formats: {', '.join(sorted(PARSERS))}")
    return suffix_of(path)


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(source_file, source_format, seq, record, error) of every file under path; other suffixes raise."""
    parsers = dict(parsers or PARSERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                kind = suffix_of(file)
                if kind not in parsers:
                    raise ValueError(f"{file}: not one of the supported formats: {', '.join(sorted(parsers))}")
                try:
                    for i, r in enumerate(parsers[kind](data, file)):
                        rows.append((file, kind, i, json.dumps(r, ensure_ascii=False, default=str), None))
                except Exception as e:  # one file's failure is its own
                    rows.append((file, kind, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "source_format", "seq", "record", "error"])

    return files.mapInPandas(run, "source_file string, source_format string, seq int, record string, error string")


def read_jsonl(spark: SparkSession, path: str, schema=None, drop_meta: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that is no object raises, document_meta rows are dropped."""
    if schema is not None:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
        bad = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
        ok = F.trim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull()
        df = raw.select(F.when(ok, F.col("value")).otherwise(bad.cast("string")).alias("record"), F.get_json_object("value", "$.record_type").alias("record_type"))
    return df.where(~F.col("record_type").eqNullSafe(F.lit("document_meta"))) if drop_meta and "record_type" in df.columns else df


def read_chunks(spark: SparkSession, path: str, schema, cleaned: DataFrame | None = None) -> DataFrame:
    """Chunk files *.chunks.jsonl with _chunk_file and _source_file, metadata read from their text; chunk ids that are missing or not unique raise.

    _source_file is that of the first of a chunk's source records that cleaned (record_id, source_file) knows, else empty.
    """
    from ..functions.semantic import enrich

    df = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.chunks.jsonl").json(path).withColumn("_chunk_file", F.col("_metadata.file_name"))
    if cleaned is not None and "source_record_ids" in df.columns:
        known = cleaned.where("source_file <> ''").select("record_id", F.col("source_file").alias("__file"))
        used = df.select("chunk_id", F.posexplode("source_record_ids").alias("__at", "record_id")).join(known, "record_id")
        first = used.groupBy("chunk_id").agg(F.min_by("__file", "__at").alias("__file"))
        df = df.join(first, "chunk_id", "left").withColumn("_source_file", F.coalesce("__file", F.lit(""))).drop("__file")
    else:
        df = df.withColumn("_source_file", F.lit(""))
    df = enrich(df)
    bad = df.groupBy("chunk_id").count().where("chunk_id is null or chunk_id = '' or count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"chunk_id {bad[0].chunk_id!r} is missing or not unique")
    return df


def first_filings(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of a form for each company and year."""
    from pyspark.sql import Window

    w = Window.partitionBy("company_id", "fiscal_year").orderBy("filed", "document_id")
    return filings.where(F.col("form") == form).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def table_previews(tables: DataFrame, n: int = 3) -> DataFrame:
    """The first n tables of each dataset, rows as arrays in the order of the header."""
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy("table_index")
    return tables.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
