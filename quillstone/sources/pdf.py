"""PDF pages: geometry over words and rules, for any extractor.

No PDF library is bundled. read_pages() takes an extractor, bytes -> pages with text, words and rules; the operators
below turn those into tables with titles, context and scope. A page that fails is a row with its error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[bytes], list[dict]]
# What a page with a financial table speaks of; what a title speaks of.
TABLE_PAGE = r"(?i)following table|following tables|consolidated statements|balance sheets|cash flows|shareholders.? equity|in millions|segment information|net sales by|revenue disaggregation|reconciliation of"
TITLE = r"(?i)\b(?:table|statement|statements|schedule|note)\b"


def read_pages(spark: SparkSession, path: str, extract: Extractor) -> DataFrame:
    """(source_file, page, status, text, words, rules, error): words and rules as JSON."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = extract(data)
                except Exception as e:
                    pages = [{"page": 0, "error": f"{type(e).__name__}: {e}"}]
                for n, p in enumerate(pages, 1):
                    rows.append((file, p.get("page", n), "error" if p.get("error") else "ok", p.get("text"), json.dumps(p.get("words", [])), json.dumps(p.get("rules", [])), p.get("error")))
            yield pd.DataFrame(rows, columns=["source_file", "page", "status", "text", "words", "rules", "error"])

    return files.mapInPandas(run, "source_file string, page int, status string, text string, words string, rules string, error string")


def metadata(raw: Column) -> Column:
    """Keys without their leading slash, entries without a value dropped."""
    return F.transform_keys(F.map_filter(raw, lambda k, v: v.isNotNull()), lambda k, v: F.regexp_replace(k, "^/", ""))


def may_hold_table(text: Column) -> Column:
    """A cheap gate before geometry: eight digits and a phrase of financial tables."""
    return (F.regexp_count(text, F.lit(r"\d")) >= 8) & text.rlike(TABLE_PAGE)


def scope_of(text: Column) -> Column:
    """The one scope that is named; unknown if none or both are."""
    said = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(standalone|consolidated)\b"), F.lit(1)))
    return F.when(F.size(said) == 1, said[0]).otherwise("unknown")


def text_lines(words: list[dict], gap: float = 3) -> list[list[dict]]:
    """Words by line: a new one begins where the top moves by more than gap; each reads from the left."""
    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        if lines and abs(w["top"] - lines[-1][0]["top"]) <= gap:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: w["x0"]) for line in lines]


def context(words: list[dict], top: float, page_text: str, above: float = 160, keep: int = 8) -> dict:
    """Title, context and scope of a table from the lines above it, else from the head of the page."""
    clean = lambda s: " ".join(s.split())
    near = [t for line in text_lines([w for w in words if top - above <= w["top"] < top]) if (t := clean(" ".join(w["text"] for w in line)))]
    head = [t for x in page_text.splitlines() if (t := clean(x))][:12]
    lines = near[-keep:] or head
    title = next((x for part in (lines, head) for x in reversed(part) if re.search(TITLE, x)), None)
    for part in (lines, head):
        said = set(re.findall(r"\b(standalone|consolidated)\b", "\n".join(part).lower()))
        if len(said) == 1:
            return {"table_title": title, "table_context": "\n".join(lines) or None, "statement_scope": said.pop()}
    return {"table_title": title, "table_context": "\n".join(lines) or None, "statement_scope": "unknown"}


# The least length of a rule; how far above and below a table one may stand, and beyond its sides; how far the
# left and the right ends of one column's rules lie apart; where number columns begin; how much wider a spanning rule is.
RULE, ABOVE, BELOW, SIDE, LEFTS, RIGHTS, NUMBERS, WIDER = 20, 40, 3, 3, 3, 5, 0.35, 8


def islands(values: list, key: Callable, gap: float) -> list[list]:
    """values by key, parted where two neighbours lie more than gap apart."""
    order = sorted(values, key=key)
    cuts = [0, *(i for i in range(1, len(order)) if key(order[i]) - key(order[i - 1]) > gap), len(order)]
    return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def rule_columns(rules: list[dict], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """Label and number columns from horizontal rules: islands of their ends, on the right, without those that span a narrower one."""
    x0, top, x1, bottom = box
    ends = [(r["x0"], r["x1"]) for r in rules if r["x1"] - r["x0"] >= RULE and -ABOVE <= r["top"] - top and r["top"] - bottom <= BELOW and r["x0"] >= x0 - SIDE and r["x1"] <= x1 + SIDE]
    alike = [g for left in islands(ends, lambda e: e[0], LEFTS) for g in islands(left, lambda e: e[1], RIGHTS)]
    columns: list[tuple[float, float]] = []
    for a, b in sorted(((sum(e[0] for e in g) / len(g), sum(e[1] for e in g) / len(g)) for g in alike), key=lambda c: c[1] - c[0]):
        inside = [c for c in columns if a - 1 <= c[0] and c[1] <= b + 1 and b - a > c[1] - c[0] + WIDER]
        if a >= x0 + NUMBERS * (x1 - x0) and not inside:
            columns.append((a, b))
    columns.sort()
    return [(x0, columns[0][0] - 1), *columns] if len(columns) > 1 and columns[0][0] - 1 > x0 else []


def grid(words: list[dict], columns: list[tuple[float, float]], gap: float = 3) -> list[list[str]]:
    """Rows of cell texts: a word is in the column that holds its middle."""
    out = []
    for line in text_lines(words, gap):
        cells = [" ".join(w["text"] for w in line if a <= (w["x0"] + w["x1"]) / 2 <= b) for a, b in columns]
        if any(cells):
            out.append(cells)
    return out


def heuristic_table(words: list[dict], rules: list[dict], box: tuple[float, float, float, float], page_text: str) -> dict | None:
    """A table of rules and words: leading rows without numbers are its header; three body rows and columns at least."""
    inside = [w for w in words if w["x0"] >= box[0] - 2 and w["x1"] <= box[2] + 2 and box[1] - 2 <= w["top"] and w.get("bottom", w["top"]) <= box[3] + 2]
    rows = grid(inside, rule_columns(rules, box))
    heads = next((i for i, r in enumerate(rows) if any(re.search(r"\d", c) and not re.fullmatch(r"(?:FY\s*)?(?:19|20)\d{2}", c.strip()) for c in r[1:])), len(rows))
    if len(rows) - heads < 3 or len(rows[0]) < 3:
        return None
    return {"matrix": rows, "header_row_count": heads, "merged_cells": []} | context(words, box[1], page_text)


# Why candidates of a whole page aren't tables.
NOT_REGISTERED = "No visually verified table region is registered for this page."
DIAGNOSTIC = "Whole-page candidates are diagnostic only; the explicit region registry is authoritative."


def excluded_candidates(pages: DataFrame, accepted: DataFrame, notes: DataFrame) -> DataFrame:
    """(source_file, page, candidate_count, accepted_count, reason) of pages (source_file, page, candidate_count) whose candidates aren't all tables.

    accepted has a row (source_file, page) for each registered region; notes (source_file, page, note) say why a page has none.
    """
    key = ["source_file", "page"]
    got = pages.join(accepted.groupBy(*key).agg(F.count("*").alias("accepted_count")), key, "left").na.fill(0, ["accepted_count"])
    got = got.where((F.col("candidate_count") != F.col("accepted_count")) & ((F.col("candidate_count") > 0) | (F.col("accepted_count") > 0)))
    why = notes.groupBy(*key).agg(F.min("note").alias("note"))
    reason = F.when(F.col("accepted_count") == 0, F.coalesce("note", F.lit(NOT_REGISTERED))).otherwise(DIAGNOSTIC)
    return got.join(why, key, "left").select(*key, "candidate_count", "accepted_count", reason.alias("reason"))


def heuristic_tables(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """heuristic_table() of every box (source_file, page, x0, top, x1, bottom) on read pages (source_file, page, text, words, rules).

    Gives source_file, page, table_number (by place on the page), matrix, header_row_count, table_title, table_context,
    statement_scope; boxes without a table give no row.
    """
    places = ("x0", "top", "x1", "bottom")
    on = boxes.groupBy("source_file", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom"))).alias("boxes"))
    got = pages.where(F.col("words").isNotNull()).select("source_file", "page", "text", "words", "rules").join(on, ["source_file", "page"])
    told = ("matrix", "header_row_count", "table_title", "table_context", "statement_scope")

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf.itertuples(index=False):
                words, rules = json.loads(p.words), json.loads(p.rules or "[]")
                found = (heuristic_table(words, rules, tuple(b[c] for c in places), p.text or "") for b in p.boxes)
                rows += [(p.source_file, p.page, n, *(t[c] for c in told)) for n, t in enumerate(filter(None, found), 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page", "table_number", *told])

    return got.mapInPandas(run, "source_file string, page int, table_number int, matrix array<array<string>>, header_row_count int, table_title string, table_context string, statement_scope string")
