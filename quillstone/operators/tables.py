"""Table operators: matrices as arrays of rows for projections, long cells for windows, and chunks of a table.

A matrix is never changed; labels, filled keys and text are projections beside it.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical_digest, chunk_id
from ..functions.text import normalise_line

EMPTY = "空值"


# --- arrays ---------------------------------------------------------------------------------------------------------


def width(matrix: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matrix, F.size)), F.lit(0))


def rectangular(matrix: Column) -> Column:
    """Rows padded with nulls to the widest one."""
    w = width(matrix)
    return F.transform(matrix, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), w - F.size(r))))


def column_name(n: Column) -> Column:
    """Letters of a sheet's n-th column, from 1: base 26 without a zero. Up to three letters."""
    letter = lambda x: F.char(x + 65)
    n = n.cast("long") - 1
    one, two, three = letter(n % 26), letter(F.floor(n / 26 - 1) % 26), letter(F.floor((n - 26) / 676 - 1) % 26)
    return F.when(n < 26, one).when(n < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def cell_range(matrix: Column) -> Column:
    return F.when((F.size(matrix) > 0) & (width(matrix) > 0), F.concat(F.lit("A1:"), column_name(width(matrix)), F.size(matrix).cast("string")))


def column_labels(matrix: Column, header_rows: Column | int = 1, unique: bool = True) -> Column:
    """A label a column: distinct non-empty header cells joined by " / ", column_n without any, made unique."""
    head = F.slice(matrix, F.lit(1), F.lit(header_rows) if isinstance(header_rows, int) else header_rows)
    # try_element_at with a name resolves the column index inside the lambda
    cells = lambda i: F.filter(F.transform(head, lambda r: normalise_line(F.try_element_at(r, i))), lambda v: v != "")
    plain = F.transform(F.sequence(F.lit(1), F.greatest(width(matrix), F.lit(1))), lambda i: F.coalesce(F.nullif(F.concat_ws(" / ", F.array_distinct(cells(i))), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))))
    plain = F.when(width(matrix) > 0, plain).otherwise(F.array().cast("array<string>"))
    if not unique:
        return plain
    own = lambda x, i: F.when(F.array_contains(F.slice(plain, F.lit(1), i), x), F.concat(x, F.lit(" / column_"), (i + 1).cast("string"))).otherwise(x)
    return F.transform(plain, own)


def projection(matrix: Column, labels: Column, table_id: Column, location: Column, header_rows: int = 1) -> Column:
    """One searchable line a body row: identity, row number, label=value; empty cells say so."""
    w = F.size(labels)
    pair = lambda r, i: F.concat(F.element_at(labels, i), F.lit("="), F.coalesce(F.nullif(normalise_line(F.try_element_at(r, i)), F.lit("")), F.lit(EMPTY)))
    line = lambda r, n: F.concat_ws(
        "；", F.concat(F.lit("table_id="), table_id), F.concat(F.lit("location="), location), F.concat(F.lit("row_number="), (n + header_rows + 1).cast("string")),
        F.transform(F.sequence(F.lit(1), w), lambda i: pair(r, i)),
    )
    return F.when(w > 0, F.transform(F.slice(matrix, header_rows + 1, 1_000_000), line)).otherwise(F.array().cast("array<string>"))


def page_labels(matrix: Column, header_rows: Column | int = 1, merged_first_two: Column | bool = False) -> Column:
    """Labels of a page's table: row_label where the first column has none; a header merged over two columns names a group."""
    plain = column_labels(matrix, header_rows, unique=False)
    named = F.transform(plain, lambda x, i: F.when((i == 0) & (x == "column_1"), F.lit("row_label")).otherwise(x))
    merged = F.lit(merged_first_two) if isinstance(merged_first_two, bool) else merged_first_two
    grouped = F.concat(F.array(F.concat(named[0], F.lit(" group")), named[0]), F.slice(named, 3, 10_000))
    return F.when(merged & (F.size(named) >= 2), grouped).otherwise(named)


# --- long cells -----------------------------------------------------------------------------------------------------


def cells(tables: DataFrame, matrix: str = "matrix", keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """(keys, row, col, value), both from 0."""
    rows = tables.select(*keys, F.posexplode(matrix).alias("row", "__r"))
    return rows.select(*keys, "row", F.posexplode("__r").alias("col", "value"))


def fill_merged(long: DataFrame, merged: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Empty cells inside a merged rectangle take its value, and its columns are filled downwards."""
    m = merged.select(*keys, "row_start", "row_end", "column_start", "column_end", F.col("value").alias("__m"))
    inside = (F.col("row") >= F.col("row_start")) & (F.col("row") < F.col("row_end")) & (F.col("col") >= F.col("column_start")) & (F.col("col") < F.col("column_end"))
    hit = long.join(m, list(keys)).where(inside).groupBy(*keys, "row", "col").agg(F.first("__m").alias("__m"))
    cols = m.select(*keys, F.explode(F.sequence("column_start", F.col("column_end") - 1)).alias("col")).distinct().withColumn("__fill", F.lit(True))
    got = long.join(hit, [*keys, "row", "col"], "left").join(cols, [*keys, "col"], "left")
    got = got.withColumn("value", F.coalesce(F.nullif(F.col("value"), F.lit("")), "__m"))
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return got.select(*keys, "row", "col", F.when(F.col("__fill"), F.last("value", ignorenulls=True).over(down)).otherwise(F.col("value")).alias("value"))


def fill_down(rows: DataFrame, columns: list[str], table: list[str], order: str) -> DataFrame:
    """Blank keys take the last value above."""
    down = Window.partitionBy(*table).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), ignorenulls=True).over(down) for c in columns})


def key_groups(rows: DataFrame, columns: list[str], table: list[str], order: str) -> DataFrame:
    """rows with grp, from 0: runs of equal filled keys; a row without any key starts its own."""
    w = Window.partitionBy(*table).orderBy(order)
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    blank = F.concat_ws("", *(F.coalesce(F.col(c), F.lit("")) for c in columns)) == ""
    filled = fill_down(rows, columns, table, order).withColumn("__k", key).withColumn("__b", blank)
    new = (F.col("__b") | ~F.col("__k").eqNullSafe(F.lag("__k").over(w))).cast("int")
    return filled.withColumn("__n", new).withColumn("grp", F.sum("__n").over(w) - 1).drop("__k", "__b", "__n")


def parent_rows(rows: DataFrame, label: str, numeric: str, table: list[str], order: str) -> DataFrame:
    """rows with parent: the label of the last row without numbers before a row with, if no numeric row lies between."""
    w = Window.partitionBy(*table).orderBy(order)
    heads = (~F.col(numeric)) & (F.trim(F.coalesce(label, F.lit(""))) != "")
    r = rows.withColumn("__h", heads)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("__h"), F.struct(F.col(order).alias("o"), F.trim(label).alias("l"))), ignorenulls=True).over(before)
    value = F.last(F.when(F.col(numeric), F.col(order)), ignorenulls=True).over(before)
    r = r.withColumn("__head", head).withColumn("__value", value)
    keep = F.col(numeric) & F.col("__head").isNotNull() & (F.col("__value").isNull() | (F.col("__value") < F.col("__head.o")))
    return r.withColumn("parent", F.when(keep, F.col("__head.l"))).drop("__h", "__head", "__value")


def difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Cells that differ between two versions: (keys, row, col, left_value, right_value, change)."""
    on = [*keys, "row", "col"]
    left, right = a.select(*on, F.col("value").alias("left_value"), F.lit(True).alias("__l")), b.select(*on, F.col("value").alias("right_value"), F.lit(True).alias("__r"))
    both = left.join(right, on, "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value")))
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").otherwise("changed")
    return both.select(*on, "left_value", "right_value", change.alias("change"))


def place_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of registered table regions from page words: (table_id, row, col, text).

    words: page, text, x0, top, bottom; regions: table_id, page, row_edges, col_edges. A word belongs to the column whose
    edges hold its left end and to the row of the nearest centre; words of a cell read by line, then from the left.
    """
    r = regions.select("table_id", "page", "row_edges", "col_edges")
    inside = words.join(r, "page").where("top >= row_edges[0] - 1 and top < element_at(row_edges, -1) and x0 >= col_edges[0] and x0 < element_at(col_edges, -1)")
    middle = F.expr("(top + bottom) / 2")
    centres = F.expr("transform(sequence(0, size(row_edges) - 2), i -> (row_edges[i] + row_edges[i + 1]) / 2)")
    gap = F.transform(centres, lambda c, i: F.struct(F.abs(c - middle).alias("d"), i.alias("i")))
    col = F.expr("size(filter(col_edges, e -> e <= x0)) - 1")
    placed = inside.select("table_id", F.array_min(gap)["i"].alias("row"), col.alias("col"), F.struct(F.round("top").alias("t"), "x0", "text").alias("w"))
    return placed.groupBy("table_id", "row", "col").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("w")), lambda w: w["text"])).alias("text"))


# --- chunks of a table ------------------------------------------------------------------------------------------------


def _t(v: Any) -> str:
    return "" if v is None else str(v)


def _cell(row: list, i: int) -> str:
    return _t(row[i]).strip() if i < len(row) else ""


def _has_number(row: list) -> bool:
    return any(ch.isdigit() for c in row[1:] for ch in _t(c))


def header_rows(record: dict, matrix: list[list]) -> int:
    try:
        return max(0, min(int(record["header_row_count"]), len(matrix)))
    except (KeyError, TypeError, ValueError):
        given = record.get("header_rows")
        return max(1, min(len(given), len(matrix))) if isinstance(given, list) and given and isinstance(given[0], list) else int(bool(matrix))


def labels_of(record: dict, matrix: list[list], heads: int) -> list[str]:
    if isinstance(record.get("table_headers"), list) and record["table_headers"]:
        return [_t(x) for x in record["table_headers"]]
    out = []
    for i in range(max(map(len, matrix), default=0)):
        parts = dict.fromkeys(v for row in matrix[:heads] if (v := _cell(row, i)))
        out.append(" / ".join(parts) or f"column_{i + 1}")
    return out


def place_of(record: dict) -> str:
    where = record.get("location")
    return ";".join(f"{k}={v}" for k, v in where.items()) if isinstance(where, dict) else _t(where) or f"page={record.get('page_number')}"


class Table:
    """What every chunk of a table shares."""

    def __init__(self, record: dict, matrix: list[list]):
        self.record, self.matrix = record, matrix
        self.heads = header_rows(record, matrix)
        self.labels = labels_of(record, matrix, self.heads)
        self.about = " ".join(_t(record.get(k)) for k in ("table_title", "table_context")).strip().lower()
        self.geography = "geograph" in self.about and ("revenue" in self.about or "sales" in self.about)
        named = [i for i, x in enumerate(self.labels) if x.lower().strip() in ("task", "input")]
        self.keys = [] if self.geography else named or ([0] if matrix and matrix[0] else [])
        self.where, self.body, self.digest = place_of(record), range(self.heads, len(matrix)), canonical_digest(matrix)
        self.filled, last = {}, {}
        for r in self.body:
            row = list(matrix[r])
            for k in self.keys:
                if v := _cell(row, k):
                    last[k] = v
                elif k in last and k < len(row):
                    row[k] = last[k]
            self.filled[r] = row

    def line(self, r: int) -> str:
        return f"row_number={r + 1}；" + "；".join(f"{x}={_cell(self.filled[r], i) or EMPTY}" for i, x in enumerate(self.labels))

    def title(self, name: Any) -> str:
        return f"table_id={name}；location={self.where}；headers=" + " | ".join(self.labels)

    def groups(self, small: int) -> list[list[int]]:
        rows = list(self.body)
        if self.geography:
            out, parent = [], []
            for r in rows:
                if _has_number(self.matrix[r]):
                    out.append([*parent, r])
                    parent = []
                elif _cell(self.matrix[r], 0):
                    parent = [r]
            return [*out, parent] if parent else out
        if len(rows) <= small:
            return [rows]
        if not self.keys:
            return [rows[i : i + small] for i in range(0, len(rows), small)]
        out, before = [], None
        for r in rows:
            key = tuple(_cell(self.filled[r], k) for k in self.keys)
            if key != before or not any(key):
                out.append([])
            out[-1].append(r)
            before = key
        return out

    def within(self, groups: list[list[int]], most: int, tokenizer) -> list[list[int]]:
        """Groups cut so that their projection stays within most tokens, a row at least."""
        out = []
        head = self.title(self.record.get("table_id"))
        for g in groups:
            part: list[int] = []
            for r in g:
                if part and len(tokenizer("\n".join([head, *map(self.line, [*part, r])]))) > most:
                    out.append(part)
                    part = []
                part = [*part, r]
            if part or not g:
                out.append(part)
        return out


def table_chunks(record: dict, rid: str, index: int, matrix: list[list], sizes, tokenizer, first: int) -> list[dict]:
    """Chunks of one table record: the whole table if it is small, else its logical groups; each keeps the whole matrix."""
    t = Table(record, matrix)
    out = []
    page = None if record.get("page_number") is None else int(record["page_number"])
    for n, rows in enumerate(t.within(t.groups(sizes.small_table), sizes.most, tokenizer)):
        about = [f"{k}={_t(record[k])}" for k in ("table_title", "table_context") if record.get(k)]
        text = "\n".join([t.title(record.get("table_id") or rid), *about, *map(t.line, rows)])
        lead = t.filled[rows[0]] if rows else []
        used = [matrix[r] for r in rows if matrix[r]]
        cells_of = [*matrix[: t.heads], *(matrix[r] for r in rows)]
        out.append({
            "chunk_id": chunk_id(rid, "table", first + n, text, []), "parent_record_id": rid, "source_record_ids": [rid], "source_format": _t(record.get("source_format")),
            "page_start": page, "page_end": page, "section_path": f"page:{page}" if page is not None else t.where,
            "chunk_type": "table" if len(rows) == len(t.body) else "table_group", "chunk_text": text, "search_text": text, "token_count": len(tokenizer(text)),
            "source_token_count": len(tokenizer("\n".join(_t(c) for row in cells_of for c in row))), "overlap_from": None, "overlap_token_count": 0, "boundary_reason": "table_group",
            "table_id": _t(record.get("table_id")) or rid, "header_row_count": t.heads, "row_indices": rows, "column_headers": t.labels,
            "row_labels": [x for row in used if (x := _cell(row, 0))], "parent_row_labels": [_cell(row, 0) for row in used if not _has_number(row)],
            "measure_name": "revenue" if "revenue" in t.about else None,
            "value_kind": "monetary" if any(w in t.about for w in ("crore", "million", "billion", "revenue", "sales")) else "numeric",
            "period_years": sorted({int(y) for x in t.labels for y in re.findall(r"\b(?:19|20)\d{2}\b", x)}),
            "table_title": record.get("table_title"), "table_context": record.get("table_context"), "statement_scope": record.get("statement_scope"),
            "table_header": matrix[: t.heads], "row_matrix": cells_of, "raw_matrix": matrix, "raw_matrix_sha256": t.digest,
            "source_record_index": index, "source_location": t.where,
            "group_key": ";".join(f"{t.labels[k]}={v}" for k in t.keys if (v := _cell(lead, k))),
        })
    return out
