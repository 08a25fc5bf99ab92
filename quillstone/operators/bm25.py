"""BM25 over a materialised inverted index, for one query or many at once.

Statistics (documents, average length, document frequency) are of the whole corpus and kept apart from the chunks, so a
filter pushed into the scan can't change a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERIC_TERMS, bm25_terms, normal_ascii, phrase_windows, text_of

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, length), df (term, df), totals (n, avgdl: one row), chunks (id, kind, text, attributes)."""

    postings: DataFrame
    df: DataFrame
    totals: DataFrame
    chunks: DataFrame
    stored: bool = True

    def of_terms(self, wanted: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
        """(postings, df) with all that wanted (term) asks for: of an index that isn't stored, one pass over the texts keeps these terms only."""
        if self.stored:
            return self.postings, self.df
        some = F.broadcast(wanted) if wanted.limit(most + 1).count() <= most else wanted
        tf = _counted(_term_rows(self.chunks).join(some, "term", "left_semi"))
        return tf, tf.groupBy("term").agg(F.count("*").alias("df"))

    def write(self, path: str) -> Index:
        """Postings bucketed by term range, so that a query reads few row groups."""
        for name in ("postings", "df", "totals", "chunks"):
            out = getattr(self, name)
            out = out.repartitionByRange("term").sortWithinPartitions("term") if "term" in out.columns else out
            out.write.mode("overwrite").parquet(f"{path}/{name}")
        return Index.read(self.postings.sparkSession, path)

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "df", "totals", "chunks")))


def _term_rows(chunks: DataFrame) -> DataFrame:
    terms = chunks.select("id", bm25_terms("text").alias("terms")).withColumn("length", F.size("terms"))
    return terms.select("id", "length", F.explode("terms").alias("term"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(id, length, term, tf) of chunks (id, text): one shuffle on id and term, counts combined map-side."""
    return _counted(_term_rows(chunks))


def build(chunks: DataFrame, kind: str = "chunk_type") -> Index:
    """Index of chunks (id, text or search_text and chunk_text, attributes). Chunks without id are left out."""
    have = set(chunks.columns)
    if "text" not in have:  # tables are searched by their projection
        tabular = F.coalesce(F.col(kind), F.lit("")).startswith("table")
        chunks = chunks.withColumn("text", F.when(tabular, F.col("search_text")).otherwise(F.col("chunk_text")))
    chunks = chunks.where("id is not null")
    chunks = chunks if kind in have else chunks.withColumn(kind, F.lit("text"))
    tf = term_frequencies(chunks)
    totals = chunks.select(F.size(bm25_terms("text")).alias("length")).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))
    return Index(tf.select("term", "id", "tf", "length"), tf.groupBy("term").agg(F.count("*").alias("df")), totals, chunks, stored=False)


def query_terms(queries: DataFrame, filters: dict | None = None) -> DataFrame:
    """(query_id, term) of queries (query_id, query); terms of filter values say nothing more and are left out."""
    terms = F.array_distinct(bm25_terms("query"))
    for value in (filters or {}).values():
        if value is not None:
            terms = F.array_except(terms, bm25_terms(F.lit(str(value))))
    return queries.select("query_id", F.explode(terms).alias("term"))


def matches(chunks: DataFrame, filters: dict | None) -> DataFrame:
    """Equality on every filter that has a value; a filter of another type than the column matches nothing, as stated types are strict."""
    kinds = dict(chunks.dtypes)
    for name, value in (filters or {}).items():
        if value is None:
            continue
        text = kinds.get(name, "string") == "string"
        chunks = chunks.where(F.col(name) == F.lit(value) if name in kinds and text == isinstance(value, str) else F.lit(False))
    return chunks


def scores(index: Index, queries: DataFrame, filters: dict | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every chunk that has a term of the query."""
    tf, length, n, df = (F.col(c).cast("double") for c in ("tf", "length", "n", "df"))
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    below = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / F.greatest(F.col("avgdl"), F.lit(1e-12)))
    asked = query_terms(queries, filters)
    postings, known = index.of_terms(asked.select("term").distinct())
    hit = asked.join(known, "term").join(postings, "term").crossJoin(F.broadcast(index.totals))  # totals: one row
    if filters:
        hit = hit.join(matches(index.chunks, filters).select("id"), "id", "left_semi")
    return hit.groupBy("query_id", "id").agg(F.sum(idf * tf * F.lit(k1 + 1.0) / F.greatest(below, F.lit(1e-12))).alias("score"))


def boosted(index: Index, scored: DataFrame, query: str, filters: dict | None = None, kind: str = "chunk_type") -> DataFrame:
    """Scores of one query with what tables, metric words and whole phrases add, in that order; (query_id, id, score)."""
    spark = scored.sparkSession
    one = spark.createDataFrame([(0, query)], "query_id int, query string")
    terms = [r.term for r in query_terms(one, filters).collect()]  # of one query
    metric = sorted(t for t in set(terms) if len(t) > 2 and not t.isdigit() and t not in GENERIC_TERMS)
    c = scored.join(index.chunks, "id")
    body = F.col("search_text") if "search_text" in index.chunks.columns else F.lit(None)
    body = F.coalesce(F.when(text_of(body) != "", body), F.col("chunk_text") if "chunk_text" in index.chunks.columns else F.col("text"))
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    own = F.array_distinct(bm25_terms(body))
    share = F.size(F.array_intersect(arr(sorted(set(terms))), own)).cast("double") / max(len(set(terms)), 1)
    score = F.when(F.coalesce(F.col(kind), F.lit("")).startswith("table"), F.col("score") * (F.lit(2.0) + F.lit(0.75) * share)).otherwise(F.col("score"))
    score = score + F.lit(80.0) * F.size(F.array_intersect(arr(metric), own))
    spaced = F.concat(F.lit(" "), normal_ascii(body), F.lit(" "))
    bonus = F.lit(0.0)
    for phrase, content in phrase_windows(query):
        if not metric or set(metric) & set(phrase.split()):
            bonus = bonus + F.when(spaced.contains(f" {phrase} "), 24.0 * len(phrase.split()) + 16.0 * content).otherwise(0.0)
    return c.select("query_id", "id", (score + F.least(bonus, F.lit(420.0))).alias("score"))


def top(scored: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The k best of each query with their rank; ties by id. Spark limits each partition before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if by is None else by, "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, filters: dict | None = None) -> DataFrame:
    if k <= 0:
        return scores(index, queries, filters).withColumn("rank", F.lit(0)).limit(0)
    return top(scores(index, queries, filters), k)


def company_aliases(chunks: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(alias, company_id): each company's id, name and ticker in lower case, and extra ones by id; the least id where two share one."""
    have = set(chunks.columns)
    if "company_id" not in have:
        return chunks.sparkSession.createDataFrame([], "alias string, company_id string")
    company = F.trim(F.col("company_id").cast("string"))
    names = [F.trim(F.col(c).cast("string")) for c in ("company_id", "company_name", "ticker") if c in have]
    found = chunks.select(company.alias("company_id"), F.explode(F.array(*names)).alias("alias"))
    if extra:
        more = chunks.sparkSession.createDataFrame([(k.lower(), a) for k, names in extra.items() for a in names], "__key string, alias string")
        known = chunks.select(company.alias("company_id")).distinct()
        found = found.unionByName(known.join(F.broadcast(more), F.lower("company_id") == F.col("__key")).select("company_id", "alias"))
    return found.where("company_id <> '' and alias <> ''").groupBy(F.lower("alias").alias("alias")).agg(F.min("company_id").alias("company_id"))


def known_values(chunks: DataFrame) -> DataFrame:
    """(kind, value): the distinct fiscal years, formats and report types of chunks; years that are no number are left out."""
    have = set(chunks.columns)
    year = F.expr("string(try_cast(fiscal_year as int))") if "fiscal_year" in have else F.lit(None).cast("string")
    other = {c: F.trim(F.col(c).cast("string")) if c in have else F.lit(None).cast("string") for c in ("source_format", "report_type")}
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in ({"fiscal_year": year} | other).items()))
    return chunks.select(F.inline(pairs)).where("value <> ''").distinct()
