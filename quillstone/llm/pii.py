"""Personal data, and terms that disclose it, in DataFrame operations only.

Base spans are patterns checked by value. Terms are then judged by information theory (Sanchez and Batet, 2016): the
pointwise mutual information of a term and a protected entity, over the entity's own information content, says how much
of the entity the term gives away. Co-occurrence and the term's documents are both counted over whole texts, by distinct
documents. A value that stands in too few of them to tell is generalised: all such values of a kind are one entity, so
the words that go with, say, telephone numbers are found where no number occurs twice. Where a term gives away more than
a threshold, its occurrences in the documents of the entity are spans too; sanitise() generalises entities to their kind
and removes such terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, bitmap_hits, stash

#: Share of an entity's information content that a term may give away; distinct documents with both that it takes to tell,
#: of a value (in one alone every rare word would) and of a kind.
DISCLOSED, SUPPORT, KIND_SUPPORT = 0.9, 2, 3
#: Spans are appended to runs of so many, since every append copies its array.
RUN = 512

_C, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: (pattern in possessive form, so that long runs take linear time and constant stack; quick test; test of a match m)
KINDS = {
    "email": (rf"(?:\G|(?<!{_C})){_C}++@{_D}++(?:\.{_D}++)++", "t like '%@%'", "true"),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"t rlike r'[0-9]\.[0-9]'",
        r"forall(split(x.m, r'\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    ),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])++",
        r"t rlike r'[0-9](?:[\x20-]?[0-9]){11}'",
        "length(regexp_replace(x.m, '[^0-9]', '')) between 12 and 19 and pmod(aggregate(sequence(1, length(regexp_replace(x.m, '[^0-9]', ''))), 0, "
        "(s, i) -> s + if(i % 2 = 1, 1, 2) * int(substring(reverse(regexp_replace(x.m, '[^0-9]', '')), i, 1)) - if(i % 2 = 0 and int(substring(reverse(regexp_replace(x.m, '[^0-9]', '')), i, 1)) > 4, 9, 0)), 10) = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"t rlike r'\+[0-9]'", "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15"),
}
_SPAN = "struct<start:bigint,ord:int,stop:bigint,kind:string,value:string>"


def _fold(items: str, length: str, keep: str, span: str) -> str:
    """SQL: span of each x of items that keep holds for, at being the place of its first character; every x is length long."""
    state = f"struct<pos:bigint,run:array<{_SPAN}>,runs:array<array<{_SPAN}>>>"
    more = f"if(size(a.run) < {RUN}, named_struct('pos', a.pos + {length}, 'run', array_append(a.run, {span}), 'runs', a.runs), named_struct('pos', a.pos + {length}, 'run', array({span}), 'runs', array_append(a.runs, a.run)))"
    return f"""aggregate({items}, cast(named_struct('pos', 0L, 'run', array(), 'runs', array()) as {state}),
        (a, x) -> if({keep}, {more}, named_struct('pos', a.pos + {length}, 'run', a.run, 'runs', a.runs)),
        a -> flatten(array_append(a.runs, a.run)))"""


def _found(ord: int, kind: str) -> str:
    """SQL: the spans of one kind in t, from the pieces between matches and the matches."""
    pattern, quick, valid = KINDS[kind]
    at = "a.pos + length(x.s)"
    span = f"named_struct('start', {at}, 'ord', {ord}, 'stop', {at} + length(x.m), 'kind', '{kind}', 'value', x.m)"
    pieces = f"zip_with(split(t, r'{pattern}', -1), concat(regexp_extract_all(t, r'{pattern}', 0), array('')), (s, m) -> named_struct('s', s, 'm', m))"
    return f"if({quick}, {_fold(pieces, 'length(x.s) + length(x.m)', f"x.m <> '' and {valid}", span)}, cast(array() as array<{_SPAN}>))"


def joined(spans: str | Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with t (text, null as empty) and base: its spans by start, then kind."""
    every = ", ".join(_found(i, k) for i, k in enumerate(KINDS))
    return docs.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("base", F.expr(f"array_sort(concat({every}))"))


_BARE = r"regexp_replace(lower({}), r'^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '')"


def _words(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., term): the distinct terms of each row of texts (t)."""
    bare = rf"filter(transform(split(t, r'[\x20\x09-\x0D]+'), w -> {_BARE.format('w')}), w -> length(w) > 2 and not w rlike '[0-9@]')"
    return texts.select(*keep, F.explode(F.expr(f"array_distinct({bare})")).alias("term"))


def _key() -> Column:
    """What texts share that are equal but for white space."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace("t", r"[\x20\x09-\x0D]+", " ")), 256))


def holdings(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(rid, first, entity, of_kind) of found (rid, t, base): what each row holds; first: the row stands for its copies.

    A value in at least support distinct documents is an entity, any other is one with all such values of its kind.
    """
    value = F.transform("base", lambda x: F.struct(x["kind"], F.concat_ws(":", x["kind"], F.when(x["kind"].isin("card", "phone"), F.regexp_replace(x["value"], "[^0-9]", "")).otherwise(F.lower(x["value"]))).alias("value")))
    keyed = found.select("rid", _key().alias("key"), F.array_distinct(value).alias("values")).dropDuplicates(["rid", "key"])
    first = keyed.groupBy("key").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    held = keyed.join(first, "rid", "left").select("rid", F.coalesce("first", F.lit(False)).alias("first"), F.inline("values"))
    held = stash(held, "held")
    often = held.where("first").groupBy("value").agg(F.count("*").alias("ne")).where(F.col("ne") >= support).select("value", F.lit(True).alias("often"))
    one = held.join(stash(often, "often"), "value", "left")
    return stash(one.select("rid", "first", F.when(F.col("often"), F.col("value")).otherwise(F.col("kind")).alias("entity"), F.col("often").isNull().alias("of_kind")).distinct(), "entities")


def disclosing(found: DataFrame, texts: DataFrame, share: float = DISCLOSED, support: int = SUPPORT, kind_support: int = KIND_SUPPORT, held: DataFrame | None = None) -> DataFrame:
    """(entity, term) pairs whose mutual information passes share of the entity's content.

    found has rid, t, base of texts with spans, texts all texts (t), held what holdings() gives. Every count is of distinct
    documents: texts that are equal but for white space are one. Terms are dropped early only where no count of pairs could
    make them pass.
    """
    held = (held or holdings(found, support)).where("first")
    texts = texts.withColumn("key", _key())
    alike = stash(texts.groupBy("key").agg((F.count("*") > 1).alias("again")), "keys")
    total = alike.count()
    least = F.when(F.col("of_kind"), kind_support).otherwise(support)
    of_entity = stash(held.groupBy("entity", "of_kind").agg(F.count("*").alias("ne")).where((F.col("ne") >= least) & (F.col("ne") < total)), "shared")
    rarest = of_entity.agg(F.min("ne"), F.max("ne")).first()
    if rarest[0] is None:
        return of_entity.select("entity", F.lit("").alias("term"))
    content = lambda n: F.log2(F.lit(float(total)) / n)
    inside = _words(found.join(held.select("rid").distinct(), "rid", "left_semi"), "rid").distinct()
    terms = stash(inside.groupBy("term").agg(F.count("*").alias("ni")).where(F.col("ni") >= min(support, kind_support)), "terms")
    # Only texts that may have copies need their key to be counted once; the terms of all others combine before the shuffle.
    again = alike.where("again")
    once = bitmap_hits(texts, F.col("key"), again, F.col("key"), again.count()).withColumn("key", F.when(F.col("__hit"), F.col("key")))
    every = bitmap_filter(_words(once, "key"), F.col("term"), terms, F.col("term"), terms.count())
    of_term = every.groupBy("term", "key").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)).alias("nt")).join(terms, "term")
    # nb is at most ne and ni: a term passes with no entity where it doesn't pass with the most or the least frequent one.
    of_term = of_term.where(content(F.col("nt")) >= share * content(F.lit(rarest[1])) - 1e-9).where(F.log2(F.col("ni") / F.col("nt")) >= (share - 1) * content(F.lit(rarest[0])) - 1e-9)
    of_term = stash(of_term, "rare")
    inside = bitmap_filter(inside, F.col("term"), of_term, F.col("term"), of_term.count()).join(of_term, "term")
    able = (content(F.col("nt")) >= share * content(F.col("ne")) - 1e-9) & (F.log2(F.col("ni") / F.col("nt")) >= (share - 1) * content(F.col("ne")) - 1e-9)
    both = held.join(of_entity, ["entity", "of_kind"]).join(inside, "rid").where(able).groupBy("entity", "of_kind", "term", "ne", "nt").agg(F.count("*").alias("nb")).where(F.col("nb") >= least)
    gives = F.log2(F.col("nb") * total / (F.col("nt") * F.col("ne"))) / content(F.col("ne"))
    return both.where(gives >= share).select("entity", "term")


def _rows(docs: DataFrame) -> DataFrame:
    """Rows of docs (rid, doc_id, text) with base, more (the term spans) and t, the latter two only where there are base spans, else sha."""
    base = base_spans(docs)
    spanned = F.size("base") > 0
    rows = stash(base.select("rid", "doc_id", "base", F.when(spanned, F.col("t")).alias("t"), F.when(~spanned, F.sha2("t", 256)).alias("sha")), "spans")
    found = rows.where("t is not null")
    held = holdings(found)
    told = stash(disclosing(found, docs.select(F.coalesce("text", F.lit("")).alias("t")), held=held), "told")
    words = bitmap_filter(_words(found, "rid"), F.col("term"), told, F.col("term"), told.count())
    mine = words.join(told, "term").join(held.select("rid", "entity"), ["rid", "entity"]).groupBy("rid").agg(F.collect_set("term").alias("terms"))
    span = f"named_struct('start', a.pos, 'ord', {len(KINDS)}, 'stop', a.pos + length(x), 'kind', 'term', 'value', x)"
    fold = _fold(r"regexp_extract_all(t, r'[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+', 0)", "length(x)", f"array_contains(terms, {_BARE.format('x')})", span)
    more = found.join(mine, "rid").select("rid", F.expr(fold).alias("more"))
    return rows.join(more, "rid", "left").withColumn("more", F.coalesce("more", F.expr(f"cast(array() as array<{_SPAN}>)")))


def _clean() -> Column:
    """t with entities replaced by [KIND] and terms removed; of spans that overlap the first counts. Pieces meet in runs, since every concat copies."""
    kept = "aggregate(array_sort(concat(base, more)), cast(named_struct('pos', 0L, 'run', array(''), 'runs', array()) as struct<pos:bigint,run:array<string>,runs:array<string>>), "
    piece = "concat(substring(t, int(a.pos) + 1, int(x.start - a.pos)), if(x.kind = 'term', '', concat('[', upper(x.kind), ']')))"
    step = f"(a, x) -> if(x.start < a.pos, a, if(size(a.run) < {RUN}, named_struct('pos', x.stop, 'run', array_append(a.run, {piece}), 'runs', a.runs), named_struct('pos', x.stop, 'run', array({piece}), 'runs', array_append(a.runs, array_join(a.run, ''))))), "
    return F.expr(f"{kept}{step}a -> concat(array_join(a.runs, ''), array_join(a.run, ''), substring(t, int(a.pos) + 1)))")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, clean_sha256 of every row of docs (doc_id, text, ...).

    Spans are kind:start:end in code points; clean_sha256 is of the text as sanitise() gives it. Null text is empty;
    repeated rows have the same spans; no rows give no rows; other columns are ignored. Texts are read whole, whatever
    their length.
    """
    rows = _rows(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()))
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_term"),
        F.coalesce("sha", F.sha2(_clean(), 256)).alias("clean_sha256"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of docs (doc_id, text, ...), entities replaced by [KIND] and disclosing terms removed.

    Of spans that overlap the first counts. Null text stays null; repeated rows are cleaned alike; other columns are left out.
    """
    source = stash(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "texts")  # ids are made once
    cut = _rows(source).where("t is not null").select("rid", _clean().alias("clean"))
    return source.join(cut, "rid", "left").select("doc_id", F.coalesce("clean", "text").alias("text"))
