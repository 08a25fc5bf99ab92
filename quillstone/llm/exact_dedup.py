"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg, 1972), in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted into integer names, then
distinct pairs of adjacent names are, and so on until each text has one name; with the text's length that is its
identity, and it is free of collisions because every name stands for one content.

Only texts whose length and 64-bit fingerprint occur twice can have an equal; of the others these two, which no other
row has, are the identity, and they skip the naming. Distinct blocks and pairs combine map-side, and the joins that hand
out names are plain equi-joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, drop, stash

BLOCK = 256


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with an integer name for each distinct value of keys; names follow the sort order within a partition."""
    names = stash(pieces.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")
    return pieces.join(names, keys)


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, n, name) of texts (rid, n, bytes): n is the length of bytes, and equal (n, name) mean equal bytes."""
    cut = F.expr(f"transform(sequence(0L, (greatest(n, 1L) - 1L) div {block}L), i -> substring(bytes, cast(i * {block}L as int) + 1, {block}))")
    level = texts.select("rid", "n", F.posexplode(cut).alias("pos", "block"))
    level = stash(_named(level, ["block"]).select("rid", "n", F.col("pos").cast("long").alias("pos"), "name"), "level")
    done, width = [], block
    while True:
        done.append(level.where(F.col("n") <= width).select("rid", "n", "name"))
        rest = level.where(F.col("n") > width)
        if not rest.limit(1).count():
            break
        odd = F.col("pos") % 2 == 1
        pairs = rest.groupBy("rid", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right")
        )
        level = stash(_named(pairs, ["left", "right"]).select("rid", "n", "pos", "name"), "level")
        width *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256, identity.

    Texts are equal when they are after each run of white space became one space; null counts as empty. Of equal
    texts the row with the least doc_id stays, null ids last; of rows that also share the id, one does. identity is the
    text's length and name, or its length and fingerprint where no other row has both: equal for equal texts only. Texts
    are named whole, whatever their length. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    norm = docs.select("doc_id", normalised().alias("norm")).select(
        "doc_id", "norm", F.octet_length("norm").cast("long").alias("n"), F.xxhash64("norm").alias("h")
    )
    rows = stash(norm.select("doc_id", "n", "h", F.sha2("norm", 256).alias("text_sha256")), "rows")
    twice = stash(rows.groupBy("n", "h").count().where("count > 1").select("n", "h"), "twice")
    near = bitmap_filter(norm, F.col("h"), twice, F.col("h"), twice.count())
    kept = near.join(twice, ["n", "h"], "left_semi").withColumn("rid", F.monotonically_increasing_id())
    texts = stash(kept.select("rid", "doc_id", "n", F.col("norm").cast("binary").alias("bytes")), "texts")
    named = identities(texts.select("rid", "n", "bytes"), block)
    member = stash(named.join(texts.select("rid", "doc_id", F.sha2("bytes", 256).alias("text_sha256")), "rid"), "member")
    drop(texts)
    groups = member.groupBy("n", "name").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.count("*").alias("group_size"))
    groups = stash(groups, "groups")  # read back, so that AQE may split the join at a large group
    inside = member.join(groups, ["n", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256",
        F.concat_ws(":", F.lit("name"), F.col("n").cast("string"), F.col("name").cast("string")).alias("identity"),
    )
    alone = rows.join(twice, ["n", "h"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
        F.concat_ws(":", F.lit("only"), F.col("n").cast("string"), F.hex("h")).alias("identity"),
    )
    return alone.unionByName(inside)
