"""Shared pieces: the cluster's shared folder, written tables, size-bounded membership filters, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. Arrow batches get 1,000 rows unless the session asks for another number: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, one of our own in local mode (tests); on a cluster that raises."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; for when every result was read."""
    discard(spark, f"{shared_dir(spark)}/quillstone/{spark.conf.get('spark.app.id')}")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as __) for a while."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    Spark removes the shuffle files of the write as soon as it has ended.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*stashed: DataFrame) -> None:
    """Deletes written tables that no result reads any more."""
    for df in stashed:
        discard(df.sparkSession, df._stashed)


def bitmap_hits(df: DataFrame, key, keys: DataFrame, key_of_keys, n_keys: int, max_bits: int = 1 << 26) -> DataFrame:
    """df with __hit: false only where key is surely not among keys, found without a shuffle of df.

    A one-hash bitmap of at most max_bits bits is built in Spark and broadcast as (word, 64 bits) rows, so the
    broadcast side has at most max_bits / 64 rows whatever the input. A fuller bitmap only hits more rows.
    """
    bits = 1 << 16
    while bits < 64 * n_keys and bits < max_bits:
        bits *= 2

    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    words = (
        keys.select(slot(key_of_keys).alias("__s"))
        .groupBy(F.floor(F.col("__s") / 64).alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__s % 64 as int)))").alias("__bits"))
    )
    return (
        df.withColumn("__slot", slot(key))
        .withColumn("__word", F.floor(F.col("__slot") / 64))
        .join(F.broadcast(words), "__word", "left")
        .withColumn("__hit", F.expr("coalesce((shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1L) = 1L, false)"))
        .drop("__slot", "__word", "__bits")
    )


def bitmap_filter(df: DataFrame, key, keys: DataFrame, key_of_keys, n_keys: int) -> DataFrame:
    """Drops most rows of df whose key is not among keys, before any shuffle; an exact join must follow."""
    return bitmap_hits(df, key, keys, key_of_keys, n_keys).where("__hit").drop("__hit")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (u, v longs), by alternating star steps.

    Large-star hangs every greater neighbour of u on u's least neighbour, small-star the smaller ones; edges only
    ever point to smaller nodes, and the graph is a forest of stars when nothing changes (Kiveris et al., 2014).
    Every step groups and joins on one key; minima combine map-side and AQE splits a hot node's join.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            least = least.select("u", F.least("u", "m").alias("m"))
            hung = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hung = both.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
        return hung.where("u > v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        before, e = e, stash(star(star(e, True), False), "links")
        drop(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
