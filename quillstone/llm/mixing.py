"""Mixing sources to target weights by pivotal dependent rounding (Srinivasan, 2001; Deville and Tille, 1998).

A source's target over its size is the number of copies that each of its documents should get. The whole part is
given; the fractions duel in pairs: a random side takes mass (probability times words) from the other until one of the
two is 0 or 1, which keeps the expected copies of each and the words of both. In a bucket of documents the largest
duels with all smaller ones as one side, then the next, so that the one fraction it ends with is of a small document;
these residuals go through a tree of further duels, and the last one of a source is drawn. So the words taken from a
source differ from its target by less than its largest document, and as a rule by a few words.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

CAP, WEIGHTS, BUCKET, FAN = 3, (1, 2, 3), 4096, 512


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, ratio, n, rank) of sizes (source, source_size, n): shares of all words by weight, at most cap times the source's size.

    Sources are dealt out by range and ranked by their place in their part and the sources of the parts before. The level
    of all rises from the plain share: what capped sources leave is shared by the others, until no more reach their cap.
    Each step is one sum over the sources, and ends at least one of them.
    """
    by = F.col("source").asc_nulls_last()
    placed = stash(sizes.repartitionByRange(by).sortWithinPartitions(by).withColumn("place", F.monotonically_increasing_id()), "sources")
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    s = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(parts), "part")
    s = stash(s.select("source", "source_size", "n", rank.cast("int").alias("rank"), cycle.alias("w")), "ranked")
    level, capped = 0.0, -1
    while True:
        full = cap * F.col("source_size") < F.lit(level) * F.col("w")
        n, total, held, w = s.agg(F.sum(full.cast("long")), F.sum("source_size"), F.sum(F.when(full, cap * F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        if not w or n == capped:
            break
        capped, level = n, ((total or 0) - (held or 0)) / w
    target = F.least((cap * F.col("source_size")).cast("double"), F.lit(level) * F.col("w"))
    return s.select("source", "source_size", "n", "rank", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("ratio"))


def duel(w1: float, p1: float, w2: float, p2: float, draw: float) -> tuple[float, float]:
    """The two probabilities after mass moved until one is 0 or 1; w1 p1 + w2 p2 and the expectations stay."""
    up, down = min(w1 * (1 - p1), w2 * p2), min(w1 * p1, w2 * (1 - p2))
    if draw * (up + down) < down:
        return (1.0, p2 - up / w2 if w1 * (1 - p1) < w2 * p2 else 0.0) if w1 * (1 - p1) <= w2 * p2 else (p1 + up / w1, 0.0)
    return (0.0, p2 + down / w2 if w1 * p1 < w2 * (1 - p2) else 1.0) if w1 * p1 <= w2 * (1 - p2) else (p1 - down / w1, 1.0)


def pivot(weights: list[float], probabilities: list[float], rng: random.Random, last: bool) -> list[float]:
    """Probabilities that are 0 or 1, but for one at most; with last, that one is drawn too."""
    p, held = list(probabilities), None
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held is None:
            held = j
            continue
        p[held], p[j] = duel(weights[held], p[held], weights[j], p[j], rng.random())
        held = next((k for k in (held, j) if 0 < p[k] < 1), None)
    if last and held is not None:
        p[held] = float(rng.random() < p[held])
    return p


def settle(weights: list[float], p: float, rng: random.Random) -> list[float]:
    """pivot() for weights in falling order that share one probability.

    Each weight duels with all the smaller ones as one side, which shares what it gains or loses so that its members
    stay equal; so large documents are settled while small ones can make up for them, and what is left is small.
    """
    out, rest = [], float(sum(weights))
    for i, w in enumerate(weights):
        rest -= w
        if not 0 < p < 1 or rest <= 0 or w * (1 - p) > rest * p or w * p > rest * (1 - p):
            return out + pivot(weights[i:], [p] * (len(weights) - i), rng, False)
        taken = rng.random() < p
        out.append(float(taken))
        p = min(1.0, max(0.0, p - w * (1 - p) / rest if taken else p + w * p / rest))
    return out


def _round(seed: int, level: int, last: bool):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["unit_size", "h", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable")
        rng = random.Random(f"{seed} {level} {g['rank'].iloc[0]} {g['bucket'].iloc[0]}")
        p = g["p"].tolist()
        if level == 0:  # all of a source share one probability
            p = settle(g["unit_size"].tolist(), p[0], rng)
        return g.assign(p=pivot(g["unit_size"].tolist(), p, rng, last))

    return run


def mix_sources(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row of docs (doc_id, text, source, ...).

    size is the number of words (null text: 0); sources by code point, null last, weigh weights in turn. Rows that
    share doc_id and source are taken together, the same number of times. Nulls in doc_id or source are values like
    others. Documents without words get the whole copies only. No rows give no rows; reruns give the same mix.
    """
    rows = stash(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")
    plan = stash(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cap, weights), "targets")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    unit = rows.groupBy("doc_id", "source").agg(F.sum("size").alias("unit_size"))
    unit = unit.join(plan, same(unit, plan, "source")).drop(plan["source"])
    h = F.xxhash64("doc_id", "source", F.lit(seed))
    unit = unit.select("doc_id", "source", "unit_size", "rank", F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"), h.alias("h"), F.pmod(h, F.ceil(F.col("n") / bucket)).alias("bucket"))
    unit = unit.where("unit_size > 0 and p > 0")
    widest = plan.agg(F.max("n")).first()[0] or 0
    groups, level, decided = max(1, -(-widest // bucket)), 0, []
    schema = "doc_id long, source string, unit_size long, rank int, whole long, p double, h long, bucket long"
    while True:
        unit = stash(unit.groupBy("rank", "bucket").applyInPandas(_round(seed, level, groups == 1), schema), "rounded")
        decided.append(unit.where("p = 0 or p = 1"))
        if groups == 1:
            break
        unit = unit.where("p > 0 and p < 1").withColumn("bucket", F.expr(f"bucket div {FAN}"))
        groups, level = -(-groups // FAN), level + 1
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    done = done.select("doc_id", "source", F.col("p").cast("long").alias("extra"))
    got = rows.join(done, same(rows, done, "doc_id", "source"), "left").drop(done["doc_id"]).drop(done["source"])
    got = got.join(plan, same(got, plan, "source")).drop(plan["source"])
    copies = (F.floor("ratio") + F.coalesce("extra", F.lit(0))).cast("long")
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")
