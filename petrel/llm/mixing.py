"""Mixing sources to token targets by entropy balancing.

Each document gets the rate exp(lambda_s * x) with x = size / (size + smooth): the
solution of a convex problem, to stay as near to rate 1 in relative entropy (a document
of n words weighing n + smooth) as the token constraint of its source s allows, with
rates at most ``cap``.  The dual is solved by Newton iterations whose gradient and
curvature are distributed sums over the table of (source, size) counts, which is what
the rates depend on; a bracket keeps each step safe where the cap flattens the dual.
Rates become copies by carrying the words gained or lost from the longest documents to
the shortest, so a source's words miss its target by about half of its shortest document.

The driver sees one row per source; more than ``most_sources`` of them are refused.  Reruns agree: who gets the odd copy depends on a
hash of the id.

Edge cases: a null text has 0 words and its document is taken once (0 words); a null
source is a source, last in order; repeated rows are documents of their own; an empty
table gives no rows; a corpus without words takes none.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .numbering import numbered
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], cap: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess is shared anew by weight."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest = Fraction(sum(sizes))
    while any(x is None for x in out):
        free = [i for i, x in enumerate(out) if x is None]
        total = sum(Fraction(weights[i]) for i in free)
        share = {i: rest * Fraction(weights[i]) / total for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        for i in over or free:
            out[i] = Fraction(cap * sizes[i]) if over else share[i]
        rest -= sum(out[i] for i in over)
    return [float(x) for x in out]


def _rate(lam: F.Column, size: F.Column, smooth: float, cap: int) -> F.Column:
    return F.least(F.lit(float(cap)), F.exp(lam * size / (size + smooth)))


def solve_dual(counts: DataFrame, targets: dict[int, float], sizes: dict[int, int], smooth: float, cap: int, steps: int = 60) -> dict[int, float]:
    """lambda of each source: Newton steps on distributed sums over counts (sid, size, n)."""
    spark = counts.sparkSession
    top = math.log(cap) * (1 + smooth) + 1e-9
    lam, low, high = {}, {}, {}
    for s, t in targets.items():
        if sizes[s] > 0 and t > 0:
            r = math.log(t / sizes[s])
            lam[s], low[s], high[s] = r, min(r, r * (1 + smooth)) - 1e-9, top
            if t >= cap * sizes[s]:
                lam[s] = low[s] = top
        else:
            lam[s], low[s], high[s] = 0.0, 0.0, 0.0
    for _ in range(steps):
        table = spark.createDataFrame(list(lam.items()), "sid int, lam double")
        r = _rate(F.col("lam"), F.col("size"), smooth, cap)
        words = F.col("n") * F.col("size") * r
        slope = F.when(r < cap, words * F.col("size") / (F.col("size") + smooth)).otherwise(F.lit(0.0))
        sums = {x["sid"]: (x["g"], x["h"]) for x in counts.where("size > 0").join(table, "sid").groupBy("sid").agg(F.sum(words).alias("g"), F.sum(slope).alias("h")).collect()}
        settled = True
        for s, (g, h) in sums.items():
            miss = g - targets[s]
            if abs(miss) <= 1e-9 * targets[s] or high[s] - low[s] < 1e-12:
                continue
            settled = False
            low[s], high[s] = (lam[s], high[s]) if miss < 0 else (low[s], lam[s])
            step = lam[s] - miss / h if h > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if settled:
            return lam
    raise RuntimeError(f"the dual did not settle in {steps} steps")


def _round(cap: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        out, owed = [], 0.0
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            if size == 0:
                out.append(n)
                continue
            owed += rate * n * size
            copies = min(cap * n, max(0, math.floor(owed / size + 0.5)))
            owed -= copies * size
            out.append(copies)
        return cells[["sid", "size", "n"]].assign(copies=out)

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, smooth: float = 16.0, most_sources: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """(id, size, source, source_size, target, copies) for every row; weights repeat over the sources in code point order."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    narrow = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")), "narrow")
    hist = scratch.save(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    n_sources = hist.select("source").distinct().count()
    if n_sources > most_sources:
        raise ValueError(f"{n_sources} sources; the driver takes {most_sources} at most (most_sources)")
    found = [(r[0], r[1]) for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(s) for _, s in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap)
    named = spark.createDataFrame([(i, s, z, t) for i, ((s, z), t) in enumerate(zip(found, targets, strict=True))], "sid int, source string, source_size long, target double")
    counts = scratch.save(hist.join(named, hist["source"].eqNullSafe(named["source"])).select("sid", "size", "n"), "counts")
    lam = solve_dual(counts, dict(enumerate(targets)), dict(enumerate(sizes)), smooth, cap)
    table = spark.createDataFrame([(i, lam[i]) for i in range(len(found))], "sid int, lam double")
    rates = counts.join(table, "sid").withColumn("rate", _rate(F.col("lam"), F.col("size"), smooth, cap))
    cells = rates.groupBy("sid").applyInPandas(_round(cap), "sid int, size long, n long, copies long")
    cells = scratch.save(cells.join(named, "sid"), "cells")
    keyed = narrow.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")))
    keyed = keyed.select("id", "d.source", "d.size", "sid", "n", "copies", "source_size", "target", F.xxhash64("id").alias("rank"))
    keyed = scratch.save(keyed.withColumn("part", F.expr("pmod(rank, 1 + n div 500)")), "keyed")
    scratch.drop("narrow", "hist", "counts")
    out = numbered(keyed, ["sid", "size"], "part", ["rank", "id"], "place")
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", F.expr("copies div n + CASE WHEN place < copies % n THEN 1 ELSE 0 END").alias("copies"))
