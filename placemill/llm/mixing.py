"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the fractional number of copies target / source size. The whole part is taken as it is. The
fractions are paired: a pair moves mass (copies times words) from one to the other, in a random direction whose odds
keep each expectation, until one of them is 0 or 1. A group so rounds all of its documents but one, and its total of
words stays as it was. The groups' leftovers meet in the next level of a reduction tree, until one is left per source,
which is rounded by its own odds. Large documents are paired first, so the one left over is among the smallest, and a
source misses its target by less than that document's size.

Levels are as many as log_fan(documents of the largest source). Groups are dealt by hash within a source, so a source
with a third of all rows gets a third of the groups; no task holds more than about `fan` rows of a group.

Targets are shares by weight; what a source can't hold goes to the others, round by round. The rounds need a few sums over
the sources, which are one row each.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own, after all others;
a null id is an id like any other; repeated rows are documents of their own, taken equally often but for one copy; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import Run, cut, doc_hash, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which targets are made on the driver, from one row each; beyond that they are made in tables, alike.
MAX_SOURCES = 100_000
_PART = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[int], cap: int) -> list[Fraction]:
    """Shares of the total by weight; what a source can't hold (cap times its size) goes to the others by weight."""
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(cap * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def targets(found: DataFrame, weights: Sequence[int], cap: int, fan: int, most: int, run: Run) -> DataFrame:
    """s (source), source_size, target, whole, p, groups for each row (source, size, n) of found."""
    if found.limit(most + 1).count() <= most:
        rows = sorted(found.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        each = fill_targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
        plan = []
        for r, target in zip(rows, each, strict=True):
            times = target / r["size"] if r["size"] else Fraction(0)
            plan.append((r["source"], r["size"], float(target), int(times), float(times - int(times)), max(1, -(-r["n"] // fan))))
        return found.sparkSession.createDataFrame(plan, "s string, source_size long, target double, whole long, p double, groups long")
    # places in the order: within a sorted part, and what the parts before it hold
    ordered = run.cut(found.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for r in sorted(ordered.groupBy("part").count().collect()):
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    place = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33) + F.create_map(*offsets)[F.col("part")]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = run.cut(ordered.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "n", weight.cast("long").alias("weight")))
    exact = lambda c: F.col(c).cast("decimal(19, 0)")
    total, all_ = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    share, n_over, over = Fraction(total, all_), -1, F.lit(False)
    while True:
        over = exact("source_size") * F.lit(cap * share.denominator).cast("decimal(19, 0)") < exact("weight") * F.lit(share.numerator).cast("decimal(19, 0)")
        n, held, gone = rows.filter(over).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == n_over or gone == all_:
            break
        n_over, share = n, Fraction(total - cap * held, all_ - gone)
    times = F.when(over, float(cap)).when(F.col("source_size") > 0, F.col("weight") * float(share) / F.col("source_size")).otherwise(0.0)
    target = F.when(over, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * float(share))
    return run.cut(rows.select("s", "source_size", target.alias("target"), F.floor(times).alias("whole"), (times - F.floor(times)).alias("p"), F.greatest(F.ceil(F.col("n") / fan), F.lit(1)).alias("groups")))


def _pivot(p: np.ndarray, w: np.ndarray, h: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Fractions rounded to 0 or 1 but for one, whose index is returned; the sum of p * w stays."""
    draws = uniform(h ^ np.uint64(seed))
    p, w, at = p.tolist(), w.tolist(), 0
    for i in range(1, len(p)):
        a, b = at, i  # a: the one still open
        up, down = min((1 - p[a]) * w[a], p[b] * w[b]), min(p[a] * w[a], (1 - p[b]) * w[b])
        if draws[i] * (up + down) < down:  # mass moves from b to a
            full = (1 - p[a]) * w[a] <= p[b] * w[b]
            p[a], p[b] = (1.0, p[b] - up / w[b]) if full else (p[a] + up / w[a], 0.0)
            at = b if full else a
        else:
            empty = p[a] * w[a] <= (1 - p[b]) * w[b]
            p[a], p[b] = (0.0, p[b] + down / w[b]) if empty else (p[a] - down / w[a], 1.0)
            at = b if empty else a
    return np.clip(np.array(p), 0.0, 1.0), at


def _rounder(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        p, last = _pivot(rows["p"].to_numpy(float), rows["size"].to_numpy(float), h, seed + level)
        more = np.round(p)
        if key[2] == 1:
            more[last] = float(uniform(h[last : last + 1] ^ np.uint64(seed + 7919))[0] < p[last])
        rows["more"] = pd.array(more.astype(np.int64), dtype="Int64")
        if key[2] > 1:
            rows.loc[last, "more"] = pd.NA
        rows["p"] = p
        return rows

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, fan: int = 4096, seed: int = 20260101, most: int = MAX_SOURCES) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies, taken: one row per row of docs, which is read once."""
    run = Run(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    # rows that nothing tells apart are one stack, which takes copies as a whole and deals them out in the end
    stacks = run.cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("h", doc_hash("doc_id", "size", "source")))
    found = run.cut(stacks.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")))
    by_source = targets(found, weights, cap, fan, most, run)
    largest = by_source.agg(F.coalesce(F.max("groups"), F.lit(1))).first()[0]
    rows = stacks.join(F.broadcast(by_source) if found.limit(most + 1).count() <= most else by_source, stacks["source"].eqNullSafe(by_source["s"])).drop("s")
    part = F.col("m") * F.col("p")
    rows = rows.withColumn("whole", F.col("m") * F.col("whole") + F.floor(part)).withColumn("p", part - F.floor(part))
    settled = (F.col("p") == 0) | (F.col("size") == 0)
    done = rows.filter(settled).withColumn("more", F.lit(0).cast("long"))
    open_, level = rows.filter(~settled), 0
    schema = "doc_id {}, source string, size long, m long, h long, source_size long, target double, whole long, p double, groups long, more long".format(dict(stacks.dtypes)["doc_id"])
    while True:
        step = open_.withColumn("g", F.pmod(F.xxhash64("h", F.lit(level)), F.col("groups")))
        step = step.groupBy("source", "g", "groups").applyInPandas(_rounder(seed, level), "g long, " + schema).drop("g")
        if largest == 1:
            done = done.unionByName(step)
            break
        step = run.cut(step)
        done = done.unionByName(step.filter("more is not null"))
        open_ = step.filter("more is null").drop("more").withColumn("groups", F.ceil(F.col("groups") / fan))
        largest, level = -(-largest // fan), level + 1
    done = run.cut(done.withColumn("all", F.col("whole") + F.col("more")))
    out = ["doc_id", "source", "size", "source_size", "target"]
    one = done.filter("m = 1").select(*out, F.col("all").alias("copies"))
    # a high stack is dealt out in parts of at most _PART rows, by many tasks
    several = done.filter("m > 1").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(_PART).cast("long")))).repartition("h", "first")
    each = several.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _PART, F.col("m")) - 1)))
    each = each.select(*out, (F.floor(F.col("all") / F.col("m")) + F.when(F.col("i") < F.col("all") % F.col("m"), 1).otherwise(0)).alias("copies"))
    both = cut(one.unionByName(each).withColumn("taken", F.col("copies") * F.col("size")))
    run.clear()
    return both
