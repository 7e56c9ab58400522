"""Mixing sources to target weights by the cube method.

Each source has a target number of words. A document is taken floor(target / source size) times for sure and once more
with the fractional rest as its inclusion probability. The cube method rounds these probabilities: it moves the vector
along the null space of the two balancing constraints (word total, document count) until a coordinate is 0 or 1. With
two constraints and three undecided documents of sizes a, b, c the null space is spanned by (b - c, c - a, a - b). The
flight runs in blocks, each of which leaves two undecided documents at most; these fly again in the next round, in
blocks of blocks, until a source's rest is one block, whose last LANDING documents are the landing problem: there only the
words are held, until one document is left, which is drawn.

While more than that (three in blocks that fly again) are undecided, the move is the one that takes the largest of them
along and the others against it, each by its p (1 - p) and so that both totals hold. So large documents are decided first,
and those that are left to land are among the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import WORD, materialize, numbered, row_hash, stable_seed

#: Documents a flight block has on average, those of a source that are landed together, and the slack under which a
#: probability counts as 0 or 1.
BLOCK, LANDING, EPS = 1024, 12, 1e-9


def _largest_first(sizes: list[float], probs: list[float], draw: Iterator[float], until: int, number: bool = True) -> list[int]:
    """Moves that hold the words, and the number unless told otherwise, and decide the largest documents first; changes probs and returns who is left, `until` mostly."""
    live = np.array(sorted((i for i, x in enumerate(probs) if 0 < x < 1), key=lambda i: (sizes[i], i)), np.int64)
    p, s = np.array(probs)[live], np.array(sizes)[live]
    s = s / max(1.0, float(s.mean()) if len(s) else 1.0)
    while len(p) > until:
        w = p[:-1] * (1 - p[:-1])
        n, first, second = w.sum(), (w * s[:-1]).sum(), (w * s[:-1] ** 2).sum()
        det = n * second - first * first
        if not number:
            u = np.r_[-w * s[-1] / first, 1.0] if first else np.r_[np.zeros(len(w)), 1.0]
        elif det > EPS * n * second:
            u = np.r_[-w * ((second - first * s[-1]) + (n * s[-1] - first) * s[:-1]) / det, 1.0]
        elif abs(s[-1] - s[0]) < EPS:
            u = np.r_[-w / n, 1.0]
        else:
            break  # all others are equal: no move of the largest holds both totals
        room = np.where(u > 0, 1 - p, p), np.where(u > 0, p, 1 - p)
        with np.errstate(divide="ignore", invalid="ignore"):
            up, down = (np.where(u != 0, x / np.abs(u), np.inf) for x in room)
        forward = next(draw) * (up.min() + down.min()) < down.min()
        ends = up if forward else down
        p = p + (ends.min() if forward else -ends.min()) * u
        hit = int(ends.argmin())
        p[hit] = float((u[hit] > 0) == forward)
        p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
        for i in np.flatnonzero((p == 0) | (p == 1)).tolist():
            probs[live[i]] = float(p[i])
        open_ = (p > 0) & (p < 1)
        live, p, s = live[open_], p[open_], s[open_]
    for i, x in zip(live.tolist(), p.tolist()):
        probs[i] = x
    return live.tolist()


def flight(sizes: list[float], probs: list[float], seed: int, land: bool) -> list[float]:
    """The cube method over one block: probabilities that are 0 or 1 but for two at most; with land, none is left."""
    p = [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in probs]
    draw = iter(np.random.Generator(np.random.PCG64(seed)).random(2 * len(p) + 4).tolist())
    waiting = _largest_first(sizes, p, draw, LANDING if land else 3)
    if land:
        for i in _largest_first(sizes, p, draw, 1, number=False):
            p[i] = 1.0 if next(draw) < p[i] else 0.0
        return p
    live: list[int] = []

    def move(units: list[int], direction: list[float]) -> None:
        up = min(((1 - p[i]) if d > 0 else -p[i]) / d for i, d in zip(units, direction) if d)
        down = min((p[i] if d > 0 else -(1 - p[i])) / d for i, d in zip(units, direction) if d)
        step = up if next(draw) * (up + down) < down else -down
        for i, d in zip(units, direction):
            x = p[i] + step * d
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x

    while True:
        live = [i for i in live if 0 < p[i] < 1]
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) < 3:
            break
        a, b, c = (sizes[i] for i in live)
        scale = max(abs(b - c), abs(c - a), abs(a - b))
        move(live, [(b - c) / scale, (c - a) / scale, (a - b) / scale] if scale else [1.0, -1.0, 0.0])
    return p


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size, n_units, target of each source of sizes(source, size, n).

    Sources by code point, null last, weigh `weights`, repeating. They share `share` of all sizes by weight; targets
    stop at `most` times their source's size and the excess is shared again. That fixed point is target =
    min(cap, level x weight), and the level follows from the sources in ascending order of cap / weight.
    The table has a row for each source, so one task may order it.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = (
        per.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", weigh)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("place", F.row_number().over(by_cap)).withColumn(
        "level",
        (F.sum("source_size").over(every) * share - (F.sum("cap").over(upto) - F.col("cap")))
        / (F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))),
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by("level", F.when(fits, F.col("place"))).over(every)
    return per.withColumn("level", level).select(
        "source",
        "source_size",
        "n_units",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    block = block.assign(words=block["size"] * block["n"]).sort_values(["words", "doc_id", "unit"], ascending=[False, True, True], na_position="first")
    first = block.iloc[0]
    seed = stable_seed(first["source"], int(first["block"]), int(first["round"]), "cube")
    block["prob"] = flight(block["words"].astype(float).tolist(), block["prob"].tolist(), seed, bool(first["last"]))
    return block.drop(columns="words")


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How often the mix takes each unit: doc_id, unit, n, source, size, source_size, target, copies.

    A unit is a distinct row (unit: its hash); n equal rows are taken or left together. A null text has size 0. Null
    sources are one source, the last. An empty table gives no rows.
    """
    units = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            row_hash(docs).alias("unit"),
            F.col(f"`{source_col}`").alias("source"),
            F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "unit")
        .agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n")),
        "mix-units",
    )
    targets = materialize(source_targets(units, weights, share, most), "mix-targets")
    largest = targets.agg(F.max("n_units")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A source's row is broadcast to its documents: as many rows as there are sources, checked by Spark against its limit.
    state = (
        units.join(targets, units["source"].eqNullSafe(targets["source"]))
        .select(units["*"], "source_size", "target", "n_units", ratio.alias("ratio"))
        .withColumn("sure", F.floor(F.col("ratio") + EPS).cast("int"))
        .withColumn("prob", F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure")))
        .drop("ratio")
    )
    rounds, left = 1, largest
    while left > BLOCK:
        rounds, left = rounds + 1, 2 * math.ceil(left / BLOCK)
    done, n_left = None, F.col("n_units")
    for k in range(rounds):
        blocks = F.lit(1) if k == rounds - 1 else F.ceil(n_left / BLOCK)
        state = (
            state.withColumn("block", F.pmod(F.xxhash64("doc_id", "unit", F.lit(k)), F.greatest(blocks, F.lit(1))))
            .withColumn("round", F.lit(k))
            .withColumn("last", F.lit(k == rounds - 1))
        )
        flown = materialize(state.groupBy("source", "block").applyInPandas(_fly, state.schema), f"mix-round{k}")
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        done = flown.filter(~open_) if done is None else done.unionByName(flown.filter(~open_))
        state = flown.filter(open_)
        n_left = 2 * F.ceil(n_left / BLOCK)
    copies = F.col("sure") + F.col("prob").cast("int")
    return done.select("doc_id", "unit", "n", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, **kw: object) -> DataFrame:
    """The mix itself: every row of docs as often as mix_plan takes it, with the columns of docs.

    The plan is joined to the rows by id and row hash; a row that is left out goes, one taken twice comes twice.
    """
    named = {"id_col": "doc_id", "source_col": "source", "text_col": "text"} | {k: str(v) for k, v in kw.items() if k.endswith("_col")}
    rows, own = numbered(docs, *named.values())
    columns = dict(zip(named, own))
    plan = mix_plan(rows, **kw | columns).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("unit").alias("_unit"), F.col("copies").alias("_copies"))
    # The plan grows with the documents, so both sides are shuffled at every size, not one broadcast while it is small.
    joined = rows.withColumn("_own", row_hash(rows)).join(
        plan.hint("shuffle_hash"), F.col(columns["id_col"]).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_unit"))
    )
    return joined.withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*rows.columns).toDF(*docs.columns)


def mix_report(docs: DataFrame, **kw: object) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every row of docs."""
    plan = mix_plan(docs, **kw)
    return plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies"
    )
