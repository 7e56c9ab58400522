"""Hard-negative mining: for an anchor and one of its positives, the best rows of other labels whose score lies in a window below the positive's.

The search is branch and bound over ball trees. Rows are dealt to blocks of bounded size (a large label has blocks of its
own, small labels share), the anchors to chunks of bounded size; a task holds one block and one chunk, builds the block's
ball tree and takes the chunk through it. For a ball of centre c and radius r, an anchor a's inner products lie within
a.c +- |a| r: a node is left out for an anchor when that range lies outside each of its windows, or strictly beneath the
k-th best that the window has already (a tie may still win by its id). The best of each block are merged by Spark.

Scores are exact: vectors are whole numbers, products are taken in doubles while their sums stay under 2^53 and in integers
beyond; bounds get a margin for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize

#: Rows in a leaf, in a block and in a chunk of anchors, about. A row is sent once for each chunk, an anchor once for each block.
LEAF, BLOCK, CHUNK = 128, 1 << 14, 1 << 14
#: Components are held within these bounds, scores within +-FAR.
LARGEST, FAR = float((1 << 31) - 1), 1 << 62


class BallTree:
    """Nodes over rows of x (whole numbers as doubles): ranges of a reordering, with centre and radius; halved down to LEAF rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.begin, self.end, self.left, self.centre, self.radius = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            here, rows = len(self.begin), x[self.order[a:b]]
            if parent >= 0:
                self.left[parent].append(here)
            centre = rows.mean(0)
            away = np.sqrt(((rows - centre) ** 2).sum(1))
            self.begin.append(a), self.end.append(b), self.left.append([]), self.centre.append(centre), self.radius.append(float(away.max()))
            if b - a <= leaf:
                continue
            one = rows[int(away.argmax())]
            other = rows[int(((rows - one) ** 2).sum(1).argmax())]
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows @ (one - other), middle)]
            todo += [(a, a + middle, here), (a + middle, b, here)]


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers held within +-FAR."""
    size = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(x).max()) if x.size else 0.0) * a.shape[1]
    if size < 2**53:
        return (a @ x.T).astype(np.int64)
    if size < FAR:
        return a.astype(np.int64) @ x.astype(np.int64).T
    whole = a.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(whole, -FAR, FAR).astype(np.int64)


def best_in_windows(
    x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray,
    a: np.ndarray, a_rows: np.ndarray, a_labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, leaf: int = LEAF,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and places in x of the k best rows of each anchor and window (low..high), -FAR - 1 and -1 where there are fewer.

    Only rows of the anchor's label count if `same`, the anchor itself left out, else only those of others. Ties go by ids.
    The third value is how many leaves were looked into for an anchor.
    """
    none = -FAR - 1
    score = np.full((len(a), low.shape[1], k), none, np.int64)
    place = np.full(score.shape, -1, np.int64)
    looked = 0
    if not len(x) or not len(a):
        return score, place, looked
    tree = BallTree(x, leaf)
    norm = np.sqrt((a * a).sum(1))
    todo = [(0, np.arange(len(a)))]
    while todo:
        node, who = todo.pop()
        centre, reach = tree.centre[node], norm[who] * tree.radius[node]
        at = a[who] @ centre
        margin = 1e-9 * (reach + norm[who] * float(np.sqrt(centre @ centre))) + 1e-6
        upper, lower = (at + reach + margin)[:, None], (at - reach - margin)[:, None]
        who = who[((upper >= low[who]) & (lower <= high[who]) & (upper >= score[who, :, -1]) & (low[who] <= high[who])).any(1)]
        if not len(who):
            continue
        if tree.left[node]:
            near = sorted(tree.left[node], key=lambda n: float((a[who] @ tree.centre[n]).mean()))
            todo += [(n, who) for n in near]  # the nearer one is taken first
            continue
        looked += len(who)
        inside = tree.order[tree.begin[node] : tree.end[node]]
        s = products(a[who], x[inside])
        fits = labels[inside][None, :] == a_labels[who][:, None]
        fits = fits & (rows[inside][None, :] != a_rows[who][:, None]) if same else ~fits
        s = np.where(fits, s, none)
        for w in range(low.shape[1]):
            t = np.where((s >= low[who, w, None]) & (s <= high[who, w, None]), s, none)
            top = t.max(1)
            some = np.flatnonzero((top > none) & (top >= score[who, w, -1]))
            if len(some):
                mine = who[some]
                all_scores = np.concatenate([score[mine, w], t[some]], axis=1)
                all_places = np.concatenate([place[mine, w], np.broadcast_to(inside, (len(some), len(inside)))], axis=1)
                order = np.lexsort((ids[all_places], -all_scores), axis=-1)[:, :k]
                score[mine, w] = np.take_along_axis(all_scores, order, 1)
                place[mine, w] = np.where(score[mine, w] > none, np.take_along_axis(all_places, order, 1), -1)
    return score, place, looked


def _matrix(lists: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled up with 0."""
    flat = lists.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = max(int(sizes.max()) if len(sizes) else 0, width, 1)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _search(k: int, same: bool):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return _FOUND.empty_table()
        x, a = _matrix(rows["q"]), _matrix(anchors["q"])
        wide = max(x.shape[1], a.shape[1])
        x, a = np.pad(x, ((0, 0), (0, wide - x.shape[1]))), np.pad(a, ((0, 0), (0, wide - a.shape[1])))
        if same:
            low, high = np.full((len(a), 1), -FAR), np.full((len(a), 1), FAR)
        else:
            low, high = _matrix_of_longs(anchors["low"], 1), _matrix_of_longs(anchors["high"], 0)
        ids, row = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        score, place, _ = best_in_windows(x, ids, row, rows["label"].to_numpy(), a, anchors["row"].to_numpy(), anchors["label"].to_numpy(), low, high, k, same)
        i, w, j = np.nonzero(place >= 0)
        at = place[i, w, j]
        return pa.table({"anchor": anchors["row"].to_numpy()[i], "window": w.astype(np.int32), "vec_id": ids[at], "score": score[i, w, j]}, _FOUND)

    return search


def _matrix_of_longs(lists: pa.ChunkedArray, missing: int) -> np.ndarray:
    flat = lists.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.full((len(sizes), max(int(sizes.max()), 1)), missing, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat.flatten().to_numpy()
    return out


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor long, window int, vec_id long, score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, q of the rows that take part: labels moved on where vec_id is divisible by 7, components floor(256 x)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    label = F.col("label").cast("long")
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * 256))).cast("int")).alias("q"),
    )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of found for each of keys, numbered from 1 as rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings has vec_id, embedding, label; other columns do not matter. Rows with a null vec_id, label or vector, or with a
    null or non-finite component, take no part. Anchors are the rows whose vec_id is divisible by `every`, their positives the
    best other rows of their label, their negatives the best rows of other labels with
    least x positive score <= 100 x negative score <= most x positive score; ties go to the smaller vec_id. A repeated row is
    a row of its own (an anchor's copy is one of its positives). Vectors of different lengths are filled up with 0; components
    are held within 32 bits, scores within +-2^62. An anchor without positives, a positive without negatives, and an empty table
    give no rows.
    """
    rows = materialize(prepared(embeddings), "negatives-rows")
    sizes = rows.groupBy("label").agg(F.count("*").alias("_n"))
    parts = F.when(F.col("_n") > block, F.ceil(F.col("_n") / block)).otherwise(0)
    small = F.coalesce(F.sum(F.when(F.col("_n") <= block, F.col("_n"))), F.lit(0))
    shared, large = sizes.agg(F.ceil(small / block).cast("int"), F.coalesce(F.sum(parts), F.lit(0)).cast("int")).first()  # two numbers
    chunks = max(1, -(-rows.filter(F.col("vec_id") % every == 0).count() // chunk))
    # Blocks 0..shared-1 hold small labels, the next ones are large labels' own; a large label has over `block` rows, so these are few.
    own = sizes.filter(parts > 0).withColumn("_from", shared + F.sum(parts).over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)) - parts)
    home = sizes.filter(parts == 0).withColumn("_from", F.pmod(F.xxhash64("label"), F.lit(max(shared, 1)))).unionByName(own)
    home = materialize(home.select("label", F.col("_from").cast("int").alias("_from"), F.greatest(parts, F.lit(1)).cast("int").alias("_parts")), "negatives-blocks")

    placed = rows.join(home, "label")
    in_block = (F.col("_from") + F.pmod(F.xxhash64("row"), F.col("_parts"))).cast("int")
    blocks = placed.select("row", "vec_id", "label", "q", in_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    blocks = blocks.groupBy("block", "chunk")
    in_chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")

    anchors = placed.filter(F.col("vec_id") % every == 0)
    anchors = materialize(anchors.select(F.col("row"), F.col("vec_id").alias("anchor_id"), "label", "q", "_from", "_parts", in_chunk), "negatives-anchors")
    near = anchors.select("row", "label", "q", "chunk", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_parts") - 1)).alias("block"))
    good = _first(blocks.cogroup(near.groupBy("block", "chunk")).applyInArrow(_search(positives, True), _FOUND_DDL), ["anchor"], positives)
    good = materialize(good.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("_rank")), "negatives-positives")

    low, high = _ceil_share(F.col("positive_score"), least), _floor_share(F.col("positive_score"), most)
    window = F.sort_array(F.collect_list(F.struct("_rank", low.alias("low"), high.alias("high")))).alias("_w")  # at most `positives`
    asked = anchors.join(good.groupBy(F.col("anchor").alias("row")).agg(window), "row")
    asked = asked.select("row", "label", "q", "chunk", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"), F.explode(F.sequence(F.lit(0), F.lit(max(shared + large, 1) - 1))).alias("block"))
    bad = _first(blocks.cogroup(asked.groupBy("block", "chunk")).applyInArrow(_search(negatives, False), _FOUND_DDL), ["anchor", "window"], negatives)
    out = bad.withColumn("_rank", F.col("window") + 1).join(good, ["anchor", "_rank"]).join(anchors.select(F.col("row").alias("anchor"), "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_share(score: Column, percent: int) -> Column:
    """floor(percent x score / 100), without leaving the range of a long."""
    rest = F.pmod(score, F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * percent + F.floor(rest * percent / 100)


def _ceil_share(score: Column, percent: int) -> Column:
    return -_floor_share(-score, percent)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor, a.label AS own, b.vec_id AS other, b.label AS label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor, other AS positive, score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
neg AS (
  SELECT pos.anchor AS anchor_id, pos.positive AS positive_id, s.other AS negative_id, pos.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY pos.anchor, pos.positive ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM pos JOIN s ON s.anchor = pos.anchor AND s.own <> s.label AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
