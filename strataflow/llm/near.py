"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles: every pair of SHARE or more is a link.

SimHash comes first: what it links (fingerprints of three-word shingles within 3 bits, as in op8) is held against the full
shingle sets, and what stays makes the first groups. Fingerprints miss most pairs near SHARE, so an exact prefix join finds
the links between these groups. Two sets of Jaccard 4/5 or more have a common element among the first n - ceil(4n/5) + 1 of each, in any order that all
sets share (n: the set's own size). These prefixes are shuffled by shingle, so texts that share a bucket are the candidates
and no pair is lost; each is then held against its full shingle sets. Sizes and places in the prefixes rule out most
candidates before that. The order puts shingles last that many texts hold: a sample of texts names them. Which they are
decides how many candidates there are, never which links are found.

The join's candidates come in rounds so that a group of m near copies does not make m x m of them: first each text with its
bucket's hub, then the others; each round takes only pairs that the links before it have not joined. The hub is the text in
whose prefix the bucket's shingle comes first: rare shingles stand before it, so it has the fewest of its own and lies nearest
to what the group shares. Where the hubs leave too many pairs apart, others are drawn, as long as that helps. The last round
takes all pairs that are still apart: texts that share most of their prefixes and are not alike are compared each with each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.common import discard, lean, materialize, numbered, row_hash
from strataflow.llm.simhash import components, linked_nodes, shingle_hashes, word_line

#: The least Jaccard similarity of a link, as a fraction.
SHARE = (4, 5)
#: For the order only: one text in so many is sampled, a shingle in so many of these is frequent, so many are named at most.
SAMPLED, OFTEN, NAMED = 8, 3, 1 << 16
#: Bits that say which texts may be wanted: what they let through is joined exactly, so only texts in question are shuffled.
SLOTS = 1 << 24
#: More hubs are drawn while the last round would take over so many pairs a row of the buckets, and a draw saves a quarter of them.
ROOM = 4


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(word_line(text), shingle), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common)


def prefix(found: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first elements of a set: those not in often (sorted) by value, then the others by rank."""
    n = len(found)
    size = n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = found[np.argsort(np.where(often[at] == found, rank[at], 0), kind="stable")]
    return found[:size]


def _may_reach(n1: str, p1: str, n2: str, p2: str) -> Column:
    """Whether sets of sizes n1, n2 whose first common element is at the places p1, p2 can be similar enough."""
    most = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
    return most * (SHARE[0] + SHARE[1]) >= (F.col(n1) + F.col(n2)) * SHARE[0]


def _once(nodes: list[int], seen: set[int]) -> list[int]:
    """Places of the nodes that this task has not met."""
    out = []
    for i, node in enumerate(nodes):
        if node not in seen:
            seen.add(node)
            out.append(i)
    return out


def _wanted_bits(nodes: DataFrame) -> Broadcast:
    """A bit map with the slot of every node of nodes(node); SLOTS bits at any size."""
    slots = nodes.select(F.pmod("node", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    return nodes.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _may_want(bits: Broadcast, nodes: pa.Array) -> np.ndarray:
    slots = nodes.to_numpy() % SLOTS
    return (bits.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def _per_text(rows: DataFrame, schema: str, emit: Callable[[int, str], list[pa.Array]], bits: Broadcast | None = None) -> DataFrame:
    """emit's columns for rows(node, text), once for each node a task meets: copies are thinned before any shuffle."""
    names = [x.split()[0] for x in schema.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(_may_want(bits, batch.column(0))))
            nodes, texts = batch.column(0).to_pylist(), batch.column(1)
            parts = [emit(nodes[i], texts[i].as_py() or "") for i in _once(nodes, seen)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=names)

    return rows.mapInArrow(lean(mapped), schema)


def sketch(found: np.ndarray) -> bytes:
    """How many elements of a set fall into each of some n / 2 to n slots, a byte each; empty where a byte doesn't hold a count."""
    slots = 1 << max(6, (len(found) // 2).bit_length())
    counts = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(a: bytes, b: bytes) -> bool:
    """False only for sketches of sets that are not alike: a slot has no more common elements than the lesser count."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in sorted((a, b), key=len))
    y = y.reshape(-1, len(x)).sum(0)  # the slots of the smaller sketch are the low bits of the larger one's
    common = int(np.minimum(x, y).sum())
    return SHARE[1] * common >= SHARE[0] * (int(x.sum()) + int(y.sum()) - common)


def _of_nodes(pairs: DataFrame, rows: DataFrame, of: Callable[[str], bytes], name: str) -> DataFrame:
    """node, value (binary) of the text of each node in pairs(a, b)."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")
    texts = _per_text(rows, "node long, text string", lambda node, text: [pa.array([node], pa.int64()), pa.array([text], pa.string())], _wanted_bits(wanted))
    chosen = texts.join(wanted.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]).select("node", "text")
    found = materialize(_per_text(chosen, "node long, value binary", lambda node, text: [pa.array([node], pa.int64()), pa.array([of(text)], pa.binary())]), name)
    discard(wanted)
    return found


def _kept(pairs: DataFrame, values: DataFrame, test: Callable[[bytes, bytes], bool], name: str) -> DataFrame:
    """The pairs(a, b) whose nodes' values pass the test."""
    x, y = (values.select(F.col("node").alias(n), F.col("value").alias(v)) for n, v in (("a", "x"), ("b", "y")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Few pairs at a time: each carries two values.
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(lean(compared), "a long, b long"), name, spark_sql_execution_arrow_maxRecordsPerBatch="1000")


def _alike_pairs(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs(a, b) of nodes whose texts' shingle sets are similar enough."""
    sets = _of_nodes(pairs, rows, lambda text: shingle_set(text, shingle).tobytes(), "near-sets")
    found = _kept(pairs, sets, lambda x, y: alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), "near-verified")
    discard(sets)
    return found


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """_alike_pairs() of many pairs that are not.

    Sketches, a sixteenth of the sets' size at most, rule out most of these before the sets themselves are shuffled.
    """
    sketches = _of_nodes(pairs, rows, lambda text: sketch(shingle_set(text, shingle)), "near-sketches")
    likely = _kept(pairs, sketches, may_be_alike, "near-likely")
    found = _alike_pairs(likely, rows, shingle)
    discard(sketches, likely)
    return found


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs(a, b) whose nodes are not in one of groups(fp, label); a node may have none."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("fp").alias(end), F.col("label").alias(f"{end}_group")), end, "left")
    return pairs.filter(F.coalesce(F.col("a_group") != F.col("b_group"), F.lit(True))).select("a", "b")


def _grouped(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """buckets(token, node, n, pos, node0) with the group that the pairs found put each node into."""
    inside = materialize(buckets.select(F.col("node").alias("fp")).distinct().withColumn("label", F.col("fp")), "near-inside")
    joined = components(found, inside).select(F.col("fp").alias("node"), F.col("label").alias("group"))
    return materialize(buckets.join(joined, "node").select("token", "node", "n", "pos", "node0", "group"), "near-named")


def _left_apart(named: DataFrame) -> tuple[int, int]:
    """How many rows of named can be similar enough to a row of their size, and how many pairs of one bucket and different groups these make.

    It decides only whether hubs are drawn again; pairs of unlike sizes may reach from other places, so it is about right, not exact.
    """
    reach = F.col("pos") * (SHARE[0] + SHARE[1]) <= F.col("n") * (SHARE[1] - SHARE[0])
    groups = named.filter(reach).groupBy("token", "group").agg(F.count("*").alias("k"))
    buckets = groups.groupBy("token").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"))
    rows, pairs = buckets.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(rows or 0), int(pairs or 0)


def _pairs(shared: DataFrame, x: str, y: str) -> DataFrame:
    """a, b: the different pairs in the columns x and y, the larger node first."""
    return shared.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _drawn(named: DataFrame, turn: int) -> DataFrame:
    """a, b: each node with a hub that is drawn for its bucket, if they are in different groups and may be similar enough."""
    hub = F.min(F.struct(F.xxhash64("token", "node", F.lit(turn)).alias("draw"), "node", "n", "pos", "group")).alias("hub")
    hubs = named.groupBy("token").agg(hub).select("token", *[F.col(f"hub.{c}").alias(f"{c}_hub") for c in ("node", "n", "pos", "group")])
    return _pairs(named.join(hubs, "token").filter((F.col("group") != F.col("group_hub")) & _may_reach("n", "pos", "n_hub", "pos_hub")), "node", "node_hub")


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their ranks from 1, the most frequent last."""
    some = rows.filter(F.pmod("node", F.lit(SAMPLED)) == 0)
    held = _per_text(some, "token long", lambda _, text: [pa.array(shingle_set(text, shingle).view(np.int64), pa.int64())])
    counts = held.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "token").limit(NAMED).collect()
    values = np.array([r.token for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(top) - np.arange(len(top)))[order]


def near_components(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """node, label (the smallest node of the component) of rows(node, text), where equal nodes have equal word lines.

    Links are all pairs of nodes whose sets of so many words have Jaccard SHARE or more.
    """
    rows = rows.select("node", "text")
    linked = materialize(linked_nodes(rows), "near-linked")
    likened = _alike_pairs(linked, rows, shingle)
    ends = materialize(likened.select(F.explode(F.array("a", "b")).alias("fp")).distinct().withColumn("label", F.col("fp")), "near-ends")
    groups = materialize(components(likened, ends), "near-groups")
    often, rank = _frequent(rows, shingle)

    def placed(node: int, text: str) -> list[pa.Array]:
        found = shingle_set(text, shingle)
        first = prefix(found, often, rank)
        n = len(first)
        return [
            pa.array(first.view(np.int64), pa.int64()),
            pa.array(np.full(n, node, np.int64)),
            pa.array(np.full(n, len(found), np.int32)),
            pa.array(np.arange(n, dtype=np.int32)),
        ]

    placed_rows = _per_text(rows, "token long, node long, n int, pos int", placed)
    bucket = Window.partitionBy("token")
    first = F.min(F.struct("pos", "node", "n")).over(bucket)
    ends = {"least": F.min("node").over(bucket), "last": F.max("node").over(bucket)}
    shared = placed_rows.withColumn("first", first).withColumns(ends).filter("least < last")
    buckets = materialize(
        shared.dropDuplicates(["token", "node"]).select("token", "node", "n", "pos", F.col("first.node").alias("node0"), F.col("first.n").alias("n0"), F.col("first.pos").alias("pos0")),
        "near-buckets",
    )
    nodes = materialize(rows.select(F.col("node").alias("fp")).distinct().withColumn("label", F.col("fp")), "near-nodes")

    stars = buckets.filter((F.col("node") != F.col("node0")) & _may_reach("n", "pos", "n0", "pos0"))
    asked = materialize(_apart(_pairs(stars, "node", "node0"), groups), "near-stars")
    found = materialize(likened.unionByName(_verified(asked, rows, shingle)), "near-found")
    # What these have joined needs no more pairs.
    named = _grouped(buckets, found)
    discard(buckets, asked)
    size, apart = _left_apart(named)
    before, turn = 2 * apart, 0
    while apart > ROOM * size and 4 * apart <= 3 * before:
        turn += 1
        asked = materialize(_drawn(named, turn), "near-drawn")
        found = materialize(found.unionByName(_verified(asked, rows, shingle)), "near-found")
        old, named = named, _grouped(named.drop("group"), found)
        discard(old, asked)
        before, apart = apart, _left_apart(named)[1]
    x, y = (named.filter("node <> node0").select("token", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "pos", "group")]) for k in (1, 2))
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("node1") < F.col("node2")) & (F.col("group1") != F.col("group2")) & _may_reach("n1", "pos1", "n2", "pos2"))
    more = materialize(_pairs(pairs, "node1", "node2"), "near-pairs")
    edges = materialize(found.unionByName(_verified(more, rows, shingle)), "near-edges")
    discard(named, more)
    return components(edges, nodes).select(F.col("fp").alias("node"), "label")


def drop_near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with the columns of docs: of the smallest id (null ids last), then by a hash of the row.

    Texts are equal nodes if their words are; texts without words, null ones too, are copies of each other. Repeated rows
    leave one. An empty table gives none. Columns may have any names.
    """
    given = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    names, at = [*docs.columns, "_near_node"], docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_near_node", T.LongType())])

    def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = np.array([xxhash.xxh64_intdigest(word_line(x or ""), 7) for x in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=names)

    # Row numbers are fixed by writing them out.
    scored = materialize(docs.mapInArrow(lean(lined), schema).withColumn("_near_row", F.monotonically_increasing_id()), "near-docs")
    found = materialize(near_components(scored.select(F.col("_near_node").alias("node"), F.col(f"`{text_col}`").alias("text")), shingle), "near-components")
    ids = F.col(f"`{id_col}`")
    keyed = scored.select("_near_node", F.struct(ids.isNull().alias("none"), ids.alias("id"), row_hash(docs).alias("hash"), "_near_row").alias("key"))
    # Copies are thinned first: a node's rows are combined before the shuffle.
    best = keyed.groupBy(F.col("_near_node").alias("node")).agg(F.min("key").alias("key"), F.count("*").alias("rows")).join(found, "node")
    best = materialize(best, "near-best")
    groups = best.groupBy("label").agg(F.min("key").alias("key"), F.sum("rows").alias("rows")).filter("rows > 1")
    kept = groups.select(F.col("key._near_row").alias("_near_row"))
    # Most texts stand alone and stay where they lie; the others are shuffled, at every size.
    bits = _wanted_bits(best.join(groups.select("label"), "label", "left_semi"))

    def split(inside: bool) -> DataFrame:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_may_want(bits, batch.column(node_at)) == inside))

        return scored.mapInArrow(lean(mapped), scored.schema)

    node_at = scored.columns.index("_near_node")
    alone = best.join(groups.select("label"), "label", "left_anti").select(F.col("key._near_row").alias("_near_row"))
    some = split(True).join(kept.unionByName(alone).hint("shuffle_hash"), "_near_row", "left_semi")
    return split(False).unionByName(some).select(*docs.columns).toDF(*given)
