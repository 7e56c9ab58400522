"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are compared by exclusive-or and bit counts in numpy, tile against tile. A tile holds fingerprints in the
order of their bit counts, and two tiles whose bit counts lie further apart than the radius are skipped: fingerprints
that differ in r bits have bit counts that differ by r at most. To keep the comparisons local, tiles are made within
buckets: of 2 r blocks of bits, fingerprints within r bits agree on r at least, so each choice of r blocks (20 of 3 out of
6, of some 32 bits each) makes buckets of its own and no link is lost. Large buckets are cut into tiles of TILE fingerprints, and each pair of tiles that is not skipped is
a task's work. What a tile pair finds is thinned to a forest before it leaves the task; components follow by rounds of
label passing over the forest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.common import lean, materialize, numbered, row_hash

BITS, TILE = 64, 4096
_WORD_BYTES = bytes(b if b not in b"\t\n\x0b\x0c\r" else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TABLE = bytes(_LOWER[b] for b in _WORD_BYTES)


def word_line(text: str) -> bytes:
    """The text's words in lower case (of ASCII), one space between."""
    return b" ".join(w for w in text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if w)


def shingle_hashes(line: bytes, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of so many words of a word_line(), repeats included; of the whole line if it is shorter; none if empty."""
    import xxhash

    if not line:
        return []
    stops = [i for i, b in enumerate(line) if b == 32] if len(line) < 64 else np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    digest = xxhash.xxh64_intdigest
    if len(stops) + 1 <= shingle:
        return [digest(line, seed)]
    starts = [0, *(s + 1 for s in stops)]
    ends = [*stops, len(line)]
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles, repeats included; none: 0."""
    hashes = shingle_hashes(word_line(text), shingle, seed)
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 1 << 14):
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = 3, drop_text: bool = False) -> DataFrame:
    """docs with a column of 64-bit fingerprints (as signed long), without the text if so asked; a null text counts as empty."""
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if i != at or not drop_text]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or "", shingle) for x in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.int64())], names=schema.names)

    return docs.mapInArrow(lean(hashed), schema)


class Forest:
    """Union-find over positions 0 .. n-1, joined in blocks of edges."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            a, b = a[differ], b[differ]
            low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            self.parent[high] = low  # of several, one stays; the others come again

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if (up == r).all():
                return r
            p[x] = up
            r = up


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (pairs of fingerprints) with the components that the links within the radius make.

    right None: links inside left. Rows are compared a strip at a time, only with the range of bit counts in reach.
    """
    other = left if right is None else right
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    left_order, other_order = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(other), kind="stable")
    x, y = left[left_order], other[other_order]
    cx, cy = np.bitwise_count(x).astype(np.int64), np.bitwise_count(y).astype(np.int64)
    forest = Forest(len(both))
    step = 256
    for at in range(0, len(x), step):
        strip = x[at : at + step]
        lo = np.searchsorted(cy, cx[at] - radius, "left")
        hi = np.searchsorted(cy, cx[min(at + step, len(x)) - 1] + radius, "right")
        if right is None:
            lo = max(lo, at)
        if lo >= hi:
            continue
        near = np.bitwise_count(strip[:, None] ^ y[None, lo:hi]) <= radius
        i, j = np.nonzero(near)
        forest.join(left_order[at + i], shift + other_order[lo + j])
    child = np.flatnonzero(forest.parent != np.arange(len(both)))
    return both[forest.roots(child)], both[child]


def masks(radius: int) -> list[int]:
    """Masks (signed) of the bits on which fingerprints are bucketed: any two within the radius agree on one of them.

    Up to a radius of 3 these are all choices of as many out of twice as many blocks; beyond, single blocks of radius + 1.
    """
    blocks, together = (2 * radius, radius) if 1 <= radius <= 3 else (radius + 1, 1)
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    found = [sum(chosen) for chosen in itertools.combinations(parts, together)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: a forest of links between the distinct fingerprints of prints(fp) whose components are those of all links."""
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("block", "value"))
    counts = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    joined = keyed.join(counts, ["block", "value"])
    small = joined.filter(F.col("n") <= TILE)
    large = joined.filter(F.col("n") > TILE)

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; each whole bucket is in one task."""
        rest: pd.DataFrame | None = None

        def compare(frame: pd.DataFrame) -> pa.RecordBatch:
            fp = frame["fp"].to_numpy().view(np.uint64)
            same = (frame["block"].to_numpy()[1:] == frame["block"].to_numpy()[:-1]) & (frame["value"].to_numpy()[1:] == frame["value"].to_numpy()[:-1])
            starts = np.r_[0, np.flatnonzero(~same) + 1, len(fp)]
            sizes = np.diff(starts)
            a, b = [], []
            two = starts[:-1][sizes == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a.append(fp[two[near]])
            b.append(fp[two[near] + 1])
            for k in np.flatnonzero(sizes > 2):
                x, y = link_tiles(fp[starts[k] : starts[k + 1]], None, radius)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(z).view(np.int64), pa.int64()) for z in (a, b)], names=["a", "b"]
            )

        for batch in batches:
            frame = batch.to_pandas()
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame["block"] == frame["block"].iloc[-1]) & (frame["value"] == frame["value"].iloc[-1])
            rest = frame[last]
            if not last.all():
                yield compare(frame[~last])
        if rest is not None and len(rest):
            yield compare(rest)

    near = small.repartition("block", "value").sortWithinPartitions("block", "value").select("block", "value", "fp").mapInArrow(in_buckets, "a long, b long")

    # Large buckets: tiles in bit count order (a tile has a place in its bucket), and every pair of tiles in reach.
    ones = F.bit_count(F.col("fp")).cast("int")
    n_tiles = F.ceil(F.col("n") / TILE)
    spread = large.withColumn("ones", ones).withColumn("part", F.pmod(F.xxhash64("fp"), n_tiles).cast("int"))
    tiles = spread.groupBy("block", "value", "ones", "part").agg(F.collect_list("fp").alias("fps"))
    named = materialize(tiles, "simhash-tiles")
    left = named.select("block", "value", F.col("ones").alias("o1"), F.col("part").alias("p1"), F.col("fps").alias("f1"))
    right = named.select("block", "value", F.col("ones").alias("o2"), F.col("part").alias("p2"), F.col("fps").alias("f2"))
    pairs = left.join(right, ["block", "value"]).filter(
        (F.col("o2") - F.col("o1")).between(0, radius) & ((F.col("o1") < F.col("o2")) | (F.col("p1") <= F.col("p2")))
    )

    def pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = np.array(row["f1"], np.int64).view(np.uint64), np.array(row["f2"], np.int64).view(np.uint64)
                a, b = link_tiles(x, None if (row["o1"], row["p1"]) == (row["o2"], row["p2"]) else y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64), pa.int64()) for z in (a, b)], names=["a", "b"])

    far = pairs.repartition("block", "value", "o1", "p1", "o2", "p2").select("o1", "p1", "f1", "o2", "p2", "f2").mapInArrow(pair_links, "a long, b long")
    return near.unionByName(far).distinct()


def linked_nodes(rows: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """a, b: pairs of nodes of rows(node, text), a > b, whose components are those of all fingerprints within the radius.

    Equal nodes have equal word lines. Nodes of one fingerprint are linked to the smallest of them, and these along links().
    """
    prints = materialize(add_fingerprint(rows.select("node", "text"), "text", "fp", shingle, drop_text=True).distinct(), "simhash-prints")
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "simhash-first")
    x, y = (first.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_first")) for n in ("a", "b"))
    across = links(first.select("fp"), radius).join(x, "a").join(y, "b").select(F.greatest("a_first", "b_first").alias("a"), F.least("a_first", "b_first").alias("b"))
    within = prints.join(first, "fp").filter("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return across.unionByName(within)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """fp, label: the smallest label of each component; edges(a, b) over labels(fp, label), every node labelled.

    Alternating star contractions: each node links its larger neighbours, then its smaller ones, to the smallest. Stars are
    left after a number of rounds that grows with the logarithm of the longest path. Each round is written out.
    """
    rank = labels.select("fp", "label")
    named = (
        edges.join(rank.select(F.col("fp").alias("a"), F.col("label").alias("u")), "a")
        .join(rank.select(F.col("fp").alias("b"), F.col("label").alias("v")), "b")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    named = materialize(named, "simhash-edges")
    seen = None
    while True:
        # large star: larger neighbours of each node go to its smallest neighbour (or itself)
        both = named.unionByName(named.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        named = materialize(stars.distinct(), "simhash-stars")
        state = named.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    roots = named.groupBy("u").agg(F.min("v").alias("root"))
    return labels.join(roots, labels["label"] == roots["u"], "left").select("fp", F.coalesce("root", "label").alias("label"))


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (as signed long), component_id (smallest id reachable by links) of every row.

    Empty and null texts have fingerprint zero and are linked like any other. Rows with a null id get fingerprints and the
    smallest id of their component, null if it has none. Repeated rows give repeated rows, an empty table none.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(add_fingerprint(rows, "text", "fp", shingle).drop("text"), "simhash-prints")
    # Every fingerprint is a node, named by itself, so rows without an id carry links like any other.
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-smallest")
    found = materialize(_named_by_itself(smallest, radius), "simhash-components")
    ids = smallest.join(found, "fp").groupBy("label").agg(F.min("id").alias("component_id"))
    named = materialize(found.join(ids, "label").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _named_by_itself(prints: DataFrame, radius: int) -> DataFrame:
    """fp, label (the smallest fingerprint of its component) of the distinct fingerprints of prints(fp)."""
    return components(links(prints.select("fp"), radius), prints.select("fp", F.col("fp").alias("label")))


def drop_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component that has an id, with the columns of docs: of the smallest id, then by a hash of the row.

    Rows without an id carry links, but a component of these alone has no row here; near.drop_near_copies(), which the
    pipeline uses, keeps one. Columns may have any names; an empty table gives none.
    """
    given = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    scored = materialize(
        add_fingerprint(docs.withColumn("_sim_text", F.col(f"`{text_col}`")), "_sim_text", "_sim_fp", shingle)
        .drop("_sim_text")
        .withColumn("_sim_row", F.monotonically_increasing_id()),
        "simhash-docs",
    )
    ids = F.col(f"`{id_col}`").cast("long")
    key = F.struct(ids.isNull().alias("none"), ids.alias("id"), row_hash(docs).alias("hash"), "_sim_row")
    best = materialize(scored.groupBy(F.col("_sim_fp").alias("fp")).agg(F.min(key).alias("key")), "simhash-best")
    found = _named_by_itself(best, radius)
    kept = best.join(found, "fp").groupBy("label").agg(F.min("key").alias("key")).filter("not key.none").select(F.col("key._sim_row").alias("_sim_row"))
    return scored.join(kept, "_sim_row", "left_semi").select(*docs.columns).toDF(*given)
